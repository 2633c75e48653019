"""Generated, minified or vendored source files (problem 7).

Method: a Re-Pair grammar is inferred over the token classes of every file.

* Generated: the share of tokens that the rules save (``reuse``). Above the upper threshold of its language a file counts as
  machine-made whatever its comments say, unless they say that it is kept by hand; below the lower one it never does; in
  between a notice in its comments breaks the tie.
* Blob: files that are almost only literals. A second grammar, over the characters of the literals, gives their size in
  bits; literals that it hardly makes smaller are data.
* Vendored: an index of rules of known upstream files. A file that shares at least half of its rules with one of them is a
  candidate copy, and equal code (without leading comments, line ends and trailing blanks) confirms it. A directory for
  bundled dependencies makes a file vendored by definition. ``shared_rules`` counts the repositories that rules occur in;
  as equal files in two repositories mean nothing by themselves, that count is reported and flags nothing.
* Minified code shows in its lines and blanks, which the grammar doesn't see.

The thresholds were set on labelled rows: at most ``LABELLED`` files, positive if a notice heads them, else negative; the
thresholds lie in the gap between the two (python: negatives up to 0.68, positives from 0.71; js: 0.72 and 0.88).

Notices count in comments and in the docstring that heads a file, never in other strings, so that code about generated
files stays hand-written.

Defined cases: null content, other languages and empty files are no cases; a file may have several reasons and comes out
once; text that isn't UTF-8 is read with replacement; very long files are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import materialize, spread
from graphloom.llm import docpairs
from graphloom.llm.syntax import with_language

#: Directories that package managers and custom reserve for bundled dependencies (fixed values).
BUNDLED = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "web_modules", "site-packages", "dist-packages", "godeps", "pods")
#: Below the first never generated, from the second on always; a notice decides between them.
REUSE = {"python": (0.5, 0.72), "js": (0.6, 0.8)}
#: Bound of the labelled rows that the thresholds were set on.
LABELLED = 60_000
LITERAL_SHARE, LITERAL_CHARS, LITERAL_RATIO, CONTROL_SHARE = 0.6, 600, 0.25, 0.01
LONG_LINE, LONG_SHARE, BLANK_SHARE = 200, 0.6, 0.1
RULE_TOKENS = 12
MAX_UPSTREAM = 200_000

_NOTICE = re.compile(
    r"(?:@generated\b|\bauto-?\s?generated\b|\bautomatically (?:generated|created|produced|built|compiled)\b|\bgenerated (?:by|from|with|using|at|on|code|file|automatically)\b|\bcode generated\b|\b(?:this|the) (?:file|class|module|code) (?:is|was|has been) (?:\w+ )?generated\b"
    r"|\bdo not (?:edit|modify|change)\b|\bdon't (?:edit|modify)\b|\bautogenerated\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)\b|\bgénéré (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\bproduced by\b.{0,40}\btool\b|\bmachine[- ]generated\b)", re.I
)
_BY_HAND = re.compile(r"(?:maintained|written|kept|edited|gepflegt|geschrieben|maintenu|mantenido)[^.\n]{0,24}\b(?:by hand|manually|von hand|à la main|a mano)\b|(?<!not )(?<!never )\bhand-?written\b|\bvon hand (?:gepflegt|geschrieben)\b", re.I)
FEATURES = "file_id bigint, repository_id string, lang string, n_tokens int, reuse double, control_share double, literal_share double, literal_chars bigint, literal_ratio double, long_share double, blank_share double, notice string, by_hand boolean, bundled boolean, code_hash string, rules array<bigint>"


def repair(tokens: np.ndarray, least: int = 2) -> tuple[int, list[tuple[int, int, int]], int]:
    """Re-Pair: (length of the final sequence, rules (symbol, left, right), greatest symbol).

    The most frequent adjacent pair becomes a new symbol until none occurs ``least`` times; ties go to the smaller pair, so equal
    sequences give equal grammars. Occurrences that overlap (``aaa``) count from the left.
    """
    seq = tokens.astype(np.int64)
    top = int(seq.max(initial=0))
    rules = []
    while len(seq) > 1:
        pairs = (seq[:-1] << 31) | seq[1:]
        values, counts = np.unique(pairs, return_counts=True)
        i = int(np.argmax(counts))
        if counts[i] < least:
            break
        at = np.flatnonzero(pairs == values[i])
        if int(values[i]) >> 31 == int(values[i]) & 0x7FFFFFFF and len(at) > 1:
            runs = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            first = at[np.searchsorted(runs, runs)]
            at = at[(at - first) % 2 == 0]
            if len(at) < 2:
                break
        top += 1
        rules.append((top, int(values[i]) >> 31, int(values[i]) & 0x7FFFFFFF))
        seq = seq.copy()
        seq[at] = top
        seq = np.delete(seq, at + 1)
    return len(seq), rules, top


def literal_ratio(raw: str) -> float:
    """Bits of the grammar over the characters of ``raw`` per bit of ``raw`` at 8 bits each; about 0.75 for base64 noise."""
    codes, seq = np.unique(np.frombuffer(raw.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    left, rules, _ = repair(seq + 1, 3)  # a pair that comes twice saves nothing
    return (left + 2 * len(rules)) * math.log2(max(2, len(codes) + len(rules))) / (8 * len(seq)) if len(seq) else 0.0


def rule_hashes(rules: list[tuple[int, int, int]], names: list[str], least: int = RULE_TOKENS) -> list[int]:
    """Hashes of what the rules of at least ``least`` tokens expand to; those inside another such rule are left out."""
    size: dict[int, int] = {}
    text: dict[int, int] = {}

    def h(*x) -> int:
        return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big", signed=True)

    for i, n in enumerate(names, 1):
        size[i], text[i] = 1, h(n)
    inner = set()
    for s, a, b in rules:
        size[s], text[s] = size[a] + size[b], h(text[a], text[b])
        inner.update((a, b))
    return sorted({text[s] for s, _, _ in rules if size[s] >= least and s not in inner})


#: Tokens that only code which does something has.
_CONTROL = frozenset("def class return if for while try with raise lambda async function throw switch =>".split())
_PY_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


def tokens_of(lang: str, text: str) -> tuple[list[str], list[str], str, list[str]]:
    """(token classes, literals, comments in order, text of the head: leading comments and docstring)."""
    classes: list[str] = []
    literals: list[str] = []
    comments: list[str] = []
    head: list[str] = []
    code = False
    fresh, depth = True, 0  # at the start of a statement
    if lang == "python":
        for m in docpairs._PY.finditer(text):
            kind, v = m.lastgroup, m[0]
            if kind == "n":
                fresh = depth == 0 or fresh
            elif kind == "o":
                depth += 1
            elif kind == "x":
                depth = max(0, depth - 1)
            if kind == "c":
                comments.append(v)
                if not code:
                    head.append(v)
            elif kind == "n" or kind == "k" or v.isspace():
                continue
            else:
                if kind == "s":
                    if not code:
                        head.append(v)
                        comments.append(v)
                    classes.append("s")
                    if not fresh:  # a string that is a statement is documentation
                        literals.append(v)
                elif v[0].isdigit():
                    classes.append("0")
                    literals.append(v)
                elif v[0].isalpha() or v[0] == "_":
                    classes.append(v if v in _PY_KEYWORDS else "n")
                else:
                    classes.append(v)
                code, fresh = True, False
    else:
        water = docpairs._JsWater(text)
        first = None
        for a, b, kind, _ in water.tokens():
            first = a if first is None else first
            if kind in ("str", "tpl", "num"):
                classes.append("0" if kind == "num" else "s")
                literals.append(text[a:b])
            else:
                classes.append("n" if kind in ("id", "priv") else kind)
        for no in sorted(water.comments):
            start, c, _ = water.comments[no]
            comments.append(c)
            if first is None or water.starts[start] <= first:
                head.append(c)
    return classes, literals, "\n".join(comments), head


_LEADING = {"python": re.compile(r"(?:\s*#[^\n]*(?:\n|\Z)|\s*\n)*"), "js": re.compile(r"(?:\s+|//[^\n]*(?:\n|\Z)|/\*.*?\*/|#![^\n]*\n)*", re.S)}


def code_of(lang: str, data: bytes) -> str:
    """The code as it is compared: no leading comments, one kind of line end, no trailing blanks."""
    text = data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    text = text[_LEADING[lang].match(text).end() :] if text else ""
    return "\n".join(line.rstrip() for line in text.split("\n")).strip("\n")


def is_notice(text: str) -> bool:
    return bool(_NOTICE.search(text)) and not _BY_HAND.search(text)


def features(file_id: int, repo: str, lang: str, path: str, data: bytes) -> tuple:
    text = data.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    classes, literals, comments, head = tokens_of(lang, text)
    names = sorted(set(classes))
    index = {c: i for i, c in enumerate(names, 1)}
    n = len(classes)
    left, rules, _ = repair(np.array([index[c] for c in classes], dtype=np.int64)) if n else (0, [], 0)
    solid = sum(len(x) for x in text.split())
    chars = sum(map(len, literals))
    share = chars / solid if solid else 0.0
    control = sum(c in _CONTROL for c in classes) / n if n else 0.0
    ratio = literal_ratio("".join(literals)) if share >= LITERAL_SHARE and chars >= LITERAL_CHARS and control <= CONTROL_SHARE else 0.0
    notice = "head" if any(is_notice(c) for c in head) else "inside" if any(is_notice(c) for c in comments.split("\n")) else ""
    lines = text.split("\n")
    long = sum(len(x) for x in lines if len(x) >= LONG_LINE)
    bundled = any(p.lower() in BUNDLED for p in path.split("/")[:-1])
    code = code_of(lang, data)
    return (
        file_id, repo, lang, n, round(1 - (left + 2 * len(rules)) / n, 6) if n else 0.0, control, share, chars,
        ratio, long / len(text) if text else 0.0, 1 - solid / len(text) if text else 0.0, notice, bool(_BY_HAND.search(comments)), bundled,
        hashlib.sha256(code.encode("utf-8", "replace")).hexdigest() if code else None, rule_hashes(rules, names),
    )


_COLUMNS = [c.split()[0] for c in FEATURES.split(", ")]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [features(i, r, lang, p, bytes(c)) for i, r, lang, p, c in zip(pdf["file_id"], pdf["repository_id"], pdf["lang"], pdf["path"], pdf["content"])]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def file_features(files: DataFrame) -> DataFrame:
    take = with_language(files.select("file_id", "repository_id", "path", "content")).where("content is not null and lang in ('python', 'js') and length(content) > 0")
    return spread(take.select("file_id", "repository_id", "lang", "path", "content")).mapInPandas(_run, FEATURES)


def upstream_features(third_party: DataFrame) -> DataFrame:
    lang = F.when(F.lower("language").startswith("py") | F.col("file_name").endswith(".py"), "python").otherwise("js")
    take = third_party.where("content is not null and length(content) > 0").select(
        F.col("tp_id").cast("bigint").alias("file_id"), F.lit("").alias("repository_id"), lang.alias("lang"), F.col("file_name").alias("path"), "content"
    )
    return take.mapInPandas(_run, FEATURES)


def copies(feats: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, tp_id, shared): files that share rules with an upstream file and have its code.

    Files too short for a rule are compared by their code alone. The upstream side is a table of known files; it is
    broadcast only if it has at most ``MAX_UPSTREAM`` rules.
    """
    u = materialize(upstream, "upstream")
    rules = u.select(F.col("file_id").alias("tp_id"), "lang", F.explode("rules").alias("rule"))
    small = rules.count() <= MAX_UPSTREAM
    hint = F.broadcast if small else (lambda df: df)
    near = feats.select("file_id", "lang", F.size("rules").alias("n_rules"), F.explode("rules").alias("rule")).join(hint(rules), ["lang", "rule"])
    near = near.groupBy("file_id", "tp_id", "n_rules").agg(F.count(F.lit(1)).alias("n")).where("2 * n >= n_rules")
    near = near.select("file_id", "tp_id", (F.col("n") / F.col("n_rules")).alias("shared"))
    short_u = u.where("size(rules) = 0").select(F.col("file_id").alias("tp_id"), F.col("code_hash").alias("short_hash"))
    short = feats.where("size(rules) = 0 and code_hash is not null").join(hint(short_u), F.col("code_hash") == F.col("short_hash")).select("file_id", "tp_id", F.lit(1.0).alias("shared"))
    codes = u.select(F.col("file_id").alias("tp_id"), F.col("code_hash").alias("tp_hash"))
    checked = near.unionByName(short).join(hint(codes), "tp_id").join(feats.select("file_id", "code_hash"), "file_id")
    return checked.where("code_hash = tp_hash").select("file_id", "tp_id", "shared")


def reasons(files: DataFrame, third_party: DataFrame) -> DataFrame:
    """(file_id, repository_id, reasons array<string>): reasons among generated, minified, vendored, blob; empty for
    hand-written files."""
    feats = materialize(file_features(files), "origin-features")
    copied = copies(feats, upstream_features(third_party)).select("file_id").distinct().withColumn("copied", F.lit(True))
    c = F.col
    blob = (c("literal_share") >= LITERAL_SHARE) & (c("literal_chars") >= LITERAL_CHARS) & (c("literal_ratio") >= LITERAL_RATIO) & (c("control_share") <= CONTROL_SHARE)
    minified = (c("long_share") >= LONG_SHARE) & (c("blank_share") < BLANK_SHARE) & ~blob
    low, high = (F.create_map(*[F.lit(x) for k, v in REUSE.items() for x in (k, v[i])])[c("lang")] for i in (0, 1))
    generated = (c("reuse") >= high) & ~blob & ~minified & ~c("by_hand") | (c("reuse") >= low) & (c("notice") != "")
    vendored = c("bundled") | F.coalesce("copied", F.lit(False))
    tags = [F.when(x, n) for n, x in (("generated", generated), ("minified", minified), ("vendored", vendored), ("blob", blob))]
    return feats.join(copied, "file_id", "left").select("file_id", "repository_id", "lang", F.array_compact(F.array(*tags)).alias("reasons"))


def shared_rules(files: DataFrame) -> DataFrame:
    """(file_id, n_rules, n_shared, most): how many rules of a file occur in other repositories too, and the greatest number
    of repositories one of them occurs in. Rules are counted map-side, so a rule that most files have makes no large group."""
    rules = materialize(file_features(files).select("file_id", "repository_id", "lang", F.explode("rules").alias("rule")), "rules")
    seen = rules.groupBy("lang", "rule", "repository_id").agg(F.lit(1).alias("one")).groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(seen, ["lang", "rule"]).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("n") > 1).alias("n_shared"), F.max("n").alias("most")
    )
