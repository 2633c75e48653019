"""Credentials embedded in source code and configuration (problem 5).

Method: a keyword automaton (Aho-Corasick, lower case) runs over each text once. At each hit, and only there, the rule of
that keyword is tried: an issuer's format, a private key block, the password part of a connection URL, the encoded part
after an authentication scheme, or the literal assigned to a key whose name says secret. The literal is then validated:
issuer formats by alphabet, length and variety or, where the issuer has one, checksum, web tokens by their decoded header,
Basic by decoding to ``user:password``, named values by structure (placeholders,
look-ups, hashes, plain settings and plain words are no credentials). Matches are replaced by placeholders of the same
length whose every character stays in its class (digit, lower, upper, other kept), so the code around keeps parsing.

Defined cases: null and empty texts give nothing; the same literal twice in a text is one case and both places are
replaced; repeated rows are rows of their own; texts are searched whole, whatever their length; long lines are no special
case because rules are anchored at hits.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Issuer prefixes and formats (fixed values of the issuers' public documentation).
ISSUERS = {
    "akia": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "asia": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ghp_": r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "gho_": r"gho_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "ghu_": r"ghu_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "ghs_": r"ghs_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "ghr_": r"ghr_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{50,}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{20,}",
    "xoxb-": r"xoxb-[0-9]{6,}-[0-9A-Za-z-]{10,}",
    "xoxp-": r"xoxp-[0-9]{6,}-[0-9A-Za-z-]{10,}",
    "xoxa-": r"xoxa-[0-9]{6,}-[0-9A-Za-z-]{10,}",
    "xoxr-": r"xoxr-[0-9]{6,}-[0-9A-Za-z-]{10,}",
    "xoxs-": r"xoxs-[0-9]{6,}-[0-9A-Za-z-]{10,}",
    "sk_live_": r"sk_live_[0-9A-Za-z]{16,}",
    "rk_live_": r"rk_live_[0-9A-Za-z]{16,}",
    "sk_test_": r"sk_test_[0-9A-Za-z]{16,}",
    "aiza": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    "npm_": r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "pypi-": r"pypi-[0-9A-Za-z_-]{40,}",
    "eyj": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}(?![0-9A-Za-z_.-])",
    "hooks.slack.com/services/": r"hooks\.slack\.com/services/T[0-9A-Z]{6,}/B[0-9A-Z]{6,}/[0-9A-Za-z]{16,}",
    "accountkey=": r"AccountKey=[0-9A-Za-z+/]{60,}={0,2}",
    "sk-": r"sk-(?:[a-z]+-)?[0-9A-Za-z_-]{32,}(?![0-9A-Za-z_-])",
    "ya29.": r"ya29\.[0-9A-Za-z_-]{20,}",
    "sg.": r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}",
}
#: Words in the name of a key that make its literal a candidate.
NAMED = ("password", "passwd", "passphrase", "pwd", "pass", "pw", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "auth_key", "authkey", "private_key", "signing_key", "signingkey", "encryption_key", "pat", "credential", "creds")
SCHEMES = ("bearer", "basic")
PAIRS = ("auth", "login", "-u", "--user", "creds", "logs in", "log in", "logged in", "sign in", "signs in", "sshpass", "mysql", "mongo", "redis-cli", "ldapsearch", "psql")

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SCHEME = re.compile(r"(?:Bearer|Basic)[ \t]+([A-Za-z0-9+/_.~=-]{8,})", re.I)
_URL = re.compile(r"://[^\s/:@'\"`<>]*:([^\s/@'\"`<>]+)@[\w.\[{$-]")
_ISSUER = {k: re.compile(v) for k, v in ISSUERS.items()}
_KEY_RUN = re.compile(r"[A-Za-z0-9_.$-]*")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
#: Keys that name nothing but a password; what is assigned to them needs less of a secret's structure.
_PASSWORD_KEY = re.compile(r"(?i)(?:^|[_.-]|[a-z](?=P))(?:password|passwd|passphrase|pwd)$")
#: From the start of the key: the name, how it is closed, what assigns, and the literal.
_ASSIGN = re.compile(
    r"""(?P<key>[A-Za-z0-9_.$-]+)
    (?P<close>\\?["'])?[ \t]*\]?[ \t]*
    (?:
      (?P<typed>:\s*[A-Za-z_][\w.\[\], |]*=) | (?P<op>:=|=>|={1,3}|:) | (?P<comma>,) | (?P<tag>>) | (?P<blank>[ \t])
    )[ \t]*
    (?:
      \\?(?P<q>\"{3}|'{3}|["'`])(?P<val>.*?)\\?(?P=q) | (?P<bare>[^\s"'`,;<>()\[\]{}]+)
    )""",
    re.X | re.S,
)
_PAIR = re.compile(
    r"""(?:auth|login|creds)["']?\s*(?:=|:)?\s*[(\[]\s*(?P<q1>["'])[^"'\n]+(?P=q1)\s*,\s*(?P<q>["'])(?P<val>[^"'\n]+)(?P=q)\s*[)\]]
      | login[ \t]+(?:is[ \t]+)?[\w.@-]+[ \t]*[/:][ \t]*(?P<say1>\S+)
      | (?:log|logs|logged|sign|signs)[ \t]in[ \t](?:\w+[ \t]){0,3}?(?:with|using)[ \t](?:[\w.@-]+[ \t]*[/:][ \t]*)?(?P<say2>\S+)
      | sshpass[ \t]+-p[ \t]*["']?(?P<ssh>[^\s"']+)
      | (?:mysql|mongo)\w*[ \t](?:[^\n|;&]*?[ \t])?-p[ \t]?["']?(?P<sql>[^\s"'-][^\s"']*)
      | (?:redis-cli|ldapsearch)[ \t](?:[^\n|;&]*?[ \t])?-[aw][ \t]+["']?(?P<red>[^\s"']+)
      | (?:-u|--user)["']?[\s,=]+["']?[A-Za-z0-9_.@-]+:(?P<cli>[^\s"'`@]+)""",
    re.X | re.I,
)
#: What a key's name must not say: settings, names and hashes that only mention a secret.
_HARMLESS = re.compile(
    r"(?i)(?:^|[_.-])(?:min|max|length|len|field|type|name|names|budget|count|limit|ttl|expiry|expires|hash|public|id|url|uri|path|file|prefix|header|policy|rotation|hint|regex|pattern|label|version|size|cost)s?(?:$|[_.-])"
    r"|(?:length|budget|hash|field|type|name|limit|count)$|^(?:max|min)(?:tokens?|pass)|public_?key|^(?:pass|path|patch|pattern|pat)$(?<!pass)(?<!pat)"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:\$\{|\{\{|<[^>]*>|%\(|#\{|\$\(|\[\[|os\.environ|getenv|process\.env|vault[:_/]|secretsmanager).*"
    r"|(?:.*[^a-z0-9])?(?:your|replace|change|insert|placeholder|example|dummy|sample|redacted|todo)(?:[^a-z0-9].*)?"
    r"|[x*.#•_-]+|(?:\*|x|•|\.){3,}.*|none|null|nil|undefined|true|false|test|secret|password|token|changeme)$"
)
_HASH = re.compile(r"^(?:\$2[aby]\$|\$argon2|\$pbkdf2|\$[156]\$|pbkdf2[:_]|sha(?:1|256|384|512)[-:]|md5:|scrypt:|data:)", re.I)
_LOOKUP = re.compile(r"^(?:self|this|settings|config|conf|os|env|process|request|ctx|args|options|params|secrets|vault|get|read|load)\b|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|^\$[A-Za-z_]\w*$|^%\w+%$|^[\w.$\[\]'\"-]*\(.*\)?;?$|\)$")
_WORDS = re.compile(r"[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]?[a-z]+(?:[ _.:/-][A-Za-z]?[a-z]+)*|[A-Z]+(?:[_-][A-Z]+)*")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {"-----begin": [("pem", "")], "://": [("url", "")]}
    for k in ISSUERS:
        kinds.setdefault(k, []).append(("issuer", k))
    for k in SCHEMES:
        kinds.setdefault(k, []).append(("scheme", k))
    for k in NAMED:
        kinds.setdefault(k, []).append(("named", k))
    for k in PAIRS:
        kinds.setdefault(k, []).append(("pair", k))
    for k, v in kinds.items():
        a.add_word(k, (len(k), v))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case without a change of length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _random(v: str) -> bool:
    """Whether a literal is built like a secret: digits among letters, or mixed case that spells no words."""
    digit, lower, upper = (any(f(c) for c in v) for f in (str.isdigit, str.islower, str.isupper))
    if not (lower or upper):
        return False
    if digit:
        return len(v) >= 8
    return len(v) >= 10 and lower and upper and not _WORDS.fullmatch(v)


def _phrase(v: str) -> bool:
    """A password without the usual mix: many letters in one run, only digits, or several words, as long as no setting is."""
    return len(v) >= 16 and v.isalpha() and v.islower() or 6 <= len(v) <= 16 and v.isdigit() and len(set(v)) > 2


def _checksum(v: str) -> bool:
    """Whether the last six characters of a prefixed token are the base-62 checksum of the others."""
    n, out = zlib.crc32(v.split("_", 1)[1][:-6].encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(6, "0") == v[-6:]


def _web_token(v: str) -> bool:
    head = v.split(".", 1)[0]
    try:
        return b'"alg"' in base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
    except (binascii.Error, ValueError):
        return False


def _literal(v: str, bare: bool) -> bool:
    if len(v) < 6 or "\n" in v or _PLACEHOLDER.match(v) or _HASH.match(v) or _LOOKUP.search(v) or " " in v.strip():
        return False
    if not _random(v):
        return False
    if bare:
        hexa = re.fullmatch(r"[0-9a-fA-F]{24,}", v)
        mixed = any(c.islower() for c in v) and any(c.isupper() for c in v)
        return bool(hexa) or len(v) >= 10 and (mixed or not v.replace("_", "").isalnum())
    return True


def _basic(v: str) -> bool:
    try:
        raw = base64.b64decode(v, validate=True)
    except (binascii.Error, ValueError):
        return False
    return b":" in raw


class Scanner:
    def __init__(self) -> None:
        self.automaton = _automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """Spans of the credentials in ``text``, in order, none inside another."""
        spans: set[tuple[int, int]] = set()
        self.ends: list[tuple[int, int]] | None = None
        self.key: tuple = (-1, -1, None)
        for end, (n, rules) in self.automaton.iter(_lower(text)):
            at = end - n + 1
            for kind, word in rules:
                for span in getattr(self, "_" + kind)(text, at, word):
                    spans.add(span)
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def _pem(self, text: str, at: int, _: str):
        if m := _PEM.match(text, at):
            if self.ends is None:
                self.ends = [e.span() for e in _PEM_END.finditer(text)]
            i = bisect.bisect_left(self.ends, (m.end(), 0))
            if i < len(self.ends):
                yield at, self.ends[i][1]

    def _url(self, text: str, at: int, _: str):
        if (m := _URL.match(text, at)) and not _PLACEHOLDER.match(m[1]) and not m[1].startswith("$"):
            yield m.span(1)

    def _issuer(self, text: str, at: int, word: str):
        if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (m := _ISSUER[word].match(text, at)):
            v = m[0]
            if v.startswith("eyJ") and not _web_token(v):
                return
            # A prefix with a filler behind it is a placeholder, unless its checksum says otherwise.
            if len(set(v)) < 8 and not (v.startswith("gh") and v[3] == "_" and _checksum(v)):
                return
            start = m.start() + (len("AccountKey=") if word == "accountkey=" else 0)
            yield start, m.end()

    def _scheme(self, text: str, at: int, word: str):
        if (at == 0 or not text[at - 1].isalnum()) and (m := _SCHEME.match(text, at)):
            v = m[1].rstrip(".")
            if not _PLACEHOLDER.match(v) and (_basic(v) if word == "basic" else len(v) >= 16 and _random(v)):
                yield m.start(1), m.start(1) + len(v)

    def _named(self, text: str, at: int, word: str):
        start = at
        while start and text[start - 1] in _KEY_CHARS:
            start -= 1
            if self.key[0] <= start < self.key[1]:  # a key that has been read already
                start = self.key[0]
                break
        if start == self.key[0]:
            m = self.key[2]
        else:
            m = _ASSIGN.match(text, start)
            self.key = (start, _KEY_RUN.match(text, at).end(), m)
        if not m or m.start() > at or m.end("key") < at + len(word):
            return
        key = m["key"]
        cli = key.startswith("--")
        if _HARMLESS.search(key) or not self._says(key, word):
            return
        if m["comma"] and not m["close"] or m["blank"] and not cli and key.lower() not in ("password", "passwd", "pass", "secret", "token") or m["tag"] and m["close"]:
            return
        group = "bare" if m["bare"] is not None else "val"
        v = m[group]
        if group == "bare":
            v = v.rstrip(".")
        if m["blank"] and not cli and not _literal(v, True):
            return
        if _literal(v, group == "bare") or group == "val" and m["q"] != "`" and _PASSWORD_KEY.search(key) and _phrase(v) and not _PLACEHOLDER.match(v):
            yield m.start(group), m.start(group) + len(v)

    @staticmethod
    def _says(key: str, word: str) -> bool:
        """Short words (pw, pat, pass, pwd) must be a part of the name, not letters inside another word."""
        if len(word) > 4:
            return True
        parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key).lower()
        return word in re.split(r"[^a-z]+", parts) or parts.endswith(("password", "passwd")) or word in ("pass", "pwd") and parts.endswith(word)

    def _pair(self, text: str, at: int, _: str):
        if at and (text[at - 1].isalnum()):
            return
        if m := _PAIR.match(text, at):
            group = next(g for g in ("val", "cli", "say1", "say2", "ssh", "sql", "red") if m[g] is not None)
            v = m[group].rstrip(".,;") if group.startswith("say") else m[group]
            if _literal(v, group.startswith("say")):
                yield m.start(group), m.start(group) + len(v)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each span replaced by as many characters of the same classes; line ends and armour lines stay."""
    out, last = [], 0
    for a, b in spans:
        body = text[a:b]
        if body.startswith("-----BEGIN"):
            mask = re.sub(r"(?m)(-----(?:BEGIN|END)[^-]*-----|\\n)|[A-Za-z0-9]", lambda m: m[1] or _blank(m[0]), body)
        else:
            mask = "".join(map(_blank, body))
        out += [text[last:a], mask]
        last = b
    return "".join([*out, text[last:]])


def _blank(c: str) -> str:
    return "0" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else c


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, secrets array<string>, redacted string) of the rows whose ``text`` holds credentials."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for pdf in batches:
            out = []
            for i, t in zip(pdf["row_id"], pdf["text"]):
                if spans := scanner.find(t):
                    out.append((i, list(dict.fromkeys(t[a:b] for a, b in spans)), redact(t, spans)))
            yield pd.DataFrame(out, columns=["row_id", "secrets", "redacted"])

    take = rows.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return take.mapInPandas(run, "row_id bigint, secrets array<string>, redacted string")


def found(evidence: DataFrame, patch_changes: DataFrame) -> DataFrame:
    """(src_table, row_id, secret), distinct."""
    a = scan(evidence, "evidence_id", "source_code").select(F.lit("evidence").alias("src_table"), "row_id", F.explode("secrets").alias("secret"))
    b = scan(patch_changes, "change_id", "new_content").select(F.lit("patch_changes").alias("src_table"), "row_id", F.explode("secrets").alias("secret"))
    return a.unionByName(b)


def redacted(evidence: DataFrame, patch_changes: DataFrame) -> DataFrame:
    """(src_table, row_id, n_secrets, redacted) of the rows that change."""
    parts = (("evidence", evidence, "evidence_id", "source_code"), ("patch_changes", patch_changes, "change_id", "new_content"))
    a, b = (
        scan(t, k, c).select(F.lit(n).alias("src_table"), "row_id", F.size("secrets").alias("n_secrets"), "redacted") for n, t, k, c in parts
    )
    return a.unionByName(b)
