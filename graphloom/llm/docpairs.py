"""Functions paired with their documentation (problem 3).

Method: island grammars. For each language only documentation, decorators, signatures and balanced bodies are parsed; all
other code is water that is skipped token by token, so that strings, comments, brackets and templates in it cannot be
mistaken for islands; Python's tokens are those of its own tokenizer. A file counts only if it parses (checked exactly, and
only for files that have pairs).

Documentation is the Python docstring, or the comment that ends on the line directly above the definition and its
decorators (in Python only without a docstring; an empty docstring is one). ``says_something`` keeps texts of at least
``MIN_WORDS`` words apart from fields, the function's own name, fillers, placeholders and linter directives.

Defined cases: null content, bytes that Python can't read and other languages give nothing; repeated deliveries, and a property with
several definitions, give one row; nested functions and functions below ``if`` or ``try`` are water.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import spread
from graphloom.llm import jsparse, lexers
from graphloom.llm.syntax import with_language

MIN_WORDS = 4
#: Words that say nothing (fixed values of the problem's statement, and placeholders).
FILLERS = frozenset("the a an this of for to and function method class is does will it".split())
PLACEHOLDERS = frozenset("todo fixme xxx tbd tba wip hack describe description docstring docstrings documentation doc docs document placeholder undocumented missing fill write add here later me stub na lorem ipsum".split())
_FIELD = re.compile(r"^\s*(?::(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raise|raises|except|exception|yield|yields|ytype|var|ivar|cvar)\b|@(?:param|arg|argument|prop|property|returns?|throws?|exception|yields?|type|typedef|template|raises?|rtype)\b)")
_TAG = re.compile(r"^\s*@\w+")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Raises?|Yields?|Throws?|Exceptions?|Attributes)\s*:?\s*$", re.I)
_INLINE = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises?|Yields?|Throws?)\s*:\s+\S", re.I)
_DIRECTIVE = re.compile(
    r"(?:\bnoqa\b|\bpylint\s*:|\bflake8\s*:|\bmypy\s*:|\bruff\s*:|\bisort\s*:|\bpyright\s*:|\btype\s*:\s*ignore|\bpragma\s*:|\bfmt\s*:|\byapf\s*:|\bnosec\b|\bnosemgrep\b|eslint[-\w]*|jshint\b|jslint\b|jscs\s*:|tslint\s*:|prettier-ignore|istanbul ignore|c8 ignore|v8 ignore|@ts-\w+|@flow\b|biome-ignore|deno-lint-ignore)[^\n]*", re.I
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CAMEL = re.compile(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|\d+|[^\W_]+")


def prose(text: str) -> str:
    """The text without fields, sections of fields and linter directives."""
    out, skip, indent = [], False, 0
    lines = _DIRECTIVE.sub("", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for i, line in enumerate(lines):
        body = line.strip()
        depth = len(line) - len(line.lstrip())
        if _FIELD.match(line):
            skip, indent = True, depth
            continue
        if tag := _TAG.match(line):  # any other tag says something behind its word
            skip = False
            out.append(line[tag.end() :])
            continue
        if _INLINE.match(line):
            skip, indent = True, depth
            continue
        if _SECTION.match(line) and (body.endswith(":") or i + 1 < len(lines) and re.fullmatch(r"\s*-{3,}\s*", lines[i + 1])):
            skip, indent = True, -1 if i + 1 < len(lines) and re.fullmatch(r"\s*-{3,}\s*", lines[i + 1]) else depth
            continue
        if skip:
            if not body:
                skip = False
            elif indent >= 0 and depth <= indent:
                skip = False
            else:
                continue
        out.append(line)
    return "\n".join(out)


def name_words(name: str) -> set[str]:
    parts = [w for p in re.split(r"[\W_]+", name) if p for w in _CAMEL.findall(p)]
    low = {w.lower() for w in parts} | {p.lower() for p in re.split(r"[\W_]+", name) if p}
    for a, b in zip(parts, parts[1:]):
        low.add((a + b).lower())
    return low


def says_something(text: str, name: str, least: int = MIN_WORDS) -> bool:
    own = name_words(name)
    n = 0
    for w in _WORD.findall(prose(text)):
        low = w.lower()
        if low in FILLERS or low in PLACEHOLDERS or low in own or low.isdigit():
            continue
        n += 1
        if n >= least:
            return True
    return False


# -- Python islands -------------------------------------------------------------------------------------------------
_PY = re.compile(
    r"(?P<c>#[^\n]*)|(?P<s>(?:[rRbBuUfFtT]{0,3})(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"))|(?P<o>[(\[{])|(?P<x>[)\]}])|(?P<k>\\\n)|(?P<n>\n)|[^\W\d]\w*|\d[\w.]*|[^\S\n]+|.", re.S
)


def decode_python(data: bytes) -> str | None:
    """The text as Python reads it. In UTF-8 it decodes strings and names only, so bad bytes are replaced, and the check of the
    whole file decides whether they may stand where they do."""
    data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")  # first, as the coding line is one of the first two
    head = b"\n".join(data.split(b"\n", 2)[:2]).decode("utf-8", "replace").encode()
    try:
        encoding, _ = tokenize.detect_encoding(io.BytesIO(head).readline)
        return data.decode(encoding, "replace" if encoding.startswith("utf-8") else "strict").removeprefix("\ufeff")
    except (SyntaxError, ValueError, LookupError):
        return None


def _statements(text: str, comments: list[str]) -> Iterator[tuple[int, list[tokenize.TokenInfo]]]:
    """(block depth, tokens) of each logical line: islands begin at these. Comments alone on their line go to ``comments``."""
    depth = 0
    tokens: list[tokenize.TokenInfo] = []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        kind = t.type
        if kind == tokenize.NEWLINE:
            if tokens:
                yield depth, tokens
            tokens = []
        elif kind == tokenize.COMMENT:
            if not t.line[: t.start[1]].strip():
                comments[t.start[0] - 1] = t.string
        elif kind == tokenize.INDENT:
            depth += 1
        elif kind == tokenize.DEDENT:
            depth -= 1
        elif kind not in (tokenize.NL, tokenize.ENDMARKER):
            tokens.append(t)


def _docstring(tokens: list[tokenize.TokenInfo]) -> str | None:
    """The value of the string that is the first statement in ``tokens``, if it is one."""
    n = at = 0
    while at < len(tokens) and tokens[at].string == "(":
        at += 1
    n = at
    while at < len(tokens) and tokens[at].type == tokenize.STRING:
        at += 1
    strings = [t.string for t in tokens[n:at]]
    end = at + n
    if not strings or any(t.string != ")" for t in tokens[at:end]) or end > len(tokens) or end < len(tokens) and tokens[end].string != ";":
        return None
    try:
        value = ast.literal_eval("(" + " ".join(strings) + ")")
    except (ValueError, SyntaxError, MemoryError):
        return None
    return value if isinstance(value, str) else None


def _header_end(tokens: list[tokenize.TokenInfo]) -> int:
    """Number of tokens up to the colon that ends a def header, or -1; a lambda outside brackets has a colon of its own."""
    depth = own = 0
    for i, t in enumerate(tokens):
        if t.type == tokenize.OP:
            if t.string in "([{":
                depth += 1
            elif t.string in ")]}":
                depth -= 1
            elif t.string == ":" and depth == 0:
                if not own:
                    return i + 1
                own -= 1
        elif depth == 0 and t.string == "lambda" and t.type == tokenize.NAME:
            own += 1
    return -1


def _identifier(name: str) -> str:
    return name if name.isascii() else unicodedata.normalize("NFKC", name)


def _comment_above(lines: list[str], no: int) -> str:
    """The block of comment lines that ends on the line above line ``no`` (from 1)."""
    i = no - 2
    out = []
    while i >= 0 and lines[i].lstrip().startswith("#"):
        out.append(lines[i].strip().lstrip("#").removeprefix("!").strip())
        i -= 1
    return "\n".join(reversed(out))


def python_pairs(text: str, module: str) -> list[tuple[str, str, str]]:
    """(qualified name, name, documentation) of the functions and methods with documentation of any kind; nothing if the tokens
    end in an error, as the file doesn't parse then."""
    if "\0" in text:  # no source has these, and the tokenizer breaks off at one with an error of its own
        return []
    comments = [""] * (text.count("\n") + 2)
    out: list[tuple[str, str, str]] = []
    cls, top = "", 0
    waiting: tuple[int, str, int] | None = None  # block depth, name and first line of a function whose body comes next

    def add(name: str, first: int, doc: str | None) -> None:
        if doc is None:
            doc = _comment_above(comments, first)
        if doc:
            out.append((".".join(x for x in (module, cls, name) if x), name, doc))

    try:
        for depth, tokens in _statements(text, comments):
            if waiting:
                add(*waiting[1:], _docstring(tokens) if depth > waiting[0] else None)
                waiting = None
            if depth == 0:
                cls = ""
            elif depth > 1 or not cls:
                continue
            word = tokens[0].string
            if word == "@":
                top = top or tokens[0].start[0]
                continue
            first, top = top or tokens[0].start[0], 0
            if depth == 0 and word == "class":
                cls = _identifier(tokens[1].string)
            at = 2 if word == "async" else 1
            if tokens[at - 1].string != "def" or (end := _header_end(tokens)) < 0:
                continue
            name = _identifier(tokens[at].string)
            if end < len(tokens):
                add(name, first, _docstring(tokens[end:]))
            else:
                waiting = depth, name, first
    except (tokenize.TokenError, SyntaxError, ValueError, IndexError):
        return []
    return out


# -- JavaScript islands ---------------------------------------------------------------------------------------------
_JS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)")
_JS_CLASS = re.compile(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b(?:\s+(?!extends\b)([\w$]+))?")
_JS_METHOD = re.compile(r"(?:static\s+)?(?:async\s+)?\*?\s*(?:(?:get|set)\s+)?(#?[\w$]+)\s*\(")
_JS_SKIP = re.compile(r"[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/", re.S)


class _JsWater:
    """Steps through code token by token; comments are kept with the line they end on."""

    def __init__(self, text: str) -> None:
        self.s = text
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|[\n\r  ]", text)]
        self.comments: dict[int, tuple[int, str, str]] = {}

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at) - 1

    def tokens(self) -> Iterator[tuple[int, int, str, int]]:
        """(start, end, class, depth before) of every token; a whole template is one token."""
        s, at, depth, prev = self.s, 0, 0, ""
        heads: list[str] = []
        value_paren = True
        if s.startswith("#!"):
            m = jsparse._NEWLINE.search(s)
            at = m.start() if m else len(s)
        while at < len(s):
            if m := _JS_SKIP.match(s, at):
                if m[0][:2] in ("//", "/*"):
                    alone = not s[self.starts[self.line(m.start())] : m.start()].strip()
                    rest = m.end()
                    self.comments[self.line(m.end() - 1)] = (self.line(m.start()), m[0], "alone" if alone else "")
                at = m.end()
                continue
            begin, c = at, s[at]
            if c == "/" and (prev not in ("id", "num", "str", "tpl", ")", "]", "}") or prev == ")" and not value_paren) and (m := jsparse._REGEX.match(s, at)):
                at, cls = m.end(), "str"
            elif c == "`":
                at, cls = self._template(at), "tpl"
            elif m := jsparse._TOKEN.match(s, at):
                at = m.end()
                cls = m[0] if m.lastgroup == "p" else m.lastgroup
                if cls == "id" and m[0] in jsparse.RESERVED and m[0] not in ("this", "super", "null", "true", "false"):
                    cls = m[0]
            else:
                at, cls = at + 1, "?"
            yield begin, at, cls, depth
            if cls in ("(", "[", "{"):
                heads.append(prev)
                depth += 1
            elif cls in (")", "]", "}"):
                h = heads.pop() if heads else ""
                value_paren = not (cls == ")" and h in ("if", "while", "for", "with"))
                depth = max(0, depth - 1)
            prev = cls

    def _template(self, at: int) -> int:
        s = self.s
        at += 1
        while at < len(s):
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                return at + 1
            elif s.startswith("${", at):
                at, depth = at + 2, 1
                while at < len(s) and depth:
                    if s[at] == "`":
                        at = self._template(at)
                        continue
                    if m := jsparse._TOKEN.match(s, at):
                        depth += (m[0] == "{") - (m[0] == "}")
                        at = m.end()
                    else:
                        at += 1
            else:
                at += 1
        return at

    def doc_above(self, at: int) -> str:
        """The comment that ends on the line directly above the one ``at`` lies on."""
        no = self.line(at) - 1
        got = self.comments.get(no)
        if not got or not got[2]:
            return ""
        first, text, _ = got
        if text.startswith("/*"):
            return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in re.split(r"\r\n|[\n\r]", text[2:-2].lstrip("*!")))
        out = [text]
        no = first - 1
        while (g := self.comments.get(no)) and g[2] and g[1].startswith("//"):
            out.append(g[1])
            no = g[0] - 1
        return "\n".join(x.lstrip("/!").strip() for x in reversed(out))


def js_pairs(text: str) -> list[tuple[str, str, str]]:
    w = _JsWater(text)
    out = []
    toks = list(w.tokens())
    cls, class_depth = "", -1
    prev = ";"

    def named(i: int) -> bool:
        """Whether a reserved word at token ``i`` is a method's name."""
        return toks[i][2] in jsparse.RESERVED and i + 1 < len(toks) and toks[i + 1][2] == "("

    for i, (a, b, kind, depth) in enumerate(toks):
        if depth == 0:
            if prev in (";", "}", "") or i == 0 or w.line(a) > w.line(toks[i - 1][0]):
                if m := _JS_FUNCTION.match(text, a):
                    if doc := w.doc_above(a):
                        out.append((m[1], m[1], doc))
                elif kind in ("class", "export", "@") and (m := _JS_CLASS.match(text, a)):
                    cls, class_depth = m[1] or "default", -1
            if kind == "{" and cls and class_depth < 0:
                class_depth = 1
            elif kind == "}" and class_depth == 1:
                cls, class_depth = "", -1
        elif cls and class_depth == 1 and depth == 1:
            if kind == "}":
                cls, class_depth = "", -1
            elif prev in ("{", ";", "}") and (kind in ("id", "priv", "*") or named(i)) or (kind == "id" or named(i)) and prev not in ("id", "=", ".", "*", "priv", "extends") and w.line(a) > w.line(toks[i - 1][0]):
                if m := _JS_METHOD.match(text, a):
                    close = _matching(toks, i)
                    if close and (doc := w.doc_above(a)):
                        out.append((f"{cls}.{m[1]}", m[1], doc))
        prev = kind
    return out


def _matching(toks: list[tuple[int, int, str, int]], i: int) -> bool:
    """Whether the signature that begins at token ``i`` has a balanced parameter list followed by a body."""
    j = i
    while j < len(toks) and toks[j][2] != "(":
        j += 1
    depth = toks[j][3] if j < len(toks) else 0
    j += 1
    while j < len(toks) and not (toks[j][2] == ")" and toks[j][3] == depth + 1):
        j += 1
    return j + 1 < len(toks) and toks[j + 1][2] == "{"


def module_of(path: str) -> str:
    parts = re.sub(r"\.\w+$", "", path).split("/")
    if parts[-1] == "__init__" and len(parts) > 1:
        parts = parts[:-1]
    return ".".join(p for p in parts if p not in ("", "."))


def file_pairs(lang: str, path: str, data: bytes) -> list[tuple[str, str, str]]:
    """(qualified name, name, documentation) of one file; nothing if it doesn't parse."""
    if lang == "python":
        text = decode_python(data)
        got = python_pairs(text, module_of(path)) if text is not None else []
    else:
        got = js_pairs(lexers.decode(data))
    got = [x for x in got if says_something(x[2], x[1])]
    return got if got and lexers.file_error(lang, path, data) is None else []


def pairs(files: DataFrame) -> DataFrame:
    """(repository_id, path, qualified_name, documentation), one row per function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys

        sys.setrecursionlimit(20_000)
        for pdf in batches:
            out = []
            for repo, path, lang, content in zip(pdf["repository_id"], pdf["path"], pdf["lang"], pdf["content"]):
                out += [(repo, path, q, d) for q, _, d in file_pairs(lang, path, bytes(content))]
            yield pd.DataFrame(out, columns=["repository_id", "path", "qualified_name", "documentation"])

    take = with_language(files.select("repository_id", "path", "content")).where("content is not null and lang in ('python', 'js')")
    got = spread(take).mapInPandas(run, "repository_id string, path string, qualified_name string, documentation string")
    return got.groupBy("repository_id", "path", "qualified_name").agg(F.min("documentation").alias("documentation"))
