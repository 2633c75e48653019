"""Token classes and statements of a source file: one lexer for each of Python, JavaScript, JSON and TOML.

``lex(lang, data)`` gives a ``Lexed``: the class of each token in order (``START`` and ``END`` at the ends), the brackets
with their positions, the statements as normalised shapes, and a note where the text has no tokens at some place. Shapes
keep keywords, operators and line ends; names are numbered in order of appearance, numbers and strings reduced to their
kind, so that a large corpus has few different shapes.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from dataclasses import dataclass, field

from graphloom.llm import jsparse

EXTENSIONS = {"py": "python", "js": "js", "mjs": "js", "cjs": "js", "json": "json", "toml": "toml"}
OPEN, CLOSE = "([{", ")]}"
#: Notes of files that could not be lexed to the end; the exact check decides them.
UNDECIDED = ("RecursionError", "MemoryError", "OverflowError")


@dataclass
class Lexed:
    classes: list[str] = field(default_factory=lambda: ["START"])
    brackets: list[tuple[int, str]] = field(default_factory=list)
    shapes: list[str] = field(default_factory=list)
    skeleton: str = ""
    error: str = ""
    context: str = ""

    def add(self, cls: str) -> None:
        if cls in ("(", "[", "{", ")", "]", "}", ":", ","):
            self.brackets.append((len(self.classes), cls))
        self.classes.append(cls)


def language(path: str) -> str | None:
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if path and "." in path.rpartition("/")[2] else None


def lex(lang: str, data: bytes) -> Lexed:
    try:
        return {"python": _python, "js": _js, "json": _json, "toml": _toml}[lang](data)
    except (RecursionError, MemoryError, OverflowError) as e:
        return Lexed(classes=["START", "END"], error=type(e).__name__)


# -- Python ---------------------------------------------------------------------------------------------------------
_NUMBER = re.compile(tokenize.Number)
#: Longer integers may be too long to read.
MAX_DIGITS = 4000
_PY_ESCAPE = re.compile(r"\\[xuUN]")
_SOFT = ("match", "case", "type", "_")
_HEADS = frozenset("if elif else while for try except finally with def class async @".split())


def _python(data: bytes) -> Lexed:
    out = Lexed()
    line: list[tuple[str, str]] = []
    depth = 0
    skeleton: list[str] = []
    try:
        for t in tokenize.tokenize(io.BytesIO(data).readline):
            kind, text = t.type, t.string
            if kind in (tokenize.ENCODING, tokenize.COMMENT, tokenize.NL):
                continue
            if kind == tokenize.ENDMARKER:
                break
            if kind == tokenize.INDENT:
                depth += 1
                out.add("INDENT")
            elif kind == tokenize.DEDENT:
                depth -= 1
                out.add("DEDENT")
            elif kind == tokenize.NEWLINE:
                out.add("NEWLINE")
                if line:
                    _python_line(out, line, depth, skeleton)
                    line = []
            else:
                cls = _python_class(kind, text)
                out.add(cls)
                line.append((cls, text))
                if text in ("global", "nonlocal", "__debug__", "__future__"):
                    out.context = text
                elif cls == "NAME" and not text.isascii() or cls == "NUM" and len(text) > MAX_DIGITS:
                    out.context = out.context or "name or number"
                elif cls in ("STR", "FMID") and (_PY_ESCAPE.search(text) or not text.isascii() and "b" in text[:2].lower()):
                    out.context = out.context or "literal"
    except (tokenize.TokenError, SyntaxError, UnicodeDecodeError, LookupError, ValueError) as e:
        out.error = f"{type(e).__name__}: {e.args[0] if e.args else ''}"[:200]
    if line:
        _python_line(out, line, depth, skeleton)
    if not out.error and b"\0" in data:
        out.error = "null byte"
    out.classes.append("END")
    out.skeleton = "\n".join(skeleton)
    return out


def _python_class(kind: int, text: str) -> str:
    if kind == tokenize.NAME:
        return text if keyword.iskeyword(text) else "NAME"
    if kind == tokenize.NUMBER:
        return "NUM" if _NUMBER.fullmatch(text) else "ERR"
    if kind == tokenize.STRING:
        return "STR"
    if kind == tokenize.FSTRING_START:
        return "FSTART"
    if kind == tokenize.FSTRING_MIDDLE:
        return "FMID"
    if kind == tokenize.FSTRING_END:
        return "FEND"
    if kind == tokenize.OP:
        return text
    return "ERR"


def _python_line(out: Lexed, line: list[tuple[str, str]], depth: int, skeleton: list[str]) -> None:
    names: dict[str, str] = {}
    parts = []
    for cls, text in line:
        if cls == "NAME":
            parts.append(text if text in _SOFT or parts[-1:] == ["!"] else names.setdefault(text, f"n{len(names)}"))
        elif cls == "NUM":
            low = text.lower()
            parts.append("1j" if low.endswith("j") else "1.5" if "." in low or "e" in low and not low.startswith("0x") else "1")
        elif cls == "STR":
            parts.append("b's'" if "b" in text[: text.find(text[-1])].lower() else "'s'")
        elif cls == "FSTART":
            parts.append("f'''")
        elif cls == "FEND":
            parts[-1] = parts[-1] + "'''"
        elif cls != "FMID":
            parts.append(text)
    shape = ""
    inside = 0
    for p in parts:  # inside an f-string only the braces may be spaced
        shape += p if shape.endswith(("f'''", " !")) or not shape else " " + p
    out.shapes.append(re.sub(r"f''' *(?=''')", "f'''", shape))
    words = [c for c, _ in line]
    head = words[0]
    texts = [t for _, t in line]
    pad = " " * depth
    flags = []
    lambdas = "lambda" in words
    is_header = head in _HEADS or texts[0] in ("match", "case")
    if ("yield" in words or "await" in words or "async" in words[1:]) and (lambdas or is_header and words[-1] == ":" or head in ("elif", "except", "@", "def", "class", "async") or texts[0] == "case"):
        out.context = out.context or "await or yield"  # the skeleton doesn't say in which scope it stands
    if texts[0] == "match" and words[-1] == ":" or ":=" in words and "for" in words:
        out.context = out.context or "match or :="  # names and the order of cases decide
    for w, body in (("return", "return"), ("break", "break"), ("continue", "continue"), ("yield", "yield"), ("await", "await x")):
        if w in words and not (w in ("yield", "await") and lambdas):
            flags.append(body)
    if any(a == "return" and b != ";" for a, b in zip(words, words[1:])):
        flags[flags.index("return")] = "return x"
    if "from" in words and ("import", "*") in zip(words, words[1:]):
        flags.append("from x import *")
    if "yield" in flags and ("yield", "from") in zip(words, words[1:]):
        flags[flags.index("yield")] = "yield from x"
    if "async" in words and head != "async":
        flags.append("[x async for x in y]")
    header = {
        "if": "if x", "elif": "elif x", "else": "else", "while": "while x", "for": "for x in y", "try": "try", "finally": "finally",
        "with": "with x", "def": "def f()", "class": "class c",
    }
    body = "; ".join(flags) or "pass"
    if head in header or head in ("except", "async", "@") or texts[0] in ("match", "case") and words[-1] == ":" and len(words) > 2 and words[1] not in ("=", ".", ",", ":"):
        if head == "except":
            h = ("except* x" if len(words) > 1 and words[1] == "*" else "except x") if len(words) > 2 else "except"
        elif head == "async":
            nxt = words[1] if len(words) > 1 else ""
            h = {"def": "async def f()", "for": "async for x in y", "with": "async with x"}.get(nxt, "async")
        elif head == "@":
            skeleton.append(f"{pad}@x")
            return
        elif head in header:
            h = header[head]
        else:
            h = "match x" if texts[0] == "match" else "case 1 if x"
        if words[-1] == ":":
            skeleton.append(f"{pad}{h}:")
            # What a header awaits or yields counts where it stands.
            if flags and h not in ("try", "else", "finally") and head not in ("elif", "except", "case"):
                skeleton.insert(len(skeleton) - 1, f"{pad}{body}") if not (len(skeleton) > 1 and skeleton[-2].strip().startswith("@")) else None
        else:
            skeleton.append(f"{pad}{h}: {body}")
    else:
        skeleton.append(pad + body)


def python_shape_error(shape: str) -> str | None:
    """Why a statement of this shape stands in no Python file, or None. Where it may stand is left to the skeleton."""
    first = shape.split(" ", 1)[0]
    text = shape
    if first == "@":
        text += "\ndef f(): pass"
    elif shape.endswith(":"):
        text += "\n case _: pass" if first == "match" else " pass\nfinally: pass" if first == "try" else " pass"
    before = {"else": "for x in y: pass\n", "elif": "if x: pass\n", "except": "try: pass\n", "finally": "try: pass\n"}.get(first, "")
    tries = [before + text]
    if first == "case" and ":" in shape:
        tries.insert(0, "match x:\n " + text)
    why = None
    for t in tries:
        for wrapped in (t, "def f():\n while x:\n" + _indent(t, "  "), "async def f():\n while x:\n" + _indent(t, "  ")):
            why = python_error(wrapped)
            if why is None:
                return None
    return why


def _indent(text: str, pad: str) -> str:
    return "\n".join(pad + x for x in text.split("\n"))


def python_error(source: str | bytes) -> str | None:
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(source, "file", "exec", dont_inherit=True)
        return None
    except (SyntaxError, ValueError, OverflowError) as e:
        return f"{type(e).__name__}: {e.args[0]}, line {getattr(e, 'lineno', None)}"
    except (RecursionError, MemoryError) as e:
        return f"{type(e).__name__}: nested too deeply"


# -- JavaScript -----------------------------------------------------------------------------------------------------
_KEEP = frozenset("async of get set static let await yield as from eval arguments constructor prototype __proto__ target meta accessor using implements interface package private protected public".split())
_STARTERS = frozenset("function class const let var if for while import export return async try switch throw do break continue debugger @".split())
_OPERAND = frozenset(("NAME", "NUM", "STR", "TPL", "TTAIL", "REGEX", ")", "]", "this", "super", "null", "true", "false", "PRIV"))


def decode(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def _js(data: bytes) -> Lexed:
    s = decode(data)
    out = Lexed()
    at = 0
    if s.startswith("#!"):
        m = jsparse._NEWLINE.search(s)
        at = m.start() if m else len(s)
    stack: list[str] = []
    heads: list[str] = []
    stmt: list[tuple[str, str, bool]] = []
    declared: tuple[list[str], set[str]] = ([], set())
    prev, value_paren = "START", False
    while True:
        begin = at
        at = jsparse._SPACE.match(s, at).end()
        nl = bool(jsparse._NEWLINE.search(s, begin, at))
        if at >= len(s):
            break
        c = s[at]
        if c == "/" and not (prev in _OPERAND and not (prev == ")" and value_paren)) and (m := jsparse._REGEX.match(s, at)):
            cls, text, at = "REGEX", "/r/" + m[2], m.end()
            if not jsparse.regex_ok(m[1], m[2]):
                out.context = "regex"
        elif c == "`" or c == "}" and stack and stack[-1] == "${":
            m = jsparse._TPL.match(s, at + 1)
            if not m:
                out.error = f"unclosed template at {at}"
                break
            head = c == "`"
            if not head:
                stack.pop()
            if m[2] == "${":
                stack.append("${")
            cls = ("TPL" if head else "TTAIL") if m[2] == "`" else "THEAD" if head else "TMID"
            text = ("`" if head else "}") + "t" + m[2]
            if re.search(r"\\[1-9xu]|\\0\d", m[1]):
                out.context = "escape"
            at = m.end()
        else:
            m = jsparse._TOKEN.match(s, at)
            if not m:
                out.error = f"no token at {at}"
                break
            kind, text, at = m.lastgroup, m[0], m.end()
            if kind == "id":
                cls = text if text in jsparse.RESERVED or text in ("let", "async", "get", "set", "static", "of", "as", "from", "await", "yield", "accessor") else "NAME"
                if text in ("this", "super", "null", "true", "false"):
                    cls = text
                if "\\" in text:
                    out.context = "escape"
            elif kind == "priv":
                cls = "PRIV"
            elif kind == "num":
                cls = "NUM"
                if s[at : at + 1].isalnum() or re.match(r"0\d", text):
                    out.context = "number"
                    if s[at : at + 1].isalnum():
                        out.error = f"bad number at {at}"
                        break
            elif kind == "str":
                cls = "STR"
                if re.search(r"\\[0-9xu]", text):
                    out.context = "escape"
            else:
                cls = text
        if not stack and stmt and (nl or prev == ";" or prev == "}") and cls != "else" and (prev == ";" or cls in _STARTERS and (prev in ("}", ";") or prev in _OPERAND) and not (cls == "while" and stmt[0][0] == "do")):
            _js_statement(out, stmt, declared)
            stmt = []
            if prev == "}" and not nl:
                out.context = out.context or "joined"  # right after a block, wrong after an object
        out.add(cls)
        stmt.append((cls, text, nl))
        if cls in ("(", "[", "{"):
            stack.append(cls)
            heads.append(prev if cls == "(" else "")
        elif cls in (")", "]", "}") and stack and stack[-1] != "${":
            stack.pop()
            h = heads.pop() if heads else ""
            value_paren = cls == ")" and h in ("if", "while", "for", "with")
        prev = cls
    if stmt:
        _js_statement(out, stmt, declared)
    once, hoisted = declared
    if len(set(once)) != len(once) or not hoisted.isdisjoint(once):
        out.context = out.context or "redeclared"
    out.classes.append("END")
    return out


def _js_statement(out: Lexed, stmt: list[tuple[str, str, bool]], declared: tuple[list[str], set[str]]) -> None:
    names: dict[str, str] = {}
    parts = []
    for cls, text, nl in stmt:
        if cls == "NAME" and text not in _KEEP:
            text = names.setdefault(text, f"n{len(names)}")
        elif cls == "PRIV":
            text = names.setdefault(text, f"#n{len(names)}")
        elif cls == "NUM":
            text = "1n" if text.endswith("n") else "1"
        elif cls == "STR" and text[1:-1] not in ("use strict", "constructor", "__proto__", "prototype"):
            text = "'s'"
        parts.append(("\n" if nl else " ") + text)
    out.shapes.append("".join(parts).strip())
    words = [c for c, _, _ in stmt]
    if words[0] == "export":
        if {"{", "*"} & set(words[1:2]):
            out.context = out.context or "export"
        if words[1:2] == ["default"]:
            declared[0].append("export default")
    if stmt[0][1][1:-1] == "use strict":
        out.context = out.context or "strict"
    _js_bindings(stmt, declared)


def _js_bindings(stmt: list[tuple[str, str, bool]], declared: tuple[list[str], set[str]]) -> None:
    """Adds the names a statement binds at its top level, those by ``var`` (at any depth, as they may rise) to the set.

    Rather too many than too few: all names of a pattern count, and function expressions like declarations.
    """
    once, hoisted = declared
    n, depth = len(stmt), 0
    for i, (cls, text, _) in enumerate(stmt):
        if cls in ("(", "[", "{", "THEAD"):
            depth += 1
        elif cls in (")", "]", "}", "TTAIL"):
            depth -= 1
        elif cls == "import" and not i:
            once += sorted({t for c, t, _ in stmt if _js_name(c)})
        elif not depth and cls in ("function", "class"):
            k = i + 2 if i + 1 < n and stmt[i + 1][0] == "*" else i + 1
            if k < n and _js_name(stmt[k][0]):
                once.append(stmt[k][1])
        elif cls == "var" or not depth and cls in ("let", "const"):
            names: set[str] = set()
            inner, pattern, begins = 0, False, True
            for c, t, nl in stmt[i + 1 :]:
                if c in (")", "]", "}", "TTAIL"):
                    inner -= 1
                    if inner < 0:
                        break
                    pattern = pattern and inner > 0
                    continue
                if not inner and (c == ";" or nl and c in _STARTERS):
                    break
                if c in ("(", "[", "{", "THEAD"):
                    pattern = pattern or begins
                    inner += 1
                elif (begins or pattern) and _js_name(c):
                    names.add(t)
                begins = not inner and c == ","
            if cls == "var":
                hoisted |= names
            else:
                once += sorted(names)


def _js_name(cls: str) -> bool:
    return cls == "NAME" or cls.isalpha() and cls.islower() and cls not in jsparse.RESERVED


def js_modes(path: str) -> tuple[str, ...]:
    """The readings that make a file of this name valid: .mjs a module, .cjs a script in a function, .js either."""
    return {"mjs": ("module",), "cjs": ("function",)}.get(path.rpartition(".")[2].lower(), ("module", "function"))


def js_error(text: str, modes: tuple[str, ...]) -> str | None:
    why = None
    for m in modes:
        why = jsparse.js_error(text, m)
        if why is None:
            return None
    return why


# -- JSON -----------------------------------------------------------------------------------------------------------
_JSON = re.compile(r'[ \t\n\r]+|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<w>true|false|null)(?!\w)|(?P<p>[{}\[\]:,])', re.A)


def _json(data: bytes) -> Lexed:
    out = Lexed()
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        out.error = "not UTF-8"
        out.classes.append("END")
        return out
    at = 0
    while at < len(s):
        m = _JSON.match(s, at)
        if not m:
            out.error = f"no token at {at}"
            break
        at = m.end()
        if m.lastgroup:
            out.add({"s": "STR", "n": "NUM"}.get(m.lastgroup) or m[0])
    out.classes.append("END")
    return out


def json_error(data: bytes) -> str | None:
    import json

    def no(x):
        raise ValueError(f"{x} is no JSON")

    try:
        json.loads(data.decode("utf-8"), parse_constant=no, parse_int=str, parse_float=str)
        return None
    except ValueError as e:
        return f"{type(e).__name__}: {e}"
    except RecursionError:
        return None  # deep, and tokens, pairs and nesting have been checked


# -- TOML -----------------------------------------------------------------------------------------------------------
_TOML = re.compile(
    r'[ \t]+|#[^\n\r]*|(?P<nl>\r?\n)|(?P<l>"""(?:[^\\]|\\.)*?"""+|\'\'\'.*?\'\'\'+)|(?P<s>"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\')|(?P<d>\[\[|\]\])|(?P<p>[{}\[\]=,.])|(?P<b>[A-Za-z0-9_+:-]+(?:(?<=\d)\.\d[\w+:-]*)?(?: \d\d:\d\d[\w.:+-]*)?)', re.S
)


def _toml(data: bytes) -> Lexed:
    out = Lexed()
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        out.error = "not UTF-8"
        out.classes.append("END")
        return out
    at, depth, began = 0, 0, 0
    line: list[str] = []
    key_side = True
    paths: list[tuple[str, tuple[str, ...]]] = []
    where: tuple[str, ...] = ()
    while at < len(s):
        m = _TOML.match(s, at)
        if not m:
            out.error = f"no token at {at}"
            break
        kind, text = m.lastgroup, m[0]
        if kind is None:
            at = m.end()
            continue
        if not line:
            began = at
        at = m.end()
        if kind == "nl":
            if not depth:
                if line:
                    where = _toml_line(out, s[began : m.start()], line, paths, where)
                line, key_side = [], True
            out.add("NL")
            continue
        if kind == "d" and (depth or not key_side or text == "[[" and line or text == "]]" and (not line or line[0] != "[[")):
            for c in text:  # nested arrays, not a table header
                out.add(c)
                line.append(c)
                depth += 1 if c == "[" else -1
            continue
        cls = {"l": "LONG", "s": "STR", "b": "BARE"}.get(kind) or text
        if cls in ("[", "{") and (line and not key_side or depth):
            depth += 1
        elif cls in ("]", "}") and depth:
            depth -= 1
        if cls == "=":
            key_side = False
        out.add(cls)
        line.append(text)
    if line:
        _toml_line(out, s[began:], line, paths, where)
    if _toml_undecided(paths):
        out.context = "keys"
    out.classes.append("END")
    return out


def _toml_line(out: Lexed, raw: str, line: list[str], paths: list[tuple[str, tuple[str, ...]]], where: tuple[str, ...]) -> tuple[str, ...]:
    out.shapes.append(_toml_shape(raw.strip()))
    if line[0] in ("[", "[["):
        where = _toml_key(line[1:-1])
        paths.append((line[0], where))
        return where if line[0] == "[" else (*where, f"#{len(paths)}")
    key = _toml_key(line[: line.index("=")] if "=" in line else line)
    paths.append(("=", where + key))
    paths += [(".", where + key[:i]) for i in range(1, len(key))]
    if any("\\" in x for x in line if x[0] == '"') and any("\\" in x for x in key):
        out.context = "keys"
    return where


_TOML_PLAIN = re.compile(r'"[^"\\\x00-\x1f\x7f]*"|\'[^\'\x00-\x1f\x7f]*\'|(?<![\w.+-])[1-9][0-9]*(?![\w.:+-])(?![ \t]*[=.])|#[^\x00-\x08\x0b-\x1f\x7f\n]*(?=\r?\n|\Z)')
_TOML_NAME = re.compile(r"(?<![\w.\"'-])[A-Za-z][A-Za-z_-]*(?=\s*[=.\]])")


def _toml_shape(raw: str) -> str:
    """A line with its plain strings, plain numbers, comments and bare keys reduced to their kind; all else, as escapes, dates,
    floats and long strings, stays as it is, so that the line is as valid as it was."""
    if '"""' in raw or "'''" in raw or "__k" in raw:
        return raw
    names: dict[str, str] = {}

    def plain(m: re.Match) -> str:
        return "" if m[0][0] == "#" else m[0] if m[0][0] in "\"'" and _quoted_key(raw, m.end()) else m[0][0] + "s" + m[0][0] if m[0][0] in "\"'" else "1"

    shape = _TOML_PLAIN.sub(plain, raw)
    return _TOML_NAME.sub(lambda m: m[0] if m[0] in ("inf", "nan", "true", "false") else names.setdefault(m[0], f"__k{len(names)}"), shape).strip()


def _quoted_key(raw: str, at: int) -> bool:
    """Whether a string that ends here is a key: keys must stay apart."""
    return raw[at:].lstrip(" \t")[:1] in ("=", ".", "]")


def _toml_key(parts: list[str]) -> tuple[str, ...]:
    """The parts of a key; a bare part may hold dots, as numbers do."""
    return tuple(y for x in parts if x != "." for y in ([x[1:-1]] if x[0] in "'\"" else x.split(".")))


def _toml_undecided(paths: list[tuple[str, tuple[str, ...]]]) -> bool:
    """Whether a key or table is named twice, or below what is no plain table: only the exact check knows which may be."""
    keys, dotted = [p for k, p in paths if k == "="], {p for k, p in paths if k == "."}
    tables, arrays = [p for k, p in paths if k == "["], {p for k, p in paths if k == "[["}
    taken = {*keys, *tables}
    if len(taken) != len(keys) + len(tables) or not dotted.isdisjoint(taken) or not arrays.isdisjoint(taken | dotted):
        return True
    closed = {*keys, *arrays, *dotted}  # nothing but their own keys may follow
    return any(p[:i] in closed for k, p in paths if k != "." for i in range(1, len(p)) if k != "=" or p[:i] not in dotted and p[:i] not in arrays)


def toml_error(data: bytes | str) -> str | None:
    import tomllib

    try:
        tomllib.loads(data.decode("utf-8").replace("\r\n", "\n") if isinstance(data, bytes) else data.replace("\r\n", "\n"))
        return None
    except RecursionError:
        return None  # deep, and undecided is not invalid
    except ValueError as e:
        return f"{type(e).__name__}: {e}"


def file_error(lang: str, path: str, data: bytes) -> str | None:
    """The exact check of a whole file."""
    if lang == "python":
        return python_error(data)
    if lang == "js":
        return js_error(decode(data), js_modes(path))
    return json_error(data) if lang == "json" else toml_error(data)


def shape_modes(lang: str, shape: str) -> int:
    """In which readings a statement of this shape stands: 1 (in JavaScript, a module) and 2 (a function); 0 is none."""
    if lang == "python":
        return 3 * (python_shape_error(shape) is None)
    if lang == "js":
        return (jsparse.js_error(shape, "module") is None) + 2 * (jsparse.js_error(shape, "function") is None)
    return 3 * (toml_error(shape) is None) if lang == "toml" else 3


def file_modes(path: str) -> int:
    """The readings open to a file of this name, as in ``shape_modes``."""
    return {"mjs": 1, "cjs": 2}.get(path.rpartition(".")[2].lower(), 3)
