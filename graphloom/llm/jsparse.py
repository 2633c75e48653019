"""A recogniser for JavaScript (ECMAScript 2024): accepts a text as module, script or function body, or says where it fails.

It builds no tree. Expressions come back as small tuples, only as far as needed to tell assignment targets, patterns and
early errors (redeclared names, misplaced break, return, await and yield, bad targets, strict-mode restrictions).
"""

from __future__ import annotations

import re
import sys

from graphloom.llm.jsregex import regex_ok

_ID_START = r"[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}"
_ID = rf"(?:{_ID_START})(?:[\w$‌‍]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})*"
_ESC = r"\\(?:u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|[^ux])"
_NUMBER = r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:0\d+(?:\.\d*)?|(?:0|[1-9](?:_?\d)*)?\.\d(?:_?\d)*|(?:0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?)(?:[eE][+-]?\d(?:_?\d)*)?"
_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_TOKEN = re.compile(
    rf"(?P<id>{_ID})|(?P<priv>#(?:{_ID}))|(?P<num>{_NUMBER})|(?P<str>'(?:[^'\\\r\n]|{_ESC})*'|\"(?:[^\"\\\r\n]|{_ESC})*\")|(?P<tpl>`)|(?P<p>{_PUNCT})", re.S
)
_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
_REGEX = re.compile(r"/(?![*/])((?:[^\\/\[\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029]|\[(?:[^\]\\\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029])*\])+)/([\w$]*)")
_TPL = re.compile(r"((?:[^`\\$]|\$(?!\{)|\\.)*)(`|\$\{)", re.S)
_NEWLINE = re.compile(r"[\n\r\u2028\u2029]")

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
STRICT_RESERVED = frozenset("implements interface let package private protected public static yield".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
#: Frames of the recogniser: calls between Python functions take no C stack, so only memory bounds the nesting.
MAX_FRAMES = 2_000_000


class JSError(Exception):
    pass


class _Fn:
    """What a function body allows."""

    def __init__(self, is_async=False, is_gen=False, strict=False, arrow=False, can_return=True, method=False, ctor=False, top=False):
        self.is_async, self.is_gen, self.strict, self.arrow, self.can_return = is_async, is_gen, strict, arrow, can_return
        self.method, self.ctor, self.top = method, ctor, top
        self.labels: list[tuple[str, bool]] = []
        self.loops = self.switches = 0
        self.static_block = False


class Recogniser:
    def __init__(self, text: str, mode: str = "module") -> None:
        self.s, self.mode = text, mode
        self.fn = _Fn(is_async=mode == "module", strict=mode == "module", can_return=mode == "function", top=True)
        self.module = mode == "module"
        self.scopes: list[dict[str, str]] = [{}]
        self.privates: list[tuple[set, set]] = []
        self.exports: set[str] = set()
        self.wanted: list[str] = []
        self.not_arrow: set[int] = set()
        self.in_ok = True
        self.start = 0
        if text.startswith("#!"):
            m = _NEWLINE.search(text)
            self.start = m.start() if m else len(text)
        self.prev_end = self.start
        self.scan(self.start)

    # -- tokens -------------------------------------------------------------------------------------------------
    def fail(self, why: str = "unexpected token"):
        raise JSError(f"{why} at {self.tok_start}")

    def scan(self, at: int) -> None:
        s = self.s
        begin = at
        at = _SPACE.match(s, at).end()
        if not self.module:
            while s.startswith("<!--", at) or s.startswith("-->", at) and (begin == self.start or _NEWLINE.search(s, begin, at)):
                m = _NEWLINE.search(s, at)
                at = _SPACE.match(s, m.start() if m else len(s)).end()
        self.nl = bool(_NEWLINE.search(s, begin, at))
        self.tok_start = at
        if at >= len(s):
            self.kind, self.val, self.end = "eof", "", at
            return
        m = _TOKEN.match(s, at)
        if not m:
            raise JSError(f"no token at {at}")
        self.kind, self.val, self.end = m.lastgroup, m[0], m.end()
        if self.kind == "num":
            nxt = s[self.end : self.end + 1]
            if nxt and (nxt.isalnum() or nxt in "_$\\"):
                raise JSError(f"bad number at {at}")
            if self.fn.strict and len(self.val) > 1 and self.val[0] == "0" and self.val[1].isdigit():
                raise JSError(f"octal number at {at}")
        elif self.kind == "str" and self.fn.strict and "\\" in self.val and re.search(r"(?<!\\)(?:\\\\)*\\(?:0\d|[1-9])", self.val):
            raise JSError(f"octal escape at {at}")
        elif self.kind == "id" and "\\" in self.val:
            name = re.sub(r"\\u\{?([0-9a-fA-F]+)\}?", lambda m: chr(min(int(m[1], 16), 0x10FFFF)), self.val)
            if not name.isidentifier() and not re.fullmatch(r"[\w$]+", name) or name in RESERVED:
                raise JSError(f"bad escape at {at}")
            self.kind = "id"
            self.val = name + "\0"  # an escaped word is never a keyword

    def state(self):
        return self.kind, self.val, self.tok_start, self.end, self.nl, self.prev_end

    def restore(self, st) -> None:
        self.kind, self.val, self.tok_start, self.end, self.nl, self.prev_end = st

    def next(self) -> None:
        self.prev_end = self.end
        self.scan(self.end)

    def at(self, v: str) -> bool:
        return self.val == v and self.kind in ("p", "id")

    def eat(self, v: str) -> bool:
        if self.at(v):
            self.next()
            return True
        return False

    def need(self, v: str) -> None:
        if not self.at(v):
            self.fail(f"expected {v}")
        self.next()

    def peek(self):
        st = self.state()
        try:
            self.next()
            return self.kind, self.val, self.nl
        except JSError:
            return "bad", "", False
        finally:
            self.restore(st)

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "eof" or self.nl:
            return
        self.fail("expected ;")

    # -- names --------------------------------------------------------------------------------------------------
    def is_name(self) -> bool:
        if self.kind != "id":
            return False
        v = self.val.rstrip("\0")
        if v in RESERVED or self.fn.strict and v in STRICT_RESERVED:
            return False
        if v == "await" and (self.fn.is_async or self.module or self.fn.static_block):
            return False
        return not (v == "yield" and (self.fn.is_gen or self.fn.strict))

    def name(self, binding: bool = True) -> str:
        if not self.is_name():
            self.fail("expected a name")
        v = self.val.rstrip("\0")
        if binding and self.fn.strict and v in ("eval", "arguments"):
            self.fail("binding of " + v)
        self.next()
        return v

    def declare(self, name: str, kind: str) -> None:
        """kind: var, let (also const, class), fn (function in a block), top (function at function level), param, catch."""
        if kind == "var":
            for i in range(len(self.scopes) - 1, -1, -1):
                have = self.scopes[i].get(name)
                if have in ("let", "fn"):
                    self.fail(f"{name} is declared already")
                self.scopes[i].setdefault(name, "var")
                if "\0fn" in self.scopes[i] or i == 0:
                    return
            return
        scope = self.scopes[-1]
        have = scope.get(name)
        if kind == "let" and have or kind == "fn" and have and not (have == "fn" and not self.fn.strict) or kind == "top" and have == "let":
            self.fail(f"{name} is declared already")
        scope[name] = kind

    # -- program ------------------------------------------------------------------------------------------------
    def run(self) -> None:
        self.scopes[0]["\0fn"] = ""
        self.directives()
        while self.kind != "eof":
            self.statement(True, True)
        for n in self.wanted:
            if n not in self.scopes[0]:
                self.fail(f"{n} is exported but not declared")

    def directives(self) -> bool:
        """Reads the directive prologue; True if it made the code strict."""
        strict = False
        while self.kind == "str":
            st = self.state()
            raw = self.val[1:-1]
            self.next()
            if not (self.at(";") or self.at("}") or self.kind == "eof" or self.nl and not (self.kind == "p" and self.val in "([.`+-*/,?&|^%<>=" or self.kind == "tpl" or self.val in ("in", "instanceof"))):
                self.restore(st)
                break
            if raw == "use strict":
                strict = self.fn.strict = True
            self.eat(";")
        return strict

    def block(self, new: bool = True) -> None:
        self.need("{")
        if new:
            self.scopes.append({})
        while not self.at("}"):
            if self.kind == "eof":
                self.fail("unclosed block")
            self.statement(True)
        if new:
            self.scopes.pop()
        self.next()

    def statement(self, decl: bool = False, top: bool = False, label: bool = False) -> None:
        self._statement(decl, top, label)

    def _statement(self, decl: bool, top: bool, label: bool) -> None:
        if self.kind == "p":
            if self.val == "{":
                return self.block()
            if self.val == ";":
                return self.next()
            if self.val == "@":
                self.decorators()
                if not self.at("class") and not self.at("export"):
                    self.fail()
        elif self.kind == "id":
            f = getattr(self, "st_" + self.val, None)
            if f and self.val in _STATEMENTS:
                return f(decl, top, label)
            if self.val == "let":
                kind, val, _ = self.peek()
                if kind == "id" and val not in ("in", "instanceof", "of") or val in ("[", "{") or kind == "id" and val == "of":
                    if not decl:
                        self.fail("declaration not allowed here")
                    return self.variables()
            if self.val == "async":
                kind, val, nl = self.peek()
                if val == "function" and not nl:
                    if not decl:
                        self.fail("declaration not allowed here")
                    self.next()
                    return self.function(True, "top" if top or self.at_fn_top() else "fn", is_async=True)
            if self.is_name():
                st = self.state()
                v = self.val
                self.next()
                if self.at(":"):
                    self.next()
                    v = v.rstrip("\0")
                    if any(n == v for n, _ in self.fn.labels):
                        self.fail("label in use")
                    self.fn.labels.append((v, self.val in ("for", "while", "do")))
                    if self.at("function"):
                        if self.fn.strict:
                            self.fail()
                        self.function(True, "fn")
                    else:
                        self.statement(False, False, True)
                    self.fn.labels.pop()
                    return None
                self.restore(st)
        self.expression()
        self.semicolon()
        return None

    def at_fn_top(self) -> bool:
        return "\0fn" in self.scopes[-1]

    def variables(self, for_head: bool = False) -> tuple[str, int, bool, bool]:
        """(kind, count, any initialiser, any pattern or const without one) of var, let or const declarations."""
        kind = self.val
        self.next()
        k = "var" if kind == "var" else "let"
        n, inits, lacks = 0, False, False
        while True:
            pattern = self.val in ("[", "{") and self.kind == "p"
            if k == "let" and self.at("let"):
                self.fail("let is no name here")
            self.binding(k)
            n += 1
            if self.eat("="):
                inits = True
                self.assign()
            elif pattern or kind == "const":
                lacks = True
                if not for_head:
                    self.fail("missing initialiser")
            if not self.eat(","):
                break
        if not for_head:
            self.semicolon()
        return kind, n, inits, lacks

    def binding(self, kind: str) -> None:
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding(kind)
                if not rest and self.eat("="):
                    self.with_in(self.assign)
                if rest or not self.eat(","):
                    break
            self.need("]")
        elif self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.declare(self.name(), kind)
                    break
                plain = self.kind == "id"
                st = self.state()
                self.property_name()
                if self.eat(":"):
                    self.binding(kind)
                elif plain:
                    after = self.state()
                    self.restore(st)
                    self.declare(self.name(), kind)
                    self.restore(after)
                else:
                    self.fail()
                if self.eat("="):
                    self.with_in(self.assign)
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.declare(self.name(), kind)

    def with_in(self, f):
        was, self.in_ok = self.in_ok, True
        out = f()
        self.in_ok = was
        return out

    # -- statements ---------------------------------------------------------------------------------------------
    def st_var(self, *_):
        self.variables()

    def st_const(self, decl, *_):
        if not decl:
            self.fail("declaration not allowed here")
        self.variables()

    def st_function(self, decl, top, label):
        if not decl and self.fn.strict:
            self.fail("declaration not allowed here")
        self.function(True, "top" if top or self.at_fn_top() else "fn")

    def st_class(self, decl, *_):
        if not decl:
            self.fail("declaration not allowed here")
        self.class_(True)

    def st_if(self, *_):
        self.next()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.with_in(self.expression)
        self.need(")")

    def loop_body(self) -> None:
        self.fn.loops += 1
        self.statement()
        self.fn.loops -= 1

    def st_while(self, *_):
        self.next()
        self.paren()
        self.loop_body()

    def st_do(self, *_):
        self.next()
        self.loop_body()
        self.need("while")
        self.paren()
        self.eat(";")

    def st_for(self, *_):
        self.next()
        is_await = self.at("await")
        if is_await:
            if not self.fn.is_async:
                self.fail("await outside async")
            self.next()
        self.need("(")
        self.scopes.append({})
        if self.at(";") and not is_await:
            self.for_rest()
        else:
            lone_let = self.at("let") and (self.peek()[0] == "id" and self.peek()[1] not in ("in", "of", "instanceof") or self.peek()[1] in ("[", "{") or self.peek()[1] == "of" and False)
            if self.at("var") or self.at("const") or lone_let:
                self.in_ok = False
                kind, n, inits, lacks = self.variables(True)
                self.in_ok = True
                if self.at("of") or self.at("in"):
                    of = self.at("of")
                    if n != 1 or inits and (of or self.fn.strict or kind != "var") or is_await and not of:
                        self.fail("bad loop head")
                    self.next()
                    self.assign() if of else self.expression()
                    self.need(")")
                else:
                    if lacks or is_await:
                        self.fail("missing initialiser")
                    self.for_rest()
            else:
                first, starts_async = self.tok_start, self.at("async")
                self.in_ok = False
                node = self.expression(cover=True)
                self.in_ok = True
                if self.at("of") or self.at("in"):
                    of = self.at("of")
                    if is_await and not of or of and starts_async and node[0] == "id" and not is_await or self.s.startswith("let", first) and of and node[0] == "id":
                        self.fail("bad loop head")
                    self.target(node)
                    self.next()
                    self.assign() if of else self.expression()
                    self.need(")")
                else:
                    self.no_cover(node)
                    if is_await:
                        self.fail()
                    self.for_rest()
        self.loop_body()
        self.scopes.pop()

    def for_rest(self) -> None:
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")

    def st_continue(self, *_):
        self.next()
        if self.is_name() and not self.nl:
            if (self.val.rstrip("\0"), True) not in self.fn.labels:
                self.fail("no such loop")
            self.next()
        elif not self.fn.loops:
            self.fail("continue outside a loop")
        self.semicolon()

    def st_break(self, *_):
        self.next()
        if self.is_name() and not self.nl:
            if all(self.val.rstrip("\0") != n for n, _ in self.fn.labels):
                self.fail("no such label")
            self.next()
        elif not (self.fn.loops or self.fn.switches):
            self.fail("break outside a loop")
        self.semicolon()

    def st_return(self, *_):
        if not self.fn.can_return:
            self.fail("return outside a function")
        self.next()
        if not (self.at(";") or self.at("}") or self.kind == "eof" or self.nl):
            self.expression()
        self.semicolon()

    def st_throw(self, *_):
        self.next()
        if self.nl:
            self.fail("line end after throw")
        self.expression()
        self.semicolon()

    def st_with(self, *_):
        if self.fn.strict:
            self.fail("with in strict code")
        self.next()
        self.paren()
        self.statement()

    def st_switch(self, *_):
        self.next()
        self.paren()
        self.need("{")
        self.scopes.append({})
        self.fn.switches += 1
        seen = False
        while not self.eat("}"):
            if self.eat("case"):
                self.with_in(self.expression)
            elif self.at("default") and not seen:
                seen = True
                self.next()
            else:
                self.fail()
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.kind == "eof":
                    self.fail("unclosed switch")
                self.statement(True)
        self.fn.switches -= 1
        self.scopes.pop()

    def st_try(self, *_):
        self.next()
        self.block()
        some = False
        if self.eat("catch"):
            some = True
            self.scopes.append({})
            if self.eat("("):
                simple = self.kind == "id"
                self.binding("catch" if simple else "let")
                self.need(")")
            self.block()
            self.scopes.pop()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            self.fail("try without catch or finally")

    def st_debugger(self, *_):
        self.next()
        self.semicolon()

    def st_import(self, decl, top, _):
        kind, val, _nl = self.peek()
        if val in ("(", "."):
            self.expression()
            return self.semicolon()
        if not (self.module and top):
            self.fail("import outside a module's top level")
        self.next()
        if self.kind == "str":
            self.next()
        else:
            more = True
            if self.is_name():
                self.declare(self.name(), "let")
                more = self.eat(",")
            if more:
                if self.eat("*"):
                    self.need("as")
                    self.declare(self.name(), "let")
                else:
                    self.need("{")
                    while not self.at("}"):
                        if self.kind not in ("id", "str"):
                            self.fail()
                        st, is_str = self.state(), self.kind == "str"
                        self.next()
                        if self.eat("as"):
                            self.declare(self.name(), "let")
                        elif is_str:
                            self.fail()
                        else:
                            after = self.state()
                            self.restore(st)
                            self.declare(self.name(), "let")
                            self.restore(after)
                        if not self.eat(","):
                            break
                    self.need("}")
            self.need("from")
            if self.kind != "str":
                self.fail("expected a module name")
            self.next()
        self.attributes()
        return self.semicolon()

    def attributes(self) -> None:
        if (self.at("with") or self.at("assert") and not self.nl) and self.peek()[1] == "{":
            self.next()
            self.next()
            while not self.at("}"):
                if self.kind not in ("id", "str"):
                    self.fail()
                self.next()
                self.need(":")
                if self.kind != "str":
                    self.fail()
                self.next()
                if not self.eat(","):
                    break
            self.need("}")

    def export_name(self, n: str) -> None:
        if n in self.exports:
            self.fail(f"{n} is exported already")
        self.exports.add(n)

    def st_export(self, decl, top, _):
        if not (self.module and top):
            self.fail("export outside a module's top level")
        self.next()
        if self.eat("*"):
            if self.eat("as"):
                if self.kind not in ("id", "str"):
                    self.fail()
                self.export_name(self.val.strip("'\""))
                self.next()
            self.need("from")
            if self.kind != "str":
                self.fail()
            self.next()
            self.attributes()
            return self.semicolon()
        if self.eat("default"):
            self.export_name("default")
            if self.at("@"):
                self.decorators()
            if self.at("function"):
                return self.function(True, "top", optional=True)
            if self.at("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                return self.function(True, "top", is_async=True, optional=True)
            if self.at("class"):
                return self.class_(True, optional=True)
            self.assign()
            return self.semicolon()
        if self.eat("{"):
            local = []
            while not self.at("}"):
                if self.kind not in ("id", "str"):
                    self.fail()
                local.append((self.val, self.kind))
                out = self.val
                self.next()
                if self.eat("as"):
                    if self.kind not in ("id", "str"):
                        self.fail()
                    out = self.val
                    self.next()
                self.export_name(out.strip("'\""))
                if not self.eat(","):
                    break
            self.need("}")
            if self.eat("from"):
                if self.kind != "str":
                    self.fail()
                self.next()
                self.attributes()
            else:
                for n, k in local:
                    if k == "str" or n in RESERVED or n in STRICT_RESERVED:
                        self.fail()
                    self.wanted.append(n)
            return self.semicolon()
        before = dict(self.scopes[0])
        if self.at("@"):
            self.decorators()
        if self.val in ("var", "let", "const"):
            self.variables()
        elif self.at("function"):
            self.function(True, "top")
        elif self.at("async") and self.peek()[1] == "function":
            self.next()
            self.function(True, "top", is_async=True)
        elif self.at("class"):
            self.class_(True)
        else:
            self.fail()
        for n in self.scopes[0]:
            if n not in before:
                self.export_name(n)
        return None

    # -- functions and classes ----------------------------------------------------------------------------------
    def function(self, declaration: bool, kind: str = "", is_async: bool = False, optional: bool = False) -> None:
        self.need("function")
        gen = self.eat("*")
        if declaration:
            if not (optional and self.at("(")):
                self.declare(self.name(), kind if not (gen or is_async) or kind == "top" else "let")
        elif not self.at("("):
            fn = self.fn
            self.fn = _Fn(is_async, gen, fn.strict)
            self.name()
            self.fn = fn
        self.params_and_body(_Fn(is_async, gen, self.fn.strict))

    def params_and_body(self, fn: _Fn, arity: int | None = None) -> None:
        outer, in_ok = self.fn, self.in_ok
        self.fn, self.in_ok = fn, True
        fn.can_return = True
        self.need("(")
        self.scopes.append({"\0fn": ""})
        simple, names = self.params(")", arity)
        self.body(simple, names)
        self.scopes.pop()
        self.fn, self.in_ok = outer, in_ok
        self.next_after_body()

    def next_after_body(self) -> None:
        """The closing brace is still the token; what follows is read under the outer function's rules."""
        self.next()

    def params(self, close: str, arity: int | None = None) -> tuple[bool, list[str]]:
        simple, n = True, 0
        names: list[str] = []
        while not self.at(close):
            if self.at("@"):
                self.decorators()
            n += 1
            if self.eat("..."):
                simple = False
                self.param(names)
                if not self.at(close):
                    self.fail("rest must be last")
                if arity == 1:
                    self.fail()
                break
            if self.kind != "id":
                simple = False
            self.param(names)
            if self.eat("="):
                simple = False
                self.assign()
            if not self.eat(","):
                break
        if arity is not None and n != arity:
            self.fail("wrong number of parameters")
        self.need(close)
        return simple, names

    def param(self, names: list[str]) -> None:
        scope: dict[str, str] = {}
        self.scopes.append(scope)
        own = self.declare
        got: list[str] = []

        def take(name: str, kind: str) -> None:
            got.append(name)

        self.declare = take  # type: ignore[method-assign]
        try:
            self.binding("param")
        finally:
            self.declare = own  # type: ignore[method-assign]
            self.scopes.pop()
        names += got

    def body(self, simple: bool, names: list[str]) -> None:
        """From { to }, which stays the current token."""
        if not self.at("{"):
            self.fail("expected {")
        for n in names:
            self.scopes[-1][n] = "param"
        self.next()
        if self.directives() and not simple:
            self.fail("use strict with parameters that aren't simple")
        if (self.fn.strict or not simple or self.fn.arrow or self.fn.method) and len(set(names)) != len(names):
            self.fail("parameter names repeat")
        if self.fn.strict and any(n in ("eval", "arguments") for n in names):
            self.fail()
        while not self.at("}"):
            if self.kind == "eof":
                self.fail("unclosed body")
            self.statement(True)
        # let of the body may not repeat a parameter: declare() saw them as "param"

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.paren()
            else:
                self.name(False)
                while self.eat("."):
                    if self.kind not in ("id", "priv"):
                        self.fail()
                    self.next()
                if self.at("("):
                    self.arguments()

    def class_(self, declaration: bool, optional: bool = False) -> None:
        self.need("class")
        strict, self.fn.strict = self.fn.strict, True
        if declaration and not (optional and (self.at("{") or self.at("extends"))):
            self.declare(self.name(), "let")
        elif not declaration and not self.at("{") and not self.at("extends"):
            self.name()
        heritage = self.eat("extends")
        if heritage:
            self.left_hand()
        if not self.at("{"):
            self.fail()
        self.next()
        declared: dict[str, str] = {}
        used: set[str] = set()
        self.privates.append((set(), used))
        ctor = False
        while not self.at("}"):
            if self.eat(";"):
                continue
            ctor = self.member(ctor, heritage, declared)
        known = set(declared)
        self.privates.pop()
        missing = used - known
        if missing:
            if not self.privates:
                self.fail("unknown private name")
            self.privates[-1][1].update(missing)
        self.fn.strict = strict
        self.next()

    def member(self, ctor: bool, heritage: bool, declared: dict[str, str]) -> bool:
        if self.at("@"):
            self.decorators()
        static = False
        if self.at("static") and self.peek()[1] not in ("(", "=", ";", "}"):
            static = True
            self.next()
            if self.at("{"):
                outer = self.fn
                self.fn = _Fn(strict=True, can_return=False, method=True)
                self.fn.static_block = True
                self.scopes.append({"\0fn": ""})
                self.block()
                self.scopes.pop()
                self.fn = outer
                return ctor
        is_async = gen = False
        accessor = ""
        if self.at("async") and not self.peek()[2] and self.peek()[1] not in ("(", "=", ";", "}", ","):
            is_async = True
            self.next()
        if self.eat("*"):
            gen = True
        if not (is_async or gen) and (self.at("get") or self.at("set")):
            kind, val, nl = self.peek()
            if val not in ("(", "=", ";", "}", ",") and not (nl and val == "*"):
                accessor = self.val
                self.next()
        private = self.kind == "priv"
        raw = self.val.strip("'\"") if self.kind in ("id", "str", "priv") else ""
        self.property_name(True)
        if private:
            old = declared.get(raw)
            now = accessor + ("s" if static else "")
            if raw == "#constructor" or old is not None and not ({old, now} in ({"get", "set"}, {"gets", "sets"})):
                self.fail("private name repeats")
            declared[raw] = "both" if old else now
        if self.at("("):
            is_ctor = raw == "constructor" and not static and not private
            if is_ctor:
                if ctor or is_async or gen or accessor:
                    self.fail("bad constructor")
                ctor = True
            if static and raw == "prototype":
                self.fail()
            fn = _Fn(is_async, gen, True, method=True, ctor=is_ctor and heritage)
            self.params_and_body(fn, {"get": 0, "set": 1}.get(accessor))
            return ctor
        if is_async or gen or accessor or raw == "constructor" or static and raw == "prototype":
            self.fail("expected (")
        if self.at("="):
            outer = self.fn
            self.fn = _Fn(strict=True, can_return=False, method=True)
            self.next()
            self.with_in(self.assign)
            self.fn = outer
        self.semicolon()
        return ctor

    def property_name(self, private: bool = False) -> None:
        if self.kind in ("id", "str", "num"):
            self.next()
        elif self.kind == "priv" and private:
            self.next()
        elif self.eat("["):
            self.with_in(self.assign)
            self.need("]")
        else:
            self.fail("expected a property name")

    # -- expressions --------------------------------------------------------------------------------------------
    def expression(self, cover: bool = False):
        node = self.assign(cover)
        while self.at(","):
            self.no_cover(node)
            self.next()
            self.assign()
            node = ("other",)
        return node

    def no_cover(self, node) -> None:
        if node[-1] is True:
            self.fail("shorthand initialiser outside a pattern")

    def target(self, node, binding: bool = False) -> None:
        """Checks that a node may be assigned to (destructuring included)."""
        kind = node[0]
        if kind == "id":
            if self.fn.strict and node[1] in ("eval", "arguments"):
                self.fail("bad target")
        elif kind == "member":
            pass
        elif kind == "paren" and node[1][0] in ("id", "member"):
            self.target(node[1])
        elif kind == "array":
            for i, x in enumerate(node[1]):
                if x is None:
                    continue
                if x[0] == "spread":
                    if i + 1 < len(node[1]) or node[2]:
                        self.fail("rest must be last")
                    x = x[1]
                    if x[0] == "assign":
                        self.fail()
                self.target(x[1] if x[0] == "assign" else x)
        elif kind == "object":
            for x in node[1]:
                if x[0] == "method":
                    self.fail("bad target")
                if x[0] == "spread":
                    if x is not node[1][-1] or x[1][0] not in ("id", "member", "paren"):
                        self.fail("bad rest")
                    self.target(x[1])
                    continue
                self.target(x[1] if x[0] == "assign" else x)
        else:
            self.fail("bad assignment target")

    def assign(self, cover: bool = False):
        return self._assign(cover)

    def _assign(self, cover: bool):
        if self.kind == "id":
            if self.val == "yield" and (self.fn.is_gen):
                self.next()
                if not self.nl:
                    if self.eat("*"):
                        self.assign()
                    elif not (self.kind == "eof" or self.kind == "p" and self.val in (")", "]", "}", ",", ";", ":") or self.val in ("in", "of")):
                        self.assign()
                return ("other",)
            if self.val == "async" and self.arrow_async():
                return ("other",)
            if self.is_name():
                kind, val, nl = self.peek()
                if val == "=>" and not nl:
                    return self.arrow_simple(False)
        elif self.val == "(" and self.kind == "p" and self.tok_start not in self.not_arrow and self.arrow_paren(False):
            return ("other",)
        node = self.conditional()
        if self.kind == "p" and self.val in _ASSIGN:
            if self.val == "=":
                self.target(node)
            else:
                self.no_cover(node)
                if node[0] == "paren":
                    node = node[1]
                if node[0] not in ("id", "member"):
                    self.fail("bad assignment target")
                self.target(node)
            op = self.val
            self.next()
            self.assign()
            return ("assign", node) if op == "=" else ("other",)
        if not cover:
            self.no_cover(node)
        return node

    def arrow_async(self) -> bool:
        kind, val, nl = self.peek()
        if nl:
            return False
        if kind == "id" and val not in RESERVED and val != "of" or val == "of" and kind == "id":
            st = self.state()
            self.next()
            if self.peek()[1] == "=>" and self.is_name():
                self.arrow_simple(True)
                return True
            self.restore(st)
            return False
        if val == "(":
            st = self.state()
            start = self.tok_start
            if start in self.not_arrow:
                return False
            self.next()
            if self.arrow_paren(True):
                return True
            self.not_arrow.add(start)
            self.restore(st)
        return False

    def arrow_simple(self, is_async: bool):
        fn = _Fn(is_async or self.fn.is_async and False, False, self.fn.strict, arrow=True)
        self.inherit(fn)
        name = self.name()
        if is_async and name == "await":
            self.fail()
        self.arrow_body(fn, True, [name])
        return ("other",)

    def inherit(self, fn: _Fn) -> None:
        fn.method, fn.ctor = self.fn.method, self.fn.ctor
        if self.fn.static_block:
            fn.static_block = True

    def arrow_paren(self, is_async: bool) -> bool:
        st, start = self.state(), self.tok_start
        scopes, privs = len(self.scopes), len(self.privates)
        outer, in_ok = self.fn, self.in_ok
        try:
            fn = _Fn(is_async, False, outer.strict, arrow=True)
            self.inherit(fn)
            self.next()
            self.in_ok = True
            simple, names = self.params(")")
            if not self.at("=>") or self.nl:
                raise JSError("no arrow")
        except JSError:
            del self.scopes[scopes:]
            del self.privates[privs:]
            self.fn, self.in_ok = outer, in_ok
            self.restore(st)
            self.not_arrow.add(start)
            return False
        self.in_ok = in_ok
        self.arrow_body(fn, simple, names)
        return True

    def arrow_body(self, fn: _Fn, simple: bool, names: list[str]) -> None:
        if not self.at("=>") or self.nl:
            self.fail("expected =>")
        outer, in_ok = self.fn, self.in_ok
        if self.module and not fn.is_async:
            pass
        self.fn = fn
        self.scopes.append({"\0fn": ""})
        self.next()
        if self.at("{"):
            self.in_ok = True
            self.body(simple, names)
            self.fn, self.in_ok = outer, in_ok
            self.scopes.pop()
            self.next()
        else:
            if len(set(names)) != len(names):
                self.fail("parameter names repeat")
            fn.can_return = False
            for n in names:
                self.scopes[-1][n] = "param"
            self.assign()
            self.scopes.pop()
            self.fn, self.in_ok = outer, in_ok

    def conditional(self):
        node = self.binary(0)
        if self.at("?"):
            self.no_cover(node)
            self.next()
            self.with_in(self.assign)
            self.need(":")
            self.assign()
            return ("other",)
        return node

    def binary(self, least: int):
        if self.kind == "priv":
            self.privates[-1][1].add(self.val) if self.privates else self.fail("private name outside a class")
            self.next()
            if not self.at("in") or not self.in_ok:
                self.fail()
            left = ("other",)
        else:
            left = self.unary()
        mixed = ""
        while True:
            op = self.val if self.kind in ("p", "id") else ""
            level = _BINARY.get(op)
            if level is None or level <= least or op == "in" and not self.in_ok:
                return left
            self.no_cover(left)
            if op == "**" and left[0] == "unary":
                self.fail("unary operand of **")
            group = "??" if op == "??" else "||" if op in ("||", "&&") else ""
            if group and (mixed and mixed != group or left[0] == "logic" and left[1] != group):
                self.fail("mixed ?? and ||")
            mixed = group or mixed
            self.next()
            right = self.binary(level - 1 if op == "**" else level)
            self.no_cover(right)
            if group and right[0] == "logic" and right[1] != group:
                self.fail("mixed ?? and ||")
            left = ("logic", group) if group else ("other",)

    def unary(self):
        if self.kind == "p" and self.val in ("+", "-", "!", "~"):
            self.next()
            self.no_cover(self.unary())
            return ("unary",)
        if self.kind == "p" and self.val in ("++", "--"):
            self.next()
            self.simple_target(self.unary())
            return ("other",)
        if self.kind == "id" and self.val in ("typeof", "void", "delete"):
            op = self.val
            self.next()
            x = self.unary()
            self.no_cover(x)
            if op == "delete" and self.fn.strict and (x[0] == "id" or x[0] == "paren" and x[1][0] == "id"):
                self.fail("delete of a name")
            return ("unary",)
        if self.kind == "id" and self.val == "await" and (self.fn.is_async or self.module and self.fn.top):
            self.next()
            self.no_cover(self.unary())
            return ("unary",)
        node = self.left_hand()
        if self.kind == "p" and self.val in ("++", "--") and not self.nl:
            self.simple_target(node)
            self.next()
            return ("other",)
        return node

    def simple_target(self, node) -> None:
        if node[0] == "paren":
            node = node[1]
        if node[0] not in ("id", "member"):
            self.fail("bad operand")
        self.target(node)

    def arguments(self) -> None:
        self.need("(")
        was, self.in_ok = self.in_ok, True
        while not self.at(")"):
            self.eat("...")
            self.assign()
            if not self.eat(","):
                break
        self.in_ok = was
        self.need(")")

    def left_hand(self, new: bool = False):
        node = self.primary(new)
        chain = False
        while True:
            if self.kind == "p":
                v = self.val
                if v == ".":
                    self.no_cover(node)
                    self.next()
                    self.member_name()
                    node = ("other",) if chain else ("member",)
                    continue
                if v == "?.":
                    if new:
                        self.fail("?. after new")
                    self.no_cover(node)
                    chain = True
                    self.next()
                    if self.at("("):
                        self.arguments()
                    elif self.eat("["):
                        self.with_in(self.expression)
                        self.need("]")
                    elif self.kind == "tpl":
                        self.fail()
                    else:
                        self.member_name()
                    node = ("other",)
                    continue
                if v == "[":
                    self.no_cover(node)
                    self.next()
                    self.with_in(self.expression)
                    self.need("]")
                    node = ("other",) if chain else ("member",)
                    continue
                if v == "(" and not new:
                    self.no_cover(node)
                    self.arguments()
                    node = ("other",)
                    continue
            elif self.kind == "tpl":
                if chain:
                    self.fail("template after ?.")
                self.no_cover(node)
                self.template(True)
                node = ("other",)
                continue
            return node

    def member_name(self) -> None:
        if self.kind == "priv":
            if not self.privates:
                self.fail("private name outside a class")
            self.privates[-1][1].add(self.val)
        elif self.kind != "id":
            self.fail("expected a member name")
        self.next()

    def template(self, tagged: bool = False) -> None:
        at = self.end
        while True:
            m = _TPL.match(self.s, at)
            if not m:
                self.fail("unclosed template")
            if not tagged and re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|0\d|x(?![0-9a-fA-F]{2})|u(?!\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4}))", m[1]):
                self.fail("bad escape")
            if m[2] == "`":
                self.end = m.end()
                self.next()
                return
            self.end = m.end()
            self.next()
            self.with_in(self.expression)
            if not self.at("}"):
                self.fail("expected }")
            at = self.end

    def primary(self, new: bool = False):
        kind, v = self.kind, self.val
        if kind == "id":
            if v == "function":
                self.function(False)
                return ("other",)
            if v == "class":
                self.class_(False)
                return ("other",)
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                self.function(False, is_async=True)
                return ("other",)
            if v in ("this", "null", "true", "false"):
                self.next()
                return ("other",)
            if v == "new":
                self.next()
                if self.eat("."):
                    if not self.at("target") or self.fn.top and self.mode != "function":
                        self.fail("new.target outside a function")
                    self.next()
                    return ("other",)
                if self.at("import") and self.peek()[1] == "(":
                    self.fail()
                self.no_cover(self.left_hand(True))
                if self.at("("):
                    self.arguments()
                return ("other",)
            if v == "super":
                self.next()
                if self.at("("):
                    if not self.fn.ctor:
                        self.fail("super() outside a derived constructor")
                elif not (self.at(".") or self.at("[")) or not self.fn.method:
                    self.fail("super outside a method")
                return ("other",)
            if v == "import":
                self.next()
                if self.eat("."):
                    if not self.at("meta") or not self.module:
                        self.fail("import.meta outside a module")
                    self.next()
                    return ("other",)
                self.need("(")
                self.with_in(self.assign)
                if self.eat(",") and not self.at(")"):
                    self.assign()
                    self.eat(",")
                self.need(")")
                return ("other",)
            name = self.name(False)
            return ("id", name)
        if kind in ("num", "str"):
            self.next()
            return ("other",)
        if kind == "tpl":
            self.template()
            return ("other",)
        if kind == "p":
            if v == "(":
                self.next()
                node = self.with_in(lambda: self.expression(True))
                self.need(")")
                self.no_cover(node)
                return ("paren", node) if node[0] in ("id", "member") else ("parens",)
            if v == "[":
                return self.array()
            if v == "{":
                return self.object()
            if v in ("/", "/="):
                m = _REGEX.match(self.s, self.tok_start)
                if not m or not regex_ok(m[1], m[2]):
                    self.fail("bad regular expression")
                self.end = m.end()
                self.next()
                return ("other",)
            if v == "@":
                self.decorators()
                self.class_(False)
                return ("other",)
        self.fail()

    def array(self):
        self.next()
        was, self.in_ok = self.in_ok, True
        items, cover, trailing = [], False, False
        while not self.at("]"):
            if self.eat(","):
                items.append(None)
                continue
            if self.eat("..."):
                x = self.assign(True)
                cover |= x[-1] is True
                items.append(("spread", x))
                trailing = self.at(",")
            else:
                x = self.assign(True)
                cover |= x[-1] is True
                items.append(x)
            if not self.eat(","):
                break
        self.in_ok = was
        self.need("]")
        return ("array", items, trailing, True) if cover else ("array", items, trailing, None)

    def object(self):
        self.next()
        was, self.in_ok = self.in_ok, True
        items, cover, protos = [], False, 0
        while not self.at("}"):
            if self.eat("..."):
                x = self.assign(True)
                cover |= x[-1] is True
                items.append(("spread", x))
            else:
                is_async = gen = False
                accessor = ""
                if self.at("async") and not self.peek()[2] and self.peek()[1] not in (",", ":", "(", "}", "="):
                    is_async = True
                    self.next()
                if self.eat("*"):
                    gen = True
                if not (is_async or gen) and (self.at("get") or self.at("set")) and self.peek()[1] not in (",", ":", "(", "}", "="):
                    accessor = self.val
                    self.next()
                plain, st = self.kind == "id", self.state()
                raw = self.val.strip("'\"") if self.kind in ("id", "str") else ""
                self.property_name()
                if self.at("("):
                    self.params_and_body(_Fn(is_async, gen, self.fn.strict, method=True), {"get": 0, "set": 1}.get(accessor))
                    items.append(("method",))
                elif is_async or gen or accessor:
                    self.fail("expected (")
                elif self.eat(":"):
                    if raw == "__proto__":
                        protos += 1
                    x = self.assign(True)
                    cover |= x[-1] is True
                    items.append(x)
                elif plain:
                    after = self.state()
                    self.restore(st)
                    name = self.name(False)
                    self.restore(after)
                    x = ("id", name)
                    if self.eat("="):
                        self.assign()
                        cover = True
                        x = ("assign", x)
                    items.append(x)
                else:
                    self.fail("expected :")
            if not self.eat(","):
                break
        self.in_ok = was
        self.need("}")
        if protos > 1 and not self.at("="):
            self.fail("__proto__ repeats")
        return ("object", items, True) if cover else ("object", items, None)


_STATEMENTS = frozenset("var const function class if while do for continue break return throw with switch try debugger import export".split())


def js_error(text: str, mode: str) -> str | None:
    """None if ``text`` is valid in ``mode`` (module, script, function), else why not. What is nested beyond memory's reach is
    undecided, and so not called invalid."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, MAX_FRAMES))
    try:
        Recogniser(text, mode).run()
        return None
    except JSError as e:
        return str(e)
    except (RecursionError, MemoryError):
        return None
    finally:
        sys.setrecursionlimit(limit)
