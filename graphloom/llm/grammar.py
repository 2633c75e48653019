"""Adjacent token pairs that a grammar permits.

A grammar is a text of EBNF rules (``name = a b | [c] {d} ;``). ``pairs`` computes FIRST, LAST and nullability by fixpoint
and from them every pair of token classes that can stand side by side in some sentence. The grammars below describe a
superset of each language on purpose: a pair they lack cannot occur in a valid file.
"""

from __future__ import annotations

import re
from functools import lru_cache

_PART = re.compile(r"\s*(?:'([^']*)'|([A-Z]+)(?![a-z\w])|([a-z]\w*)|([=|;()\[\]{}]))")


class _Grammar:
    def __init__(self, text: str) -> None:
        self.toks = [(m.lastindex, m[m.lastindex]) for m in _PART.finditer(text)]
        self.i = 0
        self.rules: dict[str, tuple] = {}
        while self.i < len(self.toks):
            name = self._take()[1]
            self._take()
            self.rules[name] = self._alt()
            self._take()

    def _take(self):
        self.i += 1
        return self.toks[self.i - 1]

    def _peek(self):
        return self.toks[self.i][1] if self.i < len(self.toks) and self.toks[self.i][0] == 4 else None

    def _alt(self):
        alts = [self._seq()]
        while self._peek() == "|":
            self._take()
            alts.append(self._seq())
        return ("alt", alts)

    def _seq(self):
        items = []
        while self._peek() not in ("|", ";", ")", "]", "}"):
            kind, v = self._take()
            if kind == 1:
                items.append(("tok", v))
            elif kind == 2:
                items.append(("tok", v))
            elif kind == 3:
                items.append(("ref", v))
            else:
                inner = self._alt()
                self._take()
                items.append({"(": inner, "[": ("opt", inner), "{": ("rep", inner)}[v])
        return ("seq", items)

    def solve(self, start: str) -> set[tuple[str, str]]:
        known: dict[str, tuple[bool, frozenset, frozenset]] = {n: (False, frozenset(), frozenset()) for n in self.rules}
        out: set[tuple[str, str]] = set()

        def walk(x) -> tuple[bool, frozenset, frozenset]:
            kind, v = x
            if kind == "tok":
                return False, frozenset([v]), frozenset([v])
            if kind == "ref":
                return known[v]
            if kind in ("opt", "rep"):
                _, first, last = walk(v)
                if kind == "rep":
                    out.update((a, b) for a in last for b in first)
                return True, first, last
            if kind == "alt":
                parts = [walk(y) for y in v]
                return any(p[0] for p in parts), frozenset().union(*(p[1] for p in parts)), frozenset().union(*(p[2] for p in parts))
            null, first, last = True, frozenset(), frozenset()
            for y in v:
                n, f, l = walk(y)
                out.update((a, b) for a in last for b in f)
                if null:
                    first |= f
                last = last | l if n else l
                null = null and n
            return null, first, last

        while True:
            before, n = dict(known), len(out)
            for name, rule in self.rules.items():
                known[name] = walk(rule)
            if known == before and len(out) == n:
                break
        return out | {("START", t) for t in known[start][1]} | {(t, "END") for t in known[start][2]} | ({("START", "END")} if known[start][0] else set())


JSON = """
value = STR | NUM | 'true' | 'false' | 'null' | '{' [member {',' member}] '}' | '[' [value {',' value}] ']' ;
member = STR ':' value ;
"""

TOML = """
file = {NL} [line {NL {NL} line}] {NL} ;
line = key '=' value | '[' key ']' | '[[' key ']]' ;
key = part {'.' part} ;
part = BARE | STR ;
value = STR | LONG | NUM | BARE | array | '{' [key '=' value {',' key '=' value}] '}' ;
array = '[' {NL} [value {NL} {',' {NL} value {NL}} [',' {NL}]] ']' ;
"""

PYTHON = """
file = {NEWLINE} {stmt} ;
stmt = simple NEWLINE | compound ;
simple = small {';' small} [';'] ;
small = exprs {('=' | AUG) exprs} | NAME ':' expr ['=' exprs] | expr ':' expr ['=' exprs] | 'pass' | 'break' | 'continue' | 'return' [exprs] | 'raise' [expr ['from' expr]]
  | 'global' names | 'nonlocal' names | 'del' exprs | 'assert' expr [',' expr] | 'import' dotted ['as' NAME] {',' dotted ['as' NAME]}
  | 'from' {'.' | '...'} [dotted] 'import' ('*' | imported | '(' imported [','] ')') | NAME NAME ['[' params ']'] '=' expr ;
imported = NAME ['as' NAME] {',' NAME ['as' NAME]} ;
names = NAME {',' NAME} ;
dotted = NAME {'.' NAME} ;
suite = ':' (simple NEWLINE | NEWLINE INDENT {stmt} stmt DEDENT) ;
compound = 'if' expr suite {'elif' expr suite} ['else' suite] | 'while' expr suite ['else' suite] | ['async'] 'for' exprs 'in' exprs suite ['else' suite]
  | 'try' suite ({'except' ['*'] [exprs ['as' NAME]] suite} ['else' suite] ['finally' suite]) | ['async'] 'with' ('(' item {',' item} [','] ')' | item {',' item}) suite
  | {'@' expr NEWLINE} (['async'] 'def' NAME ['[' params ']'] '(' [params] ')' ['->' exprs] suite | 'class' NAME ['[' params ']'] ['(' [args] ')'] suite)
  | NAME exprs ':' NEWLINE INDENT NAME exprs ['if' expr] suite {NAME pattern ['if' expr] suite} DEDENT ;
pattern = exprs ['as' NAME] {'|' exprs} ;
item = expr ['as' expr] ;
params = param {',' param} [','] ;
param = NAME [':' star] ['=' expr] | '*' [NAME [':' star]] | '**' NAME [':' expr] | '/' ;
star = expr | '*' expr ;
exprs = star {',' star} [','] ;
expr = 'lambda' [lparams] ':' expr | or ['if' or 'else' expr] | NAME ':=' expr | 'yield' [exprs] | 'yield' 'from' expr ;
lparams = lparam {',' lparam} [','] ;
lparam = NAME ['=' expr] | '*' [NAME] | '**' NAME | '/' ;
or = unary {BIN unary} ;
unary = {'not' | SIGN | 'await'} atom {trailer} ;
atom = NAME | NUM | strings | 'None' | 'True' | 'False' | '...' | '(' [exprs [gen]] ')' | '[' [exprs [gen]] ']' | '{' [entry {',' entry} [','] [gen]] '}' ;
entry = star [':' expr] | '**' expr ;
gen = ['async'] 'for' exprs 'in' or {['async'] 'for' exprs 'in' or | 'if' expr} ;
strings = string {string} ;
string = STR | FSTART {FMID | '{' exprs ['='] ['!' NAME] [':' {FMID | '{' exprs ['='] ['!' NAME] [':' {FMID}] '}'}] '}'} FEND ;
trailer = '.' NAME | '(' [args] ')' | '[' sub {',' sub} [','] ']' ;
args = arg {',' arg} [','] ;
arg = expr [gen] | NAME '=' expr | '*' expr | '**' expr | pattern ;
sub = [expr] ':' [expr] [':' [expr]] | star ;
"""

#: Classes that stand for several tokens of the same standing (fixed values of the languages).
PYTHON_GROUPS = {
    "BIN": ["or", "and", "in", "is", "not", "<", ">", "==", ">=", "<=", "!=", "|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@", "**"],
    "SIGN": ["+", "-", "~"],
    "AUG": ["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="],
}
PYTHON_EXTRA = [("not", "in"), ("is", "not")]


@lru_cache
def permissible(lang: str) -> frozenset[tuple[str, str]]:
    """The pairs of ``lang`` (json, toml, python); groups are unfolded."""
    if lang == "json":
        return frozenset(_Grammar(JSON).solve("value"))
    if lang == "toml":
        return frozenset(_Grammar(TOML).solve("file"))
    if lang == "js":
        return frozenset(_js_pairs())
    out: set[tuple[str, str]] = set()
    for a, b in _Grammar(PYTHON).solve("file"):
        out.update((x, y) for x in PYTHON_GROUPS.get(a, [a]) for y in PYTHON_GROUPS.get(b, [b]))
    return frozenset(out | set(PYTHON_EXTRA))


JS = """
file = {stmt} ;
stmt = OPEN {stmt} CLOSE | ';' | expr [';'] | DECL binding {',' binding} [';'] | WORD [expr] [';'] | HEAD '(' head ')' stmt | 'else' stmt | 'do' stmt HEAD '(' expr ')' [';']
  | 'try' OPEN {stmt} CLOSE | 'catch' ['(' target ')'] OPEN {stmt} CLOSE | 'finally' OPEN {stmt} CLOSE | 'case' expr ':' {stmt} | 'default' ':' {stmt} | NAME ':' stmt
  | 'import' [clause 'from'] STR [NAME object] [';'] | 'export' (stmt | 'default' stmt | '*' ['as' name] 'from' STR [';'] | OPEN {name ['as' name] [',']} CLOSE ['from' STR] [';']) ;
clause = NAME [',' clause] | '*' 'as' NAME | OPEN {name ['as' NAME] [',']} CLOSE ;
head = [DECL] [expr] [('of' | 'in') expr] {';' [expr]} ;
binding = target ['=' assign] ;
target = NAME | '[' {[','] ['...'] target ['=' assign]} ']' | OPEN {[','] (key [':' target] ['=' assign] | '...' NAME)} [','] CLOSE ;
name = NAME | KEY | STR | 'default' | 'as' | 'from' | 'of' ;
key = NAME | STR | NUM | KEY | PRIV | '[' assign ']' ;
expr = assign {',' assign} ;
assign = {PREFIX} operand {(INFIX | '?' | ':' | 'in' | '=' | '=>') {PREFIX} operand} ;
operand = primary {'.' (NAME | KEY | PRIV) | '?.' (NAME | KEY | PRIV | '(' args ')' | '[' expr ']') | '[' expr ']' | '(' args ')' | template | POST} ;
args = {[','] ['...'] assign} [','] ;
primary = NAME | NUM | STR | REGEX | template | 'this' | PRIV | '(' [['...'] expr {',' ['...'] assign} [',']] ')' | '[' {','} [['...'] assign {',' {','} ['...'] assign} {','}] ']' | object | function | class | OPEN {stmt} CLOSE | 'import' | 'new' '.' NAME ;
template = TPL | THEAD expr {TMID expr} TTAIL ;
object = OPEN [property {',' property} [',']] CLOSE ;
property = {MOD} key [':' assign | '=' assign | params OPEN {stmt} CLOSE] | '...' assign ;
params = '(' {[','] ['...'] [deco] target ['=' assign]} [','] ')' ;
function = ['async'] 'function' ['*'] [NAME] params OPEN {stmt} CLOSE ;
class = [deco] 'class' [NAME] ['extends' operand] OPEN {member} CLOSE ;
deco = '@' operand {'@' operand} ;
member = [deco] {MOD} key [params OPEN {stmt} CLOSE | '=' assign] [';'] | ';' | 'static' OPEN {stmt} CLOSE ;
"""
JS_GROUPS = {
    "OPEN": ["{"],
    "CLOSE": ["}"],
    "DECL": ["var", "let", "const"],
    "WORD": ["return", "throw", "break", "continue", "debugger"],
    "HEAD": ["if", "for", "while", "switch", "with"],
    "INFIX": ["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=", "??", "||", "&&", "|", "^", "&", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "instanceof", "<<", ">>", ">>>", "+", "-", "*", "/", "%", "**"],
    "PREFIX": ["+", "-", "!", "~", "++", "--", "typeof", "void", "delete", "await", "yield", "new", "async"],
    "POST": ["++", "--"],
    "MOD": ["static", "async", "get", "set", "*"],
    "KEY": [],
    "NAME": ["NAME", "let", "async", "get", "set", "static", "of", "as", "from", "await", "yield", "accessor", "super", "null", "true", "false"],
}


def _js_pairs() -> set[tuple[str, str]]:
    from graphloom.llm.jsparse import RESERVED

    groups = JS_GROUPS | {"KEY": sorted(RESERVED)}
    out: set[tuple[str, str]] = set()
    for a, b in _Grammar(JS).solve("file"):
        out.update((x, y) for x in groups.get(a, [a]) for y in groups.get(b, [b]))
    # No semicolon is needed where a line ends: what ends an expression may meet what begins a statement.
    ends = {a for a, b in out if b in (";", "END")}
    starts = {b for a, b in out if a in ("START", ";")}
    out |= {(a, b) for a in ends for b in starts}
    out |= {("yield", "*"), ("for", "await"), ("await", "("), ("await", "using")} | {("yield", x) for x in (")", "]", "}", ",", ";", ":")}
    return out
