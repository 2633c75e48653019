import ast

from graphloom.llm import docpairs as D

SCHEMA = "repository_id string, path string, content binary"
PY = '''\
# Walk the frozen list and keep entries.
@deco(
    x)
# Not above the definition's decorators but between them.
def above(a):
    return "def inner(): 'Not a function but a string at all'"

def plain():
    # a comment first
    r"""Returns every window whose owner is still registered."""
    def nested():
        "Nested functions are water and never come out here."

class C:
    """Classes are no functions, whatever they say about themselves."""

    @property
    def p(self):
        "Compare both sides of the pair and report drift."

    @p.setter
    def p(self, v):
        "Compare both sides of the pair and report drift again."

    async def q(self): "Guard against an edge that arrives twice."

    class D:
        def deep(self):
            """A method of a nested class does not count at all."""

    # Only comment, long enough to say something here.

    def gap(self): pass

if True:
    def conditional():
        "A function below a condition is no top level function."

def empty():
    ""
    # After an empty docstring this comment changes nothing today.

def after(x=(1,
             2)): return x  # trailing comments on code lines are no documentation blocks
'''
JS = '''\
/**
 * Compute how many slots remain before work is refused.
 * @param {Array} items the rows
 */
export async function a(items) { return `}${items.map((x) => `{${x}`)}`; }

/* Order matters here, entries are written before markers. */
function b() { const r = /[/}]"/; return r; }

// The caller must hold the lock, otherwise workers observe tokens.

function gap() {}

class K extends L {
  /** Returns every lease whose owner is still registered. */
  static async m(x) { if (x) { n(); } }
  // Retries twice on a broken link, then gives up.
  get v() { return function inner() {}; }
  field = 1;
  /** TODO */
  t() {}
}

const f = /** Function expressions bound to names are no declarations here. */ function g() {};
{
  /** A function inside of a block is not at top level here. */
  function h() {}
}
'''


def test_python_islands_equal_the_tree():
    got = D.python_pairs(PY, "pkg.mod")
    lines = PY.split("\n")
    want = []

    def add(n, cls):
        doc = ast.get_docstring(n, clean=False)
        if doc is None:
            doc = D._comment_above(lines, min([n.lineno, *[d.lineno for d in n.decorator_list]]))
        if doc:
            want.append((".".join(x for x in ("pkg.mod", cls, n.name) if x), n.name, doc))

    for n in ast.parse(PY).body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(n, "")
        elif isinstance(n, ast.ClassDef):
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(m, n.name)
    assert got == want and {q for q, _, _ in got} == {"pkg.mod.above", "pkg.mod.plain", "pkg.mod.C.p", "pkg.mod.C.q"}


def test_javascript_islands():
    assert [q for q, n, d in D.js_pairs(JS) if D.says_something(d, n)] == ["a", "b", "K.m", "K.v"]


def test_says_something():
    yes = D.says_something
    assert yes("Convert raw values into compact form.", "f")
    for text, name in (
        ("", "f"), ("TODO: describe", "f"), ("The encode bucket function.", "encode_bucket"), ("Does rank batch", "rankBatch"), (":param a: the long list of all values\n:return: every one of them", "f"),
        ("@param {Array} items the rows of the table\n@returns {Array} all of them", "f"), ("Args:\n    a: the value that is used here\n    b: another long description\n", "f"), ("noqa: E501 this is a long line on purpose", "f"),
        ("eslint-disable-next-line no-unused-vars, because we need it", "f"), ("See above.", "f"), ("...", "f"), ("Parameters\n----------\na : int\n    The number of things to count.\n", "f"),
    ):
        assert not yes(text, name), text
    assert yes("Args:\n    a: x\n\nCounts each pending entry once more.", "f")


def test_modules():
    assert D.module_of("a/b.py") == "a.b" and D.module_of("a/__init__.py") == "a" and D.module_of("__init__.py") == "__init__"


def test_operator(spark):
    rows = [
        ("r", "pkg/mod.py", bytearray(PY.encode())), ("r", "pkg/mod.py", bytearray(PY.encode())), ("q", "pkg/mod.py", bytearray(PY.replace("\n", "\r\n").encode())), ("r", "w/k.js", bytearray(JS.encode())), ("r", "broken.py", bytearray(PY.encode() + b"def f(:")),
        ("r", "n.py", None), ("r", None, bytearray(b"x")), ("r", "e.py", bytearray(b"")), ("r", "l.py", bytearray(b"# coding: latin-1\ndef f():\n    '''D\xe9placement des lignes vers autre table.'''\n")), ("r", "u.py", bytearray(b"def f():\n    '''\xff bad bytes in this file here'''\n")),
        ("r", "b.py", bytearray("\ufeffdef f():\n    '''Byte order marks are obeyed by readers.'''\n".encode())), ("r", "c.json", bytearray(b"{}")),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as lang", "2 as qualified_name")
    got = {(r.repository_id, r.path, r.qualified_name) for r in D.pairs(df.drop("lang")).collect()}
    names = ("pkg.mod.above", "pkg.mod.plain", "pkg.mod.C.p", "pkg.mod.C.q")
    assert got == {(x, "pkg/mod.py", q) for x in "rq" for q in names} | {("r", "w/k.js", q) for q in ("a", "b", "K.m", "K.v")} | {("r", "l.py", "l.f"), ("r", "b.py", "b.f")}
    assert D.pairs(df.drop("lang")).count() == len(got)
    assert D.pairs(df.limit(0)).count() == 0


def test_methods_named_by_reserved_words_and_other_tags():
    doc = "  /** Removes one stored entry with all its neighbours. */\n"
    names = ["delete", "catch", "finally", "default", "import", "return", "new", "if"]
    src = "class A {\n" + "".join(f"{doc}  {n}(x) {{ return g(x); }}\n" for n in names) + f"{doc}  static delete(x) {{ if (x) {{}} }}\n{doc}  async *in() {{}}\n{doc}  x = 1\n{doc}  for(y) {{}}\n}}\n"
    got = D.file_pairs("js", "a/b.mjs", src.encode())
    assert [q for q, *_ in got] == [f"A.{n}" for n in (*names, "delete", "in", "for")]
    assert D.says_something("@summary Writes sorted runs to disk.\n@param x all the words of a parameter", "f")
    assert D.says_something("@description\n  Writes sorted runs to\n  disk.", "f")
    assert not D.says_something("@param x Writes sorted runs to disk again.\n@returns {int} how many rows came out", "f")


def test_python_tokens_that_hid_functions():
    doc = '"Walk every frozen list and keep entries."'
    f, m = f"def f():\n    {doc}\n", f"    def f(self):\n        {doc}\n"
    sources = [
        """x = f'{d['(']}'\n""" + f, """x = f"{d["["]}"\n""" + f, "x = f'{a # it's ( [\n}'\n" + f, "x = f'''{a['''(''']}'''\n" + f, """y = f'{f'{f'{a['(']}'}'}'\n""" + f, """def f(a=f'{x['(']}'): """ + doc,
        "x = 1\n\x0c" + f, "class C:\n    \x0c" + m, "def \\\n  f():\n    " + doc, "async \\\n  def f():\n    " + doc, "class \\\n  C:\n" + m, "class C:\n    \\\n" + m.lstrip(), "def f(): \\\n  " + doc,
        "def f() -> lambda: 3:\n    " + doc, "def f() -> lambda: lambda: 3: " + doc, "def f():\n    ( # why\n    " + doc + "\n    # so\n    )\n", "def f():\n    ('Walk every frozen ' # one\n     'list and keep entries.')\n",
        "def ℘():\n    " + doc, "def a·b():\n    " + doc, "class ﬁx:\n    def ﬂow(self):\n        " + doc, "x = 1\n\\\n\n" + f,
    ]
    for s in sources:
        tree = ast.parse(s).body[-1]
        cls, n = (tree.name + ".", tree.body[0]) if isinstance(tree, ast.ClassDef) else ("", tree)
        assert D.python_pairs(s, "") == [(cls + n.name, n.name, ast.get_docstring(n, clean=False))], s
        assert [q for q, *_ in D.file_pairs("python", "a/b.py", s.encode())] == ["a.b." + cls + n.name], s
    assert D.file_pairs("python", "a.py", f"# x\r# y\r# coding: foo\r{f}".replace("\n", "\r").encode()) == [("a.f", "f", doc[1:-1])]
    for b in (b"# \xff\n" + f.encode(), b"# coding: latin-1 \xe9\n" + f.encode(), f.encode() + b"    # \xc3 x\n"):
        assert [q for q, *_ in D.file_pairs("python", "a.py", b)] == ["a.f"], b
    for b in (b"x = '\xff'\n", b"x\0 = 1\n", b"# coding: utf-7\nx = '+2AA-'\n", b"# coding: undefined\n"):
        assert D.file_pairs("python", "a.py", b + f.encode()) == [], b
    for s in ('x = """\n# Walk every frozen list and keep """\ndef f(): pass\n', 'x = """\n""" # Walk every frozen list and keep entries\ndef f(): pass\n', "def f():\n    (" + doc + ",)\n", "def f():\n    (" + doc + ").strip()\n", "def f():\n    " + doc + " + f''\n", f + "x = (\n", "async", f + "  x = 1\n"):
        assert D.python_pairs(s, "") == [], s
