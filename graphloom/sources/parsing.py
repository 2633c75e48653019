"""Python files to entity rows, and the joins that resolve what they name.

One pass over each file's syntax tree yields all rows: imports, classes, functions, methods, base classes and calls. The
rows are tables; resolution is one equi-join on candidate qualified names with a priority, whatever the number of rules.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from graphloom.functions import ids

ROW = "kind string, class_name string, name string, expr string, alias string, level int, is_async boolean, returns string, docstring string, params array<struct<name:string,annotation:string,default:string,kind:string>>, start_line int, start_column int, end_line int, end_column int"
_NAMES = [c.split()[0] for c in ROW.replace("array<struct<name:string,annotation:string,default:string,kind:string>>", "x").split(", ")]


def _text(node: ast.AST | None) -> str | None:
    return ast.unparse(node) if node is not None else None


def _span(n: ast.AST) -> tuple[int, int, int, int]:
    """0-based lines; columns are byte offsets, as the tree has them."""
    return n.lineno - 1, n.col_offset, n.end_lineno - 1, n.end_col_offset


def parameters(a: ast.arguments) -> list[tuple]:
    plain = [(p, "POSITIONAL_ONLY") for p in a.posonlyargs] + [(p, "POSITIONAL_OR_KEYWORD") for p in a.args]
    given = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [(p.arg, _text(p.annotation), _text(d), k) for (p, k), d in zip(plain, given)]
    if a.vararg:
        out.append(("*" + a.vararg.arg, _text(a.vararg.annotation), None, "VAR_POSITIONAL"))
    out += [(p.arg, _text(p.annotation), _text(d), "KEYWORD_ONLY") for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append(("**" + a.kwarg.arg, _text(a.kwarg.annotation), None, "VAR_KEYWORD"))
    return out


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of one file; a file that doesn't parse gives one row of kind ``error``."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line, col = getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1
        yield ("error", None, None, f"Syntax error at line {line}, column {col}: {e.args[0] if e.args else ''}", *[None] * 6, line - 1, col - 1, line - 1, col - 1)
        return
    yield from _body(tree.body)


def _body(body: list[ast.stmt]) -> Iterator[tuple]:
    for n in body:
        if isinstance(n, ast.Import):
            for a in n.names:
                yield ("import", None, "", a.name, a.asname, 0, None, None, None, None, *_span(n))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                yield ("import", None, a.name, n.module, a.asname, n.level, None, None, None, None, *_span(n))
        elif isinstance(n, ast.ClassDef):
            yield ("class", None, n.name, None, None, None, None, None, _doc(n), None, *_span(n))
            for b in (*n.bases, *n.keywords):
                yield ("base", n.name, None, _text(b.value) if isinstance(b, ast.keyword) else _text(b), b.arg if isinstance(b, ast.keyword) else None, None, None, None, None, None, *_span(b))
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield from _function(m, n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _function(n, None)
        elif isinstance(n, (ast.If, ast.Try, ast.With)):
            yield from _body(n.body)


def _doc(n) -> str | None:
    d = ast.get_docstring(n, clean=False)
    return d.strip() if d is not None else None


def _function(n, owner: str | None) -> Iterator[tuple]:
    yield ("method" if owner else "function", owner, n.name, None, None, None, isinstance(n, ast.AsyncFunctionDef), _text(n.returns), _doc(n), parameters(n.args), *_span(n))
    for c in ast.walk(n):
        if isinstance(c, ast.Call):
            f = c.func
            parts = []
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            called = ".".join([f.id, *reversed(parts)]) if isinstance(f, ast.Name) else _text(c.func)
            if called:
                yield ("call", owner, n.name, called, None, None, None, None, None, None, *_span(c))


#: Up to so many repeated deliveries are broadcast.
MAX_REPEATS = 1_000_000


def once_delivered(files: DataFrame) -> DataFrame:
    """``files`` without repeated deliveries of the same content. Contents stay where they are: digests are compared, and only
    the ids of the repeats go round."""
    if "file_id" not in files.columns:
        return files.distinct()
    digest = F.sha2("content", 256)
    g = files.select("repository_id", "path", digest.alias("h"), "file_id").groupBy("repository_id", "path", "h").agg(F.collect_set("file_id").alias("ids")).where("size(ids) > 1")
    repeats = g.select(F.explode(F.array_except("ids", F.array(F.array_min("ids")))).alias("file_id"))
    return files.join(F.broadcast(repeats) if repeats.count() <= MAX_REPEATS else repeats, "file_id", "left_anti")


def parsed(files: DataFrame) -> DataFrame:
    """(repository_id, path, module_name, …row): one Arrow pass over (repository_id, path, content) of Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, content in zip(pdf["repository_id"], pdf["path"], pdf["content"]):
                for r in parse(bytes(content)):
                    params = r[9] and [dict(zip(("name", "annotation", "default", "kind"), p)) for p in r[9]]
                    rows.append((repo, path, *r[:9], params, *r[10:]))
            yield pd.DataFrame(rows, columns=["repository_id", "path", *_NAMES])

    take = once_delivered(files.where("content is not null and path like '%.py'")).select("repository_id", "path", "content")
    return take.mapInPandas(run, f"repository_id string, path string, {ROW}").withColumn("module_name", ids.module_name(F.col("path")))


def register(spark: SparkSession) -> None:
    """Makes ``parse_python(content)`` callable in SQL: ``SELECT … FROM files, LATERAL parse_python(content)``."""

    class ParsePython:
        def eval(self, content: bytes):
            if content is not None:
                for r in parse(bytes(content)):
                    yield r

    spark.udtf.register("parse_python", udtf(ParsePython, returnType=ROW))


def definitions(rows: DataFrame) -> DataFrame:
    """(repository_id, kind, qname, id, short): what names can resolve to; the last file by path wins for a repeated name."""
    q = ids.qualified_name(F.col("module_name"), F.concat_ws(".", "class_name", "name"))
    ident = (
        F.when(F.col("kind") == "method", F.concat_ws(":", F.lit("method"), "module_name", "class_name", "name")).otherwise(F.concat_ws(":", "kind", "module_name", "name"))
    )
    d = rows.where("kind in ('class', 'function', 'method')").select("repository_id", "kind", q.alias("qname"), ident.alias("id"), F.col("name").alias("short"), "path")
    return d.groupBy("repository_id", "kind", "qname").agg(F.max_by("id", "path").alias("id"), F.max("short").alias("short"))


def bindings(rows: DataFrame) -> DataFrame:
    """(repository_id, path, symbol, bound): what an import binds a name to; the last import of a name wins."""
    parts = F.split("module_name", r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    target = F.when(F.col("level") == 0, F.col("expr")).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.col("expr")))
    sym = F.coalesce("alias", F.nullif("name", F.lit("")), F.col("expr"))
    bound = F.when(F.col("name").isin("", "*"), target).otherwise(F.concat_ws(".", target, "name"))
    i = rows.where("kind = 'import'").select("repository_id", "path", sym.alias("symbol"), bound.alias("bound"), F.struct("start_line", "start_column", "name").alias("o"))
    return i.groupBy("repository_id", "path", "symbol").agg(F.max_by("bound", "o").alias("bound"))


def _resolve(uses: DataFrame, candidates: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """Each use with the definition of least priority among its candidates (use, prio, kind, qname), or null."""
    hit = candidates.join(defs, ["repository_id", "kind", "qname"]).groupBy("repository_id", key).agg(F.min(F.struct("prio", "id")).alias("best"))
    return uses.join(hit, ["repository_id", key], "left").withColumn("target_id", F.col("best.id")).withColumn("rule", F.col("best.prio")).drop("best")


def _unique_short(defs: DataFrame, kind: str) -> DataFrame:
    """Definitions by their short name, the greatest qualified name standing for all (last writer wins)."""
    return defs.where(F.col("kind") == kind).groupBy("repository_id", "short").agg(F.max("qname").alias("qname")).withColumn("kind", F.lit(kind))


def resolve_calls(rows: DataFrame) -> DataFrame:
    """(repository_id, caller, expr, target_id, rule) per distinct call; target null if nothing matches.

    Rules in order: 1 self.m in the own class, 2 function of the own module, 3 imported object's function or method,
    4 method of a class of the own module, 5 imported symbol as function or class, 6 function or class of that name anywhere.
    """
    defs = definitions(rows)
    caller = F.when(F.col("class_name").isNotNull(), F.concat_ws(":", F.lit("method"), "module_name", "class_name", "name")).otherwise(F.concat_ws(":", F.lit("function"), "module_name", "name"))
    calls = rows.where("kind = 'call'").select("repository_id", "path", "module_name", "class_name", caller.alias("caller"), "expr").distinct()
    calls = calls.withColumn("use", F.xxhash64("repository_id", "path", "caller", "expr"))
    head, tail = F.substring_index("expr", ".", 1), F.when(F.col("expr").contains("."), F.expr("substring(expr, length(substring_index(expr, '.', 1)) + 2)"))
    c = calls.withColumn("head", head).withColumn("tail", tail)
    c = c.join(bindings(rows).withColumnRenamed("symbol", "head"), ["repository_id", "path", "head"], "left")
    q = lambda *p: F.concat_ws(".", *p)
    cand = F.array(
        F.struct(F.lit(1).alias("prio"), F.lit("method").alias("kind"), F.when((F.col("head") == "self") & F.col("tail").isNotNull(), q("module_name", "class_name", "tail")).alias("qname")),
        F.struct(F.lit(2).alias("prio"), F.lit("function").alias("kind"), F.when(F.col("tail").isNull(), q("module_name", "head")).alias("qname")),
        F.struct(F.lit(3).alias("prio"), F.lit("function").alias("kind"), F.when(F.col("tail").isNotNull() & F.col("bound").isNotNull(), q("bound", "tail")).alias("qname")),
        F.struct(F.lit(3).alias("prio"), F.lit("method").alias("kind"), F.when(F.col("tail").isNotNull() & F.col("bound").isNotNull(), q("bound", "tail")).alias("qname")),
        F.struct(F.lit(4).alias("prio"), F.lit("method").alias("kind"), F.when(F.col("tail").isNotNull(), q("module_name", "head", "tail")).alias("qname")),
        F.struct(F.lit(5).alias("prio"), F.lit("function").alias("kind"), F.when(F.col("tail").isNull(), F.col("bound")).alias("qname")),
        F.struct(F.lit(6).alias("prio"), F.lit("class").alias("kind"), F.when(F.col("tail").isNull(), F.col("bound")).alias("qname")),
        F.struct(F.lit(7).alias("prio"), F.lit("class").alias("kind"), F.when(F.col("tail").isNull(), q("module_name", "head")).alias("qname")),
    )
    named = c.select("repository_id", "use", F.explode(cand).alias("c")).select("repository_id", "use", "c.prio", "c.kind", "c.qname").where("qname is not null")
    bare = c.where("tail is null").select("repository_id", "use", F.col("head").alias("short"))
    for prio, kind in ((8, "function"), (9, "class")):
        named = named.unionByName(bare.join(_unique_short(defs, kind), ["repository_id", "short"]).select("repository_id", "use", F.lit(prio).alias("prio"), "kind", "qname"))
    return _resolve(calls, named, defs, "use").select("repository_id", "caller", "expr", "target_id", "rule")


def resolve_bases(rows: DataFrame) -> DataFrame:
    """(repository_id, class_id, expr, target_id, rule): own module first, then imports, then any class of that name."""
    defs = definitions(rows).where("kind = 'class'")
    b = rows.where("kind = 'base'").select("repository_id", "path", "module_name", F.concat_ws(":", F.lit("class"), "module_name", "class_name").alias("class_id"), "expr").distinct()
    b = b.withColumn("use", F.xxhash64("repository_id", "path", "class_id", "expr")).withColumn("head", F.substring_index("expr", ".", 1))
    b = b.withColumn("tail", F.expr("substring(expr, length(substring_index(expr, '.', 1)) + 2)"))
    j = b.join(bindings(rows).withColumnRenamed("symbol", "head"), ["repository_id", "path", "head"], "left")
    bound = F.concat_ws(".", "bound", F.nullif("tail", F.lit("")))
    cand = F.array(
        F.struct(F.lit(1).alias("prio"), F.concat_ws(".", "module_name", "expr").alias("qname")), F.struct(F.lit(2).alias("prio"), F.when(F.col("bound").isNotNull(), bound).alias("qname")),
        F.struct(F.lit(3).alias("prio"), F.col("expr").alias("qname")),
    )
    named = j.select("repository_id", "use", F.explode(cand).alias("c")).select("repository_id", "use", "c.prio", F.lit("class").alias("kind"), "c.qname").where("qname is not null")
    short = b.select("repository_id", "use", F.col("expr").alias("short")).join(_unique_short(defs, "class"), ["repository_id", "short"]).select("repository_id", "use", F.lit(4).alias("prio"), "kind", "qname")
    return _resolve(b, named.unionByName(short), defs, "use").select("repository_id", "class_id", "expr", "target_id", "rule")


def resolution_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count("target_id").alias("n_resolved"))


def chunks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Code chunks of classes, functions and methods: (repository_id, id, qualified_name, source_code, span). The first
    definition of an id wins; spans are cut from the file's lines."""
    from graphloom.functions import text as X

    d = rows.where("kind in ('class', 'function', 'method')")
    ident = F.when(F.col("kind") == "method", F.concat_ws(":", F.lit("method"), "module_name", "class_name", "name")).otherwise(F.concat_ws(":", "kind", "module_name", "name"))
    w = Window.partitionBy("repository_id", "id").orderBy("path", "start_line")
    d = d.withColumn("id", ident).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    src = files.where("content is not null").groupBy("repository_id", "path").agg((F.min_by("content", "file_id") if "file_id" in files.columns else F.min("content")).alias("content")).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    j = d.join(src, ["repository_id", "path"])
    return j.select("repository_id", "id", ids.qualified_name(F.col("module_name"), F.concat_ws(".", "class_name", "name")).alias("qualified_name"), X.line_slice(F.col("text"), F.col("start_line"), F.col("end_line")).alias("source_code"), "start_line", "end_line")
