"""Source files that do not parse (problem 4).

Method
    1. Every file is lexed once into rows: the classes of its tokens as numbers, its brackets and separators with their
       positions, its statements as normalised shapes. The rows are stored in the shared folder, so the steps below
       don't lex again.
    2. Adjacent token pairs (distinct per file, built in the JVM) are anti-joined against the pairs the grammar permits.
    3. Nesting is validated by windows over the bracket rows: running depth, and per level the bracket before each
       closing one; in JSON also the alternation of ``:`` and ``,`` in objects.
    4. Statement productions: each *different* statement shape of the corpus is tried against the grammar once, and so is
       each different block skeleton of a Python file; files with a shape that fails are found by joining back.
    5. A file that one of these steps flags is invalid; no further check is asked. What shapes cannot keep is which names a
       file binds: files in which names decide (redeclared names, exports, escapes, repeated keys), and those too deep to be
       lexed, are *undecided* unless steps 1 to 3 flag them, and go through the exact check of the whole file. All others are
       valid.

``step_quality`` holds what the steps say against the exact check of every file.

Defined cases: null content or path, and other extensions, are no cases; empty files are valid Python, JavaScript and
TOML but no JSON; repeated rows are rows of their own; files are lexed whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.catalog import materialize, spread
from graphloom.llm import grammar, lexers

LANGUAGES = ("python", "js", "json", "toml")
_WIDE = 1024
#: Files that are held as token lists at a time.
SLICE = 500
#: Up to so many different shapes are broadcast; more of them are joined by a shuffle.
MAX_BAD_SHAPES = 20_000
LEXED = "file_id bigint, lang string, modes int, tokens array<int>, at array<int>, mark array<int>, shapes array<string>, skeleton string, error string, context string"


def _codes(lang: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted({x for p in grammar.permissible(lang) for x in p}), 1)}


_MARKS = {c: i for i, c in enumerate("([{)]}:,", 1)}


def with_language(files: DataFrame) -> DataFrame:
    """Adds ``lang`` by the extension of ``path``, null for other files."""
    ext = F.lower(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1))
    pairs = [F.lit(x) for kv in lexers.EXTENSIONS.items() for x in kv]
    return files.withColumn("lang", F.when(F.col("path").contains("."), F.create_map(*pairs)[ext]))


def _sources(files: DataFrame) -> DataFrame:
    return with_language(files.select("file_id", "path", "content")).where("content is not null and lang is not null")


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(20_000)
    codes = {lang: _codes(lang) for lang in LANGUAGES}
    for pdf in (b.iloc[i : i + SLICE] for b in batches for i in range(0, len(b), SLICE)):
        out = []
        for i, lang, path, content in zip(pdf["file_id"], pdf["lang"], pdf["path"], pdf["content"]):
            x = lexers.lex(lang, bytes(content))
            undecided = x.error in lexers.UNDECIDED
            code = codes[lang]
            marks = [(at, _MARKS[c]) for at, c in x.brackets if lang == "json" or c not in ":,"]
            out.append(
                (i, lang, lexers.file_modes(path), [code.get(c, 0) for c in x.classes], [a for a, _ in marks], [m for _, m in marks], list(dict.fromkeys(x.shapes)), x.skeleton or None, None if undecided else x.error or None, x.error if undecided else x.context or None)
            )
        yield pd.DataFrame(out, columns=["file_id", "lang", "modes", "tokens", "at", "mark", "shapes", "skeleton", "error", "context"])


def lexed(files: DataFrame) -> DataFrame:
    return materialize(spread(_sources(files)).mapInPandas(_lex, LEXED), "lexed")


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """(lang, pair): a few thousand rows that depend on the grammars only."""
    rows = [(lang, c[a] * _WIDE + c[b]) for lang in LANGUAGES for c in [_codes(lang)] for a, b in sorted(grammar.permissible(lang))]
    return spark.createDataFrame(rows, "lang string, pair int")


def bad_pairs(tokens: DataFrame) -> DataFrame:
    """(file_id): files with a token pair that no sentence of their grammar has."""
    n = F.size("tokens") - 1
    pairs = F.zip_with(F.slice("tokens", F.lit(1), n), F.slice("tokens", F.lit(2), n), lambda a, b: a * _WIDE + b)
    rows = tokens.select("file_id", "lang", F.explode(F.array_distinct(pairs)).alias("pair"))
    return rows.join(F.broadcast(permissible_pairs(tokens.sparkSession)), ["lang", "pair"], "left_anti").select("file_id").distinct()


def bad_nesting(tokens: DataFrame) -> DataFrame:
    """(file_id): brackets that don't match, and JSON objects whose separators don't alternate."""
    rows = tokens.select("file_id", "lang", F.posexplode("mark").alias("i", "mark"), "at")
    rows = rows.select("file_id", "lang", "i", "mark", F.col("at")[F.col("i")].alias("at"))
    opens, closes = F.col("mark").between(1, 3), F.col("mark").between(4, 6)
    run = Window.partitionBy("file_id").orderBy("i")
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(run))
    rows = rows.withColumn("level", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth")))
    level = Window.partitionBy("file_id", "level").orderBy("i")
    rows = (
        rows.withColumn("opener", F.last(F.when(opens, F.col("mark")), True).over(level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("before", F.lag("mark").over(level))
        .withColumn("before_at", F.lag("at").over(level))
    )
    colon, comma, brace = F.lit(_MARKS[":"]), F.lit(_MARKS[","]), F.lit(_MARKS["{"])
    wrong = (F.col("depth") < 0) | closes & (F.coalesce("opener", F.lit(0)) + 3 != F.col("mark"))
    json = F.col("lang") == "json"
    wrong |= json & (F.col("mark") == colon) & ((F.coalesce("opener", F.lit(0)) != brace) | ~F.col("before").isin(_MARKS["{"], _MARKS[","]))
    wrong |= json & (F.col("mark") == comma) & (F.col("opener") == brace) & (F.col("before") != colon)
    wrong |= json & (F.col("mark") == _MARKS["}"]) & ~((F.col("before") == colon) | (F.col("before") == brace) & (F.col("at") - F.col("before_at") == 1))
    per_file = rows.groupBy("file_id").agg(F.max(F.coalesce(wrong, F.lit(False)).cast("int")).alias("wrong"), F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).alias("left"))
    return per_file.where("wrong = 1 or left <> 0").select("file_id")


def _try_shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shapes that don't stand in every reading, with those in which they do."""
    sys.setrecursionlimit(20_000)
    for pdf in batches:
        fit = [3 * (lexers.python_error(s) is None) if kind == "skeleton" else lexers.shape_modes(lang, s) for lang, kind, s in zip(pdf["lang"], pdf["kind"], pdf["shape"])]
        out = pdf[["lang", "kind", "shape"]].assign(fit=fit)
        yield out[out["fit"] != 3]


def bad_productions(tokens: DataFrame) -> DataFrame:
    """(file_id): files with a statement, or a block structure, that no production yields, or whose statements no one
    reading (module or function) has all of. Each shape is tried once."""
    shapes = tokens.select("file_id", "modes", "lang", F.lit("statement").alias("kind"), F.explode("shapes").alias("shape")).unionByName(
        tokens.where("skeleton is not null").select("file_id", "modes", "lang", F.lit("skeleton").alias("kind"), F.col("skeleton").alias("shape"))
    )
    tried = shapes.select("lang", "kind", "shape").distinct().mapInPandas(_try_shapes, "lang string, kind string, shape string, fit int")
    bad = materialize(tried, "bad-shapes")
    bad = F.broadcast(bad) if bad.count() <= MAX_BAD_SHAPES else bad
    per_file = shapes.join(bad, ["lang", "kind", "shape"]).groupBy("file_id").agg(F.bit_and(F.col("fit").bitwiseAND(F.col("modes"))).alias("fit"))
    return per_file.where("fit = 0").select("file_id")


def flagged(tokens: DataFrame) -> DataFrame:
    """(file_id, reasons): what the steps say, by step."""
    parts = [
        tokens.where("error is not null").select("file_id", F.lit("lexing").alias("reason")),
        bad_pairs(tokens).withColumn("reason", F.lit("pair")),
        bad_nesting(tokens).withColumn("reason", F.lit("nesting")),
        bad_productions(tokens).withColumn("reason", F.lit("production")),
        tokens.where("lang = 'json' and size(tokens) <= 2 and context is null").select("file_id", F.lit("pair").alias("reason")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(20_000)
    for pdf in batches:
        why = [lexers.file_error(lang, path, bytes(c)) for lang, path, c in zip(pdf["lang"], pdf["path"], pdf["content"])]
        out = pdf[["file_id", "lang"]].assign(error=why)
        yield out[out["error"].notna()]


CONFIRMED = "file_id bigint, lang string, error string"


def judged(files: DataFrame) -> DataFrame:
    """(file_id, lang, reasons, undecided) of the files that a step flags, or that the steps leave undecided."""
    tokens = lexed(files)
    marks = tokens.where("context is not null").select("file_id", F.col("context").alias("undecided"))
    got = flagged(tokens).join(marks, "file_id", "full_outer")
    only_shapes = F.col("undecided").isNotNull() & (F.col("reasons") == F.array(F.lit("production")))
    got = got.withColumn("reasons", F.when(~F.coalesce(only_shapes, F.lit(False)), F.col("reasons")))
    return materialize(got.join(tokens.select("file_id", "lang"), "file_id"), "judged-files")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, lang, error, reasons) of the files that are not valid in the language of their path."""
    got = judged(files)
    certain = got.where("reasons is not null").select("file_id", "lang", F.array_join("reasons", "+").alias("error"), "reasons")
    open_ = got.where("reasons is null").select("file_id")
    exact = _sources(files).join(open_, "file_id", "left_semi").mapInPandas(_confirm, CONFIRMED)
    return certain.unionByName(exact.withColumn("reasons", F.array(F.lit("names"))))


def step_quality(files: DataFrame) -> DataFrame:
    """(lang, n_files, n_invalid, n_flagged, n_right, n_undecided, n_missed): the steps against the exact check of every file.

    ``n_right`` of ``n_flagged`` is the precision of the steps and ``n_right`` of ``n_invalid`` their recall; ``n_missed``
    are invalid files that are neither flagged nor undecided.
    """
    everything = _sources(files).select("file_id", "lang")
    got = judged(files).drop("lang").withColumn("flagged", F.col("reasons").isNotNull())
    bad = spread(_sources(files)).mapInPandas(_confirm, CONFIRMED).select("file_id", F.lit(True).alias("bad"))
    j = everything.join(got, "file_id", "left").join(bad, "file_id", "left")
    flag, wrong = F.coalesce("flagged", F.lit(False)), F.coalesce("bad", F.lit(False))
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(wrong).alias("n_invalid"), F.count_if(flag).alias("n_flagged"), F.count_if(flag & wrong).alias("n_right"),
        F.count_if(~flag & F.col("undecided").isNotNull()).alias("n_undecided"), F.count_if(wrong & ~flag & F.col("undecided").isNull()).alias("n_missed"),
    )


def rates(files: DataFrame, invalid: DataFrame) -> DataFrame:
    """(repository_id, lang, n_files, n_invalid, rate) over the files with content."""
    keyed = with_language(files.select("file_id", "repository_id", "path", "content")).where("content is not null and lang is not null")
    marked = keyed.drop("content").join(invalid.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    return marked.groupBy("repository_id", "lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_invalid")
    ).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
