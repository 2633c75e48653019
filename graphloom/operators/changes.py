"""Operators over patches, branches, test output and work trees."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions import text as X

#: Endings of files that no patch may touch (fixed values).
FORBIDDEN_TYPES = (".exe", ".dll", ".so", ".dylib", ".pyc", ".pyd", ".db", ".sqlite", ".bin", ".tar", ".gz", ".zip")
MAX_FILES, MAX_LINES = 5, 300


def diff_problem(path: Column, planned: Column) -> Column:
    """Why a changed file speaks against its patch, or null."""
    low = F.lower(path)
    kind = F.lit(False)
    for e in FORBIDDEN_TYPES:
        kind = kind | low.endswith(e)
    return F.when(kind, "forbidden type").when(rules.has_any(low, rules.SENSITIVE), "sensitive file").when(~planned, "scope drift")


def branch_name(category: Column, short_id: Column, prefix: str) -> Column:
    """``prefix/category/id`` in safe characters; a name that is still no good becomes a hash."""
    clean = lambda c, default: F.coalesce(F.nullif(F.regexp_replace(F.trim(F.lower(c)), "[^a-zA-Z0-9_-]", "-"), F.lit("")), F.lit(default))
    raw = F.concat(F.lit(f"{prefix}/"), clean(category, "fix"), F.lit("/"), clean(short_id, "patch"))
    hashed = F.concat(F.lit(f"{prefix}/fix/patch-"), F.substring(F.sha2(F.concat_ws(":", category, short_id), 256), 1, 8))
    return F.when(rules.branch_problem(raw).isNull(), raw).otherwise(hashed)


def failed_jobs(runs: DataFrame, key: str) -> DataFrame:
    """(key, test_name, error_type) per failed job; runs: (key, conclusion, jobs, detail)."""
    bad = runs.where(F.col("conclusion").isin("failure", "timed_out", "cancelled"))
    kind = F.when(F.coalesce("detail", F.lit("")).contains("Assertion"), "AssertionError").otherwise("CIBuildError")
    return bad.select(key, F.explode("jobs").alias("test_name"), kind.alias("error_type"))


def summary_counts(outputs: DataFrame, column: str) -> DataFrame:
    """``outputs`` with counts passed, failed, error and skipped of the last line that is a summary; null where none is."""
    one = r"(\d+)\s+(passed|failed|error|errors|skipped)"
    hits = F.filter(X.lines(F.col(column)), lambda x: x.rlike(one))
    last = F.when(F.size(hits) > 0, F.element_at(hits, -1))
    words = F.regexp_extract_all(last, F.lit(one), F.lit(2))
    numbers = F.regexp_extract_all(last, F.lit(one), F.lit(1))
    pairs = F.arrays_zip(words.alias("w"), numbers.alias("n"))
    out = outputs.withColumn("_pairs", pairs)
    for label in ("passed", "failed", "error", "skipped"):
        got = F.filter("_pairs", lambda p: F.regexp_replace(p["w"], "^errors$", "error") == label)  # noqa: B023
        out = out.withColumn(label, F.when(F.size(got) > 0, F.aggregate(got, F.lit(0).cast("bigint"), lambda a, p: a + p["n"].cast("bigint"))))
    return out.drop("_pairs")


def status_counts(lines: DataFrame, key: str) -> DataFrame:
    """(key, n_staged, n_modified, n_untracked) of porcelain status lines; shorter lines than three characters say nothing."""
    a, b = F.substring("line", 1, 1), F.substring("line", 2, 1)
    return lines.where("length(line) >= 3").groupBy(key).agg(
        F.count_if(a.isin("M", "A", "R")).alias("n_staged"), F.count_if(b == "M").alias("n_modified"), F.count_if((a == "?") & (b == "?")).alias("n_untracked")
    )


def in_workspace(path: Column, size: Column) -> Column:
    """Whether a file is copied to a workspace: not below dependency or build folders, no byte code, not too large."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip = F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in rules.IGNORED_DIRS])) | F.exists(dirs, lambda p: p.endswith(".egg-info"))
    return ~(skip | path.endswith(".pyc") | path.endswith(".pyo") | (F.coalesce(size, F.lit(0)) > rules.MAX_FILE_BYTES))


def unified_diff(changes: DataFrame) -> DataFrame:
    """(change_id, patch_id, file_path, diff, added, removed): the unified diff of each change. Null contents count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, p, path, a, b in zip(pdf["change_id"], pdf["patch_id"], pdf["file_path"], pdf["old_content"], pdf["new_content"]):
                lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{path}", f"b/{path}", lineterm=""))
                body = lines[2:]
                out.append((i, p, path, "\n".join(lines), sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)))
            yield pd.DataFrame(out, columns=["change_id", "patch_id", "file_path", "diff", "added", "removed"])

    take = changes.select("change_id", "patch_id", "file_path", "old_content", "new_content")
    return take.mapInPandas(run, "change_id bigint, patch_id bigint, file_path string, diff string, added bigint, removed bigint")


def patch_totals(changes: DataFrame) -> DataFrame:
    """(patch_id, n_files, added, removed, in_bounds) over the diffs of a patch's changes."""
    g = unified_diff(changes).groupBy("patch_id").agg(F.countDistinct("file_path").alias("n_files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return g.withColumn("in_bounds", (F.col("n_files") <= MAX_FILES) & (F.col("added") + F.col("removed") <= MAX_LINES))
