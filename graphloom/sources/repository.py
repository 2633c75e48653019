"""Sources and sinks: a data source that scans source trees, upserts into parquet tables, and a JSON document store
(S1, S2, S6, S7, S9, S11, S16, S17, S27).

Spark's own binary file source leaves out names that begin with ``_`` or ``.``, and with them every ``__init__.py``; hence
a source of its own. Its partitions are sets of directories, so a large tree is read by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directory names that are never entered (fixed values).
IGNORED = (".git", ".hg", ".venv", "venv", "__pycache__", ".pytest_cache", "node_modules", ".tox", ".mypy_cache", "build", "dist")
SCHEMA = "repository_id string, path string, content binary, size_bytes bigint, error string"


class _Directories(InputPartition):
    def __init__(self, directories: list[str]) -> None:
        super().__init__(directories)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options.get("path", ""))
        if not os.path.isdir(self.root):
            raise ValueError(f"no such directory: {self.root}")
        self.extensions = tuple(x.strip() for x in options.get("extensions", ".py").split(",") if x.strip())
        self.ignored = frozenset(x.strip() for x in options.get("ignoredirs", ",".join(IGNORED)).split(",") if x.strip())
        self.per_task = int(options.get("directoriespertask", "64"))
        self.repository_id = options.get("repositoryid") or "repository:" + os.path.basename(self.root).lower()

    def partitions(self) -> list[InputPartition]:
        dirs = []
        for here, inner, _ in os.walk(self.root):
            inner[:] = sorted(d for d in inner if d not in self.ignored)
            dirs.append(here)
        return [_Directories(dirs[i : i + self.per_task]) for i in range(0, len(dirs), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for here in partition.value:
            for name in sorted(os.listdir(here)):
                full = os.path.join(here, name)
                if not name.endswith(self.extensions) or not os.path.isfile(full):
                    continue
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                    yield self.repository_id, path, data, len(data), None
                except OSError as e:
                    yield self.repository_id, path, None, None, f"{type(e).__name__}: {e.strerror}"


class RepositorySource(DataSource):
    """``spark.read.format("source_tree").load(root)``; options extensions, ignoreDirs, repositoryId, directoriesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})


def scan_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("source_tree").options(**options).load(root)


def failed_files(files: DataFrame, invalid: DataFrame) -> DataFrame:
    """Distinct paths that could not be read or don't parse."""
    unread = files.where("error is not null").select("repository_id", "path")
    return unread.unionByName(invalid.select("repository_id", "path")).distinct()


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several rows of a key the last by ``order`` wins.

    One aggregate over the union, which combines on the map side; the caller writes the result as a new version.
    """
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def incremental_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(repository_id, path, change) by hash: new, changed, unchanged or deleted."""
    c = current.select("repository_id", "path", F.col("sha256").alias("a"))
    s = stored.select("repository_id", "path", F.col("sha256").alias("b"))
    j = c.join(s, ["repository_id", "path"], "full_outer")
    return j.select(
        "repository_id", "path",
        F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"),
    )


class DocumentStore:
    """Append-only JSON documents with an explicit schema; corrupt ones are skipped on reading, the last per id is valid."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str) -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    def save(self, docs: DataFrame) -> None:
        docs.write.mode("append").json(self.path)

    def all(self) -> DataFrame:
        raw = self.spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path).where(F.col(self.key).isNotNull())
        w = Window.partitionBy(self.key).orderBy(F.desc(self.order))
        return raw.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")

    def get(self, key) -> DataFrame:
        return self.all().where(F.col(self.key) == key)
