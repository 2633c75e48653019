"""Structured Streaming forms of the event operators (§2.10): windows with late data, duplicates, upserts and job states.

Sources read whatever lies in the directory and stop (``availableNow``), so the same code serves a running stream. State
and offsets live in the shared folder. ``events.ts`` has no zone and is cast, as watermarks need an instant.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.catalog import app_dir
from graphloom.sources.repository import upsert

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
MAX_RETRIES = 3


def event_stream(spark: SparkSession, directory: str, files_per_batch: int = 8) -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _base(spark: SparkSession, base: str | None) -> str:
    return base or f"{app_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


def _run(writer, base: str) -> None:
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def _written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What lies at ``path``, or nothing if no batch came."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and gives what it wrote. What waits for the watermark stays in its state."""
    base = _base(stream.sparkSession, base)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
    _run(writer, base)
    return _written(stream.sparkSession, f"{base}/out", stream.schema)


def run_updates(stream: DataFrame, keys: list[str], base: str | None = None) -> DataFrame:
    """Runs an aggregate in update mode and gives the newest row of each key: windows that are still open come out too.

    A batch writes its rows to a folder of its own, so it can be written again after a failure.
    """
    spark = stream.sparkSession
    base = _base(spark, base)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{base}/log/batch={epoch}")

    _run(stream.writeStream.outputMode("update").foreachBatch(put), base)
    schema = T.StructType([*stream.schema.fields, T.StructField("_epoch", T.LongType())])
    values = [c for c in stream.columns if c not in keys]
    newest = _written(spark, f"{base}/log", schema).groupBy(*keys).agg(F.max_by(F.struct(*values), "_epoch").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in values]).select(*stream.columns)


def run_complete(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Runs an aggregate in complete mode and gives its last state; for session windows, which know no update mode."""
    spark = stream.sparkSession
    base = _base(spark, base)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/now")

    _run(stream.writeStream.outputMode("complete").foreachBatch(put), base)
    return _written(spark, f"{base}/now", stream.schema)


def windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type; a window comes out when the watermark has passed its end."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def without_duplicates(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def job_states(stream: DataFrame) -> DataFrame:
    """A job per user: an error counts as a failed attempt and is tried again until MAX_RETRIES, then the job has FAILED;
    a purchase is a success. One row per change of state."""
    schema = "user_id bigint, event_id bigint, state string, retries int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, retries = state.get if state.exists else ("PENDING", 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event_id, kind in zip(rows["event_id"], rows["event_type"]):
            was = now
            if now in ("SUCCEEDED", "FAILED"):
                now, retries = "PENDING", 0
            if kind == "error":
                retries += 1
                now = "FAILED" if retries >= MAX_RETRIES else "PENDING"
            elif kind == "purchase":
                now = "SUCCEEDED"
            if now != was:
                out.append((key[0], event_id, now, retries))
        state.update((now, retries))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state", "retries"])

    return stream.groupBy("user_id").applyInPandasWithState(step, schema, "state string, retries int", "append", GroupStateTimeout.NoTimeout)


def upsert_latest(stream: DataFrame, base: str | None = None) -> DataFrame:
    """The latest event per user. A batch writes the latest of its own rows, and no others, to a folder of its own; reading
    merges the folders. A run with the same ``base`` goes on where the last one ended, with all earlier rows."""
    spark = stream.sparkSession
    base = _base(spark, base)

    def put(batch: DataFrame, epoch: int) -> None:
        upsert(None, batch, ["user_id"], ["ts", "event_id"]).write.mode("overwrite").parquet(f"{base}/log/batch={epoch}")

    _run(stream.writeStream.foreachBatch(put), base)
    return upsert(None, _written(spark, f"{base}/log", stream.schema), ["user_id"], ["ts", "event_id"])
