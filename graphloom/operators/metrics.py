"""Retrieval quality, latency and rate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import materialize

Z = 1.96


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: recall@k for each k and the reciprocal rank of the first relevant entity.

    ranked: (qid, entity, rank); relevant: (qid, n_relevant) with the number of relevant entities, and ``ranked`` has a
    boolean ``hit``. Queries without results count as 0.
    """
    hits = ranked.where("hit").groupBy("qid").agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("bigint")).alias(f"h{k}") for k in ks])
    j = relevant.join(hits, "qid", "left")
    n = F.greatest(F.col("n_relevant"), F.lit(1))
    return j.select("qid", *[(F.coalesce(f"h{k}", F.lit(0)) / n).alias(f"recall_{k}") for k in ks], F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k successes in n trials, clamped to [0, 1]; zeros for n = 0."""
    n_ = n.cast("double")
    p = F.try_divide(k.cast("double"), n_)
    z2 = Z * Z
    mid = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0)))
    return low, F.when(n == 0, 0.0).otherwise(F.least(mid + half, F.lit(1.0)))


def rounded_index_percentile(values: Column, p: float) -> Column:
    """The element at index round-half-even(p * (n - 1)) of the sorted values."""
    return F.element_at(F.array_sort(values), F.bround(F.lit(p) * (F.size(values) - 1), 0).cast("int") + 1)


def rates(rows: DataFrame, parts: dict, values: dict | None = None) -> DataFrame:
    """One row of rates: ``name: (condition, among, default)`` is the share of rows among ``among`` (all if None) that fulfil the
    condition, or the default where there are none; ``values`` are aggregates of their own. All in one pass."""
    out = []
    for name, (cond, among, default) in parts.items():
        base = F.count(F.lit(1)) if among is None else F.count_if(among)
        hit = F.count_if(cond if among is None else cond & among)
        out.append(F.round(F.coalesce(F.try_divide(hit.cast("double"), base.cast("double")), F.lit(default)), 6).alias(name))
    for name, v in (values or {}).items():
        out.append((v if name.startswith(("max", "median")) else F.round(v, 6)).alias(name))
    return rows.agg(*out)


def path_quality(starts: DataFrame, got: DataFrame, want: DataFrame) -> DataFrame:
    """(repository_id, start, path_recall, path_precision): nodes on returned paths (repeats count for precision) against wanted ones."""
    k = ["repository_id", "start"]
    a = want.join(got.distinct().withColumn("hit", F.lit(1)), [*k, "id"], "left").groupBy(*k).agg(F.count(F.lit(1)).alias("n_want"), F.count("hit").alias("n_hit"))
    b = got.join(want.withColumn("right", F.lit(1)), [*k, "id"], "left").groupBy(*k).agg(F.count(F.lit(1)).alias("n_got"), F.count("right").alias("n_right"))
    j = starts.join(a, k, "left").join(b, k, "left")
    recall = F.when(F.col("n_want").isNull(), 1.0).when(F.col("n_got").isNull(), 0.0).otherwise(F.col("n_hit") / F.col("n_want"))
    precision = F.when(F.col("n_got").isNull(), F.when(F.col("n_want").isNull(), 1.0).otherwise(0.0)).otherwise(F.col("n_right") / F.col("n_got"))
    return j.select(*k, F.round(recall, 6).alias("path_recall"), F.round(precision, 6).alias("path_precision"))


def ranked_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, c, upto): each different value, how often it comes, and how many rows of its key are not above it.

    Values are counted, ranged over partitions by (key, value), summed inside each partition, and the sums of the partitions
    before it are added: no key is sorted in one task, however many values it has.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    ranged = materialize(counts.repartitionByRange(key, value).withColumn("pid", F.spark_partition_id()), "ranged-values")
    totals = ranged.groupBy("pid", key).agg(F.sum("c").alias("t"))
    before = totals.select("pid", key, (F.sum("t").over(Window.partitionBy(key).orderBy("pid")) - F.col("t")).alias("before"))
    local = F.sum("c").over(Window.partitionBy("pid", key).orderBy(value))
    return ranged.withColumn("local", local).join(before, ["pid", key]).select(key, value, "c", (F.col("local") + F.col("before")).alias("upto"))


def percentiles(rows: DataFrame, key: str, value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, one column per wanted percentile): name to (kind, p) with kind disc (nearest rank), cont (interpolated) or index
    (the element at round-half-even of p * (n - 1))."""
    r = materialize(ranked_values(rows, key, value), "ranked-values")
    n = r.groupBy(key).agg(F.sum("c").alias("n"))
    at = {}
    for name, (kind, p) in wanted.items():
        last = F.col("n") - 1
        if kind == "disc":
            at[name] = [(F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1, F.lit(1.0))]
        elif kind == "index":
            at[name] = [(F.bround(F.lit(p) * last, 0), F.lit(1.0))]
        else:
            low = F.floor(F.lit(p) * last)
            part = F.lit(p) * last - low
            at[name] = [(low, 1 - part), (F.least(low + 1, last), part)]
    picks = [F.struct(F.lit(name).alias("name"), i.cast("bigint").alias("i"), w.alias("w")) for name, xs in at.items() for i, w in xs]
    asked = n.select(key, F.explode(F.array(*picks)).alias("x")).select(key, "x.name", "x.i", "x.w")
    hit = r.join(asked, key).where((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("c")))
    return hit.groupBy(key).agg(*[F.sum(F.when(F.col("name") == name, F.col(value) * F.col("w"))).alias(name) for name in wanted])


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.95) -> DataFrame:
    """(metric, verdict) of the metrics in both tables (metric, value): a latency may grow by half, any other metric may fall to
    ``tolerance`` of its baseline; better ones are improvements, the rest is unchanged."""
    j = now.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("was")), "metric")
    late = F.lower("metric").contains("latency")
    bad = F.when(late, F.col("now") > F.col("was") * 1.5).otherwise(F.col("now") < F.col("was") * tolerance)
    good = F.when(late, F.col("now") < F.col("was")).otherwise(F.col("now") > F.col("was"))
    return j.select("metric", F.when(bad, "REGRESSION").when(good, "IMPROVEMENT").otherwise("UNCHANGED").alias("verdict"))
