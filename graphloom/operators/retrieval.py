"""Vector search, rank fusion, seeds and evidence packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
QUERY_BLOCK = 2048
#: Vectors of a part: one matrix of so many rows is held by a task.
PART_VECTORS = 100_000


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Exact top-k by cosine: queries (qid, qvec[, scope]) against all vectors (vid, vec[, scope]), in blocks.

    (qid, vid, score, rank). Queries form blocks of ``QUERY_BLOCK``; vectors are dealt out to as many parts as their number
    asks for (``PART_VECTORS`` each), so a part stays as large however many there are. Each (block, part) is one matrix
    product that hands on its k best per query, so what is shuffled afterwards is k * parts rows per query. Scores are max(0,
    cosine) rounded to 6 digits; ties go to the smaller id. With ``scope`` a query sees only vectors of its own scope. A zero
    or null vector scores 0.
    """
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-vectors.count() // PART_VECTORS))
    parts = max(parts, min(queries.sparkSession.sparkContext.defaultParallelism, 8))
    s = [scope] if scope else []
    q = queries.select("qid", "qvec", *[F.col(x).alias("qs") for x in s]).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    v = vectors.select("vid", "vec", *[F.col(x).alias("vs") for x in s]).withColumn("part", F.pmod(F.xxhash64("vid"), F.lit(parts)).cast("int"))
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "vid": [], "score": []})
        b = b.sort_values("vid")
        dim = max((len(x) for x in (*a["qvec"], *b["vec"]) if x is not None), default=1)
        qm, vm = (np.stack([np.zeros(dim) if x is None or len(x) != dim else np.asarray(x, float) for x in c]) for c in (a["qvec"], b["vec"]))
        qm, vm = (m / np.where((d := np.linalg.norm(m, axis=1, keepdims=True)) > 0, d, 1) for m in (qm, vm))
        ids, m = b["vid"].to_numpy(), len(b)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, 8_000_000 // m)
        for lo in range(0, len(a), step):
            sim = np.round(np.maximum(qm[lo : lo + step] @ vm.T, 0), 6)
            # One number orders by score, then by the smaller id.
            order = np.round(sim * 1e6).astype(np.int64) * m + np.arange(m - 1, -1, -1)
            if s:
                order[a["qs"].to_numpy()[lo : lo + step, None] != b["vs"].to_numpy()[None, :]] = -1
            top = np.argpartition(-order, min(k, m) - 1, axis=1)[:, :k] if m > k else np.tile(np.arange(m), (len(sim), 1))
            keep = np.take_along_axis(order, top, 1) >= 0
            row = np.broadcast_to(np.arange(len(sim))[:, None], top.shape)[keep]
            out.append((a["qid"].to_numpy()[lo + row], ids[top[keep]], sim[row, top[keep]] + 0.0))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("qid", "vid", "score"))})

    part = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInPandas(best, "qid bigint, vid bigint, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(*lists: tuple[str, DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of named lists (qid, entity, rank): (qid, entity, score, sources, rank).

    Summing over a union is the full outer join without its skew on popular entities: an entity twice in one list adds
    twice. Scores are rounded to 8 digits before ranking; ties go to the smaller entity.
    """
    parts = [df.select("qid", "entity", (F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("rank"))).alias("s"), F.lit(n).alias("source")) for n, df in lists]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    fused = u.groupBy("qid", "entity").agg(F.round(F.sum("s"), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "entity")
    return fused.withColumn("rank", F.row_number().over(w))


def seeds(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes a query's tokens name: (qid, repository_id, id, score), 1.0 by qualified name, 0.9 by name, 0.7 by file or
    module. Four equi-joins instead of one join with OR; the best score per node stays. tokens: (qid, repository_id, token)."""
    out = None
    for column, score in (("qualified_name", 1.0), ("name", 0.9), ("file_path", 0.7), ("module_name", 0.7)):
        n = nodes.where(F.col(column).isNotNull()).select("repository_id", F.col(column).alias("token"), "id")
        hit = tokens.join(n, ["repository_id", "token"]).select("qid", "repository_id", "id", F.lit(score).alias("score"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("qid", "repository_id", "id").agg(F.max("score").alias("score"))


def pack(items: DataFrame, group: str, order: list, size: str, key: str, max_items: int = 15, budget: int = 12_000) -> DataFrame:
    """Greedy evidence packing per group: in order, an item is taken if it fits the budget (or nothing is taken yet),
    skipped otherwise, until ``max_items`` are taken. (group, key, position, citation).

    Order decides, so this is a fold and no running sum; it runs over one group's candidates as an array in the JVM. The
    array is bounded without a loss: what is used only grows, so if an item of some size doesn't fit, no later item of that
    size does, and of each size (all above the budget being one) only the first ``max_items`` can be taken at all.
    """
    same = Window.partitionBy(group, F.least(F.col(size).cast("bigint"), F.lit(budget + 1))).orderBy(*order)
    items = items.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= max_items)
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{items.schema[key].dataType.simpleString()}>").alias("taken"))

    def step(acc, x):
        fits = (F.size(acc["taken"]) < max_items) & ((F.size(acc["taken"]) == 0) | (acc["used"] + x["n"] <= budget))
        return F.struct(
            F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["taken"], x["k"])).otherwise(acc["taken"]).alias("taken"),
        )

    taken = rows.select(group, F.aggregate("xs", start, step)["taken"].alias("taken"))
    return taken.select(group, F.posexplode("taken").alias("i", key)).select(group, key, (F.col("i") + 1).alias("position"), F.concat(F.lit("E"), (F.col("i") + 1).cast("string")).alias("citation"))


def embed(texts: DataFrame, key: str, tokens: str, dim: int = 384) -> DataFrame:
    """Deterministic embedding of token lists: a vector per token from its digest, summed and L2-normalised.

    Vectorised in numpy per Arrow batch, with the digests of a batch's distinct tokens computed once.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ramp = 3 * np.arange(dim)
        for pdf in batches:
            if not len(pdf):
                continue
            known: dict[str, np.ndarray] = {}
            out = []
            for ts in pdf["tokens"]:
                total = np.zeros(dim)
                for t in ts if ts is not None else ():
                    if t not in known:
                        d = np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8).astype(int)
                        known[t] = (((d[np.arange(dim) % 32] + ramp) % 256) - 128) / 128
                    total += known[t]
                norm = np.linalg.norm(total)
                out.append(total / norm if norm else total)
            yield pd.DataFrame({"key": pdf["key"], "embedding": out})

    return texts.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).mapInPandas(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)
