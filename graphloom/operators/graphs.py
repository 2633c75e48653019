"""Property-graph operators over nodes and edges.

Every operator works per repository: (repository_id, id) is the key throughout, and joins carry both columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import clean_id, materialize

TRACE = ("CALLS", "IMPORTS", "INHERITS")
#: Cost of a hop by its type (fixed values); other types cost 3.
HOP_COST = {"CALLS": 1.0, "IMPORTS": 2.0, "INHERITS": 1.5}
#: Types that context is expanded over.
EXPAND = ("CALLS", "IMPORTS", "INHERITS", "DEFINES")
DECAY = {0: 1.0, 1: 0.7, 2: 0.4}


def latest_nodes(nodes: DataFrame, live_only: bool = True) -> DataFrame:
    """Upsert semantics: the last row per (repository_id, id) by life, delivery and row number wins. A max of one struct
    combines on the map side, so a key delivered very often costs no window."""
    cols = [c for c in nodes.columns if c not in ("repository_id", "id")]
    order = ["first_seen_at", "ingested_at", "node_no"]
    row = F.struct(*order, *[c for c in cols if c not in order])
    keyed = nodes.withColumn("id", clean_id("id")).where("repository_id is not null and id is not null")
    out = keyed.groupBy("repository_id", "id").agg(F.max(row).alias("r")).select("repository_id", "id", *[F.col(f"r.{c}").alias(c) for c in cols])
    return out.where("deleted_at is null") if live_only else out


def stored_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (repository_id, src, rel, dst) whose ends both exist among ``nodes``; a repository is a node of its own."""
    e = edges.where("source_id is not null and target_id is not null").select(
        "repository_id", clean_id("source_id").alias("src"), F.col("relationship_type").alias("rel"), clean_id("target_id").alias("dst")
    ).distinct()
    ids = nodes.select("repository_id", "id").unionByName(nodes.select("repository_id", F.col("repository_id").alias("id"))).distinct()
    return e.join(ids.withColumnRenamed("id", "src"), ["repository_id", "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), ["repository_id", "dst"], "left_semi"
    ).select("repository_id", "src", "rel", "dst")


def neighbours(edges: DataFrame, nodes: DataFrame, rels: tuple[str, ...], incoming: bool) -> DataFrame:
    """One hop along ``rels``: (repository_id, id, other, other_name)."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    e = edges.where(F.col("rel").isin(*rels)).select("repository_id", F.col(here).alias("id"), F.col(there).alias("other"))
    return e.join(nodes.select("repository_id", F.col("id").alias("other"), F.col("name").alias("other_name")), ["repository_id", "other"]).select(
        "repository_id", "id", "other", "other_name"
    )


def typed_dependencies(edges: DataFrame) -> DataFrame:
    """Both directions as two scans with a direction column; no product of in- and out-edges."""
    out = edges.select("repository_id", F.col("src").alias("id"), F.lit("out").alias("direction"), "rel", F.col("dst").alias("other"))
    into = edges.select("repository_id", F.col("dst").alias("id"), F.lit("in").alias("direction"), "rel", F.col("src").alias("other"))
    return out.unionByName(into).distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, rels: tuple[str, ...] = TRACE, max_hops: int = 4, reverse: bool = False) -> DataFrame:
    """All paths of 1..max_hops hops from ``starts`` (repository_id, id) that visit no node twice.

    (repository_id, start, end, nodes, rels, depth, cost). The frontier grows by one equi-join per hop; Catalyst sees a
    union of bounded joins, and the cycle test is part of each join's filter.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.where(F.col("rel").isin(*rels)).select("repository_id", F.col(a).alias("end"), F.col(b).alias("nxt"), "rel")
    front = starts.select("repository_id", F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    found = None
    for _ in range(max_hops):
        front = (
            front.join(e, ["repository_id", "end"])
            .where(~F.array_contains("nodes", F.col("nxt")))
            .select("repository_id", "start", F.col("nxt").alias("end"), F.array_append("nodes", F.col("nxt")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"))
        )
        found = front if found is None else found.unionByName(front)
    return found.withColumn("depth", F.size("rels")).withColumn("cost", path_cost(F.col("rels")))


def path_cost(rels):
    """10 per hop plus the cost of each hop's type."""
    hop = F.lit(3.0)
    step = lambda r: F.when(r == "CALLS", 1.0).when(r == "IMPORTS", 2.0).when(r == "INHERITS", 1.5).otherwise(hop)
    return F.size(rels) * F.lit(10.0) + F.aggregate(rels, F.lit(0.0), lambda acc, r: acc + step(r))


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int | None, reverse: bool = False, rels: tuple[str, ...] | None = None) -> DataFrame:
    """(repository_id, start, id, distance, rel): least number of hops from each start, with the type of the edge at the
    reached node's end (the least name among the shortest). Without ``max_hops`` it goes on until nothing new is reached.

    One table of what has been reached, by start and id: each round joins the newest rows with the edges and merges the
    result by the least distance, so a round reads that table once and not every round before it. A round is stored, and the
    count of its newest rows ends the search.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges if rels is None else edges.where(F.col("rel").isin(*rels))
    e = e.select("repository_id", F.col(a).alias("id"), F.col(b).alias("nxt"), F.col("rel").alias("via"))
    seen = starts.select("repository_id", F.col("id").alias("start"), "id").distinct().withColumn("distance", F.lit(0)).withColumn("rel", F.lit(None).cast("string"))
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = seen.where(F.col("distance") == hop - 1).join(e, ["repository_id", "id"]).select("repository_id", "start", F.col("nxt").alias("id"), F.lit(hop).alias("distance"), F.col("via").alias("rel"))
        best = F.min(F.struct("distance", "rel")).alias("x")
        seen = materialize(seen.unionByName(step).groupBy("repository_id", "start", "id").agg(best).select("repository_id", "start", "id", "x.distance", "x.rel"), f"bfs-{hop}")
        if hop != max_hops and seen.where(F.col("distance") == hop).isEmpty():
            break
    return seen


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (repository_id, id): two semi-joins."""
    return edges.join(ids.withColumnRenamed("id", "src"), ["repository_id", "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), ["repository_id", "dst"], "left_semi"
    ).select("repository_id", "src", "rel", "dst")


def snapshot(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes per repository by id, and the edges among them (at most 4 * limit, in order)."""
    w = Window.partitionBy("repository_id").orderBy("id")
    top = nodes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("repository_id", "id")
    w = Window.partitionBy("repository_id").orderBy("src", "rel", "dst")
    return induced_edges(edges, top).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 4 * limit).drop("rn")


def expand(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Undirected expansion of scored seeds (group, repository_id, id, score) over two hops: (…, id, score, distance).

    A node found by several parents takes the best parent's score; a node keeps its first distance. Hop one decays to
    0.7 of the seed, hop two to 0.4 of hop one.
    """
    both = edges.select("repository_id", F.col("src").alias("id"), F.col("dst").alias("nxt")).unionByName(
        edges.select("repository_id", F.col("dst").alias("id"), F.col("src").alias("nxt"))
    ).distinct()
    k = ["grp", "repository_id", "id"]
    seen = seeds.groupBy(*k).agg(F.max("score").alias("score")).withColumn("distance", F.lit(0))
    front = seen
    for hop in (1, 2):
        step = front.join(both, ["repository_id", "id"]).groupBy("grp", "repository_id", F.col("nxt").alias("id")).agg(F.max(F.col("score") * DECAY[hop]).alias("score"))
        front = step.join(seen.select(*k), k, "left_anti").withColumn("distance", F.lit(hop)).select(*k, "score", "distance")
        seen = seen.unionByName(front)
    return seen


def routes(reached: DataFrame, edges: DataFrame, rels: tuple[str, ...] = TRACE) -> DataFrame:
    """One shortest path per (repository_id, start, id) that ``bfs`` reached forwards: (…, distance, route array).

    Each node points to the least of its predecessors one hop nearer; the routes of all nodes of a distance are built from
    those of the distance before by one join, as often as the longest route is long.
    """
    e = edges.where(F.col("rel").isin(*rels)).select("repository_id", F.col("src").alias("prev"), F.col("dst").alias("id")).distinct()
    near = reached.select("repository_id", "start", F.col("id").alias("prev"), (F.col("distance") + 1).alias("distance"))
    back = reached.where("distance > 0").select("repository_id", "start", "id", "distance").join(e, ["repository_id", "id"]).join(near, ["repository_id", "start", "prev", "distance"])
    back = materialize(back.groupBy("repository_id", "start", "id", "distance").agg(F.min("prev").alias("prev")), "predecessors")
    longest = back.agg(F.max("distance")).first()[0] or 0
    done = now = reached.where("distance = 0").select("repository_id", "start", "id", "distance", F.array("id").alias("route"))
    for hop in range(1, longest + 1):
        before = now.select("repository_id", "start", F.col("id").alias("prev"), "route")
        step = back.where(F.col("distance") == hop).join(before, ["repository_id", "start", "prev"])
        now = materialize(step.select("repository_id", "start", "id", "distance", F.array_append("route", F.col("id")).alias("route")), f"routes-{hop}")
        done = done.unionByName(now)
    return done
