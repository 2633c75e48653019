"""Queries of the general data problems (1, 2) and their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import materialize, table
from graphloom.operators import hierarchy as H
from graphloom.operators import orphans as O
from graphloom.plans.common import sql_clean_id, sql_trim


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [table(spark, sf_dir, n) for n in ("edges", "imports", "external_modules", "nodes")]
    return O.orphans(*t).select("ref_table", "ref_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [table(spark, sf_dir, n) for n in ("edges", "imports", "external_modules", "nodes")]
    e, i = O.all_references(*t[:3])
    return O.orphan_report(e.unionByName(i), O.orphans(*t))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(H.hierarchy_links(table(spark, sf_dir, "edges")), "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cycle_nodes(_links(spark, sf_dir)).select(F.col("scope").alias("repository_id"), F.col("node").alias("node_id"))


def p2_back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return H.back_links(links, H.cycle_nodes(links)).select(
        F.col("scope").alias("repository_id"), F.col("parent").alias("source_id"), F.col("child").alias("target_id")
    )


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a node with several parents is that over the least of their ids; descendants count over every parent."""
    links = _links(spark, sf_dir)
    cycles = materialize(H.cycle_nodes(links), "cycles")
    return H.with_descendant_counts(H.hierarchy(links, cycles), H.all_descendants(links, cycles)).select(
        F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), "root", F.col("depth").cast("bigint").alias("depth"),
        F.array_join("path", " > ").alias("path"), "n_descendants",
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants over every parent, each with its least distance."""
    links = _links(spark, sf_dir)
    return H.all_descendants(links, materialize(H.cycle_nodes(links), "cycles")).select(
        F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), "descendant", F.col("distance").cast("bigint").alias("distance")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_back_links, p2_hierarchy, p2_descendants)}

_LIVES = f"""
lives AS (
  SELECT repository_id AS scope, {sql_clean_id("id")} AS id, label, {sql_trim("name")} AS name,
         first_seen_at AS born, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS gone
  FROM nodes),
refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, repository_id AS scope, {sql_clean_id("target_id")} AS k, observed_at AS t
  FROM edges WHERE target_id IS NOT NULL
  UNION ALL
  SELECT 'imports', import_id, repository_id, k, observed_at FROM (
    SELECT *, CASE WHEN NOT is_relative THEN m
       WHEN base = '' THEN m ELSE base || '.' || m END AS k
    FROM (SELECT *, {sql_trim("module")} AS m,
       coalesce(array_to_string(string_split({sql_trim("module_name")}, '.')[1:greatest(len(string_split({sql_trim("module_name")}, '.')) - level, 0)], '.'), '') AS base
       FROM imports WHERE module IS NOT NULL))
  WHERE is_relative OR NOT EXISTS (SELECT 1 FROM external_modules x WHERE x.module_root = string_split(m, '.')[1])),
lost AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.scope = r.scope AND l.born <= r.t AND r.t < l.gone
      AND ((r.ref_table = 'edges' AND l.id = r.k) OR (r.ref_table = 'imports' AND l.label = 'Module' AND l.name = r.k))))
"""

_LINKS = f"""
links AS (
  SELECT DISTINCT repository_id AS scope, {sql_clean_id("source_id")} AS a, {sql_clean_id("target_id")} AS b
  FROM edges WHERE relationship_type IN ('CONTAINS', 'DEFINES') AND source_id IS NOT NULL AND target_id IS NOT NULL),
reach(scope, s, x) AS (
  SELECT scope, a, b FROM links
  UNION
  SELECT r.scope, r.s, l.b FROM reach r JOIN links l ON l.scope = r.scope AND l.a = r.x),
loops AS (SELECT DISTINCT scope, s FROM reach WHERE s = x),
back AS (
  SELECT l.* FROM links l JOIN reach r ON r.scope = l.scope AND r.s = l.b AND r.x = l.a
  UNION SELECT * FROM links WHERE a = b)
"""

_TREE = f"""
WITH RECURSIVE {_LINKS},
parent AS (
  SELECT scope, b AS node, min(a) AS up FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM back k WHERE k.scope = l.scope AND k.a = l.a AND k.b = l.b) GROUP BY 1, 2),
ids AS (SELECT DISTINCT scope, node FROM (SELECT scope, a AS node FROM links UNION ALL SELECT scope, b FROM links)),
tree(scope, node, root, depth, path) AS (
  SELECT scope, node, node, 0, [node] FROM ids i WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.scope = i.scope AND p.node = i.node)
  UNION ALL
  SELECT p.scope, p.node, t.root, t.depth + 1, list_append(t.path, p.node) FROM tree t JOIN parent p ON p.scope = t.scope AND p.up = t.node),
kept AS (SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM back k WHERE k.scope = l.scope AND k.a = l.a AND k.b = l.b)),
below(scope, node, descendant, d) AS (
  SELECT scope, a, b, 1 FROM kept
  UNION
  SELECT w.scope, w.node, k.b, w.d + 1 FROM below w JOIN kept k ON k.scope = w.scope AND k.a = w.descendant),
pairs AS (SELECT scope, node, descendant, min(d) AS distance FROM below GROUP BY 1, 2, 3)
"""

ORACLE = {
    "p1_found": f"WITH {_LIVES} SELECT ref_table, ref_id FROM lost",
    "p1_report": f"""WITH {_LIVES} SELECT r.ref_table, r.period, n_refs, coalesce(n_orphans, 0) AS n_orphans
        FROM (SELECT ref_table, strftime(t, '%Y-%m') AS period, count(*) AS n_refs FROM refs GROUP BY 1, 2) r
        LEFT JOIN (SELECT ref_table, strftime(t, '%Y-%m') AS period, count(*) AS n_orphans FROM lost GROUP BY 1, 2) l
        USING (ref_table, period)""",
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT scope AS repository_id, s AS node_id FROM loops",
    "p2_back_links": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT scope AS repository_id, a AS source_id, b AS target_id FROM back",
    "p2_hierarchy": f"""{_TREE} SELECT t.scope AS repository_id, t.node AS node_id, root, CAST(t.depth AS BIGINT) AS depth,
        array_to_string(path, ' > ') AS path, coalesce(n, 0) AS n_descendants
        FROM tree t LEFT JOIN (SELECT scope, node, count(*) AS n FROM pairs GROUP BY 1, 2) c USING (scope, node)""",
    "p2_descendants": f"{_TREE} SELECT scope AS repository_id, node AS node_id, descendant, CAST(distance AS BIGINT) AS distance FROM pairs",
}
