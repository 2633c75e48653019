"""Instances of the engine's own operators on the project tables, each with its oracle statement (DuckDB dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.catalog import clean_id, materialize, once, table, trimmed
from graphloom.functions import ids, rules
from graphloom.functions import text as X
from graphloom.operators import graphs as G
from graphloom.operators import metrics as M
from graphloom.operators import retrieval as R
from graphloom.plans.common import sql_clean_id, sql_trim

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def big(c: str):
    return F.col(c).cast("bigint").alias(c)


# -- shared fragments -----------------------------------------------------------------------------------------------
_NODES = f"""
n0 AS (SELECT *, {sql_clean_id("id")} AS cid FROM nodes WHERE repository_id IS NOT NULL AND id IS NOT NULL),
ln AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, cid ORDER BY first_seen_at DESC, ingested_at DESC, node_no DESC) AS rn FROM n0)
       WHERE rn = 1 AND deleted_at IS NULL)
"""
_GRAPH = f"""{_NODES},
ids AS (SELECT repository_id, cid FROM ln UNION SELECT repository_id, repository_id FROM ln),
ed AS (SELECT DISTINCT repository_id, {sql_clean_id("source_id")} AS src, relationship_type AS rel, {sql_clean_id("target_id")} AS dst
       FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
ge AS (SELECT e.* FROM ed e WHERE EXISTS (SELECT 1 FROM ids i WHERE i.repository_id = e.repository_id AND i.cid = e.src)
       AND EXISTS (SELECT 1 FROM ids i WHERE i.repository_id = e.repository_id AND i.cid = e.dst))
"""


def nodes_of(spark, d):
    return G.latest_nodes(table(spark, d, "nodes"))


def graph_of(spark, d):
    """The graph of the tables in ``d``, stored once per application and read by every query over it."""
    n = once(spark, "live-nodes", d, lambda: nodes_of(spark, d))
    return n, once(spark, "stored-edges", d, lambda: G.stored_edges(table(spark, d, "edges"), n))


# -- sources, upserts and identity (S3, S8-S10, S13, S14, A1, A3, F1, F18, F19, J6, J23) ------------------------------
@query(f"WITH {_NODES} SELECT repository_id, cid AS id, label, name, node_no FROM ln")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(spark, d).select("repository_id", "id", "label", "name", "node_no")


@query("SELECT repository_id, id, count(*) AS n FROM nodes GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "nodes").groupBy("repository_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_NODES} SELECT label, count(*) AS n, count(DISTINCT repository_id) AS n_repositories FROM ln GROUP BY 1")
def graph_nodes(spark, d):
    return nodes_of(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repository_id").alias("n_repositories"))


@query(f"WITH {_GRAPH} SELECT * FROM ge")
def graph_edges(spark, d):
    return graph_of(spark, d)[1]


@query(f"WITH {_GRAPH} SELECT repository_id, rel, count(*) AS n FROM ge GROUP BY 1, 2")
def edge_counts(spark, d):
    return graph_of(spark, d)[1].groupBy("repository_id", "rel").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_NODES} SELECT label, count(*) AS n, sum(CASE WHEN built = cid THEN 1 ELSE 0 END)::BIGINT AS n_equal FROM (
      SELECT label, cid, CASE label WHEN 'File' THEN 'file:' || regexp_replace(file_path, '^[./]+', '') WHEN 'Module' THEN 'module:' || name
        WHEN 'Class' THEN 'class:' || module_name || ':' || name WHEN 'Function' THEN 'function:' || module_name || ':' || name
        ELSE 'method:' || module_name || ':' || split_part(cid, ':', 3) || ':' || name END AS built FROM ln) GROUP BY 1"""
)
def id_check(spark, d):
    c = F.col
    built = (
        F.when(c("label") == "File", ids.file_id(c("file_path")))
        .when(c("label") == "Module", ids.symbol_id("module", c("name")))
        .when(c("label") == "Class", F.concat(F.lit("class:"), c("module_name"), F.lit(":"), c("name")))
        .when(c("label") == "Function", F.concat(F.lit("function:"), c("module_name"), F.lit(":"), c("name")))
        .otherwise(F.concat(F.lit("method:"), c("module_name"), F.lit(":"), ids.class_of(c("id")), F.lit(":"), c("name")))
    )
    n = nodes_of(spark, d).withColumn("same", F.when(built == c("id"), 1).otherwise(0))
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("same").cast("bigint").alias("n_equal"))


@query(
    r"""SELECT file_id, m AS module_name, coalesce(m = module_name, false) AS same FROM (
      SELECT *, regexp_replace(replace(regexp_replace(path, '\.\w+$', ''), '/', '.'), '\.__init__$', '') AS m FROM source_files WHERE path LIKE '%.py')"""
)
def module_names(spark, d):
    t = table(spark, d, "source_files").where("path like '%.py'")
    m = ids.module_name(F.col("path"))
    return t.select("file_id", m.alias("m"), F.coalesce(m == F.col("module_name"), F.lit(False)).alias("same")).withColumnRenamed("m", "module_name")


@query("SELECT DISTINCT path, lower(regexp_extract(path, '([^/]+)/*$', 1)) AS base, 'repository:' || lower(regexp_extract(path, '([^/]+)/*$', 1)) AS built, 'repository:' || replace(lower(name), ' ', '_') AS by_name FROM repositories")
def repository_ids(spark, d):
    t = table(spark, d, "repositories")
    built = ids.repository_id(F.col("path"))
    return t.select("path", F.substring_index(built, ":", -1).alias("base"), built.alias("built"), F.concat(F.lit("repository:"), ids.repository_id_of_name(F.col("name"))).alias("by_name")).distinct()


@query(
    f"""WITH {_NODES} SELECT r.repository_id, count(DISTINCT CASE WHEN label = 'File' THEN cid END) AS n_files, count(DISTINCT CASE WHEN label = 'Module' THEN cid END) AS n_modules,
      count(DISTINCT CASE WHEN label = 'Class' THEN cid END) AS n_classes, count(DISTINCT CASE WHEN label = 'Function' THEN cid END) AS n_functions,
      count(DISTINCT CASE WHEN label = 'Method' THEN cid END) AS n_methods FROM repositories r LEFT JOIN ln USING (repository_id) GROUP BY 1"""
)
def repository_structure(spark, d):
    """One aggregate over the node labels instead of a chain of outer joins."""
    n = nodes_of(spark, d).groupBy("repository_id").agg(
        *[F.count_if(F.col("label") == label).alias(c) for label, c in (("File", "n_files"), ("Module", "n_modules"), ("Class", "n_classes"), ("Function", "n_functions"), ("Method", "n_methods"))]
    )
    cols = ["n_files", "n_modules", "n_classes", "n_functions", "n_methods"]
    return table(spark, d, "repositories").select("repository_id").join(n, "repository_id", "left").select("repository_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


@query(
    """SELECT item_id, CASE WHEN category IN ('symbol_lookup','call_chain','inheritance','dependency','architecture','debugging','impact','implementation') THEN category ELSE 'symbol_lookup' END AS category,
      coalesce(difficulty, 'medium') AS difficulty, len(list_distinct(expected_entities)) AS n_expected, item_text IS NULL OR trim(item_text) = '' AS is_invalid FROM eval_items"""
)
def eval_cases(spark, d):
    known = ("symbol_lookup", "call_chain", "inheritance", "dependency", "architecture", "debugging", "impact", "implementation")
    return table(spark, d, "eval_items").select(
        "item_id", F.when(F.col("category").isin(*known), F.col("category")).otherwise("symbol_lookup").alias("category"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        F.size(F.array_compact(F.array_distinct("expected_entities"))).cast("bigint").alias("n_expected"), (F.col("item_text").isNull() | (F.trim("item_text") == "")).alias("is_invalid"),
    )


@query("SELECT category, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id FROM eval_items WHERE item_id BETWEEN 20 AND 200 GROUP BY 1")
def eval_range(spark, d):
    return table(spark, d, "eval_items").where("item_id between 20 and 200").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))


@query(
    """WITH f AS (SELECT repository_id, path, min_by(sha256, file_id) AS first_hash, max_by(sha256, file_id) AS last_hash, count(*) AS n FROM source_files WHERE content IS NOT NULL GROUP BY 1, 2)
      SELECT repository_id, count(*) AS total, sum(CASE WHEN n > 1 AND first_hash <> last_hash THEN 1 ELSE 0 END)::BIGINT AS changed, sum(CASE WHEN n > 1 AND first_hash = last_hash THEN 1 ELSE 0 END)::BIGINT AS skipped FROM f GROUP BY 1"""
)
def incremental_index(spark, d):
    """The latest delivery of a file against its first: only changed ones need indexing."""
    f = table(spark, d, "source_files").where("content is not null").groupBy("repository_id", "path").agg(
        F.min_by("sha256", "file_id").alias("a"), F.max_by("sha256", "file_id").alias("b"), F.count(F.lit(1)).alias("n")
    )
    return f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("n") > 1) & (F.col("a") != F.col("b"))).alias("changed"), F.count_if((F.col("n") > 1) & (F.col("a") == F.col("b"))).alias("skipped"))


@query("SELECT file_id, sha256(content) = sha256 AS hash_ok, octet_length(content) = size_bytes AS size_ok FROM source_files WHERE content IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "source_files").where("content is not null").select("file_id", (F.sha2("content", 256) == F.col("sha256")).alias("hash_ok"), (F.length("content") == F.col("size_bytes")).alias("size_ok"))


@query("SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def exact_dups(spark, d):
    """Group sizes come from an aggregate, and only texts that repeat are joined back: one popular text makes no window."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    g = t.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.join(g, "h").select("doc_id", "first_id", "n")


@query(
    r"""SELECT DISTINCT path, CASE WHEN regexp_matches(lower(path), '\.(md|txt)$') THEN 'MARKDOWN' WHEN regexp_matches(lower(path), 'arch|overview|diagram') THEN 'ARCHITECTURE_DIAGRAM'
      WHEN regexp_matches(lower(path), 'er|schema|database') THEN 'ER_DIAGRAM' WHEN regexp_matches(lower(path), 'uml|class') THEN 'UML_DIAGRAM' WHEN regexp_matches(lower(path), 'ui|screenshot|mockup') THEN 'UI_SCREENSHOT'
      WHEN regexp_matches(lower(path), '\.(png|jpg|jpeg|svg)$') THEN 'IMAGE' ELSE 'SOURCE' END AS asset,
      CASE lower(regexp_extract(path, '\.([^.]*)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'md' THEN 'text/markdown'
        WHEN 'txt' THEN 'text/plain' WHEN 'py' THEN 'text/x-python' ELSE 'application/octet-stream' END AS mime
      FROM source_files WHERE path IS NOT NULL"""
)
def asset_types(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").where("path is not null").select("path", rules.asset_type(p).alias("asset"), rules.mime_type(p).alias("mime")).distinct()


# -- lookups, seeds and neighbours (P2-P6, J8-J11, G1, G8, G10) -------------------------------------------------------
_TOKENS = r"""
tk AS (SELECT DISTINCT item_id AS qid, repository_id, t AS token FROM (SELECT item_id, repository_id, unnest(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*')) AS t FROM eval_items) WHERE length(t) >= 2),
sd AS (SELECT qid, repository_id, cid AS id, max(score) AS score FROM (
  SELECT qid, t.repository_id, cid, CAST(1.0 AS DOUBLE) AS score FROM tk t JOIN ln ON ln.repository_id = t.repository_id AND ln.qualified_name = token
  UNION ALL SELECT qid, t.repository_id, cid, CAST(0.9 AS DOUBLE) FROM tk t JOIN ln ON ln.repository_id = t.repository_id AND ln.name = token
  UNION ALL SELECT qid, t.repository_id, cid, CAST(0.7 AS DOUBLE) FROM tk t JOIN ln ON ln.repository_id = t.repository_id AND (ln.file_path = token OR ln.module_name = token)) GROUP BY 1, 2, 3)
"""


def item_tokens(spark, d):
    t = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "repository_id", F.explode(X.ordered_tokens(F.col("item_text"))).alias("token"))
    return t.distinct()


def item_seeds(spark, d, nodes):
    return R.seeds(item_tokens(spark, d), nodes)


@query(f"WITH {_NODES}, {_TOKENS} SELECT * FROM sd")
def seed_match(spark, d):
    return item_seeds(spark, d, nodes_of(spark, d))


_DOC_TOKENS = r"""dt AS (SELECT DISTINCT doc_id AS qid, repository_id, t AS token FROM (SELECT doc_id, repository_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*')) AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) >= 2)"""


@query(f"WITH {_NODES}, {_DOC_TOKENS} SELECT repository_id, cid AS id, count(DISTINCT qid) AS n_docs FROM dt JOIN ln USING (repository_id) WHERE ln.name = token GROUP BY 1, 2")
def document_mentions(spark, d):
    """Graph nodes that documents of their repository name."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("qid"), "repository_id", F.explode(X.ordered_tokens(F.col("text"))).alias("token")).distinct()
    n = nodes_of(spark, d).select("repository_id", F.col("name").alias("token"), "id")
    return t.join(n, ["repository_id", "token"]).groupBy("repository_id", "id").agg(F.countDistinct("qid").alias("n_docs"))


@query(f"WITH {_NODES} SELECT e.evidence_id, ln.cid AS id, ln.label FROM evidence e JOIN ln ON ln.repository_id = e.repository_id AND ln.qualified_name = e.qualified_name")
def point_lookup(spark, d):
    n = nodes_of(spark, d).select("repository_id", "qualified_name", "id", "label")
    return table(spark, d, "evidence").select("evidence_id", "repository_id", "qualified_name").join(n, ["repository_id", "qualified_name"]).select("evidence_id", "id", "label")


@query(
    f"""WITH {_NODES}, t AS (SELECT DISTINCT repository_id, name AS e FROM imports WHERE name NOT IN ('', '*'))
      SELECT t.repository_id, t.e AS entity, ln.cid AS id FROM t JOIN ln ON ln.repository_id = t.repository_id AND (ln.name = t.e OR ends_with(ln.qualified_name, '.' || t.e))"""
)
def suffix_lookup(spark, d):
    """Name or qualified-name suffix: the suffixes of each name become join keys, so the match stays an equi-join."""
    t = table(spark, d, "imports").where("name not in ('', '*')").select("repository_id", F.col("name").alias("entity")).distinct()
    n = nodes_of(spark, d)
    parts = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.array_distinct(F.concat(F.array("name"), F.when(F.size(parts) >= 2, suffixes).otherwise(F.array().cast("array<string>"))))
    n = n.select("repository_id", "id", F.explode(F.when(F.col("qualified_name").isNull(), F.array("name")).otherwise(keys)).alias("entity"))
    return t.join(n, ["repository_id", "entity"]).select("repository_id", "entity", "id").distinct()


@query(f"WITH {_GRAPH} SELECT ge.repository_id, dst AS id, src AS other, ln.name AS other_name FROM ge JOIN ln ON ln.repository_id = ge.repository_id AND ln.cid = src WHERE rel = 'CALLS'")
def callers(spark, d):
    n, e = graph_of(spark, d)
    return G.neighbours(e, n, ("CALLS",), incoming=True)


@query(f"WITH {_GRAPH} SELECT ge.repository_id, src AS id, dst AS other, ln.name AS other_name FROM ge JOIN ln ON ln.repository_id = ge.repository_id AND ln.cid = dst WHERE rel = 'CALLS'")
def callees(spark, d):
    n, e = graph_of(spark, d)
    return G.neighbours(e, n, ("CALLS",), incoming=False)


@query(f"WITH {_GRAPH} SELECT ge.repository_id, dst AS id, src AS other, ln.name AS other_name FROM ge JOIN ln ON ln.repository_id = ge.repository_id AND ln.cid = src WHERE rel = 'IMPORTS'")
def dependents(spark, d):
    n, e = graph_of(spark, d)
    return G.neighbours(e, n, ("IMPORTS",), incoming=True)


@query(f"WITH {_GRAPH} SELECT repository_id, src AS id, 'out' AS direction, rel, dst AS other FROM ge UNION SELECT repository_id, dst, 'in', rel, src FROM ge")
def typed_dependencies(spark, d):
    return G.typed_dependencies(graph_of(spark, d)[1])


@query(f"WITH {_GRAPH}, {_TOKENS}, s AS (SELECT DISTINCT repository_id, id FROM sd) SELECT ge.* FROM ge JOIN s a ON a.repository_id = ge.repository_id AND a.id = src JOIN s b ON b.repository_id = ge.repository_id AND b.id = dst")
def induced_subgraph(spark, d):
    n, e = graph_of(spark, d)
    return G.induced_edges(e, item_seeds(spark, d, n).select("repository_id", "id").distinct())


@query(
    f"""WITH {_GRAPH}, t AS (SELECT repository_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY cid) AS rn FROM ln) WHERE rn <= 25),
      x AS (SELECT ge.*, row_number() OVER (PARTITION BY ge.repository_id ORDER BY src, rel, dst) AS rn FROM ge JOIN t a ON a.repository_id = ge.repository_id AND a.cid = src JOIN t b ON b.repository_id = ge.repository_id AND b.cid = dst)
      SELECT repository_id, src, rel, dst FROM x WHERE rn <= 100"""
)
def graph_snapshot(spark, d):
    n, e = graph_of(spark, d)
    return G.snapshot(n, e, 25)


# -- traversal (G2-G7, G9, F16, F41, E10) -----------------------------------------------------------------------------
def _paths_sql(start: str, rels: str, hops: int, a: str = "src", b: str = "dst") -> str:
    return f"""WITH RECURSIVE {_GRAPH}, {_TOKENS}, st AS ({start}),
      w(repository_id, start, fin, nodes, rels, depth) AS (
        SELECT st.repository_id, st.id, ge.{b}, [st.id, ge.{b}], [rel], 1 FROM st JOIN ge ON ge.repository_id = st.repository_id AND ge.{a} = st.id WHERE rel IN ({rels}) AND ge.{b} <> st.id
        UNION ALL SELECT w.repository_id, w.start, ge.{b}, list_append(w.nodes, ge.{b}), list_append(w.rels, rel), w.depth + 1 FROM w JOIN ge ON ge.repository_id = w.repository_id AND ge.{a} = w.fin
        WHERE w.depth < {hops} AND rel IN ({rels}) AND NOT list_contains(w.nodes, ge.{b}))"""


_SEED_START = "SELECT DISTINCT repository_id, id FROM sd WHERE score >= 0.9"
_COST = "CAST(depth * 10 + list_sum(list_transform(rels, lambda r: CASE r WHEN 'CALLS' THEN 1.0 WHEN 'IMPORTS' THEN 2.0 WHEN 'INHERITS' THEN 1.5 ELSE 3.0 END)) AS DOUBLE)"


def _seed_starts(spark, d, n):
    return item_seeds(spark, d, n).where("score >= 0.9").select("repository_id", "id").distinct()


def _path_rows(p):
    return p.select("repository_id", "start", F.col("end").alias("fin"), F.array_join("nodes", " > ").alias("path"), F.array_join("rels", ",").alias("rels"), big("depth"), "cost")


@query(_paths_sql(_SEED_START, "'CALLS','IMPORTS','INHERITS'", 4) + f" SELECT repository_id, start, fin, array_to_string(nodes, ' > ') AS path, array_to_string(rels, ',') AS rels, CAST(depth AS BIGINT) AS depth, {_COST} AS cost FROM w")
def path_enum(spark, d):
    n, e = graph_of(spark, d)
    return _path_rows(G.simple_paths(e, _seed_starts(spark, d, n), max_hops=4))


@query(_paths_sql(_SEED_START, "'CALLS'", 4) + " SELECT repository_id, start, fin, array_to_string(nodes, ' > ') AS path, CAST(depth AS BIGINT) AS depth FROM w")
def call_trace(spark, d):
    n, e = graph_of(spark, d)
    return _path_rows(G.simple_paths(e, _seed_starts(spark, d, n), ("CALLS",), 4)).select("repository_id", "start", "fin", "path", "depth")


@query(_paths_sql(_SEED_START, "'CALLS'", 4, "dst", "src") + " SELECT repository_id, start, fin, array_to_string(list_reverse(nodes), ' > ') AS path, CAST(depth AS BIGINT) AS depth FROM w")
def reverse_trace(spark, d):
    n, e = graph_of(spark, d)
    p = G.simple_paths(e, _seed_starts(spark, d, n), ("CALLS",), 4, reverse=True)
    return p.select("repository_id", "start", F.col("end").alias("fin"), F.array_join(F.reverse("nodes"), " > ").alias("path"), big("depth"))


@query(
    _paths_sql(_SEED_START, "'CALLS','IMPORTS','INHERITS'", 4)
    + f""" SELECT repository_id, start, fin, path, CAST(rn AS BIGINT) AS rank, depth, cost FROM (SELECT repository_id, start, fin, array_to_string(nodes, ' > ') AS path, CAST(depth AS BIGINT) AS depth, {_COST} AS cost,
      row_number() OVER (PARTITION BY repository_id, start, fin ORDER BY depth, {_COST}, nodes, rels) AS rn FROM w WHERE EXISTS (SELECT 1 FROM st WHERE st.repository_id = w.repository_id AND st.id = w.fin)) WHERE rn <= 3"""
)
def path_between(spark, d):
    """The three best paths between any two seeds: enumerate, then filter, rank and cut."""
    n, e = graph_of(spark, d)
    st = materialize(_seed_starts(spark, d, n), "starts")
    p = G.simple_paths(e, st, max_hops=4).join(st.withColumnRenamed("id", "end"), ["repository_id", "end"], "left_semi")
    w = Window.partitionBy("repository_id", "start", "end").orderBy("depth", "cost", "nodes", "rels")
    p = p.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return p.select("repository_id", "start", F.col("end").alias("fin"), F.array_join("nodes", " > ").alias("path"), big("rank"), big("depth"), "cost")


def _bfs_sql(hops: int, a: str, b: str, rels: str | None = None) -> str:
    where = f"AND rel IN ({rels})" if rels else ""
    return f"""WITH RECURSIVE {_GRAPH}, {_TOKENS}, st AS ({_SEED_START}),
      b(repository_id, start, id, distance) AS (SELECT repository_id, id, id, 0 FROM st
        UNION SELECT b.repository_id, b.start, ge.{b}, b.distance + 1 FROM b JOIN ge ON ge.repository_id = b.repository_id AND ge.{a} = b.id WHERE b.distance < {hops} {where}),
      m AS (SELECT repository_id, start, id, min(distance) AS distance FROM b GROUP BY 1, 2, 3)"""


@query(_bfs_sql(8, "src", "dst", "'CALLS','IMPORTS','INHERITS'") + " SELECT repository_id, start, id, CAST(distance AS BIGINT) AS distance FROM m WHERE distance > 0")
def shortest_path(spark, d):
    n, e = graph_of(spark, d)
    return G.bfs(e, _seed_starts(spark, d, n), 8, rels=G.TRACE).where("distance > 0").select("repository_id", "start", "id", big("distance"))


@query(
    _bfs_sql(4, "dst", "src", "'CALLS','IMPORTS','INHERITS'")
    + """ SELECT m.repository_id, m.start, m.id, CAST(m.distance AS BIGINT) AS distance, min(ge.rel) AS rel, CASE WHEN m.distance = 1 THEN 'direct' ELSE 'indirect' END AS kind
      FROM m JOIN ge ON ge.repository_id = m.repository_id AND ge.src = m.id AND ge.rel IN ('CALLS','IMPORTS','INHERITS') JOIN m p ON p.repository_id = m.repository_id AND p.start = m.start AND p.id = ge.dst AND p.distance = m.distance - 1
      WHERE m.distance > 0 GROUP BY ALL"""
)
def impact_closure(spark, d):
    """Everything that reaches a seed within four hops, by least distance, with the dependent's own edge type."""
    n, e = graph_of(spark, d)
    out = G.bfs(e, _seed_starts(spark, d, n), 4, reverse=True, rels=G.TRACE).where("distance > 0")
    return out.select("repository_id", "start", "id", big("distance"), "rel", F.when(F.col("distance") == 1, "direct").otherwise("indirect").alias("kind"))


@query(
    _bfs_sql(4, "dst", "src", "'CALLS','IMPORTS','INHERITS'")
    + " SELECT m.repository_id, start, count(DISTINCT file_path) AS n_files, count(DISTINCT module_name) AS n_modules, count(*) AS n_nodes FROM m JOIN ln ON ln.repository_id = m.repository_id AND ln.cid = m.id WHERE distance > 0 GROUP BY 1, 2"
)
def impact_summary(spark, d):
    n, e = graph_of(spark, d)
    out = G.bfs(e, _seed_starts(spark, d, n), 4, reverse=True, rels=G.TRACE).where("distance > 0")
    return out.join(n.select("repository_id", "id", "file_path", "module_name"), ["repository_id", "id"]).groupBy("repository_id", "start").agg(
        F.countDistinct("file_path").alias("n_files"), F.countDistinct("module_name").alias("n_modules"), F.count(F.lit(1)).alias("n_nodes")
    )


def _inherit_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, st AS (SELECT DISTINCT repository_id, {a} AS id FROM ge WHERE rel = 'INHERITS'),
      b(repository_id, start, id) AS (SELECT repository_id, id, id FROM st UNION SELECT b.repository_id, b.start, ge.{b} FROM b JOIN ge ON ge.repository_id = b.repository_id AND ge.{a} = b.id AND rel = 'INHERITS')
      SELECT repository_id, start, id FROM b WHERE start <> id"""


@query(f"SELECT 'up' AS direction, * FROM ({_inherit_sql('src', 'dst')}) UNION ALL SELECT 'down', * FROM ({_inherit_sql('dst', 'src')})")
def inheritance_closure(spark, d):
    """What a class inherits from and what inherits from it, over any number of hops."""
    n, e = graph_of(spark, d)
    out = None
    for direction, here in (("up", "src"), ("down", "dst")):
        st = e.where("rel = 'INHERITS'").select("repository_id", F.col(here).alias("id")).distinct()
        part = G.bfs(e, st, None, reverse=direction == "down", rels=("INHERITS",)).where("distance > 0").select(F.lit(direction).alias("direction"), "repository_id", "start", "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_GRAPH}, {_TOKENS}, s0 AS (SELECT qid AS grp, repository_id, id, score FROM sd),
      u AS (SELECT repository_id, src AS a, dst AS b FROM ge WHERE rel IN ('CALLS','IMPORTS','INHERITS','DEFINES') UNION SELECT repository_id, dst, src FROM ge WHERE rel IN ('CALLS','IMPORTS','INHERITS','DEFINES')),
      h1 AS (SELECT grp, repository_id, b AS id, max(score * 0.7::DOUBLE) AS score FROM s0 JOIN u USING (repository_id) WHERE u.a = s0.id GROUP BY 1, 2, 3),
      x1 AS (SELECT * FROM h1 WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.grp = h1.grp AND s0.repository_id = h1.repository_id AND s0.id = h1.id)),
      h2 AS (SELECT grp, repository_id, b AS id, max(score * 0.4::DOUBLE) AS score FROM x1 JOIN u USING (repository_id) WHERE u.a = x1.id GROUP BY 1, 2, 3),
      x2 AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.grp = h2.grp AND s0.repository_id = h2.repository_id AND s0.id = h2.id) AND NOT EXISTS (SELECT 1 FROM x1 WHERE x1.grp = h2.grp AND x1.repository_id = h2.repository_id AND x1.id = h2.id))
      SELECT grp, repository_id, id, round(score, 6) AS score, CAST(distance AS BIGINT) AS distance FROM (SELECT *, 0 AS distance FROM s0 UNION ALL SELECT *, 1 FROM x1 UNION ALL SELECT *, 2 FROM x2)"""
)
def neighbour_expand(spark, d):
    n, e = graph_of(spark, d)
    s = materialize(item_seeds(spark, d, n).select(F.col("qid").alias("grp"), "repository_id", "id", "score"), "seeds")
    return G.expand(e.where(F.col("rel").isin(*G.EXPAND)), s).select("grp", "repository_id", "id", F.round("score", 6).alias("score"), big("distance"))


_LAYER = """CASE WHEN regexp_matches(x, 'api|route|controller|main|cli|endpoint|handler|server|app') THEN 'entry' WHEN regexp_matches(x, 'repo|repository|db|database|store|model|dao|entity|sql|orm') THEN 'persistence'
      WHEN regexp_matches(x, 'client|adapter|gateway|external|remote|sdk|http') THEN 'boundary' ELSE 'intermediate' END"""


@query(f"WITH {_NODES} SELECT repository_id, cid AS id, {_LAYER} AS layer FROM (SELECT *, lower(concat_ws(' ', name, qualified_name, file_path)) AS x FROM ln)")
def layer_classify(spark, d):
    x = F.concat_ws(" ", "name", "qualified_name", "file_path")
    return nodes_of(spark, d).select("repository_id", "id", rules.by_words(x, rules.LAYERS, "intermediate").alias("layer"))


# -- symbol resolution on the import table (J1, J2, J5, A2) -----------------------------------------------------------
_IMPORTS = f"""im AS (SELECT *, CASE WHEN NOT is_relative THEN m WHEN base = '' THEN m WHEN m IS NULL THEN base ELSE base || '.' || m END AS target FROM (SELECT *, {sql_trim("module")} AS m,
      coalesce(array_to_string(string_split(module_name, '.')[1:greatest(len(string_split(module_name, '.')) - level, 0)], '.'), '') AS base FROM imports))"""


def _import_targets(spark, d):
    parts = F.split("module_name", r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    m = trimmed("module")
    t = F.when(~F.col("is_relative"), m).when(base == "", m).when(m.isNull(), base).otherwise(F.concat_ws(".", base, m))
    return table(spark, d, "imports").withColumn("target", t)


@query(f"WITH {_NODES}, {_IMPORTS} SELECT im.repository_id, count(*) AS n, count(f.cid) AS n_resolved, count(*) - count(f.cid) AS n_unresolved FROM im LEFT JOIN (SELECT DISTINCT repository_id, name, cid FROM ln WHERE label = 'Module') f ON f.repository_id = im.repository_id AND f.name = im.target GROUP BY 1")
def import_resolution(spark, d):
    mods = nodes_of(spark, d).where("label = 'Module'").select("repository_id", F.col("name").alias("target"), F.col("id").alias("hit")).distinct()
    j = _import_targets(spark, d).join(mods, ["repository_id", "target"], "left")
    return j.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_resolved"), F.count_if(F.col("hit").isNull()).alias("n_unresolved"))


@query(f"WITH {_IMPORTS} SELECT DISTINCT repository_id, module_name AS src, target AS dst FROM im WHERE target IS NOT NULL AND target <> module_name")
def import_edges(spark, d):
    return _import_targets(spark, d).where("target is not null and target <> module_name").select("repository_id", F.col("module_name").alias("src"), F.col("target").alias("dst")).distinct()


@query(
    f"""WITH {_IMPORTS}, s AS (SELECT repository_id, file_path, coalesce(nullif(alias, ''), nullif(name, ''), m) AS symbol, ordinal, import_id, CASE WHEN name = '' OR name = '*' THEN target ELSE target || '.' || name END AS bound FROM im WHERE target IS NOT NULL)
      SELECT repository_id, file_path, symbol, max_by(bound, ordinal::BIGINT * 1000000000 + import_id) AS bound FROM s GROUP BY 1, 2, 3"""
)
def local_symbols(spark, d):
    """What each name of a file is bound to; the last import of a name wins."""
    t = _import_targets(spark, d).where("target is not null")
    sym = F.coalesce(F.nullif("alias", F.lit("")), F.nullif("name", F.lit("")), trimmed("module"))
    bound = F.when(F.col("name").isin("", "*"), F.col("target")).otherwise(F.concat_ws(".", "target", "name"))
    return t.select("repository_id", "file_path", sym.alias("symbol"), bound.alias("bound"), (F.col("ordinal").cast("bigint") * 1000000000 + F.col("import_id")).alias("o")).groupBy("repository_id", "file_path", "symbol").agg(F.max_by("bound", "o").alias("bound"))


# -- vectors and fusion (E4, E7, J12, T3-T5, W1, W2, A5-A7) -----------------------------------------------------------
_COS = "round(greatest(0::DOUBLE, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6)"
_TOP = f"""tv AS (SELECT * FROM (SELECT q.vec_id AS qid, q.label AS ql, v.vec_id AS vid, v.label AS vl, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank
      FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"""


def _top(spark, d, k=10, scope=None):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return R.cosine_topk(q, e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label"), k, scope)


@query(f"WITH {_TOP} SELECT qid, vid, score, rank FROM tv")
def vector_topk(spark, d):
    return _top(spark, d).select("qid", "vid", "score", big("rank"))


@query(
    f"""SELECT qid, vid, score, rank FROM (SELECT q.vec_id AS qid, v.vec_id AS vid, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank
      FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""
)
def vector_topk_isolated(spark, d):
    return _top(spark, d, scope="label").select("qid", "vid", "score", big("rank"))


_SECOND = """sl AS (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vid) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS vid, CASE WHEN q.label = v.label THEN 0.9 ELSE 0.5 END AS s
      FROM embeddings q JOIN embeddings v ON v.label BETWEEN q.label AND q.label + 1 WHERE q.vec_id % 20 = 0))"""


def _second(spark, d):
    """A rule-scored second ranking over every stored row: rows of the query's label and the next one, own label first, ten per
    query. Within a label the order is by id only, so ten rows of each label are enough."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").alias("l"))
    by_id = Window.partitionBy("l").orderBy("vid")
    least = e.withColumn("n", F.row_number().over(by_id)).where("n <= 10").drop("n")
    q = e.where("vid % 20 = 0").select(F.col("vid").alias("qid"), F.explode(F.array(F.struct("l", F.lit(0.9).alias("s")), F.struct((F.col("l") + 1).alias("l"), F.lit(0.5).alias("s")))).alias("x")).select("qid", "x.l", "x.s")
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "vid")
    return q.join(least, "l").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("qid", "vid", "rank")


@query(
    f"""WITH {_TOP}, {_SECOND}, u AS (SELECT qid, vid, rank, 'vector' AS source FROM tv UNION ALL SELECT qid, vid, rank, 'graph' FROM sl WHERE rank <= 10),
      f AS (SELECT qid, vid AS entity, round(sum(1::DOUBLE / (60 + rank)), 8) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM u GROUP BY 1, 2)
      SELECT qid, entity, score, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf(spark, d):
    v = _top(spark, d).select("qid", F.col("vid").alias("entity"), "rank")
    g = _second(spark, d).withColumnRenamed("vid", "entity")
    return R.rrf(("vector", v), ("graph", g)).where("rank <= 10").select("qid", "entity", "score", "sources", big("rank"))


@query(
    f"""WITH {_TOP}, u AS (SELECT qid, vid // 2 AS entity, rank FROM tv)
      SELECT qid, entity, round(sum(1::DOUBLE / (60 + rank)), 8) AS score, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) > 1"""
)
def rrf_dup_entity(spark, d):
    """An entity that stands twice in one list adds twice."""
    v = _top(spark, d).select("qid", F.floor(F.col("vid") / 2).alias("entity"), "rank")
    twice = v.groupBy("qid", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return R.rrf(("vector", v)).join(twice, ["qid", "entity"]).select("qid", "entity", "score", "n")


_EVAL = f"""{_TOP}, rel AS (SELECT q.vec_id AS qid, q.label, count(*) AS n FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
      h AS (SELECT qid, min(rank) AS first, sum((rank <= 1)::INT) AS h1, sum((rank <= 5)::INT) AS h5, sum((rank <= 10)::INT) AS h10 FROM tv WHERE ql = vl GROUP BY 1),
      ev AS (SELECT rel.qid, label, coalesce(h1, 0) / n AS recall_1, coalesce(h5, 0) / n AS recall_5, coalesce(h10, 0) / n AS recall_10, coalesce(1::DOUBLE / first, 0) AS mrr FROM rel LEFT JOIN h USING (qid))"""


def _evaluated(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    ranked = _top(spark, d).join(q, "qid").join(e.select(F.col("vec_id").alias("vid"), F.col("label").alias("vl")), "vid").withColumn("hit", F.col("label") == F.col("vl"))
    return M.retrieval_metrics(ranked, q.join(n, "label").select("qid", "n_relevant")).join(q, "qid")


@query(f"WITH {_EVAL} SELECT qid, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr FROM ev")
def retrieval_eval(spark, d):
    return _evaluated(spark, d).select("qid", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")])


@query(f"WITH {_EVAL} SELECT CAST(coalesce(label, -1) AS BIGINT) AS label, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr FROM ev GROUP BY ROLLUP (label)")
def eval_rollup(spark, d):
    return _evaluated(spark, d).rollup("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr")).withColumn("label", F.coalesce("label", F.lit(-1)).cast("bigint"))


# -- graph retrieval and evidence (E6, E11, W3, W4, J13, O3, F13, F39, F46) ------------------------------------------
_RETR = f"""{_GRAPH}, {_TOKENS}, u AS (SELECT repository_id, src AS a, dst AS b FROM ge UNION SELECT repository_id, dst, src FROM ge),
      h AS (SELECT qid, s.repository_id, u.b AS id, CAST(0.5 AS DOUBLE) AS score FROM sd s JOIN u ON u.repository_id = s.repository_id AND u.a = s.id),
      gr AS (SELECT qid, repository_id, id, max(score) AS score FROM (SELECT * FROM sd UNION ALL SELECT * FROM h) GROUP BY 1, 2, 3)"""


def graph_ranking(spark, d):
    n, e = graph_of(spark, d)
    s = materialize(item_seeds(spark, d, n), "seeds")
    both = e.select("repository_id", F.col("src").alias("id"), F.col("dst").alias("nxt")).unionByName(e.select("repository_id", F.col("dst").alias("id"), F.col("src").alias("nxt"))).distinct()
    hop = s.join(both, ["repository_id", "id"]).select("qid", "repository_id", F.col("nxt").alias("id"), F.lit(0.5).alias("score"))
    best = s.unionByName(hop).groupBy("qid", "repository_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "repository_id", "id")
    return best.withColumn("rank", F.row_number().over(w))


@query(f"WITH {_RETR} SELECT qid, repository_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, repository_id, id) AS rank FROM gr) WHERE rank <= 10")
def graph_retrieval(spark, d):
    return graph_ranking(spark, d).where("rank <= 10").select("qid", "repository_id", "id", "score", big("rank"))


_PACK = """WITH RECURSIVE c AS (SELECT query_id, evidence_id, length(source_code) AS n, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, evidence_id) AS o
        FROM (SELECT * FROM evidence WHERE source_code IS NOT NULL AND retrieval_score IS NOT NULL)),
      p(query_id, o, used, taken, evidence_id, ok) AS (
        SELECT query_id, o, n, 1, evidence_id, true FROM c WHERE o = 1
        UNION ALL SELECT c.query_id, c.o, CASE WHEN p.taken < 15 AND p.used + c.n <= 12000 THEN p.used + c.n ELSE p.used END, CASE WHEN p.taken < 15 AND p.used + c.n <= 12000 THEN p.taken + 1 ELSE p.taken END,
          c.evidence_id, p.taken < 15 AND p.used + c.n <= 12000 FROM p JOIN c ON c.query_id = p.query_id AND c.o = p.o + 1)"""


@query(_PACK + " SELECT query_id, evidence_id, CAST(taken AS BIGINT) AS position, 'E' || taken AS citation FROM p WHERE ok")
def evidence_pack(spark, d):
    t = table(spark, d, "evidence").where("source_code is not null and retrieval_score is not null").select("query_id", "evidence_id", F.length("source_code").alias("n_chars"), (-F.col("retrieval_score")).alias("o"), F.col("evidence_id").alias("o2"))
    return R.pack(t, "query_id", ["o", "o2"], "n_chars", "evidence_id").select("query_id", "evidence_id", big("position"), "citation")


@query("SELECT query_id, entity_id, evidence_id, retrieval_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repository_id, entity_id ORDER BY retrieval_score DESC NULLS LAST, evidence_id) AS rn FROM evidence WHERE entity_id IS NOT NULL) WHERE rn = 1")
def evidence_dedup(spark, d):
    t = table(spark, d, "evidence").where("entity_id is not null")
    best = t.groupBy("query_id", "repository_id", "entity_id").agg(F.min(F.struct(F.coalesce(-F.col("retrieval_score"), F.lit(float("inf"))), "evidence_id", "retrieval_score")).alias("b"))
    return best.select("query_id", "entity_id", "b.evidence_id", "b.retrieval_score")


_CITES = r"c AS (SELECT doc_id, regexp_extract_all(text, '\[(E\d+)\]', 1) AS m FROM documents WHERE text IS NOT NULL), ci AS (SELECT doc_id, unnest(list_distinct(m)) AS cite FROM c)"


@query(f"WITH {_CITES} SELECT doc_id, count(*) AS n_cites, count(*) FILTER (cite NOT IN ('E1','E2','E3','E4','E5','E6')) AS n_invalid FROM ci GROUP BY 1")
def citation_check(spark, d):
    valid = F.array(*[F.lit(f"E{i}") for i in range(1, 7)])
    c = X.citations(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", c.alias("c")).where("size(c) > 0").select("doc_id", F.size("c").cast("bigint").alias("n_cites"), F.size(F.array_except("c", valid)).cast("bigint").alias("n_invalid"))


@query("SELECT query_id, CASE WHEN count(DISTINCT entity_id) >= 2 AND count(DISTINCT citation_id) >= 1 THEN 'high' WHEN count(DISTINCT entity_id) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM evidence GROUP BY 1")
def confidence_label(spark, d):
    g = table(spark, d, "evidence").groupBy("query_id").agg(F.countDistinct("entity_id").alias("n"), F.countDistinct("citation_id").alias("c"))
    return g.select("query_id", rules.confidence(F.col("n"), F.col("c")).alias("confidence"))


@query("SELECT evidence_id, '[' || citation_id || '] ' || file_path || CASE WHEN start_line IS NULL THEN '' WHEN end_line IS NULL OR end_line = start_line THEN ':' || (start_line + 1) ELSE ':' || (start_line + 1) || '-' || (end_line + 1) END AS cite FROM evidence WHERE citation_id IS NOT NULL AND file_path IS NOT NULL")
def provenance_text(spark, d):
    s, e = F.col("start_line"), F.col("end_line")
    span = F.when(s.isNull(), "").when(e.isNull() | (e == s), F.concat(F.lit(":"), (s + 1).cast("string"))).otherwise(F.concat(F.lit(":"), (s + 1).cast("string"), F.lit("-"), (e + 1).cast("string")))
    return table(spark, d, "evidence").where("citation_id is not null and file_path is not null").select("evidence_id", F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), F.col("file_path"), span).alias("cite"))


@query("SELECT query_id, round(avg(score), 6) AS coverage FROM (SELECT query_id, CASE WHEN list_contains(retrieval_source, 'graph') AND list_contains(retrieval_source, 'vector') THEN 1.0 WHEN len(retrieval_source) > 0 THEN 0.5 ELSE 0.0 END AS score FROM evidence WHERE retrieval_source IS NOT NULL) GROUP BY 1")
def evidence_coverage(spark, d):
    s = F.col("retrieval_source")
    score = F.when(F.array_contains(s, "graph") & F.array_contains(s, "vector"), 1.0).when(F.size(s) > 0, 0.5).otherwise(0.0)
    return table(spark, d, "evidence").where(s.isNotNull()).groupBy("query_id").agg(F.round(F.avg(score), 6).alias("coverage"))


# -- text (F3-F13, F28-F31, F40, J16, P9) -----------------------------------------------------------------------------
def _sql_lines(c: str) -> str:
    """The lines of a text by any line end, without an empty last one."""
    ls = f"string_split(regexp_replace({c}, '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"
    return f"(CASE WHEN {ls}[-1] = '' THEN {ls}[1:-2] ELSE {ls} END)"


@query(f"SELECT evidence_id, array_to_string(l[2:3], chr(10)) AS part, CAST(len(l) AS BIGINT) AS n_lines FROM (SELECT evidence_id, {_sql_lines('source_code')} AS l FROM evidence WHERE source_code IS NOT NULL)")
def chunk_slice(spark, d):
    c = F.col("source_code")
    return table(spark, d, "evidence").where(c.isNotNull()).select("evidence_id", X.line_slice(c, F.lit(1), F.lit(2)).alias("part"), F.size(X.lines(c)).cast("bigint").alias("n_lines"))


@query(f"""WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS no FROM (SELECT doc_id, {_sql_lines('text')} AS x FROM documents WHERE text IS NOT NULL)),
      h AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS rn FROM l WHERE contains(lower(line), 'snapshot') OR contains(lower(line), 'manifest'))
      SELECT doc_id, no, line FROM h WHERE rn <= 5""")
def keyword_scan(spark, d):
    """The first five lines of each document with one of the words."""
    c = F.col("text")
    hits = F.filter(F.transform(X.lines(c), lambda x, i: F.struct((i + 1).cast("bigint").alias("no"), x.alias("line"))), lambda s: F.lower(s["line"]).contains("snapshot") | F.lower(s["line"]).contains("manifest"))
    return table(spark, d, "documents").where(c.isNotNull()).select("doc_id", F.explode(F.slice(hits, 1, 5)).alias("h")).select("doc_id", "h.no", "h.line")


_SYM = rf"""ln0 AS (SELECT doc_id, no, unnest(string_split_regex(line, '[^\p{{L}}\p{{M}}\p{{N}}_]+')) AS sym FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM (SELECT doc_id, {_sql_lines('text')} AS x FROM documents WHERE text IS NOT NULL))),
      sy AS (SELECT doc_id, no, sym FROM ln0 WHERE regexp_full_match(sym, '[A-Z][a-zA-Z0-9_]+') AND regexp_matches(sym, '(Graph|Store|Index|Queue|Cache|Router|Parser|Scanner)$'))"""
SUFFIXES = ("Graph", "Store", "Index", "Queue", "Cache", "Router", "Parser", "Scanner")


def _doc_symbols(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("no", "line"))
    s = t.select("doc_id", "no", F.explode(X.symbols(F.col("line"))).alias("sym"))
    return s.where(F.exists(F.array(*[F.lit(x) for x in SUFFIXES]), lambda x: F.endswith(F.col("sym"), x)))


@query(f"WITH {_SYM} SELECT sym, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM sy GROUP BY 1")
def symbol_mentions(spark, d):
    return _doc_symbols(spark, d).groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {_SYM}, s AS (SELECT DISTINCT doc_id, no, sym FROM sy) SELECT a.sym AS a, b.sym AS b, count(*) AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.no = b.no AND a.sym <> b.sym GROUP BY 1, 2")
def symbol_comention(spark, d):
    """Ordered pairs of different symbols of one line; formed inside the line's own array, so nothing is joined."""
    per = _doc_symbols(spark, d).groupBy("doc_id", "no").agg(F.collect_set("sym").alias("s")).where("size(s) > 1")
    pairs = F.filter(F.flatten(F.transform("s", lambda x: F.transform("s", lambda y: F.struct(x.alias("a"), y.alias("b"))))), lambda p: p["a"] != p["b"])
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, greatest(1, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')), lambda t: length(t) >= 2)) AS BIGINT)) AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark, d):
    """A text without tokens counts as one: itself, or the mark of an empty text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.embedding_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(r"SELECT item_id, CAST(len(list_filter(list_distinct(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*')), lambda t: length(t) >= 2 AND regexp_matches(t, '_|\.|^[A-Z]|.[A-Z]'))) AS BIGINT) AS n_code FROM eval_items")
def code_tokens(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.size(F.filter(X.ordered_tokens(F.col("item_text")), X.looks_like_code)).cast("bigint").alias("n_code"))


# DuckDB's patterns have no look-ahead: values that hold TEST in their leading word are marked before, and the mark taken out.
_TEST_MARK = r"""regexp_replace({0}, '(?i)((?:{1})\s*[:=]\s*[''"])([A-Za-z0-9_]*TEST)', '\1' || chr(1) || '\2', 'g')"""
_ADDED = r"""ad AS (SELECT change_id, no, line FROM (SELECT change_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM (SELECT change_id, {lines} AS l FROM patch_changes WHERE diff_snippet IS NOT NULL)) WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')),
      ht AS (SELECT change_id, no, coalesce(nullif(regexp_extract(x, 'AKIA[0-9A-Z]{{16}}'), ''), nullif(regexp_extract(x, 'ghp_[a-zA-Z0-9]{{36}}'), ''), nullif(regexp_extract(x, 'gho_[a-zA-Z0-9]{{36}}'), ''),
        nullif(regexp_extract(x, '-----BEGIN\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY'), ''), nullif(regexp_extract(x, 'xox[baprs]-[0-9a-zA-Z]{{10,48}}'), ''), nullif(regexp_extract(x, '(?i)EYJ[0-9A-ZA-Z_-]+\.[0-9A-ZA-Z_-]+\.[0-9A-ZA-Z_-]+'), ''),
        nullif(regexp_extract({mark}, '(?i)(?:api_key|access_token|secret_key|password)\s*[:=]\s*[''"][A-Za-z0-9_/-]{{16,}}[''"]'), '')) AS hit FROM (SELECT *, substr(line, 2) AS x FROM ad))""".format(
    lines=_sql_lines("diff_snippet"), mark=_TEST_MARK.format("x", "api_key|access_token|secret_key|password")
)


@query(f"WITH {_ADDED} SELECT change_id, substr(arg_min(hit, no), 1, 12) AS snippet FROM ht WHERE hit IS NOT NULL GROUP BY 1")
def secret_scan(spark, d):
    """The first secret in the added lines of each diff."""
    t = table(spark, d, "patch_changes").where("diff_snippet is not null").select("change_id", X.secret_in_diff(F.col("diff_snippet")).alias("snippet"))
    return t.where("snippet is not null")


_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'AKIA[0-9A-Z]{{16}}', 'AKIA[REDACTED_AWS_KEY]', 'g'), 'ghp_[a-zA-Z0-9]{{36}}', 'ghp_[REDACTED_GITHUB_TOKEN]', 'g'),
      'gho_[a-zA-Z0-9]{{36}}', 'gho_[REDACTED_OAUTH_TOKEN]', 'g'), 'nvapi-[a-zA-Z0-9_-]{{40,64}}', 'nvapi-[REDACTED_NIM_KEY]', 'g'),
      '-----BEGIN\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY[\s\S]+?-----END\s+(?:RSA|OPENSSH|EC|PGP|PRIVATE)\s+KEY-----', '[REDACTED_PRIVATE_KEY]', 'g'), '(?i)Bearer\s+[a-zA-Z0-9._-]+', 'Bearer [REDACTED_TOKEN]', 'g')""".format("new_content")
_REDACT = r"""replace(regexp_replace({0}, '(?i)(?:password|secret|api_key|access_token)\s*[:=]\s*[''"][A-Za-z0-9_/-]{{16,}}[''"]', 'secret=''[REDACTED]''', 'g'), chr(1), '')""".format(_TEST_MARK.format(_REDACT, "password|secret|api_key|access_token"))


@query(f"SELECT change_id, sha256({_REDACT}) AS h FROM patch_changes WHERE new_content IS NOT NULL")
def secret_redact(spark, d):
    return table(spark, d, "patch_changes").where("new_content is not null").select("change_id", F.sha2(X.redact(F.col("new_content")), 256).alias("h"))


@query(
    r"""SELECT change_id, sha256(regexp_replace(regexp_replace(regexp_replace(new_content, 'ghp_[a-zA-Z0-9]{36}', 'ghp_REDACTED', 'g'), 'gho_[a-zA-Z0-9]{36}', 'gho_REDACTED', 'g'), '(?i)Bearer\s+[a-zA-Z0-9._-]+', 'Bearer REDACTED', 'g')) AS h
      FROM patch_changes WHERE new_content IS NOT NULL"""
)
def log_sanitize(spark, d):
    return table(spark, d, "patch_changes").where("new_content is not null").select("change_id", F.sha2(X.redact(F.col("new_content"), X.LOG_REDACTIONS), 256).alias("h"))


@query(
    r"""SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)ignore\s+(?:all\s+)?(?:previous|system)\s+instructions') THEN 1 WHEN regexp_matches(text, '(?i)run\s+git\s+push\s+--force') THEN 2
      WHEN regexp_matches(text, '(?i)upload\s+(?:token|secret|credentials|repository)\s+to') THEN 3 WHEN regexp_matches(text, '(?i)delete\s+(?:repository|existing\s+branch|main)') THEN 4 WHEN regexp_matches(text, '(?i)exec\s*\(\s*[''"]') THEN 5
      WHEN regexp_matches(text, '(?i)os\.system\s*\(') THEN 6 ELSE 0 END AS pattern FROM (SELECT text FROM documents UNION ALL SELECT new_content FROM patch_changes UNION ALL SELECT source_code FROM evidence) WHERE text IS NOT NULL) GROUP BY 1"""
)
def injection_scan(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("text")) for t, c in (("documents", "text"), ("patch_changes", "new_content"), ("evidence", "source_code"))]
    t = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text is not null")
    return t.groupBy(F.coalesce(X.first_match(F.col("text"), X.INJECTIONS), F.lit(0)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT item_id, CASE WHEN regexp_matches(q, 'call|caller|callee') THEN 'call_flow' WHEN regexp_matches(q, 'inherit|extends|subclass') THEN 'inheritance' WHEN regexp_matches(q, 'import|depend|use') THEN 'dependency'
      WHEN regexp_matches(q, 'how|implement') THEN 'implementation' WHEN regexp_matches(q, 'explain|overview|architecture') THEN 'explanation' WHEN regexp_matches(q, 'bug|fix|error') THEN 'debugging' ELSE 'symbol_lookup' END AS intent
      FROM (SELECT item_id, lower(item_text) AS q FROM eval_items)"""
)
def intent_classify(spark, d):
    return table(spark, d, "eval_items").select("item_id", rules.by_words(F.col("item_text"), rules.INTENTS, "symbol_lookup").alias("intent"))


_QUERY_TYPE = """CASE WHEN regexp_matches(q, 'if i change|what breaks|impact|affected|modifying|change to|if we modify') THEN 'IMPACT_ANALYSIS'
      WHEN (regexp_matches(q, 'path from|path between|connect|reach|travel from') OR contains(q, ' to ') AND contains(q, 'how does')) AND NOT contains(q, 'architecture') AND NOT contains(q, 'endpoint') THEN 'PATH_FINDING'
      WHEN regexp_matches(q, 'depend|dependency|dependencies|imports of') AND NOT contains(q, 'who calls') THEN 'DEPENDENCY_ANALYSIS' WHEN regexp_matches(q, 'who calls|what calls|callers of|called by|which components call') THEN 'REVERSE_DEPENDENCY'
      WHEN regexp_matches(q, 'call trace|trace call|call chain|calls from|callees of') THEN 'CALL_TRACE' WHEN regexp_matches(q, 'architecture|architectural|flow from|endpoint to database|travel through the system|layer') THEN 'ARCHITECTURE_FLOW'
      WHEN regexp_matches(q, 'feature|implemented|where is|how is feature|system flow') THEN 'FEATURE_TRACE' ELSE 'CALL_TRACE' END"""


@query(f"SELECT item_id, {_QUERY_TYPE} AS query_type FROM (SELECT item_id, lower(item_text) AS q FROM eval_items)")
def query_type_classify(spark, d):
    return table(spark, d, "eval_items").select("item_id", rules.query_type(F.col("item_text")).alias("query_type"))


@query(r"SELECT file_id, CASE WHEN path IS NULL OR path = '' THEN 'empty' WHEN contains(path, '../') OR contains(path, '..\') OR starts_with(path, '..') THEN 'traversal' WHEN starts_with(path, '/') OR substr(path, 2, 1) = ':' THEN 'absolute' ELSE 'ok' END AS problem FROM source_files")
def path_safety(spark, d):
    return table(spark, d, "source_files").select("file_id", F.coalesce(rules.path_problem(F.col("path")), F.lit("ok")).alias("problem"))


# -- patches, drift and versions (A25, P16, O5, O8, J17, J18, J21) ----------------------------------------------------
@query(r"SELECT change_id, CAST(len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS BIGINT) AS n_added, CAST(len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS BIGINT) AS n_removed FROM (SELECT change_id, string_split(diff_snippet, chr(10)) AS l FROM patch_changes WHERE diff_snippet IS NOT NULL)")
def diff_stats(spark, d):
    ls = F.split("diff_snippet", "\n")
    n = lambda c: F.size(F.filter(ls, lambda x: x.startswith(c) & ~x.startswith(c * 3))).cast("bigint")
    return table(spark, d, "patch_changes").where("diff_snippet is not null").select("change_id", n("+").alias("n_added"), n("-").alias("n_removed"))


@query(
    r"""WITH p AS (SELECT patch_id, file_path, regexp_extract_all(coalesce(new_content, ''), '(?:class|def|function)\s+([A-Za-z_]\w*)', 1) AS names, lower(concat_ws(' ', file_path, operation_type, new_content)) AS x FROM patch_changes),
      r AS (SELECT patch_id, count(DISTINCT file_path) AS n_files, count(*) AS n_changes, coalesce(bool_or(regexp_matches(x, '\bdrop\s+(table|database|schema|view|index)\b|\btruncate\s+(table|\w+)\b|\balter\s+(table|database)\b|\bdelete\s+from\b|\bdatabase\s+migration\b|\bdrop\s+table\b')
        OR regexp_matches(x, 'migration|schema|database|sql|table')), false) AS bad FROM p GROUP BY 1),
      e AS (SELECT patch_id, count(DISTINCT n) AS n_entities FROM (SELECT patch_id, unnest(names) AS n FROM p) GROUP BY 1)
      SELECT patch_id, n_files, n_changes, coalesce(n_entities, 0) AS n_entities, CASE WHEN bad THEN 'BLOCKED' WHEN n_files > 3 OR coalesce(n_entities, 0) > 5 THEN 'HIGH' WHEN n_files >= 2 OR coalesce(n_entities, 0) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r LEFT JOIN e USING (patch_id)"""
)
def patch_scope(spark, d):
    """Risk of a patch by its texts, files and the names it defines; each change is judged on its own row before the aggregate."""
    t = table(spark, d, "patch_changes")
    names = F.regexp_extract_all(F.coalesce("new_content", F.lit("")), F.lit(r"(?:class|def|function)\s+([A-Za-z_]\w*)"), F.lit(1))
    x = F.concat_ws(" ", "file_path", "operation_type", "new_content")
    g = t.groupBy("patch_id").agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_changes"), F.bool_or(rules.risk_level(x, F.lit(0), F.lit(0)) == "BLOCKED").alias("bad"))
    e = t.select("patch_id", F.explode(names).alias("n")).groupBy("patch_id").agg(F.countDistinct("n").alias("n_entities"))
    j = g.join(e, "patch_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)).cast("bigint"))
    return j.select("patch_id", "n_files", "n_changes", "n_entities", F.when(F.col("bad"), "BLOCKED").otherwise(rules.risk_level(F.lit(""), F.col("n_files"), F.col("n_entities"))).alias("risk"))


@query("SELECT DISTINCT p.repository_id, p.file_path FROM patch_changes p WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repository_id = p.repository_id AND s.path = p.file_path)")
def patch_outside_plan(spark, d):
    s = table(spark, d, "source_files").select("repository_id", F.col("path").alias("file_path"))
    return table(spark, d, "patch_changes").select("repository_id", "file_path").distinct().join(s, ["repository_id", "file_path"], "left_anti")


_VER = """ver AS (SELECT repository_id, id, max_by(coalesce(qualified_name, name) || '#' || coalesce(start_line, -1) || '-' || coalesce(end_line, -1), node_no) AS body FROM nodes WHERE first_seen_at <= {t} AND (deleted_at IS NULL OR deleted_at > {t}) GROUP BY 1, 2)"""
T1, T2 = "TIMESTAMP '2025-04-01 00:00:00'", "TIMESTAMP '2025-09-01 00:00:00'"


def _version(spark, d, t):
    at = F.lit(t).cast("timestamp_ntz")
    body = F.concat(F.coalesce("qualified_name", "name"), F.lit("#"), F.coalesce("start_line", F.lit(-1)).cast("string"), F.lit("-"), F.coalesce("end_line", F.lit(-1)).cast("string"))
    n = table(spark, d, "nodes").where((F.col("first_seen_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at)))
    return n.groupBy("repository_id", "id").agg(F.max_by(body, "node_no").alias("body"))


@query(f"WITH a AS (WITH {_VER.format(t=T1)} SELECT * FROM ver), b AS (WITH {_VER.format(t=T2)} SELECT * FROM ver) SELECT coalesce(a.repository_id, b.repository_id) AS repository_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.repository_id = b.repository_id AND a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.body <> b.body")
def version_diff(spark, d):
    """Nodes live at two times, compared by one full outer join."""
    a, b = _version(spark, d, "2025-04-01 00:00:00").withColumnRenamed("body", "a"), _version(spark, d, "2025-09-01 00:00:00").withColumnRenamed("body", "b")
    j = a.join(b, ["repository_id", "id"], "full_outer").where("a is null or b is null or a <> b")
    return j.select("repository_id", "id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


_DRIFT = f"""WITH {_GRAPH}, {_SYM}, s AS (SELECT DISTINCT d.repository_id, sy.doc_id, no, sym FROM sy JOIN documents d USING (doc_id)),
      doc AS (SELECT DISTINCT a.repository_id, a.sym AS src, b.sym AS dst FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.no = b.no AND a.sym < b.sym),
      code AS (SELECT DISTINCT ge.repository_id, lower(x.name) AS src, lower(y.name) AS dst FROM ge JOIN ln x ON x.repository_id = ge.repository_id AND x.cid = src JOIN ln y ON y.repository_id = ge.repository_id AND y.cid = dst WHERE rel IN ('CALLS','INHERITS'))
      SELECT repository_id, src, dst, CASE WHEN EXISTS (SELECT 1 FROM code c WHERE c.repository_id = doc.repository_id AND c.src = lower(doc.src) AND c.dst = lower(doc.dst)) THEN 'MATCH'
        WHEN EXISTS (SELECT 1 FROM code c WHERE c.repository_id = doc.repository_id AND c.src = lower(doc.src)) THEN 'CONFLICT' ELSE 'MISSING' END AS status FROM doc"""


@query(_DRIFT)
def doc_drift(spark, d):
    """Relations that documents state against relations of the code: found, contradicted, or unknown."""
    n, e = graph_of(spark, d)
    name = n.select("repository_id", "id", F.lower("name").alias("nm"))
    code = e.where("rel in ('CALLS', 'INHERITS')").join(name.select("repository_id", F.col("id").alias("src"), F.col("nm").alias("ks")), ["repository_id", "src"]).join(name.select("repository_id", F.col("id").alias("dst"), F.col("nm").alias("kd")), ["repository_id", "dst"]).select("repository_id", "ks", "kd").distinct()
    s = _doc_symbols(spark, d).groupBy("doc_id", "no").agg(F.array_sort(F.collect_set("sym")).alias("s")).where("size(s) > 1")
    pairs = F.filter(F.flatten(F.transform("s", lambda x: F.transform("s", lambda y: F.struct(x.alias("src"), y.alias("dst"))))), lambda p: p["src"] < p["dst"])
    doc = s.select("doc_id", F.explode(pairs).alias("p")).join(table(spark, d, "documents").select("doc_id", "repository_id"), "doc_id").select("repository_id", "p.src", "p.dst").distinct()
    doc = doc.withColumn("ks", F.lower("src")).withColumn("kd", F.lower("dst"))
    j = doc.join(code.withColumn("m", F.lit(1)), ["repository_id", "ks", "kd"], "left").join(code.select("repository_id", "ks").distinct().withColumn("c", F.lit(1)), ["repository_id", "ks"], "left")
    return j.select("repository_id", "src", "dst", F.when(F.col("m") == 1, "MATCH").when(F.col("c") == 1, "CONFLICT").otherwise("MISSING").alias("status"))


@query(f"WITH {_NODES}, {_SYM}, s AS (SELECT DISTINCT repository_id, sym FROM sy JOIN documents USING (doc_id)), k AS (SELECT repository_id, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS nm, min(cid) AS id FROM ln WHERE label = 'Class' GROUP BY 1, 2) SELECT s.repository_id, sym, k.id FROM s JOIN k ON k.repository_id = s.repository_id AND k.nm = lower(regexp_replace(sym, '[^A-Za-z0-9]', '', 'g'))")
def symbol_map(spark, d):
    norm = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    s = _doc_symbols(spark, d).join(table(spark, d, "documents").select("doc_id", "repository_id"), "doc_id").select("repository_id", "sym").distinct().withColumn("nm", norm("sym"))
    k = nodes_of(spark, d).where("label = 'Class'").groupBy("repository_id", norm("name").alias("nm")).agg(F.min("id").alias("id"))
    return s.join(k, ["repository_id", "nm"]).select("repository_id", "sym", "id")


# -- events: spans, latencies, transitions, budgets (A10-A15, A23, A24, F20-F22, F26, W6-W8, W10, W11, M36) -----------
@query("SELECT user_id, count(*) AS n_spans, round(sum(value), 4) AS total, CASE WHEN bool_or(event_type = 'error') THEN 'ERROR' ELSE 'OK' END AS status FROM events GROUP BY 1")
def trace_summary(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_spans"), F.round(F.sum("value"), 4).alias("total"), F.when(F.bool_or(F.col("event_type") == "error"), "ERROR").otherwise("OK").alias("status"))


@query("SELECT user_id, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def trace_components(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(quantile_cont(value, 0.5), 6) AS i50, round(quantile_cont(value, 0.95), 6) AS i95,
      list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS r95 FROM events WHERE value IS NOT NULL GROUP BY 1"""
)
def latency_percentiles(spark, d):
    """Nearest-rank, interpolated and rounded-index percentiles side by side, all read off one distributed rank."""
    e = table(spark, d, "events").where("value is not null").select("event_type", "value")
    wanted = {"p50": ("disc", 0.5), "p95": ("disc", 0.95), "p99": ("disc", 0.99), "i50": ("cont", 0.5), "i95": ("cont", 0.95), "r95": ("index", 0.95)}
    got = M.percentiles(e, "event_type", "value", wanted)
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return mean.join(got, "event_type").select("event_type", "mean", "p50", "p95", "p99", F.round("i50", 6).alias("i50"), F.round("i95", 6).alias("i95"), "r95")


@query("SELECT event_type, n, k, round(CASE WHEN n = 0 THEN 0 ELSE greatest((p + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n), 0) END, 6) AS low, round(CASE WHEN n = 0 THEN 0 ELSE least((p + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n), 1) END, 6) AS high FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS k, CAST(count(*) FILTER (value > 10) AS DOUBLE) / count(*) AS p, CAST(1.96 * 1.96 AS DOUBLE) AS z2 FROM events GROUP BY 1)")
def wilson_ci(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_LAG = "lg AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"


@query(f"WITH {_LAG} SELECT prev AS from_state, event_type AS to_state, count(*) AS n FROM lg WHERE prev IS NOT NULL GROUP BY 1, 2")
def state_transitions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("event_type", F.lag("event_type").over(w).alias("prev"))
    return t.where("prev is not null").groupBy(F.col("prev").alias("from_state"), F.col("event_type").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n_stops FROM (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS s, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE s = 3 AND c = 3 GROUP BY 1")
def empty_run_stop(spark, d):
    """Places where three results in a row failed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    t = table(spark, d, "events").select("user_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("s"))
    return t.where("s = 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_stops"))


@query("SELECT user_id, min(event_id) FILTER (used > 200) AS first_over, count(*) FILTER (used > 200) AS n_over FROM (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) GROUP BY 1 HAVING count(*) FILTER (used > 200) > 0")
def running_budget(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "events").select("user_id", "event_id", F.sum("value").over(w).alias("used")).where("used > 200")
    return t.groupBy("user_id").agg(F.min("event_id").alias("first_over"), F.count(F.lit(1)).alias("n_over"))


@query("SELECT event_id, sum(CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS slots FROM events")
def concurrency_slots(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type").isin("signup", "click"), 1).when(F.col("event_type").isin("purchase", "error"), -1).otherwise(0)
    return table(spark, d, "events").select("event_id", F.sum(step).over(w).cast("bigint").alias("slots"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 25")
def recent_traces(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 25").drop("rn")


@query("SELECT event_id, lower(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def event_normalize(spark, d):
    return table(spark, d, "events").select("event_id", F.lower("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


_FAIL = r"""fl AS (SELECT doc_id, CASE WHEN regexp_matches(m, rx) THEN trim(regexp_extract(m, rx, 1)) ELSE 'test' END AS test_file, CASE WHEN regexp_matches(m, rx) THEN trim(regexp_extract(m, rx, 2)) ELSE 'test_execution' END AS test_name,
      CASE WHEN regexp_matches(m, rx) THEN trim(regexp_extract(m, rx, 3)) WHEN contains(m, ':') THEN trim(split_part(m, ':', 1)) ELSE 'UNKNOWN' END AS error_type,
      CASE WHEN regexp_matches(m, rx) THEN trim(regexp_extract(m, rx, 4)) WHEN contains(m, ':') THEN trim(substr(m, strpos(m, ':') + 1)) ELSE m END AS message, m
      FROM (SELECT doc_id, '(?:FAILED\s+)?([^\s:]+(?:\.py)?)::([^\s\-]+)\s*-\s*([A-Za-z0-9_]+):\s*(.*)' AS rx, unnest(regexp_extract_all(text, '(?:FAILED [^\s:]+::[^\s]+ - \w+: [^\n]*|\w*(?:Error|Exception)\b:? ?[^\n.]*)')) AS m FROM documents WHERE text IS NOT NULL))"""


def _failures(spark, d):
    """Failure lines and named errors in documents, one row each."""
    rx = r"(?:FAILED [^\s:]+::[^\s]+ - \w+: [^\n]*|\w*(?:Error|Exception)\b:? ?[^\n.]*)"
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("m"))
    return t.select("doc_id", X.failure_record(F.col("m")).alias("r"), "m").select("doc_id", "r.*", "m")


_FAILURE_KIND = """CASE WHEN regexp_matches(x, 'syntaxerror|indentationerror|invalid syntax') THEN 'SYNTAX_ERROR' WHEN regexp_matches(x, 'importerror|modulenotfounderror|no module named') THEN 'IMPORT_ERROR' WHEN contains(x, 'typeerror') THEN 'TYPE_ERROR'
      WHEN regexp_matches(x, 'assertionerror|assert') THEN 'ASSERTION_FAILURE' WHEN regexp_matches(x, 'timeout|timed out') THEN 'TEST_TIMEOUT' WHEN regexp_matches(x, 'attributeerror|nameerror|has no attribute|is not defined') THEN 'MISSING_SYMBOL'
      WHEN regexp_matches(x, 'patch application|patch failed|patch file') THEN 'PATCH_APPLICATION_FAILURE' WHEN regexp_matches(x, 'regression|baseline') THEN 'REGRESSION' WHEN regexp_matches(x, 'environment|no pytest') THEN 'ENVIRONMENT_FAILURE'
      WHEN regexp_matches(x, 'keyerror|valueerror|indexerror|runtimeerror') THEN 'RUNTIME_ERROR' ELSE 'UNKNOWN' END"""


@query(f"WITH {_FAIL} SELECT doc_id, test_file, test_name, error_type, message, {_FAILURE_KIND} AS kind FROM (SELECT *, lower(error_type || ' ' || message || ' ' || m) AS x FROM fl)")
def failure_classify(spark, d):
    f = _failures(spark, d)
    return f.select("doc_id", "test_file", "test_name", "error_type", "message", rules.by_words(F.concat_ws(" ", "error_type", "message", "m"), rules.FAILURES, "UNKNOWN").alias("kind"))


@query(f"WITH {_FAIL}, k AS (SELECT doc_id, test_name || '|' || error_type || '|' || lower(message) AS x FROM fl) SELECT doc_id, substr(sha256(string_agg(x, ';' ORDER BY x)), 1, 16) AS fingerprint FROM k GROUP BY 1")
def fingerprint(spark, d):
    one = F.concat_ws("|", "test_name", "error_type", F.lower("message"))
    g = _failures(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("f"))
    return g.select("doc_id", F.substring(F.sha2(F.array_join("f", ";"), 256), 1, 16).alias("fingerprint"))


@query(f"WITH {_FAIL} SELECT test_name, error_type, message, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM fl GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeat_detect(spark, d):
    return _failures(spark, d).groupBy("test_name", "error_type", "message").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


@query(
    """WITH m AS (SELECT 'recall' AS metric, avg(value) AS now FROM events WHERE event_type = 'click' UNION ALL SELECT 'latency', avg(value) FROM events WHERE event_type = 'view'),
      b(metric, was, worse_if) AS (VALUES ('recall', 12.0, 'below'), ('latency', 8.0, 'above'))
      SELECT metric, CASE WHEN worse_if = 'above' AND now > 1.5 * was OR worse_if = 'below' AND now < 0.95 * was THEN 'FAIL' ELSE 'PASS' END AS verdict FROM m JOIN b USING (metric)"""
)
def regression_gate(spark, d):
    e = table(spark, d, "events")
    now = e.groupBy().agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("recall"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("latency"))
    now = now.selectExpr("stack(2, 'recall', recall, 'latency', latency) as (metric, now)")
    base = spark.createDataFrame([("recall", 12.0, "below"), ("latency", 8.0, "above")], "metric string, was double, worse_if string")
    bad = (F.col("worse_if") == "above") & (F.col("now") > 1.5 * F.col("was")) | (F.col("worse_if") == "below") & (F.col("now") < 0.95 * F.col("was"))
    return now.join(base, "metric").select("metric", F.when(bad, "FAIL").otherwise("PASS").alias("verdict"))


@query("SELECT repository_id, round(coalesce(sum(CASE WHEN has_syntax_errors THEN 1 ELSE 0 END)::DOUBLE / nullif(count(has_syntax_errors), 0), 1.0), 6) AS rate FROM source_files GROUP BY 1")
def recovery_rate(spark, d):
    """A ratio that is 1 where nothing was tried."""
    g = table(spark, d, "source_files").groupBy("repository_id").agg(F.count_if("has_syntax_errors").alias("a"), F.count("has_syntax_errors").alias("b"))
    return g.select("repository_id", F.round(F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")), F.lit(1.0)), 6).alias("rate"))


# -- parsing, resolution and embedding (U1-U11, J3, J4, E1-E3) --------------------------------------------------------
def _parsed(spark, d):
    from graphloom.sources import parsing

    return materialize(parsing.parsed(table(spark, d, "source_files")), "parsed")


@query()
def parsed_entities(spark, d):
    r = _parsed(spark, d).where("kind in ('class', 'function', 'method')")
    return r.select("repository_id", "path", "kind", "class_name", "name", "is_async", "returns", F.size("params").alias("n_params"), "start_line", "end_line")


@query()
def parsed_imports(spark, d):
    return _parsed(spark, d).where("kind = 'import'").select("repository_id", "path", F.col("expr").alias("module"), "name", "alias", "level", "start_line")


@query()
def parse_errors(spark, d):
    return _parsed(spark, d).where("kind = 'error'").select("repository_id", "path", "expr")


@query()
def resolved_calls(spark, d):
    from graphloom.sources import parsing

    return parsing.resolve_calls(_parsed(spark, d))


@query()
def resolved_bases(spark, d):
    from graphloom.sources import parsing

    return parsing.resolve_bases(_parsed(spark, d))


@query()
def code_chunks(spark, d):
    from graphloom.sources import parsing

    return parsing.chunks(_parsed(spark, d), table(spark, d, "source_files").where("path like '%.py'"))


@query()
def document_embeddings(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.embedding_tokens(F.col("text")).alias("tokens"))
    return R.embed(t, "doc_id", "tokens", 64)


@query()
def hybrid_retrieval(spark, d):
    """Items against evidence by embedding, and against the graph by seeds and one hop, fused by reciprocal rank."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), X.embedding_tokens(F.col("item_text")).alias("tokens"))
    ev = table(spark, d, "evidence").where("source_code is not null and qualified_name is not null")
    code = F.concat_ws("\n ", "qualified_name", "source_code")
    vecs = R.embed(ev.select("evidence_id", X.embedding_tokens(code).alias("tokens")), "evidence_id", "tokens", 64)
    top = R.cosine_topk(R.embed(items, "qid", "tokens", 64).select("qid", F.col("embedding").alias("qvec")), vecs.select(F.col("evidence_id").alias("vid"), F.col("embedding").alias("vec")), 10)
    v = top.join(ev.select(F.col("evidence_id").alias("vid"), F.concat_ws("|", "repository_id", "entity_id").alias("entity")), "vid").select("qid", "entity", "rank")
    g = graph_ranking(spark, d).where("rank <= 10").select("qid", F.concat_ws("|", "repository_id", "id").alias("entity"), "rank")
    return R.rrf(("vector", v), ("graph", g)).where("rank <= 10").select("qid", "entity", "score", "sources", big("rank"))


# -- streams (§2.10) --------------------------------------------------------------------------------------------------
def _stream(spark, d):
    from graphloom.streaming import events

    return events, events.event_stream(spark, d)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    ev, s = _stream(spark, d)
    return ev.run_updates(ev.windows(s), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    ev, s = _stream(spark, d)
    return ev.run_to_table(ev.without_duplicates(s)).select("event_id", "user_id", "event_type")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM k GROUP BY user_id, no"""
)
def stream_sessions(spark, d):
    ev, s = _stream(spark, d)
    return ev.run_complete(ev.sessions(s)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def stream_job_states(spark, d):
    ev, s = _stream(spark, d)
    return ev.run_to_table(ev.job_states(s))


@query("SELECT user_id, max_by(event_id, ts) AS event_id, max_by(event_type, ts) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, d):
    ev, s = _stream(spark, d)
    return ev.upsert_latest(s).select("user_id", "event_id", "event_type")
