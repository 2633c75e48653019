"""Planning, retrieval, evidence, change and metric operators on the project tables, each with its oracle statement where SQL
can state it (DuckDB dialect). Literals in the statements are written out, not taken from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.catalog import materialize, table
from graphloom.functions import rules
from graphloom.functions import text as X
from graphloom.operators import changes as C
from graphloom.operators import graphs as G
from graphloom.operators import metrics as M
from graphloom.operators import retrieval as R
from graphloom.plans import reference_queries as Q
from graphloom.plans.reference_queries import _FAIL, _GRAPH, _NODES, _QUERY_TYPE, _TOKENS, _TOP, _SECOND, _paths_sql, _sql_lines, big

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _items(spark, d):
    return table(spark, d, "eval_items")


# -- questions: words, entities and plans (F8-F12, T9, O4, E12, E13, G11, G12, T12, M8) ---------------------------------
_INTENT = """CASE WHEN regexp_matches(q, 'call|caller|callee') THEN 'call_flow' WHEN regexp_matches(q, 'inherit|extends|subclass') THEN 'inheritance' WHEN regexp_matches(q, 'import|depend|use') THEN 'dependency'
      WHEN regexp_matches(q, 'how|implement') THEN 'implementation' WHEN regexp_matches(q, 'explain|overview|architecture') THEN 'explanation' WHEN regexp_matches(q, 'bug|fix|error') THEN 'debugging' ELSE 'symbol_lookup' END"""


def _plan(intent):
    """The bounds of a retrieval by intent, below the hard maxima 20, 20, 2 and 30."""
    deep = intent.isin("call_flow", "inheritance", "dependency")
    k = F.when(intent == "symbol_lookup", 5).when(intent.isin("architecture", "explanation"), 15).otherwise(10)
    rel = F.create_map(*[F.lit(x) for kv in rules.RELATIONSHIPS for x in kv])[intent]
    return {
        "vector_k": F.least(k, F.lit(20)), "graph_k": F.least(k, F.lit(20)), "depth": F.least(F.when(deep, 2).otherwise(1), F.lit(2)),
        "max_context": F.least(F.when(intent.isin("architecture", "explanation"), 20).otherwise(15), F.lit(30)), "rel": F.coalesce(rel, F.lit("")),
    }


@query(
    f"""SELECT item_id, intent, CASE intent WHEN 'symbol_lookup' THEN 5 WHEN 'explanation' THEN 15 ELSE 10 END AS vector_k, CASE intent WHEN 'symbol_lookup' THEN 5 WHEN 'explanation' THEN 15 ELSE 10 END AS graph_k,
      CASE WHEN intent IN ('call_flow', 'inheritance', 'dependency') THEN 2 ELSE 1 END AS depth, CASE intent WHEN 'explanation' THEN 20 ELSE 15 END AS max_context,
      CASE intent WHEN 'call_flow' THEN 'CALLS' WHEN 'inheritance' THEN 'INHERITS' WHEN 'dependency' THEN 'IMPORTS' ELSE '' END AS rel FROM (SELECT item_id, {_INTENT} AS intent FROM (SELECT item_id, lower(item_text) AS q FROM eval_items))"""
)
def retrieval_plan(spark: SparkSession, d: str) -> DataFrame:
    intent = rules.by_words(F.col("item_text"), rules.INTENTS, "symbol_lookup")
    return _items(spark, d).select("item_id", intent.alias("intent")).select("item_id", "intent", *[c.alias(n) for n, c in _plan(F.col("intent")).items()])


@query(
    r"""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*')), lambda t: length(t) >= 2 AND lower(t) NOT IN ('who','what','where','how','why','does','is','a','an','the','in','from','and','or','to','for','with',
      'call','calls','calling','inherit','inherits','import','imports'))), ',') AS entities FROM eval_items"""
)
def question_entities(spark, d):
    return _items(spark, d).select("item_id", F.array_join(F.array_sort(X.words_but(F.col("item_text"), rules.INTENT_STOP_WORDS)), ",").alias("entities"))


_TARGETS = r"""tg AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS rn FROM (SELECT item_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT item_id, regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*') AS x FROM eval_items))
      WHERE length(t) >= 2 AND regexp_matches(t, '_|\.|^[A-Z]|.[A-Z]') AND lower(t) NOT IN ('who','what','where','how','why','does','is','a','an','the','in','from','and','or','to','for','with','call','calls','calling','inherit','inherits','import','imports','show','find','locate','defined','definition',
        'implemented','function','class','method','module','file','code','if','i','change','could','be','affected','trace','path','between','reach','eventually','components','system') GROUP BY item_id, t)"""


def _targets(text):
    return F.filter(X.words_but(text, rules.QUERY_STOP_WORDS), X.looks_like_code)


@query(
    f"""WITH {_TARGETS} SELECT item_id, query_type, a.t AS source_entity, b.t AS target_entity, CASE WHEN query_type IN ('REVERSE_DEPENDENCY', 'IMPACT_ANALYSIS') THEN 'incoming' WHEN query_type = 'DEPENDENCY_ANALYSIS' THEN 'both' ELSE 'outgoing' END AS direction,
      4 AS max_depth, 10 AS max_paths, 100 AS max_nodes FROM (SELECT item_id, {_QUERY_TYPE} AS query_type FROM (SELECT item_id, lower(item_text) AS q FROM eval_items))
      LEFT JOIN (SELECT * FROM tg WHERE rn = 1) a USING (item_id) LEFT JOIN (SELECT * FROM tg WHERE rn = 2) b USING (item_id)"""
)
def analysis_plan(spark, d, depth: int = 4, paths: int = 10, nodes: int = 100):
    """Kind of analysis, its two ends, direction and bounds (at most 8, 50 and 500)."""
    t = _items(spark, d).select("item_id", rules.query_type(F.col("item_text")).alias("query_type"), _targets(F.col("item_text")).alias("t"))
    direction = F.when(F.col("query_type").isin("REVERSE_DEPENDENCY", "IMPACT_ANALYSIS"), "incoming").when(F.col("query_type") == "DEPENDENCY_ANALYSIS", "both").otherwise("outgoing")
    return t.select("item_id", "query_type", F.get("t", F.lit(0)).alias("source_entity"), F.get("t", F.lit(1)).alias("target_entity"), direction.alias("direction"), F.lit(min(depth, 8)).alias("max_depth"), F.lit(min(paths, 50)).alias("max_paths"), F.lit(min(nodes, 500)).alias("max_nodes"))


@query(
    r"""WITH w AS (SELECT item_id, t, i, row_number() OVER (PARTITION BY item_id ORDER BY (CASE WHEN regexp_matches(t, '^[A-Z]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[._]') THEN 1 ELSE 0 END) DESC, i) AS rn
      FROM (SELECT item_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT item_id, regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*') AS x FROM eval_items)) WHERE length(t) > 2 AND lower(t) NOT IN ('what','where','show','find','locate','how','why','trace','display','investigate','identify','causes',
      'components','depend','dependencies','data','flow','details','system','method','class','file','module','script','entry','point','storage','does','when','with','from','into','after','before','fails','failing','fail','returns','raises','error','issue','problem','reason','impact','radius','blast','change','modifying',
      'modified','delete','deleted','remove','removed','all','which','that','this','there','their','authenticate','access','profile','lookup','creation','journey','handled','points','managed','check','implementation','records','database','invalid','parameters','direct','directly','instantiation'))
      SELECT item_id, max(t) FILTER (rn = 1) AS first, coalesce(max(t) FILTER (rn = 2), max(t) FILTER (rn = 1)) AS second FROM w GROUP BY 1"""
)
def question_words(spark, d):
    """The two words of a question that look most like names, in a stable order; repeats count."""
    stop = F.array(*[F.lit(w) for w in rules.QUESTION_STOP_WORDS])
    raw = F.filter(F.regexp_extract_all("item_text", F.lit(X.TOKEN), F.lit(0)), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, F.lower(t)))
    scored = F.array_sort(F.transform(raw, lambda t, i: F.struct((-(F.when(t.rlike("^[A-Z]"), 1).otherwise(0) + F.when(t.rlike("[._]"), 1).otherwise(0))).alias("s"), i.alias("i"), t.alias("t"))))
    t = _items(spark, d).select("item_id", scored.alias("w")).where("size(w) > 0")
    return t.select("item_id", F.col("w")[0]["t"].alias("first"), F.coalesce(F.get("w", F.lit(1))["t"], F.col("w")[0]["t"]).alias("second"))


@query(
    """SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_]*')), lambda t: length(t) >= 3 AND lower(t) NOT IN ('the','and','for','not','add','reject','invalid','values','value','arguments','argument','input','with','negative','validation',
      'age','table','users','drop','run','database'))), ',') AS candidates FROM eval_items"""
)
def change_candidates(spark, d):
    return _items(spark, d).select("item_id", F.array_join(F.array_sort(X.words_but(F.col("item_text"), rules.CHANGE_SKIP_WORDS, "[A-Za-z_][A-Za-z0-9_]*", 3)), ",").alias("candidates"))


@query(
    r"""SELECT item_id, array_to_string(list_sort(list_distinct(flatten(list_transform(t, lambda x: CASE WHEN contains(x, '.') THEN list_append(list_filter(string_split(x, '.'), lambda p: length(p) > 2), x) ELSE [x] END)))), ',') AS keywords
      FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: trim(lower(x), '.')), lambda x: length(x) > 2) AS t FROM eval_items)"""
)
def search_keywords(spark, d):
    return _items(spark, d).select("item_id", F.array_join(F.array_sort(X.keywords(F.col("item_text"))), ",").alias("keywords"))


@query(
    """SELECT item_id, CASE WHEN contains(q, 'auth') OR contains(q, 'login') THEN 'identity' WHEN contains(q, 'change') OR contains(q, 'impact') OR contains(q, 'modify') THEN 'downstream' ELSE 'dependency' END AS hypothesis,
      CASE WHEN contains(q, 'auth') OR contains(q, 'login') THEN 2 ELSE 1 END AS n FROM (SELECT item_id, lower(item_text) AS q FROM eval_items)"""
)
def first_hypotheses(spark, d):
    q = F.lower("item_text")
    who, what = q.contains("auth") | q.contains("login"), q.contains("change") | q.contains("impact") | q.contains("modify")
    return _items(spark, d).select("item_id", F.when(who, "identity").when(what, "downstream").otherwise("dependency").alias("hypothesis"), F.when(who, 2).otherwise(1).alias("n"))


@query(
    r"""SELECT src, gate, count(*) AS n FROM (SELECT src, CASE WHEN regexp_matches(q, '\bdrop\s+(table|database|schema|view|index)\b|\btruncate\s+(table|\w+)\b|\balter\s+(table|database)\b|\bdelete\s+from\b|\bdatabase\s+migration\b|\bdrop\s+table\b') OR regexp_matches(q, 'migration|schema|database|table') THEN 'BLOCKED'
      WHEN regexp_matches(q, 'non-existent|unknown|cloudformation|swift ios|machinelearning|ambiguous|redis|graphql') THEN 'ABSTAIN' ELSE 'OPEN' END AS gate FROM (SELECT 'item' AS src, lower(item_text) AS q FROM eval_items UNION ALL SELECT 'document', lower(text) FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2"""
)
def request_gates(spark, d):
    a = _items(spark, d).select(F.lit("item").alias("src"), F.col("item_text").alias("q"))
    b = table(spark, d, "documents").where("text is not null").select(F.lit("document").alias("src"), F.col("text").alias("q"))
    return a.unionByName(b).groupBy("src", rules.request_gate(F.col("q")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN contains(q, 'investigat') THEN 'INVESTIGATION' WHEN contains(q, 'evaluat') THEN 'EVALUATION' WHEN contains(q, 'repair') THEN 'REPAIR' ELSE 'INDEXING' END AS job_type FROM (SELECT doc_id, lower(text) AS q FROM documents WHERE text IS NOT NULL)")
def job_types(spark, d):
    kinds = (("INVESTIGATION", ("investigat",)), ("EVALUATION", ("evaluat",)), ("REPAIR", ("repair",)))
    return table(spark, d, "documents").where("text is not null").select("doc_id", rules.by_words(F.col("text"), kinds, "INDEXING").alias("job_type"))


# -- lookups (P3, P4, P10-P12, O1, J7, G9, T13, U13, W9) -----------------------------------------------------------------
@query(
    f"""WITH {_NODES}, t AS (SELECT DISTINCT repository_id, name AS e FROM imports WHERE name NOT IN ('', '*')),
      m AS (SELECT DISTINCT t.repository_id, e, label, ln.cid AS id FROM t JOIN ln ON ln.repository_id = t.repository_id AND ln.label IN ('Method', 'Class') AND (ln.name = e OR ends_with(ln.qualified_name, '.' || e)))
      SELECT repository_id, e AS entity, label, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, e, label ORDER BY id) AS rank FROM m) WHERE rank <= 10"""
)
def name_lookup(spark, d):
    """Methods and classes by name or qualified suffix, ten of each."""
    hit = Q.suffix_lookup(spark, d).join(Q.nodes_of(spark, d).where("label in ('Method', 'Class')").select("repository_id", "id", "label"), ["repository_id", "id"])
    w = Window.partitionBy("repository_id", "entity", "label").orderBy("id")
    return hit.select("repository_id", "entity", "label", "id", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 10")


@query(
    f"""WITH {_NODES}, t AS (SELECT DISTINCT repository_id, tok FROM (SELECT repository_id, qualified_name AS tok FROM evidence UNION ALL SELECT repository_id, regexp_extract(qualified_name, '[^.]+$') FROM evidence UNION ALL SELECT repository_id, regexp_extract(qualified_name, '[^_.]+$') FROM evidence) WHERE length(tok) >= 2),
      m AS (SELECT t.repository_id, tok, ln.cid AS id, CASE WHEN label IN ('Function', 'Method') AND (qualified_name = tok OR name = tok) THEN 1 WHEN label = 'Class' AND qualified_name = tok THEN 2 ELSE 3 END AS p FROM t JOIN ln ON ln.repository_id = t.repository_id
        AND (ln.cid = tok OR name = tok OR qualified_name = tok OR ends_with(qualified_name, '.' || tok) OR ends_with(name, tok)))
      SELECT repository_id, tok AS term, arg_min(id, (p, id)) AS id, min(p) AS priority FROM m GROUP BY 1, 2"""
)
def entity_resolution(spark, d):
    """A term to one node: exact function or method, exact class, then any exact or suffix match; ties by id.

    Suffixes of names and qualified names become keys, so nothing is compared pair by pair. A proper suffix of a name says no
    more than its least node, so names are split once each. Keys and terms meet in one grouping and not in a join: what
    ``explode`` makes of a table is estimated at the size of the table, and a join by estimate would broadcast all keys.
    """
    e = table(spark, d, "evidence")
    terms = None
    for c in (F.col("qualified_name"), F.regexp_extract("qualified_name", "[^.]+$", 0), F.regexp_extract("qualified_name", "[^_.]+$", 0)):
        t = e.select("repository_id", c.alias("term"))
        terms = t if terms is None else terms.unionByName(t)
    n = G.latest_nodes(table(spark, d, "nodes").select("node_no", "repository_id", "id", "label", "name", "qualified_name", "first_seen_at", "ingested_at", "deleted_at"))
    parts = F.split("qualified_name", r"\.")
    qual_ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.array_distinct(F.array_compact(F.concat(F.array("id", "name"), F.when(F.col("qualified_name").isNull(), F.array().cast("array<string>")).otherwise(qual_ends))))
    exact = (F.col("qualified_name") == F.col("term")) | (F.col("name") == F.col("term"))
    p = F.when(F.col("label").isin("Function", "Method") & exact, 1).when((F.col("label") == "Class") & (F.col("qualified_name") == F.col("term")), 2).otherwise(3)
    own = n.select("repository_id", "id", "label", "name", "qualified_name", F.explode(keys).alias("term")).select("repository_id", "term", F.struct(p.alias("p"), "id").alias("x"))
    names = n.where("length(name) > 2").groupBy("repository_id", "name").agg(F.min("id").alias("id"))
    name_ends = F.transform(F.sequence(F.lit(2), F.length("name") - 1), lambda i: F.substr(F.col("name"), i))
    ends = names.select("repository_id", F.explode(name_ends).alias("term"), F.struct(F.lit(3).alias("p"), "id").alias("x"))
    asked = terms.select("repository_id", "term", F.lit(None).cast("struct<p:int,id:string>").alias("x"), F.lit(True).alias("asked"))
    met = own.unionByName(ends).withColumn("asked", F.lit(False)).unionByName(asked).where("length(term) >= 2")
    out = met.groupBy("repository_id", "term").agg(F.min("x").alias("x"), F.max("asked").alias("asked")).where("asked and x is not null")
    return out.select("repository_id", "term", "x.id", F.col("x.p").alias("priority"))


@query(
    f"""WITH l AS (SELECT evidence_id, sym, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS no FROM (SELECT evidence_id, regexp_extract(qualified_name, '[^.]+$') AS sym, {_sql_lines('source_code')} AS x FROM evidence WHERE source_code IS NOT NULL AND qualified_name IS NOT NULL)),
      h AS (SELECT evidence_id, no, line, contains(line, 'import') OR contains(line, 'class ') OR contains(line, 'def ') OR contains(line, '(') AS dep, contains(line, '(') OR contains(line, 'def ') AS flow FROM l WHERE contains(line, sym))
      SELECT evidence_id, array_to_string(list(no ORDER BY no)[1:10], ',') AS lines, least(20, count(*) FILTER (dep)) AS n_dependency, least(15, count(*) FILTER (flow)) AS n_flow FROM h GROUP BY 1"""
)
def symbol_lines(spark, d):
    """Lines that hold a symbol: the first ten, how many of them depend on it (20 at most) and call it (15 at most)."""
    sym = F.regexp_extract("qualified_name", "[^.]+$", 0)
    ls = F.filter(F.transform(X.lines(F.col("source_code")), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda s: s["line"].contains(F.col("sym")))
    t = table(spark, d, "evidence").where("source_code is not null and qualified_name is not null").select("evidence_id", "source_code", sym.alias("sym")).select("evidence_id", ls.alias("h")).where("size(h) > 0")
    dep = lambda s: s["line"].contains("import") | s["line"].contains("class ") | s["line"].contains("def ") | s["line"].contains("(")
    flow = lambda s: s["line"].contains("(") | s["line"].contains("def ")
    return t.select(
        "evidence_id", F.array_join(F.transform(F.slice("h", 1, 10), lambda s: s["no"].cast("string")), ",").alias("lines"),
        F.least(F.size(F.filter("h", dep)), F.lit(20)).cast("bigint").alias("n_dependency"), F.least(F.size(F.filter("h", flow)), F.lit(15)).cast("bigint").alias("n_flow"),
    )


@query("SELECT t.trace_id, CASE WHEN count(e.event_id) > 0 THEN 'OK' ELSE 'NOT_FOUND' END AS status, count(e.event_id) AS n_spans FROM (SELECT DISTINCT query_id * 3 AS trace_id FROM evidence) t LEFT JOIN events e ON e.user_id = t.trace_id GROUP BY 1")
def trace_status(spark, d):
    """Spans of the traces that are asked for; a trace without spans is NOT_FOUND."""
    asked = table(spark, d, "evidence").select((F.col("query_id") * 3).alias("trace_id")).distinct()
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("trace_id")).agg(F.count(F.lit(1)).alias("n_spans"))
    j = asked.join(n, "trace_id", "left")
    return j.select("trace_id", F.when(F.col("n_spans").isNotNull(), "OK").otherwise("NOT_FOUND").alias("status"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


@query("SELECT repository_id, change_id, row_number() OVER (PARTITION BY repository_id ORDER BY created_at, change_id) AS position FROM patch_changes WHERE new_content IS NULL OR new_content = ''")
def job_queue(spark, d):
    """Pending work per repository, first in, first out."""
    w = Window.partitionBy("repository_id").orderBy("created_at", "change_id")
    return table(spark, d, "patch_changes").where("new_content is null or new_content = ''").select("repository_id", "change_id", F.row_number().over(w).cast("bigint").alias("position"))


@query(f"WITH {_NODES}, x AS (SELECT repository_id, cid, name FROM ln WHERE label = 'Function' UNION SELECT repository_id, cid, name FROM ln WHERE label = 'Method') SELECT repository_id, name, count(*) AS n, min(cid) AS first_id FROM x GROUP BY 1, 2")
def callables_by_name(spark, d):
    """The distinct union of functions and methods, by name."""
    n = Q.nodes_of(spark, d)
    both = n.where("label = 'Function'").select("repository_id", "id", "name").union(n.where("label = 'Method'").select("repository_id", "id", "name")).distinct()
    return both.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(
    f"""WITH {_NODES}, k AS (SELECT repository_id, cid AS id, {Q._LAYER} AS layer FROM (SELECT *, lower(concat_ws(' ', name, qualified_name, file_path)) AS x FROM ln)) SELECT repository_id, layer, id, row_number() OVER (PARTITION BY repository_id, layer ORDER BY id) AS rank FROM k"""
)
def architecture_layers(spark, d):
    """The components of each layer in order."""
    w = Window.partitionBy("repository_id", "layer").orderBy("id")
    return Q.layer_classify(spark, d).select("repository_id", "layer", "id", F.row_number().over(w).cast("bigint").alias("rank"))


@query(f"WITH {_NODES}, c AS (SELECT repository_id, module_name || ':' || split_part(cid, ':', 3) AS class, count(*) AS n FROM ln WHERE label = 'Method' GROUP BY 1, 2) SELECT repository_id, arg_max(class, (n, class)) AS class, max(n) AS n_methods FROM c WHERE class IS NOT NULL GROUP BY 1")
def largest_class(spark, d):
    c = Q.nodes_of(spark, d).where("label = 'Method'").groupBy("repository_id", F.concat(F.col("module_name"), F.lit(":"), F.element_at(F.split("id", ":"), 3)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.where("class is not null").groupBy("repository_id").agg(F.max(F.struct("n", "class")).alias("x")).select("repository_id", "x.class", F.col("x.n").alias("n_methods"))


@query(
    rf"""WITH l AS (SELECT evidence_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM (SELECT evidence_id, {_sql_lines('source_code')} AS x FROM evidence WHERE source_code IS NOT NULL)),
      s AS (SELECT evidence_id, no, nullif(regexp_extract(line, '^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS cls, nullif(regexp_extract(line, '^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS fn FROM l)
      SELECT evidence_id, no, last_value(cls IGNORE NULLS) OVER (PARTITION BY evidence_id ORDER BY no) AS class_name, fn AS name FROM s QUALIFY fn IS NOT NULL"""
)
def definition_lines(spark, d):
    """Definitions by line, with the class line seen last; a fold over one text's own lines, without a window over the corpus."""
    ls = X.lines(F.col("source_code"))
    cls, fn = (lambda x: F.regexp_extract(x, r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)", 1)), (lambda x: F.regexp_extract(x, r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)", 1))
    start = F.struct(F.lit(None).cast("string").alias("cls"), F.lit(-1).alias("no"), F.array().cast("array<struct<no:int,class_name:string,name:string>>").alias("found"))

    def step(acc, x):
        now = F.coalesce(F.nullif(cls(x), F.lit("")), acc["cls"])
        no = acc["no"] + 1
        return F.struct(now.alias("cls"), no.alias("no"), F.when(fn(x) != "", F.array_append(acc["found"], F.struct(no.alias("no"), now.alias("class_name"), fn(x).alias("name")))).otherwise(acc["found"]).alias("found"))

    t = table(spark, d, "evidence").where("source_code is not null").select("evidence_id", F.explode(F.aggregate(ls, start, step)["found"]).alias("f"))
    return t.select("evidence_id", F.col("f.no").cast("bigint").alias("no"), "f.class_name", "f.name")


# -- retrieval to answer (E6, E9, E11, E13-E16, A6-A9, J13-J15, O3, F47-F49, G13, G14, T11) --------------------------------
_HOPS = f"""{_GRAPH}, {_TOKENS}, u AS (SELECT repository_id, src AS a, rel, dst AS b FROM ge WHERE rel IN ('CALLS','DEFINES','IMPORTS','INHERITS') UNION SELECT repository_id, dst, rel, src FROM ge WHERE rel IN ('CALLS','DEFINES','IMPORTS','INHERITS')),
      h1 AS (SELECT qid, s.repository_id, u.b AS id, min(u.a || '->' || u.rel || '->' || u.b) AS path FROM sd s JOIN u ON u.repository_id = s.repository_id AND u.a = s.id GROUP BY 1, 2, 3),
      h2 AS (SELECT qid, s.repository_id, u.b AS id, min(u.a || '->' || u.rel || '->' || u.b) AS path FROM h1 s JOIN u ON u.repository_id = s.repository_id AND u.a = s.id GROUP BY 1, 2, 3),
      al AS (SELECT qid, sd.repository_id, sd.id, score, 'seed:' || label AS path FROM sd JOIN ln ON ln.repository_id = sd.repository_id AND ln.cid = sd.id UNION ALL SELECT qid, repository_id, id, 0.5, path FROM h1 UNION ALL SELECT qid, repository_id, id, 0.3, path FROM h2),
      g2 AS (SELECT qid, repository_id, id, max(score)::DOUBLE AS score, arg_min(path, (-score, path)) AS path FROM al GROUP BY 1, 2, 3)"""


def graph_ranking_2hop(spark, d):
    """(qid, repository_id, id, score, path, rank): seeds, their neighbours at 0.5 and the neighbours of those at 0.3; a node keeps
    its best score, with the least path among those that give it."""
    n, e = Q.graph_of(spark, d)
    s = materialize(Q.item_seeds(spark, d, n), "seeds")
    e = e.where(F.col("rel").isin(*G.EXPAND))
    both = e.select("repository_id", F.col("src").alias("id"), "rel", F.col("dst").alias("nxt")).unionByName(e.select("repository_id", F.col("dst").alias("id"), "rel", F.col("src").alias("nxt"))).distinct()
    out = s.join(n.select("repository_id", "id", "label"), ["repository_id", "id"]).select("qid", "repository_id", "id", "score", F.concat(F.lit("seed:"), "label").alias("path"))
    front = s.select("qid", "repository_id", "id")
    for score in (0.5, 0.3):
        path = F.concat_ws("->", "id", "rel", "nxt")
        front = materialize(front.join(both, ["repository_id", "id"]).groupBy("qid", "repository_id", F.col("nxt").alias("id")).agg(F.min(path).alias("path")), "hop")
        out = out.unionByName(front.withColumn("score", F.lit(score)).select("qid", "repository_id", "id", "score", "path"))
        front = front.drop("path")
    best = out.groupBy("qid", "repository_id", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("x")).select("qid", "repository_id", "id", (-F.col("x.s")).alias("score"), "x.path")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "repository_id", "id")))


@query(f"WITH {_HOPS} SELECT qid, repository_id, id, score, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, repository_id, id) AS rank FROM g2) WHERE rank <= 10")
def graph_retrieval_2hop(spark, d):
    return graph_ranking_2hop(spark, d).where("rank <= 10").select("qid", "repository_id", "id", "score", "path", big("rank"))


@query(
    f"""WITH {_NODES}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC NULLS LAST, evidence_id) AS rn FROM evidence)
      SELECT query_id, evidence_id, rn AS position, coalesce(nullif(e.file_path, ''), n.file_path, '') AS file_path, coalesce(nullif(e.qualified_name, ''), n.qualified_name, e.entity_id) AS qualified_name, coalesce(e.start_line, n.start_line, 0) AS start_line, coalesce(e.end_line, n.end_line, 0) AS end_line
      FROM e LEFT JOIN ln n ON n.repository_id = e.repository_id AND n.cid = e.entity_id WHERE rn <= 10"""
)
def context_items(spark, d):
    """The ten best results of a query with what they bring themselves, else what is stored of their node."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("retrieval_score"), "evidence_id")
    e = table(spark, d, "evidence").withColumn("position", F.row_number().over(w)).where("position <= 10")
    n = Q.nodes_of(spark, d).select("repository_id", F.col("id").alias("entity_id"), *[F.col(c).alias("n_" + c) for c in ("file_path", "qualified_name", "start_line", "end_line")])
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    return e.join(n, ["repository_id", "entity_id"], "left").select(
        "query_id", "evidence_id", big("position"), F.coalesce(own("file_path"), "n_file_path", F.lit("")).alias("file_path"), F.coalesce(own("qualified_name"), "n_qualified_name", "entity_id").alias("qualified_name"),
        F.coalesce("start_line", "n_start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", "n_end_line", F.lit(0)).alias("end_line"),
    )


_EVIDENCE = f"""WITH RECURSIVE {_HOPS}, fu AS (SELECT qid, repository_id, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, repository_id, id) AS rank FROM g2),
      ch AS (SELECT repository_id, entity_id AS id, arg_min(length(source_code), evidence_id) AS n FROM evidence WHERE source_code IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT qid, f.repository_id, f.id, n, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, rank) AS o FROM fu f JOIN ch ON ch.repository_id = f.repository_id AND ch.id = f.id),
      p(qid, o, used, taken, repository_id, id, ok) AS (SELECT qid, o, n, 1, repository_id, id, true FROM c WHERE o = 1
        UNION ALL SELECT c.qid, c.o, CASE WHEN p.taken < 15 AND p.used + c.n <= 12000 THEN p.used + c.n ELSE p.used END, CASE WHEN p.taken < 15 AND p.used + c.n <= 12000 THEN p.taken + 1 ELSE p.taken END, c.repository_id, c.id, p.taken < 15 AND p.used + c.n <= 12000 FROM p JOIN c ON c.qid = p.qid AND c.o = p.o + 1),
      ev AS (SELECT qid, repository_id, id, taken FROM p WHERE ok),
      xe AS (SELECT DISTINCT repository_id, src, rel, dst FROM ge WHERE rel IN ('CALLS','DEFINES','IMPORTS','INHERITS'))"""


def _evidence(spark, d):
    """(qid, repository_id, id, position, citation): candidates are the ten retrieved first, then the expansion by score; those
    without a chunk fall out, the rest is packed."""
    r = graph_ranking_2hop(spark, d)
    e = table(spark, d, "evidence").where("source_code is not null and entity_id is not null")
    chunks = e.groupBy("repository_id", F.col("entity_id").alias("id")).agg(F.min_by(F.length("source_code"), "evidence_id").alias("n_chars"))
    c = r.join(chunks, ["repository_id", "id"]).select("qid", F.concat_ws("|", "repository_id", "id").alias("key"), "n_chars", F.when(F.col("rank") <= 10, 0).otherwise(1).alias("o1"), F.col("rank").alias("o2"))
    p = R.pack(c, "qid", ["o1", "o2"], "n_chars", "key")
    return p.select("qid", F.substring_index("key", "|", 1).alias("repository_id"), F.substring_index("key", "|", -1).alias("id"), "position", "citation")


@query(_EVIDENCE + " SELECT ev.qid, ev.repository_id, ev.id, CAST(ev.taken AS BIGINT) AS position, 'E' || ev.taken AS citation, count(DISTINCT (src, rel, dst)) FILTER (src IS NOT NULL) AS n_edges FROM ev LEFT JOIN xe ON xe.repository_id = ev.repository_id AND (xe.src = ev.id OR xe.dst = ev.id) GROUP BY ALL")
def evidence_graph(spark, d):
    """Packed evidence with the number of edges at each node; either end is an equi-join of its own, no join with OR."""
    ev = materialize(_evidence(spark, d), "evidence-nodes")
    e = Q.graph_of(spark, d)[1].where(F.col("rel").isin(*G.EXPAND))
    ends = e.select("repository_id", F.col("src").alias("id"), "src", "rel", "dst").unionByName(e.select("repository_id", F.col("dst").alias("id"), "src", "rel", "dst")).distinct()
    n = ev.select("repository_id", "id").distinct().join(ends, ["repository_id", "id"]).groupBy("repository_id", "id").agg(F.count(F.lit(1)).alias("n_edges"))
    return ev.join(n, ["repository_id", "id"], "left").select("qid", "repository_id", "id", big("position"), "citation", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(_EVIDENCE + " SELECT a.qid, xe.repository_id, xe.src, xe.rel, xe.dst FROM xe JOIN ev a ON a.repository_id = xe.repository_id AND a.id = xe.src JOIN ev b ON b.qid = a.qid AND b.repository_id = xe.repository_id AND b.id = xe.dst")
def evidence_edges(spark, d):
    """Edges both of whose ends are evidence of the same question."""
    ev = materialize(_evidence(spark, d), "evidence-nodes")
    e = Q.graph_of(spark, d)[1].where(F.col("rel").isin(*G.EXPAND))
    a = e.join(ev.select("qid", "repository_id", F.col("id").alias("src")), ["repository_id", "src"])
    return a.join(ev.select("qid", "repository_id", F.col("id").alias("dst")), ["qid", "repository_id", "dst"], "left_semi").select("qid", "repository_id", "src", "rel", "dst")


_STRATEGIES = f"""WITH {_TOP}, {_SECOND}, g AS (SELECT qid, vid, rank FROM sl WHERE rank <= 10), v AS (SELECT qid, vid, rank FROM tv),
      h AS (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vid) AS rank FROM (SELECT qid, vid, round(sum(1::DOUBLE / (60 + rank)), 8) AS s FROM (SELECT * FROM v UNION ALL SELECT * FROM g) GROUP BY 1, 2)),
      r AS (SELECT 'vector' AS strategy, * FROM v UNION ALL SELECT 'graph', * FROM g UNION ALL SELECT 'hybrid', * FROM h WHERE rank <= 10),
      q AS (SELECT a.vec_id AS qid, a.label, count(*) AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
      m AS (SELECT s.strategy, q.qid, q.label, q.n, count(*) FILTER (e.label = q.label AND r.rank <= 1) AS h1, count(*) FILTER (e.label = q.label AND r.rank <= 5) AS h5, count(*) FILTER (e.label = q.label) AS h10, min(r.rank) FILTER (e.label = q.label) AS first
        FROM q CROSS JOIN (VALUES ('vector'), ('graph'), ('hybrid')) s(strategy) LEFT JOIN r ON r.qid = q.qid AND r.strategy = s.strategy LEFT JOIN embeddings e ON e.vec_id = r.vid GROUP BY 1, 2, 3, 4)"""


def _strategies(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    v = Q._top(spark, d).select("qid", F.col("vid").alias("entity"), "rank")
    g = Q._second(spark, d).withColumnRenamed("vid", "entity")
    v, g = materialize(v, "vector-list"), materialize(g, "graph-list")
    h = R.rrf(("vector", v), ("graph", g)).where("rank <= 10").select("qid", "entity", "rank")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label").join(n, "label")
    out = None
    for name, ranked in (("vector", v), ("graph", g), ("hybrid", h)):
        hit = ranked.join(q, "qid").join(e.select(F.col("vec_id").alias("entity"), F.col("label").alias("l2")), "entity").withColumn("hit", F.col("label") == F.col("l2"))
        m = M.retrieval_metrics(hit, q.select("qid", "n_relevant")).join(q.select("qid", "label"), "qid").withColumn("strategy", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@query(_STRATEGIES + " SELECT strategy, CAST(coalesce(label, -1) AS BIGINT) AS label, count(*) AS n, round(avg(h1 / n), 6) AS recall_1, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(coalesce(1::DOUBLE / first, 0)), 6) AS mrr FROM m GROUP BY GROUPING SETS ((strategy, label), (strategy))")
def retrieval_strategies(spark, d):
    """Vector, graph and fused ranking side by side, per class and overall in one pass of grouping sets."""
    m = _strategies(spark, d)
    g = m.groupingSets([["strategy", "label"], ["strategy"]], "strategy", "label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")])
    return g.withColumn("label", F.coalesce("label", F.lit(-1)).cast("bigint"))


_COVER = """cv AS (SELECT i.item_id, i.category, i.should_abstain, list_distinct(list_filter(i.expected_entities, lambda x: x IS NOT NULL)) AS want, (SELECT list(DISTINCT regexp_extract(e.qualified_name, '[^.]+$')) FROM evidence e WHERE e.query_id = i.item_id AND e.qualified_name IS NOT NULL) AS got FROM eval_items i),
      ce AS (SELECT *, len(want) AS n_want, coalesce(len(list_intersect(want, got)), 0) AS n_hit, got IS NULL AS silent FROM cv)"""


def _coverage(spark, d):
    got = table(spark, d, "evidence").where("qualified_name is not null").groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set(F.regexp_extract("qualified_name", "[^.]+$", 0)).alias("got"))
    i = _items(spark, d).select("item_id", "category", "should_abstain", F.array_compact(F.array_distinct("expected_entities")).alias("want")).join(got, "item_id", "left")
    return i.select("item_id", "category", "should_abstain", F.coalesce(F.size("want"), F.lit(0)).alias("n_want"), F.when(F.col("got").isNull(), 0).otherwise(F.size(F.array_intersect("want", "got"))).alias("n_hit"), F.col("got").isNull().alias("silent"))


@query(f"""WITH {_COVER} SELECT category, count(*) AS n, round(avg(CASE WHEN n_want > 0 THEN n_hit / n_want ELSE 1 END), 6) AS coverage, round(coalesce(count(*) FILTER (should_abstain AND silent)::DOUBLE / nullif(count(*) FILTER (should_abstain), 0), 1), 6) AS abstention_accuracy,
      round(coalesce(count(*) FILTER (should_abstain AND NOT silent)::DOUBLE / nullif(count(*) FILTER (should_abstain), 0), 0), 6) AS false_answer_rate FROM ce GROUP BY 1""")
def answer_quality(spark, d):
    """Share of expected entities in the evidence, and how often silence was right; defaults where nothing was asked."""
    c = _coverage(spark, d)
    ratio = lambda a, b, default: F.round(F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double")), F.lit(default)), 6)
    ask = F.col("should_abstain")
    return c.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("n_want") > 0, F.col("n_hit") / F.col("n_want")).otherwise(1.0)), 6).alias("coverage"),
        ratio(ask & F.col("silent"), ask, 1.0).alias("abstention_accuracy"), ratio(ask & ~F.col("silent"), ask, 0.0).alias("false_answer_rate"),
    )


@query(f"WITH {_COVER} SELECT 'RETRIEVAL_FAILURE' AS error, count(*) FILTER (n_want > 0 AND n_hit = 0) AS n FROM ce UNION ALL SELECT 'ABSTENTION_FAILURE', count(*) FILTER (should_abstain AND NOT silent) FROM ce UNION ALL SELECT 'EMPTY_EXPECTATION', count(*) FILTER (n_want = 0) FROM ce")
def error_categories(spark, d):
    c = _coverage(spark, d).agg(
        F.count_if((F.col("n_want") > 0) & (F.col("n_hit") == 0)).alias("RETRIEVAL_FAILURE"), F.count_if(F.col("should_abstain") & ~F.col("silent")).alias("ABSTENTION_FAILURE"), F.count_if(F.col("n_want") == 0).alias("EMPTY_EXPECTATION")
    )
    return c.unpivot([], ["RETRIEVAL_FAILURE", "ABSTENTION_FAILURE", "EMPTY_EXPECTATION"], "error", "n")


@query(
    r"""WITH x AS (SELECT item_id, list_filter(list_transform(list_filter(list_distinct(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_.]*')), lambda t: length(t) >= 3 AND regexp_matches(t, '_|\.|^[A-Z]|.[A-Z]')), lambda t: lower(t)), lambda t: t NOT IN ('who','what','where','how','why','does','is','a','an','the','in','from','and','or',
      'to','for','with','call','calls','calling','inherit','inherits','import','imports','show','find','locate','explain','describe','implemented','defined','definition','function','class','method','module','file','code','system','usage','caller','callee','issue','flush','search','retrieved','object','objects','stored','persisted','formatted','initialized')) AS ents FROM eval_items),
      t AS (SELECT query_id AS item_id, lower(qualified_name) AS term FROM evidence UNION SELECT query_id, lower(entity_id) FROM evidence UNION SELECT query_id, lower(file_path) FROM evidence),
      g AS (SELECT x.item_id, ents, list(term) FILTER (term IS NOT NULL) AS terms FROM x LEFT JOIN t USING (item_id) GROUP BY 1, 2)
      SELECT item_id, CASE WHEN terms IS NULL THEN 'no evidence' WHEN len(ents) = 0 THEN 'enough' WHEN len(list_filter(ents, lambda e: len(list_filter(terms, lambda z: contains(z, e))) > 0)) > 0 THEN 'enough' ELSE 'not named' END AS sufficiency FROM g"""
)
def sufficiency(spark, d):
    """Whether a question's code names occur in the evidence found for it. Terms are gathered per question; both lists are its own."""
    common = F.array(*[F.lit(w) for w in rules.ANSWER_COMMON_WORDS])
    ents = F.filter(F.filter(X.words_but(F.col("item_text"), rules.INTENT_STOP_WORDS, least=3), X.looks_like_code), lambda t: ~F.array_contains(common, F.lower(t)))
    e = table(spark, d, "evidence").select(F.col("query_id").alias("item_id"), F.explode(F.array(F.lower("qualified_name"), F.lower("entity_id"), F.lower("file_path"))).alias("term")).where("term is not null")
    g = _items(spark, d).select("item_id", F.transform(ents, lambda t: F.lower(t)).alias("ents")).join(e.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "item_id", "left")
    named = F.exists("ents", lambda x: F.exists("terms", lambda t: t.contains(x)))
    return g.select("item_id", F.when(F.col("terms").isNull(), "no evidence").when((F.size("ents") == 0) | named, "enough").otherwise("not named").alias("sufficiency"))


@query("""SELECT query_id, sha256(string_agg('[' || coalesce(citation_id, '') || '] ' || coalesce(qualified_name, '') || ' (' || coalesce(file_path, '') || ')', chr(10) ORDER BY evidence_id)) AS h, count(*) AS n FROM evidence GROUP BY 1""")
def prompt_text(spark, d):
    """The evidence list of a prompt, in order."""
    line = F.concat(F.lit("["), F.coalesce("citation_id", F.lit("")), F.lit("] "), F.coalesce("qualified_name", F.lit("")), F.lit(" ("), F.coalesce("file_path", F.lit("")), F.lit(")"))
    g = table(spark, d, "evidence").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", line.alias("l")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return g.select("query_id", F.sha2(F.array_join(F.transform("x", lambda s: s["l"]), "\n"), 256).alias("h"), "n")


@query("WITH e AS (SELECT query_id, 'Evidence: ' || qualified_name || ' [' || citation_id || ']' AS line, row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS rn FROM evidence WHERE qualified_name IS NOT NULL AND citation_id IS NOT NULL) SELECT query_id, string_agg(line, chr(10) ORDER BY rn) AS answer FROM e WHERE rn <= 5 GROUP BY 1")
def cited_answer(spark, d):
    """The deterministic answer: up to five evidence lines, each with its citation."""
    w = Window.partitionBy("query_id").orderBy("evidence_id")
    e = table(spark, d, "evidence").where("qualified_name is not null and citation_id is not null").select("query_id", F.concat(F.lit("Evidence: "), "qualified_name", F.lit(" ["), "citation_id", F.lit("]")).alias("line"), F.row_number().over(w).alias("rn")).where("rn <= 5")
    return e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("answer"))


@query(
    r"""WITH c AS (SELECT doc_id, repository_id, unnest(list_distinct(regexp_extract_all(text, '\[(E\d+)\]', 1))) AS cite FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, cite, EXISTS (SELECT 1 FROM evidence e WHERE e.repository_id = c.repository_id AND e.citation_id = c.cite) AS valid FROM c"""
)
def citations_in_evidence(spark, d):
    """Each citation of a document, and whether its repository has evidence of that number."""
    c = table(spark, d, "documents").where("text is not null").select("doc_id", "repository_id", F.explode(X.citations(F.col("text"))).alias("cite"))
    e = table(spark, d, "evidence").where("citation_id is not null").select("repository_id", F.col("citation_id").alias("cite")).distinct().withColumn("valid", F.lit(True))
    return c.join(e, ["repository_id", "cite"], "left").select("doc_id", "cite", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(r"SELECT event_id, CAST(json_extract_string(block, '$.k') AS BIGINT) AS k FROM (SELECT event_id, regexp_extract('plan: ' || props || ' end', '(?s)\{.*\}', 0) AS block FROM events)")
def json_blocks(spark, d):
    """The JSON object inside a text, read by a schema."""
    block = F.regexp_extract(F.concat(F.lit("plan: "), "props", F.lit(" end")), r"(?s)\{.*\}", 0)
    return table(spark, d, "events").select("event_id", F.from_json(block, "k bigint")["k"].alias("k"))


@query(
    _paths_sql(Q._SEED_START, "'CALLS'", 4)
    + """, x AS (SELECT DISTINCT repository_id, start, nodes, depth FROM w), a AS (SELECT repository_id, start, unnest(nodes) AS id, 0 AS part, unnest(range(len(nodes))) AS i FROM x
        UNION ALL SELECT ge.repository_id, dst, src, 1, 0 FROM ge JOIN st ON st.repository_id = ge.repository_id AND st.id = ge.dst WHERE rel IN ('CALLS','IMPORTS','INHERITS')),
      m AS (SELECT repository_id, start, id, min((part, i)) AS o FROM a GROUP BY 1, 2, 3) SELECT repository_id, start, id, 'E' || row_number() OVER (PARTITION BY repository_id, start ORDER BY o, id) AS citation FROM m"""
)
def evidence_context(spark, d):
    """Nodes of a start's call paths, then of its direct dependents, each once in that order and numbered."""
    n, e = Q.graph_of(spark, d)
    st = materialize(Q._seed_starts(spark, d, n), "starts")
    p = G.simple_paths(e, st, ("CALLS",), 4).select("repository_id", "start", F.posexplode("nodes").alias("i", "id"), F.lit(0).alias("part"))
    dep = e.where(F.col("rel").isin(*G.TRACE)).join(st.select("repository_id", F.col("id").alias("dst")), ["repository_id", "dst"], "left_semi").select("repository_id", F.col("dst").alias("start"), F.lit(0).alias("i"), F.col("src").alias("id"), F.lit(1).alias("part"))
    m = p.unionByName(dep).groupBy("repository_id", "start", "id").agg(F.min(F.struct("part", "i")).alias("o"))
    w = Window.partitionBy("repository_id", "start").orderBy("o", "id")
    return m.select("repository_id", "start", "id", F.concat(F.lit("E"), F.row_number().over(w).cast("string")).alias("citation"))


_HYP = """hy AS (SELECT i.item_id, CASE WHEN contains(lower(item_text), 'change') OR contains(lower(item_text), 'impact') OR contains(lower(item_text), 'modify') THEN 'modifying the entity breaks direct downstream callers' ELSE 'target symbol behavior diverges due to missing dependency or call chain' END AS h FROM eval_items i),
      se AS (SELECT hy.item_id, e.citation_id, contains(h, lower(e.qualified_name)) OR contains(h, lower(e.file_path)) OR len(list_filter(string_split(h, ' '), lambda w: length(w) > 4 AND contains(lower(concat_ws(' ', e.qualified_name, e.file_path, e.source_code)), w))) > 0 AS sup,
        contains(h, 'fail') AND (contains(lower(e.qualified_name), 'succ') OR contains(lower(e.qualified_name), 'pass') OR contains(lower(e.qualified_name), 'ok')) AS con FROM hy JOIN evidence e ON e.query_id = hy.item_id WHERE e.qualified_name IS NOT NULL AND e.file_path IS NOT NULL)"""


@query(f"""WITH {_HYP}, n AS (SELECT item_id, count(DISTINCT citation_id) FILTER (sup) AS n_sup, count(DISTINCT citation_id) FILTER (con) AS n_con FROM se GROUP BY 1)
      SELECT item_id, n_sup, n_con, CASE WHEN n_con > n_sup AND n_con >= 2 THEN 'REJECTED' WHEN n_sup >= 1 THEN 'SUPPORTED' ELSE 'OPEN' END AS status, CASE WHEN n_con > n_sup AND n_con >= 2 THEN 'REJECTED' WHEN n_sup >= 2 AND n_con = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM n""")
def hypothesis_support(spark, d):
    """Evidence for and against a question's hypothesis, and what follows from the counts."""
    q = F.lower("item_text")
    h = F.when(q.contains("change") | q.contains("impact") | q.contains("modify"), "modifying the entity breaks direct downstream callers").otherwise("target symbol behavior diverges due to missing dependency or call chain")
    e = table(spark, d, "evidence").where("qualified_name is not null and file_path is not null")
    j = _items(spark, d).select("item_id", h.alias("h")).join(e.withColumnRenamed("query_id", "item_id"), "item_id")
    name = F.lower("qualified_name")
    body = F.lower(F.concat_ws(" ", "qualified_name", "file_path", "source_code"))
    sup = F.col("h").contains(name) | F.col("h").contains(F.lower("file_path")) | F.exists(F.split("h", " "), lambda w: (F.length(w) > 4) & body.contains(w))
    con = F.col("h").contains("fail") & (name.contains("succ") | name.contains("pass") | name.contains("ok"))
    n = j.groupBy("item_id").agg(F.countDistinct(F.when(sup, F.col("citation_id"))).alias("n_sup"), F.countDistinct(F.when(con, F.col("citation_id"))).alias("n_con"))
    no = (F.col("n_con") > F.col("n_sup")) & (F.col("n_con") >= 2)
    return n.select("item_id", "n_sup", "n_con", F.when(no, "REJECTED").when(F.col("n_sup") >= 1, "SUPPORTED").otherwise("OPEN").alias("status"), F.when(no, "REJECTED").when((F.col("n_sup") >= 2) & (F.col("n_con") == 0), "HIGH").otherwise("MEDIUM").alias("confidence"))


# -- changes, diffs and test output (F23-F27, F35, F36, P15, P17, A26, A28, J21, J22, S2, S17, S18, S21, S23, S28) -----------
@query(
    """WITH f AS (SELECT patch_id, file_path, row_number() OVER (PARTITION BY patch_id ORDER BY change_id) AS i, CASE WHEN regexp_matches(lower(file_path), '\\.(exe|dll|so|dylib|pyc|pyd|db|sqlite|bin|tar|gz|zip)$') THEN 'forbidden type'
        WHEN regexp_matches(lower(file_path), '\\.env|id_rsa|credentials|secret|\\.pem') THEN 'sensitive file' WHEN NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repository_id = p.repository_id AND s.path = p.file_path) THEN 'scope drift' END AS problem FROM patch_changes p)
      SELECT patch_id, coalesce(arg_min(problem, i) FILTER (problem IS NOT NULL), 'ok') AS verdict, count(*) FILTER (problem IS NOT NULL) AS n_problems FROM f GROUP BY 1""".replace("\\\\", "\\")
)
def diff_inspection(spark, d):
    """The first reason against a patch, in the order of its changes: type, sensitive name, a file outside of the plan."""
    p = table(spark, d, "patch_changes").select("patch_id", "change_id", "repository_id", "file_path")
    plan = table(spark, d, "source_files").select("repository_id", F.col("path").alias("file_path")).distinct().withColumn("planned", F.lit(True))
    j = p.join(plan, ["repository_id", "file_path"], "left").withColumn("problem", C.diff_problem(F.col("file_path"), F.col("planned").isNotNull()))
    return j.groupBy("patch_id").agg(F.coalesce(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("change_id"))), F.lit("ok")).alias("verdict"), F.count("problem").alias("n_problems"))


@query(
    """SELECT word, count(*) AS n FROM (SELECT CASE WHEN contains(x, 'git commit') THEN 'git commit' WHEN contains(x, 'git push') THEN 'git push' WHEN contains(x, 'rm -rf') THEN 'rm -rf' WHEN contains(x, 'drop table') THEN 'drop table' WHEN contains(x, 'delete from') THEN 'delete from'
      WHEN contains(x, 'subprocess') THEN 'subprocess' WHEN contains(x, 'os.system') THEN 'os.system' WHEN contains(x, 'eval(') THEN 'eval(' WHEN contains(x, 'exec(') THEN 'exec(' WHEN contains(x, 'chmod') THEN 'chmod' WHEN contains(x, 'chown') THEN 'chown' ELSE 'none' END AS word
      FROM (SELECT lower(new_content) AS x FROM patch_changes WHERE new_content IS NOT NULL UNION ALL SELECT lower(text) FROM documents WHERE text IS NOT NULL)) GROUP BY 1"""
)
def command_safety(spark, d):
    t = table(spark, d, "patch_changes").select(F.col("new_content").alias("x")).unionByName(table(spark, d, "documents").select(F.col("text").alias("x"))).where("x is not null")
    return t.groupBy(rules.by_words(F.col("x"), [(w, (w,)) for w in rules.FORBIDDEN_REPAIR], "none").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH b AS (SELECT change_id, 'auto/' || coalesce(nullif(regexp_replace(trim(lower(operation_type)), '[^a-zA-Z0-9_-]', '-', 'g'), ''), 'fix') || '/' || coalesce(nullif(regexp_replace(trim(lower(file_path)), '[^a-zA-Z0-9_-]', '-', 'g'), ''), 'patch') AS raw, operation_type || ':' || file_path AS src FROM patch_changes),
      s AS (SELECT change_id, CASE WHEN length(raw) > 100 THEN 'auto/fix/patch-' || substr(sha256(src), 1, 8) ELSE raw END AS name FROM b), f AS (SELECT *, min(change_id) OVER (PARTITION BY name) AS first_id FROM s)
      SELECT change_id, CASE WHEN change_id = first_id THEN name ELSE name || '-v' || substr(sha256(name || ':collision'), 1, 4) END AS branch FROM f"""
)
def branch_names(spark, d):
    """A safe branch name per change; a name that an earlier change has gets a suffix. Who came first is an aggregate joined back."""
    t = table(spark, d, "patch_changes").select("change_id", C.branch_name(F.col("operation_type"), F.col("file_path"), "auto").alias("name"))
    first = t.groupBy("name").agg(F.min("change_id").alias("first_id"))
    return t.join(first, "name").select("change_id", F.when(F.col("change_id") == F.col("first_id"), F.col("name")).otherwise(F.concat("name", F.lit("-v"), F.substring(F.sha2(F.concat("name", F.lit(":collision")), 256), 1, 4))).alias("branch"))


@query(
    r"""SELECT patch_id, substr('fix(' || lower(arg_min(file_path, change_id)) || '): ' || arg_min(operation_type, change_id), 1, 100) AS subject, sha256(string_agg('  - ' || operation_type || ' in ' || file_path, chr(10) ORDER BY change_id)) AS body, count(DISTINCT file_path) AS n_files FROM patch_changes GROUP BY 1"""
)
def commit_messages(spark, d):
    """Subject (at most 100 characters) and the list of changes of a patch's commit."""
    line = F.concat(F.lit("  - "), "operation_type", F.lit(" in "), "file_path")
    g = table(spark, d, "patch_changes").groupBy("patch_id").agg(
        F.min_by("file_path", "change_id").alias("f"), F.min_by("operation_type", "change_id").alias("o"), F.array_sort(F.collect_list(F.struct("change_id", line.alias("l")))).alias("x"), F.countDistinct("file_path").alias("n_files")
    )
    subject = F.substring(F.concat(F.lit("fix("), F.lower("f"), F.lit("): "), "o"), 1, 100)
    return g.select("patch_id", subject.alias("subject"), F.sha2(F.array_join(F.transform("x", lambda s: s["l"]), "\n"), 256).alias("body"), "n_files")


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'timed_out' ELSE 'success' END AS conclusion, ['job-' || (user_id % 3), 'job-x'] AS jobs, CASE WHEN value > 10 THEN 'AssertionError: ' || value END AS detail FROM events)
      SELECT event_id, unnest(jobs) AS test_name, CASE WHEN contains(coalesce(detail, ''), 'Assertion') THEN 'AssertionError' ELSE 'CIBuildError' END AS error_type FROM r WHERE conclusion IN ('failure', 'timed_out', 'cancelled')""")
def ci_failures(spark, d):
    """A failure row for every failed job of a run that did not end well."""
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "timed_out").otherwise("success")
    runs = table(spark, d, "events").select("event_id", kind.alias("conclusion"), F.array(F.concat(F.lit("job-"), (F.col("user_id") % 3).cast("string")), F.lit("job-x")).alias("jobs"), F.when(F.col("value") > 10, F.concat(F.lit("AssertionError: "), F.col("value").cast("string"))).alias("detail"))
    return C.failed_jobs(runs, "event_id")


_SUMMARY = """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS errors, count(*) FILTER (event_type = 'signup') AS skipped FROM events GROUP BY 1)"""


@query(f"{_SUMMARY} SELECT user_id, passed, failed, errors AS error, skipped FROM s")
def test_summaries(spark, d):
    """Counts by outcome out of the last summary line of a test run's output (here made from counts, so that they must come back)."""
    n = table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(a) for k, a in (("click", "p"), ("error", "f"), ("view", "e"), ("signup", "s"))])
    out = F.format_string("collected 9 items\n1 failed while 2 passed earlier\n==== %d passed, %d failed, %d errors, %d skipped in 0.42s ====\nbye\n", "p", "f", "e", "s")
    return C.summary_counts(n.select("user_id", out.alias("stdout")), "stdout").select("user_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("passed", "failed", "error", "skipped")])


@query(f"WITH {_FAIL}, x AS (SELECT DISTINCT d.repository_id, error_type, message, d.created_at >= TIMESTAMP '2025-06-01 00:00:00' AS late FROM fl JOIN documents d USING (doc_id) WHERE d.repository_id IS NOT NULL AND d.created_at IS NOT NULL) SELECT repository_id, error_type, message FROM x a WHERE late AND NOT EXISTS (SELECT 1 FROM x b WHERE NOT b.late AND b.repository_id = a.repository_id AND b.error_type = a.error_type AND b.message = a.message)")
def new_failures(spark, d):
    """Failures after a time that were not there before it: a difference of distinct rows."""
    t = table(spark, d, "documents").where("repository_id is not null and created_at is not null").select("doc_id", "repository_id", (F.col("created_at") >= F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).alias("late"))
    x = Q._failures(spark, d).join(t, "doc_id").select("repository_id", "error_type", "message", "late").distinct()
    key = ["repository_id", "error_type", "message"]
    return x.where("late").select(*key).join(x.where("not late").select(*key), key, "left_anti")


@query("""WITH f AS (SELECT repository_id, path, min_by(sha256, file_id) AS a, max_by(sha256, file_id) AS b, count(*) AS n FROM source_files WHERE content IS NOT NULL GROUP BY 1, 2)
      SELECT CASE WHEN regexp_matches(lower(path), 'arch|overview|diagram') THEN 'ARCHITECTURE_DIAGRAM' WHEN regexp_matches(lower(path), 'er|schema|database') THEN 'ER_DIAGRAM' WHEN regexp_matches(lower(path), 'uml|class') THEN 'UML_DIAGRAM' WHEN regexp_matches(lower(path), 'ui|screenshot|mockup') THEN 'UI_SCREENSHOT' ELSE 'SOURCE' END AS asset,
      count(*) AS n, count(*) FILTER (n > 1 AND a = b) AS n_skipped FROM f GROUP BY 1""")
def asset_index(spark, d):
    f = table(spark, d, "source_files").where("content is not null").groupBy("repository_id", "path").agg(F.min_by("sha256", "file_id").alias("a"), F.max_by("sha256", "file_id").alias("b"), F.count(F.lit(1)).alias("c"))
    return f.groupBy(rules.asset_type(F.col("path")).alias("asset")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("c") > 1) & (F.col("a") == F.col("b"))).alias("n_skipped"))


@query("SELECT DISTINCT repository_id, path FROM source_files WHERE error IS NOT NULL OR has_syntax_errors")
def failed_files(spark, d):
    return table(spark, d, "source_files").where("error is not null or has_syntax_errors").select("repository_id", "path").distinct()


@query(
    """WITH l AS (SELECT repository_id, CASE operation_type WHEN 'ADD_TEST' THEN '?? ' WHEN 'ADD_FUNCTION' THEN 'A  ' WHEN 'MODIFY_IMPORT' THEN 'MM ' ELSE ' M ' END || file_path AS line FROM patch_changes)
      SELECT repository_id, count(*) FILTER (line[1] IN ('M', 'A', 'R')) AS n_staged, count(*) FILTER (line[2] = 'M') AS n_modified, count(*) FILTER (line[1:2] = '??') AS n_untracked FROM l GROUP BY 1"""
)
def worktree_status(spark, d):
    code = F.when(F.col("operation_type") == "ADD_TEST", "?? ").when(F.col("operation_type") == "ADD_FUNCTION", "A  ").when(F.col("operation_type") == "MODIFY_IMPORT", "MM ").otherwise(" M ")
    return C.status_counts(table(spark, d, "patch_changes").select("repository_id", F.concat(code, "file_path").alias("line")), "repository_id")


@query(
    """SELECT file_id, CASE WHEN len(list_intersect(string_split(path, '/')[1:-2], ['.git','.hg','.svn','__pycache__','.pytest_cache','.mypy_cache','.ruff_cache','.tox','.cache','coverage','.htmlcov','.idea','.vscode','.venv','venv','env','node_modules','.next','.nuxt','dist','build','target','out','site-packages','.eggs'])) > 0
      OR len(list_filter(string_split(path, '/')[1:-2], lambda p: ends_with(p, '.egg-info'))) > 0 OR ends_with(path, '.pyc') OR ends_with(path, '.pyo') OR coalesce(size_bytes, 0) > 5242880 THEN false ELSE true END AS copied FROM source_files WHERE path IS NOT NULL"""
)
def workspace_files(spark, d):
    return table(spark, d, "source_files").where("path is not null").select("file_id", C.in_workspace(F.col("path"), F.col("size_bytes")).alias("copied"))


@query(f"WITH {_NODES} SELECT repository_id, cid AS id, label FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, cid) AS rn FROM ln) WHERE rn <= 100")
def local_graph(spark, d):
    """The first hundred nodes of a repository in the order of its files."""
    w = Window.partitionBy("repository_id").orderBy(F.asc_nulls_first("file_path"), F.asc_nulls_first("start_line"), "id")
    return Q.nodes_of(spark, d).select("repository_id", "id", "label", F.row_number().over(w).alias("rn")).where("rn <= 100").drop("rn")


@query("SELECT event_type, printf('| %s | %d | %.4f |', event_type, count(*), round(avg(value), 4)) AS line FROM events WHERE value IS NOT NULL GROUP BY 1")
def report_lines(spark, d):
    g = table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("m"))
    return g.select("event_type", F.format_string("| %s | %d | %.4f |", "event_type", "n", "m").alias("line"))


@query("SELECT user_id, count(*) AS n_spans, CASE WHEN bool_or(event_type = 'error') THEN 'ERROR' ELSE 'OK' END AS status, sum(CASE WHEN contains(p, 'REDACTED') THEN 1 ELSE 0 END)::BIGINT AS n_redacted FROM (SELECT *, regexp_replace('Bearer k' || event_id, '(?i)Bearer\\s+[a-zA-Z0-9._-]+', 'Bearer [REDACTED_TOKEN]', 'g') AS p FROM events) GROUP BY 1".replace("\\\\", "\\"))
def trace_export(spark, d):
    """One JSON document per trace: summary and redacted spans; read back here by its fields."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", X.redact(F.concat(F.lit("Bearer k"), F.col("event_id").cast("string"))).alias("note"))
    g = e.groupBy("user_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n_spans"), F.when(F.bool_or(F.col("event_type") == "error"), "ERROR").otherwise("OK").alias("status"), F.collect_list(F.struct("event_id", "note")).alias("spans"))).alias("doc"))
    x = g.select("user_id", F.from_json("doc", "n_spans bigint, status string, spans array<struct<event_id: bigint, note: string>>").alias("x"))
    return x.select("user_id", "x.n_spans", "x.status", F.size(F.filter("x.spans", lambda s: s["note"].contains("REDACTED"))).cast("bigint").alias("n_redacted"))


@query()
def patch_diffs(spark, d):
    """Unified diffs of old against new content, with their line totals and whether the patch keeps its bounds."""
    return C.patch_totals(table(spark, d, "patch_changes"))


@query("SELECT * FROM (SELECT asset, source, rel, target, count(*) AS n FROM (SELECT DISTINCT path, lower(regexp_extract(path, '[^/]+$')) AS name, CASE WHEN regexp_matches(lower(path), 'arch|overview|diagram') THEN 'ARCHITECTURE_DIAGRAM' WHEN regexp_matches(lower(path), 'er|schema|database') THEN 'ER_DIAGRAM' WHEN regexp_matches(lower(path), 'uml|class') THEN 'UML_DIAGRAM' WHEN regexp_matches(lower(path), 'ui|screenshot|mockup') THEN 'UI_SCREENSHOT' ELSE 'SOURCE' END AS kind FROM source_files WHERE path IS NOT NULL) p JOIN (VALUES (1, 'ARCHITECTURE_DIAGRAM', 'arch', 'AuthService', 'USES', 'PostgreSQL'), (1, 'ARCHITECTURE_DIAGRAM', 'arch', 'AuthService', 'USES', 'Redis'), (2, 'ER_DIAGRAM', 'er', 'Order', 'REFERENCES', 'User'), (3, 'UML_DIAGRAM', 'uml', 'AdminUser', 'INHERITS', 'User')) v(i, asset, word, source, rel, target) ON v.i = CASE WHEN kind = 'ARCHITECTURE_DIAGRAM' OR contains(name, 'arch') THEN 1 WHEN kind = 'ER_DIAGRAM' OR contains(name, 'er') THEN 2 WHEN kind = 'UML_DIAGRAM' OR contains(name, 'uml') THEN 3 END GROUP BY 1, 2, 3, 4)")
def drawing_relations(spark, d):
    """What the drawings of a repository show, by the first kind that fits type or name."""
    p = table(spark, d, "source_files").where("path is not null").select("path").distinct().select(rules.asset_type(F.col("path")).alias("kind"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))
    asset = F.lit(None).cast("string")
    for kind, word in reversed(list(dict.fromkeys((a, w) for a, w, *_ in rules.DRAWINGS))):
        asset = F.when((F.col("kind") == kind) | F.col("name").contains(word), kind).otherwise(asset)
    shown = spark.createDataFrame([(a, s, r, t) for a, _, s, r, t in rules.DRAWINGS], "asset string, source string, rel string, target string")
    return p.select(asset.alias("asset")).join(F.broadcast(shown), "asset").groupBy("asset", "source", "rel", "target").agg(F.count(F.lit(1)).alias("n"))


# -- metrics of runs (A13, A16-A22, A24, F26, F50, M4, M6, M16) -----------------------------------------------------------
_RUNS = """rn AS (SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type IN ('click', 'purchase') AND value > 0) AS n_useful, count(DISTINCT event_type) AS n_kinds, sum(value) AS ms, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'signup') AS expected_unsafe,
      count(*) FILTER (event_type = 'error') AS n_iter, CASE WHEN NOT bool_or(event_type = 'error') THEN 'SUCCESS' WHEN bool_or(event_type = 'purchase') THEN 'ABSTAIN' ELSE 'FAILURE' END AS status, max(event_type) AS last_kind FROM events GROUP BY 1)"""


def _runs(spark, d):
    t = F.col("event_type")
    status = F.when(~F.bool_or(t == "error"), "SUCCESS").when(F.bool_or(t == "purchase"), "ABSTAIN").otherwise("FAILURE")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(t.isin("click", "purchase") & (F.col("value") > 0)).alias("n_useful"), F.countDistinct(t).alias("n_kinds"), F.sum("value").alias("ms"), F.bool_or(t == "error").alias("failed"),
        F.bool_or(t == "signup").alias("expected_unsafe"), F.count_if(t == "error").alias("n_iter"), status.alias("status"), F.max(t).alias("last_kind"),
    )


@query(f"WITH {_RUNS} SELECT round(count(*) FILTER (n_kinds > 2)::DOUBLE / count(*), 6) AS success, round(count(*) FILTER (n_useful > 0 OR failed)::DOUBLE / count(*), 6) AS sufficiency, round(count(*) FILTER (expected_unsafe = failed)::DOUBLE / count(*), 6) AS abstention, round(avg(n_useful / n_calls), 6) AS efficiency, round(1 - avg(n_useful / n_calls), 6) AS unnecessary, round(avg(n_calls), 6) AS calls FROM rn")
def agent_metrics(spark, d):
    c = F.col
    return M.rates(
        _runs(spark, d), {"success": (c("n_kinds") > 2, None, 0.0), "sufficiency": ((c("n_useful") > 0) | c("failed"), None, 0.0), "abstention": (c("expected_unsafe") == c("failed"), None, 1.0)},
        {"efficiency": F.avg(c("n_useful") / c("n_calls")), "unnecessary": 1 - F.avg(c("n_useful") / c("n_calls")), "calls": F.avg("n_calls")},
    )


_CHANGES = """cr AS (SELECT c.change_id, EXISTS (SELECT 1 FROM source_files s WHERE s.repository_id = c.repository_id AND s.path = c.file_path) AS planned, new_content IS NOT NULL AS patched, coalesce(old_content, '') <> '' AS tested, operation_type = 'ADD_TEST' AS unsafe FROM patch_changes c)"""


@query(f"WITH {_CHANGES} SELECT round(count(*) FILTER (planned)::DOUBLE / count(*), 6) AS plan_validity, round(count(*) FILTER (patched)::DOUBLE / count(*), 6) AS applied, round(count(*) FILTER (planned AND patched AND tested)::DOUBLE / count(*), 6) AS correctness, round(coalesce(count(*) FILTER (unsafe AND NOT patched)::DOUBLE / nullif(count(*) FILTER (unsafe), 0), 1), 6) AS rejection FROM cr")
def change_metrics(spark, d):
    plan = table(spark, d, "source_files").select("repository_id", F.col("path").alias("file_path")).distinct().withColumn("p", F.lit(True))
    t = table(spark, d, "patch_changes").join(plan, ["repository_id", "file_path"], "left").select(
        F.coalesce("p", F.lit(False)).alias("planned"), F.col("new_content").isNotNull().alias("patched"), (F.coalesce("old_content", F.lit("")) != "").alias("tested"), (F.col("operation_type") == "ADD_TEST").alias("unsafe")
    )
    c = F.col
    return M.rates(t, {"plan_validity": (c("planned"), None, 0.0), "applied": (c("patched"), None, 0.0), "correctness": (c("planned") & c("patched") & c("tested"), None, 0.0), "rejection": (~c("patched"), c("unsafe"), 1.0)})


@query(f"WITH {_RUNS} SELECT round(count(*) FILTER (status = 'SUCCESS')::DOUBLE / count(*), 6) AS success, round(count(*) FILTER (status = 'FAILURE' AND n_iter = 1)::DOUBLE / count(*), 6) AS first_patch, round(avg(n_iter), 6) AS avg_iterations, median(n_iter)::DOUBLE AS median_iterations, max(n_iter) AS max_iterations, round(coalesce(count(*) FILTER (expected_unsafe AND status <> 'SUCCESS')::DOUBLE / nullif(count(*) FILTER (expected_unsafe), 0), 1), 6) AS rejection FROM rn")
def repair_metrics(spark, d):
    c = F.col
    return M.rates(
        _runs(spark, d), {"success": (c("status") == "SUCCESS", None, 1.0), "first_patch": ((c("status") == "FAILURE") & (c("n_iter") == 1), None, 1.0), "rejection": (c("status") != "SUCCESS", c("expected_unsafe"), 1.0)},
        {"avg_iterations": F.avg("n_iter"), "median_iterations": F.median("n_iter"), "max_iterations": F.max("n_iter")},
    )


@query(f"WITH {_RUNS} SELECT round(count(*) FILTER (status IN ('SUCCESS', 'ABSTAIN'))::DOUBLE / count(*), 6) AS workflow, round(count(*) FILTER (last_kind <> 'error')::DOUBLE / count(*), 6) AS branch, round(coalesce(count(*) FILTER (failed AND status = 'ABSTAIN')::DOUBLE / nullif(count(*) FILTER (failed), 0), 1), 6) AS detection FROM rn")
def workflow_metrics(spark, d):
    """Rates of version-control and hosting runs: ended well, branch made, problems that were seen."""
    c = F.col
    return M.rates(_runs(spark, d), {"workflow": (c("status").isin("SUCCESS", "ABSTAIN"), None, 1.0), "branch": (c("last_kind") != "error", None, 1.0), "detection": (c("status") == "ABSTAIN", c("failed"), 1.0)})


@query(
    _paths_sql(Q._SEED_START, "'CALLS'", 4)
    + """, gt AS (SELECT DISTINCT repository_id, start, unnest(nodes) AS id FROM w), ot AS (SELECT repository_id, start, unnest(nodes) AS id FROM w),
      wt AS (SELECT st.repository_id, st.id AS start, ge.dst AS id FROM st JOIN ge ON ge.repository_id = st.repository_id AND ge.src = st.id WHERE rel IN ('CALLS', 'IMPORTS') GROUP BY ALL),
      a AS (SELECT wt.repository_id, wt.start, count(*) AS n_want, count(gt.id) AS n_hit FROM wt LEFT JOIN gt USING (repository_id, start, id) GROUP BY 1, 2),
      b AS (SELECT ot.repository_id, ot.start, count(*) AS n_got, count(wt.id) AS n_right FROM ot LEFT JOIN wt USING (repository_id, start, id) GROUP BY 1, 2)
      SELECT st.repository_id, st.id AS start, round(CASE WHEN n_want IS NULL THEN 1 WHEN n_got IS NULL THEN 0 ELSE n_hit / n_want END, 6) AS path_recall, round(CASE WHEN n_got IS NULL THEN CASE WHEN n_want IS NULL THEN 1 ELSE 0 END ELSE n_right / n_got END, 6) AS path_precision
      FROM st LEFT JOIN a ON a.repository_id = st.repository_id AND a.start = st.id LEFT JOIN b ON b.repository_id = st.repository_id AND b.start = st.id"""
)
def reasoning_metrics(spark, d):
    """Recall and precision of call paths against what a start calls or imports."""
    n, e = Q.graph_of(spark, d)
    st = materialize(Q._seed_starts(spark, d, n), "starts")
    got = materialize(G.simple_paths(e, st, ("CALLS",), 4).select("repository_id", "start", F.explode("nodes").alias("id")), "path-nodes")
    want = e.where("rel in ('CALLS', 'IMPORTS')").join(st.select("repository_id", F.col("id").alias("src")), ["repository_id", "src"], "left_semi").select("repository_id", F.col("src").alias("start"), F.col("dst").alias("id")).distinct()
    return M.path_quality(st.withColumnRenamed("id", "start"), got, want)


@query("SELECT sum(CASE WHEN s = 'MATCH' THEN 1 ELSE 0 END)::BIGINT AS n_match, count(*) AS n, round(coalesce(sum(CASE WHEN s = 'CONFLICT' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0), 1), 6) AS conflict_rate, round(coalesce(sum(CASE WHEN s = 'MATCH' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0), 1), 6) AS match_rate FROM (SELECT status AS s FROM (" + Q._DRIFT + "))")
def drift_metrics(spark, d):
    t = Q.doc_drift(spark, d)
    s = F.col("status")
    rate = lambda k: F.round(F.coalesce(F.try_divide(F.count_if(s == k).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(1.0)), 6)
    return t.agg(F.count_if(s == "MATCH").alias("n_match"), F.count(F.lit(1)).alias("n"), rate("CONFLICT").alias("conflict_rate"), rate("MATCH").alias("match_rate"))


@query("SELECT event_type, round(sum(value), 4) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY 1")
def counters_and_gauges(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


@query("SELECT round(avg(v) FILTER (k = 'click'), 6) AS click, round(avg(v) FILTER (k = 'view'), 6) AS view, round(avg(t), 6) AS total FROM (SELECT user_id, event_type AS k, avg(value) AS v, NULL AS t FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, NULL, NULL, sum(value) FROM events GROUP BY 1)")
def stage_averages(spark, d):
    """Averages per stage over the runs that have it, and of the totals, out of one map per run."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.sum("value").alias("s"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"), F.sum("s").alias("t"))
    return m.agg(*[F.round(F.avg(F.try_element_at("m", F.lit(k))), 6).alias(k) for k in ("click", "view")], F.round(F.avg("t"), 6).alias("total"))


@query("SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 1000 AS duration_ms FROM events")
def span_durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", ((us - F.lag(us).over(w)).cast("double") / 1000).alias("duration_ms"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'Investigate PR #' || user_id WHEN event_type = 'click' THEN 'Address review comment on ' || json_extract_string(props, '$.k') || ':0: ' WHEN event_type = 'error' THEN 'Repair CI failure in workflow ''CI Workflow'' for PR #' || user_id ELSE 'Process event ' || event_type || ' for PR #' || user_id END AS instruction FROM events")
def event_instructions(spark, d):
    pr = F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Investigate PR #"), pr)).when(F.col("event_type") == "click", F.concat(F.lit("Address review comment on "), F.get_json_object("props", "$.k"), F.lit(":0: ")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Repair CI failure in workflow 'CI Workflow' for PR #"), pr)).otherwise(F.concat(F.lit("Process event "), "event_type", F.lit(" for PR #"), pr))
    )
    return table(spark, d, "events").select("event_id", text.alias("instruction"))


@query("SELECT arg_min(event_id, (ts, event_id)) AS event_id, user_id, event_type, least(8, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS depth, count(*) AS n FROM events GROUP BY 2, 3, 4")
def tool_calls(spark, d):
    """Calls with clamped arguments, each canonical call once: the first of equal ones runs."""
    e = table(spark, d, "events").withColumn("depth", F.least(F.lit(8), F.get_json_object("props", "$.k").cast("bigint")))
    return e.groupBy("user_id", "event_type", "depth").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))


_STOP = """WITH s AS (SELECT user_id, event_id, ts, row_number() OVER w AS step, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS n_strong, sum(value) OVER w AS n_evidence, date_diff('second', min(ts) OVER w, ts) AS elapsed,
      count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS empty3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
      r AS (SELECT *, CASE WHEN n_strong >= 3 THEN 'strong evidence' WHEN step >= 10 THEN 'iterations' WHEN step >= 12 THEN 'steps' WHEN n_evidence >= 100 THEN 'evidence' WHEN elapsed >= 300000 THEN 'time' WHEN empty3 = 3 THEN 'nothing new' END AS reason FROM s)"""


@query(f"{_STOP} SELECT user_id, min(step) AS step, arg_min(reason, step) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1")
def stop_reasons(spark, d):
    """Where and why an investigation stops: the first rule that holds at its first step."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    sec = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    s = table(spark, d, "events").select(
        "user_id", F.count(F.lit(1)).over(w).alias("step"), F.sum((F.col("event_type") == "purchase").cast("int")).over(w).alias("strong"), F.sum("value").over(w).alias("evidence"),
        (sec - F.min(sec).over(w)).alias("elapsed"), F.sum((F.col("event_type") == "error").cast("int")).over(last).alias("empty3"),
    )
    c = F.col
    reason = F.when(c("strong") >= 3, "strong evidence").when(c("step") >= 10, "iterations").when(c("step") >= 12, "steps").when(c("evidence") >= 100, "evidence").when(c("elapsed") >= 300000, "time").when(c("empty3") == 3, "nothing new")
    r = s.withColumn("reason", reason).where("reason is not null")
    return r.groupBy("user_id").agg(F.min(F.struct("step", "reason")).alias("x")).select("user_id", "x.step", "x.reason")


# -- routes, impact lists, assets and gates (A4, F4, F40, G4, J22, M10, M16, M27, M28, S7, S15, T10) ------------------------
@query(
    Q._bfs_sql(8, "src", "dst", "'CALLS','IMPORTS','INHERITS'")
    + """, e AS (SELECT DISTINCT repository_id, src, dst FROM ge WHERE rel IN ('CALLS','IMPORTS','INHERITS')),
      pr AS (SELECT m.repository_id, m.start, m.id, m.distance, min(e.src) AS prev FROM m JOIN e ON e.repository_id = m.repository_id AND e.dst = m.id JOIN m p ON p.repository_id = m.repository_id AND p.start = m.start AND p.id = e.src AND p.distance = m.distance - 1 GROUP BY ALL),
      rt(repository_id, start, id, distance, route) AS (SELECT repository_id, start, id, 0, [id] FROM m WHERE distance = 0 UNION ALL SELECT pr.repository_id, pr.start, pr.id, pr.distance, list_append(rt.route, pr.id) FROM rt JOIN pr ON pr.repository_id = rt.repository_id AND pr.start = rt.start AND pr.prev = rt.id AND pr.distance = rt.distance + 1)
      SELECT repository_id, start, id, CAST(distance AS BIGINT) AS distance, array_to_string(route, ' > ') AS route FROM rt WHERE distance > 0"""
)
def shortest_routes(spark, d):
    """A shortest path of at most eight hops from each seed to what it reaches."""
    n, e = Q.graph_of(spark, d)
    reached = G.bfs(e, Q._seed_starts(spark, d, n), 8, rels=G.TRACE)
    return G.routes(reached, e).where("distance > 0").select("repository_id", "start", "id", big("distance"), F.array_join("route", " > ").alias("route"))


@query(
    Q._bfs_sql(4, "dst", "src", "'CALLS','IMPORTS','INHERITS'")
    + " SELECT m.repository_id, start, array_to_string(list_sort(list_distinct(list(file_path) FILTER (file_path IS NOT NULL))), ',') AS files, array_to_string(list_sort(list_distinct(list(module_name) FILTER (module_name IS NOT NULL))), ',') AS modules FROM m JOIN ln ON ln.repository_id = m.repository_id AND ln.cid = m.id WHERE distance > 0 GROUP BY 1, 2"
)
def impact_lists(spark, d):
    """The files and modules that a change of a seed affects, distinct and in order."""
    n, e = Q.graph_of(spark, d)
    out = G.bfs(e, Q._seed_starts(spark, d, n), 4, reverse=True, rels=G.TRACE).where("distance > 0")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return out.join(n.select("repository_id", "id", "file_path", "module_name"), ["repository_id", "id"]).groupBy("repository_id", "start").agg(listed("file_path").alias("files"), listed("module_name").alias("modules"))


@query(
    f"""SELECT evidence_id, CASE WHEN s BETWEEN 1 AND len(l) THEN array_to_string(l[s:least(e, len(l))], chr(10)) ELSE '# Symbol ' || qualified_name || ' defined in ' || file_path || ':' || s || '-' || e END AS snippet
      FROM (SELECT evidence_id, qualified_name, file_path, coalesce(nullif(start_line, 0), 1) AS s, coalesce(nullif(end_line, 0), coalesce(nullif(start_line, 0), 1)) AS e, {_sql_lines('source_code')} AS l FROM evidence WHERE source_code IS NOT NULL AND qualified_name IS NOT NULL AND file_path IS NOT NULL) WHERE e >= s"""
)
def context_snippets(spark, d):
    """Lines counted from 1, and a comment that names the symbol where there are none."""
    c = F.col
    s = F.coalesce(F.nullif("start_line", F.lit(0)), F.lit(1))
    t = table(spark, d, "evidence").where("source_code is not null and qualified_name is not null and file_path is not null").select(
        "evidence_id", "qualified_name", "file_path", s.alias("s"), F.coalesce(F.nullif("end_line", F.lit(0)), s).alias("e"), "source_code", F.size(X.lines(c("source_code"))).alias("n")
    ).where("e >= s")
    note = F.concat(F.lit("# Symbol "), "qualified_name", F.lit(" defined in "), "file_path", F.lit(":"), c("s").cast("string"), F.lit("-"), c("e").cast("string"))
    return t.select("evidence_id", F.when((c("s") >= 1) & (c("s") <= c("n")), X.line_slice(c("source_code"), c("s") - 1, c("e") - 1)).otherwise(note).alias("snippet"))


@query(
    rf"""WITH l AS (SELECT doc_id, no, unnest(string_split_regex(line, '[^\p{{L}}\p{{M}}\p{{N}}_]+')) AS sym FROM (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS no FROM (SELECT doc_id, {_sql_lines('text')} AS x FROM documents WHERE text IS NOT NULL)))
      SELECT sym, CASE WHEN contains(sym, 'Service') THEN 'SERVICE' ELSE 'CLASS' END AS kind, count(*) AS n, min(no) AS first_line FROM l WHERE regexp_full_match(sym, '[A-Z][a-zA-Z0-9_]+') AND regexp_matches(sym, '(Service|Controller|Manager|Repository|Model|View|Handler|Middleware|User|Auth|Token|Order)$') GROUP BY 1, 2"""
)
def documented_parts(spark, d):
    """Parts of a system that documents name, by the endings of their names."""
    t = table(spark, d, "documents").where("text is not null").select(F.posexplode(X.lines(F.col("text"))).alias("no", "line"))
    s = t.select("no", F.explode(X.symbols(F.col("line"))).alias("sym")).where(F.exists(F.array(*[F.lit(x) for x in rules.KNOWN_SUFFIXES]), lambda x: F.endswith(F.col("sym"), x)))
    return s.groupBy("sym", F.when(F.col("sym").contains("Service"), "SERVICE").otherwise("CLASS").alias("kind")).agg(F.count(F.lit(1)).alias("n"), (F.min("no") + 1).cast("bigint").alias("first_line"))


@query(
    """SELECT DISTINCT repository_id, path, 'ast_' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(repository_id || ':' || path)), 1, 10) AS asset_id, sha256(content) AS hash, octet_length(content) AS size FROM source_files WHERE content IS NOT NULL AND repository_id IS NOT NULL AND path IS NOT NULL"""
)
def asset_rows(spark, d):
    """Assets with their name-based ids, digests and sizes."""
    t = table(spark, d, "source_files").where("content is not null and repository_id is not null and path is not null")
    return t.select("repository_id", "path", rules.asset_id(F.col("repository_id"), F.col("path")).alias("asset_id"), F.sha2("content", 256).alias("hash"), F.length("content").cast("bigint").alias("size")).distinct()


_GATE = """now AS (SELECT 'mean_value' AS metric, avg(value) AS value FROM events UNION ALL SELECT 'p95_latency', quantile_disc(value, 0.95) FROM events WHERE value IS NOT NULL UNION ALL SELECT 'error_share', avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM events),
      base(metric, value) AS (VALUES ('mean_value', 10.0::DOUBLE), ('p95_latency', 20.0), ('error_share', 0.1), ('unknown', 1.0))"""


@query(f"WITH {_GATE} SELECT metric, CASE WHEN contains(metric, 'latency') AND n.value > b.value * 1.5 OR NOT contains(metric, 'latency') AND n.value < b.value * 0.95 THEN 'REGRESSION' WHEN contains(metric, 'latency') AND n.value < b.value OR NOT contains(metric, 'latency') AND n.value > b.value THEN 'IMPROVEMENT' ELSE 'UNCHANGED' END AS verdict FROM now n JOIN base b USING (metric)")
def baseline_gate(spark, d):
    """Metrics of now against a baseline; what only one side has is left out."""
    e = table(spark, d, "events")
    one = M.percentiles(e.where("value is not null").withColumn("k", F.lit(1)), "k", "value", {"p95_latency": ("disc", 0.95)}).select("p95_latency")
    now = e.agg(F.avg("value").alias("mean_value"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    now = now.unpivot([], ["mean_value", "error_share"], "metric", "value").unionByName(one.unpivot([], ["p95_latency"], "metric", "value"))
    base = spark.createDataFrame([("mean_value", 10.0), ("p95_latency", 20.0), ("error_share", 0.1), ("unknown", 1.0)], "metric string, value double")
    return M.regressions(now, base)


@query(
    f"""WITH {_NODES}, c AS (SELECT DISTINCT item_id, repository_id, t FROM (SELECT item_id, repository_id, unnest(regexp_extract_all(item_text, '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM eval_items) WHERE length(t) >= 3 AND lower(t) NOT IN ('the','and','for','not','add','reject','invalid','values','value','arguments','argument','input','with',
        'negative','validation','age','table','users','drop','run','database')),
      m AS (SELECT item_id, ln.cid AS id, ln.label, ln.file_path, ln.repository_id FROM c JOIN ln ON ln.repository_id = c.repository_id AND ln.name = c.t AND ln.label IN ('Class', 'Function', 'Method')),
      r AS (SELECT m.item_id, m.id, CASE WHEN m.label <> 'Class' AND EXISTS (SELECT 1 FROM m k WHERE k.item_id = m.item_id AND k.label = 'Class' AND k.file_path = m.file_path) THEN 1 WHEN m.label <> 'Class' THEN 2 ELSE 3 END AS p FROM m)
      SELECT item_id, arg_min(id, (p, id)) AS id, min(p) AS priority FROM r GROUP BY 1"""
)
def target_grounding(spark, d):
    """What a request is about: a function in the file of a class it names too, else any function, else a class."""
    words = X.words_but(F.col("item_text"), rules.CHANGE_SKIP_WORDS, "[A-Za-z_][A-Za-z0-9_]*", 3)
    c = _items(spark, d).select("item_id", "repository_id", F.explode(words).alias("name"))
    m = c.join(Q.nodes_of(spark, d).where("label in ('Class', 'Function', 'Method')").select("repository_id", "name", "id", "label", "file_path"), ["repository_id", "name"])
    m = materialize(m.select("item_id", "id", "label", "file_path"), "named-nodes")
    files = m.where("label = 'Class' and file_path is not null").select("item_id", "file_path").distinct().withColumn("with_class", F.lit(True))
    p = F.when((F.col("label") != "Class") & F.col("with_class"), 1).when(F.col("label") != "Class", 2).otherwise(3)
    return m.join(files, ["item_id", "file_path"], "left").groupBy("item_id").agg(F.min(F.struct(p.alias("p"), "id")).alias("x")).select("item_id", "x.id", F.col("x.p").alias("priority"))


@query(
    """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS n, sum(value) OVER w AS used, count(*) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS same, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
      r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN same > 1 THEN 'FAILURE: repeated' WHEN n >= 5 THEN 'FAILURE: iterations' WHEN used >= 300 THEN 'FAILURE: budget' END AS verdict FROM s) SELECT user_id, min(n) AS iterations, arg_min(verdict, n) AS verdict FROM r WHERE verdict IS NOT NULL GROUP BY 1"""
)
def repair_stops(spark, d):
    """Where a loop of attempts ends: success, an attempt that was there before, too many attempts, or a spent budget."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    again = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "events").select("user_id", "event_type", F.count(F.lit(1)).over(w).alias("n"), F.sum("value").over(w).alias("used"), F.count(F.lit(1)).over(again).alias("same"))
    v = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("same") > 1, "FAILURE: repeated").when(F.col("n") >= 5, "FAILURE: iterations").when(F.col("used") >= 300, "FAILURE: budget")
    r = s.withColumn("verdict", v).where("verdict is not null")
    return r.groupBy("user_id").agg(F.min(F.struct("n", "verdict")).alias("x")).select("user_id", F.col("x.n").alias("iterations"), "x.verdict")


@query(
    """WITH a AS (SELECT query_id, repository_id, entity_id AS id, max(retrieval_score) AS score, 'CODE' AS kind FROM evidence WHERE entity_id IS NOT NULL AND retrieval_score IS NOT NULL GROUP BY 1, 2, 3
        UNION ALL SELECT e.query_id, d.repository_id, 'document:' || d.doc_id, 0.92, 'DOCUMENT' FROM (SELECT DISTINCT query_id, repository_id FROM evidence) e JOIN (SELECT repository_id, min(doc_id) AS doc_id FROM documents WHERE doc_kind = 'design_note' GROUP BY 1) d ON d.repository_id = e.repository_id)
      SELECT query_id, id, kind, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repository_id, id) AS rank FROM a) WHERE rank <= 5"""
)
def merged_results(spark, d):
    """Code and document results of a query in one ranking, the best five."""
    e = table(spark, d, "evidence")
    code = e.where("entity_id is not null and retrieval_score is not null").groupBy("query_id", "repository_id", F.col("entity_id").alias("id")).agg(F.max("retrieval_score").alias("score")).withColumn("kind", F.lit("CODE"))
    note = table(spark, d, "documents").where("doc_kind = 'design_note'").groupBy("repository_id").agg(F.min("doc_id").alias("doc_id"))
    docs = e.select("query_id", "repository_id").distinct().join(note, "repository_id").select("query_id", "repository_id", F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("id"), F.lit(0.92).alias("score"), F.lit("DOCUMENT").alias("kind"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "repository_id", "id")
    return code.unionByName(docs).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "id", "kind", "score", big("rank"))
