"""Plans that must hold at any size: unbounded search, ranks without a large task, streams that go on after a restart."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import graphs as G
from graphloom.operators import metrics as M
from graphloom.operators import retrieval as R
from graphloom.sources import parsing
from graphloom.streaming import events as E


def test_search_without_a_limit(spark):
    e = spark.createDataFrame([("r", f"n{i}", "INHERITS", f"n{i + 1}") for i in range(12)], "repository_id string, src string, rel string, dst string")
    st = spark.createDataFrame([("r", "n0")], "repository_id string, id string")
    assert {(r.id, r.distance) for r in G.bfs(e, st, None).collect()} == {(f"n{i}", i) for i in range(13)}
    assert {r.id for r in G.bfs(e, st, 3).collect()} == {"n0", "n1", "n2", "n3"}
    assert {r.distance for r in G.bfs(e.limit(0), st, None).collect()} == {0}


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(4)
    rows = [(k, round(rnd.random() * 20, 1)) for k in "aab" for _ in range(137)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"disc": ("disc", 0.95), "cont": ("cont", 0.95), "idx": ("index", 0.95), "med": ("cont", 0.5)}
    for r in M.percentiles(df, "k", "v", wanted).collect():
        xs = sorted(v for k, v in rows if k == r.k)
        assert r.disc == xs[int(np.ceil(0.95 * len(xs))) - 1] and r.idx == xs[round(0.95 * (len(xs) - 1))]
        assert abs(r.cont - np.percentile(xs, 95)) < 1e-9 and abs(r.med - np.percentile(xs, 50)) < 1e-9
    assert M.percentiles(df.limit(0), "k", "v", wanted).count() == 0


def test_topk_over_several_parts(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in np.round(rnd.normal(size=4), 1)], i % 3) for i in range(120)] + [(200, None, 0), (201, [0.0] * 4, 1)]
    v = spark.createDataFrame(vecs, "vid bigint, vec array<double>, g int")
    q = v.where("vid % 20 = 0").select(F.col("vid").alias("qid"), F.col("vec").alias("qvec"), "g")
    one = sorted(tuple(r) for r in R.cosine_topk(q, v, 7).collect())
    scoped = sorted(tuple(r) for r in R.cosine_topk(q, v, 7, "g").collect())
    monkeypatch.setattr(R, "PART_VECTORS", 11)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    assert sorted(tuple(r) for r in R.cosine_topk(q, v, 7).collect()) == one
    assert sorted(tuple(r) for r in R.cosine_topk(q, v, 7, "g").collect()) == scoped
    assert all(r[0] % 3 == r[1] % 3 for r in scoped if r[0] < 200 and r[1] < 200)


def test_repeated_deliveries_are_parsed_once(spark, monkeypatch):
    rows = [(1, "r", "a.py", b"x = 1"), (2, "r", "a.py", b"x = 1"), (3, "r", "a.py", b"x = 2"), (4, "q", "a.py", b"x = 1"), (5, "r", "b.py", None)]
    df = spark.createDataFrame([(i, r, p, None if c is None else bytearray(c)) for i, r, p, c in rows], "file_id bigint, repository_id string, path string, content binary")
    for most in (1_000_000, 0):
        monkeypatch.setattr(parsing, "MAX_REPEATS", most)
        assert {r.file_id for r in parsing.once_delivered(df.where("content is not null")).collect()} == {1, 3, 4}


def test_streams_go_on_and_take_empty_folders(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "base")
    cols = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

    def put(n, rows):
        spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double, props string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{src}/events{n}.parquet")

    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.schema(cols).option("recursiveFileLookup", True).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    assert E.upsert_latest(read()).count() == 0 and E.run_updates(E.windows(read()), ["start", "event_type"]).count() == 0
    put(1, [(1, "2024-01-01 00:00:00", 7, "view", 1.0, None), (2, "2024-01-01 00:05:00", 8, "view", 1.0, None)])
    assert {(r.user_id, r.event_id) for r in E.upsert_latest(read(), base).collect()} == {(7, 1), (8, 2)}
    put(2, [(3, "2024-01-01 00:10:00", 7, "click", 1.0, None)])
    assert {(r.user_id, r.event_id) for r in E.upsert_latest(read(), base).collect()} == {(7, 3), (8, 2)}
    w = {(r.event_type, r.n) for r in E.run_updates(E.windows(read()), ["start", "event_type"]).collect()}
    assert w == {("view", 2), ("click", 1)}
    assert E.run_complete(E.sessions(read())).count() == 2


def test_release_removes_what_was_stored(spark):
    path = catalog.app_dir(spark).removeprefix("file://")
    import os

    df = catalog.materialize(spark.range(3), "x")
    assert df.count() == 3 and os.path.isdir(path)
    first = catalog.once(spark, "y", "d", lambda: spark.range(2))
    assert catalog.once(spark, "y", "d", lambda: spark.range(9)) is first
    catalog.release(spark)
    assert not os.path.exists(path) and catalog.once(spark, "y", "d", lambda: spark.range(9)).count() == 9


def test_parts_that_documents_name(spark, tmp_path):
    from graphloom.plans import analysis_queries as A

    texts = ["The UserService calls the OrderRepository.\r\nUserService and Token", "a userservice, XService2 and Authority", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in A.documented_parts(spark, str(tmp_path)).collect()}
    assert got == {("UserService", "SERVICE", 2, 1), ("OrderRepository", "CLASS", 1, 1), ("Token", "CLASS", 1, 2)}


def test_dealing_out_keeps_all_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)], "i int, t string").coalesce(1)
    assert sorted(r.i for r in catalog.spread(df).collect()) == list(range(40))


def test_metrics_against_a_baseline(spark):
    now = spark.createDataFrame([("recall", 0.50), ("p50_latency_ms", 140.0), ("mrr", 0.9), ("x", 1.0)], "metric string, value double")
    base = spark.createDataFrame([("recall", 0.8667), ("p50_latency_ms", 100.0), ("mrr", 0.8), ("y", 1.0)], "metric string, value double")
    assert {tuple(r) for r in M.regressions(now, base).collect()} == {("recall", "REGRESSION"), ("p50_latency_ms", "UNCHANGED"), ("mrr", "IMPROVEMENT")}


def test_terms_meet_all_suffixes_without_a_broadcast(spark, tmp_path):
    from graphloom.plans import analysis_queries as A

    odd = [
        ("function:m:load_row", "Function", "load_row", "m.load_row"), ("method:m:C:load_row", "Method", "load_row", "m.C.load_row"), ("class:m:C", "Class", "CC", "m.CC"), ("class:a:row", "Class", "row", "row"), ("class:b:xrow", "Class", "xrow", "b.xrow"),
        ("file:a/row.py", "File", "row.py", None), ("module:m", "Module", "m", "m"), ("function:n", "Function", None, "q.r.row"), ("x", None, "", ""), ("yy", "Class", "ow", "z..ow"), ("aa:load_row", "File", "load_row", None),
    ]
    spark.createDataFrame([(i, r, *x, "2024-01-01") for i, (r, x) in enumerate((r, x) for r in "rq" for x in odd[: 11 if r == "r" else 3])], "node_no bigint, repository_id string, id string, label string, name string, qualified_name string, t string").selectExpr(
        "*", "cast(t as timestamp_ntz) as first_seen_at", "cast(t as timestamp_ntz) as ingested_at", "cast(null as timestamp_ntz) as deleted_at").drop("t").write.parquet(f"{tmp_path}/nodes.parquet")
    asked = ["m.load_row", "m.C.load_row", "C.load_row", "x.row", "a.ow", "CC", "m.CC", "row.py", "yy", "m", "r.row", ".ow", "load_row", "nothing", None, "", "_row"]
    spark.createDataFrame([(r, q) for r in ("r", "q", "z", None) for q in asked], "repository_id string, qualified_name string").write.parquet(f"{tmp_path}/evidence.parquet")
    words = {w for q in asked if q for w in (q, re.search("[^.]*$", q)[0], re.search("[^_.]*$", q)[0]) if len(w) >= 2}
    want = set()
    for r in "rq":
        for w in words:
            hit = []
            for i, label, name, qn in odd[: 11 if r == "r" else 3]:
                if w in (i, name, qn) or (qn or "").endswith("." + w) or (name or "").endswith(w):
                    hit.append((1 if label in ("Function", "Method") and w in (qn, name) else 2 if label == "Class" and qn == w else 3, i))
            if hit:
                want.add((r, w, min(hit)[1], min(hit)[0]))
    df = A.entity_resolution(spark, str(tmp_path))
    assert {tuple(x) for x in df.collect()} == want and {x[3] for x in want} == {1, 2, 3}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
