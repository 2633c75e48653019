import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators import orphans as O

T0 = dt.datetime(2025, 1, 1)
EDGES = "edge_id bigint, repository_id string, source_id string, relationship_type string, target_id string, observed_at timestamp_ntz, ingested_at timestamp_ntz"
NODES = "node_no bigint, repository_id string, id string, label string, name string, first_seen_at timestamp_ntz, deleted_at timestamp_ntz"
IMPORTS = "import_id bigint, repository_id string, module_name string, module string, is_relative boolean, level int, observed_at timestamp_ntz"


def day(n):
    return T0 + dt.timedelta(hours=n)


def found(spark, edges, nodes, imports=(), external=()):
    e = spark.createDataFrame(list(edges), EDGES)
    n = spark.createDataFrame(list(nodes), NODES)
    i = spark.createDataFrame(list(imports), IMPORTS)
    x = spark.createDataFrame(list(external), "module_root string, origin string")
    return {(r.ref_table, r.ref_id) for r in O.orphans(e, i, x, n).collect()}


def test_lives_blanks_paths_and_nulls(spark):
    nodes = [(1, "r", "file:a.py", "File", "a.py", day(10), day(20)), (2, "r", "file:a.py", "File", "a.py", day(30), None), (3, None, "x", "File", "x", day(0), None)]
    edges = [
        (1, "r", "s", "CALLS", " file:./a.py\t", day(10), day(0)),  # born at that time
        (2, "r", "s", "CALLS", "file:a.py", day(20), day(0)),  # gone at that time
        (3, "r", "s", "CALLS", "file:a.py", day(29), day(0)),
        (4, "r", "s", "CALLS", "file:../a.py", day(31), day(0)),
        (5, "r", "s", "CALLS", None, day(31), day(0)),
        (6, "q", "s", "CALLS", "file:a.py", day(31), day(0)),  # another repository
        (7, None, "s", "CALLS", "x", day(31), day(0)),
        (8, "r", "s", "CALLS", "file:a.py", None, day(0)),
        (9, "r", "s", "CALLS", "", day(31), day(0)),
    ]
    assert found(spark, edges, nodes) == {("edges", i) for i in (2, 3, 6, 7, 8, 9)}


def test_imports(spark):
    nodes = [(1, "r", "module:a.b", "Module", "a.b", day(0), None), (2, "r", "class:a.c:X", "Class", "a.c", day(0), None)]
    imports = [
        (1, "r", "a.x", " a.b ", False, 0, day(5)),
        (2, "r", "a.x", "a.c", False, 0, day(5)),  # only a class has that name
        (3, "r", "a.x", "b", True, 1, day(5)),
        (4, "r", "a.x", "b", True, 2, day(5)),
        (5, "r", "a.x", None, True, 1, day(5)),
        (6, "r", "a.x", "os.path", False, 0, day(5)),
        (7, "r", "a.x", "os", True, 1, day(5)),  # relative ones are never external
    ]
    assert found(spark, [], nodes, imports, [("os", "stdlib")]) == {("imports", i) for i in (2, 4, 7)}


def test_empty_tables_and_repeats(spark):
    assert found(spark, [], []) == set()
    twice = [(1, "r", "s", "CALLS", "t", day(1), day(1)), (2, "r", "s", "CALLS", "t", day(1), day(1))]
    assert found(spark, twice, []) == {("edges", 1), ("edges", 2)}


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    nodes, edges = [], []
    for i in range(120):
        a = rnd.randrange(200)
        nodes.append((i, f"r{i % 2}", f"n{rnd.randrange(12)}", "File", "x", day(a), None if rnd.random() < 0.2 else day(a + rnd.randrange(60))))
    for i in range(400):
        edges.append((i, f"r{i % 2}", "s", "CALLS", "n0" if i % 3 == 0 else f"n{rnd.randrange(15)}", day(rnd.randrange(260)), day(0)))
    want = set()
    for e in edges:
        live = any(n[1] == e[1] and n[2] == e[4] and n[5] <= e[5] and (n[6] is None or e[5] < n[6]) for n in nodes)
        if not live:
            want.add(("edges", e[0]))
    assert found(spark, edges, nodes) == want


def test_extra_columns_do_not_clash(spark):
    e = spark.createDataFrame([(1, "r", "s", "CALLS", "t", day(1), day(1))], EDGES).withColumn("scope", F.lit(1)).withColumn("key", F.lit(2)).withColumn("salt", F.lit(3))
    n = spark.createDataFrame([], NODES).withColumn("born", F.lit(1)).withColumn("gone", F.lit(1))
    i = spark.createDataFrame([], IMPORTS)
    x = spark.createDataFrame([], "module_root string, origin string")
    out = O.orphans(e, i, x, n)
    assert out.count() == 1
    report = O.orphan_report(O.edge_references(e).unionByName(O.import_references(i, x)), out).collect()
    assert [(r.ref_table, r.period, r.n_refs, r.n_orphans) for r in report] == [("edges", "2025-01", 1, 1)]


def test_burst_of_one_key_within_an_hour(spark, monkeypatch):
    """Thousands of references of one key in one hour, against lives that begin and end in it, with and without salt."""
    import datetime as dt
    import random

    rnd, t0 = random.Random(2), dt.datetime(2024, 1, 1, 10)
    lives = [("s", "k", t0 + dt.timedelta(minutes=a), t0 + dt.timedelta(minutes=b)) for a, b in ((-120, -70), (-65, 3), (5, 9), (7, 20), (40, 41))]
    refs = [("edges", i, "s", "k", t0 + dt.timedelta(seconds=rnd.randrange(-9000, 5000))) for i in range(3000)]
    want = {i for _, i, _, _, at in refs if not any(b <= at < g for _, _, b, g in lives)}
    r = spark.createDataFrame(refs, "ref_table string, ref_id bigint, scope string, key string, at timestamp_ntz")
    p = spark.createDataFrame(lives, "scope string, key string, born timestamp_ntz, gone timestamp_ntz")
    for rows in (1_000_000, 100):
        monkeypatch.setattr(O, "ROWS_PER_SALT", rows)
        assert {x.ref_id for x in O.orphan_references(r, p).collect()} == want
