import random

from graphloom.llm import leakage as K

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, item_text string"


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as term", "2 as pos")
    i = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as term", "2 as word")
    return {(r.doc_id, r.item_id) for r in K.leaked_pairs(K.build_index(d), i).collect()}


def brute(docs, items):
    import re

    w = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda t: {tuple(x[i : i + 13]) for x in [w(t)] for i in range(len(x) - 12)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 20
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "one two")]
    docs = []
    for i in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(80))]
        if i % 2:
            src = rnd.choice(items[:20])[1].split()
            a = rnd.randrange(max(1, len(src) - 12))
            words[5:5] = src[a : a + rnd.randrange(10, 20)]
        docs.append((i, rnd.choice([" ", ", ", "\n> * "]).join(words).upper() if i % 3 else " ".join(words)))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (103, docs[1][1])]
    want = brute(docs, items)
    assert want and pairs(spark, docs, items) == want


def test_runs_are_maximal_and_repeats_give_one_pair(spark):
    item = " ".join(f"t{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"a b {item} c {item}"), (2, " ".join(f"t{i}" for i in range(12)))], DOCS)
    i = spark.createDataFrame([(9, item)], ITEMS)
    got = sorted((r.doc_id, r.doc_from, r.item_from, r.n_words) for r in K.phrase_matches(K.build_index(d), i).collect())
    assert got == [(1, 2, 0, 20), (1, 23, 0, 20)]
    assert K.leaked_pairs(K.build_index(d), i).count() == 1


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert K.leaked_pairs(K.build_index(d.limit(0)), i).count() == 0 and K.leaked_pairs(K.build_index(d), i.limit(0)).count() == 0


def test_proximity_finds_changed_passages(spark):
    words = [f"t{i}" for i in range(40)]
    changed = [w if i % 8 != 7 else "noise" for i, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(reversed(words)))], DOCS)
    i = spark.createDataFrame([(5, " ".join(words))], ITEMS)
    assert [(r.doc_id, r.item_id) for r in K.proximity_matches(K.build_index(d), i).collect()] == [(1, 5)]
    assert K.leaked_pairs(K.build_index(d), i).count() == 0


def test_shuffled_plan_gives_the_same(spark, monkeypatch):
    item = " ".join(f"t{i}" for i in range(20))
    docs, items = [(1, "x " + item), (2, "y")], [(9, item)]
    monkeypatch.setattr(K, "MAX_BROADCAST", 0)
    assert pairs(spark, docs, items) == {(1, 9)}


def test_one_index_serves_several_item_sets(spark, tmp_path):
    """The corpus is read to build the index and never again: it may be gone when the items are looked up."""
    import shutil

    item = " ".join(f"t{i}" for i in range(20))
    other = " ".join(f"u{i}" for i in range(16))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "x " + item), (2, other + " y"), (3, None)], DOCS).write.parquet(path)
    index = K.build_index(spark.read.parquet(path))
    shutil.rmtree(path)
    for items, want in (([(9, item)], {(1, 9)}), ([(8, other)], {(2, 8)}), ([(7, "nothing of it")], set())):
        table = spark.createDataFrame(items, ITEMS)
        assert {(r.doc_id, r.item_id) for r in K.leaked_pairs(index, table).collect()} == want
        assert {(r.doc_id, r.item_id) for r in K.proximity_matches(index, table).collect()} == want


def test_proximity_recall(spark):
    """Items with a changed, dropped or added word every six to ten words come back in at least nine of ten cases."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items, docs = [], []
    for n in range(120):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 80))]
        items.append((n, " ".join(words)))
        changed, at = [], rnd.randrange(6, 11)
        for k, w in enumerate(words):
            how = rnd.choice(("change", "drop", "add")) if k % at == at - 1 else ""
            changed += {"": [w], "change": ["zz"], "drop": [], "add": [w, "zz"]}[how]
        noise = [rnd.choice(vocab) for _ in range(60)]
        docs.append((n, " ".join(noise[:30] + changed + noise[30:])))
    found = {(r.doc_id, r.item_id) for r in K.proximity_matches(K.build_index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, ITEMS)).collect()}
    hits = sum((n, n) in found for n in range(120))
    assert hits >= 108 and len(found) <= 1.1 * hits
