import random

import pytest

from graphloom.operators import hierarchy as H


def links(spark, pairs, scope="r"):
    return spark.createDataFrame([(scope, a, b) for a, b in pairs], "scope string, parent string, child string").distinct()


def reaches_itself(pairs):
    succ = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)
    out = set()
    for s in succ:
        seen, todo = set(), list(succ[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += succ.get(x, ())
        if s in seen:
            out.add(s)
    return out


def test_forest_offsets():
    f = H.WeightedForest()
    for a, b in (("a", "b"), ("b", "c"), ("d", "e"), ("c", "d")):
        f.link(a, b)
    off = {x: o for x, _, o, _ in f.rows()}
    assert [off[x] - off["a"] for x in "abcde"] == [0, 1, 2, 3, 4] and not f.bad
    f.link("e", "a")
    assert all(bad for *_, bad in f.rows())


@pytest.mark.parametrize(("seed", "group", "most"), [(1, 50_000, 2_000_000), (2, 4, 2_000_000), (3, 10, 5), (4, 1, 1)])
def test_cycles_against_brute_force(spark, monkeypatch, seed, group, most):
    """One group, many groups that merge level by level, and boundaries too large for a task."""
    monkeypatch.setattr(H, "GROUP_LINKS", group)
    monkeypatch.setattr(H, "MAX_GROUP", most)
    rnd = random.Random(seed)
    pairs = [(f"module:p{i // 4}.m{i}", f"module:p{rnd.randrange(12)}.m{rnd.randrange(50)}") for i in range(50)]
    pairs += [(f"module:p{i}.m{i}", f"class:p{i}.m{i}:C{j}") for i in range(10) for j in range(3)]
    pairs.append(("x", "x"))
    got = {r.node for r in H.cycle_nodes(links(spark, pairs)).collect()}
    assert got == reaches_itself(pairs)


def test_paths_depths_and_descendants(spark):
    pairs = [("repo", "file:a/__init__.py"), ("file:a/__init__.py", "module:a"), ("module:a", "file:a/b.py"), ("file:a/b.py", "module:a.b"), ("module:a.b", "class:a.b:C"), ("class:a.b:C", "method:a.b:C:m"), ("module:a.b", "function:a.b:f")]
    ln = links(spark, pairs)
    t = {r.node: r for r in H.with_descendant_counts(H.hierarchy(ln, H.cycle_nodes(ln))).collect()}
    assert t["method:a.b:C:m"].path == ["repo", "file:a/__init__.py", "module:a", "file:a/b.py", "module:a.b", "class:a.b:C", "method:a.b:C:m"]
    assert t["method:a.b:C:m"].depth == 6 and t["method:a.b:C:m"].root == "repo" and t["repo"].depth == 0
    assert t["repo"].n_descendants == 7 and t["module:a.b"].n_descendants == 3 and t["method:a.b:C:m"].n_descendants == 0


def test_loops_are_reported_not_followed(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")]
    ln = links(spark, pairs)
    cy = H.cycle_nodes(ln)
    assert {r.node for r in cy.collect()} == {"a", "b", "c"}
    assert {(r.parent, r.child) for r in H.back_links(ln, cy).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    t = {r.node: r.path for r in H.hierarchy(ln, cy).collect()}
    assert t["d"] == ["c", "d"] and t["a"] == ["z", "a"] and t["b"] == ["b"]


def test_long_chain_and_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_LINKS", 20)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("hub", f"leaf{i}") for i in range(500)]
    ln = links(spark, pairs)
    t = {r.node: r.depth for r in H.hierarchy(ln, H.cycle_nodes(ln)).collect()}
    assert t["n300"] == 300 and t["leaf7"] == 1
    loop = links(spark, [*pairs, ("leaf3", "hub")])
    assert {r.node for r in H.cycle_nodes(loop).collect()} == {"hub", "leaf3"}


def test_nulls_empty_and_repeats(spark):
    schema = "edge_id bigint, repository_id string, source_id string, relationship_type string, target_id string"
    e = spark.createDataFrame([(1, "r", None, "CONTAINS", "b"), (2, "r", "a", "CONTAINS", None), (3, None, "a", "CONTAINS", "b"), (4, "r", " a", "DEFINES", "a "), (5, "r", "a", "DEFINES", "a"), (6, "r", "a", "CALLS", "q")], schema)
    ln = H.hierarchy_links(e)
    assert [(r.parent, r.child) for r in ln.collect()] == [("a", "a")]
    empty = H.hierarchy_links(e.limit(0))
    assert H.cycle_nodes(empty).count() == 0 and H.hierarchy(empty, H.cycle_nodes(empty)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_over_every_parent(spark, seed):
    rnd = random.Random(seed)
    pairs = [("a", "c"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "y"), ("y", "d"), ("u", "v"), ("v", "u"), ("v", "w"), ("w", "w"), ("w", "d")]
    pairs += [(f"m{rnd.randrange(i)}", f"m{i}") for i in range(1, 40) for _ in range(2)]
    ln = links(spark, pairs)
    cycles = H.cycle_nodes(ln)
    kept = set(pairs) - {("u", "v"), ("v", "u"), ("w", "w")}
    want = {}
    for s in {x for p in kept for x in p}:
        level, n = {s}, 0
        while level := {b for a, b in kept if a in level}:
            n += 1
            for b in level:
                want.setdefault((s, b), n)
    pairs = H.all_descendants(ln, cycles)
    got = [((r.node, r.descendant), r.distance) for r in pairs.collect()]
    assert len(got) == len(want) and dict(got) == want and want["a", "d"] == 2 and ("b", "d") in want
    n = {r.node: r.n_descendants for r in H.with_descendant_counts(H.hierarchy(ln, cycles), pairs).collect()}
    assert n["b"] == 2 and n["a"] == 4 and n["w"] == 1 and n["u"] == 0


def test_no_links_have_no_descendants(spark):
    ln = links(spark, [("a", "a")])
    assert H.all_descendants(ln, H.cycle_nodes(ln)).count() == 0


def test_groups_by_size_whatever_the_ids_look_like(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_LINKS", 50)
    for pairs in ([(f"n{i // 3}", f"n{i}") for i in range(1, 2001)], [("hub", f"n{i}") for i in range(2000)], [("module:m", f"class:m:C{i}") for i in range(2000)]):
        sizes = [r["count"] for r in H._grouped(links(spark, pairs)).groupBy("part").count().collect()]
        assert len(sizes) >= 20 and max(sizes) <= 6 * H.GROUP_LINKS and sum(sizes) == 2000


def test_contraction_equals_merging(spark, monkeypatch):
    """Sets and levels are the same whether boundaries meet in a task or are contracted by joins."""
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(max(1, i - 30), i + 1)}" if i % 17 else f"r{i}", f"n{i + 1}") for i in range(70)] + [("n2", "n1"), ("n50", "n49")]
    coded, names = H.encode(links(spark, pairs))
    name = {r.id: r.node for r in names.collect()}

    def sets(rows):
        out = {}
        for r in rows:
            out.setdefault(r.root, []).append((name[r.node], r.off, r.bad))
        return {(frozenset(n for n, _, _ in v), frozenset((n, o - min(x for _, x, _ in v)) for n, o, _ in v) if not v[0][2] else None, v[0][2]) for v in out.values()}

    one = sets(H.components(coded).collect())
    monkeypatch.setattr(H, "GROUP_LINKS", 3)
    monkeypatch.setattr(H, "MAX_GROUP", 2)
    coded, names = H.encode(links(spark, pairs))
    name = {r.id: r.node for r in names.collect()}
    assert sets(H.components(coded).collect()) == one and any(bad for *_, bad in one) and not all(bad for *_, bad in one)
