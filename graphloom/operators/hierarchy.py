"""Parent-child links to full hierarchies (problem 2).

Method: weighted disjoint-set forests. Each group of links builds a forest locally, in which every node carries its
offset (how many levels it lies below) to the root of its set. The forests of sub-groups are merged level by level:
only *boundary* nodes, those that occur in more than one sub-group, go up to the next level; all others are done and
learn their final root later by a join down the levels. A set whose offsets contradict each other may hold a cycle, and
no other set can. Only the links of such sets go through the exact check (``cycle_nodes``), which peels nodes without a
way in or out, again level by level, and looks for strongly connected sets in what is left.

Paths are then materialised by indexed parent traversal: each group climbs its own parent index as far as it reaches;
the group tops, few because links are grouped by the module they lie in, are resolved by pointer doubling.

Grouping. The links of a scope are counted, and it gets one group for every ``GROUP_LINKS`` of them. A link is placed by the
module its child lies in, so that a file's classes and methods meet in one group and only package links cross groups; ids
that name no module are placed by their parent. The links of a place that alone has more than ``GROUP_LINKS`` are dealt out by
child: any grouping is valid, it only makes more boundary nodes. Each level up has an eighth of the groups, as long as no
group of it gets more than ``MAX_GROUP`` links. A boundary that is larger still never meets in one task: it is contracted by
rounds of joins (each node is linked to its least neighbour, with the offset to it) until nothing changes, suspicious links
are peeled by rounds of anti-joins, and connected sets beyond ``MAX_GROUP`` links are searched for loops by reach.

Defined cases: links with a null end or scope are left out; repeated links count once; a link from a node to itself is a
cycle of one; an empty table gives empty results; ids are compared as given (callers clean them first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import clean_id, materialize

TYPES = ("CONTAINS", "DEFINES")
MAX_DOUBLINGS = 40
#: Links a group of the first level should have, how many groups become one on the next level, and the most links of a group.
GROUP_LINKS, FAN, MAX_GROUP = 50_000, 8, 2_000_000


def hierarchy_links(edges: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Distinct (scope, parent, child) of the given relationship types, with cleaned ids and without null ends."""
    return (
        edges.where(F.col("relationship_type").isin(*types) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select(F.col("repository_id").alias("scope"), clean_id("source_id").alias("parent"), clean_id("target_id").alias("child"))
        .where("scope is not null")
        .distinct()
    )


def _module(col: str):
    """The module an id lies in: ``a.b`` for ``file:a/b.py``, ``method:a.b:C:m`` and the like; null for ids without one."""
    body = F.element_at(F.split(F.concat(F.col(col), F.lit(":")), ":"), 2)
    path = F.translate(F.regexp_replace(body, r"(/__init__)?\.\w+$", ""), "/", ".")
    return F.nullif(F.when(F.col(col).startswith("file:"), path).when(F.col(col).contains(":"), body), F.lit(""))


def _up(col: str):
    """The number by which a node is placed on higher levels: that of its package, or its own."""
    return F.xxhash64(F.coalesce(F.substring_index(_module(col), ".", 2), F.col(col)))


def _grouped(links: DataFrame) -> DataFrame:
    """``links`` with ``groups``, the number of groups of their scope, and ``part``, the one they fall in. All counts combine
    on the map side; scopes and places are joined by value."""
    placed = links.withColumn("place", F.xxhash64(F.coalesce(_module("child"), F.col("parent"))))
    per_place = placed.groupBy("scope", "place").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_place.groupBy("scope").agg(F.ceil(F.sum("n") / GROUP_LINKS).cast("int").alias("groups"))
    hot = per_place.where(F.col("n") > GROUP_LINKS).select("scope", "place", F.ceil(F.col("n") / GROUP_LINKS).cast("int").alias("salts"))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("child"), F.col("salts"))).otherwise(0)
    out = placed.join(sizes, "scope").join(hot, ["scope", "place"], "left")
    return out.withColumn("part", F.pmod(F.xxhash64("place", salt), F.col("groups")).cast("int")).drop("place", "salts")


def encode(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links in numbers, names): ids become 64-bit numbers, as strings would be most of what is shuffled.

    links: (s, groups, part, parent, child, parent_up, child_up), with the number of groups of the scope and the numbers by
    which the ends are placed on higher levels; names: (id, scope, node). Equal numbers of different names are looked for,
    and another seed is taken until there are none.
    """
    nodes = links.select("scope", F.col("parent").alias("node")).unionByName(links.select("scope", F.col("child").alias("node"))).distinct()
    for seed in range(8):
        number = lambda c: F.xxhash64(F.lit(seed), "scope", c)  # noqa: B023, E731
        names = materialize(nodes.select(number("node").alias("id"), "scope", "node"), "names")
        if names.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed without equal numbers")
    coded = _grouped(links).select(
        F.xxhash64("scope").alias("s"), "groups", "part", number("parent").alias("parent"), number("child").alias("child"), _up("parent").alias("parent_up"), _up("child").alias("child_up")
    )
    return materialize(coded, "coded-links"), names


def _next_level(level: DataFrame, i: int, up: str) -> DataFrame:
    """``level`` with the groups of level ``i``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("groups") / FAN**i))
    return level.withColumn("part", F.pmod(F.col(up), n).cast("int"))


def _largest(level: DataFrame, *keys: str) -> int:
    return level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


class WeightedForest:
    """Union-find with path compression and union by size; ``off[x]`` is x's level minus that of its root."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.off: dict = {}
        self.size: dict = {}
        self.bad: set = set()

    def find(self, x) -> tuple:
        up, off = self.up, self.off
        if x not in up:
            up[x], off[x], self.size[x] = x, 0, 1
            return x, 0
        chain = []
        while up[x] != x:
            chain.append(x)
            x = up[x]
        total = 0
        for y in reversed(chain):
            total += off[y]
            up[y], off[y] = x, total
        return x, total

    def link(self, parent, child, weight: int = 1) -> None:
        """States that ``child`` lies ``weight`` levels below ``parent``."""
        (a, x), (b, y) = self.find(parent), self.find(child)
        if a == b:
            if y - x != weight:
                self.bad.add(a)
            return
        if self.size[a] < self.size[b]:
            a, b, x, y, weight = b, a, y, x, -weight
        self.up[b], self.off[b] = a, x + weight - y
        self.size[a] += self.size[b]
        if b in self.bad:
            self.bad.add(a)

    def rows(self) -> Iterator[tuple]:
        for x in list(self.up):
            root, off = self.find(x)
            yield x, root, off, root in self.bad


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[pd.DataFrame]]]:
    """The runs of equal keys in a partition sorted by them, across batch borders."""
    now, parts = None, []
    for pdf in batches:
        if not len(pdf):
            continue
        for key, sub in pdf.groupby(keys, sort=False):
            if key != now:
                if parts:
                    yield now, parts
                now, parts = key, []
            parts.append(sub)
    if parts:
        yield now, parts


FOREST = "s bigint, groups int, part int, node bigint, root bigint, off int, bad boolean, node_up bigint, root_up bigint"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (scope, part), parts in _groups(batches, ["s", "part"]):
        f = WeightedForest()
        up: dict[int, int] = {}
        groups = int(parts[0]["groups"].iloc[0])
        for pdf in parts:
            for a, b, w, bad, x, y in zip(*(pdf[c].tolist() for c in ("parent", "child", "weight", "bad", "parent_up", "child_up"))):
                f.link(a, b, w)
                up[a], up[b] = x, y
                if bad:
                    f.bad.add(f.find(a)[0])
        rows = [(scope, groups, part, x, r, o, bad, up[x], up[r]) for x, r, o, bad in f.rows()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOREST.split(", ")])


def _run(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over groups (s, part), which lie together and sorted in a partition."""
    return df.repartition("s", "part").sortWithinPartitions("s", "part").mapInPandas(fn, schema)


def components(coded: DataFrame) -> DataFrame:
    """(node, root, off, bad) of encoded links: the set of each node, its level against the set's root, and whether the
    set's levels contradict each other (only then can it hold a cycle)."""
    level = coded.withColumn("weight", F.lit(1)).withColumn("bad", F.lit(False))
    steps: list[DataFrame] = []
    top = level.agg(F.max("groups")).first()[0] or 1
    last = 0 if top == 1 else math.ceil(math.log(top, FAN) - 1e-9)
    known = None
    for i in range(last + 1):
        forest = materialize(_run(level, _forest, FOREST), f"forest-{i}")
        if i == last:
            known = forest.select("node", "root", "off", "bad")
            break
        steps.append(forest)
        # Boundary nodes go up with the roots that stand for their sets; a set without one is complete.
        shared = forest.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
        level = forest.join(shared, "node", "left_semi").select(
            "s", "groups", F.col("root").alias("parent"), F.col("node").alias("child"), F.col("off").alias("weight"), "bad",
            F.col("root_up").alias("parent_up"), F.col("node_up").alias("child_up"),
        )
        level = materialize(_next_level(level, i + 1, "parent_up"), f"boundary-{i}")
        if _largest(level, "s", "part") > MAX_GROUP:
            known = contracted(level)
            break
    # A node may lie in several groups of a level; any of its rows leads to the same final root.
    for forest in reversed(steps):
        one = forest.groupBy("node").agg(F.min(F.struct("root", "off", "bad")).alias("x")).select("node", "x.*")
        top = known.select(F.col("node").alias("root"), F.col("root").alias("root2"), F.col("off").alias("off2"), F.col("bad").alias("bad2"))
        down = one.join(top, "root", "left").select(
            "node", F.coalesce("root2", "root").alias("root"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), (F.col("bad") | F.coalesce("bad2", F.lit(False))).alias("bad"),
        )
        known = down.join(known, "node", "left_anti").unionByName(known)
    known = materialize(known, "sets")
    worse = known.where("bad").select("root").distinct().withColumn("worse", F.lit(True))
    return known.drop("bad").join(worse, "root", "left").select("node", "root", "off", F.coalesce("worse", F.lit(False)).alias("bad"))


def contracted(level: DataFrame) -> DataFrame:
    """(node, root, off, bad) of weighted links (parent, child, weight, bad) whose boundary is too large for one task.

    Every round links each node to the least node around it (large star, then small star, as in the usual contraction by
    alternating stars), adding up offsets on the way; two offsets between the same two nodes that differ mark the set as bad.
    The state is a table of links from a lesser to a greater node, (a, b, w): b lies w levels below a.
    """

    def oriented(df: DataFrame) -> DataFrame:
        keep = F.col("a") <= F.col("b")
        df = df.select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(keep, F.col("w")).otherwise(-F.col("w")).alias("w"), "bad")
        df = df.withColumn("bad", F.col("bad") | (F.col("a") == F.col("b")) & (F.col("w") != 0))
        g = df.groupBy("a", "b").agg(F.min("w").alias("w"), F.max("w").alias("w2"), F.max("bad").alias("bad"))
        return g.select("a", "b", "w", (F.col("bad") | (F.col("w") != F.col("w2"))).alias("bad"))

    def star(links: DataFrame, large: bool) -> DataFrame:
        back = links.select(F.col("b").alias("u"), F.col("a").alias("v"), (-F.col("w")).alias("w"), "bad")
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "bad").unionByName(back)
        least = near.groupBy("u").agg(F.min(F.struct("v", "w")).alias("m")).select("u", F.col("m.v").alias("mv"), F.col("m.w").alias("mw"))
        own = F.col("u") < F.col("mv")
        least = least.select("u", F.when(own, F.col("u")).otherwise(F.col("mv")).alias("m"), F.when(own, F.lit(0)).otherwise(F.col("mw")).alias("mw"))
        side = near.where("v > u" if large else "v <= u").join(least, "u")
        moved = side.select(F.col("m").alias("a"), F.col("v").alias("b"), (F.col("w") - F.col("mw")).alias("w"), "bad")
        if not large:  # the node itself goes to its least neighbour
            moved = moved.unionByName(side.select(F.col("m").alias("a"), F.col("u").alias("b"), (-F.col("mw")).alias("w"), "bad"))
        return oriented(moved)

    now = materialize(oriented(level.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.col("weight").alias("w"), "bad")), "stars-0")
    loops = now.where("a = b").select(F.col("a").alias("node"), "bad")
    lone = materialize(loops, "lone")
    now = now.where("a <> b")
    i, state = 0, None
    while True:
        i += 1
        nxt = materialize(star(star(now, True), False), f"stars-{i}")
        lone = lone.unionByName(nxt.where("a = b and bad").select(F.col("a").alias("node"), "bad"))
        now = nxt.where("a <> b")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    to_root = now.select(F.col("b").alias("node"), F.col("a").alias("root"), F.col("w").alias("off"), "bad")
    roots = now.groupBy("a").agg(F.max("bad").alias("bad")).select(F.col("a").alias("node"), F.col("a").alias("root"), F.lit(0).alias("off"), "bad")
    alone = loops.select("node", F.col("node").alias("root"), F.lit(0).alias("off"), "bad")
    out = to_root.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min(F.struct("root", "off")).alias("x"), F.max("bad").alias("bad")).select("node", "x.root", "x.off", "bad")
    worse = lone.where("bad").select("node").distinct().withColumn("worse", F.lit(True))
    return out.join(worse, "node", "left").select("node", "root", "off", (F.col("bad") | F.coalesce("worse", F.lit(False))).alias("bad"))


def _strong(succ: dict) -> set[tuple]:
    """(node, loop) of the nodes that reach themselves (Tarjan, without recursion)."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    found: set[tuple] = set()
    for start in succ:
        if start in index:
            continue
        work = [(start, iter(succ[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(succ.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in succ.get(v, ()):
                        found.update((x, v) for x in part)
    return found


LEFT = "s bigint, groups int, parent bigint, child bigint, child_up bigint, root bigint"


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links left after nodes inside the group without a way in or a way out have gone, again and again."""
    for (scope, _), parts in _groups(batches, ["s", "part"]):
        out: dict[int, set[int]] = {}
        into: dict[int, set[int]] = {}
        fixed: set[int] = set()
        up: dict[int, tuple] = {}
        groups = int(parts[0]["groups"].iloc[0])
        for pdf in parts:
            for a, b, x, y, u, r in zip(*(pdf[c].tolist() for c in ("parent", "child", "parent_shared", "child_shared", "child_up", "root"))):
                out.setdefault(a, set()).add(b)
                into.setdefault(b, set()).add(a)
                up[b] = (u, r)
                if x:
                    fixed.add(a)
                if y:
                    fixed.add(b)
        todo = [n for n in {*out, *into} if n not in fixed and not (out.get(n) and into.get(n))]
        while todo:
            n = todo.pop()
            for m in out.pop(n, ()):
                into[m].discard(n)
                if not into[m] and m not in fixed:
                    todo.append(m)
            for m in into.pop(n, ()):
                if m in out:
                    out[m].discard(n)
                    if not out[m] and m not in fixed:
                        todo.append(m)
        left = [(scope, groups, a, b, *up[b]) for a, bs in out.items() for b in bs]
        if left:
            yield pd.DataFrame(left, columns=["s", "groups", "parent", "child", "child_up", "root"])


def _cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, parts in _groups(batches, ["root"]):
        succ: dict[int, list[int]] = {}
        for pdf in parts:
            for a, b in zip(pdf["parent"].tolist(), pdf["child"].tolist()):
                succ.setdefault(a, []).append(b)
        found = sorted(_strong(succ))
        if found:
            yield pd.DataFrame(found, columns=["id", "loop"])


def _trimmed(left: DataFrame) -> DataFrame:
    """``left`` without links that start at a node without a way in or end at one without a way out, by rounds."""
    n = left.count()
    for i in range(1_000_000):
        left = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        left = materialize(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), f"trim-{i}")
        m = left.count()
        if m == n:
            break
        n = m
    return left


def _by_reach(left: DataFrame) -> DataFrame:
    """(id, loop) of the nodes that reach themselves over the links (parent, child), without a group that has to fit a task.

    Rounds of colouring: each node takes the greatest node it can be reached from; what a colour's own node can be reached
    from inside its colour, backwards, is strongly connected with it. Those nodes go, the rest is trimmed, and so on.
    """
    found = None
    left = materialize(left.select("parent", "child"), "reach")
    while not left.isEmpty():
        nodes = left.select(F.col("parent").alias("id")).unionByName(left.select(F.col("child").alias("id"))).distinct()
        color = materialize(nodes.select("id", F.col("id").alias("color")), "color")
        while True:
            seen = left.join(color.withColumnRenamed("id", "parent"), "parent").groupBy(F.col("child").alias("id")).agg(F.max("color").alias("from"))
            nxt = color.join(seen, "id", "left").select("id", F.greatest("color", "from").alias("color"), (F.col("from") > F.col("color")).alias("went"))
            nxt = materialize(nxt, "color")
            color = nxt.drop("went")
            if nxt.where("went").isEmpty():
                break
        ends = left.join(color.select(F.col("id").alias("parent"), F.col("color").alias("c1")), "parent").join(color.select(F.col("id").alias("child"), F.col("color").alias("c2")), "child")
        same = materialize(ends.where("c1 = c2").select("parent", "child", F.col("c1").alias("color")), "same-color")
        reach = front = color.where("id = color")
        while True:
            back = same.join(front.select(F.col("id").alias("child"), "color"), ["child", "color"]).select(F.col("parent").alias("id"), "color").distinct()
            front = materialize(back.join(reach, "id", "left_anti"), "front")
            if front.isEmpty():
                break
            reach = materialize(reach.unionByName(front), "reached")
        inner = same.join(reach.select(F.col("id").alias("parent")), "parent", "left_semi").join(reach.select(F.col("id").alias("child")), "child", "left_semi")
        loops = materialize(inner.select(F.col("parent").alias("id"), F.col("color").alias("loop")).distinct(), "loops")
        found = loops if found is None else found.unionByName(loops)
        rest = left.join(reach.select(F.col("id").alias("parent")), "parent", "left_anti").join(reach.select(F.col("id").alias("child")), "child", "left_anti")
        left = _trimmed(materialize(rest, "rest"))
    return found if found is not None else left.select(F.col("parent").alias("id"), F.col("child").alias("loop"))


def cycle_nodes(links: DataFrame) -> DataFrame:
    """(scope, node, loop): nodes that reach themselves, with a number for the loop they share.

    Only links of sets with contradicting levels are looked at. They are peeled level by level, then by rounds where a group
    would be too large; what is left lies on or between cycles and is searched set by set.
    """
    coded, names = encode(links)
    suspect = components(coded).where("bad").select(F.col("node").alias("child"), "root")
    left = coded.join(suspect, "child").select("s", "groups", "part", "parent", "child", "child_up", "root")
    top = coded.agg(F.max("groups")).first()[0] or 1
    last = 0 if top == 1 else math.ceil(math.log(top, FAN) - 1e-9)
    for i in range(last + 1):
        left = materialize(_next_level(left, i, "child_up") if i else left, f"peel-{i}")
        if i and _largest(left, "s", "part") > MAX_GROUP:
            left = _trimmed(left)
            break
        ends = left.select(F.col("parent").alias("node"), "part").unionByName(left.select(F.col("child").alias("node"), "part")).distinct()
        shared = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
        for end in ("parent", "child"):
            left = left.join(shared.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_shared")), end, "left").withColumn(f"{end}_shared", F.coalesce(f"{end}_shared", F.lit(False)))
        left = _run(left, _peel, LEFT)
    left = materialize(left, "peeled")
    sizes = left.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > MAX_GROUP).select("root"), "large-sets")
    small = left.join(large, "root", "left_anti")
    found = small.repartition("root").sortWithinPartitions("root").mapInPandas(_cycles, "id bigint, loop bigint")
    if not large.isEmpty():
        found = found.unionByName(_by_reach(left.join(large, "root", "left_semi")))
    return materialize(found, "loops").join(names, "id").select("scope", "node", "loop")


def back_links(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """Links both of whose ends lie on the same loop; they lead back and are reported instead of followed."""
    a = cycles.select("scope", F.col("node").alias("parent"), F.col("loop").alias("loop_a"))
    b = cycles.select("scope", F.col("node").alias("child"), F.col("loop").alias("loop_b"))
    return links.join(a, ["scope", "parent"]).join(b, ["scope", "child"]).where("loop_a = loop_b").select("scope", "parent", "child")


def _climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node's path up to the first ancestor without a parent in the group; climbed paths are reused."""
    for (scope, _), parts in _groups(batches, ["scope", "part"]):
        up: dict[str, str] = {}
        for pdf in parts:
            up.update(zip(pdf["child"], pdf["parent"]))
        done: dict[str, tuple[str, list[str]]] = {}
        for node in up:
            chain, x = [], node
            while x in up and x not in done:
                chain.append(x)
                x = up[x]
            top, path = done[x] if x in done else (x, [])
            for y in reversed(chain):
                path = [*path, y]
                done[y] = (top, path)
        yield pd.DataFrame({"scope": scope, "node": list(done), "top": [t for t, _ in done.values()], "path": [p for _, p in done.values()]})


def hierarchy(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """(scope, node, parent, root, depth, path): one row per node, path from the root to the node.

    Links that lead back are not followed. A node with several parents hangs below the least of their ids, and below
    none if all its links lead back. Depth is 0 at a root.
    """
    nodes = links.select("scope", F.col("parent").alias("node")).unionByName(links.select("scope", F.col("child").alias("node"))).distinct()
    kept = links.join(back_links(links, cycles), ["scope", "parent", "child"], "left_anti")
    parent = kept.groupBy("scope", "child").agg(F.min("parent").alias("parent"))
    placed = _grouped(parent).repartition("scope", "part").sortWithinPartitions("scope", "part")
    local = materialize(placed.mapInPandas(_climb, "scope string, node string, top string, path array<string>"), "climb")
    tops = local.select("scope", F.col("top").alias("node")).distinct()
    # Pointer doubling over the tops only: (node, top, path) with path from below ``top`` down to the node.
    jump = materialize(local.join(tops, ["scope", "node"], "left_semi"), "tops-0")
    for i in range(1, MAX_DOUBLINGS):
        nxt = jump.select("scope", F.col("node").alias("top"), F.col("top").alias("top2"), F.col("path").alias("path2"))
        moved = jump.join(nxt, ["scope", "top"], "left").select(
            "scope", "node", F.coalesce("top2", "top").alias("top"),
            F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"),
            F.col("path2").isNotNull().alias("went"),
        )
        jump = materialize(moved, f"tops-{i}")
        if jump.where("went").isEmpty():
            break
        jump = jump.drop("went")
    above = jump.select("scope", F.col("node").alias("top"), F.col("top").alias("root"), F.col("path").alias("above"))
    full = local.join(above, ["scope", "top"], "left").select(
        "scope", "node", F.coalesce("root", "top").alias("root"),
        F.concat(F.array(F.coalesce("root", "top")), F.coalesce("above", F.array().cast("array<string>")), "path").alias("path"),
    )
    roots = nodes.join(parent.select("scope", F.col("child").alias("node")), ["scope", "node"], "left_anti").select(
        "scope", "node", F.col("node").alias("root"), F.array("node").alias("path")
    )
    out = full.unionByName(roots)
    return out.select(
        "scope", "node", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), "root",
        (F.size("path") - 1).alias("depth"), "path",
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(scope, node, descendant, distance) for every node below another; as many rows as the paths are long."""
    return tree.select("scope", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "node")).select(
        "scope", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance")
    )


def all_descendants(links: DataFrame, cycles: DataFrame) -> DataFrame:
    """(scope, node, descendant, distance) over every parent, not only the one a path goes by; distance is the least.

    Links that lead back are left out, so no node is below itself. Pairs are found by doubling: a way of length between
    2^k and 2^(k+1) goes on from a pair at exactly 2^k, so that in a tree each pair is formed once.
    """
    kept = links.join(back_links(links, cycles), ["scope", "parent", "child"], "left_anti")
    coded, names = encode(kept)
    known = coded.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(1).alias("distance"))
    for k in range(MAX_DOUBLINGS):
        far = known.where(F.col("distance") == 1 << k).select("a", F.col("b").alias("m"))
        on = known.select(F.col("a").alias("m"), "b", "distance")
        longer = far.join(on, "m").groupBy("a", "b").agg((F.min("distance") + (1 << k)).alias("distance"))
        new = materialize(longer.join(known, ["a", "b"], "left_anti"), f"pairs-{k}")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    node, below = (names.select(F.col("id").alias(c), "scope", F.col("node").alias(n)) for c, n in (("a", "node"), ("b", "descendant")))
    return known.join(node, "a").join(below.drop("scope"), "b").select("scope", "node", "descendant", "distance")


def with_descendant_counts(tree: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``tree`` with n_descendants, counted over ``pairs``; without them over the ancestors of every path, combined map-side."""
    n = (descendants(tree) if pairs is None else pairs).groupBy("scope", "node").agg(F.count(F.lit(1)).alias("n_descendants"))
    return tree.join(n, ["scope", "node"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)).cast("bigint"))
