import random

import numpy as np
import pytest

from graphloom.llm import splitting as S

SCHEMA = "evidence_id bigint, start_line int, source_code string"


def test_range_maximum_ties_right():
    rnd = random.Random(1)
    v = np.array([rnd.randrange(4) for _ in range(200)])
    r = S.RangeMaximum(v)
    for _ in range(500):
        a = rnd.randrange(200)
        b = rnd.randrange(a, 200)
        assert r.query(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_round_trip_limit_and_overlap(end):
    rnd = random.Random(2)
    text = "".join(("def f%d():" % i if rnd.random() < 0.1 else "    " * rnd.randrange(3) + "x" * rnd.randrange(60)) + end for i in range(400))
    pieces = S.split(text)
    assert all(0 < len(p[3]) <= S.LIMIT for p in pieces)
    assert "".join(p[3][p[2] :] for p in pieces) == text
    lines = S._LINE.findall(text)
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] == a[1] - 1 and b[2] == len(lines[a[1] - 1]) + len(lines[a[1]])
    for first, last, _, piece in pieces:
        assert piece == "".join(lines[first : last + 1])


def test_cuts_before_definitions():
    body = "".join(f"    x{i} = {i}\n" for i in range(150))
    text = "".join(f"def f{k}():\n{body}\n\n" for k in range(6))
    cuts = [p[3][p[2] :] for p in S.split(text)[1:]]
    assert sum(c.startswith("def ") for c in cuts) >= 5


def test_long_lines_are_cut_at_natural_places():
    text = "a = [" + ", ".join(str(i) for i in range(9000)) + "]"
    pieces = S.split(text)
    assert all(len(p[3]) <= S.LIMIT for p in pieces) and "".join(p[3][p[2] :] for p in pieces) == text
    assert all(p[3][-1] in " ,]" for p in pieces)
    solid = "é" * 20_001
    assert "".join(p[3][p[2] :] for p in S.split(solid)) == solid


def test_operator_on_nulls_empty_repeats_and_extra_columns(spark):
    long = "line\n" * 1000
    rows = [(1, 10, long), (1, 10, long), (2, None, long), (3, -5, long), (4, 0, None), (5, 0, ""), (6, 0, "short"), (7, 3, "x" * 4000), (8, 3, "x" * 4001)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "2 as n_pieces")
    out = S.split_items(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.evidence_id, []).append(r)
    assert set(by) == {1, 2, 3, 8}
    assert len(by[1]) == 2 * len(by[2]) and min(r.start_line for r in by[1]) == 10 and min(r.start_line for r in by[2]) == 0 == min(r.start_line for r in by[3])
    assert all(sorted(r.piece_no for r in v) == list(range(1, v[0].n_pieces + 1)) for k, v in by.items() if k != 1)
    assert S.split_items(df.limit(0)).count() == 0
    assert S.split_items(df, oversized_only=False).where("evidence_id = 6").count() == 1
