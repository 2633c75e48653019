import random

import numpy as np

from graphloom.llm import origin as O

FILES = "file_id bigint, repository_id string, path string, content binary"
UP = "tp_id int, package string, version string, file_name string, language string, content binary"


def expand(symbol, rules):
    r = {s: (a, b) for s, a, b in rules}
    return expand(r[symbol][0], rules) + expand(r[symbol][1], rules) if symbol in r else [symbol]


def test_repair_is_a_grammar_of_its_input():
    rnd = random.Random(1)
    for n in (0, 1, 2, 5, 60, 400):
        seq = [rnd.randrange(1, 5) for _ in range(n)]
        left, rules, _ = O.repair(np.array(seq, dtype=np.int64))
        assert all(a and b for _, a, b in rules) and left + 2 * len(rules) <= max(n, 2)
    assert O.repair(np.array([1] * 9, dtype=np.int64))[0] <= 5
    left, rules, top = O.repair(np.array([1, 2, 1, 2, 1, 2, 3], dtype=np.int64))
    assert expand(rules[0][0], rules) == [1, 2]


HAND = '''\
"""Reads the table that the generator writes."""
import os

HEADER = "# Code generated by tool. DO NOT EDIT."


def write(rows, path):
    # The table that this module writes is auto-generated output; the module itself is maintained by hand.
    if not rows:
        return None
    for row in rows:
        print(row, file=path)
    return os.path.join(path, "x")
'''
GENERATED = "# Automatisch erzeugt aus x.xsd - nicht von Hand bearbeiten\n_f = tuple\n\n\nclass T:\n" + "".join(f"    a{i} = _f(({i}, {i % 7}))\n" for i in range(30))
TRAILER = "_f = dict\n\n\nclass T:\n" + "".join(f"    b{i} = _f({i}, {i % 7})\n" for i in range(30)) + "\n# end of autogenerated section; regenerate with `make x`\n"
MINIFIED = "/*! x v1 */\n" + "".join(f"var a{i}=b||{{}},c=[{i},2];function d{i}(e){{return e.f?c(e):null}}" for i in range(60))
BLOB = "DATA = (\n" + "".join('    "' + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=76)) + '"\n' for i in range(30)) + ")\n"
UPSTREAM = "# Copyright (c) them.\n# Permission granted.\n\n" + HAND.replace("write", "lookup").replace("rows", "nodes")


def test_features_in_text():
    assert O.is_notice("# @generated by x") and O.is_notice("This file was automatically generated by y.") and not O.is_notice("# generates tables")
    assert O.code_of("python", b"# a\r\n\r\nx = 1  \r\n\r\n") == "x = 1" == O.code_of("python", b"x = 1")
    assert O.code_of("js", b"// c\n/* d */\nx()\n") == "x()"


def test_operator(spark):
    rows = [
        (1, "r", "a/hand.py", HAND), (2, "q", "a/hand.py", HAND), (3, "r", "a/t.py", GENERATED), (4, "r", "a/u.py", TRAILER), (5, "r", "web/x.js", MINIFIED), (6, "r", "a/data.py", BLOB),
        (7, "r", "a/util/mine.py", "# local copy\n" + UPSTREAM.split("\n\n", 1)[1].replace("\n", "  \r\n")), (8, "r", "a/vendor/p/x.py", HAND + "\ny = 1\n"), (9, "r", "a/vendors/x.py", HAND + "\nz = 1\n"), (10, "r", "a/vendor.py", HAND + "\nq = 1\n"),
        (11, "r", "a.json", "{}"), (12, "r", "node_modules/p/package.json", "{}"), (13, "r", "e.py", ""), (14, "r", None, "x"), (15, "r", "a/other.py", UPSTREAM.replace("print", "emit")), (16, "r", "a/t2.py", GENERATED), (17, "r", "a/util/short.py", "x = 1\n"),
    ]
    files = spark.createDataFrame([(i, r, p, bytearray(c.encode())) for i, r, p, c in rows] + [(18, "r", "n.py", None)], FILES)
    up = spark.createDataFrame([(1, "p", "1", "x.py", "python", bytearray(UPSTREAM.encode())), (2, "p", "1", "s.py", "python", bytearray(b"# c\nx = 1\n")), (3, "p", "1", "n.py", None, None)], UP)
    got = {r.file_id: r.reasons for r in O.reasons(files.selectExpr("*", "1 as notice", "2 as rules"), up).collect() if r.reasons}
    assert got == {3: ["generated"], 4: ["generated"], 5: ["minified"], 6: ["blob"], 7: ["vendored"], 8: ["vendored"], 16: ["generated"], 17: ["vendored"]}
    assert O.reasons(files.limit(0), up.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "r", "bin.js", bytearray(bytes(range(256)) * 4)), (2, "r", "q.py", bytearray(b"'''open"))], FILES)
    assert O.reasons(odd, up).count() == 2
    assert {r.file_id for r in O.reasons(files, up.limit(0)).where("size(reasons) > 0").collect()} == {3, 4, 5, 6, 8, 16}


def test_grammar_decides(spark, monkeypatch):
    """High rule reuse needs no notice, a notice on code without reuse says nothing, and without Re-Pair the rows change."""
    silent = GENERATED.split("\n", 1)[1]
    table = "# kept by hand\n" + silent
    words = "# Code generated by tool. DO NOT EDIT.\n" + HAND
    loud = "DATA = (\n" + '    "the same words again and again, "\n' * 60 + ")\n"
    rows = [(1, silent), (2, table), (3, words), (4, BLOB), (5, loud + "# kept by hand\n")]
    feats = {i: O.features(i, "r", "python", "a/x.py", c.encode()) for i, c in rows}
    files = spark.createDataFrame([(i, "r", "a/x.py", bytearray(c.encode())) for i, c in rows], FILES)
    up = spark.createDataFrame([], UP)
    got = {r.file_id: r.reasons for r in O.reasons(files, up).collect() if r.reasons}
    assert got == {1: ["generated"], 4: ["blob"]}
    monkeypatch.setattr(O, "repair", lambda tokens, least=2: (len(tokens), [], 0))
    without = {i: O.features(i, "r", "python", "a/x.py", c.encode()) for i, c in rows}
    reuse = O._COLUMNS.index("reuse")
    assert feats[1][reuse] >= O.REUSE["python"][1] > O.REUSE["python"][0] > without[1][reuse]


def test_shared_rules(spark):
    files = spark.createDataFrame([(i, r, "a/x.py", bytearray(GENERATED.encode())) for i, r in ((1, "r"), (2, "q"), (3, "q"))], FILES)
    got = O.shared_rules(files).collect()
    assert {r.file_id for r in got} == {1, 2, 3} and all(r.most == 2 and r.n_shared == r.n_rules > 0 for r in got)
    assert O.shared_rules(files.limit(0)).count() == 0


def test_equal_contents_in_different_places(spark):
    """A content is parsed once, but what its place says holds for each file."""
    rows = [(1, "r", "a/x.py", HAND), (2, "r", "a/vendor/x.py", HAND), (3, "q", "b/x.py", HAND), (4, "q", "b/x.js", HAND), (5, "q", "node_modules/x.py", HAND)]
    files = spark.createDataFrame([(i, r, p, bytearray(c.encode())) for i, r, p, c in rows], FILES)
    got = {r.file_id: (r.repository_id, r.reasons) for r in O.reasons(files, spark.createDataFrame([], UP)).collect()}
    assert got == {1: ("r", []), 2: ("r", ["vendored"]), 3: ("q", []), 4: ("q", []), 5: ("q", ["vendored"])}
