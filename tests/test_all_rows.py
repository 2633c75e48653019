"""Queries that once left rows out: every row counts, whatever its line ends."""

from graphloom.plans import reference_queries as Q


def test_second_list_ranks_all_rows(spark, sf_dir):
    rows = [(r.vec_id, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label").collect()]
    want = {}
    for qid, label in rows:
        if qid % 20 == 0 and label is not None:
            best = sorted((b != label, v) for v, b in rows if b in (label, label + 1))[:10]
            want |= {(qid, v): i for i, (_, v) in enumerate(best, 1)}
    got = {(r.qid, r.vid): r["rank"] for r in Q._second(spark, sf_dir).collect()}
    assert got == want and any(v % 7 for _, v in got)
    fused = Q.hybrid_rrf(spark, sf_dir).collect()
    assert len({(r.qid, r.entity) for r in fused}) == len(fused)
    for r in fused:
        if r.sources == "graph":
            assert r.score == round(1 / (60 + want[r.qid, r.entity]), 8)
    assert any(r.entity % 7 and "graph" in r.sources for r in fused)


def test_documents_with_any_line_end(spark, tmp_path):
    texts = ["a\r\nAnchorStore and NodeGraph\r\na Snapshot\r\n", "x\rmanifest 1\rTextIndex", "NodeGraph\x0bTextIndex snapshot", "AnchorStore TextIndex\n", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert {tuple(r) for r in Q.keyword_scan(spark, d).collect()} == {(0, 3, "a Snapshot"), (1, 2, "manifest 1"), (2, 2, "TextIndex snapshot")}
    assert {tuple(r) for r in Q.symbol_mentions(spark, d).collect()} == {("AnchorStore", 2, 2), ("NodeGraph", 2, 2), ("TextIndex", 3, 3)}
    pairs = {("AnchorStore", "NodeGraph"), ("AnchorStore", "TextIndex")}
    assert {tuple(r) for r in Q.symbol_comention(spark, d).collect()} == {(*p, 1) for a, b in pairs for p in ((a, b), (b, a))}


def test_chunks_of_any_text(spark, tmp_path):
    codes = ["a\nb\nc\n", "a\r\nb\x0cc", "a\u2028b\r", "a", None, ""]
    spark.createDataFrame(list(enumerate(codes)), "evidence_id bigint, source_code string").write.parquet(f"{tmp_path}/evidence.parquet")
    got = {tuple(r) for r in Q.chunk_slice(spark, str(tmp_path)).collect()}
    assert got == {(0, "b\nc", 3), (1, "b\nc", 3), (2, "b", 2), (3, "", 1), (5, "", 0)}
