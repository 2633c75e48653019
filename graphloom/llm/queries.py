"""Queries of the training-data problems (3 to 10) and their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import table
from graphloom.llm import docpairs, leakage, lexicon, origin, personal, secrets, splitting, syntax


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(table(spark, sf_dir, "evidence"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_items(table(spark, sf_dir, "evidence"))
    return pieces.where("piece_no = 1 and n_pieces > 1").select("evidence_id")


def p6_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces put together again, each without what it repeats, and whether all keep the limit."""
    p = splitting.split_items(table(spark, sf_dir, "evidence"))
    part = F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("new"), (F.length("piece") <= splitting.LIMIT).alias("fits"))
    g = p.groupBy("evidence_id").agg(F.array_sort(F.collect_list(part)).alias("x"))
    return g.select("evidence_id", F.sha2(F.array_join(F.transform("x", lambda s: s["new"]), ""), 256).alias("h"), F.forall("x", lambda s: s["fits"]).alias("fits"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(leakage.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.phrase_matches(leakage.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.proximity_matches(leakage.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_phrases(spark, sf_dir)
    return found.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").cast("bigint").alias("longest"), F.count(F.lit(1)).alias("n_passages")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "evidence"), table(spark, sf_dir, "patch_changes"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "evidence"), table(spark, sf_dir, "patch_changes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mentions(table(spark, sf_dir, "documents")).select("doc_id", F.size("found").alias("n_mentions"), "redacted")


QUERIES = {f.__name__: f for f in (p5_found, p5_redacted, p10_found, p10_redacted, p6_pieces, p6_joined, p6_found, p8_ids, p9_found, p9_phrases, p9_proximity, p9_report)}

_GRAMS = r"""
iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}_]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw)),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw)),
hit AS (SELECT doc_id, item_id, ig.i AS a, dg.i - ig.i AS diag FROM dg JOIN ig USING (g)),
runs AS (
  SELECT doc_id, item_id, diag, min(a) - 1 AS item_from, count(*) + 12 AS n
  FROM (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY a) AS run FROM hit) GROUP BY doc_id, item_id, diag, run)
"""

ORACLE = {
    "p6_joined": "SELECT evidence_id, sha256(source_code) AS h, true AS fits FROM evidence WHERE length(source_code) > 4000",
    "p6_found": "SELECT evidence_id FROM evidence WHERE length(source_code) > 4000",
    "p9_found": f"WITH {_GRAMS} SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_phrases": f"WITH {_GRAMS} SELECT doc_id, item_id, CAST(item_from + diag AS INT) AS doc_from, CAST(item_from AS INT) AS item_from, CAST(n AS INT) AS n_words FROM runs",
    "p9_report": f"""WITH {_GRAMS} SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(max(n) AS BIGINT) AS longest, count(*) AS n_passages
        FROM runs GROUP BY item_id""",
}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(_files(spark, sf_dir)).select("repository_id", "path", "qualified_name")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(_files(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(_files(spark, sf_dir)).select("file_id")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(_files(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return syntax.rates(files, syntax.invalid_files(files))


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.step_quality(_files(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.reasons(_files(spark, sf_dir), table(spark, sf_dir, "third_party_files")).where("size(reasons) > 0").select("file_id")


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = origin.reasons(_files(spark, sf_dir), table(spark, sf_dir, "third_party_files"))
    return got.select("file_id", "repository_id", "lang", F.array_join("reasons", "+").alias("reasons"))


def p7_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = p7_reasons(spark, sf_dir)
    return r.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.when(F.col("reasons") == "", 1).otherwise(0)).alias("n_handwritten")
    )


def p7_shared_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.shared_rules(_files(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (p3_found, p3_pairs, p4_found, p4_files, p4_rates, p4_steps, p7_found, p7_reasons, p7_repositories, p7_shared_rules)}
