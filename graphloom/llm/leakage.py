"""Evaluation texts leaking into training text (problem 9).

Method: a distributed positional inverted index. ``build_index`` reads the corpus once and stores a posting (word, doc_id,
pos) for every token of every document, sorted by word inside each shard; a shard holds the documents of one partition, so
nothing is shuffled to build it. All searches read that table only, over any number of item sets: term counts come from its
word column; for every window of ``WORDS`` consecutive item words the two rarest terms are the window's anchors, whose
lists are intersected after adjusting offsets; the diagonals that survive are checked word by word against the postings of
the documents they lie in. Runs of matching words of at least ``WORDS`` are exact phrase matches; items whose words come back
in order with gaps are proximity matches.

Test items are a small table by nature, but its size is checked: only up to ``MAX_BROADCAST`` item words are broadcast;
beyond that the same joins shuffle, with ``SALTS`` parts of the postings of each word, as a frequent one may be a large share.

Defined cases: null or empty texts and items match nothing; an item of fewer than ``WORDS`` words has no window; repeated
items are items of their own; the same passage twice in a document gives one pair; words are compared in lower case; other
columns of the tables are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import materialize

WORDS = 13
MAX_BROADCAST = 2_000_000
SALTS = 32
#: Share of an item's words that must come back, within so many words of a diagonal, for a proximity match.
COVER, DRIFT = 0.6, 20


def words(text: str):
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def build_index(docs: DataFrame) -> DataFrame:
    """The stored postings (word, doc_id, pos) of all documents."""
    tokens = docs.where("text is not null").select("doc_id", F.posexplode(words("text")).alias("pos", "word"))
    return materialize(tokens.select("word", "doc_id", "pos").sortWithinPartitions("word", "doc_id", "pos"), "positional-index")


def _of_words(index: DataFrame, by_word: DataFrame, n: int) -> DataFrame:
    """The join of postings with a table keyed by word that has up to ``n`` rows."""
    if n <= MAX_BROADCAST:
        return index.join(F.broadcast(by_word), "word")
    salted = by_word.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).drop("salt")


def _item_words(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, ipos, word, n_words) and the number of rows."""
    raw = items.where("item_text is not null").select("item_id", words("item_text").alias("w"))
    out = materialize(raw.select("item_id", F.size("w").alias("n_words"), F.posexplode("w").alias("ipos", "word")), "item-words")
    return out, out.count()


def _anchors(index: DataFrame, item_words: DataFrame, n: int, width: int) -> DataFrame:
    """The two rarest terms of the windows of item words: (item_id, word, ipos, word2, shift, reach), shift from the first
    to the second, reach the item positions of all windows with these two. A window with a term the corpus lacks is no
    anchor: nothing can match it."""
    freq = _of_words(index.select("word", "doc_id"), item_words.select("word").distinct(), n).groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    known = item_words.join(freq, "word", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    w = Window.partitionBy("item_id").orderBy("ipos").rowsBetween(0, width - 1)
    two = known.select(
        "item_id", F.col("ipos").alias("start"), "n_words", F.min("cf").over(w).alias("least"),
        F.slice(F.array_sort(F.collect_list(F.struct("cf", "ipos", "word")).over(w)), 1, 2).alias("two"),
    ).where((F.col("start") + width <= F.col("n_words")) & (F.col("least") > 0))
    a, b = F.col("two")[0], F.col("two")[F.size("two") - 1]
    two = two.select("item_id", a["word"].alias("word"), a["ipos"].alias("ipos"), b["word"].alias("word2"), (b["ipos"] - a["ipos"]).alias("shift"), F.explode(F.sequence("start", F.col("start") + (width - 1))).alias("r"))
    return two.groupBy("item_id", "word", "ipos", "word2", "shift").agg(F.collect_set("r").alias("reach"))


def _diagonals(index: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(doc_id, item_id, diag, reach): document position less item position, where both rarest terms of a window agree,
    and the item positions of those windows."""
    terms = anchors.select("word").unionByName(anchors.select(F.col("word2").alias("word"))).distinct()
    postings = materialize(_of_words(index, terms, n), "anchor-postings")
    first = _of_words(postings, anchors, n).select(
        "doc_id", "item_id", "reach", (F.col("pos") - F.col("ipos")).alias("diag"), (F.col("pos") + F.col("shift")).alias("pos"), F.col("word2").alias("word")
    )
    return first.join(postings, ["doc_id", "pos", "word"], "left_semi").select("doc_id", "item_id", "diag", "reach")


def _agreeing(index: DataFrame, items: DataFrame, width: int, whole: bool) -> DataFrame:
    """(doc_id, item_id, diag, ipos, n_words): item positions whose word stands in the document on a diagonal that two
    anchors of a window of ``width`` words share; positions of such windows only, or of the ``whole`` item."""
    item_words, n = _item_words(items)
    anchors = materialize(_anchors(index, item_words, n, width), "anchors")
    diagonals = materialize(_diagonals(index, anchors, n), "diagonals")
    hit = diagonals.select("doc_id").distinct()
    there = index.join(_small(hit, hit.count()), "doc_id", "left_semi")
    if whole:
        wanted = diagonals.select("doc_id", "item_id", "diag").distinct().join(_small(item_words, n), "item_id")
    else:
        wanted = diagonals.select("doc_id", "item_id", "diag", F.explode("reach").alias("ipos")).distinct().join(_small(item_words, n), ["item_id", "ipos"])
    wanted = wanted.select("doc_id", "item_id", "diag", "ipos", "n_words", "word", (F.col("diag") + F.col("ipos")).alias("pos"))
    return wanted.join(there, ["doc_id", "pos", "word"], "left_semi").drop("word")


def phrase_matches(index: DataFrame, items: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, item_id, doc_from, item_from, n_words): maximal runs of at least ``width`` item words in an indexed document."""
    agree = _agreeing(index, items, width, whole=False)
    w = Window.partitionBy("doc_id", "item_id", "diag").orderBy("ipos")
    runs = agree.withColumn("run", F.col("ipos") - F.row_number().over(w)).groupBy("doc_id", "item_id", "diag", "run")
    return runs.agg(F.min("ipos").alias("item_from"), F.count(F.lit(1)).cast("int").alias("n_words")).where(F.col("n_words") >= width).select(
        "doc_id", "item_id", (F.col("item_from") + F.col("diag")).alias("doc_from"), "item_from", "n_words"
    )


def leaked_pairs(index: DataFrame, items: DataFrame, width: int = WORDS) -> DataFrame:
    return phrase_matches(index, items, width).select("doc_id", "item_id").distinct()


def proximity_matches(index: DataFrame, items: DataFrame, cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    """(doc_id, item_id, cover): items of which at least ``cover`` of the words stand in a document close to one diagonal.

    Candidates come from windows of five words, so a passage with words put in or changed every few words is found;
    matches of diagonals in the same band of ``drift`` words add up, each item word once.
    """
    agree = _agreeing(index, items, 5, whole=True)
    band = F.explode(F.array(F.floor(F.col("diag") / drift), F.floor(F.col("diag") / drift) + 1))
    near = agree.withColumn("band", band).groupBy("doc_id", "item_id", "band", "n_words").agg(F.countDistinct("ipos").alias("hits"))
    share = near.groupBy("doc_id", "item_id").agg(F.max(F.col("hits") / F.col("n_words")).alias("cover"))
    return share.where(F.col("cover") >= cover).select("doc_id", "item_id", F.round("cover", 4).alias("cover"))
