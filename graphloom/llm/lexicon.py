"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method: a minimal acyclic transducer. The frequent words of the corpus, with the ids they encode to, are compiled into
an automaton that shares prefixes and suffixes; the words below each arc are counted, so the path of a word adds up to
its rank, and the rank points to its ids. The file is written once to the shared folder and memory-mapped by every
worker. Words the automaton doesn't know are merged exactly by the byte-pair ranks.

The counts of words cover the whole corpus; ``max_words`` bounds only what is compiled (and sent to the driver for it),
never what is encoded: rarer words take the exact merge.

Defined cases: a null or empty text gives an empty list; strings of special tokens are ordinary text; other columns are
not looked at; very long texts and words are encoded whole (the merge is a heap, n log n in the word).
"""

from __future__ import annotations

import base64
import heapq
import io
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import shared_dir, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_WORDS = 50_000
MIN_COUNT = 3
MAX_BYTES = 48
CACHE = 200_000
#: Texts that are held as id lists at a time.
SLICE = 1_000

_WORDS = regex.compile(PATTERN)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text)


class Ranks:
    """The vocabulary and the exact byte-pair merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}

    def merge(self, word: bytes) -> list[int]:
        of = self.of
        whole = of.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := of.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = part[i]
            j = right[i] if a is not None else -1
            if a is None or j < 0 or len(a) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = a + part[j], None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := of.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            h = left[i]
            if h >= 0 and (r := of.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [of[p] for p in part if p is not None]


def compile_transducer(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` as one block of arrays.

    Words are added in sorted order; what the next word doesn't share is minimised at once against the states seen so
    far (equal finality and arcs), so the automaton stays minimal. Arcs are keyed by state * 256 + byte in one sorted
    array, each with its target and the number of words that sort before those it leads to.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[list[tuple[int, int]]] = []
    path: list[list] = [[False, []]]  # open states: final, arcs

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            arcs.append(node[1])
        return register[key]

    last = b""
    for word in sorted(words):
        same = len(os.path.commonprefix([last, word]))
        while len(path) - 1 > same:
            state = close(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = close(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = close(path[0])

    below = [0] * len(finals)  # a state is closed after those it leads to
    keys, targets, skips = [], [], []
    for s, out in enumerate(arcs):
        n = int(finals[s])
        for byte, t in out:
            keys.append(s * 256 + byte)
            targets.append(t)
            skips.append(n)
            n += below[t]
        below[s] = n
    ids = [words[w] for w in sorted(words)]
    block = io.BytesIO()
    for a in (
        np.array([root], np.int64), np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array(finals, np.bool_),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([i for x in ids for i in x], np.int32),
    ):
        np.save(block, a)
    return block.getvalue()


class Transducer:
    """Reads the block, memory-mapped if it is a file, and looks up many words at once."""

    def __init__(self, source: str | bytes) -> None:
        raw = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        out, at = [], 0
        for _ in range(7):
            head = io.BytesIO(raw[at : at + 4096].tobytes())
            np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head)
            at += head.tell()
            size = int(np.prod(shape)) * kind.itemsize
            out.append(raw[at : at + size].view(kind))
            at += size
        self.root, self.keys, self.targets, self.skips, self.finals, self.starts, self.ids = out

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1: all words walk the automaton byte by byte together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        size = np.array([len(w) for w in words])
        width = int(size.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        state, rank, live = np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for i in range(width + 1):
            ended = live[size[live] == i]
            good = ended[self.finals[state[ended]]]
            out[good] = rank[good]
            live = live[size[live] > i]
            if not len(live):
                break
            want = state[live] * 256 + text[live, i]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            there = self.keys[arc] == want
            live, arc = live[there], arc[there]
            rank[live] += self.skips[arc]
            state[live] = self.targets[arc]
        return out

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        rank = self.rank(words)
        return [None if r < 0 else self.ids[self.starts[r] : self.starts[r + 1]].tolist() for r in rank]


class Encoder:
    """Words to ids through a bounded cache, the transducer, and the exact merge, in this order."""

    def __init__(self, vocabulary: str, transducer: Transducer) -> None:
        self.ranks, self.transducer = Ranks(vocabulary), transducer
        self.cache: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cache = self.cache
        split = [words_of(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in cache})
        if new:
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            short = [i for i, b in enumerate(raw) if len(b) <= MAX_BYTES]
            got: list[list[int] | None] = [None] * len(new)
            for i, ids in zip(short, self.transducer.look_up([raw[i] for i in short])):
                got[i] = ids
            for w, b, ids in zip(new, raw, got):
                cache[w] = self.ranks.merge(b) if ids is None else ids
        out = [[i for w in ws for i in cache[w]] for ws in split]
        if len(cache) > CACHE:
            cache.clear()
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, name: str, source: str | bytes) -> Encoder:
    key = (vocabulary, name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, Transducer(source))
    return _ENCODERS[key]


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts: counted per partition in Python, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                c.update(w for w in words_of(t) if len(w) <= MAX_BYTES)
            if len(c) > CACHE:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    src = texts.select(F.col(text).alias("text")).where("text is not null and text <> ''")
    return spread(src).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> bytes:
    """The transducer of the ``max_words`` most frequent words that occur at least ``min_count`` times."""
    top = word_counts(texts, text).where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(max_words).select("word")
    ranks = Ranks(vocabulary)
    words = {}
    for r in top.collect():  # bounded by max_words
        b = r["word"].encode("utf-8", "surrogatepass")
        if 0 < len(b) <= MAX_BYTES:
            words[b] = ranks.merge(b)
    return compile_transducer(words)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, **lexicon) -> DataFrame:
    """(key, ids) for every row of ``docs``."""
    spark = docs.sparkSession
    block = build_lexicon(docs, text, vocabulary, **lexicon)
    name = f"lexicon-{os.urandom(6).hex()}"
    folder = shared_dir(spark)
    if folder.startswith("file:") or folder.startswith("/"):
        where = folder.removeprefix("file:")
        where = "/" + where.lstrip("/")
        os.makedirs(where, exist_ok=True)
        with open(f"{where}/{name}", "wb") as f:
            f.write(block)
        source, shared = f"{where}/{name}", None
    else:  # not a mounted folder: the block, bounded by max_words, goes out as a broadcast
        source, shared = None, spark.sparkContext.broadcast(block)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in (b.iloc[i : i + SLICE] for b in batches for i in range(0, len(b), SLICE)):
            enc = enc or _encoder(vocabulary, name, source or shared.value)
            ids = enc.encode_batch([None if t is None or t is pd.NA else t for t in pdf["text"]])
            yield pd.DataFrame({"key": pdf["key"], "ids": ids})

    kind = docs.schema[key].dataType.simpleString()
    out = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(encode, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
