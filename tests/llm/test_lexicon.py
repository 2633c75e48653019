import os
import random

import pytest

from graphloom.llm import lexicon as L

pytestmark = pytest.mark.skipif(not os.path.exists(L.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=L.PATTERN, mergeable_ranks=L.Ranks(L.VOCABULARY).of, special_tokens={})


def test_transducer_knows_its_words_and_no_others(tmp_path):
    rnd = random.Random(1)
    words = {bytes(rnd.choice(b"abcde") for _ in range(rnd.randrange(1, 9))): [i, i + 1] for i in range(500)}
    block = L.compile_transducer(words)
    (tmp_path / "x").write_bytes(block)
    for t in (L.Transducer(block), L.Transducer(str(tmp_path / "x"))):
        assert t.look_up(list(words)) == list(words.values())
        others = [w for w in (bytes(rnd.choice(b"abcdef") for _ in range(5)) for _ in range(300)) if w not in words]
        assert t.look_up(others) == [None] * len(others)
        assert t.look_up([]) == []
    assert L.Transducer(L.compile_transducer({})).look_up([b"a", b""]) == [None, None]


def test_states_are_shared():
    t = L.Transducer(L.compile_transducer({a + b"ing": [1] for a in (b"walk", b"talk", b"sing", b"ring")}))
    assert len(t.finals) < 12


def test_merge_equals_public_tokenizer(public):
    ranks = L.Ranks(L.VOCABULARY)
    rnd = random.Random(4)
    alphabet = "abcdeth ing\n\tÄéß日本🙂'll0123 _-ABC…"
    for _ in range(400):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
        assert [i for w in L.words_of(s) for i in ranks.merge(w.encode())] == public.encode_ordinary(s)
    long = "aB" * 5000 + "x" * 3000
    assert ranks.merge(long.encode()) == public._encode_single_piece(long)


def test_corpus(spark, public):
    texts = ["hello world hello", "hello world", None, "", "   \n\n  ", "<|endoftext|> is text", "naïve café — 日本語 👩‍💻", "x" * 5000, "hello world hello", "DON'T I'LL"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'a' as ids", "1 as key", "'w' as word")
    for bounds in ({"max_words": 2, "min_count": 2}, {"min_count": 1}, {"max_words": 0}):
        got = {r.doc_id: r.ids for r in L.encode_corpus(df, **bounds).collect()}
        assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert L.encode_corpus(df.limit(0)).count() == 0


def test_real_texts(spark, sf_dir, public):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: public.encode_ordinary(r.text) if r.text else [] for r in df.collect()}
    assert {r.doc_id: r.ids for r in L.encode_corpus(df).collect()} == want
