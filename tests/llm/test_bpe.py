import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD_TEXTS, docs_frame, with_clashes

from marginscope.llm import bpe, queries

RANKS = queries.ranks()
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(RANKS)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_pattern_is_the_tokenizers():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_random_texts_equal_tiktoken(merges):
    rnd = random.Random(3)
    alphabet = "ab AB\n\t  '.,!?12é漢字ß…  \x1c\x85  sdtre lv'😀\0"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 999, " " * 77, "=" * 500, "aaaaaaab" * 50, "……… ………", None, ""]
    for t, got in zip(texts, bpe.Encoder(merges).block(texts)):
        assert ids(got) == TIKTOKEN.encode_ordinary(t or ""), repr(t)


def test_replay_equals_one_word_at_a_time(merges):
    rnd = random.Random(4)
    words = [bytes(rnd.choice(b"abcde \xc3\xa9.") for _ in range(rnd.randint(1, 25))) for _ in range(2000)]
    assert [ids(x) for x in merges.replay(words)] == [merges.encode_one(w) for w in words]


def test_merge_that_makes_a_lower_rank():
    # "ab" (rank 300) makes "abc" (rank 256), which must go before the second "ab"
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 400, b"ab": 300, b"aba": 299, b"cab": 500}
    m = bpe.Merges(ranks)
    words = [b"abcabab", b"ababab", b"abab", b"cababc", b"abaabc"]
    assert [ids(x) for x in m.replay(words)] == [m.encode_one(w) for w in words]


def test_cache_is_bounded(merges, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e = bpe.Encoder(merges)
    for t in ("one two three four five", "six seven", "one two"):
        assert ids(e.block([t])[0]) == TIKTOKEN.encode_ordinary(t)
        assert len(e.known) <= 8


def test_query_equals_tiktoken(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = TIKTOKEN.encode_ordinary(texts[r["doc_id"]] or "")
        raw = np.array(want, dtype="<u4").tobytes()
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_odd_rows(spark):
    docs = with_clashes(docs_frame(spark, ODD_TEXTS), "ids", "_ids", "n_tokens")
    rows = bpe.round_trip(docs, RANKS).collect()
    assert len(rows) == len(ODD_TEXTS)
    want = sorted((i is None, i or 0, len(TIKTOKEN.encode_ordinary(t or ""))) for i, t in ODD_TEXTS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows) == want
    out = bpe.encode_documents(docs, RANKS)
    assert out.columns.count("ids") == 1 and "n_tokens" in out.columns
    got = out.where("doc_id = 8").select(bpe.unpack(out["ids"]).alias("u"), bpe.decoder(RANKS)("ids").alias("d")).first()
    assert got["u"] == TIKTOKEN.encode_ordinary(ODD_TEXTS[7][1]) and bytes(got["d"]).decode() == ODD_TEXTS[7][1]
    assert out.where("doc_id = 1").select(bpe.unpack(out["ids"])).first()[0] == []
    assert bpe.round_trip(docs_frame(spark, []), RANKS).count() == 0
