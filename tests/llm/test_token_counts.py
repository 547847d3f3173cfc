import random

import public_tokenizers
import pytest
from helpers import ODD_TEXTS, docs_frame, with_clashes
from tokenizers import models

from marginscope.llm import queries, token_counts

PIECES, BYTES = token_counts.load_vocabulary(public_tokenizers.path(queries.UNIGRAM_PIECES))


def public_counts(pieces, byte_fallback, texts):
    """Token counts of the public unigram tokenizer over the same vocabulary."""
    least = min(s for _, s in pieces)
    byte = [(f"<0x{b:02X}>", least) for b in range(256)] if byte_fallback else []
    model = models.Unigram([("<unk>", 0.0 if byte_fallback else least)] + byte + pieces, 0, byte_fallback)
    return [len(model.tokenize("▁" + t.replace(" ", "▁"))) if t else 0 for t in texts]


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "ab AB\n\t  '.,!?12é漢字ß…  \x85 sdtre lv'the in 𒀀😀▁"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + [None, "", " ", "   a", "a   ", "漢" * 50]


def test_random_texts_equal_the_public_tokenizer():
    texts = random_texts(3000, 2)
    got = [n for n, _ in token_counts.Counter(PIECES, BYTES).block(texts)]
    assert got == public_counts(PIECES, BYTES, texts)


@pytest.mark.parametrize("seed", range(5))
def test_ties_and_unknown_characters(seed):
    """A small vocabulary full of ties, with and without byte pieces."""
    rnd = random.Random(seed)
    names = {"".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 4))) for _ in range(25)}
    pieces = [(p, -float(rnd.randint(1, 4))) for p in sorted(names)]
    texts = ["".join(rnd.choice("abc dé") for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    for byte_fallback in (True, False):
        got = [n for n, _ in token_counts.Counter(pieces, byte_fallback).block(texts)]
        assert got == public_counts(pieces, byte_fallback, texts)


def test_cut_is_the_same_as_whole_texts():
    texts = random_texts(500, 9)
    cut, whole = token_counts.Counter(PIECES, BYTES), token_counts.Counter(PIECES, BYTES)
    assert cut.cut
    whole.cut = False
    assert cut.block(texts) == whole.block(texts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], public_counts(PIECES, BYTES, [r["text"] for r in rows])))
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, sf).collect()}
    assert got == want


def test_odd_rows(spark):
    docs = with_clashes(docs_frame(spark, ODD_TEXTS), "n_tokens", "best_score")
    got = docs.select("doc_id", token_counts.token_counts(docs, PIECES, BYTES).alias("c")).select("doc_id", "c.n_tokens").collect()
    want = zip([i for i, _ in ODD_TEXTS], public_counts(PIECES, BYTES, [t for _, t in ODD_TEXTS]))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    empty = docs_frame(spark, [])
    assert empty.select(token_counts.token_counts(empty, PIECES, BYTES)).count() == 0
