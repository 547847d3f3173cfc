import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginscope.llm import queries
from marginscope.llm import repeated_text as rt

from helpers import ODD_TEXTS, docs_frame, with_clashes


def slow(rows, length=rt.LENGTH):
    """{(id, text): (n_bytes, n_removed, n_spans, sha)} with a dictionary of all strings."""
    docs = sorted({(i is not None, i or 0, (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for known, i, raw in docs:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\x01" * length
            seen.add(s)
        flags = [0, *gone]
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i if known else None, raw] = (len(raw), sum(gone), sum(b > a for a, b in zip(flags, flags[1:])), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def wanted(rows):
    of = slow(rows)
    return sorted((i is not None, i or 0, *of[i, (t or "").encode()]) for i, t in rows)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "züge", "漢字"]) for _ in range(n))


def corpus(rng, n):
    """Documents with copies, shared passages of many lengths, repeats inside a text, and periodic ones."""
    shared = [prose(rng, k) for k in (12, 20, 40, 200)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif kind < 0.45:
            t = "ab" * rng.randint(20, 300) + "x" * rng.randint(0, 300)
        else:
            t = " ".join(prose(rng, rng.randint(0, 60)) + rng.choice(["", *shared]) for _ in range(rng.randint(1, 4)))
        rows.append((i, t))
    return rows


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_suffix_dedup(spark, sf)
    assert df.dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    got = result(df)
    assert got == wanted(rows) and sum(r[3] for r in got) > 0


@pytest.mark.parametrize("seed,crowded,block", [(1, rt.CROWDED, rt.BLOCK_BYTES), (2, 2, 3000), (3, 1, 500)])
def test_random_corpora(spark, monkeypatch, seed, crowded, block):
    monkeypatch.setattr(rt, "CROWDED", crowded)
    monkeypatch.setattr(rt, "BLOCK_BYTES", block)
    rng = random.Random(seed)
    rows = corpus(rng, 120)
    df = docs_frame(spark, rows, 6)
    assert result(rt.digests(rt.remove_repeats(df))) == wanted(rows)


def test_odd_rows(spark):
    rng = random.Random(7)
    text = prose(rng, 300)
    rows = [*ODD_TEXTS, (-3, text), (20, text), (None, text[:400]), (21, "é" * 300), (22, "x" * 99), (23, "x" * 100), (24, "y" * 199), (25, "\0" * 250)]
    df = with_clashes(docs_frame(spark, rows, 3), "id", "tie", "h", "g", "off", "n", "part", "spans", "kept", "maybe")
    assert result(rt.digests(rt.remove_repeats(df))) == wanted(rows)
    assert rt.remove_repeats(df.where("false")).count() == 0
    assert rt.remove_repeats(df.where("doc_id = 2")).collect()[0]["n_bytes"] == 0


def test_rows_of_one_id(spark):
    rng = random.Random(8)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(5, a), (5, a), (5, b + a), (6, a)]
    got = {}
    for r in rt.remove_repeats(docs_frame(spark, rows, 4)).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), []).append(sum(s["end"] - s["start"] for s in r["spans"]))
    n = len(a.encode())
    assert got[5, n][0] == got[5, n][1] and got[6, n] == [n]
    # of the two texts of id 5 one holds what the other loses
    assert {got[5, n][0], got[5, len((b + a).encode())][0]} in ({0, n}, {0, n + 1})


def test_long_texts_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(rt, "CROWDED", 50)
    monkeypatch.setattr(rt, "PIECE", 1 << 11)
    monkeypatch.setattr(rt, "_PLACE_BITS", np.uint64((1 << 12) - 1))
    rng = random.Random(9)
    line = "This very common line stands in nearly every document of the corpus, with 99 bytes or a little less"
    rows = [(i, f"{rng.random()} {prose(rng, 10)} {line[: rng.choice([60, 85, 99])]} {rng.random()} {prose(rng, 10)}") for i in range(300)]
    rows += [(1000, prose(rng, 4000)), (1001, "x" * 30_000), (1002, prose(rng, 2000) + rows[0][1])]
    rows += [(1003, rows[300][1][5000:20_000])]
    assert result(rt.digests(rt.remove_repeats(docs_frame(spark, rows, 5)))) == wanted(rows)


def test_suffix_order_is_that_of_sorting():
    rng = np.random.default_rng(3)
    for size, letters in [(1, 2), (2, 1), (50, 1), (300, 2), (2000, 3), (1500, 256), (400, 1)]:
        text = rng.integers(0, letters, size).astype(np.uint8)
        raw = text.tobytes()
        padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
        words = np.zeros(size + 1, dtype=np.uint64)
        for k in range(8):
            words |= padded[k : k + size + 1].astype(np.uint64) << np.uint64(8 * (7 - k))
        order = rt.suffix_order(text, words, 100).tolist()
        assert sorted(order) == list(range(size))
        heads = [raw[i : i + 100] for i in order]
        # zeros stand for what lies beyond the end
        assert [h.ljust(100, b"\0") for h in heads] == sorted(h.ljust(100, b"\0") for h in heads)


def test_equal_strings_share_an_anchor():
    rng = np.random.default_rng(5)
    hasher = rt.Hasher()
    passage = rng.integers(97, 123, 700).astype(np.uint8)
    seen = {}
    for lead in (0, 1, 57, 300):
        text = np.concatenate([rng.integers(97, 123, lead).astype(np.uint8), passage, rng.integers(97, 123, 150).astype(np.uint8)])
        first, count, _, h, _ = hasher.stretches(text, np.ones(len(text) - rt.LENGTH + 1, dtype=bool))
        assert count.sum() == len(text) - rt.LENGTH + 1
        for f, c, x in zip(first, count, h):
            for k in range(f, f + c):
                if lead <= k <= lead + 600:
                    assert seen.setdefault(k - lead, x) == x
