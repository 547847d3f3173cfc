import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import ODD_TEXTS, crc, docs_frame, with_clashes

from marginscope.llm import language_id, queries


def slow_bits(sample, text):
    """Code length by dictionaries, one byte at a time."""
    order = language_id.ORDER
    after = defaultdict(Counter)
    for t in sample:
        b = bytes(order) + t.lower().encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                context = b[i - k : i]
                if not context or context[0] > 0:
                    after[context][b[i]] += 1
    b = bytes(order) + text.lower().encode()
    bits = 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = after.get(b[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if b[i] in seen:
                    bits -= math.log2(seen[b[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(monkeypatch):
    rnd = random.Random(1)
    a = ["".join(rnd.choice("abcé de") for _ in range(200)) for _ in range(4)]
    b = ["".join(rnd.choice("defg ü") for _ in range(150)) for _ in range(3)]
    model = language_id.fit([(t, "a") for t in a] + [(t, "b") for t in b])
    texts = ["abc de", "", "dü fg", "ABC", "zzz 漢", "x", a[0], None]
    for stride in (7, 1 << 20):
        monkeypatch.setattr(language_id, "STRIDE", stride)
        got = model.bits(texts)
        for row, t in zip(got, texts):
            assert row == pytest.approx([slow_bits(a, t or ""), slow_bits(b, t or "")], rel=1e-4, abs=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(out) > 200 and sum(out) / len(out) > 0.97


def test_learns_only_from_its_folds(spark):
    held = [i for i in range(200) if crc(i, 3) == 1][:20]
    docs = docs_frame(spark, [(i, "held out words", "xx") for i in held] + [(i, "der die das", "de") for i in range(200) if crc(i, 3) != 1])
    assert language_id.fit_documents(docs).langs == ["de"]


def test_odd_rows(spark):
    train = [(i, "the and of in to", "en") for i in range(20)] + [(i, "der die das und", "de") for i in range(20, 40)]
    docs = docs_frame(spark, train)
    model = language_id.fit_documents(with_clashes(docs, "score", "_text", "_n"))
    odd = with_clashes(docs_frame(spark, ODD_TEXTS), "lang_pred", "score")
    rows = odd.select("doc_id", language_id.language(odd, model).alias("p")).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        none = r["doc_id"] in (1, 2, 3, 4)
        assert (r["p"]["lang_pred"] == "und") == none and 0 <= r["p"]["score"] <= 1
    nothing = language_id.fit_documents(docs_frame(spark, []))
    assert nothing.predict(["abc", None])[0] == ["und", "und"]
    assert docs_frame(spark, []).select(language_id.language(odd, model)).count() == 0
