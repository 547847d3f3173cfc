import itertools

import numpy as np
import pytest
from helpers import ODD_TEXTS, crc, docs_frame, labels_schema, with_clashes

from marginscope.llm import quality_crf as Q
from marginscope.llm import queries


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(1)
    lines = np.array([3, 1, 5, 2])
    unary, stay = rnd.normal(size=lines.sum()), 0.7
    good, same, log_z = Q.marginals(unary, stay, lines)
    start, total = 0, 0.0
    for n in lines:
        u = unary[start : start + n]
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weight[path] = np.exp(sum(u[i] for i in range(n) if path[i]) + stay * sum(a == b for a, b in zip(path, path[1:])))
        z = sum(weight.values())
        total += np.log(z)
        for i in range(n):
            assert good[start + i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / z)
            if i:
                assert same[start + i] == pytest.approx(sum(w for p, w in weight.items() if p[i] == p[i - 1]) / z)
        start += n
    assert log_z == pytest.approx(total)


def test_gradient_is_that_of_the_likelihood():
    rnd = np.random.default_rng(2)
    lines = np.array([4, 3])
    x, y = rnd.normal(size=(7, 2)), np.array([1, 1, 0, 0, 1, 0, 1.0])
    inner = np.array([0, 1, 1, 1, 0, 1, 1], dtype=bool)
    kept = ((y[1:] == y[:-1]) & inner[1:]).sum()

    def likelihood(w, s):
        return (x @ w) @ y + s * kept - Q.marginals(x @ w, s, lines)[2]

    w, s, h = np.array([0.3, -0.2]), 0.4, 1e-6
    good, same, _ = Q.marginals(x @ w, s, lines)
    for k in range(2):
        step = np.eye(2)[k] * h
        assert (x.T @ (y - good))[k] == pytest.approx((likelihood(w + step, s) - likelihood(w - step, s)) / (2 * h), abs=1e-4)
    assert kept - same.sum() == pytest.approx((likelihood(w, s + h) - likelihood(w, s - h)) / (2 * h), abs=1e-4)


def test_line_features_by_hand():
    x, size, lines = Q.line_features(["AB cd!!\n\nto to to |", None])
    assert lines.tolist() == [3, 1] and size.tolist() == [7, 0, 10, 0]
    other, doubled, upper, bar, repeats = x[:, :5].T
    assert other[0] == pytest.approx(2 / 7) and doubled[0] == 0.5 and upper[0] == 0.5
    assert bar[2] == 0.25 and repeats[2] == 0.5 and not x[1, :8].any()


def test_scores_do_not_depend_on_the_batch():
    texts = ["one line", "two\nlines here", "", "A!! B!! C!!\nplain words", "x " * 500]
    sample = [(t, k % 2) for k, t in enumerate(["good plain words\nmore of them here", "BAD!! BAD!! BAD!!\nBAD!!"] * 20)]
    model = Q.fit([(t, 1 - y) for t, y in sample])
    assert model.score(texts) == pytest.approx(np.concatenate([model.score([t]) for t in texts]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_quality_crf(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    out = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if crc(x["doc_id"], 5) == 0]
    assert len(out) > 40 and sum(a == b for a, b in out) / len(out) > 0.95


def test_fits_on_its_folds_only(spark):
    held = [i for i in range(300) if crc(i, 5) == 0]
    rest = [i for i in range(300) if crc(i, 5) != 0]
    docs = docs_frame(spark, [(i, "plain words") for i in range(300)])
    labels = spark.createDataFrame([(i, 0, 0) for i in held] + [(i, 1, 0) for i in rest], labels_schema())
    # only label 1 is left: everything is good
    assert Q.fit_documents(docs, labels).score(["anything", "", None]).min() > 0.9


def test_sample_is_bounded(spark):
    from marginscope.llm import common

    docs = docs_frame(spark, [(i, "w" * 10) for i in range(500)] * 2)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(500)] + [(7, None, 1), (None, 1, 1)], labels_schema())
    got = common.labelled_sample(docs, labels, "quality", 30, 200, 5, 0)
    assert sorted(y for _, y in got) == [0] * 20 + [1] * 20
    assert got == common.labelled_sample(docs.repartition(7), labels.repartition(5), "quality", 30, 200, 5, 0)
    many = docs_frame(spark, [(i, "w") for i in range(20_000)])
    flags = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert len(common.labelled_sample(many, flags, "quality", 1000, 10**6, 5, 0)) == 2000


def test_odd_rows(spark):
    docs = with_clashes(docs_frame(spark, ODD_TEXTS), "score", "predicted")
    none = spark.createDataFrame([], labels_schema())
    model = Q.fit_documents(docs, none)
    assert docs.select(Q.quality(docs, model).alias("s")).where("s = 0.5").count() == len(ODD_TEXTS)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 0, None), (8, None, 0), (9, 1, 1), (9, 0, 1), (99, 1, 1)], labels_schema())
    model = Q.fit_documents(docs, labels)
    scores = docs.select(Q.quality(docs, model).alias("s"), Q.line_scorer(model)("text").alias("l")).collect()
    assert len(scores) == len(ODD_TEXTS) and all(0 <= r["s"] <= 1 and len(r["l"]) >= 1 for r in scores)
    assert docs_frame(spark, []).select(Q.quality(docs, model)).count() == 0
