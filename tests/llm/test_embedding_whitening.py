import math

import numpy as np
from pyspark.sql import functions as F

from marginscope.llm import embedding_whitening as ew
from marginscope.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def slow(rows):
    """{id: (n, deviation)} , x vectors, eigenvalues, components and trace, by plain numpy over all rows."""
    rows = [(i, v) for i, v in rows if sound(v)]
    width = max((len(v) for _, v in rows), default=0)
    x = [[math.floor(256 * float(c)) for c in v] + [0] * (width - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    a = np.array(fit, dtype=float) - np.array(sums) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return [i for i, _ in rows], np.array(x, dtype=float) - np.array(sums) / n, n, deviation, e[::-1], v[:, ::-1], e.sum()


def check(got, rows, components=4):
    ids, x, n, deviation, e, v, trace = slow(rows)
    assert len(got) == components * len(ids)
    want = {i: k for k, i in enumerate(ids)}
    sign = {}
    for r in got:
        k, c = want[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == (deviation[k] if deviation[k] < 2**63 else None)
        w = x[k] @ v[:, c] / math.sqrt(e[c])
        if abs(w) > 1e-6:
            s = sign.setdefault(c, math.copysign(1, w * r["whitened"]))
            assert abs(s * r["whitened"] - w) < 1e-8 * max(1, abs(w))
        assert abs(r["explained"] - e[c] / trace) <= 1e-10 and 0 <= r["identity_error"] < 1e-9


def test_query_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
        df = queries.op12_embedding_whitening(spark, sf)
        assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
        check(df.collect(), rows)


def spread(n, width, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) * np.geomspace(50, 1, width)


def test_odd_rows(spark):
    good = spread(200, 6)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(good)]
    rows += [(1000 + k, good[0].tolist(), 1) for k in range(50)]  # copies count once in the fit
    rows += [(2000, None, 0), (2001, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] + [0.0] * 5, 0)]
    rows += [(-7, [0.5, -0.0], 0), (-8, [], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("x", "n", "component", "id", "row"):
        df = df.withColumn(c, F.lit("mine"))
    check(ew.whiten(df).collect(), [(i, v) for i, v, _ in rows])
    assert ew.whiten(df.where("false")).count() == 0
    assert ew.whiten(df.where("vec_id >= 2000")).count() == 0
    assert ew.whiten(df.where("vec_id >= 1000")).count() == 0  # one distinct vector: nothing varies
    assert ew.whiten(df.where("vec_id = -8")).count() == 0
    # a null id and a repeated id each keep their rows
    twice = df.where("vec_id < 100 and vec_id >= 0").withColumn("vec_id", F.when(F.col("vec_id") > 1, F.col("vec_id") % 10))
    assert ew.whiten(twice).count() == 400


def test_few_directions(spark):
    rng = np.random.default_rng(4)
    flat = np.round(rng.standard_normal((300, 2)) * 20) @ np.array([[1, 0, 2, 0, 1], [0, 1, 1, 0, -1]])
    rows = [(k, (v / 256 * 256).tolist(), 0) for k, v in enumerate(flat)]
    got = ew.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, [(i, v) for i, v, _ in rows], components=2)


def test_large_entries_and_ill_conditioning(spark):
    big = spread(100, 4) * 1e9
    rows = [(k, v.tolist(), 0) for k, v in enumerate(big)]
    got = ew.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["deviation"] is None for r in got)
    check(got, [(i, v) for i, v, _ in rows])
    # eigenvalues that lie 14 powers of ten apart
    rng = np.random.default_rng(6)
    wide = rng.standard_normal((400, 4)) * np.array([1e7, 1e5, 1e2, 1.0])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(wide)]
    got = ew.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1600 and max(r["identity_error"] for r in got) < 1e-6
    ew.whiten(spark.createDataFrame([(1, [1e308, -1e308], 0), (2, [0.0, 1.0], 0), (3, [5.0, 1.0], 0)], SCHEMA)).collect()


def test_factors_of_a_singular_matrix():
    a = np.array([[1.0, 1.0, 0.0], [2.0, 2.0, 0.0], [3.0, 3.0, 0.0]])
    r = ew.factor(a.T @ a, 3)
    assert np.allclose(np.tril(r, -1), 0) and np.isfinite(ew.solve_rows(a, r)).all()
    x = np.random.default_rng(1).standard_normal((50, 5))
    r = ew.factor(x.T @ x, 50)
    q = ew.solve_rows(x, r)
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(5))


def test_exact_sums_and_deviations():
    x = np.array([[2**62, -(2**62)], [2**62, 5], [2**63 - 1, -7]])
    hi, lo = ew._halves(x)
    sums = [(int(h) << 32) + int(v) for h, v in zip(hi, lo)]
    assert sums == [sum(int(v) for v in c) for c in x.T]
    model = ew.Whitening(3, sums, np.zeros((2, 0)), np.zeros(0), 1.0)
    assert ew.deviations(x, model) == [None] * 3
    small = np.array([[1, 2], [3, -4], [7, 7]])
    sums = small.sum(axis=0).tolist()
    model = ew.Whitening(3, sums, np.zeros((2, 0)), np.zeros(0), 1.0)
    assert ew.deviations(small, model) == [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in small.tolist()]
