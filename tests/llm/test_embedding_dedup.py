import numpy as np
import pandas as pd
import pytest

from marginscope.llm import embedding_dedup as E
from marginscope.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=E.COSINE):
    """{vec_id: (links, component)} of all pairs."""
    ok = {}
    for i, v, label in rows:
        x = np.array([np.nan if e is None else e for e in v], dtype=float) if v else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            ok[i] = (x / np.linalg.norm(x), label)
    links = {i: set() for i, *_ in rows}
    for i, (x, a) in ok.items():
        for j, (y, b) in ok.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= cosine:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        if i not in component:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in component:
                    component[k] = i
                    todo += links[k]
    return {i: (len(links[i]), component[i]) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    df = queries.op8_embedding_dedup(spark, f"/root/testdata/{sf}")
    got = result(df)
    assert got.keys() == want.keys()
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def near_rows(n, groups, seed, dim=16):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        g = i % groups
        v = base[g] + rnd.normal(size=dim) * (0.12 if i % 3 else 0.0)
        rows.append((i, v.astype(np.float32).tolist(), g % 2))
    return rows


def test_planted_groups(spark, monkeypatch):
    """Groups larger than a window and a block, with equal vectors among them."""
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = near_rows(600, 5, 1)
    want = brute(rows)
    got = result(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.95 * len(got)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [nan, 1.0, 1.0], 0),
        (9, [1.0, None, 1.0], 0), (10, [inf, 1.0, 1.0], 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    df = df.withColumn("n_links", F.lit("mine")).withColumn("component", F.lit(7)).withColumn("packed", F.lit(1))
    assert result(E.near_duplicates(df)) == brute(rows)
    kept = {r["vec_id"] for r in E.near_duplicates(df).where("kept").collect()}
    assert kept == {i for i, *_ in rows} - {2, 11}
    twice = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (None, [0.0], 0)], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in E.near_duplicates(twice).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("None", 0, None), ("None", 2, 1)]
    assert E.near_duplicates(df.where("false")).count() == 0


def test_doubles_are_compared_in_full(spark):
    """Vectors that differ only beyond single precision are different classes, and link."""
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0 + 1e-12], 0), (3, [1.0, 2.0], 0), (4, [-2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(E.near_duplicates(df)) == brute(rows) == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def loose_rows(n, mean, seed, dim=64):
    """One group around a centre: cosines of pairs are ``mean`` on average, few of them links."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=dim)
    x = np.sqrt(mean) * centre / np.linalg.norm(centre) + np.sqrt((1 - mean) / dim) * rnd.normal(size=(n, dim))
    return x.astype(np.float32)


def all_pairs(x, cosine=E.COSINE):
    """(links, component) of each vector, all pairs compared."""
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, a, b = np.zeros(len(u), dtype=np.int64), [], []
    for k in range(0, len(u), 2000):
        near = u[k : k + 2000] @ u.T >= cosine
        links[k : k + 2000] = near.sum(axis=1) - 1
        i, j = E.spanning_edges(np.nonzero(near)[0] + k, np.nonzero(near)[1])
        a.append(i)
        b.append(j)
    component = np.arange(len(u))
    root, node = E.spanning_edges(np.concatenate(a), np.concatenate(b))
    component[node] = root
    return links, component


@pytest.mark.parametrize("mean", [0.86, 0.88])
def test_large_loose_group(spark, mean):
    """A group whose links are few among its near pairs loses none, however many times a window it has."""
    x = loose_rows(20_000, mean, 3)
    links, component = all_pairs(x)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 0}), SCHEMA).repartition(8)
    got = E.near_duplicates(df).toPandas().sort_values("vec_id")
    right = got["component_id"].to_numpy() == component
    print(f"mean {mean}: links {got['n_links'].sum()} of {links.sum()}, kept {got['kept'].sum()} of {len(set(component.tolist()))}, right component_id {right.mean():.4f}")
    assert got["n_links"].sum() >= 0.999 * links.sum() and (got["n_links"].to_numpy() <= links).all()
    assert right.mean() >= 0.999
