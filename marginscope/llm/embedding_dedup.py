"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (signs of random
projections). Vectors are ordered by label and key over the whole cluster, and each
is compared with the WINDOW that follow it; pairs whose cosine is high enough are
near, and near pairs of all passes are united into neighbourhoods. A range partition's
last vectors are compared with the first ones of the next in a second, small step.

Equal vectors are one class from the start, with a weight. A window cannot show
all links of a large group, so neighbourhoods are drawn at a looser cosine than that
of a link: a loose group, whose links are few among its many near pairs, hangs
together in any of its windows, whatever its size. Inside each neighbourhood
all pairs are then compared, block by block: links are counted exactly and
united into components, without a table of the pairs.
The work of that step grows with the square of the number of different vectors in
a neighbourhood, in tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize
from .components import connected_components, spanning_edges

#: Least cosine of a link.
COSINE = 0.93
#: Vectors within so many times a link's angle are near: cosine 0.80 where a link has 0.93.
LOOSE = 1.7
#: Passes, bits of a key, and vectors that each is compared with in a pass.
PASSES, BITS, WINDOW = 24, 48, 24
#: Vectors of a component that a task compares with as many others.
BLOCK = 512
SEED = 11


def _units(packed: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors in double precision from packed floats."""
    x = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Vectors of one width at a time; those of different widths link with nothing."""
    width = frame["packed"].map(len)
    for _, part in frame.groupby(width, sort=False):
        yield part.reset_index(drop=True)


def _window_links(frame: pd.DataFrame, window: int, cosine: float, kind: str) -> pd.DataFrame:
    """What links each row of one pass and label with the next ``window`` rows, as few edges that connect the same."""
    x = _units(frame["packed"], kind)
    group = frame["pass"].to_numpy(dtype=np.int64) * (1 << 32) + frame["label"].to_numpy(dtype=np.int64) % (1 << 32)
    node = frame["node"].to_numpy(dtype=np.int64)
    a, b = [], []
    for off in range(1, min(window, len(frame) - 1) + 1):
        hit = (np.einsum("ij,ij->i", x[:-off], x[off:]) >= cosine) & (group[:-off] == group[off:])
        a.append(node[:-off][hit])
        b.append(node[off:][hit])
    a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b))
    a, b = spanning_edges(a, b)
    return pd.DataFrame({"a": a, "b": b})


def pack(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, kind: str) -> DataFrame:
    """(id, label, packed): vectors as packed floats; packed is null for those that link with nothing."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for v in s:
                x = np.array([np.nan if e is None else e for e in v], dtype="<f8") if v is not None and len(v) else np.zeros(0)
                # the norm must be finite too; equal vectors have equal bytes, whatever the sign of a zero
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.linalg.norm(x) if len(x) else 0.0
                out.append((x + 0.0).astype(kind).tobytes() if np.isfinite(norm) and norm > 0 else None)
            yield pd.Series(out, dtype=object)

    return vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.when(F.col(label_col).isNotNull(), packed(F.col(vec_col))).alias("packed"),
    )


def pass_links(classes: DataFrame, kind: str, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """(a, b): edges between classes (node, label, packed) that connect what the passes found within ``cosine``; every pair is verified."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for frame in batches:
            for part in _by_width(frame):
                x = _units(part["packed"], kind)
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng(SEED).standard_normal((d, passes * bits))
                for p in range(passes):
                    key = ((x @ planes[d][:, p * bits : (p + 1) * bits]) > 0) @ weight
                    yield part.assign(**{"pass": p, "key": key})[["pass", "label", "key", "node", "packed"]]

    keyed = classes.select("label", "node", "packed").mapInPandas(project, "pass int, label long, key long, node long, packed binary")
    # width first: a change of width ends a window
    ordered = keyed.repartitionByRange(F.octet_length("packed"), "pass", "label", "key", "node").sortWithinPartitions(
        F.octet_length("packed"), "pass", "label", "key", "node"
    )
    kinds = "a long, b long, part int, side int, place int, pass int, label long, node long, packed binary"

    def edge(frame: pd.DataFrame, side: int, part: int) -> pd.DataFrame:
        return frame.assign(a=None, b=None, part=part, side=side, place=np.arange(len(frame)))

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        head, tail = None, None
        for frame in batches:
            frame = frame.drop(columns="key")
            head = frame.iloc[:window] if head is None else pd.concat([head, frame]).iloc[:window]
            both = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            for part in _by_width(both):
                found = _window_links(part, window, cosine, kind)
                if len(found):
                    yield found.assign(part=None, side=None, place=None, **{"pass": None}, label=None, node=None, packed=None)
            tail = both.iloc[-window:]
        if tail is not None:
            # a boundary has the number of the partition after it
            yield edge(head, 1, me)
            yield edge(tail, 0, me + 1)

    slid = materialize(ordered.mapInPandas(slide, kinds), "passes")

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["side", "place"]).reset_index(drop=True)
        found = [_window_links(part, window, cosine, kind) for part in _by_width(rows) if len(part) > 1]
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    edges = slid.where("side is not null").groupBy("part").applyInPandas(across, "a long, b long")
    return slid.where("a is not null").select("a", "b").union(edges).distinct()


def links_within(members: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """(node, n, a, b) from (component, node, copies, packed), all pairs of each component compared.

    Rows with a node: parts of the number of vectors of other classes that it links with.
    The others: edges that connect the same as all links.
    """
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small components share tasks
    task = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(4096)))
    dealt = dealt.select(task.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "node", "copies", "packed")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        out, ends = [], []
        for _, whole in frame.groupby("component", sort=False):
            for part in _by_width(whole):
                x = _units(part["packed"], kind)
                node, copies, own = part["node"].to_numpy(), part["copies"].to_numpy(dtype=np.int64), part["own"].to_numpy()
                left, right = (own == i, own == j)
                near = (x[left] @ x[right].T) >= cosine
                if i == j:
                    np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"node": node[left], "n": near @ copies[right]}))
                if i != j:
                    out.append(pd.DataFrame({"node": node[right], "n": near.T @ copies[left]}))
                at, to = np.nonzero(near)
                ends.append(np.stack(spanning_edges(node[left][at], node[right][to])))
        counts = pd.concat(out)
        edges = np.concatenate(ends, axis=1)
        return pd.concat([
            counts[counts["n"] > 0].assign(a=None, b=None), pd.DataFrame({"node": None, "n": None, "a": edges[0], "b": edges[1]})
        ]).astype("Int64")

    return dealt.groupBy("task", "i", "j").applyInPandas(count, "node long, n long, a long, b long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, passes: int = PASSES, bits: int = BITS, window: int = WINDOW,
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Vectors are compared only with those of the same label. A null, empty or zero
    vector, one with null or non-finite components, and one without a label link
    with nothing. Equal vectors of a label link with each other; repeated rows
    count as vectors of their own. Vectors of different width do not link. A null
    id takes part and has a null component_id only if its whole component has
    no id. An empty table gives an empty one. Other columns are not looked at.
    """
    bound_batches(vectors.sparkSession)
    element = getattr(vectors.schema[vec_col].dataType, "elementType", None)
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = materialize(pack(vectors, id_col, vec_col, label_col, kind), "vectors")
    classes = rows.where("packed is not null").groupBy("label", "packed").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # classes are numbered by their least id; those without any by a hash
    classes = materialize(classes.withColumn("node", F.coalesce("least", -F.abs(F.xxhash64("label", "packed")) - 1)), "classes")
    loose = math.cos(min(math.pi, LOOSE * math.acos(max(-1.0, min(1.0, cosine)))))
    around = connected_components(pass_links(classes, kind, passes, bits, window, loose))
    members = classes.join(around, "node").select("component", "node", "copies", "packed")
    found = materialize(links_within(members, kind, cosine), "links")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n").alias("others"))
    part = connected_components(found.where("a is not null").select("a", "b"))
    # the least real id of each component
    of = classes.join(part, "node", "left").select("label", "packed", "node", "least", "copies", F.coalesce("component", "node").alias("c"))
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    of = of.join(least, "c").join(counts, "node", "left").select(
        F.col("label").alias("_l"), F.col("packed").alias("_p"), "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n")
    )
    out = rows.join(of, (F.col("label") == F.col("_l")) & (F.col("packed") == F.col("_p")), "left")
    component = F.when(F.col("packed").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
