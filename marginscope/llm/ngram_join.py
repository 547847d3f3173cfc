"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Method: pigeonhole over a partition of the universe. Two sets with Jaccard
similarity of at least t differ in at most H = (1 - t) / (1 + t) * (|r| + |s|)
elements. For each band of set sizes, tokens are hashed into more than H
segments, and each segment of a set is indexed as a whole; the first few also with
each one element deleted. A set that looks for partners gives every segment an
allowance of 0 (not looked at), 1 (equal segments) or 2 (equal up to one
element); if the allowances add up to H + 1, a linked pair must meet in some
segment; allowances beyond that make it meet in more, which rules out chance
meetings. Allowances go to the segments whose index keys are rare, by a count of all
keys of the corpus in a fixed number of counters. Keys only bring pairs together:
every link is then verified on the whole texts.

Large groups: equal sets are one node from the start. Keys in crowded counters
bypass the grouping of keys and only meet in a join that adaptive execution splits.
Nodes that share many keys with a common centre are a family, and a family is
compared as a whole in blocks, so that a group of thousands of near copies makes rows
for its members and not for their pairs. Only pairs that meet across families and
components are compared one by one; no possible link is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Words a shingle, and similarity of a link in percent.
WORDS = 5
PERCENT = 80
#: Counters of the key statistics (fixed, whatever the size of the corpus).
COUNTERS = 1 << 20
#: Counters are summed in shares of 2 ** SHARE_BITS.
SHARE_BITS = 14
#: The first segments of every band, so many, are also indexed with one element deleted.
DELETIONS = 1
#: Members of a family that a task compares with as many others, and tokens it counts at once.
BLOCK, COLUMNS = 256, 8192
#: A counter is crowded when it holds so many times the mean.
CROWDED = 16

_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _times(a: int, b: np.uint64) -> np.uint64:
    return _U(a * int(b) % 2**64)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

    #: Bytes that are hashed at once, and the longest word that is hashed with its neighbours.
    SLICE, LONG = 1 << 18, 64

    def __init__(self, words: int = WORDS):
        self.words = words
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * _STEP[20])
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.up, self.down = (self._powers(x) for x in (int(_STEP[21]), pow(int(_STEP[21]), -1, 1 << 64)))

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.SLICE, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _words(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, hash) of the words of ``raw``, slice by slice; slices end at white space."""
        every = np.frombuffer(raw, dtype=np.uint8)
        at = 0
        while at < len(every):
            stop = min(at + self.SLICE, len(every))
            if stop < len(every):
                gaps = np.flatnonzero(self.space[every[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:  # one word fills the slice: it ends at the next white space
                    word = raw[at:].split(None, 1)[0]
                    yield np.array([at]), np.array([xxhash.xxh64_intdigest(word)], dtype=np.uint64)
                    at += len(word)
                    continue
            part = every[at:stop]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space[part], [True]]).astype(np.int8)))
            first, last = edge[::2], edge[1::2]
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.letter[part] * self.up[: len(part)], dtype=np.uint64)])
            h = mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
            for k in np.flatnonzero(last - first > self.LONG):
                h[k] = xxhash.xxh64_intdigest(raw[at + first[k] : at + last[k]])
            yield at + first, h
            at = stop

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """For each text its distinct shingles of words (runs of bytes other than ASCII white space; A-Z in lower case).

        Fewer words than a shingle holds are one shingle; no words, none.
        """
        held, size = [], 0
        for text in texts:
            held.append((text or "").encode("utf-8", "replace").lower())
            size += len(held[-1]) + 1
            if size > self.SLICE:
                yield from self._sets(held)
                held, size = [], 0
        yield from self._sets(held)

    def _sets(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        if not raws:
            return
        found = list(self._words(b"\n".join(raws)))
        place, h = (np.concatenate(x) if found else np.zeros(0, dtype=np.uint64) for x in (zip(*found) if found else ((), ())))
        ends = np.cumsum([len(r) + 1 for r in raws])
        edge = [0, *np.searchsorted(place, ends).tolist()]
        whole = np.full(max(0, len(h) - self.words + 1), _U(self.words))
        for i in range(self.words):
            whole += h[i : i + len(whole)] * _STEP[i]
        whole = mix(whole)
        for a, z in zip(edge, edge[1:]):
            n = z - a
            if n >= self.words:
                out = np.sort(whole[a : z - self.words + 1])
                yield out[np.concatenate([[True], out[1:] != out[:-1]])]
            else:
                yield mix(np.array([(n + sum(int(x) * int(_STEP[i]) for i, x in enumerate(h[a:z]))) % 2**64] if n else [], dtype=np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


class Scheme:
    """Size bands, segments and keys for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        first, last = [], []
        a = 1
        while a <= largest:
            first.append(a)
            last.append(a * 100 // percent)
            a = last[-1] + 1
        self.first, self.last = np.array(first), np.array(last)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def budget(self, r: int, s: int) -> int:
        """Most elements in which linked sets of these sizes can differ."""
        return (100 - self.percent) * (r + s) // (100 + self.percent)

    def segments(self, band: int) -> int:
        """As many as the largest set that looks here can need, and a tenth to choose from."""
        top = int(self.last[band])
        need = self.budget(top * 100 // self.percent, top) + 1
        return need + need // 10 + 1

    def split(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of each segment; then the keys with one element deleted and the segments they belong to."""
        m = self.segments(band)
        spread = mix(tokens + _times(band + 1, _STEP[9]))
        seg = ((spread >> _U(32)) % _U(m)).astype(np.int64)
        part = mix(spread + _STEP[10])
        sums = np.zeros(m, dtype=np.uint64)
        np.add.at(sums, seg, part)
        salt = mix((np.arange(m, dtype=np.uint64) + _U(1)) * _STEP[11] + _times(band, _STEP[12]))
        near = np.flatnonzero(seg < DELETIONS)
        at = seg[near]
        return mix(sums + salt), mix(sums[at] - part[near] + salt[at]), at

    def index_keys(self, tokens: np.ndarray) -> np.ndarray:
        """Keys under which a set can be found by sets of its band and the next."""
        if not len(tokens):
            return np.zeros(0, dtype=np.uint64)
        whole, less, _ = self.split(tokens, self.band(len(tokens)))
        return np.concatenate([whole, less])

    def roles(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every key of a set and its role: 2 * c + 1 if the set can be found under the key.

        c is 0 where the set does not look. Else it looks in its own band and the one
        below for linked sets no larger than itself; with c - 1 allowances beyond H + 1,
        it meets each of them under c keys at least.
        """
        n = len(tokens)
        keys, roles = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int8)]
        own = self.band(n) if n else 0
        for band in (own, own - 1) if n else ():
            if band < 0 or int(self.last[band]) * 100 < self.percent * n:
                continue
            need = self.budget(n, min(n, int(self.last[band]))) + 1
            whole, less, at = self.split(tokens, band)
            cost = counts[(whole % _U(COUNTERS)).astype(np.int64)]
            # a second allowance costs the keys with one element deleted
            full = np.unique(at)  # an empty segment has nothing to delete
            extra = np.bincount(at, weights=counts[(less % _U(COUNTERS)).astype(np.int64)], minlength=DELETIONS)[full]
            steps = np.concatenate([cost, cost[full] + extra + 1])
            wanted = min(need + need // 25 + 1, len(steps))
            take = np.argpartition(steps, wanted - 1)[:wanted]
            asked = np.zeros(len(whole), dtype=bool)
            asked[take[take < len(whole)]] = True
            twos = full[take[take >= len(whole)] - len(whole)]
            deleted = twos[asked[twos]]  # a second allowance without a first counts as the first
            asked[twos] = True
            every, looks = np.concatenate([whole, less]), np.concatenate([asked, np.isin(at, deleted)])
            c = 2 * min(wanted - need + 1, 60)
            if band == own:
                keys.append(every)
                roles.append(np.where(looks, c + 1, 1).astype(np.int8))
            else:
                keys.append(every[looks])
                roles.append(np.full(len(keys[-1]), c, dtype=np.int8))
        return np.concatenate(keys), np.concatenate(roles)


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_sets(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Two kinds of rows from one pass over the texts (_id, _known, _mark, text).

    (_id, _known, _mark, n_shingles, set_key) for each document: the size of its set and a 128-bit
    digest of it (null when empty). (block, counts) for each task and block of
    2 ** SHARE_BITS counters: how many index keys of its documents fall into each.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler()
        total = np.zeros(COUNTERS, dtype=np.int64)
        for frame in batches:
            sets = list(cut.many(frame["text"]))
            for x in sets:
                np.add.at(total, (scheme.index_keys(x) % _U(COUNTERS)).astype(np.int64), 1)
            yield pd.DataFrame({
                "_id": frame["_id"],
                "_known": frame["_known"],
                "_mark": frame["_mark"],
                "n_shingles": [len(x) for x in sets],
                "set_key": pd.Series([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], dtype=object),
                "block": None,
                "counts": None,
            })
        blocks = np.unique(np.flatnonzero(total) >> SHARE_BITS).tolist()
        if blocks:
            yield pd.DataFrame({
                "_id": None, "_known": None, "_mark": None, "n_shingles": None, "set_key": None, "block": blocks,
                "counts": [total[k << SHARE_BITS : (k + 1) << SHARE_BITS] for k in blocks],
            })

    common.bound_batches(rows.sparkSession)
    return rows.select("_id", "_known", "_mark", "text").mapInPandas(
        describe, "_id long, _known boolean, _mark long, n_shingles long, set_key binary, block int, counts array<long>"
    )


def _key_counts(sets: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: COUNTERS numbers, whatever the size of the corpus."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"][:1], "counts": [np.sum(np.stack(frame["counts"]), axis=0)]})

    rows = sets.where("block is not null").select("block", "counts").withColumn("salt", F.floor(F.spark_partition_id() / 256))
    # first 256 partitions at a time, so that no task holds the counters of all of them
    part = rows.groupBy("block", "salt").applyInPandas(lambda f: add(f), "block int, counts array<long>")
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in part.groupBy("block").applyInPandas(lambda f: add(f), "block int, counts array<long>").collect():
        out[r["block"] << SHARE_BITS : (r["block"] + 1) << SHARE_BITS] = r["counts"]
    return out


def _keys(texts: DataFrame, scheme: Scheme, counts: np.ndarray) -> DataFrame:
    """(key, salt, node, role): every index key and every key a node looks under; salt is 0 for keys in counters that aren't crowded."""
    heavy = counts > CROWDED * max(1.0, counts.mean())
    weight = np.minimum(counts, 2**31 - 1).astype(np.int32)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler()
        for frame in batches:
            keys, nodes, looks, held = [], [], [], 0
            for node, tokens in zip(frame["node"].tolist(), cut.many(frame["text"])):
                key, role = scheme.roles(tokens, weight)
                keys.append(key)
                looks.append(role)
                nodes.append(np.full(len(key), node))
                held += len(key)
                if held > 500_000:
                    yield _key_frame(keys, nodes, looks, heavy)
                    keys, nodes, looks, held = [], [], [], 0
            if held:
                yield _key_frame(keys, nodes, looks, heavy)

    return texts.mapInPandas(emit, "key long, salt short, node long, role byte")


def _key_frame(keys: list, nodes: list, looks: list, heavy: np.ndarray) -> pd.DataFrame:
    key, node = np.concatenate(keys), np.concatenate(nodes)
    salt = np.where(heavy[(key % _U(COUNTERS)).astype(np.int64)], 1 + node % 1000, 0).astype(np.int16)
    return pd.DataFrame({"key": key.astype(np.int64), "salt": salt, "node": node, "role": np.concatenate(looks)})


def _verified(pairs: DataFrame, with_text: Callable[..., DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar enough."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = Shingler()
        for left, right in batches:
            yield pd.Series([_links(x, y, percent) for x, y in zip(cut.many(left), cut.many(right))], dtype=bool)

    return with_text(with_text(pairs, "a", "_x"), "b", "_y").where(similar("_x", "_y")).select("a", "b")


def spanning_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the index of the first one of those it reaches by links among them."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    token, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    # a token of one set is in no intersection
    rank = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)
    for a in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    first = np.arange(n)
    while True:
        least = np.where(linked, first[None, :], n).min(axis=1)
        least = least[least]
        if (least == first).all():
            return first
        first = least


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough links to connect what is linked within each family of (family, node, text).

    A family is compared in blocks of its members, two blocks a task, by sparse
    counts of common tokens; no pair becomes a row.
    """
    size = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # families of one block share tasks
    task = F.when(F.col("blocks") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(4096)))
    dealt = dealt.select(task.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "family", "node", "text")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        cut = Shingler()
        out = []
        for _, part in frame.groupby("family", sort=False):
            node = part["node"].to_numpy()
            if len(node) > 1:
                first = spanning_links(list(cut.many(part["text"])), percent)
                far = first != np.arange(len(node))
                out.append(pd.DataFrame({"a": node[first[far]], "b": node[far]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return dealt.groupBy("task", "i", "j").applyInPandas(compare, "a long, b long")


def link_nodes(
    texts: DataFrame, with_text: Callable[..., DataFrame], sizes: DataFrame, counts: np.ndarray, percent: int = PERCENT
) -> DataFrame:
    """(node, component) of the rows (node, text) that have a link; rows have different sets, nodes are not negative.

    ``with_text`` adds the text of a frame's column of nodes under a name: the few texts that are compared are
    looked up, so that not all are shuffled again. ``sizes`` has the set size of each node.
    """
    keys = _keys(texts, Scheme(percent), counts)
    # keys of more than one node, one of which looks; a counter that isn't crowded bounds the
    # nodes of its keys, the rest are dealt by salt and kept
    per_key = Window.partitionBy("key", "salt")
    met = common.materialize(
        keys.withColumn("_n", F.count(F.lit(1)).over(per_key))
        .withColumn("_looks", F.max("role").over(per_key))
        .where("salt > 0 or (_n > 1 and _looks > 1)")
        .select("key", "node", "role"),
        "keys",
    )
    # The most central node of a key is one that shares many keys with many others. Nodes that share
    # twice the keys a link needs with a centre are of its family; families are compared as wholes.
    crowd = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    weight = met.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("w"))
    weighed = common.materialize(met.join(weight, "node").select("key", "node", "role", "w"), "weighed")
    centre = weighed.groupBy("key").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = weighed.join(centre.select("key", "a"), "key").where("node != a").groupBy("node", "a").agg(
        F.count("*").alias("n"), F.max(F.shiftright("role", 1)).alias("times")
    )
    best = shared.groupBy("node").agg(F.max_by(F.struct("a", "n", "times"), F.struct("n", -F.col("a"))).alias("s"))
    near = best.where("s.n >= s.times and s.times > 0").select(F.col("node").alias("a"), F.col("s.a").alias("b"))
    kernel = connected_components(near).select("node", F.col("component").alias("family"))
    # A node whose keys have several centres of one family is of that family as well.
    of_key = centre.join(kernel.withColumnRenamed("node", "a"), "a").select("key", "family")
    shared = weighed.join(of_key, "key").groupBy("node", "family").agg(F.count("*").alias("n"), F.max(F.shiftright("role", 1)).alias("times"))
    best = shared.groupBy("node").agg(F.max_by(F.struct("family", "n", "times"), F.struct("n", -F.col("family"))).alias("s"))
    more = best.where("s.n >= s.times and s.times > 0").select(F.col("node").alias("a"), F.col("s.family").alias("b"))
    edges = kernel.select(F.col("node").alias("a"), F.col("family").alias("b")).union(more)
    family = common.materialize(connected_components(edges).select("node", F.col("component").alias("family")), "families")
    first = common.materialize(family_links(with_text(family, "node", "text").select("family", "node", "text"), percent), "links")
    part = connected_components(first)
    # what may still be linked: nodes that meet under a key, in different components and families
    place = family.join(part, "node", "full").select("node", F.coalesce("component", "node").alias("c"), "family")
    whole = met.join(place, "node", "left").select("key", "node", "role", F.coalesce("c", "node").alias("c"), F.coalesce("family", -1 - F.col("node")).alias("f"))
    mixed = whole.groupBy("key").agg(F.min("f").alias("_l"), F.max("f").alias("_h")).where("_l < _h").select("key")
    rest = common.materialize(whole.join(mixed, "key").join(sizes, "node"), "rest")
    looks = rest.where("role > 1").selectExpr("key", "node x", "c cx", "f fx", "least lx", "most mx", "shiftright(role, 1) times")
    found = rest.where(F.col("role").bitwiseAND(1) == 1).selectExpr("key", "node y", "c cy", "f fy", "least ly", "most my")
    # a set looks for sets no larger than itself, and no smaller than a link allows
    fits = (found["ly"] <= looks["mx"]) & (100 * found["my"] >= percent * looks["lx"])
    # a node shares no more keys with a member than with the member's family: one row for a family first
    held = found.groupBy("key", F.col("fy").alias("fz")).agg(F.min("ly").alias("lz"), F.max("my").alias("mz"))
    may = (held["lz"] <= looks["mx"]) & (100 * held["mz"] >= percent * looks["lx"])
    close = looks.join(held, (looks["key"] == held["key"]) & (looks["fx"] != held["fz"]) & may).groupBy("x", "fz").agg(
        F.count("*").alias("n"), F.min("times").alias("least_times")
    )
    close = common.materialize(close.where("n >= least_times").select(F.col("x").alias("xz"), "fz"), "close")
    looks = looks.join(close, looks["x"] == close["xz"])
    apart = looks.join(found, (looks["key"] == found["key"]) & (looks["fz"] == found["fy"]) & (looks["cx"] != found["cy"]) & fits)
    met_often = apart.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("times").alias("times")).where("n >= times")
    pairs = common.materialize(met_often.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    return connected_components(first.union(_verified(pairs, with_text, percent)))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What a row is known by: its id (0 and not known if null) and a mark of its text."""
    own = F.col(id_col).cast("long")
    return [F.coalesce(own, F.lit(0)).alias("_id"), own.isNotNull().alias("_known"), F.xxhash64(own.isNull(), text_col).alias("_mark")]


def _linked(base: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their sets, and the classes of equal sets with their component, from (_id, _known, _mark, text).

    A class has its least id, the first of its rows, and the least number ``c`` of its component's classes.
    """
    both = common.materialize(shingle_sets(base, Scheme(percent)), "sets")
    sets = both.where("block is null")
    # one node for each class of equal sets, numbered once and for all; the first row stands for it
    first = F.min(F.struct((~F.col("_known")).alias("_null"), "_id", "_mark")).alias("first")
    classes = sets.where("set_key is not null").groupBy("set_key").agg(first, F.first("n_shingles").alias("n"))
    nodes = common.materialize(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "n", "first"), "nodes")
    rows = nodes.select("node", "first._id", "first._mark")

    def with_text(frame: DataFrame, node: str, name: str) -> DataFrame:
        found = base.select("_id", "_mark", F.col("text").alias(name))
        return frame.join(rows.withColumnRenamed("node", node), node).join(found, ["_id", "_mark"]).drop("_id", "_mark")

    met = base.join(rows.hint("shuffle_hash"), ["_id", "_mark"]).select("node", "text")
    # a row that is there several times over would give its keys several times
    copies = sets.where("set_key is not null").groupBy("_id", "_mark").count().where("count > 1")
    texts = met if copies.isEmpty() else met.dropDuplicates(["node"])
    sizes = nodes.select("node", F.col("n").alias("least"), F.col("n").alias("most"))
    part = link_nodes(texts, with_text, sizes, _key_counts(both), percent)
    of = nodes.join(part, "node", "left").select("set_key", "first", F.coalesce("component", "node").alias("c"))
    return sets.select("_id", "_known", "n_shingles", "set_key"), of


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): the least id reachable by links of at least ``percent`` similarity.

    One row for each row of ``docs``, repeated rows included. A text that is null or
    has no words has an empty set and is linked with nothing; equal non-empty
    sets are linked. Ids are whole numbers of any sign. A null id takes part and gets the component's least id
    (null if it has none). Rows of one id with different texts are judged each by its own text. Other columns
    are not looked at. An empty table gives an empty one.
    """
    sets, of = _linked(docs.select(*_row_key(docs, id_col, text_col), F.col(text_col).alias("text")), percent)
    least = of.groupBy("c").agg(F.min(F.when(~F.col("first._null"), F.col("first._id"))).alias("component_id"))
    named = of.join(least, "c").select("set_key", "component_id")
    own = F.when(F.col("_known"), F.col("_id"))
    return sets.join(named, "set_key", "left").select(
        own.alias(id_col), "n_shingles", F.when(F.col("set_key").isNull(), own).otherwise(F.col("component_id")).alias("component_id")
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component stays: the one with the least id.

    Null ids come last; rows of one id are ordered by a hash of their text, equal ones by a hash of their other
    columns, and of rows equal in all columns one stays. Rows without words are linked with nothing and stay, all of them.
    """
    _, of = _linked(docs.select(*_row_key(docs, id_col, text_col), F.col(text_col).alias("text")), percent)
    kept = of.groupBy("c").agg(F.min("first").alias("first")).select("first._id", "first._mark")
    whole = F.struct(*docs.columns).alias("_all")
    keyed = docs.select(whole, *_row_key(docs, id_col, text_col), F.xxhash64(*docs.columns).alias("_row"))
    worded = F.coalesce(F.col("_all")[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = Window.partitionBy("_id", "_mark").orderBy("_row")
    found = keyed.where(worded).join(kept, ["_id", "_mark"], "left_semi").withColumn("_at", F.row_number().over(order)).where("_at = 1")
    return found.select("_all.*").union(keyed.where(~worded).select("_all.*"))


#: The same rows by comparing all pairs that share a shingle, for DuckDB and ids that are not null.
COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS node, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT node, doc_id, list_distinct(CASE
           WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingles
  FROM words
), members AS (
  SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.node AS a, b.node AS b
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS other FROM sets
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach r ON r.node = s.node JOIN sets o ON o.node = r.other
GROUP BY s.node, s.doc_id, s.shingles
"""
