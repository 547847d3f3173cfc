"""Removal of repeated text by two-stage suffix sorting.

A byte goes when it lies in a string of LENGTH bytes that also starts earlier: in a document with a
smaller id, or earlier in the same one. Three steps, whose work is linear in the text:

1. Anchors. Every LENGTH-byte string is given the least hash among its GRAM-byte grams, the
   first one of equals; equal strings get the same anchor at the same place. Neighbouring starts with
   one anchor form a stretch. Equal stretches (same anchor, same digest of all their
   bytes) collapse to the earliest, first in each batch, then over the cluster; the
   starts of the others are repeats. No text is shuffled for this. An anchor with one distinct stretch
   is settled by it.
2. Suffix sorting. Distinct stretches that share an anchor are cut by how far a start lies from
   the anchor, which gives each part bytes that all its strings hold; parts whose bytes are met
   once are dropped. The rest are sorted in blocks of bounded size: only suffixes smaller than their
   successors are sorted directly, the others are induced by scanning the buckets of first bytes in
   order, and common prefixes of neighbours in that order give the equal strings, of which all but the
   earliest are repeats. More than CROWDED parts with the same bytes (an end of a passage in
   ever new surroundings) are dealt by salt, and what their blocks leave by strings, so that no
   task gets a group that grows with the corpus.
3. Cutting. The repeats of a document meet its text, which is written without them.

Rows of step 1 carry hashes and places only, some 40 bytes of text each. Digests have
64 bits next to the anchor's 64, so that different stretches are beyond taking for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Bytes of a string that counts as a repeat.
LENGTH = 100
#: Bytes of a gram, and grams of a string among which the anchor is chosen.
GRAM = 24
#: Starts that are hashed at once; a power of two, as places share 64 bits with hashes.
PIECE = 1 << 16
#: Starts by whose distance from the anchor a stretch is cut.
REACH = 26
#: Bytes that are suffix-sorted at once, and parts with one key from which they are dealt by salt.
BLOCK_BYTES = 1 << 20
CROWDED = 2048
#: Groups among which the parts of a crowded key are dealt.
SALTS = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_PLACE_BITS = np.uint64(PIECE * 2 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Stretches of byte strings; holds tables of fixed size."""

    def __init__(self) -> None:
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
        self.up = _powers(_ODD, PIECE + LENGTH)
        self.down = _powers(pow(_ODD, -1, 1 << 64), PIECE + LENGTH)

    def grams(self, raw: np.ndarray) -> np.ndarray:
        """Hash of the GRAM bytes from each place."""
        h, width, parts, at = self.table[raw], 1, [], 0
        while width <= GRAM:
            if GRAM & width:
                parts.append((h, width))
            factor = np.uint64(pow(_ODD, width, 1 << 64))
            h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
            width *= 2
        out, count = None, len(raw) - GRAM + 1
        for h, width in reversed(parts):
            one = h[at : at + count]
            out = one.copy() if out is None else out * np.uint64(pow(_ODD, width, 1 << 64)) + one
            at += width
        return _mix(out)

    def stretches(self, raw: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, number of starts, place of the anchor from the start, anchor, digest) of the valid starts of at most PIECE bytes and LENGTH - 1 more."""
        hashes = self.grams(raw)
        inside = LENGTH - GRAM + 1
        starts = len(hashes) - inside + 1
        key = (hashes & ~_PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= inside:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:starts], least[inside - width : inside - width + starts])
        place = (least & _PLACE_BITS).astype(np.int64)
        new = np.empty(starts, dtype=bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, starts))
        real = valid[first]
        first, count = first[real], count[real]
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)])
        digest = (total[first + count - 1 + inside] - total[first]) * self.down[first]
        return first, count, place[first] - first, hashes[place[first]], _mix(digest + count.astype(np.uint64))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that hold whole documents where they fit, and overlap inside longer ones."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at + LENGTH <= end:
        stop = min(at + PIECE, end)
        if stop < end:
            last = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            stop = last if last > at else stop
        yield at, stop
        at = stop


def _earliest(h: np.ndarray, g: np.ndarray, doc: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first row of each (h, g), and of the later ones that start elsewhere, by document and place."""
    order = np.lexsort((off, doc, g, h))
    if not len(order):
        return order, order
    same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    lead = np.repeat(order[head], np.diff(np.append(head, len(order))))
    later = (doc[order] != doc[lead]) | (off[order] != off[lead])
    return order[head], order[later]


def _joined(doc: np.ndarray, off: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, touching ones of a document united."""
    order = np.lexsort((off, doc))
    doc, off, end = doc[order], off[order], (off + count)[order]
    if not len(doc):
        return doc, off, end
    # ends grow within a document, as far as any before
    far = np.maximum.accumulate(end + doc.astype(np.int64) * (1 << 32)) - doc.astype(np.int64) * (1 << 32)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (off[1:] > far[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], off[first], far[last] - off[first]


def document_key(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """(id, tie): rows of one id are told apart by their text's hash; one id a row needs none."""
    repeated = docs.groupBy(id_col).count().where("count > 1").isEmpty()
    return F.col(id_col).cast("long"), F.lit(0).cast("long") if repeated else F.xxhash64("_bytes")


_ROWS = "repeat boolean, h long, g long, id long, tie long, off int, n int, a int"
_ROW_NAMES = ["repeat", "h", "g", "id", "tie", "off", "n", "a"]


def _rows(repeat: bool, h, g, ids: pa.Array, ties: pa.Array, doc: np.ndarray, off, n, a) -> pa.RecordBatch:
    at = pa.array(doc)
    columns = [pa.array(np.full(len(doc), repeat)), h.view(np.int64), g.view(np.int64), ids.take(at), ties.take(at), *(x.astype(np.int32) for x in (off, n, a))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_ROW_NAMES)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the documents (id, tie, text), equal ones of a batch collapsed; ranges of known repeats."""
    hasher = Hasher()
    for b in batches:
        ids, ties, texts = b.columns
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        # documents by rank of (id, tie), null ids first; equal documents share a rank
        _, tie_rank = np.unique(ties.to_numpy(), return_inverse=True)
        _, id_rank = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)
        id_rank = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, id_rank + 1)
        _, rank = np.unique(id_rank * (len(tie_rank) + 1) + tie_rank, return_inverse=True)
        found = []
        for at, stop in _pieces(offsets):
            part = raw[at : min(stop + LENGTH - 1, int(offsets[-1]))]
            if len(part) < LENGTH:
                continue
            places = np.arange(at, at + len(part) - LENGTH + 1)
            doc = np.searchsorted(offsets, places, side="right") - 1
            # a document's last starts have no LENGTH bytes; their mark changes where documents meet
            first, count, a, h, g = hasher.stretches(part, places + LENGTH <= offsets[doc + 1])
            found.append((doc[first], first + at - offsets[doc[first]], count, a, h, g))
        if not found:
            continue
        doc, off, count, a, h, g = map(np.concatenate, zip(*found))
        firsts, later = _earliest(h, g, rank[doc], off)
        yield _rows(False, h[firsts], g[firsts], ids, ties, doc[firsts], off[firsts], count[firsts], a[firsts])
        doc, off, count = _joined(doc[later], off[later], count[later])
        spread = _mix(off.astype(np.uint64) * np.uint64(1 << 20) + doc.astype(np.uint64))
        yield _rows(True, spread, spread, ids, ties, doc, off, count, off)


_SETTLED = "need boolean, id long, tie long, off int, n int, a int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, g, id, tie, off): repeats, and the first row of each of several stretches of one anchor.

    Looks one row back and one first row ahead, so a group of any size streams through.
    """
    names = ["need", "id", "tie", "off", "n", "a"]

    def put(need: bool, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, need)), *(b.column(c) for c in names[1:])], names=names)

    lead: pa.RecordBatch | None = None  # the first row of the last group
    lead_alone = True  # no other stretch of its anchor so far
    for b in batches:
        known = b.column("repeat")
        yield put(False, b.filter(known))
        b = b.filter(pc.invert(known))
        if not b.num_rows:
            continue
        joined = pa.concat_batches([lead, b]) if lead is not None else b
        had = lead is not None
        h, g = joined.column("h").to_numpy(), joined.column("g").to_numpy()
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        head = np.flatnonzero(new)
        lead_of = pa.array(np.repeat(head, np.diff(np.append(head, len(h)))))
        first = joined.take(lead_of)
        elsewhere = np.zeros(len(h), dtype=bool)
        for c in ("id", "tie", "off"):
            a, z = joined.column(c), first.column(c)
            null_a, null_z = (x.is_null().to_numpy(zero_copy_only=False) for x in (a, z))
            elsewhere |= (a.fill_null(0).to_numpy() != z.fill_null(0).to_numpy()) | (null_a != null_z)
        yield put(False, joined.filter(pa.array(elsewhere)))
        # a first row is needed if the first row before or after it has the same anchor
        hh = h[head]
        like_next = np.append(hh[1:] == hh[:-1], False)
        like_last = np.concatenate([[had and not lead_alone], hh[1:] == hh[:-1]])
        need = (like_next | like_last)[:-1]
        if had and not lead_alone and len(need):
            need[0] = False  # given out already
        shown = like_last[-1]
        give = head[:-1][need].tolist() + ([int(head[-1])] if shown and (len(head) > 1 or not had) else [])
        yield put(True, joined.take(pa.array(give, pa.int64())))
        lead, lead_alone = joined.slice(int(head[-1]), 1), not shown


def suffix_order(text: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of all suffixes, in order of their first ``depth`` bytes at least (those beyond: any order).

    ``words`` are the eight bytes from each place, zeros past the end. Two stages: suffixes
    smaller than their successors are sorted; each other one goes to the front of the bucket
    of its first byte when the scan of the buckets, in order, meets its successor.
    """
    size = len(text)
    step = text[1:].astype(np.int16) - text[:-1]
    turn = np.append(np.flatnonzero(step), size - 1)
    # where bytes are equal, the next unequal pair decides; the last suffix is larger than the empty one
    decides = turn[np.searchsorted(turn, np.arange(size))]
    smaller = np.append(step, -1)[decides] > 0
    order = np.flatnonzero(smaller)
    order = order[np.argsort(words[order], kind="stable")]
    key = words[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(order) else key
    for deep in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.concatenate([[False], same])) if len(order) else order
        if not len(tied):
            break
        key = words[np.minimum(order[tied] + deep, size)]
        sorted_ = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][sorted_], key[sorted_]
        parts = group[tied]
        new = np.concatenate([[True], (parts[1:] != parts[:-1]) | (key[1:] != key[:-1])])
        fresh = np.concatenate([[True], ~same])
        fresh[tied] = new
        group = np.cumsum(fresh)
    heads = np.searchsorted(text[order], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets[text[-1]].append(np.array([size - 1]))
    out = []
    for byte in np.unique(text).tolist():
        front = np.concatenate(buckets[byte]) if buckets[byte] else order[:0]
        while len(front):
            out.append(front)
            _hand_on(front, byte, text, buckets)
            front = front[front > 0] - 1
            front = front[text[front] == byte]
        back = order[heads[byte] : heads[byte + 1]]
        out.append(back)
        _hand_on(back, byte, text, buckets)
    return np.concatenate(out)


def _hand_on(places: np.ndarray, byte: int, text: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Predecessors with a larger first byte go to their buckets, in this order."""
    before = places[places > 0] - 1
    first = text[before]
    larger = first > byte
    before, first = before[larger], first[larger]
    by_byte = np.argsort(first, kind="stable")
    before, first = before[by_byte], first[by_byte]
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else before
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(first)]):
        buckets[first[a]].append(before[a:z])


def _repeats(parts: list[bytes], counts: list[int], length: int) -> np.ndarray:
    """Whether each start of the parts, in their order, begins a string that began earlier among them."""
    lengths = np.array([len(p) for p in parts])
    # two bytes end a part, so that runs of one byte end with it
    text = np.frombuffer(b"".join(p + b"\x00\xff" for p in parts), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    counts = np.array(counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(at, counts) + inner
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(text) + 1, dtype=np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * (7 - k))
    real = np.zeros(len(text), dtype=bool)
    real[starts] = True
    order = suffix_order(text, words, length)
    order = order[real[order]]
    # neighbours with a common prefix of that length
    equal = np.arange(len(order) - 1)
    for deep in [*range(0, length - 7, 8), max(0, length - 8)]:
        a, b = words[order[equal] + deep], words[order[equal + 1] + deep]
        if length < 8:
            a, b = (x >> np.uint64(64 - 8 * length) for x in (a, b))
        equal = equal[a == b]
    joins = np.zeros(len(order), dtype=bool)
    joins[equal + 1] = True
    head = np.flatnonzero(~joins)
    least = np.minimum.reduceat(order, head) if len(order) else order
    again = np.zeros(len(text), dtype=bool)
    again[order] = order != np.repeat(least, np.diff(np.append(head, len(order))))
    return again[starts]


def _sorter(length: int, block: int):
    """Rows (h, hot, id, tie, off, n, part) sorted by h and place, to runs of starts that are repeats.

    Equal strings have one h. Groups that are not hot are compared whole: what a block leaves of an open group
    is compared with the group's rest. Runs of hot rows that are the first of their
    block and group come out too, with their bytes, and are yet to be compared.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple], left: list[tuple]) -> pa.RecordBatch:
            """Runs of repeats; ``left`` gets the rows that have other starts, and are not hot."""
            again = _repeats([r[6] for r in rows], [r[5] for r in rows], length)
            counts = np.array([r[5] for r in rows])
            row = np.repeat(np.arange(len(rows)), counts)
            first = np.cumsum(counts) - counts
            hot = np.array([r[1] for r in rows])
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (again[1:] != again[:-1])])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(again)))
            shown = again[head] | hot[row[head]]
            out = []
            for k, n in zip(head[shown].tolist(), size[shown].tolist()):
                _, _, i, tie, off, _, part = rows[row[k]]
                at = k - int(first[row[k]])
                out.append((True, i, tie, off + at, n, None) if again[k] else (False, i, tie, off + at, n, part[at : at + n + length - 1]))
            alive = (np.add.reduceat(~again, first) > 0) & ~hot
            left.extend(rows[k] for k in np.flatnonzero(alive))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["repeat", *_PLACE, "n", "part"])

        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= block:
                    left: list[tuple] = []
                    yield flush(held, left)
                    held = [r for r in left if r[0] == row[0]]
                    # what is left of an open group is at most CROWDED different stretches
                    size = 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held, [])

    return sort


_SORTED = "repeat boolean, id long, tie long, off int, n int, part binary"
_PLACE = ["id", "tie", "off"]


def _sort_parts(parts: DataFrame, *salt: Column) -> DataFrame:
    """``parts`` (h, hot, id, tie, off, n, part) through the sorter."""
    order = ["h", F.col("id").asc_nulls_first(), "tie", "off"]
    # a partition's rows of one h are in order of place, whatever their salt
    dealt = parts.repartition("h", *salt).sortWithinPartitions(*order)
    return dealt.select("h", "hot", *_PLACE, "n", "part").mapInArrow(_sorter(LENGTH, BLOCK_BYTES), _SORTED)


def _same(left: str = "id", right: str = "_id") -> Column:
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("tie") == F.col("_tie"))


#: Slots of the filter of documents are at most this many bits, sent to the tasks in words of 64.
MOST_SLOTS = 1 << 26


def _maybe(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` (id, tie, ...) with ``maybe``, false only where ``keys`` do not hold the document.

    A bitmap of hashed documents, a megabyte of words at most for each million of slots; where
    a corpus outgrows it, more documents are looked up in vain, and results are the same.
    """
    rows = keys.select(F.countDistinct(F.struct("id", "tie"))).first()[0]
    slots = min(MOST_SLOTS, 1 << max(16, (8 * rows).bit_length()))
    slot = F.pmod(F.xxhash64("id", "tie"), F.lit(slots))
    bit = lambda s: F.expr(f"shiftleft(1L, cast({s} % 64 as int))")
    words = keys.select(slot.alias("_s")).distinct().groupBy((F.col("_s") / 64).cast("long").alias("_w")).agg(F.bit_or(bit("_s")).alias("_bits"))
    # at most MOST_SLOTS / 64 rows of two longs
    met = docs.withColumn("_s", slot).join(F.broadcast(words), (F.col("_s") / 64).cast("long") == F.col("_w"), "left")
    return met.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit("_s")) != 0, F.lit(False))).drop("_s", "_w", "_bits")


def _by_reach(needs: DataFrame) -> DataFrame:
    """Stretches (id, tie, off, n, a, text) cut by how far a start lies from the anchor, in steps of REACH.

    Strings of one such part share LENGTH - REACH + 1 bytes, whose hash is their key ``h``:
    equal strings lie equally far from their anchor and get the same key.
    """
    last = F.floor(F.col("a") / REACH).cast("int")
    least = F.floor((F.col("a") - F.col("n") + 1) / REACH).cast("int")
    each = needs.withColumn("step", F.explode(F.sequence(least, last)))
    near = F.col("a") - F.col("step") * REACH
    each = each.withColumn("from", F.greatest(F.lit(0), near - (REACH - 1))).withColumn("to", F.least(F.col("n") - 1, near))
    shared = F.substring(F.col("_bytes"), F.col("off") + near + 1, F.lit(LENGTH - REACH + 1))
    n = F.col("to") - F.col("from") + 1
    off = F.col("off") + F.col("from")
    part = F.substring(F.col("_bytes"), off + 1, n + LENGTH - 1)
    return each.select(F.xxhash64("step", shared).alias("h"), "id", "tie", off.alias("off"), n.alias("n"), part.alias("part"))


def repeats(docs: DataFrame) -> DataFrame:
    """(id, tie, off, n): runs of starts of strings that start earlier, from documents (id, tie, _bytes)."""
    rows = docs.where(F.octet_length("_bytes") >= LENGTH).mapInArrow(_anchors, _ROWS)
    place = [F.col("id").asc_nulls_first(), "tie", "off"]
    settled = rows.repartition("h").sortWithinPartitions("h", "g", *place).mapInArrow(_settle, _SETTLED)
    settled = materialize(settled, "stretches")
    needs = settled.where("need").drop("need")
    asked = _maybe(docs, needs).where("maybe").select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "_bytes").dropDuplicates(["_id", "_tie"])
    parts = _by_reach(needs.join(asked, _same()))
    # a part alone with its key has no equal string
    sizes = parts.groupBy("h").count().where("count > 1").select(F.col("h").alias("_h"), (F.col("count") > CROWDED).alias("hot"))
    parts = parts.join(sizes, F.col("h") == F.col("_h"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "off"), F.lit(SALTS))).otherwise(0)
    found = materialize(_sort_parts(parts, salt), "repeats")
    # what blocks of hot groups leave meets string by string
    each = found.where("not repeat").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    string = F.substring(F.col("part"), F.col("i") + 1, F.lit(LENGTH))
    strings = each.select(F.xxhash64(string).alias("h"), F.lit(False).alias("hot"), "id", "tie", (F.col("off") + F.col("i")).alias("off"), F.lit(1).alias("n"), string.alias("part"))
    runs = [settled.where("not need"), found.where("repeat"), _sort_parts(strings).where("repeat")]
    return runs[0].select(*_PLACE, "n").union(runs[1].select(*_PLACE, "n")).union(runs[2].select(*_PLACE, "n"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, kept = [], []
        for raw, runs in zip(b.column("_bytes").to_pylist(), b.column("runs").to_pylist()):
            mine: list[list[int]] = []
            for off, n in sorted((r["off"], r["n"]) for r in runs or []):
                end = off + n - 1 + LENGTH
                if mine and off <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], end)
                else:
                    mine.append([off, end])
            spans.append([{"start": a, "end": z} for a, z in mine])
            edges = [0, *(x for m in mine for x in m), len(raw)]
            kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in b.column("_bytes").to_pylist()], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): each document's bytes without those in strings that start earlier.

    ``spans`` are the removed runs [start, end) in bytes of UTF-8, ``kept`` the rest, which may cut a
    character. Ids are whole numbers; null ids come before all others. A null text is empty; texts under
    LENGTH bytes lose nothing. Rows of one id with different texts are different documents, ordered by
    their texts' hashes; rows with the same id and text are one document, and each gets its result. An empty table gives
    an empty one. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    raw = docs.withColumn("_bytes", F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"))
    key, tie = document_key(raw, id_col)
    raw = raw.select(key.alias("id"), tie.alias("tie"), "_bytes")
    found = materialize(repeats(raw), "repeats")
    runs = found.groupBy("id", "tie").agg(F.collect_list(F.struct("off", "n")).alias("runs"))
    runs = runs.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "runs")
    flagged = _maybe(raw, found)
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = flagged.where("not maybe").select("id", F.octet_length("_bytes").cast("long").alias("n_bytes"), none.alias("spans"), F.col("_bytes").alias("kept"))
    met = flagged.where("maybe").select("id", "tie", "_bytes").join(runs, _same(), "left").select("id", "_bytes", "runs")
    cut = met.mapInArrow(_cut, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return clean.union(cut).withColumnRenamed("id", id_col)


def digests(removed: DataFrame) -> DataFrame:
    """Counts and digest in place of spans and bytes, of what ``remove_repeats`` gives."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select(
        *[c for c in removed.columns if c not in ("spans", "kept")], lost.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The same rows by grouping every 100-byte string of the corpus, for DuckDB.
REMOVED_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS node, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), starts AS (
  SELECT node, doc_id, unnest(range(0, octet_length(raw) - 99)) AS pos, raw FROM texts
), strings AS (
  SELECT node, doc_id, pos, md5(hex(raw[pos + 1:pos + 100])) AS key FROM starts
), later AS (
  SELECT node, pos FROM strings QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, node, pos) > 1
), marked AS (
  SELECT node, pos, CASE WHEN pos <= lag(pos) OVER w + 100 THEN 0 ELSE 1 END AS opens FROM later WINDOW w AS (PARTITION BY node ORDER BY pos)
), numbered AS (
  SELECT node, pos, sum(opens) OVER (PARTITION BY node ORDER BY pos) AS span FROM marked
), spans AS (
  SELECT node, span, min(pos) AS first, max(pos) + 100 AS last FROM numbered GROUP BY node, span
), gaps AS (
  SELECT node, coalesce(lag(last) OVER (PARTITION BY node ORDER BY first), 0) AS first, first AS last, last - first AS removed FROM spans
), kept AS (
  SELECT g.node, string_agg(hex(raw[g.first + 1:g.last]), '' ORDER BY g.first) AS digits, max(g.last + removed) AS upto,
         sum(removed) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN texts t ON t.node = g.node GROUP BY g.node
)
SELECT t.doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.node IS NULL THEN hex(raw) ELSE digits || hex(raw[upto + 1:]) END)) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.node = t.node
"""
