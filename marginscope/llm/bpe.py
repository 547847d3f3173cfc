"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of the corpus (one Arrow batch) is cut into the matches of the
tokenizer's pattern, and its distinct matches are laid end to end as one array of
byte tokens. An inverted index maps the rank of each adjacent token pair to the
positions where it stands; ranks leave a heap in order, every occurrence is
merged at once, and only the two neighbours of a merge are looked up and
indexed again. The ids of a text are then put together from those of its matches.

The result is that of merging the lowest-ranked pair of each match again and
again, leftmost first. Where a merge creates a pair of a lower rank than its own,
merging all occurrences at once could differ; such words are encoded alone.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces of text whose ids a task keeps between blocks.
CACHE = 200_000
#: Characters of texts whose pieces are held at once.
SLICE = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The pairs of tokens that merge, as sorted arrays: pair -> id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            (ranks[t[:k]] << 32) | ranks[t[k:]]: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.none = max(ranks.values()) + 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], self.none)

    def encode_one(self, word: bytes) -> list[int]:
        """One word, merging the lowest-ranked pair again and again."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, self.none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == self.none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each (non-empty) word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = int(ends[-1])
        # position n stands for "no neighbour"
        tok = np.append(self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)], 0)
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before[starts] = n
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        pair = np.full(n + 1, self.none)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def enter(at: np.ndarray) -> np.ndarray:
            """Look up the pairs that begin at these positions and index them; returns their ranks."""
            rank = self.lookup(tok[at], tok[after[at]])
            pair[at] = rank
            hit = rank < self.none
            found, where = rank[hit], at[hit]
            if len(found):
                order = np.argsort(found, kind="stable")
                found, where = found[order], where[order]
                cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
                heads = found[np.concatenate(([0], cuts))].tolist()
                for r, group in zip(heads, np.split(where, cuts) if len(cuts) else [where]):
                    if r in index:
                        index[r].append(group)
                    else:
                        index[r] = [group]
                        heapq.heappush(heap, r)
            return rank

        enter(np.flatnonzero(after[:n] != n))
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.concatenate(groups)
            at = at[pair[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                twice = at[1:] == at[:-1]  # a position between two merges was indexed twice
                if twice.any():
                    at = at[np.append(True, ~twice)]
                if (after[at[:-1]] == at[1:]).any():  # runs such as "aaaa": every second one, from the left
                    keep, taken = [], -1
                    for p in at.tolist():
                        if p != taken:
                            keep.append(p)
                            taken = after[p]
                        else:
                            taken = -1
                    at = np.array(keep)
            gone = after[at]
            # one by one, the first of two neighbours would for a moment stand beside the second's first token
            near = np.flatnonzero(after[gone[:-1]] == at[1:])
            if len(near):
                moment = self.lookup(np.full(len(near), r), tok[at[near + 1]]) < r
                if moment.any():
                    odd.append(at[near[moment]])
            tok[at] = r
            alive[gone] = False
            pair[gone] = self.none
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            pair[at] = self.none
            left = before[at]
            touched = np.concatenate((at[beyond != n], left[left != n]))
            if len(touched):
                ranks = enter(touched)
                if (ranks < r).any():
                    odd.append(touched[ranks < r])
        kept = np.flatnonzero(alive)
        ids = tok[kept].astype("<u4").tobytes()
        cut = np.searchsorted(kept, ends) * 4
        out, last = [], 0
        for c in cut.tolist():
            out.append(ids[last:c])
            last = c
        for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else ():
            out[w] = np.array(self.encode_one(words[w]), dtype="<u4").tobytes()
        return out


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces between blocks, a bounded number of them.

    A single space between two other non-space characters always begins a
    match. A text in which every space stands so is cut there and each different
    piece is matched only once; any other text is matched as a whole.
    """

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges = merges
        self.find = regex.compile(pattern).findall
        self.cut_at_spaces = pattern == PATTERN
        self.known: dict[str, bytes] = {}  # pieces after a space
        self.uneven: set[str] = set()  # those that begin or end with white space
        self.matches: dict[str, bytes] = {}

    def block(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; b'' for null or empty."""
        out: list[bytes] = []
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= SLICE:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held)

    def _slice(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) + len(self.matches) > CACHE:
            self.known, self.uneven, self.matches = {}, set(), {}
        # the pieces of a text take far more memory than the text: they are cut twice rather than held
        new: set[str] = set()
        for t in texts:
            if t and self.cut_at_spaces:
                new.update(t.split(" ")[1:])
        names = list(new - self.known.keys())
        del new
        self.uneven.update(p for p in names if not p or p[0].isspace() or p[-1].isspace())
        found = [self.find(" " + p) for p in names]
        whole: list[list[str]] = []  # the matches of a text's first piece, or of all of it
        even: list[bool] = []
        for t in texts:
            ps = t.split(" ") if t and self.cut_at_spaces else None
            ok = bool(ps) and ps[0] != "" and not ps[0][-1].isspace() and self.uneven.isdisjoint(ps[1:])
            even.append(ok)
            whole.append(self.find(ps[0] if ok else t) if t else [])
        words = list({m for ms in found for m in ms}.union(*whole) - self.matches.keys())
        self.matches.update(zip(words, self.merges.replay([w.encode() for w in words])))
        self.known.update((p, b"".join([self.matches[m] for m in ms])) for p, ms in zip(names, found))
        out = []
        for t, ms, ok in zip(texts, whole, even):
            head = b"".join([self.matches[m] for m in ms])
            if ok:
                head += b"".join(map(self.known.__getitem__, t.split(" ")[1:]))
            out.append(head)
        return out


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    """Column function: text -> ids packed as little-endian 32-bit integers (binary)."""
    merges = Merges(ranks)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(merges, pattern)
        for s in batches:
            yield pd.Series(e.block(s.tolist()), dtype=object)

    return encode


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    token = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        token[r] = t
    return token


def _decode(token: list[bytes], packed: bytes) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def decoder(ranks: dict[bytes, int]):
    """Column function: packed ids -> bytes. An id outside the vocabulary raises."""
    token = _tokens(ranks)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_decode(token, x or b"") for x in s], dtype=object)

    return decode


def coder(ranks: dict[bytes, int], pattern: str = PATTERN):
    """Column function: text -> (ids, decoded): packed ids, and the bytes they decode to."""
    merges, token = Merges(ranks), _tokens(ranks)

    @F.pandas_udf("ids binary, decoded binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = Encoder(merges, pattern)
        for s in batches:
            ids = e.block(s.tolist())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([_decode(token, x) for x in ids], dtype=object)})

    return code


def n_tokens(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def unpack(packed: Column) -> Column:
    """Packed ids as array<int>, with built-in functions only."""
    h = F.hex(packed)
    def one(i):
        b = [F.substring(h, i * 8 + 1 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)]
        return F.conv(F.concat(*b), 16, 10).cast("int")
    return F.when(n_tokens(packed) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), n_tokens(packed).cast("int") - 1), one)
    )


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Every column of ``docs`` and the packed ids of its text.

    A null or empty text has no ids. A column already named ``ids_col`` is
    replaced. Repeated rows stay repeated; an empty table gives an empty one.
    """
    common.bound_batches(docs.sparkSession)
    return docs.withColumn(ids_col, encoder(ranks)(F.col(text_col)))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row a document: number of tokens, packed ids, sha256 of them and of the bytes they decode to."""
    common.bound_batches(docs.sparkSession)
    coded = docs.select(id_col, *keep, coder(ranks)(F.col(text_col)).alias("_c"))
    return coded.select(
        id_col,
        *keep,
        n_tokens(F.col("_c.ids")).alias("n_tokens"),
        F.sha2("_c.ids", 256).alias("ids_sha256"),
        F.sha2("_c.decoded", 256).alias("decoded_sha256"),
        F.col("_c.ids").alias("ids"),
    )
