"""Benchmark passages in documents, found up to a number of edits.

An item of m characters may differ in k = ERROR_PERCENT % of m edits. By the
pigeonhole principle, one of k + 1 pieces of the item stands unchanged in every
such occurrence. An Aho-Corasick automaton finds all pieces of all items in one
pass over a text; each hit fixes a window, in which Myers' bit-parallel
algorithm computes the least edit distance of the item to any stretch of the text.

Texts and items are compared in lower case with runs of white space as
one space; spans count characters of that form.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits allowed, in percent of an item's characters.
ERROR_PERCENT = 6
#: Items are shipped to the tasks in bundles of so many characters; more items make more bundles.
BUNDLE_CHARS = 2_000_000

MATCHES = "array<struct<item_id:long,start:int,end:int,distance:int>>"


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, first end of such a stretch)."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """Occurrences of a set of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int = ERROR_PERCENT):
        self.items = [(i, t) for i, t in ((i, normalize(t)) for i, t in items) if t]
        self.edits = [len(t) * error_percent // 100 for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            count = self.edits[n] + 1
            for p in range(count):
                a, b = len(t) * p // count, len(t) * (p + 1) // count
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the best occurrence of each item, in order of item."""
        if not self.items or not text:
            return []
        t = normalize(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for n, offset in where:
                found = best.get(n)
                if found and found[0] == 0:
                    continue
                k = self.edits[n]
                start = end + 1 - size - offset
                # hits of one occurrence lie within k of each other's diagonal
                step = start // (k + 1)
                if step in tried.setdefault(n, set()):
                    continue
                tried[n].add(step)
                hit = self._verify(n, t, start, k)
                if hit and (not found or hit < found):
                    best[n] = hit
        return sorted((self.items[n][0], s, e, d) for n, (d, s, e) in best.items())

    def _verify(self, n: int, t: str, start: int, k: int) -> tuple[int, int, int] | None:
        item = self.items[n][1]
        stop = start + len(item)
        if start >= 0 and t.startswith(item, start):
            if k or ((start == 0 or t[start - 1] == " ") and (stop == len(t) or t[stop] == " ")):
                return 0, start, stop
        if not k:  # an item too short for edits must stand as whole words
            return None
        # every diagonal of the hit's step, and k edits more on either side
        a = max(0, start - 2 * k)
        distance, end = myers(item, t[a : stop + 2 * k])
        if distance > k:
            return None
        _, back = myers(item[::-1], t[a : a + end][::-1])
        return distance, a + end - back, a + end


def finder(items: list[tuple[int, str]], error_percent: int = ERROR_PERCENT):
    """Column function: text -> its matches with these items."""

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Finder(items, error_percent)
        names = ("item_id", "start", "end", "distance")
        for s in batches:
            yield pd.Series([[dict(zip(names, m)) for m in f.matches(t)] for t in s], dtype=object)

    return find


def bundles(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = BUNDLE_CHARS) -> list[list[tuple[int, str]]]:
    """The items in bundles of bounded size, one after another; null texts are left out."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-total // size)
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items
        yield sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def match_column(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> Column:
    """Matches of each text with every item of the benchmark."""
    common.bound_batches(docs.sparkSession)
    found = [finder(b)(F.col(text_col)) for b in bundles(benchmark)]
    if not found:
        return F.array().cast(MATCHES)
    return F.concat(*found) if len(found) > 1 else found[0]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, end, distance): the best occurrence of each item in each document that holds one.

    Null and empty texts and items match nothing. Items of under 17 characters
    must occur unchanged, as whole words. Of equally good occurrences the first
    counts; repeated rows give repeated results; an empty table gives none.
    """
    base = docs.select(F.col(id_col).alias("_id"), match_column(docs, benchmark, text_col).alias("_m")).where(F.size("_m") > 0)
    return base.select("_id", F.explode("_m").alias("m")).select(
        F.col("_id").alias(id_col), "m.item_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), "m.distance"
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark."""
    return docs.where(F.size(match_column(docs, benchmark, text_col)) == 0)
