"""Language of a text by prediction by partial matching over bytes.

For each language, a byte context tree of order ORDER holds how often each byte
followed each context in a sample of its texts. A byte seen c times after a context
that was seen n times with d different bytes costs -log2(c / (n + d)); an unseen
one costs the escape, -log2(d / (n + d)), and what it costs after the context
one byte shorter; a context never seen costs nothing to leave; without any
context every byte costs 8 bits. The statistics are frozen, so the cost of a byte
depends on the ORDER bytes before it only, and each distinct run of
ORDER + 1 bytes of a block is looked up once. The language with the shortest code
for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context.
ORDER = 4
#: Bounds of the sample that each language's tree is learned from.
SAMPLE_PER_LANG = 400
SAMPLE_CHARS = 1_500_000
#: Answer for texts without a letter.
UNKNOWN = "und"
#: Bytes that are scored at once.
STRIDE = 2 << 20

_LETTER = regex.compile(r"\p{L}")


def to_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case, ORDER zero bytes before each, and where each one's bytes begin (and the last end)."""
    raw = [(t or "").lower().replace("\0", " ").encode("utf-8", "replace") for t in texts]
    pad = bytes(ORDER)
    b = np.frombuffer(b"".join(pad + r for r in raw), dtype=np.uint8)
    starts = np.cumsum([0] + [len(r) + ORDER for r in raw])
    return b, starts


def keys(b: np.ndarray, order: int) -> np.ndarray:
    """For each position from ORDER on, the byte there and ``order`` bytes before it as one number."""
    n = len(b) - ORDER
    out = np.zeros(max(n, 0), dtype=np.int64)
    for back in range(order, -1, -1):
        out = (out << 8) | b[ORDER - back : ORDER - back + len(out)]
    return out


class Model:
    """Context trees of several languages as sorted arrays, one pair for each order."""

    def __init__(self, langs: list[str], samples: list[list[str]]):
        self.langs = langs
        n = len(langs)
        counts = []
        for texts in samples:
            b, starts = to_bytes(texts)
            at = np.ones(len(b), dtype=bool)
            for k in range(ORDER):
                at[starts[:-1] + k] = False
            real = at[ORDER:]
            per_order = []
            for k in range(ORDER + 1):
                key = keys(b, k)[real]
                # contexts that reach before the text's begin are not counted
                if k:
                    key = key[((key >> (8 * k)) & 255) > 0]
                per_order.append(np.unique(key, return_counts=True))
            counts.append(per_order)
        self.symbols, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            symbols = np.unique(np.concatenate([c[k][0] for c in counts])) if n else np.zeros(0, dtype=np.int64)
            contexts = np.unique(symbols >> 8)
            cost = np.full((len(symbols), n), np.nan, dtype=np.float32)
            escape = np.zeros((len(contexts), n), dtype=np.float32)
            for lang, c in enumerate(counts):
                key, count = c[k]
                of = np.searchsorted(contexts, key >> 8)
                seen = np.bincount(of, weights=count, minlength=len(contexts))
                kinds = np.bincount(of, minlength=len(contexts))
                total = seen + kinds
                cost[np.searchsorted(symbols, key), lang] = -np.log2(count / total[of])
                some = kinds > 0
                escape[some, lang] = -np.log2(kinds[some] / total[some])
            self.symbols.append(symbols)
            self.costs.append(cost)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def cost(self, key: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each run of ORDER + 1 bytes, in each language."""
        total = np.full((len(key), len(self.langs)), 8, dtype=np.float32)
        for k in range(ORDER + 1):
            short = key & ((1 << 8 * (k + 1)) - 1)
            if not len(self.symbols[k]):
                continue
            context = short >> 8
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            total += np.where(known[:, None], self.escapes[k][at], 0)
            at = np.minimum(np.searchsorted(self.symbols[k], short), len(self.symbols[k]) - 1)
            cost = np.where((self.symbols[k][at] == short)[:, None], self.costs[k][at], np.nan)
            total = np.where(np.isnan(cost), total, cost)
        return total

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each whole text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        b, starts = to_bytes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))[ORDER:]
        for a in range(0, len(owner), STRIDE):
            part = b[a : a + STRIDE + ORDER]
            key = keys(part, ORDER)
            real = part[ORDER:] > 0  # the padding between texts costs nothing
            key, who = key[real], owner[a : a + STRIDE][real]
            if not len(key):
                continue
            code, distinct = pd.factorize(key)
            cost = self.cost(distinct).astype(np.float64)
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            for lang in range(len(self.langs)):
                out[who[first], lang] += np.add.reduceat(cost[code, lang], first)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability given the code lengths, for each text."""
        if not texts:
            return [], np.zeros(0)
        letters = [bool(t and _LETTER.search(t)) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.bits(texts)
        best = bits.argmin(axis=1)  # of equal code lengths, the first in order of name
        p = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)], np.where(letters, p, 0.0)


def fit(sample: list[tuple[str, str]]) -> Model:
    """Learn one tree for each label of (text, language) pairs."""
    langs = sorted({lang for _, lang in sample})
    return Model(langs, [[t for t, x in sample if x == lang] for lang in langs])


def fit_documents(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, max_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample of the documents with a language outside the held-out fold (crc32 of the id, modulo 3, is 1)."""
    return fit(common.labelled_sample(docs, docs, "lang", per_lang, max_chars, folds=3, held_out=1))


def predictor(model: Model):
    """Column function: text -> (lang_pred, score). Null and texts without a letter are UNKNOWN, with score 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = model.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def language(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    common.bound_batches(docs.sparkSession)
    return predictor(model)(F.col(text_col))
