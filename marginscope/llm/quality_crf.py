"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is described by shares of its bytes and words (symbols,
capitals, bars, words that repeat their neighbour, ...). A two-state chain with
weights for the line's own features, those of the lines before and after it and
the change of state gives each line's probability of being good by
forward-backward; their mean, weighted by line length, is the quality of the
document, put on the scale of a probability by a logistic fit.

Labels belong to documents, so lines are first labelled like their document;
after a first fit the lines of a bad document that look good are relabelled
(the worst line stays bad) and the chain is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample of labelled documents that the model is fitted on.
SAMPLE_PER_LABEL = 2000
SAMPLE_CHARS = 4_000_000
#: Fitting cuts documents into runs of so many lines; scoring does not.
RUN = 64
#: Characters whose features are computed at once.
STRETCH = 1 << 20
#: A document is good from this score on.
GOOD = 0.3

_KINDS = {"lower": 0, "upper": 1, "digit": 2, "space": 3, "mark": 4, "other": 5, "bar": 6, "wide": 7}


def _kind_of_byte() -> np.ndarray:
    kind = np.full(256, _KINDS["other"], dtype=np.uint8)
    kind[128:] = _KINDS["wide"]
    for chars, name in (
        ("abcdefghijklmnopqrstuvwxyz", "lower"),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        ("0123456789", "digit"),
        (" \t\n\r\v\f", "space"),
        (".,;:?'\"()-", "mark"),
        ("|", "bar"),
    ):
        kind[[ord(c) for c in chars]] = _KINDS[name]
    return kind


KIND = _kind_of_byte()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length, and the number of lines of each text.

    Null counts as empty; an empty text is one empty line. Texts are taken some at
    a time, as the arrays over bytes are many times their size.
    """
    parts, now, held = [], [], 0
    for t in texts:
        now.append(t)
        held += len(t or "")
        if held >= STRETCH:
            parts.append(_line_features(now))
            now, held = [], 0
    if now or not parts:
        parts.append(_line_features(now or [""]))
    x, size, lines = zip(*parts)
    return np.concatenate(x), np.concatenate(size), np.concatenate(lines)


def _line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = ("\n".join(t or "" for t in texts) + "\n").encode("utf-8", "replace")
    b = np.frombuffer(raw, dtype=np.uint8)
    lines = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    kind = KIND[b]
    count = {name: np.add.reduceat((kind == k), starts, dtype=np.int64) for name, k in _KINDS.items()}
    count["space"] -= 1  # the line's own end
    # the same symbol twice in a row ("!!", "%%%")
    twice = np.zeros(len(b), dtype=bool)
    twice[1:] = (b[1:] == b[:-1]) & (kind[1:] == _KINDS["other"])
    doubled = np.add.reduceat(twice, starts, dtype=np.int64)
    # words, and those equal to the word before them on the line
    gap = kind == _KINDS["space"]
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    words = np.zeros(len(starts), dtype=np.int64)
    repeats = np.zeros(len(starts), dtype=np.int64)
    if len(first):
        line_of = np.searchsorted(ends, first)
        words = np.bincount(line_of, minlength=len(starts))
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b)))) if first[0] == 0 else (
            np.arange(len(b)) - np.concatenate((np.zeros(first[0], dtype=np.int64), np.repeat(first, np.diff(np.append(first, len(b))))))
        )
        value = np.where(gap, np.uint64(0), _MIX[LOWER[b]] * _STEP[place & 63])
        key = np.add.reduceat(value, first)
        same = (key[1:] == key[:-1]) & (line_of[1:] == line_of[:-1])
        repeats = np.bincount(line_of[1:][same], minlength=len(starts))
    n = np.maximum(size, 1)
    w = np.maximum(words, 1)
    letters = np.maximum(count["lower"] + count["upper"] + count["wide"], 1)
    shares = np.stack(
        [
            count["other"] / n,
            doubled / w,
            count["upper"] / letters,
            count["bar"] / w,
            repeats / w,
            count["digit"] / n,
            count["mark"] / w,
            (size - count["space"]) / w / 20,
        ],
        axis=1,
    )
    shares = np.clip(shares, 0, 2)
    extra = np.stack([np.log1p(size) / 10, size == 0, (words <= 3) & (size > 0)], axis=1)
    return np.concatenate([shares, np.minimum(1, 5 * shares[:, :5]), extra], axis=1), size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in the same text, and a constant."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[(ends - lines)], after[ends - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(unary: np.ndarray, stay: float, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all texts at once: P(good) of each line, P(same state as the line before), log Z.

    ``unary`` is the score of "good" over "bad"; ``stay`` that of keeping the state.
    """
    order = np.argsort(-lines, kind="stable")
    starts = (np.cumsum(lines) - lines)[order]
    left = lines[order]
    n, longest = len(unary), int(left[0]) if len(left) else 0
    fwd = np.zeros((n, 2))  # log messages into bad, good
    bwd = np.zeros((n, 2))
    active = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")

    def pass_on(m: np.ndarray) -> np.ndarray:
        return np.stack([np.logaddexp(m[:, 0] + stay, m[:, 1]), np.logaddexp(m[:, 0], m[:, 1] + stay)], axis=1)

    emit = np.stack([np.zeros(n), unary], axis=1)
    for t in range(1, longest):
        at = starts[: active[t]] + t
        fwd[at] = pass_on(fwd[at - 1] + emit[at - 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        bwd[at] = pass_on(bwd[at + 1] + emit[at + 1])
    both = fwd + emit + bwd
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    same = np.zeros(n)
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(inner)
    left_in, right_in = fwd[at - 1] + emit[at - 1], emit[at] + bwd[at]
    same[at] = np.exp(np.logaddexp(left_in[:, 0] + right_in[:, 0], left_in[:, 1] + right_in[:, 1]) + stay - z[at])
    return good, same, float(z[np.cumsum(lines) - lines].sum()) if n else 0.0


def fit_chain(x: np.ndarray, y: np.ndarray, lines: np.ndarray, steps: int = 120, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the chain by gradient ascent (Adam) on the conditional log-likelihood."""
    rng_free = np.zeros(x.shape[1] + 1)
    m, v = rng_free.copy(), rng_free.copy()
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(lines) - lines] = False
    kept = (y[1:] == y[:-1]) & inner[1:]
    theta = rng_free
    for k in range(1, steps + 1):
        good, same, _ = marginals(x @ theta[:-1], theta[-1], lines)
        grad = np.append(x.T @ (y - good), kept.sum() - same.sum()) / max(len(x), 1) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression (a constant last) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


class Model:
    """A fitted chain and the scale that turns its document means into probabilities."""

    def __init__(self, weights: np.ndarray, stay: float, scale: np.ndarray):
        self.weights, self.stay, self.scale = weights, stay, scale

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, its length, and the number of lines of each text."""
        x, size, lines = line_features(texts)
        good, _, _ = marginals(with_neighbours(x, lines) @ self.weights, self.stay, lines)
        return good, size, lines

    def mean(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        good, size, lines = self.lines(texts)
        starts = np.cumsum(lines) - lines
        weight = size + 1.0
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregates(self.mean(texts)) @ self.scale[:-1] + self.scale[-1], -30, 30)))


def aggregates(mean: np.ndarray) -> np.ndarray:
    """The weighted mean of P(good), and the order of magnitude of what is bad."""
    return np.column_stack([mean, np.log(1.03 - mean)])


def fit(sample: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) pairs. Without labels of both kinds every score is that label (0.5 without any)."""
    texts, y = [t for t, _ in sample], np.array([int(v) for _, v in sample])
    if len(set(y.tolist())) < 2:
        width = line_features([""])[0].shape[1] * 3 + 1
        odds = (5.0 if y.any() else -5.0) if len(y) else 0.0
        return Model(np.zeros(width), 0.0, np.array([0.0, 0.0, odds]))
    x, size, lines = line_features(texts)
    full = with_neighbours(x, lines)
    doc = np.repeat(np.arange(len(texts)), lines)
    # long documents are cut into runs for fitting
    pos = np.arange(len(x)) - np.repeat(np.cumsum(lines) - lines, lines)
    cut = np.flatnonzero(pos % RUN == 0)
    runs = np.diff(np.append(cut, len(x)))
    target = y[doc].astype(float)
    weights, stay = fit_chain(full, target, runs)
    good, _, _ = marginals(full @ weights, stay, lines)
    starts = np.cumsum(lines) - lines
    worst = np.repeat(np.minimum.reduceat(good, starts), lines)
    target = np.where((y[doc] == 0) & (good > 0.5) & (good > worst), 1.0, target)
    weights, stay = fit_chain(full, target, runs)
    model = Model(weights, stay, np.zeros(3))
    model.scale = fit_logistic(aggregates(model.mean(texts)), y)
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    return fit(common.labelled_sample(docs, labels, "quality", per_label, max_chars, folds=5, held_out=0))


def scorer(model: Model):
    """Column function: text -> quality, 0 to 1. Null scores as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(s.tolist()))

    return score


def line_scorer(model: Model):
    """Column function: text -> P(good) of each of its lines."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            good, _, lines = model.lines(texts) if texts else (np.zeros(0), None, np.zeros(0, dtype=int))
            yield pd.Series(np.split(good, np.cumsum(lines)[:-1]), dtype=object)

    return score


def quality(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    common.bound_batches(docs.sparkSession)
    return scorer(model)(F.col(text_col))
