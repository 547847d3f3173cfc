"""Toxic documents, by a lexicon that also matches misspelled words.

The lexicon is learned from labelled documents: words and word beginnings
("stem*") that stand in many more toxic documents than others. It is kept as a
trie. Each distinct word of a block is made into a Levenshtein automaton
of distance 1 (two bit masks of reachable positions, without and with an
error; two swapped letters are one) and intersected with the trie; words that could not match by the
pigeonhole rule (with one error, one half of the term is intact, or the swap is in the
middle) are passed over. Runs of other characters than blanks are such words too where letters
stand with digits or symbols ("idi0t"), if their letters alone match nothing.

Every hit gets a context score from the words around it: quotation marks, words
that report or define ("said", "the word", ...) speak for a quotation,
addressing somebody speaks for abuse. Sums over a document's hits go into a
logistic regression.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_crf import fit_logistic

#: Bounds of the sample of labelled documents that lexicon and weights are fitted on.
SAMPLE_PER_LABEL = 3000
SAMPLE_CHARS = 6_000_000
#: At most so many terms, lengths of a term, and the shortest term that may be misspelled.
MAX_TERMS = 200
#: Texts whose words the fit holds at once when it scores its sample.
BATCH = 100
SHORTEST, LONGEST, FUZZY_FROM = 4, 10, 4
#: The shortest word beginning that may be misspelled (it meets more words by chance, which its weight tells).
FUZZY_OPEN_FROM = 4
#: A word near a term is no misspelling if this share of clean documents holds it.
HARMLESS_SHARE = 0.005
#: A misspelled term counts so much of a right one, less the oftener it is met by chance in clean
#: documents, half at this share of them.
FUZZY_SHARE, FUZZY_CHANCE = 0.8, 0.02
#: Words on each side of a hit that its context score looks at.
WINDOW = 8
#: A document is toxic from this score on.
TOXIC = 0.5
#: Numbers that describe a document.
FEATURES = 5

#: Words that report or define, and words that address somebody.
REPORTING = frozenset("said says wrote writes quote quoted quotes quoting called calls term word words slur insult means meaning defined definition "
                      "sagte schrieb zitat wort begriff dit écrit mot terme dijo escribió cita palabra término".split())
ADDRESSING = frozenset("you your you're yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted".split())
QUOTES = '"“”„«»‘’'

_WORDS = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[\"“”„«»‘’]")


def words_of(text: str | None) -> list[str]:
    """Words in lower case, and quotation marks."""
    return _WORDS.findall((text or "").lower())


#: What stands around a run of characters and not for a letter of it.
_ENDS = ".,;:!?()[]{}<>…'`" + QUOTES


def noisy_of(run: str) -> str | None:
    """A run of characters in lower case without punctuation around it, if letters stand in it with digits or symbols."""
    if run.isalpha():
        return None
    core = run.strip(_ENDS)
    return core if SHORTEST <= len(core) + 1 and not core.isalpha() and regex.search(r"\p{L}", core) and not _WORDS.fullmatch(core) else None


def noisy_words(text: str | None) -> list[str]:
    return [core for run in set((text or "").lower().split()) if (core := noisy_of(run))]


class Trie:
    """Terms as nested dicts; "" holds (term, open): an open term matches every word that begins with it.

    ``fuzzy`` has the weights of misspelled terms (those of right ones if not
    given), ``harmless`` words that aren't misspellings. With ``swaps``, two swapped neighbours are one error.
    """

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, float] | None = None, harmless: frozenset[str] = frozenset(), swaps: bool = False):
        self.swaps = swaps
        self.terms, self.fuzzy, self.harmless = terms, terms if fuzzy is None else fuzzy, harmless
        self.root: dict = {}
        self.whole = {t for t in terms if not t.endswith("*")}
        self.open = {t[:-1] for t in terms if t.endswith("*")}
        self.open_lengths = sorted({len(t) for t in self.open})
        # with one error, either the first or the second half of a term is intact
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.head_lengths: list[int] = []
        self.tail_at: list[tuple[int, int]] = []
        tail_at = set()
        for t in terms:
            stem, is_open = (t[:-1], True) if t.endswith("*") else (t, False)
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            if len(stem) >= (FUZZY_OPEN_FROM if is_open else FUZZY_FROM):
                node.setdefault("", []).append((t, is_open))
                h = len(stem) // 2
                self.heads.add(stem[:h])
                if swaps:
                    self.heads.add(stem[: h - 1] + stem[h] + stem[h - 1])
                self.tails.add(stem[h:])
                tail_at |= {(h + d, len(stem) - h) for d in (-1, 0, 1)}
        self.head_lengths = sorted({len(h) for h in self.heads})
        self.tail_at = sorted(tail_at)

    def exact(self, word: str) -> float:
        best = self.terms[word] if word in self.whole else 0.0
        for k in self.open_lengths:
            if k > len(word):
                break
            if word[:k] in self.open:
                best = max(best, self.terms[word[:k] + "*"])
        return best

    def may_be_near(self, word: str) -> bool:
        return any(word[:k] in self.heads for k in self.head_lengths) or any(word[a : a + k] in self.tails for a, k in self.tail_at)

    def near(self, word: str) -> float:
        """Largest weight of a misspelled term for a word; 0 if none or if the word is harmless."""
        if word in self.harmless:
            return 0.0
        return max([self.fuzzy[t] for t in self.near_terms(word)], default=0.0)

    def near_terms(self, word: str) -> set[str]:
        """The terms (long enough to be misspelled) within distance 1 of the word, or of its beginning if they are open.

        The automaton's state after some letters of a term: bit i of ``none``
        (of ``one``) says that the first i letters of the word can have been
        read without (with one) error, bit i of ``swap`` that the term's last letter is the word's
        letter after the next.
        """
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        full = (1 << len(word) + 1) - 1
        end = 1 << len(word)
        met = set()
        stack = [(self.root, 1, 2 & full, 0)]
        while stack:
            node, none, one, swap = stack.pop()
            for t, is_open in node.get("", ()):
                if (none | one) if is_open else (none | one) & end:
                    met.add(t)
            for c, child in node.items():
                if c:
                    m = mask.get(c, 0)
                    after_none = (none & m) << 1
                    after_one = ((one & m) << 1 | none | none << 1 | after_none << 1 | (swap & m) << 2) & full
                    after_swap = none & m >> 1 if self.swaps else 0
                    if after_none | after_one | after_swap:
                        stack.append((child, after_none, after_one, after_swap))
        return met


def hash_words(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


def learn_terms(sample: list[tuple[list[str], int]], max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Terms and their log-odds weights from (words, label) pairs, by likelihood ratio of document frequencies."""
    # copies of one text would pass its chance words off as terms: texts with the same least
    # three-word hash share one vote
    group = [(label, min((hash_words(words[i : i + 3]) for i in range(max(1, len(words) - 2))), default=0)) for words, label in sample]
    size = Counter(group)
    df: tuple[dict[str, float], ...] = (defaultdict(float), defaultdict(float))
    total = [0.0, 0.0]
    for label in (1, 0):  # of clean documents only what enough toxic ones hold is counted
        for (words, y), g in zip(sample, group):
            if y != label:
                continue
            seen: set[str] = set()
            for w in set(words):
                if len(w) >= SHORTEST:
                    seen.add(w)
                    seen.update(w[:k] + "*" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            vote = 1 / size[g]
            for t in seen if label else seen & df[1].keys():
                df[label][t] += vote
            total[label] += vote
        if label:
            df = (df[0], {t: a for t, a in df[1].items() if a >= 3})
    if not all(total):
        return {}
    odds: dict[str, float] = {}
    gain: dict[str, float] = {}
    for t, a in df[1].items():
        c = df[0].get(t, 0.0)
        p, q = (a + 0.5) / (total[1] + 1), (c + 0.5) / (total[0] + 1)
        if p < 4 * q:
            continue
        share = (a + c) / sum(total)
        g = 2 * (a * math.log(a / total[1] / share) + (c * math.log(c / total[0] / share) if c else 0))
        if g >= 15:
            odds[t], gain[t] = math.log(p / q), g
    chosen: dict[str, float] = {}
    for t in sorted(gain, key=lambda t: (-gain[t], t.endswith("*"), -len(t), t)):
        stem = t.rstrip("*")
        # what a chosen beginning already tells, and a beginning of a chosen term that tells no more
        if any(odds[t] < chosen.get(stem[:k] + "*", -9) + 0.7 for k in range(SHORTEST, len(stem) + 1)):
            continue
        if t.endswith("*") and any(u.startswith(stem) and gain[u] >= 0.95 * gain[t] for u in chosen):
            continue
        chosen[t] = odds[t]
        if len(chosen) >= max_terms:
            break
    return chosen


def learn_misspelling(terms: dict[str, float], clean: list[list[str]]) -> tuple[dict[str, float], frozenset[str]]:
    """Weights of misspelled terms, and words near a term that clean documents use."""
    trie = Trie(terms, swaps=True)
    held: Counter = Counter()
    near: dict[str, set[str]] = {}
    met: list[set[str]] = []
    for words in clean:
        here: set[str] = set()
        for w in set(words):
            found = near.get(w)
            if found is None:
                found = near[w] = trie.near_terms(w) if trie.may_be_near(w) and not trie.exact(w) else set()
            if found:
                here.add(w)
        held.update(here)
        met.append(here)
    n = max(1, len(clean))
    harmless = frozenset(w for w, k in held.items() if k >= HARMLESS_SHARE * n)
    # harmless words are passed over one by one: a term that they are near to loses little by them
    chance, rest = Counter(), Counter()
    for here in met:
        chance.update(set().union(*(near[w] for w in here)))
        rest.update(set().union(*(near[w] for w in here - harmless)))
    return {t: w * FUZZY_SHARE * (1 - chance[t] / n) / (1 + rest[t] / n / FUZZY_CHANCE) for t, w in terms.items()}, harmless


class Matcher:
    """Finds lexicon words in blocks of texts; forgets words once it knows too many."""

    KNOWN = 300_000

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, float] | None = None, harmless: frozenset[str] = frozenset()):
        self.trie = Trie(terms, fuzzy, harmless, swaps=True)
        self.hits: dict[str, tuple[float, bool]] = {}
        self.seen: set[str] = set()
        self.runs: dict[str, str] = {}
        self.seen_runs: set[str] = set()

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """Words of each text, all looked up; a run of characters that is a misspelled term only as a whole is one word."""
        lower = [(t or "").lower() for t in texts]
        words = [words_of(t) for t in lower]
        self.look_up(set().union(*words))
        runs = [set(t.split()) for t in lower]
        if len(self.seen_runs) > self.KNOWN:
            self.runs, self.seen_runs = {}, set()
        new = set().union(*runs) - self.seen_runs
        noisy = {run: core for run in new if (core := noisy_of(run))}
        parts = {run: words_of(core) for run, core in noisy.items()}
        self.look_up({w for found in parts.values() for w in found})
        for run, core in noisy.items():
            if self.hits.keys().isdisjoint(parts[run]) and self.trie.may_be_near(core) and self.trie.near(core):
                self.runs[run] = core
        self.seen_runs |= new
        for k, held in enumerate(runs):
            if not self.runs.keys().isdisjoint(held):
                words[k] = [w for run in lower[k].split() for w in self._pieces(run)]
        # forgotten words are looked up again
        self.look_up({self.runs[run] for held in runs for run in held if run in self.runs})
        return words

    def _pieces(self, run: str) -> list[str]:
        core = self.runs.get(run)
        if core is None:
            return words_of(run)
        at = run.index(core)
        return [c for c in run[:at] if c in QUOTES] + [core] + [c for c in run[at + len(core) :] if c in QUOTES]

    def look_up(self, words: set[str]) -> None:
        if len(self.seen) > self.KNOWN:
            self.hits, self.seen = {}, set()
        trie = self.trie
        for w in words - self.seen:
            weight = trie.exact(w)
            if weight:
                self.hits[w] = (weight, True)
            elif len(w) >= FUZZY_FROM - 1 and trie.may_be_near(w) and (weight := trie.near(w)):
                self.hits[w] = (weight, False)
        self.seen |= words

    def spans(self, words: list[str]) -> list[tuple[int, str, float, bool, float]]:
        """(position, word, weight, spelled right, context) of each hit; context from 0 (quotation) to 1 (abuse)."""
        if self.hits.keys().isdisjoint(words):
            return []
        quotes = np.cumsum([w in QUOTES for w in words])
        found = []
        for i, w in enumerate(words):
            if w in self.hits:
                around = words[max(0, i - WINDOW) : i + WINDOW + 1]
                quoted = 2 * (quotes[i] % 2 == 1 and quotes[-1] > quotes[i]) + sum(x in REPORTING for x in around)
                addressed = sum(x in ADDRESSING for x in around)
                context = 1 / (1 + math.exp(min(20, 1.5 * quoted - addressed - 2)))
                weight, right = self.hits[w]
                found.append((i, w, weight, right, context))
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        split = self.split(texts)
        out = np.zeros((len(texts), FEATURES))
        for row, words in zip(out, split):
            found = self.spans(words)
            if found:
                row[:] = (
                    math.log1p(sum(weight * context for _, _, weight, _, context in found)),
                    math.log1p(len({w for _, w, *_ in found})),
                    max(weight * context for _, _, weight, _, context in found) / 4,
                    math.sqrt(sum(context for *_, context in found) / len(words)),
                    math.log1p(len(words)) / 10,
                )
        return out


class Model:
    """A lexicon, its misspellings and the weights of the regression."""

    def __init__(self, terms: dict[str, float], weights: np.ndarray, fuzzy: dict[str, float] | None = None, harmless: frozenset[str] = frozenset()):
        self.terms, self.weights, self.fuzzy, self.harmless = terms, weights, fuzzy, harmless

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.fuzzy, self.harmless)

    def score(self, matcher: Matcher, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(matcher.features(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(sample: list[tuple[str, int]]) -> Model:
    """Fit lexicon and weights on (text, label) pairs.

    The weights are fitted on hits of lexicons learned without the document at
    hand (two halves, each scored by the other's lexicon). Without labels of
    both kinds nothing is toxic unless every label is.
    """
    y = np.array([int(v) for _, v in sample])
    if len(set(y.tolist())) < 2:
        return Model({}, np.array([0.0] * FEATURES + [5.0 if len(y) and y.all() else -5.0]))
    texts = [t for t, _ in sample]
    words = [list(map(sys.intern, words_of(t))) for t in texts]  # one copy of each word
    noisy = [[] if label else noisy_words(t) for t, label in zip(texts, y)]
    half = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        half[at] = np.arange(len(at)) % 2
    x = np.zeros((len(y), FEATURES))
    for k in (0, 1):
        other = [(words[i], int(y[i]), noisy[i]) for i in np.flatnonzero(half != k)]
        at = np.flatnonzero(half == k)
        matcher = Matcher(*_lexicon(other))
        for part in np.array_split(at, max(1, len(at) // BATCH)):  # the words of a batch at a time
            x[part] = matcher.features([texts[i] for i in part])
    terms, fuzzy, harmless = _lexicon([(w, int(v), z) for w, v, z in zip(words, y, noisy)])
    return Model(terms, fit_logistic(x, y, l2=0.3), fuzzy, harmless)


def _lexicon(sample: list[tuple[list[str], int, list[str]]]) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    terms = learn_terms([(w, label) for w, label, _ in sample])
    return terms, *learn_misspelling(terms, [w + noisy for w, label, noisy in sample if not label])


def fit_documents(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_chars: int = SAMPLE_CHARS) -> Model:
    """Fit, in one task, on a bounded sample of the labelled documents outside the held-out fold (crc32 of the id, modulo 5, is 0)."""

    def parts(sample: list[tuple[str, int]]) -> tuple:
        model = fit(sample)
        return model.terms, model.weights, model.fuzzy, model.harmless

    rows = common.sample_rows(docs, labels, "toxic", per_label, max_chars, folds=5, held_out=0)
    return Model(*common.fit_in_task(rows, parts))


def scorer(model: Model):
    """Column function: text -> toxicity, 0 to 1. Null scores as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for s in batches:
            yield pd.Series(model.score(matcher, s.tolist()))

    return score


def span_finder(model: Model):
    """Column function: text -> its hits (position among the words, word, weight, spelled right, context)."""

    @F.pandas_udf("array<struct<word_index:int,word:string,weight:double,exact:boolean,context:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for s in batches:
            split = matcher.split(s.tolist())
            names = ("word_index", "word", "weight", "exact", "context")
            yield pd.Series([[dict(zip(names, h)) for h in matcher.spans(w)] for w in split], dtype=object)

    return find


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    common.bound_batches(docs.sparkSession)
    return scorer(model)(F.col(text_col))
