"""Number of unigram tokens of a text, by a Viterbi search that only counts.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at
each character. Dynamic programming carries two numbers for each position: the
score of the best segmentation up to it, and how many tokens that has. Candidates
come in order of their begin and replace the best one only when strictly better,
so of equal scores the one with the longest last piece stays, as in the public
unigram tokenizers. A character that no piece covers alone may be an unknown
one, 10 below the least score; it counts as one token for each of its UTF-8 bytes
where the vocabulary has pieces for bytes, else unknown neighbours are one token.

Spaces become the vocabulary's space mark, and the text gets one in front. If no piece
holds the mark after another character, a text may be cut before each run of marks;
every distinct stretch of a block is then searched once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: How far below the least score an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Stretches of text whose counts a task keeps between blocks.
CACHE = 300_000


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces and scores, has byte pieces) of a sentencepiece file; control and unknown pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte = [i for i in ids if sp.is_byte(i)]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not sp.is_byte(i)], len(byte) == 256


class Counter:
    """Counts tokens; keeps a bounded number of counted stretches."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cut = byte_fallback and not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.together = {p[k : k + 2] for p, _ in pieces for k in range(len(p) - 1)}
        self.known: dict[str, tuple[int, float]] = {}
        self.ends: dict[str, tuple[int, float]] = {}  # single characters that no piece joins to what is before them

    def viterbi(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation of a normalised text."""
        n = len(text)
        least = self.unknown
        # best segmentation up to each position; unset positions are settled when reached
        score: list = [0.0] + [None] * n
        count = [0] * (n + 1)
        lost = [False] * (n + 1)
        alone = [False] * (n + 1)  # some piece covers the character before the position alone
        settled = 0

        def settle(upto: int) -> None:
            """An unknown character where no piece covers it alone, if that is better."""
            for at in range(settled + 1, upto + 1):
                if not alone[at] and (score[at] is None or score[at - 1] + least > score[at]):
                    score[at], lost[at] = score[at - 1] + least, True
                    count[at] = count[at - 1] + (len(text[at - 1].encode("utf-8", "replace")) if self.byte_fallback else not lost[at - 1])

        # pieces come in order of their end, the longest first
        for end, (size, s) in self.automaton.iter(text):
            at = end + 1
            if at - settled > 1:
                settle(end)
                settled = end
            total = score[at - size] + s
            best = score[at]
            if best is None or total > best:
                score[at], count[at] = total, count[at - size] + 1
            if size == 1:
                alone[at] = True
                settled = at  # the shortest piece is the last one of its end
        if settled < n:
            settle(n)
        return count[n], score[n]

    def stretch(self, text: str) -> tuple[int, float]:
        """A stretch, cut before its last characters where no piece holds them and their neighbour together."""
        tokens, score = 0, 0.0
        while len(text) > 2 and text[-2:] not in self.together:
            n, s = self.last(text[-1])
            tokens, score, text = tokens + n, score + s, text[:-1]
        known = self.known.get(text)
        if known is None:
            known = self.known[text] = self.viterbi(text)
        return tokens + known[0], score + known[1]

    def last(self, char: str) -> tuple[int, float]:
        known = self.ends.get(char)
        if known is None:
            known = self.ends[char] = self.viterbi(char)
        return known

    def block(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """(tokens, score) of each text; (0, 0) for null or empty."""
        if not self.cut:
            return [self.viterbi(MARK + t.replace(" ", MARK)) if t else (0, 0.0) for t in texts]
        parts: list[list[str]] = []
        for t in texts:
            if not t:
                parts.append([])
            elif t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t:
                parts.append(t.split(" "))  # each one after a single mark
            else:
                # the key of any other stretch begins with its marks
                parts.append(self.stretches(MARK + t.replace(" ", MARK)))
        if len(self.known) > CACHE:
            self.known = {}
        counted = {p: self.stretch(p if p.startswith(MARK) else MARK + p) for p in set().union(*parts)}
        out = []
        for ps in parts:
            found = list(map(counted.__getitem__, ps))
            out.append((sum(c for c, _ in found), sum(s for _, s in found)))
        return out


def counter(pieces: list[tuple[str, float]], byte_fallback: bool):
    """Column function: text -> (n_tokens, best_score)."""

    @F.pandas_udf("n_tokens long, best_score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Counter(pieces, byte_fallback)
        for s in batches:
            yield pd.DataFrame(c.block(s.tolist()), columns=["n_tokens", "best_score"]).astype({"n_tokens": "int64", "best_score": "float64"})

    return count


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool, text_col: str = "text") -> Column:
    """(n_tokens, best_score) of each text. Null and empty texts have no tokens and score 0."""
    common.bound_batches(docs.sparkSession)
    return counter(pieces, byte_fallback)(F.col(text_col))
