"""Token counts of a unigram tokenizer by count-only Viterbi."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import map_texts

#: What the tokenizer takes off the lowest score of the vocabulary for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Stands for a blank, in front of each pre-token.
BLANK = "\u2581"
#: Pre-tokens remembered in a worker, and the longest one remembered.
MAX_UNITS = 250_000
MAX_UNIT_CHARS = 48
#: Characters of a pre-token from which its tables are packed.
LONG_UNIT = 4096
_NONE = float("-inf")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, the unknown piece first; no control or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    skip = [sp.IsControl(i) or sp.IsByte(i) or sp.IsUnused(i) or sp.IsUnknown(i) for i in range(len(sp))]
    return [(sp.IdToPiece(sp.unk_id()), 0.0)] + [(sp.IdToPiece(i), sp.GetScore(i)) for i in range(len(sp)) if not skip[i]]


class Counter:
    """Numbers of tokens that a unigram tokenizer gives, unknown characters in a row fused into one.

    Aho-Corasick finds every piece that ends at a character, longest first. The best score up to
    there is the best of score so far plus piece score; a later candidate must be greater to win, so
    of equal scores the one with the longest last piece stays: the tokenizer tries starts from left
    to right and also keeps the first. Each end carries the score, the count and whether the last
    token is unknown; no path is kept.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self._pieces = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self._pieces.add_word(piece, (len(piece), float(score), i == 0))
        self._pieces.make_automaton()
        self._single = {p for p, _ in vocabulary if len(p) == 1}
        self._unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of one pre-token."""
        n = len(text)
        if n < LONG_UNIT:
            score, count, unknown = [_NONE] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        else:  # packed: 17 bytes a character
            score, count, unknown = array("d", [_NONE]) * (n + 1), array("q", [0]) * (n + 1), bytearray(n + 1)
        score[0] = 0.0
        ready = 0  # ends up to here have seen all their candidates

        def settle(upto: int) -> None:
            nonlocal ready
            while ready < upto:
                ready += 1
                if text[ready - 1] in self._single:
                    continue
                new = score[ready - 1] + self._unknown
                if new > score[ready]:
                    score[ready] = new
                    count[ready] = count[ready - 1] + (not unknown[ready - 1])
                    unknown[ready] = True

        for last, (size, worth, is_unknown) in self._pieces.iter(text):
            end = last + 1
            if ready < last:
                settle(last)
            start = end - size
            new = score[start] + worth
            if new > score[end]:
                score[end] = new
                count[end] = count[start] + (not (is_unknown and unknown[start]))
                unknown[end] = is_unknown
        settle(n)
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for a null or empty one."""
        if not text:
            return 0
        known = self._known
        marked = text.replace(" ", BLANK)
        units = marked.split(BLANK)
        if not units[0]:
            del units[0]
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            pass
        for u in set(units).difference(known):
            known[u] = self.unit(BLANK + u)
        total = sum(map(known.__getitem__, units))
        for u in units:
            if len(u) > MAX_UNIT_CHARS:
                known.pop(u, None)
        if len(known) > MAX_UNITS:
            known.clear()
        return total


def _counter(path: str) -> Callable:
    def make():
        counter = Counter(read_vocabulary(path))
        return lambda texts: {"n_tokens": [counter.text(t) for t in texts]}

    return make


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): tokens of every whole text, blanks marked and pre-tokens split at them.

    A null or empty text has 0 tokens. Repeated rows and null ids are counted like any others; other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    return map_texts(docs, [F.col(id_col).alias("doc_id")], F.col(text_col), _counter(vocabulary_path), [T.StructField("n_tokens", T.LongType())])
