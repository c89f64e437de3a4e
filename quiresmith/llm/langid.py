"""Language identification of mixed-language text: script candidates, then Viterbi over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import map_texts, sample_rows

#: Labelled documents that the model is fitted on at most (a random sample of them, whole texts).
MAX_TRAIN_DOCS = 20_000
#: Languages that a model may hold; more are an error, for the model is held in every worker.
MAX_LANGUAGES = 400
#: Log-score that a change of language between two words costs.
SWITCH_PENALTY = 8.0
#: Share of a language's words in a script from which it is a candidate for words in that script.
SCRIPT_SHARE = 0.005
_BUCKETS = 1 << 16
_PIECE = 1_000_000
#: Log-score below the best one that a word gives a language at least, so that no name decides alone.
_FLOOR = -20.0

# First and last code points of scripts (Unicode block ranges), each with its number.
_SCRIPTS = (
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1), (0xFF21, 0xFF5A, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3), (0x2DE0, 0x2DFF, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x08A0, 0x08FF, 6), (0xFB50, 0xFDFF, 6),  # Arabic
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0A00, 0x0DFF, 9),  # other Brahmic scripts of India
    (0x0E00, 0x0EFF, 10),  # Thai, Lao
    (0x10A0, 0x10FF, 11),  # Georgian
    (0x1100, 0x11FF, 12), (0x3130, 0x318F, 12), (0xAC00, 0xD7AF, 12),  # Hangul
    (0x3040, 0x30FF, 13),  # Kana
    (0x3400, 0x4DBF, 14), (0x4E00, 0x9FFF, 14), (0xF900, 0xFAFF, 14), (0x20000, 0x2FFFF, 14),  # Han
)
_N_SCRIPTS = 16


class _Tables:
    """Code point tables, made once a process."""

    letter: np.ndarray | None = None
    script: np.ndarray

    @classmethod
    def get(cls) -> type[_Tables]:
        if cls.letter is None:
            script = np.full(0x110000, 15, np.uint8)
            for a, b, k in _SCRIPTS:
                script[a : b + 1] = k
            cls.script = script
            cls.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls


def _pieces(text: str) -> list[str]:
    """The text in parts of about _PIECE characters, cut before a character that is no letter: never in a word."""
    out, at = [], 0
    while len(text) - at > _PIECE:
        cut = at + _PIECE
        while cut > at and text[cut].isalpha():
            cut -= 1
        if cut == at:  # one word as long as a part: go on to its end
            cut = at + _PIECE
            while cut < len(text) and text[cut].isalpha():
                cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out or [text]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the joined texts: bucket of each letter's trigram, first letter, script and text of each word.

    Words are runs of letters, lower-cased. A trigram is a letter and its neighbours in the word.
    """
    tables = _Tables.get()
    lower = [t.lower() for t in texts]
    c = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = tables.letter[c]
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    before = np.where((at > 0) & is_letter[at - 1], c[at - 1], 0).astype(np.uint32)
    after_at = np.minimum(at + 1, len(c) - 1)
    after = np.where((at + 1 < len(c)) & is_letter[after_at], c[after_at], 0).astype(np.uint32)
    mixed = before * np.uint32(2654435761) ^ (c[at] * np.uint32(2246822519) + (after * np.uint32(3266489917) >> np.uint32(7)))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    bucket = mixed >> np.uint32(16)
    first = np.flatnonzero(before == 0)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return bucket, first, tables.script[c[at[first]]], np.searchsorted(ends, at[first], "right")


@dataclass
class Model:
    """langs in sorted order; scores[k, bucket]: log-probability of a letter's trigram in language k."""

    langs: list[str]
    scores: np.ndarray
    allowed: np.ndarray  # [script, language]
    penalty: float

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of each word in each language (0 for the best, else below), its letters, its text, and
        whether a language is known that writes its script."""
        parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
        scores, letters, owner, known, group, size = [], [], [], [], [], 0
        for n, (i, p) in enumerate(parts):
            group.append((i, p))
            size += len(p)
            if size < _PIECE and n + 1 < len(parts):
                continue
            bucket, first, script, text = _words([p for _, p in group])
            if len(first):
                s = np.stack([np.add.reduceat(row[bucket], first) for row in self.scores], axis=1)
                s -= s.max(axis=1, keepdims=True)
                np.maximum(s, _FLOOR, out=s)
                ok = self.allowed[script]
                s = np.where(ok, s, 2 * _FLOOR).astype(np.float32)
                known.append(ok.any(axis=1))
                s[~known[-1]] = 0  # no language writes so: no evidence
                scores.append(s)
                letters.append(np.diff(np.append(first, len(bucket))))
                owner.append(np.array([i for i, _ in group])[text])
            group, size = [], 0
        if not scores:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(scores), np.concatenate(letters), np.concatenate(owner), np.concatenate(known)

    def label(self, texts: list[str | None]) -> dict[str, list]:
        """Per text: its language, that language's share of the letters, and the labelled spans."""
        given = [t or "" for t in texts]
        n = len(given)
        out: dict[str, list] = {"lang_pred": ["und"] * n, "score": [0.0] * n, "spans": [[] for _ in range(n)]}
        if not self.langs:
            return out
        s, letters, owner, known = self.word_scores(given)
        lengths = np.bincount(owner, minlength=n)
        path = viterbi(s, lengths, self.penalty)
        share = np.zeros((n, len(self.langs)))
        np.add.at(share, (owner[known], path[known]), letters[known])
        total = np.bincount(owner, weights=letters, minlength=n)
        best = share.argmax(axis=1)
        path = np.where(known, path, -1)
        starts = np.cumsum(lengths) - lengths
        turn = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1]))) if len(path) else []
        stop = np.append(turn[1:], len(path)) if len(path) else []
        for a, b in zip(turn, stop, strict=True):
            i = owner[a]
            out["spans"][i].append({"first_word": int(a - starts[i]), "last_word": int(b - 1 - starts[i]), "lang": self.langs[path[a]] if path[a] >= 0 else "und"})
        for i in np.flatnonzero(total):
            out["lang_pred"][i] = self.langs[best[i]]
            out["score"][i] = float(share[i, best[i]] / total[i])
        return out


def viterbi(s: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, for all texts at once; ties go to the earlier label and to staying.

    s[word, label] holds the texts' words one text after the other. A step handles the t-th word of
    every text that has one, longest texts first.
    """
    path = np.zeros(len(s), np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    size = size[size > 0]
    if not len(size):
        return path
    start = (np.cumsum(lengths) - lengths)[order][: len(size)]
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
    stay = np.ones(s.shape, bool)
    source = np.zeros(len(s), np.int16)
    value = s[start].copy()
    for t in range(1, size[0]):
        a = alive[t]
        at = start[:a] + t
        v = value[:a]
        source[at] = v.argmax(axis=1)
        move = v.max(axis=1, keepdims=True) - penalty
        stay[at] = v >= move
        value[:a] = np.maximum(v, move) + s[at]
    state = value.argmax(axis=1)
    for t in range(size[0] - 1, 0, -1):
        a = alive[t]
        at = start[:a] + t
        now = state[:a]
        path[at] = now
        state[:a] = np.where(stay[at, now], now, source[at])
    path[start] = state
    return path


def _count(texts: list[str], langs: list[str]) -> Counter:
    """Occurrences by (language, key): a trigram bucket, or _BUCKETS + script for words."""
    out: Counter = Counter()
    for lang in sorted(set(langs)):
        counts = np.zeros(_BUCKETS + _N_SCRIPTS, np.int64)
        for part in (p for t, g in zip(texts, langs, strict=True) if g == lang for p in _pieces(t)):
            bucket, first, script, _ = _words([part])
            counts[:_BUCKETS] += np.bincount(bucket, minlength=_BUCKETS)
            counts[_BUCKETS:] += np.bincount(script, minlength=_N_SCRIPTS)
        out.update({(lang, int(k)): int(counts[k]) for k in np.flatnonzero(counts)})
    return out


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
    most: int = MAX_TRAIN_DOCS, penalty: float = SWITCH_PENALTY,
) -> Model:
    """Fit on rows with a text and a language; counts are summed in Spark, the driver gets the sums.

    The sample of at most about ``most`` rows is chosen by the hash of the key column. Labels that name
    more than MAX_LANGUAGES languages raise a ValueError: none is left out silently.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key")
    )
    rows = sample_rows(rows, most, F.col("key"), seed=11).select("text", "lang").where("text IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for b in batches:
            total += _count(b.column(0).to_pylist(), b.column(1).to_pylist())
        keys = list(total)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([k[0] for k in keys], pa.string()), "key": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([total[k] for k in keys], pa.int64())}
        )

    sums = rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = sums.where(F.col("key") >= _BUCKETS).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang")
    langs = sorted(r.lang for r in words.limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"labels name more than {MAX_LANGUAGES} languages")
    at = {g: i for i, g in enumerate(langs)}
    counts = np.zeros((len(langs), _BUCKETS + _N_SCRIPTS))
    for r in sums.where(F.col("lang").isin(langs)).toLocalIterator() if langs else ():
        counts[at[r.lang], r.key] = r.n
    grams, scripts = counts[:, :_BUCKETS] + 0.1, counts[:, _BUCKETS:]
    scores = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32) if langs else grams.astype(np.float32)
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, scores, (share >= SCRIPT_SHARE).T.copy(), penalty)


SPANS = T.ArrayType(
    T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("lang", T.StringType())])
)

RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]


def _labeller(model: Model) -> Callable:
    return lambda: model.label


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): every whole text labelled word by word.

    A word is a run of letters; its candidates are the languages that write its script. Viterbi
    finds the labelling of the words with the best sum of scores less SWITCH_PENALTY per change of
    language; spans lists its runs by word number from 0. lang_pred is the language with the most
    letters (ties: the first by name), score its share of all letters. Words in a script that no
    language writes are evidence for none: their spans are ``und`` and count for no language, so a
    text of nothing else has the score 0 (and, as it has letters, the first language by name).

    Null texts, texts without a letter, and all texts where nothing could be learned give ``und``, 0
    and no span. Repeated rows and rows with a null id are labelled like any others; other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    return map_texts(docs, [F.col(id_col).alias("doc_id")], F.col(text_col), _labeller(model), RESULT)


def held_out(id_col: str = "doc_id"):
    """True for one document in five, which the model must not learn from; also where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
