"""Mixing to target weights with soft membership: posteriors by a classifier, rates by least squares."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import Shelf, hash01, map_texts, sample_rows

#: Labelled documents that the classifier is fitted on at most (a random sample, whole texts).
MAX_TRAIN_DOCS = 20_000
MAX_ROUNDS = 30
#: Largest difference of an expected share from its target at which the descent stops.
TOLERANCE = 5e-4
#: Added to the posteriors' second moments, so that a domain that hardly any document belongs to is
#: missed rather than chased by rates far from 1.
RIDGE = 1e-3
_BITS = 15
_BUCKETS = 1 << _BITS
_PIECE = 1_000_000
_PLACES = np.random.default_rng(1).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_buckets(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every word, and the number of words of every text.

    Words are runs of characters other than space and U+0009-U+000D.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buckets, counts = [], np.zeros(len(data), np.int64)
    for i, whole in enumerate(data):
        if len(whole) > _PIECE:  # long texts alone, in parts cut at a blank
            at = 0
            while at < len(whole):
                cut = whole.rfind(b" ", at, at + _PIECE) if len(whole) - at > _PIECE else len(whole)
                cut = len(whole) if cut <= at else cut
                b, n = _hash([whole[at:cut]])
                buckets.append(b)
                counts[i] += n[0]
                at = cut
            continue
        buckets.append(i)  # a place for a short text
    out, group = [], []

    def flush():
        if group:
            b, n = _hash([data[i] for i in group])
            counts[group] = n
            out.append(b)
            group.clear()

    size = 0
    for x in buckets:
        if isinstance(x, int):
            group.append(x)
            size += len(data[x])
            if size > _PIECE:
                flush()
                size = 0
        else:
            flush()
            size = 0
            out.append(x)
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.int64), counts


def _hash(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[raw]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.append(0, np.searchsorted(first, ends, "left")))
    if not len(first):
        return np.zeros(0, np.int64), n
    inside = np.flatnonzero(~blank)
    word = np.cumsum(~blank & np.append(True, blank[:-1]))[inside] - 1
    place = (inside - first[word]) & 63
    mixed = np.add.reduceat(_PLACES[place] * (raw[inside].astype(np.uint64) + np.uint64(1)), np.searchsorted(inside, first))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - _BITS)).astype(np.int64), n


@dataclass
class Classifier:
    """Posterior of each domain: softmax of a bias and a linear map of the text's mean word log-ratios."""

    domains: list[str]
    ratios: np.ndarray  # [domain, bucket]
    weight: np.ndarray  # [domain, domain]
    bias: np.ndarray

    def means(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        bucket, n = word_buckets(texts)
        out = np.zeros((len(n), len(self.domains)))
        some = np.flatnonzero(n)
        if len(some):
            start = (np.cumsum(n) - n)[some]
            for k, row in enumerate(self.ratios):
                out[some, k] = np.add.reduceat(row[bucket], start) / n[some]
        return out, n

    def posteriors(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        z, n = self.means(texts)
        return _softmax(z @ self.weight.T + self.bias), n


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True, initial=-1e300))
    return x / x.sum(axis=1, keepdims=True)


def fit_classifier(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN_DOCS
) -> Classifier:
    """Fit on documents that ``labelled`` (doc_id, domain) names; null domains and ids are ignored.

    The sample of at most about ``most`` labelled ids is so small that it is broadcast. Half of its
    documents give the word log-ratios (counted in Spark), the other half calibrates them, so that
    posteriors are soft where words do not tell.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    marked = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", "domain")
    marked = sample_rows(marked, most, F.col("doc_id"), seed=5).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = shelf.put(texts.join(F.broadcast(marked), "doc_id").withColumn("fit", hash01(F.col("doc_id"), seed=6) < 0.5))

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            domains = np.array(b.column(0).to_pylist(), object)
            given = b.column(1).to_pylist()
            for d in set(domains):
                bucket, _ = word_buckets([given[i] for i in np.flatnonzero(domains == d)])
                total[d] = total.get(d, 0) + np.bincount(bucket, minlength=_BUCKETS)
        keys = [(d, int(k), int(c[k])) for d, c in total.items() for k in np.flatnonzero(c)]
        yield pa.RecordBatch.from_pydict(
            {"domain": pa.array([k[0] for k in keys], pa.string()), "key": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([k[2] for k in keys], pa.int64())}
        )

    sums = rows.where("fit").select("domain", "text").mapInArrow(count, "domain string, key long, n long").groupBy("domain", "key").agg(F.sum("n").alias("n"))
    domains = sorted(r.domain for r in marked.select("domain").distinct().collect())
    at = {d: i for i, d in enumerate(domains)}
    counts = np.full((len(domains), _BUCKETS), 0.2)
    for r in sums.toLocalIterator():
        counts[at[r.domain], r.key] += r.n
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    k = len(domains)
    model = Classifier(domains, logs - logs.mean(axis=0, keepdims=True) if k else logs, np.eye(k), np.zeros(k))
    if not k:
        return model

    def mean(batches):
        import pyarrow as pa

        for b in batches:
            z, _ = model.means(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(z), pa.list_(pa.float64()))], names=["domain", "z"])

    held = rows.where("NOT fit").select("domain", "text").mapInArrow(mean, "domain string, z array<double>").collect()
    held.sort(key=lambda r: (r.domain, r.z))
    if held:
        _calibrate(model, np.array([r.z for r in held]), np.array([at[r.domain] for r in held]))
    return model


def _calibrate(model: Classifier, z: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-4) -> None:
    """Multinomial logistic regression on the mean log-ratios, by gradient descent on scaled inputs."""
    k = len(model.domains)
    middle, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-9)
    x = np.column_stack([(z - middle) / scale, np.ones(len(z))])
    w = np.zeros((k, k + 1))
    w[:, -1] = np.log(np.bincount(y, minlength=k) + 1)
    want = np.eye(k)[y]
    moved = w.copy()
    for step in range(steps):
        g = (_softmax(x @ moved.T) - want).T @ x / len(x) + decay * moved
        new = moved - 1.0 * g
        moved = new + step / (step + 3) * (new - w)
        w = new
    model.weight = w[:, :-1] / scale
    model.bias = w[:, -1] - model.weight @ middle


@dataclass
class Rates:
    """Document rates as a function of the posterior alone: the descent's steps, replayed.

    Every document starts at rate 1. Step s subtracts the inner product of its posterior with
    ``steps[s]`` from the point that momentum leads to, and projects onto [0, most], or if that is None
    onto the nonnegative rates; momentum starts anew after the steps in ``restarts``. ``shares`` are the expected shares that the descent ended with, ``gap``
    the largest difference of one from its target.
    """

    domains: list[str]
    most: float | None = None
    steps: list[np.ndarray] = field(default_factory=list)
    restarts: set[int] = field(default_factory=set)
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gap: float = 0.0

    def of(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """The rates, or with ``ahead`` the point at which the next gradient is taken."""
        r = y = np.ones(len(p))
        t = 0
        for i, s in enumerate(self.steps):
            new = np.clip(y - p @ s, 0.0, self.most)
            t = 0 if i in self.restarts else t + 1
            y = new + max(0, t - 1) / (t + 2) * (new - r)
            r = new
        return y if ahead else r


def fit_rates(
    table: DataFrame, domains: Sequence[str], targets: Mapping[str, float], rounds: int = MAX_ROUNDS, most: float | None = None
) -> Rates:
    """Nonnegative rates (of at most ``most``, if given) whose expected token shares per domain come as near to ``targets`` as can be.

    Minimises (E(r)/B - w)' A^-1 (E(r)/B - w), where E(r) sums rate * tokens * posterior over all
    documents, B is the token total, w the targets and A the token-weighted second moment of the
    posteriors (plus a small ridge). In the token-weighted metric the gradient of a document is its
    posterior times A^-1 (E/B - w), with Lipschitz constant 1, so projected steps of 1 with momentum
    descend. Each round is one pass over (tokens, posterior) that returns one short row of sums.
    """
    rates = Rates(list(domains), most)
    k = len(rates.domains)
    w = np.array([float(targets.get(d, 0.0)) for d in rates.domains])
    if not k or w.sum() <= 0:
        return rates
    w /= w.sum()

    def sums(ahead: bool) -> tuple[float, np.ndarray, np.ndarray]:
        moments = not rates.steps

        def run(batches):
            import pyarrow as pa

            total, e, a = 0.0, np.zeros(k), np.zeros((k, k))
            for b in batches:
                t = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += t.sum()
                e += (t * rates.of(p, ahead)) @ p
                if moments:
                    a += (p * t[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([[total, *e, *a.ravel()]], pa.list_(pa.float64()))], names=["x"])

        cols = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(1 + k + k * k)]
        row = table.select("tokens", "posterior").mapInArrow(run, "x array<double>").agg(*cols).first()
        got = np.array([x or 0.0 for x in row])
        return got[0], got[1 : 1 + k], got[1 + k :].reshape(k, k)

    total, e, a = sums(ahead=True)
    if not total:
        return rates
    inverse = np.linalg.inv(a / total + RIDGE * np.eye(k))
    last, worth = np.full(k, np.inf), np.inf
    for _ in range(rounds):
        gap = e / total - w
        if np.abs(gap).max() < TOLERANCE or np.abs(gap - last).max() < TOLERANCE / 100:
            break
        now = gap @ inverse @ gap
        if now > worth and len(rates.steps) - 1 not in rates.restarts:  # momentum led uphill
            rates.restarts.add(len(rates.steps) - 1)
            worth = np.inf
        else:
            last, worth = gap, now
            rates.steps.append(inverse @ gap)
        e = sums(ahead=True)[1]
    rates.shares = sums(ahead=False)[1] / total
    rates.gap = float(np.abs(rates.shares - w).max())
    return rates


def _poster(model: Classifier, rates: Rates | None) -> Callable:
    def make():
        def run(texts):
            p, n = model.posteriors(texts)
            out = {"tokens": list(map(int, n)), "posterior": p.tolist()}
            return out if rates is None else out | {"rate": rates.of(p).tolist()}

        return run

    return make


def posteriors(docs: DataFrame, model: Classifier, keep: Sequence[Column], text_col: str = "text", rates: Rates | None = None) -> DataFrame:
    """``keep`` columns, tokens (words of the whole text), posterior (of model.domains, in order), and with
    ``rates`` the rate of each row."""
    fields = [T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]
    if rates is not None:
        fields.append(T.StructField("rate", T.DoubleType()))
    return map_texts(docs, keep, F.col(text_col), _poster(model, rates), fields)


def rated(table: DataFrame, rates: Rates) -> DataFrame:
    """A table of (doc_id, tokens, posterior) with the rate of each row."""
    k = len(rates.domains)
    schema = T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates.of(p), pa.float64())], names=schema.names)

    return table.mapInArrow(run, schema)


#: Target token shares of the label domains.
TARGETS = {"clean": 0.87, "low": 0.04, "toxic": 0.09}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic): toxic, else low quality, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").alias("doc_id"), domain.alias("domain"))


def copies(rate: Column, *by: Column) -> Column:
    """How often a document enters the mix: its rate, rounded up or down by chance, by the hash of ``by``."""
    return (F.floor(rate) + (hash01(*by, seed=13) < rate - F.floor(rate)).cast("int")).cast("int")


def mix(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    rounds: int = MAX_ROUNDS, most: float | None = None,
) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies, gap) for every row of ``docs``.

    ``labelled`` (doc_id, domain) names domains of some documents; the classifier fitted on them
    gives every document a posterior over the domains; rates make the expected token totals of the
    domains match ``targets`` (shares; they are scaled to sum to 1, domains without one get 0). gap, the
    same in all rows, tells how far the worst expected share stays from its target: up to TOLERANCE if
    the targets can be met, more if no nonnegative rates (of at most ``most``, if given) meet them or
    ``rounds`` were too few.

    A null text has no words, the prior as posterior and thus a rate like any other. Without usable
    labels there is no domain: posteriors are empty and rates 1. Repeated rows get equal rates and
    null ids are rated like any others; other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    model = fit_classifier(docs, labelled, id_col, text_col)
    table = Shelf(docs.sparkSession, "posteriors").put(posteriors(docs, model, [F.col(id_col).alias("doc_id")], text_col))
    rates = fit_rates(table, model.domains, targets, rounds, most)
    out = rated(table.select("doc_id", "tokens", "posterior"), rates)
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("gap", F.lit(rates.gap))
