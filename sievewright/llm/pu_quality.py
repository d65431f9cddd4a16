"""Quality classifier from positive and unlabelled texts.

Texts become a fixed number of measures of their bytes and words, computed for whole Arrow
batches without a loop over words. A small network is fitted to minimise the non-negative
unbiased risk: with class prior p, trusted positives P and unlabelled texts U,
``p R+(P) + max(0, R-(U) - p R-(P))``; where the second part would fall below zero its gradient
is turned round, so that the network cannot deny unlabelled positives to lower the risk. Labels
of the other class take no part in fitting.

The prior is estimated from P and U alone: a first network is fitted to tell P from U, and the
share of U above a score over that of P above it, lessened least, bounds the prior from above
(best bin); the bound is taken on texts that the first fit did not see, which for U are all texts
outside its sample, scored and counted where they lie.

The gradient steps draw on at most ``fit_rows`` positives and as many unlabelled texts, those of
least hash of their id; the prior and the scores cover every row. The measures are language-blind counts: neither id, nor
language, source or label enters a score.

Defined results: a null or empty text has all measures 0 and is scored like any other; rows
repeat as they come; a null id counts as remainder null, which is not held out, and finds no
label; without any positive every score is 0.5; with one positive or one unlabelled text there is
nothing to bound the prior with, and it is 0.5; equal scores reach a cut alike; very long texts are
measured whole; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, text_of
from .wordhash import Words, chunks

FIT_ROWS = 20_000
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3
_KINDS = ("lower", "upper", "digit", "space", "newline", "symbol", "bang", "pipe", "stop", "other", "high")


def _table() -> np.ndarray:
    table = np.full(256, _KINDS.index("other"), np.uint8)
    for kind, members in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "newline": (10,),
        "symbol": map(ord, "#*$%&<>@^~={}[]\\/_+"), "bang": map(ord, "!?"), "pipe": (124,), "stop": map(ord, ".,;:"), "high": range(128, 256),
    }.items():
        table[list(members)] = _KINDS.index(kind)
    return table


_CLASS = _table()
NAMES = (
    *(f"share_{k}" for k in _KINDS), *(f"words_end_{k}" for k in _KINDS), "log_words", "word_length", "word_length_spread", "long_words",
    "same_as_previous", "same_as_second", "bigram_repeats", "word_variety", "lines_per_word", "line_variety", "capital_words", "shout_words", "one_byte_words",
)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive places of ``at``."""
    return np.diff(np.r_[0.0, np.cumsum(values, dtype=np.float64)][at])


def _distinct(keys: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    return np.bincount(d[fresh], minlength=docs)[:docs]


def measures(words: Words) -> np.ndarray:
    """One row of measures for each text."""
    data, bounds, docs = words.data, words.bounds, len(words.bounds) - 1
    kinds = _CLASS[data]
    size = np.maximum(np.diff(bounds), 1)
    text_of_byte = np.repeat(np.arange(docs), np.diff(bounds))
    shares = np.bincount(text_of_byte * 16 + kinds, minlength=docs * 16).reshape(docs, 16)[:, : len(_KINDS)] / size[:, None]
    n = np.diff(words.at)
    many = np.maximum(n, 1)
    doc = np.repeat(np.arange(docs), n)
    starts, ends = words.starts, words.ends
    last = np.bincount(doc * 16 + kinds[ends - 1], minlength=docs * 16).reshape(docs, 16)[:, : len(_KINDS)] / many[:, None]
    length = (ends - starts).astype(float)
    mean = _sums(length, words.at) / many
    spread = np.sqrt(np.maximum(_sums(length**2, words.at) / many - mean**2, 0))
    h = words.hashes
    back = [np.zeros(len(h), bool), np.zeros(len(h), bool)]
    for k in (1, 2):
        back[k - 1][k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
    pair = h.copy()
    pair[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    upper, lower = np.r_[0, np.cumsum(kinds == 1)], np.r_[0, np.cumsum(kinds == 0)]
    ups, downs = upper[ends] - upper[starts], lower[ends] - lower[starts]
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[bounds[:-1][np.diff(bounds) > 0], breaks + 1])
    line_start = line_start[line_start < len(data)]
    of_line = np.searchsorted(bounds, line_start, "right") - 1
    first = np.searchsorted(starts, line_start)
    stop = np.r_[first[1:], len(starts)]
    total = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    line_key = total[stop] - total[first]
    full = stop > first
    lines = np.bincount(of_line[full], minlength=docs)[:docs]
    columns = [
        np.log1p(n), mean, spread, _sums(length > 20, words.at) / many, _sums(back[0], words.at) / many, _sums(back[1], words.at) / many,
        1 - _distinct(pair, doc, docs) / many, _distinct(h, doc, docs) / np.power(many, 0.8), lines / many,
        _distinct(line_key[full], of_line[full], docs) / np.maximum(lines, 1),
        _sums((ups > 0) & (downs > 0), words.at) / many, _sums((ups > 1) & (downs == 0), words.at) / many, _sums(length == 1, words.at) / many,
    ]
    return np.column_stack([shares, last, *columns])


def with_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x) with the measures of each text."""

    def run(batches):
        for batch, words in chunks(batches, 1):
            x = measures(words)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


class Network:
    """One hidden layer over standardised measures, fitted by Adam."""

    def __init__(self, width: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.parts = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def standardise(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.parts[0] + self.parts[1])
        return hidden, hidden @ self.parts[2] + self.parts[3][0]

    def gradient(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        inner = np.outer(slope, self.parts[2]) * (1 - hidden**2)
        return [z.T @ inner, inner.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.scaled(x))[1])


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def non_negative_risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk for the logistic loss, and its slopes at the outputs of P and U as the method takes them."""
    loss = lambda f: np.logaddexp(0, -f)
    positive = prior * loss(f_p).mean()
    negative = loss(-f_u).mean() - prior * loss(-f_p).mean()
    up_p, up_u, n_p, n_u = _sigmoid(f_p), _sigmoid(f_u), len(f_p), len(f_u)
    if negative >= 0:
        return positive + negative, (prior * (up_p - 1) - prior * up_p) / n_p, up_u / n_u
    return positive, prior * up_p / n_p, -up_u / n_u


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int = 0) -> Network:
    """A network of least non-negative risk; equal weights of P and U tell the two apart."""
    net = Network(x_p.shape[1], seed)
    net.standardise(np.concatenate([x_p, x_u]))
    z_p, z_u = net.scaled(x_p), net.scaled(x_u)
    rng = np.random.default_rng(seed + 1)
    m, v, t = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts], 0
    steps = max(1, len(z_u) // 512)
    for _ in range(EPOCHS):
        for u, p in zip(np.array_split(rng.permutation(len(z_u)), steps), np.array_split(rng.permutation(len(z_p)), steps)):
            if not len(u) or not len(p):
                continue
            hp, f_p = net.forward(z_p[p])
            hu, f_u = net.forward(z_u[u])
            _, s_p, s_u = non_negative_risk(f_p, f_u, prior)
            t += 1
            for i, (a, b) in enumerate(zip(net.gradient(z_p[p], hp, s_p), net.gradient(z_u[u], hu, s_u))):
                g = a + b + (1e-4 * net.parts[i] if net.parts[i].ndim > 1 else 0)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                net.parts[i] = net.parts[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def _cuts(s_p: np.ndarray) -> np.ndarray:
    """Scores to bound the prior at: quantiles of the scores of positives that the fit did not see."""
    return np.unique(np.quantile(s_p, np.linspace(0, 0.9, 91)))


def best_bin(s_p: np.ndarray, cut: np.ndarray, above: np.ndarray, n_u: int) -> float:
    """The least bound on the share of positives in U, of which ``above`` texts of ``n_u`` reach each cut."""
    q_p = 1 - np.searchsorted(np.sort(s_p), cut) / len(s_p)
    q_u = above / n_u
    slack = np.sqrt(np.log(20) / 2) * (len(s_p) ** -0.5 + n_u**-0.5)
    best = int(np.argmin((q_u + slack) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 1 / (n_u + 1), 1))


def _above(scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return len(scores) - np.searchsorted(np.sort(scores), cut)


def estimate_prior(x_p: np.ndarray, x_u: np.ndarray, seed: int = 0) -> float:
    """Best-bin estimate of the share of positives in U, from rows that the fit did not see."""
    a, b = len(x_p) // 2, len(x_u) // 2
    net = fit(x_p[:a], x_u[:b], 0.5, seed)
    s_p, s_u = net.score(x_p[a:]), net.score(x_u[b:])
    cut = _cuts(s_p)
    return best_bin(s_p, cut, _above(s_u, cut), len(s_u))


def counts_above(docs: DataFrame, net: Network, cut: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all texts of ``docs`` reach each cut, and how many there are; a task sends one row a cut."""

    def run(batches):
        total = np.zeros(len(cut) + 1, np.int64)
        for batch, words in chunks(batches, 1):
            total += np.r_[_above(net.score(measures(words)), cut), len(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "n"])

    found = docs.select("doc_id", text_of("text").alias("t")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(cut) + 1, np.int64)
    for r in found:
        n[r["at"]] = r["n"]
    return n[:-1], int(n[-1])


def _sample(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ids and measures of the ``limit`` rows of least hash of their id, in that order."""
    h = F.xxhash64("doc_id").alias("h")
    picked = rows.select("doc_id", "x", h).orderBy("h", "doc_id").limit(limit).toPandas()
    return picked["h"].to_numpy(np.int64), np.array(picked["x"].tolist(), float).reshape(len(picked), len(NAMES))


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5, held_out: int = 0):
    """The network and the estimated prior from documents outside the held-out fold.

    Unlabelled texts are all of these, trusted or not: the corpus whose prior is sought. Labels of
    the other class are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter((bucket("doc_id", folds) != held_out) & F.col("doc_id").isNotNull())
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    # at most fit_rows ids of 8 bytes: small enough to broadcast whatever the tables hold
    chosen = lambda ids: F.broadcast(ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    positive = with_measures(rows.join(chosen(rows.join(trusted, "doc_id", "left_semi")), "doc_id", "left_semi"))
    unlabelled = with_measures(rows.join(chosen(rows), "doc_id", "left_semi"))
    (_, x_p), (h_u, x_u) = _sample(positive, fit_rows), _sample(unlabelled, fit_rows)
    if not len(x_p) or not len(x_u):
        return None, 0.5
    rng = np.random.default_rng(5)
    x_p = x_p[rng.permutation(len(x_p))]
    prior, a, b = 0.5, len(x_p) // 2, len(x_u) // 2
    if a and b:
        net = fit(x_p[:a], x_u[:b], 0.5)
        s_p = net.score(x_p[a:])
        cut = _cuts(s_p)
        # the fit saw the texts of least hash: all others bound the prior
        above, n_u = counts_above(rows.filter(F.xxhash64("doc_id") > int(h_u[b - 1])), net, cut)
        prior = best_bin(s_p, cut, above, n_u) if n_u else prior
    return fit(x_p, x_u[rng.permutation(len(x_u))], prior), prior


def score_quality(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted) for every row of ``docs``."""

    def run(batches):
        for batch, words in chunks(batches, 1):
            s = net.score(measures(words)) if net is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, words in chunks(batches, at):
            yield batch.filter(pa.array(net.score(measures(words)) >= threshold)) if net is not None else batch

    return docs.mapInArrow(run, docs.schema)


def pu_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, prior) for every row of ``docs``."""
    net, prior = fit_quality(spark, docs, labels, fit_rows, folds, held_out)
    return score_quality(docs, net).select(
        "doc_id", F.coalesce(bucket("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted", F.lit(prior).alias("prior")
    )
