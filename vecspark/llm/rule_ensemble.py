"""A quality classifier that is a sparse ensemble of rules.

Boosted shallow trees are grown over statistics of the text. Every path from a root to a node becomes a rule, a conjunction
of thresholds; a logistic regression with an L1 penalty weights the rules and leaves few of them. What remains is compiled
into one Spark column expression over the statistics, so scoring is a sum of CASEs and the model is readable.

Learning uses at most about SAMPLE_ROWS labelled rows, drawn by a hash of doc_id over all of them; their ids are broadcast
(that many at most), so no text is shuffled. Every document is scored over its whole text, in one pass.

Nulls: a null text is an empty one; labels with a null doc_id or label are not learned from; a doc_id with several labels
has the lowest, and one with several rows is learned from once, by the lowest statistics. Repeated rows are scored one by one. Where the labels learned from are all alike, or missing, every score
is their mean, or 0.5. Empty texts have statistics of 0. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vecspark.llm.common import bounded_batches, small_batches, text_of, texts
from vecspark.llm.language_id import fold

SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, LEAST_SUPPORT, RATE = 40, 3, 32, 30, 0.3
#: Penalties that a fifth of the sampled rows chooses from.
PENALTIES = (0.01, 0.003, 0.001)
#: A document is of quality from this score on.
ACCEPT = 0.3
STATISTICS = ("chars", "words", "word_chars", "symbols", "stops", "upper", "digits", "other_chars", "distinct_words", "top_word",
              "distinct_triples", "dup_lines", "words_a_line", "odd_words", "upper_words", "long_words")
_SYMBOLS, _STOPS = b"#*$%&|<>{}[]\\^~_=+@", b".,;:!?"


def statistics(text: str) -> tuple[float, ...]:
    """The text's statistics, in the order of STATISTICS: logarithms of sizes, and shares."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(text)
    if not n:
        return (float(np.log1p(size)),) + (0.0,) * (len(STATISTICS) - 1)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols, stops, digits = gone(_SYMBOLS), gone(_STOPS), gone(b"0123456789")
    return (
        float(np.log1p(size)), float(np.log1p(n)), letters / n, symbols / size, stops / n, gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(1, letters), digits / size,
        (size - letters - symbols - stops - digits) / size, len(counts) / n, max(counts.values()) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(c for w, c in counts.items() if w.strip(_SYMBOLS + _STOPS) != w.rstrip(_STOPS)) / n,
        sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / n, sum(c for w, c in counts.items() if len(w) > 30) / n,
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction: per statistic an interval (low, high] of values; ``weight`` is added where all hold."""

    bounds: tuple[tuple[int, float, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, low, high in self.bounds:
            out &= (x[:, i] > low) & (x[:, i] <= high)
        return out

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for i, low, high in self.bounds:
            c = F.col(f"{prefix}{STATISTICS[i]}")
            if low > -np.inf:
                out &= c > float(low)
            if high < np.inf:
                out &= c <= float(high)
        return out


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str) -> Column:
        """The score as a Spark expression over columns with the statistics."""
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z += F.when(r.column(prefix), float(r.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _tree_rules(codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[list[Rule], np.ndarray]:
    """Paths of one tree that fits the gradient on ``rows``, and the step it takes for all rows."""
    step, rules = np.zeros(len(codes)), []

    def grow(inside: np.ndarray, fitted: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        if bounds:
            rules.append(Rule(tuple((i, *b) for i, b in sorted(bounds.items()))))
        g, h = gradient[fitted].sum(), hessian[fitted].sum()
        best = (1e-6, -1, 0)
        if depth < DEPTH and len(fitted) >= 2 * LEAST_SUPPORT:
            for i in rng.choice(codes.shape[1], max(1, codes.shape[1] * 2 // 3), replace=False):
                own = codes[fitted, i]
                gs = np.cumsum(np.bincount(own, gradient[fitted], BINS))[:-1]
                hs = np.cumsum(np.bincount(own, hessian[fitted], BINS))[:-1]
                ns = np.cumsum(np.bincount(own, minlength=BINS))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAST_SUPPORT) | (len(fitted) - ns < LEAST_SUPPORT)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), int(i), at)
        if best[1] < 0:
            step[inside] = g / (h + 1)
            return
        _, i, at = best
        cut, (low, high) = float(edges[i][at]), bounds.get(i, (-np.inf, np.inf))
        left, fit_left = codes[inside, i] <= at, codes[fitted, i] <= at
        grow(inside[left], fitted[fit_left], bounds | {i: (low, min(high, cut))}, depth + 1)
        grow(inside[~left], fitted[~fit_left], bounds | {i: (max(low, cut), high)}, depth + 1)

    grow(np.arange(len(codes)), rows, {}, 0)
    return rules, step


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """Distinct paths of boosted trees."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    edges = [np.append(e, np.full(BINS - len(e), np.inf)) for e in edges]
    z, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rules, step = _tree_rules(codes, edges, y - p, p * (1 - p), np.flatnonzero(rng.random(len(y)) < 0.5), rng)
        z += RATE * step
        found |= dict.fromkeys(r.bounds for r in rules)
    return [Rule(b) for b in found]


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 250) -> np.ndarray:
    """Weights (the first is the free intercept) that minimise log loss plus the penalty, by accelerated proximal steps."""
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / float(v @ (a.T @ (a @ v)))
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        new = ahead - rate * (a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / len(y))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t_new
    return w


def train(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(float(np.clip(np.log(y.mean() + 1e-9) - np.log(1 - y.mean() + 1e-9), -6, 6)) if len(y) else 0.0)
    rules = extract_rules(x, y.astype(np.float64))
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))))
    a = np.column_stack([np.ones(len(y)), *(r.holds(x) for r in rules)]).astype(np.float32)
    checks = np.arange(len(y)) % 5 == 0
    start = np.zeros(a.shape[1])
    tried = []
    for penalty in PENALTIES:
        start = lasso_logistic(a[~checks], y[~checks], penalty, start)
        z = a[checks] @ start
        tried.append((float(np.mean(np.logaddexp(0, -z) * y[checks] + np.logaddexp(0, z) * (1 - y[checks]))), penalty, start))
    _, penalty, start = min(tried, key=lambda x: x[0])
    w = lasso_logistic(a, y, penalty, start)
    return RuleEnsemble(float(w[0]), [Rule(r.bounds, float(v)) for r, v in zip(rules, w[1:], strict=True) if abs(v) > 1e-4])


def with_statistics(docs: DataFrame, prefix: str = "stat_", without: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` but those in ``without``, and a column for each statistic of its text."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in without]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = np.array([statistics(t) for t in texts(batch, "text")]).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names=[*kept, *(prefix + s for s in STATISTICS)])

    return docs.mapInArrow(measured, StructType([*(docs.schema[c] for c in kept), *(StructField(prefix + s, DoubleType()) for s in STATISTICS)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learns from the labelled rows outside the held-out fifth."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(fold(5) != 0).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    total = known.count()
    if not total:
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000)) < min(1.0, sample_rows / total) * 1_000_000)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), "doc_id")
    lowest = F.min(F.struct(*[f"stat_{s}" for s in STATISTICS])).alias("lowest")
    found = with_statistics(rows, without=("text",)).groupBy("doc_id", "label").agg(lowest).select("doc_id", "label", "lowest.*").orderBy("doc_id").toArrow()
    x = np.stack([found.column(f"stat_{s}").to_numpy() for s in STATISTICS], axis=1) if found.num_rows else np.zeros((0, len(STATISTICS)))
    return train(x, found.column("label").to_numpy())


def score(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted."""
    rows = with_statistics(docs.select("doc_id", text_of().alias("text")), without=("text",))
    return rows.select("doc_id", ensemble.column("stat_").alias("score")).select("doc_id", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns outside the held-out fifth and scores all rows: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of quality, with all their columns."""
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    ensemble = fit(docs, labels)
    return with_statistics(docs, prefix).where(ensemble.column(prefix) >= ACCEPT).select(*docs.columns)
