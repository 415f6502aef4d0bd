"""Language identification by character language models with interpolated Kneser-Ney smoothing.

A model per language gives each character's probability after the three before it. Texts are lower-cased; every stretch of
characters that are not letters counts as one space. The counts of 4-grams per language are taken in Spark; all lower
orders of Kneser-Ney smoothing count types of the order above, so they follow from the 4-grams. All languages share one
table for each order: a sorted array of hashed n-grams, entered through a directory on the leading bits, and beside it the
log probabilities in every language, already interpolated. So a character costs one look-up whatever the number of
languages; only n-grams that no language has seen go on to the shorter contexts.

The prediction is the language with the lowest cross-entropy per character. ``rejected`` says that even that language
explains the text badly: its cross-entropy is over the language's mean by more than REJECT_AT standard deviations, as
calibrated on documents that the model has not counted, with regard to the text's length; or that the text has no letter.

Fitting uses at most about SAMPLE_DOCS documents of each language (drawn by a hash of doc_id over all of them). All orders are
counted over the whole sample. Of each order and language the most frequent n-grams are kept, at most MAX_GRAMS and fewer
where there are so many languages that the tables would have over MODEL_CELLS numbers; what the others had goes to shorter
contexts, so probabilities still sum to one, and the model's size does not grow with the input. Every document is scored,
over its whole text.

Nulls: a null text, or one without a letter, gets ``und``, score 0 and rejected. A null doc_id is never learned from and
counts as held out. Rows with a null language aren't learned from. Without any row to learn from every prediction is
``und``. Equal cross-entropies: the first language in alphabetical order. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import bounded_batches, small_batches, stored, text_of, texts

SAMPLE_DOCS = 3_000
MAX_GRAMS, MODEL_CELLS = 200_000, 1 << 26
ORDER = 4
DISCOUNT = 0.75
#: Of ten sampled documents one calibrates the rejection.
CALIBRATE = 10
REJECT_AT = 8.0
#: Characters that count as independent evidence at most: successive 4-grams share signs, so a long text's score would else be
#: 0 or 1. It scales the score alone, not the prediction.
EVIDENCE = 40
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 0x20


def _classes() -> np.ndarray:
    """For each code point the 16-bit sign that stands for it: itself if it is a letter, one sign for letters beyond, else space."""
    table = np.full(0x110000, _SPACE, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = i if i < 0xFFFF else 0xFFFF
    return table


_TABLE: list[np.ndarray] = []


def signs(text: str) -> np.ndarray:
    """The text's signs after ORDER - 1 spaces; only those spaces if it has no letter."""
    if not _TABLE:
        _TABLE.append(_classes())
    a = _TABLE[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = a != _SPACE
    if not keep.any():
        a = a[:0]
    else:
        keep[1:] |= keep[:-1]
        a = a[keep]
    return np.concatenate((np.full(ORDER - 1, _SPACE, np.uint16), a))


def grams(a: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each sign after the leading spaces, packed into 64 bits."""
    out = np.zeros(len(a) - ORDER + 1, np.uint64)
    for k in range(n):
        start = ORDER - n + k
        out = (out << np.uint64(16)) | a[start : start + len(out)]
    return out


class HashTable:
    """A sorted array of mixed keys with a directory on their leading bits; ``values`` has a row for each key, in that order,
    and one row more for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: float = 0.0):
        mixed = keys * _MIX
        order = np.argsort(mixed)
        self.keys = np.append(mixed[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.vstack((values[order], np.full((1, values.shape[1]), absent))).astype(np.float32)
        self.bits = np.uint64(64 - max(1, int(np.ceil(np.log2(len(keys) + 2))) + 1))
        heads = np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits
        self.directory = np.searchsorted(self.keys[:-1], heads).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; that of the absent if there is none."""
        mixed = keys * _MIX
        at = self.directory[mixed >> self.bits].astype(np.int64)
        found = self.keys[at]
        behind = np.flatnonzero(found < mixed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < mixed[behind]]
        at[self.keys[at] != mixed] = len(self.keys) - 1
        return at


#: n-grams, how often each was seen (below the highest order: as the end of how many different longer ones), and the sum of
#: that over all n-grams with its context.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray]


class KneserNey:
    """Models of several languages over the same tables: ``tables[n]`` has the log probabilities of n-grams, ``weights[n]``
    the log weight that a context of n signs gives to shorter contexts."""

    def __init__(self, languages: list[str], counted: list[list[Counted]]):
        """``counted`` has for each language the n-grams of each order from 1 on, their counts, and those of their contexts."""
        self.languages, n_lang = languages, len(languages)
        mask = lambda n: np.uint64((1 << 16 * n) - 1)
        signs_seen = max(1, len(np.unique(np.concatenate([orders[0][0] for orders in counted]))))
        self.floor = float(-np.log(signs_seen + 1))
        self.tables, self.weights = [None] * (ORDER + 1), [None] * ORDER
        lower = lambda keys: np.full((len(keys), n_lang), self.floor)
        for n in range(1, ORDER + 1):
            every = np.unique(np.concatenate([orders[n - 1][0] for orders in counted]))
            contexts = np.unique(every >> np.uint64(16))
            weight, value = np.zeros((len(contexts), n_lang)), np.empty((len(every), n_lang))
            shorter = lower(every & mask(n - 1))
            at = np.searchsorted(contexts, every >> np.uint64(16))
            for lang, orders in enumerate(counted):
                keys, counts, totals = orders[n - 1]
                owner = np.searchsorted(contexts, keys >> np.uint64(16))
                share = (counts - DISCOUNT) / totals
                given = np.bincount(owner, share, len(contexts))
                seen = given > 0
                weight[seen, lang] = np.log(1 - given[seen])
                p = np.exp(weight[at, lang] + shorter[:, lang])
                p[np.searchsorted(every, keys)] += share
                value[:, lang] = np.log(p)
            self.tables[n], self.weights[n - 1] = HashTable(every, value), HashTable(contexts, weight)
            lower = lambda keys, n=n: self._look(keys, n)

    def _look(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of n-grams, whether or not they were seen."""
        table = self.tables[n]
        at = table.find(keys)
        out = table.values[at]
        missing = np.flatnonzero(at == len(table.keys) - 1)
        if len(missing):
            rest = keys[missing]
            weights = self.weights[n - 1]
            shorter = self._look(rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else np.float32(self.floor)
            out[missing] = weights.values[weights.find(rest >> np.uint64(16))] + shorter
        return out

    def entropies(self, many: list[np.ndarray]) -> np.ndarray:
        """Nats per character of each text, given as signs, in each language; without letters nan."""
        out = np.full((len(many), len(self.languages)), np.nan)
        step, size = [], 0
        for i, a in enumerate(many):
            if len(a) > ORDER - 1:
                step.append(i)
                size += len(a)
            if step and (size >= 1 << 18 or i == len(many) - 1):
                self._entropies(many, step, out)
                step, size = [], 0
        if step:
            self._entropies(many, step, out)
        return out

    def _entropies(self, many: list[np.ndarray], step: list[int], out: np.ndarray) -> None:
        parts = [grams(many[i]) for i in step]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        scores = self._look(np.concatenate(parts), ORDER)
        # float64 sums: a text's result doesn't depend on its neighbours beyond rounding that float32 results hide.
        sums = np.add.reduceat(scores.astype(np.float64), np.concatenate(([0], ends[:-1])), axis=0)
        out[step] = -sums / sizes[:, None]


def _in_training(fold: Column) -> Column:
    return F.coalesce(fold != 1, F.lit(False))


def counted_grams(sample: DataFrame, max_grams: int = MAX_GRAMS) -> list[tuple[str, list[Counted]]]:
    """(language, n-grams of each order) over the sampled rows (lang, text), at most ``max_grams`` an order."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                by.setdefault(lang, []).append(grams(signs(text)))
            for lang, parts in by.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    rows = sample.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, list[Counted]] = {}
    for order in range(ORDER, 0, -1):
        rows = stored(rows, "grams")
        # Only the most frequent of each language come to the driver.
        own = rows.withColumn("total", F.expr("sum(n) over (partition by lang, shiftrightunsigned(gram, 16))")).withColumn("at", F.expr("row_number() over (partition by lang order by n desc, gram)"))
        top = own.where(F.col("at") <= max_grams).select("lang", "gram", "n", "total").toArrow()
        langs, columns = np.array(top.column("lang").to_pylist(), object), [top.column(c).to_numpy().astype(np.int64) for c in ("gram", "n", "total")]
        for lang in set(langs.tolist()):
            gram, n, total = (c[langs == lang] for c in columns)
            found.setdefault(lang, []).insert(0, (gram.view(np.uint64), n.astype(np.float64), total.astype(np.float64)))
        rows = rows.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    return sorted(found.items())


class LanguageId:
    """A fitted identifier: the models, and per language mean, variance per character and variance per document of the
    cross-entropy of its own documents."""

    def __init__(self, model: KneserNey, mean: np.ndarray, per_char: np.ndarray, per_doc: np.ndarray):
        self.model, self.mean, self.per_char, self.per_doc = model, mean, per_char, per_doc

    def judge(self, many: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        marked = [signs(t) for t in many]
        size = np.array([len(a) - ORDER + 1 for a in marked])
        h = self.model.entropies(marked)
        none = size == 0
        h[none] = 0
        best = h.argmin(1)
        lowest = h[np.arange(len(many)), best]
        evidence = np.minimum(size, EVIDENCE)[:, None]
        score = 1 / np.exp(-(h - lowest[:, None]) * evidence).sum(1)
        spread = np.sqrt(self.per_char[best] / np.maximum(size, 1) + self.per_doc[best])
        rejected = none | (lowest - self.mean[best] > REJECT_AT * spread)
        langs = [UNKNOWN if n else self.model.languages[b] for n, b in zip(none.tolist(), best.tolist(), strict=True)]
        return langs, np.where(none, 0.0, np.round(score, 6)), rejected


def fit(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, max_grams: int = MAX_GRAMS) -> LanguageId | None:
    """Learns from rows (doc_id, text, lang); None if there are none."""
    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    at = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000))
    shares = {r.lang: min(1.0, sample_docs / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    sample = stored(rows.where(at < share * 1_000_000).select("lang", "text", (F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(CALIBRATE)) == 0).alias("calibrates")), "language-sample")
    most = min(max_grams, MODEL_CELLS // len(shares) ** 2 + 1)
    counted = counted_grams(sample.where("not calibrates"), most) or counted_grams(sample, most)
    if not counted:
        return None
    model = KneserNey([c[0] for c in counted], [c[1] for c in counted])
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            marked = [signs(t) for t in texts(batch, "text")]
            h, names = shared.value.entropies(marked), shared.value.languages
            found = [(lang, len(a) - ORDER + 1, float(x[names.index(lang)])) for lang, a, x in zip(batch.column("lang").to_pylist(), marked, h, strict=True) if lang in names and len(a) >= ORDER]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["lang", "n", "h"])

    # The median and the spread about it don't follow the few documents that carry a wrong language.
    held = sample.where("calibrates").mapInArrow(measured, "lang string, n long, h double")
    middle = held.groupBy("lang").agg(F.percentile_approx("h", 0.5).alias("mean"))
    off = F.abs(F.col("h") - F.col("mean"))
    spread = {r.lang: r for r in held.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.percentile_approx(off * F.sqrt("n"), 0.5).alias("short"), F.percentile_approx(off, 0.5).alias("whole")).collect()}
    value = lambda f, default: np.array([f(spread[x]) if x in spread else default for x in model.languages])
    # 1.4826 median deviations are a standard deviation; the floors keep a tiny sample from rejecting what is usual.
    return LanguageId(model, value(lambda r: r.mean, -model.floor), value(lambda r: max(1.0, (1.4826 * r.short) ** 2), 4.0), value(lambda r: max(0.01, (1.4826 * r.whole) ** 2), 0.25))


def predict(docs: DataFrame, fitted: LanguageId | None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, rejected."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            n = batch.num_rows
            langs, scores, rejected = shared.value.judge(texts(batch, "text")) if shared.value else ([UNKNOWN] * n, np.zeros(n), np.ones(n, bool))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(judged, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out third and judges all: doc_id, held_out, lang_pred, score, rejected."""
    bounded_batches(docs.sparkSession)
    fitted = fit(docs.where(_in_training(fold(3))))
    return predict(docs, fitted).select("doc_id", F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns, after learning from those outside the held-out third."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(_in_training(fold(3)))))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            if shared.value:
                yield batch.filter(pa.array(~shared.value.judge(texts(batch, "text"))[2]))

    return docs.mapInArrow(kept, docs.schema)
