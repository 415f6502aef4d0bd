"""Quality rules by tokeniser fertility, after plain rules on length and repetition.

A public vocabulary encodes every text. Text that a vocabulary was not made for, or that is not language at all, shows in
three figures: characters per token, the share of tokens that fall back to bytes, and the entropy of the tokens. What is
usual differs by language, script and length, so each group of these has bands of its own about the medians over all its
documents, in median deviations from them. Junk has few characters per token and few different tokens at once, while clean
text with numbers or names is low in the first alone, so the lower band holds for the two together: the root of the sum of
their squared shortfalls. The upper bands hold for each figure. A document outside a band of its group is rejected. A
group's middle and spread are drawn toward those of its language and script at all lengths, these toward the script's, and
these toward all documents', as if PRIOR documents of the wider group were in it: small groups lean on wider ones, and no
size switches to another rule.

Base rules come first: a text fails with fewer than 20 words, or if over 30 % of its words lie in windows of eight words
that occur twice or more in it; such texts don't shape the bands. Medians come from mergeable sketches over all rows, of all
kinds of group at once; what is broadcast is one row for each group, and only if there are few.

Nulls: a null text is an empty one, without words, and fails. A null language is a group of its own in each script.
Repeated rows are judged one by one. An empty table gives an empty result. Columns other than doc_id, text and lang are
not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import ASCII_SPACE, bounded_batches, small_batches, stored, text_of, texts

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Median deviations (times 1.4826, which makes them standard deviations) that the shortfall may have, and each excess.
LOW_BAND, HIGH_BAND = 3.5, 8.0
#: Documents of the wider group that count in a group.
PRIOR = 20
#: Columns that tell groups apart, and how many of them each kind of group has, from the finest to all documents.
GROUP, KINDS = {"script": "string", "lang": "string", "size": "int"}, (3, 2, 1, 0)
#: Spread of each figure at least: characters per token, byte share, entropy.
LEAST_SPREAD = {"chars_per_token": 0.08, "byte_share": 0.005, "entropy": 0.12}
FIGURES = tuple(LEAST_SPREAD)
BROADCAST_GROUPS = 10_000
REMEMBERED = 400_000
#: First code point after each script's range that has one, in order: fixed values.
SCRIPTS = ((0x250, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "armenian"), (0x600, "hebrew"), (0x780, "arabic"), (0x900, "other"), (0x980, "devanagari"),
           (0xE00, "indic"), (0xE80, "thai"), (0x1100, "other"), (0x1200, "hangul"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "other"), (0x3100, "kana"),
           (0x3400, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"), (0x110000, "other"))
_STARTS = np.array([s for s, _ in SCRIPTS[:-1]])
_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_SYMBOLS = b"#*$%&|<>"
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WINDOW)]


class PieceTokenizer:
    """Ids as SentencePieceProcessor.encode gives them for a BPE model whose pieces have no space but at their start;
    units between such places are remembered."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.lead = len(self.model.encode("\n"))
        blank = {f"<0x{ord(c):02X}>" for c in ASCII_SPACE}
        self.is_byte = np.array([self.model.is_byte(i) and self.model.id_to_piece(i) not in blank for i in range(self.size)])
        self.ids_of: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        units, known = _UNITS.findall(" " + text), self.ids_of
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(units).difference(known))
        if new:
            # The model puts a space before what it gets, so a unit's own first space is left out; before a unit without
            # one, a line break keeps that space off, and both are dropped again.
            spaced = [u[0] == " " for u in new]
            found = self.model.encode([u[1:] if s else "\n" + u for u, s in zip(new, spaced, strict=True)], num_threads=1)
            for unit, s, ids in zip(new, spaced, found, strict=True):
                known[unit] = array("I", (ids or [self.model.piece_to_id("\u2581")]) if s else ids[self.lead :]).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, units)), np.uint32)


@lru_cache(maxsize=2)
def shared_pieces(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += own[k : k + n] * _ODD[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + WINDOW, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, ASCII_SPACE)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str:
    """The script of most letters beyond ASCII's share; ``none`` without a letter."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    letters = "".join(filter(str.isalpha, text))
    if not letters:
        return "none"
    points = np.frombuffer(letters.encode("utf-32-le"), "<u4")
    names = np.array([n for _, n in SCRIPTS])[np.searchsorted(_STARTS, points, side="right")]
    found, counts = np.unique(names, return_counts=True)
    return str(found[counts.argmax()])


def token_figures(ids: np.ndarray, chars: int, pieces: PieceTokenizer) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte tokens, entropy in bits."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return n, chars / n, float(pieces.is_byte[ids].mean()), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


STATS = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


def measured(docs: DataFrame, model_path: str) -> DataFrame:
    """One row with all counts and figures for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model_path)
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
        for batch in small_batches(batches, "text"):
            found = []
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                found.append((doc, lang, script_of(text), *base_counts(text), *token_figures(pieces.encode(text), len(text), pieces)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in STATS.split(", ")])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), text_of().alias("text")).mapInArrow(rows, STATS)


def bands(stats: DataFrame) -> DataFrame:
    """Per group (script, lang, size: doublings of the number of tokens) the middle and spread of each figure, drawn toward those
    of wider groups."""
    key = [F.struct(F.lit(kind).alias("kind"), *[(F.col(c) if i < kind else F.lit(None).cast(t)).alias(c) for i, (c, t) in enumerate(GROUP.items())]) for kind in KINDS]
    rows = stats.select(*FIGURES, F.explode(F.array(*key)).alias("key")).select(*FIGURES, "key.*")
    names = ["kind", *GROUP]
    middle = stored(rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in names]).agg(F.count("*").alias("members"), *[F.percentile_approx(c, 0.5, 1000).alias(f"{c}_mid") for c in FIGURES]), "middles")
    off = rows.join(F.broadcast(middle) if few(middle) else middle, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names])
    found = stored(off.groupBy(*names).agg(F.first("members").alias("members"), *[F.first(f"{c}_mid").alias(f"{c}_mid") for c in FIGURES],
                                           *[F.greatest(F.lit(LEAST_SPREAD[c]), 1.4826 * F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_mid")), 0.5, 1000)).alias(f"{c}_spread") for c in FIGURES]), "spreads")
    values = [f"{c}_{x}" for c in FIGURES for x in ("mid", "spread")]
    drawn = found.where("kind = 0").select(*names, *values)
    for kind in KINDS[-2::-1]:
        wider = drawn.where(F.col("kind") == kind - 1).select(*[F.col(c).alias(f"of_{c}") for c in GROUP], *[F.col(v).alias(f"of_{v}") for v in values])
        own = found.where(F.col("kind") == kind)
        own = own.join(F.broadcast(wider) if few(wider) else wider, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in list(GROUP)[: kind - 1]] or F.lit(True))
        drawn = own.select(*names, *[((F.col("members") * F.col(v) + PRIOR * F.col(f"of_{v}")) / (F.col("members") + PRIOR)).alias(v) for v in values])
    return stored(drawn.drop("kind"), "bands")


def few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def fertility_rules(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, kept, then the figures and ``reason``."""
    size = F.floor(F.log2(F.col("n_tokens") + 1)).cast("int")
    stats = stored(measured(docs, model_path).withColumn("size", size), "fertility")
    # Texts that fail the base rules don't shape the bands.
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    found = bands(stats.where(~failed)).withColumnsRenamed({c: f"of_{c}" for c in GROUP})
    joined = stats.join(F.broadcast(found) if few(found) else found, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in GROUP], "left")
    off = {c: (F.col(c) - F.col(f"{c}_mid")) / F.col(f"{c}_spread") for c in FIGURES}
    short = [F.pow(F.least(off[c], F.lit(0.0)), 2) for c in ("chars_per_token", "entropy")]
    reason = F.when(failed, "base").when(F.sqrt(short[0] + short[1]) > LOW_BAND, "low fertility")
    for c in FIGURES:
        reason = reason.when(off[c] > HIGH_BAND, c)
    return joined.withColumn("reason", reason).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("reason").isNull().alias("kept"),
                                                     "n_tokens", "chars_per_token", "byte_share", "entropy", "script", "reason")
