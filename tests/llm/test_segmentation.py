import tracemalloc
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from vecspark.llm import segmentation
from vecspark.llm.queries import op4_segmentations
from vecspark.llm.segmentation import Lattices, Vocabulary, mixed, sample_batch, segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY, MODEL = Vocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = {MODEL.id_to_piece(i): i for i in range(MODEL.get_piece_size()) if not (MODEL.is_byte(i) or MODEL.is_control(i) or MODEL.is_unknown(i))}


def every(text):
    """All segmentations of a text as ids, with their probabilities."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    out = []

    def go(at, ids, w):
        if at == len(s):
            out.append((tuple(ids), w))
            return
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in PIECES:
                i = PIECES[s[at:end]]
                go(end, [*ids, i], w / (-MODEL.get_score(i) % 1e9 + 2.7))
        if s[at] not in PIECES:
            own = [MODEL.piece_to_id(f"<0x{b:02X}>") for b in s[at].encode()]
            go(at + 1, ids + own, w / (32000 + 2.7) ** len(own))

    go(0, [], 1.0)
    total = sum(w for _, w in out)
    return {ids: w / total for ids, w in out}


TEXTS = ["", "a", "the", "in on", "ab\nc", "é☃", "  x", "a  b ", "\n\n", "日本ก"]


@pytest.mark.parametrize("text", TEXTS)
def test_draws_everything_once(text):
    want = every(text)
    k = len(want) + 3
    got = sample_batch([text, "other text", text], np.array([1, 2, 3], np.uint64), k, VOCABULARY)
    for rows in (got[0], got[2]):
        ids = [tuple(VOCABULARY.ids(s).tolist()) for s, *_ in rows]
        assert len(ids) == len(set(ids)) == len(want) and set(ids) == set(want)
        for i, (_, log_p, _, inclusion) in zip(ids, rows, strict=True):
            assert abs(exp(log_p) - want[i]) < 1e-9 and inclusion == 0
        scores = [r[2] for r in rows]
        assert scores == sorted(scores, reverse=True)


def test_law_without_replacement():
    text, n = "the in", 6000
    want = every(text)
    rows = sample_batch([text] * n, np.arange(n, dtype=np.uint64), 2, VOCABULARY)
    got = [[tuple(VOCABULARY.ids(s).tolist()) for s, *_ in r] for r in rows]
    first, pairs = Counter(g[0] for g in got), Counter(map(tuple, got))
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 2e-3
        for other, q in want.items():
            both = p * q / (1 - p) if ids != other else 0
            assert abs(pairs[ids, other] / n - both) < 4 * (both / n) ** 0.5 + 2e-3
    # Inclusion probabilities weight samples without bias: the sum of p / inclusion is 1 on average.
    total = [sum(exp(r[1] - r[3]) for r in rs) for rs in rows]
    assert abs(np.mean(total) - 1) < 5 * np.std(total) / n**0.5 + 0.01


def test_long_word_sums_in_logarithms():
    short = Lattices([" thein" * 1], VOCABULARY)
    word = " " + "thein" * 40
    a = Lattices([word], VOCABULARY)
    assert np.isfinite(a.log_mass).all() and np.allclose(np.add.reduceat(np.exp(a.log_p), np.unique(a.first[:-1][~a.final])), 1)
    assert np.isfinite(short.log_mass).all()


def test_short_words_of_many_bytes():
    """Their product of weights is below the smallest float; it must neither cost samples nor reach other texts of a batch."""
    rare = "".join(c for c in map(chr, range(0x1200, 0x1290)) if c not in PIECES)[:50]
    many = [f"{rare} the quick brown fox", rare, f"in{rare}on", "plain words", "😀" * 40]
    keys = np.arange(5, dtype=np.uint64)
    got = sample_batch(many, keys, 2, VOCABULARY)
    assert [len(x) for x in got] == [2, 1, 2, 2, 1]
    for text, rows in zip(many, got, strict=True):
        for symbols, log_p, score, inclusion in rows:
            assert np.isfinite([log_p, score, inclusion]).all() and VOCABULARY.decode(VOCABULARY.ids(symbols)) == text
    assert abs(sum(exp(r[1]) for r in got[1]) - 1) < 1e-9
    alone = sample_batch(many[3:4], keys[3:4], 2, VOCABULARY)[0]
    assert [r[0].tolist() for r in alone] == [r[0].tolist() for r in got[3]] and np.allclose([r[1:] for r in alone], [r[1:] for r in got[3]])


def test_query_gives_the_segmentations(spark, tmp_path):
    rows = [(1, "Some text\nwith  lines é ☃."), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_segmentations(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, 3: 1}
    for r in got:
        assert MODEL.decode(r.ids) == (dict(rows)[r.doc_id] or "") and len(r.ids) == r.n_tokens
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_depends_on_row_alone():
    texts = ["some words", "the quick brown fox", "x" * 100, "", "a b c"]
    keys = mixed(np.arange(5, dtype=np.uint64))
    together = sample_batch(texts, keys, 3, VOCABULARY)
    for i in range(5):
        alone = sample_batch(texts[i : i + 1], keys[i : i + 1], 3, VOCABULARY)[0]
        assert [r[0].tolist() for r in alone] != [] and [VOCABULARY.ids(r[0]).tolist() for r in alone] == [VOCABULARY.ids(r[0]).tolist() for r in together[i]]


def test_table(spark):
    rows = [(1, "Some text\nwith  lines é ☃."), (2, None), (3, ""), (4, "▁ sign"), (5, "long words " * 20_000), (6, "x" * 3000), (None, "null key"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(*r, 0, [1]) for r in rows], "doc_id long, text string, rank int, ids array<int>")
    got = segmentations(df, PATH, k=3).collect()
    assert all(r.decoded for r in got)
    by = Counter(r.doc_id for r in got)
    assert by == {1: 3, 2: 1, 3: 1, 4: 3, 5: 3, 6: 3, None: 3, 7: 6}
    assert len({tuple(r.ids) for r in got if r.doc_id == 7}) == 3 and len({tuple(r.ids) for r in got if r.doc_id == 5}) == 3
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert MODEL.decode(r.ids) == text.replace("▁", " ") and r.n_tokens == len(r.ids) and r.log_p <= 1e-9 and r.log_inclusion <= 0
    again = segmentations(df.repartition(5), PATH, k=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = segmentations(df, PATH, k=3, seed=1).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    assert segmentations(df.limit(0), PATH, digest=True).collect() == []


def test_portions_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 12, 300)] + ["é☃" * 50, "x" * 200, "ก" * 40]
    texts = [" ".join(rng.choice(words, n)) for n in (40, 0, 1, 300, 7, 0, 90)] + ["", "\n "]
    keys = mixed(np.arange(len(texts), dtype=np.uint64))
    at_once = sample_batch(texts, keys, 3, VOCABULARY)
    for name in ("BUILT_CHARACTERS", "WALKED_CHARACTERS", "MOST_PLACES"):
        monkeypatch.setattr(segmentation, name, 20)
    for got, want in zip(sample_batch(texts, keys, 3, VOCABULARY), at_once, strict=True):
        assert [r[0].tolist() for r in got] == [r[0].tolist() for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want])


def test_worker_holds_one_part(spark, monkeypatch):
    """The rows of a part are given before the next part is drawn; lattices are built in portions."""
    rng = np.random.default_rng(6)
    words = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 60_000)])
    many = [" ".join(rng.choice(words, 800)) for _ in range(400)]
    df = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, function, schema: function)
    sampled = segmentations(df, PATH, k=2, digest=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(many))), "text": many})
    rows, largest = 0, 0
    tracemalloc.start()
    try:
        for out in sampled(iter([batch])):
            rows, largest = rows + out.num_rows, max(largest, out.nbytes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2 * len(many) and largest < 4e6 and peak < 100e6
