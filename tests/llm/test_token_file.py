import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecspark.llm.common import shared_dir
from vecspark.llm.token_file import Segment, find_token, range_part, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [200, 256, 70_000, 1 << 25, (1 << 32) - 1])
def test_codes(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(5000) ** 6 * top).astype(np.uint32)
    s = Segment(Segment.pack([3, None], [2000, 5000], ids))
    assert (s.tokens(0, 5000) == ids).all() and all(s.token(i) == ids[i] for i in range(0, 5000, 37))
    for a, b in [(0, 0), (5000, 5000), (1, 2), (511, 513), (1003, 4999)]:
        assert (s.tokens(a, b) == ids[a:b]).all()
    assert [(d, n, len(x)) for d, n, x in s.documents()] == [(3, 0, 2000), (None, 2000, 3000)]


def test_no_tokens():
    s = Segment(Segment.pack([], [], np.zeros(0, np.uint32)))
    assert s.n_tokens == 0 and len(s.tokens(0, 0)) == 0
    with pytest.raises(IndexError):
        s.token(0)


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rows = [(None, "none")] + [(i, None if i % 9 == 0 else "" if i % 9 == 1 else f"Word {i} thing. " * (i % 40)) for i in range(-50, 300)] + [(5000, "long text " * 30_000), (5001, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows[::-1]], "doc_id long, text string, part int, payload binary")
    path = shared_dir(spark, "t")
    write_tokens(df, path, PATH, segment_tokens=500)
    got = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    ids = Tokenizer.from_file(PATH).encode(rows[200][1], add_special_tokens=False).ids
    assert find_token(spark, path, rows[200][0], 3) == ids[3] and find_token(spark, path, rows[200][0], 10**6) is None and find_token(spark, path, 99_999, 0) is None


def test_empty_and_repeated(spark):
    path = shared_dir(spark, "t")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_tokens(spark, path).collect() == []
    path = shared_dir(spark, "t")
    write_tokens(spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string"), path, PATH)
    got = read_tokens(spark, path).collect()
    assert sorted(r.start for r in got) == [0, 3, 6, 9, 12] and len({r.ids_crc32 for r in got}) == 1


def test_parts_ascend_and_hot_ids_are_dealt_over_them(spark):
    rng = np.random.default_rng(3)
    ids = [None] * 300 + [7] * 500 + rng.integers(-(10**12), 10**12, 700).tolist()
    rng.shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for parts in (1, 2, 16, 90):
        got = [(r.doc_id, r.part) for r in df.select("doc_id", range_part(df, parts).alias("part")).collect()]
        order = sorted(got, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        assert [d for d, _ in order] == sorted((d for d, _ in got), key=lambda d: (d is not None, d or 0))
        sizes = np.bincount([p for _, p in got])
        assert sizes.max() <= 3 * len(ids) / parts + 5 and len(sizes) <= parts * 1.3 + 2


def test_one_doc_id_on_many_rows(spark):
    rows = [(5, f"word {i}") for i in range(400)] + [(i, "other words") for i in range(10)]
    path = shared_dir(spark, "t")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, segment_tokens=50)
    got = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(d for d, _ in rows) and len(got) == len(rows)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
