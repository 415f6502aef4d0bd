import os
import pathlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecspark.llm import language_id, rule_ensemble


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with copies, near copies, junk and texts without letters, and labels for them."""
    rng = random.Random(9)
    words = ["".join(rng.choice(["wa", "ter", "peo", "ple", "lit", "tle", "sou", "nd"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [(i, text(rng.randint(60, 200)), "en") for i in range(200)]
    copies = [(300 + i, "  " + clean[i][1].replace(" ", "\n", 3), "en") for i in range(20)]
    near = []
    for i in range(20, 40):
        own = clean[i][1].split()
        own[5] = "changed"
        near.append((300 + i, " ".join(own), "en"))
    junk = [(400 + i, " ".join(rng.choice(words) + rng.choice(["###", "&&&", "$$$"]) for _ in range(100)), "en") for i in range(60)]
    odd = [(500, None, "en"), (501, "", None), (502, "1 2 3", "en"), (None, text(80), "en")]
    rows = clean + copies + near + junk + odd
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "s", 1, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 400), 0) for d, _, _ in rows if d is not None and d < 500], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    identified, quality, exact, near = left
    assert not identified & {500, 501, 502} and len(identified) >= 295
    assert not quality & set(range(400, 500)) and len(quality) >= 235
    lost = quality - exact
    assert lost == {i if len(dict_text(spark, sf_dir, i)) < len(dict_text(spark, sf_dir, j)) else j for i, j in ((k, 300 + k) for k in range(20)) if {i, j} <= quality}
    gone = exact - near
    assert gone == {300 + i for i in range(20, 40) if {i, 300 + i} <= exact}


def dict_text(spark, sf_dir, doc):
    if not hasattr(dict_text, "held"):
        dict_text.held = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return dict_text.held[doc]


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert all(r.offset + r.length <= 1024 for r in rows)


def test_stages_decide_about_rows(spark, sf_dir):
    """Repeated ids, rows without an id and repeated rows, in the stages that drop copies."""
    long = " ".join(f"word{i}" for i in range(50))
    rows = [(0, "same text"), (1, "same text"), (1, "unique text"), (5, "rep"), (5, "rep"), (None, "nn"), (None, "nn"), (9, long), (9, long.replace("word7 ", "")), (9, "something else")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact, near = (stage for _, stage in corpus_pipeline.STAGES[2:4])
    left = near(spark, spark.createDataFrame(exact(spark, docs, sf_dir).collect(), docs.schema), sf_dir)
    got = sorted((str(r.doc_id), r.text) for r in left.collect())
    assert left.columns == docs.columns and len(got) == 6
    assert [t for _, t in got if t in ("same text", "unique text", "rep", "nn", "something else")] == ["same text", "unique text", "rep", "something else", "nn"]


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, sf_dir).collect() == []


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_run_equals_brute_force(spark, sf_dir):
    """All stages on plain lists, each on what its predecessor kept, against the rows of run()."""
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=str)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = language_id.fit(docs.where("doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"))
    rows = [r for r, rejected in zip(rows, fitted.judge([t or "" for _, t in rows])[2], strict=True) if not rejected]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    learned = sorted((d, t) for d, t in rows if d in labels and zlib.crc32(str(d).encode()) % 5)
    model = rule_ensemble.train(np.array([rule_ensemble.statistics(t) for _, t in learned]), np.array([float(labels[d]) for d, _ in learned]))
    rows = [r for r, s in zip(rows, model.score(np.array([rule_ensemble.statistics(t) for _, t in rows])), strict=True) if s >= 0.3]
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is not None, d or 0, t))
    rows = [(d if known else None, t) for _, known, d, t in map(min, groups.values())]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    root = list(range(len(order)))
    sets = [shingles(t) for _, t in order]
    for i in range(len(order)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [order[i] for i in sorted(set(root))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    pieces = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want) and len(rows) == len(want) > 180
    for doc, ids in want.items():
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)


def test_a_stage_leaves_only_its_result(spark, sf_dir):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, sf_dir)
    assert {n.rpartition("-")[0] for n in set(os.listdir(root)) - before} == {f"stage-{name}" for name, _ in corpus_pipeline.STAGES}
