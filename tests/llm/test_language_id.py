import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from vecspark.llm.language_id import DISCOUNT, HashTable, KneserNey, counted_grams, grams, identify, keep_identified, signs

SOUNDS = {"aa": ["ba", "da", "lo", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver", "ich"], "cc": ["при", "вет", "мир", "ста", "но"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make(n=240):
    rng, rows = random.Random(6), []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, sentence(rng, lang, rng.randint(30, 120)), lang))
    return rows


ODD = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "aa"), (1003, sentence(random.Random(1), "cc", 20_000), None), (None, "badalo miru", "aa"), (1004, "日本語" * 60, "aa"), (1005, "x", "bb"), (3, "badalo", "aa"), (3, "badalo", "aa")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_signs():
    assert "".join(map(chr, signs("Ab, c1É!"))) == "   ab c é "
    assert len(signs(" 1 ")) == 3 and len(signs("")) == 3 and len(grams(signs(""))) == 0
    assert signs("𝒳a").tolist()[3:] == [0xFFFF, ord("a")]


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = HashTable(keys[::2], np.arange(len(keys[::2]), dtype=float)[:, None], absent=-1)
    got = table.values[table.find(keys), 0]
    assert (got[::2] == np.arange(len(keys[::2]))).all() and (got[1::2] == -1).all()


def brute(counts, alphabet):
    """Interpolated Kneser-Ney by its definition, with counts of 4-grams and of types below."""
    orders = {4: Counter(counts)}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (alphabet + 1)
        followers = {g: c for g, c in orders[n].items() if g[:-1] == gram[:-1]}
        total = sum(followers.values())
        if not total:
            return p(gram[1:])
        return max(followers.get(gram, 0) - DISCOUNT, 0) / total + DISCOUNT * len(followers) / total * p(gram[1:])
    return p


def all_orders(grams_of, most=None):
    """All orders from counted 4-grams, or the most frequent of each."""
    out = []
    keys, counts = grams_of
    for n in (4, 3, 2, 1):
        _, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        kept = np.lexsort((keys, -counts))[:most]
        out.insert(0, (keys[kept], counts[kept].astype(float), np.bincount(at, counts)[at][kept]))
        keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
    return out


def test_models_by_definition():
    texts = {"aa": ["bada lo", "dalo miru ba"], "bb": ["sch ein ung", "badu ver"]}
    counted, plain = [], []
    for lang in texts:
        every = np.concatenate([grams(signs(t)) for t in texts[lang]])
        counted.append(np.unique(every, return_counts=True))
        plain.append(Counter("".join(map(chr, signs(t)[i : i + 4])) for t in texts[lang] for i in range(len(signs(t)) - 3)))
    model = KneserNey(list(texts), [all_orders(c) for c in counted])
    alphabet = len({g[-1] for c in plain for g in c})
    ps = [brute(c, alphabet) for c in plain]
    probes = ["bada lo", "schlo eq", "zzz"]
    got = model.entropies([signs(t) for t in probes])
    for text, row in zip(probes, got, strict=True):
        a = "".join(map(chr, signs(text)))
        for j, p in enumerate(ps):
            want = -sum(math.log(p(a[i : i + 4])) for i in range(len(a) - 3)) / (len(a) - 3)
            assert abs(row[j] - want) < 1e-5, (text, j)
    # Every distribution sums to one over the signs and the unknown.
    signs_seen = sorted({g[-1] for c in plain for g in c})
    assert abs(sum(ps[0]("ada" + s) for s in signs_seen) + ps[0]("ada￿") - 1) < 1e-9


def test_identify(spark):
    rows = make() + ODD
    got = identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, r in by.items():
        assert r.held_out == (doc is None or zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= r.score <= 1
    right = [by[d].lang_pred == lang for d, _, lang in make() if d != 3]
    assert sum(right) == len(right)
    assert sum(by[d].rejected for d, _, _ in make()) <= 2
    for d in (1000, 1001, 1002):
        assert by[d].lang_pred == "und" and by[d].rejected and by[d].score == 0
    assert by[1003].lang_pred == "cc" and by[1004].rejected and by[1004].lang_pred != "und" and by[1005].lang_pred in SOUNDS
    kept = keep_identified(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    verdicts = defaultdict(bool, {r.doc_id: r.rejected for r in got})
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _ in rows if not verdicts[d])


def test_result_does_not_depend_on_partitions(spark):
    rows = make(90)
    a = sorted(map(str, identify(frame(spark, rows)).collect()))
    assert a == sorted(map(str, identify(frame(spark, rows).repartition(7)).collect()))


def test_nothing_to_learn(spark):
    assert identify(frame(spark, [])).collect() == []
    got = identify(frame(spark, [(1, "text", None), (2, None, "aa")])).collect()
    assert all(r.lang_pred == "und" and r.rejected for r in got)
    assert keep_identified(frame(spark, [(1, "text", None)])).collect() == []


def test_counts_of_all_orders(spark):
    rows = [(lang, text) for _, text, lang in make(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for most in (10**6, 50):
        for lang, orders in counted_grams(df, most):
            want = all_orders(np.unique(np.concatenate([grams(signs(t)) for x, t in rows if x == lang]), return_counts=True), most)
            for got, expected in zip(orders, want, strict=True):
                assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in expected)))


def test_cut_models_still_sum_to_one():
    every = np.unique(np.concatenate([grams(signs(sentence(random.Random(2), "aa", 200)))]), return_counts=True)
    model = KneserNey(["aa"], [all_orders(every, 12)])
    alphabet = [chr(c) for c in range(97, 123)] + [" "]
    seen = {int(k) for k in all_orders(every, 12)[0][0]}
    for context in ("bad", "xyz", "  b"):
        p = sum(math.exp(model._look(np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context + s))], np.uint64), 4)[0, 0]) for s in alphabet)
        unknown = math.exp(model._look(np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context + "q"))], np.uint64), 4)[0, 0])
        known = sum(ord(s) in seen for s in alphabet)
        # Signs that were never seen have one share together.
        assert abs(p - (len(alphabet) - known - 1) * unknown - 1) < 1e-5
