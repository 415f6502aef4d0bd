import random
import re
from collections import Counter
from math import log2

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm.fertility import LEAST_SPREAD, PRIOR, PieceTokenizer, base_counts, fertility_rules, script_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS, LIBRARY = PieceTokenizer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a  b   c ", "x\ny\n\n z", "\n", " \n ", "日本 語\tq", "▁x ▁", "é" * 50, "trailing   ", "🙂 🙃"])
def test_cases(text):
    assert OURS.encode(text).tolist() == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), st.sampled_from(" \n\tab1é.#")), max_size=50))
def test_any_text(text):
    assert OURS.encode(text).tolist() == LIBRARY.encode(text)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_base_counts():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 16, 40, 400):
        for vocabulary in (1, 2, 3, 50):
            text = "".join(f"w{rng.randrange(vocabulary)}é{rng.choice([' ', chr(10), '  ', chr(11), ' # '])}" for _ in range(n))
            assert base_counts(text) == brute(text)


@pytest.mark.parametrize(("text", "script"), [("", "none"), ("123 !", "none"), ("abc", "latin"), ("naïve", "latin"), ("привет a", "cyrillic"), ("漢字漢字かな", "han"), ("ありがとう", "kana"), ("한국어", "hangul"), ("ελληνικά", "greek")])
def test_scripts(text, script):
    assert script_of(text) == script


def test_rules(spark):
    rng = random.Random(2)
    words = ["water", "people", "little", "sound", "great", "where", "through", "sentence", "before", "right", "picture", "again", "house", "animal", "point", "mother", "world", "country"]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", "s"]) for _ in range(100)), "en") for i in range(200)]
    noise = [(1000 + i, " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) if rng.random() < 0.5 else chr(rng.randrange(0x13A0, 0x13F0)) for _ in range(3)) for _ in range(100)), "en") for i in range(3)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "one two", "xx"), (2003, "same words in a line that come again and again\n" * 30, "en"), (2004, "long text of words " + " ".join(rng.choice(words) for _ in range(60_000)), None), (None, clean[0][1], "en"), (2005, clean[1][1], None)]
    rows = clean + noise + odd
    df = spark.createDataFrame([(*r, "c", 1.5) for r in rows], "doc_id long, text string, lang string, script string, entropy double")
    got = {r.doc_id: r for r in fertility_rules(df, PATH).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        ids = LIBRARY.encode(text or "")
        assert r.n_tokens == len(ids)
        if ids:
            assert abs(r.entropy + sum(c / len(ids) * log2(c / len(ids)) for c in Counter(ids).values())) < 1e-9
    assert sum(got[d].kept for d, _, _ in clean) >= 190 and not any(got[d].kept for d, _, _ in noise)
    assert got[2000].reason == got[2003].reason == "base" and got[None].kept


def test_no_rows(spark):
    assert fertility_rules(spark.createDataFrame([], "doc_id long, text string, lang string"), PATH).collect() == []


def test_junk_in_small_groups(spark):
    rng = random.Random(5)
    words = ["water", "people", "little", "sound", "great", "where", "through", "sentence", "before", "right", "picture", "again", "house", "animal", "point", "mother", "world", "country"]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", "s"]) for _ in range(100)), "en") for i in range(200)]
    junk = lambda: " ".join("".join(rng.choice("qxzjkv") for _ in range(5)) for _ in range(100))
    rows = [*clean, (1000, junk(), "en"), (1001, junk(), "xx"), (1002, junk(), None), (1003, " ".join([junk() for _ in range(100)]), "en"), (1004, clean[0][1], "yy"), (1005, clean[1][1], None)]
    got = {r.doc_id: r for r in fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert not any(got[i].kept for i in (1000, 1001, 1002, 1003))
    assert got[1004].kept and got[1005].kept and sum(got[i].kept for i in range(200)) >= 190


def test_verdicts_equal_brute_force(spark):
    """The bands and verdicts by their definitions, on plain lists."""
    rng = random.Random(11)
    words = ["water", "people", "little", "sound", "great", "where", "through", "sentence", "before", "right", "picture", "again", "house", "animal"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "xx", None])
        own = rng.choice([words, words, words, ["qxz", "zkvj", "xqq", "jjkz"], ["привет", "мир", "слово", "хлеб", "дом"]])
        rows.append((i, " ".join(rng.choice(own) + rng.choice(["", "", ".", "7"]) for _ in range(rng.choice([10, 40, 90, 200]))), lang))
    got = {r.doc_id: r for r in fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    middle = lambda xs: sorted(xs)[-(-len(xs) // 2) - 1]
    keys = {i: (got[i].script, lang, int(log2(got[i].n_tokens + 1))) for i, _, lang in rows}
    base = {i for i in keys if not got[i].base_failed}
    bands = {}
    for figure, least in LEAST_SPREAD.items():
        value = {i: getattr(got[i], figure) for i in keys}
        for kind in (0, 1, 2, 3):
            groups = {}
            for i in base:
                groups.setdefault(keys[i][:kind], []).append(value[i])
            for key, xs in groups.items():
                mid = middle(xs)
                own = mid, max(least, 1.4826 * middle([abs(x - mid) for x in xs]))
                wide = bands.get((figure, key[:-1])) if kind else own
                bands[figure, key] = tuple((len(xs) * a + PRIOR * b) / (len(xs) + PRIOR) for a, b in zip(own, wide, strict=True))
    kept = 0
    for i in keys:
        if got[i].base_failed:
            assert not got[i].kept
            continue
        off = {f: (getattr(got[i], f) - bands[f, keys[i]][0]) / bands[f, keys[i]][1] for f in LEAST_SPREAD}
        want = (min(off["chars_per_token"], 0) ** 2 + min(off["entropy"], 0) ** 2) ** 0.5 <= 3.5 and max(off.values()) <= 8
        assert got[i].kept == want, (i, off)
        kept += want
    assert 20 < kept < len(base)
