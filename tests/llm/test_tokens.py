import random

import public_tokenizers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecspark.llm.tokens import WordTokenizer

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Ours and the library's as it is; and both with the strings of special tokens as plain text.
KINDS = [(WordTokenizer(public_tokenizers.path(n)), Tokenizer.from_file(public_tokenizers.path(n))) for n in NAMES]
PLAIN = [(WordTokenizer(public_tokenizers.path(n), plain_special=True), Tokenizer.from_file(public_tokenizers.path(n))) for n in NAMES]
for _, t in PLAIN:
    t.encode_special_tokens = True


def same(text):
    for ours, library in KINDS + PLAIN:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["", " ", "\n", "a  b", "a \n b", "a\n\nb ", "  lead", "tail  \t", "don't we'LL 's", "x\x1cy \x1c z\x1d", "İstanbul ΣΣ é ́", " a  b　c ", "<|endoftext|> a<|startoftext|>", "日本語 テキスト", "12345 6 ½ ²", "×÷ª²³¹º", "\u0000\x7f\x80\x85\x9f", "🙂🙃 x", "ǅ ß ẞ ﬁ", "a <|endoftext|> b", "<|endoftext|>", "don't<|startoftext|>İ <|endoftext|>  x", "<|endoftext|", "''s'S 're'", "a_b__1²³"])
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'ab1é.#\x1c\xa0")), max_size=60))
def test_any_text(text):
    same(text)


def test_words():
    rng = random.Random(5)
    same(" ".join("".join(rng.choice("abcdetions'.,é1") for _ in range(rng.randint(1, 12))) for _ in range(3000)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "a", "É", "İ", "'s", "\n", "<|", "9"]), max_size=12))
def test_special_strings(parts):
    same("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x12F), max_size=40))
def test_plain_characters(text):
    same(text)


def test_a_full_memory(monkeypatch):
    monkeypatch.setattr("vecspark.llm.tokens.REMEMBERED", 3)
    for text in ("one two three four five", "İone İtwo İthree İfour İfive", "one İtwo") * 2:
        same(text)
