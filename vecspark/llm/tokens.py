"""Token ids of whole texts by the tokenizers library, with the ids of pieces kept.

A tokenizer that splits a text by a pattern before it merges gives each piece the same ids wherever it stands. So a text is
split by the tokenizer's own pattern, the ids of pieces are remembered, and only new pieces go to its model. Below U+0130 the
pattern's character classes are spelled out, which splits fast; a text with other characters is cut at white space, and
each new unit of it is encoded by the library as a whole. So is a text that holds the string of a special token.

An empty text has no ids. Texts are never null here: callers pass empty ones. A text's length is not limited, and what is
remembered is bounded by its number."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Pieces that are remembered; when full, the memory starts anew.
REMEMBERED = 400_000
#: White space as Unicode has it: fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Endings that both public tokenizers split off: fixed values.
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Texts below this character are in normal form C, and their lower case is that of each character alone.
PLAIN_BELOW = 0x130


def _class(kind: str) -> str:
    """The characters below PLAIN_BELOW of one Unicode category, for a regular expression's brackets."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c)).startswith(kind))


def _patterns() -> tuple[str, str]:
    """How the byte-level tokenizer, and the one that drops white space, split texts below PLAIN_BELOW."""
    letters, numbers = _class("L"), _class("N")
    others = f"[^{letters}{numbers}{SPACE}]+"
    return (f" ?[{letters}]+|{ENDINGS}| ?[{numbers}]+| ?{others}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+", f"[{letters}]+|[{numbers}]|{ENDINGS}|{others}")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else 256 and on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def shared_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process, so that what it remembers outlasts a task."""
    return WordTokenizer(path)


class _Pieces(dict):
    """The ids, as bytes, of pieces of plain texts; those of a new piece come from the tokenizer's model."""

    def __init__(self, model, n_ids: int):
        super().__init__()
        self.model, self.chars = model, _byte_chars()
        self.table = [_bytes([i]) for i in range(n_ids)]

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.chars))
        ids = self[piece] = self.table[found[0].id] if len(found) == 1 else b"".join([self.table[t.id] for t in found])
        return ids


class _Units(dict):
    """The ids, as bytes, of stretches between white space; a new one is encoded as a text."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = _bytes(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        return ids


class WordTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them. The string of a special token in a text is that
    token, as the library has it by default; with ``plain_special`` it is ordinary text."""

    def __init__(self, path: str, plain_special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [] if plain_special else [t.content for t in added.values()]
        self.lowers = self.tokenizer.normalizer is not None
        self.split = re.compile(_patterns()[self.lowers]).findall
        self.cut = re.compile(f"[^{SPACE}]+" if self.lowers else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.beyond = re.compile(f"[{chr(PLAIN_BELOW)}-{chr(sys.maxunicode)}]").search
        self.pieces = _Pieces(self.tokenizer.model, self.tokenizer.get_vocab_size())
        self.units = _Units(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        for known in (self.pieces, self.units):
            if len(known) > REMEMBERED:
                known.clear()
        if any(s in text for s in self.special):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not text.isascii() and self.beyond(text):
            return b"".join(map(self.units.__getitem__, self.cut(text)))
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower() if self.lowers else text)))
