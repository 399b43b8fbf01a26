"""Encoding long texts through a bounded memory of what their pieces encode to.

Byte-pair encoders split a text before they merge, and none of the vocabularies
used here ever joins across a single space that stands between two characters
other than white space.  So a text may be cut at such spaces, each piece
encoded once, and the ids joined.  Natural text repeats its pieces so much
that this saves most of the encoder's work, with the same ids.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

#: Characters that count as white space in at least one of the pre-tokenizers, but for the space.
_SPACES = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_BEFORE = [c + " " for c in (" ", *_SPACES)]
_ASCII_BEFORE = [p for p in _BEFORE if p.isascii()]
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at its single spaces, which are left out."""
    if text.isprintable():  # no white space but spaces
        return _CUT.split(text) if "  " in text else text.split(" ")
    for pair in _ASCII_BEFORE if text.isascii() else _BEFORE:
        if pair in text:
            return _CUT.split(text)
    return text.split(" ")


@contextmanager
def _no_cycle_search() -> Iterator[None]:
    """Encoding makes very many small lists and no cycles: searches for those, as lists come and go, find nothing."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


#: Texts are encoded in groups of about this many characters.
_GROUP = 1 << 19


class _Memory(dict):
    """Pieces and their places in ``codes``; a piece that is asked for and not there gets the next place."""

    def __init__(self):
        self.codes: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class UnitCoder:
    """Ids of texts, through ``encode_many`` for pieces not seen lately.

    ``encode_many`` maps strings to sequences of ids.  The memory has a young
    and an old half.  When the young one has more than ``limit`` pieces after a
    group of texts it becomes the old one, and pieces met again are taken over.
    That bounds what is held and changes nothing but speed.
    """

    def __init__(self, encode_many: Callable[[list[str]], Sequence[Sequence[int]]], limit: int = 300_000, fold=None):
        self.encode_many, self.limit, self.fold = encode_many, limit, fold
        self.young, self.old = _Memory(), _Memory()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        with _no_cycle_search():
            out = self._coded(texts)
        yield from out

    def _coded(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(self.fold(text) if self.fold else text) for text in texts]
        heads = self._bytes([one.pop(0) for one in cut])
        young, old = self.young, self.old
        places = [list(map(young.__getitem__, one)) for one in cut]
        known = list(map(old.get, young.new))
        coded = iter(self._bytes([" " + p for p, place in zip(young.new, known) if place is None]))
        young.codes += [next(coded) if place is None else old.codes[place] for place in known]
        young.new.clear()
        code = young.codes.__getitem__
        out = [head + b"".join(map(code, one)) for head, one in zip(heads, places)]
        if len(young) > self.limit:
            self.old, self.young = young, _Memory()
        return out

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.encode_many(texts)] if texts else []


_coders: dict[str, UnitCoder] = {}
#: The look behind comes second, so that the search goes from point to point and not over every character.
_POINT, _COMMA = (re.compile(rf"{c}(?<=[^\W\d_].)(?=\s|$)") for c in (r"\.", ","))
#: A byte as the character that byte-level vocabularies write for it.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip(_PRINTED, map(chr, _PRINTED))) | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)
}


def spread_words(text: str) -> str:
    """A text of the same ids for a lower-case vocabulary that drops white space.

    Lower-cased, with line breaks as spaces and points and commas apart from
    the word before them, so that pieces are mostly bare words.  Texts that case
    folding could change in another way than the encoder does are left alone.
    """
    if not text.isascii():
        lower = text.lower()
        if "\u03a3" in text or "\u0130" in text or not all(unicodedata.is_normalized("NFC", t) for t in (text, lower)):
            return text
        text = lower
    return _COMMA.sub(" ,", _POINT.sub(" .", text.lower().replace("\n", " ")))


def word_coder(path: str) -> UnitCoder:
    """The tokenizers library's coder for a file whose pre-tokens are words without white space.

    Bare lower-case words go to the file's model at once; everything else goes
    through the whole encoder.  One per Python worker.
    """
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        merge = tokenizer.model.tokenize

        def encode(texts: list[str]) -> list[list[int]]:
            out: list = [None] * len(texts)
            other = []
            for i, text in enumerate(texts):
                word = text[1:] if text[:1] == " " else text
                if not word.isalpha():
                    other.append(i)
                elif word.isascii():
                    out[i] = [t.id for t in merge(word.lower())]
                elif word == word.lower() and unicodedata.is_normalized("NFC", word):
                    out[i] = [t.id for t in merge(word.encode().decode("latin-1").translate(_BYTE_CHARS))]
                else:
                    other.append(i)
            if other:
                for i, e in zip(other, tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
                    out[i] = e.ids
            return out

        _coders[path] = UnitCoder(encode, fold=spread_words)
    return _coders[path]
