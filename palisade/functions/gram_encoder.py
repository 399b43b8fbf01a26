"""Gram counting, vectorised over the texts of an Arrow batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd

from palisade import fixed_values as fv

#: Texts are counted in groups of so many characters, each of which takes some hundred bytes.
_ROW_GROUP_CHARS = 1_000_000
_BLOCK_CHARS = 1_000_000
_SIZES = range(fv.GRAM_MIN, fv.GRAM_MAX + 1)
MAX_ALPHABET = 0xFFFF
#: Most places of a table of grams.
_TABLE = 4_000_000


def _spaced(texts: list[str]) -> list[str]:
    return [f" {' '.join(t.split())} " for t in texts]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _pack(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit code per row of up to four 16-bit ids."""
    code = columns[0].astype(np.uint64)
    for column in columns[1:]:
        code = (code << np.uint64(16)) | column
    return code


def row_groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in groups of bounded size, with the number of the first."""
    first, group, chars = 0, [], 0
    for i, text in enumerate(texts):
        if group and chars + len(text) > _ROW_GROUP_CHARS:
            yield first, group
            first, group, chars = i, [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield first, group


def _count_keys(keys: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    if bins <= 4 * len(keys):
        counts = np.bincount(keys, minlength=bins)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(keys, return_counts=True)


def _grams_in(texts: list[str], alphabet: np.ndarray) -> list[str]:
    """The distinct grams of a group of texts that uses the given characters."""
    ids = np.zeros(0x110000, dtype=np.uint16)
    ids[alphabet] = np.arange(len(alphabet))
    ids, space = ids[_code_points("".join(_spaced(texts)))], ids[ord(" ")]
    symbols = [chr(c) for c in alphabet]
    grams = []
    for size in _SIZES:
        codes = np.zeros(0, dtype=np.uint64)
        for start in range(0, len(ids) - size + 1, _BLOCK_CHARS):
            stop = min(start + _BLOCK_CHARS, len(ids) - size + 1)
            columns = [ids[start + k : stop + k] for k in range(size)]
            in_word = ~((columns[0] == space) & (columns[1] == space))
            for inner in columns[1:-1]:
                in_word &= inner != space
            codes = np.union1d(codes, _pack([c[in_word] for c in columns]))
        for code in codes.tolist():
            shifts = range(16 * (size - 1), -1, -16)
            grams.append("".join(symbols[(code >> shift) & 0xFFFF] for shift in shifts))
    return grams


def _dense_counts(texts: list[str], alphabet: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """The result of :func:`_count_all`, by tables instead of sorts; None where a table would be large.

    A gram is its first characters' number times the alphabet plus its last character, and
    the numbers that occur are made dense again before the next character.
    """
    spaced, n_chars = _spaced(texts), len(alphabet)
    lens = [len(s) for s in spaced]
    if sum(lens) > 2 * _BLOCK_CHARS:
        return None
    ids = np.zeros(0x110000, dtype=np.int32)
    ids[alphabet] = np.arange(n_chars)
    space, ids = ids[ord(" ")], ids[_code_points("".join(spaced))]
    row_of = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    symbols = [chr(c) for c in alphabet]
    inside, prefix, names, all_names, found = ids != space, ids, symbols, [], []
    for size in range(2, _SIZES[-1] + 1):
        if len(names) * n_chars > _TABLE:
            return None
        codes = prefix[: len(ids) - size + 1] * np.int32(n_chars) + ids[size - 1 :]
        if size == 2:  # all but two spaces
            in_word = inside[:-1] | inside[1:]
        else:
            in_word = in_word[: len(codes)] & inside[size - 2 : size - 2 + len(codes)]
        at = np.flatnonzero(in_word)
        if not len(at):
            break
        present = np.zeros(len(names) * n_chars, dtype=bool)
        present[codes[at]] = True
        prefix = np.maximum(np.cumsum(present, dtype=np.int32) - 1, 0)[codes]  # outside words any number
        names = [names[code // n_chars] + symbols[code % n_chars] for code in np.flatnonzero(present).tolist()]
        if size in _SIZES:
            found.append((row_of[at], prefix[at] + np.int32(len(all_names))))
            all_names += names
    size_v = len(all_names)
    if not size_v:
        empty = np.zeros(0, dtype=np.int64)
        return [], empty, empty, empty
    keys = np.concatenate([row * np.int64(size_v) + gram for row, gram in found])
    del found
    keys, tf = _count_keys(keys, len(texts) * size_v)
    return all_names, keys // size_v, keys % size_v, tf


def _plain_counts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The result of :func:`_count_all` for texts with more characters than ids."""
    counts = [
        Counter(w[i : i + n] for w in padded for n in _SIZES for i in range(len(w) - n + 1))
        for padded in ([f" {w} " for w in t.split()] for t in texts)
    ]
    grams = sorted(set().union(*counts))
    at = {gram: i for i, gram in enumerate(grams)}
    entries = [(row, at[g], n) for row, count in enumerate(counts) for g, n in count.items()]
    row, gram, tf = np.array(entries, dtype=np.int64).reshape(-1, 3).T
    return grams, row, gram, tf


def _count_all(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(grams, row, gram index, count) of every gram in a group of texts."""
    present = np.zeros(0x110000, dtype=bool)
    present[ord(" ")] = True
    for text in texts:
        present[_code_points(text)] = True
    alphabet = np.flatnonzero(present)
    if len(alphabet) > MAX_ALPHABET:
        return _plain_counts(texts)
    dense = _dense_counts(texts, alphabet)
    if dense is not None:
        return dense
    grams = _grams_in(texts, alphabet)
    none = np.zeros(len(grams))
    return grams, *GramEncoder(grams, none, none).count_group(texts)


def gram_groups(texts: list[str]) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, grams, row, gram index, count) of every group of texts, in row order."""
    for first, group in row_groups(texts):
        yield first, len(group), *_count_all(group)


def gram_counts(texts: list[str], known=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, gram, count) arrays of all grams, or those that ``known`` lets through, per group of texts."""
    for first, _, grams, row, gram, tf in gram_groups(texts):
        if known is not None and grams:
            kept = known(grams)[gram]
            row, gram, tf = row[kept], gram[kept], tf[kept]
        yield first + row, np.array(grams, dtype=object)[gram], tf


def gram_document_counts(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Grams, and in how many of the texts each occurs, per group of texts."""
    for _, _, grams, _, gram, _ in gram_groups(texts):
        yield grams, np.bincount(gram, minlength=len(grams))


class GramEncoder:
    """Counts vocabulary grams per text with array operations only.

    Characters become 16-bit ids (0: not in the vocabulary), a gram of n
    characters becomes n ids in one 64-bit code, and each size has its own
    sorted code table.  Words are joined by single spaces with a space at both
    ends: the windows that are no gram of one word then hold a space inside, and
    no vocabulary gram does.
    """

    def __init__(self, grams: list[str], idf: np.ndarray, weight: np.ndarray):
        alphabet = sorted(set("".join(grams)))
        if len(alphabet) > MAX_ALPHABET:
            raise ValueError("alphabet too large for 16-bit ids")
        self.idf = np.asarray(idf, dtype=np.float64)
        self.weight = np.asarray(weight, dtype=np.float64)
        self._char_id = np.zeros(0x110000, dtype=np.uint16)
        self._char_id[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self._codes, self._positions = {}, {}
        for size in _SIZES:
            positions = np.array([i for i, g in enumerate(grams) if len(g) == size], dtype=np.int64)
            ids = self._ids("".join(grams[i] for i in positions)).reshape(-1, size)
            codes = _pack([ids[:, k] for k in range(size)])
            order = np.argsort(codes)
            self._codes[size], self._positions[size] = codes[order], positions[order]

    @staticmethod
    def alphabet_fits(grams: pd.Series) -> bool:
        return len(set("".join(grams))) <= MAX_ALPHABET

    def _ids(self, text: str) -> np.ndarray:
        return self._char_id[_code_points(text)]

    def count_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, gram index, count) for a group of texts, in row and gram order."""
        spaced = _spaced(texts)
        ids = self._ids("".join(spaced))
        row_of = np.repeat(np.arange(len(texts)), [len(s) for s in spaced])
        size_v = len(self.idf)
        found, counts = [], []
        for start in range(0, len(ids), _BLOCK_CHARS):
            keys = []
            for size in _SIZES:
                table = self._codes[size]
                stop = min(start + _BLOCK_CHARS, len(ids) - size + 1)
                if stop <= start or not len(table):
                    continue
                codes = _pack([ids[start + k : stop + k] for k in range(size)])
                at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
                hit = np.flatnonzero(table[at] == codes)
                keys.append(row_of[start + hit] * size_v + self._positions[size][at[hit]])
            if keys:
                k, c = _count_keys(np.concatenate(keys), len(texts) * size_v)
                found.append(k)
                counts.append(c)
        if not found:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty
        if len(found) > 1:  # the same gram may occur in several blocks of a text
            keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
            tf = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        else:
            keys, tf = found[0], counts[0]
        return keys // size_v, keys % size_v, tf

    def tfidf(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per group of rows: first row, row count, and (row, gram, value) arrays.

        The value is (1 + ln tf) * idf over the L2 norm of its row.
        """
        for first, group in row_groups(texts):
            row, gram, tf = self.count_group(group)
            value = (1.0 + np.log(tf)) * self.idf[gram]
            norm = np.sqrt(np.bincount(row, value * value, minlength=len(group)))
            yield first, len(group), row, gram, value / norm[row] if len(row) else value

    def dot(self, texts: list[str]) -> np.ndarray:
        """Weighted sum of the normalised tf-idf values of each text."""
        parts = [
            np.bincount(row, value * self.weight[gram], minlength=n)
            for _, n, row, gram, value in self.tfidf(texts)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)

    def sparse_rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Gram indices and values of each text, as two lists of arrays."""
        indices, values = [], []
        for _, n, row, gram, value in self.tfidf(texts):
            cuts = np.searchsorted(row, np.arange(1, n))
            indices += np.split(gram.astype(np.int32), cuts)
            values += np.split(value, cuts)
        return indices, values
