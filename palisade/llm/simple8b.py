"""Simple-8b: integers packed into 64-bit words.

The top four bits of a word select how many values it holds and of how many
bits each; a value too wide for any of them is escaped: selector 0, and the
value in the word that follows.  Packing is greedy, as many values to a word as
fit.  Both directions work on whole arrays.
"""

from __future__ import annotations

import numpy as np

#: Selector -> (values in a word, bits of each).  0 is the escape.
SELECTORS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
#: First value too wide for each selector but the escape, narrow selectors first.
_TOO_WIDE = np.array([1 << bits for _, bits in SELECTORS[1:]], np.uint64)
_MOST = max(n for n, _ in SELECTORS)
#: The narrowest selector that takes a value, of values below 65,536.
_NARROWEST = (np.searchsorted(_TOO_WIDE, np.arange(1 << 16, dtype=np.uint64), "right") + 1).astype(np.uint8)


def _choices(values: np.ndarray) -> np.ndarray:
    """The best selector at each place: the one that takes the longest run of narrow enough values.

    The widest value of each run comes from two shorter runs; where no run of a
    length fits, no longer one does.
    """
    n = len(values)
    widest = np.zeros(n + _MOST, np.uint8)  # of the run at each place, as the narrowest selector that takes it
    widest[:n] = _NARROWEST[values] if values.max() < len(_NARROWEST) else np.searchsorted(_TOO_WIDE, values, "right") + 1
    choice, run = np.zeros(n, np.uint8), 1
    for selector in range(len(SELECTORS) - 1, 0, -1):
        more = SELECTORS[selector][0] - run
        if more:
            widest = np.maximum(widest[: len(widest) - more], widest[more:])
            run += more
        fits = widest[:n] <= selector
        if not fits.any():
            break
        np.copyto(choice, selector, where=fits)
    return choice


def _starts(choice: np.ndarray, real: np.ndarray, width: int) -> np.ndarray:
    """Where words start: each group of ``width`` places has a first word, and a word that ends in padding is its last.

    Only every eighth start is walked to; the others follow from those at once.
    """
    n = len(choice)
    here = np.arange(n)
    one = np.append(here + _COUNTS[choice], n)
    one[:n] = np.where(np.append(real, np.zeros(_MOST, bool))[one[:n]], one[:n], (here // width + 1) * width)
    two = one[one]
    four = two[two]
    eight = memoryview(four[four])
    walked, at = [], 0
    while at < n:
        walked.append(at)
        at = eight[at]
    starts = np.array(walked, np.int64)
    for jump in (four, two, one):
        starts = np.concatenate([starts, jump[starts]])
    starts.sort()
    return starts[: np.searchsorted(starts, n)]


def pack(values: np.ndarray) -> np.ndarray:
    """64-bit words of unsigned values.  Unused places of the last word are zero."""
    return pack_groups(values, max(1, len(values)))[0]


def pack_groups(values: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the values, and the first word of each group of values, which starts on a word of its own."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # Padding behind each group, so that no word goes on into the next one.
    n_groups, width = -(-n // group), group + _MOST
    where = np.arange(n)
    where += where // group * _MOST
    padded = np.zeros(n_groups * width + _MOST, np.uint64)
    padded[where] = values
    real = np.zeros(n_groups * width, bool)
    real[where] = True
    choice = _choices(padded[: n_groups * width])
    starts = _starts(choice, real, width)
    chosen = choice[starts]
    length = 1 + (chosen == 0)
    place = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[place[own] + 1] = padded[starts[own]]
            continue
        each, shifts = _lanes(selector)
        word = np.bitwise_or.reduce(padded[starts[own] + each] << shifts, axis=0)
        words[place[own]] = word | np.uint64(selector << 60)
    return words, place[np.searchsorted(starts, np.arange(n_groups) * width)]


def _lanes(selector: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and shifts of the values in a word, as columns."""
    count, bits = SELECTORS[selector]
    each = np.arange(count)[:, None]
    return each, (each * bits).astype(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    heads = np.arange(len(words))
    if (selectors == 0).any():
        # A raw word may look like anything: it is one that follows an escape that isn't raw itself.
        raw = np.zeros(len(words), bool)
        for at in np.flatnonzero(selectors == 0).tolist():
            if not raw[at]:
                raw[at + 1] = True
        heads = np.flatnonzero(~raw)
    chosen = selectors[heads]
    counts = _COUNTS[chosen]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == selector)
        if selector == 0:
            out[place[own]] = words[heads[own] + 1]
            continue
        each, shifts = _lanes(selector)
        mask = np.uint64((1 << SELECTORS[selector][1]) - 1)
        out[place[own] + each] = (words[heads[own]] >> shifts) & mask
    return out[:n]
