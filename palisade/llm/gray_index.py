"""A hierarchical Hamming index over fingerprints in Gray order, as arrays.

Fingerprints sorted by Gray rank differ little from their neighbours.  Sixteen
of them share the bits that all have in common: a mask and a pattern, which is
a node of the level above; sixteen nodes again share what their patterns have in
common.  A search goes down two trees at once, adding up the differences on
the bits that become common at each level, and leaves a pair of nodes with all
their members as soon as the sum exceeds the radius.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Members of an index: three levels above the fingerprints.
CELL = FAN**3
#: Pairs of nodes that are opened at a time.
_AT_ONCE = 4096


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def build(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(patterns, masks) from the fingerprints up to a single root."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    for _ in range(3):
        patterns, masks = levels[-1]
        heads = np.arange(0, len(patterns), FAN)
        first = np.repeat(patterns[heads], np.diff(np.append(heads, len(patterns))))
        common = np.bitwise_and.reduceat(masks, heads) & ~np.bitwise_or.reduceat(patterns ^ first, heads)
        levels.append((patterns[heads] & common, common))
    return levels


def _differences(a, b, i, j, but=None):
    common = a[1][i] & b[1][j]
    if but is not None:
        common &= ~but
    return np.bitwise_count((a[0][i] ^ b[0][j]) & common)


def search(a: list, b: list, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints at most ``radius`` apart; ``same``: of one index, i < j."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def down(level: int, i: np.ndarray, j: np.ndarray, sums: np.ndarray) -> None:
        if level == 0:
            found.append((i, j))
            return
        (pa, pb), (ca, cb) = (a[level], b[level]), (a[level - 1], b[level - 1])
        for at in range(0, len(i), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            kids = np.arange(FAN)
            ci = (i[part, None, None] * FAN + kids[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            cj = (j[part, None, None] * FAN + kids[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            owner = np.broadcast_to(np.arange(at, min(at + _AT_ONCE, len(i)))[:, None, None], ci.shape).ravel()
            ci, cj = ci.ravel(), cj.ravel()
            ok = (ci < len(ca[0])) & (cj < len(cb[0]))
            if same:
                ok &= ci < cj if level == 1 else ci <= cj
            ci, cj, owner = ci[ok], cj[ok], owner[ok]
            above = pa[1][i[owner]] & pb[1][j[owner]]
            more = sums[owner] + _differences(ca, cb, ci, cj, above)
            near = more <= radius
            if near.any():
                down(level - 1, ci[near], cj[near], more[near])

    root = np.zeros(1, np.int64)
    sums = _differences(a[3], b[3], root, root).astype(np.int64)
    if sums[0] <= radius:
        down(3, root, root, sums)
    if not found:
        return root[:0], root[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component, given links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
