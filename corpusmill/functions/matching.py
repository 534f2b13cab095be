"""How many characters of two texts stand in matching blocks, for many pairs of texts at once."""

from __future__ import annotations

import numpy as np

# Run lengths that are looked for in turn, how many equal places are laid out at once, and how many characters go on together.
LENGTHS = (8, 4, 2, 1)
AT_ONCE = 1 << 20
TOGETHER = 1 << 16


def _ranks(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each of LENGTHS, a number at every place that is equal where as many following characters are (short ends aside)."""
    ranks, k = {1: np.unique(codes, return_inverse=True)[1].astype(np.int64)}, 1
    while k < LENGTHS[0]:
        r = ranks[k]
        both = r * (int(r.max(initial=0)) + 1)
        both[: max(len(r) - k, 0)] += r[k:]
        k *= 2
        ranks[k] = np.unique(both, return_inverse=True)[1].astype(np.int64)
    return ranks


def _places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from lo up to hi of each box, and their boxes."""
    n = np.maximum(hi - lo, 0)
    box = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n) + lo[box], box


def _runs(codes: np.ndarray, rank: np.ndarray, k: int, boxes: np.ndarray) -> np.ndarray:
    """Rows box, i, j, length: every run of k equal characters or more that cannot be made longer in its box."""
    alo, ahi, blo, bhi = boxes
    a, abox = _places(alo, ahi - k + 1)
    b, bbox = _places(blo, bhi - k + 1)
    kinds = int(rank.max(initial=0)) + 1
    akey, bkey = abox * kinds + rank[a], bbox * kinds + rank[b]
    order = np.argsort(bkey, kind="stable")
    b, bkey = b[order], bkey[order]
    first = np.searchsorted(bkey, akey, "left")
    n = np.searchsorted(bkey, akey, "right") - first
    some = n > 0
    a, abox, first, n = a[some], abox[some], first[some], n[some]
    cuts = np.searchsorted(np.cumsum(n), np.arange(AT_ONCE, int(n.sum()) + AT_ONCE, AT_ONCE), "right")
    begins, ends = [], []
    for part in (slice(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True)):
        m = n[part]
        i, box = np.repeat(a[part], m), np.repeat(abox[part], m)
        j = b[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[part], m)]
        begin = (i == alo[box]) | (j == blo[box]) | (codes[i - 1] != codes[j - 1])
        end = (i + k == ahi[box]) | (j + k == bhi[box]) | (codes[np.minimum(i + k, len(codes) - 1)] != codes[np.minimum(j + k, len(codes) - 1)])
        begins.append(np.stack([box[begin], i[begin], j[begin]]))
        ends.append(np.stack([i[end], j[end]]))
    box, i, j = np.concatenate(begins, axis=1)
    ei, ej = np.concatenate(ends, axis=1)
    # Along a diagonal beginnings and ends alternate, so that sorted alike they meet.
    here, there = np.lexsort((i, j - i)), np.lexsort((ei, ej - ei))
    box, i, j, ei = box[here], i[here], j[here], ei[there]
    return np.stack([box, i, j, ei + k - i])


def matched(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For each pair, the characters in its matching blocks: the longest common run (the first in the left text, then in the right), then the same before and behind it.

    Runs of at least 8 characters are looked for first, shorter ones only in what these leave between them. All pairs go
    on together: a box is a stretch of a left and one of a right text, and each step parts every box at its longest run.
    """
    codes = np.frombuffer("".join([*(a for a, _ in pairs), *(b for _, b in pairs)]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    stops = np.cumsum([0, *(len(a) for a, _ in pairs), *(len(b) for _, b in pairs)])
    n = len(pairs)
    boxes, owner = np.stack([stops[:n], stops[1 : n + 1], stops[n : 2 * n], stops[n + 1 :]]), np.arange(n)
    total, ranks = np.zeros(n, dtype=np.int64), _ranks(codes)
    for k in LENGTHS:
        live = (boxes[0] < boxes[1]) & (boxes[2] < boxes[3])
        boxes, owner = boxes[:, live], owner[live]
        runs, rest = _runs(codes, ranks[k], k, boxes), []
        while runs.shape[1]:
            runs = runs[:, np.argsort(runs[0], kind="stable")]
            head = np.flatnonzero(np.diff(runs[0], prepend=-1))
            longest = np.repeat(np.maximum.reduceat(runs[3], head), np.diff(head, append=runs.shape[1]))
            box, i, j, size = runs[:, runs[3] == longest]
            first = np.lexsort((j, i, box))
            first = first[np.flatnonzero(np.diff(box[first], prepend=-1))]
            box, i, j, size = box[first], i[first], j[first], size[first]
            np.add.at(total, owner[box], size)
            rest.append((np.delete(boxes, box, axis=1), np.delete(owner, box)))
            alo, ahi, blo, bhi = boxes[:, box]
            boxes = np.concatenate([np.stack([alo, i, blo, j]), np.stack([i + size, ahi, j + size, bhi])], axis=1)
            owner = np.tile(owner[box], 2)
            # What is left of each other run lies wholly before or wholly behind the one taken.
            at = np.repeat(np.arange(len(box)), np.diff(head, append=runs.shape[1]))
            _, x, y, length = runs
            before = (x < i[at]) & (y < j[at])
            skip = np.where(before, 0, np.maximum(0, np.maximum((i + size)[at] - x, (j + size)[at] - y)))
            left = np.where(before, np.minimum(length, np.minimum(i[at] - x, j[at] - y)), length - skip)
            runs = np.stack([at + np.where(before, 0, len(box)), x + skip, y + skip, left])[:, left >= k]
        boxes, owner = np.concatenate([boxes, *(b for b, _ in rest)], axis=1), np.concatenate([owner, *(o for _, o in rest)])
    return total


def in_groups(pairs: list[tuple[str, str]]) -> np.ndarray:
    """matched(), with about TOGETHER characters at a time."""
    ends = np.cumsum([len(a) + len(b) for a, b in pairs])
    cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(pairs)]
    return np.concatenate([matched(pairs[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)])
