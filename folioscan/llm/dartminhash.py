"""Weighted MinHash by darts, for many sets at once.

Every element has its own endless sequence of random darts on a board of weight
and rank, the same wherever the element occurs. A set sees the darts that fall
below its weight of the element, and only those of low rank, about ``THETA`` in
all: that bound falls with the set's total weight, so large sets cost one look
at each element. Each dart names one of ``k`` coordinates, and the earliest
dart of a coordinate is its value. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Sets with a coordinate that
no dart has hit look at twice as many; the darts they have seen stay the same.

The board is cut along the weight axis at 1, 2, 4, ...; in each strip the ranks
of an element's darts are the sums of exponential gaps, drawn from hashes.
"""

from __future__ import annotations

import numpy as np

from folioscan.llm.textscan import mix64

#: Throws that are looked at together.
AT_ONCE = 1 << 15
_STRIP, _TURN, _PLACE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def _times(n: int, odd: int) -> np.uint64:
    return np.uint64(n * odd & 0xFFFFFFFFFFFFFFFF)


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _throw(best: np.ndarray, k: int, elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> None:
    """Darts of all elements up to their rank bounds; best, owner * k + coordinate -> (rank bits, dart), gets the least."""
    strip, low, light = 0, 0.0, bool((weight < 1).any())
    while len(elements):
        high = 1.0 if strip == 0 else low * 2
        seed = mix64(elements ^ _times(strip + 1, _STRIP))
        rank = np.zeros(len(elements))
        which = np.arange(len(elements))
        turn = 0
        while len(which):
            # Several throws of each element at once where few elements are left, as when one of them holds most of the weight.
            some = max(1, min(64, AT_ONCE // len(which)))
            turns = np.arange(turn + 1, turn + some + 1, dtype=np.uint64)
            turn += some
            h = mix64(seed[which][:, None] + (turns * np.uint64(_TURN))[None, :])
            ranks = np.concatenate([rank[which][:, None], -np.log(_uniform(h)) / (high - low)], 1).cumsum(1)[:, 1:]
            inside = ranks < bound[which][:, None]
            rank[which] = ranks[:, -1]
            row, column = np.nonzero(inside)
            seen, value = which[row], ranks[row, column]
            dart = mix64(seed[seen] ^ (turns * np.uint64(_PLACE))[column])
            which = which[inside[:, -1]]
            if high > 1 or light:
                under = low + _uniform(mix64(dart + np.uint64(_STRIP))) * (high - low) <= weight[seen]
                seen, dart, value = seen[under], dart[under], value[under]
            place = owner[seen] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, place, (value.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF)))
        more = weight > high
        elements, owner, weight, bound = elements[more], owner[more], weight[more], bound[more]
        strip, low = strip + 1, high


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """n x k values of n sets; set j holds the ``elements`` (64-bit hashes, distinct within a set) whose ``owner`` is j.

    weight: of each element, above 0; 1 by default. Rows of empty sets are all ones.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    weight = np.ones(len(elements)) if weight is None else weight.astype(np.float64)
    total = np.bincount(owner, weight, n)
    best = np.full(n * k, none, np.uint64)
    theta = k * (np.log(k) + 3)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        at = owner[mine]
        _throw(best, k, elements[mine], at, weight[mine], theta / total[at])
        todo = todo & (best.reshape(n, k) == none).any(1)
        theta *= 2
    return (best & np.uint64(0xFFFFFFFF)).reshape(n, k)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """Signed 64-bit keys of runs of ``rows`` coordinates; different bands have different keys."""
    n, k = signature.shape
    bands = k // rows
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for r in range(rows):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return h.view(np.int64)
