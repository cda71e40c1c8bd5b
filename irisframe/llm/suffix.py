"""Suffix arrays and common prefixes of a shard of texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols in one sorting key: 7 of 9 bits each, 0 marks a text's end.
_WIDTH = 7
_BITS = 9
_LANE = 512


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each closed by 0, and where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.uint16) + 1
    symbols[starts + sizes - 1] = 0
    return symbols, starts


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The next 7 symbols of every place as one number, zero after a text's end."""
    padded = np.append(symbols, np.zeros(_WIDTH, dtype=np.uint16)).astype(np.uint64)
    keys, alive = np.zeros(len(symbols), dtype=np.uint64), np.ones(len(symbols), dtype=np.uint64)
    for k in range(_WIDTH):
        here = padded[k : k + len(symbols)] * alive
        alive *= here > 0
        keys = (keys << np.uint64(_BITS)) | here
    return keys


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, ends of texts ordered by place, and the keys.

    Larsson-Sadakane: suffixes sorted by h symbols are sorted by 2h with the ranks
    of the suffixes h further on; suffixes whose place is settled are left alone.
    """
    size = len(symbols)
    keys = _keys(symbols)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    # A key whose last symbol is 0 reaches its text's end, which is unlike all others.
    ended = (ordered & np.uint64((1 << _BITS) - 1)) == 0
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | ended[1:]))
    places = np.arange(size)
    ranks = np.empty(size, dtype=np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, places, 0))
    active = places[~(new & np.append(new[1:], True))]
    step = _WIDTH
    while len(active):
        at = order[active]
        key = (ranks[at].astype(np.uint64) << np.uint64(32)) | ranks[np.minimum(at + step, size - 1)].astype(np.uint64)
        # Groups come in rank order, which a merging sort makes use of.
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[active] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        ranks[at] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~(new & np.append(new[1:], True))]
        step *= 2
    return order, keys


def common_prefixes(order: np.ndarray, keys: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in ``order``, up to ``limit``.

    Kasai's walk in text order: one place on, the common prefix shrinks by one at
    most. Lanes of places are walked in step, each from nothing. Places with less
    than ``limit`` symbols left in their text have no meaning.
    """
    size = len(order)
    before = np.full(size, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    lanes = np.arange(0, size, _LANE)
    known = np.zeros(len(lanes), dtype=np.int64)
    found = np.zeros(size, dtype=np.int64)
    fresh = np.zeros(size, dtype=bool)
    fresh[starts] = True
    padded = np.append(keys, np.zeros(limit + _WIDTH, dtype=np.uint64))
    shifts = [np.uint64(_BITS * k) for k in range(_WIDTH)]
    for step in range(min(_LANE, size)):
        at = lanes + step
        inside = at < size
        if not inside.all():
            lanes, known, at = lanes[inside], known[inside], at[inside]
        other = before[at]
        known = np.where(fresh[at] | (other < 0), 0, known)
        going = np.flatnonzero((other >= 0) & (known < limit))
        while len(going):
            differ = padded[at[going] + known[going]] ^ padded[other[going] + known[going]]
            same = np.zeros(len(going), dtype=np.int64)
            for shift in shifts:
                same += (differ >> shift) == 0
            known[going] += same
            going = going[(same == _WIDTH) & (known[going] < limit)]
        known = np.minimum(known, limit)
        found[at] = known
        known = np.maximum(known - 1, 0)
    return found[order]
