"""Hashes of word and byte windows, and the anchors that lead equal windows together.

Everything here works on one batch of documents laid end to end in numpy. A
batch is bounded by its callers, so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

SLICE = 1 << 21
WORD_CACHE = 150_000
_HASH_BITS = np.uint64(40)
_POSITION = np.uint64((1 << 24) - 1)
_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_BYTE_HASH = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hash of every word met so far; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def words_of(text: str | None, *, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8 bytes; ``bytes.split`` cuts at 0x20 and 0x09-0x0D
    and ``bytes.lower`` changes A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def byte_hashes(raw: bytes) -> np.ndarray:
    return _BYTE_HASH[np.frombuffer(raw, dtype=np.uint8)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the ordered pair (a, b), elementwise."""
    out = a * _MIX_A
    out ^= out >> _SHIFT
    out += b
    out *= _MIX_B
    out ^= out >> _SHIFT
    return out


class Grams:
    """Hashes of all runs of ``n`` consecutive units, doubled up from one unit."""

    def __init__(self, units: np.ndarray):
        self._of = {1: units}

    def __call__(self, n: int) -> np.ndarray:
        if n not in self._of:
            top = 1 << (n.bit_length() - 1)
            if top == n:
                half = self(n // 2)
                size = max(0, len(half) - n // 2)
                self._of[n] = mix(half[:size], half[n // 2 : n // 2 + size])
            else:
                head, tail = self(top), self(n - top)
                size = max(0, len(self._of[1]) - n + 1)
                self._of[n] = mix(head[:size], tail[top : top + size])
        return self._of[n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(gram: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the ``valid`` windows of ``width`` consecutive grams.

    Returns (anchor position, first window, end of windows) of each run of
    windows with the same leftmost smallest gram. Equal windows have their
    anchor at the same offset, since the choice depends on their content only.
    """
    if not valid.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    if len(gram) > int(_POSITION):
        raise ValueError("a batch is too long")
    low = np.uint64(64) - _HASH_BITS
    ranked = ((gram >> low) << low) | np.arange(len(gram), dtype=np.uint64)
    chosen = (sliding_min(ranked, width) & _POSITION).astype(np.int64)
    chosen[~valid] = -1
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    end = np.append(first[1:], len(chosen))
    kept = chosen[first] >= 0
    return chosen[first][kept], first[kept], end[kept]


def cut_long(size: int, length: int, limit: int = SLICE) -> list[tuple[int, int]]:
    """(start, end) of slices that hold every window of ``length`` units once."""
    return [(at, min(size, at + limit + length - 1)) for at in range(0, max(1, size - length + 1), limit)]


def laid_end_to_end(units: Sequence[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units in one array, where each text starts, and which window starts
    leave the window inside its text."""
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    joined = np.concatenate(units) if units else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(sizes)
    valid = np.ones(max(0, len(joined) - length + 1), dtype=bool)
    for end in ends.tolist():
        valid[max(0, end - length + 1) : end] = False
    return joined, ends - sizes, valid


def batches(sizes: Iterable[int], limit: int = SLICE) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit`` at most."""
    out, start, total, at = [], 0, 0, -1
    for at, size in enumerate(sizes):
        if total and total + size > limit:
            out.append((start, at))
            start, total = at, 0
        total += size
    if at >= start:
        out.append((start, at + 1))
    return out
