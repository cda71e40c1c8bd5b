"""Texts cut at spaces into parts that occur again and again, column-wise.

Byte-level and piece vocabularies start a new piece at a space that follows other
text, so a text's ids are those of its parts, one after the other. A slice of texts
is cut by Arrow, equal parts become one dictionary entry, and only the entries are
encoded. Texts where a cut is not safe (runs of white space, other white space than
ASCII's, a space at the end, special tokens) stay whole, as one part.

Nothing is remembered between slices, so memory is bounded by a slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A part stands for itself after a space, or without one after this mark; the mark
#: and the kept space are bytes that UTF-8 does not have.
MARK = b"\xff"
_KEPT = b"\xfe"
_ENDS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_OTHER = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_UNSAFE = "[" + "".join(f"\\x{{{c:x}}}" for c in _OTHER) + r"]|[\t-\r ] | \z"


@dataclass(frozen=True)
class Parts:
    """The distinct parts of a slice, and each text's part numbers."""

    distinct: list[bytes]
    index: np.ndarray
    starts: np.ndarray

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of the parts over each text."""
        running = np.concatenate(([0], np.cumsum(values[self.index], dtype=np.int64)))
        return running[self.starts[1:]] - running[self.starts[:-1]]


def cut_texts(texts: pa.Array, *, spaced: bool, kept_whole: Iterable[str] = ()) -> Parts:
    """Parts of texts without nulls. ``spaced`` puts a space before every text;
    texts with one of ``kept_whole`` are not cut."""
    texts = texts.cast(pa.large_string())
    raw = texts.cast(pa.large_binary())
    if spaced:
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    unsafe = pc.match_substring_regex(texts, pattern="|".join([_UNSAFE, *map(re.escape, kept_whole)]))
    none, mark, space = (pa.scalar(b, pa.large_binary()) for b in (b"", MARK, MARK + _KEPT))
    ready = raw if spaced else pc.binary_join_element_wise(mark, raw, none)
    if pc.any(unsafe).as_py():
        whole = pc.binary_join_element_wise(space if spaced else mark, pc.replace_substring(raw, pattern=b" ", replacement=_KEPT), none)
        ready = pc.if_else(unsafe, whole, ready)
    lists = pc.split_pattern(ready, pattern=b" ")
    coded = lists.flatten().dictionary_encode()
    starts = np.asarray(lists.offsets, dtype=np.int64)
    return Parts(byte_list(coded.dictionary), np.asarray(coded.indices), starts - starts[:1])


def byte_list(values: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls."""
    data, ends = values.buffers()[2].to_pybytes() if values.buffers()[2] else b"", ends_of(values).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def ends_of(values: pa.Array) -> np.ndarray:
    """Where each value of a large binary or string array starts in its data, and
    the end of the last one."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]


def text_of(part: bytes) -> bytes:
    return part[1:].replace(_KEPT, b" ") if part.startswith(MARK) else b" " + part


def stands_alone(part: bytes) -> bool:
    """Whether a part must not be encoded in one go with others: it has no space
    before it, or ends in what may join the next one's space."""
    return not part or part.startswith(MARK) or part.endswith(_ENDS)


def place_in_runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside every run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of runs that start at ``starts``."""
    return np.repeat(starts, sizes) + place_in_runs(sizes)


def byte_slices(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, start, ends = [], 0, np.cumsum(sizes)
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        out.append((start, stop))
        start = stop
    return out
