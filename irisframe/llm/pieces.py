"""Cutting texts at places where a byte-level tokenizer starts a new piece anyway,
and remembering what became of the pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: White space always starts a new piece where it follows other text, and so does
#: common punctuation after Latin letters. The white space here is ASCII's.
_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?]*(?:[\t-\r ]|$))|[.,;:!?]+(?=[\t-\r ]|$)|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+"
)
#: Texts with other white space, or with what may be a special token, stay whole.
_OTHER = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)] + ["<|"]
_WHOLE = re.compile("|".join(map(re.escape, _OTHER)))
#: Before a space these make a run of white space, which the pattern cuts as a whole.
_RUNS = [c + " " for c in "\t\n\x0b\x0c\r "]
_NO_SPACE = "\ue000"


def cut(text: str) -> list[str]:
    """Parts whose encodings, one after the other, are the text's. A part stands
    for itself with a space before it, or without one after the mark."""
    if any(c in text for c in _OTHER):
        return [_NO_SPACE + text]
    if _NO_SPACE in text or any(c in text for c in _RUNS):
        return [_NO_SPACE + p for p in _PIECE.findall(text)]
    parts = text.split(" ")
    parts[0] = _NO_SPACE + parts[0]
    return parts


def text_of(part: str) -> str:
    return part[1:] if part.startswith(_NO_SPACE) else " " + part


def finer(part: str) -> list[str]:
    """The text of a part, cut once more where that is safe."""
    text = text_of(part)
    return [text] if _WHOLE.search(text) else _PIECE.findall(text)


_ONE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?]+")


def is_one_piece(text: str) -> bool:
    """Whether the pattern of byte-level vocabularies takes the text as one piece."""
    return _ONE.fullmatch(text) is not None


class Recent:
    """A mapping that keeps what was used lately: at most twice ``limit`` entries."""

    def __init__(self, limit: int, longest: int = 200):
        self._limit, self._longest = limit, longest
        self._new: dict[str, object] = {}
        self._old: dict[str, object] = {}

    def of(self, keys: Iterable[list[str]], make: Callable[[list[str]], Iterable]) -> dict[str, object]:
        """Values of all ``keys``, those not remembered made by one call. The result
        is valid until the next call; it may hold more than was asked for."""
        if len(self._new) > self._limit:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        missing = []
        for key in {k for found in keys for k in found if k not in new}:
            if key in old:
                new[key] = old[key]
            else:
                missing.append(key)
        long: dict[str, object] = {}
        for key, value in zip(missing, make(missing)):
            (new if len(key) <= self._longest else long)[key] = value
        return {**new, **long} if long else new
