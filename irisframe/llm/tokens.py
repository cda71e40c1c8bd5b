"""Token ids of whole texts by a vocabulary file, encoding each distinct part once."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from irisframe.llm.parts import Parts, cut_texts, gather, stands_alone, text_of

#: How byte-level vocabularies spell bytes: printable Latin-1 letters stand for
#: themselves, the other bytes for letters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: The cut that byte-level vocabularies make when none is given.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def spelled_bytes(token: str) -> bytes:
    """The bytes of a byte-level token."""
    return bytes(map(_LETTER_BYTES.__getitem__, token))


def rank_encoding(given: dict) -> tiktoken.Encoding | None:
    """A vocabulary file's content as ranks, if its merges are in the order of their
    ids and it cuts texts as byte-level vocabularies do; else None."""
    model, cut = given["model"], given.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not given.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    special = {t["content"] for t in given.get("added_tokens", [])}
    ranks = {spelled_bytes(t): i for t, i in model["vocab"].items() if t not in special}
    if made != sorted(set(made)) or {bytes([b]) for b in range(256)} - ranks.keys() or len(ranks) != 256 + len(made):
        return None
    if made and min(made) <= max(ranks[bytes([b])] for b in range(256)):
        return None
    return tiktoken.Encoding("given", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Ids as unsigned 32-bit numbers, equal to the tokenizers library's own.

    ``special`` tells whether the strings of special tokens in a text are those
    tokens, as in the library by default, or ordinary text.
    """

    def __init__(self, path: str, *, special: bool = True):
        self._path, self._as_text, self._library = path, not special, None
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self._ranks = rank_encoding(given)
        added = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        self.special = list(added) if special else []
        self.kept_whole = list(added) if special or self._ranks is None else []
        self.token_bytes: list[bytes] = []
        if self._ranks is not None:
            vocabulary = given["model"]["vocab"] | added
            self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.token_bytes[i] = token.encode() if token in added else spelled_bytes(token)
        self._sizes = np.array([len(t) for t in self.token_bytes], dtype=np.int64)

    @property
    def _tokenizer(self) -> Tokenizer:
        """The library's own, loaded where a text needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
            self._library.encode_special_tokens = self._as_text
        return self._library

    def _alone(self, text: str) -> np.ndarray:
        if self._ranks is None or any(s in text for s in self.special):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self._ranks.encode_ordinary(text), dtype=np.uint32)

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, number of ids of each part)."""
        alone = [i for i, p in enumerate(parts) if self._ranks is None or stands_alone(p)]
        if len(alone) == len(parts):
            found = [self._alone(text_of(p).decode()) for p in parts]
            return np.concatenate([*found, np.zeros(0, dtype=np.uint32)]), np.array([len(f) for f in found], dtype=np.int64)
        apart = set(alone)
        together = [p for i, p in enumerate(parts) if i not in apart]
        ids = np.array(self._ranks.encode_ordinary((b" " + b" ".join(together)).decode()), dtype=np.uint32)
        part_ends = np.cumsum([len(p) + 1 for p in together])
        ends = np.cumsum(self._sizes[ids])
        upto = np.searchsorted(ends, part_ends)
        if not (ends[upto] == part_ends).all():
            raise ValueError("a token reaches over the end of a part")
        counts = np.zeros(len(parts), dtype=np.int64)
        places = np.ones(len(parts), dtype=bool)
        places[alone] = False
        counts[places] = np.diff(np.concatenate(([0], upto + 1)))
        if not alone:
            return ids, counts
        found = [self._alone(text_of(parts[i]).decode()) for i in alone]
        counts[alone] = [len(f) for f in found]
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        starts = np.cumsum(counts) - counts
        out[gather(starts[places], counts[places])] = ids
        out[gather(starts[alone], counts[alone])] = np.concatenate(found)
        return out, counts

    def cut(self, texts: pa.Array, *, spaced: bool = False) -> Parts:
        return cut_texts(texts, spaced=spaced, kept_whole=self.kept_whole)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts without nulls, as little-endian bytes."""
        parts = self.cut(texts)
        ids, counts = self.encode_parts(parts.distinct)
        starts = np.cumsum(counts) - counts
        # Freed buffers of earlier slices go back, so that workers stay small.
        pa.default_memory_pool().release_unused()
        out = ids.astype("<u4", copy=False)[gather(starts[parts.index], counts[parts.index])]
        ends = np.concatenate(([0], np.cumsum(parts.totals(counts)))).tolist()
        return [out[a:b].tobytes() for a, b in zip(ends, ends[1:])]


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def text_encoder(path: str, *, special: bool = True) -> TextEncoder:
    """The worker's encoder for a vocabulary file, kept for its later tasks."""
    if (path, special) not in _encoders:
        _encoders[path, special] = TextEncoder(path, special=special)
    return _encoders[path, special]
