"""Byte-level byte-pair encoding of whole tables with the tokenizers library.

The library's splitter works left to right without looking back. A run of letters ends where no letter follows, and a
blank that stands alone begins what follows it: a text may be cut between a letter and a sign of ASCII that is no letter,
and between a sign of ASCII and a blank before a letter, with the same ids on both sides. Texts are cut at all these
places; segments are looked up by hash in the bounded table of ``pieces``, every hit is compared character by character,
and segments that are new to a worker are encoded by the library: those that are letters after at most one blank, one part
for its splitter, by its model alone, and all others as texts.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .pieces import BLOCK, Encoder

#: Segments that a worker's table holds before it is emptied, and bits of its number of slots.
CACHE, SLOT_BITS = 1_000_000, 21
#: Code points below which the classes of characters are the same in all versions of Unicode that libraries use.
STABLE = 0x0600


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for the characters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


BYTE_NAMES = {b: c for c, b in byte_names().items()}


class ByteEncoder(Encoder):
    """The encodings of one tokenizer file, and the segments met so far. Strings of special tokens are plain text."""

    slot_bits = SLOT_BITS

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.letters = np.array([chr(i).isalpha() for i in range(STABLE)])
        self.signs = np.array([not chr(i).isalpha() for i in range(128)])
        self._forget()

    def full(self) -> bool:
        return self.chars_end.n > CACHE

    def merged(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments given as one array of code points, and how many each segment has."""
        text, ends, starts = points.tobytes().decode("utf-32-le"), sizes.cumsum(), sizes.cumsum() - sizes
        other = ~self.letters[np.minimum(points, STABLE - 1)] | (points >= STABLE)
        blank = points[starts] == 32
        single = (np.add.reduceat(other, starts) == blank) & (sizes > blank)
        found: list[list[int]] = [[]] * len(sizes)
        words = np.flatnonzero(single)
        # The model reads one character for each byte.
        wide = 1 + (points >= 128).astype(np.int64) + (points >= 2048) + (points >= 65536)
        upto = np.concatenate([[0], wide.cumsum()])
        named = text.encode().decode("latin-1").translate(BYTE_NAMES)
        tokenize = self.library.model.tokenize
        for k, a, b in zip(words.tolist(), upto[starts[words]].tolist(), upto[ends[words]].tolist(), strict=True):
            found[k] = [t.id for t in tokenize(named[a:b])]
        texts = np.flatnonzero(~single)
        parts = [text[a:b] for a, b in zip(starts[texts].tolist(), ends[texts].tolist(), strict=True)]
        for k, x in zip(texts.tolist(), self.library.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            found[k] = x.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def check(self, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Nothing to compare: the ids are the library's."""

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's ids begin (one entry more)."""
        ends = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cut = np.ones(len(points), bool)
        cut[1:] = self.letters[np.minimum(points[:-1], STABLE - 1)] & (points[:-1] < STABLE)
        cut[1:] &= self.signs[np.minimum(points[1:], 127)] & (points[1:] < 128)
        alone = (points[1:-1] == 32) & self.letters[np.minimum(points[2:], STABLE - 1)] & (points[2:] < STABLE)
        cut[1:-1] |= alone & (points[:-2] > 32) & (points[:-2] < 127)
        cut[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ids, counts, lo = [], [], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
            stop = starts[hi] if hi < len(starts) else len(points)
            for held, new in zip((ids, counts), self._block(points[starts[lo] : stop], starts[lo:hi] - starts[lo]), strict=True):
                held.append(new)
            lo = hi
        upto = np.concatenate([[0], np.concatenate(counts).cumsum()])
        return np.concatenate(ids), upto[np.searchsorted(starts, ends)]

    def encode_with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, but the strings of special tokens get the tokens' ids, as in the library's default."""
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if len(special) != 1:
            raise ValueError("a vocabulary with one special token is expected")
        ((mark, own),) = special.items()
        parts = [x.split(mark) for x in texts]
        ids, bounds = self.encode([p for x in parts for p in x])
        first = np.cumsum([0, *map(len, parts)])
        # Before every part but a text's first stands the special token.
        extra = np.arange(first[-1] + 1) - np.searchsorted(first, np.arange(first[-1] + 1), "right") + 1
        extra[-1] = first[-1] - len(texts)
        out = np.full(len(ids) + int(extra[-1]), own, np.int32)
        out[np.arange(len(ids)) + np.repeat(extra[:-1], np.diff(bounds))] = ids
        return out, (bounds + extra)[first]


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The encoder of a tokenizer file; one for each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
