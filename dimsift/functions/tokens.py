"""Tokens of ``[a-z]+`` as arrays: cut, told apart and counted without a step per token."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

LOOKED_UP = 16  # letters of a token that is remembered, as two whole numbers; longer ones are hashed each time
CHUNK_BYTES = 1_000_000  # of texts that are cut at once
SPACE = ord(" ")
# no byte of another character is one of these in UTF-8
LETTERS = bytes(c if ord("a") <= c <= ord("z") else SPACE for c in range(256))
# what is left of eight bytes, first letter lowest, by how many of them are letters
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_HALF = np.uint64(29)


class TokenDimensions:
    """The dimension that a token's MD5 names, remembered for about ``known`` tokens.

    Two tables with a place per token: the first keeps who came first, so frequent tokens stay; the second
    keeps who came last. A token that neither has costs its MD5 again, and no other answer.
    """

    def __init__(self, dims: int, salt: int, known: int):
        self.dims, self.salt = dims, salt
        bits = max(1, (max(1, known) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        # the letters, as two numbers, and the dimension
        self.tables = [tuple(np.zeros(1 << bits, kind) for kind in (np.uint64, np.uint64, np.int32)) for _ in range(2)]

    def counts(self, texts: Sequence[str | None]) -> np.ndarray:
        """How many tokens of every text have each dimension."""
        found = np.zeros((len(texts), self.dims))
        cut, size, start = [], 0, 0
        for row, text in enumerate(texts):
            cut.append((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS))
            size += len(cut[-1])
            if size >= CHUNK_BYTES or row == len(texts) - 1:
                found[start:row + 1] = self._counted(cut)
                cut, size, start = [], 0, row + 1
        return found

    def _counted(self, texts: list[bytes]) -> np.ndarray:
        # a space before the first token, and behind the last as many bytes as a look at it may take
        joined = b" " + b" ".join(texts) + b" " * (LOOKED_UP + 1)
        is_letter = np.frombuffer(joined, np.uint8) != SPACE
        edges = (is_letter[1:] != is_letter[:-1]).nonzero()[0] + 1
        starts, ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        tokens = starts.searchsorted(np.add.accumulate(sizes) + 1)
        tokens[1:] -= tokens[:-1].copy()
        row = np.arange(len(texts)).repeat(tokens)
        dims = self._dimensions(joined, starts, ends)
        return np.bincount(row * self.dims + dims, minlength=len(texts) * self.dims).reshape(len(texts), self.dims)

    def _dimensions(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        lengths = ends - starts
        low = eight.take(starts) & _MASKS.take(np.minimum(lengths, 8))
        high = eight.take(starts + 8) & _MASKS.take(np.minimum(np.maximum(lengths - 8, 0), 8))
        mixed = low * _FACTORS[0] ^ high * _FACTORS[1]
        mixed ^= mixed >> _HALF
        # the second place of a token has nothing to do with its first
        places = [((mixed * factor) >> self.shift).astype(np.int64) for factor in _FACTORS[1:]]
        lows, highs, known = self.tables[0]
        same = (lows.take(places[0]) == low) & (highs.take(places[0]) == high) & (lengths <= LOOKED_UP)
        dims = known.take(places[0])
        left = (~same).nonzero()[0]
        lows, highs, known = self.tables[1]
        at = places[1].take(left)
        same = (lows.take(at) == low.take(left)) & (highs.take(at) == high.take(left)) & (lengths.take(left) <= LOOKED_UP)
        dims[left[same]] = known[at[same]]
        left = left[~same]
        if len(left):
            dims[left] = self._hashed([joined[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())])
            left = left[lengths[left] <= LOOKED_UP]
            free = self.tables[0][0].take(places[0].take(left)) == 0
            for (lows, highs, known), place, new in zip(self.tables, places, (left[free], left[~free])):
                # of tokens that meet at one place, the same one in all three
                at, one = place.take(new), np.empty(len(lows), np.int64)
                one[at] = new
                new = one[at]
                lows[at], highs[at], known[at] = low[new], high[new], dims[new]
        return dims

    def _hashed(self, tokens: list[bytes]) -> np.ndarray:
        distinct = {token: i for i, token in enumerate(dict.fromkeys(tokens))}
        digests = b"".join([hashlib.md5(token).digest() for token in distinct])
        dims = np.frombuffer(digests, ">u4").reshape(-1, 4)[:, self.salt] % np.uint32(self.dims)
        return dims.astype(np.int32).take(np.fromiter(map(distinct.__getitem__, tokens), np.int64, len(tokens)))
