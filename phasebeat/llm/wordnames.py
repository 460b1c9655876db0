"""Fingerprints of words, taken for a whole text at once."""

from __future__ import annotations

import numpy as np
import xxhash

from phasebeat.llm.chunks import BASE, BLOCK, powers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Fixed value: bytes of words are digits, small letters, and all of characters beyond ASCII.
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class WordNames:
    """64-bit names of the words in UTF-8 text."""

    def __init__(self):
        self.up, self.down = powers(BASE, 2 * BLOCK), powers(pow(BASE, -1, 2**64), 2 * BLOCK)
        self.code = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, data: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Names of the words of ``data`` in order, none of them zero, and where each begins.

        With ``prefixes`` there is a row of names for each of these numbers of bytes too, zero for words that are not longer.
        """
        data = _LOWER[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IS_WORD[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            base = int(starts[lo])
            s, e = starts[lo:hi] - base, np.minimum(ends[lo:hi] - base, 2 * BLOCK)
            part = data[base : base + int(e[-1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.code[part] * self.up[: len(part)], out=sums[1:])
            for row, size in enumerate((0, *prefixes)):
                found = (sums[np.minimum(s + size, e) if size else e] - sums[s]) * self.down[s]
                found ^= found >> np.uint64(29)
                found *= np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
                found ^= found >> np.uint64(32)
                out[row, lo:hi] = np.where(s + size < e, found, 0) if size else np.maximum(found, 1)
        for i in np.flatnonzero(ends - starts >= BLOCK):  # words that may reach beyond a block's sums
            out[0, i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
        return (out if prefixes else out[0]), starts


def words_by_text(data: np.ndarray, lens: list[int], names: WordNames) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of consecutive texts, a zero after each text, and where each text begins among them."""
    ends = np.cumsum(lens, dtype=np.int64)
    parts, firsts, at, before = [], [], 0, 0
    zero = np.zeros(1, np.uint64)
    for n in np.diff(ends, prepend=0):
        own, _ = names.of(data[at : at + n])
        parts += [own, zero]
        firsts.append(before)
        before += len(own) + 1
        at += int(n)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(firsts, np.int64)
