"""Whole batches of texts as numpy arrays: words, character n-grams and their 64-bit hashes.

Hashes are polynomials over the characters, taken from one prefix sum, so the
hash of any substring costs one subtraction and one product. Batches are cut
at text borders into chunks of bounded size; a longer text is cut at a word
border, so memory is bounded whatever a text's length is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of a chunk; one text's word longer than this makes its chunk larger.
CHUNK = 1 << 17
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_UNBASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 18
    while size < n:
        size *= 2
    return tuple(x[:n] for x in _powers(size))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def not_space() -> np.ndarray:
    """Which code points belong to words when only ASCII white space parts them."""
    out = np.ones(0x110000, bool)
    out[[0x20, *range(9, 14)]] = False
    return out


class Words:
    """Words of some texts in one array, each with a 0 before it and after it.

    ``start[i]`` is the place of the 0 before word i, ``start[i + 1]`` that of
    the one after it, ``doc[i]`` the number of its text.
    """

    def __init__(self, texts: list[str], first: int, inside: np.ndarray):
        joined = "\n".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = inside[cp]
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = ok.copy()
        begins[1:] &= ~ok[:-1]
        at = np.flatnonzero(begins)
        self.doc = np.searchsorted(ends, at, "right") + first
        self.n = len(at)
        number = np.cumsum(begins)
        rank = np.cumsum(ok) - 1
        place = (rank + number)[ok]
        self.cp = np.zeros((int(place[-1]) + 2) if self.n else 1, np.uint32)
        self.cp[place] = cp[ok]
        self.start = np.append(rank[at] + np.arange(self.n), len(self.cp) - 1)
        up, self._down = powers(len(self.cp) + 1)
        self._sum = np.zeros(len(self.cp) + 1, U)
        np.cumsum(mix(self.cp.astype(U) + U(0x51ED270B)) * up[: len(self.cp)], out=self._sum[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[begin]) * self._down[begin])

    def whole(self) -> np.ndarray:
        """A hash per word."""
        return self.hashes(self.start[:-1], self.start[1:] + 1)

    def ngrams(self, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of words padded by one mark on each side, and the word number of each. ``words``: a mask."""
        last = self.start[1:] + 1 - n
        count = np.maximum(last - self.start[:-1] + 1, 0)
        if words is not None:
            count = np.where(words, count, 0)
        word = np.repeat(np.arange(self.n), count)
        begin = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + self.start[word]
        return self.hashes(begin, begin + n) ^ U(n), word


def pieces(text: str, inside: np.ndarray) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut between words."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and inside[ord(text[end])]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def chunks(texts: list[str | None], inside: np.ndarray) -> Iterator[Words]:
    """Words of all texts, chunk after chunk; nulls are empty. A long text may meet several chunks."""
    held: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        if held and size + len(text) > CHUNK:
            yield Words(held, first, inside)
            held, size = [], 0
        if len(text) > CHUNK:
            for part in pieces(text, inside):
                yield Words([part], i, inside)
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text) + 1
    if held:
        yield Words(held, first, inside)
