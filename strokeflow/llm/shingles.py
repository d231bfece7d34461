"""Shingle sets of whole Arrow batches: 64-bit hashes of runs of k words, vectorised over the UTF-8 bytes.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A
text with fewer than k words (and at least one) has one shingle, the whole
sequence. Work goes on in chunks of bounded size; the words of a longer text
are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .textarrays import U, mix, powers

#: Bytes of text that are worked on at a time.
CHUNK = 1 << 18


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.arange(256, dtype=U)
    value[65:91] += U(32)
    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    return mix(value + U(0x1234567)), space


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``; no word crosses a border."""
    value, is_space = _tables()
    space = is_space[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    begins[inner] = ~space[inner]
    ends[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U)), start


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut at white space."""
    _, is_space = _tables()
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not is_space[data[end]]:
            end += 1
        out.append(_words(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def _combine(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents from word hashes in order."""
    factor = [U(int(x)) for x in mix(np.arange(1, k + 1, dtype=U)) | U(1)]
    n = len(words)
    count = np.bincount(doc) if n else np.zeros(0, np.int64)
    m = max(0, n - k + 1)
    h = np.zeros(m, U)
    for j in range(k):
        h += words[j : j + m] * factor[j]
    whole = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
    h, of = mix(h[whole]), doc[:m][whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), U)
        for j in range(k - 1):
            inside = j < count[few]
            short[inside] += words[first[inside] + j] * factor[j]
        h = np.concatenate([h, mix(short ^ mix(count[few].astype(U) + U(77)))])
        of = np.concatenate([of, few])
    return h, of


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and the offset of each text; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def batches(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, rows) of parts of ``texts``: distinct shingles, sorted by row and then hash."""
    data, off = _spans(texts)
    row = 0
    while row < len(off) - 1:
        end = int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1
        end = min(max(end, row + 1), len(off) - 1)
        part = data[off[row] : off[end]]
        if len(part) > CHUNK:
            words = _long_words(part)
            doc = np.zeros(len(words), np.int64)
        else:
            words, start = _words(part, off[row:end] - off[row])
            doc = np.searchsorted(off[row : end + 1] - off[row], start, "right") - 1
        h, of = _combine(words, doc, k)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield row, end, h[new], of[new] + row
        row = end


def bags(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, rows, counts) of parts of ``texts``: distinct words, sorted by row and then hash."""
    data, off = _spans(texts)
    row = 0
    while row < len(off) - 1:
        end = int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1
        end = min(max(end, row + 1), len(off) - 1)
        part = data[off[row] : off[end]]
        if len(part) > CHUNK:
            h = _long_words(part)
            of = np.zeros(len(h), np.int64)
        else:
            h, start = _words(part, off[row:end] - off[row])
            of = np.searchsorted(off[row : end + 1] - off[row], start, "right") - 1
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        yield row, end, h[at], of[at] + row, np.diff(np.append(at, len(h)))
        row = end
