"""Packing examples into fixed-length sequences: vector bin packing by dot products.

An example has three demands: tokens, one segment, and tokens that bear loss.
A sequence has a limit for each. The open sequence takes, of the examples that
fit into all that is left, the one whose demands have the largest dot product
with what is left (both as shares of the limits), until none fits; a gap that
is then still worth filling takes a part of the example with most tokens.

Every task packs the examples it reads, through a window of bounded size: no
shuffle, and no padding but in one sequence of a task, which is cut at powers
of two, where no padding is needed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .storage import table

#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000
# The pieces that the vocabulary's own rules cut a text into, and
# the characters for which lower-casing and normalisation are those of Python.
PIECE = r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\s\w]|_)+"
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027]*"


class Tokens:
    """Ids of whole texts. A text's pieces are encoded on their own, so each is encoded once by a worker and remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces = re.compile(PIECE).findall
        self._plain = re.compile(PLAIN).fullmatch
        self._ids: dict[str, bytes] = {}

    def _exact(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """All new pieces in one call: a word number per token tells which piece it is of."""
        got = self._tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        word, ids = np.array(got.word_ids), np.array(got.ids, "<u4").tobytes()
        if len(word) and word[-1] == len(pieces) - 1:
            at = (4 * np.searchsorted(word, np.arange(len(pieces) + 1))).tolist()
            self._ids.update((x, ids[a:b]) for x, a, b in zip(pieces, at, at[1:]))
        else:
            self._ids.update((x, self._exact(x)) for x in pieces)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        text = text or ""
        if "<|" in text or not self._plain(text):
            return self._exact(text)
        pieces = self._pieces(text.lower())
        known = self._ids
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            new = list({x for x in pieces if x not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(pieces))
            self._learn(new)
        return b"".join(map(known.__getitem__, pieces))


@cache
def tokens_of(path: str) -> Tokens:
    """One per worker and vocabulary, kept from task to task."""
    return Tokens(path)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    #: Examples that wait for a place at a time.
    window: int = 1024
    #: Gaps of up to so many tokens are not filled with parts of examples.
    slack: int = 7


class Packer:
    """Packs examples that arrive one by one. ``emit`` gets the pieces of each closed sequence: (key, start, ids, place of the piece in it)."""

    def __init__(self, limits: Limits, emit):
        self.limits, self.emit = limits, emit
        n = limits.window
        self.key: list = [None] * n
        self.ids: list = [b""] * n
        self.start = np.zeros(n, np.int64)
        self.size = np.zeros(n, np.int64)
        self.loss = np.zeros(n, np.int64)
        self.loss_from = np.zeros(n, np.int64)
        self.used = 0
        self.open: list = []
        self._reset()

    def _reset(self) -> None:
        self.left = [self.limits.tokens, self.limits.segments, self.limits.loss]

    def add(self, key, ids: bytes, loss_from: int = 0) -> None:
        """Ids from ``loss_from`` on bear loss. What fills sequences of its own leaves at once."""
        start, n, lim = 0, len(ids) // 4, self.limits
        while n - start >= lim.tokens:
            take = self._fits(start, n - start, loss_from, lim.tokens, lim.loss)
            if take < lim.tokens:
                break
            self.emit([(key, start, ids[4 * start : 4 * (start + take)], 0)])
            start += take
        while n > start:
            take = self._fits(start, min(n - start, lim.tokens), loss_from, lim.tokens, lim.loss)
            self._wait(key, start, ids[4 * start : 4 * (start + take)], loss_from)
            start += take

    @staticmethod
    def _fits(start: int, n: int, loss_from: int, tokens: int, loss: int) -> int:
        return min(n, tokens, max(0, loss_from - start) + loss)

    def _wait(self, key, start: int, ids: bytes, loss_from: int) -> None:
        if self.used == self.limits.window:
            self._place()
        self._put(self.used, key, start, ids, loss_from)
        self.used += 1

    def _put(self, i: int, key, start: int, ids: bytes, loss_from: int) -> None:
        n = len(ids) // 4
        self.key[i], self.ids[i], self.start[i], self.size[i], self.loss_from[i] = key, ids, start, n, loss_from
        self.loss[i] = max(0, start + n - max(start, loss_from))

    def _remove(self, i: int) -> None:
        last = self.used - 1
        for a in (self.key, self.ids, self.start, self.size, self.loss, self.loss_from):
            a[i] = a[last]
        self.key[last] = None
        self.ids[last] = b""
        self.used = last

    def _take(self, i: int, n: int) -> None:
        key, start, ids, loss_from = self.key[i], int(self.start[i]), self.ids[i], int(self.loss_from[i])
        self.open.append((key, start, ids[: 4 * n], self.limits.tokens - self.left[0]))
        self.left[0] -= n
        self.left[1] -= 1
        self.left[2] -= max(0, start + n - max(start, loss_from))
        if n == self.size[i]:
            self._remove(i)
        else:
            self._put(i, key, start + n, ids[4 * n :], loss_from)

    def _close(self) -> None:
        if self.open:
            self.emit(self.open)
        self.open = []
        self._reset()

    def _place(self) -> None:
        """Make room: put one waiting example, or a part of one, into the open sequence."""
        while True:
            left, lim = self.left, self.limits
            size, loss = self.size[: self.used], self.loss[: self.used]
            if left[1] > 0:
                fit = (size <= left[0]) & (loss <= left[2])
                score = size * (left[0] / lim.tokens**2) + loss * (left[2] / lim.loss**2) + left[1] / lim.segments**2
                i = int(np.argmax(np.where(fit, score, -1.0)))
                if fit[i]:
                    self._take(i, int(size[i]))
                    return
                if left[0] > lim.slack:
                    i = int(np.argmax(size))
                    n = self._fits(int(self.start[i]), int(size[i]), int(self.loss_from[i]), left[0], left[2])
                    if n > lim.slack:
                        self._take(i, n)
                        self._close()
                        continue
            self._close()

    def finish(self) -> None:
        while self.used:
            self._place()
        total = self.limits.tokens - self.left[0]
        if 0 < total < self.limits.tokens - self.limits.slack:
            self._by_powers(total)
        self._close()

    def _by_powers(self, total: int) -> None:
        """The last sequence in parts whose lengths are powers of two, which need no padding."""
        pieces, self.open = self.open, []
        parts = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        room, out, filled = parts.pop(0), [], 0
        for key, start, ids, _ in pieces:
            while ids:
                n = min(len(ids) // 4, room - filled)
                out.append((key, start, ids[: 4 * n], filled))
                start, ids, filled = start + n, ids[4 * n :], filled + n
                if filled == room:
                    self.emit(out)
                    room, out, filled = (parts.pop(0) if parts else 0), [], 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), loss_from: str | None = None) -> DataFrame:
    """Pieces (``SCHEMA``) of all ``docs`` (doc_id, text), packed; each token lies in one piece.

    A document is its text's ids and then ``end_id``; a null text is empty, so
    it still has that one token. ``loss_from`` names a column with the token
    from which a document bears loss (null or absent: all of it does).
    Sequences hold at most ``limits.tokens`` tokens, ``limits.segments`` pieces
    and ``limits.loss`` loss-bearing tokens. Rows that repeat are packed each;
    a null doc_id is kept. ``sequence_id`` has the number of the task in its
    upper bits, so a task that runs again makes the same rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        sequence = TaskContext.get().partitionId() << 33

        def emit(pieces: list) -> None:
            nonlocal sequence
            for (doc, n), start, ids, at in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, sequence, at))
            sequence += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(_ARROW))], schema=_ARROW)
            rows.clear()
            return out

        packer = Packer(limits, emit)
        for got in batches:
            for doc, text, first in zip(got[0].to_pylist(), got[1], got[2].to_pylist()):
                ids = tokens.encode(text.as_py()) + end
                packer.add((doc, len(ids) // 4), ids, first or 0)
                if len(rows) >= 10_000:
                    yield batch()
        packer.finish()
        yield batch()

    first = f"cast({loss_from} as long)" if loss_from else "cast(0 as long)"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text", f"{first} AS first").mapInArrow(pack, SCHEMA)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
