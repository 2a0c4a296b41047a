"""Vectorised text primitives shared by the operators of this subpackage.

A batch of texts is read as one byte buffer; words, word hashes and shingle
hashes are then computed with numpy over the whole buffer, so the cost per text
is a few nanoseconds a byte and no Python object is made per word.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
CHUNK_BYTES = 2 << 20

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
WORD_BYTE[128:] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(n, b, dtype=U64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large_string array without nulls (a null becomes '')."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array; nothing is copied."""
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive texts: word i is buf[start[i]:end[i]]; text d has words first[d] to first[d+1]-1."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = _BYTES.get(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.buf) + 1, U64)
            np.cumsum((self.buf + U64(1)) * up[: len(self.buf)], out=total[1:])
            return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def shingles(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of every run of n words within a text."""
        h = self.hashes() if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = _WORDS.get(len(h) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) + 1, U64)
            np.cumsum(h * up[: len(h)], out=total[1:])
            s = mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])
        docs = self.docs()
        ok = np.flatnonzero(docs[: len(s)] == docs[n - 1 :])
        return s[ok], docs[ok], ok


def split_words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """Words of each text of a string column."""
    column = strings(column)
    if lower:
        column = pc.utf8_lower(column)
    buf, offsets = raw(column)
    inside = WORD_BYTE[buf]
    begin, stop = inside.copy(), inside.copy()
    if len(buf):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edge] = inside[edge]
        stop[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch with at most `limit` bytes of text each (a longer text is a slice of its own)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hash(word: str) -> int:
    """The hash that Words.hashes() gives a single word."""
    w = split_words(pa.array([word]))
    return int(w.hashes()[0])


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def sets_of(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted within it, and their offsets by text."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n_docs + 1))
