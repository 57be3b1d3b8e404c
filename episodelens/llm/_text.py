"""Vectorised word kernels over Arrow string columns (no per-word Python).

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes.  Hashes are 64-bit polynomial
fingerprints with random byte values, finalised by an avalanche step; the hash
of any run of k words costs O(1) from prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_OTHER_VALUE = np.random.Generator(np.random.PCG64(71828182)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_VALUE_LOWER, _OTHER_VALUE_LOWER = _BYTE_VALUE[_LOWER], _OTHER_VALUE[_LOWER]
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text handled at once; a single longer document is handled alone.
CHUNK_BYTES = 1 << 19


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, U64(self.base)), np.full(size, U64(self.inverse))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser for uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def repaired(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with U+FFFD for damaged UTF-8, document by document, so that none changes how another is read."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    if not ((data[heads] & 0xC0) == 0x80).any():  # no document begins inside a character, so all are whole if the slice is
        try:
            data.tobytes().decode()
            return data, offsets
        except UnicodeDecodeError:
            pass
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents whose bytes together stay within limit (one document at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Words of a slice of documents.

    data/offsets: bytes and document bounds; starts/ends: byte bounds of words;
    first: index of each document's first word (one more entry at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n:
            gap = SEPARATOR[data]
            begins, finishes = ~gap, ~gap
            begins[1:] &= gap[:-1]
            finishes[:-1] &= gap[1:]
            cuts = offsets[(offsets > 0) & (offsets < n)]
            begins[cuts] = ~gap[cuts]
            finishes[cuts - 1] = ~gap[cuts - 1]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False, other: bool = False) -> np.ndarray:
        """64-bit hash of each word, ASCII-lower-cased on request; other: of a second, independent function."""
        if not len(self):
            return np.zeros(0, np.uint64)
        up, down = _BYTES.upto(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        values = ((_BYTE_VALUE, _BYTE_VALUE_LOWER), (_OTHER_VALUE, _OTHER_VALUE_LOWER))[other][lower]
        np.cumsum(values[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def texts(self) -> list[list[bytes]]:
        raw = self.data.tobytes()
        return [[raw[a:b] for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)] for i, j in zip(self.first[:-1], self.first[1:], strict=True)]


class Runs:
    """Hashes of runs of k consecutive words, for any k, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self.down = _WORDS.upto(self.n + 1)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up[: self.n], out=self.total[1:])

    def of(self, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Hash of words[start : start + k]; the caller sees to bounds."""
        ends = starts + k
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + np.asarray(k, np.uint64))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word windows, each within one document, and each one's document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    if not len(docs):
        return np.zeros(0, np.int64), docs
    shift = np.cumsum(counts) - counts
    return np.arange(len(docs)) - shift[docs] + first[:-1][docs], docs


def batches_of(column_batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(record batch slice, Words) pairs of bounded size from an iterator of record batches."""
    for batch in column_batches:
        data, offsets = string_buffers(batch.column(column))
        for at, to in slices(offsets, limit):
            part = offsets[at : to + 1]
            yield batch.slice(at, to - at), Words(data[part[0] : part[-1]], part - part[0])
