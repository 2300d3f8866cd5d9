"""Vectorised byte-level views of a batch of texts: words, word hashes, n-gram codes (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Workers live long; the plain allocator gives freed batches back.
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def noise64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = noise64(256, 1)
_PLACE = noise64(1 << 14, 2)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a space between neighbours, and the start of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)])


def word_edges(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes of `kind`; data ends in a byte that is not."""
    inside = kind[data].view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each word."""
    if not len(start):
        return np.empty(0, U64)
    size = end - start
    offset = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], size)
    where = place + np.repeat(start, size)
    with np.errstate(over="ignore"):
        weight = _PLACE[place & (len(_PLACE) - 1)]
        if size.max() > len(_PLACE):  # very long words: later stretches get weights of their own
            weight = weight * (U64(2) * (place >> 14).astype(U64) + U64(1))
        return mix64(np.add.reduceat(_BYTE[data[where]] * weight, offset[:-1]) + size.astype(U64))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if t is None else t for t in pc.cast(column, pa.binary()).to_pylist()]


def chunks(batches, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts hold about max_bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
