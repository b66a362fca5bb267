"""Words of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = U(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one, so that one enormous word is a single call.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _PRIME)


def shape(rows: DataFrame, columns: Sequence[str], more: str) -> T.StructType:
    """The schema of some columns of ``rows``, whatever their names, and ``more``."""
    return T.StructType([rows.schema[c] for c in columns] + T.StructType.fromDDL(more).fields)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (nulls are empty)."""
    if text.null_count:
        text = text.fill_null("")
    _, offsets, data = text.buffers()
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return b[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each, so memory follows the longest text only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column: ``start`` and ``end`` in ``data``; ``at[d]:at[d+1]`` are those of text d."""

    def __init__(self, text: pa.Array, lower: bool):
        raw, self.text_at = flat(text)
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        space = _SPACE[raw]
        edge = np.ones(n + 1, bool)  # edge[i]: a text begins at i or byte i-1 is a space
        edge[1 : n + 1] = space
        edge[0] = True
        edge[self.text_at] = True
        word = ~space
        self.start = np.flatnonzero(word & edge[:n])
        after = np.append(space[1:], True) if n else space
        last = self.text_at[1:] - 1
        after[last[last >= 0]] = True
        self.end = np.flatnonzero(word & after) + 1
        self.at = np.searchsorted(self.start, self.text_at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        h = size.astype(U) * _PRIME
        order = np.argsort(np.minimum(size, _LONG + 1).astype(np.uint8), kind="stable")
        begin = np.searchsorted(size, np.arange(1, _LONG + 2), sorter=order)
        pos, hl = self.start[order], h[order]
        for k in range(_LONG):  # the words of more than k bytes
            go = slice(begin[k], begin[_LONG])
            hl[go] = hl[go] * _PRIME + _BYTE[self.data[pos[go]]]
            pos[go] += 1
        h[order] = hl
        for i in np.flatnonzero(size > _LONG):
            h[i] = U(int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little"))
        return mix(h)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive items (``len(h) - n + 1`` of them), order included."""
    if len(h) < n:
        return np.empty(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out = out * _PRIME + h[k : len(h) - n + 1 + k]
    return mix(out)


def list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list column of int64 from values end to end."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
