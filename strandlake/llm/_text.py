"""Vectorised reading of Arrow text columns: bytes, words and their hashes, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of the vectorised code looks at; a longer document makes a step of its own.
STEP_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (three xor-shift-multiply steps)."""
    x = x + np.uint64((seed + 1) * int(_ODD) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    made = []
    for b in (base, inverse):
        p = np.full(n + 1, b, dtype=np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(STEP_BYTES, 1 << max(1, n).bit_length()))


@dataclass
class Step:
    """Some whole documents: first..last of the batch, their bytes and where each begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[Step]:
    data, at = text_bytes(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Step(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


@dataclass
class Words:
    """Words of a step: byte ranges, the index of each one's document in the step, and 64-bit hashes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.per_doc)])


def ranges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes, none of which crosses a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Hasher:
    """64-bit hashes of byte ranges (polynomial over random byte values, mixed with the length), from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def words(step: Step, lower: bool = True, inside: np.ndarray | None = None) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document, A-Z in lower case; inside: another table of bytes that make words."""
    data = LOWER[step.data] if lower else step.data
    start, end = ranges(~SPACE[data] if inside is None else inside[data], step.offsets)
    doc = np.searchsorted(step.offsets, start, "right") - 1
    return Words(start, end, doc, hash_ranges(data, start, end), np.bincount(doc, minlength=len(step)))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Hasher(data)(start, end)
