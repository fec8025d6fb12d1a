"""Features of windows of a sequence by prefix counts: one array of running counts a sequence, two look-ups a window.

A sequence is one row, and its features come out of one pass over it: characters are never shuffled. Windows are given as arrays of
starts and ends, from 0, the end left out. Only ASCII letters count, small ones as capitals; any other symbol is a symbol without a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of each share, charges, and the classes of the reduced alphabet.
COMPOSITION = {"acidic": "DE", "alanine": "A", "aromatic": "FWY", "proline": "P", "qn": "QN", "aliphatic": "AVILM"}
PLUS, MINUS, MARKED = "KR", "DE", "ST"
CLASSES = {"H": "AVLIM", "R": "FWY", "P": "P", "G": "G", "O": "ST", "+": "KRH", "-": "DE", "N": "NQC"}
LAGS = (1, 2, 3, 5, 8, 10)
#: Places between the two symbols of a pair, and symbols of a block of charge.
APART, BLOCK = 3, 5
PAIRS = [a + b for a in CLASSES for b in CLASSES]
Windows = tuple[np.ndarray, np.ndarray]


def _mean(total: np.ndarray, n: np.ndarray, empty: float | np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), empty)


def running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Symbols:
    """A sequence's symbols as capitals (0 for what is no ASCII)."""

    def __init__(self, text: str) -> None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, code, 0).astype(np.uint8)
        self.code = np.where((code >= 97) & (code <= 122), code - 32, code).astype(np.uint8)
        self.text = text

    def __len__(self) -> int:
        return len(self.code)

    def isin(self, letters: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(letters.encode())] = True
        return table[self.code]

    def charge(self) -> np.ndarray:
        return self.isin(PLUS).astype(np.int8) - self.isin(MINUS).astype(np.int8)

    def whole(self) -> Windows:
        return np.array([0]), np.array([len(self)])

    def tiles(self, width: int) -> Windows:
        start = np.arange(0, len(self), width)
        return start, np.minimum(start + width, len(self))

    def centred(self, center: np.ndarray, radius: int) -> Windows:
        """Windows around centers (from 1), clipped at both ends."""
        return np.maximum(center - 1 - radius, 0), np.minimum(center + radius, len(self))


def counted(x: np.ndarray, w: Windows) -> np.ndarray:
    total = running(x)
    return total[w[1]] - total[w[0]]


def composition(s: Symbols, w: Windows) -> dict[str, np.ndarray]:
    """The share of each group of letters, and the net charge a symbol; 0 in an empty window."""
    n = w[1] - w[0]
    out = {k: _mean(counted(s.isin(x), w), n, 0.0) for k, x in COMPOSITION.items()}
    return out | {"charge": _mean(counted(s.charge().astype(np.int64), w), n, 0.0)}


def geometry(s: Symbols, w: Windows) -> dict[str, np.ndarray]:
    """How marked symbols stand: density, gaps between neighbours (mean, deviation, its ratio to the mean, shares of 1, up to 3 and up to 5), and how often two are a lag apart.

    Without a gap the mean is the window's length, the deviation 0, the ratio 1 and the shares 0; a lag as long as the window or longer gives 0.
    """
    start, end = w
    n = end - start
    mark = s.isin(MARKED)
    at = np.flatnonzero(mark)
    gap = np.diff(at)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    m = np.maximum(hi - lo - 1, 0)
    inner = lambda x: (lambda c: np.where(m > 0, c[np.minimum(lo + m, len(c) - 1)] - c[np.minimum(lo, len(c) - 1)], 0))(running(x))
    mean = _mean(inner(gap), m, n.astype(float))
    deviation = np.sqrt(np.maximum(_mean(inner(gap * gap), m, 0.0) - np.where(m > 0, mean * mean, 0), 0))
    out = {"density": _mean(counted(mark, w), n, 0.0), "gap_mean": mean, "gap_sd": np.where(m > 0, deviation, 0.0), "gap_cv": np.where(m > 0, deviation / (mean + 1e-9), 1.0)}
    out |= {name: _mean(inner(gap <= most), m, 0.0) for name, most in (("adjacent", 1), ("close_3", 3), ("close_5", 5))}
    for k in LAGS:
        both = np.zeros(len(mark), bool)
        both[: max(len(mark) - k, 0)] = mark[:-k] & mark[k:] if len(mark) > k else False
        out[f"autocorr_{k}"] = _mean(counted(both, (start, np.maximum(end - k, start))), np.maximum(n - k, 0), 0.0)
    return out


def decoration(s: Symbols, w: Windows) -> np.ndarray:
    """Sequence charge decoration: products of charges times the root of their distance, over all pairs of a window, over its length. A distance is one shifted product."""
    start, end = w
    charge = s.charge().astype(np.int64)
    total = np.zeros(len(start))
    for d in range(1, int((end - start).max(initial=0))):
        both = np.zeros(len(charge), np.int64)
        both[:-d] = charge[:-d] * charge[d:]
        total += np.sqrt(d) * counted(both, (start, np.maximum(end - d, start)))
    return _mean(total, end - start, 0.0)


def blockiness(s: Symbols, w: Windows) -> np.ndarray:
    """The variance of the mean charge of whole blocks of BLOCK symbols from the window's start; 0 for fewer than two."""
    start, end = w
    total = running(s.charge().astype(np.int64))
    n = (end - start) // BLOCK
    sums, squares = np.zeros(len(start)), np.zeros(len(start))
    for k in range(int(n.max(initial=0))):
        at = np.minimum(start + k * BLOCK, len(s))
        x = np.where(k < n, total[np.minimum(at + BLOCK, len(s))] - total[at], 0) / BLOCK
        sums, squares = sums + x, squares + x * x
    return np.where(n >= 2, np.maximum(_mean(squares, n, 0.0) - _mean(sums, n, 0.0) ** 2, 0), 0.0)


def pair_codes(s: Symbols) -> np.ndarray:
    """For each place the number in PAIRS of its class and that of the symbol APART on; -1 where one has no class."""
    table = np.full(256, -1)
    for k, letters in enumerate(CLASSES.values()):
        table[list(letters.encode())] = k
    kind = table[s.code]
    out = np.full(len(s), -1)
    if len(s) > APART:
        a, b = kind[:-APART], kind[APART:]
        out[:-APART] = np.where((a >= 0) & (b >= 0), a * len(CLASSES) + b, -1)
    return out


def pairs(s: Symbols, w: Windows) -> np.ndarray:
    """(pairs, windows): the share of each of PAIRS among the window's pairs; all 0 where it has none."""
    code = pair_codes(s)
    inside = (w[0], np.maximum(w[1] - APART, w[0]))
    n = counted(code >= 0, inside)
    return np.stack([_mean(counted(code == k, inside), n, 0.0) for k in range(len(PAIRS))])


def by_sequence(df: DataFrame, id_col: str, text_col: str, fields: str, made: Callable[[Symbols], Iterable[np.ndarray]]) -> DataFrame:
    """(id, fields): made() gives a column for each field from a sequence's symbols, all of one length; null and empty texts have no rows."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    names = [f.split() for f in fields.split(", ")]
    schema = pa.schema([("id", pa.int64()), *((n, kinds[k]) for n, k in names)])

    def run(batches):
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                columns = [np.asarray(c) for c in made(Symbols(text))]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(columns[0]), pa.int64()), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "")
    return rows.mapInArrow(run, f"id long, {fields}").withColumnRenamed("id", id_col)
