"""Molecular structures: atoms from mmCIF files, solvent-accessible surface, contacts, and global alignment of sequences.

A file, a chain and a pair of sequences are small; Spark deals them out, and numpy works on one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One-letter codes of the amino acids.
CODES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
#: The largest accessible surface of each amino acid, in square angstroms.
LARGEST = {"A": 129, "R": 274, "N": 195, "D": 193, "C": 167, "Q": 225, "E": 223, "G": 104, "H": 224, "I": 197, "L": 201, "K": 236, "M": 224, "F": 240, "P": 159, "S": 155, "T": 172, "W": 285, "Y": 263, "V": 174}
#: Van der Waals radii of elements, in angstroms; others have OTHER_RADIUS.
RADII, OTHER_RADIUS = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80}, 1.80
PROBE = 1.4
#: Cells of the tables of the pairs that are aligned together, a byte each.
CELLS = 8_000_000
ATOMS = "file string, chain string, residue long, code string, element string, x double, y double, z double"
_FIELD = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+")


def atom_rows(text: str) -> list[tuple]:
    """(chain, residue, code, element, x, y, z) of the first model's heavy atoms in amino acids; a residue is numbered as the authors do. Broken rows are left out."""
    names: list[str] = []
    made, first = [], None
    for line in text.splitlines():
        if line.startswith("_atom_site."):
            names.append(line.split()[0].removeprefix("_atom_site."))
        elif names and line.startswith(("ATOM", "HETATM")):
            row = dict(zip(names, (x.strip("'\"") for x in _FIELD.findall(line)), strict=False))
            first = first or row.get("pdbx_PDB_model_num", "1")
            code, element = CODES.get(row.get("label_comp_id", "")), row.get("type_symbol", "").upper()
            if code is None or element in ("H", "D", "") or row.get("pdbx_PDB_model_num", "1") != first or row.get("label_alt_id", ".") not in (".", "?", "A"):
                continue
            try:
                made.append((row.get("auth_asym_id") or row["label_asym_id"], int(row.get("auth_seq_id") or row["label_seq_id"]), code, element, *(float(row[f"Cartn_{c}"]) for c in "xyz")))
            except (KeyError, ValueError):
                continue
        elif names and made and line.startswith(("#", "loop_", "_")):
            break
    return made


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """One row for each atom, from whole files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def read(frames):
        for f in frames:
            yield pd.DataFrame([(file, *a) for file, text in zip(f["file"], f["value"], strict=True) for a in atom_rows(text)], columns=[c.split()[0] for c in ATOMS.split(", ")])

    return rows.mapInPandas(read, ATOMS)


def sphere(points: int) -> np.ndarray:
    """Points spread evenly over the unit sphere, on a golden spiral."""
    k = np.arange(points) + 0.5
    polar, turn = np.arccos(1 - 2 * k / points), np.pi * (1 + 5**0.5) * k
    return np.column_stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)])


def _taken(xyz: np.ndarray, width: float) -> Callable[[np.ndarray], np.ndarray]:
    """A test of whether points lie in a cell of this width that holds one of xyz."""
    known = xyz[np.isfinite(xyz).all(1)]
    if not len(known) or not width > 0:
        return lambda p: np.zeros(p.shape[:-1], bool)
    low = known.min(0)
    size = np.floor((known.max(0) - low) / width) + 1
    if np.prod(size) > 2**62:
        return lambda p: np.zeros(p.shape[:-1], bool)
    number = lambda c: ((c[..., 0] * size[1] + c[..., 1]).astype(np.int64) * int(size[2])) + c[..., 2].astype(np.int64)
    cells = np.unique(number(np.floor((known - low) / width)))

    def test(p: np.ndarray) -> np.ndarray:
        c = np.floor((p - low) / width)
        inside = ((c >= 0) & (c < size)).all(-1)
        n = number(np.where(inside[..., None], c, 0))
        return inside & (cells[np.minimum(np.searchsorted(cells, n), len(cells) - 1)] == n)

    return test


def exposed(xyz: np.ndarray, radius: np.ndarray, points: int, own: np.ndarray | None = None) -> np.ndarray:
    """Accessible area of each atom (or of those numbered in own): the share of points on its sphere that are in no other's; radii include the probe.

    A point in a cell with an atom, whose diagonal is below every radius, is inside that atom's sphere; only the points of other cells are held against atoms near. Where atoms lie close, few
    points are left.
    """
    own = np.arange(len(xyz)) if own is None else own
    unit, made = sphere(points), np.zeros(len(own))
    taken = _taken(xyz, radius.min() / 2 if len(radius) else 0.0)
    for start in range(0, len(own), 500):
        some = own[start : start + 500]
        at = xyz[some][:, None, :] + radius[some][:, None, None] * unit
        free = ~taken(at)
        for k in np.flatnonzero(free.any(1)):
            i, left = some[k], np.flatnonzero(free[k])
            apart = ((xyz - xyz[i]) ** 2).sum(1)
            near = np.flatnonzero((apart < (radius + radius[i]) ** 2) & (np.arange(len(xyz)) != i))
            # The nearest atoms first: most points are inside one of them.
            near = near[np.argsort(apart[near], kind="stable")]
            for first in range(0, len(near), 64):
                n = near[first : first + 64]
                left = left[~((((at[k, left])[:, None, :] - xyz[None, n]) ** 2).sum(2) < radius[n] ** 2).any(1)]
                if not len(left):
                    break
            made[start + k] = 4 * np.pi * radius[i] * radius[i] * (len(left) / points)
    return made


def surface(atoms: DataFrame, points: int = 200, least: float = 0.20) -> DataFrame:
    """(file, chain, residue, code, area, relative, is_surface) of each residue: rolled over by a probe, alone in its chain, against the largest area of its kind.

    A chain is cut into cells as wide as two atoms reach; a task has a cell's atoms and those of the cells around, so that a large chain is many tasks' work.
    """
    reach = 2 * (max(*RADII.values(), OTHER_RADIUS) + PROBE)
    near = F.array(*(F.lit(s) for s in (-1, 0, 1)))
    rows = atoms.select("file", "chain", "residue", "code", "element", "x", "y", "z", F.lit(True).alias("own"))
    for c in "xyz":
        # A little wider than the reach, since quotients are rounded; atoms without a place touch nothing.
        rows = rows.withColumn("_s", F.explode(near)).withColumn("own", F.col("own") & (F.col("_s") == 0)).withColumn(f"c{c}", F.coalesce(F.floor(F.col(c) / (reach * (1 + 1e-9))).cast("long"), F.lit(0)) + F.col("_s")).drop("_s")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.flatnonzero(rows["own"].to_numpy())
        if not len(own):  # a cell beside others, without atoms of its own
            return pd.DataFrame(columns=[c.split()[0] for c in f"{ATOMS}, area double".split(", ")])
        radius = rows["element"].map(RADII).fillna(OTHER_RADIUS).to_numpy() + PROBE
        made = rows.iloc[own][["file", "chain", "residue", "code", "element", "x", "y", "z"]].copy()
        made["area"] = exposed(rows[["x", "y", "z"]].to_numpy(float), radius, points, own)
        return made

    areas = rows.groupBy("file", "chain", "cx", "cy", "cz").applyInPandas(one, f"{ATOMS}, area double")
    # Summed in one order, so that partitions don't change the last bits.
    listed = F.array_sort(F.collect_list(F.struct("element", "x", "y", "z", "area")))
    found = areas.dropna(subset=["file", "chain", "residue", "code"]).groupBy("file", "chain", "residue", "code").agg(F.aggregate(listed, F.lit(0.0), lambda total, a: total + a["area"]).alias("area"))
    largest = F.create_map(*(F.lit(x) for kind in LARGEST.items() for x in kind))[F.col("code")]
    return found.withColumn("relative", F.col("area") / largest).withColumn("is_surface", F.coalesce(F.col("relative") >= least, F.lit(False)))


def contacts(a: DataFrame, b: DataFrame, reach: float = 5.0) -> DataFrame:
    """(file, chain, residue) of a with an atom within reach of one of b in the same file: atoms meet in cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left, right = a.select("file", "chain", "residue", "x", "y", "z", *(cell(c).alias(f"c{c}") for c in "xyz")), b.select("file", *(F.col(c).alias(f"{c}2") for c in "xyz"), *(cell(c).alias(f"d{c}") for c in "xyz"))
    for c in "xyz":
        right = right.withColumn("step", F.explode(near)).withColumn(f"c{c}", F.col(f"d{c}") + F.col("step")).drop("step")
    apart = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz")
    return left.join(right, ["file", "cx", "cy", "cz"]).where(apart <= reach * reach).select("file", "chain", "residue").distinct()


def _scored(a: Sequence[str], b: Sequence[str], score: Callable[[str, str], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols of all texts of a and of b (rows filled with 0), and the scores of each symbol of a with each of b."""
    made, kinds = [], []
    for texts in (a, b):
        known = {x: i for i, x in enumerate(sorted(set("".join(texts))))}
        codes = np.zeros((len(texts), max(map(len, texts))), np.int64)
        for row, t in zip(codes, texts, strict=True):
            row[: len(t)] = [known[x] for x in t]
        made.append(codes)
        kinds.append(known)
    return *made, np.array([[score(x, y) for y in kinds[1]] for x in kinds[0]]).reshape(len(kinds[0]), len(kinds[1]))


def aligned_all(a: Sequence[str], b: Sequence[str], score: Callable[[str, str], float], opening: float = -10.0, longer: float = -0.5) -> list[list[tuple[int, int]]]:
    """For each pair of texts, the pairs of places, from 0, that a best global alignment puts together; a gap costs `opening` and `longer` for each symbol after its first.

    Ties go to a pair, then to a gap in b. Cells of one diagonal, of all pairs of texts, are one step; what came before a cell is one byte.
    """
    if not len(a):
        return []
    x, y, table = _scored(a, b, score)
    (n, m), count = (x.shape[1], y.shape[1]), len(a)
    ends_a, ends_b = (np.array([len(t) for t in texts]) for texts in (a, b))
    none = np.full((3, count, n + 1), -np.inf)  # ends with a pair, with a symbol of a beside a gap, of b beside a gap
    before, last = none.copy(), none.copy()  # the diagonals two back and one back, by place in a
    came = np.zeros((n + m + 1, count, n + 1), np.int8)
    final = np.zeros(count, np.int64)
    gaps = [np.array(g)[:, None, None] for g in ((opening, longer, opening), (opening, opening, longer))]
    for d in range(n + m + 1):
        now = none.copy()
        if d == 0:
            now[0, :, 0] = 0
        lo, hi = max(0, d - m), min(n, d)
        for k, (first, end, source, shift) in enumerate(((max(1, lo), min(n, d - 1), before, 1), (max(1, lo), hi, last, 1), (lo, min(n, d - 1), last, 0))):
            if first > end:
                continue
            # Places in a of the diagonal's cells; for a pair and a gap in b the cell before is one place less in a.
            i = np.arange(first, end + 1)
            values = source[:, :, first - shift : end + 1 - shift] + (gaps[k - 1] if k else 0.0)
            best = values.argmax(0)
            now[k, :, first : end + 1] = np.take_along_axis(values, best[None], 0)[0] + (table[x[:, i - 1], y[:, d - i - 1]] if not k else 0.0)
            came[d, :, first : end + 1] += (best * 3**k).astype(np.int8)
        over = np.flatnonzero(ends_a + ends_b == d)
        final[over] = now[:, over, ends_a[over]].argmax(0)
        before, last = last, now
    i, j, k = ends_a.copy(), ends_b.copy(), final
    steps = []
    row = np.flatnonzero((i > 0) | (j > 0))
    while len(row):
        own = k[row]
        paired = row[own == 0]
        steps.append((paired, i[paired] - 1, j[paired] - 1))
        k[row] = came[i[row] + j[row], row, i[row]] // 3**own % 3
        i[row] -= own != 2
        j[row] -= own != 1
        row = row[(i[row] > 0) | (j[row] > 0)]
    made: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    for rows, p, q in reversed(steps):
        for r, u, v in zip(rows.tolist(), p.tolist(), q.tolist(), strict=True):
            made[r].append((u, v))
    return made


def aligned(a: str, b: str, score: Callable[[str, str], float], opening: float = -10.0, longer: float = -0.5) -> list[tuple[int, int]]:
    """The alignment of two texts, as aligned_all()."""
    return aligned_all([a], [b], score, opening, longer)[0]


def align(pairs: DataFrame, key: str, a: str, b: str, score: Callable[[str, str], float]) -> DataFrame:
    """(key, places) for each row: places are the aligned pairs, from 0. score: any matrix of substitutions. Null sequences are empty.

    Pairs of like lengths are aligned together, as many as have CELLS cells.
    """

    def run(batches):
        for batch in batches:
            x, y = ([t or "" for t in batch.column(c).to_pylist()] for c in (a, b))
            size = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
            order = np.lexsort((size[:, 1], size[:, 0]))
            start = 0
            while start < len(order):
                # The largest block of the next pairs whose padded tables have CELLS cells at most, one pair at least.
                part = size[order[start : start + 4096]]
                cells = np.arange(1, len(part) + 1) * (np.maximum.accumulate(part.sum(1)) + 1) * (np.maximum.accumulate(part[:, 0]) + 1)
                rows = order[start : start + max(1, int((cells <= CELLS).sum()))]
                start += len(rows)
                made = aligned_all([x[r] for r in rows], [y[r] for r in rows], score)
                flat = np.array([p for places in made for p in places], np.int32).reshape(-1, 2)
                places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])
                offsets = pa.array(np.append(0, np.cumsum([len(p) for p in made])), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, places)], names=[key, "places"])

    dealt = pairs.select(key, a, b).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, places array<struct<a: int, b: int>>")
