"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._labels import labelled_sample
from strandlake.llm._store import remainder
from strandlake.llm._text import Step, hash_ranges, ranges, record_batch, steps, words

#: Bytes whose shares are features, by class.
_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" ", b"\n", b".", b",", b"!?", b"|", b"*", b"%", b"$", b"&", b"#", b"<>{}[]=_/\\", b"'\"-;:()", bytes(range(128, 256))]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _i
_N_CLASS = len(_CLASSES) + 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many distinct keys it has and how often its most frequent one occurs."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(step: Step) -> np.ndarray:
    """One row of statistics for each document; an empty text has zeros only."""
    n = len(step)
    size = np.diff(step.offsets).astype(float)
    doc_of_byte = np.repeat(np.arange(n), np.diff(step.offsets))
    shares = np.bincount(doc_of_byte * _N_CLASS + _CLASS[step.data], minlength=n * _N_CLASS).reshape(n, _N_CLASS) / np.maximum(size, 1)[:, None]
    w = words(step)
    count = w.per_doc.astype(float)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / some - mean**2, 0))
    one, most = _distinct(w.doc, w.hash, n)
    same = w.doc[1:] == w.doc[:-1]
    again = np.bincount(w.doc[1:][same & (w.hash[1:] == w.hash[:-1])], minlength=n) / some
    pairs, often = _distinct(w.doc[1:][same], (w.hash[1:] * np.uint64(3) + w.hash[:-1])[same], n)
    last = _CLASS[step.data[w.end - 1]] if len(w.end) else np.zeros(0, np.int64)
    odd = np.bincount(w.doc[(last >= 7) & (last <= 13)], minlength=n) / some
    stops = np.bincount(w.doc[(last == 5) | (last == 7)], minlength=n) / some
    start, end = ranges(~_NEWLINE[step.data], step.offsets)
    line_doc = np.searchsorted(step.offsets, start, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    own, _ = _distinct(line_doc, hash_ranges(step.data, start, end), n)
    return np.column_stack([shares, np.log1p(size), np.log1p(count), mean, spread, one / some, most / some, again, pairs / np.maximum(count - 1, 1), often / some, odd, stops, np.log1p(lines), own / np.maximum(lines, 1), count / np.maximum(lines, 1)])


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node k of a tree has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and (not len(node) or node[0] < inner):
                if not len(node):
                    break
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> Trees:
    """Logistic boosting; splits are found on histograms of quantile bins. Ties take the first feature and bin."""
    inner, n_leaf = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        none = np.zeros((0, inner))
        return Trees(float(np.log(p / (1 - p))), none.astype(np.int64), none, np.zeros((0, n_leaf)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    flat = binned + np.arange(m) * bins
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    made_f, made_t, made_v = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, low = 1 << level, (1 << level) - 1
            cell = ((node - low)[:, None] * (m * bins) + flat).ravel()
            sums = [np.bincount(cell, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < min_rows) | (nt - nl < min_rows)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[low + k], threshold[low + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, n_leaf) / (np.bincount(leaf, h, n_leaf) + l2)
        margin += value[leaf]
        made_f.append(feature), made_t.append(threshold), made_v.append(value)
    return Trees(base, np.array(made_f), np.array(made_t), np.array(made_v))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label: str = "quality") -> Trees:
    """Fit on at most max_rows labelled rows whose crc32 remainder by 5 is not 0; statistics are made on the executors."""
    sample = labelled_sample(docs, labels, label, 5, lambda r: r != 0, max_rows)
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def features(batches):
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False)
            for s in steps(b.column("text")):
                yield record_batch(schema, [y[s.first : s.last], list(statistics(s))])

    got = sample.select("text", "label").mapInArrow(features, "label int, x array<double>").toArrow().to_pandas()
    if not len(got):
        return fit(np.zeros((0, 1)), np.zeros(0))
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit does not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, repeated rows included.

    A null text counts as empty; empty texts get the score of all-zero statistics; a null id stays null and counts as held out (remainder 0).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for s in steps(b.column("text")):
                yield record_batch(schema, [b.column("doc_id").slice(s.first, len(s)), model.predict(statistics(s))])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows whose own text scores 0.3 or more, with all their columns; a row is judged where it stands, without a join."""
    clash = {c.lower() for c in docs.columns}
    column = next(c for c in ("score", *(f"score_{i}" for i in range(len(clash) + 1))) if c.lower() not in clash)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        made = [model.predict(statistics(s)) for s in steps(pa.array(texts, pa.large_string()))]
        return pd.Series(np.concatenate(made) if made else np.zeros(0))

    return docs.withColumn(column, of(F.col("text"))).where(F.col(column) >= 0.3).drop(column)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    return score(docs, train(docs, labels, max_rows))
