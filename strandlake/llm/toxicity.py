"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learnt from labels of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._labels import labelled_sample
from strandlake.llm._store import remainder
from strandlake.llm._text import LOWER, Hasher, Step, ranges, record_batch, steps

BUCKETS = 1 << 18
#: Standard errors by which a feature's shares have to differ; of 2 to 5 the best on a part of the training rows.
LEAST_Z = 4.0
#: Features that a step of the fit looks at.
BLOCK = 1 << 21
#: Words are runs of letters, digits and bytes over 127.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


#: Besides whole words, their first bytes are features: insults are inflected.
PREFIXES = (4, 5)


def bags(step: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each feature (a word or the start of one): its bucket and its sentence's index in the step; for each sentence: its document, and the bytes where it starts and ends.

    A sentence ends at . ! ? or a line's end. The features of a sentence stand together.
    """
    data = LOWER[step.data]
    start, end = ranges(_WORD[data], step.offsets)
    doc = np.searchsorted(step.offsets, start, "right") - 1
    hashed = Hasher(data)
    key = np.column_stack([hashed(start, end), *(hashed(start, np.minimum(end, start + k)) + np.uint64(k) for k in PREFIXES)])
    ends = np.concatenate([[0], np.cumsum(_STOP[data])])[start]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    bounds = np.column_stack([start[at], end[np.append(at[1:], len(end)) - 1]]) if len(at) else np.zeros((0, 2), np.int64)
    return (key % np.uint64(BUCKETS)).astype(np.int64).ravel(), np.repeat(np.cumsum(new) - 1, 1 + len(PREFIXES)), doc[new], bounds


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def excess(p: np.ndarray, none: float) -> np.ndarray:
    """How much less likely to be clean (in logs) a sentence of toxicity p is than one without any known word; never below 0."""
    return np.maximum(np.log1p(-none) - np.log1p(-np.minimum(p, 1 - 1e-12)), 0)


@dataclass
class Model:
    """A sentence is toxic with the logistic of bias + the sum of its words' weights."""

    bias: float
    weight: np.ndarray

    def sentences(self, step: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The toxicity of each sentence of the step, its document, and where it starts and ends in the step's bytes."""
        bucket, sentence, doc, bounds = bags(step)
        z = self.bias + np.bincount(sentence, self.weight[bucket], len(doc))
        return logistic(z), doc, bounds

    def joined(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or over each document's sentences, of what they have above a sentence without any known word: so a long clean text does not add up."""
        return np.maximum(-np.expm1(-np.bincount(doc, excess(p, logistic(self.bias)), n)), 0.0)

    def documents(self, step: Step) -> np.ndarray:
        p, doc, _ = self.sentences(step)
        return self.joined(p, doc, len(step))


def choose(seen: np.ndarray, toxic: np.ndarray, n: int, positives: int, least: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that get a weight, all whose shares of toxic and other documents differ by `least` standard errors or more, and the weights to begin with."""
    a, b = (toxic + 0.5) / (positives + 1), (seen - toxic + 0.5) / (n - positives + 1)
    share = seen / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positives + 1 / (n - positives)))
    z = np.where(seen > 0, (toxic / positives - (seen - toxic) / (n - positives)) / error, 0)
    kept = np.flatnonzero(np.abs(z) >= least)
    return kept, np.clip(np.log(a / b)[kept], 0, 3) * 0.5


@dataclass
class Bags:
    """Documents as bags of sentences: kept features (distinct in each sentence, sentence by sentence), how many each sentence has, sentences of each document, labels."""

    feature: np.ndarray
    size: np.ndarray
    per_doc: np.ndarray
    y: np.ndarray

    def blocks(self) -> list[tuple[slice, slice, slice]]:
        """Documents, sentences and features of parts with about BLOCK features each, so that a step of the fit holds little at once."""
        sentences = np.concatenate([[0], np.cumsum(self.per_doc)])
        features = np.concatenate([[0], np.cumsum(self.size)])[sentences]
        made, i = [], 0
        while i < len(self.y):
            j = max(i + 1, int(np.searchsorted(features, features[i] + BLOCK, "right")) - 1)
            made.append((slice(i, j), slice(sentences[i], sentences[j]), slice(features[i], features[j])))
            i = j
        return made


def likelihood(theta: np.ndarray, feature: np.ndarray, size: np.ndarray, per_doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The log-likelihood of documents' labels under what joined() scores, and its gradient by the weights and the bias (the last of theta)."""
    z = np.zeros(len(size))
    some = size > 0
    if some.any():
        z[some] = np.add.reduceat(theta[feature], (np.cumsum(size) - size)[some])
    p, none = logistic(z + theta[-1]), logistic(theta[-1])
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    clean = np.bincount(doc, excess(p, none), len(per_doc))
    toxic = np.maximum(-np.expm1(-clean), 1e-9)
    # By a document's excess: -1 for a clean document, (1 - P) / P for a toxic one. A sentence's excess grows by p with its weights, by p - none with the bias.
    pull = np.where(y > 0, (1 - toxic) / toxic, -1.0)[doc] * (z >= 0)
    grad = np.zeros_like(theta)
    grad[:-1] = np.bincount(feature, np.repeat(pull * p, size), len(theta) - 1)
    grad[-1] = (pull * (p - none)).sum()
    return float(np.where(y > 0, np.log(toxic), -clean).sum()), grad


def fit(bags: Bags, start: np.ndarray, rounds: int = 150, rate: float = 0.15, l2: float = 2e-6) -> np.ndarray:
    """The weights and the bias, by Adam on the noisy-or log-likelihood of the very scores that joined() gives."""
    theta = np.append(start, np.log(np.clip(bags.y.mean(), 1e-3, 0.5) / 20))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    blocks = bags.blocks()
    for t in range(1, rounds + 1):
        grad = sum(likelihood(theta, bags.feature[features].astype(np.intp), bags.size[sentences], bags.per_doc[docs], bags.y[docs])[1] for docs, sentences, features in blocks)
        grad = grad / len(bags.y)
        grad[:-1] -= l2 * np.sign(theta[:-1]) + l2 * theta[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return theta


def counted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents and toxic documents with each bucket, and of all."""
    schema = pa.schema([("bucket", pa.int32()), ("seen", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False) > 0
            for s in steps(b.column("text")):
                bucket, sentence, doc, _ = bags(s)
                of = y[s.first : s.last]
                key = np.unique(doc[sentence] * np.int64(BUCKETS) + bucket)
                for i, chosen in enumerate((key, key[of[key // BUCKETS]])):
                    total[i, :BUCKETS] += np.bincount(chosen % BUCKETS, minlength=BUCKETS)
                total[:, BUCKETS] += len(of), int(of.sum())
        some = np.flatnonzero(total[0])
        yield record_batch(schema, [some.astype(np.int32), total[0, some], total[1, some]])

    got = sample.select("text", "label").mapInArrow(run, "bucket int, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow().to_pandas()
    total = np.zeros((2, BUCKETS + 1), np.int64)
    total[:, got["bucket"].to_numpy()] = got["seen"].to_numpy(), got["toxic"].to_numpy()
    return total[0, :BUCKETS], total[1, :BUCKETS], int(total[0, BUCKETS]), int(total[1, BUCKETS])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Learn from at most max_rows labelled rows whose crc32 remainder by 3 is not 1.

    One pass counts the documents with each bucket, which chooses the features; a second brings these, four bytes each, to the
    driver. With labels of one kind only, or none, every sentence has the same low score.
    """
    sample = labelled_sample(docs, labels, "toxic", 3, lambda r: r != 1, max_rows)
    seen, toxic, n, positives = counted(sample)
    weight = np.zeros(BUCKETS)
    if not 0 < positives < n:
        return Model(float(np.log(np.clip(positives / max(n, 1), 1e-3, 0.5) / 20)), weight)
    kept, start = choose(seen, toxic, n, positives)
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("feature", pa.binary()), ("size", pa.binary())])

    def read(batches):
        for b in batches:
            ids, y = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)
            for s in steps(b.column("text")):
                bucket, sentence, doc, _ = bags(s)
                use = place[bucket] >= 0
                # A sentence's features count once each, however often they occur.
                pair = np.unique(sentence[use] * np.int64(len(kept) + 1) + place[bucket[use]])
                feature, size = (pair % (len(kept) + 1)).astype(np.int32), np.bincount(pair // (len(kept) + 1), minlength=len(doc)).astype(np.int32)
                at = np.searchsorted(doc, np.arange(len(s) + 1))
                cut = np.concatenate([[0], np.cumsum(size)])[at]
                yield record_batch(schema, [ids[s.first : s.last], y[s.first : s.last], *([x[i:j].tobytes() for i, j in zip(e[:-1], e[1:], strict=True)] for x, e in ((feature, cut), (size, at)))])

    got = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(read, "doc_id long, label int, feature binary, size binary").toArrow().to_pandas().sort_values(["doc_id", "feature", "size"], ignore_index=True)
    joined = Bags(np.frombuffer(b"".join(got["feature"]), np.int32), np.frombuffer(b"".join(got["size"]), np.int32), got["size"].str.len().to_numpy() // 4, (got["label"].to_numpy() > 0).astype(float))
    theta = fit(joined, start)
    weight[kept] = theta[:-1]
    return Model(float(theta[-1]), weight)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence, worst_score, offending) for each row, repeated rows included.

    worst_sentence is the index of the sentence with the highest score (ties: the first) among those with words, -1 if none.
    offending: start:end of each sentence that scores `least` or more, in code points from its first word to the end of its last, comma-joined.
    A null or empty text, or one without words, scores 0. A null id stays null and is not held out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_sentence", pa.int32()), ("worst_score", pa.float64()), ("offending", pa.string())])

    def run(batches):
        for b in batches:
            for s in steps(b.column("text")):
                p, doc, bounds = model.sentences(s)
                n = len(s)
                total = model.joined(p, doc, n)
                at, worst, top = np.searchsorted(doc, np.arange(n + 1)), np.full(n, -1), np.zeros(n)
                order = np.lexsort((np.arange(len(p)), -p, doc))
                some = at[1:] > at[:-1]
                first = order[at[:-1][some]]
                worst[some], top[some] = first - at[:-1][some], p[first]
                points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                where = [""] * n
                for i in np.flatnonzero(p >= least).tolist():
                    x, y = (points[bounds[i]] - points[s.offsets[doc[i]]]).tolist()
                    where[doc[i]] += f",{x}:{y}" if where[doc[i]] else f"{x}:{y}"
                yield record_batch(schema, [b.column("doc_id").slice(s.first, n), total, worst, top, where])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, worst_sentence int, worst_score double, offending string")
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_sentence", "worst_score", "offending")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    return score(docs, train(docs, labels, max_rows))
