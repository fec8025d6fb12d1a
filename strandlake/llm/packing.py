"""Packing by lexical retrieval: a sharded BM25 index finds unused neighbours, which fill each seed's window."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import save
from strandlake.llm._text import Step, mix, record_batch, steps, words

WINDOW = 2048
END_ID = 1
#: Documents to a shard of the index.
SHARD_DOCS = 2048
K1, B = 1.2, 0.75
#: Postings from which on a term of a shard has a row of weights for all of its pieces: at most a 128th as many rows as postings.
DENSE = 128
#: Distinct words, and parts of words, whose ids a Python worker remembers (some 40 and 250 bytes each).
CACHE_WORDS, CACHE_PARTS = 3 << 19, 1 << 18
#: Words of these characters only are split here as the vocabulary's own rules do; any other word goes to the tokenizer whole.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Coder:
    """Ids of whole texts. White space always parts tokens in this vocabulary, so that each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Bytes are written as printable characters before merging: the printable ones of Latin-1 as themselves, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.parts.clear()

    def part(self, text: str) -> list[int]:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            found = self.parts[text] = [t.id for t in self.tok.model.tokenize("".join(map(self.char.__getitem__, text.encode())))]
        return found

    def word(self, text: str) -> list[int]:
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return self.tok.encode(text, add_special_tokens=False).ids
        parts = _PARTS.findall(text.lower())
        return self.part(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.part(p)]

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        coded = [self.word(t) for t in texts]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size + len(self.flat)
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.begin, self.size = np.insert(self.hash, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, step: Step) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each document with the end id, one document after the other, and where each begins."""
        w = words(step, lower=False)
        kinds, first, same = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hash, kinds)
        new = np.ones(len(kinds), bool)
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != kinds
        if new.any():
            raw = step.data.tobytes()
            self.learn(kinds[new], [raw[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hash, kinds)
        n = len(step)
        per_word = self.size[at][same]
        out_at = np.concatenate([[0], np.cumsum(np.bincount(w.doc, per_word, n).astype(np.int64) + 1)])
        out = np.empty(out_at[-1], np.uint32)
        out[out_at[1:] - 1] = END_ID
        before = np.cumsum(per_word) - per_word
        inner = np.arange(int(per_word.sum())) - np.repeat(before, per_word)
        # A word's ids go after those of the words before it and the ends of the documents before its own.
        out[np.repeat(before + w.doc, per_word) + inner] = self.flat[np.repeat(self.begin[at][same], per_word) + inner]
        return out, out_at


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


@dataclass
class Statistics:
    """Over all pieces: how many there are, their mean length, and the pieces that have each term."""

    n: int
    mean: float
    df: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def order(self) -> np.ndarray:
        """A place for each term, the same everywhere: at random, but the sooner the rarer the term is. A term of one piece stands last."""
        u = (mix(np.arange(len(self.df), dtype=np.uint64), 5) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        at = np.where(self.df > 1, -np.log(u + 2.0**-60) / np.maximum(self.idf, 1e-9), np.inf)
        place = np.empty(len(at), np.int64)
        place[np.argsort(at, kind="stable")] = np.arange(len(at))
        return place


def bags(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' distinct terms, piece by piece: (piece, term, count), and the lengths of the pieces. Terms are token ids."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    term = np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)
    key, count = np.unique((np.repeat(np.arange(len(pieces)), length) << 32) | term, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count, length


def statistics(cut: DataFrame) -> Statistics:
    """The driver gets a row for each term, of which there are no more than the vocabulary has."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("pieces", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            _, term, _, length = bags(unpacked(b.column("ids").to_pylist()))
            seen = np.bincount(term, minlength=len(df))
            seen[: len(df)] += df
            df, n, tokens = seen, n + len(length), tokens + int(length.sum())
        some = np.flatnonzero(df)
        yield record_batch(schema, [np.append(some, -1), np.append(df[some], 0), np.append(np.zeros(len(some), np.int64), n), np.append(np.zeros(len(some), np.int64), tokens)])

    got = cut.select("ids").mapInArrow(run, "term long, df long, pieces long, tokens long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "pieces", "tokens"))).toArrow().to_pandas()
    n, tokens = int(got["pieces"].sum()), int(got["tokens"].sum())
    df = np.zeros(max(1, int(got["term"].max()) + 1 if len(got) else 1), np.int64)
    some = got[got["term"] >= 0]
    df[some["term"].to_numpy()] = some["df"].to_numpy()
    return Statistics(n, tokens / max(n, 1), df)


def unpacked(ids: list[bytes]) -> list[np.ndarray]:
    """Ids of pieces: a first byte tells their width, 2 or 4 bytes."""
    return [np.frombuffer(x, np.uint16 if x[:1] == b"2" else np.uint32, offset=4).astype(np.uint32) for x in ids]


def packed(ids: np.ndarray) -> bytes:
    return (b"2   " + ids.astype(np.uint16).tobytes()) if ids.max() < 65536 else (b"4   " + ids.astype(np.uint32).tobytes())


class Index:
    """BM25 over a shard's pieces, with the statistics of all pieces. Used pieces are skipped."""

    def __init__(self, pieces: list[np.ndarray], about: Statistics | None = None) -> None:
        self.doc, self.term, count, length = bags(pieces)
        width = int(self.term.max()) + 1 if len(self.term) else 1
        about = about or Statistics(len(pieces), float(length.mean()) if len(length) else 1.0, np.bincount(self.term, minlength=width))
        self.begin = np.searchsorted(self.doc, np.arange(len(pieces) + 1))
        norm = K1 * (1 - B + B * length / max(1.0, about.mean))
        weight = about.idf[self.term] * count * (K1 + 1) / (count + norm[self.doc])
        order = np.argsort(self.term, kind="stable")
        self.by_doc, self.by_weight = self.doc[order], weight[order]
        kinds, first = np.unique(self.term[order], return_index=True)
        ends = np.append(first[1:], len(order))
        at = np.searchsorted(kinds, self.term)
        # Frequent terms have a row each; of others, each piece's postings are ranges of by_doc.
        many = np.flatnonzero(ends - first >= DENSE)
        row = np.full(len(kinds), -1)
        row[many] = np.arange(len(many))
        self.row, self.low, self.high = row[at], first[at], ends[at]
        self.dense = np.zeros((len(many), len(pieces)))
        some = self.row >= 0
        self.dense[self.row[some], self.doc[some]] = weight[some]

    def scores(self, seed: int, n: int) -> np.ndarray:
        """Each piece's score for all of the seed's terms."""
        own = slice(self.begin[seed], self.begin[seed + 1])
        row, low, high = self.row[own], self.low[own], self.high[own]
        rare = row < 0
        low, size = low[rare], (high - low)[rare]
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.by_doc[at], self.by_weight[at], n) + self.dense[row[~rare]].sum(0)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused pieces that share a term with the seed, best first; ties by index."""
        score = self.scores(seed, len(used))
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def fill(pieces: list[np.ndarray], about: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, to). Each window starts with the first unused piece as its seed and takes its neighbours in order.

    The last one taken is cut where the window is full, and its rest is the next seed. Without unused neighbours the next
    unused piece is taken. What is left at the end of the shard is cut into powers of two, so that nothing is padded.
    """
    index, used = Index(pieces, about), np.zeros(len(pieces), bool)
    made: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, cursor = WINDOW, 0
    rest: tuple[int, int] | None = None
    while True:
        if rest:
            seed, start = rest
            rest = None
        else:
            while cursor < len(pieces) and used[cursor]:
                cursor += 1
            if cursor == len(pieces):
                break
            seed, start = cursor, 0
            used[seed] = True
        queue = [(seed, start)]
        near = None
        k = 0
        while queue:
            piece, start = queue.pop()
            end = min(len(pieces[piece]), start + room)
            window.append((piece, start, end))
            room -= end - start
            if not room:
                made.append(window)
                window, room = [], WINDOW
                if end < len(pieces[piece]):
                    rest = (piece, end)
                break
            if near is None:
                near = index.neighbours(seed, used)
            if k < len(near):
                queue.append((int(near[k]), 0))
                used[near[k]] = True
                k += 1
    left = WINDOW - room
    while left:  # binary digits of what is left, largest first
        want = 1 << (left.bit_length() - 1)
        left -= want
        one: list[tuple[int, int, int]] = []
        while want:
            piece, a, b = window.pop(0)
            take = min(want, b - a)
            one.append((piece, a, a + take))
            want -= take
            if a + take < b:
                window.insert(0, (piece, a + take, b))
        made.append(one)
    return made


def pack(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece.

    Full windows of a long document are sequences of their own. The rests, shorter than a window, are put in the order of
    their first and second terms in one random order of all terms that favours rare ones: pieces that share rare terms come to stand
    together. Shards are runs of SHARD_DOCS pieces in this order; in each, an index with the statistics of all pieces finds a
    seed's neighbours. Null and empty texts have the end id only; a null id stays null; repeated rows are packed one by
    one. sequence_id: even for a full window, odd for a shard's.
    """
    cut_schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])

    def tokenize(batches):
        for b in batches:
            row, doc_ids = b.column("row").to_pylist(), b.column("doc_id").to_pylist()
            for s in steps(b.column("text")):
                tokens, at = coder(path).ids(s)
                made = []
                for i, begin, n in zip(range(s.first, s.last), at.tolist(), np.diff(at).tolist(), strict=False):
                    own, rest = tokens[begin : begin + n], n % WINDOW
                    for start in range(0, n - rest, WINDOW):
                        made.append((doc_ids[i], row[i], start, n, zlib.crc32(own[start : start + WINDOW]), None))
                    if rest:
                        made.append((doc_ids[i], row[i], n - rest, n, None, packed(own[n - rest :])))
                yield record_batch(cut_schema, list(zip(*made, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    cut = save(spark, rows.mapInArrow(tokenize, "doc_id long, row long, start long, doc_tokens long, crc long, ids binary"), "pieces")
    tails = cut.where("ids IS NOT NULL").select("doc_id", "row", "start", "doc_tokens", "ids")
    about = spark.sparkContext.broadcast(statistics(tails))
    keyed_schema = pa.schema([*(cut_schema.field(c) for c in tails.columns), ("first", pa.int64()), ("second", pa.int64())])

    def key(batches):
        place = about.value.order()
        for b in batches:
            doc, term, _, length = bags(unpacked(b.column("ids").to_pylist()))
            if not len(length):
                continue
            at = np.searchsorted(doc, np.arange(len(length)))
            own = place[term]
            first = np.minimum.reduceat(own, at)
            own[own == first[doc]] = np.iinfo(np.int64).max
            yield record_batch(keyed_schema, [*b.columns, first, np.minimum.reduceat(own, at)])

    shards = max(1, -(-about.value.n // SHARD_DOCS))
    order = ["first", "second", "row", "start"]
    near = tails.mapInArrow(key, ", ".join(f"{c} {t}" for c, t in tails.dtypes) + ", first long, second long").repartitionByRange(-(-shards // 4), *order).sortWithinPartitions(*order)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def shard(columns: list[list], sequence: int) -> list[tuple]:
        doc_id, start, total, ids = columns
        pieces, made = unpacked(ids), []
        for q, parts in enumerate(fill(pieces, about.value)):
            offset = 0
            for p, a, b in parts:
                made.append((doc_id[p], start[p] + a, b - a, zlib.crc32(pieces[p][a:b]), total[p], 2 * (sequence + q) + 1, offset))
                offset += b - a
        return made

    def run(batches):
        sequence, held = TaskContext.get().partitionId() << 32, None
        for b in batches:
            new = [b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
            held = new if held is None else [x + y for x, y in zip(held, new, strict=True)]
            while len(held[0]) >= SHARD_DOCS:
                made = shard([x[:SHARD_DOCS] for x in held], sequence)
                held, sequence = [x[SHARD_DOCS:] for x in held], sequence + len(made)
                yield record_batch(schema, list(zip(*made, strict=True)))
        if held and held[0]:
            yield record_batch(schema, list(zip(*shard(held, sequence), strict=True)))

    full = cut.where("ids IS NULL").select("doc_id", "start", F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(near.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in schema.names)))
