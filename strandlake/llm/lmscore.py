"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram model over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import remainder, save
from strandlake.llm._text import Step, mix, record_batch, steps, words

#: Bytes of context of the longest kind.
ORDER = 5
#: Stands before a text (as context) and ends it; UTF-8 never has this byte.
MARK = 255
#: Bytes of text to a block, about: what one group of the scoring step holds. A longer document is a block by itself, or makes its block longer.
BLOCK_BYTES = 1 << 24
#: Bytes of context by whose hash counts are dealt: a longer context is in its ending's shard. Shorter ones are counted over all texts and broadcast.
SHARED = 2
#: Shards for each block of documents.
SHARDS = 2
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(step: Step) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and each text's end: the ORDER bytes before it and itself as one number; and where each document begins among them."""
    n, size = len(step), np.diff(step.offsets)
    begin = step.offsets[:-1] + np.arange(n) * (ORDER + 1)
    padded = np.full(len(step.data) + n * (ORDER + 1), MARK, np.uint64)
    padded[np.arange(len(step.data)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, size)] = step.data
    end = len(padded) - ORDER
    g = padded[:end].copy()
    for k in range(1, ORDER + 1):
        g = (g << np.uint64(8)) | padded[k : end + k]
    keep = np.ones(end, bool)
    # A document's first number begins at its first mark; those that begin later than its end belong to none.
    late = (begin[1:, None] - np.arange(1, ORDER + 1)).ravel()
    keep[late] = False
    return g[keep], np.concatenate([[0], np.cumsum(size + 1)])


class Trie:
    """Counts of symbols by context of ORDER bytes down to none. A context's escape is as likely as it has distinct symbols (method C).

    After an escape the symbols of the longer context are excluded. As counts of shorter contexts are sums over longer
    ones, a longer context's symbols all occur in the shorter: what is excluded at a level is known from the context above.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, longest: int = ORDER, shared: list[dict] | None = None) -> None:
        """shared: the levels of SHARED bytes of context and fewer, where key has only one shard of all numbers."""
        self.levels = []
        k, c = key.astype(np.uint64), count.astype(np.int64)
        below: tuple | None = None
        for width in range(longest, -1, -1):
            if shared is not None and width == SHARED:
                longer, longer_where, n_longer = below
                at = np.searchsorted(shared[0]["key"], longer & self.mask(width))
                self.levels[-1]["excluded"] = np.bincount(longer_where, shared[0]["count"][at], n_longer)
                self.levels += shared
                break
            context, where = np.unique(k >> np.uint64(8), return_inverse=True)
            if below:  # the sum, at this level, of the counts of each longer context's symbols
                longer, longer_where, n_longer = below
                at = np.searchsorted(k, longer & self.mask(width))
                self.levels[-1]["excluded"] = np.bincount(longer_where, c[at], n_longer)
            self.levels.append({"key": k, "count": c, "context": context, "total": np.bincount(where, c, len(context)), "kinds": np.bincount(where, minlength=len(context))})
            below = (k, where, len(context))
            if width:
                k, inverse = np.unique(k & self.mask(width - 1), return_inverse=True)
                c = np.bincount(inverse, c, len(k)).astype(np.int64)
        top = self.levels[0]
        at = np.searchsorted(top["context"], top["key"] >> np.uint64(8))
        value = np.log10(top["count"] / (top["total"] + top["kinds"])[at]) if len(at) else np.zeros(0)
        self.shift = np.uint64(64 - min(24, max(10, (2 * max(1, len(value))).bit_length())))
        slot = self.slot(top["key"])
        self.table_key = np.full(1 << int(64 - self.shift), np.iinfo(np.uint64).max)
        self.table_value = np.zeros(len(self.table_key))
        self.table_key[slot], self.table_value[slot] = top["key"], value

    @staticmethod
    def mask(width: int) -> np.uint64:
        return np.uint64((1 << 8 * (width + 1)) - 1)

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g * _MULT) >> self.shift

    def walk(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each number's last byte after those before it, from the longest context down."""
        out, open_ = np.zeros(len(g)), np.ones(len(g), bool)
        n_out, k_out = np.zeros(len(g)), np.zeros(len(g))
        for width, level in zip(range(ORDER, -1, -1), self.levels, strict=True):
            low = g & self.mask(width)
            at = np.minimum(np.searchsorted(level["context"], low >> np.uint64(8)), max(0, len(level["context"]) - 1))
            if not len(level["context"]):
                continue
            there = level["context"][at] == low >> np.uint64(8)
            total, kinds = np.where(there, level["total"][at] - n_out, 0), np.where(there, level["kinds"][at] - k_out, 0)
            i = np.minimum(np.searchsorted(level["key"], low), len(level["key"]) - 1)
            hit = open_ & (level["key"][i] == low)
            some = np.maximum(total + kinds, 1)
            out[hit] += np.log10(level["count"][i][hit] / some[hit])
            open_ &= ~hit
            left = open_ & (kinds > 0)
            out[left] += np.log10(kinds[left] / some[left])
            n_out = np.where(there, level["excluded"][at], 0) if width else n_out
            k_out = np.where(there, level["kinds"][at], 0)
        out[open_] -= np.log10(256 - k_out[open_])
        return out

    def logs(self, g: np.ndarray) -> np.ndarray:
        slot = self.slot(g)
        out = self.table_value[slot]
        miss = np.flatnonzero(self.table_key[slot] != g)
        if len(miss):
            kinds, inverse = np.unique(g[miss], return_inverse=True)
            out[miss] = self.walk(kinds)[inverse]
        return out


def merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(key, return_inverse=True)
    return key, np.bincount(inverse, count, len(key)).astype(np.int64)


def tallied(g: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ORDER + 1 bytes, and how often each is seen; one sort, with `seen` as the lowest bit."""
    both = np.sort((g << np.uint64(1)) | seen.astype(np.uint64))
    k = both >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(k) else np.zeros(0, np.int64))


class Lookup:
    """Places of known keys among sorted ones: a table by hash answers most, the rest is searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(8, (2 * max(1, len(keys))).bit_length()))
        self.place = np.zeros(1 << int(64 - self.shift), np.int32)
        self.place[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULT) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self.slot(keys)].astype(np.int64)
        if len(keys):
            miss = np.flatnonzero(self.keys[at] != keys)
            some, inverse = np.unique(keys[miss], return_inverse=True)
            at[miss] = np.searchsorted(self.keys, some)[inverse]
        return at


def short_contexts(docs: DataFrame) -> list[dict]:
    """The levels of SHARED bytes of context and fewer, over all whole training texts (crc32 remainder by 10 is not 0)."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(1 << 8 * (SHARED + 1), np.int32)
        for b in batches:
            for s in steps(b.column("text")):
                g = np.sort((grams(s)[0] & Trie.mask(SHARED)).astype(np.uint32))
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                total[g[first]] += np.diff(np.append(first, len(g))).astype(np.int32)
        key = np.flatnonzero(total)
        yield record_batch(schema, [key, total[key].astype(np.int64)])

    seen = docs.where(remainder("doc_id", 10) != 0).select("text").mapInArrow(run, "gram long, n long")
    got = seen.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    return Trie(got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy(), SHARED).levels


def blocks(docs: DataFrame, n: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", (remainder("doc_id", 10) != 0).alias("train")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def known(spark: SparkSession, docs: DataFrame, parts: DataFrame, n_shards: int) -> DataFrame:
    """(block, long, keys, values, n, kinds): a block's distinct words, or numbers of bytes (long), that one shard has, packed as 64-bit numbers.

    values: how often the word occurs in all training texts, or log10 of the number's probability in the trie of all of them.
    n: the words' occurrences in the block's training texts. kinds: words of the shard that occur in training texts, at one of its rows. Words go by 64-bit hashes.
    """
    counts = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("long", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
    values = pa.schema([("block", pa.int32()), ("long", pa.bool_()), ("keys", pa.binary()), ("values", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64())])
    shared = spark.sparkContext.broadcast(short_contexts(docs))

    def count(block, table):
        train = table.column("train").combine_chunks().to_numpy(zero_copy_only=False)
        found = {False: [], True: []}
        for s in steps(table.column("text")):
            w, (g, at) = words(s), grams(s)
            learn = train[s.first : s.last]
            found[False].append(merged(w.hash, learn[w.doc]))
            found[True].append(tallied(g, np.repeat(learn, np.diff(at))))
        made = []
        for long, parts_ in found.items():
            k, c = merged(*(np.concatenate(x) for x in zip(*parts_, strict=True))) if parts_ else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            end = (k >> np.uint64(8)) & np.uint64((1 << 8 * (SHARED + 1)) - 1) if long else k
            shard = (mix(end) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            some, first = np.unique(shard[order], return_index=True)
            k, c = k[order], c[order].astype(np.int32)
            for i, x, y in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(k)], strict=True):
                made.append((block[0].as_py(), i, long, k[x:y].tobytes(), c[x:y].tobytes()))
        return pa.Table.from_batches([record_batch(counts, list(zip(*made, strict=True)))] if made else [], schema=counts)

    def values_of(_, table):
        is_long = table.column("long").to_pylist()
        block, keys, n = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
        made = []
        for long in (False, True):
            here = [i for i, x in enumerate(is_long) if x == long]
            if not here:
                continue
            own = np.frombuffer(b"".join(keys[i] for i in here), np.uint64)
            times = np.frombuffer(b"".join(n[i] for i in here), np.int32)
            k, inverse = np.unique(own, return_inverse=True)
            c = np.bincount(inverse, times, len(k)).astype(np.int64)
            value = (Trie(k[c > 0], c[c > 0], shared=shared.value).logs(k) if long else c.astype(np.float64))[inverse]
            at = np.concatenate([[0], np.cumsum([len(keys[i]) // 8 for i in here])]).tolist()
            for j, i in enumerate(here):
                made.append((block[i], long, keys[i], value[at[j] : at[j + 1]].tobytes(), int(times[at[j] : at[j + 1]].sum()), int((c > 0).sum()) if j == 0 else 0))
        return pa.Table.from_batches([record_batch(values, list(zip(*made, strict=True)))], schema=values)

    per_block = parts.groupBy("block").applyInArrow(count, "block int, shard int, long boolean, keys binary, counts binary")
    return save(spark, per_block.groupBy("shard").applyInArrow(values_of, "block int, long boolean, keys binary, values binary, n long, kinds long"), "known")


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, repeated rows included.

    A null text is empty: one token, its end, and the model's probability of ending at once. A null id counts as held out.
    Without training rows N and V are 0.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(remainder("doc_id", 10) != 0).alias("ends")).first()
    n_blocks, ends = max(1, -(-size["bytes"] // BLOCK_BYTES)), size["ends"]
    parts = blocks(docs, n_blocks)
    found = known(spark, docs, parts, SHARDS * n_blocks)
    sums = found.where("not long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    total, kinds = sums["n"] + ends, sums["kinds"] + (ends > 0)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(_, table, dictionary):
        is_long = dictionary.column("long").to_pylist()
        keys, values = (dictionary.column(c).to_pylist() for c in ("keys", "values"))
        sides = []
        for long in (False, True):
            here = [i for i, x in enumerate(is_long) if x == long]
            k, v = np.frombuffer(b"".join(keys[i] for i in here), np.uint64), np.frombuffer(b"".join(values[i] for i in here))
            order = np.argsort(k)
            sides += [k[order], v[order]]
        word, c, gram, of_gram = sides
        log = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
        end = float(np.log10((ends + 0.1) / (total + 0.1 * (kinds + 1))))
        word_at, gram_at = Lookup(word), Lookup(gram)
        ids, made = table.column("doc_id").combine_chunks(), []
        for s in steps(table.column("text")):
            w, (g, first) = words(s), grams(s)
            at = word_at(w.hash)
            n = len(s)
            made.append(record_batch(schema, [ids.slice(s.first, n), w.per_doc + 1, np.bincount(w.doc, c[at] > 0, n).astype(np.int64) + (ends > 0), np.bincount(w.doc, log[at], n) + end, np.add.reduceat(of_gram[gram_at(g)], first[:-1])]))
        return pa.Table.from_batches(made, schema=schema)

    out = parts.groupBy("block").cogroup(found.select("block", "long", "keys", "values").groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
