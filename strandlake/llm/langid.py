"""Language identification by cross-parsing: the language whose text yields the longest matches needs the fewest phrases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm._store import lowest, remainder
from strandlake.llm._text import ranges, hash_ranges, record_batch, steps

#: Letters: ASCII ones and all bytes of longer UTF-8 characters. What stands between words is one separator, byte 32.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of data; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        new = len(moves)
        moves.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] != length[p] + 1:
                copy = len(moves)
                moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return moves


@dataclass
class Model:
    """All languages' automata in one table; root[k] starts language k, -1 is where there is no move.

    A state's first move is only[state] (class of byte) to only_to[state]; states with more moves have rows of their own in more[row[state], class].
    """

    langs: list[str]
    byte_class: np.ndarray
    only: np.ndarray
    only_to: np.ndarray
    row: np.ndarray
    more: np.ndarray
    root: np.ndarray
    size: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        """What a phrase of each language costs: a place in its text or one of 256 bytes has to be named. 1 for the longest text."""
        bits = np.log(self.size + 256.0)
        return bits / bits.max() if len(bits) else bits

    def move(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.where(self.only[state] == c, self.only_to[state], self.more[self.row[state], c])

    def phrases(self, padded: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each row of bytes; rows come longest first. A symbol that no match begins with is a phrase."""
        state = np.tile(self.root, (len(size), 1))
        count = np.zeros(state.shape, np.int64)
        for j in range(padded.shape[1]):
            live = int(np.searchsorted(-size, -j, "left"))
            c = self.byte_class[padded[:live, j]][:, None]
            now = state[:live]
            to = self.move(now, c)
            stuck = to < 0
            count[:live] += stuck & (now != self.root)
            again = np.where(stuck, self.move(np.broadcast_to(self.root, now.shape), c), to)
            lost = again < 0
            count[:live] += lost
            state[:live] = np.where(lost, self.root, again)
        return count + (state != self.root)


def fit(texts: dict[str, str], max_bytes: int | None = None) -> Model:
    """One automaton per language over its words, lower-cased and parted by single separators; max_bytes of it where that is given.

    As words are parsed one by one, no match crosses a separator, and each distinct word is needed only once. With more text
    matches are longer, which Model.weight makes up for.
    """
    joined = {}
    for lang in sorted(texts):
        data = np.frombuffer(texts[lang].lower().encode(), np.uint8)
        start, end = ranges(_LETTER[data], np.array([0, len(data)]))
        if len(start):
            found = dict.fromkeys(data[a:b].tobytes() for a, b in zip(start, end, strict=True))
            joined[lang] = (b" " + b" ".join(found) + b" ")[:max_bytes]
    seen = sorted(set().union(*joined.values())) if joined else []
    byte_class = np.full(256, len(seen), np.int64)
    byte_class[seen] = np.arange(len(seen))
    only, only_to, row, more, root = [], [], [], [np.full((1, len(seen) + 1), -1, np.int32)], []
    base, rows = 0, 1
    for lang in joined:
        moves = suffix_automaton(joined[lang])
        first = np.full((2, len(moves)), -1, np.int32)
        own = np.zeros(len(moves), np.int32)
        many = [i for i, m in enumerate(moves) if len(m) > 1]
        t = np.full((len(many), len(seen) + 1), -1, np.int32)
        for i, m in enumerate(moves):
            if m:
                c, to = next(iter(m.items()))
                first[:, i] = byte_class[c], to + base
        for r, i in enumerate(many):
            t[r, byte_class[list(moves[i])]] = np.array(list(moves[i].values()), np.int32) + base
            own[i] = rows + r
        only.append(first[0]), only_to.append(first[1]), row.append(own), more.append(t), root.append(base)
        base, rows = base + len(moves), rows + len(many)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (only, only_to, row)]
    return Model(list(joined), byte_class, *flat, np.concatenate(more), np.array(root, np.int32), np.array([len(x) for x in joined.values()], np.int64))


def train(docs: DataFrame, docs_per_lang: int = 300) -> Model:
    """Learn from rows with a lang whose crc32 remainder by 5 is not 0: of each language the docs_per_lang first in order of a hash of the id, with their whole texts.

    Only rows among the lowest hashes, about 4 * docs_per_lang of a language, are sorted. Where ids repeat, there may be fewer than docs_per_lang.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 5) != 0))
    known = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    # One count a language, as the model has one automaton a language.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    near = known.join(F.broadcast(counts), "lang").where(lowest("h", 4 * docs_per_lang, F.col("n")))
    order = W.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    got = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_lang).select("lang", "place", "text").toArrow().to_pandas()
    got = got.sort_values(["lang", "place"])
    return fit({str(k): "\n".join(v["text"]) for k, v in got.groupby("lang")})


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrases_per_byte) for each row, repeated rows included.

    Words are parsed one by one, with a separator on each side; a phrase counts as much as its language's weight, and ties go to the
    first language by name. The score is the winner's share of exp(-weighted phrases). und and score 0: a null text, one without a letter, or no language learnt.
    """
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrases_per_byte", pa.float64())])

    def run(batches):
        m = shared.value
        n_lang = len(m.langs)
        for b in batches:
            text = b.column("text")
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for s in steps(pc.utf8_lower(text)):
                n = len(s)
                start, end = ranges(_LETTER[s.data], s.offsets)
                doc = np.searchsorted(s.offsets, start, "right") - 1
                _, first, same = np.unique(hash_ranges(s.data, start, end), return_index=True, return_inverse=True)
                size = (end - start)[first]
                order = np.argsort(-size, kind="stable")
                count = np.zeros((len(first), n_lang), np.int64)
                # Words of about the same length go together, so that the padding stays small.
                for part in np.array_split(order, max(1, len(order) // 16384)) if len(order) and n_lang else []:
                    length, width = size[part] + 2, int(size[part[0]]) + 2
                    at = start[first[part]][:, None] + np.arange(-1, width - 1)
                    inside = (np.arange(width) >= 1) & (np.arange(width) <= size[part][:, None])
                    count[part] = m.phrases(np.where(inside, s.data[np.clip(at, 0, len(s.data) - 1)], 32), length)
                total = np.column_stack([np.bincount(doc, count[same, k], n) for k in range(n_lang)]) if n_lang else np.zeros((n, 1))
                cost = total * m.weight if n_lang else total
                best = cost.argmin(1)
                low = total[np.arange(n), best]
                share = 1 / np.exp(np.maximum(cost.min(1)[:, None] - cost, -700)).sum(1)
                ok = letter[s.first : s.last] & (n_lang > 0)
                bytes_read = np.maximum(np.bincount(doc, end - start + 1, n), 1)
                names = np.where(ok, np.array(m.langs or ["und"], object)[best], "und")
                yield record_batch(schema, [b.column("doc_id").slice(s.first, n), list(names), np.where(ok, share, 0.0), np.where(ok, low / bytes_read, 0.0)])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrases_per_byte double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "phrases_per_byte")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict(spark, docs, train(docs))
