"""N-gram Jaccard join by adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._components import connected_components, roots
from strandlake.llm._store import save
from strandlake.llm._text import STEP_BYTES, Step, mix, record_batch, steps, words

#: Counters of the sketch of shingle frequencies: what is broadcast has this many longs, however large the input is.
SKETCH = 1 << 17
#: Shared prefix tokens that a document may ask for.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)
#: Pairs of nodes (32 bytes each), or ids of dropped rows, up to which they are broadcast.
BROADCAST_PAIRS = 200_000
#: What verifying one candidate (two whole texts) costs, in postings read or written.
VERIFY_COST = 300.0


def shingles(step: Step, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each one's begin.

    A shingle is `width` consecutive words; a document of fewer has its whole sequence as one, one without words none.
    """
    w = words(step)
    n = len(step)
    first = w.first
    count = np.where(w.per_doc >= width, w.per_doc - width + 1, np.minimum(w.per_doc, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    size = np.repeat(np.minimum(w.per_doc, width), count)
    key = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < size
        key[inside] = key[inside] * np.uint64(0xD6E8FEB86659FD93) + w.hash[at[inside] + k]
    key = mix(key, 3)
    doc = np.repeat(np.arange(n), count)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle of each of SKETCH hash classes, over all documents."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for s in steps(b.column("text")):
                key, _ = shingles(s, width)
                total += np.bincount((key % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        some = np.flatnonzero(total)
        yield record_batch(schema, [some.astype(np.int32), total[some]])

    got = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sketch = np.zeros(SKETCH, np.int64)
    sketch[got["slot"].to_numpy()] = got["n"].to_numpy()
    return sketch


def choose_matches(frequency: np.ndarray, size: int, base: int) -> int:
    """The number of shared prefix tokens l, of MATCHES, with the least estimated cost.

    frequency: estimated other documents with each token, in global order; base: the tokens before the l-th. A candidate shares l
    of the prefix's tokens, so that at most a sum of frequencies / l documents come to verification.
    """
    most = max(1, size - base)
    best, cost = 1, np.inf
    total = np.cumsum(frequency[: base + MATCHES[-1]])
    for m in MATCHES:
        if m > most:
            break
        others = float(total[min(base + m, len(total)) - 1])
        now = base + m + others + VERIFY_COST * others / m
        if now < cost * 0.95:
            best, cost = m, now
    return best


#: Documents with a token from which on pairs are listed at their first common token only.
HOT = 16
#: Classes of shingle hashes whose sizes bound how many shingles two sets can share.
CLASSES = 256


def signatures(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, h, n, sig1, sig2, matches, rank, prefix, classes) for each row: the text's hash, the set's size, a 128-bit sum of its shingles, its prefix, and a byte for each class of shingles.

    Tokens stand in global order: rare ones (by the sketch) first, ties by hash. A document of n shingles shares at least
    ceil(percent * n / 100) with a partner, so that both have `matches` common tokens among the first
    n - ceil(percent * n / 100) + matches. rank: low where even the rarest tokens are frequent, as in the middle of a group of near copies.
    classes: how many shingles fall into each class; 255 stands for more as well.
    """
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, width))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("matches", pa.int32()), ("rank", pa.int32()), ("prefix", pa.list_(pa.int64())), ("classes", pa.binary())])

    def run(batches):
        seen = sketch.value
        usual = float(seen.mean())
        for b in batches:
            ids, h = b.column("doc_id"), b.column("h")
            for s in steps(b.column("text")):
                key, at = shingles(s, width)
                count = seen[(key % np.uint64(SKETCH)).astype(np.int64)]
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                if len(key):
                    some = np.minimum(at[:-1], len(key) - 1)
                    sig1 = np.where(n > 0, np.add.reduceat(mix(key, 11), some), np.uint64(0))
                    sig2 = np.where(n > 0, np.add.reduceat(mix(key, 12), some), np.uint64(0))
                else:
                    sig1 = sig2 = np.zeros(len(n), np.uint64)
                classes = np.minimum(np.bincount(doc * CLASSES + (mix(key, 13) % np.uint64(CLASSES)).astype(np.int64), minlength=len(n) * CLASSES), 255).astype(np.uint8).reshape(len(n), CLASSES)
                matches, rank, prefixes = np.ones(len(n), np.int32), np.zeros(len(n), np.int32), []
                order = np.lexsort((key, count, doc))
                key, count = key[order], count[order]
                others = np.maximum(0.0, count - usual - 2 * np.sqrt(usual))  # what chance alone does not bring to a class
                for i, size in enumerate(n.tolist()):
                    base = size - -(-percent * size // 100)
                    own = slice(at[i], at[i + 1])
                    if size:
                        matches[i] = choose_matches(others[own], size, base)
                        rank[i] = -100 * np.log2(1 + others[own][: base + 1]).mean()
                    prefixes.append(key[own][: base + matches[i]].view(np.int64) if size else np.zeros(0, np.int64))
                yield record_batch(schema, [ids.slice(s.first, len(n)), h.slice(s.first, len(n)), n.astype(np.int32), sig1.view(np.int64), sig2.view(np.int64), matches, rank, prefixes, [c.tobytes() for c in classes]])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return save(spark, rows.mapInArrow(run, "doc_id long, h long, n int, sig1 long, sig2 long, matches int, rank int, prefix array<long>, classes binary"), "signatures")


def possible(rows: DataFrame, percent: int) -> DataFrame:
    """The rows whose two sets (n_a, n_b, classes_a, classes_b) can share enough shingles: no more than the smaller count of each class. The classes go."""
    left = rows.drop("classes_a", "classes_b")
    columns = left.columns

    def run(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(f"classes_{s}").to_pylist()), np.uint8).reshape(-1, CLASSES) for s in "ab")
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            most = np.minimum(a, c)
            kept = ((100 + percent) * most.sum(1, dtype=np.int64) >= percent * n) | (most == 255).any(1)
            yield b.select(columns).filter(pa.array(kept))

    return rows.mapInArrow(run, left.schema)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of pairs (key_a and key_b, each a doc_id and its text's hash, and more columns) whose sets have 100 * intersection >= percent * union, by their whole texts."""

    def run(batches):
        for b in batches:
            texts = [pc.fill_null(b.column(c).cast(pa.large_string()), "") for c in ("text_a", "text_b")]
            rest = b.select([c for c in b.schema.names if c not in ("text_a", "text_b")])
            ends = np.cumsum(sum(pc.binary_length(t).to_numpy(zero_copy_only=False) for t in texts))
            i = 0
            while i < b.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_BYTES, "right")) - i)
                kept = np.zeros(n, bool)
                for s in steps(pa.chunked_array([t.slice(i, n) for t in texts]).combine_chunks(), 1 << 62):
                    key, at = shingles(s, width)
                    for k in range(n):
                        both = np.concatenate([key[at[k] : at[k + 1]], key[at[n + k] : at[n + k + 1]]])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        kept[k] = 100 * common >= percent * (len(both) - common)
                yield rest.slice(i, n).filter(pa.array(kept))
                i += n

    texts = docs.where("doc_id IS NOT NULL").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key"), "text")
    rest = [c for c in pairs.columns if c not in ("key_a", "key_b")]
    one = lambda *columns: [F.any_value(c).alias(c) for c in columns]  # noqa: E731  a repeated row has the same key and text
    if pairs.count() <= BROADCAST_PAIRS:  # then only the texts of pairs are shuffled
        of_a = texts.toDF("key_a", "text_a").join(F.broadcast(pairs), "key_a").groupBy("key_a", "key_b").agg(*one(*rest, "text_a"))
        both = of_a.join(texts.toDF("key_b", "text_b").join(F.broadcast(pairs.select("key_a", "key_b")), "key_b").groupBy("key_a", "key_b").agg(*one("text_b")), ["key_a", "key_b"])
    else:
        needed = texts.join(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(*one("text"))
        both = pairs.join(needed.toDF("key_b", "text_b"), "key_b").join(needed.toDF("key_a", "text_a"), "key_a")
    return both.select(*pairs.columns, "text_a", "text_b").mapInArrow(run, pairs.schema)


def must(percent: int, a: str, b: str) -> str:
    """Common tokens that sets of a and b tokens need, rounded up."""
    return f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}"


class Joined:
    """Components as they grow: (node, component) of each node that has been linked to another; others are their own component."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.known = None

    def merge(self, moved: DataFrame) -> None:
        """moved: (node, component) of components, named by a node, that go into another one."""
        if self.known is not None:
            new = moved.toDF("component", "root")
            moved = self.known.join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component")).union(moved)
        self.known = save(self.spark, moved, "known")


def narrowed(spark: SparkSession, rows: DataFrame, percent: int) -> DataFrame:
    """Postings that can still bring a new link: their token's group has several components, and a partner small enough for their place."""
    groups = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n"), F.count("*").alias("size")).where("lo < hi").drop("lo", "hi")
    return save(spark, rows.drop("size", "least_n").join(groups, "token").where(f"pos < n - {smallest(percent)} + matches"), "open")


def smallest(percent: int) -> str:
    """Common tokens that a posting's node needs at least: with the smallest partner that its token's group or its own size allow."""
    return must(percent, "n", f"greatest(least_n, ({percent} * n + 99) div 100)")


def components(spark: SparkSession, docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, component_h) for each row, repeated rows included; h is a hash of the text.

    Equal sets make one node. First come rounds in which each component has one candidate: a lead of one of its tokens, the one
    with which it shares most. So a group of near copies gathers around its middle, and pairs within it need no comparison. When a round
    brings nothing or little is left, all pairs across components that have enough of their prefixes in common are verified.
    Every candidate, also in the rounds, shares the number of prefix tokens that the two ask for.

    An empty, null or wordless text has 0 shingles and itself as component; a null id stays null and links with nothing. Rows
    that repeat an id are judged each by its own text. component_id and component_h are those of the component's first row, with the smallest id and,
    where rows repeat that, the smallest hash.
    """
    made = signatures(spark, docs, width, percent)
    usable = made.where("n > 0 AND doc_id IS NOT NULL")
    first_row = usable.groupBy("n", "sig1", "sig2").agg(F.min(F.struct("doc_id", "h")).alias("key"), *(F.any_value(c).alias(c) for c in ("matches", "rank", "prefix", "classes")))
    nodes = save(spark, first_row.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Most tokens are in one document only: these are counted away before postings are shuffled.
    shared = nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = nodes.select("node", F.posexplode("prefix").alias("pos", "token"), "n", "matches", "rank").join(shared, "token", "left_semi")
    open_ = narrowed(spark, postings.withColumn("component", F.col("node")), percent)
    texts = docs.select("doc_id", "text")
    similar_size = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    common, enough = must(percent, "n_a", "n_b"), "least(matches_a, matches_b)"
    of_a, of_b = (nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "matches", "prefix", "classes"))) for s in "ab")
    both = ["key_a", "key_b", "component_a", "component_b"]

    def links(pairs: DataFrame) -> DataFrame:
        """(component_a, component_b) of the pairs (a, b) whose texts are similar."""
        seen = pairs.join(of_a.drop("prefix_a", "matches_a"), "a").join(of_b.drop("prefix_b", "matches_b"), "b").select(*both, "n_a", "n_b", "classes_a", "classes_b")
        return save(spark, verified(save(spark, possible(seen, percent).select(both), "pairs"), texts, width, percent).select("component_a", "component_b"), "links")

    grown, turn = Joined(spark), 0
    while True:
        left = open_.agg(F.count("*").alias("rows"), F.sum("size").alias("comparisons")).first()
        if not left["rows"] or turn and left["comparisons"] <= 4 * left["rows"]:
            break
        # Leads are the first of their tokens' groups in one order of components, another in each round: links go down in it and make no circle.
        first = F.col("rank").cast("long") if turn == 0 else F.xxhash64("component", F.lit(turn))
        lead = open_.groupBy("token").agg(F.min(F.struct(first.alias("first"), "component", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos", "matches")).alias("lead"))
        lead = lead.select("token", F.col("lead.component").alias("component_a"), F.col("lead.node").alias("a"), *(F.col(f"lead.{c}").alias(f"{c}_a") for c in ("n", "pos", "matches")))
        near = open_.select("token", F.col("component").alias("component_b"), F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "pos", "matches"))).join(lead, "token").where("component_b <> component_a").where(similar_size)
        near = near.where(f"pos_a < n_a - {common} + {enough} AND pos_b < n_b - {common} + {enough}").groupBy("component_b", "component_a", "a", "b", "matches_a", "matches_b").agg(F.count("*").alias("c")).where(f"c >= {enough}")
        stars = near.groupBy("component_b").agg(F.max(F.struct("c", "a", "b", "component_a")).alias("best")).select("component_b", "best.component_a", "best.a", "best.b")
        moved = links(save(spark, stars, "stars")).select(F.col("component_b").alias("node"), F.col("component_a").alias("parent"))
        n_moved = moved.count()
        if n_moved:
            to = roots(spark, moved)
            grown.merge(to)
            open_ = narrowed(spark, open_.join(to.toDF("component", "root"), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"), percent)
        turn += 1
        if n_moved * left["comparisons"] < left["rows"] ** 2:  # a further round would read more rows than it saves comparisons
            break
    # What is left: pairs across components. With both sizes known, their first common token leaves room for `common` - 1 to follow.
    # In large groups only the first common token lists a pair, so that a pair does not come once for each of them.
    strict = open_.where(f"pos <= n - {smallest(percent)}").select("token", "node", "pos", "n", "component", "size")
    hot = strict.where(F.col("size") > HOT).join(nodes.select("node", "prefix"), "node").withColumn("before", F.slice("prefix", F.lit(1), F.col("pos"))).drop("prefix")

    def across(rows: DataFrame, rule: str) -> DataFrame:
        a, b = (rows.select("token", F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in ("token", "node", "size"))) for s in "ab")
        near = f"a < b AND component_a <> component_b AND pos_a <= n_a - {common} AND pos_b <= n_b - {common} AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        return a.join(b, (a["token"] == b["token"]) & F.expr(f"{near} AND {rule}")).select("a", "b", "component_a", "component_b")

    rare = across(strict.where(F.col("size") <= HOT), "true")
    listed = save(spark, rare.distinct().union(across(hot, "NOT arrays_overlap(before_a, before_b)")).distinct(), "listed")
    prefixes = listed.join(of_a.drop("key_a", "classes_a"), "a").join(of_b.drop("key_b", "classes_b"), "b")
    sharing = prefixes.where(f"size(array_intersect(slice(prefix_a, 1, n_a - {common} + {enough}), slice(prefix_b, 1, n_b - {common} + {enough}))) >= {enough}")
    edges = links(sharing.select(listed.columns)).toDF("a", "b")
    if not edges.isEmpty():
        grown.merge(connected_components(spark, edges).where("node <> component"))
    of_node = nodes.select("n", "sig1", "sig2", "node", F.col("key").alias("first"))
    if grown.known is not None:
        linked = grown.known.union(grown.known.select(F.col("component").alias("node"), "component").distinct())
        linked = save(spark, linked.join(nodes.select("node", "key"), "node"), "linked")
        ids = linked.groupBy("component").agg(F.min("key").alias("least"))
        of_node = of_node.join(linked.join(ids, "component").select("node", "least"), "node", "left").withColumn("first", F.coalesce("least", "first")).drop("least")
    out = usable.join(of_node.drop("node"), ["n", "sig1", "sig2"], "left").select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("component_h"))
    return out.union(made.where("n = 0 OR doc_id IS NULL").select("doc_id", "h", F.col("n").cast("long"), F.col("doc_id").alias("component_id"), F.col("h").alias("component_h")))


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies, with all their columns: of each component one row with the smallest id stays.

    Where rows repeat that id, the one with the smallest hash of its text stays, and of equal rows one. Rows without words or with a null id all stay.
    """
    found = components(spark, docs, width, percent).where("n_shingles > 0 AND doc_id IS NOT NULL")
    judged = save(spark, found.groupBy("doc_id", "h", ((F.col("doc_id") != F.col("component_id")) | (F.col("h") != F.col("component_h"))).alias("goes")).agg(F.count("*").alias("rows")), "judged")
    goes, again = judged.where("goes").select("doc_id", "h"), judged.where("NOT goes AND rows > 1").select("doc_id", "h")

    def rows_of(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_PAIRS else keys
        return df.join(keys, (df["doc_id"].cast("long") == keys["doc_id"]) & (F.xxhash64(df["text"]) == keys["h"]), how)

    left = rows_of(docs, goes, "left_anti")
    if again.isEmpty():
        return left
    return rows_of(left, again, "left_anti").union(rows_of(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


#: The rows of the query (width 3, 90 per cent) in DuckDB: all pairs with a common shingle, then reachability.
SQL = """WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM split),
members AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
links AS (SELECT a.r AS a, b.r AS b FROM members a JOIN members b ON a.x = b.x AND a.r <> b.r AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.r, b.r HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT x.doc_id, max(len(x.s)) AS n_shingles, min(y.doc_id) AS component_id FROM reach JOIN sets x ON x.r = reach.a JOIN sets y ON y.r = reach.b GROUP BY x.r, x.doc_id"""
