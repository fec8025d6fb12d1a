"""Benchmark decontamination by templates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import save

#: Words of a template window, and of the shortest item that is looked for.
WINDOW, SHORTEST = 5, 3
#: Share of an item's windows that a document has, and of its slots that are filled consistently.
LEAST = 0.8
#: Slots that may differ by chance whatever the share: two of an item's values can coincide ("2 apples and 2 pears") where a copy's don't; a third equal one that differs is no chance.
CHANCE = 1
#: Rows of benchmark windows up to which they are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Units of measure that may follow a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|in|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|kmh|mph|hz|khz|mhz|ghz|kb|mb|gb|tb|v|w|kw|kwh|j|kj|cal|kcal|pa|kpa|mol|usd|eur|gbp|dollars?|euros?|pounds?|cents?|percent|degrees?"
#: Placeholders, from the private-use area.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


def template(text: Column) -> Column:
    """The text with numbers, units beside them, and capitalised words within sentences as typed placeholders; lower-cased, without punctuation.

    White space stays where it is, so that template and text have the same number of words.
    """
    t = F.regexp_replace(text, f"[{NUMBER}{NAME}{UNIT}]", " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\d,;] )\p{Lu}\p{Ll}+", NAME)
    t = F.regexp_replace(t, r"(?<![\p{L}\d])\d+(?:[.,:/]\d+)*", NUMBER)
    t = F.regexp_replace(F.lower(t), rf"[$€£¥%](?={NUMBER})|(?<={NUMBER})%|(?<={NUMBER} )%(?=\s)|(?<={NUMBER} ?)(?:{UNITS})(?![\p{{L}}\d])", UNIT)
    return F.regexp_replace(t, rf"[^\p{{L}}\d\s{NUMBER}{NAME}{UNIT}]+", "")


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def plain(text: Column) -> Column:
    """The text in lower case and without punctuation; white space stays where it is."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\d\s]+", "")


def templated(df: DataFrame, key: str, form=template) -> DataFrame:
    """(key, words): the words of each template, or of another form of the text, that are not empty; a null text has none."""
    return df.select(F.col(key), F.filter(words(form(F.coalesce("text", F.lit("")))), lambda w: w != "").alias("words"))


def windows(size: int) -> Column:
    """Hashes of all windows of `size` words."""
    return F.expr(f"CASE WHEN size(words) >= {size} THEN transform(sequence(1, size(words) - {size - 1}), i -> xxhash64(slice(words, i, {size}))) ELSE CAST(array() AS array<bigint>) END")


def literal(size: int) -> Column:
    """For the same windows: whether two words or more are no placeholders."""
    return F.expr(f"CASE WHEN size(words) >= {size} THEN transform(sequence(1, size(words) - {size - 1}), i -> size(filter(slice(words, i, {size}), w -> w NOT RLIKE '^[{NUMBER}{NAME}{UNIT}]+$')) >= 2) ELSE CAST(array() AS array<boolean>) END")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, size, plain, h, n): each window of each item with two literal words; an item of 3 or 4 words is one window.

    An item of placeholders, without such windows, has the windows of its plain text instead, with its own values (plain).
    Items of fewer words and null ids have none.
    """
    rows = items.where("item_id IS NOT NULL")

    def sized(made: DataFrame, form: bool) -> DataFrame:
        of = lambda size: made.where(F.size("words") >= size if size == WINDOW else F.size("words") == size).select("item_id", F.lit(size).alias("size"), F.lit(form).alias("plain"), F.explode(F.arrays_zip(windows(size).alias("h"), literal(size).alias("ok"))).alias("w"))
        return of(3).union(of(4)).union(of(5)).where("w.ok").select("item_id", "size", "plain", "w.h")

    found = sized(templated(rows, "item_id"), False)
    found = found.union(sized(templated(rows.join(found.select("item_id").distinct(), "item_id", "left_anti"), "item_id", plain), True))
    return found.join(found.groupBy("item_id").agg(F.countDistinct("h").alias("n")), "item_id")


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, size, matched, n) of each document that has at least LEAST of an item's distinct windows."""
    wanted = save(spark, item_windows(items), "items")
    kinds = [tuple(r) for r in wanted.select("size", "plain").distinct().collect()]  # six at most
    sought = wanted.select("item_id", "size", "plain", "h", "n").distinct()
    if sought.count() <= BROADCAST_ROWS:
        sought = F.broadcast(sought)
    found = None
    for size, form in sorted(kinds):
        made = templated(docs, "doc_id", plain if form else template)
        own = made.select("doc_id", F.explode(windows(size)).alias("h")).join(sought.where((F.col("size") == size) & (F.col("plain") == form)), "h")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return wanted.select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "item_id", "size", F.lit(0).cast("long").alias("matched"), "n").limit(0)
    # Each task first drops its own repeats: a window that a document or many documents repeat is counted once for each.
    return found.groupBy("doc_id", "item_id", "size", "n").agg(F.countDistinct("h").alias("matched")).where(F.col("matched") >= LEAST * F.col("n"))


def slot_checks(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, item_id, slots, conflicts, changed) of matches whose items have placeholders.

    Document and item are laid beside each other at the offset at which most of their windows agree (ties: the smallest).
    Values are compared without case and punctuation. Of the places where the item has one value, those where the document
    does not have the most frequent of its values there are conflicts; two values of the item may become one.
    """
    marks = f"[{NUMBER}{NAME}{UNIT}]"
    both = lambda df, key: df.select(key, F.expr("filter(arrays_zip(w, t), x -> x.t IS NOT NULL AND x.t <> '')").alias("pair")).select(key, F.col("pair.t").alias("words"), F.col("pair.w").alias("raw"))
    split = lambda df, key: df.select(key, words(F.regexp_replace(F.coalesce("text", F.lit("")), marks, " ")).alias("w"), words(template(F.coalesce("text", F.lit("")))).alias("t"))
    slotted = both(split(items.where("item_id IS NOT NULL"), "item_id"), "item_id").where(F.exists("words", lambda w: w.rlike(marks)))
    pairs = found.select("doc_id", "item_id", "size").join(slotted.select("item_id"), "item_id", "left_semi")
    doc_side = both(split(docs, "doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    # Windows of both sides, for the matched pairs only.
    of_item = pairs.join(slotted, "item_id").select("doc_id", "item_id", "size", F.col("words").alias("iw"), F.col("raw").alias("ir"))
    joined = of_item.join(doc_side, "doc_id")
    at = "transform(sequence(1, greatest(1, size({0}) - size + 1)), i -> named_struct('i', i, 'h', xxhash64(slice({0}, i, size))))"
    dw = joined.select("doc_id", "item_id", F.explode(F.expr(at.format("words"))).alias("d")).select("doc_id", "item_id", F.col("d.i").alias("di"), F.col("d.h").alias("h"))
    iw = of_item.select("doc_id", "item_id", F.explode(F.expr(at.format("iw"))).alias("x")).select("doc_id", "item_id", F.col("x.i").alias("ii"), F.col("x.h").alias("h"))
    offset = dw.join(iw, ["doc_id", "item_id", "h"]).groupBy("doc_id", "item_id", (F.col("di") - F.col("ii")).alias("shift")).agg(F.count("*").alias("c"))
    best = offset.groupBy("doc_id", "item_id").agg(F.max_by("shift", F.struct("c", -F.col("shift"))).alias("shift"))
    beside = joined.join(best, ["doc_id", "item_id"]).select("doc_id", "item_id", F.explode(F.expr(f"""
        filter(transform(sequence(1, size(iw)), i -> named_struct('kind', iw[i - 1], 'a', ir[i - 1], 'same', iw[i - 1] <=> get(words, i - 1 + shift), 'b', get(raw, i - 1 + shift))), x -> x.same AND x.kind RLIKE '{marks}')""")).alias("s"))
    value = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\d.,:/]+|[.,:/]+$", "")
    slot = beside.select("doc_id", "item_id", "s.kind", value("s.a").alias("a"), value("s.b").alias("b"))
    ways = slot.groupBy("doc_id", "item_id", "kind", "a", "b").agg(F.count("*").alias("c"))
    ways = ways.groupBy("doc_id", "item_id", "kind", "a").agg(F.sum("c").alias("places"), F.max("c").alias("most"), F.sum(F.when(F.col("a") != F.col("b"), F.col("c")).otherwise(0)).alias("changed"))
    return ways.groupBy("doc_id", "item_id").agg(F.sum("places").alias("slots"), F.sum(F.col("places") - F.col("most")).alias("conflicts"), F.sum("changed").alias("changed"))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, slots, conflicts, changed) of each leak: enough windows, and slots filled consistently.

    changed: slots whose values differ from the item's, that is, a re-parameterised question. Items without slots have 0. Up to CHANCE slots, or a share of 1 - LEAST of them, may be in conflict;
    a copy whose values are all unchanged has none.
    Null texts match nothing; rows that repeat an id count as one document; rows with a null id are not judged.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    found = save(spark, matches(spark, rows, items), "matches")
    checked = found.join(slot_checks(rows, items, found), ["doc_id", "item_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("slots", "conflicts", "changed")}
    ok = zero["conflicts"] <= F.greatest(F.lit(float(CHANCE)), (1 - LEAST) * zero["slots"])
    return checked.where(ok).select("doc_id", "item_id", "matched", F.col("n").alias("n_windows"), *(c.alias(k) for k, c in zero.items()))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without leaks, with all their columns."""
    return docs.join(contaminated(spark, docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
