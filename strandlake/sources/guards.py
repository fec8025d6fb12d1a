"""Guards on shards: what a shard must have is counted in the pass that writes it, and a shard that lacks it is not kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Guard:
    """columns: the required ones, each with its type as Spark writes it (or "" for any). key: columns that name a row, none of them null or blank, each row's
    own. filled: columns without nulls or blanks. least: rows a shard has at least."""

    columns: dict[str, str]
    key: Sequence[str] = ()
    filled: Sequence[str] = field(default_factory=tuple)
    least: int = 0


def blank(df: DataFrame, column: str) -> Column:
    """Whether a value is null or, as text, empty but for white space; NaN counts as null."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, StringType):
        return c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")
    return c.isNull() | F.isnan(c) if kind.simpleString() in ("double", "float") else c.isNull()


def lacking(df: DataFrame, guard: Guard) -> list[str]:
    """What the schema lacks: required columns, and types."""
    found = dict(df.dtypes)
    return [f"no column {c}" for c in guard.columns if c not in found] + [f"column {c} is {found[c]}, not {t}" for c, t in guard.columns.items() if c in found and t and found[c] != t] + [f"no column {c}" for c in (*guard.key, *guard.filled) if c not in found and c not in guard.columns]


def write(spark: SparkSession, df: DataFrame, path: str, guard: Guard) -> list[str]:
    """Write df as Parquet to path and return no reasons; or why it is refused, and nothing is left at path.

    Rows are dealt and sorted by key, so that repeats are neighbours: one pass writes and counts rows, blanks and repeats. A schema that lacks a column or type is
    refused before anything is run.
    """
    if reasons := lacking(df, guard):
        return reasons
    seen, counts = Observation(), [F.count(F.lit(1)).alias("rows")]
    checked = list(dict.fromkeys([*guard.key, *guard.filled]))
    counts += [F.count_if(blank(df, c)).alias(f"blank {c}") for c in checked]
    marked = df
    if guard.key:
        own = [F.col(f"`{c}`") for c in guard.key]
        again = F.row_number().over(W.partitionBy(*own).orderBy(*own)) > 1
        marked = df.withColumn("_again", again & ~F.greatest(*(blank(df, c) for c in guard.key), F.lit(False)))
        counts.append(F.count_if("_again").alias("repeats"))
    marked.observe(seen, *counts).drop("_again").write.mode("overwrite").parquet(path)
    got = seen.get
    reasons = [f"{got[f'blank {c}']} blank {c}" for c in checked if got[f"blank {c}"]]
    if got.get("repeats"):
        reasons.append(f"{got['repeats']} repeated {', '.join(guard.key)}")
    if got["rows"] < guard.least:
        reasons.append(f"{got['rows']} rows, not {guard.least}")
    if reasons:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return reasons


def coverage(shards: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """(missing, unexpected, repeated): keys that no shard has, keys that nothing expects, and keys that shards have more than once; null keys are equal."""
    have = shards.groupBy(*key).agg(F.count("*").alias("_n"))
    want = expected.select(*key).distinct().withColumn("_w", F.lit(1))
    both = have.alias("a").join(want.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    return both.agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("repeated"))
