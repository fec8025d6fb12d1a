"""Regions with their members and sources: a chain of sites is one row, and what is known of it comes out of one pass over its members."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import intervals
from strandlake.operators.matching import matched


def chains(positions: Sequence[int], gap: int, least: int) -> list[tuple[int, int]]:
    """Start and end of each chain of `least` ascending positions or more."""
    if not len(positions):
        return []
    at = np.asarray(positions)
    cut = np.flatnonzero(np.diff(at) > gap) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(at, cut) if len(x) >= least]


def survives(positions: Sequence[int], sources: Sequence[Sequence[str]], gap: int, least: int) -> bool:
    """Whether a chain is left when any one source goes, with the sites that have no other; without sources it is not."""
    every = {s for own in sources for s in own}
    return bool(every) and all(chains([p for p, own in zip(positions, sources, strict=True) if any(s != gone for s in own)], gap, least) for gone in every)


def materialised(evidence: DataFrame, keys: Sequence[str], pos: str, source: str, gap: int, least: int) -> DataFrame:
    """(keys, start, end, span, valence, positions, n_sources, sources, max_matched, survives, members) of each chain of distinct sites of `least` or more.

    evidence has a row for each site and source, repeats allowed; a null source is none, rows with a null key or position go. positions and sources are joined by
    semicolons, sources sorted as text; max_matched: the most sites with a source of their own; survives: see survives(); members: (pos, sources) of each site.
    A region is one row, which its coordinates bound.
    """
    rows = evidence.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(source).cast("string").alias("source")).dropna(subset=[*keys, "pos"])
    sites = rows.groupBy(*keys, "pos").agg(F.array_sort(F.collect_set("source")).alias("own"))
    chained = intervals.chained(sites, keys, "pos", gap, least)
    members = chained.join(sites, [*keys, "pos"]).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("own").alias("sources")))).alias("members")).drop("island")
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    nested = pa.list_(pa.struct([("pos", pa.int64()), ("sources", pa.list_(pa.string()))]))

    def run(batches):
        for b in batches:
            made = []
            for group in b.column("members").to_pylist():
                at, own = [m["pos"] for m in group], [m["sources"] for m in group]
                every = sorted({s for x in own for s in x}, key=str.encode)
                made.append((at[0], at[-1], at[-1] - at[0] + 1, len(at), ";".join(map(str, at)), len(every), ";".join(every), matched(dict(zip(at, own, strict=True))), survives(at, own, gap, least)))
            columns = list(zip(*made, strict=True)) if made else [[]] * 9
            types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), b.column("members").cast(nested)], names=[*keys, *_FIELDS, "members"])

    return members.select(*keys, "members").mapInArrow(run, f"{kinds}, start long, end long, span long, valence long, positions string, n_sources long, sources string, max_matched long, survives boolean, members array<struct<pos:long,sources:array<string>>>")


_FIELDS = ("start", "end", "span", "valence", "positions", "n_sources", "sources", "max_matched", "survives")
