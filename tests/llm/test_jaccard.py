"""The n-gram Jaccard join against all pairs, on groups of near copies around the threshold, and on rows that repeat an id."""

import itertools
import re

import numpy as np
import pytest

from strandlake.llm import jaccard


def shingle_set(text, width):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(rows, width, percent):
    """For each row: its set's size, and the smallest id that links reach."""
    sets = [shingle_set(t, width) for _, t in rows]
    low = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[a] != low[b]:
            x, y = low[a], low[b]
            low = [x if v == y else v for v in low]
    ids = {}
    for (i, _), k in zip(rows, low):
        ids[k] = min(ids.get(k, i), i)
    return [(i, len(s), ids[k]) for (i, _), s, k in zip(rows, sets, low)]


def copies(rng, n_groups, n_copies, n_words, most):
    """Texts with up to `most` words changed, put in or left out; each group also has runs copied into other groups."""
    rows = []
    for g in range(n_groups):
        base = [f"w{x}" for x in rng.integers(0, 400, n_words)]
        for _ in range(n_copies):
            w = list(base)
            for _ in range(rng.integers(0, most + 1)):
                at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[at : at + (kind > 0)] = [f"w{rng.integers(0, 400)}"] if kind < 2 else []
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize(("width", "percent", "most"), [(3, 90, 6), (5, 80, 8), (2, 60, 30)])
def test_groups_around_the_threshold(spark, width, percent, most):
    rows = copies(np.random.default_rng(width), 4, 45, 90, most) + [(2000, "short one"), (2001, "Short  ONE"), (2002, ""), (2003, None)]
    got = jaccard.components(spark, spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    want = classes(rows, width, percent)
    assert len({c for *_, c in want}) < len(rows) - 20  # there are links
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_rounds_and_pairs_find_the_same(spark, monkeypatch):
    """Where every round's candidates are turned down, all links come from the pairs across components; and the join of texts by shuffles finds the same."""
    rows = copies(np.random.default_rng(9), 3, 30, 80, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real, calls = jaccard.verified, []
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: calls.append(1) or real(pairs.limit(0) if len(calls) == 1 else pairs, *a))
    got = jaccard.components(spark, df, 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(classes(rows, 3, 85))
    monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", -1)
    again = jaccard.components(spark, df, 3, 85).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_repeated_ids(spark):
    """Rows that repeat an id are judged each by its own text; of copies one row stays."""
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "xy")
    rows = [(1, one), (1, two), (2, one), (3, two), (4, one), (4, one), (None, one), (None, None), (5, ""), (6, None), (5, "")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, h int, id_ string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(spark, df).collect()), key=str)
    assert got == sorted([(1, 38, 1)] * 2 + [(2, 38, 1), (3, 38, 1), (4, 38, 1), (4, 38, 1), (None, 38, None), (None, 0, None), (5, 0, 5), (5, 0, 5), (6, 0, 6)], key=str)
    kept = jaccard.keep_first(spark, df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([(1, one), (1, two), (None, one), (None, None), (5, ""), (6, None), (5, "")], key=str)
    twice = spark.createDataFrame([(1, one), (1, one), (2, one)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.keep_first(spark, twice).collect()] == [(1, one)]
