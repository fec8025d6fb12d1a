"""Window features against plain loops over each window's own symbols."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from strandlake import catalog
from strandlake.operators import windows as win
from strandlake.operators.windows import Symbols

TEXTS = ["", "S", "ST", "KDKD", "stSTxxKRDE" * 3, "日本SéT" * 9, "A" * 50, "".join(np.random.default_rng(1).choice(list("ACDEFGHIKLMNPQRSTVWYstkd -"), 400)), "S" * 120]


def cases(s):
    r = np.random.default_rng(len(s))
    start = r.integers(0, len(s) + 1, 40)
    return start, np.minimum(start + r.integers(0, 90, 40), len(s))


def upper(text):
    return "".join(c.upper() if c.isascii() else "?" for c in text)


@pytest.mark.parametrize("text", TEXTS)
def test_composition(text):
    s = Symbols(text)
    w = cases(s)
    got = win.composition(s, w)
    for i, (a, b) in enumerate(zip(*w, strict=True)):
        part = upper(text)[a:b]
        n = max(len(part), 1)
        for k, letters in win.COMPOSITION.items():
            assert got[k][i] == pytest.approx(sum(c in letters for c in part) / n)
        assert got["charge"][i] == pytest.approx((sum(c in "KR" for c in part) - sum(c in "DE" for c in part)) / n)


@pytest.mark.parametrize("text", TEXTS)
def test_geometry(text):
    s = Symbols(text)
    w = cases(s)
    got = win.geometry(s, w)
    for i, (a, b) in enumerate(zip(*w, strict=True)):
        mask = [c in "ST" for c in upper(text)[a:b]]
        n, at = len(mask), [j for j, m in enumerate(mask) if m]
        gap = np.diff(at)
        want = {"density": sum(mask) / n if n else 0, "gap_mean": gap.mean() if len(gap) else n, "gap_sd": gap.std() if len(gap) else 0, "gap_cv": gap.std() / (gap.mean() + 1e-9) if len(gap) else 1}
        want |= {k: (gap <= m).mean() if len(gap) else 0 for k, m in (("adjacent", 1), ("close_3", 3), ("close_5", 5))}
        want |= {f"autocorr_{k}": np.mean([mask[j] and mask[j + k] for j in range(n - k)]) if n > k else 0 for k in win.LAGS}
        assert {k: float(v[i]) for k, v in got.items()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


@pytest.mark.parametrize("text", TEXTS)
def test_charge_and_pairs(text):
    s = Symbols(text)
    w = cases(s)
    scd, block, share = win.decoration(s, w), win.blockiness(s, w), win.pairs(s, w)
    kind = {c: k for k, letters in win.CLASSES.items() for c in letters}
    for i, (a, b) in enumerate(zip(*w, strict=True)):
        part = upper(text)[a:b]
        q = [(c in "KR") - (c in "DE") for c in part]
        n = len(q)
        assert scd[i] == pytest.approx(sum(q[j] * q[k] * math.sqrt(k - j) for j in range(n) for k in range(j + 1, n)) / n if n else 0)
        means = [np.mean(q[j : j + 5]) for j in range(0, n - 4, 5)]
        assert block[i] == pytest.approx(np.var(means) if len(means) > 1 else 0)
        seen = Counter(kind[x] + kind[y] for x, y in zip(part, part[3:]) if x in kind and y in kind)
        total = sum(seen.values())
        assert share[:, i].tolist() == [pytest.approx(seen[p] / total if total else 0) for p in win.PAIRS]


def test_windows_of_a_radius():
    s = Symbols("x" * 35)
    assert [x.tolist() for x in s.centred(np.array([1, 18, 35]), 10)] == [[0, 7, 24], [11, 28, 35]]
    assert [x.tolist() for x in s.tiles(20)] == [[0, 20], [20, 35]]


def test_rows(spark):
    rows = [(1, "STST"), (None, "ST"), (2, None), (3, ""), (1, "STST"), (4, "K" * 300_000)]
    got = win.by_sequence(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", "n long", lambda s: [np.array([len(s)])])
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 4), (1, 4), (4, 300_000), (None, 2)]
    assert win.by_sequence(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", "n long", lambda s: [[1]]).collect() == []


#: Queries over windows of text that pass over a sequence once; substrings of each window would walk it from its start.
ONCE = ["transfer_features", "nonst_composition", "window_substr", "tiles", "pssm_score"]


@pytest.mark.parametrize("name", ONCE)
def test_one_pass(spark, tmp_path, name):
    text = "aSTK\u00e9 DEp\u1e9e" * 40
    rows = [(1, text), (2, "s" * 20), (3, None), (4, "t" * 21), (5, "\U0001f600" * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.queries()[name](spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()[name])
    assert [d[0] for d in want.description] == made.columns
    assert sorted(map(tuple, made.collect())) == sorted(want.fetchall())


def test_radii_share_a_pass(spark, tmp_path, monkeypatch):
    """Windows of all radii are one call of a feature, with the means of a call for each."""
    from strandlake.plans import windows as plan

    text = "".join(np.random.default_rng(6).choice(list("ACDEFGHIKLMNPQRSTVWYx "), 500))
    calls, s = [], plan.windows.Symbols(text)
    monkeypatch.setattr(plan, "_each", lambda spark, sf_dir, fields, made: made)
    monkeypatch.setattr(plan, "_rounded", lambda df, places, *columns: df)
    made = plan._means(None, "", ["a", "b"], lambda s, w: (calls.append(len(w[0])), (plan.windows.decoration(s, w), plan.windows.blockiness(s, w)))[1])(s)
    around = plan._centred(s)
    assert calls == [3 * len(around[0][1][0])]
    assert list(made[2]) == [plan.windows.decoration(s, w).mean() for _, w in around]
    assert list(made[3]) == [plan.windows.blockiness(s, w).mean() for _, w in around]
