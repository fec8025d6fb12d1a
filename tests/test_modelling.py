"""Folds of whole groups and boosted models on made-up rows."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import boosting, modelling
from strandlake.operators.boosting import Boosting
from strandlake.plans import models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    rows = [(i, int(i % 17), float(a), float(b) if i % 9 else None, int(a > 0.2)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, g long, a double, b double, y int").cache()


def test_dealt():
    for sizes in ([(9, 1), (4, 2), (3, 50), (1, 1000)], [(1, 7)], [(100, 3), (1, 2)]):
        takes = modelling.dealt(sizes, 5)
        assert [sum(t) for t in takes] == [m for _, m in sizes]
    loads = [sum(s * t[f] for (s, _), t in zip([(9, 1), (4, 2), (3, 50), (1, 1000)], modelling.dealt([(9, 1), (4, 2), (3, 50), (1, 1000)], 5))) for f in range(5)]
    assert max(loads) - min(loads) <= 1
    # Each group to the lightest fold, one by one.
    small, load = [(5, 2), (4, 1), (3, 4), (1, 3)], [0] * 3
    for s, m in small:
        for _ in range(m):
            load[load.index(min(load))] += s
    assert sorted(load) == sorted(sum(s * t[f] for (s, _), t in zip(small, modelling.dealt(small, 3))) for f in range(3))


def test_group_folds(spark, table):
    made = modelling.group_folds(table, "g", 4).collect()
    assert len(made) == 17 == len({r["g"] for r in made})
    per = [sum(r["n"] for r in made if r["fold"] == f) for f in range(4)]
    assert sum(per) == 300 and max(per) - min(per) <= 18
    again = modelling.group_folds(table.repartition(7), "g", 4).collect()
    assert {(r["g"], r["fold"]) for r in again} == {(r["g"], r["fold"]) for r in made}
    assert modelling.group_folds(table.limit(0), "g").count() == 0


HOW = Boosting(("a", "b"), trees=3, depth=2, rate=0.4)


def test_out_of_fold_and_transfer(spark, table):
    scored = modelling.out_of_fold(table, "id", "y", "g", HOW, 2)
    got = modelling.metrics(scored, "y").first()
    assert scored.count() == 300 and got["auroc"] > 0.97 and got["ap"] > 0.95
    assert scored.join(table.select("id", "g"), "id").select("g", "fold").distinct().count() == 17
    moved = modelling.transfer(table.where("g < 10"), table.where("g >= 8"), "id", "y", "g", HOW)
    assert moved.count() == table.where("g >= 8").count() and modelling.metrics(moved, "y").first()["auroc"] > 0.97
    one = modelling.transfer(table.where("y = 1 AND g < 8"), table.where("g >= 8"), "id", "y", "g", HOW)
    assert {r["score"] for r in one.select("score").distinct().collect()} == {1.0}
    none = modelling.transfer(table.limit(0), table, "id", "y", "g", HOW)
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.0}
    assert modelling.out_of_fold(table.limit(0), "id", "y", "g", HOW, 2).collect() == []


def test_ablation_and_nesting(spark, table):
    families = {"a": replace(HOW, features=("a",)), "b": replace(HOW, features=("b",))}
    got = {r["family"]: r for r in modelling.ablation(table, "id", "y", "g", families, 3).collect()}
    own = modelling.metrics(modelling.out_of_fold(table, "id", "y", "g", families["b"], 3), "y").first()
    assert got["a"]["auroc"] > 0.97 > 0.7 > got["b"]["auroc"] and got["b"]["auroc"] == pytest.approx(own["auroc"]) and got["b"]["ap"] == pytest.approx(own["ap"])
    made = modelling.nested(table, "id", "y", "g", {"weak": families["b"], "strong": families["a"]}, 3, 2, (0.5, 0.9)).collect()
    assert len(made) == 6 and {r["chosen"] for r in made} == {"strong"}
    folds = {r["g"]: r["fold"] for r in modelling.group_folds(table, "g", 3).collect()}
    rows = [(r["g"], r["y"]) for r in table.collect()]
    for r in made:
        mine = [y for g, y in rows if folds[g] == r["outer"]]
        assert (r["positives"], r["negatives"]) == (sum(mine), len(mine) - sum(mine))
        assert 0 <= r["fp"] <= r["negatives"] and r["tp"] > 0.8 * r["positives"] and r["inner_ap"] > 0.9


def plain(bins, y, how, watched=()):
    """One model, node by node, in one process: each split by trying every feature, cut and side for missing values."""
    train = [i for i in range(len(y)) if i not in set(watched)]
    p = sum(y[i] for i in train)
    n = len(train)
    w = (n / (2 * (n - p)), n / (2 * p)) if how.balanced else (1.0, 1.0)
    margin = np.full(len(y), 0.0 if how.balanced else math.log(p / (n - p)))
    best, kept, history = (-1.0, 0), None, [margin.copy()]
    for t in range(how.trees + 1):
        score = 1 / (1 + np.exp(-margin))
        level = np.minimum((score * boosting.LEVELS).astype(int), boosting.LEVELS - 1)
        if len(watched):
            order = sorted(set(level[list(watched)]), reverse=True)
            tp = seen = 0
            ap = 0.0
            for s in order:
                own = [y[i] for i in watched if level[i] == s]
                tp, seen = tp + sum(own), seen + len(own)
                ap += sum(own) * tp / seen
            ap /= max(sum(y[i] for i in watched), 1)
            if ap > best[0] + 1e-15:
                best = (ap, t)
            if how.patience and t - best[1] >= how.patience:
                return history[best[1]]
        if t == how.trees:
            return margin
        g = [int(np.rint(w[int(y[i])] * (score[i] - y[i]) * boosting.UNIT)) for i in range(len(y))]
        h = [int(np.rint(w[int(y[i])] * score[i] * (1 - score[i]) * boosting.UNIT)) for i in range(len(y))]
        total = lambda rows: (sum(g[i] for i in rows) / boosting.UNIT, sum(h[i] for i in rows) / boosting.UNIT)  # noqa: E731, B023
        gain = lambda rows: (lambda s: s[0] * s[0] / (s[1] + how.l2))(total(rows))  # noqa: E731, B023

        def below(rows, everyone, depth):
            found = None
            for f in range(bins.shape[1]):
                for cut in range(255):
                    for to_left in (False, True):
                        side = lambda i: bins[i, f] <= cut if bins[i, f] != 255 else to_left  # noqa: E731, B023
                        a, b = [i for i in rows if side(i)], [i for i in rows if not side(i)]
                        if len(a) >= how.leaf and len(b) >= how.leaf and (q := gain(a) + gain(b) - gain(rows)) > 1e-9 and (found is None or q > found[0] + 1e-12):
                            found = (q, f, cut, to_left)
                    if cut > bins[bins[:, f] != 255, f].max():
                        break
            if found is None:
                a, b = total(rows)
                margin[everyone] += -how.rate * a / (b + how.l2)
                return
            _, f, cut, to_left = found
            side = [bool(bins[i, f] <= cut) if bins[i, f] != 255 else to_left for i in range(len(y))]
            for want in (True, False):
                part, all_ = [i for i in rows if side[i] == want], [i for i in everyone if side[i] == want]
                if depth == 1:
                    a, b = total(part)
                    margin[all_] += -how.rate * a / (b + how.l2)
                else:
                    below(part, all_, depth - 1)

        below(train, list(range(len(y))), how.depth)
        history.append(margin.copy())


@pytest.mark.parametrize(("how", "parts"), [(replace(HOW, trees=2, balanced=True, l2=3.0), 7), (replace(HOW, trees=10, depth=1, rate=0.8, patience=2), 3)])
def test_models_equal_one_process(spark, how, parts):
    r = np.random.default_rng(9)
    n = 160
    bins = r.integers(0, 9, (n, 2)).astype(np.uint8)
    bins[r.random((n, 2)) < 0.2] = 255
    y = ((bins[:, 0] > 4) ^ (r.random(n) < 0.2)).astype(int)
    watched = [i for i in range(n) if i % 5 == 0] if how.patience else []
    rows = [(i, int(y[i]), bytearray(bins[i].tobytes()), [boosting.WATCH if i in watched else boosting.TRAIN]) for i in range(n)]
    given = spark.createDataFrame(rows, "id long, y int, bins binary, roles array<tinyint>").repartition(parts)
    models = boosting.fit(spark, given, [how], ["a", "b"])
    got = {x["id"]: x["score"] for x in boosting.scored(given, models, F.array(F.lit(0))).collect()}
    want = 1 / (1 + np.exp(-plain(bins, y, how, watched)))
    assert [got[i] for i in range(n)] == [pytest.approx(x, abs=1e-12) for x in want]


def test_models_do_not_depend_on_partitions(spark, table):
    how = Boosting(("a", "b"), trees=3, depth=2, rate=0.3, patience=2)
    one, other = (sorted(map(tuple, modelling.out_of_fold(t, "id", "y", "g", how, 3).collect())) for t in (table.repartition(1), table.repartition(9)))
    assert one == other


def test_margins_are_carried_on(spark, monkeypatch):
    """Margins that are written after each tree, in many blocks, give the trees of a pass down all of them."""
    monkeypatch.setattr(boosting, "KEPT", 1)
    monkeypatch.setattr(boosting, "BLOCK", 25)
    r = np.random.default_rng(11)
    bins = r.integers(0, 9, (120, 2)).astype(np.uint8)
    bins[r.random((120, 2)) < 0.2] = 255
    y = ((bins[:, 0] > 4) ^ (r.random(120) < 0.2)).astype(int)
    how = Boosting(("a", "b"), trees=4, depth=2, rate=0.3)
    rows = [(i, int(y[i]), bytearray(bins[i].tobytes()), [boosting.TRAIN, boosting.OUT if i % 3 else boosting.TRAIN]) for i in range(120)]
    given = spark.createDataFrame(rows, "id long, y int, bins binary, roles array<tinyint>")
    whole, third = boosting.fit(spark, given, [how, how], ["a", "b"])
    assert whole.margins(bins) == pytest.approx(plain(bins, y, how), abs=1e-12)
    assert third.margins(bins[::3]) == pytest.approx(plain(bins[::3], y[::3], how), abs=1e-12)


def test_the_query_grows_all_trees(monkeypatch):
    """gbt_oof: 300 trees of depth 3 in steps of 0.04 over all training rows, as in the reference."""
    seen = []
    monkeypatch.setattr(models, "labelled", lambda *_: None)
    monkeypatch.setattr(modelling, "out_of_fold", lambda *a: seen.append(a[4]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.gbt_oof(None, "")
    assert (seen[0].trees, seen[0].depth, seen[0].rate, seen[0].l2, seen[0].patience) == (300, 3, 0.04, 1.0, 0)
