"""Regions against plain loops."""

import numpy as np

from strandlake.operators import regions
from strandlake.operators.matching import matched


def test_chains_and_survival():
    assert regions.chains([1, 3, 5, 20, 22, 23, 40], 3, 3) == [(1, 5), (20, 23)] and regions.chains([], 3, 1) == []
    assert regions.survives([1, 2, 3], [["a", "b"], ["a", "b"], ["b", "c"]], 3, 2)
    assert not regions.survives([1, 2, 3], [["a"], ["a"], ["b"]], 3, 2) and not regions.survives([1, 2, 3], [[], [], []], 3, 2)
    assert not regions.survives([1, 4, 7], [["a", "b"], ["a"], ["a", "b"]], 3, 2)  # without the middle site the ends are apart


def test_materialised(spark):
    r = np.random.default_rng(6)
    rows = [(int(e), int(p), s) for e, p, s in zip(r.integers(0, 6, 400), r.integers(0, 300, 400), r.choice(list("abcdé"), 400), strict=True)]
    rows += [(9, 1, None), (9, 2, None), (9, 3, "a"), (None, 1, "a"), (9, None, "a"), rows[0], (8, 1, "a"), (8, 2, "a")]
    got = {(x["e"], x["start"]): x for x in regions.materialised(spark.createDataFrame(rows, "e long, p long, s string").repartition(5), ["e"], "p", "s", 4, 3).collect()}
    want = 0
    for e in {x[0] for x in rows if x[0] is not None}:
        own = {}
        for k, p, s in rows:
            if k == e and p is not None:
                own.setdefault(p, set()).update([s] if s else [])
        for start, end in regions.chains(sorted(own), 4, 3):
            x, at = got[e, start], [p for p in sorted(own) if start <= p <= end]
            every = sorted({s for p in at for s in own[p]})
            assert (x["end"], x["span"], x["valence"], x["positions"]) == (end, end - start + 1, len(at), ";".join(map(str, at)))
            assert (x["n_sources"], x["sources"]) == (len(every), ";".join(every))
            assert x["survives"] == regions.survives(at, [own[p] for p in at], 4, 3)
            assert x["max_matched"] == matched({p: sorted(own[p]) for p in at}) <= len(every)
            assert [(m["pos"], set(m["sources"])) for m in x["members"]] == [(p, own[p]) for p in at]
            want += 1
    assert len(got) == want > 10
    assert regions.materialised(spark.createDataFrame([], "e long, p long, s string"), ["e"], "p", "s", 4, 3).collect() == []
