"""Structures: parsing, the surface of spheres, contacts and alignments by hand."""

import itertools
import math

import numpy as np
import pytest

from strandlake.operators import structures as S

CIF = """data_X
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM C "C5'" ALA A 10 0.0 0.0 0.0 1
ATOM H H ALA A 10 1.0 0.0 0.0 1
ATOM N N GLY A 11 100.0 0.0 0.0 1
ATOM O O SER B 5 3.0 0.0 0.0 1
HETATM O O HOH B 6 3.0 0.0 0.0 1
ATOM C C ALA A 10 x 0.0 0.0 1
ATOM C C ALA A 10 0.0 0.0 0.0 2
#
_other.thing 1
"""


def test_structures(spark, tmp_path):
    (tmp_path / "x.cif").write_text(CIF)
    atoms = S.read_mmcif(spark, f"{tmp_path}/*.cif")
    got = sorted((r["chain"], r["residue"], r["code"], r["element"], r["x"]) for r in atoms.collect())
    assert got == [("A", 10, "A", "C", 0.0), ("A", 11, "G", "N", 100.0), ("B", 5, "S", "O", 3.0)]
    area = {(r["chain"], r["residue"]): (r["area"], r["is_surface"]) for r in S.surface(atoms).collect()}
    assert area["A", 10] == (pytest.approx(4 * math.pi * 3.1**2), True)
    near = S.contacts(atoms.where("chain = 'A'"), atoms.where("chain = 'B'"))
    assert [(r["chain"], r["residue"]) for r in near.collect()] == [("A", 10)]
    assert S.surface(atoms.limit(0)).count() == 0


def test_two_spheres():
    r, d = 3.0, 2.5
    cap = 2 * math.pi * r * (r - d / 2)
    made = S.exposed(np.array([[0, 0, 0], [d, 0, 0.0]]), np.array([r, r]), 20_000)
    assert made == pytest.approx([4 * math.pi * r * r - cap] * 2, rel=2e-3)


def all_scores(a, b, score, opening, longer):
    """Scores of every alignment, as paths of pairs and gaps."""
    def walk(i, j, last):
        if i == len(a) and j == len(b):
            yield 0.0
        if i < len(a) and j < len(b):
            for s in walk(i + 1, j + 1, 0):
                yield s + score(a[i], b[j])
        if i < len(a):
            for s in walk(i + 1, j, 1):
                yield s + (longer if last == 1 else opening)
        if j < len(b):
            for s in walk(i, j + 1, 2):
                yield s + (longer if last == 2 else opening)
    return walk(0, 0, 0)


def test_alignment(spark):
    score = lambda x, y: 4.0 if x == y else -1.0
    for a, b in itertools.product(("", "ACD", "AACD", "GACDA"), ("", "ACD", "CAD", "ADDAA")):
        places, total = S.aligned(a, b, score, -3.0, -0.5), 0.0
        ends = [(-1, -1), *places, (len(a), len(b))]
        for (i, j), (k, m) in itertools.pairwise(ends):
            total += sum((-3.0 - 0.5 * (gap - 1)) for gap in (k - i - 1, m - j - 1) if gap)
        total += sum(score(a[i], b[j]) for i, j in places)
        assert total == pytest.approx(max(all_scores(a, b, score, -3.0, -0.5)))
    df = spark.createDataFrame([(1, "ACDE", "ACE"), (2, None, "A")], "k long, a string, b string")
    got = {r["k"]: [(p["a"], p["b"]) for p in r["places"]] for r in S.align(df, "k", "a", "b", lambda x, y: 15.0 if x == y else -15.0).collect()}
    assert got == {1: [(0, 0), (1, 1), (3, 2)], 2: []}


def test_alignments_together(monkeypatch, spark):
    """Pairs of many lengths in one step give what each gives alone, however they are blocked; one step a diagonal, not one a cell."""
    r = np.random.default_rng(5)
    texts = [tuple("".join(r.choice(list("ACDé"), int(n))) for n in r.integers(0, 12, 2)) for _ in range(60)]
    score = lambda x, y: 5.0 if x == y else -4.0
    a, b = zip(*texts, strict=True)
    alone = [S.aligned(x, y, score) for x, y in texts]
    assert S.aligned_all(a, b, score) == alone and S.aligned_all([], [], score) == []
    monkeypatch.setattr(S, "CELLS", 500)
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "k long, a string, b string").repartition(2)
    got = {x["k"]: [(p["a"], p["b"]) for p in x["places"]] for x in S.align(df, "k", "a", "b", score).collect()}
    assert got == dict(enumerate(alone))


def test_surface_is_dealt_out(spark):
    """A chain's atoms are grouped by cells, not as one group."""
    atoms = spark.createDataFrame([("f", "A", 1, "A", "C", 0.0, 0.0, 0.0)], S.ATOMS)
    assert "FlatMapGroupsInPandas [file" in (plan := S.surface(atoms)._jdf.queryExecution().analyzed().toString()) and "cx" in plan


def plain(xyz, radius, points):
    unit, made = S.sphere(points), []
    for i, (c, r) in enumerate(zip(xyz, radius, strict=True)):
        others = np.arange(len(xyz)) != i
        inside = (((c + r * unit)[:, None, :] - xyz[None, others]) ** 2).sum(2) < radius[others] ** 2
        made.append(4 * np.pi * r * r * (~inside.any(1)).mean())
    return np.array(made)


@pytest.mark.parametrize(("n", "spread"), [(300, 4.0), (200, 15.0), (60, 60.0)])
def test_surface_by_cells(spark, n, spread):
    """Crowded and loose chains against all points and all atoms."""
    r = np.random.default_rng(n)
    xyz, kinds = r.normal(0, spread, (n, 3)), r.choice(list("CNOSX"), n)
    radius = np.array([S.RADII.get(k, S.OTHER_RADIUS) + S.PROBE for k in kinds])
    want = plain(xyz, radius, 200)
    assert S.exposed(xyz, radius, 200) == pytest.approx(want, rel=1e-12)
    atoms = spark.createDataFrame([("f", "A", i // 2, "A", str(k), *map(float, p)) for i, (k, p) in enumerate(zip(kinds, xyz, strict=True))], S.ATOMS)
    got = {x["residue"]: (x["area"], x["is_surface"]) for x in S.surface(atoms).collect()}
    both = want.reshape(-1, 2).sum(1)
    assert got == {i: (pytest.approx(v), v / 129 >= 0.2) for i, v in enumerate(both)}
