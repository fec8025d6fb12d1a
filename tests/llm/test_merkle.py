"""The Merkle manifest against a plain recursive version and against SQL, over awkward tables."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import merkle

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(nodes, fanout):
    """The root of a list of digests, and the siblings (left, right) of each leaf on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for path, i in zip(paths, at, strict=True):
            run, own = runs[i // fanout], i % fanout
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes, at = [h(*r) for r in runs], [i // fanout for i in at]
    return nodes[0], paths


def audited(rows, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4] if r[4] is None else r[4] + more), enc(r[1]))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    made, roots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = plain([leaf(r) for r in own], fanout)
        roots.append(root)
        made.append((own, root, paths))
    if not roots:
        return []
    root, above = plain(roots, fanout)
    out = []
    for (own, sub, paths), top in zip(made, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, int(hit))
            for a, b in path + top:
                fold = h(a, fold, b)
            out.append((r[0], leaf(r), sub, root, h(*(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def awkward(n):
    rows = [(i * 3, f"text {i} ä" * (i % 5), ["en", "en", "en", "de", "fr"][i % 5], f"s{i % 3}", i) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "x", "", None, 5), (0, "", "en", None, None), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1), (-4, "minus", "zz", "", 2**62), (9, "y" * 200_000, "日本", "s", 200_000)]
    return rows


@pytest.mark.parametrize(("n", "fanout", "levels"), [(0, 2, 2), (1, 2, 8), (60, 2, 2), (90, 3, 2), (700, 2, 8)])
def test_plain(spark, n, fanout, levels, monkeypatch):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (fanout, levels))
    rows = awkward(n)
    got = merkle.audit(spark, spark.createDataFrame(rows, KINDS).withColumns({"pos": F.lit(1), "key": F.lit("k"), "root": F.lit("r")}).repartition(7), fanout)
    assert sorted(map(tuple, got.collect()), key=repr) == audited(rows, fanout)


def test_tampering_shows(spark):
    got = merkle.audit(spark, spark.createDataFrame(awkward(300), KINDS)).toPandas()
    hit = got["doc_id"].map(lambda i: i == i and zlib.crc32(str(int(i)).encode()) % 7 == 0)
    assert 20 < hit.sum() < 80
    null_chars = hit & got["verified"]  # the row of id 0 without n_chars, if its id is hit
    assert (got["verified"] == ~hit)[~null_chars].all()
    assert got["root"].nunique() == 1


def test_empty(spark):
    assert merkle.audit(spark, spark.createDataFrame([], KINDS)).collect() == []


def test_groups_beyond_one_block(spark):
    """More groups than a block holds: the upper tree has several tables, too."""
    rows = [(i, "t", f"l{i % 41:02d}", "s", i) for i in range(150)]
    got = merkle.manifest(spark, spark.createDataFrame(rows, KINDS).select("doc_id", "lang", merkle.leaf([F.col("doc_id")]).alias("digest")), "lang", "doc_id", 2, 2)
    checked = got.select(merkle.folded(F.col("digest"), F.col("path")).alias("f"), "root").distinct().collect()
    assert len(checked) == 1 and checked[0]["f"] == checked[0]["root"]


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    rows = awkward(64)
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(merkle.SQL).fetchall()
    # In SQL a null id has no remainder, and is not tampered with either.
    assert sorted(want, key=repr) == audited(rows, 2)
