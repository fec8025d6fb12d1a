"""Each stage of the pipeline by itself, the stages together, and packing and PPM against plain versions."""

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from strandlake.llm import lmscore, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of both qualities with copies, a leak and personal data, and rows with nulls, repeats and empty texts."""
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in "ba de fi go hu ka lo mi nu po ra se ti vo".split() for b in "l n r s t m".split()]
    good = lambda: " ".join(" ".join(rng.choice(vocabulary, 8)).capitalize() + "." for _ in range(6))
    junk = lambda: " ".join(f"{w} %% ## $$" for w in rng.choice(vocabulary, 20))
    rows = [(i, good() if i % 3 else junk()) for i in range(300)]
    rows += [(1000, rows[1][1]), (1001, rows[1][1] + " extra"), (1, rows[1][1]), (1002, f"{good()} If a train travels 75 km in 3 hours, how fast does the train called Dash go {good()}"), (1003, f"{good()} Write to a.b@c.de or call +1 (605) 555-9305 today. {good()}")]
    rows += [(None, good()), (1004, good())]
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "If a train travels 60 km in 2 hours, how fast does the train called Bolt go")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality, near, leaks, private, packed = (f for _, f in pipeline.STAGES)
    kept = quality(spark, docs, sf_dir)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    junk = [i for i in range(300) if i % 3 == 0]
    assert kept.columns == docs.columns and len(set(ids) & set(junk)) < 5 and len(set(range(300)) - set(junk) - set(ids)) < 5 and None in ids
    one = near(spark, docs, sf_dir)
    left = sorted((r["doc_id"] for r in one.select("doc_id").collect()), key=str)
    assert one.columns == docs.columns and left == sorted([*range(300), 1002, 1003, 1004, None], key=str)
    clean = leaks(spark, docs, sf_dir)
    assert clean.columns == docs.columns and docs.count() - clean.count() == 1 and clean.where("doc_id = 1002").isEmpty()
    masked = {r["doc_id"]: r for r in private(spark, docs, sf_dir).collect()}
    assert "[EMAIL]" in masked[1003]["text"] and "[PHONE]" in masked[1003]["text"] and masked[1003]["n_chars"] == len(masked[1003]["text"])
    assert all(masked[r["doc_id"]]["text"] == r["text"] for r in docs.where("doc_id < 300").collect())
    assert packed(spark, docs, sf_dir).agg({"length": "sum"}).first()[0] == packed(spark, docs, sf_dir).where("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & {1000, 1001, 1002} and {1003, 1004, None} <= ids and len(ids & set(range(300))) > 180


def test_stages_of_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_packing_of_clashing_and_long(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(1, "word " * 300_000), (1, None), (2, ""), (2, ""), (None, "x"), (3, "alpha beta"), (4, "alpha beta")]
    df = spark.createDataFrame([(i, t, 5, 6, b"z") for i, t in rows], "doc_id long, text string, row int, first int, ids binary")
    got = packing.pack(spark, df, path).collect()
    assert sum(r["length"] for r in got) == sum(len(packing.coder(path).tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) & (sum(n for _, n in v) - 1) == 0 for v in per.values())
    assert packing.pack(spark, df.limit(0), path).count() == 0


def bm25(pieces, seed):
    """Scores by the formula, term by term."""
    n, mean = len(pieces), sum(map(len, pieces)) / len(pieces)
    out = []
    for p in pieces:
        score = 0.0
        for t in set(pieces[seed].tolist()):
            df, tf = sum(t in q for q in pieces), int((p == t).sum())
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(p) / mean))
        out.append(score)
    return out


def test_bm25_and_greedy_filling():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 60, rng.integers(1, 400)).astype(np.uint32) for _ in range(40)]
    index = packing.Index(pieces)
    for seed in (0, 7, 39):
        assert np.allclose(index.scores(seed, 40), bm25(pieces, seed))
        used = np.zeros(40, bool)
        used[[seed, 3, 11]] = True
        near = index.neighbours(seed, used)
        assert not set(near.tolist()) & {seed, 3, 11}
        want = bm25(pieces, seed)
        assert near.tolist() == sorted((i for i in range(40) if not used[i] and want[i] > 0), key=lambda i: (-round(want[i], 9), i))
    made = packing.fill(pieces)
    assert sorted((p, a, b) for s in made for p, a, b in s) == [(p, a, b) for p in range(40) for a, b in sorted((a, b) for s in made for q, a, b in s if q == p)]
    assert all(sum(b - a for q, a, b in (x for s in made for x in s) if q == p) == len(pieces[p]) for p in range(40))
    first = [p for p, *_ in made[0]]
    used = np.zeros(40, bool)
    used[0] = True
    assert first[0] == 0 and first[1:] == index.neighbours(0, used)[: len(first) - 1].tolist()


def ppm(train, text):
    """log10 of a text's bytes and end by PPM with method C and exclusion, from plain dictionaries."""
    seen = {}
    for t in train:
        row = [lmscore.MARK] * lmscore.ORDER + list(t.encode()) + [lmscore.MARK]
        for i in range(lmscore.ORDER, len(row)):
            for k in range(lmscore.ORDER + 1):
                at = seen.setdefault(tuple(row[i - k : i]), {})
                at[row[i]] = at.get(row[i], 0) + 1
    row, total = [lmscore.MARK] * lmscore.ORDER + list(text.encode()) + [lmscore.MARK], 0.0
    for i in range(lmscore.ORDER, len(row)):
        out, p = set(), 1.0
        for k in range(lmscore.ORDER, -1, -1):
            at = seen.get(tuple(row[i - k : i]))
            if at is None:
                continue
            left = {s: n for s, n in at.items() if s not in out}
            mass = sum(left.values()) + len(left)
            if row[i] in left:
                p *= left[row[i]] / mass
                break
            if left:
                p *= len(left) / mass
            out |= set(at)
        else:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_ppm_by_dictionaries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(list("abc é"), rng.integers(0, 60)))) for i in range(60)] + [(100, None), (101, "zz never seen ø"), (7, "abc")]
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    got = lmscore.score(spark, spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, block int, shard int, keys string")).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == sorted((i, round(ppm(train, t or ""), 6)) for i, t in rows)
