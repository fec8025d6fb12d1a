"""Trained operators on held-out rows of made-up texts, and with missing, empty, long and repeated rows."""

import zlib

import numpy as np
import pytest

from strandlake.llm import langid, quality, toxicity

WORDS = "river stone house light paper table green music water field story window garden bread train".split()


def made(n, seed):
    """Clean sentences; every fourth document has an insult in one of them; every third is junk."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = [" ".join(rng.choice(WORDS, rng.integers(4, 9))).capitalize() + "." for _ in range(rng.integers(2, 9))]
        toxic = int(i % 4 == 0)
        if toxic:
            k = int(rng.integers(0, len(s)))
            s[k] = s[k][:-1] + " you " + str(rng.choice(["moron", "morons", "idiots", "idiot"])) + "."
        junk = int(i % 3 == 0)
        text = " ".join(s)
        rows.append((i, "$$ ## " * 30 + text.replace(" ", " %% ") if junk else text, toxic, 1 - junk))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made(1200, 7)
    extra = [(5000, None, None, None), (5001, "", None, None), (5002, "... !!", None, None), (5003, "fine words here. " * 60_000, None, None), (None, rows[0][1], 1, 1), rows[4]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5, 9) for i, t, *_ in rows + extra], "doc_id long, text string, lang string, source string, score double, label int")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows] + [(5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_held_out(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.classify(None, docs, labels).collect()}
    held = [(i, t, x) for i, t, x, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, *_ in held) and not got[None]["held_out"]
    assert np.mean([got[i]["predicted"] == x for i, _, x in held]) > 0.97
    for i, text, x in held:
        if x and got[i]["predicted"]:
            spans = [tuple(map(int, s.split(":"))) for s in got[i]["offending"].split(",")]
            assert any(w in text[a:b] for a, b in spans for w in ("moron", "idiot"))
            assert sum(b - a for a, b in spans) < len(text)
    assert [got[i]["score"] for i in (5000, 5001, 5002)] == [0, 0, 0] and got[5003]["predicted"] == 0


def test_quality_held_out(tables):
    rows, docs, labels = tables
    scored = quality.classify(None, docs, labels).collect()
    assert len(scored) == docs.count()
    got = {r["doc_id"]: r for r in scored}
    assert got[None]["held_out"] and got[5001]["held_out"] == (zlib.crc32(b"5001") % 5 == 0)
    held = [(i, q) for i, *_, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"]
    model = quality.train(docs, labels)
    assert quality.kept(docs, model).columns == docs.columns
    assert sorted(r["doc_id"] for r in quality.kept(docs, model).where("doc_id < 5000").select("doc_id").distinct().collect()) == sorted(i for i, r in got.items() if i is not None and i < 5000 and r["predicted"])


def test_trees_by_hand():
    """Traversal over flattened trees is that of a plain walk, and a boosted fit lowers the loss with each tree."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).round(1)
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.1)).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)
    inner = model.feature.shape[1]
    for row, margin in zip(x[:80], model.margin(x[:80])):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < inner:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - inner]
        assert margin == pytest.approx(total)
    loss = [-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) for p in (quality.fit(x, y, trees=k, depth=3).predict(x) for k in (1, 4, 12))]
    assert loss[0] > loss[1] > loss[2]


def test_noisy_or_by_hand():
    """The fit's gradient step raises the likelihood, and a document's score is one minus the product over its sentences."""
    import pyarrow as pa

    from strandlake.llm._text import steps

    model = toxicity.Model(-2.0, np.random.default_rng(0).normal(size=toxicity.BUCKETS))
    texts = ["One two. Three four! Five", "", "six\nseven eight"]
    (step,) = steps(pa.array(texts))
    p, doc, bounds = model.sentences(step)
    raw = step.data.tobytes()
    assert [raw[a:b].decode() for a, b in bounds] == ["One two", "Three four", "Five", "six", "seven eight"] and doc.tolist() == [0, 0, 0, 2, 2]
    none = 1 / (1 + np.exp(2.0))
    want = [1 - np.prod(np.minimum((1 - p[doc == i]) / (1 - none), 1)) for i in range(3)]
    assert model.documents(step) == pytest.approx(want)


def test_the_fit_is_of_what_is_scored():
    """The likelihood that is raised is that of joined(), and its gradient is right."""
    r = np.random.default_rng(4)
    size, per_doc, y = r.integers(0, 4, 40), np.array([5, 0, 10, 20, 5]), np.array([1.0, 0, 0, 1, 1])
    feature = r.integers(0, 6, size.sum())
    theta = np.append(r.uniform(0.1, 1, 6), -2.0)
    value, grad = toxicity.likelihood(theta, feature, size, per_doc, y)
    z = [theta[f].sum() for f in np.split(feature, np.cumsum(size)[:-1])]
    doc = np.repeat(np.arange(5), per_doc)
    p = toxicity.Model(-2.0, np.zeros(toxicity.BUCKETS)).joined(toxicity.logistic(np.array(z) - 2), doc, 5)
    p = np.maximum(p, 1e-9)
    assert value == pytest.approx(np.log(p[y > 0]).sum() + np.log1p(-p[y == 0]).sum(), abs=1e-6)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert grad[k] == pytest.approx((toxicity.likelihood(theta + step, feature, size, per_doc, y)[0] - toxicity.likelihood(theta - step, feature, size, per_doc, y)[0]) / 2e-6, rel=1e-4, abs=1e-6)
    # Sentences without known words add nothing to either.
    empty = toxicity.likelihood(theta, np.zeros(0, int), np.zeros(20, int), np.array([20]), np.zeros(1))
    assert empty[0] == 0 and not empty[1].any()


def parsed(data, phrase_text):
    """Phrases of data in a plain greedy cross-parsing against a text."""
    n, i = 0, 0
    while i < len(data):
        k = i + 1
        while k <= len(data) and data[i:k] in phrase_text:
            k += 1
        n, i = n + 1, max(i + 1, k - 1)
    return n


def test_cross_parsing_by_hand():
    rng = np.random.default_rng(2)
    texts = {k: " ".join("".join(rng.choice(list(a), rng.integers(2, 7))) for _ in range(60)) for k, a in (("aa", "abcd"), ("bb", "cdef"), ("cc", "xyz"))}
    model = langid.fit(texts)
    for word in ["abca", "dddd", "cdef", "zzyx", "q", "abxcd"] + ["".join(rng.choice(list("abcdefxyz"), 6)) for _ in range(40)]:
        row = f" {word} ".encode()
        count = model.phrases(np.frombuffer(row, np.uint8)[None, :], np.array([len(row)]))[0]
        for k, lang in enumerate(model.langs):
            words = list(dict.fromkeys(texts[lang].split()))
            assert count[k] == parsed(row, (" " + " ".join(words) + " ").encode())


def test_empty_tables(tables):
    _, docs, labels = tables
    for f in (lambda d: toxicity.classify(None, d, labels), lambda d: quality.classify(None, d, labels), lambda d: quality.classify(None, d, labels.limit(0))):
        assert f(docs.limit(0)).count() == 0
