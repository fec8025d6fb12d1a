"""The operators against brute force on small texts with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontam, jaccard, jpeg, langid, lmscore, packing, pii, quality, sentences, toxicity
from strandlake.llm._text import steps

LONG = "word%d and more of the same text here. "
TEXTS = {
    0: "The quick brown fox jumps over the lazy dog near the old river bank today",
    1: "The quick brown fox jumps over the lazy dog near the old river bank today",
    2: None,
    3: "",
    4: "one",
    5: "Mail a.b@c.de or call +1 (605) 555-9305, card 4337166598464399, ip 10.0.0.1 and 999.1.1.1",
    6: "".join(LONG % i for i in range(400)),
    7: "".join(LONG % i for i in range(398)) + "another end",
    8: "日本語 ünï \x00 \x85 é",
    9: "a@b@c.d 1.2.3.4.5.6.7.8 +12 34 56 78 90 12",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), 0.5, 1) for k, t in TEXTS.items()]
    rows += [rows[0], (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, prefix int").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k != 4), int(k == 5)) for k in TEXTS] + [(3, None, None)], "doc_id long, quality int, toxic int")


def naive_spans(text):
    made = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    made += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    made += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    made += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(made, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_pii(spark, docs):
    field = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(spark, docs, field).collect()}
    for k, t in TEXTS.items():
        base = naive_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert {x for x in pii.written(base).split(",") if x} <= set(got[k]["spans"].split(","))
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = "".join(rng.choice(list("a.@1 2+(-)9x0"), 60))
        assert pii.base_spans(t) == naive_spans(t)
    assert pii.redacted(TEXTS[5], field).startswith("Mail [EMAIL] or call [PHONE], card [CARD], ip [IP]")
    assert pii.redact(docs, field).columns == docs.columns


def test_skip_chain(spark):
    t = pii.tokens(x := "call +1 (605) 555-9305 now. " + "word " * 20 + "again 605 555 9305 today", pii.base_spans(x))
    field = pii.fit([t] * 20)
    assert [s[2] for s in pii.all_spans(x, field)[1]] == ["phone", "phone"]
    assert pii.hubs(["k", "z", "k", "y", "y"]).tolist() == [[0, 0], [2, 0], [3, 1], [4, 1]]
    far = "call +1 (605) 555-9305 now. " + "number 99887766 and word " * 60 + "again 605 555 9305 today"
    other = pii.tokens(n := "number 99887766 and word " * 3, pii.base_spans(n))
    field = pii.fit([t, other] * 20)
    assert [s[:2] for s in pii.all_spans(far, field)[1]] == [(5, 22), (far.index("605 555"), far.index("605 555") + 12)]


def test_marginals_by_enumeration():
    """On trees sum-product is exact: all labellings of small documents are summed up."""
    rng = np.random.default_rng(8)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(k, pii.N_FEATURES)), rng.normal(size=(2, k, k)), rng.normal(size=(k, k)))
    field.skip = (field.skip + field.skip.T) / 2
    for key, fixed in ((["a", "b", "c"], [0, 2, 0]), (["a"], [0]), (["a", "b"], [0, 0])):
        t = pii.Tokens([], rng.normal(size=(len(key), pii.N_FEATURES)), key, np.array(fixed))
        score = t.x @ field.unary.T
        total = np.zeros((len(key), k))
        for y in itertools.product(range(k), repeat=len(key)):
            if all(f in (0, v) for f, v in zip(fixed, y)):
                w = sum(score[i, v] for i, v in enumerate(y) if not fixed[i]) + sum(field.chain[0][a, b] for a, b in itertools.pairwise(y))
                for i, v in enumerate(y):
                    total[i, v] += np.exp(w)
        assert np.allclose(field.marginals(t, settled=1e-12), total / total.sum(1, keepdims=True), atol=1e-6)


def test_jpeg(spark, docs, monkeypatch):
    rng = np.random.default_rng(2)
    for n in (576, 576 * 13):
        p = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        image = jpeg.Progressive(jpeg.store(p))
        assert jpeg.payload_of(image) == p
        with monkeypatch.context() as m:  # bit by bit, as for any other image
            m.setattr(jpeg.Progressive, "even_scan", lambda *a: False)
            other = jpeg.Progressive(jpeg.store(p))
        assert all((a.coef == b.coef).all() for a, b in zip(image.components, other.components))
    grid = np.cos((2 * np.arange(8) + 1)[:, None] * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)
    c = rng.normal(size=(8, 8))
    assert np.allclose((c.reshape(1, 64) @ jpeg.IDCT).reshape(8, 8), grid @ c @ grid.T, atol=1e-4)
    got = {r["doc_id"]: r for r in jpeg.store_texts(spark, docs).collect()}
    for k, t in TEXTS.items():
        raw = (t or "").encode()
        raw += b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (got[k]["payload_sha256"], got[k]["tail_crc32"]) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    broken = spark.createDataFrame([(1, b"no image"), (2, None), (3, jpeg.store(bytes(576)))], "k long, b binary")
    assert [(r["k"], r["rgb"] is not None) for r in jpeg.decode(broken, "b", "k").orderBy("k").collect()] == [(1, False), (2, False), (3, True)]


def test_jpeg_of_broken_streams(spark):
    rng = np.random.default_rng(5)
    whole = jpeg.store(rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes())
    cuts = [*range(0, 400, 7), len(whole) // 2, len(whole) - 200, len(whole) - 3, len(whole) - 2, len(whole) - 1]
    for n in cuts:
        with pytest.raises((ValueError, IndexError, KeyError, struct.error)):
            jpeg.Progressive(whole[:n])
    at = whole.index(b"\xff\xc2") + 5
    huge = whole[:at] + b"\xff\xff\xff\xff" + whole[at + 4 :]
    rows = [(i, x) for i, x in enumerate([whole, whole[: len(whole) // 2], whole[:-200], whole[:-2], huge, whole + b"more", b"\xff\xd8\xff\xd9", whole])]
    got = jpeg.decode(spark.createDataFrame(rows, "k long, b binary").withColumn("rgb", F.lit(1)), "b", "k").orderBy("k").collect()
    assert [r["rgb"] is not None for r in got] == [True, False, False, False, False, True, False, True]
    assert got[0]["rgb"] == got[5]["rgb"] == got[7]["rgb"] and "large" in got[4]["error"] and "end" in got[1]["error"]
    assert jpeg.decode(spark.createDataFrame(rows[:1], "k long, b binary"), "b", "k", 100).first()["rgb"] is None


def test_lm(spark, docs):
    step = next(steps(pa.array(["abc abc abcd", "hello", None, "abd"])))
    g, at = lmscore.grams(step)
    trie = lmscore.Trie(*np.unique(g, return_counts=True))
    assert np.allclose(trie.walk(g), trie.logs(g))
    for context in (b"c abc", b"zzabc", b"qqqqq"):
        all_ = np.array([int.from_bytes(context + bytes([i]), "big") for i in range(256)], np.uint64)
        assert abs((10 ** trie.walk(all_)).sum() - 1) < 1e-9
    known = {k: t or "" for k, t in TEXTS.items()}
    rows = [*known.items(), (0, known[0]), (None, "no id at all")]
    split = lambda t: [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [None]
    train = [w for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 10 for w in split(t)]
    n, v = len(train), len(set(train))
    got = lmscore.score(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words = split(dict(rows)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in train for w in words), n)
        assert abs(r["base_score"] - sum(np.log10((train.count(w) + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6


def test_lm_keeps_every_leaf(spark):
    """More distinct leaves than 2^20; the scores are those of one trie over all of them."""
    rng = np.random.default_rng(4)
    texts = {i: bytes(rng.integers(97, 123, 250_000, dtype=np.uint8)).decode() for i in range(5)} | {10: "abc abd", 11: None, 12: ""}
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts[held] = texts[0][1000:1200] + "zz 日本 q"
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    key, count = np.unique(np.concatenate([lmscore.grams(s)[0] for s in steps(pa.array(train))]), return_counts=True)
    assert len(key) > 1 << 20
    trie = lmscore.Trie(key, count)
    got = lmscore.score(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = sum(trie.logs(lmscore.grams(s)[0]).sum() for s in steps(pa.array([texts[r["doc_id"]]], pa.string())))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def test_packing(spark, docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tok = packing.coder(path).tok
    got = packing.pack(spark, docs, path).collect()
    want = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in TEXTS.items()}
    for k, ids in want.items():
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == k}) if k else []
        for start, length, crc, total in own:
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], np.uint32).tobytes())
        assert not k or sum(x[1] for x in own) == len(ids)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 2048


def test_classifiers(spark, docs, labels):
    for made in (quality.classify(spark, docs, labels), toxicity.classify(spark, docs, labels)):
        got = made.collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = labels.limit(0)
    assert quality.classify(spark, docs, empty).count() == docs.count()
    assert toxicity.classify(spark, docs, empty).count() == docs.count()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((quality.fit(x, y).predict(x) > 0.5) == y).mean() > 0.95


def test_language(spark, docs):
    got = {r["doc_id"]: r for r in langid.identify(spark, docs).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[0]["lang_pred"] == "en"
    model = langid.fit({"a": "abab abab ab", "b": "xyz xyz zyx"}, 1000)
    size = np.array([6, 5])
    padded = np.array([list(b" abab "), list(b" xyz ") + [32]], np.uint8)
    count = model.phrases(padded, size)
    assert count[0, 0] < count[0, 1] and count[1, 1] < count[1, 0]


def test_language_of_few_bytes(spark):
    """A language with one short row leaves the others as they are, and words far into a long text are learnt."""
    en = "the house stands near the river where children play every morning before school"
    de = "das haus steht nahe am fluss wo kinder jeden morgen vor der schule spielen"
    rows = [(i, f"{t} ", k) for i, (t, k) in enumerate([(en, "en"), (de, "de")] * 20)]
    rows += [(1000 + i, "ok", "xx") for i in range(2)] + [(2000, "word " * 20_000 + "zebra giraffe okapi", "en"), (2001, "zebra giraffe okapi", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert zlib.crc32(b"2000") % 5 and any(zlib.crc32(str(1000 + i).encode()) % 5 for i in range(2))
    assert all(got[i] == k for i, _, k in rows if i < 1000) and got[2001] == "en"


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for f in (jaccard.components, sentences.removed, lmscore.score, langid.identify, jpeg.store_texts):
        assert f(spark, none).count() == 0
