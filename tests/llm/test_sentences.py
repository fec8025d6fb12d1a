"""Sentence spans against brute force, and the cases that the docstrings name."""

import re

import numpy as np

from strandlake.llm import sentences

LEAST = sentences.MIN_WORDS


def parted(text):
    parts = re.split(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*|[\n\r]+", text or "")
    return [x for x in (re.sub(r"\s+", " ", p).strip(" ") for p in parts) if x]


def covered(rows):
    """For each distinct (id, text) the sentences in a run that an earlier place has; earlier by id (null last), and place."""
    first, spans = {}, []
    for k, (i, t) in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))):
        s = parted(t)
        n = [len(x.split()) for x in s]
        own = set()
        for a in range(len(s)):
            for b in range(a, len(s)):
                total = sum(n[a : b + 1])
                if total >= LEAST and (total - n[b] < LEAST or total - n[a] < LEAST):
                    own.add((a, b))
        for a, b in sorted(own):
            spans.append((k, i, t, a, b, "\n".join(s[a : b + 1])))
    out = {}
    for k, i, t, a, b, run in spans:
        if run in first:
            out.setdefault((i, t), set()).update(range(a, b + 1))
        first.setdefault(run, (k, a))
    return {key: sorted(v) for key, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, ["x"]) for i, t in rows], "doc_id long, text string, h int, sentences array<string>")


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 26))) + "." for _ in range(40)]
    rows = [(int(i), " ".join(pool[j] for j in rng.integers(0, 40, rng.integers(0, 14)))) for i in rng.permutation(60)]
    shared = " ".join(pool[:9])
    rows += [(100 + i, f"Own start {i}. {shared} Own end {i}.") for i in range(5)]
    got = {(r["doc_id"], r["text"]): r["removed"] for r in sentences.removed(spark, frame(spark, rows)).join(frame(spark, rows).select("doc_id", "text"), "doc_id").collect()}
    assert got == covered(rows) and len(got) > 20


def test_named_cases(spark):
    passage = "First sentence of a shared passage that is long enough here. Second one follows with some more words. Third one ends the passage now."
    han = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u73a9\u3002" * 4
    rows = [(1, f"Own start of one. {passage} Own end."), (2, f"Other start here. {passage} Other end here."), (3, None), (4, ""), (5, f"{passage} {passage}"), (None, passage)]
    rows += [(6, "Short line here.\nAgain short."), (7, "Short line here.\nAgain short."), (8, han), (9, han)]
    rows += [(10, " ".join(f"v{i}" for i in range(50))), (11, " ".join(f"v{i}" for i in range(50)))]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in sentences.dedup(spark, df).collect()}
    assert {k: r["removed"] for k, r in got.items()} == {2: [1, 2, 3], 5: [0, 1, 2, 3, 4, 5], None: [0, 1, 2], 8: [1, 2, 3], 9: [0, 1, 2, 3], 11: [0]}
    assert got[2]["text"] == "Other start here.\nOther end here." and got[None]["text"] == ""
    assert sentences.removed(spark, df.limit(0)).count() == 0


def test_repeated_ids(spark):
    """Of two rows with one id, only the one that repeats a passage loses sentences; repeated rows are one document."""
    passage = " ".join(f"p{i}" for i in range(25)) + "."
    rows = [(1, passage), (2, f"Begin. {passage}"), (2, "A. B. C. D."), (1, passage)]
    got = [(r["doc_id"], r["removed"], r["text"]) for r in sentences.dedup(spark, frame(spark, rows)).collect()]
    assert got == [(2, [1], "Begin.")]


def test_long_text(spark):
    words = " ".join(f"q{i}." if i % 3 == 0 else f"q{i}" for i in range(60_000))
    got = sentences.removed(spark, frame(spark, [(1, words), (2, words)])).collect()
    assert [(r["doc_id"], r["removed"]) for r in got] == [(2, list(range(len(parted(words)))))]
