"""Benchmark decontamination against a plain Python version, and the slot cases that the docstrings name."""

from collections import Counter, defaultdict

import numpy as np
import regex

from strandlake.llm import decontam as D

MARKS = f"[{D.NUMBER}{D.NAME}{D.UNIT}]"


def template(t):
    t = regex.sub(MARKS, " ", t)
    t = regex.sub(r"(?<=[\p{Ll}\d,;] )\p{Lu}\p{Ll}+", D.NAME, t)
    t = regex.sub(r"(?<![\p{L}\d])\d+(?:[.,:/]\d+)*", D.NUMBER, t).lower()
    t = regex.sub(rf"[$€£¥%](?={D.NUMBER})|(?<={D.NUMBER})%|(?<={D.NUMBER} )%(?=\s)|(?<={D.NUMBER} ?)(?:{D.UNITS})(?![\p{{L}}\d])", D.UNIT, t)
    return regex.sub(rf"[^\p{{L}}\d\s{D.NUMBER}{D.NAME}{D.UNIT}]+", "", t)


def pairs(text):
    """(template word, raw word) of the words whose template is not empty."""
    raw = regex.sub(MARKS, " ", text or "").split()
    return [(t, r) for t, r in zip(template(" ".join(raw)).split(" "), raw, strict=True) if t] if raw else []


def grams(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def leaks(docs, items):
    """(doc, item): (matched, n, slots, conflicts, changed), by looking at every document and item."""
    out = {}
    for item, text in items:
        both = pairs(text)
        words = [t for t, _ in both]
        if len(words) < D.SHORTEST:
            continue
        size = min(D.WINDOW, len(words))
        want = {g for g in grams(words, size) if sum(not regex.fullmatch(f"{MARKS}+", w) for w in g) >= 2}
        for doc, body in docs:
            other = pairs(body)
            theirs = [t for t, _ in other]
            have = Counter(grams(theirs, size))
            found = want & set(have)
            if not want or len(found) < D.LEAST * len(want):
                continue
            shifts = Counter(j - i for i, g in enumerate(grams(words, size)) for j, h in enumerate(grams(theirs, size)) if g == h)
            shift = min(shifts, key=lambda s: (-shifts[s], s))
            value = lambda w: regex.sub(r"[^\p{L}\d.,:/]+|[.,:/]+$", "", w.lower())
            ways = defaultdict(Counter)
            for i, (t, a) in enumerate(both):
                if regex.search(MARKS, t) and 0 <= i + shift < len(other) and other[i + shift][0] == t:
                    ways[t, value(a)][value(other[i + shift][1])] += 1
            slots, conflicts = sum(sum(c.values()) for c in ways.values()), sum(sum(c.values()) - max(c.values()) for c in ways.values())
            changed = sum(n for (_, a), c in ways.items() for b, n in c.items() if a != b)
            if conflicts <= max(D.CHANCE, (1 - D.LEAST) * slots):
                out[doc, item] = (len(found), len(want), slots, conflicts, changed)
    return out


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, 1) for i, t in docs], "doc_id long, text string, n int, size int")
    x = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): (r["matched"], r["n_windows"], r["slots"], r["conflicts"], r["changed"]) for r in D.contaminated(spark, d, x).collect()}


def test_against_every_pair(spark):
    rng = np.random.default_rng(3)
    vocabulary = "the a train boat goes from to in of how many apples does have after and then she he buys sells costs".split()
    names = "Anna Bob Carl Dora".split()

    def sentence(n):
        made = []
        for _ in range(n):
            k = rng.random()
            made.append(str(rng.integers(2, 99)) if k < 0.15 else str(rng.choice(names)) if k < 0.25 else f"{rng.integers(2, 40)} km" if k < 0.3 else str(rng.choice(vocabulary)))
        return " ".join(made) + "?"

    items = [(i, sentence(rng.integers(2, 24))) for i in range(25)]
    docs = [(i, sentence(rng.integers(0, 60))) for i in range(20)]
    for k, (i, text) in enumerate(items):
        swap = {x: str(rng.integers(2, 99)) for x in set(regex.findall(r"\d+", text))}
        docs.append((100 + i, f"{sentence(8)} {regex.sub(r'[0-9]+', lambda m: swap[m[0]], text)} {sentence(5)}"))
        docs.append((200 + i, f"{sentence(8)} {regex.sub(r'[0-9]+', lambda m: str(rng.integers(2, 99)), text)}"))
        docs.append((300 + i, text.upper() if k % 5 == 0 else text.rstrip("?")))
    want = leaks(docs, items)
    assert len(want) > 40 and any(v[3] for v in want.values())
    assert got(spark, docs, items) == want


def test_slots(spark):
    items = [(1, "Tom has 2 apples and 2 pears in his basket today"), (2, "There are 3 cats and 5 dogs in the garden"), (3, "So he has 5. How many more will he get by then"), (4, "7 km 30 min 12 kg"), (5, "dog"), (6, None), (None, "Tom has 2 apples and 2 pears"), (7, "a 1 b 1 c 1 d 1 e 1 f 1 g 1 h 1 i 1 j 1 k 1 l 1")]
    docs = [(1, "Ann has 3 apples and 7 pears in his basket today"), (2, "there are 4 cats and 4 dogs in the garden"), (3, "so he has 5 how many more will he get by then"), (4, "it took 7 km 30 min 12 kg."), (5, "it took 9 km 31 min 15 kg."), (6, None), (7, ""), (None, "There are 3 cats and 5 dogs in the garden"), (8, "my dog"), (9, " ".join(f"{c} {i}" for i, c in enumerate("abcdefghijkl"))), (10, " ".join(f"{c} 44" for c in "abcdefghijkl"))]
    found = got(spark, docs, items)
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 4), (10, 7)}
    assert found[1, 1][3] == 1 and found[2, 2][3] == 0 and found[3, 3][3:] == (0, 0) and found[10, 7][4] == 12


def test_items_of_few_slots(spark):
    """A value that an item repeats has one value in a copy; of two equal ones, one may differ by chance."""
    frame = "the {} red boxes and the {} green boxes and the {} blue boxes are all in the shed"
    items = [(1, frame.format(7, 7, 7)), (2, "a farmer who owns {} sheep has to build one fence around them".format(7)), (3, "a baker sells {} loaves before noon and {} rolls after it".format(4, 4)), (4, "a pilot flies {} miles to the north and {} miles to the east".format(3, 9))]
    docs = [(i, frame.format(*v)) for i, v in enumerate([(7, 7, 7), (5, 5, 5), (7, 7, 8), (7, 8, 9), (1, 2, 3)])]
    docs += [(10, items[1][1]), (11, items[1][1].replace("7", "31")), (20, items[2][1].replace("4", "6")), (21, "a baker sells 4 loaves before noon and 8 rolls after it"), (30, items[3][1].replace("3", "8")), (31, items[3][1].replace("3", "9"))]
    found = got(spark, docs, items)
    assert set(found) == {(0, 1), (1, 1), (2, 1), (10, 2), (11, 2), (20, 3), (21, 3), (30, 4), (31, 4)}
    assert [found[k][2:] for k in ((0, 1), (1, 1), (2, 1), (11, 2), (21, 3))] == [(3, 0, 0), (3, 0, 3), (3, 1, 1), (1, 0, 1), (2, 1, 1)]


def test_empty_and_repeated(spark):
    item = [(1, "There are 3 cats and 5 dogs in the garden")]
    doc = (1, "There are 3 cats and 5 dogs in the garden")
    assert got(spark, [], item) == {} and got(spark, [doc], []) == {}
    assert set(got(spark, [doc, doc, (2, doc[1] + " x" * 200_000)], item)) == {(1, 1), (2, 1)}
    d = spark.createDataFrame([doc, (2, "clean text"), (3, None), (None, doc[1])], "doc_id long, text string")
    x = spark.createDataFrame(item, "item_id long, text string")
    assert sorted(D.decontaminate(spark, d, x).collect(), key=str) == sorted([(2, "clean text"), (3, None), (None, doc[1])], key=str)
