"""Personal data: patterns, and a skip-chain conditional random field that keeps labels of similar tokens consistent."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import lowest
from strandlake.llm._text import record_batch

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits, as one ends with all of its last run: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What the field labels: long runs of digits with separators, and words around an at sign, also a spelt one.
_CANDIDATE = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++|[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]++)*+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each at sign: its local part goes back to the last match or other character."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.fullmatch(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns alone, by start and then kind as listed."""
    made = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        made += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                made.append((m.start(), m.end(), "card"))
        made += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(made, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Tokens:
    """Candidates of a document: spans, features, key of similarity, and the label that the patterns fix (0: none does)."""

    span: list[tuple[int, int]]
    x: np.ndarray
    key: list[str]
    fixed: np.ndarray


N_FEATURES = 18


def features(text: str, a: int, b: int) -> tuple[np.ndarray, str]:
    word = text[a:b]
    digits = "".join(_DIGIT.findall(word))
    x = np.zeros(N_FEATURES)
    x[0] = 1
    is_mail = "@" in word or "at]" in word or "at)" in word
    n = len(digits)
    if is_mail:
        x[1] = 1
        x[2] = "." in word or "dot" in word
        key = "@" + re.sub(r"[ \[\]().]|@|at(?=[\])])|dot(?=[\])])", "", word.lower())
    else:
        x[3 + min(5, (n - 1) // 3)] = 1
        parts = word.split(".")
        x[9] = len(parts) == 4 and all(p.isdigit() for p in parts)
        x[10] = x[9] and all(len(p) <= 3 and int(p) <= 255 for p in parts)
        x[11] = 12 <= n <= 19 and luhn(digits)
        x[12] = word[0] == "+"
        x[13] = "(" in word
        x[14] = "-" in word or " " in word
        x[15] = 10 <= n <= 12
        before = text[max(0, a - 12) : a].lower()
        x[16] = before.rstrip().endswith((":", "=", "#"))
        x[17] = b < len(text) and (text[b].isalnum() or text[b] == "_") or (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_="))
        key = "." + ".".join(parts) if x[9] else digits[-8:]
    return x, key


def pieces(word: str) -> list[tuple[int, int]]:
    """The candidate whole, or in two where a space parts a card number of 12 to 19 digits from what is too long to be one token."""
    if sum(map(str.isdigit, word)) > 15:
        for m in re.finditer(" ", word):
            sides = [re.sub("[ -]", "", x) for x in (word[: m.start()], word[m.end() :])]
            if any(x.isdigit() and 12 <= len(x) <= 19 and luhn(x) for x in sides):
                return [(0, m.start()), (m.end(), len(word))]
    return [(0, len(word))]


def tokens(text: str, base: list[tuple[int, int, str]]) -> Tokens:
    """Each base span is a candidate; others are those that touch none and have at least 8 digits or an at sign."""
    taken = sorted((a, b, KINDS.index(k) + 1) for a, b, k in base)
    spans = [(a, b, k) for a, b, k in taken]
    i = 0
    for m in _CANDIDATE.finditer(text) if _DIGIT.search(text) or "@" in text or "at" in text else ():
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if any(s < b and e > a for s, e, _ in taken[i : i + 3]):
            continue
        spans += [(a + i, a + j, 0) for i, j in pieces(m[0]) if sum(map(str.isdigit, m[0][i:j])) >= 8 or "@" in m[0] or "at]" in m[0] or "at)" in m[0]]
    spans.sort()
    made = [features(text, a, b) for a, b, _ in spans]
    return Tokens([(a, b) for a, b, _ in spans], np.array([x for x, _ in made]).reshape(-1, N_FEATURES), [k for _, k in made], np.array([k for *_, k in spans], np.int64))


def hubs(key: list[str]) -> np.ndarray:
    """(candidate, hub) of each candidate whose key another one has too: n occurrences of a key meet in one hub, so that all are two edges apart."""
    count = Counter(key)
    number = {k: i for i, k in enumerate(k for k, n in count.items() if n > 1)}
    return np.array([(i, number[k]) for i, k in enumerate(key) if k in number], np.int64).reshape(-1, 2)


@dataclass
class Field:
    """Log potentials: unary[label, feature]; chain[same key or not, label, label] of neighbours; skip[label, label] of a token and its key's hub."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def edges(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes and their potentials; hubs come after the candidates."""
        n = len(t.key)
        line = np.column_stack([np.arange(n - 1), np.arange(1, n)])
        same = np.fromiter((t.key[i] == t.key[i + 1] for i in range(n - 1)), np.int64, max(0, n - 1))
        far = hubs(t.key)
        return np.concatenate([line, far + np.array([0, n])]), np.concatenate([self.chain[same], np.broadcast_to(self.skip, (len(far), *self.skip.shape))])

    def marginals(self, t: Tokens, rounds: int = 500, damping: float = 0.3, settled: float = 1e-4) -> np.ndarray:
        """Loopy sum-product over the document's graph until no message changes by `settled`, or for `rounds` where they swing; fixed labels are certain."""
        score = t.x @ self.unary.T
        some = t.fixed > 0
        score[some] = -50
        score[some, t.fixed[some]] = 0
        edge, potential = self.edges(t)
        if not len(edge):
            return softmax(score)
        n = len(score)
        score = np.concatenate([score, np.zeros((max(0, int(edge.max()) + 1 - n), score.shape[1]))])
        source, target = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
        table = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edge)) + len(edge), np.arange(len(edge))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = score.copy()
            np.add.at(belief, target, message)
            out = log_sum((belief[source] - message[back])[:, :, None] + table)
            out -= out.max(1, keepdims=True)
            new = damping * message + (1 - damping) * out
            moved = np.abs(new - message).max()
            message = new
            if moved < settled:
                break
        belief = score.copy()
        np.add.at(belief, target, message)
        return softmax(belief[:n])


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: list[Tokens], rounds: int = 200, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood by gradient ascent. The patterns give the labels; a candidate that none matches takes the label of a similar one in its document, else none; a hub has its candidates' label."""
    k = len(LABELS)
    x, y, near, far = [], [], [], []
    base = 0
    for t in docs:
        label = t.fixed.copy()
        of: dict[str, int] = {}
        for key, f in zip(t.key, t.fixed, strict=True):
            if f:
                of[key] = int(f)
        for i, key in enumerate(t.key):
            label[i] = label[i] or of.get(key, 0)
        n = len(t.key)
        x.append(t.x), y.append(label)
        near += [(base + i, base + i + 1, int(t.key[i] == t.key[i + 1])) for i in range(n - 1)]
        far += [(base + i, of.get(t.key[i], 0)) for i, _ in hubs(t.key).tolist()]
        base += n
    field = Field(np.zeros((k, N_FEATURES)), np.zeros((2, k, k)), np.zeros((k, k)))
    if not base:
        field.skip[:] = np.eye(k) * 2
        return field
    x, y = np.concatenate(x), np.concatenate(y)
    e, h = np.array(near, np.int64).reshape(-1, 3), np.array(far, np.int64).reshape(-1, 2)
    one = np.eye(k)
    for _ in range(rounds):
        score = x @ field.unary.T
        pair, rows = field.chain[e[:, 2]], np.arange(len(e))
        np.add.at(score, e[:, 0], pair[rows, :, y[e[:, 1]]])
        np.add.at(score, e[:, 1], pair[rows, y[e[:, 0]], :])
        np.add.at(score, h[:, 0], field.skip[:, h[:, 1]].T)
        error = one[y] - softmax(score)
        field.unary += rate * (error.T @ x / len(y) - l2 * field.unary)
        left, right = error[e[:, 0]], error[e[:, 1]]
        grad = left[:, :, None] * one[y[e[:, 1]]][:, None, :] + one[y[e[:, 0]]][:, :, None] * right[:, None, :]
        for s in (0, 1):
            field.chain[s] += rate * (grad[e[:, 2] == s].sum(0) / len(y) - l2 * field.chain[s])
        both = error[h[:, 0]].T @ one[h[:, 1]] / max(1, len(h))
        field.skip += rate * ((both + both.T) / 2 - l2 * field.skip)
    return field


def train(docs: DataFrame, max_docs: int = 3000) -> Field:
    """Fit on at most max_docs distinct documents with a digit or an at sign, the first in order of a hash, with their whole texts.

    Only hashes among the lowest, about 4 * max_docs, are sorted; copies count once. Candidates and their features are made on the executors.
    """
    some = docs.select("text").where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    total = max(some.count(), 1)
    chosen = some.where(lowest("h", 4 * max_docs, F.lit(total))).select("h").distinct().orderBy("h").limit(max_docs)
    schema = pa.schema([("h", pa.int64()), ("x", pa.binary()), ("key", pa.list_(pa.string())), ("fixed", pa.binary())])

    def read(batches):
        for b in batches:
            made = [tokens(t, base_spans(t)) for t in b.column("text").to_pylist()]
            yield record_batch(schema, [b.column("h"), [t.x.tobytes() for t in made], [t.key for t in made], [t.fixed.tobytes() for t in made]])

    one = some.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    got = one.select("h", "text").mapInArrow(read, "h long, x binary, key array<string>, fixed binary").toArrow().sort_by("h").to_pylist()
    made = [Tokens([], np.frombuffer(r["x"]).reshape(-1, N_FEATURES), r["key"], np.frombuffer(r["fixed"], np.int64)) for r in got]
    return fit([t for t in made if t.key])


def all_spans(text: str, field: Field, least: float = 0.5) -> tuple[list, list]:
    """Base spans, and these with the spans that the field adds: candidates whose most likely label is a kind, with a probability over `least`."""
    base = base_spans(text)
    t = tokens(text, base)
    if not len(t.fixed) or t.fixed.all():
        return base, base
    p = field.marginals(t)
    best = p.argmax(1)
    added = [(*t.span[i], LABELS[best[i]]) for i in np.flatnonzero((t.fixed == 0) & (best > 0) & (p.max(1) > least))]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(spark: SparkSession, docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row, repeated rows included.

    The counts and the digest are of base spans; spans has these and the added ones. Null and empty texts have no spans
    (the digest is that of no bytes); a null id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches):
        for b in batches:
            made = []
            for text in b.column("text").to_pylist():
                base, spans = all_spans(text or "", field)
                count = [sum(s[2] == k for s in base) for k in KINDS]
                made.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            if made:
                yield record_batch(schema, [b.column("doc_id"), *zip(*made, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str | None, field: Field) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in all_spans(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The same rows and columns, texts redacted; null texts stay null. n_chars, where there is such a column, follows the text."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t if isinstance(t, str) else None, field) for t in texts], dtype=object)

    out = docs.withColumn("text", of(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out
