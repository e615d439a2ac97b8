"""Toxicity: a linear-chain conditional random field over tokens.

Labels come per document, so tokens are labelled first: a feature of a token
(the lower-cased word, or its first 4 or 5 characters) counts as an offence
mark if at least ``support`` toxic and few of the clean training documents
have it (smoothed log odds of at least ``min_odds``); the bar is a number of
documents, so it does not grow with the sample. A token of a toxic document
with such a mark is labelled toxic, every other token clean.

The CRF (two states; weights of the marks, a state bias and transitions) is
fitted on bounded windows of labelled tokens by gradient ascent of the exact
log likelihood. Scoring is exact forward-backward over the whole text: tokens
without a mark all have the same potentials, so a run of k of them is the
k-th power of one 2 x 2 matrix and only marked tokens are stepped through.
The marginals of the toxic state at marked tokens give the offending offsets
(marginal >= 0.5) and, through a logistic layer on their sum, maximum and
rate, the document's score.

Training reads at most ``per_class`` documents of each label, taken by a
seeded hash, texts counted once; the model holds every mark of that sample.

Defined cases: null, empty and unmarked texts get the score of a text without
offence; repeated rows are scored alike; a document with several labels
counts as toxic if one of them is 1; null labels and labels without a
document are ignored; without labels of both kinds every score is 0; an empty
table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, written

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5)
WINDOW = 48
FLUSH = 100_000


def tokens_of(text: str) -> list[str]:
    """The tokens, lower-cased after they are cut: case folding can add
    characters that would cut them elsewhere."""
    return "\n".join(TOKEN.findall(text)).lower().split("\n") if TOKEN.search(text) else []


def features(token: str) -> list[str]:
    """Feature names of one lower-cased token."""
    return ["=" + token, *(token[:n] for n in PREFIXES if len(token) >= n)]


@dataclass
class ToxicModel:
    marks: dict[str, float] = field(default_factory=dict)      # weight of the toxic state
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))
    trained: bool = False

    def __post_init__(self) -> None:
        self.heads = {f[1:5] if f[0] == "=" else f[:4] for f in self.marks}
        self.step = np.exp(self.trans)
        quiet = self.step * np.array([1.0, math.exp(self.bias)])       # one unmarked token
        self.quiet = quiet / np.abs(np.linalg.eigvals(quiet)).max()
        self.powers: dict[int, np.ndarray] = {0: np.eye(2)}

    def power(self, k: int) -> np.ndarray:
        if k not in self.powers:
            if len(self.powers) > 4096:    # gaps of one length recur; the memory stays bounded
                self.powers.clear()
            self.powers[k] = np.linalg.matrix_power(self.quiet, k)
        return self.powers[k]

    def marked(self, text: str) -> tuple[list[tuple[int, int, int, float]], int]:
        """``(token number, start, end, weight)`` of marked tokens, and the number of tokens."""
        heads = self.heads
        tokens = tokens_of(text)
        if not any(t[:4] in heads for t in tokens):
            return [], len(tokens)
        out, n = [], 0
        for n, (token, m) in enumerate(zip(tokens, TOKEN.finditer(text)), 1):
            if token[:4] in heads:
                w = [self.marks[f] for f in features(token) if f in self.marks]
                if w:
                    out.append((n - 1, m.start(), m.end(), sum(w)))
        return out, n

    def marginals(self, marked: list[tuple[int, int, int, float]], n: int) -> np.ndarray:
        """Marginal of the toxic state at each marked token of a text of ``n`` tokens."""
        if not marked:
            return np.zeros(0)
        gaps = [b[0] - a[0] - 1 for a, b in zip(marked, marked[1:])]
        emit = [np.array([1.0, math.exp(min(50.0, self.bias + m[3]))]) for m in marked]
        fwd, at = [], np.array([1.0, 0.0])                 # the chain starts clean
        for k, e in zip([marked[0][0], *gaps], emit):
            at = at @ self.power(k) @ self.step * e
            at = at / at.sum()
            fwd.append(at)
        back = self.power(n - 1 - marked[-1][0]) @ np.ones(2)
        out = np.zeros(len(marked))
        for i in range(len(marked) - 1, -1, -1):
            p = fwd[i] * back
            out[i] = p[1] / p.sum()
            if i:
                back = self.power(gaps[i - 1]) @ (self.step @ (emit[i] * back))
                back = back / back.sum()
        return out

    def summary(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int, int, float]], np.ndarray]:
        found, n = self.marked(text or "")
        p = self.marginals(found, n)
        x = np.array([1.0, math.log1p(p.sum()), p.max() if len(p) else 0.0, p.sum() / max(1, n)])
        return x, found, p

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """Document score and the offsets of its toxic tokens."""
        if not self.trained:
            return 0.0, []
        x, found, p = self.summary(text)
        return 1 / (1 + math.exp(-float(np.clip(x @ self.layer, -40, 40)))), \
            [(m[1], m[2]) for m, q in zip(found, p) if q >= 0.5]


def _windows(texts: list[str], toxic: list[int], marks: list[str], rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token windows as (mark ids padded with len(marks), labels, mask)."""
    at, k = {f: i for i, f in enumerate(marks)}, len(marks)
    width = 1 + len(PREFIXES)
    ids, labels, mask = [], [], []
    for text, y in zip(texts, toxic):
        tokens = tokens_of(text)
        if not tokens:
            continue
        found = [i for i, t in enumerate(tokens) if any(f in at for f in features(t))] or [len(tokens) // 2]
        for mid in rng.choice(found, min(2, len(found)), replace=False):
            part = tokens[max(0, mid - WINDOW // 2):][:WINDOW]
            x = [[at[f] for f in features(t) if f in at] for t in part]
            pad = WINDOW - len(part)
            ids.append([r + [k] * (width - len(r)) for r in x] + [[k] * width] * pad)
            labels.append([int(y and bool(r)) for r in x] + [0] * pad)
            mask.append([1] * len(part) + [0] * pad)
    return np.array(ids), np.array(labels), np.array(mask, float)


def fit_crf(ids: np.ndarray, labels: np.ndarray, mask: np.ndarray, marks: list[str], rounds: int = 120,
            lr: float = 0.15, l2: float = 1e-3) -> ToxicModel:
    """Gradient ascent (Adam) of the log likelihood of the labelled windows."""
    n, length = labels.shape
    w, b, trans = np.zeros(len(marks) + 1), -2.0, np.zeros((2, 2))
    state = [np.zeros(len(w) + 5), np.zeros(len(w) + 5)]
    prev = np.concatenate([np.zeros((n, 1), int), labels[:, :-1]], axis=1)
    for t in range(1, rounds + 1):
        e = b + w[ids].sum(axis=2)                                  # n x length, toxic state
        m = np.exp(trans)
        emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -50, 50))], axis=2)
        fwd = np.zeros((n, length, 2))
        at = np.tile([1.0, 0.0], (n, 1))
        for i in range(length):
            nxt = at @ m * emit[:, i]
            nxt /= nxt.sum(axis=1, keepdims=True)
            at = np.where(mask[:, i:i + 1] > 0, nxt, at)
            fwd[:, i] = at
        back, gt, gamma = np.ones((n, 2)), np.zeros((2, 2)), np.zeros((n, length))
        for i in range(length - 1, -1, -1):
            live = mask[:, i:i + 1] > 0
            p = fwd[:, i] * back
            p /= p.sum(axis=1, keepdims=True)
            gamma[:, i] = p[:, 1] * mask[:, i]
            before = fwd[:, i - 1] if i else np.tile([1.0, 0.0], (n, 1))
            pair = before[:, :, None] * m[None] * (emit[:, i] * back)[:, None, :]
            pair = pair / pair.sum(axis=(1, 2), keepdims=True) * mask[:, i][:, None, None]
            gt -= pair.sum(axis=0)
            nb = (emit[:, i] * back) @ m.T
            back = np.where(live, nb / nb.sum(axis=1, keepdims=True), back)
        np.add.at(gt, (prev[mask > 0], labels[mask > 0]), 1)
        miss = (labels - gamma) * mask
        gw = np.zeros(len(w))
        for k in range(ids.shape[2]):
            gw += np.bincount(ids[:, :, k].ravel(), miss.ravel(), len(w))
        gw[-1] = 0
        g = np.concatenate([gw, [miss.sum()], gt.ravel()]) / n - l2 * np.concatenate([w, [b], trans.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = lr * state[0] / (1 - 0.9 ** t) / (np.sqrt(state[1] / (1 - 0.99 ** t)) + 1e-8)
        w, b, trans = w + move[:len(w)], b + move[len(w)], trans + move[-4:].reshape(2, 2)
        w[-1] = 0
    return ToxicModel(dict(zip(marks, w[:-1].tolist())), float(b), trans, trained=True)


def _fit_layer(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    a = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(a))
        a = a + np.clip(np.linalg.solve(h, x.T @ (y - p) / len(y) - l2 * a), -4, 4)
    return a


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = 6000,
          support: int = 5, min_odds: float = 1.5, seed: int = 42) -> ToxicModel:
    """Fit on labelled documents whose id is not in the held-out fold."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_fold(F.col("doc_id"), folds) != held_out)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicModel()
    bound = {k: int(min(1.0, per_class / sizes[k]) * (1 << 30)) for k in (0, 1)}
    pick = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    chosen = known.where(pick < F.when(F.col("toxic") == 1, bound[1]).otherwise(bound[0])).where("toxic in (0, 1)")
    texts = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = written(texts.join(F.broadcast(chosen), "doc_id")              # 2 * per_class ids
                     .groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity")

    def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[Counter] = [Counter(), Counter()]

        def counted() -> pd.DataFrame:
            names = sorted(seen[0].keys() | seen[1].keys())
            out = pd.DataFrame({"f": pd.Series(names, dtype=object), "t": [seen[1][f] for f in names], "c": [seen[0][f] for f in names]})
            seen[0].clear(), seen[1].clear()
            return out
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"]):
                seen[y].update({f for t in set(tokens_of(text)) for f in features(t)})
                if len(seen[0]) + len(seen[1]) > FLUSH:         # the sums are taken in Spark
                    yield counted()
        if seen[0] or seen[1]:
            yield counted()
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicModel()
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    marks = sample.mapInPandas(document_counts, "f string, t long, c long").groupBy("f") \
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c")) \
        .where((F.col("t") >= support) & (odds >= min_odds)) \
        .select("f").collect()                     # each has ``support`` of the sample's documents
    marks = sorted(r["f"] for r in marks)
    if not marks:
        model = ToxicModel(trained=True)
        model.layer[0] = math.log(n[1] / n[0])
        return model

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, text, y in zip(pdf["h"], pdf["text"], pdf["toxic"]):
                ids, lab, mask = _windows([text], [y], marks, np.random.default_rng([seed, h & 0xFFFFFFFF]))
                if len(ids):
                    yield pd.DataFrame({"h": h, "y": y, "ids": [x.astype(np.int32).tobytes() for x in ids],
                                        "lab": [x.astype(np.int8).tobytes() for x in lab],
                                        "mask": [x.astype(np.int8).tobytes() for x in mask]})
    got = sample.mapInPandas(windows, "h long, y int, ids binary, lab binary, mask binary").collect()
    got.sort(key=lambda r: (r["h"], bytes(r["ids"])))
    ids = np.array([np.frombuffer(r["ids"], np.int32) for r in got]).reshape(len(got), WINDOW, -1).astype(int)
    model = fit_crf(ids, np.array([np.frombuffer(r["lab"], np.int8) for r in got]).astype(int),
                    np.array([np.frombuffer(r["mask"], np.int8) for r in got]).astype(float), marks)
    shared = docs.sparkSession.sparkContext.broadcast(model)                # one number per mark

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [shared.value.summary(t)[0] for t in pdf["text"]]
            yield pd.DataFrame(np.array(x).reshape(-1, 4), columns=list("abcd")).assign(y=pdf["toxic"], h=pdf["h"])
    rows = sorted(map(tuple, sample.mapInPandas(summaries, "a double, b double, c double, d double, y int, h long").collect()))
    data = np.array([r[:5] for r in rows])
    model.layer = _fit_layer(data[:, :4], data[:, 4])
    return model


def score(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns, or ``keep``) with ``toxic_score`` and
    ``toxic_spans`` (start, end in characters); columns of these names are
    replaced."""
    docs = docs.drop("toxic_score", "toxic_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [shared.value.score(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({"score": [g[0] for g in got],
                             "spans": [[{"start": a, "end": b} for a, b in g[1]] for g in got]})
    out = docs.withColumn("_kt", run(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in (keep or docs.columns)], F.col("_kt.score").alias("toxic_score"),
                      F.col("_kt.spans").alias("toxic_spans"))
