"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's bytes are folded (A-Z lower-cased, every ASCII byte that is not a
letter is a blank) and cut into n-grams of 2 to 4 bytes; each is hashed to one
of 2**15 embeddings of 16 dimensions. The mean embedding of all n-grams of
the whole text goes through a linear softmax. Embeddings and weights are
trained by stochastic gradient descent in numpy on a bounded sample: at most
``per_lang`` documents of each language, taken by a seeded hash, and of each at
most ``grams`` n-grams spread over the whole text plus one short run, so that
short texts are learned too. A fifth of the sample's documents calibrates: a
temperature is fitted by log loss, and the rejection thresholds are the
``reject`` quantiles over held-out samples that are rightly predicted, of the
score and of how usual the text's n-grams are (the mean log share of their
buckets in training: a softmax over the learned languages alone is sure of
letter noise and of unlearned languages too).

For scoring the mean embedding is linear in the n-grams, so one table of
2**15 x languages logits is sent to the tasks; texts are scored in slices of
bounded size, each whole.

Training collects at most 2 ``per_lang`` lists of ``grams`` buckets per
language (about 5 MB each).

Defined cases: a text that is null or has no letter (any script) is ``und``
with score 0 and is rejected; repeated rows are scored alike; with no labelled
row every text is ``und``; an empty table gives no rows; other columns are
ignored or kept. Ties go to the language first in code point order.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, slices

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
SLICE = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in string.ascii_lowercase:
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = ord(_c)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def hashed_grams(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order the bucket at every start, and whether the n-gram
    has a letter and no inner blank."""
    x = data.astype(np.uint32)
    blank = data == 32
    out = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m < 1:
            out.append((np.empty(0, np.uint32), np.empty(0, bool)))
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ x[k:k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        ok = ~(blank[:m] & blank[n - 1:n - 1 + m])
        for k in range(1, n - 1):
            ok &= ~blank[k:k + m]
        out.append((h & np.uint32(BUCKETS - 1), ok))
    return out


def grams_of(text: str) -> np.ndarray:
    """Buckets of all n-grams of one text."""
    data = _FOLD[np.frombuffer(b" " + _bytes(text) + b" ", np.uint8)]
    parts = [h[ok] for h, ok in hashed_grams(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray           # BUCKETS x langs: embedding @ weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    usual: np.ndarray | None = None      # log share of each bucket in training
    least_usual: float = -np.inf

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        has = [isinstance(t, str) and _LETTER.search(t) is not None for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        raw = [b" " + _bytes(t) + b"   " if ok else b"" for t, ok in zip(texts, has)]
        total, count, known = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in slices([len(r) for r in raw], SLICE):
            live = [i for i in range(a, b) if raw[i]]
            if not live:
                continue
            data = _FOLD[np.frombuffer(b"".join(raw[i] for i in live), np.uint8)]
            starts = np.cumsum([0] + [len(raw[i]) for i in live[:-1]])
            for h, ok in hashed_grams(data):           # the blanks between texts keep n-grams apart
                at = np.minimum(starts, len(h) - 1)
                for k in range(len(self.langs)):
                    total[live, k] += np.add.reduceat(np.where(ok, self.table[:, k][h], 0.0), at)
                count[live] += np.add.reduceat(ok.astype(np.float64), at)
                if self.usual is not None:
                    known[live] += np.add.reduceat(np.where(ok, self.usual[h], 0.0), at)
        p = self._softmax(total / np.maximum(count, 1)[:, None] + self.bias)
        best, has = p.argmax(axis=1), np.array(has, bool)
        score = np.where(has, p[np.arange(len(p)), best], 0.0) if len(p) else np.zeros(0)
        return ([self.langs[k] if ok else "und" for k, ok in zip(best, has)], score,
                has & (score >= self.threshold) & (known / np.maximum(count, 1) >= self.least_usual))


def fit(langs: list[str], y: np.ndarray, x: list[np.ndarray], seed: int = 42, epochs: int = 6, lr: float = 0.5,
        reject: float = 0.002, owner: np.ndarray | None = None) -> LanguageModel:
    """Train on bucket lists ``x`` with language numbers ``y``; lists of one
    ``owner`` (document) are all trained on or all held out."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    owners, owner = np.unique(np.arange(len(x)) if owner is None else owner, return_inverse=True)
    apart = np.isin(owner, rng.permutation(len(owners))[:len(owners) // 5])
    held, train = np.flatnonzero(apart), np.flatnonzero(~apart)
    bags = [np.unique(v, return_counts=True) for v in x]
    for epoch in range(epochs):
        step = lr * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, n = bags[i]
            if not len(ids):
                continue
            share = n / n.sum()
            mean = share @ emb[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= step * 0.1 * p
            emb[ids] -= step * 10 * np.outer(share, back)
    seen = np.zeros(BUCKETS)
    for i in train:
        seen[bags[i][0]] += bags[i][1]
    model = LanguageModel(langs, emb @ w, b, usual=np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS)))
    held = [i for i in held if len(bags[i][0])]
    if held:
        logits = np.array([(bags[i][1] / bags[i][1].sum()) @ model.table[bags[i][0]] for i in held]) + b
        truth = y[held]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model._softmax(logits)[np.arange(len(held)), truth], 1e-12)).mean()
        model.temperature = min((0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
        p = model._softmax(logits)
        right = p.argmax(axis=1) == truth
        if right.any():
            known = np.array([(bags[i][1] / bags[i][1].sum()) @ model.usual[bags[i][0]] for i in held])
            model.threshold = float(np.quantile(p[right].max(axis=1), reject))
            model.least_usual = float(np.quantile(known[right], reject))
    return model


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, per_lang: int = 1500, grams: int = 768,
          seed: int = 42) -> LanguageModel:
    """Fit on documents with a language whose id is not in the held-out fold."""
    usable = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_fold(F.col("doc_id"), folds) != held_out))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    pick = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for lang in langs:                                  # expected sample: per_lang documents of each
        share = F.when(F.col("lang") == lang, int(min(1.0, per_lang / sizes[lang]) * (1 << 30))).otherwise(share)
    sample = usable.where(pick < share).select("lang", pick.alias("h"), "doc_id", "text")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, h, doc_id, text in zip(pdf["lang"], pdf["h"], pdf["doc_id"], pdf["text"]):
                g = grams_of(text).astype("<u2")
                if not len(g):
                    continue
                spread = g[np.linspace(0, len(g) - 1, min(grams, len(g))).astype(int)]
                rows.append((lang, h, str(doc_id), spread.tobytes()))
                data = text.split()
                at = h % max(1, len(data) - 3)
                few = grams_of(" ".join(data[at:at + 4])).astype("<u2")
                few = few[np.linspace(0, len(few) - 1, min(grams, len(few))).astype(int)]
                rows.append((lang, h, str(doc_id), few.tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "h", "d", "g"])
    rows = sorted(map(tuple, sample.mapInPandas(draw, "lang string, h long, d string, g binary").collect()))
    y = np.array([langs.index(r[0]) for r in rows], np.int64)
    return fit(langs, y, [np.frombuffer(bytes(r[3]), "<u2").astype(np.int64) for r in rows], seed,
               owner=np.array([r[2] for r in rows]))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns, or ``keep``) with ``lang_pred``, ``lang_score`` and
    ``lang_accepted``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2**15 x languages numbers

    @F.pandas_udf("pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred, score, accepted = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"pred": pred, "score": score, "accepted": accepted})
    out = docs.withColumn("_kl", predict(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in (keep or docs.columns)], F.col("_kl.pred").alias("lang_pred"),
                      F.col("_kl.score").alias("lang_score"), F.col("_kl.accepted").alias("lang_accepted"))
