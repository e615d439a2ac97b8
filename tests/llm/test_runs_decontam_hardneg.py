"""Periodic runs, benchmark windows and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest_llm import documents
from keepsake.llm import decontam, hardneg, queries, runs

# ------------------------------------------------------------------ runs


def brute_runs(w, least=12):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def as_sequence(texts):
    return np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64)


def expected(texts):
    begin = itertools.accumulate([0, *map(len, texts)])
    return [(a + b, n, q) for w, b in zip(texts, begin) for a, n, q in brute_runs(w)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=5))
def test_runs_of_small_alphabets(texts):
    assert list(zip(*(x.tolist() for x in runs.runs_of(*as_sequence(texts))))) == expected(texts)


def test_runs_of_nested_repetitions():
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 260):
                unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
                unit += unit[:rng.randint(0, len(unit))]
                w += unit * rng.randint(1, 4)
            texts.append(w)
        assert list(zip(*(x.tolist() for x in runs.runs_of(*as_sequence(texts))))) == expected(texts)


def test_runs_at_the_least_length():
    for q in range(1, 40):
        unit = list(range(1, q + 1))
        size = max(12, 2 * q)
        for lead in range(9):
            head = list(range(100, 100 + lead))
            for n in (size - 1, size, size + 1):
                w = head + (unit * 14)[:n] + [99]
                assert list(zip(*(x.tolist() for x in runs.runs_of(*as_sequence([w]))))) == expected([w])


def test_find_runs_rows(spark):
    rows = [(1, "a b c " * 5, "en", "s"), (1, "a b c " * 5, "en", "s"), (2, None, None, None), (3, "", "x", None),
            (None, "z z " * 13, None, "s"), (5, " ".join(f"w{i}" for i in range(60_000)) + " q" * 30_000, None, None),
            (6, "x y " * 5 + "\x0bx\ty", None, None)]
    got = runs.find_runs(documents(spark, rows)).orderBy("doc_id", "collapsed").collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [tuple(x) for x in by_id[1]["runs"]] == [(0, 15, 3)] and by_id[1]["collapsed"] == "a b c"
    assert by_id[2]["runs"] == [] and by_id[2]["collapsed"] == "" and by_id[3]["runs"] == []
    assert [tuple(x) for x in by_id[None]["runs"]] == [(0, 13, 1)] and by_id[None]["collapsed"] == "z z"
    assert [tuple(x) for x in by_id[5]["runs"]] == [(60_000, 30_000, 1)]
    assert [tuple(x) for x in by_id[6]["runs"]] == [(0, 12, 2)]
    assert runs.find_runs(documents(spark, rows).where("false")).count() == 0


def test_run_query_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    planted = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        found = brute_runs(w)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        top = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
        want = (len(found), *top, 1000 * top[1] // top[2] if found else None,
                hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(),
                hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        g = got[r["doc_id"]]
        assert (g["n_runs"], g["start"], g["length"], g["period"], g["exponent_milli"], g["runs_sha256"], g["collapsed_sha256"]) == want
    assert planted > 5


# ------------------------------------------------------------------ benchmark windows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items, n):
    w, hit, named = re.findall(WORD, low(text)), set(), set()
    for item, other in items:
        o = re.findall(WORD, low(other))
        size = min(n, len(o))
        wins = {tuple(o[i:i + size]) for i in range(len(o) - size + 1)} if size else set()
        at = [i for i in range(len(w) - size + 1) if size and tuple(w[i:i + size]) in wins]
        hit |= {k for i in at for k in range(i, i + size)}
        named |= {str(item)} if at and item is not None else set()
    return len(w), sorted(hit), sorted(named)


def sample(rng, items=12, docs=60):
    say = lambda k: " ".join(rng.choice(["A", "b", "Été", "d", "e9"]) for _ in range(k))      # noqa: E731
    bench = [(rng.choice([None, 1, 7, 70, 8, i]), rng.choice([say(rng.randint(0, 9)), None, "", "...", say(3)])) for i in range(items)]
    text = lambda: rng.choice([None, "", "!?", say(rng.randint(0, 40)).replace(" ", rng.choice([" ", ", ", "\n"]))])      # noqa: E731
    return bench, [(rng.choice([None, i, 5]), text(), "en", None) for i in range(docs)]


@pytest.mark.parametrize("limit", [200_000, 3])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "MAX_WINDOWS", limit)
    bench, docs = sample(random.Random(limit))
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, n_hit int")
    d = documents(spark, docs)
    got = decontam.scan(d, b, ["doc_id", "text"], n=4).collect()
    seen = sorted((str(r["doc_id"]), r["text"] or "", r["n_words"], r["n_hit"], r["item_ids"],
                   [k for s in r["spans"] for k in range(s["first"], s["last"] + 1)]) for r in got)
    want = []
    for i, t, _, _ in docs:
        n, hit, named = brute_hits(t, bench, 4)
        want.append((str(i), t or "", n, len(hit), named, hit))
    assert seen == sorted(want)
    clean = decontam.remove_documents(d, b, n=4)
    assert clean.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(w[0] for w in want if not w[3])
    cut = decontam.remove_spans(d, b, n=4)
    assert cut.columns == d.columns and cut.count() == len(docs)
    left = sorted((str(r["doc_id"]), re.findall(WORD, low(r["text"]))) for r in cut.collect())
    assert left == sorted((w[0], [x for k, x in enumerate(re.findall(WORD, low(w[1]))) if k not in w[5]]) for w in want)


def test_remove_spans_keeps_other_characters(spark):
    b = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    d = documents(spark, [(1, "  So: THE quick, fox -- ran. (off)", None, None), (2, "The quick fox", None, None), (3, "a  b", None, None)])
    got = {r["doc_id"]: r["text"] for r in decontam.remove_spans(d, b, n=10).collect()}
    assert got == {1: "  So: ran. (off)", 2: "", 3: "a  b"}


def test_decontamination_of_empty_tables_and_long_texts(spark):
    b = spark.createDataFrame([(1, "p q r")], "item_id long, text string")
    long = "x " * 200_000 + "p q r " * 3
    d = documents(spark, [(1, long, None, None)] + [(9, "p q r", None, None)] * 3)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontam.scan(d, b).collect())
    assert got == [(1, 200_009, 9)] + [(9, 3, 3)] * 3
    assert [r["n_hit"] for r in decontam.scan(d, b.where("false")).collect()] == [0] * 4
    assert decontam.scan(d.where("false"), b).count() == 0


def test_decontamination_is_native(spark):
    d, b = documents(spark, [(1, "a b", None, None)]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontam.scan(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# ------------------------------------------------------------------ hard negatives

def brute_mine(rows, anchor, k_pos=5, k_neg=3):
    one = {}
    for i, v, label in rows:
        if None not in (i, v, label) and len(v) and all(x is not None and np.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    e = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, (_, v) in one.items()}
    out = set()
    for a in filter(anchor, one):
        s = {i: sum(x * y for x, y in zip(e[a], e[i])) for i in one if i != a and len(e[i]) == len(e[a])}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if one[i][0] == one[a][0]][:k_pos]:
            fit = [i for i in order if one[i][0] != one[a][0] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]]
            out |= {(a, p, r, i, s[p], s[i]) for r, i in enumerate(fit[:k_neg], 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0) for i, v, label in rows], "vec_id long, embedding array<double>, label int, page int")


def mined(df):
    return {tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 5 == 0).collect()}


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "copies"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hardneg, "PAGE", 48), monkeypatch.setattr(hardneg, "LEAF", 8), monkeypatch.setattr(hardneg, "NODE", 3)
    monkeypatch.setattr(hardneg, "PART", 16)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(400, 6))
    if kind == "clusters":
        x = rng.normal(size=(8, 6))[rng.integers(0, 8, 400)] * 3 + x * 0.1
    if kind == "copies":
        x[:180] = x[0]
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(400)]
    got = mined(vectors(spark, rows))
    assert got and got == brute_mine(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (5, [1.0, 1.5], 1), (1, [1.0, 1.0], 1), (2, [0.9, 1.0], 2), (3, [0.7, 1.0], 2), (3, [0.7, 1.0], 2),
            (4, [0.0, 0.0], 1), (6, [0.0, 0.0], 2), (7, None, 1), (8, [], 1), (9, [nan, 1.0], 2), (11, [inf, 1.0], 2),
            (12, [None, 1.0], 2), (13, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (10, [1.0, 2.0, 3.0], 1), (15, [1.0, 2.0, 2.0], 1),
            (14, [1.0, 1.4, 2.0], 2), (16, [0.8, 1.0], 3), (16, [0.8, 0.9], 2), (20, [-1.0, -2.0], 1)]
    assert mined(vectors(spark, rows)) == brute_mine(rows, lambda i: i % 5 == 0)
    assert mined(vectors(spark, rows).where("false")) == set()
    assert mined(vectors(spark, rows[1:2])) == set()


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**55, 3.0]])
    x = np.array([[1.0, 1.0], [1.0, 2.0], [2.0**55, 0.0]])
    assert hardneg.products(a, x).tolist() == [[2**55 + 3, 2**55 + 6, 2**62]]
