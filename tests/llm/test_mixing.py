import itertools

import numpy as np
from hypothesis import given, settings, strategies as st

from keepsake.llm import mixing
from conftest_llm import documents


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 120))
def test_fit_budget_is_the_best_sum(counts, budget):
    lengths, n = list(counts), list(counts.values())
    k = mixing.fit_budget(np.array(lengths), np.array(n), budget)
    assert all(0 <= a <= b for a, b in zip(k, n))
    sums = {sum(a * b for a, b in zip(lengths, pick)) for pick in itertools.product(*[range(c + 1) for c in n])}
    got = sum(a * b for a, b in zip(lengths, k.tolist()))
    total = sum(a * b for a, b in zip(lengths, n))
    # the proportional part is fixed first, so the knapsack is over the rest
    assert got in sums and abs(min(budget, total) - got) <= max(lengths)


def test_fit_budget_hits_large_budgets():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 3000, 400))
    counts = rng.integers(1, 5000, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    k = mixing.fit_budget(lengths, counts, budget)
    assert (k * lengths).sum() == budget and (k >= 0).all() and (k <= counts).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(65_537, 3_000_000), st.integers(1, 2), min_size=1, max_size=3),
       st.lists(st.integers(1, 60_000), max_size=2, unique=True), st.floats(0, 1))
def test_fit_budget_of_very_long_documents(long, short, share):
    counts = long | {l: 1 for l in short}
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    total = int((lengths * n).sum())
    budget = int(total * share)
    k = mixing.fit_budget(lengths, n, budget)
    assert ((0 <= k) & (k <= n)).all()
    gaps = [abs(budget - sum(a * b for a, b in zip(counts, pick))) for pick in itertools.product(*[range(c + 1) for c in n])]
    # within a window of the best: the proportional part is kept where it comes that near
    assert abs(budget - int((k * lengths).sum())) <= min(gaps) + (1 << 16)


def test_fit_budget_takes_the_long_document_that_just_misses():
    fit = lambda counts, budget: mixing.fit_budget(np.array(list(counts)), np.array(list(counts.values())), budget).tolist()     # noqa: E731
    assert fit({100_000: 1, 10_000_000: 1}, 9_000_000) == [0, 1]
    assert fit({1_000_000: 1}, 900_000) == [1] and fit({1_000_000: 1}, 400_000) == [0]
    assert fit({50: 1, 100_000: 1}, 60_000) == [0, 1]
    assert fit({70_000: 1, 300_000: 1, 500_000: 1}, 790_000) == [0, 1, 1]


def test_targets_reshare_the_excess():
    t = mixing.targets([10, 100, 1000], [5, 2, 1], 3)
    assert t[0] == 30 and t[1] == 300 and abs(sum(t) - 1110) < 1e-9
    assert mixing.targets([], [], 3) == [] and mixing.targets([0, 0], [5, 2], 3) == [0.0, 0.0]


def test_mix_of_a_hot_length(spark):
    rows = [(i, "w " * (3 if i % 3 else 1 + i % 17), "en", None if i % 10 == 0 else f"s{i % 3}") for i in range(9000)]
    rows += [(9000, None, "en", "s0"), (9001, "", "en", "s1"), (None, "a b", "en", "s2"), (5, rows[5][1], "en", rows[5][3])]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)                  # noqa: E731
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["size"] == len((dict(zip([x[0] for x in rows], [x[1] for x in rows]))[r["doc_id"]] or "").split())
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s))
    want = mixing.targets([by[s][0]["source_size"] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        assert abs(by[s][0]["target"] - t) < 1e-6 and abs(sum(r["taken"] for r in by[s]) - t) <= 2
        assert sum(r["size"] for r in by[s]) == by[s][0]["source_size"]
    mixed = mixing.repeat_rows(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["repeats"] for r in got)


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
