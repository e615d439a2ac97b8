"""SimHash, vector dedup, nearest neighbours, components and fixity against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest_llm import documents
from keepsake.llm import ann, fixity, simhash, vecdedup
from keepsake.llm.components import components, forest


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_forest(edges):
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    nodes, low = forest(u, v)
    want = roots({x for e in edges for x in e}, edges)
    assert dict(zip(nodes.tolist(), low.tolist())) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(1800)] + [(i, i + 1) for i in range(5000, 5400)]
    edges += [(9000, x) for x in range(9001, 9800)] + [(1, 1), (7, None)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(16)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)
    assert components(df.where("false")).count() == 0


def brute_fingerprint(text, k=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    rng = random.Random(2)
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    texts = [None, "", " \t", "a", "A", "a b c d", "x\x0cy\x1cz q\x85r s t"]
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(20, 200))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts)] + [(ids[3], texts[3], "en", "s"), (None, texts[20], "en", "s")]
    docs = documents(spark, rows)
    groups = simhash.simhash_groups(docs)
    got = groups.collect()
    fp = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    want = roots(ids, links)
    assert len(got) == len(rows) and len(links) > 30
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["fingerprint"] == f"{brute_fingerprint(texts[20]):016x}"
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])
    kept = simhash.keep_one(docs, groups)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i in ids if want[i] == i)
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def test_long_text_fingerprint():
    text = " ".join(f"v{i % 977}" for i in range(90_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("blocks, chunk", [(7, 20_000), (6, 10), (5, 3)])
def test_hot_blocks_lose_no_link(spark, blocks, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 1 << 22)          # small keys count as hot
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components(simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, blocks, chunk)).collect()
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert {r["node"]: r["component"] for r in got} == {k: v for k, v in roots(signed, links).items() if any(k in e for e in links)}


def vectors_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")


def some_vectors(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0 or not rows:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[rng.integers(0, len(rows))][1]) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.15])
        rows.append((int(i * 7 % n), [float(x) for x in v.astype(np.float32)], int(i % 3)))
    return rows


ODD = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [float("inf")] + [1.0] * 23, 1),
       (1004, [1.0] * 24, None), (1005, [1.0] * 5, 1), (1006, [None] + [1.0] * 23, 1), (1007, [], 1), (None, [1.0] * 24, 1)]


def test_vector_dedup(spark):
    rows = some_vectors(1)
    got = {r["vec_id"]: r for r in vecdedup.near_vectors(vectors_table(spark, rows + ODD)).collect()}
    x, label = {r[0]: np.array(r[1], np.float64) for r in rows}, {r[0]: r[2] for r in rows}
    links = [(a, b) for a, b in itertools.combinations(x, 2) if label[a] == label[b]
             and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98]
    want, degree = roots(list(x), links), {i: 0 for i in x}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 100
    for i in x:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[i], want[i], want[i] == i)
    for i, _, _ in ODD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(rows) + len(ODD)
    assert vecdedup.near_vectors(vectors_table(spark, [])).count() == 0
    assert {r["n_links"] for r in vecdedup.near_vectors(vectors_table(spark, [(1, [1.0, 2.0], 1)] * 3)).collect()} == {2}


def near_pairs(rows):
    x = {r[0]: np.array(r[1], np.float64) / np.linalg.norm(r[1]) for r in rows}
    return [(a, b) for a, b in itertools.combinations(sorted(x), 2) if x[a] @ x[b] >= 0.98]


def test_vectors_of_small_labels_link_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in (base[i % 8] + rng.normal(size=16) * 0.02).astype(np.float32)], 1) for i in range(16)]
    links = near_pairs(rows)
    assert len(links) >= 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(vectors_table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: sum(i in pair for pair in links) for i in range(16)}


def test_a_dense_run_goes_on_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "CELL", 16)
    rng = np.random.default_rng(6)
    mid = rng.normal(size=16)
    rows = [(i, [float(x) for x in (mid + rng.normal(size=16) * 0.005).astype(np.float32)], 1) for i in range(150)]
    got = vecdedup.near_vectors(vectors_table(spark, rows), passes=1, window=4).collect()
    assert len(near_pairs(rows)) == 150 * 149 // 2 and {r["n_links"] for r in got} == {149}
    many = vecdedup.near_vectors(vectors_table(spark, rows), passes=6, window=4).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in many) == sorted((r["vec_id"], r["n_links"]) for r in got)
    # of the pairs found again, those that an earlier pass compares in any case go
    at = np.array([[0, 40], [15, 3], [16, 2], [18, 60]])
    i, j = vecdedup._not_before(at, np.array([0, 1, 1, 0, 2]), np.array([1, 2, 3, 3, 3]), 1, 2, 16)
    assert list(zip(i.tolist(), j.tolist())) == [(1, 3), (0, 3)]


def test_passes_grow_with_the_largest_label():
    assert vecdedup.passes_for(0, 0.98, 12, 64) == vecdedup.passes_for(1000, 0.98, 12, 64) == 12
    assert vecdedup.passes_for(10**6, 0.98, 12, 64) < vecdedup.passes_for(10**8, 0.98, 12, 64) < 40
    assert vecdedup.passes_for(10**6, 1.0, 12, 64) == 12


def test_a_dense_run_is_compared_to_its_end():
    rng = np.random.default_rng(2)
    u = rng.normal(size=16) + rng.normal(size=(1500, 16)) * 0.01
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = vecdedup.links_in_order(u, 0.98, 8)
    assert len(set(zip(i.tolist(), j.tolist()))) == 1500 * 1499 // 2


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_step_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)], 0) for i in range(3000)] + some_vectors(4)[:0]
    rows += [(3000 + i, rows[40][1], 0) for i in range(500)]                     # copies: one hot key, ties
    odd = [r for r in ODD if r[2] is not None and r[0] not in (1005,)]
    table = vectors_table(spark, rows + [(i + 9000 if i is not None else None, e, k) for i, e, k in odd] + [(9105, [1.0] * 5, 1)])
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, chunk=200, query_chunk=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows], np.float64)
    ids = np.array([r[0] for r in rows])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        order = np.lexsort((ids, -score))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([f[2] for f in found], x[[f[1] for f in found]] @ x[q])
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:]))
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.93
    few = ann.nearest(vectors_table(spark, rows[:5]), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert ann.nearest(vectors_table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_fixity_locates_damage(spark):
    rows = [(i, f"http://h/{i % 50}", "<p>" + "é" * (i % 40), "x") for i in range(700)] + [(5, None, None, "x"), (None, "u", "", "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length string")
    records = fixity.warc_records(pages, per_file=100)
    index = fixity.record_index(records)
    plain = fixity.fixity_report(index, records, per_file=100).collect()
    assert len(plain) == len(rows) and {r["status"] for r in plain} == {"ok"} and all(r["root"] == r["replica_root"] for r in plain)
    for f in {r["file"] for r in plain}:
        own = sorted((r["pos"], r["offset"], r["length"]) for r in plain if r["file"] == f)
        assert [o[1] for o in own] == [sum(x[2] for x in own[:k]) for k in range(len(own))]
    hurt = records.where("page_id is null or page_id <> 31").withColumn("bytes", F.when(F.col("page_id") == 77, F.lit(b"zz")).otherwise(F.col("bytes")))
    extra = spark.createDataFrame([(99, 0, b"more")], "file long, pos long, bytes binary")
    report = fixity.fixity_report(index, hurt.select("file", "pos", "bytes").unionByName(extra), per_file=100).collect()
    assert sorted((r["page_id"], r["status"]) for r in report if r["status"] != "ok" and r["page_id"] is not None) == [(31, "missing"), (77, "corrupt")]
    assert [r["file"] for r in report if r["status"] == "extra"] == [99]
    bad = {r["file"] for r in report if r["status"] != "ok"}
    assert {r["file"] for r in report if r["root"] != r["replica_root"]} == bad
    empty = fixity.warc_records(pages.where("false"))
    assert fixity.fixity_report(fixity.record_index(empty), empty).count() == 0
