"""The pipeline, stage by stage, against brute force over each stage's own input."""

import hashlib
import itertools
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from keepsake.llm import langid, simhash, toxicity
from keepsake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "stone and river", "en", None, 1), (900_001, None, None, "s", 0), (900_002, "", "en", "s", 0),
                                 (900_003, "12 34 ?!", "en", None, 8), (900_004, "you idiot", "en", "s", 9)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = written(docs.unionByName(odd).withColumn("row", F.lit("clash")), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out

    def ids(df):
        return Counter(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = seen["toxicity"]
    model = toxicity.train(before, table(spark, SF, "labels"))
    assert ids(after) == Counter(r["doc_id"] for r in before.collect() if model.score(r["text"])[0] < 0.5)
    before, after = seen["language_id"]
    rows = before.collect()
    accepted = langid.train(before).predict([r["text"] for r in rows])[2]
    assert ids(after) == Counter(r["doc_id"] for r, ok in zip(rows, accepted) if ok)
    assert not {900_001, 900_002, 900_003} & set(ids(after)) and len(ids(after)) > 0.9 * len(rows)
    before, after = seen["simhash"]
    rows = before.collect()
    comp = brute_components({r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows if r["doc_id"] is not None})
    assert ids(after) == Counter([i for i in comp if comp[i] == i] + [None for r in rows if r["doc_id"] is None])
    before, after = seen["mixing"]
    size = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
    taken = ids(after)
    assert max(taken.values()) <= 3 and set(taken) <= set(size)
    total = sum(size[i] * n for i, n in taken.items())
    assert abs(total - sum(size.values())) <= 0.02 * sum(size.values())
    before, after = seen["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        b = np.array(lib.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        want[(r["doc_id"], len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] += 1
    assert Counter(map(tuple, after.collect())) == want


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_stages_on_odd_tables(spark):
    """Empty tables, null ids and texts, long and repeated texts pass every stage."""
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    words = "the water of a house and the street came from this morning".split()
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, " ".join(words * 20_000), "en", None), (3, "the house", "en", "a"),
            (3, "the house", "en", "a"), (None, "the house and the water", "en", "b"), (4, "!!", None, "b"),
            *[(100 + i, " ".join(words[i % 7:] + words) + f" n{i}", "en", "ab"[i % 2]) for i in range(40)]]
    odd = spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows],
                                "doc_id long, text string, lang string, source string, n_chars long, size int")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns, name
            if name in ("toxicity", "bpe"):
                assert len(got) == docs.count(), name
            if name == "language_id":
                assert all(r["text"] and r["text"] != "!!" for r in got)
                assert len(got) in (0, len([r for r in rows if r[1] and r[1] != "!!"]))
            if name == "simhash" and got:
                assert sum(r["doc_id"] == 3 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 2
