"""Tokenizers, license scan, language ID and toxicity against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest_llm import documents
from keepsake.llm import bpe, langid, licenses, rans, tokenbin, toxicity
from keepsake.llm.license_rules import CONFIDENCE, GRANT, TRIGGERS, rules

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGE = [None, "", " ", "a", "  a  b ", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>z", "a" * 700, "ab" * 2000,
        "é" * 90, "\x00\x1c\x85  z", "日本語テキスト です", "🙂👍🏽 x", "՘a﷐b", "it's 'S 'll 12 345 don't!! ...",
        "İstanbul: ΣΑΣ ǅ H̱ Å", "\n\n a\t\tb\r\n", "word, word. Word; wörd? naïve!", "<|endoftext|", "a , b"]


def noise(n, seed):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(0, 127), *range(0xA0, 0x250), *range(0x300, 0x345), 0x130, 0x3A3, 0x1E9B, 0x1100, 0x1161,
                             0xAC00, 0x2028, 0x3000, 0x1F600]] + [" "] * 60 + list("etaoins") * 10
    return ["".join(rng.choices(pool, k=rng.randint(0, 200))) for _ in range(n)]


def test_rank_arrays_equal_the_library():
    enc, lib = bpe.RankArrayBPE(BYTE), Tokenizer.from_file(BYTE)
    texts = EDGE + noise(600, 1)
    for t, got in zip(texts, enc.encode_batch(texts)):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(t)
        assert enc.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_equal_short_ones():
    enc = bpe.RankArrayBPE(BYTE)
    rng = random.Random(3)
    for _ in range(200):
        w = "".join(rng.choices("abcdeths", k=rng.randint(2, 60)))
        enc.learn([w])
        assert enc.cache[w] == enc.merge_long(w.encode()).tobytes()


def test_bpe_digests_and_columns(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(EDGE)] + [(3, "a", "en", "s"), (None, "x", None, None)]
    docs, lib = documents(spark, rows), Tokenizer.from_file(BYTE)
    got = sorted(bpe.digests(docs, BYTE).collect(), key=str)
    want = []
    for i, t, _, _ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert set(docs.columns) < set(back.columns)
    assert back.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert bpe.digests(documents(spark, []), BYTE).count() == 0


def test_chunk_encoder_equals_the_library():
    enc, lib = tokenbin.ChunkEncoder(WORD), Tokenizer.from_file(WORD)
    texts = [t or "" for t in EDGE] + noise(1500, 2)
    for t, got in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(got, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_rans_round_trip_and_checksum():
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 5001)
    ids = rng.choice(5000, 200_000, p=p / p.sum()).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids))
    blocks = [ids[:100_000], ids[100_000:100_001], ids[:0], ids[150_000:], ids[:128], ids[:129]]
    payloads = rans.encode_blocks(table, blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(rans.decode_blocks(table, payloads), blocks))
    bits = sum(map(len, payloads)) * 8 / sum(map(len, blocks))
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum()
    assert bits < entropy * 1.1
    broken = bytearray(payloads[0])
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks(table, [bytes(broken)])


def test_token_files(spark):
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(EDGE + noise(300, 5))] + [(None, "null id", "en", "s"), (2**60, "far", "en", "s")]
    docs, lib = documents(spark, rows).repartition(7), Tokenizer.from_file(WORD)
    folder = tokenbin.write_corpus(docs, WORD, block_ids=500)
    got = sorted(tokenbin.corpus_index(spark, folder).collect(), key=lambda r: r["start"])
    start = 0
    for (i, t, _, _), r in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), got, strict=True):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        start += len(ids)
    empty = tokenbin.write_corpus(documents(spark, []), WORD)
    assert tokenbin.corpus_index(spark, empty).count() == 0


def brute_scan(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]
    line, hits = (" " + " ".join(w) + " " if w else ""), []
    if any(x in line for x in TRIGGERS):
        for n, r in enumerate(rules()):
            hits += [(m.start(), m.end(), r.priority, n, r.label) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line)]
    better = lambda g, h: g[2] < h[2] or g[2] == h[2] and ((g[0], g[1]) != (h[0], h[1]) or g[3] < h[3])          # noqa: E731
    kept = [h for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and g != h and better(g, h) for g in hits)]
    at = [i for i, _ in base]
    score = max([0.5 if base else 0.0] + [CONFIDENCE[h[2]] for h in kept])
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in base} | {h[4] for h in kept})), score)


def test_license_scan(spark):
    texts = [None, "", "   ", "MIT License", "mit license mit license general public license", "mit license " * 300,
             "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-or-later",
             "licensed under CC BY-NC 4.0.", "under the GNU General Public License, version 3.", "Éa license MIT-License",
             "permission is hereby granted, free of charge, to any person obtaining a copy http://www.apache.org/licenses/LICENSE-2.0",
             "GNU Lesser General Public License v2.1 or later; gplv3 or later bsd 3-clause license", "license", "general public"]
    rng = random.Random(4)
    words = "mit apache license licensed under the gnu general public version 2 3 0 bsd clause gpl spdx identifier or later cc by nc 4".split()
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = licenses.scan(documents(spark, rows)).drop("detections").collect()
    for r in got:
        assert tuple(r)[1:] == brute_scan(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_scan_goes_on_behind_line_separators(spark):
    texts = [x for c in "\x85\u2028\u2029" for x in (f"a{c} mit license b", f"mit license a{c} mit license b", f"a {c} b{c}c gplv3 or later",
                                                    f"{c}mit license {c} spdx license identifier mit {c}")]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:-1] == brute_scan(t), repr(t)
        assert got[i]["detections"]
    assert len(got[1]["detections"]) == 2


def test_every_rule_is_tried_on_every_text(spark):
    texts = ["released under CC BY-SA 4.0", "distributed under WTFPL", "CC0 1.0 Universal", "http://wtfpl.net", "mozilla.org/MPL/2.0",
             "eclipse.org/legal/epl-v10", "scripts.sil.org/OFL", "w3.org/Consortium/Legal", "Simplified BSD", "the 2-clause BSD",
             "This product includes software developed by the Apache Software Foundation", "same terms as Perl itself",
             "All advertising materials mentioning features or use of this software must display",
             "The Software shall be used for Good, not Evil", "plain words of no rule", "open later apache epl", None]
    names = licenses.rules()
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        line = " " + " ".join(re.findall("[a-z0-9]+", (t or "").lower())) + " "
        hits = [(m.start(), m.end(), r.priority, n, r.label) for n, r in enumerate(names)
                for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line)]
        kept = [h for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and g != h and (g[2] < h[2] or g[2] == h[2] and (
            (g[0], g[1]) != (h[0], h[1]) or g[3] < h[3])) for g in hits)]
        assert bool(kept) == (i < 14), t
        assert sorted(map(tuple, got[i]["detections"])) == sorted((h[4], h[0], h[1], h[2]) for h in kept), t


def test_rules_hold_their_keyword():
    all_ = rules()
    assert len(all_) > 300 and len(set(all_)) == len(all_)
    for r in all_:
        assert r.keyword and r.keyword in r.pattern.replace(GRANT, "")
        re.compile(r.pattern)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_id(spark):
    rng = random.Random(6)
    words = {"aa": "kalo meti suna rovi pela".split(), "bb": "grüx ßchen öftig tränk würd".split(), "cc": "zhyq xwv qqrt vxk zzt".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang, "s")
            for i in range(600) for lang in [sorted(words)[i % 3]]]
    rows += [(600, None, "aa", "s"), (601, "", "aa", "s"), (602, "123 ?! 77", "bb", "s"), (603, "kalo meti suna", None, None), (None, "rovi pela kalo", "aa", "s")]
    docs = documents(spark, rows)
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [i for i, t, lang, _ in rows[:600] if fold(i, 4) == 2]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == got[i]["lang"] for i in held) >= 0.98 * len(held)
    for i in (600, 601, 602):
        assert (got[i]["lang_pred"], got[i]["lang_score"], got[i]["lang_accepted"]) == ("und", 0.0, False)
    assert got[603]["lang_pred"] == "aa" and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    none = langid.train(documents(spark, [(1, "x", None, None)]))
    assert langid.identify(docs, none).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(documents(spark, []), model).count() == 0


def test_a_long_text_is_scored_whole():
    model = langid.fit(["a", "b"], np.array([0, 1] * 40), [langid.grams_of(t).astype(int) for t in ["kalo meti suna", "grüx öftig tränk"] * 40])
    long = "kalo meti suna " * 2000 + "grüx öftig tränk " * 200_000
    assert model.predict([long, "kalo", None])[0] == ["b", "a", "und"]


def brute_marginals(model, marked, n):
    weight = {m[0]: m[3] for m in marked}
    e = [np.array([1.0, np.exp(model.bias + weight.get(t, 0.0))]) for t in range(n)]
    fwd, at = [], np.array([1.0, 0.0])
    for t in range(n):
        at = at @ model.step * e[t]
        at /= at.sum()
        fwd.append(at)
    back, out = np.ones(2), np.zeros(n)
    for t in range(n - 1, -1, -1):
        p = fwd[t] * back
        out[t] = p[1] / p.sum()
        back = model.step @ (e[t] * back)
        back /= back.sum()
    return out[[m[0] for m in marked]]


def test_marginals_of_skipped_runs_equal_the_full_chain():
    model = toxicity.ToxicModel({"=bad": 3.0, "awful": 2.0}, -2.0, np.array([[1.0, -1.0], [-0.4, 0.3]]), trained=True)
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join(rng.choices(["fine", "bad", "awfully", "so", "x"], k=rng.randint(1, 300)))
        found, n = model.marked(text)
        assert np.allclose(model.marginals(found, n), brute_marginals(model, found, n), atol=1e-9)
        assert all(text[a:b] in ("bad", "awfully") for _, a, b, _ in found)


def test_toxicity(spark):
    rng = random.Random(8)
    clean, bad = "the of and stone river cloud green walk over under".split(), ["Idiotic", "scummy", "Trashlike"]
    rows, labels = [], []
    for i in range(800):
        words = rng.choices(clean, k=rng.randint(5, 80))
        if i % 5 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(800, None, None, None), (801, "", "en", "s"), (None, "the stone", "en", "s"), (802, "clean " * 50_000 + "idiotic scummy", "en", "s")]
    labels += [(None, 1, 1), (9999, 0, 1), (5, 1, None)]
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(800) if fold(i, 5) == 0]
    assert all((got[i]["toxic_score"] >= 0.5) == (i % 5 == 0) for i in held) and len(held) > 100
    text = rows[0][1]
    assert {text[s["start"]:s["end"]] for s in got[0]["toxic_spans"]} <= set(bad) and got[0]["toxic_spans"]
    assert got[800]["toxic_score"] == got[801]["toxic_score"] < 0.5 and got[None]["toxic_score"] < 0.5
    assert got[802]["toxic_score"] > got[801]["toxic_score"] and len(got[802]["toxic_spans"]) == 2
    assert "size" in toxicity.score(docs, model).columns
    untrained = toxicity.train(docs, marks.where("toxic = 0"))
    assert toxicity.score(docs, untrained).where("toxic_score <> 0").count() == 0
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_rare_offences_of_a_large_sample_are_marks(spark):
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    names = sorted({"".join(rng.choices(syllables, k=4)) for _ in range(900)})
    bad, clean = names[::5][:150], [w for i, w in enumerate(names) if i % 5]
    rows, labels = [], []
    for i in range(4000):
        words = rng.choices(clean, k=rng.randint(5, 30))
        if i % 2 == 0:                                  # each word in under 1 % of the toxic documents
            words.insert(rng.randrange(len(words)), bad[i // 2 % len(bad)])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 2 == 0)))
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [i for i in range(4000) if fold(i, 5) == 0]
    right = [(model.score(rows[i][1])[0] >= 0.5) == (i % 2 == 0) for i in held]
    assert sum("=" + w in model.marks for w in bad) >= 0.95 * len(bad)
    assert sum(right) >= 0.95 * len(held), sum(right) / len(held)


def test_language_rejection(spark):
    """Letter noise and a language left out of training are rejected, clean texts stay."""
    rng = random.Random(8)
    words = {"de": "der die das und nicht haus wald strasse kommen gehen schnell über können morgen abend wasser".split(),
             "en": "the and of house forest street come going quickly about could morning evening water with from".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))      # noqa: E731
    docs = documents(spark, [(i, text(lang), lang, None) for i, lang in enumerate(["de", "en"] * 200)])
    model = langid.train(docs)
    clean = [text(lang) for lang in ["de", "en"] * 40]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) * 1 + " " +
             " ".join("".join(rng.choice("qxzjkvwpfbgy") for _ in range(7)) for _ in range(30)) for _ in range(40)]
    russian = [" ".join(rng.choice("дом лес улица вода утро вечер быстро идти".split()) for _ in range(40)) for _ in range(40)]
    assert sum(model.predict(clean)[2]) >= 78
    assert sum(model.predict(noise)[2]) == 0 and sum(model.predict(russian)[2]) == 0


def test_language_score_equals_brute_force(spark):
    """The score is the softmax of the mean logits of all n-grams, one text at a time."""
    docs = documents(spark, [(i, t, lang, None) for i, (t, lang) in enumerate(
        [("the quick water of the house", "en"), ("der schnelle wald und das haus", "de")] * 30)])
    model = langid.train(docs)
    texts = ["the wald", "Haus!", "über 7 water " * 400, "z", "the quick water of the house"]
    pred, score, accepted = model.predict(texts + texts[:2])
    assert pred[:2] == pred[5:] and (score[:2] == score[5:]).all()
    for t, lang, p in zip(texts, pred, score):
        g = langid.grams_of(t).astype(int)
        z = (model.table[g].sum(axis=0) / max(1, len(g)) + model.bias) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p - want.max()) < 1e-9 and lang == model.langs[int(want.argmax())]


def test_toxicity_learns_long_tokens_and_cuts_before_folding():
    long = "grawl" + "x" * 60
    assert toxicity.tokens_of("İstanbul ΑΣ " + long.upper()) == ["i̇stanbul", "ας", long]
    model = toxicity.ToxicModel({"=" + long: 3.0}, -1.0, np.array([[2.0, -6.0], [-6.0, 2.0]]), trained=True)
    found, n = model.marked("a " * 9000 + long)
    assert n == 9001 and [m[0] for m in found] == [9000]
    # a sticky chain: powers beyond 4,096 are exact
    assert np.allclose(model.power(9000), np.linalg.matrix_power(model.quiet, 4500) @ np.linalg.matrix_power(model.quiet, 4500))
