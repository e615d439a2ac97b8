"""Custom algorithms vs sequential / brute-force oracles on random inputs."""

import random
from pathlib import PurePosixPath


from pyspark.sql import functions as F

from keepsake.functions import names as N
from keepsake.functions import scalars as S
from keepsake.operators import ids, pairing, recovery, similarity
from keepsake.plans import actions


# ---------------------------------------------------------------- numbering

def test_dense_index_and_group_rank(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {r["id"]: r["rn"] for r in ids.dense_index(df, ["v", "id"], "rn").collect()}
    exp = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == exp
    for hot in (10 ** 9, 10):          # plain window path, and the hot-key spread path
        gr = {r["id"]: r["rk"] for r in ids.group_rank(df, ["k"], ["v", "id"], "rk", hot_rows=hot).collect()}
        exp = {}
        for k in "abc":
            grp = sorted([r for r in rows if r[1] == k], key=lambda r: (r[2], r[0]))
            exp.update({r[0]: i + 1 for i, r in enumerate(grp)})
        assert gr == exp


# ---------------------------------------------------------------- pairing

def assert_first_free(order, wanted, got):
    """Each sidecar of ``order`` holds the first wanted media that no earlier
    one holds, and none if there is no such media."""
    for i, sidecar in enumerate(order):
        before = {got[j] for j in order[:i] if j in got}
        free = [m for m in wanted[sidecar] if m not in before]
        assert got.get(sidecar) == (free[0] if free else None), sidecar


def test_pairing_takes_the_first_free_media(spark):
    rnd = random.Random(11)
    files = []
    for i in range(600):
        arch = f"Z00{rnd.randint(1, 3)}"
        year = f"Photos from {rnd.choice([2011, 2012])}"
        base = f"IMG_{rnd.randint(0, 30):03d}"
        if rnd.random() < 0.5:
            name = base + rnd.choice([".jpg", ".JPG", "(1).jpg", ".png"])
        else:
            name = base + rnd.choice([".jpg", ".png"]) + rnd.choice([".supplemental-metadata", ".s(1)", ""]) + ".json"
        files.append({"file_id": i, "archive": arch, "year": year, "name": name,
                      "path": f"/r/{arch}/Takeout/Google Photos/{year}/{name}"})
    files = list({f["path"]: f for f in files}.values())
    df = spark.createDataFrame([(f["file_id"], f["path"]) for f in files], "file_id long, path string")
    got = {r["json_path"]: r["media_path"] for r in
           pairing.pair_sidecars(df, ("archive", "name", "file_id")).collect()}
    files.sort(key=lambda f: (f["archive"], f["name"], f["file_id"]))
    sidecars = [f for f in files if f["name"].lower().endswith(".json")]
    names = spark.createDataFrame([(f["path"], f["name"]) for f in sidecars], "path string, n string")
    expected = {r["path"]: r["e"] for r in names.select("path", N.sidecar_expected_media(F.col("n")).alias("e")).collect()}
    wanted = {s["path"]: [m["path"] for m in files if m["year"] == s["year"] and not m["name"].lower().endswith(".json")
                          and m["name"].lower() == (expected[s["path"]] or "").lower()] for s in sidecars}
    for year in {f["year"] for f in files}:
        assert_first_free([s["path"] for s in sidecars if s["year"] == year], wanted, got)
    assert len(got) > 50


# ---------------------------------------------------------------- recovery

def test_recovery_gives_each_sidecar_its_first_free_media(spark):
    for seed in range(1):
        rnd = random.Random(seed)
        jsons = [f"IMG_{rnd.randint(0, 40)}{rnd.choice(['', '1', '(1)'])}.jpg.json" for _ in range(60)]
        media = [f"IMG_{rnd.randint(0, 40)}{rnd.choice(['', '1', '_1', '(1)'])}.{rnd.choice(['jpg', 'png'])}"
                 for _ in range(80)]
        jsons = sorted({f"/q/J/Z001/{n}" for n in jsons})
        media = sorted({f"/q/M/Z001/{n}" for n in media})
        df = spark.createDataFrame([(p,) for p in jsons + media], "path string")
        got = {r["json_path"]: r["media_path"] for r in recovery.recover_pairs(df, "/q/J", "/q/M").collect()}
        name = F.element_at(F.split("path", "/"), -1)
        key = {r["path"]: (r["j"], r["m"]) for r in df.select(
            "path", N.fuzzy_key_sidecar(name).alias("j"), N.fuzzy_key_media(name).alias("m")).collect()}
        wanted = {j: [m for m in media if key[j][0] and key[m][1] and (key[j][0] in key[m][1] or key[m][1] in key[j][0])]
                  for j in jsons}
        assert_first_free(jsons, wanted, got)


# ---------------------------------------------------------------- hamming

def test_hamming_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    cands = [rnd.getrandbits(64) - (1 << 63) for _ in range(300)]
    queries = []
    for i in range(60):
        base = rnd.choice(cands)
        flips = rnd.sample(range(64), rnd.randint(0, 14))
        h = base & ((1 << 64) - 1)
        for b in flips:
            h ^= 1 << b
        queries.append(h - (1 << 64) if h >= (1 << 63) else h)
    q = spark.createDataFrame([(f"q{i}", h) for i, h in enumerate(queries)], "q_id string, q_hash long")
    c = spark.createDataFrame([(f"c{i}", h) for i, h in enumerate(cands)], "c_id string, c_hash long")
    for t, bands in [(10, 4), (10, 8), (6, 2), (12, 4)]:
        got = {(r["q_id"], r["c_id"], r["distance"]) for r in similarity.hamming_pairs(q, c, t, bands).collect()}
        exp = set()
        for i, a in enumerate(queries):
            for j, b in enumerate(cands):
                d = bin((a ^ b) & ((1 << 64) - 1)).count("1")
                if d <= t:
                    exp.add((f"q{i}", f"c{j}", d))
        assert got == exp, (t, bands)
        assert exp


def test_probes_are_never_broadcast(spark):
    """A query hash becomes hundreds of probes; its table looks small before that."""
    q = spark.range(50).selectExpr("id AS q_id", "id * 7919 AS q_hash", "'y' AS year")
    c = spark.range(50).selectExpr("id AS c_id", "id * 7907 AS c_hash", "'y' AS year")
    for keys in ((), ("year",)):
        plan = similarity.hamming_pairs(q, c, 10, keys=keys)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [band" in plan
        assert all("LeftOuter" in line for line in plan.splitlines() if "BroadcastHashJoin [" in line)   # the hot values


def brute_best(files, k, limit):
    """Per quarantined file the k nearest others of its year (of all years without one)."""
    year = lambda p: next((x for x in reversed(p.split("/")[:-1]) if x.startswith("Photos from ")), "")      # noqa: E731
    out = {}
    for _, q, hq in files:
        if q.startswith("/r/Q/"):
            near = sorted((bin(int(hq, 16) ^ int(h, 16)).count("1"), n, p) for n, p, h in files
                          if not p.startswith("/r/Q/") and year(q) in ("", year(p)))
            out.update({(q, r): (p, d) for r, (d, n, p) in enumerate(near[:k], 1) if d <= limit})
    return out


def test_best_matches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16), monkeypatch.setattr(similarity, "BAND_CHUNK", 9)
    rnd = random.Random(2)
    hot = [rnd.getrandbits(64) for _ in range(3)]
    files = []
    for i in range(260):
        h = rnd.choice(hot) if i % 3 == 0 else rnd.getrandbits(64) if i % 3 == 1 else hot[0] ^ (rnd.getrandbits(16) << 16)
        folder = rnd.choice(["Photos from 2010", "Photos from 2011", "Photos from 2012", "x"])
        files.append((i, f"/r/{'Q/' if i % 4 == 0 else ''}Z001/{folder}/f{rnd.randint(0, 10**9)}.jpg", f"{h:016x}"))
    m = spark.createDataFrame(files, "row_id long, media_path string, phash64 string")
    for k, limit in ((1, 10), (3, 10), (5, None)):
        got = {(r["unmatched"], r["rank"]): (r["match"], r["distance"])
               for r in similarity.best_matches(m, "/r/Q", k, threshold=limit).collect()}
        assert got == brute_best(files, k, 64 if limit is None else limit), (k, limit)


def test_equal_hashes_stay_linear(spark):
    """Files of one hash are one row of the search; each file gets k rows."""
    files = [(i, f"/r/{'Q/' if i % 2 else ''}Z001/Photos from 2010/f{i:05d}.jpg", "00ff00ff00ff00ff") for i in range(4000)]
    m = spark.createDataFrame(files, "row_id long, media_path string, phash64 string")
    got = similarity.best_matches(m, "/r/Q", 2).collect()
    assert len(got) == 4000 and {(r["rank"], r["match"]) for r in got} == {(1, files[0][1]), (2, files[2][1])}


def test_recovery_of_homonyms_and_contested_keys(spark, monkeypatch):
    rounds = []
    write = recovery.materialize
    monkeypatch.setattr(recovery, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    paths = [f"/q/J/Z{i:03d}/IMG_1.jpg.json" for i in range(500)] + [f"/q/M/Z{i:03d}/IMG_1.jpg" for i in range(400)]
    got = recovery.recover_pairs(spark.createDataFrame([(p,) for p in paths], "path string"), "/q/J", "/q/M").collect()
    assert {r["json_path"]: r["media_path"] for r in got} == {paths[i]: paths[500 + i].replace("IMG_1.jpg.json", "IMG_1.jpg") for i in range(400)}
    assert rounds.count("recovery-lost") == 1 and rounds.count("recovery-parts") <= 2
    for seed in range(1):
        rnd = random.Random(seed)
        j = sorted({f"/q/J/{rnd.randint(0, 30):02d}/{'1' * rnd.randint(1, 4)}{rnd.choice(['', 'a'])}.json" for _ in range(16)})
        m = sorted({f"/q/M/{rnd.randint(0, 30):02d}/{'1' * rnd.randint(1, 5)}{rnd.choice(['', 'a', 'b'])}.x" for _ in range(12)})
        got = {r["json_path"]: r["media_path"] for r in recovery.recover_pairs(
            spark.createDataFrame([(p,) for p in j + m], "path string"), "/q/J", "/q/M").collect()}
        key = lambda p: p.rsplit("/", 1)[1].split(".")[0]      # noqa: E731
        left, want = list(m), {}
        for p in j:
            first = next((x for x in left if key(p) in key(x) or key(x) in key(p)), None)
            if first:
                want[p] = first
                left.remove(first)
        assert got == want


# ---------------------------------------------------------------- free names

def test_free_names_underscore(spark):
    existing = spark.createDataFrame([("/d/a.jpg",), ("/d/a_1.jpg",), ("/d/a_3.jpg",), ("/d/b.jpg",)], "path string")
    targets = spark.createDataFrame(
        [("k1", "/d/a.jpg", 1), ("k2", "/d/a.jpg", 2), ("k3", "/d/a.jpg", 3), ("k4", "/d/c.jpg", 1),
         ("k5", "/d/c.jpg", 2)], "key string, target string, order long")
    got = {r["key"]: r["dst"] for r in actions.free_names(targets, existing, "underscore").collect()}
    assert got == {"k1": "/d/a_2.jpg", "k2": "/d/a_4.jpg", "k3": "/d/a_5.jpg", "k4": "/d/c.jpg", "k5": "/d/c_1.jpg"}


def test_free_names_restored(spark):
    existing = spark.createDataFrame([("/d/a.jpg",), ("/d/a_restored.jpg",)], "path string")
    targets = spark.createDataFrame([("k1", "/d/a.jpg", 1), ("k2", "/d/a.jpg", 2)],
                                    "key string, target string, order long")
    got = {r["key"]: r["dst"] for r in actions.free_names(targets, existing, "restored").collect()}
    assert got == {"k1": "/d/a_restored_1.jpg", "k2": "/d/a_restored_2.jpg"}


def test_backfill_with_sibling_extension(spark):
    from keepsake.operators import timestamps
    m = spark.createDataFrame([
        (1, "matched", "/r/Z001/IMG_9.jpg.supplemental-metadata.json", "", None, "", ""),
        (2, "matched", "/r/Z001/IMG_8.jpg.json", "/r/Z001/IMG_8.jpg", None, "", ""),
        (3, "matched", "/r/Z001/gone.json", "/r/Z001/gone.jpg", None, "", ""),
        (4, "unmatched_json", "/r/Z001/IMG_7.jpg.json", "", None, "", ""),
    ], "row_id long, row_type string, json_path string, media_path string, timestamp_unix long, "
       "formatted_time string, new_ext string")
    side = spark.createDataFrame([
        ("/r/Z001/IMG_9.jpg.supplemental-metadata.json", '{"photoTakenTime": {"timestamp": "86400"}}'),
        ("/r/Z001/IMG_9.jpg.supplemental-metadata.HEIC", None),
        ("/r/Z001/IMG_8.jpg.json", '{"photoTakenTime": {"timestamp": 0}}'),
        ("/r/Z001/IMG_7.jpg.json", '{"photoTakenTime": {"timestamp": "5"}}'),
    ], "path string, content string")
    new, report = timestamps.backfill_timestamps(m, side)
    got = {r["row_id"]: r for r in report.collect()}
    assert set(got) == {1}                      # 2: time 0; 3: sidecar missing; 4: not matched
    assert got[1]["timestamp_unix"] == 86400 and got[1]["formatted_time"] == "1970:01:02 00:00:00"
    assert got[1]["new_ext"] == ".heic"         # sibling named <sidecar stem>.*, .json excluded


def test_backfill_retries_zero_and_looks_where_told(spark):
    from keepsake.operators import timestamps
    m = spark.createDataFrame([
        (1, "matched", "/r/a.json", "", 0, "", ""), (2, "matched", "/r/b.json", "/r/b.PNG", 0, "", ""),
        (3, "matched", "/r/c.json", "/r/c.jpg", 7, "", ""), (4, "unmatched_json", "/r/d.json", "", 0, "", ""),
        (5, "matched", "/r/e.json", "", 0, "", ".kept"), (6, "matched", None, "", None, "", "")],
        "row_id long, row_type string, json_path string, media_path string, timestamp_unix long, "
        "formatted_time string, new_ext string")
    side = spark.createDataFrame([(f"/r/{x}.json", '{"photoTakenTime": {"timestamp": "9"}}') for x in "abcde"],
                                 "path string, content string")
    files = spark.createDataFrame([("/r/a.z.MOV",), ("/r/a.HEIC",), ("/q/a.AAA",), ("/r/ab.jpg",), ("/r/a.JSON",)], "path string")
    assert timestamps.backfill_timestamps(m, side, files)[1].count() == 0
    new, report = timestamps.backfill_timestamps(m, side, files, retry_zero=True)
    assert {r["row_id"]: (r["timestamp_unix"], r["new_ext"]) for r in report.collect()} == {
        1: (9, ".heic"), 2: (9, ".png"), 5: (9, ".kept")}
    assert {r["row_id"]: r["timestamp_unix"] for r in new.collect()} == {1: 9, 2: 9, 3: 7, 4: 0, 5: 9, 6: None}


def test_reset_drops_verdicts_of_rows_without_a_group(spark):
    from keepsake.operators import dedup
    cols = "row_id long, media_path string, " + ", ".join(f"{c} string" for c in dedup.VERDICT_COLUMNS)
    m = spark.createDataFrame([(1, "/a", "group_0000", "true", "x", "phash", "v"), (2, "/b", "", "", "", "", ""),
                               (3, "", "group_0000", "false", "", "best_candidate", "w")], cols)
    v = spark.createDataFrame([("/b", "group_0000", "false", "", "best_candidate", "z")],
                              cols.replace("row_id long, ", ""))
    got = lambda reset: {r["row_id"]: (r["dedup_group_id"], r["delete_flag"])          # noqa: E731
                         for r in dedup.apply_verdicts(m, v, reset).collect()}
    assert got(False) == {1: ("group_0000", "true"), 2: ("group_0000", "false"), 3: ("group_0000", "false")}
    assert got(True) == {1: ("", ""), 2: ("group_0000", "false"), 3: ("", "")}


def test_conversion_failures_are_not_the_notes(spark):
    from keepsake.operators import reports
    m = spark.createDataFrame([(1, "/a", "Recovered match"), (2, "/b", None), (3, "/c", "x"), (4, None, "y")],
                              "row_id long, media_path string, notes string")
    failed = spark.createDataFrame([("/a", "late"), ("/a", "early"), ("/b", None), (None, "z"), ("/nowhere", "n")],
                                   "path string, reason string")
    got = {tuple(r) for r in reports.conversion_failures(m, failed).collect()}
    assert got == {(1, "/a", "early", True), (2, "/b", None, False)}


def test_fingerprint_cache_cycle(spark):
    from keepsake.operators import dedup
    m = spark.createDataFrame([
        (1, "/r/a.jpg", "aa", "0000000000000001", 100), (2, "/r/b.jpg", "", "", None),
        (3, "/r/c.jpg", "cc", "0000000000000003", 300), (4, "/r/gone.jpg", "", "", None)],
        "row_id long, media_path string, content_sha1 string, phash64 string, hash_mtime long")
    files = spark.createDataFrame([("/r/a.jpg", 100), ("/r/b.jpg", 200), ("/r/c.jpg", 999)], "path string, mtime long")
    miss = {r["row_id"]: r["reason"] for r in dedup.fingerprint_cache_misses(m, files).collect()}
    assert miss == {2: "no_hash", 3: "mtime_changed"}       # 4: file missing -> nothing
    computed = spark.createDataFrame([("/r/b.jpg", "bb", 2), ("/r/c.jpg", "cc2", -1)],
                                     "path string, content_sha1 string, phash long")
    new = {r["row_id"]: r for r in dedup.refresh_fingerprints(m, computed, files).collect()}
    assert new[2]["content_sha1"] == "bb" and new[2]["phash64"] == "0000000000000002" and new[2]["hash_mtime"] == 200
    assert new[3]["phash64"] == "ffffffffffffffff" and new[3]["hash_mtime"] == 999
    assert new[1]["content_sha1"] == "aa" and new[1]["hash_mtime"] == 100
    assert dedup.fingerprint_cache_misses(dedup.refresh_fingerprints(m, computed, files), files).count() == 0


def test_intake_plan_with_tracker(spark):
    zips = spark.createDataFrame([("/z/takeout-1-001.zip",), ("/z/takeout-1-002.zip",), ("/z/Z001.zip",),
                                  ("/z/takeout-x.ZIP",)], "path string")
    done = spark.createDataFrame([("takeout-1-002",)], "stem string")
    got = sorted((r["name"], r["op"]) for r in actions.archive_intake_plan(zips, "/p", done).collect())
    assert got == [("takeout-1-001.zip", "extract"), ("takeout-1-001.zip", "keep_name"), ("takeout-x.ZIP", "skip")]


def test_required_columns_are_checked(spark):
    import pytest
    from keepsake.operators import reports, timestamps
    df = spark.createDataFrame([(1, "matched")], "row_id long, row_type string")
    with pytest.raises(ValueError, match="json_path"):
        timestamps.backfill_timestamps(df, spark.createDataFrame([], "path string, content string"))
    with pytest.raises(ValueError, match="new_ext"):
        reports.file_types(df)


def test_sampling_and_skip_flags(spark):
    from keepsake.operators import dedup
    m = spark.createDataFrame([
        (1, "/r/a.jpg", "", "deleted", "f1", "s1"), (2, "/r/b.jpg", "", "", "f1", "s1"),
        (3, "/r/c.mp4", "", "", "", "v1"), (4, "/r/d.mp4", "", "", "", "v1"), (5, "/r/e.png", "", "", "f1", "s1")],
        "row_id long, media_path string, json_path string, deletion_status string, phash64 string, content_sha1 string")
    got = {r["ext"]: r["row_id"] for r in actions.sample_per_extension(
        m, None, exts=(".jpg", ".png", ".mp4"), exclude_deleted=True).collect()}
    assert got == {".jpg": 2, ".mp4": 3, ".png": 5}
    kinds = {r["_kind"] for r in dedup.dedup_candidates(m, videos=False).collect()}
    assert kinds == {0}
    kinds = {r["_kind"] for r in dedup.dedup_candidates(m, images=False).collect()}
    assert kinds == {1}


def numbered_path(path, n, style):
    """Variant ``n`` of a path from the definition; 0 is the path itself."""
    folder, _, name = path.rpartition("/")
    p = PurePosixPath(name)
    mark = {"underscore": f"_{n}", "paren": f"({n})", "restored": "_restored" + (f"_{n - 1}" if n > 1 else "")}[style] if n else ""
    return f"{folder}/{p.stem}{mark}{p.suffix}"


def check_names(spark, rows, present, style):
    """Every row, in order, has the first variant that neither exists nor went to an earlier row."""
    got = {r["key"]: r["dst"] for r in actions.free_names(
        spark.createDataFrame(rows, "key string, target string, order long").repartition(7),
        spark.createDataFrame([(p,) for p in present], "path string"), style).collect()}
    assert len(got) == len(rows) and len(set(got.values())) == len(got)
    held = set(present)
    for k, target, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        n = 0
        while numbered_path(target, n, style) in held:
            n += 1
        assert got[k] == numbered_path(target, n, style), (style, k, target)
        held.add(got[k])


def test_free_names_of_camera_names(spark, monkeypatch):
    """Only contested targets go through the rounds; long rows of wanted variants are passed in one."""
    seen = []
    settle = actions._settle
    monkeypatch.setattr(actions, "_settle", lambda t, now, *a: seen.append(now.count()) or settle(t, now, *a))
    rows = [(f"k{i:05d}", f"/d/IMG_{i:05d}.jpg", i) for i in range(3000)]
    check_names(spark, rows, [f"/d/IMG_{i:05d}.jpg" for i in range(0, 3000, 300)], "underscore")
    assert sum(seen) == 10
    rows = [(f"p{i}", f"/d/IMG_{i}.jpg", 2 * i) for i in range(1, 60)] + [(f"q{i}", "/d/IMG.jpg", 31 * i) for i in range(6)] \
        + [("dot1", "/d/n.", 1), ("dot2", "/d/n.", 3), ("dot3", "/d/n._1", 2), ("dot4", "/d/n._1", 4)]
    check_names(spark, rows, ["/d/IMG_7.jpg"], "underscore")
    check_names(spark, [("a", "/d/x.jpg", 1)], [], "paren")


def test_free_names_never_repeat(spark):
    rnd = random.Random(5)
    pool = [f"/d{k}/{n}{v}.jpg" for k in range(3) for n in ("a", "b", "a_b") for v in ("", "_1", "_2", "_1_1", "_7")]
    for style in ("underscore", "paren", "restored"):
        rows = [(f"k{i:03d}", rnd.choice(pool if style == "underscore" else
                                         [x.replace("_1", numbered_path("/x", 1, style)[2:]) for x in pool]), i) for i in range(120)]
        present = rnd.sample(pool, 12) + ["/d0/a_3.jpg", "/d0/a(1).jpg", "/d1/b_restored.jpg"]
        rnd.shuffle(rows)
        check_names(spark, rows, present, style)
    probe = spark.createDataFrame([("1", "/q/a.jpg", 1), ("2", "/q/a.jpg", 2), ("3", "/q/a_1.jpg", 3)], "key string, target string, order long")
    none = spark.createDataFrame([], "path string")
    assert {r["key"]: r["dst"] for r in actions.free_names(probe, none, "underscore").collect()} == {
        "1": "/q/a.jpg", "2": "/q/a_1.jpg", "3": "/q/a_1_1.jpg"}


def test_intake_takes_a_number_once(spark):
    zips = spark.createDataFrame([("/z/take-1-001.zip",), ("/z/take-0-001.zip",), ("/z/t-002.zip",), ("/z/u-002.zip",), ("/z/Z002.zip",)], "path string")
    plan = [r for r in actions.archive_intake_plan(zips, "/p").collect() if r["op"] in ("rename", "keep_name")]
    assert {r["name"]: r["op"] for r in plan} == {"take-0-001.zip": "rename", "take-1-001.zip": "keep_name",
                                                 "t-002.zip": "keep_name", "u-002.zip": "keep_name"}


def test_times_outside_the_calendar_are_blank(spark):
    df = spark.createDataFrame([(99999999999999,), (253402300800,), (253402300799,), (1700000000000,), (-62135596801,)], "t long")
    assert [r[0] for r in df.select(S.format_unix(F.col("t"))).collect()] == ["", "", "9999:12:31 23:59:59", "", ""]


def test_roots_with_pattern_characters(spark):
    files = spark.createDataFrame([(f"/d/a (1)/Z001/T/{x}",) for x in ("Photos from 2011/a.jpg", "Other/b.jpg")], "path string")
    assert [r["dst"] for r in actions.photos_root_prune_plan(files, "/d/a (1)").collect()] == ["/d/a (1)/Z001/T/Other"]


def test_free_names_many_rows_one_target(spark, monkeypatch):
    monkeypatch.setattr(actions, "NAME_CHUNK", 7)          # force several chunks
    n = 40
    targets = spark.createDataFrame([(f"k{i}", "/d/a.jpg", i) for i in range(n)], "key string, target string, order long")
    existing = spark.createDataFrame([("/d/a.jpg",), ("/d/a_3.jpg",), ("/d/a_9.jpg",)], "path string")
    got = {r["key"]: r["dst"] for r in actions.free_names(targets, existing, "underscore").collect()}
    free = [f"/d/a_{i}.jpg" for i in range(1, n + 3) if i not in (3, 9)][:n]
    assert got == {f"k{i}": free[i] for i in range(n)}


def test_converted_media_names_do_not_collide(spark):
    names = ["/d/IMG.PNG", "/d/IMG.png", "/d/x.heic", "/d/y.avi", "/d/z.png"]
    m = spark.createDataFrame([(i, p, p + ".supp.json", p[3:] + ".supp.json", "", "") for i, p in enumerate(names)],
                              "row_id long, media_path string, json_path string, json_filename string, action_taken string, new_ext string")
    headers = spark.createDataFrame([("/d/z.png", "FFD8FFE000104A4649460001")], "path string, header_hex string")
    existing = spark.createDataFrame([(p,) for p in [*names, "/d/x_heic_conv.jpg", "/d/z_png_conv.jpg.supp.json"]], "path string")
    got = {r["row_id"]: (r["media_path"], r["json_path"], r["action_taken"]) for r in actions.conversion_plan(m, headers, existing).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "/d/IMG_png_conv.jpg", 1: "/d/IMG_png_conv_1.jpg", 2: "/d/x_heic_conv_1.jpg",
                                                 3: "/d/y_avi_conv.mp4", 4: "/d/z_png_conv.jpg"}
    assert got[1][1] == "/d/IMG_png_conv_1.jpg.supp.json" and got[4][1] == "/d/z_png_conv.jpg.supp(1).json"
    assert got[2][2].endswith("x_heic_conv_1.jpg") and "z_png_conv.jpg" in got[4][2]


def test_conversion_sidecar_collision_and_guardrail_apply(spark):
    from keepsake.operators import dedup
    m = spark.createDataFrame([
        (1, "/r/IMG_1.png", "/r/IMG_1.png.supp.json", "IMG_1.png.supp.json", "", ".png", "", "", ""),
        (2, "/r/IMG_2.jpg", "/r/IMG_2.jpg.supp.json", "IMG_2.jpg.supp.json", "", ".jpg", "g1", "true", "phash"),
    ], "row_id long, media_path string, json_path string, json_filename string, action_taken string, "
       "new_ext string, dedup_group_id string, delete_flag string, dedup_reason string")
    headers = spark.createDataFrame([("/r/IMG_1.png", "89504E470D0A1A0A0000000D")], "path string, header_hex string")
    existing = spark.createDataFrame([("/r/IMG_1_png_conv.jpg.supp.json",)], "path string")
    r = actions.conversion_plan(m, headers, existing).collect()
    assert len(r) == 1 and r[0]["media_path"] == "/r/IMG_1_png_conv.jpg"
    assert r[0]["json_path"] == "/r/IMG_1_png_conv.jpg.supp(1).json"
    assert r[0]["json_filename"] == "IMG_1_png_conv.jpg.supp(1).json"
    checks = spark.createDataFrame([("/r/IMG_9.jpg", "/r/IMG_2.jpg", True)], "a_path string, b_path string, unflag boolean")
    new, cleared = dedup.apply_guardrail(m, checks)
    row = {x["row_id"]: x for x in new.collect()}[2]
    assert row["delete_flag"] == "false" and row["dedup_reason"] == "guardrail_uncertain" and cleared.count() == 1
