"""File-based sources and pixel operators on files made in a fresh temp dir."""

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import functions as F

from keepsake.catalog.filesets import embedding_image, png_bytes
from keepsake.operators import pixels
from keepsake.plans import actions
from keepsake.sources import archives, files, manifest_csv, texts


def test_csv_roundtrip_keeps_quotes_newlines_spaces(spark):
    d = tempfile.mkdtemp(prefix="ks-csv-")
    rows = [(1, "matched", ' padded  ', 'say "hi"', "line1\nline2", ""), (2, "unmatched_json", "", "a,b", "", None)]
    df = spark.createDataFrame(rows, "row_id long, row_type string, notes string, json_filename string, "
                                     "action_taken string, media_path string")
    manifest_csv.write_manifest(df, d + "/m")
    back = manifest_csv.read_manifest(spark, d + "/m").orderBy("row_id").collect()
    assert [r["notes"] for r in back] == [" padded  ", ""]
    assert back[0]["json_filename"] == 'say "hi"' and back[0]["action_taken"] == "line1\nline2"
    assert back[1]["media_path"] == "" and back[1]["json_filename"] == "a,b"
    assert back[0]["row_id"] == 1


def test_archive_members_and_corrupt_zip(spark):
    d = tempfile.mkdtemp(prefix="ks-zip-")
    with zipfile.ZipFile(os.path.join(d, "good.zip"), "w") as z:
        z.writestr("Takeout/Google Photos/Photos from 2012/IMG_1.jpg", b"x")
        z.writestr("Takeout/a.json", b"{}")
    with open(os.path.join(d, "bad.zip"), "wb") as fh:
        fh.write(b"PK\x03\x04 truncated")
    inv = files.inventory(spark, d, glob="*.zip").select("path")
    got = archives.archive_members(inv).collect()
    ok = sorted(r["member"] for r in got if r["error"] is None)
    assert ok == ["Takeout/Google Photos/Photos from 2012/IMG_1.jpg", "Takeout/a.json"]
    assert [r["zip_path"].endswith("bad.zip") for r in got if r["error"] is not None] == [True]


def _zip(path, names, comment=b"", before=b""):
    with open(path, "wb") as fh:
        fh.write(before)
    with zipfile.ZipFile(path, "a") as z:
        for k, name in enumerate(names):
            info = zipfile.ZipInfo(name)
            info.comment = b"PK\x01\x02" * (k % 3)          # looks like an entry and is none
            z.writestr(info, b"x" * (k % 5))
        z.comment = comment


def test_archive_members_by_pieces_equal_the_whole_directory(spark):
    d = tempfile.mkdtemp(prefix="ks-zip-")
    names = [f"Photos from {2000 + k % 20}/{'ü' * (k % 4)}IMG_{k}" + "PK\x01\x02" * (k % 7) + "y" * (k * 37 % 90) for k in range(400)]
    _zip(f"{d}/many.zip", names + ["folder/"])
    _zip(f"{d}/noted.zip", names[:50], comment=b"a comment", before=b"runs by itself" * 9)
    _zip(f"{d}/one long.zip", ["a", "b" * 60000, "c"])
    _zip(f"{d}/empty.zip", [])
    _zip(f"{d}/wide.zip", [f"{k}" for k in range(65600)])     # above 65,535 entries: 64-bit end record
    paths = sorted(os.path.join(d, n) for n in os.listdir(d))
    zips = spark.createDataFrame([(p,) for p in paths], "path string")
    want = []
    for p in paths:
        with zipfile.ZipFile(p) as z:
            want += [(p, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
    for piece in (97, 1000, 1 << 20, archives.PIECE):
        small = zips if piece > 1000 else zips.where("path not like '%wide%'")
        got = archives.archive_members(small, piece).collect()
        assert all(r["error"] is None for r in got)
        assert sorted((r["zip_path"], r["member"], r["size"]) for r in got) == sorted(
            w for w in want if piece > 1000 or "wide" not in w[0])


def test_archive_directory_that_breaks_off_is_one_error_row(spark):
    d = tempfile.mkdtemp(prefix="ks-zip-")
    _zip(f"{d}/a.zip", [f"IMG_{k}.jpg" for k in range(300)])
    with open(f"{d}/a.zip", "rb") as fh:
        data = bytearray(fh.read())
    with open(f"{d}/a.zip", "rb") as fh:
        first, end = archives.directory_range(fh)
    at = data.index(b"IMG_150.jpg", first) - 46
    data[at:at + 2] = b"??"
    with open(f"{d}/a.zip", "wb") as fh:
        fh.write(data)
    zips = spark.createDataFrame([(f"{d}/a.zip",), (f"{d}/none.zip",), (None,)], "path string")
    for piece in (500, archives.PIECE):
        got = archives.archive_members(zips, piece).collect()
        assert len(got) == 3 and all(r["error"] and r["member"] is None for r in got)
    assert archives.archive_members(zips.limit(0)).count() == 0


def test_headers_and_sidecar_documents(spark):
    d = tempfile.mkdtemp(prefix="ks-files-")
    os.makedirs(os.path.join(d, "Z001", "Photos from 2012"))
    p = os.path.join(d, "Z001", "Photos from 2012", "IMG_1.png")
    with open(p, "wb") as fh:
        fh.write(bytes.fromhex("FFD8FFE000104A4649460001") + b"rest")
    with open(p + ".supplemental-metadata.json", "w") as fh:
        fh.write('{"photoTakenTime": {"timestamp": "86400"}}')
    h = files.file_headers(files.inventory(spark, d, glob="*.png").select("path")).collect()
    assert h[0]["header_hex"] == "FFD8FFE000104A4649460001"
    docs = files.sidecar_documents(spark, d).collect()
    assert len(docs) == 1 and docs[0]["path"].endswith("IMG_1.png.supplemental-metadata.json")
    assert "Photos from 2012" in docs[0]["path"]       # percent-decoded


def test_tag_dump_pivot_last_line_wins(spark):
    d = tempfile.mkdtemp(prefix="ks-tags-")
    with open(os.path.join(d, "dump.txt"), "w") as fh:
        fh.write("======== /a/x.mov\nTrack Create Date : 2012:01:01 00:00:00\n"
                 "Media Create Date : 2012:01:02 00:00:00\nTrack Create Date : 2012:01:03 00:00:00\n"
                 "======== /a/y.jpg\nDate/Time Original : 2013:05:05 10:00:00\n")
    got = {r["file"]: r for r in texts.pivot_tags(texts.tag_dump_sections(spark, d)).collect()}
    assert got["/a/x.mov"]["track_create_date"] == "2012:01:03 00:00:00"
    assert got["/a/x.mov"]["media_create_date"] == "2012:01:02 00:00:00"
    assert got["/a/x.mov"]["date_time_original"] is None
    assert got["/a/y.jpg"]["date_time_original"] == "2013:05:05 10:00:00"


def test_tool_log_summary(spark):
    d = tempfile.mkdtemp(prefix="ks-log-")
    with open(os.path.join(d, "run.log"), "w") as fh:
        fh.write("a [1/3]\nb [2/3]\nc [3/3]\n    1 directories scanned\n    3 image files updated\nWarning: x\n")
    rows = texts.tool_log_summary(texts.read_tool_log(spark, d)).collect()
    prog = [r for r in rows if r["kind"] == "progress"]
    assert prog[0]["current"] == 3 and prog[0]["total"] == 3
    assert sorted(r["line"] for r in rows if r["kind"] == "summary") == ["1 directories scanned",
                                                                         "3 image files updated"]


def test_phash_and_pixel_guardrail(spark):
    d = tempfile.mkdtemp(prefix="ks-img-")
    rnd = np.random.default_rng(1)
    base = embedding_image(rnd.normal(size=64))
    other = embedding_image(rnd.normal(size=64))
    imgs = {"a.png": base, "a_bright.png": np.clip(base + 5, 0, 255), "a_big.png": np.kron(base, np.ones((2, 2))),
            "b.png": other}
    for n, a in imgs.items():
        with open(os.path.join(d, n), "wb") as fh:
            fh.write(png_bytes(a))
    im = pixels.read_images(spark, d)
    ph = {os.path.basename(r["path"]): r["phash"] for r in pixels.image_phash(im).collect()}

    def dist(x, y):
        return bin((ph[x] ^ ph[y]) & (2 ** 64 - 1)).count("1")
    assert dist("a.png", "a_bright.png") <= 2 and dist("a.png", "a_big.png") <= 4
    assert dist("a.png", "b.png") > 10
    pairs = spark.createDataFrame([(os.path.join(d, "a.png"), os.path.join(d, x)) for x in
                                   ["a_bright.png", "a_big.png", "b.png", "missing.png"]], "a_path string, b_path string")
    g = {os.path.basename(r["b_path"]): r for r in pixels.guardrail(pairs, im, 10.0, 4, "to_min").collect()}
    assert not g["a_bright.png"]["unflag"] and not g["a_big.png"]["unflag"]
    assert g["b.png"]["unflag"]
    assert not g["missing.png"]["unflag"]          # a missing file is skipped, never un-flagged


def test_pixel_pairs_in_parts_equal_direct_comparison(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="ks-img-")
    rnd = np.random.default_rng(2)
    kept = {f"{d}/{k}.png": np.round(embedding_image(rnd.normal(size=64), 64 + 32 * (k % 2))) for k in range(8)}
    for n, a in kept.items():
        with open(n, "wb") as fh:
            fh.write(png_bytes(a))
    names = list(kept)
    pairs = [(names[0], n) for n in names] + [(n, names[0]) for n in names[3:6]] + [(names[1], names[2])] * 2 \
        + [(names[0], f"{d}/gone.png"), (f"{d}/gone.png", names[1]), (names[0], None), (None, None)]
    df = spark.createDataFrame(pairs, "a_path string, b_path string")
    im = pixels.read_images(spark, d)
    for policy in ("to_first", "to_min"):
        def expect(a, b):
            if a not in kept or b not in kept:
                return 255.0, False
            x, y = (np.repeat(kept[n][:, :, None], 3, axis=2) for n in (a, b))
            return round(pixels.pixel_diff(x, y, policy), 6), True
        want = sorted(((a or "", b or "", *expect(a, b)) for a, b in pairs))
        for copies, limit in ((1000, 50_000), (2, 0)):
            monkeypatch.setattr(pixels, "COPIES_PER_PART", copies)
            monkeypatch.setattr(pixels, "BROADCAST_USES", limit)
            out = pixels.pair_pixel_diff(df, im, policy, with_hashes=True)
            rows = out.collect()
            assert sorted((r["a_path"] or "", r["b_path"] or "", round(r["diff"], 6), r["present"]) for r in rows) == want
            assert all((r["a_phash"] is not None) == (r["b_phash"] is not None) == r["present"] for r in rows)
    assert pixels.pair_pixel_diff(df.limit(0), im).count() == 0


def test_failed_moves_take_all_variants(spark):
    files_df = spark.createDataFrame([(p,) for p in [
        "/r/Z001/T/IMG_1.heic", "/r/Z001/T/IMG_1.heic.json", "/r/Z001/T/IMG_1.xmp", "/r/Z001/T/IMG_10.heic",
        "/r/__FAILED_FILES__/Z001/T/IMG_1.xmp"]], "path string")
    failed = spark.createDataFrame([("/r/Z001/T/IMG_1.heic", "HEIC->JPEG error")], "path string, reason string")
    got = {r["src"]: r["dst"] for r in actions.failed_moves(failed, files_df, "/r/__FAILED_FILES__").collect()}
    assert got == {"/r/Z001/T/IMG_1.heic": "/r/__FAILED_FILES__/Z001/T/IMG_1.heic",
                   "/r/Z001/T/IMG_1.heic.json": "/r/__FAILED_FILES__/Z001/T/IMG_1.heic.json",
                   "/r/Z001/T/IMG_1.xmp": "/r/__FAILED_FILES__/Z001/T/IMG_1_1.xmp"}


def test_sinks_times_csv_and_audit(spark):
    from keepsake.sources import sinks
    d = tempfile.mkdtemp(prefix="ks-sink-")
    rows = spark.createDataFrame([("/a/x.jpg", "2012:01:01 00:00:00", "2012:01:01 00:00:00", "2012:01:01 00:00:00",
                                   "", "")], "SourceFile string, DateTimeOriginal string, CreateDate string, "
                                            "ModifyDate string, MediaCreateDate string, TrackCreateDate string")
    sinks.write_times_csv(rows, d + "/times")
    back = spark.read.option("header", True).csv(d + "/times").collect()
    assert back[0]["SourceFile"] == "/a/x.jpg" and back[0]["MediaCreateDate"] is None
    ev = spark.createDataFrame([("unflag", "/a/x.jpg", "diff=12.0")], "event string, path string, detail string")
    sinks.append_audit(ev, d + "/audit", "guardrail")
    sinks.append_audit(ev, d + "/audit", "guardrail")
    assert spark.read.parquet(d + "/audit").count() == 2


def test_intake_stream_is_incremental(spark):
    from keepsake.catalog.filesets import EMPTY_ZIP
    from keepsake.streaming.intake import run_intake
    d = tempfile.mkdtemp(prefix="ks-intake-")
    dl, out, ck = d + "/downloads", d + "/plan", d + "/ckpt"
    os.makedirs(dl)
    for n in ["takeout-a-001.zip", "takeout-a-002.zip", "Z001.zip"]:
        with open(os.path.join(dl, n), "wb") as fh:
            fh.write(EMPTY_ZIP)
    run_intake(spark, dl, out, ck, "/p")
    with open(os.path.join(dl, "takeout-b-003.zip"), "wb") as fh:
        fh.write(EMPTY_ZIP)
    run_intake(spark, dl, out, ck, "/p")
    rows = spark.read.parquet(out).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], set()).add(r["name"])
    assert sorted(by_batch) == [0, 1]
    assert by_batch[0] == {"takeout-a-001.zip", "takeout-a-002.zip"}
    assert by_batch[1] == {"takeout-b-003.zip"}          # the tracker skips what was planned
    with open(os.path.join(dl, "a-first-002.zip"), "wb") as fh:
        fh.write(EMPTY_ZIP)
    run_intake(spark, dl, out, ck, "/p")
    late = {r["op"] for r in spark.read.parquet(out).where("name = 'a-first-002.zip'").collect()}
    assert late == {"extract", "keep_name"}              # an earlier batch was promised Z002.zip


def test_trees_are_listed_in_tasks(spark):
    d = tempfile.mkdtemp(prefix="ks-list-")
    want = {}
    for k, rel in enumerate(["a.jpg", "__UNMATCHED_MEDIA__/Z001/b c+%20.jpg", "x/y/z/.hidden", "x/y/w.JSON", "x/v.zip", "x/n.zip.txt"]):
        os.makedirs(os.path.dirname(os.path.join(d, rel)), exist_ok=True)
        with open(os.path.join(d, rel), "w") as fh:
            fh.write("q" * k)
        os.utime(os.path.join(d, rel), (1_600_000_000 + k, 1_600_000_000.9 + k))
        want[os.path.join(d, rel)] = (k, 1_600_000_000 + k)
    os.makedirs(d + "/empty/deeper")
    got = {r["path"]: (r["length"], r["mtime"]) for r in files.inventory(spark, d).collect()}
    assert got == want
    assert [r["name"] for r in files.inventory(spark, d, glob="*.zip").collect()] == ["v.zip"]
    assert [r["content"] for r in files.sidecar_documents(spark, d).collect()] == ["qqq"]
    assert files.inventory(spark, d + "/nowhere").count() == 0


def test_dct_matches_reference_definition():
    # unnormalised DCT-II: y[k] = 2 * sum_n x[n] cos(pi k (2n + 1) / 2N)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=32)
    n = np.arange(32)
    expect = np.array([2 * np.sum(x * np.cos(np.pi * k * (2 * n + 1) / 64)) for k in range(32)])
    assert np.allclose(pixels._dct_matrix(32) @ x, expect)


def test_tag_dump_sections_across_blocks(spark):
    d = tempfile.mkdtemp(prefix="ks-tags-split-")
    lines, expect = [], {}
    for i in range(40):
        f = f"/a/f{i:03d}.mov"
        lines.append(f"======== {f}")
        for k in range(i % 4 + 1):
            lines.append(f"Track Create Date               : 2012:01:{k + 1:02d} 00:00:{i % 60:02d}")
            lines.append(f"Other Tag {k}                   : noise {i}")
        expect[f] = f"2012:01:{i % 4 + 1:02d} 00:00:{i % 60:02d}"     # the last one wins
    with open(os.path.join(d, "dump.txt"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")       # many blocks, sections straddle them
    try:
        got = {r["file"]: r["track_create_date"] for r in texts.pivot_tags(texts.tag_dump_sections(spark, d)).collect()}
        blocks = spark.read.text(d).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 10
    assert got == expect
