"""A third of all rows share one fingerprint: results stay whole and exact,
and the per-group decisions are map-side (partial) aggregations."""

from pyspark.sql import functions as F

from keepsake.operators import dedup


def _manifest(spark, n=3000):
    rows = []
    for i in range(1, n + 1):
        hot = i % 3 == 0
        fp = "ffffffffffffffff" if hot else f"{i:016x}"
        if not hot and i % 3 == 1:
            fp = f"{i - 1 if i > 1 else i:016x}"           # small groups of two
        name = f"IMG_{i:05d}{'(1)' if i % 7 == 0 else ''}.jpg"
        rows.append((i, f"/r/Z001/{name}", name, f"{name}.json" if i % 2 else "", fp, ""))
    return spark.createDataFrame(rows, "row_id long, media_path string, original_media string, "
                                       "json_filename string, phash64 string, content_sha1 string")


def test_hot_fingerprint_group(spark):
    m = _manifest(spark)
    v = dedup.dedup_verdicts(m)
    hot = v.join(m.select("media_path", "phash64"), "media_path").where(F.col("phash64") == "ffffffffffffffff")
    rows = hot.collect()
    assert len(rows) == 1000
    assert len({r["dedup_group_id"] for r in rows}) == 1
    keepers = [r for r in rows if r["delete_flag"] == "false"]
    assert len(keepers) == 1
    # keeper: has a sidecar (odd row), clean name, shortest, first seen -> row 3
    assert keepers[0]["media_path"] == "/r/Z001/IMG_00003.jpg"
    assert all(r["duplicate_of"] == "IMG_00003.jpg" for r in rows if r["delete_flag"] == "true")


def test_group_decisions_are_partial_aggregations(spark):
    m = _manifest(spark, 300)
    per_path = dedup.last_row_per_path(dedup.dedup_candidates(m))
    plan = per_path.groupBy("_kind", "_fp").agg(F.min("first_row_id"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
