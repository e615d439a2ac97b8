"""Invariants from the survey's test strategy, on the sf0.001 tables:
quarantine/restore round trip, no dangling paths after recovery, editor
reports equal the real difference, one keeper per live group."""

import os

import pytest
from pyspark.sql import functions as F

from keepsake.catalog import queries as Q
from keepsake.catalog import fixtures as X
from keepsake.functions import constants as K
from keepsake.operators import dedup, edits, recovery
from keepsake.plans import actions

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_quarantine_restore_round_trip(spark):
    m = Q.manifest(spark, SF)
    q, report = edits.quarantine_unmatched(m, X.ROOT)
    media = q.where(F.col("row_type") == "unmatched_media").select("row_id", F.col("media_path").alias("path"))
    plan = actions.restore_plan(media.select("path"), f"{X.ROOT}/{K.UNMATCHED_MEDIA_DIR}", X.ROOT)
    back = plan.join(media, plan["src"] == media["path"]).select("row_id", "dst")
    orig = m.select("row_id", "media_path")
    diff = back.join(orig, "row_id").where(F.col("dst") != F.col("media_path"))
    assert back.count() > 0 and diff.count() == 0


def test_editor_report_equals_real_difference(spark):
    m = Q.manifest(spark, SF)
    new, report = edits.quarantine_unmatched(m, X.ROOT)
    changed = (new.alias("n").join(m.alias("o"), "row_id")
               .where(~F.col("n.media_path").eqNullSafe(F.col("o.media_path"))
                      | ~F.col("n.json_path").eqNullSafe(F.col("o.json_path"))
                      | ~F.col("n.notes").eqNullSafe(F.col("o.notes")))
               .select("row_id"))
    assert sorted(r[0] for r in changed.collect()) == sorted(r[0] for r in report.select("row_id").collect())
    new2, report2 = edits.clear_column(m, "notes")
    assert new2.where(F.col("notes") != "").count() == 0
    assert report2.count() == m.where(F.col("notes") != "").count()


def test_no_dangling_paths_after_recovery(spark):
    q = Q.quarantined(spark, SF)
    pairs = Q.recovered_pairs(spark, SF)
    new, updated = recovery.apply_recovery(q, pairs, Q.QJSON_ROOT, Q.UNMATCHED_ROOT, X.ROOT)
    # every recovered row points at the restored (original) locations, which exist in the inventory
    inv = Q.inventory(spark, SF).select("path")
    rec = updated.select("media_path").union(updated.select("json_path")).withColumnRenamed("media_path", "path")
    assert rec.join(inv, "path", "left_anti").count() == 0
    # a recovered sidecar no longer has its own unmatched row
    left = new.where(F.col("row_type") == "unmatched_json").join(
        pairs.select(F.col("json_path").alias("qj")), F.col("json_path") == F.col("qj"), "left_semi")
    assert left.count() == 0
    assert new.count() == q.count() - updated.count()


def test_one_keeper_per_live_group(spark):
    d = Q.deduped_manifest(spark, SF)
    assert dedup.verify_groups(d).count() == 0
    g = d.where(F.col("dedup_group_id") != "").groupBy("dedup_group_id").agg(
        F.count_if(F.col("delete_flag") == "false").alias("k"), F.count(F.lit(1)).alias("n"))
    assert g.where((F.col("k") != 1) | (F.col("n") < 2)).count() == 0
