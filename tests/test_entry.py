"""Driver contract: entry runs, every oracle key is a query, and a sample of
queries matches its DuckDB oracle at sf0.001 (full check: tools/oracle_check.py)."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["dedup_verdicts", "pair_sidecars", "hamming_nearest", "fuzzy_recover", "conversion_plan",
          "quarantine_paths", "dedup_fix_groups", "backfill_timestamps"]


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "media_path", "dedup_group_id", "delete_flag", "duplicate_of",
                          "dedup_reason", "visual_review_path"]
    rows = df.collect()
    assert len(rows) > 0
    groups = {}
    for r in rows:
        groups.setdefault(r["dedup_group_id"], []).append(r["delete_flag"])
    assert all(flags.count("false") == 1 and len(flags) >= 2 for flags in groups.values())


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sample_matches_oracle(spark):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for n in SAMPLE:
        sdf = qs[n](spark, SF)
        cols = sorted(sdf.columns)
        srows = [r.asDict() for r in sdf.collect()]
        cur = con.execute(sql[n])
        dcols = [d[0] for d in cur.description]
        drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        assert cols == sorted(dcols), n
        assert len(srows) == len(drows), n
        assert digest(srows, cols)[0] == digest(drows, cols)[0], n


def test_stage_tables_follow_replaced_tables(spark, tmp_path):
    from keepsake.catalog import fixtures, stages
    folder = str(tmp_path)

    def build():
        return fixtures.table(spark, folder, "t").selectExpr("x + 1 as y")
    for rows in (3, 5):
        spark.range(rows).selectExpr("id as x").write.mode("overwrite").parquet(f"{folder}/t.parquet")
        first = stages.stage(spark, folder, "plus_one", build)
        assert first.count() == rows
        assert stages.stage(spark, folder, "plus_one", build).inputFiles() == first.inputFiles()
