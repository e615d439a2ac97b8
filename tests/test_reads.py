"""Costly inputs are read once, and small tables of much work by all cores."""

from pyspark.sql import functions as F

from keepsake.catalog import filesets, queries
from keepsake.catalog import fixtures as X
from keepsake.operators import dedup, pairing, pixels

SMALL = "/root/testdata/sf0.001"


def counted(spark, df, col):
    """``df`` with a column that counts how often it is made."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x
    return df.withColumn(col, F.udf(look, "string").asNondeterministic()(col)), seen


def test_manifest_takes_names_apart_once(spark):
    rows = [(i, f"/r/Z001/Photos from 2012/IMG_{i}.jpg{'.supp.json' if i % 2 else ''}", "{}") for i in range(40)]
    inv, seen = counted(spark, spark.createDataFrame(rows, "file_id long, path string, content string"), "path")
    assert pairing.build_manifest(inv, ("archive", "name", "file_id")).count() == 40
    assert seen.value == 40


def test_verdicts_read_the_manifest_once(spark):
    rows = [(i, f"/r/IMG_{i}.jpg", f"IMG_{i}.jpg", "", f"{i // 2:016x}", "") for i in range(40)]
    m, seen = counted(spark, spark.createDataFrame(rows, "row_id long, media_path string, original_media string, "
                                                         "json_filename string, phash64 string, content_sha1 string"), "phash64")
    assert dedup.dedup_verdicts(m).count() == 40
    assert seen.value == 40


def test_reset_reads_the_first_run_from_its_table(spark):
    queries.queries()["dedup_reset"](spark, SMALL)
    assert any(key[2] == "first_run" for key in queries.stage.__globals__["_WRITTEN"])


def test_audit_runs_record_written_reports(spark, monkeypatch):
    plans, record = [], queries.record_events

    def spy(events, *args):
        plans.append(events._jdf.queryExecution().optimizedPlan().toString())
        record(events, *args)
    monkeypatch.setattr(queries, "record_events", spy)
    queries.queries()["audit_events"](spark, SMALL)
    assert len(plans) == 12 and not any("Join" in p for p in plans)


def test_texts_of_one_file_are_hashed_by_all_cores(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", 6) for i in range(40)], "doc_id long, text string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    media = X.media_files(spark, str(tmp_path))
    assert media.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert media.count() == 40


def test_pictures_are_written_and_read_by_all_cores(spark, tmp_path, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i + j) for j in range(64)]) for i in range(200)], "vec_id long, embedding array<float>")
    vectors.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    cores, parts, run = spark.sparkContext.defaultParallelism, [], filesets._run

    def spy(df, *args):
        parts.append(df.rdd.getNumPartitions())
        run(df, *args)
    monkeypatch.setattr(filesets, "_run", spy)
    monkeypatch.setattr(pixels, "TASKS_PER_CORE", 1)
    images = pixels.read_images(spark, filesets.image_files(spark, str(tmp_path)))
    assert parts == [cores]
    assert images.rdd.getNumPartitions() <= cores
    assert images.count() == 400
