"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, fixity, hardneg, langid, licenses, mixing, runs, simhash, tokenbin, toxicity, vecdedup
from .common import id_fold, table


def in_fold(doc_id, folds: int, fold: int):
    return F.coalesce(id_fold(F.col(doc_id), folds) == fold, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs, folds=4, held_out=2), keep=["doc_id"])
    return out.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenbin.write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.corpus_index(spark, folder)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def damaged(records: DataFrame) -> DataFrame:
    """The second replica of the fixity query: what a copy looks like after
    bit rot and loss. Records of pages at 7 modulo 97 have their fifth last
    byte changed; those at 11 modulo 211 are lost."""
    page = F.coalesce("page_id", F.lit(0))
    rotten = F.concat(F.expr("substring(bytes, 1, octet_length(bytes) - 5)"), F.lit("?\r\n\r\n").cast("binary"))
    return records.where(page % 211 != 11).withColumn("bytes", F.when(page % 97 == 7, rotten).otherwise(F.col("bytes")))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = fixity.warc_records(table(spark, sf_dir, "pages"))
    return fixity.fixity_report(fixity.record_index(ours), damaged(ours))


def repeating(docs: DataFrame) -> DataFrame:
    """The documents of the run query: where crc32(doc_id) % 10 is 0, the words
    from one place on repeat with a period that follows from the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    rows = rows.withColumn("n", F.when(n > 0, n.cast("long")))
    rows = rows.withColumn("a", g % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    new = F.transform("w", lambda w, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(repeating(table(spark, sf_dir, "documents")))
    # longest first, then first start, then smallest period
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"),
        F.col("top.p").alias("period"), F.expr("(-1000 * top.l) div top.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], n=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_sources, op2_language_id, op3_token_files, op4_bpe, op5_vector_dedup, op6_license_scan,
             op7_curve_neighbours, op8_toxicity, op9_simhash, op10_warc_fixity, op11_periodic_runs, op12_decontamination,
             op13_hard_negatives]
    return {f.__name__: f for f in found}
