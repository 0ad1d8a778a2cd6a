"""The queries of this subpackage by name, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm import (
    byte_bpe,
    collocations,
    embedding_links,
    language_id,
    licenses,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    suffix_dedup,
    toxicity,
    url_filter,
    warc_zip,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links.near_duplicates(_table(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = _table(spark, folder, "labels").where(~held_out)
    scored = toxicity.scores(_table(spark, folder, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_terms")


def op7_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zip.round_trip(spark, _table(spark, folder, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return url_filter.evaluate(url_filter.dated_pages(pages), url_filter.dated_entries(pages)).withColumnRenamed("id", "page_id")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.filed_documents(_table(spark, folder, "documents")))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.sample_counts(_table(spark, folder, "documents"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", periodic_runs.looped_text().alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.longest_run("runs"))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    predicted = language_id.predict(docs, language_id.fit(docs.where(~held_out)))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mixing": op2_source_mixing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_warc_zip": op7_warc_zip,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op5_license_scan": licenses.SQL,
    "op12_collocations": collocations.SQL,
}
