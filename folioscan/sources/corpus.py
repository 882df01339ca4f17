"""Document corpora made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import file_type, ticks


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents as files /corpus/<source>/<lang>/doc_<id>.<txt, md or csv>."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".csv")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    folder = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")
    modified = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return docs.select(
        F.concat(folder, F.lit("/"), name).alias("file_path"), name.alias("file_name"), folder.alias("folder_path"), F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("file_size"), modified.alias("last_modified"), ticks(modified).alias("last_modified_ticks"), file_type(ext).alias("file_type"), "doc_id",
    )


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table pages as files /pages/page_<id>.html, markup and all."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html"))
    modified = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600)
    return pages.select(
        F.concat(F.lit("/pages/"), name).alias("file_path"), name.alias("file_name"), F.lit("/pages").alias("folder_path"), F.col("html").alias("content"),
        F.octet_length("html").cast("bigint").alias("file_size"), modified.alias("last_modified"), ticks(modified).alias("last_modified_ticks"), file_type(F.lit(".html")).alias("file_type"),
    )


def chat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table conversations as files /chat/<conv_id>/<turn>.log."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    folder = F.concat(F.lit("/chat/"), F.col("conv_id").cast("string"))
    name = F.concat(F.col("turn").cast("string"), F.lit(".log"))
    modified = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn"))
    return turns.select(
        F.concat(folder, F.lit("/"), name).alias("file_path"), name.alias("file_name"), folder.alias("folder_path"), F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("file_size"), modified.alias("last_modified"), ticks(modified).alias("last_modified_ticks"), file_type(F.lit(".log")).alias("file_type"),
    )
