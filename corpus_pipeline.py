"""The corpus pipeline: documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.byte_bpe import byte_bpe_round_trip
from folioscan.llm.exact_dedup import exact_dedup
from folioscan.llm.mixing import mix_sources
from folioscan.llm.near_dedup import near_components
from folioscan.llm.quality import quality_rules
from folioscan.llm.shared import Scratch, written


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row (row): the id, where ids tell all rows apart, else a
    number, written so that it stays."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return docs.withColumn("row", F.col("doc_id"))
    return written(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the lines that pass. Null and empty
    texts go; repeated rows are judged each."""
    # exploding the kept verdicts computes each once; a filter would compute it twice
    judged = quality_rules(docs)
    judged = judged.withColumn("quality", F.explode(F.filter(F.array("quality"), lambda q: q["kept"]))).withColumn("text", F.col("quality.cleaned"))
    return judged.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: the document with the largest id; null comes before all
    ids. A null text equals an empty one, and of repeated rows one stays."""
    rows = keyed(docs)
    kept = exact_dedup(rows.withColumn("key", F.struct("doc_id", "row")), "key").where("kept").select("key.row")
    return rows.join(kept, "row", "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (five words, 0.8), one row: the one with
    the smallest id; null comes after all ids. Texts without words are like no other."""
    rows = keyed(docs)
    found = near_components(rows, "row", k=5, percent=80).join(rows.select("row", "doc_id"), "row")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")).select("least.row")
    return rows.join(kept, "row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights 3, 1, 2 takes them, each row by
    itself whatever its id. Texts without words, null ones too, are never taken; a null
    source is one."""
    rows = keyed(docs)
    taken = mix_sources(rows, key_col="row").groupBy("row").agg(F.count(F.lit(1)).alias("passes"))
    return rows.join(taken, "row").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents, row by row: a null text has no
    tokens, null ids stay, repeated rows are encoded each, and no rows give no rows."""
    return byte_bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", clean), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mix sources", mix), ("byte BPE", encode)]
#: SQL has no byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``, each stage's rows written once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.drop_before(1)
        return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
