"""The queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.byte_bpe import byte_bpe_round_trip
from folioscan.llm.decontaminate import decontaminate
from folioscan.llm.exact_dedup import exact_dedup
from folioscan.llm.html_text import extract_main_text
from folioscan.llm.mixing import mix_summary
from folioscan.llm.near_dedup import near_components
from folioscan.llm.prefix_trie import marked_turns, prefix_trie, spliced
from folioscan.llm.quality import quality_rules
from folioscan.llm.sharding import kd_shards
from folioscan.llm.shared import Scratch, written
from folioscan.llm.spelling import spelling_variants, word_counts
from folioscan.llm.suffix_tree import score_documents
from folioscan.llm.token_counts import TokenLedger, changes, counted
from folioscan.llm.token_files import token_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and what is read back from them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 3, 1, 2 takes of each document."""
    return mix_summary(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return kd_shards(_table(spark, sf_dir, "documents"), leaves=24)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    Loaded with the counts of one tokenizer, then revised to those of another; documents
    of under 50 tokens are deleted.
    """
    docs = _table(spark, sf_dir, "documents").select("source", "lang", "text")
    paths = {"word_bpe_49k": public_tokenizers.path("word_bpe_49k.json"), "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    with Scratch(spark) as scratch:
        tokens = scratch.written(counted(docs, paths, public_tokenizers.PATTERN), "counted")
        old, new = paths
        ledger = TokenLedger(spark, scratch.path("ledger"))
        ledger.commit("load", changes(tokens, old, F.col(old)))
        revised = changes(tokens, old, F.col(old), -1).unionByName(changes(tokens, new, F.col(new)))
        ledger.commit("revise", revised)
        ledger.commit("load", changes(tokens, old, F.col(old)))  # sent again: counts once
        ledger.commit("delete", changes(tokens.where(F.col(new) < 50), new, F.col(new), -1))
        return written(ledger.totals(), "token-counts")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts decoded from them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose id's CRC-32 mod 7 isn't 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar 3-word shingles."""
    return near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of each document, and the verdict."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{k}") for k in fields])


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a window of ten words of a benchmark item."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, k=4)
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of five letters and three occurrences.

    Where 97 divides the CRC-32 of a document's id and a word, the word lacks a letter there.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.filter(F.split("text", r"[^A-Za-z\u00C0-\u00FF]+"), lambda w: F.length(w) >= 5)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    spelled = F.when(F.col("h") % 97 == 0, F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling_variants(word_counts(each, F.array(spelled), least_chars=5, least_count=3), times=2)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt to begin as the one at its hundred
    does, for as many turns as the CRC-32 of its id says."""
    conv = F.col("conv_id")
    with Scratch(spark) as scratch:
        turns = scratch.written(marked_turns(_table(spark, sf_dir, "conversations")), "turns")
        convs, rebuilt = spliced(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
        return prefix_trie(convs, rebuilt)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_mix_sources": op2_mix_sources,
    "op3_kd_shards": op3_kd_shards,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_text": op6_html_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_winnowing": op11_winnowing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}
