"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of the hashes of k words in a row, each window keeps its smallest: the fingerprint.
Equal windows keep equal ones, so a window that a document shares with an item is
found by its fingerprint, however it lies. Documents' fingerprints are joined with
those of the benchmark; a hit is extended to the windows whose fingerprint it is, and
these are compared as texts with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, let, written

#: What lies between words once A-Z are small letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which a table made of the benchmark is sent to all executors.
BROADCAST_BYTES = 32 << 20


def plain_words(text: Column) -> Column:
    """The words of a text: runs of letters, digits and whatever isn't ASCII, with A-Z
    lower-cased; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)  # then lower() changes A-Z alone
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(F.coalesce(small, F.lit("")), GAPS), "")


def fingerprints(words: Column, size: int, k: int) -> Column:
    """Runs of windows of ``size`` words that have the same smallest hash of ``k`` words
    in a row: size, start (of the first window), n (windows), print. None for fewer words."""
    shorter = lambda xs, by: F.slice(xs, F.lit(1), F.size(xs) - by)

    def least(mins: Column, span: int) -> Column:
        # mins[i] covers ``span`` hashes; doubled until the window's are covered
        step = min(span, size - k + 1 - span)
        if not step:
            return let(mins, runs)
        return let(mins, lambda m: least(F.transform(shorter(m, step), lambda x, i: F.least(x, F.get(m, i + step))), span + step))

    def runs(mins: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(mins) - 1), lambda i: (i == 0) | (F.get(mins, i) != F.get(mins, i - 1)))
        return let(first, lambda at: F.transform(at, lambda p, j: F.struct(F.lit(size).alias("size"), p.alias("start"), (F.coalesce(F.get(at, j + 1), F.size(mins)) - p).alias("n"), F.get(mins, p).alias("print"))))

    grams = lambda hs: F.transform(shorter(hs, k - 1), lambda h, i: F.xxhash64(*[F.get(hs, i + j) for j in range(k)]))
    none = F.array().cast("array<struct<size:int,start:int,n:int,print:bigint>>")
    return F.when(F.size(words) >= size, let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: least(grams(hs), 1))).otherwise(none)


def _windows(words: Column, window: int) -> Column:
    """The windows of an item as texts; one of fewer words is a window itself."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.array_join(F.slice(words, i + 1, F.lit(window)), " "))
    return F.when(F.size(words) >= window, each).when(F.size(words) > 0, F.array(F.array_join(words, " ")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, k: int = 4, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: ``key``, n_words, windows (start and size, in words, of all places
    where a window of an item occurs, sorted), n_hit (words inside any), items (sorted ids,
    as text, of the items with an occurring window).

    A window is ``window`` words in a row of an item; an item of fewer words, but not
    none, is one window. Sharing ``window`` words or more with an item is always found,
    since fingerprints are of ``k`` words and windows hold at least one; for items that
    are shorter, documents are fingerprinted for their lengths too. Answers are exact:
    candidates are compared as texts.

    A null text has no words; a document without words has no hits. Documents with one id
    or none are answered row by row, repeated rows each. An item without an id hits, but
    isn't listed. No documents give no rows, no items no hits; other columns are ignored.
    Tables made of the benchmark are broadcast up to ``broadcast_bytes``; beyond that
    fingerprints alone are shuffled, and the texts of documents once. The items that hold
    one window stand in one row, as they do in the answer.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        items = scratch.written(benchmark.select(F.col(item_key).cast("string").alias("item"), plain_words(F.col(item_text)).alias("words")).where("size(words) > 0"), "items")
        wins = items.select("item", F.explode(_windows(F.col("words"), window)).alias("win"))
        wins = scratch.written(wins.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
        sizes = [r["s"] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("s")).distinct().collect()]  # window numbers at most
        of_item = F.concat(*[F.when(F.least(F.size("words"), F.lit(window)) == s, fingerprints(F.col("words"), s, min(k, s))).otherwise(fingerprints(F.array().cast("array<string>"), s, min(k, s))) for s in sizes]) if sizes else fingerprints(F.array().cast("array<string>"), 1, 1)
        prints = scratch.written(items.select(F.explode(of_item).alias("x")).select("x.size", "x.print").distinct(), "prints")
        bytes_of = wins.agg(F.sum(F.octet_length("win") + 32 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)).alias("b")).first()["b"] or 0
        small = lambda df, size: F.broadcast(df) if size <= broadcast_bytes else df

        base = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("start"), F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("print")))
        rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("same"), plain_words(F.col(text)).alias("words"))
        marks = F.concat(base, *[fingerprints(F.col("words"), s, min(k, s)) for s in sizes])
        known = (F.col("x.size") == prints["size"]) & (F.col("x.print") == prints["print"])
        if 32 * prints.count() <= broadcast_bytes:
            marked = rows.select("id", "same", "words", F.explode(marks).alias("x")).join(F.broadcast(prints), known, "left")
            marked = marked.where(prints["print"].isNotNull() | (F.col("x.size") == 0)).select("id", "same", "words", "x")
        else:
            hits = rows.select("id", "same", F.explode(marks).alias("x")).join(prints, known, "left_semi").groupBy("id", "same").agg(F.collect_set("x").alias("xs"))
            hits = hits.select(F.col("id").alias("hit_id"), F.col("same").alias("hit_same"), "xs")
            marked = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("same") == F.col("hit_same")), "left")
            marked = marked.select("id", "same", "words", F.explode(F.concat(base, F.coalesce("xs", F.slice(base, 1, 0)))).alias("x"))
        asked = marked.select("id", "same", "words", F.col("x.size").alias("size"), F.explode(F.sequence(F.col("x.start"), F.col("x.start") + F.col("x.n") - 1)).alias("start"))
        asked = asked.select("id", "same", F.when(F.col("size") == 0, F.size("words")).alias("n_words"), "size", "start", F.when(F.col("size") > 0, F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ")).alias("asked"))
        found = asked.join(small(wins, bytes_of), F.col("asked") == F.col("win"), "left").where(F.col("items").isNotNull() | (F.col("size") == 0))
        hit = F.when(F.col("size") > 0, F.struct("start", "size"))
        docs_out = found.groupBy("id", "same").agg(
            F.max("n_words").cast("bigint").alias("n_words"), F.count_if(F.col("size") == 0).alias("copies"), F.array_sort(F.collect_set(hit)).alias("windows"), F.flatten(F.collect_set("items")).alias("items"),
        )
        step = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"))
        covered = F.aggregate("windows", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")), step, lambda a: a["n"])
        out = docs_out.select(F.col("id").alias(key), "n_words", "windows", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return written(out.drop("copy"), "decontaminated")
