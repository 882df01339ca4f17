"""What a segment of the index holds, and a reader of one version.

Beside documents a segment has, as Parquet: grouped postings (a row per term and
document, positions delta-coded by the format), blocks of them with their largest
impact, a dictionary, and the dictionary's trigrams; and paths and times by folder, with
digests of the folders. A reader resolves its version once, so all parts that a query
reads belong together.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions.analysis import dealt_postings, wildcard_regex
from folioscan.plans.query import Infix

POSTINGS = "file_path string, field string, term string, freq int, length int, block int, positions array<int>, bucket int"
DICTIONARY = "field string, term string, df bigint, cf bigint, bucket int"
BLOCKS = "field string, term string, block int, n bigint, cf bigint, impact double, bucket int"
GRAMS = "gram string, field string, term string, df bigint, cf bigint, bucket int"
LENGTHS = "file_path string, length bigint"
DEAD = "file_path string"
ENTRIES = "folder string, file_path string, last_modified_ticks bigint, slot int"
#: Columns of folders' digests.
FOLDERS = ("folder", "parent", "below", "below1", "below2", "own", "own1", "own2")
DIGESTS = "folder string, parent string, below bigint, below1 bigint, below2 bigint, own bigint, own1 bigint, own2 bigint, slot int"
#: Documents for each slot of a segment's entries, and slots at most; numbers of slots are
#: powers of two.
SLOT_DOCS, MOST_SLOTS = 1 << 12, 1 << 12
#: Documents of a block of postings, and blocks that a slice of a bucket can number.
BLOCK_DOCS, SLICE_BLOCKS = 128, 1 << 20
#: Parts into which documents deal a bucket, as a few terms hold most places, and
#: documents for each.
LEAST_SLICES, SLICE_DOCS = 4, 1 << 18
#: Bytes of texts for each slice of a bucket, so a task sorts its places in memory.
SLICE_BYTES = 2 << 20
#: Ends a term, so that its last letters have a trigram, too.
END = "\0"
#: Parquet options that code positions as differences.
DELTA = {"parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element": "false"}


def bucket_of(text: Column, buckets: int) -> Column:
    """The bucket of a term or of the first letters of a trigram."""
    return (F.crc32(text.cast("binary")) % buckets).cast("int")


def bucket_on_driver(text: str, buckets: int) -> int:
    """``bucket_of`` for a string at hand."""
    return zlib.crc32(text.encode()) % buckets


def slots_for(documents: int) -> int:
    """Into how many slots the entries of so many documents are dealt."""
    return min(MOST_SLOTS, 1 << max(0, -(-documents // SLOT_DOCS) - 1).bit_length())


def slot_of(folder: Column, slots: int) -> Column:
    """The slot of a folder."""
    return F.crc32(folder.cast("binary")).bitwiseAND(F.lit(slots - 1)).cast("int")


def path_key(path: Column) -> Column:
    """What two paths of one file have in common: no scheme of local files, small letters."""
    return F.lower(F.regexp_replace(path, "^file:/*", "/"))


def folder_of(key: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(F.translate(key, "\\", "/"), "/?[^/]*$", "")


def impact() -> Column:
    """Share of a document's terms that one term makes."""
    return F.col("freq") / F.col("length")


def write_postings(grouped: DataFrame | None, path: str, buckets: int, documents: int, size: int = 0, texts: DataFrame | None = None, analyser: str = "unicode") -> None:
    """Write grouped postings, else those of ``texts``, of so many bytes by bucket. Blocks are made of
    documents with like impact, within slices of a bucket, so no term's documents meet in one
    task. Each slice is a task of its own, and one sort serves blocks and files alike: blocks
    are cut where a number of rows of the slice is full or another term begins, so no window
    gathers a term's rows once more."""
    slices = max(LEAST_SLICES, -(-documents // SLICE_DOCS), -(-size // (buckets * SLICE_BYTES)))
    if grouped is None:
        dealt = dealt_postings(texts, buckets, slices, analyser).withColumn("bucket", F.floor(F.col("part") / slices).cast("int"))
    else:
        part = F.col("bucket") * slices + F.pmod(F.xxhash64("file_path"), F.lit(slices)).cast("int")
        dealt = grouped.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("part", part).repartitionById(buckets * slices, "part")
    dealt = dealt.sortWithinPartitions("bucket", "field", "term", impact().desc(), "file_path")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the rest is the task's number
    block = F.col("part") % slices * SLICE_BLOCKS + F.floor(row / BLOCK_DOCS).cast("int")
    dealt = dealt.withColumn("block", block.cast("int")).select("file_path", "field", "term", "freq", "length", "block", "positions", "bucket")
    dealt.write.options(**DELTA).partitionBy("bucket").parquet(path)


def blocks_of(postings: DataFrame) -> DataFrame:
    """The blocks of written postings: how many documents and places each has, and the
    largest impact."""
    return postings.groupBy("bucket", "field", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("cf"), F.max(impact()).alias("impact"))


def grams_of(words: DataFrame, buckets: int) -> DataFrame:
    """The trigrams of a dictionary's terms, an end mark added, by their first two letters."""
    padded = F.concat("term", F.lit(END))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring(padded, i, F.lit(3))))
    each = words.where(F.length("term") > 1).select(F.explode(grams).alias("gram"), "field", "term", "df", "cf")
    return each.withColumn("bucket", bucket_of(F.substring("gram", 1, 2), buckets))


def pattern_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a pattern."""
    return [p for p in re.split(r"[*?]+", pattern) if p]


class Reader:
    """One version of an index: what is read through it belongs together, whatever is
    written meanwhile."""

    def __init__(self, spark, version: int, segments: list[dict], analyser: str):
        self.spark, self.version, self.segments, self.analyser = spark, version, segments, analyser
        self._total: int | None = None

    def _part(self, part: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """A part of all segments, with the number of each row's segment (segment)."""
        out = None
        for k, x in enumerate(self.segments if segments is None else segments):
            rows = self.spark.read.schema(schema).parquet(f"{x['data']}/{part}").withColumn("segment", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema).withColumn("segment", F.lit(0)) if out is None else out

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (file_path, segment) that no later segment takes out."""
        later = [(k, x) for k, x in enumerate(self.segments) if x["dead"]]
        if not later:
            return rows
        dead = None
        for k, x in later:
            gone = self.spark.read.schema(DEAD).parquet(f"{x['data']}/dead").select(F.col("file_path").alias("gone"), F.lit(k).alias("by"))
            dead = gone if dead is None else dead.unionByName(gone)
        last = dead.groupBy("gone").agg(F.max("by").alias("by"))
        return rows.join(last, (rows["file_path"] == last["gone"]) & (rows["segment"] < last["by"]), "left_anti")

    def docs(self) -> DataFrame:
        """The documents; none if there is no version."""
        return self.live(self._part("docs", S.DOCS)).drop("segment")

    def has_folders(self) -> bool:
        """Whether all segments have digests of folders, which older ones lack."""
        return bool(self.segments) and all("slots" in x for x in self.segments)

    def slots_of(self, folders: DataFrame) -> list[int]:
        """The slots of ``folders`` (folder), as finely as any segment tells them apart."""
        most = max((x["slots"] for x in self.segments), default=1)
        return [r[0] for r in folders.select(slot_of(F.col("folder"), most)).distinct().collect()]

    def _slotted(self, part: str, schema: str, slots: list[int] | None) -> DataFrame:
        """A part of all segments, in some slots alone."""
        out = self._part(part, schema, [])
        for k, x in enumerate(self.segments):
            rows = self.spark.read.schema(schema).parquet(f"{x['data']}/{part}").withColumn("segment", F.lit(k))
            out = out.unionByName(rows if slots is None else rows.where(F.col("slot").isin(sorted({s & (x["slots"] - 1) for s in slots}))))
        return out.drop("slot")

    def folders(self, parents: DataFrame | None = None, slots: list[int] | None = None) -> DataFrame:
        """The digests of all folders, or of the children of ``parents`` (parent), which are
        in ``slots``; a folder whose files have gone may be among them, with zeros."""
        rows = self._slotted("folders", DIGESTS, slots).drop("segment")
        rows = rows if parents is None else rows.join(parents, "parent", "left_semi")
        counted = [F.sum(c).alias(c) if c in ("below", "own") else F.bit_xor(c).alias(c) for c in FOLDERS[2:]]
        return rows.groupBy("folder", "parent").agg(*counted).select(*FOLDERS)

    def entries(self, folders: DataFrame) -> DataFrame:
        """file_path and last_modified_ticks of the documents right in ``folders`` (folder),
        whose slots alone are read."""
        rows = self._slotted("entries", ENTRIES, self.slots_of(folders))
        return self.live(rows.join(folders.select("folder"), "folder", "left_semi")).select("file_path", "last_modified_ticks")

    def entries_at(self, paths: DataFrame) -> DataFrame:
        """file_path and last_modified_ticks of those of ``paths`` (file_path) that are documents."""
        if not self.has_folders():
            return self.docs().select("file_path", "last_modified_ticks").join(paths, "file_path", "left_semi")
        return self.entries(paths.select(folder_of(path_key(F.col("file_path"))).alias("folder")).distinct()).join(paths, "file_path", "left_semi")

    def total(self) -> int:
        """The number of documents, counted once."""
        if self._total is None:
            self._total = self.docs().count()
        return self._total

    def grouped(self, terms: DataFrame | None = None) -> DataFrame:
        """Grouped postings, or those of ``terms`` (field, term), whose buckets alone are
        read then."""
        out = None
        for k, x in enumerate(self.segments):
            rows = self.spark.read.schema(POSTINGS).parquet(f"{x['data']}/postings").withColumn("segment", F.lit(k))
            if terms is not None:
                rows = rows.join(terms.select("field", "term", bucket_of(F.col("term"), x["buckets"]).alias("bucket")).distinct(), ["bucket", "field", "term"], "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return self.live(self._part("postings", POSTINGS) if out is None else out)

    def places_of(self, field: str, terms: list[str], blocks: list[tuple[int, int]] | None = None) -> DataFrame:
        """Grouped postings of a few terms: their buckets alone are read. With ``blocks``
        (segment and block), of these blocks alone."""
        out = None
        for k, x in enumerate(self.segments):
            own = None if blocks is None else [b for s, b in blocks if s == k]
            if own == []:
                continue
            rows = self.spark.read.schema(POSTINGS).parquet(f"{x['data']}/postings").withColumn("segment", F.lit(k))
            rows = rows.where(F.col("bucket").isin(sorted({bucket_on_driver(t, x["buckets"]) for t in terms})) & (F.col("field") == field) & F.col("term").isin(terms))
            rows = rows if own is None else rows.where(F.col("block").isin(own))
            out = rows if out is None else out.unionByName(rows)
        return self.live(self._part("postings", POSTINGS, []) if out is None else out)

    def all_blocks(self) -> DataFrame:
        """The blocks of all terms of contents: field, term, block, n, impact, segment."""
        return self._part("blocks", BLOCKS).where("field = 'content'").drop("bucket", "cf")

    def blocks(self, field: str, term: str) -> DataFrame:
        """The blocks of one term: segment, block, n, impact."""
        out = self._part("blocks", BLOCKS, []).drop("bucket", "cf")
        for k, x in enumerate(self.segments):
            rows = self.spark.read.schema(BLOCKS).parquet(f"{x['data']}/blocks").where((F.col("bucket") == bucket_on_driver(term, x["buckets"])) & (F.col("field") == field) & (F.col("term") == term))
            out = out.unionByName(rows.drop("bucket", "cf").withColumn("segment", F.lit(k)))
        return out

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """One row per term and place: file_path, field, term, pos."""
        return self.grouped(terms).select("file_path", "field", "term", F.explode("positions").alias("pos"), "bucket").withColumn("pos", F.col("pos").cast("bigint"))

    def lengths(self) -> DataFrame:
        """file_path and length (terms of the content) of the documents with any."""
        return self.live(self._part("lengths", LENGTHS)).drop("segment")

    def counts(self) -> DataFrame:
        """field, term, df and cf as the segments have them together; of segments that
        follow older ones, they may be negative."""
        words = self._part("dictionary", DICTIONARY).select("field", "term", "df", "cf")
        return words if len(self.segments) < 2 else words.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def dictionary(self) -> DataFrame:
        """The terms: field, term, df, cf."""
        return self.counts() if len(self.segments) < 2 else self.counts().where("df > 0")

    def document_counts(self, field: str, terms: list[str]) -> dict[str, int]:
        """How many documents have each of a few terms; their buckets alone are read."""
        found = self._part("dictionary", DICTIONARY, []).drop("bucket")
        for x in self.segments:
            rows = self.spark.read.schema(DICTIONARY).parquet(f"{x['data']}/dictionary").withColumn("segment", F.lit(0))
            found = found.unionByName(rows.where(F.col("bucket").isin(sorted({bucket_on_driver(t, x["buckets"]) for t in terms})) & (F.col("field") == field) & F.col("term").isin(terms)).drop("bucket"))
        return {t: 0 for t in terms} | {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}

    def terms_with(self, infix: Infix, field: str) -> DataFrame:
        """field, term and df of the terms that hold a pattern, in which * and ? are
        wildcards.

        Trigrams of its parts pick terms, which are checked then; of a part of two letters,
        the trigrams that begin with them. Other patterns read the dictionary.
        """
        pattern, parts = infix.pattern, pattern_parts(infix.pattern)
        holds = F.col("term").contains(pattern) if infix.plain else F.col("term").rlike(wildcard_regex(f"*{pattern}*"))
        grams = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
        pairs = [p for p in parts if len(p) == 2]
        if not grams and not pairs:
            return self.dictionary().where((F.col("field") == field) & holds).select("field", "term", "df")
        out = None
        for k, x in enumerate(self.segments):
            rows = self.spark.read.schema(GRAMS).parquet(f"{x['data']}/grams").where(F.col("field") == field)
            if grams:
                rows = rows.where(F.col("bucket").isin(sorted({bucket_on_driver(g[:2], x["buckets"]) for g in grams})) & F.col("gram").isin(grams))
                rows = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.first("df").alias("df")).where(F.col("n") == len(grams)).select("term", "df")
            else:
                rows = rows.where((F.col("bucket") == bucket_on_driver(pairs[0], x["buckets"])) & F.col("gram").startswith(pairs[0])).groupBy("term").agg(F.first("df").alias("df"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "field string, term string, df bigint")
        out = out.where(holds)
        out = out if len(self.segments) < 2 else out.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return out.select(F.lit(field).alias("field"), "term", "df")
