"""Analysers: texts to terms, and the postings and dictionary made of them."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import schema as S

#: Words of letters, marks, digits and underscores, or any other visible character.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"

#: Terms that are grouped together in a task's memory; one text may have more.
GROUPED_TERMS = 1 << 20

_analysers: dict[str, tuple[Callable[[Column], Column], Callable[[str], list[str]]]] = {}


def register_analyser(name: str, column: Callable[[Column], Column], driver: Callable[[str], list[str]]) -> None:
    """Add an analyser: as a column function for texts, and as a function for query words."""
    _analysers[name] = (column, driver)


def split_utf8(text: str, most: int = S.MAX_TERM_BYTES) -> list[str]:
    """``text`` in pieces of at most ``most`` UTF-8 bytes, cut between characters."""
    out, piece, size = [], [], 0
    for c in text:
        n = len(c.encode("utf-8", "surrogatepass"))
        if size + n > most and piece:
            out.append("".join(piece))
            piece, size = [], 0
        piece.append(c)
        size += n
    return out + ["".join(piece)] if piece else out


def _pieces(term: Column) -> Column:
    """``split_utf8`` for one term, in the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"), F.lit(0).alias("n"))

    def add(a: Column, c: Column) -> Column:
        full = a["n"] + F.octet_length(c) > S.MAX_TERM_BYTES
        return F.struct(
            F.when(full, F.array_append(a["done"], a["last"])).otherwise(a["done"]).alias("done"),
            F.when(full, c).otherwise(F.concat(a["last"], c)).alias("last"),
            F.when(full, F.octet_length(c)).otherwise(a["n"] + F.octet_length(c)).alias("n"),
        )

    return F.aggregate(F.split(term, ""), start, add, lambda a: F.array_append(a["done"], a["last"]))


def _bounded(terms: Column) -> Column:
    """``terms`` with those that are too long cut; the array of one makes them be
    computed once, and only texts with such a term are looked at term by term."""
    long = lambda t: F.octet_length(t) > S.MAX_TERM_BYTES
    cut = lambda ts: F.flatten(F.transform(ts, lambda t: F.when(long(t), _pieces(t)).otherwise(F.array(t))))
    return F.element_at(F.transform(F.array(terms), lambda ts: F.when(F.exists(ts, long), cut(ts)).otherwise(ts)), 1)


def analysed(text: Column) -> Column:
    """The part of a text that is analysed, and so searched, however: its first 500,000
    characters; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, S.MAX_ANALYSED_CHARS)


def _unicode_words(text: str) -> list[str]:
    out, word = [], []
    for c in text.lower():
        if c == "_" or unicodedata.category(c)[0] in "LMN":
            word.append(c)
            continue
        if word:
            out.append("".join(word))
            word = []
        if not c.isspace():
            out.append(c)
    return out + ["".join(word)] if word else out


register_analyser("unicode", lambda text: F.regexp_extract_all(F.lower(analysed(text)), F.lit(TOKEN), F.lit(0)), _unicode_words)
register_analyser(
    "whole",
    lambda text: F.when(F.trim(analysed(text)) == "", F.array().cast("array<string>")).otherwise(F.array(F.lower(analysed(text)))),
    lambda text: [text.lower()] if text.strip() else [],
)


def _register_morphological() -> None:
    """Mode-C morphemes, where the library and its dictionary are installed; without
    them, and for a text of which they make nothing, the whole text is one term."""
    whole, whole_word = _analysers["whole"]
    try:
        from sudachipy import Dictionary
    except ImportError:
        register_analyser("morph", whole, whole_word)
        return

    def words(text: str) -> list[str]:
        tokenizer = Dictionary().create()
        return [m.surface().strip().lower() for m in tokenizer.tokenize(text) if m.surface().strip()] or whole_word(text)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def column(texts: pd.Series) -> pd.Series:
        tokenizer = Dictionary().create()
        return texts.map(lambda t: [m.surface().strip().lower() for m in tokenizer.tokenize(t) if m.surface().strip()])

    def terms(text: Column) -> Column:
        return F.element_at(F.transform(F.array(column(analysed(text))), lambda ts: F.when(F.size(ts) > 0, ts).otherwise(whole(text))), 1)

    register_analyser("morph", terms, words)


_register_morphological()


def tokens(text: Column, analyser: str = "unicode") -> Column:
    """The terms of a text in order; terms over 32,765 bytes are cut."""
    return _bounded(_analysers[analyser][0](text))


def tokenize(text: str, analyser: str = "unicode") -> list[str]:
    """The terms of a query word."""
    return _analysers[analyser][1](text)


def postings(docs: DataFrame, analyser: str = "unicode", key: str = "file_path") -> DataFrame:
    """One row per term and place: key, field (content or filename), term, pos."""
    text = docs.select(key, F.lit("content").alias("field"), tokens(F.col("content"), analyser).alias("terms"))
    names = docs.select(key, F.lit("filename").alias("field"), tokens(F.col("file_name"), analyser).alias("terms"))
    return text.unionByName(names).select(key, "field", F.posexplode("terms").alias("pos", "term")).select(key, "field", "term", F.col("pos").cast("bigint").alias("pos"))


def dictionary(posted: DataFrame, key: str = "file_path") -> DataFrame:
    """One row per field and term: df (documents) and cf (places)."""
    per_doc = posted.groupBy("field", "term", key).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def _grouped(places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (key, field, terms) to a row per distinct term: its number (freq), that of all
    terms (length), and its places if asked for. Texts are grouped some at a time."""

    def group(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("terms")
        ends = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        row = np.repeat(np.arange(len(sizes)), sizes)
        words = pc.dictionary_encode(lists.flatten())
        # equal terms of a text side by side, in order of their places: text, term and place
        # make one number (a batch has under 2^21 terms, or one text)
        mark, bits = row * max(1, len(words.dictionary)) + words.indices.to_numpy(), len(row).bit_length()
        if int(mark.max(initial=0)).bit_length() + bits < 64:
            mark = np.sort((mark << bits) | np.arange(len(row)))
            order, mark = mark & ((1 << bits) - 1), mark >> bits
        else:
            order = np.argsort(mark, kind="stable")
            mark = mark[order]
        first = np.flatnonzero(np.r_[True, np.diff(mark) != 0][: len(order)])
        at = row[order[first]]
        made = {c: batch.column(c).take(pa.array(at)) for c in batch.schema.names if c != "terms"}
        made |= {"term": words.dictionary.take(words.indices.take(pa.array(order[first]))), "freq": pa.array(np.diff(np.r_[first, len(order)]).astype(np.int32)), "length": pa.array(sizes[at].astype(np.int32))}
        if places:
            pos = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)
            made["positions"] = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        return pa.record_batch(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held = 0, 0
            for k, n in enumerate(np.diff(batch.column("terms").offsets.to_numpy()).tolist()):
                held += n
                if held >= GROUPED_TERMS:
                    yield group(batch.slice(start, k + 1 - start))
                    start, held = k + 1, 0
            yield group(batch.slice(start))

    return run


def _fields(docs: DataFrame, analyser: str, key: str) -> DataFrame:
    """A row for each field of a text: key, field, terms."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(c), analyser).alias("terms")) for f, c in (("content", "content"), ("filename", "file_name"))])
    return docs.select(key, F.explode(fields).alias("x")).select(key, "x.field", "x.terms")


def grouped_postings(docs: DataFrame, analyser: str = "unicode", key: str = "file_path", places: bool = True) -> DataFrame:
    """One row per term, document and field: key, field, term, freq, length (terms of the
    field), and positions (ascending, from 0) if asked for. Made within each document, so
    nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    return _fields(docs, analyser, key).mapInArrow(_grouped(places), f"{key} {kind}, field string, term string, freq int, length int" + ", positions array<int>" * places)


#: Grouped postings of many texts for one part of an index, in lists: a path, field, length
#: and number of terms for each text, and what its terms are.
PACKED = "part int, paths array<string>, fields array<string>, lengths array<int>, counts array<int>, terms array<string>, freqs array<int>, places array<int>"


def _packed(buckets: int, slices: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Rows of ``grouped_postings`` to a row for each part, a bucket's slice: buckets by terms
    (as ``segments.bucket_of``), slices by paths."""
    crc = lambda texts: np.array([zlib.crc32((x or "").encode()) for x in texts.to_pylist()] + [0], dtype=np.int64)

    def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
        path, field, length = (rows.column(c) for c in ("file_path", "field", "length"))
        codes = {c: rows.column(c).dictionary_encode() for c in ("file_path", "field", "term")}
        own = {c: x.indices.fill_null(len(x.dictionary)).to_numpy() for c, x in codes.items()}
        part = (crc(codes["term"].dictionary) % buckets)[own["term"]] * slices + (crc(codes["file_path"].dictionary) % slices)[own["file_path"]]
        changes = lambda *columns: np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in columns], axis=0)][: len(part)])
        order = np.argsort(part, kind="stable")
        first, texts = changes(part[order]), changes(part[order], own["file_path"][order], own["field"][order], length.to_numpy()[order])
        ends = lambda at: np.r_[at, len(order)].astype(np.int32)
        head, of_row, at = pa.array(order[texts]), pa.array(np.r_[np.searchsorted(texts, first), len(texts)].astype(np.int32)), pa.array(order)
        lists = lambda offsets, values: pa.ListArray.from_arrays(offsets, values)
        positions = rows.column("positions").take(at)
        places = np.r_[0, np.cumsum(rows.column("freq").take(at).to_numpy())][ends(first)].astype(np.int32)
        return pa.record_batch(
            [pa.array(part[order][first].astype(np.int32)), lists(of_row, path.take(head)), lists(of_row, field.take(head)), lists(of_row, length.take(head)), lists(of_row, pa.array(np.diff(ends(texts)))),
             lists(pa.array(ends(first)), rows.column("term").take(at)), lists(pa.array(ends(first)), rows.column("freq").take(at)), lists(pa.array(places), positions.flatten())],
            ["part", "paths", "fields", "lengths", "counts", "terms", "freqs", "places"],
        )

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``grouped_postings``, and their part, again."""
    for batch in batches:
        flat = {c: batch.column(c).flatten() for c in batch.schema.names if c != "part"}
        text = pa.array(np.repeat(np.arange(len(flat["counts"])), flat["counts"].to_numpy()))
        row = pa.array(np.repeat(np.arange(len(batch)), batch.column("terms").value_lengths().to_numpy()))
        ends = pa.array(np.r_[0, np.cumsum(flat["freqs"].to_numpy())].astype(np.int32))
        made = {"file_path": flat["paths"].take(text), "field": flat["fields"].take(text), "term": flat["terms"], "freq": flat["freqs"], "length": flat["lengths"].take(text)}
        yield pa.record_batch(made | {"positions": pa.ListArray.from_arrays(ends, flat["places"]), "part": batch.column("part").take(row)})


def dealt_postings(docs: DataFrame, buckets: int, slices: int, analyser: str = "unicode") -> DataFrame:
    """``grouped_postings`` and their part, each part's in a task of its own. They move as
    lists of many terms, so a path, its field and length move once for the terms that a text
    has in a part."""
    group, pack = _grouped(True), _packed(buckets, slices)
    packed = _fields(docs, analyser, "file_path").mapInArrow(lambda batches: map(pack, group(batches)), PACKED)
    return packed.repartitionById(buckets * slices, "part").mapInArrow(_unpacked, "file_path string, field string, term string, freq int, length int, positions array<int>, part int")


def dictionary_of(docs: DataFrame, analyser: str = "unicode") -> DataFrame:
    """``dictionary`` of documents: terms are counted in each text first, so one shuffle
    moves each task's distinct terms."""
    docs = docs.withColumn("_key", F.lit(0))  # paths need not travel
    return grouped_postings(docs, analyser, "_key", places=False).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("freq").alias("cf"))


def wildcard_regex(pattern: str) -> str:
    """A pattern with * and ? as a regular expression for whole terms."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
