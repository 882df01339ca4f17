"""Line previews with marked query words, and moves between marked lines."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import schema as S


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


#: Characters that a text in composed form may not have, or only in some places.
UNCOMPOSED = (
    "[\\p{M}\\p{Cn}\\u0374\\u037E\\u0387\\u0958-\\u0FFF\\u1161-\\u11C2\\u1F71-\\u1FFD\\u2000\\u2001\\u2126\\u212A\\u212B\\u2329\\u232A\\u2ADC\\uF900-\\uFAFF\\uFB1D-\\uFB4E"
    "\\x{1D15E}-\\x{1D1C0}\\x{2F800}-\\x{2FA1F}]"
)


def nfc(text: Column) -> Column:
    """The text in composed form. Texts without any of ``UNCOMPOSED`` are composed already
    and don't leave the JVM: the function gets null for them, as it is called for every row."""
    may_differ = text.rlike("[^\\x00-\\u02FF]") & text.rlike(UNCOMPOSED)
    return F.when(may_differ, _composed(F.when(may_differ, text))).otherwise(text)


def html_encode(text: Column) -> Column:
    """``< > & " '``, U+00A0 to U+00FF and characters beyond U+FFFF as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    code = lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[\\u00A0-\\u00FF\\x{10000}-\\x{10FFFF}]"), code(c)).otherwise(c))
    return F.when(text.rlike("[\\u00A0-\\u00FF\\x{10000}-\\x{10FFFF}]"), F.array_join(each, "")).otherwise(text)


def encode_term(term: str) -> str:
    """``html_encode`` for a query word."""
    named = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
    return "".join(named.get(c) or (f"&#{ord(c)};" if 0xA0 <= ord(c) <= 0xFF or ord(c) > 0xFFFF else c) for c in term)


def quote(term: str) -> str:
    """A term as a regular expression that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in term)


def preview_terms(query: str | None) -> list[str]:
    """The words of a query between spaces and wide spaces, composed."""
    return [unicodedata.normalize("NFC", t) for t in re.split("[ 　]", query or "") if t.strip()]


def preview_content(content: Column, error: Column | None = None, limit: int | None = S.PREVIEW_CHARS) -> Column:
    """What a preview shows: the content, cut at ``limit`` characters (whole if that is
    None), a message for an error, or a note where nothing could be read."""
    shown = F.when(content.isNull(), F.lit(S.NO_PREVIEW))
    if limit is not None:
        shown = shown.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(S.PREVIEW_CUT)))
    shown = shown.otherwise(content)
    return shown if error is None else F.when(error.isNotNull(), F.concat(F.lit(S.PREVIEW_ERROR), error)).otherwise(shown)


def preview(docs: DataFrame, query: str | None, compat: bool = True, limit: int | None = S.PREVIEW_CHARS) -> DataFrame:
    """file_path, line_no (from 1), content (encoded, words marked), has_match.

    Texts are composed before they are cut, so the limit counts composed characters.
    ``compat`` marks one word after the other, so a later word may mark earlier
    marks; otherwise all words are marked in one pass.
    """
    terms = preview_terms(query)
    error = nfc(F.col("error")) if "error" in docs.columns else None
    lines = docs.select("file_path", F.posexplode(F.split(preview_content(nfc(F.col("content")), error, limit), "\n", -1)).alias("pos", "raw"))
    lines = lines.select("file_path", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.rtrim(F.col("raw"), F.lit("\r")).alias("raw"))
    hits = [F.col("raw").rlike("(?iu)" + quote(t)) for t in terms]
    found = F.lit(False)
    for h in hits:
        found |= h
    shown = html_encode(F.col("raw"))
    if compat:
        for t, h in zip(terms, hits):
            shown = F.when(h, F.regexp_replace(shown, "(?iu)" + quote(encode_term(t)), "<mark>$0</mark>")).otherwise(shown)
    elif terms:
        longest = sorted((quote(encode_term(t)) for t in terms), key=len, reverse=True)
        shown = F.regexp_replace(shown, "(?iu)" + "|".join(longest), "<mark>$0</mark>")
    return lines.select("file_path", "line_no", shown.alias("content"), found.alias("has_match"))


def preview_path(spark: SparkSession, path: str | None, query: str | None, compat: bool = True) -> DataFrame:
    """The preview of one file, read from disk now rather than from the index. An
    empty path, a file that no extractor reads and an error give one line that says so."""
    from folioscan.sources.extractors import default_registry
    from folioscan.sources.files import extract

    one = "file_path string, content string, error string"
    ext = "." + path.rpartition(".")[2] if path and "." in path else ""
    if not path or default_registry().get(ext) is None:
        return preview(spark.createDataFrame([(path, None if path else S.NO_PATH, None)], one), query if path else "", compat)
    files = spark.read.format("binaryFile").load(path)
    return preview(extract(files).select("file_path", "content", "error"), query, compat)


def highlight_nav(lines: DataFrame, wrap: bool = True) -> DataFrame:
    """For each marked line: file_path, line_no, next_line, prev_line (round the ends
    if ``wrap``, else null there), k (its number), total."""
    by_file = Window.partitionBy("file_path")
    order, every = by_file.orderBy("line_no"), by_file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = (F.first("line_no").over(every), F.last("line_no").over(every)) if wrap else (F.lit(None).cast("bigint"),) * 2
    return lines.where("has_match").select(
        "file_path", "line_no", F.coalesce(F.lead("line_no").over(order), first).alias("next_line"), F.coalesce(F.lag("line_no").over(order), last).alias("prev_line"),
        F.row_number().over(order).cast("bigint").alias("k"), F.count(F.lit(1)).over(by_file).alias("total"),
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """file_path, line_count, match_lines."""
    return lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("line_count"), F.count_if("has_match").alias("match_lines"))
