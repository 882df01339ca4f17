"""Previews of texts longer than a preview shows."""

from folioscan import schema as S
from folioscan.operators import preview
from folioscan.plans import catalogue


def test_pages_are_counted_whole(spark, tmp_path):
    html = "<p>\n" * (S.PREVIEW_CHARS // 4 + 9)  # the cut would lose nine lines and add one
    spark.createDataFrame([(1, "u", html), (2, "u", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.file_path: r.line_count for r in catalogue.QUERIES["preview_html"](spark, str(tmp_path)).collect()}
    assert got == {"/pages/page_1.html": html.count("\n") + 1, "/pages/page_2.html": 1}


def test_the_cut_counts_composed_characters(spark):
    docs = spark.createDataFrame([("/a", "é\n" * 10)], "file_path string, content string")
    assert [r.content for r in preview.preview(docs, "", limit=20).orderBy("line_no").collect()] == ["&#233;"] * 10 + [""]
    assert [r.content for r in preview.preview(docs, "", limit=4).orderBy("line_no").collect()] == ["&#233;", "&#233;", "", "... (省略)"]


def test_only_texts_that_may_change_are_composed(spark, monkeypatch):
    import unicodedata

    from pyspark.sql import functions as F

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # every character by itself, after a letter, and after what it composes with
    pairs = [c for c in chars if len(d := unicodedata.normalize("NFD", c)) > 1]
    texts = chars + ["e" + c for c in chars] + [unicodedata.normalize("NFD", c) for c in pairs]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in docs.select(preview.nfc(F.col("t")).alias("t")).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in texts]
    # what needs no composing reaches Python as null
    seen = F.udf(lambda t: t, "string")
    monkeypatch.setattr(preview, "_composed", lambda text: F.concat(F.lit("!"), F.coalesce(seen(text), F.lit("null"))))
    plan = spark.createDataFrame([("日本語 é",), ("é",)], "t string").select(preview.nfc(F.col("t")).alias("t"))
    assert [r.t for r in plan.collect()] == ["日本語 é", "!é"]
