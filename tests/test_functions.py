import pytest
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions import analysis, text
from folioscan.plans.query import Infix, Phrase, escape_wildcards, is_plain_word, normalize_query, parse_query, split_words
from folioscan.sources.settings import Settings, normalize_extension, normalize_extensions, normalize_folder

CASES = [("", ""), (None, ""), (".cs", ".cs"), (".CS", ".cs"), ("txt", ".txt"), ("TXT", ".txt"), ("C:\\path\\to\\file.cs", ".cs"), ("/path/to/file.js", ".js"), ("  .md  ", ".md"), ("a.txt", ".a.txt"), ("   ", ""), ("/dir/noext", "")]


def test_normalize_extension(spark):
    found = spark.createDataFrame([(a,) for a, _ in CASES], "x string").select(text.normalize_extension(F.col("x"))).collect()
    assert [r[0] for r in found] == [b for _, b in CASES]
    assert [normalize_extension(a) for a, _ in CASES] == [b for _, b in CASES]
    assert normalize_extensions(["TXT", ".txt", "", " md"]) == [".txt", ".md"]


def test_labels_and_icons(spark):
    found = spark.createDataFrame([("a.docx",), ("b.YML",), ("c.htm",), ("d",)], "n string").select(text.file_type(text.extension(F.col("n"))), text.icon_class(F.col("n"))).collect()
    assert [tuple(r) for r in found] == [("Word文書", "word"), ("YAMLファイル", "text"), (S.OTHER_TYPE, "text"), (S.OTHER_TYPE, "text")]
    assert len({*S.FILE_TYPES.values(), S.OTHER_TYPE}) == 20 and len(S.TEXT_EXTENSIONS) == 38


def test_sizes_and_ages(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1048575,), (1572864,)], "s bigint").select(text.format_size(F.col("s"))).collect()
    assert [r[0] for r in sizes] == ["0 B", "1023 B", "1 KB", "1023 KB", "1.5 MB"]
    ages = spark.createDataFrame([(None,), (30,), (61,), (7200,), (3 * 86400,), (8 * 86400,)], "s bigint")
    shown = ages.select(text.format_age(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("s")), F.timestamp_seconds(F.lit(1_700_000_000)))).collect()
    assert [r[0] for r in shown] == [S.NEVER, S.JUST_NOW, "1分前", "2時間前", "3日前", "11/06 22:13"]


def test_ticks_round_trip(spark):
    row = spark.sql("SELECT timestamp '2024-01-01 00:00:00.123456' AS t").select("t", text.time_of_ticks(text.ticks(F.col("t"))), text.time_of_ticks(F.lit(0)), text.ticks(F.col("t"))).first()
    assert row[0] == row[1] and row[2] is None and row[3] == 638396640001234560


def test_under_any(spark):
    paths = ["/a/b/c.txt", "/A/B", "/a/bc/d.txt", "C:\\x\\y.txt"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(text.under_any(F.col("p"), ["/a/b/", "C:\\"])).collect()
    assert [r[0] for r in found] == [True, True, False, True]


def test_query_words():
    assert normalize_query(None) == "" and normalize_query("  a　b ") == "a b"
    assert split_words("than　doc_1") == ["than", "doc_1"] and split_words("a\tb") == ["a\tb"]
    assert len(split_words(" ".join("w" * 65))) == S.MAX_QUERY_WORDS == 64
    plain = {"abc": True, "a_b": True, "消費税": True, "10%": False, "C++": False, "ー": True, "😀": False, "foo-bar": False}
    assert {w: is_plain_word(w) for w in plain} == plain
    assert escape_wildcards("a*b?") == "a\\*b\\?"


def test_query_plans():
    assert parse_query("").blank and parse_query("　").blank and not parse_query("a").blank
    word = parse_query("THAN").words[0]
    assert word.content == Infix("than") and word.name == Infix("than")
    word = parse_query("FOO-BAR").words[0]
    assert word.content == Phrase(("foo", "-", "bar")) and word.name == Infix("FOO-BAR")
    assert parse_query("FOO-BAR", lenient=True).words[0].name == Infix("foo-bar")
    assert parse_query("FOO-BAR", "whole").words[0].content == Infix("foo-bar")


def test_tokens(spark):
    texts = ["", "  \n", "Foo bar_1, baz", "消費税は10%です", "a\nb", "e\u0301t", "x" * 40000]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.tokens(F.col("t"))).collect()]
    assert found == [[p for w in analysis.tokenize(t) for p in analysis.split_utf8(w)] for t in texts]
    assert found[2] == ["foo", "bar_1", ",", "baz"] and [len(x) for x in found[-1]] == [32765, 7235]
    assert analysis.split_utf8("é" * 4, 5) == ["éé", "éé"] and analysis.split_utf8("") == []


def test_settings(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    assert ".docx" in Settings.load(path).target_extensions
    settings = Settings(target_extensions=["TXT", "txt"], auto_rebuild_interval_minutes=60)
    assert settings.add_folder(str(tmp_path) + "/") is None and settings.add_folder(str(tmp_path).upper()) and settings.add_folder("") and settings.add_folder("/no/such")
    assert settings.add_extension("md") is None and settings.add_extension(".MD")
    settings.save(path)
    again = Settings.load(path)
    assert again.target_extensions == [".txt", ".md"] and again.target_folders == [str(tmp_path)] and again.refresh_minutes() == 60
    assert normalize_folder("C:") == "C:\\" and normalize_folder("/a/b/") == "/a/b"
    (tmp_path / "bad.json").write_text("{")
    assert Settings.load(str(tmp_path / "bad.json")).theme_mode == "System"


@pytest.mark.parametrize("line, k, total, shown", [(3, 1, 2, "3 行目 (1/2)"), (0, 1, 2, "1/2"), (3, 1, 0, None)])
def test_highlight_position(spark, line, k, total, shown):
    assert spark.range(1).select(text.highlight_position(F.lit(line), F.lit(k), F.lit(total))).first()[0] == shown


def test_folders_and_extensions_are_removed():
    settings = Settings(target_folders=["/A/b", "/c"], target_extensions=[".md", ".TXT"])
    assert settings.remove_folder("/a/B/") and not settings.remove_folder("/a/B") and settings.target_folders == ["/c"]
    assert settings.remove_extension(" .txt") and not settings.remove_extension(".exe") and settings.target_extensions == [".md"]
