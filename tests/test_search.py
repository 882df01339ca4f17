import html
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.analysis import tokenize
from folioscan.operators import preview, search, tree
from folioscan.plans.query import Phrase, SearchOptions, parse_query

SCHEMA = "file_path string, file_name string, folder_path string, content string, file_size bigint, last_modified timestamp, last_modified_ticks bigint, file_type string"


def corpus(spark, texts):
    rows = [(f"/d/{name}", name, "/d", content, len(content or ""), None, k, "ファイル") for k, (name, content) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


DOCS = [("than.txt", "More than ever"), ("b.txt", "Thanks, 消費税は 10%です"), ("c.csv", "foo-bar and foo bar"), ("d.txt", None), ("e.txt", "")]


def names(df):
    return [r.file_name for r in df.collect()]


@pytest.mark.parametrize(
    "query, found",
    [("than", ["than.txt", "b.txt"]), ("THAN", ["than.txt", "b.txt"]), ("than 消費税", ["b.txt"]), ("10%", ["b.txt"]), ("", []), ("　", []), ("zzz", []), ("foo-bar", ["c.csv"]), ("th*n", ["than.txt", "b.txt"]), ("m?re", ["than.txt"]), ("more than ever", ["than.txt"]), ("csv", ["c.csv"])],
)
def test_search(spark, query, found):
    assert names(search.search(corpus(spark, DOCS), query)) == found
    assert search.total_hits(corpus(spark, DOCS), query).first()[0] == len(found)


def test_scores(spark):
    got = {r.file_name: r.score for r in search.search(corpus(spark, DOCS), "than").collect()}
    norm = 1 / math.sqrt(1 + 6.25)
    assert got["b.txt"] == pytest.approx(norm * 0.5) and got["than.txt"] == pytest.approx(norm * 3.5)


def test_limits_and_filters(spark):
    docs = corpus(spark, DOCS)
    assert names(search.search(docs, "than", SearchOptions(max_results=1))) == ["than.txt"]
    assert names(search.search(docs, "than", SearchOptions(folder="/x"))) == []
    assert names(search.search(docs, "than", SearchOptions(file_types=["ファイル"]))) == ["than.txt", "b.txt"]
    assert search.matches(docs, search.QueryPlan(())).count() == 5


def brute_phrase(terms, phrase):
    """Starts b where every term i stands at b + i or b + i + 1, on different places, one at least at b + i."""
    n = 0.0
    for base in range(-1, len(terms)):
        spots = [[p for p in (base + i, base + i + 1) if 0 <= p < len(terms) and terms[p] == t] for i, t in enumerate(phrase)]
        if all(spots) and len({p for s in spots for p in s}) >= len(phrase) and any(base + i in s for i, s in enumerate(spots)):
            n += 1.0 if all(base + i in s for i, s in enumerate(spots)) else 0.5
    return n


def test_phrase_against_brute_force(spark):
    rng = random.Random(42)
    texts = [(f"{k}.txt", " ".join(rng.choice("ab,") for _ in range(rng.randint(0, 9)))) for k in range(120)]
    docs = corpus(spark, texts)
    for phrase in (("a", "b"), ("a", ",", "b"), ("a", "a")):
        got = {r.file_path: r.freq for r in search.phrase_frequencies(docs, Phrase(phrase), "unicode").collect()}
        expected = {f"/d/{n}": f for n, t in texts if (f := brute_phrase(tokenize(t), phrase))}
        assert got == expected


def test_and_is_monotone(spark):
    docs = corpus(spark, [(f"{k}.txt", " ".join(c)) for k, c in enumerate(itertools.product(["ab", "bc", "cd"], repeat=2))])
    few, more = ({r.file_path for r in search.search(docs, q).collect()} for q in ("ab bc", "ab"))
    assert few < more


def test_postings_answer_as_scans_do(spark, tmp_path):
    from folioscan.operators.index import Index

    index = Index(spark, str(tmp_path / "i"), buckets=4)
    rng = random.Random(7)
    texts = [(f"{rng.choice(['than', 'doc', 'x-y'])}_{k}.txt", " ".join(rng.choice(["than", "Thanks", "of", "the", "of, the", "消費税"]) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    docs = corpus(spark, texts + [("n.txt", None)]).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    index.upsert(docs)
    for query in ("than", "than the", "of,the", "of,the than", "th?n", "zzz", "", "x-y", "消費税 doc"):
        one, two = ([(r.file_path, round(r.score, 9)) for r in rows.collect()] for rows in (search.search_index(index, query), search.search(docs, query)))
        assert one == two, query
    assert search.search_index(index, "than", SearchOptions(max_results=3)).count() == 3
    # after changes, too: some documents replaced, some gone, in segments and compacted
    changed = docs.where("last_modified_ticks % 5 = 0").withColumn("content", F.concat(F.lit("than anew "), F.coalesce("content", F.lit(""))))
    index.upsert(changed)
    index.delete(docs.where("last_modified_ticks % 7 = 1").select("file_path"))
    now = docs.join(changed.select("file_path"), "file_path", "left_anti").unionByName(changed).where("last_modified_ticks % 7 <> 1")
    for compacted in (False, True):
        if compacted:
            index.compact(2)
        assert len(index.segments()) == (1 if compacted else 3) and index.docs().count() == now.count()
        for query in ("anew", "than the", "of,the than", "th?n"):
            one, two = ([(r.file_path, round(r.score, 9)) for r in rows.collect()] for rows in (search.search_index(index, query), search.search(now, query)))
            assert one == two and one, query


def marked(docs, query):
    return [(r.fragment, r.text[r.highlight_start : r.highlight_end]) for r in search.snippets(docs, query).orderBy("fragment").collect()]


def test_snippets(spark):
    docs = corpus(spark, [("s.txt", "x" * 98 + "than" + "y" * 120 + "THAN" + "z" * 700 + "than")])
    assert marked(docs, "than") == [(0, "than"), (2, "THAN"), (9, "than")]
    assert [len(r.text) for r in search.snippets(docs, "than").orderBy("fragment").collect()] == [102, 100, 30]  # a match that passes the end is whole
    assert search.snippets(docs, "than", SearchOptions(skip_highlights=True)).count() == 0 and search.snippets(docs, "").count() == 0
    many = corpus(spark, [("m.txt", ("a than " + "x" * 93) * 8)])
    assert marked(many, "than") == [(k, "than") for k in range(5)]


def test_snippets_of_phrases_and_wildcards(spark):
    docs = corpus(spark, [("s.txt", "Some of, the rest; roof, the end. " + "-" * 80 + " OF ,\n THE last, of, not the then of,x,the")])
    assert marked(docs, "of,the") == [(0, "of, the"), (1, "OF ,\n THE")]
    assert marked(docs, "of,the rest") == [(0, "of, the"), (1, "OF ,\n THE")]
    assert marked(docs, "r??t") == [(0, "rest")] and marked(docs, "t*n") == [(1, "then")]
    assert marked(corpus(spark, [("t.txt", "of, not the")]), "of,the") == [(0, "of, not the")]  # one term between
    assert marked(corpus(spark, [("t.txt", "x 消費税は 10%です")]), "10%") == [(0, "10%")]


def test_phrases_by_expressions_and_by_places_agree(spark):
    rng = random.Random(11)
    texts = [(f"{k}.txt", "".join(rng.choice(["a", "b", ",", " ", "é", "ab", "\n", ".", "A"]) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    docs = corpus(spark, texts)
    for phrase in (("a", "b"), ("a", ",", "b"), ("é", ".", "ab"), ("ab", "a", "b", ",")):
        got = {r.file_path: (r.freq, r.length) for r in search.phrase_frequencies(docs, Phrase(phrase), "unicode").collect()}
        assert got == {f"/d/{n}": (f, len(tokenize(t))) for n, t in texts if (f := brute_phrase(tokenize(t), phrase))}


def test_scan_and_index_see_the_same_part_of_a_text(spark, tmp_path):
    from folioscan.operators.index import Index

    docs = corpus(spark, [("long.txt", "word " * 104_000 + "beyond"), ("short.txt", "beyond")]).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    index = Index(spark, str(tmp_path / "i"))
    index.upsert(docs)
    assert names(search.search(docs, "beyond")) == names(search.search_index(index, "beyond")) == ["short.txt"]


def test_preview(spark):
    docs = corpus(spark, [("p.txt", "a<b> Mark\r\nnone\ncaf\u00e9 CAFE\u0301 than\n")])
    lines = preview.preview(docs, "mark CAF\u00c9").orderBy("line_no").collect()
    assert [r.has_match for r in lines] == [True, False, True, False]
    assert lines[0].content == "a&lt;b&gt; <mark>Mark</mark>" and lines[1].content == "none"
    plain = preview.preview(docs, "").orderBy("line_no").collect()
    assert [html.unescape(r.content) for r in plain] == ["a<b> Mark", "none", "café CAFÉ than", ""] and not any("<mark>" in r.content for r in plain)
    both = preview.preview(docs, "mark a", compat=False).orderBy("line_no").collect()
    assert both[0].content == "<mark>a</mark>&lt;b&gt; <mark>Mark</mark>"
    nav = preview.highlight_nav(preview.preview(docs, "than mark")).orderBy("line_no").collect()
    assert [(r.line_no, r.next_line, r.prev_line, r.k, r.total) for r in nav] == [(1, 3, 3, 1, 2), (3, 1, 1, 2, 2)]
    ends = preview.highlight_nav(preview.preview(docs, "than mark"), wrap=False).orderBy("line_no").collect()
    assert [(r.next_line, r.prev_line) for r in ends] == [(3, None), (None, 1)]


def test_preview_messages(spark):
    docs = spark.createDataFrame([("/a", None, "boom"), ("/b", None, None), ("/c", "x" * 50001, None)], "file_path string, content string, error string")
    got = {r.file_path: r.content for r in preview.preview(docs, "").where("line_no = 1").collect()}
    assert got["/a"] == "[エラー] boom" and got["/b"] == "[プレビュー不可]" and len(got["/c"]) == 50000
    assert preview.preview(docs, "").where("file_path = '/c'").count() == 2


def test_preview_path(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.docx").write_text("no archive")
    lines = lambda p, q="two": [(r.content, r.has_match) for r in preview.preview_path(spark, p, q).orderBy("line_no").collect()]
    assert lines(str(tmp_path / "a.txt")) == [("one", False), ("<mark>two</mark>", True)]
    assert lines(str(tmp_path / "b.exe"), "") == [("[プレビュー不可]", False)] and lines("") == [("ファイルパスが指定されていません", False)]
    assert lines(str(tmp_path / "c.docx"), "")[0][0].startswith("[エラー] ")


def test_expand_to(spark):
    nodes = spark.createDataFrame([("/r", True), ("/r/Sub", True), ("/r/sub/x.txt", False), ("/r/subway", True)], "full_path string, is_folder boolean")
    open_ = lambda p, f: sorted(r.full_path for r in tree.expand_to(nodes, p, f).where("is_expanded").collect())
    assert open_("/R/sub/x.txt", True) == ["/r", "/r/Sub"] == open_("\\r\\sub\\", False) and open_("/other", False) == []


def test_tree(spark):
    items = corpus(spark, [("x.txt", "1"), ("Y.md", "22")]).withColumn("folder_path", F.lit("/r/sub/deep")).withColumn("file_path", F.concat("folder_path", F.lit("/"), "file_name"))
    nodes = tree.build_tree(items, ["/r", "/other"])
    folders = {r.full_path: r.file_count for r in nodes.where("is_folder").collect()}
    assert folders == {"/r": 2, "/r/sub": 2, "/r/sub/deep": 2}
    assert [r.name for r in tree.sort_tree(nodes).where("parent_path = '/r/sub/deep'").orderBy("place").collect()] == ["x.txt", "Y.md"]
    nav = {r.full_path[-5:]: (r.next_file[-5:], r.prev_file[-5:]) for r in tree.file_nav(tree.flatten_files(nodes, ["/r", "/other"])).collect()}
    assert nav == {"x.txt": ("/Y.md", "/Y.md"), "/Y.md": ("x.txt", "x.txt")}
    assert tree.build_tree(items.limit(0), ["/r"]).count() == 0 and tree.build_tree(items, []).count() == 0
    assert parse_query("x").words
