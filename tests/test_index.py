import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscan.operators import index
from folioscan.sources import extractors, samples
from folioscan.sources.files import extract, scan
from folioscan.streaming.refresh import apply_changes, keep_latest, latest_kept, start_refresh


def test_extractors():
    assert extractors.extract_docx(samples.docx(samples.PARAGRAPHS, ["表"])).splitlines() == [p for p in samples.PARAGRAPHS if p]
    assert "表" in extractors.extract_docx(samples.docx(["a"], ["表"]), include_tables=True)
    for shared in (False, True):
        assert extractors.extract_xlsx(samples.xlsx([samples.ROWS, [("x",)]], shared)) == "項目\t金額\t消費税\n商品A\t1000\t100\n商品B\t2000\t200\n\nx\n\n"
    assert extractors.extract_xlsx(samples.xlsx([samples.ROWS]), compat=True) == "1000\t100\n2000\t200\n\n"
    assert extractors.extract_pptx(samples.pptx([["a", " ", "b"], ["c"]])) == "a\nb\n\nc\n\n"
    assert extractors.decode_text("消費税".encode("utf-16")) == "消費税" and extractors.decode_text(b"\xef\xbb\xbfx") == "x" and extractors.decode_text(b"") == ""
    with pytest.raises(ValueError):
        extractors.extract_text(b"x" * (10 * 1024 * 1024 + 1))
    registry = extractors.default_registry()
    assert registry.get(".TXT") and registry.get(".exe") is None and ".pdf" in registry.extensions()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "$bin").mkdir()
    (root / "Windows").mkdir()
    for name, data in {"a.txt": b"alpha", "sub/b.md": b"beta gamma", "c.exe": b"x", "noext": b"x", "$bin/d.txt": b"x", "Windows/e.txt": b"x", "bad.docx": b"no archive", "w.docx": samples.docx(["消費税"])}.items():
        (root / name).write_bytes(data)
    return root


def short(rows):
    return sorted(os.path.basename(r[0]) for r in rows)


def test_scan_and_extract(spark, folder):
    files = scan(spark, [str(folder), "/no/such/folder"])
    assert short(files.select("path").collect()) == ["a.txt", "b.md", "bad.docx", "w.docx"]
    assert "content" not in files.select("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    found = {os.path.basename(r.file_path): r for r in extract(files).collect()}
    assert found["a.txt"].content == "alpha" and found["w.docx"].content == "消費税\n" and found["bad.docx"].error and found["bad.docx"].content is None
    assert short(scan(spark, [str(folder)], [".MD"]).select("path").collect()) == ["b.md"]
    assert scan(spark, ["/no/such/folder"]).count() == 0


def test_unreadable_folders_are_skipped(spark, folder, monkeypatch):
    from py4j.protocol import Py4JJavaError

    from folioscan.sources import files as f

    load, children = f._load, f._children

    def denied(spark, path, deep):
        if deep:
            raise Py4JJavaError("denied", spark._jvm.java.io.IOException("denied"))
        return load(spark, path, deep)

    def refuse(fs, path):
        if path.getName() == "sub":
            raise Py4JJavaError("denied", spark._jvm.java.io.IOException("denied"))
        assert path.getName() not in ("$bin", "Windows")  # not even listed
        return children(fs, path)

    monkeypatch.setattr(f, "_load", denied)
    assert short(scan(spark, [str(folder)]).select("path").collect()) == ["a.txt", "b.md", "bad.docx", "w.docx"]
    monkeypatch.setattr(f, "_children", refuse)
    assert short(scan(spark, [str(folder)]).select("path").collect()) == ["a.txt", "bad.docx", "w.docx"]


def test_progress_is_told(spark, folder, tmp_path):
    told = []
    index.Index(spark, str(tmp_path / "i")).rebuild([str(folder)], progress=told.append)
    assert told and told[-1]["processed"] == told[-1]["total"] and all(0 <= x["percent"] <= 100 for x in told)


def test_morphemes_fall_back_to_whole_texts(spark):
    from folioscan.functions import analysis

    if "sudachipy" not in __import__("sys").modules:
        docs = spark.createDataFrame([("消費税 Is Due",), ("  ",), (None,)], "t string")
        assert [r.t for r in docs.select(analysis.tokens(F.col("t"), "morph").alias("t")).collect()] == [["消費税 is due"], [], []]
        assert analysis.tokenize("消費税", "morph") == ["消費税"]


def test_update_equals_rebuild(spark, folder, tmp_path):
    one = index.Index(spark, str(tmp_path / "one"))
    assert one.docs().count() == 0
    assert one.update([str(folder)])["errors"] == 1  # no version yet: all of it
    (folder / "a.txt").write_text("alpha two")
    os.utime(folder / "a.txt", (1, 1))
    (folder / "sub" / "b.md").unlink()
    (folder / "n.log").write_text("new")
    done = one.update([str(folder)])
    assert (done["add"], done["update"], done["delete"]) == (2, 1, 1)  # the broken file is tried again
    two = index.Index(spark, str(tmp_path / "two"))
    two.rebuild([str(folder)])
    text = lambda i: sorted((r.file_path, r.content) for r in i.docs().collect())
    assert text(one) == text(two)
    terms = lambda i: sorted(map(tuple, i.postings().select("field", "term", "pos").collect()))
    assert terms(one) == terms(two)
    words = lambda i: sorted(map(tuple, i.dictionary().select("field", "term", "df", "cf").collect()))
    assert words(one) == words(two)
    assert one.stats().first().document_count == 3


def test_unreachable_root_keeps_entries(spark, folder, tmp_path):
    one = index.Index(spark, str(tmp_path / "one"))
    one.rebuild([str(folder)])
    os.rename(folder, str(folder) + "-gone")
    assert one.update([str(folder)])["delete"] == 0
    assert one.update([str(folder)], compat=True)["delete"] == 3


def test_snapshots(spark, tmp_path):
    store = index.Index(spark, str(tmp_path / "i"))
    rows = lambda *texts: spark.createDataFrame([(f"/{t}", t, "/", t, 1, None, 1, "x", None) for t in texts], index.S.DOCS)
    store.upsert(rows("a", "b"))
    store.upsert(rows("b", "c"))
    store.delete(spark.createDataFrame([("/a",)], "file_path string"))
    assert sorted(r.content for r in store.docs().collect()) == ["b", "c"]
    assert sorted(r.term for r in store.postings().where("field = 'content'").collect()) == ["b", "c"]
    data = store._entry()["data"]
    # a writer that dies before its version file leaves the old version in force
    rows("z").write.parquet(f"{store.root}/data/v=99-dead/docs")
    assert sorted(r.content for r in store.docs().collect()) == ["b", "c"] and store._entry()["data"] == data
    with pytest.raises(Exception):
        store._publish(store.versions()[-1], {"data": "other"})
    store.compact(1)
    assert store.vacuum(keep=1) == [1, 2, 3] and store.docs().count() == 2


def test_updates_write_what_has_changed(spark, tmp_path):
    store = index.Index(spark, str(tmp_path / "i"))
    rows = lambda *texts: spark.createDataFrame([(f"/{t[0]}", t, "/", t, 1, None, 1, "x", None) for t in texts], index.S.DOCS)
    store.upsert(rows("a x", "b x y", "c z"))
    store.upsert(rows("b y", "d x"))
    assert sorted(r.content for r in spark.read.parquet(store.segments()[1]["data"] + "/docs").collect()) == ["b y", "d x"]
    words = lambda: {r.term: (r.df, r.cf) for r in store.dictionary().where("field = 'content'").collect()}
    expected = {"a": (1, 1), "b": (1, 1), "c": (1, 1), "d": (1, 1), "x": (2, 2), "y": (1, 1), "z": (1, 1)}
    assert words() == expected and {r.file_path: r.length for r in store.lengths().collect()} == {"/a": 2, "/b": 2, "/c": 2, "/d": 2}
    store.delete(spark.createDataFrame([("/c",), ("/none",)], "file_path string"))
    del expected["c"], expected["z"]
    assert words() == expected
    store.compact(1)
    assert words() == expected and len(store.segments()) == 1
    store.upsert(rows("c again"))  # what was deleted comes back
    assert words() == expected | {"c": (1, 1), "again": (1, 1)} and store.stats().first().document_count == 4


def test_vacuum_waits_for_readers(spark, tmp_path):
    store = index.Index(spark, str(tmp_path / "i"))
    rows = lambda *texts: spark.createDataFrame([(f"/{t}", t, "/", t, 1, None, 1, "x", None) for t in texts], index.S.DOCS)
    store.upsert(rows("a", "b"))
    reader = store.docs()
    store.upsert(rows("c"))
    store.compact(1)
    assert store.vacuum(keep=1) == [1, 2] and reader.count() == 2  # a query that began before goes on
    assert store.vacuum(keep=1, grace=0) == [] and store.docs().count() == 3
    assert len(list((tmp_path / "i" / "data").iterdir())) == 1
    with pytest.raises(Exception):
        reader.count()


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_BYTES", 100)
    store = index.Index(spark, str(tmp_path / "i"), buckets=2)
    rows = lambda n: spark.createDataFrame([(f"/{k}", f"{k}", "/", "word " * 20, 1, None, 1, "x", None) for k in range(n)], index.S.DOCS)
    store.upsert(rows(20))
    store.upsert(rows(1))
    assert [x["buckets"] for x in store.segments()] == [20, 2]
    assert store.postings(spark.createDataFrame([("content", "word")], "field string, term string")).groupBy("file_path").count().count() == 20


def test_diff_ignores_case_and_borders(spark):
    side = lambda *xs: spark.createDataFrame(list(xs), "file_path string, last_modified_ticks bigint")
    got = index.diff(side(("/A/x", 1), ("/ab/y", 1), ("/a/z", 2)), side(("/a/X", 1), ("/a/Z", 1), ("/a/new", 1)), ["/a"])
    assert sorted(map(tuple, got.collect())) == [("add", "/a/new"), ("update", "/a/Z")]


def test_upsert_takes_the_last(spark):
    side = lambda *xs: spark.createDataFrame(list(xs), "file_path string, last_modified_ticks bigint")
    assert sorted(map(tuple, index.upsert(side(("/a", 1)), side(("/a", 2), ("/a", 3), ("/b", 1))).collect())) == [("/a", 3), ("/b", 1)]
    assert [r[0] for r in index.purge_unlisted(side(("/a/x", 1), ("/b/y", 1)), ["/a"]).collect()] == ["/a/x"]


def test_change_feed(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    feed, target, mark = (str(tmp_path / x) for x in ("feed", "target", "mark"))
    for part in (events.where("event_id < 400"), events.where("event_id >= 400")):
        part.coalesce(1).write.mode("append").parquet(feed)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
        apply_changes(spark, feed, schema, mark, target).awaitTermination()
    got = spark.read.parquet(f"{target}/1").select("file_path", "last_modified_ticks").collect()
    expected = index.latest_changes(events).select("user_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_kept_changes_of_late_and_repeated_events(spark, tmp_path):
    feed, target, mark = (str(tmp_path / x) for x in ("feed", "target", "mark"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    row = lambda e, minute, user, kind: (e, datetime(2024, 1, 1, 0, minute), user, kind, float(e), None)
    files = [[row(1, 5, 1, "click"), row(2, 1, 2, "signup")], [row(3, 4, 1, "error"), row(2, 1, 2, "signup")], [row(4, 9, 2, "error"), row(5, 5, 1, "view"), row(6, 0, None, "signup")], [row(1, 5, 1, "click")]]
    got = []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        keep_latest(spark, feed, schema, mark, target, files=1).awaitTermination()
        got.append(sorted(((r.user_id, r.event_id, r.op) for r in latest_kept(spark, target).collect()), key=repr))
    assert got == [[(1, 1, "modify"), (2, 2, "create")], [(1, 1, "modify"), (2, 2, "create")], [(1, 5, "modify"), (2, 4, "delete"), (None, 6, "create")], [(1, 5, "modify"), (2, 4, "delete"), (None, 6, "create")]]
    # a batch writes the keys that it has, not all
    assert {r.user_id for r in spark.read.parquet(f"{target}/batch=3").collect()} == {1}


def test_refresh(spark, folder, tmp_path):
    store = index.Index(spark, str(tmp_path / "i"))
    query = start_refresh(store, [str(folder)], 0.02, str(tmp_path / "mark"))
    try:
        for _ in range(120):
            if store.versions():
                break
            time.sleep(0.5)
        assert store.docs().where(F.col("content") == "alpha").count() == 1
    finally:
        query.stop()
    with pytest.raises(ValueError):
        start_refresh(store, [], 0, "")
