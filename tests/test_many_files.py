"""Scans of many small files, files that a session makes, and decks of many slides."""

import zipfile

from folioscan.plans import catalogue
from folioscan.sources import extractors, files, samples


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for k in range(1200):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    monkeypatch.setattr(files, "LEAST_TASKS", 1, raising=False)
    found = files.scan(spark, [f"file://{tmp_path}"])
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < 1200 / 32
    assert sorted(r.content for r in files.extract(found).collect()) == sorted(f"text {k}" for k in range(1200))
    monkeypatch.setattr(files, "TASK_BYTES", 1, raising=False)  # large files keep their tasks
    assert files.scan(spark, [f"file://{tmp_path}"]).rdd.getNumPartitions() >= 1200 // 32


def test_rows_of_one_row_group_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "ROWS_A_TASK", 10, raising=False)
    docs = spark.range(95).selectExpr("id as doc_id", "concat('a ', id) as text").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spread = catalogue._spread(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert spread.rdd.getNumPartitions() == 10 and spread.count() == 95


def test_only_files_of_the_kind_are_made(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_office", {})
    assert catalogue.QUERIES["extract_txt"](spark, "/root/testdata/sf0.001").where("not failed").count() == 200
    root = next(iter(catalogue._office.values())).removeprefix("file://")
    assert [p.name for p in __import__("pathlib").Path(root).iterdir()] == ["txt"]


def test_a_deck_is_read_without_its_list_of_names_for_each_slide(monkeypatch):
    data, asked = samples.pptx([[f"slide {k}"] for k in range(50)]), []
    names = zipfile.ZipFile.namelist
    monkeypatch.setattr(zipfile.ZipFile, "namelist", lambda self: asked.append(1) or names(self))
    assert extractors.extract_pptx(data) == "".join(f"slide {k}\n\n" for k in range(50)) and len(asked) <= 1


def test_an_update_knows_files_under_a_root_with_slashes(spark, tmp_path):
    from folioscan.operators import index

    (tmp_path / "files").mkdir()
    for k in range(3):
        (tmp_path / "files" / f"{k}.txt").write_text(f"text {k}")
    store = index.Index(spark, str(tmp_path / "i"), buckets=2)
    store.update([f"file://{tmp_path}/files"])  # three slashes, where listings have one
    (tmp_path / "files" / "0.txt").unlink()
    done = store.update([f"file://{tmp_path}/files"])
    assert (done["add"], done["update"], done["delete"]) == (0, 0, 1)
    assert sorted(r.content for r in store.docs().collect()) == ["text 1", "text 2"]


def test_empty_files_are_documents(spark, tmp_path):
    from folioscan.operators import index

    (tmp_path / "files" / "sub").mkdir(parents=True)
    for name, data in {"a.txt": "", "sub/b.md": "", "c.txt": "text", "$bin.txt": "", "noext": ""}.items():
        (tmp_path / "files" / name).write_text(data)
    root, store = f"file://{tmp_path}/files", index.Index(spark, str(tmp_path / "i"), buckets=2)
    assert sorted((r.path.rpartition("/")[2], r.content) for r in files.scan(spark, [root]).collect()) == [("$bin.txt", b""), ("a.txt", b""), ("b.md", b""), ("c.txt", b"text")]
    store.update([root])
    found = lambda: sorted((r.file_name, r.content) for r in store.docs().collect())
    assert found() == [("$bin.txt", ""), ("a.txt", ""), ("b.md", ""), ("c.txt", "text")]
    (tmp_path / "files" / "a.txt").unlink()
    (tmp_path / "files" / "sub" / "d.txt").write_text("")
    done = store.update([root])
    assert (done["add"], done["update"], done["delete"], done["files"]) == (1, 0, 1, 1)
    assert found() == [("$bin.txt", ""), ("b.md", ""), ("c.txt", "text"), ("d.txt", "")]


def test_an_updated_index_has_empty_documents(spark, tmp_path, monkeypatch):
    import duckdb

    monkeypatch.setattr(catalogue, "_updates", {})
    rows = spark.range(80).selectExpr("id as doc_id", "concat('src', id % 3) as source", "if(id % 4 = 0, '', if(id % 4 = 1, null, concat('text ', id))) as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("index_updated_files", "index_update_report"):
        ours = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
        assert ours == sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall())


def test_an_error_of_the_driver_leaves_no_folder_out(spark, tmp_path, monkeypatch):
    import pytest
    from py4j.protocol import Py4JJavaError

    def full(spark, path, deep):
        raise Py4JJavaError("full", spark._jvm.java.lang.RuntimeException("listing", spark._jvm.java.lang.OutOfMemoryError("heap")))

    (tmp_path / "a.txt").write_text("text")
    monkeypatch.setattr(files, "_load", full)
    with pytest.raises(Py4JJavaError):
        files.scan(spark, [f"file://{tmp_path}"])


def test_an_index_of_files_leaves_the_listing_to_tasks(spark, tmp_path, monkeypatch):
    from folioscan.operators import index

    for k in range(4):
        (tmp_path / "files" / f"s{k % 2}" / "Windows").mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / f"s{k % 2}" / f"{k}.txt").write_text(f"text {k}")
        (tmp_path / "files" / f"s{k % 2}" / "Windows" / "x.txt").write_text("x")
    root = f"file://{tmp_path}/files"
    plain = [tuple(r) for r in files.scan(spark, [root]).drop("content").orderBy("path").collect()]
    assert len(plain) == 4 and [tuple(r) for r in files.listed(spark, [root]).orderBy("path").collect()] == plain
    monkeypatch.setattr(files, "_load", None)  # it holds all files in the driver
    store = index.Index(spark, str(tmp_path / "i"), buckets=1)
    assert store.rebuild([root])["files"] == 4
    assert store.update([root])["files"] == 0
    assert store.index_folder(f"{root}/s1")["files"] == 2
    assert sorted(r.content for r in store.docs().collect()) == [f"text {k}" for k in range(4)]
