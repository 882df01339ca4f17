"""What of an index's work grows with its texts, and what is left out."""

import glob

import pytest

from folioscan.operators import index, segments
from folioscan.plans import catalogue
from folioscan.schema import DOCS


def docs_of(spark, texts):
    return spark.createDataFrame([(f"/{n}", n, "/", t, 1, None, 1, "x", None) for n, t in texts], DOCS)


def test_slices_grow_with_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_BYTES", 100, raising=False)
    docs = docs_of(spark, [(f"d{k}.txt", " ".join(f"w{k % 7} x{k}" for _ in range(9))) for k in range(200)])
    store = index.Index(spark, str(tmp_path / "i"), buckets=2)
    store.commit(docs)
    bytes_of_texts = store.segments()[0]["size"]
    files = glob.glob(f"{store.segments()[0]['data']}/postings/bucket=0/*.parquet")
    assert len(files) > bytes_of_texts / 2 / 100 / 2  # a file for most slices, where four were made
    assert {r.term: r.df for r in store.dictionary().where("field = 'content' and term like 'w%'").collect()} == {f"w{k}": len(range(k, 200, 7)) for k in range(7)}
    assert store.lengths().where("length = 18").count() == 200


def test_an_unchanged_index_makes_no_other(spark, monkeypatch):
    made = []

    class Counted(index.Index):
        def __init__(self, *args, **options):
            made.append(1)
            super().__init__(*args, **options)

    monkeypatch.setattr(index, "Index", Counted)
    monkeypatch.setattr(catalogue, "_indexes", {})
    catalogue._built(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_compacting_analyses_and_joins_nothing(spark, tmp_path, monkeypatch):
    store = index.Index(spark, str(tmp_path / "i"), buckets=2)
    store.upsert(docs_of(spark, [("a", "one two"), ("b", "two two"), ("c", None)]))
    store.upsert(docs_of(spark, [("b", "three")]))
    store.delete(spark.createDataFrame([("/a",)], "file_path string"))
    before = sorted(map(tuple, store.dictionary().collect())), sorted(map(tuple, store.postings().collect()), key=str)
    monkeypatch.setattr(index, "grouped_postings", lambda *a, **k: pytest.fail("texts are analysed again"))
    store.compact(2)
    assert len(store.segments()) == 1 and store.docs().count() == 2
    assert (sorted(map(tuple, store.dictionary().collect())), sorted(map(tuple, store.postings().collect()), key=str)) == before


def test_blocks_are_cut_without_gathering_a_terms_rows(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from folioscan.functions.analysis import grouped_postings
    from folioscan.operators import segments

    monkeypatch.setattr(segments, "BLOCK_DOCS", 8)
    monkeypatch.setattr(segments, "LEAST_SLICES", 1)
    docs = spark.range(100).selectExpr("concat('/f/', id, '.txt') as file_path", "concat(id, '.txt') as file_name", "concat('a b c', repeat(' d', cast(id % 9 as int))) as content")
    segments.write_postings(grouped_postings(docs), f"{tmp_path}/p", 1, 100)
    rows = spark.read.schema(segments.POSTINGS).parquet(f"{tmp_path}/p")
    got = segments.blocks_of(rows).collect()
    assert max(r.n for r in got) == 8 and sum(r.n for r in got) == rows.count() == grouped_postings(docs).count()
    assert len({r.block for r in got}) == -(-rows.count() // 8)  # blocks are numbered through, not by term
    tops = rows.groupBy("field", "term", "block").agg(F.max(segments.impact()).alias("top"), F.min(segments.impact()).alias("low")).orderBy("field", "term", "block").collect()
    assert all((a.field, a.term) != (b.field, b.term) or a.low >= b.top for a, b in zip(tops, tops[1:]))


def test_a_folder_over_all_that_is_there_leaves_one_segment(spark, tmp_path, monkeypatch):
    from folioscan.operators import index

    (tmp_path / "f" / "a").mkdir(parents=True)
    for k in range(6):
        (tmp_path / "f" / ("a" if k < 3 else "") / f"{k}.txt").write_text(f"text {k}")
    store = index.Index(spark, str(tmp_path / "i"), buckets=2)
    monkeypatch.setattr(index, "upsert", None)  # a scan has each path once
    store.index_folder(f"file://{tmp_path}/f/a")
    store.index_folder(f"file://{tmp_path}/f")
    assert [x["documents"] for x in store.segments()] == [6] and not store.segments()[0]["dead"]
    assert sorted(r.content for r in store.docs().collect()) == [f"text {k}" for k in range(6)]
    assert {r.term: r.df for r in store.dictionary().where("field = 'content'").collect()} == {"text": 6, **{str(k): 1 for k in range(6)}}
    store.index_folder(f"file://{tmp_path}/f/a")  # this takes a part out, as before
    assert len(store.segments()) == 2 and store.docs().count() == 6
    assert {r.term: r.df for r in store.dictionary().where("field = 'content'").collect()} == {"text": 6, **{str(k): 1 for k in range(6)}}


def test_postings_move_as_lists_and_come_back_the_same(spark):
    from pyspark.sql import functions as F

    from folioscan.functions import analysis

    rows = [(f"/a/{k}.txt", f"{k}.txt", None if k % 5 == 0 else " ".join(f"w{j % (k + 1)} é日{j}" for j in range(k))) for k in range(60)]
    docs = spark.createDataFrame([*rows, ("/a/3.txt", "3.txt", "dup dup"), (None, "n.txt", "no path")], "file_path string, file_name string, content string").repartition(3)
    plain = sorted(str(tuple(r)) for r in analysis.grouped_postings(docs).collect())
    dealt = analysis.dealt_postings(docs, 5, 3)
    assert sorted(str(tuple(r)) for r in dealt.drop("part").collect()) == plain and dealt.rdd.getNumPartitions() == 15
    assert dealt.where(F.floor(F.col("part") / 3) != segments.bucket_of(F.col("term"), 5)).count() == 0
    assert dealt.select("part", F.spark_partition_id().alias("task")).distinct().groupBy("part").count().where("count > 1").count() == 0
    assert analysis.dealt_postings(docs.where("false"), 5, 3).count() == 0


def test_an_index_moves_no_texts_and_leaves_no_shuffles(spark, monkeypatch):
    set_to, plain = [], segments.write_postings
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(catalogue, "_indexes", {})
    monkeypatch.setattr(index, "upsert", None)  # it moves them to find a path's last
    monkeypatch.setattr(index, "write_postings", lambda *a: set_to.append((spark.conf.get(name), a[0])) or plain(*a))
    store = catalogue._built(spark, "/root/testdata/sf0.001")
    assert set_to == [("true", None)] and spark.conf.get(name, None) == before
    assert store.docs().count() == 200
