"""Segments, pinned readers, leases, tiers and cancellation of the index."""

import glob
import math
import random
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscan.functions.analysis import grouped_postings, postings
from folioscan.operators import index, search, segments
from folioscan.plans.query import Infix, SearchOptions

WORDS = ["alpha", "beta", "ab", "abab", "ba", "x", "é", "東京都", "gamma", "alphabet", "tab", "of", ",", "the"]


def docs_of(spark, texts, tick=1):
    return spark.createDataFrame([(f"/{n}", n, "/", t, 1, None, tick, "x", None) for n, t in texts], index.S.DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return [(f"{rng.choice(['of', 'doc', 'x'])}{k}.txt", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for k in range(300)] + [("null", None), ("empty", "")]


@pytest.fixture(scope="module")
def store(spark, texts, tmp_path_factory):
    out = index.Index(spark, str(tmp_path_factory.mktemp("index") / "i"), buckets=4)
    out.upsert(docs_of(spark, texts[:200]))
    out.upsert(docs_of(spark, texts[150:]))
    out.delete(spark.createDataFrame([(f"/{n}",) for n, _ in texts[:9]], "file_path string"))
    return out


def test_groups_hold_the_places_of_postings(spark, texts, monkeypatch):
    docs = docs_of(spark, texts)
    for most in (1 << 20, 50):  # in one go, and some texts at a time
        monkeypatch.setattr("folioscan.functions.analysis.GROUPED_TERMS", most)
        flat = grouped_postings(docs).select("file_path", "field", "term", F.explode("positions").alias("pos"))
        assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, postings(docs).collect()))
    lengths = {r.file_path: r.length for r in grouped_postings(docs).where("field = 'content'").collect()}
    assert lengths["/" + texts[5][0]] == len(texts[5][1].split())


def test_positions_are_written_as_differences(store):
    path = glob.glob(f"{store.segments()[0]['data']}/postings/bucket=0/*.parquet")[0]
    group = pq.ParquetFile(path).metadata.row_group(0)
    column = next(c for c in (group.column(i) for i in range(group.num_columns)) if c.path_in_schema.startswith("positions"))
    assert "DELTA_BINARY_PACKED" in column.encodings


def test_blocks_bound_their_documents(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_DOCS", 8)
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, texts))
    reader = one.at()
    rows = reader.places_of("content", ["alpha"]).join(reader.blocks("content", "alpha").withColumnRenamed("impact", "top"), ["segment", "block"]).collect()
    assert len(rows) == reader.document_counts("content", ["alpha", "none"])["alpha"] and reader.document_counts("content", ["none"]) == {"none": 0}
    assert all(r.freq / r.length <= r.top for r in rows) and len({r.block for r in rows}) >= len(rows) // 8


@pytest.mark.parametrize("pattern", ["alpha", "ab", "東京", "京", "a*ta", "lph?b", "abab", "??"])
def test_terms_by_trigrams(store, pattern):
    whole = store.dictionary().where("field = 'content'").collect()
    regex = segments.wildcard_regex(f"*{pattern}*")
    import re

    expected = sorted((r.term, r.df) for r in whole if re.match(regex, r.term))
    assert sorted((r.term, r.df) for r in store.at().terms_with(Infix(pattern), "content").collect()) == expected


def test_trigrams_prune_buckets(store):
    plan = store.at().terms_with(Infix("alphabet"), "content")._jdf.queryExecution().sparkPlan()
    scans = [n for n in (leaves.apply(i) for leaves in [plan.collectLeaves()] for i in range(leaves.size()))]
    shown = " ".join(n.verboseStringWithOperatorId() for n in scans) or plan.toString()
    assert "PartitionFilters: [" in shown and "bucket" in shown.split("PartitionFilters: [")[1].split("]")[0] and "/dictionary" not in shown



@pytest.mark.parametrize("query", ["of,the x", "ab,ab", "none,such"])
def test_topk_is_the_head_of_the_whole_answer(store, query):
    whole = [(r.file_path, round(r.score, 9)) for r in search.search_index(store, query, SearchOptions(5)).collect()]
    found, told = search.search_topk(store, query, SearchOptions(5), first_blocks=4)
    assert [(r.file_path, round(r.score, 9)) for r in found.collect()] == whole and told["blocks_read"] <= told["blocks"]


def test_topk_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_DOCS", 10)
    monkeypatch.setattr(segments, "LEAST_SLICES", 1)
    rows = [(f"{k:03d}", "of , the " * (1 + k % 3) + "word " * (5 * k)) for k in range(200)] + [("zzz", "word " * 50)]
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, rows))
    whole = [(r.file_path, round(r.score, 9)) for r in search.search_index(one, "of,the", SearchOptions(5)).collect()]
    found, told = search.search_topk(one, "of,the", SearchOptions(5), first_blocks=2)
    assert [(r.file_path, round(r.score, 9)) for r in found.collect()] == whole
    assert told["blocks"] == 20 and told["blocks_read"] == 2 and told["rounds"] == 1


def test_a_query_reads_one_version(spark, tmp_path):
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, [("a", "of the alpha"), ("b", "of, the")]))
    built, reader = search.search_index(one, "alpha"), one.at()
    one.upsert(docs_of(spark, [("a", "no more"), ("c", "alpha")]))
    assert [r.file_path for r in built.collect()] == ["/a"]
    assert [r.file_path for r in search.search_index(reader, "alpha").collect()] == ["/a"] and reader.total() == 2
    assert [r.file_path for r in search.search_index(one.at(1), "alpha").collect()] == ["/a"]
    assert [r.file_path for r in search.search_index(one, "alpha").collect()] == ["/c"]
    with pytest.raises(ValueError):
        one.at(7)


def test_a_lease_holds_its_version(spark, tmp_path):
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, [("a", "alpha")]))
    with one.lease() as reader:
        one.commit(docs_of(spark, [("b", "beta")]))
        assert one.vacuum(keep=1, grace=0) == [1]
        assert [r.file_path for r in reader.docs().collect()] == ["/a"]
    one.vacuum(keep=1, grace=0)
    with pytest.raises(Exception):
        reader.docs().collect()
    with one.lease(seconds=-1) as late:  # a reader that never came back
        one.commit(docs_of(spark, [("c", "gamma")]))
        one.vacuum(keep=1, grace=0)
        with pytest.raises(Exception):
            late.docs().collect()
    assert not list((tmp_path / "i" / "leases").glob("*.json"))


def test_writers_that_fail_leave_nothing(spark, tmp_path, monkeypatch):
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, [("a", "alpha")]))
    before = sorted(p.name for p in (tmp_path / "i" / "data").iterdir())
    monkeypatch.setattr(one, "versions", lambda: [])  # it comes too late for version 1
    with pytest.raises(Exception):
        one.commit(docs_of(spark, [("b", "beta")]))
    monkeypatch.undo()
    assert sorted(p.name for p in (tmp_path / "i" / "data").iterdir()) == before and one.versions() == [1]
    (tmp_path / "i" / "data" / "died").mkdir()
    one.vacuum()
    assert (tmp_path / "i" / "data" / "died").exists()
    one.vacuum(orphans=-1)
    assert sorted(p.name for p in (tmp_path / "i" / "data").iterdir()) == before


def test_tiers_keep_segments_few():
    for one in (lambda k: 1, lambda k: 1 + k % 7, lambda k: 4 ** (k % 6), lambda k: random.Random(k).randint(0, 10**6)):
        sizes = []
        for k in range(1000):
            sizes.append(one(k))
            start = index.merge_from(sizes)
            if start is not None:
                sizes[start:] = [sum(sizes[start:])]
            assert len(sizes) <= 3 * (2 + math.log(sum(sizes) + 1, 4))
            if k == 99 and one(5) == 1:
                assert len(sizes) <= 10


def test_many_updates_leave_few_segments(spark, tmp_path):
    one, now = index.Index(spark, str(tmp_path / "i"), buckets=1), {}
    for k in range(6):
        new = {f"d{k % 4}": f"alpha{k} of", f"e{k}": f"beta {k}"}
        one.upsert(docs_of(spark, list(new.items())))
        now |= new
        if k == 3:
            one.delete(spark.createDataFrame([(f"/e{k}",)], "file_path string"))
            del now[f"e{k}"]
    assert len(one.segments()) <= 4 < len(one.versions())
    assert {r.file_name: r.content for r in one.docs().collect()} == now
    whole = docs_of(spark, list(now.items()))
    assert sorted(map(tuple, one.dictionary().collect())) == sorted(map(tuple, index.dictionary_of(whole).select("field", "term", "df", "cf").collect()))
    assert sorted(map(tuple, one.postings().select("file_path", "field", "term", "pos").collect())) == sorted(map(tuple, postings(whole).collect()))
    assert {r.file_path: r.length for r in one.lengths().collect()} == {f"/{n}": len(t.split()) for n, t in now.items()}


def test_a_cancelled_rebuild_leaves_the_old_version(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for k in range(20):
        (tmp_path / "files" / f"{k}.txt").write_text("slow")
    one = index.Index(spark, str(tmp_path / "i"), buckets=2)
    one.upsert(docs_of(spark, [("a", "alpha")]))
    before = sorted(p.name for p in (tmp_path / "i" / "data").iterdir())
    registry = index.Registry()

    mark = tmp_path / "reading"

    def slow(data: bytes) -> str:
        mark.touch()
        time.sleep(10)
        return data.decode()

    def stop() -> None:
        while not mark.exists():
            time.sleep(0.1)
        one.cancel("mine")

    registry.add([".txt"], slow)
    threading.Thread(target=stop, daemon=True).start()
    with pytest.raises(Exception), one.cancellable("mine"):
        one.rebuild([str(tmp_path / "files")], registry=registry)
    assert one.versions() == [1]
    assert sorted(p.name for p in (tmp_path / "i" / "data").iterdir()) == before
    assert one.docs().count() == 1  # later jobs run
