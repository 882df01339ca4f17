import os
import random

import pytest

from folioscan.operators import segments
from folioscan.operators.folders import differing, digests, root_keys
from folioscan.operators.index import Index
from folioscan.operators.segments import Reader


def sums(df):
    return {r.folder: tuple(r)[1:] for r in df.collect() if any(tuple(r)[2:])}


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, last_modified_ticks bigint")


def test_digests_add_up(spark):
    rows = [("/r/a/x.txt", 1), ("/r/a/y.txt", 2), ("file:/r/B/c/z.txt", 3), ("/top.txt", None), ("C:\\d\\e.txt", 5)]
    one, two = digests(files(spark, rows)), digests(files(spark, rows[1:2]), -1)
    both = one.unionByName(two).groupBy("folder", "parent").agg(*[segments.F.sum(c).alias(c) if c in ("below", "own") else segments.F.bit_xor(c).alias(c) for c in segments.FOLDERS[2:]])
    assert sums(both.select(*segments.FOLDERS)) == sums(digests(files(spark, rows[:1] + rows[2:])))
    found = {r.folder: (r.parent, r.below, r.own) for r in one.collect()}
    assert found == {"": (None, 4, 1), "/r": ("", 3, 0), "/r/a": ("/r", 2, 2), "/r/b": ("/r", 1, 0), "/r/b/c": ("/r/b", 1, 1), "c:": (None, 1, 0), "c:/d": ("c:", 1, 1)}
    assert digests(files(spark, [])).count() == 0 and digests(files(spark, [(None, 1)])).count() == 0


def test_root_keys():
    assert set(root_keys(["/A/b/", "file:///a", "/c", "/ab"])) == {"/a", "/c", "/ab"}
    assert root_keys(["/", "/x"]) == [""] and root_keys([]) == []


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "files"
    for k in range(40):
        folder = root / f"d{k % 5}" / f"e{k % 15}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.txt").write_text(f"word{k} all")
        os.utime(folder / f"f{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    return root


def entries_read(monkeypatch):
    """The folders of all entries that are read from here on."""
    read, plain = set(), Reader._slotted

    def told(self, part, schema, slots):
        out = plain(self, part, schema, slots)
        if part == "entries":
            read.update(os.path.basename(r.folder) for r in out.select("folder").distinct().collect())
        return out

    monkeypatch.setattr(Reader, "_slotted", told)
    return read


def test_updates_read_only_folders_that_differ(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLOT_DOCS", 4)
    index = Index(spark, str(tmp_path / "index"))
    index.update([str(tree)])
    read = entries_read(monkeypatch)
    assert index.update([str(tree)])["version"] == 1 and not read
    (tree / "d1" / "e1" / "f1.txt").write_text("changed")
    (tree / "d2" / "e7" / "f7.txt").unlink()
    done = index.update([str(tree)])
    assert (done["add"], done["update"], done["delete"]) == (0, 1, 1)
    # of the 15 folders only those are read that share a slot with the two
    slots = {r.folder: r.slot for r in spark.range(15).selectExpr("concat('e', id) as name", f"concat(lower('{tree}'), '/d', id % 5, '/e', id) as folder").withColumn("slot", segments.slot_of(segments.F.col("folder"), index.segments()[0]["slots"])).collect()}
    wanted = {s for f, s in slots.items() if os.path.basename(f) in ("e1", "e7")}
    assert read == {os.path.basename(f) for f, s in slots.items() if s in wanted} and len(read) < 15


def test_updates_equal_whole_comparisons(spark, tree, tmp_path):
    rng, index = random.Random(5), Index(spark, str(tmp_path / "index"))
    index.update([str(tree)])
    for step in range(3):
        paths = sorted(tree.rglob("*.txt"))
        for path in rng.sample(paths, 4):
            path.unlink() if rng.random() < 0.5 else os.utime(path, (1_800_000_000 + step, 1_800_000_000 + step))
        new = tree / f"n{step % 2}" / f"m{step}"
        new.mkdir(parents=True)
        (new / "x.txt").write_text(f"new{step}")
        index.update([str(tree)])
        on_disk = {(str(p), p.stat().st_mtime) for p in tree.rglob("*.txt")}
        docs = index.docs().selectExpr("replace(file_path, 'file:', '') as p", "last_modified").collect()
        assert {r.p for r in docs} == {p for p, _ in on_disk}
        # the segments' digests together are those of the documents
        assert sums(index.at().folders()) == sums(digests(index.docs()))
    assert any(x["slots"] for x in index.segments()) and index.update([str(tree)])["files"] == 0


def test_other_names_are_compared_whole(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.update([str(tree)])
    rows = digests(files(spark, [("hdfs://host/a/x.txt", 1)]))
    assert differing(index.at(), rows, ["hdfs:///a"], lambda x: x) is None
    assert differing(Reader(spark, 0, [], "unicode"), rows, ["hdfs://host/a"], lambda x: x) is None
    assert {r.folder for r in differing(index.at(), rows, ["hdfs://host/a"], lambda x: x).collect()} == {"hdfs://host/a"}


def test_indexes_without_digests_still_update(spark, tree, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "index"))
    plain = Index._put
    monkeypatch.setattr(Index, "_put", lambda self, name, entry, overwrite=False: plain(self, name, {k: [{n: y for n, y in x.items() if n != "slots"} for x in v] if k == "segments" else v for k, v in entry.items()}, overwrite))
    index.update([str(tree)])
    monkeypatch.undo()
    assert not index.at().has_folders()
    (tree / "d0" / "e0" / "f0.txt").unlink()
    assert index.update([str(tree)])["delete"] == 1 and index.docs().count() == 39
    assert index.update([str(tree)])["files"] == 0
    index.compact()
    assert index.at().has_folders() and index.update([str(tree)])["files"] == 0
