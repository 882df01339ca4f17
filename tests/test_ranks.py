"""Numbers and running totals do not depend on how groups are dealt."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscan.operators import ranks, tree
from folioscan.operators.ranks import ranked, running
from folioscan.sources.shared import new_path


@pytest.fixture
def rows(spark):
    rng = random.Random(2)
    groups = ["big"] * 900 + [None] * 40 + [f"g{i}" for i in range(20) for _ in range(rng.randint(1, 9))]
    return spark.createDataFrame([(g, rng.randint(0, 10_000), i) for i, g in enumerate(groups)], "g string, v int, id int")


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_ranked(rows, most):
    found = ranked(rows, ["g"], [F.desc("v"), F.col("id")], "n", group_rows=most).collect()
    assert len(found) == rows.count()
    by = {}
    for r in sorted(found, key=lambda r: (-r["v"], r["id"])):
        by[r["g"]] = by.get(r["g"], 0) + 1
        assert r["n"] == by[r["g"]]


def test_a_large_group_is_spread(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "new_path", lambda *a: written.append(new_path(*a)) or written[-1])
    ranked(rows, ["g"], [F.desc("v"), F.col("id")], "n", group_rows=5)
    parts = [r["count"] for r in spark.read.parquet(written[0]).where("g = 'big'").groupBy(F.shiftright("_at", ranks.PART_BITS)).count().collect()]
    assert sum(parts) == 900 and len(parts) > 1 and max(parts) <= 600


def test_ranked_without_rows(rows):
    assert ranked(rows.limit(0), ["g"], [F.col("v")]).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_running(spark, block):
    rng = random.Random(3)
    data = [(g, p, rng.getrandbits(60), rng.randint(0, 9)) for g, n in (("a", 100), ("b", 1), ("c", 7), ("d", 8)) for p in range(n)]
    df = spark.createDataFrame(data, "g string, p int, x bigint, y bigint")
    found = running(df, "g", "p", {"xs": (F.col("x"), F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "ys": (F.col("y"), F.sum, lambda a, b: a + b)}, 99, block)
    want, at = [], {}
    for g, p, x, y in data:
        xs, ys = at.get(g, (0, 0))
        at[g] = (xs ^ x, ys + y)
        want.append((g, p, x, y, *at[g]))
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("sort, ascending", [("name", True), ("date", True), ("date", False), ("size", False), ("type", True)])
def test_listings_of_large_folders_are_the_same(spark, sort, ascending):
    rng = random.Random(4)
    rows = [("/r" if k % 9 else "/s", f"{rng.choice('abc')}{k}.{rng.choice(['txt', 'md'])}", k % 7 == 0, None if k % 5 == 0 else datetime(2024, 1, 1 + k % 9), rng.randint(0, 9), f"/r/{k:03d}") for k in range(300)]
    nodes = spark.createDataFrame(rows, "parent_path string, name string, is_folder boolean, last_modified timestamp, file_size bigint, full_path string")
    small, large = (sorted((r.full_path, r.place) for r in tree.list_items(nodes, sort, ascending, group_rows=n).collect()) for n in (1 << 20, 10))
    assert small == large and len({p for _, p in large}) == max(p for _, p in large)


def test_trees_with_many_siblings_are_the_same(spark):
    nodes = spark.createDataFrame([("/t", "/p" if k % 4 else None, k % 3 == 0, f"n{k * 7 % 50}", f"/p/{k}") for k in range(200)], "target string, parent_path string, is_folder boolean, name string, full_path string")
    small, large = (sorted((r.full_path, r.place) for r in tree.sort_tree(nodes, group_rows=n).collect()) for n in (1 << 20, 10))
    assert small == large
