"""Sharding of rows that repeat, and of ids that are no numbers; quotas of many blocks."""

import pytest

from folioscan.llm import mixing, sharding
from folioscan.llm.mixing import mix_summary, split_quotas
from folioscan.llm.sharding import kd_shards


@pytest.mark.parametrize("doc_id", ["7", None, "no number"])
def test_repeated_rows_are_dealt_evenly(spark, doc_id):
    kind = "bigint" if doc_id != "no number" else "string"
    rows = spark.createDataFrame([(doc_id if kind == "string" or doc_id is None else int(doc_id), "one text")] * 1000, f"doc_id {kind}, text string")
    found = kd_shards(rows, leaves=4).collect()
    counts = [sum(r["shard"] == s for r in found) for s in range(4)]
    assert len(found) == 1000 and max(counts) - min(counts) <= 2
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))


def test_blocks_follow_what_a_draw_can_tell(spark, monkeypatch):
    quotas = split_quotas([56_250] * 16_000, 2, seed=3)  # 900 million blocks
    assert quotas.sum() == 900_000_000 and abs(int(quotas[0].sum()) - int(quotas[1].sum())) <= 1 and (quotas >= 0).all()
    docs = spark.createDataFrame([(k, "word " * (1 + k % 5), f"s{k % 8}") for k in range(800)], "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MOST_DRAWN", 32)  # two blocks a source
    taken = {}
    for r in mix_summary(docs, block_docs=4).collect():
        got = taken.setdefault(r["doc_id"] % 8, [0, r["target"]])
        got[0] += r["taken"]
    assert all(abs(got - target) < 5 for got, target in taken.values())  # less than a document


def test_levels_of_many_nodes_take_turns(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 90), f"s{k % 3}") for k in range(150)], "doc_id bigint, text string, source string")
    whole = sorted(kd_shards(docs, leaves=6).collect())
    monkeypatch.setattr(sharding, "MOST_NODES", 2)
    assert sorted(kd_shards(docs, leaves=6).collect()) == whole and len({r["shard"] for r in whole}) == 6
    with pytest.raises(ValueError):
        kd_shards(docs, leaf_bytes=7)
