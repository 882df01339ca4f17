"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a seeded hash, which also permutes
them. A source's quota is the run of permuted blocks whose sizes reach its target;
quotas over the source's size start again at the first block. The quotas of all
sources, counted in blocks, are then split among the output shards: at each node of
a binary tree a multivariate-hypergeometric draw decides how many blocks of each
source go to the left half, so at a leaf each shard knows how many blocks of each
source it gets, and the blocks of different shards are disjoint. Within a shard the
documents are shuffled by hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.shared import SPACE, Scratch, written

#: Sources that the driver's table of sizes may hold.
MOST_SOURCES = 1_000_000
#: Blocks of a source; beyond it blocks hold more documents, so that what runs over a
#: source's blocks in order stays small.
MOST_BLOCKS = 1 << 16
#: Blocks that all sources draw together, as one draw of the quotas tells apart.
MOST_DRAWN = 900_000_000


def target_sizes(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is
    cut off is shared anew by weight among the others until none is above."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        if weight <= 0 or left <= 0:
            break
        full = {i for i in open_ if left * weights[i] / weight >= most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= math.fsum(most * sizes[i] for i in full)
        open_ -= full
    return target


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source each shard gets: shards x sources, columns
    sum to ``quotas``, rows differ by one at most in total."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        first, n, counts = nodes.pop()
        if n == 1:
            out[first] = counts
            continue
        half, total = n // 2, int(counts.sum())
        wanted = total * half // n
        left, rest, need = np.zeros_like(counts), total, wanted
        for k, c in enumerate(counts.tolist()):  # one hypergeometric draw per source makes the multivariate one
            rest -= c
            left[k] = rng.hypergeometric(c, rest, need) if c and need and rest else min(c, need)
            need -= int(left[k])
        nodes += [(first, half, left), (first + half, n - half, counts - left)]
    return out


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, block_docs: int = 64, seed: int = 17, key_col: str | None = None
) -> DataFrame:
    """The documents that the mix takes: one row per document and pass over it.

    Columns: id, source, size (words of the text), source_size, target (of the
    source, in words), copy (0 for the first pass), shard, place (order in the
    shard, a hash). ``weights`` repeat over the sources in code-point order, null
    last; the mix shares ``share`` times all words, no source more than ``most``
    times its own. A source takes whole documents in permuted order; the one at the
    target is taken if that comes nearer to it. Documents without words are never
    taken. Rows that repeat an id are documents of their own. The same rows and
    seed give the same mix. No rows give no rows. ``key_col``, unique to each row, is
    returned too.
    """
    with Scratch(docs.sparkSession) as scratch:
        _, drawn = _dealt(scratch, _sized(scratch, docs, id_col, text_col, source_col, key_col), weights, share, most, shards, block_docs, seed)
        return written(drawn.withColumnRenamed("row", key_col) if key_col else drawn.drop("row"), "mix")


def mix_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words that
    the shards of the mix hold of it, repeats counted). The options are those of
    ``mix_sources``. The mix is written, each shard in its shuffled order, and read."""
    options = {"weights": (3, 1, 2), "share": 1.5, "most": 2.0, "shards": 16, "block_docs": 64, "seed": 17} | options
    with Scratch(docs.sparkSession) as scratch:
        placed, drawn = _dealt(scratch, _sized(scratch, docs, id_col, text_col, source_col), **options)
        mixed = scratch.written(drawn.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place"), "mix-shards")
        taken = mixed.groupBy("row").agg(F.sum("size").alias("taken"))
        found = placed.join(taken, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
        return written(found, "mix-summary")


def _sized(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, source_col: str, key_col: str | None = None) -> DataFrame:
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+"), "")).cast("long")
    return scratch.written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col).alias("salt"), (F.col(key_col) if key_col else F.monotonically_increasing_id()).alias("row")), "mix-sizes")


def _dealt(scratch: Scratch, sized: DataFrame, weights, share, most, shards, block_docs, seed) -> tuple[DataFrame, DataFrame]:
    """All rows with their source's size and target, and the rows that the shards draw."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in found]
    targets = target_sizes(sizes, [float(weights[k % len(weights)]) for k in range(len(found))], share * sum(sizes), most)
    # a source's documents fall into this many blocks, by the hash that permutes them
    most_blocks = min(MOST_BLOCKS, MOST_DRAWN // (math.ceil(most) * max(1, len(found))))
    plan = [(k, r["source"], sizes[k], targets[k], max(1, min(most_blocks, round(r["docs"] / block_docs)))) for k, r in enumerate(found)]
    plan_df = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, blocks long")
    order = F.xxhash64(F.lit(seed), "id", "salt")
    dealt = sized.join(F.broadcast(plan_df) if len(plan) <= 10_000 else plan_df, sized["source"].eqNullSafe(plan_df["source"])).select(
        "row", "source_no", sized["source"], "id", "size", "source_size", "target", order.alias("order"), F.pmod(F.xxhash64(F.lit(seed + 1), "id", "salt"), F.col("blocks")).alias("block")
    )
    per_block = dealt.groupBy("source_no", "block").agg(F.sum("size").alias("block_size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    # blocks are few: one for block_docs documents, and a hot source's running sum is over its blocks only
    before = Window.partitionBy("source_no").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    blocks = (
        per_block.withColumn("start", F.sum("block_size").over(before) - F.col("block_size"))
        .withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .select("source_no", "block", "start", "passes", "rest", (F.col("start") + F.col("block_size") <= F.col("rest")).alias("whole"), (F.col("start") >= F.col("rest")).alias("out"))
    )
    placed = dealt.join(blocks, ["source_no", "block"])
    inside = Window.partitionBy("source_no", "block").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.where("not whole and not out").withColumn("end", F.col("start") + F.sum("size").over(inside))
    # of the block at the target: documents up to it, and the next one if that ends nearer to it
    cut = cut.withColumn("more", ((F.col("end") <= F.col("rest")) | (F.col("end") - F.col("rest") < F.col("rest") - (F.col("end") - F.col("size")))).cast("int")).drop("end")
    placed = placed.where("whole or out").withColumn("more", F.col("whole").cast("int")).unionByName(cut)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0).cast("long"))
    placed = scratch.written(placed, "mix-placed")
    used = scratch.written(placed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy")), "mix-taken")
    block_list = used.select("source_no", "block", "copy").distinct()
    ranked = block_list.withColumn("rank", F.row_number().over(Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 2), "block", "copy"), "block", "copy")) - 1)
    counts = {r["source_no"]: r["n"] for r in block_list.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = split_quotas([counts.get(k, 0) for k in range(len(plan))], shards, seed)
    ends = np.cumsum(quotas, axis=0)
    ranges = [(k, s, int(ends[s, k] - quotas[s, k]), int(ends[s, k])) for s in range(shards) for k in range(len(plan)) if quotas[s, k]]
    ranges_df = spark.createDataFrame(ranges, "source_no int, shard int, first long, last long")
    shard_of = ranked.join(ranges_df, "source_no").where("rank >= first and rank < last").select("source_no", "block", "copy", "shard")
    return placed, used.join(shard_of, ["source_no", "block", "copy"]).select("row", "id", "source", "size", "source_size", "target", "copy", "shard", F.xxhash64(F.lit(seed + 3), "order", "copy").alias("place"))
