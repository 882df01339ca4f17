"""The trie of conversations' prefixes.

A node is a prefix that conversations share, known by the digest of its turns, and
belongs to the smallest conversation that starts with it. Who owns a prefix owns all
longer ones of its own, so the first depth that a conversation owns is found by binary
search, for all conversations together, in joins of their digests with the smallest
conversation of each digest. What a conversation owns is a chain, which hangs on the
node before its first one; totals of chains are made from the outermost inwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, written
from folioscan.operators.ranks import GROUP_ROWS, ranked, running

NODE = ["depth", "mark1", "mark2"]


def marked_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """conv_id, n (from 1, by turn, null first; ties by role and text), mark1 and mark2 (hashes
    of role and text, 128 bits together), chars (code points of the text) of each turn.

    Null roles and texts count as empty; rows without a conversation are left out.
    """
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    numbered = ranked(named, ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "n", group_rows)
    return numbered.select("conv_id", "n", F.xxhash64("role", "text").alias("mark1"), F.xxhash64("text", F.lit(1), "role").alias("mark2"), F.length("text").cast("bigint").alias("chars"))


def spliced(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their turns (as ``turns``), each rebuilt: the
    first ``taken`` (``most`` at most) turns of conversation ``base``, all if it has fewer,
    then its own turns after as many. ``base`` and ``taken`` are columns over conv_id."""
    turn = F.struct("n", "mark1", "mark2", "chars")
    heads = turns.where(F.col("n") <= most).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", base.alias("base"), taken.alias("taken"))
    heads = heads.join(convs.select("base").distinct(), F.col("conv_id") == F.col("base"), "left_semi").select(F.col("conv_id").alias("of"), "head")
    convs = convs.join(heads, F.col("base") == F.col("of"), "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<n:bigint,mark1:bigint,mark2:bigint,chars:bigint>>")), F.lit(1), F.col("taken").cast("int")))
    convs = convs.withColumn("size", F.size("head") + F.greatest(F.col("own") - F.col("taken"), F.lit(0)))
    ahead = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    shift = convs.select("conv_id", "taken", F.size("head").alias("ahead"))
    own = turns.join(shift, "conv_id").where(F.col("n") > F.col("taken")).select("conv_id", (F.col("n") - F.col("taken") + F.col("ahead")).alias("n"), "mark1", "mark2", "chars")
    return convs.select("conv_id", "size"), ahead.unionByName(own)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """owner, depth and the SHA-256 of the comma-joined ids of each run of rows, which
    come sorted. Ids pass by; none but the running hash is held."""
    at, sha = None, None
    for batch in batches:
        done = []
        for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id"))):
            if (owner, depth) != at:
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = (owner, depth), hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        yield _digest_rows(done)
    if at:
        yield _digest_rows([(*at, sha.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    owner, depth, sha = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"owner": pa.array(owner, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": pa.array(sha, pa.string())})


def _first_owned(scratch: Scratch, convs: DataFrame, prefixes: DataFrame, least: DataFrame) -> DataFrame:
    """conv_id, size, first: the first depth whose prefix a conversation owns, size + 1 if
    there is none. Each round halves all ranges that are still open."""
    ranges = scratch.written(convs.select("conv_id", "size", F.lit(0).cast("bigint").alias("low"), (F.col("size") + 1).alias("high")), "ranges")
    while ranges.where("low < high").limit(1).count():
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        asked = ranges.where("low < high").select("conv_id", middle.alias("depth")).join(prefixes, ["conv_id", "depth"]).join(least, NODE)
        owned = asked.select("conv_id", (F.col("owner") == F.col("conv_id")).alias("owned"))
        told = ranges.join(owned, "conv_id", "left")
        low = F.when(F.col("owned"), F.col("low")).when(~F.col("owned"), middle + 1).otherwise(F.col("low"))
        high = F.when(F.col("owned"), middle).otherwise(F.col("high"))
        ranges = scratch.written(told.select("conv_id", "size", low.alias("low"), high.alias("high")), "ranges")
    return ranges.select("conv_id", "size", F.col("low").alias("first"))


def _levels(scratch: Scratch, chains: DataFrame) -> DataFrame:
    """conv_id and level (chains between a chain and the root's) of the chains (conv_id,
    parent), in as many rounds as the largest level has binary digits."""
    ways = scratch.written(chains.select("conv_id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("level")), "levels")
    while ways.where("up is not null").limit(1).count():
        onward = ways.select(F.col("conv_id").alias("at"), F.col("up").alias("next"), F.col("level").alias("more"))
        ways = scratch.written(ways.join(onward, F.col("up") == F.col("at"), "left").select("conv_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return ways.select("conv_id", "level")


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = GROUP_ROWS) -> DataFrame:
    """One row per node: conv_id (the smallest member, its owner), depth, parent_conv_id
    (null for the root), n_convs (members: the conversations that start with it),
    n_children, n_leaves, saved_tokens, ends_sha256, all about its subtree as named.

    ``convs`` has conv_id and size (turns, possibly 0), ``turns`` conv_id, n (1 to size),
    mark1, mark2 and chars, as ``marked_turns`` and ``spliced`` make them; equal marks are
    equal turns. n_leaves counts childless nodes of the subtree, saved_tokens sums
    (n_convs - 1) * chars of its nodes, ends_sha256 is the SHA-256 of the ascending ids,
    comma-joined, of the members that end there. Equal conversations share all nodes and
    end together; a conversation without turns ends at the root. No conversations give no
    nodes; rows without conv_id, marks or n are not expected, other columns are ignored.
    A conversation of more than ``block`` turns spans several tasks.

    Rounds: a binary search over depths, then one per level of chains that hang on chains.
    Ids of the members that end at one node pass one task in order, as their digest asks;
    only the running hash is held.
    """
    spark = convs.sparkSession
    with Scratch(spark) as scratch:
        convs = scratch.written(convs.select("conv_id", F.col("size").cast("bigint").alias("size")), "conversations")
        longest = convs.agg(F.max("size").alias("m")).first()["m"] or 0
        own = turns.select("conv_id", F.col("n").cast("bigint").alias("depth"), F.struct("mark1", "mark2").alias("own"), "chars")
        steps = running(own, "conv_id", "depth", {m: (F.xxhash64("depth", f"own.{m}"), F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for m in ("mark1", "mark2")}, longest, block)
        root = convs.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "chars", "mark1", "mark2")])
        prefixes = scratch.written(steps.select(*root.columns).unionByName(root), "prefixes")
        least = scratch.written(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("owner")), "least")

        first = scratch.written(_first_owned(scratch, convs, prefixes, least), "first")
        hung = first.where("first > 0").select("conv_id", (F.col("first") - 1).alias("depth")).join(prefixes, ["conv_id", "depth"]).join(least, NODE)
        hung = hung.select(F.col("conv_id").alias("hung"), F.col("owner").alias("parent"), F.col("depth").alias("at"))
        chains = scratch.written(first.join(hung, F.col("conv_id") == F.col("hung"), "left").select("conv_id", "size", "first", "parent", "at"), "chains")
        owned = F.col("first") <= F.col("size")

        levels = scratch.written(_levels(scratch, chains.where(owned)), "levels")
        most = levels.agg(F.max("level").alias("m")).first()["m"]
        ends = chains.where(~owned).groupBy(F.col("parent").alias("end_conv"), F.col("at").alias("end_depth")).agg(F.count(F.lit(1)).alias("ends"))
        nodes = prefixes.join(chains.where(owned), "conv_id").where("depth >= first").join(levels, "conv_id")
        nodes = nodes.join(ends, (F.col("conv_id") == F.col("end_conv")) & (F.col("depth") == F.col("end_depth")), "left")
        last = F.col("depth") == F.col("size")
        path = scratch.path("nodes")
        nodes.select("conv_id", "depth", "chars", "first", "parent", last.alias("last"), (F.coalesce("ends", F.lit(0)) + last.cast("bigint")).alias("ends"), (F.col("size") - F.col("depth")).alias("back"), "level").write.partitionBy("level").parquet(path)

        done = scratch.path("done")
        for level in range(most, -1, -1) if most is not None else ():
            own = spark.read.parquet(f"{path}/level={level}")
            if level < most:
                hang = spark.read.parquet(f"{done}/level={level + 1}").where("depth = first")
                hang = hang.groupBy(F.col("parent").alias("on"), (F.col("depth") - 1).alias("on_depth")).agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"kids_{c}") for c in ("n_convs", "n_leaves", "saved_tokens")])
                own = own.join(hang, (F.col("conv_id") == F.col("on")) & (F.col("depth") == F.col("on_depth")), "left").drop("on", "on_depth")
            else:
                own = own.withColumns({c: F.lit(None).cast("bigint") for c in ("kids", "kids_n_convs", "kids_n_leaves", "kids_saved_tokens")})
            own = own.fillna(0, ["kids", "kids_n_convs", "kids_n_leaves", "kids_saved_tokens"])
            plus = (F.sum, lambda a, b: a + b)
            leaf = (F.col("last") & (F.col("kids") == 0)).cast("bigint")
            own = running(own, "conv_id", "back", {"n_convs": (F.col("ends") + F.col("kids_n_convs"), *plus), "n_leaves": (leaf + F.col("kids_n_leaves"), *plus)}, longest, block)
            own = running(own, "conv_id", "back", {"saved_tokens": ((F.col("n_convs") - 1) * F.col("chars") + F.col("kids_saved_tokens"), *plus)}, longest, block)
            own = own.withColumn("n_children", F.col("kids") + (~F.col("last")).cast("bigint"))
            own.select("conv_id", "depth", "first", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens").write.parquet(f"{done}/level={level}")
        if most is None:
            return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")

        last_node = chains.select(F.when(owned, F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("size").alias("depth"), "conv_id")
        digests = last_node.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(_digests, "owner bigint, depth bigint, ends_sha256 string").withColumnRenamed("depth", "end_depth")
        full = spark.read.parquet(done).drop("level")
        out = full.join(digests, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("end_depth")), "left")
        above = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
        none = hashlib.sha256().hexdigest()
        return written(out.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "prefix-trie")
