"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Documents with equal texts share one point (the smallest language, source and id
of the group, and the text's size). A node of the tree that has to yield k leaves is
split where k // 2 of k parts of its bytes lie to the left, along the dimension in
which its points spread widest. The weighted median is found by distributed
histograms: every pass sums the bytes of all nodes of a level by bucket and narrows
each node's interval to the bucket that holds the median, until the rest is small.
Ties in a dimension are ordered by the text's hash, and copies of one text by their
own hash, so even a group larger than a leaf is split evenly.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, written

#: Sums that the histograms of a level send to the driver at most, and buckets of a node.
MOST_SUMS, MOST_BUCKETS = 1 << 17, 1 << 13
#: Nodes of a level whose medians are sought together; a level with more takes several turns.
MOST_NODES = 1 << 16
#: A node's median is exact to this share of a leaf's bytes.
TOLERANCE = 0.0005


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _points(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, the coordinates d0 to d3, and the hashes that break ties."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = scratch.written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("crc"),
        F.xxhash64(text).alias("tie"), meta("lang").alias("lang"), meta("source").alias("source"), F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")
    key = ["tie", "crc", "size"]
    # written, so that both sides of the join are plain exchanges and a hot group can be split
    groups = scratch.written(rows.groupBy(*key).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("id").alias("least")), "shard-groups")
    # a name's place is its rank among the names of its kind, null first
    both = groups.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("lang").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("source").alias("name")))).alias("x")).select("x.*")
    names = scratch.written(_numbered(scratch, both.distinct(), [F.col("kind"), F.col("name").asc_nulls_first()]), "shard-names")
    for kind, (column, place) in enumerate((("lang", "d0"), ("source", "d1"))):
        ranks = names.where(F.col("kind") == kind).select(F.col("name").alias("named"), F.col("number").alias(place))
        groups = groups.join(ranks, F.col(column).eqNullSafe(F.col("named"))).drop("named", column)
    return rows.drop("lang", "source").join(scratch.written(groups, "shard-places"), key).select(
        "id", "size", "crc", "tie", F.xxhash64("id", F.lit(1), "row").alias("own"), "d0", "d1", F.col("size").alias("d2"), F.coalesce(F.col("least").cast("string").try_cast("long"), F.lit(-1)).alias("d3"), F.lit(0).alias("node"),
    )


def _numbered(scratch: Scratch, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their number (from 0, without gaps) in ``order``, counted in the
    parts of a distributed sort, to which the rows of earlier parts are added."""
    placed = scratch.written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    parts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for r in parts:
        starts.append((r["part"], before - (r["part"] << 33)))
        before += r["n"]
    starts = _table(rows, starts, "part", "start")  # a row for each part of the sort
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", F.col("at") + F.col("start")).drop("part", "start", "at")


def _table(like: DataFrame, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of 64-bit numbers and nulls."""
    if not rows:
        return like.sparkSession.createDataFrame([], ", ".join(f"{n} long" for n in names))
    values = ", ".join("(" + ", ".join("bigint(null)" if x is None else f"bigint('{x}')" for x in r) + ")" for r in rows)
    return like.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def kd_shards(docs: DataFrame, leaves: int = 24, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes of the text plus 8; null:
    8), text_crc32, law ("bytes": the sizes of shards are near equal), shard (0 to
    ``leaves`` - 1), slot (gapless from 0 in its shard, by id). With ``leaf_bytes``
    there are as many leaves as it takes to hold no more than that each.

    The driver holds a number for each leaf, and the histograms of MOST_NODES nodes at
    once; a level with more nodes takes several turns, each of which reads the points.
    No row fits into ``leaf_bytes`` under 8, which are an error.

    Equal texts share a shard unless a split has to divide them for balance. A null
    text counts as empty, a text of any length is one size; null ids, languages or
    sources are places of their own; ids that aren't numbers have one place. Repeated rows
    are told apart, so they may be split from each other as balance asks.
    Columns named lang and source steer the tree where they exist; others are ignored.
    Fewer rows than leaves leave shards empty, and no rows give no rows.
    """
    if leaf_bytes is not None and leaf_bytes < 8:
        raise ValueError(f"no row fits into a leaf of {leaf_bytes} bytes")
    with Scratch(docs.sparkSession) as scratch:
        return written(_kd_shards(scratch, docs, leaves, id_col, text_col, leaf_bytes), "shards")


def _kd_shards(scratch: Scratch, docs: DataFrame, leaves: int, id_col: str, text_col: str, leaf_bytes: int | None) -> DataFrame:
    points = scratch.written(_points(scratch, docs, id_col, text_col), "shard-points")
    about = points.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[(F.max(d).cast("double") - F.min(d).cast("double")).alias(d) for d in DIMENSIONS]).first()
    if leaf_bytes is not None:
        leaves = max(1, -(-(about["bytes"] or 0) // leaf_bytes))
    nodes = {0: leaves}  # first leaf of a node -> its leaves
    while splitting := {first: n for first, n in nodes.items() if n > 1}:
        bounds, spans, order = None, [float(about[d] or 0) for d in DIMENSIONS], list(splitting)
        for at in range(0, len(order), MOST_NODES):
            turn = {first: splitting[first] for first in order[at : at + MOST_NODES]}
            cuts = _cuts(points, turn, spans)
            told = _table(points, [(first, DIMENSIONS.index(cuts[first][0]), *cuts[first][1], first + n // 2) for first, n in turn.items()], "node", "dim", "v", "t", "o", "right")
            if len(order) > MOST_NODES:  # too many to plan as one local table, or to broadcast
                told = scratch.written(told, "shard-bounds")
            bounds = told if bounds is None else bounds.unionByName(told)
        moved = points.join(bounds if len(order) > MOST_NODES else F.broadcast(bounds), "node", "left")
        x, tie, own = _coordinate(F.col("dim")), F.col("tie"), F.col("own")
        left = (x < F.col("v")) | ((x == F.col("v")) & ((tie < F.col("t")) | ((tie == F.col("t")) & (own <= F.col("o")))))
        moved = moved.withColumn("node", F.when(left | F.col("right").isNull(), F.col("node")).otherwise(F.col("right")).cast("int"))
        points = scratch.written(moved.select(*points.columns), "shard-level", about["n"])
        nodes = {k: v for first, n in nodes.items() for k, v in ({first: n} if n == 1 else {first: n // 2, first + n // 2: n - n // 2}).items()}
    points = _numbered(scratch, points.select("id", "size", "crc", "tie", F.col("node").alias("shard")), [F.col("shard"), F.col("id").asc_nulls_first(), F.col("tie"), F.col("crc")])
    sizes = sorted(points.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect())
    firsts = list(zip((r["shard"] for r in sizes), accumulate((r["n"] for r in sizes), initial=0)))
    starts = None
    for at in range(0, max(1, len(firsts)), MOST_NODES):
        told = _table(points, firsts[at : at + MOST_NODES], "shard", "first")
        if len(firsts) > MOST_NODES:
            told = scratch.written(told, "shard-starts")
        starts = told if starts is None else starts.unionByName(told)
    return points.join(starts if len(firsts) > MOST_NODES else F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _coordinate(number: Column) -> Column:
    """The dimension of that number, or the text's hash (4) or own hash (5) of a row."""
    out = F.lit(None).cast("long")
    for k, name in enumerate((*DIMENSIONS, "tie", "own")):
        out = F.when(number == k, F.col(name)).otherwise(out)
    return out


def _cuts(points: DataFrame, splitting: dict[int, int], spans: list[float]) -> dict[int, tuple[str, tuple[int, int, int]]]:
    """For each node its widest dimension and the last place of its left part.

    What is looked for in each node goes to the rows as a table of a row for each node,
    and the sums of its buckets come back."""
    here = points.join(F.broadcast(_table(points, [(k,) for k in splitting], "node")), "node")
    # one pass for the spreads of all nodes, then one for each round of histograms
    made = here.groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *[f(d).alias(f"{f.__name__}_{d}") for d in (*DIMENSIONS, "tie", "own") for f in (F.min, F.max)]).collect()
    state = {}
    for r in made:
        wide = [(r[f"max_{d}"] - r[f"min_{d}"]) / s if s else 0.0 for d, s in zip(DIMENSIONS, spans)]
        dim = DIMENSIONS[wide.index(max(wide))]
        n = splitting[r["node"]]
        state[r["node"]] = {"dim": dim, "level": 0, "lo": r[f"min_{dim}"], "hi": r[f"max_{dim}"], "want": r["bytes"] * (n // 2) / n, "slack": TOLERANCE * r["bytes"] / n, "fixed": [], "tie": (r["min_tie"], r["max_tie"]), "own": (r["min_own"], r["max_own"])}
    done: dict[int, tuple[str, tuple[int, int, int]]] = {node: ("d0", (0, 0, 0)) for node in splitting if node not in state}
    low, high, buckets = -(1 << 63), (1 << 63) - 1, max(4, min(MOST_BUCKETS, MOST_SUMS // max(1, len(splitting))))
    while open_ := {k: s for k, s in state.items() if k not in done}:
        wanted = []
        for k, s in open_.items():
            s["width"] = max(1, -(-(s["hi"] - s["lo"] + 1) // buckets))
            fixed = [*s["fixed"], None, None][:2]
            wanted.append((k, DIMENSIONS.index(s["dim"]), s["level"] and s["level"] + 3, *fixed, s["lo"], s["hi"], s["width"]))
        told = points.join(F.broadcast(_table(points, wanted, "node", "dim", "level", "f0", "f1", "lo", "hi", "width")), "node")
        x = _coordinate(F.when(F.col("level") == 0, F.col("dim")).otherwise(F.col("level")))
        told = told.where(x.between(F.col("lo"), F.col("hi")) & (F.col("f0").isNull() | (_coordinate(F.col("dim")) == F.col("f0"))) & (F.col("f1").isNull() | (F.col("tie") == F.col("f1"))))
        # differences of 64-bit numbers may pass 64 bits: decimals hold them
        told = told.select("node", "size", "width", (x.cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")).alias("offset")).withColumn("b", F.expr("offset div width"))
        sums: dict[int, list[tuple[int, int, int]]] = {k: [] for k in open_}
        for r in told.groupBy("node", "b").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            sums[r["node"]].append((r["b"], r["w"], r["n"]))
        for k, s in open_.items():
            total, chosen = 0, None
            for b, w, n in sorted(sums[k]):
                chosen = (b, w, n)
                if total + w > s["want"]:
                    break
                total += w
            else:
                chosen = None
            if chosen is None:  # all of the interval lies to the left
                done[k] = _bound(s, s["hi"], low, high)
                continue
            b, w, n = chosen
            lo = s["lo"] + b * s["width"]
            hi = min(s["hi"], lo + s["width"] - 1)
            s["want"] -= total
            if n == 1 or min(s["want"], w - s["want"]) <= s["slack"]:  # the bucket goes to the nearer side as a whole
                done[k] = _bound(s, hi if 2 * s["want"] >= w else lo - 1, low, high)
            elif lo < hi:
                s["lo"], s["hi"] = lo, hi
            elif s["level"] < 2:  # one value holds the median: go on by the next part of the order
                s["fixed"].append(lo)
                s["level"] += 1
                s["lo"], s["hi"] = s["tie"] if s["level"] == 1 else s["own"]
            else:
                done[k] = _bound(s, hi if 2 * s["want"] >= w else lo - 1, low, high)
    return done


def _bound(s: dict, last: int, low: int, high: int) -> tuple[str, tuple[int, int, int]]:
    """The place (dimension, hash, own hash) after which nothing with ``last`` at the
    state's level comes; before it if ``last`` is under the lowest 64-bit number."""
    place = [*s["fixed"], last]
    if last < low:
        return s["dim"], (tuple([*s["fixed"][:-1], s["fixed"][-1], low, low])[:3])
    return s["dim"], tuple([*place, *[high] * (3 - len(place))])
