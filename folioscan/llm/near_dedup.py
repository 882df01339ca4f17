"""Near-duplicate detection by MinHash bands with sequential Bayesian verification.

Texts become sets of word shingles (64-bit hashes); equal sets are one node. Nodes
that agree in a band of their signature meet in a bucket. In each bucket every node
is paired with the bucket's smallest one. A pair's signatures are compared batch by
batch, and it is pruned as soon as the posterior probability that its similarity
reaches the threshold, under a uniform prior, falls below ``miss``. Survivors are
verified exactly on their full sets.

Components of these links leave the buckets in which several components meet. There
all pairs of nodes of different components are compared as well, in tiles of bounded
size: tiles of signatures first, which tell the nodes that have any plausible partner,
then tiles of these nodes' sets, where pairs are pruned and verified in the same way
and a pair is skipped once its ends are known to be connected. So no pair that shares
a band is left out, yet the pairs inside a large group of copies are never listed.

Words are hashed in the JVM, so Python gets numbers and remembers no words. Sets are
built again for the nodes that have to be verified, which a filter finds in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.components import connected_components
from folioscan.llm.shared import Scratch, lists, small_batches, word_hashes, written

#: Hashes compared before the posterior is looked at again.
BATCH = 32
#: Nodes of a bucket, and bytes of their sets, in one part; two parts make a tile.
TILE, TILE_BYTES = 2048, 8 << 20
#: Words of 64 bits in the filter that says which sets are needed: at most so many rows
#: are broadcast. Beyond its capacity it spares less work and nothing else changes.
MOST_FILTER_WORDS = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the ``k``-word shingles of a text, given as the
    hashes of its words. Fewer words are one shingle; without words there is none."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    state = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        state = _mix(state * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return np.unique(state)


@lru_cache(maxsize=4)
def _multipliers(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(members: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` minima of a non-empty set under as many permutations of 32-bit numbers,
    of which the low 16 bits are kept: others agree in them only to be found out later."""
    a, b = _multipliers(n)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    small = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 512):
        x = small[at : at + 512, None] * a + b
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(axis=0), out=least)
    return least.astype(np.uint16)


@lru_cache(maxsize=8)
def matches_needed(hashes: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes compared, least matches that keep a pair) after each batch: a pair is
    pruned if P(similarity >= threshold | matches) < miss under a uniform prior."""
    out = []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        # with m matches of n the posterior is Beta(m + 1, n - m + 1), and its tail
        # above t is the chance of at most m successes in n + 1 trials of chance t
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def plausible(one: np.ndarray, others: np.ndarray, needed: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which rows of ``others`` (signatures) may be similar enough to ``one``, which
    is a signature or one for each row."""
    alive, found, at = np.arange(len(others)), np.zeros(len(others), dtype=np.int32), 0
    for n, least in needed:
        mine = one[at:n] if one.ndim == 1 else one[alive, at:n]
        found = found + (others[alive, at:n] == mine).sum(axis=1)
        keep = found >= least
        alive, found, at = alive[keep], found[keep], n
        if not len(alive):
            break
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least ``percent`` times the union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _members(value: pa.Scalar) -> np.ndarray:
    """A packed set, not copied."""
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _sets(docs: DataFrame, k: int, needed: DataFrame) -> DataFrame:
    """id and members (packed hashes) of the documents (columns id, text) in ``needed``
    (a written table; column id): a filter as large as they ask for keeps most other
    texts out of Python, and a join the rest."""
    bits = 64 * min(MOST_FILTER_WORDS, 1 << max(0, needed.count() // 4).bit_length())  # some 16 bits or more for each
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    flags = needed.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("x"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(w, k).tobytes() for w in lists(batch.column(1))], pa.binary())], names=["id", "members"])

    found = docs.where("id is not null").withColumn("b", bit).withColumn("w", F.expr("b div 64")).join(F.broadcast(flags), "w").where("shiftright(x, cast(b % 64 AS int)) & 1 = 1")
    found = found.select("id", word_hashes(F.col("text")).alias("words")).mapInArrow(build, "id bigint, members binary")
    return found.join(needed.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "members"])


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, miss: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (distinct ``k``-word shingles),
    component_id (the smallest id that can be reached over links), kept (id is
    component_id).

    Two documents are linked when their sets' similarity is at least ``percent``
    hundredths. A pair at the threshold shares no band with probability
    (1 - (percent/100)^rows)^bands, 7e-9 for 85 and 3e-6 for 80; ``miss`` bounds the
    posterior at which a pair is pruned.

    Null texts and texts without words have empty sets and are linked with nothing.
    Rows with a null id have a null component and aren't kept. Rows that repeat an
    id share its component if their texts are equal. Ids are cast to bigint. Further
    columns are ignored. No rows give no rows. The answer is written; all that it took
    is deleted.
    """
    plain = small_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))
    with Scratch(docs.sparkSession) as scratch:
        found = _near_components(scratch, plain, k, percent, bands, rows, miss)
        found = found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
        return written(found, "near-components", docs.sparkSession)


def _near_components(scratch: Scratch, docs: DataFrame, k: int, percent: int, bands: int, rows: int, miss: float) -> DataFrame:
    hashes = bands * rows
    needed = matches_needed(hashes, percent / 100, miss)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, signs = [], [], []
            for words in lists(batch.column(1)):
                members = shingles(words, k)
                sizes.append(len(members))
                prints.append(xxhash.xxh3_128_digest(members) if len(members) else None)
                signs.append(signature(members, hashes).tobytes() if len(members) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n_shingles", "fingerprint", "signature"])

    hashed = docs.select("id", word_hashes(F.col("text")).alias("words"))
    sketched = scratch.written(hashed.mapInArrow(sketch, "id bigint, n_shingles bigint, fingerprint binary, signature binary"), "sketches")
    nodes = sketched.where("id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("id", "signature")).alias("first"), F.first("n_shingles").alias("n_shingles"))
    signed = scratch.written(nodes.select("first.id", "first.signature", "n_shingles", "fingerprint"), "nodes")
    count = signed.count()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, signs = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, bands, rows)
            state = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signs.shape[:2]).copy()
            for j in range(rows):
                state = _mix(state * np.uint64(0x9E3779B97F4A7C15) + signs[:, :, j])
            yield pa.record_batch([pa.array(np.repeat(ids, bands)), pa.array(state.ravel().view(np.int64))], names=["id", "bucket"])

    placed = signed.select("id", "signature").mapInArrow(keyed, "id bigint, bucket bigint")
    shared = scratch.written(placed.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")).where("n > 1"), "shared", bands * count)
    met = scratch.written(placed.join(shared, "bucket"), "buckets", bands * count)

    # each node of a bucket against the bucket's smallest one
    pairs = met.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    sign = lambda x: signed.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, hashes) for c in (2, 3))
            yield batch.select([0, 1]).take(pa.array(plausible(one, other, needed)))

    likely = scratch.written(pairs.join(sign("a"), "a").join(sign("b"), "b").select("a", "b", "sa", "sb").mapInArrow(prune, "a bigint, b bigint"), "likely")
    ends = scratch.written(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends", count)
    sets = scratch.written(_sets(docs, k, ends), "sets")
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = [similar(_members(a), _members(b), percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(sure, pa.bool_()))

    links = scratch.written(likely.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "ma", "mb").mapInArrow(verify, "a bigint, b bigint"), "links")
    parts = connected_components(links, scratch.written)
    more = _across(scratch, docs, met.where("n > 2"), parts, signed, k, percent, needed)
    parts = connected_components(links.unionByName(more), scratch.written) if more.limit(1).count() else parts

    # documents without words meet nobody, so they needn't meet in a task either
    member = signed.select("fingerprint", F.col("id").alias("node"))
    some = sketched.where("fingerprint is not null").join(member, "fingerprint", "left").join(parts, "node", "left")
    return (
        some.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id"))
        .unionByName(sketched.where("fingerprint is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    )


def _tiled(nodes: DataFrame, size: Column) -> DataFrame:
    """``nodes`` (bucket, id, component and what else) once for each tile that they lie in.

    A bucket's largest component is one side, whose nodes needn't meet each other; all
    other nodes are the other side. ``size`` (an aggregate) says how many parts a side
    has. A tile holds a part of the one and a part of the other side, or two parts of
    the latter, or one of them; so a bucket of one large component and few other nodes
    makes each node come once or twice. ``own`` is the part, below 0 for the first side.
    """
    sides = nodes.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"))
    nodes = nodes.join(sides.select("bucket", F.col("most.component").alias("most")), "bucket").withColumn("first", F.col("component") == F.col("most")).drop("most")
    parts = nodes.groupBy("bucket", "first").agg(size.cast("int").alias("parts"))
    parts = parts.groupBy("bucket").agg(F.max(F.when(F.col("first"), F.col("parts"))).alias("firsts"), F.max(F.when(~F.col("first"), F.col("parts"))).alias("others"))
    laid = nodes.join(parts.where("others is not null"), "bucket").withColumn("own", F.when(F.col("first"), -1 - F.pmod(F.xxhash64("id"), F.col("firsts"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int"))
    met = F.when(F.col("first"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("firsts"), F.col("others") - 1))
    laid = laid.withColumn("other", F.explode(met))
    return laid.withColumn("tile", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).drop("first", "firsts", "others", "other")


def _in_tiles(rows: DataFrame, run, schema: str, names: list[str]) -> DataFrame:
    """``run`` applied to the rows of each tile, which come as lists of values."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns[:5]), *batch.columns[5:]):
                if tile != last and held:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in run(held)], names=names)
                    held = []
                last = tile
                held.append(row)
        if held:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in run(held)], names=names)

    return rows.repartition("tile").sortWithinPartitions("tile", "own", "id").mapInArrow(compare, schema)


def _across(scratch: Scratch, docs: DataFrame, met: DataFrame, parts: DataFrame, signed: DataFrame, k: int, percent: int, needed) -> DataFrame:
    """Links between nodes of different components that share a bucket (columns a, b)."""
    rows = met.count()
    once = met.groupBy("n", "who").agg(F.min("bucket").alias("bucket"))  # buckets with the same nodes are one
    here = met.select("bucket", "id", "n").join(once.select("bucket"), "bucket", "left_semi").join(parts.withColumnRenamed("node", "id"), "id", "left")
    here = scratch.written(here.select("bucket", "id", "n", F.coalesce("component", "id").alias("component")), "met", rows)
    mixed = here.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    here = scratch.written(here.join(mixed, "bucket", "left_semi"), "mixed", rows)

    # by signatures: which nodes have a plausible partner in another component
    laid = _tiled(here, F.ceil(F.count(F.lit(1)) / TILE)).join(signed.select("id", "signature"), "id").select("tile", "bucket", "id", "component", "own", "signature")
    alike = _in_tiles(laid, lambda rows: _tile_suspects(rows, needed), "bucket bigint, id bigint", ["bucket", "id"])
    alike = scratch.written(alike.distinct().join(here.select("bucket", "id", "component"), ["bucket", "id"]).join(signed.select("id", "n_shingles"), "id"), "suspects", rows)
    ends = scratch.written(alike.select("id").distinct(), "suspect-ids", rows)

    # by their sets: which pairs of these are linked
    laid = _tiled(alike, F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n_shingles") * 8 / TILE_BYTES)))
    laid = laid.join(signed.select("id", "signature"), "id").join(_sets(docs, k, ends), "id").select("tile", "bucket", "id", "component", "own", "signature", "members")
    return scratch.written(_in_tiles(laid, lambda rows: _tile_links(rows, percent, needed), "a bigint, b bigint", ["a", "b"]), "across")


def _unpacked(rows: list) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ids, components numbered from 0, parts and signatures of a tile's rows, and
    whether the tile has two parts.

    A tile of two parts holds the pairs between them; those inside a part are held by
    the part's own tile, and come here once more only where there is one part.
    """
    names: dict[int, int] = {}
    root = np.array([names.setdefault(r[2], len(names)) for r in rows])
    owns = np.array([r[3] for r in rows])
    signs = np.stack([np.frombuffer(r[4].as_buffer(), dtype=np.uint16) for r in rows])
    return [r[1] for r in rows], root, owns, signs, bool((owns != owns[0]).any())


def _tile_suspects(rows: list, needed) -> tuple[list[int], list[int]]:
    """The bucket and ids of a tile's nodes that have a plausible partner in another component."""
    ids, root, owns, signs, two = _unpacked(rows)
    found = np.zeros(len(rows), dtype=bool)
    for i in range(len(rows) - 1):
        rest = np.arange(i + 1, len(rows))
        rest = rest[(root[rest] != root[i]) & ((owns[rest] != owns[i]) if two else True) & ~(found[i] & found[rest])]
        if len(rest):
            near = rest[plausible(signs[i], signs[rest], needed)]
            found[near] = True
            found[i] |= len(near) > 0
    chosen = np.flatnonzero(found).tolist()
    return [rows[i][0] for i in chosen], [ids[i] for i in chosen]


def _tile_links(rows: list, percent: int, needed) -> tuple[list[int], list[int]]:
    """Verified links that connect the components in a tile, none that adds nothing."""
    ids, root, owns, signs, two = _unpacked(rows)  # components are merged as links are found
    sets = [_members(r[5]) for r in rows]
    left, right = [], []
    for i in range(len(rows) - 1):
        rest = np.arange(i + 1, len(rows))
        apart = rest[(root[rest] != root[i]) & ((owns[rest] != owns[i]) if two else True)]
        for j in apart[plausible(signs[i], signs[apart], needed)] if len(apart) else ():
            if root[i] != root[j] and similar(sets[i], sets[j], percent):
                left.append(ids[i]), right.append(ids[j])
                root[root == root[j]] = root[i]
    return left, right
