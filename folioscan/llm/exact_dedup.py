"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes meets a mask, so equal
passages yield equal chunks wherever they stand. A chunk is known by a 64-bit
fingerprint; fingerprints are verified against SHA-256 digests of the chunks, and
where any fingerprint stands for several contents, chunks are known by fingerprint
and digest. A text's recipe is the ordered list of its verified chunk identifiers,
and texts are equal exactly when their recipes are. Only fingerprints and digests
are moved between tasks, never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, small_batches, utf8, written

#: Bytes that the rolling hash sees.
WINDOW = 32


def gear_table(seed: int = 7) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def cut_points(data: bytes, average: int = 2048, least: int = 512, most: int = 16384) -> list[int]:
    """The ends of the chunks of ``data``; the last is its length. None for no data.

    A chunk has ``least`` to ``most`` bytes but for the last one; ``average`` is a
    power of two. Equal data has equal cuts.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    rolled = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    step = 1
    while step < WINDOW:  # each pass doubles the bytes that a place's hash sees
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    places = np.flatnonzero((rolled >> np.uint32(8)) & np.uint32(average - 1) == 0) + 1
    ends, start, k, m = [], 0, 0, len(places)
    places = places.tolist()
    while n - start > least:
        while k < m and places[k] < start + least:
            k += 1
        end = min(places[k] if k < m else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (id, text): the text's digest, and its chunks' fingerprints and digests."""
    for batch in batches:
        digests, fingerprints, chunk_digests = [], [], []
        for data in utf8(batch.column(1)):
            digests.append(hashlib.sha256(data).hexdigest())
            marks, shas, start = [], [], 0
            for end in cut_points(data):
                chunk = data[start:end]
                marks.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                shas.append(hashlib.sha256(chunk).digest())
                start = end
            fingerprints.append(marks)
            chunk_digests.append(shas)
        yield pa.record_batch(
            [batch.column(0), pa.array(digests, pa.string()), pa.array(fingerprints, pa.list_(pa.int64())), pa.array(chunk_digests, pa.list_(pa.binary()))],
            names=["id", "text_sha256", "marks", "shas"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Columns: ``id_col``, keep_id (the largest id with an equal text), group_size
    (rows with that text), kept (id is keep_id), text_sha256 (of the UTF-8 text).

    A null text counts as empty. Rows that repeat an id and its text share one
    answer, and each counts in group_size. A row with a null id is counted and
    never kept, unless its group has no other id: then keep_id is null and kept is
    false. Further columns of ``docs`` are ignored. No rows give no rows.
    The answer is written, and what it took is deleted.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, text_sha256 string, marks array<bigint>, shas array<binary>"
    with Scratch(docs.sparkSession) as scratch:
        # small batches: a worker holds a batch's texts and, for one text, a number for each byte
        recipes = scratch.written(small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(chunk_recipes, schema), "recipes")
        pieces = recipes.select(F.explode(F.arrays_zip("marks", "shas")).alias("c")).select("c.marks", "c.shas").distinct()
        clash = pieces.groupBy("marks").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        listed = recipes.select("id", "text_sha256", (F.arrays_zip("marks", "shas") if clash else F.col("marks")).alias("recipe"))
        # written, so that both sides of the join are plain exchanges and a hot recipe can be split
        groups = scratch.written(listed.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        found = listed.join(groups, "recipe").select(
            F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
        )
        return written(found, "exact-groups", docs.sparkSession)
