"""Digests of folders, by which an index and a listing are compared from the root down.

A folder's digests are two 64-bit hashes of the paths and times of the files in it, and of
all files below it, each file's combined by exclusive or, with their numbers. So digests
of segments add up: what a segment takes out of older ones is combined once more, with
a negative number. Folders that agree are left as they are with all that is below them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.segments import FOLDERS, Reader, folder_of, path_key, slot_of

#: What is compared of two folders: all below them, and their own files.
BELOW, OWN = ("below", "below1", "below2"), ("own", "own1", "own2")


def root_keys(roots: list[str]) -> list[str]:
    """The outermost of some folders, as ``path_key`` and ``folder_of`` spell them."""
    keys = sorted({re.sub("^file:/*", "/", r).lower().replace("\\", "/").rstrip("/") for r in roots}, key=len)
    return [k for n, k in enumerate(keys) if not any(k.startswith(o + "/") for o in keys[:n])]


def digests(files: DataFrame, sign: int = 1) -> DataFrame:
    """The digests of all folders that ``files`` (file_path, last_modified_ticks) lie under;
    ``sign`` -1 takes the files out of what this is added to. No files give no folders; a
    null path has none, a null time counts as one of its own."""
    keyed = files.where("file_path is not null").select(path_key(F.col("file_path")).alias("key"), "last_modified_ticks")
    own = keyed.select(folder_of(F.col("key")).alias("at"), F.xxhash64("key", "last_modified_ticks").alias("h1"), F.xxhash64(F.lit(1), "last_modified_ticks", "key").alias("h2"))
    own = own.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    # from here on rows are folders, not files
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = own.withColumn("folder", F.explode(above)).withColumn("here", F.col("folder") == F.col("at"))
    mine = lambda c: F.when(F.col("here"), F.col(c)).otherwise(0)
    sums = each.groupBy("folder").agg(
        (F.sum("n") * sign).alias("below"), F.bit_xor("h1").alias("below1"), F.bit_xor("h2").alias("below2"), (F.sum(mine("n")) * sign).alias("own"), F.bit_xor(mine("h1")).alias("own1"), F.bit_xor(mine("h2")).alias("own2")
    )
    return sums.withColumn("parent", F.when(F.col("folder").contains("/"), folder_of(F.col("folder")))).select(*FOLDERS)


def _agree(names: tuple[str, ...]) -> Column:
    """Whether old and new values are equal; a folder that isn't there has none."""
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(F.col(f"old_{n}"), F.lit(0)) == F.coalesce(F.col(f"new_{n}"), F.lit(0)))
    return out


def differing(reader: Reader, disk: DataFrame, roots: list[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The folders (folder) whose own files differ between an index and ``disk``, the
    digests of a listing under ``roots``; None where they can't tell, as the index has
    none or files are listed by other names than those of the roots.

    A round compares the children of the folders that differed in the last one, so there
    are as many as the deepest of them is deep. ``write`` writes and reads a table.
    """
    keys = root_keys(roots)
    disk = write(disk)
    told = disk.agg(F.sum("own").alias("all"), F.sum(F.when(F.col("folder").isin(keys), F.col("below"))).alias("under")).first()
    if not reader.has_folders() or told["all"] != told["under"]:
        return None
    found = None
    old, new = reader.folders(), disk
    old, new = old.where(F.col("folder").isin(keys)), new.where(F.col("folder").isin(keys))
    while True:
        sides = [side.select("folder", *[F.col(c).alias(f"{name}_{c}") for c in BELOW + OWN]) for name, side in (("old", old), ("new", new))]
        level = write(sides[0].join(sides[1], "folder", "full_outer").where(~_agree(BELOW)).select("folder", (~_agree(OWN)).alias("own")))
        found = level if found is None else found.unionByName(level)
        slots = reader.slots_of(level)
        if not slots:
            return found.where("own").select("folder")
        parents = level.select(F.col("folder").alias("parent"))
        old, new = reader.folders(parents, slots), disk.join(parents, "parent", "left_semi")


def write_folders(docs: DataFrame, sums: DataFrame, path: str, slots: int, slices: int) -> None:
    """Write the entries (path and time) of ``docs`` by folder, and the digests by parent,
    each into so many slots; a folder's entries are dealt to ``slices`` tasks."""
    entries = docs.where("file_path is not null").select(folder_of(path_key(F.col("file_path"))).alias("folder"), "file_path", "last_modified_ticks").withColumn("slot", slot_of(F.col("folder"), slots))
    entries.repartition("slot", F.pmod(F.xxhash64("file_path"), F.lit(slices))).sortWithinPartitions("slot", "folder", "file_path").write.partitionBy("slot").parquet(f"{path}/entries")
    sums = sums.withColumn("slot", slot_of(F.coalesce("parent", F.lit("")), slots))
    sums.repartition("slot").sortWithinPartitions("slot", "parent", "folder").write.partitionBy("slot").parquet(f"{path}/folders")
