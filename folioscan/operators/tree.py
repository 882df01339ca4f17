"""Result trees, folder listings and moves between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import extension, file_type
from folioscan.operators.ranks import GROUP_ROWS, ranked


def bucket_targets(items: DataFrame, roots: list[str]) -> DataFrame:
    """``items`` with target (the first root that their folder starts with, whatever
    the case); items under no root are dropped."""
    low = F.lower("folder_path")
    target = F.coalesce(*[F.when(low.startswith(r.rstrip("/\\").lower()), F.lit(r)) for r in roots]) if roots else F.lit(None).cast("string")
    return items.withColumn("target", target).where("target is not null")


def _placed(items: DataFrame, roots: list[str]) -> DataFrame:
    """Items with target, parts (folders between target and file) and folder (their node)."""
    rest = F.substring(F.col("folder_path"), F.length("target") + 1, F.length("folder_path"))
    parts = F.filter(F.split(rest, r"[/\\]+"), lambda p: p != "")
    trimmed = F.regexp_replace("target", r"[/\\]+$", "")
    rows = bucket_targets(items, roots).withColumn("parts", parts)
    return rows.withColumn("folder", F.when(F.size("parts") == 0, F.col("target")).otherwise(F.concat(trimmed, F.lit("/"), F.array_join("parts", "/"))))


def build_tree(items: DataFrame, roots: list[str]) -> DataFrame:
    """One row per node: target, full_path, parent_path, name, is_folder, depth,
    file_path, file_size, last_modified, file_count (files below a folder).

    Folders are the targets with items and every folder between them and an item.
    """
    placed = _placed(items, roots)
    trimmed = F.regexp_replace("target", r"[/\\]+$", "")
    path = lambda n: F.when(n == 0, F.col("target")).otherwise(F.concat(trimmed, F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/")))
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(
        path(n).alias("full_path"), F.when(n > 0, path(n - 1)).alias("parent_path"),
        F.when(n == 0, F.regexp_extract(trimmed, r"([^/\\]*)$", 1)).otherwise(F.get("parts", n - 1)).alias("name"), n.cast("bigint").alias("depth")))
    folders = (
        placed.select("target", F.explode(above).alias("n")).groupBy("target", "n.full_path", "n.parent_path", "n.name", "n.depth").agg(F.count(F.lit(1)).alias("file_count"))
        .select("target", "full_path", "parent_path", "name", F.lit(True).alias("is_folder"), "depth", F.lit(None).cast("string").alias("file_path"), F.lit(0).cast("bigint").alias("file_size"), F.lit(None).cast("timestamp").alias("last_modified"), "file_count")
    )
    files = placed.select(
        "target", F.col("file_path").alias("full_path"), F.col("folder").alias("parent_path"), F.col("file_name").alias("name"), F.lit(False).alias("is_folder"),
        (F.size("parts") + 1).cast("bigint").alias("depth"), "file_path", "file_size", "last_modified", F.lit(0).cast("bigint").alias("file_count"),
    )
    return folders.unionByName(files)


def sort_tree(tree: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``tree`` with place: the number of a node among its siblings, folders first,
    then by name whatever the case. More than ``group_rows`` siblings are sorted by many
    tasks."""
    return ranked(tree, ["target", "parent_path"], [F.desc("is_folder"), F.upper("name"), F.col("name"), F.col("full_path")], group_rows=group_rows)


def expand_to(tree: DataFrame, path: str, is_file: bool = False) -> DataFrame:
    """``tree`` with is_expanded: whether a folder is on the way to ``path``, whatever
    the case and the separators. The way to a file ends at its folder."""
    target = path.replace("\\", "/").rstrip("/").lower()
    target = target.rpartition("/")[0] if is_file else target
    node = F.lower(F.regexp_replace(F.regexp_replace("full_path", r"\\", "/"), "/+$", ""))
    on_the_way = (node != "") & ((node == target) | F.lit(target).startswith(F.concat(node, F.lit("/"))))
    return tree.withColumn("is_expanded", F.col("is_folder") & on_the_way)


def flatten_files(tree: DataFrame, roots: list[str]) -> DataFrame:
    """The files of a tree in pre-order: target, full_path and key, an array that
    sorts them: the target's number, then at each level folders before files, by name."""
    number = F.coalesce(*[F.when(F.col("target") == r, F.lit(f"{k:09d}")) for k, r in enumerate(roots)])
    rest = F.substring(F.col("parent_path"), F.length("target") + 1, F.length("parent_path"))
    folders = F.transform(F.filter(F.split(rest, r"[/\\]+"), lambda p: p != ""), lambda p: F.concat(F.lit("0"), F.upper(p)))
    return tree.where("not is_folder").select("target", "full_path", F.concat(F.array(number), folders, F.array(F.concat(F.lit("1"), F.upper("name")), F.col("name"))).alias("key"))


def file_nav(files: DataFrame) -> DataFrame:
    """For each file of ``flatten_files``: full_path, next_file, prev_file, round the
    ends, within its target and on to the next target's files.

    A folder's own files follow each other, so files are put in order folder by folder,
    and folders by their first file; a task holds the files of one folder, or one row
    for each folder of a target.
    """
    files = files.withColumn("folder", F.slice("key", F.lit(1), F.size("key") - 2))
    folders = files.groupBy("target", "folder").agg(F.min(F.struct("key", "full_path")).alias("a"), F.max(F.struct("key", "full_path")).alias("z"), F.count(F.lit(1)).alias("n"))
    ends = folders.groupBy("target").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("of_target"))
    # targets are few: their order is made in one partition
    ring = Window.orderBy("a")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("target", "of_target", F.coalesce(F.lead("a.full_path").over(ring), F.first("a.full_path").over(whole)).alias("after"), F.coalesce(F.lag("z.full_path").over(ring), F.last("z.full_path").over(whole)).alias("before"))
    order = Window.partitionBy("target").orderBy("a")
    folders = folders.join(F.broadcast(ends), "target").select(
        "target", "folder", "of_target", F.coalesce(F.lead("a.full_path").over(order), "after").alias("after"), F.coalesce(F.lag("z.full_path").over(order), "before").alias("before"),
        (F.sum("n").over(order) - F.col("n")).alias("earlier"),
    )
    own = Window.partitionBy("target", "folder").orderBy("key", "full_path")
    return files.join(folders, ["target", "folder"]).select(
        "full_path", F.coalesce(F.lead("full_path").over(own), "after").alias("next_file"), F.coalesce(F.lag("full_path").over(own), "before").alias("prev_file"),
        (F.row_number().over(own) + F.col("earlier")).cast("bigint").alias("k"), "of_target",
    )


def list_items(nodes: DataFrame, sort: str = "name", ascending: bool = True, kind: str = "", group_rows: int = GROUP_ROWS) -> DataFrame:
    """A folder's listing: ``nodes`` (name, is_folder, last_modified, file_size) that
    the filter keeps, with place. ``kind`` is "" (all), "folder" or an extension.

    By name, folders come first whatever the direction; by date, missing dates come
    first when ascending; by type, folders have none; by size, folders have 0. A folder of
    more than ``group_rows`` items is sorted by many tasks.
    """
    kept = nodes
    if kind == "folder":
        kept = nodes.where("is_folder")
    elif kind:
        kept = nodes.where(~F.col("is_folder") & (extension(F.col("name")) == kind.lower()))
    keys: dict[str, Column] = {
        "name": F.col("name"), "date": F.col("last_modified"), "size": F.when(F.col("is_folder"), 0).otherwise(F.col("file_size")),
        "type": F.when(F.col("is_folder"), "").otherwise(extension(F.col("name"))),
    }
    key = keys.get(sort, F.col("name"))
    order = [F.desc("is_folder")] if sort not in ("date", "size", "type") else []
    order.append(key.asc_nulls_first() if ascending else key.desc_nulls_last())
    return ranked(kept, ["parent_path"], [*order, F.col("full_path")], group_rows=group_rows)


def listing_columns(nodes: DataFrame) -> DataFrame:
    """What a listing shows: name, date or "-", extension in capitals or フォルダ, size or "-"."""
    from folioscan.functions.text import format_date, format_size

    folder = F.col("is_folder")
    return nodes.select(
        "full_path", "name", F.when(folder, "-").otherwise(format_date(F.col("last_modified"))).alias("date"),
        F.when(folder, "フォルダ").otherwise(F.upper(F.ltrim(extension(F.col("name")), F.lit(".")))).alias("type"), F.when(folder, "-").otherwise(format_size(F.col("file_size"))).alias("size"),
    )


def distinct_extensions(nodes: DataFrame) -> DataFrame:
    """The extensions of the files among ``nodes``, and how many have each."""
    ext = extension(F.col("name"))
    return nodes.where(~F.col("is_folder") & (ext != "")).groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.first(file_type(ext)).alias("label"))
