"""Scans of file trees, and documents from files."""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import Accumulator
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions.text import extension, file_name, file_type, folder_path, ticks
from folioscan.sources.extractors import Registry, default_registry
from folioscan.sources.shared import new_path


#: Bytes of files that one task reads where they are small, tasks of a scan that are joined in
#: one at most, and tasks for each core at least.
TASK_BYTES, MOST_JOINED, LEAST_TASKS = 32 << 20, 64, 4
#: Files that one task reads at most, entries of a listing that are handed on at once, and
#: bytes of texts that are.
TASK_FILES, LISTED_AT_ONCE, TEXT_BYTES = 1 << 11, 1 << 12, 16 << 20
#: What a listing by tasks has, folders to list next among it.
ENTRY = "path string, folder boolean, ms bigint, length bigint"
#: Errors of a folder or file that can't be read or has gone; others end a listing.
UNREADABLE = (errno.EACCES, errno.EPERM, errno.ENOENT, errno.ENOTDIR, errno.ELOOP)


def outside_system_folders(path: Column) -> Column:
    """Whether no folder of a path is a system folder or starts with "$"."""
    folders = F.slice(F.split(path, r"[/\\]"), F.lit(1), F.greatest(F.size(F.split(path, r"[/\\]")) - 1, F.lit(0)))
    names = [n.lower() for n in S.SYSTEM_FOLDERS]
    return ~F.exists(folders, lambda d: d.startswith("$") | F.lower(d).isin(names))


def scan(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, registry: Registry | None = None) -> DataFrame:
    """The files under ``roots``: path, modificationTime, length, content (bytes).

    Files without an extension, or with another than the given ones (else: the
    extractors'), are left out, and so are system folders. Folders that can't be read
    are skipped: where one ends the listing, folders are listed one by one and system
    folders not at all. A plan that doesn't use ``content`` doesn't read the files. A file
    under two roots comes once. Spark's reader leaves out empty files; those of local or
    mounted folders are added. The driver holds the listing; see ``listed``.
    """
    files = None
    for root in outermost(roots):
        if not _exists(spark, root):
            continue
        try:
            found = _load(spark, root, True)
        except (Py4JJavaError, AnalysisException) as e:
            if _fatal(spark, e):
                raise
            if not (folders := _readable_folders(spark, root)):
                continue
            found = _load(spark, folders, False)
        found = _joined(found)
        if _local(spark, root):
            empty = _listed(spark, root).where("length = 0").select("path", "modificationTime", "length", F.lit(b"").alias("content"))
            found = found if empty.isEmpty() else found.where("length > 0").unionByName(empty)
        found = found.where(_below_root(spark, root))
        files = found if files is None else files.unionByName(found)
    if files is None:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return files.where(_wanted(extensions, registry))


def listed(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, registry: Registry | None = None) -> DataFrame:
    """The files of ``scan`` without their contents, which ``extract`` reads by their paths:
    path, modificationTime, length. Tasks list the folders, a round for each depth, and the
    listing is a table, so the driver holds none of it. That is so of local or mounted
    folders, which tasks can open; if a root is in another store, this is ``scan``."""
    tops = [root for root in outermost(roots) if _exists(spark, root)]
    if not tops or not all(_local(spark, root) for root in tops):
        return scan(spark, roots, extensions, registry)
    files = None
    for root in tops:
        found = _listed(spark, root).where(_below_root(spark, root))
        files = found if files is None else files.unionByName(found)
    return files.where(_wanted(extensions, registry))


def _wanted(extensions: list[str] | None, registry: Registry | None) -> Column:
    return extension(F.col("path")).isin(sorted({e.lower() for e in extensions or (registry or default_registry()).extensions()}))


def _below_root(spark: SparkSession, root: str) -> Column:
    """Whether a path is in no system folder; only folders below the root count."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return outside_system_folders(F.regexp_replace(F.col("path"), f"^[a-z]*:?/*{_quoted(base)}", ""))


def _fatal(spark: SparkSession, error: Exception) -> bool:
    """Whether an error is no fault of a folder, as the driver's memory has run out."""
    cause = getattr(error, "java_exception", None)
    while cause is not None:
        if spark._jvm.java.lang.Class.forName("java.lang.Error").isInstance(cause):
            return True
        cause = cause.getCause()
    return False


def _local(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The files under a local or mounted folder, listed by tasks and written as a table."""
    place, rounds = new_path(spark, "listing"), 0
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    folders = spark.createDataFrame([(base,)], "path string")
    while True:
        folders.mapInArrow(_entries, ENTRY).write.parquet(f"{place}/{rounds}")
        folders = spark.read.schema(ENTRY).parquet(f"{place}/{rounds}").where("folder").select("path")
        rounds += 1
        if not (n := folders.count()):
            break
        folders = folders.repartition(min(n, LEAST_TASKS * spark.sparkContext.defaultParallelism))
    found = spark.read.schema(ENTRY).parquet(*[f"{place}/{k}" for k in range(rounds)]).where("not folder")
    return found.select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_millis("ms").alias("modificationTime"), "length")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files and folders right in each folder; those that can't be read or that Spark
    hides are left out, and so are system folders."""
    rows: list[tuple] = []
    made = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "folder", "ms", "length"])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for row in _entries_of(folder):
                rows.append(row)
                if len(rows) >= LISTED_AT_ONCE:
                    yield made()
                    rows.clear()
    yield made()


def _entries_of(folder: str) -> Iterator[tuple]:
    try:
        with os.scandir(folder) as found:
            for x in found:
                if _hidden(x.name) or not _utf8(x.name):
                    continue
                try:
                    if not x.is_dir():
                        yield f"{folder.rstrip('/')}/{x.name}", False, (at := x.stat()).st_mtime_ns // 1_000_000, at.st_size
                    elif not _system(x.name):
                        yield f"{folder.rstrip('/')}/{x.name}", True, 0, 0
                except OSError as e:  # a link to nothing, or gone meanwhile
                    if e.errno not in UNREADABLE:
                        raise
    except NotADirectoryError:  # the root is a file
        yield folder, False, (at := os.stat(folder)).st_mtime_ns // 1_000_000, at.st_size
    except OSError as e:
        if e.errno not in UNREADABLE:
            raise


def _hidden(name: str) -> bool:
    """Whether Spark's readers leave out what has such a name."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.startswith(".") or name.endswith("._COPYING_")


def _utf8(name: str) -> bool:
    """Whether a name is text, as paths in tables are."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def outermost(roots: list[str]) -> list[str]:
    """``roots`` without those that a scan of another one covers, as no system folder lies
    between the two."""
    kept: list[str] = []
    for root in sorted(dict.fromkeys(r.rstrip("/") or "/" for r in roots), key=len):
        below = [root[len(k.rstrip("/")) :].split("/") for k in kept if root.startswith(k.rstrip("/") + "/")]
        if not any(all(not _system(name) for name in names) for names in below):
            kept.append(root)
    return kept


def _system(name: str) -> bool:
    return name.startswith("$") or name.lower() in {n.lower() for n in S.SYSTEM_FOLDERS}


def roots_of(path: Column, roots: list[str]) -> Column:
    """How many of the folders a path lies under."""
    bare = lambda r: r.split(":", 1)[-1].lstrip("/").rstrip("/")
    own = F.regexp_replace(path, "^[a-z]*:?/*", "")
    return sum((own.startswith(bare(r) + "/").cast("int") for r in roots), F.lit(0))


def _load(spark: SparkSession, path: str | list[str], deep: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("ignoreMissingFiles", "true").load(path)


def _joined(files: DataFrame) -> DataFrame:
    """``files`` in fewer tasks where they are small: Spark reads 32 of them in one at most."""
    tasks, least = files.select("path").rdd.getNumPartitions(), LEAST_TASKS * files.sparkSession.sparkContext.defaultParallelism
    if tasks <= least:
        return files
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the listing
    together = max(1, min(MOST_JOINED, TASK_BYTES * tasks // max(1, size)))
    return files.coalesce(max(least, -(-tasks // together)))


def _children(files, path) -> list:
    return files.listStatus(path)


def _readable_folders(spark: SparkSession, root: str) -> list[str]:
    """``root`` and the folders below it that can be listed, system folders left out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, todo, out = top.getFileSystem(spark._jsc.hadoopConfiguration()), [top], []
    names = {n.lower() for n in S.SYSTEM_FOLDERS}
    while todo:
        path = todo.pop()
        try:
            found = _children(files, path)
        except Py4JJavaError:  # denied, gone or broken: go on with the others
            continue
        if any(x.isFile() for x in found):
            out.append(path.toString())
        todo += [x.getPath() for x in found if x.isDirectory() and not (name := x.getPath().getName()).startswith("$") and name.lower() not in names]
    return out


def _quoted(text: str) -> str:
    return "/*" + "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text.lstrip("/"))


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class _Gone(Exception):
    """A file that was listed is not there any more."""


def _bytes(path: str) -> bytes:
    try:
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
            return file.read()
    except FileNotFoundError as e:
        raise _Gone(path) from e


def listing(files: DataFrame) -> DataFrame:
    """Paths and times without contents: file_path, last_modified_ticks, file_size."""
    return files.select(F.col("path").alias("file_path"), ticks(F.col("modificationTime")).alias("last_modified_ticks"), F.col("length").alias("file_size"))


def _spread(files: DataFrame) -> DataFrame:
    """``files`` dealt to tasks that read so many files and bytes, however they were listed."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    least = LEAST_TASKS * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(min(n, least), -(-n // TASK_FILES), -(-size // TASK_BYTES), 1), "path")


def extract(files: DataFrame, registry: Registry | None = None, counted: Accumulator | None = None, failed: Accumulator | None = None) -> DataFrame:
    """Documents of ``files`` with their text, and error where a file couldn't be read
    (its content is null then). Files that no extractor reads have an empty text. Files
    without a column ``content`` are opened by their paths, one at a time.
    ``counted`` and ``failed`` gather how many files were read and how many couldn't be; a
    column ``times`` says how often each counts."""
    registry = registry or default_registry()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            done = lambda: pd.DataFrame(rows, columns=["path", "modificationTime", "length", "text", "error"])
            for row in batch.itertuples(index=False):
                path, ext = row.path, "." + row.path.rpartition("/")[2].rpartition(".")[2].lower() if "." in row.path.rpartition("/")[2] else ""
                extractor, error = registry.get(ext), None
                try:
                    data = bytes(row.content) if given else _bytes(path)
                    out = extractor(data) if extractor else ""
                except _Gone:  # since it was listed
                    continue
                except Exception as e:  # one bad file must not end the scan
                    out, error = None, f"{type(e).__name__}: {e}"
                if counted is not None:
                    counted.add(int(row.times))
                if failed is not None and error is not None:
                    failed.add(int(row.times))
                rows.append((path, row.modificationTime, row.length, out, error))
                held += len(out or "")
                if held >= TEXT_BYTES:
                    yield done()
                    rows, held = [], 0
            yield done()

    given = "content" in files.columns
    files = files if given else _spread(files)
    files = files if "times" in files.columns else files.withColumn("times", F.lit(1))
    read_out = files.select("path", "modificationTime", "length", *["content"] * given, "times").mapInPandas(read, "path string, modificationTime timestamp, length bigint, text string, error string")
    path = F.col("path")
    return read_out.select(
        path.alias("file_path"), file_name(path).alias("file_name"), folder_path(path).alias("folder_path"), F.col("text").alias("content"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("last_modified"), ticks(F.col("modificationTime")).alias("last_modified_ticks"), file_type(extension(path)).alias("file_type"), F.current_timestamp().alias("indexed_at"), "error",
    )
