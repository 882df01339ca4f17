"""What the operators of this folder share: the shared scratch folder, written
intermediate tables and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources.shared import new_path as scratch_path

#: The white space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Maps ASCII capitals to small letters in UTF-8 bytes; other bytes are kept.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Files of a table whose rows are known to be few, and rows in a file of a larger one.
LEAST_FILES, FILE_ROWS = 8, 250_000


def written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read again, by ``spark`` if given.

    This cuts the lineage: a lost executor costs no recomputation of ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the scratch folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Intermediate tables of one run, which are deleted when the run ends.

    What outlives the run has to be written beside them, with ``written``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        """A new path that goes with the run."""
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` written as Parquet, and read until the run ends. With ``rows``, about
        as many as there are, small tables make few files."""
        path = self.path(name)
        (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))).write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop_before(self, n: int) -> None:
        """Delete all but the last ``n`` paths now."""
        for path in self.paths[: len(self.paths) - n]:
            discard(self.spark, path)
        self.paths = self.paths[len(self.paths) - n :]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop_before(0)


def scans_files(df: DataFrame) -> bool:
    """Whether ``df`` only projects or filters the rows of files, which come the same again."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def small_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df`` in a session of its own in which Python functions get batches of some
    ``size`` bytes at most (one row may be larger), and in which a job's shuffle files go
    when it ends, since its results are written. The caller's session stays as it is."""
    spark = df.sparkSession
    clone = spark._jsparkSession.cloneSession()
    clone.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    clone.conf().set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    jvm = spark._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(jvm.ofRows(clone, df._jdf.queryExecution().analyzed()), SparkSession(spark.sparkContext, clone))


def shuffle_partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for moving the rows of ``df``: the session's number, or more
    where the optimiser's size estimate asks for more than ``bytes_each`` each.

    The estimate is the size of the files for a scan; text is taken to be four
    times as large in memory.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-4 * size // bytes_each) if size < 1 << 55 else 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, though it is used often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text in order, A-Z lower-cased."""

    def small(w: Column) -> Column:  # most words are ASCII, which lower() does a byte at a time
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), ""), lambda w: F.xxhash64(small(w)))


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column of 64-bit numbers, as unsigned numbers; not copied."""
    values, ends = column.flatten().to_numpy().view(np.uint64), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class Memo(dict):
    """Results of ``make`` by key, in a memory of at most ``limit`` entries.

    Entries live in two generations of half that size: when the young one is full
    it becomes the old one, whose entries return when they are asked for again. So
    what comes often stays, whatever else the corpus holds.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
