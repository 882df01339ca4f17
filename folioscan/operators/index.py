"""The versioned document index: differences, updates and snapshots.

A version is a list of segments. A segment is a folder with documents, their postings
and dictionary, and the paths that it takes out of older segments, as Parquet; its
dictionary counts what these held with negative signs. So an update writes what has
changed, however large the index is; segments of like size become one as they gather,
and ``compact`` makes one segment of all. A
version counts once its file in ``versions`` exists; the file is created without
overwriting, so of two writers of one version only one succeeds, and a job that dies
before it leaves the old version in force. An update compares digests of folders first,
from the root down, and then the files of those folders that differ.
"""

from __future__ import annotations

import itertools
import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions.analysis import dictionary_of, grouped_postings
from folioscan.functions.text import under_any
from folioscan.operators.folders import differing, digests, write_folders
from folioscan.operators.segments import BLOCKS, DEAD, DICTIONARY, FOLDERS, POSTINGS, SLICE_DOCS, Reader, blocks_of, bucket_of, folder_of, grams_of, path_key, slots_for, write_postings
from folioscan.sources.extractors import Registry
from folioscan.sources.files import extract, listed, listing, roots_of


def diff(index: DataFrame, disk: DataFrame, roots: list[str], reachable: list[str] | None = None) -> DataFrame:
    """op (add, update or delete) and file_path of what differs.

    Both sides have file_path and last_modified_ticks; paths are compared whatever
    their case. Files that changed their time either way are updates. Only index
    entries under ``reachable`` (else: all of ``roots``) are deleted.
    """
    old = index.where(under_any(F.col("file_path"), roots)).select(F.lower("file_path").alias("k"), F.col("file_path").alias("old_path"), F.col("last_modified_ticks").alias("old_ticks"))
    new = disk.select(F.lower("file_path").alias("k"), F.col("file_path").alias("new_path"), F.col("last_modified_ticks").alias("new_ticks"))
    both = old.join(new, "k", "full_outer")
    op = F.when(F.col("old_path").isNull(), "add").when(F.col("new_path").isNull(), "delete").when(F.col("old_ticks") != F.col("new_ticks"), "update")
    out = both.select(op.alias("op"), F.coalesce("new_path", "old_path").alias("file_path")).where("op is not null")
    return out if reachable is None else out.where((F.col("op") != "delete") | under_any(F.col("file_path"), reachable))


def upsert(docs: DataFrame, changed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``docs`` with the rows of ``changed`` in place of those with their file_path; of
    several changes of one path the last by ``order`` wins."""
    by = Window.partitionBy("file_path").orderBy(*[F.desc(c) for c in order or ["last_modified_ticks"]])
    last = changed.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return docs.join(last.select("file_path"), "file_path", "left_anti").unionByName(last, allowMissingColumns=True)


def delete(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """``docs`` without the given file_paths."""
    return docs.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def purge_unlisted(docs: DataFrame, roots: list[str]) -> DataFrame:
    """``docs`` under the given folders only."""
    return docs.where(under_any(F.col("file_path"), roots))


def snapshot(docs: DataFrame, roots: list[str]) -> DataFrame:
    """file_path and last_modified_ticks of the documents under the given folders."""
    return docs.where(under_any(F.col("file_path"), roots)).select("file_path", "last_modified_ticks")


def change_of(event_type: Column) -> Column:
    """What an event does: signup and purchase create, error deletes, others modify."""
    return F.when(event_type.isin("signup", "purchase"), "create").when(event_type == "error", "delete").otherwise("modify")


def latest_changes(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by (ts, event_id), and what it does: signup and
    purchase create, click and view modify, error deletes."""
    by = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(key, "event_id", change_of(F.col("event_type")).alias("op"), F.col("value"))


#: Bytes of texts for each bucket of a segment's postings. A larger index has more slices of a
#: bucket first: few terms of a text in a slice make its path be written over and over.
BUCKET_BYTES = 1 << 30
#: Segments of like size that make a larger one, and bytes that a path taken out counts for.
FAN, DEAD_BYTES = 4, 64


def merge_from(sizes: list[int], fan: int = FAN) -> int | None:
    """From which segment on all are to be one, given their sizes, oldest first; none yet
    if that is no gain.

    Tiers are powers of ``fan``; as soon as ``fan`` segments at the end are of the last
    one's tier or below, they are merged, and what that makes may be merged in turn. So
    there are less than ``fan`` for each tier.
    """
    bits = fan.bit_length() - 1
    tier = lambda x: 0 if x <= 1 else (x - 1).bit_length() // bits
    sizes, found = list(sizes), None
    while True:
        start = len(sizes)
        while start and tier(sizes[start - 1]) <= tier(sizes[-1]):
            start -= 1
        if len(sizes) - start < fan:
            return found
        found, sizes[start:] = start, [sum(sizes[start:])]


class Progress:
    """Files read so far, of how many, and errors, as tasks end; ``tell`` gets them every
    so often while the body of a with statement runs, and once more at its end.

    A task that runs twice counts its files twice, so processed is held to the total."""

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None] | None, seconds: float = 0.25):
        self.tell, self.seconds, self.total, self.began = tell, seconds, 0, time.monotonic()
        self.read, self.failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self._done = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def now(self) -> dict:
        """processed, total, percent, errors, elapsed_ms and text."""
        processed, errors = min(self.read.value, self.total), self.failed.value
        percent = 100.0 * processed / self.total if self.total else 0.0
        text = f"{processed:,} / {self.total:,}" + (S.SKIPPED.format(errors) if errors else "")
        return {"processed": processed, "total": self.total, "percent": percent, "errors": errors, "elapsed_ms": round((time.monotonic() - self.began) * 1000), "text": text}

    def _watch(self) -> None:
        while not self._done.wait(self.seconds):
            self.tell(self.now())

    def __enter__(self) -> Progress:
        if self.tell:
            self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._done.set()
        if self.tell:
            self._thread.join()
            if kind is None:
                self.tell(self.now())


class Index:
    """Segments in ``root``, a folder that the cluster shares. ``buckets`` is the least
    number into which a segment's terms are dealt; larger segments have more."""

    def __init__(self, spark: SparkSession, root: str, analyser: str = "unicode", buckets: int = 16):
        self.spark, self.root, self.analyser, self.buckets = spark, root.rstrip("/"), analyser, buckets
        self._named: set[str] = set()  # folders that versions written here name
        self._tag: str | None = None
        self._cancelled: frozenset[str] = frozenset()
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _numbers(self, folder: str) -> list[int]:
        path = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def versions(self) -> list[int]:
        """The versions that count, oldest first."""
        return self._numbers("versions")

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _entry(self) -> dict | None:
        versions = self.versions()
        return self._read(f"versions/{versions[-1]:08d}") if versions else None

    def at(self, version: int | None = None) -> Reader:
        """A reader of one version (else: the newest), whatever is written later."""
        versions = self.versions()
        if version is not None and version not in versions:
            raise ValueError(f"there is no version {version}")
        version = version or (versions[-1] if versions else 0)
        entry = self._read(f"versions/{version:08d}") if version else {"segments": []}
        return Reader(self.spark, version, entry["segments"], self.analyser)

    @contextmanager
    def lease(self, version: int | None = None, seconds: float = 3600) -> Iterator[Reader]:
        """A reader whose files no vacuum deletes while the body runs, or for so many
        seconds if it never ends."""
        reader, name = self.at(version), f"leases/{uuid.uuid4().hex}"
        self._put(name, {"version": reader.version, "until": time.time() + seconds})
        try:
            yield reader
        finally:
            self._fs.delete(self._path(f"{self.root}/{name}.json"), False)

    def _leased(self) -> set[int]:
        """The versions under a lease; leases that have ended are removed."""
        path = self._path(f"{self.root}/leases")
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        leases = {n: self._read(f"leases/{n}") for n in names}
        for name in [n for n, x in leases.items() if x["until"] < time.time()]:
            self._fs.delete(self._path(f"{self.root}/leases/{name}.json"), False)
        return {x["version"] for x in leases.values() if x["until"] >= time.time()}

    def segments(self) -> list[dict]:
        """The segments of the newest version, oldest first: data (their folder), buckets,
        dead (whether they take paths out of older ones), size, documents."""
        return self.at().segments

    def docs(self) -> DataFrame:
        """The documents of the newest version; none if there is no version."""
        return self.at().docs()

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """The places of the newest version's terms, or of ``terms`` (field, term), whose
        buckets alone are read then."""
        return self.at().postings(terms)

    def lengths(self) -> DataFrame:
        """file_path and length (terms of the content) of the documents with any."""
        return self.at().lengths()

    def dictionary(self) -> DataFrame:
        """The terms of the newest version: field, term, df, cf."""
        return self.at().dictionary()

    def commit(self, docs: DataFrame, unchanged: DataFrame | None = None) -> int:
        """Write ``docs`` as the next version, in one segment. Postings of the documents
        in ``unchanged`` (file_path) are taken from the version before."""
        with self._writing() as new:
            reader = self.at()
            now = new.documents(docs)
            if unchanged is None:
                return self._publish_segments([new.finish(None)])
            fresh = grouped_postings(now.join(unchanged.select("file_path"), "file_path", "left_anti"), self.analyser)
            posted = reader.grouped().drop("bucket", "block", "segment").join(unchanged.select("file_path"), "file_path", "left_semi").unionByName(fresh)
            return self._publish_segments([new.finish(posted)])

    def append(self, docs: DataFrame, gone: DataFrame) -> int:
        """The next version: a further segment with ``docs``, which takes the paths of
        ``docs`` and of ``gone`` (file_path) out of the others. Segments of like size become
        one, so there are few however many updates there were."""
        with self._writing() as new, self._writing() as merged:
            reader = self.at()
            now = new.documents(docs)
            taken, counts = 0, None
            if reader.segments:
                gone = gone.select("file_path").unionByName(now.select("file_path"))
                taken = new.take_out(reader.entries_at(gone).distinct())
                if taken == sum(x["documents"] for x in reader.segments) and not any(x["dead"] for x in reader.segments):  # nothing of them is left
                    new.taken = 0
                    return self._publish_segments([new.finish(None)])
                counts = dictionary_of(reader.docs().join(new.dead(), "file_path", "left_semi"), self.analyser) if taken else None
            segments = [*reader.segments, new.finish(None, less=counts, gone=new.dead() if taken else None)]
            start = merge_from([x["size"] for x in segments])
            if start is not None:
                segments = [*segments[:start], merged.join(segments[start:], keep_dead=start > 0)]
            return self._publish_segments(segments)

    @contextmanager
    def _writing(self) -> Iterator[Segment]:
        """A segment to write. It is deleted unless a version names it in the end, so a
        writer that fails, is interrupted or comes too late leaves nothing. What was shuffled
        for a part of it is deleted when the part is written, not when the driver happens to
        collect its garbage."""
        segment, brief = Segment(self), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(brief, None)
        self.spark.conf.set(brief, "true")
        try:
            yield segment
        finally:
            self.spark.conf.unset(brief) if before is None else self.spark.conf.set(brief, before)
            if segment.data not in self._named:
                self._fs.delete(self._path(segment.data), True)

    def _publish_segments(self, segments: list[dict]) -> int:
        self._check()
        version = (self.versions() or [0])[-1] + 1
        self._publish(version, {"data": segments[-1]["data"], "segments": segments, "at": time.time(), "analyser": self.analyser})
        self._named |= {x["data"] for x in segments}
        return version

    def _put(self, name: str, entry: dict, overwrite: bool = False) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}.json"), overwrite)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _publish(self, version: int, entry: dict) -> None:
        self._put(f"versions/{version:08d}", entry)  # fails if another writer was first

    def rebuild(self, roots: list[str], extensions: list[str] | None = None, registry: Registry | None = None, progress: Callable[[dict], None] | None = None) -> dict:
        """Index all files under ``roots`` anew: version, files, errors, elapsed_ms.
        ``progress`` is told how many files are read; a file under two roots counts twice
        in the total and when read, though it is one document."""
        with Progress(self.spark, progress) as told:
            done = self._indexed(listed(self.spark, roots, extensions, registry), roots, registry, told, self.commit)
        return done | {"elapsed_ms": told.now()["elapsed_ms"]}

    def _indexed(self, files: DataFrame, roots: list[str], registry: Registry | None, told: Progress, commit: Callable[[DataFrame], int]) -> dict:
        """Extract ``files``, once, and commit the documents that could be read."""
        files = files.withColumn("times", roots_of(F.col("path"), roots))
        told.total = files.agg(F.sum("times")).first()[0] or 0  # of the listing; contents aren't read
        path = f"{self.root}/data/read-{uuid.uuid4().hex}"
        self._check()
        try:
            extract(files, registry, told.read, told.failed).write.parquet(path)
            found = self.spark.read.parquet(path)
            errors = found.where("error is not null").count()
            return {"version": commit(found.where("error is null").drop("error")), "files": told.total, "errors": errors}
        finally:
            self._fs.delete(self._path(path), True)

    def update(self, roots: list[str], extensions: list[str] | None = None, registry: Registry | None = None, compat: bool = False, progress: Callable[[dict], None] | None = None) -> dict:
        """Index what was added, changed or removed under ``roots`` since the newest
        version; without a version all of it: version, files, errors, elapsed_ms, and add,
        update and delete (files). A file that can't be read keeps its old entry. Entries
        under roots that can't be reached stay, unless ``compat``."""
        if not self.versions():
            return self.rebuild(roots, extensions, registry, progress)
        with Progress(self.spark, progress) as told:
            done = self._update(roots, extensions, registry, compat, told)
        return done | {"elapsed_ms": told.now()["elapsed_ms"]}

    def _update(self, roots: list[str], extensions: list[str] | None, registry: Registry | None, compat: bool, told: Progress) -> dict:
        from folioscan.sources.files import _exists

        files, reader = listed(self.spark, roots, extensions, registry), self.at()
        reachable = None if compat else [r for r in roots if _exists(self.spark, r)]
        path, numbers = f"{self.root}/data/changes-{uuid.uuid4().hex}", itertools.count()

        def kept(rows: DataFrame) -> DataFrame:
            name = f"{path}/{next(numbers)}"
            rows.write.parquet(name)
            return self.spark.read.schema(rows.schema).parquet(name)

        try:
            now = listing(files).select("file_path", "last_modified_ticks")
            folders = differing(reader, digests(now), roots, kept)
            if folders is None:
                old = reader.docs().select("file_path", "last_modified_ticks")
            else:
                folders = kept(folders)
                old = reader.entries(folders)
                now = now.withColumn("folder", folder_of(path_key(F.col("file_path")))).join(folders, "folder", "left_semi")
            changes = kept(diff(self._comparable(old), self._comparable(now), [self._bare(r) for r in roots], None if reachable is None else [self._bare(r) for r in reachable]))
            counts = {r["op"]: r["n"] for r in changes.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
            done = {"version": reader.version, "files": 0, "errors": 0}
            if counts:
                todo = changes.where("op <> 'delete'").select(F.lower("file_path").alias("k"))

                def commit(fresh: DataFrame) -> int:
                    gone = changes.where("op = 'delete'").select("file_path").unionByName(fresh.select(self._bare_column(F.col("file_path")).alias("file_path"))).select(F.lower("file_path").alias("k"))
                    out = old.join(gone, F.lower(self._bare_column(F.col("file_path"))) == gone["k"], "left_semi")
                    return self.append(fresh, out)

                done = self._indexed(files.join(todo, F.lower(self._bare_column(F.col("path"))) == todo["k"], "left_semi"), roots, registry, told, commit)
            return done | {k: counts.get(k, 0) for k in ("add", "update", "delete")}
        finally:
            self._fs.delete(self._path(path), True)

    @contextmanager
    def cancellable(self, tag: str) -> Iterator[None]:
        """The body ends with an error when ``cancel(tag)`` is called, from any thread: its
        jobs are interrupted, nothing more is published, and the index stays at its version."""
        self._tag, self._cancelled = tag, self._cancelled - {tag}
        self.spark.sparkContext.addJobTag(tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            self._tag = None

    def cancel(self, tag: str) -> None:
        """Interrupt what runs under a tag; what is between two jobs ends before the next."""
        self._cancelled = self._cancelled | {tag}
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _check(self) -> None:
        if self._tag in self._cancelled:
            raise InterruptedError(f"{self._tag} was cancelled")

    @staticmethod
    def _bare(path: str) -> str:
        return re.sub("^file:/*", "/", path)

    @staticmethod
    def _bare_column(path):
        return F.regexp_replace(path, "^file:/*", "/")

    def _comparable(self, rows: DataFrame) -> DataFrame:
        return rows.select(self._bare_column(F.col("file_path")).alias("file_path"), "last_modified_ticks")

    def index_folder(self, root: str) -> dict:
        """Index one folder's files on top of what is there."""
        with Progress(self.spark, None) as told:
            none = self.spark.createDataFrame([], "file_path string")
            # a scan has each path once, so no texts are moved to find the last of a path
            done = self._indexed(listed(self.spark, [root]), [root], None, told, lambda docs: self.append(docs, none))
        return done | {"elapsed_ms": told.now()["elapsed_ms"]}

    def upsert(self, docs: DataFrame) -> int:
        """Put documents in place of those with their paths; of several with one path the
        last by time stays."""
        last = upsert(self.spark.createDataFrame([], S.DOCS), docs)
        return self.append(last, self.spark.createDataFrame([], "file_path string"))

    def delete(self, paths: DataFrame) -> int:
        """Remove documents by path."""
        return self.append(self.spark.createDataFrame([], S.DOCS), paths)

    def compact(self, files: int = 8) -> int:
        """One segment of all, its documents in so many files."""
        with self._writing() as new:
            return self._publish_segments([new.join(self.segments(), keep_dead=False, files=files)])

    def vacuum(self, keep: int = 2, grace: float = 3600, orphans: float = 7 * 86400) -> list[int]:
        """Remove all but the last versions; the numbers of those removed.

        Folders that no version names any more are deleted by the first vacuum that
        comes ``grace`` seconds after that, unless a lease holds their version, so a query
        that reads them can end. Folders that no version ever named, left by writers that
        died, are deleted ``orphans`` seconds after they were last written to.
        """
        old = self.versions()[:-keep] if keep else []
        self._fs.mkdirs(self._path(f"{self.root}/removed"))
        for version in old:
            self._put(f"removed/{version:08d}", {**self._read(f"versions/{version:08d}"), "removed": time.time()}, overwrite=True)
            self._fs.delete(self._path(f"{self.root}/versions/{version:08d}.json"), False)
        leased, removed = self._leased(), {v: self._read(f"removed/{v:08d}") for v in self._numbers("removed")}
        held = [self._read(f"versions/{v:08d}") for v in self.versions()] + [x for v, x in removed.items() if v in leased or time.time() - x["removed"] < grace]
        used = {x["data"] for entry in held for x in entry["segments"]}
        for version, entry in removed.items():
            if version not in leased and time.time() - entry["removed"] >= grace:
                for x in entry["segments"]:
                    if x["data"] not in used:
                        self._fs.delete(self._path(x["data"]), True)
                self._fs.delete(self._path(f"{self.root}/removed/{version:08d}.json"), False)
        data = self._path(f"{self.root}/data")
        for x in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = x.getPath().getName()
            if not any(u.endswith(f"/{name}") for u in used) and time.time() - x.getModificationTime() / 1000 > orphans:
                self._fs.delete(x.getPath(), True)
        return old

    def stats(self) -> DataFrame:
        """One row: document_count, last_updated, index_size_bytes (of all segments)."""
        reader = self.at()
        size = sum(self._fs.getContentSummary(self._path(x["data"])).getLength() for x in reader.segments)
        return reader.docs().agg(F.count(F.lit(1)).alias("document_count"), F.max("indexed_at").alias("last_updated")).withColumn("index_size_bytes", F.lit(size).cast("bigint"))


class Segment:
    """A segment while it is written: documents first, then what is made of them."""

    def __init__(self, index: Index):
        self.index, self.spark = index, index.spark
        self.data = f"{index.root}/data/{uuid.uuid4().hex}"
        self.size, self.count, self.taken = 0, 0, 0

    def _read(self, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.data}/{part}")

    def documents(self, docs: DataFrame) -> DataFrame:
        """Write the documents; they are read from the segment then."""
        self.index._check()
        docs.select(*[F.col(f.name).cast(f.dataType) for f in S.DOCS.fields]).write.parquet(f"{self.data}/docs")
        now = self._read("docs", S.DOCS)
        self.size, self.count = now.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.count(F.lit(1))).first()
        return now

    def take_out(self, paths: DataFrame) -> int:
        """Take paths (file_path, and last_modified_ticks where digests need it) out of older
        segments; how many there are."""
        paths.write.parquet(f"{self.data}/dead")
        self.taken = self.dead().count()
        return self.taken

    def dead(self) -> DataFrame:
        """The paths that the segment takes out of older ones."""
        return self._read("dead", f"{DEAD}, last_modified_ticks bigint")

    def finish(self, posted: DataFrame | None, less: DataFrame | None = None, words: DataFrame | None = None, gone: DataFrame | None = None, folders: DataFrame | None = None) -> dict:
        """Write postings (``posted``, else those of the documents), their blocks, the dictionary (``words``, else that of the postings;
        ``less`` counted with negative signs) and its trigrams, and entries by folder with
        digests (``folders``, else those of the documents; ``gone`` taken out); what a version
        says of it."""
        self.index._check()
        buckets = max(self.index.buckets, -(-self.size // BUCKET_BYTES))
        write_postings(posted, f"{self.data}/postings", buckets, self.count, self.size, self._read("docs", S.DOCS), self.index.analyser)
        written = self._read("postings", POSTINGS)
        # of a document's terms one has its first place, so no others need be moved
        first = written.where((F.col("field") == "content") & (F.get("positions", F.lit(0)) == 0))
        first.groupBy("file_path").agg(F.max("length").cast("bigint").alias("length")).write.parquet(f"{self.data}/lengths")
        blocks_of(written).write.partitionBy("bucket").parquet(f"{self.data}/blocks")
        if words is None:
            words = self._read("blocks", BLOCKS).groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        if less is not None:
            words = words.unionByName(less.select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        words.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{self.data}/dictionary")
        grams = grams_of(self._read("dictionary", DICTIONARY), buckets)
        grams.repartition("bucket").sortWithinPartitions("bucket", "field", "gram").write.partitionBy("bucket").parquet(f"{self.data}/grams")
        docs, slots = self._read("docs", S.DOCS), slots_for(self.count + self.taken)
        sums = digests(docs) if folders is None else folders
        if gone is not None:
            sums = sums.unionByName(digests(gone, -1)).groupBy("folder", "parent").agg(*[F.sum(c).alias(c) if c in ("below", "own") else F.bit_xor(c).alias(c) for c in FOLDERS[2:]])
        write_folders(docs, sums, self.data, slots, max(1, -(-self.count // SLICE_DOCS)))
        return {"data": self.data, "slots": slots, "buckets": buckets, "dead": self.taken > 0, "size": self.size + DEAD_BYTES * self.taken, "documents": self.count}

    def join(self, segments: list[dict], keep_dead: bool, files: int | None = None) -> dict:
        """Make one segment of several that follow each other, its documents in so many
        files if that is given. Nothing is analysed again; paths that they take out of others
        are kept if there are older ones."""
        reader = Reader(self.spark, 0, segments, self.index.analyser)
        self.documents(reader.docs() if files is None else reader.docs().repartition(files))
        if keep_dead:
            dead = [self.spark.read.schema(DEAD).parquet(f"{x['data']}/dead") for x in segments if x["dead"]]
            if dead:
                self.take_out(reduce(DataFrame.unionByName, dead).distinct())
        words = reader.counts().where("df <> 0 or cf <> 0")
        made = self.finish(reader.grouped().drop("bucket", "block", "segment"), words=words, folders=reader.folders() if reader.has_folders() else None)
        return made if reader.has_folders() or not keep_dead else {k: v for k, v in made.items() if k != "slots"}
