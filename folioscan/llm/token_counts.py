"""Token counts kept as rollups of signed deltas.

A ledger is a folder. A batch is a table of signed changes: an insert adds a
document's tokens, a delete takes them away, a revision takes the old count away and
adds the new one. Committing a batch sums its changes by source, language and
tokenizer version and writes the sums under a name of their own; a small file named
by the batch then makes them count. That file is created by an atomic rename that
fails if it exists, so a batch that is sent again, or finished by two drivers, counts
once. Totals are the sums over the committed batches, and folding replaces many
batches by their sums.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.byte_bpe import read_ranks
from folioscan.llm.shared import utf8
from folioscan.llm.token_files import WordEncoder

KEYS = ("source", "lang", "tokenizer")
#: How the names of folds begin: no batch is named so, and they sort behind all batches.
FOLD = "~fold-"
SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


class TokenLedger:
    """Additive totals of documents and tokens in ``root``, a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path(f"{self.root}/commits"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _entries(self) -> dict[str, dict]:
        """The committed files and what they say, folds last and in their order. A file
        that a fold deletes meanwhile means that the fold is to be read: start again."""
        while True:
            found = {s.getPath().getName(): s.getPath() for s in self.files.listStatus(self._path(f"{self.root}/commits"))}
            out = {}
            for name in sorted(n for n in found if n.endswith(".json")):
                try:
                    stream = self.files.open(found[name])
                except Py4JJavaError as e:
                    if "FileNotFoundException" not in e.java_exception.getClass().getName():
                        raise
                    break
                try:
                    out[name] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
            else:
                return out

    def committed(self) -> dict[str, str]:
        """The committed batches and the folders of their sums."""
        return {batch: entry["data"] for entry in self._entries().values() for batch in entry["batches"]}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (columns source, lang, tokenizer, documents, tokens; both
        numbers signed, null is 0) as ``batch``; false if that batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        data = f"{self.root}/data/{batch}-{uuid.uuid4().hex}"
        self._summed(changes).write.parquet(data)
        return self._publish(batch, [batch], data)

    def _publish(self, name: str, batches: list[str], data: str) -> bool:
        entry = json.dumps({"batches": batches, "data": data}).encode()
        part = self._path(f"{self.root}/commits/.{name}-{uuid.uuid4().hex}")
        out = self.files.create(part)
        out.write(bytearray(entry))
        out.close()
        final = self._path(f"{self.root}/commits/{name}.json")
        if self.files.exists(final) or not self.files.rename(part, final):
            self.files.delete(part, False)
            return False
        return True

    def _summed(self, changes: DataFrame) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(total("documents"), total("tokens"))

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; keys whose
        changes cancelled out stay with zeros. Null keys are keys. Empty if nothing
        was committed."""
        return self._sums(sorted(set(self.committed().values())))

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self._summed(self.spark.read.schema(SCHEMA).parquet(*folders))

    def fold(self) -> bool:
        """Replace the committed batches by one set of sums; the batches stay known.

        A batch that commits meanwhile stays as it is. Of two folds at a time one
        counts, and the other one does nothing and is false.
        """
        entries = self._entries()
        committed = {batch: entry["data"] for entry in entries.values() for batch in entry["batches"]}
        if len(set(committed.values())) < 2:
            return False
        last = max((int(name[len(FOLD) : -len(".json")]) for name in entries if name.startswith(FOLD)), default=0)
        name = f"{FOLD}{last + 1:012d}"
        data = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        self._sums(sorted(set(committed.values()))).write.parquet(data)
        if not self._publish(name, sorted(committed), data):
            self.files.delete(self._path(data), True)
            return False
        self._forget(sorted(entries))
        return True

    def _forget(self, names: list[str]) -> None:
        """Delete the files that a fold has read. Their sums stay for those who read them now."""
        for name in names:
            self.files.delete(self._path(f"{self.root}/commits/{name}"), False)


def counted(docs: DataFrame, tokenizers: dict[str, str], pattern: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """source, lang and, under each name of ``tokenizers``, the tokens of each text.

    A path to a rank file counts by byte-level BPE of the matches of ``pattern``, one to
    a tokenizer file by the tokenizers library. A null text has no tokens; repeated
    rows count each, and no rows give no rows.
    """
    names = list(tokenizers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_counter(path, pattern) for path in tokenizers.values()]
        for batch in batches:
            texts = utf8(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([c(t) for t in texts], pa.int64()) for c in counters)], names=["source", "lang", *names])

    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "source string, lang string, " + ", ".join(f"`{n}` bigint" for n in names))


@lru_cache(maxsize=4)
def _counter(path: str, pattern: str) -> Callable[[bytes], int]:
    if path.endswith(".tiktoken"):
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        return lambda text: len(coder.encode_ordinary(text.decode()))
    encoder = WordEncoder(path)
    return lambda text: len(encoder.encode(text))


def changes(docs: DataFrame, tokenizer: str, count: Column, sign: int = 1, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Signed changes for the rows of ``docs``: ``count`` tokens each under ``tokenizer``.

    A null count is 0. Null sources and languages are keys; repeated rows count each,
    and rows with equal keys, very long texts and further columns make no difference.
    No rows give no changes: committing them makes the batch known and adds nothing.
    """
    return docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("bigint").alias("documents"), (F.coalesce(count, F.lit(0)) * sign).cast("bigint").alias("tokens"),
    )
