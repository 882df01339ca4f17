"""Token ids in Arrow stream files with fixed-size-list batches.

A shard is one file in Arrow's streaming format. Each record batch holds the same
number of sequences (the last may hold fewer), each sequence the same number of
ids: ``input_ids`` is a fixed-size list of unsigned integers as wide as the
vocabulary needs, ``mask`` a fixed-size list of bits, unset where the last sequence
is padded. A reader maps the file, and any sequence is a view of the mapped memory.
Beside each shard a second stream file lists its documents and where they start.

Documents stand in ascending order of their ids over all shards; each is followed
by an end id. Shards are ranges of ids, written under another name first and then
renamed, so a task that is run again replaces its file by an equal one, and the folder
appears with all of them.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Memo, scratch_path, shuffle_partitions, utf8

#: Remembered words in each Python worker.
MOST_WORDS = 1_500_000


# What a tokenizer file says if its words may be encoded one by one.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_into_words(about: dict) -> bool:
    """Whether a tokenizer (its file's contents) lower-cases texts, drops white space
    and encodes what lies between, letters apart from other characters."""
    steps, splits = (about.get("normalizer") or {}).get("normalizers", []), (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    spaces = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x["type"] == "Replace")
    first = splits[0]
    return tuple(x["type"] for x in steps) == NORMALIZERS and spaces and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and bool(first.get("invert"))


class WordEncoder:
    """Ids of texts under a tokenizer file of the tokenizers library, special tokens in
    a text included, as the library finds them.

    Where the file says that texts are lower-cased and split at white space, the words
    between ASCII white space, in ASCII small letters, are encoded on their own, and
    ids of words that come again are remembered. The library encodes all other texts
    whole: those of other tokenizers, and those that hold a special token or its small letters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = (np.uint16, "H") if small else (np.uint32, "I")
        self.words = Memo(self._word, MOST_WORDS)
        self.by_words = _splits_into_words(json.loads(self.tokenizer.to_str()))
        self.special = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha():  # a mark after a letter is a piece of its own
            return self.words[word[:-1]] + self.words[word[-1:]]
        return self._ids(word)

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a text given in UTF-8."""
        small = text.lower()
        if not self.by_words or any(x in small for x in self.special):
            return np.frombuffer(self._ids(text), dtype=self.kind)
        return np.frombuffer(b"".join(map(self.words.__getitem__, small.split())), dtype=self.kind)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SequenceWriter:
    """Packs ids into sequences of ``length`` and writes them in batches of ``rows``."""

    def __init__(self, sink, kind: type, length: int, rows: int, about: dict):
        self.kind, self.length, self.rows = kind, length, rows
        value = pa.from_numpy_dtype(np.dtype(kind))
        self.schema = pa.schema([("input_ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], {b"about": json.dumps(about).encode()})
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * self.rows
        if self.held >= full:
            ids = np.concatenate(self.parts)
            for at in range(0, len(ids) - full + 1, full):
                self._write(ids[at : at + full])
            self.parts = [ids[len(ids) - len(ids) % full :]]
            self.held = len(self.parts[0])

    def _write(self, ids: np.ndarray) -> None:
        padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.kind)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.parts))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a shard; the arrays are views of ``source``,
    which is the memory of a mapped file where the file system allows it."""

    def __init__(self, source: pa.NativeFile | pa.Buffer):
        reader = pa.ipc.open_stream(source)
        self.about = json.loads(reader.schema.metadata[b"about"])
        self.batches = list(reader)  # the messages' heads are read, their bodies only when used
        self.rows = self.about["rows"]
        self.length = self.about["length"]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, column: int, k: int):
        batch = self.batches[k // self.rows]
        return batch.column(column).flatten().slice(k % self.rows * self.length, self.length)

    def ids(self, k: int) -> np.ndarray:
        """The ids of sequence ``k``, padding included; not copied."""
        return self._row(0, k).to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> np.ndarray:
        """Which ids of sequence ``k`` are no padding."""
        return self._row(1, k).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, over the borders of sequences and batches."""
        full, parts = self.rows * self.length, []
        while n > 0:
            batch = self.batches[start // full].column(0).flatten()
            at = start % full
            part = batch.slice(at, n).to_numpy(zero_copy_only=True)
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def open_sequences(folder: str, shard: int) -> SequenceFile:
    """A shard of ``folder``: mapped if the folder is local, else read."""
    files, path = _files(folder)
    name = f"{path}/{shard:06d}.arrow"
    return SequenceFile(pa.memory_map(name) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(name))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 1024, rows: int = 64, shards: int | None = None
) -> list[tuple[int, int, int]]:
    """Write the texts of ``docs`` to shards in ``folder``; return (shard, documents, ids) of each.

    The answer has one entry per shard, of some 64 MB of text each. Null texts count
    as empty: just the end id. Null ids come first. Rows with equal ids are ordered by
    a hash of their text, and so may lie in several shards, however many there are;
    repeated rows are documents each. Texts may be of any length. Further columns are
    ignored; no rows give no shards.

    Shards are written beside ``folder``, which appears when all are there; it must not
    hold files yet.
    """
    kind, target = docs.schema[id_col].dataType.simpleString(), folder.rstrip("/")
    files, path = _files(target)
    if files.get_file_info(path).type != pafs.FileType.NotFound and files.get_file_info(pafs.FileSelector(path)):
        raise ValueError(f"{target} holds files")
    folder = f"{target}.{uuid.uuid4().hex}.part"
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    dealt = rows_in.repartitionByRange(shards or shuffle_partitions(rows_in), *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer, index, count = TaskContext.get(), _encoder(tokenizer_path), None, None, 0
        shard = task.partitionId()
        files, path = _files(folder)
        finals = [f"{path}/{shard:06d}{x}.arrow" for x in ("", "-docs")]
        parts = [f"{x}.{task.taskAttemptId()}.part" for x in finals]
        end = np.array([end_id], dtype=encoder.kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(path, recursive=True)
                sinks = [files.open_output_stream(x, compression=None) for x in parts]
                writer = SequenceWriter(sinks[0], encoder.kind, length, rows, {"rows": rows, "length": length, "end_id": end_id, "tokenizer": os.path.basename(tokenizer_path)})
                index = pa.ipc.new_stream(sinks[1], _index_schema(batch))
            starts, sizes = [], []
            for text in utf8(batch.column(1)):
                starts.append(writer.total)
                writer.add(encoder.encode(text))
                writer.add(end)
                sizes.append(writer.total - starts[-1])
            count += len(sizes)
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_index_schema(batch)))
        if writer is None:
            return
        writer.close()
        index.close()
        for sink, part, final in zip(sinks, parts, finals):
            sink.close()
            files.move(part, final)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([count], pa.int64()), pa.array([writer.total], pa.int64())], names=["shard", "docs", "ids"])

    found = dealt.mapInArrow(write, "shard int, docs bigint, ids bigint").collect()
    if found:
        files.create_dir(os.path.dirname(path), recursive=True)
        if files.get_file_info(path).type != pafs.FileType.NotFound:
            files.delete_dir(path)  # it is empty
        files.move(_files(folder)[1], path)
    return sorted((r["shard"], r["docs"], r["ids"]) for r in found)


def _index_schema(batch: pa.RecordBatch) -> pa.Schema:
    """The schema of a shard's list of documents."""
    return pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(docs: DataFrame, folder: str, shards: list[tuple[int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards, from the files alone: id, start (ids of
    all documents before it), n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), shard. ``docs`` gives the session and the id's type."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"
    if not shards:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    bases = list(zip((s for s, *_ in shards), accumulate((ids for *_, ids in shards), initial=0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                sequences = open_sequences(folder, shard)
                for listed in pa.ipc.open_stream(files.open_input_stream(f"{path}/{shard:06d}-docs.arrow")):
                    starts, sizes = listed.column(1).to_numpy(), listed.column(2).to_numpy()
                    crcs = [zlib.crc32(sequences.span(s, n).astype("<u4")) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch(
                        [listed.column(0), pa.array(starts + base), listed.column(2), pa.array(crcs, pa.int64()), pa.array([shard] * len(crcs), pa.int32())], names=["id", "start", "n_tokens", "ids_crc32", "shard"]
                    )

    # a task gets its own shards and what comes before them
    return spark.createDataFrame(bases, "shard int, base bigint").repartitionByRange(len(bases), "shard").mapInArrow(read, schema).withColumnRenamed("id", id_col)


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files to a new folder of the scratch folder, or to
    ``folder``, and return ``read_token_files`` of them."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(docs, folder, write_token_files(docs, folder, tokenizer_path, id_col, text_col, **options), id_col)
