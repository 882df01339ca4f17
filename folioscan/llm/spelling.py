"""Spelling variants by full neighbourhoods.

Each word emits all distinct strings that one deletion, replacement or insertion makes
of it, with the letters that the vocabulary has; those that are words, too, are its
neighbours, which takes a hash join and no measure of distance. Before candidates leave
their task they pass a table of bits of a fixed size with the hashes of all words, so
few but words are shuffled; the join decides.

Hashes are sums of letter times power of an odd base, modulo 2**64: those of all strings
made of a word follow from the sums over its beginnings and ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, written

BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd
UNBASE = pow(BASE, -1, 1 << 64)
#: Bits of the table that candidates pass (32 MB), those of a row of it, and candidates looked at together.
TABLE_BITS, ROW_BITS, TILE = 28, 15, 1 << 19
#: Words for each task.
TASK_WORDS = 20_000


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length and their code points, one word per row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, TILE // n)
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            yield part, np.frombuffer("".join(words[i] for i in part.tolist()).encode("utf-32-le"), np.uint32).reshape(len(part), n)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and bit, in the table, of each word."""
    for batch in batches:
        for _, codes in _by_length(batch.column("word").to_pylist()):
            bits = np.unique(_bit((codes * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))).astype(np.int64)
            yield pa.record_batch({"row": pa.array((bits >> ROW_BITS).astype(np.int32)), "bit": pa.array((bits & ((1 << ROW_BITS) - 1)).astype(np.int32))})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the table as bytes."""
    for batch in batches:
        rows = []
        for bits in batch.column("bits").to_pylist():
            row = np.zeros(1 << ROW_BITS, np.uint8)
            row[bits] = 1
            rows.append(np.packbits(row, bitorder="little").tobytes())
        yield pa.record_batch({"row": batch.column("row"), "bytes": pa.array(rows, pa.binary())})


def _table(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of all words: always 32 MB, whatever the number of words."""
    rows = words.select("word").mapInArrow(_bits_of, "row int, bit int").groupBy("row").agg(F.collect_set("bit").alias("bits"))
    table = np.zeros((1 << TABLE_BITS - ROW_BITS, 1 << ROW_BITS - 3), np.uint8)
    for r in rows.mapInArrow(_packed, "row int, bytes binary").toLocalIterator():
        table[r["row"]] = np.frombuffer(r["bytes"], np.uint8)
    return table.reshape(-1)


def neighbours(words: list[str], letters: str, table: np.ndarray | None = None) -> Iterator[tuple[int, str]]:
    """Place of a word and each distinct string that one edit with ``letters`` makes of
    it, or of these what ``table`` may hold.

    One edit of several that make the same string counts: the first letter of a run is
    deleted, and no letter is put behind its like.
    """
    alphabet = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
    for at, codes in _by_length(words):
        n = codes.shape[1]
        powers = _powers(n + 1)
        terms = codes * powers[:n]
        ends = np.zeros((len(at), n + 1), np.uint64)  # sums from a place on
        ends[:, :n] = np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        starts = ends[:, :1] - ends
        twice = np.zeros((len(at), n), bool)  # same letter as before
        twice[:, 1:] = codes[:, 1:] == codes[:, :-1]
        own = alphabet.astype(np.uint64) * powers[: n + 1, None]  # place x letter
        row_step, place_step = max(1, TILE // ((n + 1) * len(alphabet) or 1)), max(1, TILE // (len(alphabet) or 1))
        for a in range(0, len(at), row_step):
            rows = slice(a, a + row_step)
            for p in range(0, n + 1, place_step):
                gone, place = slice(p, min(n, p + place_step)), slice(p, p + place_step)
                after = slice(gone.start + 1, gone.stop + 1)
                made = [
                    ("delete", (starts[rows, gone] + ends[rows, after] * np.uint64(UNBASE))[:, :, None], ~twice[rows, gone, None]),
                    ("replace", (starts[rows, gone] + ends[rows, after])[:, :, None] + own[gone], codes[rows, gone, None] != alphabet),
                ]
                before = np.zeros((codes[rows].shape[0], n + 1), np.uint32)
                before[:, 1:] = codes[rows]
                made.append(("insert", (starts[rows, place] + ends[rows, place] * np.uint64(BASE))[:, :, None] + own[place], before[:, place, None] != alphabet))
                for kind, hashes, once in made:
                    if table is not None:
                        bits = _bit(hashes)
                        once = once & ((table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    for i, j, k in np.argwhere(once).tolist():
                        word, j = words[at[a + i]], j + p
                        yield int(at[a + i]), word[:j] + ("" if kind == "delete" else letters[k]) + word[j + (kind != "insert") :]


def word_counts(docs: DataFrame, words: Column, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word and n of the strings in the array column ``words`` that have at least so many
    code points and occurrences. Null arrays and strings don't count."""
    each = docs.select(F.explode(words).alias("word")).where(F.length("word") >= least_chars)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def spelling_variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``counts`` (word, n).

    Words are near if they differ by exactly one letter inserted, deleted or replaced. A
    word's form is its near word with the largest n (ties: the smallest in code-point
    order), if that n is at least ``times`` its own; root is what forms lead to at last,
    the word itself where it has none. n_near counts near words.

    Words are expected once each, without null; the empty word is near no other. No words
    give no rows, and other columns are ignored. Letters are those of the words, so the
    driver holds an alphabet, and a table of 32 MB. As n doubles from word to form, roots
    are found in a few rounds, each of which halves the way.
    """
    spark = counts.sparkSession
    with Scratch(spark) as scratch:
        words = scratch.written(counts.select("word", F.col("n").cast("bigint").alias("n")).where("word is not null"), "words")
        letters = "".join(sorted(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()))
        tasks = max(spark.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))
        dealt = words.repartition(tasks, "word")
        table = spark.sparkContext.broadcast(_table(dealt))

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
                made: list[tuple[int, str]] = []
                for x in neighbours(own, letters, table.value):
                    made.append(x)
                    if len(made) == 50_000:
                        yield pack(made, own, n)
                        made = []
                yield pack(made, own, n)

        def pack(made: list[tuple[int, str]], own: list[str], n: list[int]) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array([s for _, s in made], pa.string()), "near": pa.array([own[i] for i, _ in made], pa.string()), "near_n": pa.array([n[i] for i, _ in made], pa.int64())})

        # each string comes once from each word near it, so rows count words
        near = dealt.mapInArrow(candidates, "word string, near string, near_n bigint").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        found = words.join(near, "word", "left")
        formed = -F.col("best.less") >= times * F.col("n")
        forms = scratch.written(
            found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms"
        )
        table.unpersist()
        ways = scratch.written(forms.where("form is not null").select("word", F.col("form").alias("root")), "ways")
        while True:
            onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
            ways = scratch.written(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
            if not ways.where("moved").limit(1).count():
                break
            ways = ways.drop("moved")
        out = forms.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "spelling")
