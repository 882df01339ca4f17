"""Language-model scoring with a probabilistic suffix tree over words.

A text's symbols are its words, A-Z lower-cased, and one end; a word is known by its
64-bit hash. A context is the string of symbols before a symbol, up to a fixed depth
and never beyond the start of the text. The root of the tree is the add-one unigram of
the training texts, in which all words that training never saw share one more symbol's
chance; so the tree and the base score speak about the same events.

Training counts what follows every context that occurs a fixed number of times,
whatever the size of the corpus, so the tree grows with it. A context stays in the tree
if what follows it diverges from its parent's distribution: if each of its symbols,
foretold from the others, is likelier than under the parent on the whole. What follows
a context that stays is smoothed with its parent's distribution, in proportion to the
kinds of symbols seen there; a symbol's chance is that of the longest state of its
context, and passes through contexts that were left out.

All texts are kept as blocks of a few million symbols, one file each. On each level of
the tree a block sends its distinct contexts and symbols, with their counts, to shards
by context; a shard adds up and judges its contexts and answers each block. So what
moves are a block's distinct strings, packed, and never texts or single symbols; a
context's strings come together once for each block that holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Scratch, lists, scans_files, shuffle_partitions, small_batches, word_hashes, written

#: Symbols in a block; a longer text is a block of its own.
BLOCK = 2_000_000
#: The end's hash, and the steps in one natural unit in which a parent's chance is sent.
END, STEPS = 0, 8
#: Tasks in which blocks are followed.
MOST_TASKS = 1 << 16
PACKED = pa.Codec("zstd", compression_level=3)
MOVED = "shard int, block bigint, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on in few bytes: no wider than their largest number, their
    bytes by place, compressed."""
    narrow = [a.astype(np.min_scalar_type(a.max(initial=0)), copy=False) for a in arrays]
    head = np.array([len(narrow), *(x for a in narrow for x in (a.dtype.itemsize, len(a)))], dtype=np.int64)
    raw = b"".join([head.tobytes(), *((a >> a.dtype.type(8 * i) if i else a).astype(np.uint8).tobytes() for a in narrow for i in range(a.dtype.itemsize))])
    return len(raw).to_bytes(8, "little") + PACKED.compress(raw, asbytes=True)


def unpack(data: bytes | memoryview, *kinds: type) -> list[np.ndarray]:
    """The arrays of ``pack``, as these types."""
    raw = PACKED.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size, length in zip(kinds, sizes[::2], sizes[1::2]):
        whole = np.zeros(length, f"u{size}")
        for i in range(size):
            whole |= np.frombuffer(raw, np.uint8, length, at + i * length).astype(whole.dtype) << whole.dtype.type(8 * i)
        out.append(whole.astype(kind))
        at += size * length
    return out


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending runs of numbers, which begin at ``starts``, as differences."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _climbed(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of ``_steps``."""
    total = np.cumsum(steps)
    return total - np.repeat(total[starts] - steps[starts], np.diff(np.append(starts, len(steps)))) if len(steps) else total


def _joined(parts: list[list[np.ndarray]], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of words (hashes), in as few bytes as it takes."""
    return (((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)).astype(np.min_scalar_type(shards))


def _shard(numbers: np.ndarray, shards: int) -> np.ndarray:
    """The shard of contexts. A context's number says which shard it comes from and its
    rank there; ranks that follow each other go to different shards, and in a shard
    the rank alone tells contexts apart."""
    return ((numbers - 1) // shards + (numbers - 1) % shards) % shards


def _order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of codes (from 0 on) in the codes' order, then in their own, and how often
    each distinct code occurs. Where codes and places fit into one number together, numbers
    are sorted, which takes a fraction of the time that sorting places by codes takes."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits < 64:
        codes = np.sort((codes << bits) | np.arange(len(codes)))
        order, codes = codes & ((1 << bits) - 1), codes >> bits
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)])
    return order, np.diff(starts, append=len(codes))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct code, in the codes' order, and the number of each code."""
    order, counts = _order(codes)
    inverse = np.empty(len(codes), np.int64)
    inverse[order] = np.repeat(np.arange(len(counts)), counts)
    return order[np.cumsum(counts) - 1], inverse  # whichever comes last


def _put(folder: str, name: str, data: bytes) -> None:
    """A file of the folder; one that a task writes again takes the other's place."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/{name}.{TaskContext.get().taskAttemptId()}.part"
    with files.open_output_stream(part, compression=None) as out:
        out.write(data)
    files.move(part, f"{path}/{name}")


def _got(folder: str, name: str) -> bytes:
    files, path = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def _rows(shard: list, block: list, data: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["shard", "block", "data"])


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each value of ``by`` (rows come ordered) with the other key and data of its rows;
    rows without data only say that there is such a value."""
    other = "block" if by == "shard" else "shard"
    last, held = None, []
    for batch in batches:
        for own, x, data in zip(batch.column(by).to_pylist(), batch.column(other).to_pylist(), batch.column("data")):
            if own != last and last is not None:
                yield last, held
                held = []
            last = own
            held.append((x, data.as_buffer().to_pybytes() if data.is_valid else None))
    if last is not None:
        yield last, held


class Block:
    """A block's texts: the local number of each symbol, and what the levels answered."""

    #: What is answered about words: counts and numbers.
    WORDS = (np.int64, np.int64)
    #: What is answered about a level: for each string its count, and for each that occurs
    #: often enough to be a context its rank in the shard, as steps; for each context its
    #: occurrences and kinds (0: left out).
    ANSWERS = (np.int64, np.int64, np.int64, np.int64)

    def __init__(self, folder: str, block: int, shards: int):
        self.folder, self.block, self.shards = folder, block, shards
        self.by_shard, self.at, sizes, self.train = unpack(_got(folder, f"{block}.bin"), np.int64, np.int64, np.int64, np.bool_)
        self.sizes, self.in_training = sizes, np.repeat(self.train, sizes)
        self.starts = np.cumsum(sizes) - sizes

    def answer(self, level: int, least: int) -> tuple[np.ndarray, ...]:
        """What the shards answered to a level: counts, numbers (0 where a string occurs too
        rarely to be a context), and the occurrences and kinds of contexts."""
        parts, often, n, ranks, seen, kinds = unpack(_got(self.folder, f"{self.block}-{level}.bin"), *[np.int64] * 6)
        number, some = np.zeros(len(n), np.int64), n >= least
        parts, often = parts[often > 0], often[often > 0]
        number[some] = _climbed(ranks, np.cumsum(often) - often) * self.shards + np.repeat(parts, often) + 1
        return n, number, seen, kinds

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts and numbers of the block's words, which come in the order of shards."""
        answers = unpack(_got(self.folder, f"{self.block}-0.bin"), *Block.WORDS)
        out = [np.zeros(len(self.by_shard), np.int64) for _ in answers]
        for x, answer in zip(out, answers):
            x[self.by_shard] = answer
        return out[0], out[1]

    def after(self, numbers: np.ndarray) -> np.ndarray:
        """What stands before each symbol in its text; 0 at the start."""
        out = np.zeros(len(self.at), dtype=np.int64)
        out[1:] = numbers[:-1]
        out[self.starts] = 0
        return out

    def before(self, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """``after``, for numbers at some places; they are 0 at the others."""
        out = np.zeros(len(self.at) + 1, dtype=np.int64)
        out[places + 1] = numbers
        out[self.starts] = 0
        return out[:-1]

    def level(self, local: np.ndarray, contexts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct strings of a level. ``contexts`` has the number of each symbol's
        context or 0, ``local`` the block's own number of it, ``ranks`` the order of words.
        Returns the places of symbols with a context, string by string; and for the strings,
        ordered by shard, context and word, how many places each has, one of them, and the
        start of each context."""
        places = np.flatnonzero(contexts)
        context = local[places]
        number = np.zeros(int(context.max(initial=0)) + 1, np.int64)
        number[context] = contexts[places]
        used = np.flatnonzero(number)
        own, number = _shard(number[used], self.shards), number[used]
        bits = int(number.max(initial=0)).bit_length()
        order = _order((own << bits) | number)[0] if bits + self.shards.bit_length() < 63 else np.lexsort((number, own))
        rank = np.zeros(int(context.max(initial=0)) + 1, np.int64)
        rank[used[order]] = np.arange(len(used)) * len(self.by_shard)
        order, sizes = _order(rank[context] + ranks[self.at[places]])
        places = places[order]
        first = places[np.cumsum(sizes) - 1]
        own = contexts[first]
        return places, sizes, first, np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)


def _blocks(folder: str, shards: int) -> Callable:
    """Texts (id, words as hashes, train) to blocks, and the words of each to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for words, i, train in zip(lists(batch.column(1)), range(batch.num_rows), batch.column(2).to_pylist()):
                held.append((batch.column(0).slice(i, 1), words, train))
                size += len(words) + 1
                if size >= BLOCK:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush(held, number)

    def flush(held: list, block: int) -> Iterator[pa.RecordBatch]:
        end, train = np.array([END], np.uint64), np.array([t for _, _, t in held])
        sizes = np.array([len(w) + 1 for _, w, _ in held], np.int64)
        coded = pc.dictionary_encode(pa.array(np.concatenate([x for _, w, _ in held for x in (w, end)])))
        words, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        often = np.argsort(-np.bincount(at), kind="stable")  # frequent words get small numbers, which take few bytes
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        words, at = words[often], rank[at]
        table = pa.table({"id": pa.concat_arrays([i for i, _, _ in held])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        _put(folder, f"{block}.arrow", sink.getvalue().to_pybytes())
        counts = np.bincount(at[np.repeat(train, sizes)], minlength=len(words))
        own = _word_shard(words, shards)
        order = np.argsort(own, kind="stable")
        _put(folder, f"{block}.bin", pack(order, at, sizes, train))
        cuts = np.flatnonzero(np.diff(own[order].astype(np.int64), prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            yield _rows([own[order[a]]], [block], [pack(words[order[a:b]], counts[order[a:b]])])

    return run


def _counted_words(shards: int) -> Callable:
    """A shard's words: their counts and numbers, frequent ones first, to each block;
    and under block -1 all occurrences in training, and the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            parts = [unpack(data, np.uint64, np.int64) for _, data in rows]
            words, counts = _joined(parts, (np.uint64, np.int64))
            _, inverse = np.unique(words, return_inverse=True)
            total = np.bincount(inverse, counts).astype(np.int64)
            rank = np.empty(len(total), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
            yield _rows([shard], [-1], [np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()])
            start = 0
            for (block, _), part in zip(rows, parts):
                own = inverse[start : start + len(part[0])]
                start += len(own)
                yield _rows([shard], [block], [pack(total[own], rank[own] * shards + shard + 1)])

    return run


def diverges(n: np.ndarray, context: np.ndarray, total: np.ndarray, kinds: np.ndarray, parent: np.ndarray, prior: float) -> np.ndarray:
    """Which contexts diverge from their parent: whether what follows them (counts ``n``
    of the strings, with their number of ``context`` and chance under the ``parent``) is
    likelier, each occurrence foretold from the others, than under the parent."""
    smooth = prior * kinds[context]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * np.log((n - 1 + smooth * parent) / (total[context] - 1 + smooth) / parent)
    return np.bincount(context, np.where(n > 0, gain, 0.0), minlength=len(total)) > 0


def _judged_contexts(shards: int, least: int, prior: float) -> Callable:
    """A shard's contexts of a level: what each block asked about them."""
    sent = (np.int64, np.int64, np.int64, np.int64, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            asked = [(block, _heard(unpack(data, *sent))) for block, data in rows if data is not None]
            yield from (_rows([shard], [block], [None]) for block, data in rows if data is None)
            contexts, sizes, words, counts, chances = _joined([a for _, a in asked], sent)
            _, at = np.unique(contexts, return_inverse=True)
            every, most = np.repeat(at, sizes), words.max(initial=0) + 1
            first, inverse = _distinct(every * most + words)
            trained = np.flatnonzero(counts)
            first[inverse[trained]] = trained  # only these say how likely they are
            of = every[first]
            n, parent = np.bincount(inverse, counts, minlength=len(first)).astype(np.int64), np.exp(chances[first] / -STEPS)
            kinds_of = int(of[-1]) + 1 if len(of) else 0
            total, kinds = np.bincount(of, n, minlength=kinds_of).astype(np.int64), np.bincount(of, n > 0, minlength=kinds_of).astype(np.int64)
            kinds[~((total >= least) & diverges(n, of, total, kinds, parent, prior))] = 0
            rank = np.cumsum(n >= least) - 1
            n = np.where(kinds[of] > 0, n, np.minimum(n, least))  # where a context is left out, counts are not used
            total[kinds == 0] = 0
            string = context = 0
            for block, (own, own_sizes, own_words, _, _) in asked:
                s, c = inverse[string : string + len(own_words)], at[context : context + len(own)]
                string, context = string + len(s), context + len(c)
                ranks = rank[s][n[s] >= least]
                yield _rows([shard], [block], [pack(n[s], _steps(ranks, np.arange(min(1, len(ranks)))), total[c], kinds[c])])

    return run


def _told(contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, chances: np.ndarray) -> bytes:
    """What a block asks of a shard: contexts (ranks) and the words after each ascend."""
    return pack(_steps(contexts, np.arange(min(1, len(contexts)))), sizes, _steps(words, np.cumsum(sizes) - sizes), counts, chances)


def _heard(asked: list[np.ndarray]) -> list[np.ndarray]:
    contexts, sizes, words, counts, chances = asked
    return [np.cumsum(contexts), sizes, _climbed(words, np.cumsum(sizes) - sizes), counts, chances]


def _stored(folder: str, level: int) -> Callable:
    """The shards' answers to a level of each block, to a file of the block."""
    kinds = Block.ANSWERS if level else Block.WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "block"):
            if number < 0:
                sums = np.sum([np.frombuffer(data, np.int64) for _, data in rows], axis=0).tolist()
                yield _counts([number], [sums[0]], [sums[1]])
                continue
            told = [(shard, unpack(data, *kinds)) for shard, data in rows if data is not None]
            parts = [np.array([shard for shard, _ in told], np.int64), np.array([len(x[1]) for _, x in told], np.int64)] if level else []
            _put(folder, f"{number}-{level}.bin", pack(*parts, *_joined([x for _, x in told], kinds)))
            yield _counts([number], [0], [0])

    return run


def _counts(block: list, total: list, distinct: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (block, total, distinct)], names=["block", "total", "distinct"])


def _levels(block: Block, answered: int, total: int, distinct: int, least: int, prior: float):
    """Follow a block through the levels that were answered. Returns the counts, numbers
    and order of its words, the chance of each symbol so far and, of the next level, the
    numbers of contexts and the block's own."""
    counts, numbers = block.by_word()
    ranks = np.empty(len(numbers), np.int64)
    ranks[_order(numbers)[0]] = np.arange(len(numbers))
    chance = (counts[block.at] + 1) / (total + distinct + 1)
    contexts = block.after(np.where(counts >= least, numbers, 0)[block.at])
    local = block.after(block.at)
    for level in range(1, answered + 1):
        places, sizes, _, starts = block.level(local, contexts, ranks)
        n, number, seen, kinds = block.answer(level, least)
        context = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
        kept = kinds[context] > 0
        smooth = prior * kinds[context[kept]]
        at, of = places[np.repeat(kept, sizes)], sizes[kept]
        chance[at] = (np.repeat(n[kept], of) + np.repeat(smooth, of) * chance[at]) / np.repeat(seen[context[kept]] + smooth, of)
        some = number > 0
        at, of = places[np.repeat(some, sizes)], sizes[some]
        contexts, local = block.before(at, np.repeat(number[some], of)), block.before(at, np.repeat(np.flatnonzero(some), of))
    return counts, numbers, ranks, chance, contexts, local


def _asked(folder: str, shards: int, level: int, total: int, distinct: int, least: int, prior: float) -> Callable:
    """Blocks to what they ask about the strings of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from ask(number)

    def ask(number: int) -> Iterator[pa.RecordBatch]:
        block = Block(folder, number, shards)
        _, numbers, ranks, chance, contexts, local = _levels(block, level - 1, total, distinct, least, prior)
        places, many, first, starts = block.level(local, contexts, ranks)
        n = np.diff(np.cumsum(block.in_training[places], dtype=np.int64)[np.cumsum(many) - 1], prepend=0)
        steps = np.where(n > 0, np.minimum(np.rint(-np.log(chance[first]) * STEPS), 255), 0).astype(np.uint8)
        own = _shard(contexts[first[starts]], shards)
        cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
        yield _rows([number % shards], [number], [None])  # a block that asks nothing goes on, too
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            lo, hi = starts[a], starts[b] if b < len(starts) else len(first)
            sizes = np.diff(np.append(starts[a:b], hi))
            yield _rows([own[a]], [number], [_told((contexts[first[starts[a:b]]] - 1) // shards, sizes, numbers[block.at[first[lo:hi]]], n[lo:hi], steps[lo:hi])])

    return run


def _scored(folder: str, shards: int, depth: int, total: int, distinct: int, least: int, prior: float) -> Callable:
    """Blocks to the scores of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield score(number)

    def score(number: int) -> pa.RecordBatch:
        block = Block(folder, number, shards)
        counts, _, _, chance, _, _ = _levels(block, depth, total, distinct, least, prior)
        ids = pa.ipc.open_stream(_got(folder, f"{number}.arrow")).read_all().column("id").combine_chunks()
        own, whole = counts[block.at], np.full(len(block.sizes), total, np.int64)
        known = np.add.reduceat((own > 0).astype(np.int64), block.starts)
        base, score = (np.add.reduceat(np.log10(x), block.starts) for x in ((own + 1) / (total + distinct + 1), chance))
        return pa.record_batch(
            [ids, pa.array(~block.train), pa.array(block.sizes), pa.array(known), pa.array(whole), pa.array(base), pa.array(score)],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, prior: float = 4.0, least: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, held_out (not ``train``), n_tokens (words and
    the end), n_known (tokens that occur in training texts), train_tokens, base_score
    (log10 probability under add-one unigrams of the training tokens), score (log10
    probability under the suffix tree of the training texts).

    Contexts have up to ``depth`` tokens, and occur ``least`` times in training; a kept
    context's counts are smoothed with ``prior`` times its kinds of next tokens.

    ``train`` is a condition on the columns of ``docs``; null means training. A null
    text counts as empty: one end. Null ids are kept, rows that repeat an id are
    scored each, further columns are ignored. Without training texts every token has
    the one chance there is, 1. No rows give no rows. A text of any length is held in
    memory as a whole, as 8 bytes for each word. Rows that don't come straight from files
    are written first, so that a task that runs again makes the same blocks. The answer is
    written, and what it took is deleted.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    shards = shuffle_partitions(docs.select(text_col))
    with Scratch(docs.sparkSession) as blocks, Scratch(docs.sparkSession) as scratch:
        if not scans_files(rows):
            rows = blocks.written(rows, "texts")
        folder, rows = blocks.path("suffix-tree"), small_batches(rows.select("id", word_hashes(F.col("text")).alias("words"), "train"))

        def answered(asked: DataFrame, judge: Callable, level: int) -> DataFrame:
            """The blocks, when the shards' answers to a level lie beside each. The answers
            are written before they are dealt to blocks, when the questions are gone."""
            with Scratch(docs.sparkSession) as answers:
                told = answers.written(asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block").mapInArrow(judge, MOVED), "suffix-answers")
                back = told.repartition(shards, "block").sortWithinPartitions("block", "shard")
                return scratch.written(back.mapInArrow(_stored(folder, level), "block bigint, total bigint, distinct bigint"), "suffix-blocks")

        found = answered(rows.mapInArrow(_blocks(folder, shards), MOVED), _counted_words(shards), 0)
        total, distinct = (found.where("block = -1").select("total", "distinct").first() or (0, 0))[:2]
        found, number = found.where("block >= 0").select("block"), min(MOST_TASKS, max(1, found.count() - 1))
        for level in range(1, depth + 1):
            answered(found.repartition(number).mapInArrow(_asked(folder, shards, level, total, distinct, least, prior), MOVED), _judged_contexts(shards, least, prior), level)
        schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        scored = found.repartition(number).mapInArrow(_scored(folder, shards, depth, total, distinct, least, prior), schema)
        return written(scored.withColumnRenamed("id", id_col), "scores", docs.sparkSession)
