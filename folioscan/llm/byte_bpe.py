"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, one character each, so pyahocorasick can hold the
vocabulary. A piece is first covered by longest matches from the left; where two
adjacent tokens could not have come from the merges, the encoder backtracks to the
next shorter match. Whether two tokens may stand side by side is decided by undoing
their merges along the border, and remembered. Each place is entered at most once
for each token that starts there, so the work is linear in the piece.

A pre-tokeniser splits texts into pieces that are encoded separately; a piece that
is itself a token is that token. Ids of words that come again are remembered, in a
memory of fixed size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import Memo

#: Remembered words and pairs of tokens in each Python worker.
MOST_WORDS, MOST_PAIRS = 600_000, 1_000_000
#: A rank behind all others.
NEVER = 1 << 40
# Fixed value: the pre-tokeniser under which a single space opens a piece and a full stop
# or comma after a letter is one.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

assert sys.byteorder == "little" and array("I").itemsize == 4


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a rank file: base64, a space, the rank, in lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class ByteBPE:
    """Encoder and decoder for ranks whose order is the order of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {k: v for v, k in ranks.items()}
        self.pieces, self.by_words = regex.compile(pattern).findall, pattern == SPACED_PATTERN
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # an identifier orders tokens by rank; the ids of single bytes have no halves
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = None
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._may_touch(a, b):
                    self.halves[rank] = (a, b)
                    self.pairs[a, b] = rank
                    break
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self.halves[rank]:  # others come from no merges: only as whole pieces
                self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.touch = Memo(lambda p: self._may_touch(p >> 32, p & 0xFFFFFFFF), MOST_PAIRS)
        self.spaced = Memo(lambda word: self._pack(" " + word), MOST_WORDS)

    def _border(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The tokens that stood at a token's left (0) or right (1) border while it was
        merged, the token itself first, each with the rank of the merge that ended it."""
        ended = NEVER
        while True:
            yield token, ended
            halves = self.halves.get(token)
            if halves is None:
                return
            token, ended = halves[side], token

    def _may_touch(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens, one after the other, gives just them.

        That adjacent tokens decide this alone, by their merges along the border, is the
        published idea behind BPE in linear time. Merges happen in the order of ranks,
        those of one rank from the left. So the tokens are what comes out unless, at some
        time, the two that then stood at the border could be merged before the left
        one's own merge, and no later than the right one's.
        """
        ahead, pairs = list(self._border(right, 0)), self.pairs
        for a, a_ended in self._border(left, 1):
            for b, b_ended in ahead:
                across = pairs.get((a, b))
                if across is not None and across < a_ended and across <= b_ended:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pre-tokeniser."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, touch = piece.decode("latin-1"), self.touch
        greedy = [x[1] for x in self.matcher.iter_long(text)]
        last = -1
        for rank, _ in greedy:
            if last >= 0 and not touch[last << 32 | rank]:
                break
            last = rank
        else:
            return [rank for rank, _ in greedy]
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.matcher.iter(text):
            starts[end + 1 - match[1]].append(match)  # ends ascend, so the longest comes last
        ids: list[int] = []
        at, left = [0], [list(starts[0])]
        dead = bytearray(len(text) + 1)
        while at[-1] < len(text):
            options = left[-1]
            while options:
                rank, length = options.pop()
                end = at[-1] + length
                if not dead[end] and (not ids or touch[ids[-1] << 32 | rank]):
                    ids.append(rank)
                    at.append(end)
                    left.append(list(starts[end]) if end < len(text) else [])
                    break
            else:  # no token leads on from here: never enter this place again
                dead[at[-1]] = 1
                at.pop(), left.pop(), ids.pop()
        return ids

    def _pack(self, word: str) -> bytes:
        """The ids of a word with the space before it, under SPACED_PATTERN."""
        if word[-1] in ".," and word[0] == " " and word[-2].isascii() and word[-2].isalpha():  # a mark after a letter is a piece
            return self.spaced[word[1:-1]] + array("I", self.encode_piece(word[-1].encode())).tobytes()
        if word.isascii() and word[1:].isalpha() and word[0] == " ":  # plainly one piece
            return array("I", self.encode_piece(word.encode())).tobytes()
        return array("I", [i for piece in self.pieces(word) for i in self.encode_piece(piece.encode())]).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        Under SPACED_PATTERN a single space between two characters that aren't white
        space always opens a piece, so the words between such spaces are encoded on
        their own. Under other patterns each piece is found in the text.
        """
        if not text:
            return b""
        if not self.by_words:
            return array("I", [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode())]).tobytes()
        if text[-1].isspace() or text[0].isspace() or _BESIDE.search(text):
            words = _BREAK.split(text)
        else:
            words = text.split(" ")
        first = words.pop(0)
        return self._pack(first) + b"".join(map(self.spaced.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: White space beside a space: there the words between spaces don't stand alone.
_BESIDE = re.compile(r"\s | \s")
_BREAK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def byte_bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: its text encoded and decoded.

    Columns: id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the bytes that the ids decode to) and, with
    ``keep_ids``, ids (those bytes). ``ranks_path`` is read by each worker.

    A null text counts as empty and has no tokens; null ids are kept. Repeated rows
    give repeated answers, further columns are ignored, and no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            counts, hashes, decoded, packs = [], [], [], []
            for text in batch.column(1):
                ids = coder.encode_packed(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(np.frombuffer(ids, dtype="<u4").tolist())).hexdigest())
                packs.append(ids if keep_ids else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch(columns + [pa.array(packs, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("id", id_col)
