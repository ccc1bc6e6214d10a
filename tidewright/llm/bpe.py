"""Byte-level BPE by prefix dynamic programming: encode, append, edit, decode."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidewright.llm.textarrays import slices

NONE = 1 << 40
# Remembered pieces and pairs of a worker; each memory is emptied when full, results do not depend on it.
PIECES, PIECE_CHARS, PAIRS = 3 << 18, 32, 1 << 19


class PrefixTable:
    """For every prefix of some bytes the last token of its encoding.

    A token may end a prefix when it is a suffix of it and the pair (last token of the prefix before it, token) encodes to just
    that pair. Exactly one token does, so the table is unique, a prefix's row never depends on what follows, appending only
    adds rows, and after an edit the rows before it stay.
    """

    def __init__(self, bpe: "Bpe", data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> "PrefixTable":
        done = len(self.data)
        self.data += more
        data, last, ranks, pairs, width = bytes(self.data), self.last, self.bpe.ranks, self.bpe.pairs, self.bpe.longest
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - width), end):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if not start or pairs.get((last[start], token)) or self.bpe.follows(last[start], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return self

    def edit(self, start: int, stop: int, new: bytes) -> "PrefixTable":
        """Replaces ``data[start:stop]``; rows before ``start`` are kept, rows after it are made anew."""
        tail = bytes(self.data[stop:])
        del self.data[start:], self.last[start + 1:]
        return self.append(new + tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


class Bpe:
    """Ranks of a byte-level vocabulary and the piece pattern of its texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # the pattern's white space is Unicode's; this engine's class also holds four separators of ASCII
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: merge the adjacent pair of the lowest rank, leftmost first, until no pair has one or ``stop`` parts are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes a token; None for a single byte."""
        if token not in self.split:
            parts = self.merge(self.bytes_of[token], 2)
            if len(parts) > 2:
                raise ValueError(f"no merge makes token {token}")
            self.split[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.split[token]

    def follows(self, token: int, after: int) -> bool:
        """Whether the bytes of both tokens encode to just these two.

        Their merges are undone from the last to the first. If the two parts that meet at the border could merge before the merge
        undone last, they would have, and the border would be gone. Of equal ranks the left one merges first.
        """
        if (known := self.pairs.get((token, after))) is not None:
            return known
        left, right, bound = token, after, NONE
        while not (crossed := self.ranks.get(self.bytes_of[left] + self.bytes_of[right], NONE) < bound):
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or of_left is not None and left > right:
                bound, left = left, of_left[1]
            else:
                bound, right = right + 1, of_right[0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[token, after] = not crossed
        return not crossed

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None counts as empty.

        Pieces not met before are encoded in sorted order by one prefix table: what a piece shares with the one before it is kept,
        only the rest is made anew.
        """
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.pieces
        new = set().union(*split).difference(known)
        if len(known) + len(new) > PIECES:
            known.clear()
            new = set().union(*split)
        fresh: dict[str, bytes] = {}
        table, before = PrefixTable(self), b""
        for piece in sorted(new):
            data = piece.encode()
            token = self.ranks.get(data)  # a piece that is a token needs no merge
            if token is None:
                shared = next((i for i, (x, y) in enumerate(zip(before, data, strict=False)) if x != y), min(len(before), len(data)))
                ids = table.edit(shared, len(before), data[shared:]).tokens()
                before = data
            else:
                ids = [token]
            (known if len(piece) <= PIECE_CHARS else fresh)[piece] = np.array(ids, "<u4").tobytes()
        if fresh:
            return [b"".join([fresh.get(p) or known[p] for p in pieces]) for pieces in split]
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _shipped(docs: DataFrame, path: str) -> str:
    """The vocabulary's name among the files Spark hands to every executor; the path itself need only exist on the driver."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``ids``: the text's token ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately, without special tokens. A null text counts as empty and has no ids. Texts are
    encoded whole, row by row, in slices of bounded bytes. A column named ``ids`` is replaced.
    """
    kept = [c for c in docs.columns if c != "ids" and (keep is None or c in keep)]
    schema, name = StructType([*docs.select(kept).schema.fields, StructField("ids", BinaryType(), False)]), _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(SparkFiles.get(name), pattern)
        for part in slices(batches, text_col):
            ids = bpe.encode_many(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(ids, pa.binary())], [*kept, "ids"])

    return docs.select([*kept, *([] if text_col in kept else [text_col])]).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids; null ids give null. A column of that name is replaced."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema, name = StructType([*encoded.select(kept).schema.fields, StructField("decoded", BinaryType())]), _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(SparkFiles.get(name), "")
        for part in slices(batches, ids_col):
            out = [None if i is None else bpe.decode(i) for i in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "decoded"])

    return encoded.select(kept).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: the text encoded, its ids decoded again, both digested."""
    schema, name = docs.select(F.col(f"`{id_col}`").alias(id_col)).schema, _shipped(docs, path)
    schema = schema.add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(SparkFiles.get(name), pattern)
        for part in slices(batches, text_col):
            ids = bpe.encode_many(part.column(text_col).to_pylist())
            columns = [
                pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *columns], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
