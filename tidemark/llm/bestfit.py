"""Packing documents by vector best-fit.

A document's ids and the end token are one piece, or, beyond the capacity, pieces of the capacity and a last shorter one.
A piece demands (tokens, documents, attention): its length, 1, and its length squared. A bin - one training sequence - has a
capacity of each. Pieces are taken from the longest to the shortest; each goes into the open bin that can take it under
every constraint and that by the weighted residual ("norm": the least sum of shares left; "dot": the largest product of what it
demands and what is left) fits best, or into a new one.

The defaults' weights let tokens decide and the others break ties, and capacities of documents and attention are what a bin full of
tokens can need at most, so that sequences are as few as best-fit makes them; tighter ones are parameters.

Pieces are dealt over tasks by a hash of their row, so each task packs a like mix of lengths, of about PART_TOKENS tokens; a task's few bins
that stay half empty are all that more tasks cost. A task holds its open bins' numbers, never the pieces. The order is
total, so a task that runs again packs alike.

Null text counts as empty: the end token alone. Repeated rows, and rows with one or no doc_id, are packed each. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table, written
from .wordids import loaded

SIZE, END = 2048, 0
#: Tokens and pieces that a task packs, about.
PART_TOKENS, PART_PIECES = 16_000_000, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids binary, row long"
PACKED = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Bin:
    """What a bin can take, how much each of the three counts, and how a bin is chosen."""

    tokens: int = SIZE
    documents: int = SIZE
    attention: int = SIZE * SIZE
    weights: tuple[float, float, float] = (1.0, 1e-5, 1e-5)
    choice: str = "norm"

    def __post_init__(self):
        if self.choice not in ("norm", "dot") or self.tokens < 1 or self.documents < 1 or self.attention < self.tokens**2:
            raise ValueError("a bin takes one piece of its capacity at least, by norm or dot")

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


class Open:
    """The open bins of a task. place(length) gives the bin's number and the place in it."""

    def __init__(self, kind: Bin):
        self.kind, self.capacity = kind, kind.capacity
        self.share = np.array(kind.weights) / self.capacity
        self.left = np.zeros((3, 1024))
        self.rest = np.zeros(1024)
        self.number = np.zeros(1024, dtype=np.int64)
        self.open = self.made = 0

    def _fitting(self, demand: np.ndarray) -> int:
        n = self.open
        left = self.left[:, :n]
        can = (left[0] >= demand[0]) & (left[1] >= demand[1]) & (left[2] >= demand[2])
        # What is left after placing differs from what is left before by the same amount in every bin.
        score = self.rest[:n] if self.kind.choice == "norm" else -((self.share * demand / self.capacity) @ left)
        score = np.where(can, score, np.inf)
        best = int(score.argmin()) if n else 0
        return best if n and score[best] < np.inf else -1

    def place(self, length: int) -> tuple[int, int]:
        demand = np.array([length, 1.0, float(length) ** 2])
        at = self._fitting(demand) if length < self.kind.tokens else -1
        if at < 0:
            at = self._new()
        left = self.left[:, at]
        offset = self.kind.tokens - int(left[0])
        left -= demand
        self.rest[at] = self.share @ left
        number = int(self.number[at])
        if left.min() < 1:  # nothing fits any more
            self._close(at)
        return number, offset

    def _new(self) -> int:
        if self.open == len(self.number):
            self.left = np.concatenate([self.left, np.zeros_like(self.left)], axis=1)
            self.rest, self.number = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rest, self.number))
        at = self.open
        self.left[:, at], self.number[at] = self.capacity, self.made
        self.open, self.made = at + 1, self.made + 1
        return at

    def _close(self, at: int) -> None:
        """The last open bin takes the closed one's place."""
        last = self.open - 1
        self.left[:, at], self.rest[at], self.number[at] = self.left[:, last], self.rest[last], self.number[last]
        self.open = last


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length and ids (16-bit, with the end token) of every document; row: a number of its own for each document."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = loaded(tokenizer or default_tokenizer()), np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                out: list[list] = [[] for _ in names]
                for doc, row, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), encoder.ids([t or "" for t in some.column(1).to_pylist()])):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 2 * size)):
                        own = ids[start : start + 2 * size]
                        for column, v in zip(out, (doc, k, start // 2, len(own) // 2, own, row)):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return in_text_batches(rows).mapInArrow(run, PIECES)


def packed(rows: DataFrame, kind: Bin | None = None) -> DataFrame:
    """rows (as of pieces(), in a table) with ids_crc32, sequence_id and offset."""
    kind = kind or Bin()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, Open(kind)
        for batch in batches:
            at = [bins.place(n) for n in batch.column(3).to_pylist()]
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype="<u2").astype("<u4").tobytes()) for x in batch.column(4)]
            more = [pa.array(crc, pa.int64()), pa.array([first + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[c.split()[0] for c in PACKED.split(", ")])

    tokens, n = rows.agg(F.sum("length"), F.count(F.lit(1))).first()
    parts = max(1, -(-(tokens or 0) // PART_TOKENS), -(-n // PART_PIECES))
    dealt = in_text_batches(rows).repartition(parts, "row", "piece").sortWithinPartitions(F.desc("length"), "row", "piece")
    return dealt.mapInArrow(run, PACKED)


def pack(documents: DataFrame, tokenizer: str | None = None, kind: Bin | None = None) -> DataFrame:
    kind = kind or Bin()
    return packed(written(pieces(documents, tokenizer, kind.tokens)), kind)


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
