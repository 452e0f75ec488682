"""Packing documents into sequences along a Hilbert curve.

1. Texts become token ids (Arrow batches), and each document's mean hashed token vector is
   projected to DIMS coordinates, squashed to BITS bits each, and turned into a Hilbert key.
2. Rows are range-sorted by (key, doc_id, length, hash of the ids), so that equal keys - copies - still spread.
3. Every range is one stream of tokens cut every `size` tokens; what is left at its end is cut into
   powers of two, so nothing is padded. A sequence's id is the range's number
   shifted left by 40 bits plus its place in the range.

Null text counts as empty: the end token alone. Repeated rows are packed each. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table, written
from .tokens import loaded

SIZE, END = 1024, 0
DIMS, BITS = 4, 8
#: Tokens that a range has on average.
RANGE_TOKENS = 8_000_000
TOKENS = "doc_id long, key long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of rows of unsigned coordinates below 2 ** bits (transposed Gray-code form)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def keys_of(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents, each with one token at least."""
    signs = np.random.default_rng(7).standard_normal((1 << 16, DIMS)).astype(np.float32)
    n = np.array([len(i) for i in ids])
    mean = np.add.reduceat(signs[np.concatenate(ids)], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
    return hilbert(((np.tanh(3 * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))


def tokenized(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, key, n and ids (16-bit, with the end token) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer or default_tokenizer())
        end = np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                raw = [x + end for x in encoder.ids([t or "" for t in some.column(1).to_pylist()])]
                arrays = [np.frombuffer(x, dtype="<u2") for x in raw]
                n = pa.array([len(a) for a in arrays], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys_of(arrays), pa.int64()), n, pa.array(raw, pa.binary())], names=["doc_id", "key", "n", "ids"])

    return in_text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def _cut(pieces: list[tuple], lengths: list[int]) -> list[list[tuple]]:
    """pieces (doc_id, start, ids, doc_tokens) in a row, cut into sequences of the given lengths."""
    out, rest = [], pieces[::-1]
    for room in lengths:
        own = []
        while room:
            doc, start, ids, total = rest.pop()
            if len(ids) > room:
                rest.append((doc, start + room, ids[room:], total))
                ids = ids[:room]
            own.append((doc, start, ids, total))
            room -= len(ids)
        out.append(own)
    return out


def packed(tokens: DataFrame, size: int = SIZE) -> DataFrame:
    """tokens (as of tokenized(), in a table) packed: one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple] = []
        held = 0
        names = [c.split()[0] for c in PIECES.split(", ")]

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal next_id
            out = []
            for s in sequences:
                offset = 0
                for doc, start, ids, total in s:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, next_id, offset))
                    offset += len(ids)
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(3)):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2")
                open_pieces.append((doc, 0, ids, len(ids)))
                held += len(ids)
                if held >= 256 * size:
                    full, held = held // size, held % size
                    *done, open_pieces = _cut(open_pieces, [size] * full + [held])
                    yield rows(done)
        if held:
            tail = held % size
            lengths = [size] * (held // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if tail >> b & 1]
            yield rows(_cut(open_pieces, lengths))

    total = tokens.agg(F.sum("n")).first()[0] or 0
    # The order is total up to equal rows, so a task that runs again cuts alike.
    order = ["key", "doc_id", "n", F.xxhash64("ids")]
    ranges = tokens.repartitionByRange(max(1, -(-total // RANGE_TOKENS)), *order)
    return ranges.sortWithinPartitions(*order).mapInArrow(run, PIECES)


def pack(documents: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    return packed(written(tokenized(documents, tokenizer)), size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
