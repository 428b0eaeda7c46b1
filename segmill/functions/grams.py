"""Vectorised multiset elements of texts (characters or bigrams with occurrence numbers)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def elements(texts: list[str], width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)`` of all characters (``width`` 1) or bigrams (2) of every text.

    The hash covers the piece and its occurrence number in the text, so sets of hashes intersect as the
    multisets of pieces do. Texts shorter than ``width`` have none.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    if width == 2:
        inside = owner[:-1] == owner[1:]
        piece, owner = ((points[:-1] << np.uint64(21)) | points[1:])[inside], owner[:-1][inside]
    else:
        piece = points + (np.uint64(1) << np.uint64(50))
    order = np.lexsort((piece, owner))
    piece, owner = piece[order], owner[order]
    first = np.ones(len(piece), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(first)
    occurrence = np.arange(len(piece)) - np.repeat(runs, np.diff(np.append(runs, len(piece))))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return mixed(mixed(piece) + occurrence.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), offsets


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_frequencies(texts: DataFrame, width: int = 2) -> tuple[np.ndarray, int]:
    """``(texts per slot, texts)`` over the column ``text``: a table of fixed size whatever the input.

    Tasks send the pieces of their tables that hold counts; sums are made by piece on the executors.
    """
    universe, piece = 1 << SLOT_BITS, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(universe, np.int64), 0
        for batch in batches:
            own = [t for t in batch.column(0).to_pylist() if t]
            if own:
                total += np.bincount(slots(elements(own, width)[0]), minlength=universe)
                docs += len(own)
        parts = [(k, total[k * piece : (k + 1) * piece]) for k in range(universe // piece)] + [(-1, np.array([docs]))]
        kept = [(k, zlib.compress(v.tobytes(), 1)) for k, v in parts if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([v for _, v in kept], pa.binary())], names=["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(v), np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["k", "counts"])

    shape = "k int, counts binary"
    tasks = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequency, docs = np.zeros(universe, np.int64), 0
    for row in texts.select("text").mapInArrow(count, shape).repartition(tasks, "k").mapInArrow(add, shape).toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row.counts), np.int64)
        if row.k < 0:
            docs = int(counts[0])
        else:
            frequency[row.k * piece : (row.k + 1) * piece] = counts
    return frequency, docs
