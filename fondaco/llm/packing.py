"""Filling containers of fixed capacity with documents, along a space-filling curve.

The size of a document is its number of tokens in a public vocabulary. Its hashed token vector is projected to ``DIMENSIONS``
numbers, quantised, and turned into the position on a Hilbert curve; documents are range-sorted by that position, so the
partitions are stretches of the curve and neighbours hold similar content. Each stretch is packed by itself in windows of
documents that follow each other: the largest first, each into the fullest container that still takes it; containers that
stay roomy are carried on to the next window. A text over the capacity is cut into pieces of full capacity and a rest;
nothing else is ever split.

The range sort breaks ties by id, so a group of equal texts, however large, spreads over partitions. The number of stretches
follows the number of tokens; each leaves at most ``CARRIED`` containers roomy. A task holds one window and the carried
containers.

Defined results: null and empty texts have no tokens; they come out with zero tokens and no container. Null ids are left out;
repeated ids are items of their own; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fondaco.llm.tokens import MergeReplay, vocabulary_content
from fondaco.session import materialise

DIMENSIONS, BITS, BUCKETS = 3, 10, 4096
WINDOW = 4096
#: Containers kept open from one window to the next.
CARRIED = 64
#: Full containers' worth of tokens in a stretch, about.
STRETCH = 500


def projections(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((buckets, dimensions))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of grid points (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    # Undo the excess work of the curve's rotations, from the highest bit down.
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _placer(source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, table = MergeReplay(source.value), projections()
        for batch in batches:
            ids = replay.encode(batch.column("text").to_pylist())
            points = np.zeros((len(ids), DIMENSIONS))
            for i, row in enumerate(ids):
                if row:
                    own = np.unique(np.array(row, np.int64) * 2_654_435_761 % BUCKETS)
                    points[i] = table[own].sum(0) / math.sqrt(len(own))
            squashed = 1 / (1 + np.exp(-1.7 * points))
            keys = hilbert(np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(r) for r in ids], pa.int64()), pa.array(keys, pa.int64())], names=["id", "n_tokens", "curve"])

    return run


class Packer:
    """Packs windows of pieces into containers of the capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.made = 0
        self.open: list[tuple[int, int]] = []  # (room, container), by room

    def window(self, sizes: list[int]) -> list[int]:
        """The container of each piece."""
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            n = sizes[i]
            at = bisect.bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, container = self.open.pop(at)
            else:
                room, container = self.capacity, self.made
                self.made += 1
            out[i] = container
            if room > n:
                bisect.insort(self.open, (room - n, container))
        self.open = self.open[-CARRIED:]
        return out


def _packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity)
        held: list[list] = [[], [], [], []]  # id, piece, start, size

        def pack():
            where = packer.window(held[3])
            rows = [held[0], held[1], [base + c for c in where], held[2], held[3]]
            batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows], names=["id", "piece", "container", "start", "n_tokens"])
            for v in held:
                v.clear()
            return batch

        for batch in batches:
            for i, n in zip(batch.column("id").to_pylist(), batch.column("n_tokens").to_pylist()):
                for piece, start in enumerate(range(0, n, capacity)):
                    for v, x in zip(held, (i, piece, start, min(capacity, n - start))):
                        v.append(x)
                if len(held[0]) >= WINDOW:
                    yield pack()
        if held[0]:
            yield pack()

    return run


def containers(documents: DataFrame, id_column: str, text_column: str, capacity: int = 4096, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, piece, container, start, n_tokens): the piece of a document that begins at token ``start`` lies in the container."""
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")
    placed = materialise(texts.mapInArrow(_placer(vocabulary_content(documents, vocabulary, folder)), "id long, n_tokens long, curve long"), "curve")
    total = placed.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    stretches = max(1, round(total / (capacity * STRETCH)))
    along = placed.where("n_tokens > 0").repartitionByRange(stretches, "curve", "id").sortWithinPartitions("curve", "id")
    packed = along.select("id", "n_tokens").mapInArrow(_packer(capacity), "id long, piece long, container long, start long, n_tokens long")
    none = placed.where("n_tokens = 0").selectExpr("id", "0L as piece", "cast(null as long) as container", "0L as start", "0L as n_tokens")
    return packed.unionByName(none)
