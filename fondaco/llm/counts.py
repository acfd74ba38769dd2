"""Corpus counts in hashed tables whose size follows the corpus, up to a bound.

Every task counts its rows into one table; the tables are summed segment by segment, in two steps, so that no task holds
more than a few dozen segments of half a MB. ``cells_for`` gives a table a cell for
four occurrences of keys, up to ``MOST_CELLS`` (128 MB), which is the bound of what is sent to the driver and broadcast. A count
can only be too high, by the counts of the other keys in its cell. The operators that use a table take no decision from a count
that could lose a result: counts give an order of tokens or the weight of one, and any order and any weights are sound.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Cells of a segment, and branches into which the tasks' tables are summed first.
SEGMENT, BRANCHES = 1 << 17, 64
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 25


def cells_for(occurrences: int) -> int:
    """Cells of a table for a corpus of so many occurrences of keys: a power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (max(int(occurrences) // 4, 1) - 1).bit_length()))


def _partial(hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for part in hashes(batch):
                at = (part % np.uint64(cells)).astype(np.int64)
                if len(at) * 4 < cells:
                    at, n = np.unique(at, return_counts=True)
                    total[at] += n.astype(np.uint32)
                else:
                    total += np.bincount(at, minlength=cells).astype(np.uint32)
        if total.any():
            branch = TaskContext.get().partitionId() % BRANCHES
            for segment, at in enumerate(range(0, cells, SEGMENT)):
                packed = zlib.compress(total[at : at + SEGMENT].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([branch], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "branch", "packed"])

    return run


def _sum(group: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for packed in group.column("packed"):
        part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.int64)
        total = part if total is None else total + part
    packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.table([pa.array([group.column("segment")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "branch", "packed"])


def hashed_counts(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], cells: int = 1 << 20) -> np.ndarray:
    """The table of counts of all hashes that ``hashes`` gives for the batches of ``rows``."""
    schema = "segment int, branch int, packed binary"
    parts = rows.mapInArrow(_partial(hashes, cells), schema).groupBy("segment", "branch").applyInArrow(_sum, schema)
    table = np.zeros(cells, np.uint32)
    for row in parts.groupBy("segment").applyInArrow(_sum, schema).collect():  # a row for each segment
        at = row["segment"] * SEGMENT
        table[at : at + SEGMENT] = np.frombuffer(zlib.decompress(bytes(row["packed"])), np.uint32)
    return table


class _Deflated:
    """Bytes that are pickled deflated and come out as they were, by what every Python has."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return zlib.decompress, (zlib.compress(self.data, 1),)


class Sent:
    """A table of counts to broadcast: most cells are small, so its file on each machine takes a fraction; its value there is the table."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __reduce__(self):
        return np.frombuffer, (_Deflated(self.table.tobytes()), self.table.dtype.str)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_one(h: int) -> int:
    """mix for one number."""
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 31


_word_hashes: dict[str, int] = {}


def hash_word(w: str) -> int:
    h = _word_hashes.get(w)
    return int(hash_words([w])[0]) if h is None else h


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; hashes of words met before are kept, up to a bound."""
    known = _word_hashes
    if len(known) > 2_000_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
