"""Encoding with a public byte-level BPE vocabulary by replaying its merges over a corpus slice.

The words of a slice of documents are counted once each; an inverted index from token pair to the positions where the pair
stands is built over these distinct words, and every merge is applied in rank order to all its positions at once, updating
only the index entries of the touched neighbours. No word is ever scanned again for its best pair. A slice is an Arrow batch;
words met in earlier slices of the same task are kept, so the replay runs over new words only.

The work is one pass over the documents without a shuffle, so skew in any column has no effect.

Defined results: null and empty texts give an empty list of ids; text is taken whole, in any length; ids are those of the
vocabulary without special tokens, whose strings in a text are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("FONDACO_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split of byte-level BPE text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept from slice to slice; the memory of a task stays bounded whatever the corpus.
KEPT_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class MergeReplay:
    """Encodes words with a vocabulary: the path or the content of a tokenizers JSON of byte-level BPE."""

    def __init__(self, source: str | bytes):
        model = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())["model"]
        vocab = model["vocab"]
        self.of_byte = [vocab[s] for s in byte_symbols()]
        # Pair of ids -> (rank, id of the merged token), keyed by one integer.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(WORD)
        self.kept: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        merges, of_byte = self.merges, self.of_byte
        ids: list[int] = []
        starts = []
        for w in words:
            starts.append(len(ids))
            ids += [of_byte[b] for b in w.encode("utf-8", "surrogatepass")]
            ids.append(-1)  # no pair reaches over the end of a word
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, tuple[int, list[int]]] = {}  # rank -> new id, positions of the pair's left token
        for i in range(n - 1):
            if (found := merges.get(ids[i] << 32 | ids[i + 1])) and ids[i] >= 0 <= ids[i + 1]:
                index.setdefault(found[0], (found[1], []))[1].append(i)
        pair_of = {rank: key for key, (rank, _) in merges.items()} if not hasattr(self, "pair_of") else self.pair_of
        self.pair_of = pair_of
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            rank = heapq.heappop(waiting)
            new, places = index.pop(rank)
            pair = pair_of[rank]
            left, right = pair >> 32, pair & 0xFFFFFFFF
            places.sort()  # overlapping places merge from the left
            for i in places:
                if ids[i] != left:
                    continue
                j = after[i]
                if j >= n or ids[j] != right:
                    continue
                k = after[j]
                ids[i], ids[j] = new, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    if ids[k] >= 0 and (found := merges.get(new << 32 | ids[k])):
                        if found[0] not in index:
                            index[found[0]] = (found[1], [])
                            heapq.heappush(waiting, found[0])
                        index[found[0]][1].append(i)
                h = before[i]
                if h >= 0 and ids[h] >= 0 and (found := merges.get(ids[h] << 32 | new)):
                    if found[0] not in index:
                        index[found[0]] = (found[1], [])
                        heapq.heappush(waiting, found[0])
                    index[found[0]][1].append(h)
        out = []
        for s in starts:
            word = []
            i = s
            while ids[i] != -1:
                word.append(ids[i])
                i = after[i]
            out.append(word)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text of a slice."""
        split, kept = self.split.findall, self.kept
        cut = [split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in kept))
        kept.update(zip(new, self.replay(new)))
        out = [[i for w in words for i in kept[w]] for words in cut]
        if len(kept) > KEPT_WORDS:
            kept.clear()
        return out


def vocabulary_content(documents: DataFrame, vocabulary: str, folder: str | None):
    """The content of a vocabulary file (a few MB), sent from the driver, so executors need no copy of the folder."""
    return documents.sparkSession.sparkContext.broadcast(Path(f"{folder or TOKENIZERS}/{vocabulary}.json").read_bytes())


def _encoder(source, id_column: str, text_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        replay = MergeReplay(source.value)
        for batch in batches:
            ids = replay.encode(batch.column(text_column).to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for row in ids for i in row), np.int32, int(lengths.sum()))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), lists], names=[id_column, "ids"])

    return run


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every document, null and empty ones included."""
    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, text_column).mapInArrow(_encoder(vocabulary_content(documents, vocabulary, folder), id_column, text_column), f"`{id_column}` {kind}, ids array<int>")


def _counter(source, id_column: str, text_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        replay = MergeReplay(source.value)
        for batch in batches:
            n = [len(i) for i in replay.encode(batch.column(text_column).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(n, pa.int64())], names=[id_column, "n_tokens"])

    return run


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_tokens) of every document; null and empty texts have none."""
    kind = dict(documents.dtypes)[id_column]
    return documents.select(id_column, text_column).mapInArrow(_counter(vocabulary_content(documents, vocabulary, folder), id_column, text_column), f"`{id_column}` {kind}, n_tokens long")
