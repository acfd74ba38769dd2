"""Similarity of vectors, sets, strings and fingerprints as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Hashes of character grams that a task keeps; short grams recur all the time.
KEPT_GRAMS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length, null if they differ in size or hold no number."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(n == 0, F.lit(0.0)).when(~F.isnan(n), dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n), F.transform(a, lambda x: x.cast("double") / n))


def shingles(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` neighbouring words.

    The words are bound to a variable: where Spark puts their expression in place of a column, they are still made once a row, not once a run.
    """
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (width - 1))
    runs = lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, width), " "))
    of = lambda w: F.when(F.size(w) >= width, F.array_distinct(runs(w))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), of), 1)


def character_grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def spaced(text: Column) -> Column:
    """A text's words as ``trigram_bits`` reads them: each between two blanks and one; texts of equal words are equal. Null stays, no word gives ''."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    joined = F.array_join(words, "   ")
    return F.when(joined == "", joined).otherwise(F.concat(F.lit("  "), joined, F.lit(" ")))


def packed(row: np.ndarray, code: np.ndarray, rows: int, codes: int) -> np.ndarray:
    """A row of 64-bit words for each of ``rows``, with the bits of its codes set; ``row`` is sorted."""
    width = max(1, -(-codes // 64))
    out = np.empty((rows, width), np.uint64)
    ends = np.searchsorted(row, np.arange(rows + 1))
    step = max(1, 32_000_000 // (width * 64))
    for at in range(0, rows, step):
        to = min(at + step, rows)
        grid = np.zeros((to - at, width * 64), np.bool_)
        grid[row[ends[at] : ends[to]] - at, code[ends[at] : ends[to]]] = True
        out[at:to] = np.packbits(grid, axis=1, bitorder="little").view("<u8")
    return out


def trigram_bits(spaced: list[str]) -> np.ndarray:
    """A row of 64-bit words for each text of ``spaced``: a bit for each trigram that any of them holds, exact; as many are set as ``trigrams`` has."""
    lengths = np.array([len(t) for t in spaced], np.int64)
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.zeros(0x110000, np.int32)
    known[points] = 1
    known[32] = 0
    size = int(known.sum()) + 1
    known = np.where(known > 0, np.cumsum(known, dtype=np.int32), 0).astype(np.int32 if size**3 < 1 << 31 else np.int64)  # a blank is 0
    x = known[points]
    if len(x) < 3:
        return np.zeros((len(spaced), 1), np.uint64)
    row = np.repeat(np.arange(len(spaced), dtype=np.int32), lengths)
    good = (row[2:] == row[:-2]) & ((x[1:-1] != 0) | (x[2:] != 0))  # the last word's end and the next one's two blanks are no trigram
    codes, row = ((x[:-2] * size + x[1:-1]) * size + x[2:])[good], row[2:][good]
    if size**3 <= 1 << 24:
        there = np.zeros(size**3, np.int32)
        there[codes] = 1
        many = int(there.sum())
        codes = (np.cumsum(there, dtype=np.int32) - 1)[codes]
    else:
        kinds, codes = np.unique(codes, return_inverse=True)
        many = len(kinds)
    return packed(row, codes, len(spaced), many)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def simhash(rows: DataFrame, id_column: str, features: Column, high: bool = True) -> DataFrame:
    """(id, fingerprint): signed 64-bit simhash of each row's strings, by bit votes over the high or low half of their md5.

    Votes are counted by a generated aggregation over the exploded strings; a row's strings stand in one task, so what is
    shuffled is one partial count a row. Rows without strings have no fingerprint.
    """
    digest = F.conv(F.substring(F.md5("_f"), 1 if high else 17, 16), 16, -10).cast("long")
    hashes = rows.select(F.col(id_column), F.explode(features).alias("_f")).select(id_column, digest.alias("_h"))
    ones = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"_b{i}") for i in range(64)]
    votes = hashes.groupBy(id_column).agg(F.count("*").alias("_n"), *ones)
    total = F.lit(0).cast("long")
    for i in range(64):
        total = total.bitwiseOR(F.when(2 * F.col(f"_b{i}") > F.col("_n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return votes.select(id_column, total.alias("fingerprint"))


def _gram_votes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                hashes = []
                for i in range(len(text) - n + 1):
                    g = text[i : i + n]
                    h = known.get(g)
                    if h is None:
                        h = known[g] = int.from_bytes(md5(g.encode()).digest()[:8], "big")
                    hashes.append(h)
                bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out.append(int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0]))
                if len(known) > KEPT_GRAMS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.int64())], names=["id", "fingerprint"])

    return run


def simhash_characters(rows: DataFrame, n: int = 3) -> DataFrame:
    """(id, fingerprint) of (id, text): signed 64-bit simhash over all runs of n characters, by the high half of their md5.

    Runs in Arrow batches: md5 is taken once for each different run that a task meets, where the JVM would take it for every
    occurrence. Null texts and those of fewer than n characters have no fingerprint.
    """
    told = rows.where(F.length("text") >= n).select(F.col("id").cast("long").alias("id"), "text")
    return told.mapInArrow(_gram_votes(n), "id long, fingerprint long")


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; 64 where one is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(64))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64
