"""Chunking of texts with exact offsets. A chunker maps a text to spans; all run in Arrow batches over whole texts.

For every chunker ``text[char_start:char_end]`` is the chunk, spans begin at 0, end at the length of the text, and leave no
gap other than white space. Null and blank texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Spans = list[tuple[int, int]]

# What opens a unit of a legal text.
LEGAL_MARK = re.compile(r"^[ \t]*(?:Art\.|Articolo\b|Comma\b|Lettera\b|Capo\b|Sezione\b|\d+\.\s|\d+-[a-z]+\.\s|[a-z]\)\s)", re.M)
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|(?<=;)\n")


def fixed(text: str, size: int = 1000, overlap: int = 150) -> Spans:
    """Slices of equal size that overlap."""
    out, at = [], 0
    while True:
        out.append((at, min(at + size, len(text))))
        if out[-1][1] == len(text):
            return out
        at += size - overlap


def _segments(text: str, most: int) -> Spans:
    """Paragraphs; those over the limit by sentences; those over it by force."""
    out: Spans = []

    def cut(start: int, end: int, marks: Iterator[re.Match]) -> Spans:
        parts, at = [], start
        for m in marks:
            if m.start() > at:
                parts.append((at, m.start()))
            at = max(at, m.end())
        return parts + ([(at, end)] if at < end else [])

    for start, end in cut(0, len(text), re.finditer(r"\n\n+", text)):
        if end - start <= most:
            out.append((start, end))
            continue
        for s, e in cut(start, end, SENTENCE_END.finditer(text, start, end)):
            out += [(p, min(p + most, e)) for p in range(s, e, most)]
    return out


def generic(text: str, target: int = 1000, overlap: int = 150, most: int = 2000, least: int = 20) -> Spans:
    """Segments gathered up to the target; each chunk begins with the end of the one before; a tiny last chunk joins it."""
    segments = _segments(text, most)
    out: Spans = []
    start, end = segments[0]
    for s, e in segments[1:]:
        if e - start <= target:
            end = e
        else:
            out.append((start, end))
            start, end = max(end - overlap, start), e
    out.append((start, end))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def legal(text: str, target: int = 1000, most: int = 1200, overlap: int = 150, window: int = 100, least: int = 30) -> Spans:
    """Cuts near the target at a legal mark, else a paragraph, else a sentence; the last chunk ends the text."""
    out: Spans = []
    at = 0
    while True:
        if at + most >= len(text):
            out.append((at, len(text)))
            break
        low, high = at + target - window, min(len(text), at + target + window)
        mark = LEGAL_MARK.search(text, low, high)
        gap = text.find("\n\n", low, high)
        stop = re.compile(r"\.\s").search(text, low, high)
        end = mark.start() if mark and mark.start() > at else gap if gap > at else stop.end() if stop else at + target
        end = min(end, at + most)
        out.append((at, end))
        at = max(end - overlap, at + 1)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def backward(text: str, target: int = 1000, window: int = 100, overlap: int = 150) -> Spans:
    """Cuts at the last '. ', else ', ', else blank around the target."""
    out: Spans = []
    at = 0
    while at + target < len(text):
        low, high = at + target - window, min(len(text), at + target + window)
        end = next((p + len(m) for m in (". ", ", ", " ") if (p := text.rfind(m, low, high)) > at), at + target)
        out.append((at, end))
        at = max(end - overlap, at + 1)
    return out + [(at, len(text))]


def paragraphs(text: str, size: int = 2000, overlap: int = 200) -> Spans:
    """Cuts at the last paragraph, else sentence, in the second half of the window."""
    out: Spans = []
    at = 0
    while at + size < len(text):
        half, high = at + size // 2, at + size
        end = next((p + len(m) for m in ("\n\n", ". ") if (p := text.rfind(m, half, high)) > 0), high)
        out.append((at, end))
        at = max(end - overlap, at + 1)
    return out + [(at, len(text))]


def cut_scores(text: str, soft: int = 1700, hard: int = 2000) -> list[tuple[int, float, str]]:
    """Possible cuts of a long text between the soft and the hard limit: place, score, kind; best first."""
    found = []
    for kind, worth, form in (("paragraph", 1.0, r"\n\n+"), ("sentence", 0.8, r"(?<=[.?!])\s+(?=[A-ZÀ-Ý])"), ("clause", 0.5, r"(?<=[;:])\s+"), ("comma", 0.2, r",\s+")):
        for m in re.compile(form).finditer(text, min(soft, len(text)), min(hard, len(text))):
            bad = re.search(r"\b(?:art|artt|n|sez|cod|proc|civ|pen|cfr|v|co|lett|par)\.\s*$", text[max(0, m.start() - 8) : m.start() + 1], re.I)
            found.append((m.end(), round(worth - 0.3 * (m.end() - soft) / max(1, hard - soft) - (0.6 if bad else 0.0), 4), kind))
    return sorted(found, key=lambda c: (-c[1], c[0]))


def _chunker(spans_of: Callable[[str], Spans]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends, texts = [], [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if text and text.strip():
                    for n, (s, e) in enumerate(spans_of(text)):
                        ids.append(i), numbers.append(n), starts.append(s), ends.append(e), texts.append(text[s:e])
            ints = [pa.array(v, pa.int32()) for v in (numbers, starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *ints, pa.array(texts, pa.string())], names=["id", "chunk_no", "char_start", "char_end", "text"])

    return run


def chunk(rows: DataFrame, spans_of: Callable[[str], Spans]) -> DataFrame:
    """(id, chunk_no, char_start, char_end, text) of (id, text)."""
    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_chunker(spans_of), "id long, chunk_no int, char_start int, char_end int, text string")


def chunk_fixed(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """The fixed chunker as column expressions."""
    steps = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / (size - overlap))).cast("int")
    at = rows.where(F.length("text") > 0).select("id", "text", F.explode(F.sequence(F.lit(0), steps)).alias("chunk_no"))
    start = F.col("chunk_no") * (size - overlap)
    return at.select("id", "chunk_no", start.alias("char_start"), F.least(start + size, F.length("text")).alias("char_end"), F.substring("text", start + 1, F.lit(size)).alias("text"))
