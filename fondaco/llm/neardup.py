"""Near-duplicate records: a set-similarity join by prefix filtering under several global token orders.

The token set of a record is its set of shingles (``width`` adjacent words). For Jaccard similarity >= t, two sets that match
share a token among the first |x| - ceil(t |x|) + 1 tokens of each, under any global order of tokens. Three orders are used:

1. rarest first (by corpus counts, ties by hash): generates the candidates;
2. tokens of odd hash first, each part rarest first;
3. tokens of even hash first, each part rarest first.

A candidate must share prefix tokens under all of them; the filters are intersected with bounds on the sets' lengths, on the
tokens left after the shared one, and on the symmetric difference of 256-bit parity maps, none of which can lose a match.
What passes is verified exactly on the sets.

Shape of the work: records with equal sets are one class before anything is compared. A class sends each partition of the
token space one packed entry with its prefix tokens that fall there, so the shuffle carries a few bytes a token. Pairs are
made in the partitions with vectorised code and leave them as they come, a bounded number at a time. Tokens of more than ``HOT``
records are split into a grid of cells by record hash, each a task's share of its own.

Corpus counts sit in a table that follows the corpus (see counts.py); a wrong count changes only the order, never the result.
What a cell holds on average is taken off before a token counts as hot, so a full table does not make every token hot.

Defined results: null texts and texts of fewer than ``width`` words have no tokens and match nothing, not even each other;
null ids are left out; repeated rows count once, and an id with several texts belongs to the class of each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fondaco.llm.counts import cells_for, hash_words, hashed_counts, mix
from fondaco.session import discard, materialise, tasks_of

WORDS = re.compile(r"[^\W_]+")
HOT = 20_000
PAIRS_AT_ONCE = 1_000_000
#: Copies of one class that meet the others of their class, or of a linked one, in one task.
COPIES = 2_000
#: Packed prefix tokens a partition should hold at most.
TOKENS_A_PARTITION = 4_000_000
BITS = 256


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's shingles."""
    words = WORDS.findall(text.lower()) if text else []
    if len(words) < width:
        return np.zeros(0, np.uint64)
    w = hash_words(words)
    n = len(w) - width + 1
    h = w[:n].copy()
    for i in range(1, width):
        h = mix(h) + w[i : i + n]
    return np.unique(mix(h))


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """shingles of each text of a batch, hashed and sorted together."""
    words: list[str] = []
    lengths = []
    for t in texts:
        w = WORDS.findall(t.lower()) if t else []
        words += w
        lengths.append(len(w))
    ends = np.cumsum(lengths)
    n = len(words) - width + 1
    if n < 1:
        return [np.zeros(0, np.uint64)] * len(texts)
    w = hash_words(words)
    h = w[:n].copy()
    for i in range(1, width):
        h = mix(h) + w[i : i + n]
    h = mix(h)
    record = np.repeat(np.arange(len(texts)), lengths)[:n]
    inside = np.arange(n) + width <= ends[record]
    h, record = h[inside], record[inside]
    order = np.lexsort((h, record))
    h, record = h[order], record[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (record[1:] != record[:-1])][: len(h)]
    h, record = h[new], record[new]
    return np.split(h, np.cumsum(np.bincount(record, minlength=len(texts)))[:-1])


def least_overlap(a, b, t: float):
    """Common tokens that sets of a and b tokens need for similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def prefix_length(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def ordered(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """The tokens under global order 1, 2 or 3."""
    rarity = counts[(tokens % np.uint64(len(counts))).astype(np.int64)]
    if order == 1:
        return tokens[np.lexsort((tokens, rarity))]
    late = (tokens >> np.uint64(40)) & np.uint64(1)
    if order == 2:
        late = late ^ np.uint64(1)
    return tokens[np.lexsort((tokens, rarity, late))]


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keys = [], [], []
            given = batch.column("text").to_pylist()
            for i, text, s in zip(batch.column("id").to_pylist(), given, sets_of(given, width)):
                if len(s):
                    with np.errstate(over="ignore"):
                        low = int(mix(s * np.uint64(3)).sum(dtype=np.uint64)) & (2**64 - 1)
                    keys.append(s.sum(dtype=np.uint64).tobytes() + low.to_bytes(8, "little") + len(s).to_bytes(4, "little"))
                    ids.append(i)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(keys, pa.binary())], names=["id", "text", "key"])

    return run


def _all_tokens(width: int):
    def hashes(batch: pa.RecordBatch):
        if batch.num_rows:
            yield np.concatenate(sets_of(batch.column("text").to_pylist(), width))

    return hashes


def _parity_map(tokens: np.ndarray) -> bytes:
    bits = np.bincount((tokens >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _poster(counts, width: int, t: float, parts: int):
    """One row for each record and partition: record, size, parity map, and packed prefix tokens with position and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        noise = int(count.astype(np.int64).sum()) // len(count)
        for batch in batches:
            out: dict[int, list[tuple]] = {}
            for rec, s in zip(batch.column("rec").to_pylist(), sets_of(batch.column("text").to_pylist(), width)):
                prefix = ordered(s, count, 1)[: prefix_length(len(s), t)]
                often = count[(prefix % np.uint64(len(count))).astype(np.int64)]
                place = np.flatnonzero(often > 1)  # a token counted once is in this record alone
                if not len(place):
                    continue
                tokens, often = prefix[place], often[place]
                part = (mix(tokens) % np.uint64(parts)).astype(np.int64)
                rest = np.zeros(len(tokens), np.uint64)
                side = np.zeros(len(tokens), np.uint8)
                blocks = np.maximum(np.ceil((often.astype(np.int64) - noise) / HOT), 1).astype(np.int64)
                if (blocks > 1).any():
                    tokens, place, part, rest, side = _grid(tokens, place, part, blocks, rec, parts)
                short = ((tokens >> np.uint64(20)) ^ rest).astype(np.uint32)
                bits = _parity_map(s)
                order = np.argsort(part, kind="stable")
                at, starts = np.unique(part[order], return_index=True)
                for p, rows in zip(at.tolist(), np.split(order, starts[1:])):
                    out.setdefault(p, []).append((rec, len(s), bits, short[rows].tobytes(), place[rows].astype(np.uint32).tobytes(), side[rows].tobytes()))
            ps = list(out)
            pack = [
                (
                    np.array([r[0] for r in out[p]], np.int64).tobytes(), np.array([r[1] for r in out[p]], np.uint32).tobytes(), b"".join(r[2] for r in out[p]),
                    np.array([len(r[5]) for r in out[p]], np.uint32).tobytes(), b"".join(r[3] for r in out[p]), b"".join(r[4] for r in out[p]), b"".join(r[5] for r in out[p]),
                )
                for p in ps
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), *[pa.array([x[i] for x in pack], pa.binary()) for i in range(7)]], names=["part", *PACKED])

    return run


PACKED = ["recs", "sizes", "bits", "lengths", "tokens", "places", "sides"]


def _grid(tokens, place, part, blocks, rec, parts):
    """Spread the hot tokens over cells (a, b) of record blocks; a record goes to the cells of its block's row and column."""
    own = int(mix(np.array([rec], np.uint64))[0])
    of = np.repeat(np.arange(len(tokens)), blocks)
    other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = (np.uint64(own) % blocks.astype(np.uint64)).astype(np.int64)[of]
    a, b = np.minimum(mine, other), np.maximum(mine, other)
    cell = mix(tokens[of] + (a * 65_537 + b + 1).astype(np.uint64))
    cold = blocks[of] == 1
    part = np.where(cold, part[of], (cell % np.uint64(parts)).astype(np.int64))
    rest = np.where(cold, np.uint64(0), cell & np.uint64(0xFFFFFFFF))
    side = np.where(cold | (a == b), 0, np.where(mine < other, 1, 2)).astype(np.uint8)
    return tokens[of], place[of], part, rest, side


def _pairer(t: float):
    """Candidate pairs of a partition, after the length, position and parity bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        get = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        recs, sizes, lengths = get("recs", np.int64), get("sizes", np.uint32).astype(np.int64), get("lengths", np.uint32)
        bits = get("bits", np.uint64).reshape(len(recs), -1)
        tokens, places, sides = get("tokens", np.uint32), get("places", np.uint32).astype(np.int64), get("sides", np.uint8)
        rec = np.repeat(np.arange(len(recs)), lengths)
        order = np.argsort(tokens, kind="stable")
        tokens, places, sides, rec = tokens[order], places[order], sides[order], rec[order]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        length = np.diff(np.r_[start, len(tokens)])
        before = np.arange(len(tokens)) - np.repeat(start, length)  # earlier entries of the same token
        ends = np.cumsum(before)
        found: list[np.ndarray] = []

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        at = held = 0
        while at < len(tokens):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n = before[at:stop]
            right = np.repeat(np.arange(at, stop), n)
            left = right - (np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n)) - 1
            at = stop
            a, b = rec[left], rec[right]
            sa, sb = sizes[a], sizes[b]
            need = least_overlap(sa, sb, t)
            keep = (np.minimum(sa - places[left], sb - places[right]) >= need) & (np.minimum(sa, sb) >= t * np.maximum(sa, sb) - 1e-9)
            keep &= (sides[left] != sides[right]) | (sides[left] == 0)
            keep &= a != b
            a, b, most = a[keep], b[keep], (sa + sb - 2 * need)[keep]
            keep = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= most
            a, b = recs[a[keep]], recs[b[keep]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            held += len(found[-1])
            if held >= PAIRS_AT_ONCE:
                yield flush()
                held = 0
        if found:
            yield flush()

    return run


def _verifier(counts, width: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        kept: dict[int, tuple] = {}

        def of(rec, text):
            if rec not in kept:
                if len(kept) > 20_000:
                    kept.clear()
                s = shingles(text, width)
                n = prefix_length(len(s), t)
                kept[rec] = (s, frozenset(ordered(s, count, 2)[:n].tolist()), frozenset(ordered(s, count, 3)[:n].tolist()))
            return kept[rec]

        for batch in batches:
            a, b, sim = [], [], []
            for ra, ta, rb, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b"))):
                x, x2, x3 = of(ra, ta)
                y, y2, y3 = of(rb, tb)
                if x2.isdisjoint(y2) or x3.isdisjoint(y3):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= least_overlap(len(x), len(y), t):
                    a.append(ra), b.append(rb), sim.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_duplicates(rows: DataFrame, id_column: str, text_column: str, *, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every record with a token set, and (a, b, similarity) between classes; a < b are class ids.

    Records of equal sets share a class, named by its smallest id; their similarity is 1.
    """
    spark = rows.sparkSession
    texts = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    keyed = materialise(texts.mapInArrow(_keys(width), "id long, text string, key binary"), "keyed")
    classes = keyed.groupBy("key").agg(F.min("id").alias("rec"), F.min_by("text", "id").alias("text"), F.count("*").alias("n"))
    reps = materialise(classes.select("key", "rec", "text", "n"), "classes")
    measured = reps.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    counts = spark.sparkContext.broadcast(hashed_counts(reps, _all_tokens(width), cells_for(measured // 7)))
    # About one token in eight characters, 40 % of them in a prefix at 0.6; more partitions than tasks do no harm.
    parts = max(tasks_of(spark), math.ceil(measured / 8 * (1 - threshold) / TOKENS_A_PARTITION))
    posted = reps.select("rec", "text").mapInArrow(_poster(counts, width, threshold, parts), "part int, " + ", ".join(f"{c} binary" for c in PACKED))
    pairs = posted.groupBy("part").applyInArrow(_pairer(threshold), "a long, b long").distinct()
    side = lambda c: reps.select(F.col("rec").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "text_a", "b", "text_b")
    links = joined.mapInArrow(_verifier(counts, width, threshold), "a long, b long, similarity double")
    members = keyed.select("id", "key").distinct().join(reps.select("key", F.col("rec").alias("class_id")), "key").select("id", "class_id")
    return members, links


def near_pairs(rows: DataFrame, id_column: str, text_column: str, *, threshold: float, width: int) -> DataFrame:
    """(id_a, id_b): all pairs of records, copies included. Its size is what the caller asks for; groups use near_groups."""
    members, links = near_duplicates(rows, id_column, text_column, threshold=threshold, width=width)
    members = materialise(members, "members")
    # Copies of a class stand in blocks; who meets a class meets each of its blocks in a task of its own.
    crowded = members.groupBy("class_id").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("_blocks"), F.count("*").alias("_n"))
    placed = members.join(crowded, "class_id").withColumn("_block", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    right = placed.select(F.col("class_id").alias("b"), "_block", F.col("id").alias("y"))
    left = placed.select(F.col("class_id").alias("a"), F.col("_block").alias("_left"), F.col("id").alias("x"))
    linked = links.select("a", "b").join(crowded.select(F.col("class_id").alias("b"), "_blocks"), "b").select("a", "b", every)
    linked = linked.join(crowded.select(F.col("class_id").alias("a"), "_blocks"), "a").select("a", "b", "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_left"))
    across = linked.join(left, ["a", "_left"]).join(right, ["b", "_block"]).where("x <> y").select("x", "y")
    alike = placed.where("_n > 1")
    within = alike.select(F.col("class_id").alias("b"), F.col("id").alias("x"), every).join(right, ["b", "_block"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_groups(rows: DataFrame, id_column: str, text_column: str, *, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(id, group_id, links): the connected group of each record with a token set, and the classes it is linked to.

    group_id is the smallest id of the group. Labels spread by the smallest neighbour with shortcuts over the label's own
    label, each round a written table, until none changes.
    """
    members, links = near_duplicates(rows, id_column, text_column, threshold=threshold, width=width)
    links = materialise(links.select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    labels = held = materialise(degree.select(F.col("a").alias("node"), F.col("a").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        hop = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = materialise(step.join(hop, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        discard(held)
        held = step
        changed = step.where("label <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            break
    found = labels.join(degree.withColumnRenamed("a", "node"), "node").withColumnRenamed("node", "class_id")
    return members.join(found, "class_id", "left").select("id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
