"""The k most similar vectors of every vector: balanced posting lists with boundary replication.

Index: centroids come from a balanced bisection of a bounded sample, ``SAMPLED`` vectors a centroid, drawn by id hash. Their
number grows with the rows, one for ``LIST_SIZE``, so lists keep their size up to ``CENTROIDS`` centroids in all (13 million
vectors); from there on lists grow and are split. A graph over the centroids is built once, broadcast, and searched best-first
for the lists of a vector. A vector is posted to every list whose centroid is at most (1 + ``RATIO``) times as far as its nearest
one, at most ``LISTS``; the same distance-ratio rule selects the lists in which it is searched. Every row is indexed and every
row is a query.

Search: inside a list all cosines are computed in double precision, in blocks. Lists over ``BLOCK`` rows are split in blocks
that meet pairwise in tasks of their own, so a hot list spreads over the cluster. Equal vectors are searched once: they form
a class that carries its k + 1 smallest ids.

What goes through the driver and is broadcast: at most ``CENTROIDS`` centroids in all (8 MB at 64 dimensions) with their graph,
from at most twice ``SAMPLED`` x ``CENTROIDS`` vectors, whatever the data.

Defined results: null, zero, non-finite and wrong-length vectors take no part; ties go to the smaller id; a null model or id
takes no part; repeated ids keep the greatest vector; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fondaco.session import materialise

SAMPLED = 8
CENTROIDS = 32_768
LIST_SIZE = 400
LISTS = 6
RATIO = 0.25
DEGREE = 16
BEAM = 24
BLOCK = 8_000


def valid_vectors(rows: DataFrame, id_column: str, model: str, dims: str, vector: str) -> DataFrame:
    """(id, model, vec) of the vectors that can be compared."""
    v = F.col("vec")
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select(F.col(id_column).alias("id"), F.col(model).alias("model"), F.col(dims).alias("_dims"), F.col(vector).alias("vec"))
    rows = rows.where("id is not null and model is not null and vec is not null").where(F.size("vec") == F.col("_dims"))
    rows = rows.withColumn("_s", squares).where((F.col("_s") > 0) & ~F.isnan("_s") & (F.col("_s") < float("inf")))
    return rows.select("id", "model", "vec")


def balanced_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Centroids of a bisection that always splits the largest part at the median along its two-means axis."""
    import heapq

    rng = np.random.default_rng(7)
    parts = [(-len(sample), 0, np.arange(len(sample)))]
    made = 1
    while len(parts) < count and -parts[0][0] >= 2:
        _, _, rows = heapq.heappop(parts)
        x = sample[rows]
        a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
        for _ in range(4):
            near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        along = x @ (b - a)
        order = np.argsort(along, kind="stable")
        # Cut where the two means part, kept between a quarter and three quarters.
        cut = int(np.clip(near.sum(), len(x) // 4, len(x) - len(x) // 4)) if 0 < near.sum() < len(x) else len(x) // 2
        cut = max(1, min(len(x) - 1, cut))
        for half in (order[:cut], order[cut:]):
            heapq.heappush(parts, (-len(half), made, rows[half]))
            made += 1
    return np.stack([sample[rows].mean(0) for _, _, rows in parts])


class CentroidGraph:
    """A neighbour graph over centroids, searched best-first from a few entries; all queries of a batch move together."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        self.sq = (self.c**2).sum(1)
        n = len(self.c)
        degree = min(DEGREE, n - 1)
        links = np.zeros((n, max(degree, 1)), np.int32)
        for at in range(0, n, 1024):
            d = self.sq[None, :] - 2 * self.c[at : at + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            if degree:
                links[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        # A ring keeps the graph connected; a few far links make it a small world.
        far = np.random.default_rng(13).integers(0, n, (n, 4)).astype(np.int32)
        every = np.sort(np.concatenate([links, far, ((np.arange(n) + 1) % n)[:, None].astype(np.int32)], axis=1), axis=1)
        # A link that recurs becomes a link to the node itself, which a search has always met already.
        again = np.concatenate([np.zeros((n, 1), bool), every[:, 1:] == every[:, :-1]], axis=1)
        self.links = np.where(again, np.arange(n, dtype=np.int32)[:, None], every)
        self.entries = self._spread(min(n, max(32, int(4 * np.sqrt(n)))))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.c, self.sq, self.links, self.entries

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, ...]) -> "CentroidGraph":
        graph = cls.__new__(cls)
        graph.c, graph.sq, graph.links, graph.entries = arrays
        return graph

    def _spread(self, count: int) -> np.ndarray:
        """Entries far from one another: each next one is the centroid farthest from those before."""
        chosen = [0]
        least = ((self.c - self.c[0]) ** 2).sum(1)
        while len(chosen) < count:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, ((self.c - self.c[chosen[-1]]) ** 2).sum(1))
        return np.array(chosen, np.int64)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the k nearest centroids of each row, nearest first."""
        n, beam = len(self.c), max(BEAM, k)
        xs = (x**2).sum(1)[:, None]
        first = self.sq[self.entries] - 2 * x @ self.c[self.entries].T + xs
        take = min(beam, len(self.entries))
        near = np.argpartition(first, take - 1, axis=1)[:, :take]
        ids, dist = self.entries[near], np.take_along_axis(first, near, 1)
        open_ = np.ones(ids.shape, bool)
        for _ in range(32):
            # Expand the best unexpanded node of each query.
            best = np.where(open_, dist, np.inf).argmin(1)
            row = np.arange(len(x))
            active = open_[row, best]
            if not active.any():
                break
            open_[row, best] = False
            fresh = self.links[ids[row, best]].astype(np.int64)
            d = self.sq[fresh] - 2 * np.einsum("nd,nkd->nk", x, self.c[fresh]) + xs
            d[(fresh[:, :, None] == ids[:, None, :]).any(2)] = np.inf
            ids, dist, open_ = np.concatenate([ids, fresh], 1), np.concatenate([dist, d], 1), np.concatenate([open_, np.isfinite(d)], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, open_ = (np.take_along_axis(v, keep, 1) for v in (ids, dist, open_))
            if (np.where(open_, dist, np.inf).min(1) > np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1]).all():
                break
        order = np.argsort(dist, axis=1, kind="stable")[:, : min(k, n)]
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assigner(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {m: CentroidGraph.of(arrays) for m, arrays in index.value.items()}
        for batch in batches:
            models = np.asarray(batch.column("model").to_pylist(), object)
            lists: list = [None] * len(models)
            for m in set(models):
                rows = np.flatnonzero(models == m)
                graph = graphs[m]
                x = _matrix(batch.column("vec").take(pa.array(rows)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for at in range(0, len(rows), 2048):
                    ids, d = graph.search(x[at : at + 2048].astype(np.float32), LISTS)
                    keep = np.sqrt(d) <= (1 + RATIO) * np.sqrt(d[:, :1]) + 1e-6
                    for r, i, k in zip(rows[at : at + 2048], ids, keep):
                        lists[r] = i[k].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    return run


def _searcher(k: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("vec"))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = group.column("cid").to_numpy()
        side = group.column("side").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, side = x[order], ids[order], side[order]
        a, b, c = [], [], []
        for at in range(0, len(x), 512):
            cos = x[at : at + 512] @ x.T
            cos[cos < least - 1e-6] = -1
            own = np.arange(at, at + len(cos))
            cos[np.arange(len(cos)), own] = -1
            # In a cell of two different blocks only pairs across them count; those inside have a cell of their own.
            cos[(side[own][:, None] == side[None, :]) & (side[own] > 0)[:, None]] = -1
            q, m = np.nonzero(cos > -1)
            value = np.round(cos[q, m], 6)
            good = value >= least
            q, m, value = q[good], m[good], value[good]
            rank = np.lexsort((m, -value, q))  # members stand in id order
            q, m, value = q[rank], m[rank], value[rank]
            start = np.searchsorted(q, np.arange(len(cos)))
            keep = np.arange(len(q)) - start[q] < k
            a.append(ids[at + q[keep]]), b.append(ids[m[keep]]), c.append(value[keep])
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table([cat(a, pa.int64()), cat(b, pa.int64()), cat(c, pa.float64())], names=["cid", "near", "cosine"])

    return run


def nearest(rows: DataFrame, id_column: str, model: str, dims: str, vector: str, k: int = 5, least: float = 0.85) -> DataFrame:
    """(id, near, cosine): up to k most similar rows of the same model for every row, of cosine ``least`` or more."""
    spark = rows.sparkSession
    keyed = valid_vectors(rows, id_column, model, dims, vector)
    keyed = keyed.groupBy("id", "model").agg(F.max("vec").alias("vec"))
    key = F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))
    keyed = materialise(keyed.withColumn("key", key), "vectors")

    # Classes of equal vectors; cid is the smallest id.
    classes = materialise(keyed.groupBy("model", "key").agg(F.min("id").alias("cid"), F.first("vec").alias("vec")), "classes")
    sizes = {r["model"]: r["n"] for r in classes.groupBy("model").agg(F.count("*").alias("n")).limit(CENTROIDS // 16 + 1).collect()}
    if not sizes:
        return spark.createDataFrame([], "id long, near long, cosine double")
    if len(sizes) > CENTROIDS // 16:
        raise ValueError(f"more than {CENTROIDS // 16} models share the {CENTROIDS} centroids; index them in several runs")
    total = sum(sizes.values())
    counts = {m: max(1, min(n // LIST_SIZE, CENTROIDS * n // total)) for m, n in sizes.items()}
    drawn = F.lit(False)
    for m, n in sizes.items():
        share = min(1.0, (SAMPLED * counts[m] + 64) / n)
        drawn = drawn | ((F.col("model") == m) & (F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(1 << 20)) <= int(share * (1 << 20))))
    sample = classes.where(drawn).select("model", "vec").toArrow()
    models = np.asarray(sample.column("model").to_pylist(), object)
    index = {}
    for m, count in counts.items():
        x = _matrix(sample.column("vec").filter(pa.array(models == m)))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index[m] = CentroidGraph(balanced_centroids(x.astype(np.float32), max(1, min(count, len(x) // 2)))).arrays()
    index = spark.sparkContext.broadcast(index)
    posted = materialise(
        classes.select("cid", "model", "vec").mapInArrow(_assigner(index), "cid long, model string, vec array<float>, lists array<int>"), "postings"
    )

    # Lists over BLOCK rows are split; the counts are at most one row a list.
    at = posted.select("cid", "model", F.explode("lists").alias("list"), "vec")
    counts = posted.select("model", F.explode("lists").alias("list")).groupBy("model", "list").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    at = at.join(F.broadcast(counts.withColumn("blocks", blocks).drop("n")), ["model", "list"])
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(other, F.col("own")).alias("a"), F.greatest(other, F.col("own")).alias("b"),
            F.when(other == F.col("own"), 0).when(F.col("own") < other, 1).otherwise(2).alias("side"),
        ),
    )
    at = at.withColumn("own", own).select("cid", "vec", "model", "list", F.explode(cells).alias("cell"))
    at = at.select("cid", "vec", "model", "list", "cell.a", "cell.b", "cell.side")
    found = at.groupBy("model", "list", "a", "b").applyInArrow(_searcher(k, least), "cid long, near long, cosine double")
    # A pair found in several lists has one rank, so its copies go after the cut, in the same partitions.
    best = Window.partitionBy("cid").orderBy(F.desc("cosine"), "near")
    found = found.withColumn("_n", F.dense_rank().over(best)).where(F.col("_n") <= k).groupBy("cid", "near").agg(F.max("cosine").alias("cosine"))

    # From classes back to rows: the k + 1 smallest ids of a class stand for it.
    members = keyed.join(classes.select("model", "key", "cid"), ["model", "key"]).select("id", "cid")
    smallest = Window.partitionBy("cid").orderBy("id")
    few = members.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1).drop("_n")
    crowded = few.groupBy("cid").agg(F.count("*").alias("_n")).where("_n > 1").select("cid", F.col("cid").alias("near"), F.lit(1.0).alias("cosine"))
    ranked = found.unionByName(crowded).join(few.withColumnRenamed("cid", "near").withColumnRenamed("id", "other"), "near")
    first = Window.partitionBy("cid").orderBy(F.desc("cosine"), "other")
    ranked = ranked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    listed = ranked.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("other").alias("near"), "cosine"))).alias("_list"))
    own_list = F.slice(F.filter("_list", lambda s: s.near != F.col("id")), 1, k)
    return members.join(listed, "cid").select("id", F.explode(own_list).alias("s")).select("id", "s.near", "s.cosine")


def nearest_pairs(rows: DataFrame, id_column: str, model: str, dims: str, vector: str, k: int = 5, least: float = 0.85) -> DataFrame:
    """(id_a, id_b, cosine): pairs where at least one row is among the k most similar of the other."""
    found = nearest(rows, id_column, model, dims, vector, k, least)
    return found.groupBy(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).agg(F.max("cosine").alias("cosine"))
