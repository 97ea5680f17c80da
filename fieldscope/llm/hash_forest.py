"""Approximate nearest neighbours with a hash-prefix forest.

A tree gives every vector a long string: each symbol is the nearest, by
Euclidean distance, of a set of anchor vectors that are drawn from the shard's
own rows. So strings agree where vectors are near, whatever their lengths. A
shard of the vectors keeps one sorted array of strings per tree. A query
descends in each array by binary search to its longest-prefix matches; then all
trees ascend together, one symbol at a time, until the matches of all trees hold
enough different vectors. Those are compared exactly, and the nearest of all
shards are kept.

Queries are a stated set, broadcast in blocks of bounded size. A shard is a
bounded number of rows, so no group of vectors meets in one task; identical
vectors of a shard are one entry with its smallest ids.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import with_package

TREES = 48
SYMBOLS = 3
SHARD_ROWS = 8192
QUERY_BLOCK = 8192
LEAST_CANDIDATES, CANDIDATE_POWER = 512, 0.8  # a shard of n looks at max(512, n^0.8) vectors of its forest at least


class Forest:
    """Sorted arrays of the hash strings of the different vectors ``x``."""

    def __init__(self, x: np.ndarray):
        self.x, self.base = x, 2 * x.shape[1]
        # TREES x SYMBOLS anchor sets; a fixed seed, so a shard that is computed again is the same
        self.anchors = np.random.default_rng(len(x)).integers(0, len(x), (TREES, SYMBOLS, self.base))
        self.halves = (x * x).sum(1) / 2
        s = self.strings(x)
        self.order = np.argsort(s, axis=1, kind="stable")
        self.sorted = np.take_along_axis(s, self.order, axis=1)

    def strings(self, v: np.ndarray) -> np.ndarray:
        """Hash strings (trees x vectors) as integers of SYMBOLS digits to the
        base of twice the dimension."""
        out = np.zeros((TREES, len(v)), np.int64)
        for t, tree in enumerate(self.anchors):
            for rows in tree:
                # |v - a|^2 is smallest where v.a - |a|^2 / 2 is largest
                out[t] = out[t] * self.base + (v @ self.x[rows].T - self.halves[rows]).argmax(1)
        return out

    def candidates(self, q: np.ndarray, enough: int):
        """Per query the rows found by the synchronous ascent."""
        of = self.strings(q)
        levels = []
        for level in range(SYMBOLS):  # the longest prefix first
            cut = self.base**level
            low = of // cut * cut
            levels.append([(np.searchsorted(s, lo), np.searchsorted(s, lo + cut)) for s, lo in zip(self.sorted, low, strict=True)])
        for i in range(len(q)):
            for ranges in levels:
                if sum(hi[i] - lo[i] for lo, hi in ranges) >= enough:
                    rows = np.unique(np.concatenate([o[lo[i] : hi[i]] for o, (lo, hi) in zip(self.order, ranges, strict=True)]))
                    if len(rows) >= enough:
                        yield rows
                        break
            else:
                yield np.arange(len(self.x))  # the empty prefix: the whole shard


def search_shard(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """(query number, vec_id, distance) of the k nearest found in a shard."""
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((ids, of))  # ids of a vector, smallest first; a repeated (id, vector) row counts once
    ids, of = ids[order], of[order]
    once = np.concatenate([[True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])])
    ids, of = ids[once], of[once]
    starts = np.searchsorted(of, np.arange(len(distinct) + 1))
    forest = Forest(distinct)
    enough = max(LEAST_CANDIDATES, math.ceil(len(distinct) ** CANDIDATE_POWER))
    asked, back = np.unique(q, axis=0, return_inverse=True)
    back = back.ravel()
    near = []
    for v, rows in zip(asked, forest.candidates(asked, enough), strict=True):
        d = np.sqrt(((distinct[rows] - v) ** 2).sum(1))
        # k + 1 vectors, as one may have the query's own id only; ties of the last stay in
        last = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
        keep = d <= last
        near.append((rows[keep], d[keep]))
    out = []
    for i, j in enumerate(back):
        found = [(dist, int(v)) for r, dist in zip(*near[j], strict=True) for v in ids[starts[r] : starts[r + 1]][: k + 1].tolist() if v != q_ids[i]]
        out += [(i, v, dist) for dist, v in sorted(set(found))[:k]]
    return out


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(usable)


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The different (vec_id, embedding) rows of ``valid`` queries in blocks of
    about QUERY_BLOCK, dealt by id and vector."""
    q = queries.dropDuplicates(["vec_id", "embedding"])
    blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))
    return [q.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b) for b in range(blocks)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest found of ``vectors(vec_id, embedding)`` for each row of
    ``queries(vec_id, embedding)``: query_id, rank, vec_id, score (Euclidean).

    Rows with a null id, or a vector that is null, empty, zero or holds a null
    or non-finite component take no part. Vectors are compared with those of
    their own length only. A query's own id is no candidate; equal distances go
    by id; a repeated (id, vector) row counts once; two vectors under one query
    id are ranked as one query of that id. With k or fewer candidates all are
    returned. Other columns are ignored.
    """
    spark = with_package(vectors.sparkSession)
    x, q = valid(vectors), valid(queries)
    shards = max(1, math.ceil(x.count() / SHARD_ROWS))
    x = x.repartition(shards, F.xxhash64("vec_id"))
    found = []
    for stated in query_blocks(q):
        rows = stated.collect()  # a block of the stated queries
        asked: dict[int, tuple] = {}
        for dim in {len(r["embedding"]) for r in rows}:
            own = [r for r in rows if len(r["embedding"]) == dim]
            asked[dim] = np.array([r["vec_id"] for r in own], np.int64), np.array([r["embedding"] for r in own])
        block = spark.sparkContext.broadcast(asked)

        def run(batches, block=block):
            for ids, vectors in chunks(batches):
                if len(part := block.value.get(vectors.shape[1], ())):
                    got = search_shard(ids, vectors, *part, k)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0][[g[0] for g in got]] if got else [], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())],
                                                     names=["query_id", "vec_id", "score"])

        found.append(x.mapInArrow(run, "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    every = reduce(DataFrame.unionByName, found).dropDuplicates(["query_id", "vec_id", "score"])
    ranked = every.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)


def chunks(batches, rows: int = 2 * SHARD_ROWS):
    """Shards of at most ``rows`` rows and one vector length from a partition."""
    held: dict[int, list] = {}

    def flush(dim):
        ids, parts = zip(*held.pop(dim), strict=True)
        return np.concatenate(ids), np.concatenate(parts)

    for b in batches:
        ids, col = b.column("vec_id").to_numpy(), b.column("embedding")
        sizes = col.value_lengths().to_numpy()
        flat = col.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            held.setdefault(dim, []).append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
            if sum(len(i) for i, _ in held[dim]) >= rows:
                yield flush(dim)
    for dim in list(held):
        yield flush(dim)
