"""Hard-negative mining with Kronecker-packed inner products.

Scores are integer inner products of floor(256 x) components. Several
candidates share one wide integer: their components are biased to be
non-negative and laid into separate fields, each wide enough for a whole
biased inner product, so that one multiplication by an anchor's component
advances all of them at once and no field carries into the next. Unpacking the
fields and taking the bias off gives each candidate's exact score. Where two
fields or more fit into 53 bits the wide integers are doubles (all sums are
whole numbers below 2^53, hence exact); longer fields use Python integers of
any width.

Anchors are a stated set. They are broadcast in blocks of bounded size, and
every block meets all rows twice: once for its positives, once for the
negatives inside each positive's score window. A task keeps only the best few
per anchor while it reads, so neither a hot label nor a hot vector gathers
anywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, with_package
from .vectors import blocks, is_finite, one_row_per_id

SCALE = 256
ANCHOR_BLOCK = 8192  # anchors broadcast at a time
CANDIDATE_BLOCK = 4096  # rows packed at a time
TILE = 512  # anchors multiplied at a time
BIG_FIELDS = 64  # candidates in one Python integer
NONE = -np.iinfo(np.int64).max  # no score; its negative is a 64-bit integer too


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): doubles where all are below 2^52, else Python integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**44:
        return np.floor(SCALE * x)
    return np.array([[math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in row] for row in x.tolist()], dtype=object)


class Packed:
    """Candidates packed for anchors whose components lie in [low, high]."""

    def __init__(self, rows: np.ndarray, low, high):
        n, self.dim = rows.shape
        self.n, self.sums = n, rows.sum(1)
        self.anchor_bias, self.bias = -int(low), -int(rows.min())
        most = self.dim * (int(high) - int(low)) * (int(rows.max()) + self.bias)
        self.width = max(1, most.bit_length())
        self.small = self.width <= 53 and rows.dtype != object
        self.fields = 53 // self.width if self.small else BIG_FIELDS
        kind = np.float64 if self.small else object
        whole = np.zeros((-(-n // self.fields) * self.fields, self.dim), kind)
        whole[:n] = (rows if self.small else as_python(rows)) + self.bias
        shares = whole.reshape(-1, self.fields, self.dim)
        self.wide = sum(shares[:, f] * (1 << self.width * f) for f in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates; beyond 64 bits the
        nearest 64-bit integer."""
        biased = (anchors if self.small else as_python(anchors)) + self.anchor_bias
        product = biased @ self.wide.T
        if self.small:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        fields = np.stack([product >> (self.width * f) & mask for f in range(self.fields)], axis=2).reshape(len(anchors), -1)[:, : self.n]
        if self.small:
            off = self.bias * anchors.sum(1).astype(np.int64)[:, None] + self.anchor_bias * self.sums.astype(np.int64)[None, :]
            return fields - off - self.dim * self.bias * self.anchor_bias
        off = self.bias * as_python(anchors).sum(1)[:, None] + self.anchor_bias * as_python(self.sums)[None, :]
        return np.clip(fields - off - self.dim * self.bias * self.anchor_bias, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def as_python(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Best:
    """The best ``k`` (score, id) of each of ``shape`` lists: higher scores
    first, then smaller ids."""

    def __init__(self, shape: tuple[int, ...], k: int):
        self.k = k
        self.score, self.id = np.full((*shape, k), NONE), np.zeros((*shape, k), np.int64)

    def add(self, at, score: np.ndarray, ids: np.ndarray):
        """Merge new entries (last axis) into the lists at ``at``."""
        score, ids = np.concatenate([self.score[at], score], -1), np.concatenate([self.id[at], ids], -1)
        first = np.lexsort((ids, -score), axis=-1)[..., : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, first, -1), np.take_along_axis(ids, first, -1)


def sorted_by_id(ids, *more):
    order = np.argsort(ids, kind="stable")
    return ids[order], *(m[order] for m in more)


def positives_of(batches, anchors: dict, k: int, block: int = CANDIDATE_BLOCK, tile_rows: int = TILE):
    """(anchor number, id, score) of the best ``k`` rows of each anchor's own label."""
    best: dict[int, Best] = {}
    for ids, labels, x in blocks(batches, block, ("vec_id", "label")):
        if (part := anchors.get(x.shape[1])) is None:
            continue
        held = best.setdefault(x.shape[1], Best((len(part["id"]),), k))
        ids, labels, rows = sorted_by_id(ids, labels, integers(x))
        for label in np.intersect1d(labels, part["label"]).tolist():
            own, mine = np.flatnonzero(labels == label), np.flatnonzero(part["label"] == label)
            packed = Packed(rows[own], part["low"], part["high"])
            for at in range(0, len(mine), tile_rows):
                tile = mine[at : at + tile_rows]
                score = packed.scores(part["rows"][tile])
                score[part["id"][tile][:, None] == ids[own][None, :]] = NONE
                first = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend, so ties stay in their order
                held.add(tile, np.take_along_axis(score, first, 1), ids[own][first])
    for dim, held in best.items():
        a, _ = np.nonzero(held.score > NONE)
        yield anchors[dim]["number"][a], held.id[held.score > NONE], held.score[held.score > NONE]


def negatives_of(batches, anchors: dict, k: int, low: int, high: int, block: int = CANDIDATE_BLOCK, tile_rows: int = TILE):
    """(anchor number, place of the positive, id, score) of the best ``k`` rows
    of other labels in each positive's score window."""
    best: dict[int, Best] = {}
    for ids, labels, x in blocks(batches, block, ("vec_id", "label")):
        if (part := anchors.get(x.shape[1])) is None:
            continue
        held = best.setdefault(x.shape[1], Best(part["score"].shape, k))
        ids, labels, rows = sorted_by_id(ids, labels, integers(x))
        packed = Packed(rows, part["low"], part["high"])
        for at in range(0, len(part["id"]), tile_rows):
            tile = np.arange(at, min(at + tile_rows, len(part["id"])))
            score = packed.scores(part["rows"][tile])
            score[part["label"][tile][:, None] == labels[None, :]] = NONE
            order = np.argsort(-score, axis=1, kind="stable")
            score = np.take_along_axis(score, order, 1)
            for i, t in enumerate(tile.tolist()):
                for p, s in enumerate(part["score"][t].tolist()):
                    if s != NONE:
                        top, least = high * s // 100, -(-low * s // 100)
                        start = np.searchsorted(-score[i], -top)
                        stop = start + min(k, np.searchsorted(-score[i][start:], -least, side="right"))
                        if score[i][start:stop].size:
                            held.add((t, p), score[i][start:stop], ids[order[i][start:stop]])
    for dim, held in best.items():
        a, p, _ = np.nonzero(held.score > NONE)
        yield anchors[dim]["number"][a], p, held.id[held.score > NONE], held.score[held.score > NONE]


def by_length(rows: list) -> dict[int, dict[str, np.ndarray]]:
    """Anchors of a block by the length of their vectors."""
    out = {}
    for dim in {len(r["embedding"]) for r in rows}:
        own = [(i, r) for i, r in enumerate(rows) if len(r["embedding"]) == dim]
        x = integers(np.array([r["embedding"] for _, r in own]))
        out[dim] = {"number": np.array([i for i, _ in own]), "id": np.array([r["vec_id"] for _, r in own], np.int64),
                    "label": np.array([r["label"] for _, r in own], np.int64), "rows": x, "low": x.min(), "high": x.max()}
    return out


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         block: int = CANDIDATE_BLOCK, tile_rows: int = TILE) -> DataFrame:
    """For each anchor among ``vectors(vec_id, label, embedding)`` and each of
    its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` per cent of the positive's: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Scores are inner products of
    floor(256 x) components; higher ones come first, ties by smaller id.

    Rows with a null id, a null label, or a vector that is null, empty or holds
    a null or non-finite component take no part. An id with several usable rows
    counts once, with its smallest (label, vector). Vectors are compared with
    those of their own length only. A positive with a negative score has an
    empty window; one with score 0 takes scores of 0. Scores beyond 64 bits are
    clipped to 64 bits. An empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    spark = with_package(vectors.sparkSession)
    scratch = Scratch(spark)
    usable = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").filter(F.col("label").isNotNull() & is_finite())
    rows = scratch.keep(one_row_per_id(usable, "label", "embedding"))
    anchors = rows.filter(is_anchor)
    n_blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    parts = []
    for b in range(n_blocks):
        rows_here = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()  # about ANCHOR_BLOCK rows
        if not rows_here:
            continue
        asked = by_length(rows_here)
        sent = spark.sparkContext.broadcast(asked)

        def find_positives(batches, sent=sent):
            for a, ids, score in positives_of(batches, sent.value, positives, block, tile_rows):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["a", "id", "score"])

        best = W.partitionBy("a").orderBy(F.desc("score"), "id")
        found = rows.mapInArrow(find_positives, "a long, id long, score long").withColumn("p", F.row_number().over(best) - 1)
        got = found.filter(F.col("p") < positives).collect()  # at most ANCHOR_BLOCK x positives
        score, of = np.full((len(rows_here), positives), NONE), np.zeros((len(rows_here), positives), np.int64)
        for r in got:
            score[r["a"], r["p"]], of[r["a"], r["p"]] = r["score"], r["id"]
        for part in asked.values():
            part["score"], part["positive"] = score[part["number"]], of[part["number"]]
        windows = spark.sparkContext.broadcast((asked, np.array([r["vec_id"] for r in rows_here], np.int64), of, score))

        def find_negatives(batches, windows=windows):
            asked, ids, of, score = windows.value
            for a, p, neg, s in negatives_of(batches, asked, negatives, low, high, block, tile_rows):
                cols = [ids[a], of[a, p], neg, score[a, p], s]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        ranked = rows.mapInArrow(find_negatives, schema).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
        parts.append(scratch.keep(ranked))
        sent.destroy()
        windows.destroy()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*[scratch.path(p) for p in parts])
    scratch.drop(rows)
    return out.select(*columns)
