"""Near-duplicate embeddings: all pairs of at least a given cosine, by dual
traversal of cover trees.

On unit vectors a cosine is a distance, so the levels of one large tree reach
from the whole table down to single vectors. Its upper levels are tables:

1. Rows with one vector are one entry with its number of copies.
2. Each entry goes to its nearest pivot, and entries of a cell that is too
   large to its nearest pivot inside the cell. Pivots are a bounded sample and
   only place entries; every entry is placed, and no result depends on them.
   A cell of more than one block's rows is dealt to blocks by hash, so a hot
   cell never meets in one task.
3. A block keeps its vectors with the cover tree over them, its centre and its
   covering radius (`cover_tree`).

The dual traversal starts with the pairs of cells, drops those further apart
than the threshold and both covering radii, goes on to the pairs of blocks in
the rest, and then into the trees of each block with up to `PARTNERS` others.
A task returns links per entry, as numbers, and a spanning forest of what it
linked, both bounded by the rows it read, so a crowd of near copies is counted
whole without being written out as pairs.

How much the bounds drop depends on the vectors. Where they have no structure
(independent directions in many dimensions) covering radii reach everywhere
and the centres of all blocks are compared with each other.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, with_package
from .components import components
from .cover_tree import SLACK, CoverTree, Links, pairs_within, unit
from .vectors import blocks as vector_blocks
from .vectors import is_finite

BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20  # of unit vectors; longer vectors make blocks of fewer rows
PIVOTS = (1024, 64)  # most pivots of a vector length, then of a cell
PARTNERS = 8  # blocks that one task row compares a block with, about


def block_rows(dim: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def placed(entries: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``entries`` of every cell with more than a block's rows moved to the
    cells of its nearest pivots; the first rows of a cell in hash order are its
    pivots, at most ``most``."""
    spark = entries.sparkSession
    sizes = entries.groupBy("dim", "cell").count().collect()  # one row per cell: a bounded number of pivots made them
    wanted = [(r["dim"], r["cell"], min(most, math.ceil(r["count"] / block_rows(r["dim"])))) for r in sizes if r["count"] > block_rows(r["dim"])]
    if not wanted:
        return entries
    in_order = W.partitionBy("dim", "cell").orderBy("h1", "h2")
    sample = (
        entries.join(F.broadcast(spark.createDataFrame(wanted, "dim int, cell long, m int")), ["dim", "cell"])
        .select("dim", "cell", "m", "embedding", F.row_number().over(in_order).alias("k")).filter(F.col("k") <= most).filter("k <= m")
    )
    pivots: dict[tuple[int, int], list] = {}
    for r in sample.collect():
        pivots.setdefault((r["dim"], r["cell"]), []).append(r["embedding"])
    sent = spark.sparkContext.broadcast({k: unit(np.array(v)) for k, v in pivots.items()})

    def nearest(batches):
        for b in batches:
            dims, cells = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "cell"))
            out = cells * (most + 1)
            index = np.arange(b.num_rows)
            numbered = pa.RecordBatch.from_arrays([pa.array(index), b.column(b.schema.get_field_index("embedding"))], names=["i", "embedding"])
            for own, x in vector_blocks(iter([numbered]), BLOCK_ROWS, ("i",)):
                x = unit(x)
                for cell in np.unique(cells[own]).tolist():
                    if (p := sent.value.get((x.shape[1], cell))) is not None:
                        at = cells[own] == cell
                        out[own[at]] += 1 + (x[at] @ p.T).argmax(1)
            yield b.set_column(b.schema.get_field_index("cell"), "cell", pa.array(out, pa.int64()))

    return scratch.keep(entries.mapInArrow(nearest, entries.schema))


def packed(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


BLOCK = "block long, dim int, cell long, centre array<double>, radius double, blob binary"


def build_block(table):
    """One block: unit vectors, ids, copies and the cover tree over them."""
    entry = table.combine_chunks().to_batches()[0]
    (ids, copies, x), = vector_blocks(iter([entry]), 1 << 40, ("entry", "copies"))
    order = np.argsort(ids)
    ids, copies, x = ids[order], copies[order], unit(x[order])
    tree = CoverTree.build(x)
    blob = packed(ids=ids, copies=copies, x=x, **{f"t{i}": a for i, a in enumerate(tree.arrays())})
    dim, cell = (entry.column(entry.schema.get_field_index(c))[0].as_py() for c in ("dim", "cell"))
    cols = [[int(ids[0])], [dim], [cell], [x[tree.centre[0]].tolist()], [float(tree.radius[0])], [blob]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary()), strict=True)],
                    names=["block", "dim", "cell", "centre", "radius", "blob"])


def opened(blob: bytes):
    z = np.load(io.BytesIO(blob), allow_pickle=False)
    return z["ids"], z["copies"], z["x"], CoverTree(*(z[f"t{i}"] for i in range(7)))


def within_reach(pairs: DataFrame, reach: float) -> DataFrame:
    """Pairs ``(a, b, ca, cb, ra, rb)`` whose covering balls come within ``reach``."""

    def run(batches):
        for b in batches:
            ca, cb = (b.column(b.schema.get_field_index(c)) for c in ("ca", "cb"))
            ra, rb = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("ra", "rb"))
            sizes = ca.value_lengths().to_numpy()
            x, y = ca.flatten().to_numpy(), cb.flatten().to_numpy()
            cosine = np.add.reduceat(x * y, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
            keep = np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0)) - ra - rb <= reach + SLACK
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def compare_group(key, table, least_cosine):
    """A block with its partners: links per entry and a spanning forest."""
    a = key[0].as_py()
    blobs = dict(zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True))
    partners = sorted(table.filter(pa.compute.field("partner")).column("block").to_pylist())
    ids, copies, x, tree = opened(blobs[a])
    degree = np.zeros(len(ids), np.int64)
    out_a, out_b, out_n = [], [], []

    def add(a, b, n):
        out_a.append(a), out_b.append(np.broadcast_to(b, len(a))), out_n.append(np.broadcast_to(n, len(a)))

    for partner in partners:
        same = partner == a
        other = (ids, copies, x, tree) if same else opened(blobs[partner])
        links: Links = pairs_within(x, tree, copies, other[2], other[3], other[1], least_cosine, same)
        degree += links.degree_a
        if not same and (linked := links.degree_b > 0).any():
            add(other[0][linked], -1, links.degree_b[linked])
        both = ids if same else np.concatenate([ids, other[0]])
        u, v = links.forest()
        if len(u):
            add(both[u], both[v], 0)
    if (linked := degree > 0).any():
        add(ids[linked], -1, degree[linked])
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_a, out_b, out_n)]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])


def links_of(entries: DataFrame, least_cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``entries(entry, copies, dim, h1, h2, embedding)`` to (entry, n): links
    with the rows of other entries, and a forest (a, b) of the linked entries."""
    cells = entries.withColumn("cell", F.lit(0).cast("long"))
    for most in PIVOTS:
        cells = placed(cells, most, scratch)
    sizes = cells.groupBy("dim", "cell").agg(F.count("*").alias("_n"))
    most_rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    dealt = cells.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.col("h2"), F.ceil(F.col("_n") / most_rows)))
    trees = scratch.keep(dealt.select("dim", "cell", "part", "entry", "copies", "embedding").groupBy("dim", "cell", "part").applyInArrow(build_block, BLOCK))

    reach = math.sqrt(2.0 - 2.0 * least_cosine)
    # Cells as nodes: the centre of one block, and the radius that covers the balls of all its blocks.
    head = trees.groupBy("dim", "cell").agg(F.min_by("centre", "block").alias("centre"))
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("h.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))
    nodes = scratch.keep(
        head.alias("h").join(trees.alias("b"), ["dim", "cell"])
        .groupBy("dim", "cell").agg(F.max(far + F.col("b.radius") + SLACK).alias("radius"), F.min_by("h.centre", "b.block").alias("centre"), F.min("b.block").alias("node"))
    )
    left = nodes.select("dim", F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    right = nodes.select("dim", F.col("node").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    near_cells = within_reach(left.join(right, "dim").filter("a <= b").drop("dim"), reach)
    own = trees.join(nodes.select("dim", "cell", "node"), ["dim", "cell"]).select("node", "block", "centre", "radius")
    below = (
        near_cells.join(own.select(F.col("node").alias("a"), F.col("block").alias("x"), F.col("centre").alias("ca"), F.col("radius").alias("ra")), "a")
        .join(own.select(F.col("node").alias("b"), F.col("block").alias("y"), F.col("centre").alias("cb"), F.col("radius").alias("rb")), "b")
        .filter("a < b OR x <= y").select(F.col("x").alias("a"), F.col("y").alias("b"), "ca", "cb", "ra", "rb")
    )
    near = scratch.keep(within_reach(below, reach))
    groups = max(1, math.ceil(trees.count() / PARTNERS))
    keyed = near.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(groups)))
    sides = keyed.select("a", "g", F.col("b").alias("block"), F.lit(True).alias("partner")).unionByName(
        keyed.select("a", "g", F.col("a").alias("block"), F.lit(False).alias("partner")).distinct())
    rows = sides.join(trees.select("block", "blob"), "block")
    found = scratch.keep(rows.groupBy("a", "g").applyInArrow(lambda key, t: compare_group(key, t, least_cosine), "a long, b long, n long"))
    scratch.drop(near, nodes, trees, *([cells] if cells is not entries else []))
    degrees = found.filter("b = -1 AND n > 0").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    return degrees, found.filter("n = 0").select("a", "b")


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.9) -> DataFrame:
    """One row per id of ``vectors(vec_id, embedding)``: vec_id, n_links (other
    ids linked directly, by a cosine of at least ``least_cosine``),
    component_id (smallest id reachable by links, itself included) and kept
    (vec_id = component_id).

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing; vectors of different lengths do not link. An id with
    several rows counts once, with its smallest usable vector; rows without an
    id take no part and have no row in the result. Rows with equal vectors link
    with each other. An empty table gives no rows; other columns, whatever
    their names, are ignored. ``least_cosine`` must be above 0 and at most 1.
    """
    spark = with_package(vectors.sparkSession)
    scratch = Scratch(spark)
    usable = is_finite() & F.exists("embedding", lambda x: x != 0)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL")
    rows = named.groupBy("vec_id").agg(F.min(F.when(usable, F.col("embedding"))).alias("embedding"))
    # 128 bits of hash stand for a vector where rows are grouped and joined
    rows = scratch.keep(rows.select("vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")))
    known = rows.filter("embedding IS NOT NULL")
    entries = scratch.keep(known.groupBy("h1", "h2").agg(F.min("vec_id").alias("number"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
                           .select("h1", "h2", F.col("number").alias("entry"), "copies", F.size("embedding").alias("dim"), "embedding"))
    degrees, forest = links_of(entries, least_cosine, scratch)
    roots = components(forest, scratch).select(F.col("node").alias("entry"), "root")
    about = (
        entries.select("h1", "h2", "entry", "copies").join(degrees, "entry", "left").join(roots, "entry", "left")
        .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "entry").alias("root"))
    )
    linked = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("h1")).alias("h1"), "h2").join(about, ["h1", "h2"], "left")
    root = F.coalesce("root", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
