"""Near-duplicate detection by Order MinHash.

A document's k-mers are its five-word shingles, labelled with their occurrence
number. A sketch takes the three labelled shingles of smallest hash and keeps
them in text order; ``BANDS`` sketches are drawn, each a bucket key. Documents
of a bucket are candidates, and a pair is a link if a banded alignment of
their words keeps enough whole shingles in order:
kept / (n_a + n_b - kept) >= 0.8. Classes are the connected components.

Identical word sequences are one node from the start. Nodes linked so far are of
one side (component), and only pairs of two sides are ever tried, so a crowd of
near copies costs about one alignment a node:

1. every node of a bucket with the bucket's leader; again with other leaders
   where a bucket has nodes of several sides left;
2. in buckets of up to ``SMALL`` nodes all pairs of two sides;
3. the nodes of larger buckets with several sides meet in new buckets by their
   rarest labelled shingles, as many as a pair of 0.8 must have one of in common
   (a prefix filter, exact for every pair of them), where step 1 and then all
   pairs of two sides follow, of small buckets first, as they close larger ones.
   A pair is passed over where the shingles rarer than the bucket's, which only
   one of the two can have there, are too many for 0.8 already.

No bucket is capped, and none is expanded into all its pairs: nodes of one side
are not paired, and in step 3 a bucket is one shingle rare in its crowd.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, likely, map_batches, sliced, with_package, words_of
from .components import components

K = 5
LEAST = 0.8
BANDS = 16  # a pair of 0.8 misses all of them once in 100,000: (1 - 0.8^3)^16
PICKED = 3
SMALL = 32  # nodes of a bucket whose pairs of two sides are all tried at once
LEADERS = 3  # leaders that a bucket is tried with in turn while it has several sides
BITS = 1024
WIDER = (4,)  # times SMALL: buckets up to these sizes come before those of any size
HELD_LABELS = 2 << 20  # shingles that a task keeps of nodes it has met
FREQUENT = 50_000  # most shingles of crowds, 16 bytes each, that every task knows
HOT = 256  # pairs of one node beyond which its words are sent to several tasks

_U = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)
_SEED = np.random.default_rng(20).integers(1, 2**63, (BANDS, 2), dtype=np.int64).astype(_U) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def labelled_shingles(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the labelled shingles of documents laid end to end, with each
    document's first shingle and number of shingles. A document of one to four
    words has one shingle, of all its words."""
    n = np.where(sizes >= K, sizes - K + 1, np.minimum(sizes, 1))
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - first[of] + starts[of]
    end = (starts + sizes)[of]
    padded = np.concatenate([codes.astype(_U) + _U(1), np.zeros(K, _U)])
    h = np.zeros(len(at), _U)
    for j in range(K):
        h += np.where(at + j < end, padded[at + j], _U(0)) * _PLACE[j]
    h = _mix(h)
    key = h ^ _mix(of.astype(_U) + _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if again.any():  # occurrence numbers, in text order
        place = np.arange(len(order))
        run = np.maximum.accumulate(np.where(again, 0, place))
        h[order] += (place - run).astype(_U) * _U(0xA24BAED4963EE407)
        h = _mix(h)
    return h, first, n


def sketches(labels: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x BANDS) of documents with at least one shingle."""
    of = np.repeat(np.arange(len(n)), n)
    out = np.empty((len(n), BANDS), np.int64)
    none = _U(0xFFFFFFFFFFFFFFFF)
    for band, (flip, times) in enumerate(_SEED):
        v = (labels ^ flip) * times
        v ^= v >> _U(29)
        picked = np.full((len(n), PICKED), len(labels), np.int64)
        for i in range(PICKED):
            low = np.minimum.reduceat(v, first)
            at = np.flatnonzero((v == low[of]) & (v != none))
            picked[of[at], i] = at
            v[at] = none
        picked.sort(axis=1)  # text order
        key = np.full(len(n), _U(band + 1))
        for i in range(PICKED):
            there = picked[:, i] < len(labels)
            key = _mix(key * _U(0x9E3779B97F4A7C15) + np.where(there, labels[np.minimum(picked[:, i], len(labels) - 1)], _U(0)))
        out[:, band] = key.view(np.int64)
    return out


def kept_shingles(a: list[int], b: list[int], most: int) -> int | None:
    """Whole shingles kept by a smallest-edit alignment of two word sequences,
    searched in the band of at most ``most`` insertions and deletions; None if
    there is no such alignment."""
    na, nb = len(a), len(b)

    def run(x: int, y: int) -> int:
        z = x
        while z < na and y < nb and a[z : z + 32] == b[y : y + 32]:
            step = min(32, na - z, nb - y)
            z, y = z + step, y + step
        while z < na and y < nb and a[z] == b[y]:
            z, y = z + 1, y + 1
        return z - x

    r = run(0, 0)
    reach = {0: (r, max(0, r - K + 1))}
    if r == na == nb:
        return reach[0][1]
    for d in range(1, most + 1):
        new = {}
        for k in range(-min(d, nb), min(d, na) + 1):
            if (k + d) & 1:
                continue
            right, down = reach.get(k - 1), reach.get(k + 1)
            best = None
            if right and right[0] < na:
                best = (right[0] + 1, right[1])
            if down and down[0] - k <= nb and (best is None or down > best):
                best = down
            if best is None:
                continue
            x, kept = best
            if x - k < 0:
                continue
            r = run(x, x - k)
            new[k] = (x + r, kept + max(0, r - K + 1))
            if x + r == na and x + r - k == nb:
                return new[k][1]
        reach = new | {k: v for k, v in reach.items() if k not in new}
    return None


def _labels(codes: np.ndarray) -> np.ndarray:
    return labelled_shingles(codes, np.array([0]), np.array([len(codes)]))[0]


def similarity(a: np.ndarray, b: np.ndarray, la: np.ndarray | None = None, lb: np.ndarray | None = None) -> float:
    """Similarity of two texts' word codes, 0 where it is below LEAST."""
    la, lb = _labels(a) if la is None else la, _labels(b) if lb is None else lb
    if not len(la) or not len(lb):
        return 0.0
    total = len(la) + len(lb)
    if min(len(la), len(lb)) < LEAST * max(len(la), len(lb)):
        return 0.0
    common = len(np.intersect1d(la, lb, assume_unique=True))
    if common < LEAST * (total - common):  # the alignment keeps no more than both have
        return 0.0
    kept = kept_shingles(a.tolist(), b.tolist(), total // 9 + 1)
    s = kept / (total - kept) if kept else 0.0
    return s if s >= LEAST else 0.0


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the word sequence; null without words), keys."""

    def step(b: pa.RecordBatch) -> dict:
        lists = [words_of(t) for t in b.column("text").to_pylist()]
        full = [i for i, w in enumerate(lists) if w]
        nodes: list = [None] * len(lists)
        keys: list = [[]] * len(lists)
        if full:
            sizes = np.array([len(lists[i]) for i in full])
            codes = np.concatenate([word_codes(lists[i]) for i in full])
            got = sketches(*labelled_shingles(codes, np.cumsum(sizes) - sizes, sizes))
            for i, k in zip(full, got.tolist(), strict=True):
                nodes[i], keys[i] = hashlib.blake2b(b" ".join(lists[i]), digest_size=16).digest(), k
        return {"doc_id": b.column("doc_id"), "node": nodes, "keys": keys}

    return map_batches(docs.select("doc_id", "text"), step, docs.select("doc_id").schema.add("node", "binary").add("keys", T.ArrayType(T.LongType())), most_bytes=2 << 20)


def codes_of(docs: DataFrame) -> DataFrame:
    """node, codes (four bytes a word), number of shingles and their bitmap,
    of texts with words."""

    def step(b: pa.RecordBatch) -> dict:
        lists = [w for w in map(words_of, b.column("text").to_pylist()) if w]
        codes = [word_codes(w) for w in lists]
        labels = [_labels(c) for c in codes]
        return {"node": [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in lists], "codes": [c.tobytes() for c in codes],
                "shingles": [len(x) for x in labels], "bits": pa.array([bitmap(x).tolist() for x in labels], pa.list_(pa.int64()))}

    return map_batches(docs.select("text"), step, "node binary, codes binary, shingles int, bits array<bigint>")


def bitmap(labels: np.ndarray) -> np.ndarray:
    """One bit of BITS for each labelled shingle, as 64-bit integers."""
    out = np.zeros(BITS // 64, _U)
    at = labels % _U(BITS)
    np.bitwise_or.at(out, (at // _U(64)).astype(np.int64), _U(1) << at % _U(64))
    return out.view(np.int64)


def _can_be(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow 0.8: each differing bit is a shingle that only
    one of the two has, and a link has at most a ninth of the sum of both."""
    of = lambda node, k: codes.select(F.col("node").alias(node), F.col("shingles").alias(f"n{k}"), F.col("bits").alias(f"s{k}"))
    return pairs.join(of("a", 1), "a").join(of("b", 2), "b").filter(_differ("s1", "s2") * 9 <= F.col("n1") + F.col("n2")).select("a", "b")


def _differ(a: str, b: str):
    """Number of bits that differ between two bitmaps."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, c: n + c)


def _with_sides(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``keys(key, node, ...)`` with each node's side, of buckets with two sides or more."""
    if roots is None:
        sided = keys.withColumn("side", F.col("node"))
    else:
        sided = keys.join(roots, "node", "left").withColumn("side", F.coalesce("root", "node")).drop("root")
    open_ = sided.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("s"), F.max("side").alias("t")).filter("s <> t").select("key", "n")
    return sided.join(open_, "key")


def _with_leader(sided: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each node with its bucket's leader, where their sides
    differ. Each turn has its own order of nodes to choose leaders by; in buckets
    of rare shingles the first leader is one with few shingles rarer than that."""
    first = [F.col("before")] if turn == 0 and "before" in sided.columns else []
    rank = F.struct(*first, F.xxhash64(F.lit(turn), "node").alias("h"), F.struct(*[F.col(c).alias(f"{c}_a") for c in sided.columns if c not in ("key", "n")]).alias("x"))
    leaders = sided.groupBy("key").agg(F.min(rank)["x"].alias("x")).select("key", "x.*")
    led = sided.join(leaders, "key").filter("side <> side_a").filter(_near_enough(sided, "_a"))
    return led.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def _two_sides(sided: DataFrame) -> DataFrame:
    """All pairs of two sides of each bucket, but for those that ``_near_enough`` excludes."""
    other = sided.select("key", *[F.col(c).alias(f"{c}_b") for c in sided.columns if c not in ("key", "n")])
    pairs = sided.join(other, "key").filter("side < side_b").filter(_near_enough(sided, "_b"))
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _near_enough(sided: DataFrame, other: str):
    """Positional filter in buckets of rare shingles: in the bucket of the rarest
    shingle that two nodes share, all rarer ones of both are of one of them only,
    and a link has at most a ninth of the sum of both on one side only. The
    bitmaps bound the same number (see ``_can_be``)."""
    if "before" not in sided.columns:
        return F.lit(True)
    near = F.expr(f"9 * (before + before{other}) <= size + size{other} AND 5 * least(size, size{other}) >= 4 * greatest(size, size{other})")
    return near & (_differ("bits", f"bits{other}") * 9 <= F.col("size") + F.col(f"size{other}"))


def _with_codes(pairs: DataFrame, codes: DataFrame, hot: DataFrame, node: str, out: str) -> DataFrame:
    """Adds the words of ``node``. A node of many pairs, listed in ``hot``, is
    copied, so that its pairs are spread over as many tasks."""
    hot = hot.filter(F.col("role") == node).select(F.col("node").alias(node), "copies")
    salted = pairs.join(hot, node, "left").withColumn("copy", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    copied = codes.select(F.col("node").alias(node), F.col("codes").alias(out)).join(hot, node, "left")
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return salted.join(copied, [node, "copy"]).drop("copy")


def _hot(pairs: DataFrame) -> DataFrame:
    """role (a or b), node and copies of nodes of more than HOT pairs."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("node")) for c in "ab"])).alias("x")).select("x.*")
    return ends.groupBy("role", "node").agg(F.ceil(F.count("*") / HOT).alias("copies")).filter("copies > 1")


def _links(pairs: DataFrame, codes: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    of_pairs = {c: likely(codes, "node", pairs.select(c)) for c in "ab"}
    both = _with_codes(_with_codes(pairs, of_pairs["b"], hot, "b", "cb"), of_pairs["a"], hot, "a", "ca").select("a", "b", "ca", "cb")

    def run(batches):
        known: dict[bytes, tuple] = {}
        held = 0

        def of(node: bytes, cell: bytes):
            nonlocal held
            if node not in known:
                codes = np.frombuffer(cell, np.uint32)
                if held + len(codes) > HELD_LABELS:
                    known.clear()
                    held = 0
                known[node] = codes, _labels(codes)
                held += len(codes)
            return known[node]

        for batch in sliced(batches, "cb", 4 << 20):
            keep = []
            for a, b, ca, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb")), strict=True):
                (x, lx), (y, ly) = of(a, ca), of(b, cb)
                keep.append(similarity(x, y, lx, ly) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _rare_keys(nodes: DataFrame, codes: DataFrame, scratch: Scratch) -> DataFrame:
    """``keys(key, node, size, before, bits)``: of its ``size`` labelled shingles a node
    takes the rarest among ``nodes``, a fifth and one more: two nodes that share
    0.8 have one of them in common. ``before`` counts the rarer ones. Shingles
    that nobody else has count but need no bucket.
    """
    codes = likely(codes, "node", nodes)
    # dealt out by node: a crowd's shingles are made by all tasks, not by the few whose files hold it
    wanted = codes.join(nodes, "node", "left_semi").select("node", "codes").repartition("node")
    shared = _given(wanted).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.keep(shared)
    own = W.partitionBy("node")
    ranked = _given(wanted, shared).join(shared, "key").withColumn("common", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("n", "key")))
    ranked = ranked.withColumn("before", F.expr("given - common + rank - 1").cast("int"))
    # a node with a ninth of itself and of the largest partner before the shingle has no link by it
    kept = ranked.filter("before <= floor(size / 5) AND 9 * before <= size + 1.25 * size").select("key", "node", "size", "before")
    return kept.join(codes.select("node", "bits"), "node")


def _given(wanted: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Rows (node, size, given, key) of ``given`` of each node's ``size`` labelled
    shingles: of all, or, where the counts ``shared(key, n)`` are known, without
    frequent ones that come too late in the node's order, by n, to be taken.

    The most frequent shingles, fewer than ``FREQUENT``, are known to every task.
    A node has all others before them, and gives as many of them as its fifth has
    room for: in a crowd of near copies that is its rare end alone.
    """
    often = counts = np.zeros(0, np.int64)
    if shared is not None:
        least = (shared.agg(F.sum("n")).first()[0] or 0) // FREQUENT
        often, counts = np.array(shared.filter(F.col("n") > least).select("key", "n").collect(), np.int64).reshape(-1, 2).T
        often, counts = often[order := np.argsort(often)], counts[order]

    def run(batches):
        for batch in sliced(batches, "codes", 1 << 20):
            lists = [_labels(np.frombuffer(c, np.uint32)).view(np.int64) for c in batch.column("codes").to_pylist()]
            some = [_rare_end(x, often, counts) for x in lists]
            sizes = [pa.array([len(x) for x in y], pa.int32()) for y in (lists, some)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *sizes, pa.array([x.tolist() for x in some], pa.list_(pa.int64()))], names=["node", "size", "given", "labels"])

    labels = wanted.mapInArrow(run, "node binary, size int, given int, labels array<bigint>")
    return labels.select("node", "size", "given", F.explode("labels").alias("key"))


def _rare_end(labels: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``labels`` without those of ``often`` (sorted, with their counts) that are
    beyond the rarest fifth and one more."""
    if not len(often):
        return labels
    at = np.minimum(np.searchsorted(often, labels), len(often) - 1)
    known = often[at] == labels
    rest, n = labels[known], counts[at[known]]
    room = max(0, len(labels) // 5 + 1 - (len(labels) - len(rest)))
    return np.concatenate([labels[~known], rest[np.lexsort((rest, n))[:room]]])


class _Search:
    """Links found so far, the sides they make, and the pairs tried."""

    def __init__(self, codes: DataFrame, scratch: Scratch):
        self.codes, self.scratch = codes, scratch
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []
        self.roots: DataFrame | None = None
        self.linked = 0  # rows of roots

    def sides(self, sided: DataFrame) -> DataFrame:
        """The buckets of ``sided`` that have several sides now; those of one side stay so."""
        return self.scratch.keep(_with_sides(sided.drop("side", "n"), self.roots))

    def try_pairs(self, pairs: DataFrame, near: bool = False) -> bool:
        """Align what was not tried yet, and take the sides together that it
        links; whether there are any. ``near``: pairs of rare shingles' buckets,
        which ``_near_enough`` has held to what ``_can_be`` asks."""
        if self.tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tried), ["a", "b"], "left_anti")
        pairs = self.scratch.keep(pairs)
        if not pairs.count():
            self.scratch.drop(pairs)
            return False
        self.tried.append(pairs)
        able = pairs if near else self.scratch.keep(_can_be(pairs, self.codes))
        hot = self.scratch.keep(_hot(able))
        found = self.scratch.keep(_links(able, self.codes, hot))
        self.scratch.drop(hot, *([] if near else [able]))
        n = found.count()
        if not n:
            return False
        self.links.append(found)
        old = self.roots
        every = found if old is None else old.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found)
        self.roots = components(every, self.scratch, self.linked + n)
        self.linked = self.roots.count()
        if old is not None:
            self.scratch.drop(old)
        return True

    def lead(self, sided: DataFrame, turns: int = LEADERS) -> DataFrame:
        """Step 1 in the buckets ``sided``. Returns those left with several sides."""
        near = "before" in sided.columns
        for turn in range(turns):
            at = sided if turn == 0 else sided.filter(f"n > {SMALL}")
            if at.isEmpty():
                break
            if self.try_pairs(_with_leader(at, turn), near):
                last, sided = sided, self.sides(sided)
                self.scratch.drop(last)
        return sided


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) per row of
    ``docs(doc_id, text)``, and n_words-less texts each alone.

    Rows with the same words, whatever else differs, are one class. A null or
    word-less text is a class of its own: class_id is its doc_id. Null ids take
    part; a class whose ids are all null has a null class_id. Other columns are
    ignored. Repeated rows stay in the result.
    """
    spark = with_package(docs.sparkSession)
    scratch = Scratch(spark)
    drawn = scratch.keep(sketch(docs))
    every = drawn.filter("node IS NOT NULL").select("node", F.array_distinct("keys").alias("keys")).distinct().select(F.explode("keys").alias("key"), "node")
    shared = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = scratch.keep(_with_sides(likely(every, "key", shared), None))
    # one text of each node that shares a bucket; a lone document's text is not moved any further
    wanted = keys.select("node").distinct()
    ids = drawn.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), (F.count("*") != F.count("doc_id")).alias("nulls")).join(wanted, "node")
    ids = ids.select(F.when(F.col("nulls"), None).otherwise(F.col("id")).alias("id")).distinct()
    ids = scratch.keep(ids)
    codes = codes_of(likely(docs.select("doc_id", "text"), "doc_id", ids).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))
    codes = scratch.keep(codes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("codes", "shingles", "bits")]))

    search = _Search(codes, scratch)
    left = search.lead(keys)
    if search.try_pairs(_two_sides(left.filter(f"n <= {SMALL}"))):
        left = search.sides(left)
    large = left.filter(f"n > {SMALL}")
    if not large.isEmpty():
        nodes = scratch.keep(large.select("node").distinct())
        rare = search.lead(scratch.keep(_with_sides(_rare_keys(nodes, codes, scratch), search.roots)), 1)
        for most in (*(times * SMALL for times in WIDER), None):
            if search.try_pairs(_two_sides(rare if most is None else rare.filter(f"n <= {most}")), True) and most is not None:
                rare = search.sides(rare)
    roots = search.roots if search.roots is not None else drawn.select("node", F.col("node").alias("root")).limit(0)
    named = drawn.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class"))
    names = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    out = named.join(names, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("class").isNotNull().alias("has_words"))
    scratch.drop(codes, left, *search.tried, *search.links)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of the smallest doc_id, and of
    equal ids one. Texts without words all stay. All columns are kept."""
    named = classes(docs)
    scratch = Scratch(docs.sparkSession)
    # rows of each id that name a class: of most ids one, whose texts stay where they are
    naming = scratch.keep(named.filter("has_words").groupBy(F.col("doc_id").alias("_id")).agg(F.count_if(F.expr("doc_id <=> class_id")).alias("copies")))
    is_id = F.col("doc_id").eqNullSafe(F.col("_id"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    others = naming.filter("copies <> 1").select("_id")
    stay = likely(docs.filter(has_words), "doc_id", others, "left_anti")
    single = likely(docs.filter(has_words), "doc_id", others).join(others, is_id, "left_anti")
    # several rows with the chosen id: one of each word sequence stays
    repeated = naming.filter("copies > 1").select("_id")
    several = likely(docs.filter(has_words), "doc_id", repeated).join(repeated, is_id, "left_semi")
    several = several.withColumn("_words", F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")).dropDuplicates(["doc_id", "_words"])
    return stay.select(*cols).unionByName(single.select(*cols)).unionByName(several.select(*cols)).unionByName(docs.filter(~has_words).select(*cols))
