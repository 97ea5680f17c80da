"""Exact removal of repeated byte strings with a Burrows-Wheeler transform.

Two equal 100-byte windows choose the same anchor: the 40-byte string of
smallest hash inside them. Documents are cut into contexts, the maximal runs of
windows with one anchor; contexts of an anchor that occurs once are done with.
The others meet by anchor, in blocks of bounded text. A block's suffixes are
sorted, and its transform is extended backwards breadth-first: the rows whose
common prefix has length 0, 1, 2 ... are separated level by level, and what is
still together at the minimum length are the equal windows. All of a class but
the earliest are removed.

Contexts that are equal throughout are settled before that, first in the task
that cuts them, then in the block. Anchors of very many different contexts (the
edge of a passage that countless documents share) meet by window instead, so
that no block grows with them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, with_package

LENGTH = 100
ANCHOR = 40
BLOCK_BYTES = 4 << 20
MANY = 20_000  # contexts of one anchor beyond which they meet by window

_U = np.uint64
_BYTE = np.random.default_rng(2).integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def contexts(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """Anchor hash, context hash, document number, first window and number of
    windows of all contexts of documents laid end to end."""
    n, w = len(data), length - k + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if n < length:
        return (np.empty(0, np.int64),) * 5
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * _powers(_BASE, n))])
    back = _powers(_BACK, n)
    grams = _mix((sums[k:] - sums[:-k]) * back[: n - k + 1])
    # 40 bits of the hash, then the place: the leftmost of the smallest
    low = (grams & ~_U(0xFFFFFF)) | np.arange(len(grams), dtype=_U) % _U(1 << 24)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (w - span)], low[w - span :]) if w > span else low
    doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    first_of = np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1)
    at = np.arange(len(doc)) - first_of[doc] + starts[doc]
    mine = low[at]
    cut = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.empty(0, np.int64)
    many = np.diff(np.append(cut, len(at)))
    place = (mine[cut] & _U(0xFFFFFF)).astype(np.int64)
    place += (at[cut] - place + (1 << 23)) >> 24 << 24  # places are kept modulo 2^24
    first = at[cut]
    whole = _mix((sums[first + many - 1 + length] - sums[first]) * back[first] + (place - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F) + many.astype(_U))
    return grams[place].view(np.int64), whole.view(np.int64), doc[cut], first - starts[doc[cut]], many


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix array of ``s`` by its first ``depth`` symbols, prefix doubling
    from packs of seven symbols; only suffixes that share their group are sorted
    again. Also which rows differ from the row above within a smaller number of
    symbols, the last that the doubling passed, and that number."""
    n, done = len(s), 7 if depth > 7 else 1
    padded = np.concatenate([s.astype(np.int64), np.zeros(8, np.int64)])
    code = np.zeros(n, np.int64)
    for j in range(done):
        code = code << 9 | padded[j : j + n]
    order = np.argsort(code)
    code = code[order]
    rank = np.zeros(n + depth + 7, np.int64)  # of a suffix: one more than the first row of its group; 0 beyond the end
    rows = np.arange(n)  # of suffixes that share their group
    new = np.zeros(n, bool)
    while True:
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        new[rows] = fresh
        left = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if done >= depth or not len(left):
            return order, new, done
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))] + 1
        rows = rows[left]
        at = order[rows]
        code = rank[at] * (n + 2) + rank[at + done]
        resort = np.argsort(code)
        order[rows], code = at[resort], code[resort]
        if done * 2 > depth:
            return order, new, done
        done *= 2


def equal_windows(s: np.ndarray, length: int) -> np.ndarray:
    """Class number of every position of ``s`` whose ``length`` symbols from
    there occur elsewhere too, else -1.

    ``s`` holds symbols >= 1 and separators 0. The rows of the transform are
    split breadth-first: row r and the row above it differ at level l + 1 if
    they start with different symbols, or if the rows they come from by one
    step to the right differ at level l. The first level is the deepest that
    sorting the rows has told. Rows alone in their class drop out.
    """
    n = len(s)
    order, new, start = suffix_order(s, length)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    # the transform is s[order - 1]
    right = row_of[np.minimum(order + 1, n - 1)]  # the row one step to the right: where this row's backward extension started
    ends = np.flatnonzero(np.append(s, 0) == 0)
    new |= ends[np.searchsorted(ends, order)] - order < start  # a separator ends every match
    rows = np.arange(n)  # rows still looked at: those that are not alone
    group = np.empty(n + 1, np.int32)
    live = np.flatnonzero(~new)  # rows that are still one with the row above, and where both come from
    here, above = right[live], right[live - 1]
    for level in range(start, length):
        if not len(live):
            break
        if (level - start) % 8 == 0:
            kept = np.flatnonzero(~(new & np.append(new[1:], True)))
            place = np.full(len(new) + 1, len(kept))
            place[kept] = np.arange(len(kept))
            rows, new = rows[kept], new[kept]
            live, here, above = place[live], place[here], place[above]
        np.cumsum(new, dtype=np.int32, out=group[: len(new)])
        group[len(new)] = -1  # of rows no longer looked at
        # extended rows stay together only if their rests are in one interval of the level before
        g = group[here]
        apart = (g != group[above]) | (g < 0)
        if apart.any():
            new[live[apart]] = True
            live, here, above = live[~apart], here[~apart], above[~apart]
    whole = np.ones(n, bool)
    whole[rows] = new
    new = whole
    group = np.cumsum(new)
    size = np.bincount(group)
    out = np.full(n, -1, np.int64)
    out[order] = np.where(size[group] > 1, group, -1)
    return out


def repeated(order: np.ndarray, texts: list[bytes], routes: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For contexts with their rank in corpus order: which of their windows
    start earlier in another of them (or in themselves)."""
    dup = [np.zeros(len(t) - length + 1, bool) for t in texts]
    seen: dict[bytes, int] = {}
    distinct = []
    for i in np.argsort(order, kind="stable").tolist():
        if texts[i] in seen:
            dup[i][:] = True
        else:
            seen[texts[i]] = i
            distinct.append(i)
    # equal windows have equal anchors: an anchor with one context has no more
    many = Counter(routes[i] for i in distinct)
    distinct = [i for i in distinct if many[routes[i]] > 1]
    if not distinct:
        return dup
    s = np.frombuffer(b"\0".join([texts[i] for i in distinct] + [b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(texts[i]) + 1 for i in distinct])
    s[ends - 1] = 0
    label = equal_windows(s, length)
    hit = np.flatnonzero(label >= 0)
    first = np.empty(label.max() + 1, np.int64)  # in corpus order: contexts lie earliest first
    first[label[hit][::-1]] = hit[::-1]
    again = np.zeros(len(s), bool)
    again[hit] = first[label[hit]] != hit
    for i, end in zip(distinct, ends.tolist(), strict=True):
        start = end - 1 - len(texts[i])
        dup[i] = again[start : start + len(dup[i])]
    return dup


def _runs(d: np.ndarray, ties: np.ndarray, f: np.ndarray, dup: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Runs of repeated windows of all contexts, as spans of their documents."""
    gap = np.zeros(1, bool)  # before each context, and at the end
    edge = np.diff(np.concatenate([y for x in dup for y in (gap, x)] + [gap]).astype(np.int8))
    first = np.cumsum([1] + [len(x) + 1 for x in dup])
    s, e = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    of = np.searchsorted(first, s, side="right") - 1
    return [d[of], ties[of], f[of] + s - first[of], f[of] + e - first[of] - 1 + length]


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of
    ``docs(doc_id, text)``, and on demand ``kept`` (the remaining bytes).

    Documents are ordered by doc_id, a null id first; rows of one id by a hash
    of their text. Equal rows are one document: what they hold is not a repeat
    of itself, and each gets that document's result. Null texts are empty;
    texts shorter than ``length`` lose nothing. Other columns are ignored.
    """
    spark = with_package(docs.sparkSession)
    scratch = Scratch(spark)
    id_field = docs.select("doc_id").schema[0]
    low = F.lit(-(2**63)).cast("long")
    rows, ids = docs.agg(F.count("*"), F.countDistinct(F.coalesce(F.col("doc_id").cast("long"), low))).first()
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64(text) if ids < rows else F.lit(0).cast("long")
    body = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), low).alias("d"), tie.alias("tie"), text.alias("text"))
    once = body.dropDuplicates(["d", "tie"]) if ids < rows else body

    def cut(b: pa.RecordBatch) -> dict:
        raw = b.column("text").cast(pa.binary()).to_pylist()
        sizes = np.array([len(x) for x in raw], np.int64)
        anchor, whole, doc, first, many = contexts(np.frombuffer(b"".join(raw), np.uint8), sizes, length)
        return {"a": anchor, "c": whole, "d": b.column("d").to_numpy()[doc], "tie": b.column("tie").to_numpy()[doc], "f": first, "n": many}

    found = map_batches(once.select("d", "tie", "text"), cut, "a long, c long, d long, tie long, f int, n int", most_bytes=2 << 20)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = found.repartition(parts, "a")  # one shuffle for the count and the join
    place = F.struct("d", "tie") if ids < rows else F.col("d")  # in the order of documents
    # both read every column of it: of two selections of columns each would be cut and shuffled on its own
    unused = [F.max(c).alias(f"max_{c}") for c in ("tie", "f", "n")]
    again = dealt.groupBy("a").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(place).alias("p0"), *unused)
    again = again.filter("m > 1 AND max_tie IS NOT NULL AND max_f >= 0 AND max_n > 0")
    # where all contexts of an anchor are equal (by 64 bits each of anchor and context), all but the first are repeats
    marks = dealt.join(again, "a").select("d", "tie", F.struct("a", "f", "n", "m", ((F.col("c0") == F.col("c1")) & (F.col("c") == F.col("c0"))).alias("alike"), (place > F.col("p0")).alias("later")).alias("mark"))
    per_doc = scratch.keep(marks.groupBy("d", "tie").agg(F.collect_list("mark").alias("marks")))
    alike = per_doc.select("d", "tie", F.explode(F.filter("marks", lambda m: m["alike"] & m["later"])).alias("x")).select("d", "tie", F.col("x.f").alias("s"), (F.col("x.f") + F.col("x.n") - 1 + length).alias("e"))
    # the others' text is wanted; equal contexts in the first document itself are settled along with them
    per_doc = per_doc.select("d", "tie", F.filter("marks", lambda m: ~(m["alike"] & m["later"])).alias("marks")).filter(F.exists("marks", lambda m: ~m["alike"]) | (F.size(F.array_distinct(F.transform("marks", lambda m: m["a"]))) < F.size("marks")))

    def slices(b: pa.RecordBatch) -> dict:
        marks, raw = b.column("marks"), b.column("text").cast(pa.binary()).to_pylist()
        doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(marks).to_numpy())
        a, f, n, m, alike = (marks.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("a", "f", "n", "m", "alike"))
        by_anchor = np.lexsort((a, doc))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(a[by_anchor]) != 0) | (np.diff(doc[by_anchor]) != 0)])) if len(a) else np.empty(0, np.int64)
        repeats_here = np.empty(len(a), bool)
        repeats_here[by_anchor] = np.repeat(np.diff(np.append(starts, len(a))) > 1, np.diff(np.append(starts, len(a))))
        d, tie = b.column("d").to_numpy(), b.column("tie").to_numpy()
        order = np.lexsort((f, tie[doc], d[doc]))
        order = order[~alike[order] | repeats_here[order]]
        by_window = m[order] > MANY
        times = np.where(by_window, n[order], 1)  # one piece, or one for each window
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        of, by_window = np.repeat(order, times), np.repeat(by_window, times)
        doc, a, f, n = doc[of], a[of], f[of] + step, np.where(by_window, 1, n[of])
        ctx = [raw[i][x:y] for i, x, y in zip(doc.tolist(), f.tolist(), (f + n - 1 + length).tolist(), strict=True)]
        seen: set = set()
        known = np.zeros(len(ctx), bool)  # an earlier one in this very task
        for i, key in enumerate(zip(a.tolist(), ctx, strict=True)):
            if key in seen:
                known[i] = True
            else:
                seen.add(key)
        route = a.copy()
        for i in np.flatnonzero(by_window).tolist():
            route[i] = int.from_bytes(hashlib.blake2b(ctx[i], digest_size=8).digest(), "little", signed=True)
        return {"route": route, "d": d[doc], "tie": tie[doc], "f": f, "settled": np.where(known, n, 0), "ctx": pa.array(ctx, pa.binary(), mask=known)}

    joined = once.select("d", "tie", "text").join(per_doc, ["d", "tie"])
    pieces = scratch.keep(map_batches(joined, slices, "route long, d long, tie long, f int, settled int, ctx binary", most_bytes=4 << 20))
    total = pieces.agg(F.sum(F.octet_length("ctx") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    bound = pa.schema([("d", pa.int64()), ("tie", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def settle(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d, ties, f = (t.column(c).to_numpy() for c in ("d", "tie", "f"))
        rank = np.empty(len(d), np.int64)
        rank[np.lexsort((f, ties, d))] = np.arange(len(d))
        dup = repeated(rank, t.column("ctx").to_pylist(), t.column("route").to_pylist(), length)
        return pa.Table.from_arrays([pa.array(x, y.type) for x, y in zip(_runs(d, ties, f, dup, length), bound, strict=True)], schema=bound)

    open_pieces = pieces.filter("ctx IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("route"), F.lit(blocks)))
    spans = open_pieces.groupBy("block").applyInArrow(settle, "d long, tie long, s int, e int")
    sure = pieces.filter("ctx IS NULL").select("d", "tie", F.col("f").alias("s"), (F.col("f") + F.col("settled") - 1 + length).alias("e"))
    removed = spans.unionByName(sure).unionByName(alike).groupBy("d", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def digest(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for raw, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
            runs = _merged((x["s"], x["e"]) for x in spans or ())
            kept, at = [], 0
            for s, e in runs:
                kept.append(raw[at:s])
                at = e
            left = b"".join([*kept, raw[at:]])
            for c, v in zip(out, (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left), strict=True):
                out[c].append(v)
        if not with_text:
            del out["kept"]
        return {"doc_id": b.column("doc_id")} | out

    final = body.join(removed, ["d", "tie"], "left").select("doc_id", "text", "spans")
    schema = docs.select(id_field.name).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return map_batches(final, digest, schema.add("kept", "binary") if with_text else schema)
