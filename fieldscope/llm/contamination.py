"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns the documents it reads into shards of bounded size, builds a
suffix array over a shard's words and binary-searches every suffix of the
benchmark texts in it. A window of 13 consecutive benchmark words (a whole
shorter item) that a suffix finds marks document words as hit; matches are
extended word by word to the longest verbatim match.

A document never leaves its task, so nothing is shuffled. The benchmark is
taken in blocks of bounded size that are broadcast one after the other.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, with_package, words_of

WINDOW = 13
BLOCK_BYTES = 8 << 20


class Items:
    """A block of benchmark items: word ids, and one search entry per window."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        lists = [words_of(t) for _, t in rows]
        self.names = [n for n, _ in rows]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
        ids = [[self.vocab[w] for w in ws] for ws in lists]
        self.words = np.fromiter(chain.from_iterable(x + [0] for x in ids), np.int32)
        starts = np.cumsum([0] + [len(x) + 1 for x in ids])
        at, size, item = [], [], []
        for k, x in enumerate(ids):
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                at.append(starts[k] + i), size.append(n), item.append(k)
        self.at, self.size, self.item = (np.array(v, np.int64) for v in (at, size, item))
        self.head = min(3, int(self.size.min())) if len(at) else 0
        # every prefix of `head` words that a window starts with
        self.heads = np.unique(self._code(self.words, self.at)) if len(at) else np.empty(0, np.uint64)

    def _code(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        code = np.zeros(len(at), np.uint64)
        for k in range(self.head):
            code = code * np.uint64(len(self.vocab) + 1) + words[at + k].astype(np.uint64)
        return code


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of the first ``depth`` words from there
    on, by prefix doubling (``words`` is padded with ``depth`` zeros)."""
    rank = words.astype(np.int64)
    done = 1
    while done < depth:
        # ranks of twice the length, of every position that starts one of the wanted suffixes
        code = rank[:-done] * (int(rank.max()) + 1) + rank[done:]
        _, inverse = np.unique(code, return_inverse=True)
        rank = np.concatenate([inverse + 1, np.zeros(done, np.int64)])
        done *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(items: Items, words: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of ``sa`` whose suffixes start with each window: one binary search
    per benchmark suffix and word, all suffixes at once."""
    lo, hi = np.zeros(len(items.at), np.int64), np.full(len(items.at), len(sa), np.int64)
    for k in range(int(items.size.max())):
        live = (items.size > k) & (lo < hi)
        want = items.words[items.at + np.minimum(k, items.size - 1)]
        for upper in (False, True):
            a, b = lo.copy(), np.where(live, hi, lo)
            while (more := a < b).any():
                mid = (a + b) >> 1
                got = words[sa[np.minimum(mid, len(sa) - 1)] + k]
                right = more & ((got <= want) if upper else (got < want))
                a, b = np.where(right, mid + 1, a), np.where(more & ~right, mid, b)
            if upper:
                hi = np.where(live, a, hi)
            else:
                first = a
        lo = np.where(live, first, lo)
    return lo, hi


def match_shard(items: Items, texts: list[str | None]) -> list[tuple]:
    """Per document: word count, merged hit runs (start, end), item numbers,
    and the longest match (words, document start, item, item start)."""
    lists = [words_of(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    if not len(items.at) or not counts.sum():
        return [(int(n), [], [], (0, None, None, None)) for n in counts]
    get, pad = items.vocab.get, int(items.size.max()) + 1
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    words = np.zeros(starts[-1] + pad, np.int32)  # 0: a word that no item has, and the end of a document
    for x, s in zip(lists, starts, strict=False):
        if x:
            words[s : s + len(x)] = [get(w, 0) for w in x]
    del lists
    n = len(words) - pad
    live = np.flatnonzero(words[:n])
    live = live[np.isin(items._code(words, live), items.heads)] if items.head else live
    blank = [(int(c), [], [], (0, None, None, None)) for c in counts]
    if not len(live):
        return blank
    # the suffixes that can match, and as many words behind them as a window has
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, live, 1), np.add.at(near, np.minimum(live + pad, len(words)), -1)
    kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    gap = np.concatenate([[False], np.diff(kept) > 1])
    place = np.arange(len(kept)) + np.cumsum(gap)
    short = np.zeros(int(place[-1]) + 1 + pad, np.int32)
    short[place] = words[kept]
    of_short = np.zeros(len(short), np.int64)
    of_short[place] = kept
    sa = suffix_array(short, place[np.searchsorted(kept, live)], pad - 1)
    lo, hi = search(items, short, sa)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return blank
    many = hi[found] - lo[found]
    entry = np.repeat(found, many)
    row = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
    at, size = of_short[sa[row]], items.size[entry]
    doc = np.searchsorted(starts, at, "right") - 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1), np.add.at(edge, at + size, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turn = np.diff(covered)
    run_start, run_end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    run_doc = np.searchsorted(starts, run_start, "right") - 1
    # longest match: a chain of windows on the same diagonal (item place - document place)
    order = np.lexsort((at, at - items.at[entry], doc))
    a, e, d, g = at[order], entry[order], doc[order], (at - items.at[entry])[order]
    first = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(d) != 0) | (np.diff(g) != 0) | (np.diff(items.item[e]) != 0)])
    heads = np.flatnonzero(first)
    length = np.diff(np.append(heads, len(a))) - 1 + items.size[e[heads]]
    best: dict[int, tuple] = {}
    item_start = np.searchsorted(items.item, np.arange(len(items.names)))
    for h, ln in zip(heads.tolist(), length.tolist(), strict=True):
        k = int(items.item[e[h]])
        new = (-ln, int(a[h] - starts[d[h]]), k, int(items.at[e[h]] - items.at[item_start[k]]))
        best[int(d[h])] = min(best.get(int(d[h]), new), new)
    pairs = np.unique(np.stack([doc, items.item[entry]]), axis=1)
    out = list(blank)
    for k in np.unique(doc).tolist():
        runs = [(int(s - starts[k]), int(t - starts[k])) for s, t in zip(run_start[run_doc == k], run_end[run_doc == k], strict=True)]
        b = best[k]
        out[k] = (int(counts[k]), runs, pairs[1][pairs[0] == k].tolist(), (-b[0], b[1], items.names[b[2]], b[3]))
    return out


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = "n_words long, runs array<struct<s: long, e: long>>, items array<string>, longest struct<n: long, at: long, item: string, item_at: long>"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = 8 << 20, keep_text: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` against ``benchmark(item_id, text)``.

    Returns one row per input row: ``doc_id``, ``text`` if ``keep_text``, ``n_words``, ``runs``
    (merged hit word ranges), ``items`` (ids, as strings, with an occurring
    window; repeated items once), ``longest`` (words, word offset in the
    document, item, word offset in the item; ties to the earliest).

    Null and word-less documents have no matches; items that are null or
    without words have no window; a null item id reads as ''. An empty
    benchmark gives no matches. Other columns are ignored.
    """
    spark = with_package(docs.sparkSession)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("t")).distinct()
    total = bench.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() AS array<struct<s: long, e: long>>)").alias("runs"),
                      F.expr("cast(array() AS array<string>)").alias("items"), F.expr("named_struct('n', 0L, 'at', cast(null AS long), 'item', cast(null AS string), 'item_at', cast(null AS long))").alias("longest"))
    given = [docs.schema["doc_id"], T.StructField("text", T.StringType())]
    for k in range(blocks):
        # one block of the stated benchmark, of about block_bytes
        rows = bench.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).orderBy("item", "t").collect()
        block = spark.sparkContext.broadcast(Items([tuple(r) for r in rows], window))

        with_text = keep_text or k < blocks - 1

        def step(b: pa.RecordBatch, block=block, with_text=with_text) -> dict:
            items = block.value
            got = match_shard(items, b.column("text").to_pylist())
            runs, names, longest = [], [], []
            for (_, new, ids, lm), r, i, was in zip(got, b.column("runs").to_pylist(), b.column("items").to_pylist(), b.column("longest").to_pylist(), strict=True):
                runs.append([{"s": s, "e": e} for s, e in merge_runs(new + [(x["s"], x["e"]) for x in r])])
                names.append(sorted({*i, *(items.names[x] for x in ids)}))
                longest.append(was if was["n"] >= lm[0] else dict(zip(("n", "at", "item", "item_at"), lm, strict=True)))
            carried = {"doc_id": b.column("doc_id")} | ({"text": b.column("text")} if with_text else {})
            return carried | {"n_words": [g[0] for g in got], "runs": runs, "items": names, "longest": longest}

        out = map_batches(out, step, T.StructType(given[: 1 + with_text] + T.StructType.fromDDL(FOUND).fields), most_bytes=shard_bytes)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's digest per document, and the longest match."""
    m = find_matches(docs, benchmark, **options)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    m = m.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                 F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "longest")
    return m.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    F.col("longest.n").alias("longest_words"), F.col("longest.at").alias("longest_at"),
                    F.col("longest.item").alias("longest_item"), F.col("longest.item_at").alias("longest_item_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept; one narrow
    pass (rows need no key, so repeated and null ids are safe)."""
    others = [c for c in docs.columns if c != "text"]
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc_id"), "text")
    m = find_matches(body, benchmark, window, block_bytes, keep_text=True)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    kept = m.filter(~((n_hit > 0) & (20 * n_hit >= F.col("n_words"))))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns])
