"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document is a sparse vector x. Its score is the logistic of
w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, and the pairwise part is
computed in linear time as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
Trained on a bounded labelled sample; every document is scored in one narrow
pass over the table.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_package, words_of
from .sampling import fold, labelled_sample

WORD_BUCKETS = 1 << 14
BINS = 12  # of each structure statistic
FACTORS = 8
ROWS_PER_CLASS = (4_000, 6_000)  # the bound of the sample
LONGEST = 65_536
EPOCHS, BATCH, RATE, L2 = 12, 128, 0.02, 2e-5

_ASCII_UPPER, _ASCII_LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_DIGITS, _WHITE, _PUNCTUATION = string.digits.encode(), string.whitespace.encode(), string.punctuation.encode()
_NON_ASCII = bytes(range(128, 256))
STATISTICS = ("log length", "log words", "word length", "distinct words", "most frequent word", "repeated neighbours", "upper", "digits",
              "white space", "punctuation", "stops", "non-ASCII", "words a line", "short lines", "distinct lines", "distinct threes", "log n_chars")


def statistics(text: str, words: list[bytes], n_chars: int | None) -> list[float]:
    """Structure statistics, each about 0 to 1, in the order of STATISTICS."""
    b = text.encode("utf-8", "surrogatepass")
    n, k = max(1, len(b)), max(1, len(words))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    most = counts.most_common(1)[0][1] if words else 0
    threes = max(1, len(words) - 2)
    return [
        math.log1p(len(b)) / 14, math.log1p(len(words)) / 12, min(1, sum(map(len, words)) / k / 20), len(counts) / k, most / k,
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / k, share(_ASCII_UPPER), share(_DIGITS), share(_WHITE), share(_PUNCTUATION),
        min(1, 10 * share(b".,")), share(_NON_ASCII), min(1, k / len(lines) / 50),
        sum(len(x) < 25 for x in lines) / len(lines), len(set(lines)) / len(lines), len(set(zip(words, words[1:], words[2:], strict=False))) / threes,
        math.log1p(max(0, n_chars or 0)) / 14,
    ]


def vector(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values. Words are weighted by the root of their share; each
    statistic lights the two bins around its value."""
    text = text or ""
    words = words_of(text)
    at, x = [], []
    if words:
        counts = Counter(zlib.crc32(w) % WORD_BUCKETS for w in words)
        at += counts.keys()
        x += (np.sqrt(np.fromiter(counts.values(), float)) / math.sqrt(len(words))).tolist()
    for j, s in enumerate(statistics(text, words, n_chars)):
        place = min(max(s, 0.0), 1.0) * (BINS - 1)
        low = min(int(place), BINS - 2)
        first = WORD_BUCKETS + j * BINS + low
        at += [first, first + 1]
        x += [1 - (place - low), place - low]
    return np.array(at, np.int64), np.array(x)


SIZE = WORD_BUCKETS + BINS * len(STATISTICS)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of several vectors laid end to end, and sum_i v_if x_i."""
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + pairs, s

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        at, x, starts = laid(vectors)
        return 1 / (1 + np.exp(-np.clip(self.raw(at, x, starts)[0], -30, 30)))


def laid(vectors):
    sizes = np.array([len(a) for a, _ in vectors])
    return np.concatenate([a for a, _ in vectors]), np.concatenate([x for _, x in vectors]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def train(vectors: list, y: np.ndarray, seed: int = 7) -> Machine | None:
    """Adagrad on the logistic loss, in batches; None if a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * 5 / (1 + 0.3 * epoch)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            at, x, starts = laid([vectors[i] for i in rows])
            raw, s = m.raw(at, x, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(error, np.diff(np.append(starts, len(at))))
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(at))))
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, each * x, len(used)) + L2 * m.w[used]
            dv = np.empty((len(used), FACTORS))
            for f in range(FACTORS):
                dv[:, f] = np.bincount(place, each * x * (s[of, f] - m.v[at, f] * x), len(used))
            dv += L2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            m.w0 -= rate * error.sum() / math.sqrt(g0)
    return m


def score(docs: DataFrame, labels: DataFrame, rows_per_class: tuple[int, int] = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs(doc_id, text)``.

    ``n_chars`` is used as metadata where the column exists (its null reads as
    0); language, source, id and labels are no inputs. Learns from
    ``labels(doc_id, quality)`` outside the fold crc32(id) mod 4 = 2, from at
    most ``rows_per_class`` rows. Null and empty texts have no words but all
    statistics. Without rows of either class every score is the only class
    seen, or 1 without labels. Repeated rows score alike.
    """
    spark = with_package(docs.sparkSession)
    meta = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    body = docs.select("doc_id", "text", meta.alias("n_chars"))
    rows = labelled_sample(body, labels, "quality", 4, 2, rows_per_class, LONGEST, ("text", "n_chars"))
    y = np.array([r["y"] for r in rows], float)
    machine = spark.sparkContext.broadcast(train([vector(r["text"], r["n_chars"]) for r in rows], y) if rows else None)
    only = float(y[0]) if len(rows) else 1.0

    def step(b: pa.RecordBatch) -> dict:
        m = machine.value
        vectors = [vector(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
        return {"doc_id": b.column("doc_id"), "score": np.full(len(vectors), only) if m is None else m.score(vectors)}

    out = map_batches(body, step, docs.select("doc_id").schema.add("score", "double"), most_bytes=2 << 20)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
