"""Toxicity by compression distance with zstandard dictionaries.

Training, on a bounded labelled sample and in one task: one dictionary is trained on ordinary
text and one on the distinctive words of toxic text. Scoring: every window of
a document's words is compressed twice, with the ordinary dictionary and with
the same dictionary followed by the toxic one. The window's distance is how
many bytes the toxic dictionary saves. A logistic curve over the distances of
all windows of a document (how many reach each threshold, the largest ones,
the mean) is calibrated on sample rows that the dictionaries did not see.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_package, words_of
from .sampling import fold, learned

WINDOW, STRIDE = 24, 12  # bytes
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
LEVEL = 3
ROWS_PER_CLASS = (6_000, 3_000)  # ordinary, toxic: the bound of the sample
LONGEST = 65_536  # bytes of a sampled text; with ROWS_PER_CLASS the only bound of what the dictionaries learn from
DISTINCT_Z = 5.0  # a word is distinctive beyond so many standard errors
THRESHOLDS = np.arange(2, 13)


def _family(words: list[bytes]) -> int:
    """Smallest hash of five consecutive words: equal for most near copies."""
    return min((xxhash.xxh64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))), default=0)


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a trained dictionary; few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size + 600, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: means, scales, weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + l2 * len(y) * np.eye(len(w)), z.T @ (p - y) + l2 * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def compressors(self):
        def one(content: bytes):
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_checksum=0, write_content_size=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress

        return one(self.ordinary), one(self.ordinary + self.toxic)

    def distances(self, words: list[bytes], compressors) -> np.ndarray:
        plain, toxic = compressors
        b = b" " + b" ".join(words) + b" "
        cut = [b[i : i + WINDOW] for i in range(0, max(1, len(b) - WINDOW + STRIDE), STRIDE)]
        return np.array([len(plain(w)) - len(toxic(w)) for w in cut])

    def features(self, words: list[bytes], compressors) -> np.ndarray:
        x = self.distances(words, compressors)
        reach = (x[:, None] >= THRESHOLDS).sum(0)
        top = np.sort(x)[::-1]
        return np.concatenate([np.log1p(reach), np.log1p(1000 * reach / len(x)), [np.log(len(x)), top[0], top[:3].mean(), x.mean()]])

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[(features - self.mean) / self.scale, np.ones(len(features))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[int, str | None]]) -> Model | None:
    """Model from (label, text) rows; None if a class is missing. Texts are
    held as joined words and split when they are looked at: a list of words
    takes many times the memory of its text."""
    seen, parts = set(), {(y, part): [] for y in (0, 1) for part in (0, 1)}
    for y, text in rows:
        words = words_of(text)
        if (key := _family(words)) not in seen:  # near copies would pass for distinctive text
            seen.add(key)
            parts[y, key >> 7 & 1].append(b" ".join(words))
    if not all(parts.values()):  # too few rows for a part of their own
        whole = {y: parts[y, 0] + parts[y, 1] for y in (0, 1)}
        parts = {(y, part): whole[y] for y in (0, 1) for part in (0, 1)}
    ordinary, toxic = parts[0, 0], parts[1, 0]
    if not ordinary or not toxic:
        return None
    in_toxic, in_ordinary = Counter(), Counter()
    for w in toxic:
        in_toxic.update(set(w.split()))
    for w in ordinary:
        in_ordinary.update(set(w.split()))

    def z(w: bytes) -> float:
        expected = len(toxic) * (in_ordinary[w] + 1) / (len(ordinary) + 1)
        return (in_toxic[w] - expected) / (expected + 1) ** 0.5

    distinct = {w for w, n in in_toxic.items() if n >= 3 and z(w) > DISTINCT_Z} or {w for w, _ in sorted(in_toxic.items(), key=lambda x: (-z(x[0]), x[0]))[:20]}
    toxic_samples = [s for s in (b" " + b" ".join(x for x in w.split() if x in distinct) + b" " for w in toxic) if len(s) > 8] or [b" " + b" ".join(sorted(distinct)) + b" "]
    ordinary_samples = [b" ".join(w[i : i + 40]) for w in map(bytes.split, ordinary) for i in range(0, len(w), 40)]
    m = Model(_dictionary(ordinary_samples, ORDINARY_BYTES, 48, 8), _dictionary(toxic_samples, TOXIC_BYTES, 24, 6))
    c = m.compressors()
    texts = parts[0, 1] + parts[1, 1]
    x = np.array([m.features(w.split(), c) for w in texts])
    y = np.repeat([0.0, 1.0], [len(parts[0, 1]), len(parts[1, 1])])
    m.mean, m.scale, m.weights = logistic(x, y)
    return m


def score(docs: DataFrame, labels: DataFrame, rows_per_class: tuple[int, int] = ROWS_PER_CLASS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs(doc_id, text)``,
    and the columns named in ``keep``.

    Learns from ``labels(doc_id, toxic)`` outside the fold crc32(id) mod 5 = 0,
    from a sample of at most ``rows_per_class`` rows. Null and empty texts are
    scored as one empty window. A null id is in fold crc32('') = 0. Without
    rows of either class every score is 0. Repeated rows score alike.
    """
    spark = with_package(docs.sparkSession)
    model = spark.sparkContext.broadcast(learned(train, docs, labels, "toxic", 5, 0, rows_per_class, LONGEST))

    def step(b: pa.RecordBatch) -> dict:
        m = model.value
        if m is None:
            p = np.zeros(b.num_rows)
        else:
            c = m.compressors()
            p = m.score(np.array([m.features(words_of(t), c) for t in b.column("text").to_pylist()]))
        return {"doc": b.column("doc"), "score": p} | ({"text": b.column("text")} if "text" in keep else {})

    carried = [c for c in ("doc_id", *keep) if c != "text"]
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(carried)]).alias("doc"), "text")
    schema = body.select("doc").schema.add("score", "double")
    if "text" in keep:
        schema = schema.add("text", "string")
    out = map_batches(body, step, schema)
    return out.select(F.col("doc.doc_id").alias("doc_id"), (fold(F.col("doc.doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      *[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in keep if c != "doc_id"])


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns kept."""
    with_all = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")
    scored = score(with_all, labels, keep=("row", "text")).filter("predicted = 0")
    return scored.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
