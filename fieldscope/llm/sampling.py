"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id reads as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows_per_class: tuple[int, int],
            longest: int, columns: tuple[str, ...]) -> DataFrame:
    """Labelled rows outside the held-out fold: y and ``columns``.

    At most ``rows_per_class[y]`` ids of each class, the smallest by a hash of
    the id, and texts of at most ``longest`` bytes: bounded by these parameters,
    it does not grow with the corpus. A doc_id labelled twice counts once with
    its larger label, and one with several rows brings the smallest of them.
    """
    ids = labels.filter(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    bounded = [ids.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(n) for y, n in enumerate(rows_per_class)]
    chosen = F.broadcast(bounded[0].unionByName(bounded[1]))
    rows = docs.filter(F.octet_length("text") <= longest).join(chosen, "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(*columns)).alias("row"))
    return one.select("y", *[F.col(f"row.{c}") for c in columns])


def _in_order(rows) -> list:
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows_per_class: tuple[int, int],
                    longest: int, columns: tuple[str, ...] = ("text",)) -> list:
    """The bounded sample (see ``_sample``) as Row(y, *columns), on the driver."""
    return _in_order(_sample(docs, labels, label, folds, held_out, rows_per_class, longest, columns).collect())


def learned(fit: Callable[[list[tuple]], object], docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
            rows_per_class: tuple[int, int], longest: int, columns: tuple[str, ...] = ("text",)):
    """What ``fit`` makes of the rows of ``labelled_sample``, in an executor's
    task: no text reaches the driver, only the pickled result does."""

    def run(batches):
        rows = _in_order(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    rows = _sample(docs, labels, label, folds, held_out, rows_per_class, longest, columns)
    made = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return fit([]) if made is None else pickle.loads(bytes(made["model"]))
