"""Helpers shared by the training-data operators: tables in the shared folder,
Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldscope.session import checkpoint_dir, ship_package

# One byte per input byte: A-Z in lower case; 0-9, a-z and every byte of a
# non-ASCII character unchanged; everything else a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

# Slots of 64 bits, the most that a filter of `likely` broadcasts: 16 million bits.
SLOTS = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def with_package(spark: SparkSession) -> SparkSession:
    """Make the package importable on the executors."""
    ship_package(spark)
    return spark


class Scratch:
    """Parquet tables in the shared checkpoint folder.

    ``keep(df)`` computes ``df`` once, cuts its lineage and reads it back, so
    that a lost executor loses nothing. ``drop(df)`` removes such a table once
    nothing reads it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/fieldscope-llm/{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._frames: dict[int, DataFrame] = {}
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)], self._frames[id(out)] = path, out
        return out

    def path(self, df: DataFrame) -> str:
        """The folder of a table that ``keep`` wrote."""
        return self._paths[id(df)]

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            self._frames.pop(id(df), None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that their texts hold about ``most_bytes`` each
    (one row at least), which bounds a Python worker's memory."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.flatnonzero(np.diff(ends)) + 1
        start = 0
        for stop in [*cuts.tolist(), b.num_rows]:
            if stop > start:
                yield b.slice(start, stop - start)
            start = stop


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str | StructType, most_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over batches of bounded text size; ``f`` returns the
    output columns as a dict of lists or arrays, in the order of ``schema``."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema)

    def run(batches):
        for b in sliced(batches, most_bytes=most_bytes):
            got = f(b)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(got.values(), out, strict=True)],
                schema=out,
            )

    return df.mapInArrow(run, schema)


def likely(rows: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` may be among the values of ``keys``, a table of
    that column alone, or (``left_anti``) the others.

    All rows that match are likely, nulls too; so are a few that do not, and an
    exact join follows. That one shuffles little more than the rows it needs, and
    this one none of ``rows``. Each task knows three bits of each key (a Bloom
    filter) in at most ``SLOTS`` slots of 64, however many keys there are; beyond
    some millions of them more rows are likely, and none is lost.
    """

    def bits(h: Column) -> Column:
        at = [F.shiftrightunsigned(h, 18 + 6 * i).bitwiseAND(63).cast("int") for i in range(3)]
        return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in at])

    slot = lambda h: F.pmod(h, F.lit(SLOTS))
    h = F.xxhash64(*keys.columns)
    known = keys.select(slot(h).alias("_slot"), bits(h).alias("_bits")).groupBy("_slot").agg(F.bit_or("_bits").alias("_bits"))
    known = F.broadcast(known)
    h = F.xxhash64(rows[column])
    return rows.join(known, (known["_slot"] == slot(h)) & (known["_bits"].bitwiseAND(bits(h)) == bits(h)), how)
