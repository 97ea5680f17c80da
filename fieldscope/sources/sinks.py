"""Sinks: every result is a table.

Writes go to a new location (never over the source documents) and are
idempotent per run (``mode('overwrite')``, optionally per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_cleaned(cleaned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Cleaned documents as ``(doc_id, content)`` Parquet, one row per
    document; only documents where something was removed."""
    write_table(cleaned.where(F.col("removed") > 0).select(key, F.col("cleaned").alias("content")), path)


def write_report(lines: DataFrame, path: str) -> None:
    """Ordered report lines as text. ``orderBy`` range-partitions
    the lines, so the part files concatenated in name order are the report.
    Lines of one place (section, name, seq) are in the order of their text."""
    lines.orderBy("section", "name", "seq", "line").select("line").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report as ``(line_no, line)``, numbered from 1 over its files.

    A file is read in blocks by several tasks, line by line. A task's row
    numbers rise over its blocks, so a line's number is the lines before its
    block and its place in it: only one row per block is gathered."""
    each = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"))
    blocks = each.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    at = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    each = each.join(F.broadcast(at), ["file", "block"])
    return each.select((F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("bigint").alias("line_no"), "line")


def write_log(rows: DataFrame, path: str, at: Column | None = None) -> None:
    """The error log as JSON rows, one folder per level; ``at`` is the
    time to stamp them with (now by default)."""
    rows.withColumn("logged_at", at if at is not None else F.current_timestamp()).write.mode("overwrite").partitionBy("level").json(path)


def export_results(paths: DataFrame, catalog: DataFrame, stats: DataFrame, path: str, key: str = "doc_id") -> None:
    """Nested JSON of a run. ``catalogs``: each catalog's names by
    category; ``files``: each document with its field paths; ``summary``: one
    document with the totals of all catalogs."""
    named = catalog.where(~F.col("is_category"))
    by_cat = named.groupBy("catalog", "category").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "field"))).alias("f"), F.min("ordinal").alias("o"))
    cats = by_cat.groupBy("catalog").agg(F.array_sort(F.collect_list(F.struct("o", "category", F.col("f.field").alias("fields")))).alias("c")).select(
        "catalog", F.transform("c", lambda c: F.struct(c["category"].alias("category"), c["fields"].alias("fields"))).alias("categories"))
    cats.write.mode("overwrite").json(f"{path}/catalogs")
    paths.select(key, F.col("paths").alias("fields")).write.mode("overwrite").json(f"{path}/files")
    one = named.agg(F.count("*").alias("catalog_names")).withColumn("_one", F.lit(1))
    files = paths.agg(F.count("*").alias("files")).withColumn("_one", F.lit(1))
    comparison = stats.agg(F.array_sort(F.collect_list(F.struct(*stats.columns))).alias("comparison")).withColumn("_one", F.lit(1))
    one.join(files, "_one").join(comparison, "_one").drop("_one").write.mode("overwrite").json(f"{path}/summary")


def export_extras(extras: DataFrame, path: str) -> None:
    """``reports.extra_fields`` as sorted JSON rows, with their number in ``total``."""
    extras.orderBy("catalog", "field_name").write.mode("overwrite").json(f"{path}/fields")
    extras.agg(F.count("*").alias("total_extra_fields")).write.mode("overwrite").json(f"{path}/total")
