"""Set operations on field-path sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structure_diff(paths: DataFrame, left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """X1 at scale: ``left``/``right`` are ``(pair_id, doc_id)`` sides of
    document pairs; one ``full_outer`` join on (pair, path) labels every
    path ``left_only``, ``right_only`` or ``common``."""
    lp = left.join(paths, key).select("pair_id", "path", F.lit(True).alias("_l"))
    rp = right.join(paths, key).select("pair_id", "path", F.lit(True).alias("_r"))
    j = lp.join(rp, ["pair_id", "path"], "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "common").when(F.col("_l"), "left_only").otherwise("right_only")
    return j.select("pair_id", "path", side.alias("side"))


def structure_diff_counts(diff: DataFrame) -> DataFrame:
    """X1 counts: left/right totals and the common count per pair."""
    s = F.col("side")
    return diff.groupBy("pair_id").agg(
        F.count_if(s != "right_only").alias("left_count"),
        F.count_if(s != "left_only").alias("right_count"),
        F.count_if(s == "common").alias("common_count"),
    )


def expected_check(prof: DataFrame, expected: list[str], key: str = "doc_id") -> DataFrame:
    """Raw-name check against an expected list (no normalization):
    ``valid`` (expected is a subset), sorted ``missing``/``extra``/``matched``."""
    exp = F.array_sort(F.array_distinct(F.array(*[F.lit(x) for x in expected]))) if expected else F.array().cast("array<string>")
    p = F.col("paths")
    missing = F.array_except(exp, p)
    return prof.select(
        key,
        (F.size(missing) == 0).alias("valid"),
        F.array_sort(missing).alias("missing"),
        F.array_sort(F.array_except(p, exp)).alias("extra"),
        F.array_sort(F.array_intersect(exp, p)).alias("matched"),
    )


def union_paths(*frames: DataFrame) -> DataFrame:
    """Set union of path (or name) frames with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
