"""Aggregations over the comparison table.

All are ``groupBy`` aggregates with partial (map-side) aggregation; lists
that feed reports are sorted and capped with ``slice`` only where the cap is
the feature (first 10 files, first 20 records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def _cnt(cond, weight: str | None = None) -> F.Column:
    """Rows that meet a condition; with ``weight`` each counts so many times."""
    return F.sum(F.when(cond, F.col(weight)).otherwise(0)) if weight else F.count_if(cond)


def first_k(df: DataFrame, group: list[str], order: str, k: int, salt_buckets: int = 64) -> DataFrame:
    """The ``k`` smallest ``order`` values per group, skew-safe.

    A hot group is first cut into ``salt_buckets`` slices by a hash of the
    ordering value; each slice keeps its own first ``k`` (bounded), then a
    second window over at most ``salt_buckets * k`` rows per group picks the
    global first ``k``. No task ever holds a whole group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(order)
    local = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(order)
    return local.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).drop("_salt", "_r")


def match_stats(cmp: DataFrame, by: tuple[str, ...] = ("catalog",), weight: str | None = None) -> DataFrame:
    """A1: totals by status and match kind (``weight``: documents per row of a
    comparison of document classes)."""
    s = F.col("status")
    return cmp.groupBy(*by).agg(
        _cnt(F.lit(True), weight).alias("total"),
        _cnt(s == "matched", weight).alias("matched"),
        _cnt(s == "missing", weight).alias("missing"),
        _cnt(s == "extra", weight).alias("extra"),
        _cnt((s == "matched") & (F.col("match_kind") == "exact"), weight).alias("exact_matches"),
        _cnt((s == "matched") & (F.col("match_kind") == "fuzzy"), weight).alias("fuzzy_matches"),
    )


def per_doc_counts(cmp: DataFrame, keys: tuple[str, ...] = ("catalog", "doc_id")) -> DataFrame:
    """A2: matched / missing / extra per document, with the zero-match flag."""
    s = F.col("status")
    return cmp.groupBy(*keys).agg(
        _cnt(s == "matched").alias("matched"),
        _cnt(s == "missing").alias("missing"),
        _cnt(s == "extra").alias("extra"),
    ).withColumn("zero_match", (F.col("matched") == 0) & (F.col("extra") > 0))


def per_doc_lists(cmp: DataFrame, keys: tuple[str, ...] = ("catalog", "doc_id")) -> DataFrame:
    """A3: per-document sorted lists of missing and extra names."""
    s = F.col("status")
    return cmp.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(s == "missing", F.col("field_name")))).alias("missing_fields"),
        F.array_sort(F.collect_list(F.when(s == "extra", F.col("field_name")))).alias("extra_fields"),
    )


def field_partials(cmp: DataFrame, docs: DataFrame, top: int = 10, key: str = "class_id", weight: str = "n") -> DataFrame:
    """Partial A4: per (catalog, field) the counts by status, whether it has a
    category, the number of documents that miss it and the first ``top`` of
    them. Partials of disjoint sets of documents merge in ``field_verdicts``.

    ``cmp`` is a comparison of document classes, ``docs(key, docs)`` the first
    documents of each: no row per document and field is ever made.
    """
    s = F.col("status")
    g = cmp.groupBy("catalog", "field_name").agg(
        _cnt(s == "matched", weight).alias("n_matched"),
        _cnt(s == "missing", weight).alias("n_missing"),
        _cnt(s == "extra", weight).alias("n_extra"),
        F.max(F.when(s == "missing", F.col("category") != "")).alias("has_category"),
    )
    # a class misses a field once, however often the catalog lists it
    miss = cmp.where(s == "missing").groupBy("catalog", "field_name", key).agg(F.first(weight).alias("_n"))
    n_docs = miss.groupBy("catalog", "field_name").agg(F.sum("_n").alias("n_docs"))
    named = miss.join(docs, key).select("catalog", "field_name", F.explode("docs").alias("doc"))
    return g.join(n_docs, ["catalog", "field_name"], "left").join(_first_names(named, top), ["catalog", "field_name"], "left")


def _first_names(named: DataFrame, top: int) -> DataFrame:
    return first_k(named, ["catalog", "field_name"], "doc", top).groupBy("catalog", "field_name").agg(
        F.array_sort(F.collect_list("doc")).alias("docs"))


def field_verdicts(partials: DataFrame, top: int = 10) -> DataFrame:
    """A4 + A5 from ``field_partials`` of one or more sets of documents."""
    g = partials.groupBy("catalog", "field_name").agg(
        *[F.sum(c).alias(c) for c in ("n_matched", "n_missing", "n_extra", "n_docs")], F.max("has_category").alias("has_category"))
    named = partials.select("catalog", "field_name", F.explode("docs").alias("doc"))
    g = g.join(_first_names(named, top), ["catalog", "field_name"], "left")
    category = F.coalesce("has_category", F.lit(False))
    listing = F.when(F.col("n_docs") <= top, F.array_join("docs", ", ")).otherwise(
        F.concat(F.array_join("docs", ", "), F.lit(" and "), (F.col("n_docs") - top).cast("string"), F.lit(" more")))
    # a field missing somewhere never falls through to "extra": without a
    # category it is reported only when no document carries the name at all
    verdict = (
        F.when(F.col("n_matched") > 0, F.lit("matched"))
        .when(F.col("n_missing") > 0, F.when(category | (F.col("n_extra") == 0), F.lit("missing")))
        .when(F.col("n_extra") > 0, F.lit("extra"))
    )
    times = (
        F.when(F.col("n_matched") > 0, F.col("n_matched"))
        .when(F.col("n_missing") > 0, F.col("n_missing"))
        .otherwise(F.col("n_extra"))
    )
    return g.select(
        "catalog", "field_name", verdict.alias("verdict"), times.alias("times"),
        F.when((F.col("n_matched") == 0) & category, listing).alias("missing_in"),
    ).where(F.col("verdict").isNotNull())


def field_rollup(cmp: DataFrame, top: int = 10, key: str = "doc_id") -> DataFrame:
    """A4 + A5: one verdict per field name across all documents of a
    comparison with one row per document and field.

    matched anywhere -> matched (n times); else missing somewhere: a field
    with a catalog category is reported missing with its (distinct, sorted)
    document list, a field without one only if the name never appeared in
    any document; else extra (n times). ``pipeline.rollup_fields`` gives the
    same without a row per document and field.
    """
    from ..session import materialize

    one = materialize(cmp.withColumn("n", F.lit(1).cast("long")))
    docs = one.select(key).distinct().select(key, F.array(F.col(key).cast("string")).alias("docs"))
    return field_verdicts(field_partials(one, docs, top, key), top)


def unique_unmatched(cmp: DataFrame, weight: str | None = None) -> DataFrame:
    """Distinct missing / extra names over all documents, sorted."""
    return (
        cmp.where(F.col("status").isin("missing", "extra"))
        .groupBy("catalog", "status", "field_name")
        .agg(_cnt(F.lit(True), weight).alias("occurrences"))
    )


def totals(cmp: DataFrame, weight: str | None = None) -> DataFrame:
    """Overall matched / missing / extra / compared."""
    s = F.col("status")
    return cmp.groupBy("catalog").agg(
        _cnt(s == "matched", weight).alias("matched"), _cnt(s == "missing", weight).alias("missing"),
        _cnt(s == "extra", weight).alias("extra"), _cnt(F.lit(True), weight).alias("compared"),
    )


def record_issues(rec_cmp: DataFrame, first: int = 20) -> DataFrame:
    """Per document, records with missing or extra fields; first 20 ids."""
    s = F.col("status")
    per_rec = rec_cmp.groupBy("catalog", "doc_id", "record_idx").agg(
        _cnt(s == "missing").alias("missing"), _cnt(s == "extra").alias("extra")
    ).where("missing + extra > 0")
    tot = per_rec.groupBy("catalog", "doc_id").agg(
        F.count("*").alias("records_with_issues"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
    )
    firsts = first_k(per_rec, ["catalog", "doc_id"], "record_idx", first).groupBy("catalog", "doc_id").agg(
        F.array_sort(F.collect_list("record_idx")).alias("first_records")
    )
    return tot.join(firsts, ["catalog", "doc_id"])


def first_per_field(cmp: DataFrame, order: str = "doc_id") -> DataFrame:
    """Keep the first row per (field, status) and count all of them.

    ``min_by`` and ``count`` aggregate partially on the map side, so a field
    present in most documents never gathers in one task.
    """
    g = cmp.groupBy("catalog", "field_name", "status").agg(
        F.min_by(F.struct(*[c for c in cmp.columns if c not in ("catalog", "field_name", "status")]), order).alias("_r"),
        F.count("*").alias("occurrences"),
    )
    return g.select("catalog", "field_name", "status", "_r.*", "occurrences")


def load_stats(parsed: DataFrame, v: str = "v") -> DataFrame:
    """Success / failed document counts."""
    return parsed.agg(_cnt(F.col(v).isNotNull()).alias("success"), _cnt(F.col(v).isNull()).alias("failed"))


def category_unmatched(cmp: DataFrame, category: str | None = None, pattern: str | None = None) -> DataFrame:
    """Unmatched names of one category, or whose name contains a pattern."""
    cond = F.lit(False)
    if category is not None:
        cond = cond | (names.norm_category("category") == category.replace(" ", "").replace("_", "").replace("-", "").lower())
    if pattern is not None:
        cond = cond | F.lower("field_name").contains(pattern.lower())
    return cmp.where(F.col("status").isin("missing", "extra") & cond)


def run_summary(cmp: DataFrame, rec_issues: DataFrame | None, findings: DataFrame | None, catalog: DataFrame,
                parsed: DataFrame) -> DataFrame:
    """One row per catalog joining the totals of the other roll-ups."""
    t = totals(cmp)
    size = catalog.groupBy("catalog").agg(F.count("*").alias("catalog_names"))
    # one-row aggregates attach through a constant key (a broadcast hash join)
    docs = parsed.agg(F.count_if(F.col("v").isNotNull()).alias("files_processed")).withColumn("_one", F.lit(1))
    out = t.join(size, "catalog", "left").withColumn("_one", F.lit(1)).join(F.broadcast(docs), "_one")
    if rec_issues is not None:
        r = rec_issues.groupBy("catalog").agg(
            F.count("*").alias("multi_record_files_with_issues"), F.sum("records_with_issues").alias("records_with_issues")
        )
        out = out.join(r, "catalog", "left")
    if findings is not None:
        fc = findings.agg(F.countDistinct("field").alias("special_char_fields")).withColumn("_one", F.lit(1))
        out = out.join(F.broadcast(fc), "_one")
    return out.drop("_one")


def full_summary(cmp: DataFrame, rec_cmp: DataFrame, found: DataFrame, catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """A11 over all grains: one row per catalog with its size, the files and
    multi-record files (``counts``: one row), totals and distinct unmatched
    names of the file comparison, records with issues, and fields with special
    characters in values (JSON) or names (catalog).

    ``cmp`` and ``rec_cmp`` are comparisons of classes with their number ``n``
    of documents and records.
    """
    named = catalog.groupBy("catalog").agg(
        F.count_if(~F.col("is_category")).alias("catalog_fields"),
        F.countDistinct(F.when(names.has_special_name("field"), F.col("field"))).alias("special_catalog_fields"))
    u = unique_unmatched(cmp, "n").groupBy("catalog").agg(
        F.count_if(F.col("status") == "missing").alias("unique_missing"), F.count_if(F.col("status") == "extra").alias("unique_extra"))
    per_rec = rec_cmp.where(F.col("status").isin("missing", "extra")).groupBy("catalog", "class_id").agg(F.first("n").alias("n"))
    issues = per_rec.groupBy("catalog").agg(F.sum("n").alias("records_with_issues"))
    one = found.agg(F.countDistinct("field").alias("special_json_fields")).withColumn("_one", F.lit(1))
    out = named.join(totals(cmp, "n"), "catalog").join(u, "catalog", "left").join(issues, "catalog", "left")
    out = out.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").join(one, "_one").drop("_one")
    return out.na.fill(0, ["unique_missing", "unique_extra", "records_with_issues"])
