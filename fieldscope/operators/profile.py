"""Special-character profiling of values.

Values come from the node table (dotted-path lookup semantics: arrays are
entered at their first element when it is an object; for a root array the
first non-null value across records wins), or from any
``(doc_id, field, value)`` string table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def path_values(n: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, field, value VARIANT)``: the value each field path
    resolves to; root arrays take the first record with a non-null value."""
    cand = n.where(F.col("keyed") & F.col("fst") & (F.col("kind") != "null")).select(
        key, F.coalesce("unit", F.lit(0)).alias("_u"), F.col("path").alias("field"), "v"
    )
    return cand.groupBy(key, "field").agg(F.min_by("v", "_u").alias("value"))


def string_values(pv: DataFrame, key: str = "doc_id") -> DataFrame:
    """String values only (``value STRING``)."""
    return pv.where(F.expr("schema_of_variant(value) = 'STRING'")).select(
        key, "field", F.expr("variant_get(value, '$', 'string')").alias("value")
    )


def is_json_container_text(v: Column) -> Column:
    """Trimmed text is a bracketed JSON array/object that parses."""
    shaped = v.rlike(r"(?sU)\A[\s\x{1C}-\x{1F}]*+(?:\[.*\]|\{.*\})[\s\x{1C}-\x{1F}]*+\z")
    return shaped & F.try_parse_json(v).isNotNull()


def findings(values: DataFrame, key: str = "doc_id", keywords: Column | None = None, reverse: bool = True) -> DataFrame:
    """P20: rows ``(doc_id, field, special_chars, sample_value)`` for string
    values with characters outside the allowed set; exempt fields (P18) and
    JSON-looking text (P19) are skipped. Sample = first 100 characters."""
    v = F.col("value")
    keep = (v.isNotNull() & (F.length(v) > 0) & ~names.excluded(F.col("field"), keywords, reverse)
            & ~is_json_container_text(v))
    f = values.where(keep).withColumn("special_chars", names.special_chars(v))
    return f.where(F.size("special_chars") > 0).select(
        key, "field", "special_chars", F.substring(v, 1, 100).alias("sample_value"), "value"
    )


def value_states(values: DataFrame, exclusions: DataFrame, value: str = "cleaned", reverse: bool = True) -> DataFrame:
    """P16-P20 for ``(catalog, field, <value>)`` rows with the exclusion
    configuration as a table (M13: ``exclusions(catalog, keyword)``): adds
    ``state`` (empty | excluded | json_text | special | plain) and
    ``special_chars`` (of ``special`` values only)."""
    words = exclusions.where(F.col("catalog").isNotNull()).groupBy("catalog").agg(F.collect_set("keyword").alias("_words"))
    v = F.col(value)
    # else a catalog's values, of all documents, meet in one task
    d = values.join(F.broadcast(words), "catalog", "left").withColumn("special_chars", names.special_chars(v))
    state = (
        F.when(v.isNull() | (F.length(v) == 0), F.lit("empty"))
        .when(names.excluded(F.col("field"), F.col("_words"), reverse), F.lit("excluded"))
        .when(is_json_container_text(v), F.lit("json_text"))
        .when(F.size("special_chars") > 0, F.lit("special")).otherwise(F.lit("plain"))
    )
    d = d.withColumn("state", state).drop("_words")
    return d.withColumn("special_chars", F.when(F.col("state") == "special", F.col("special_chars")))


def line_numbers(found: DataFrame, docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """1-based line of each finding in its document's text.

    First line holding the last path segment (case-insensitive) and the
    first 50 characters of the value; else the first line holding those 50
    characters (plain substring; see README on the regex-escape quirk).

    Findings come from Variant values, whose assumed width makes any number of
    them look small: the hint keeps them from being broadcast by the driver.
    """
    j = found.hint("merge").join(docs.select(key, content).hint("merge"), key)
    lines = F.split(F.col(content), "\n")
    seg = F.lower(F.element_at(F.split("field", r"\."), -1))
    probe = F.substring("value", 1, 50)
    both = F.filter(F.transform(lines, lambda l, i: F.when(F.lower(l).contains(seg) & l.contains(probe), i + 1)),
                    lambda x: x.isNotNull())
    only = F.filter(F.transform(lines, lambda l, i: F.when(l.contains(probe), i + 1)), lambda x: x.isNotNull())
    ln = F.coalesce(F.element_at(both, 1), F.element_at(only, 1))
    return j.withColumn("line_number", F.when(F.length("value") > 0, ln).cast("int")).drop(content)


def rollup(found: DataFrame, key: str = "doc_id", cap: int = 50) -> DataFrame:
    """Per field, the sorted character set, occurrence count and the
    first ``cap`` occurrences (doc, line, 80-char sample) in key order.

    Character sets are deduplicated before collection and occurrences go
    through a salted first-k, so a hot field never lands whole in one task.
    """
    from .rollup import first_k

    if "line_number" not in found.columns:
        found = found.withColumn("line_number", F.lit(None).cast("int"))
    chars = found.select("field", F.explode("special_chars").alias("c")).distinct().groupBy("field").agg(
        F.array_sort(F.collect_list("c")).alias("chars")
    )
    counts = found.groupBy("field").agg(F.count("*").alias("occurrences"))
    occ = found.select("field", F.struct(F.col(key).alias("doc"), F.col("line_number").alias("line"),
                                          F.substring("sample_value", 1, 80).alias("sample")).alias("o"))
    firsts = first_k(occ, ["field"], "o", cap).groupBy("field").agg(
        F.array_sort(F.collect_list("o")).alias("first_occurrences")
    )
    return chars.join(counts, "field").join(firsts, "field")


def minified(content: Column) -> Column:
    """One line over 100 characters, or under 20 % of the first 100
    non-blank, non-comment lines indented. Blank text is not minified."""
    t = F.regexp_replace(content, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")
    lines = F.split(t, "\n")
    first = F.slice(lines, 1, 100)
    counted = F.filter(first, lambda l: (F.trim(l) != "") & ~F.trim(l).startswith("//"))
    indented = F.filter(counted, lambda l: l.startswith(" ") | l.startswith("\t"))
    one_line = (F.size(lines) == 1) & (F.length(t) > 100)
    ratio = F.size(indented) / F.size(counted)
    return F.when(F.length(t) == 0, F.lit(False)).otherwise(one_line | ((F.size(counted) > 0) & (ratio < 0.2)))
