"""Text reports as ordered lines.

A report is a DataFrame ``(section INT, name STRING, seq BIGINT, line STRING)``;
``sinks.write_report`` sorts it by the first three and writes the lines. Long
listings (documents of a field, fields of a document) are rows of their own, so
no line and no task grows with the number of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import rollup, validate
from ..session import materialize

RULE = "=" * 80


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(df: DataFrame, section: int, name: Column, lines: list[Column], first: int = 0) -> DataFrame:
    """A row of ``df`` to several lines; null lines are left out."""
    each = df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.posexplode(F.array(*lines)).alias("_k", "line"))
    return each.where(F.col("line").isNotNull()).select("section", "name", (F.col("_k") + first).cast("bigint").alias("seq"), "line")


def _heading(df: DataFrame, section: int, title: Column) -> DataFrame:
    """The heading of a section: before all its lines, where ``title`` is not null."""
    return _lines(df, section, F.lit(""), [F.when(title.isNotNull(), x) for x in (F.lit(""), title, F.lit(RULE))], first=-3)


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validation_report(val: DataFrame, key: str = "doc_id") -> DataFrame:
    """Summary, then invalid files with errors, files with warnings, valid files."""
    t = validate.batch_totals(val)
    clean = val.agg(F.count_if(F.col("valid") & (F.size("warnings") == 0)).alias("clean"))
    body = validate.report_lines(val, key).select("section", "name", F.col("seq").cast("bigint").alias("seq"), "line")
    summary = _lines(t, 0, F.lit(""), [
        F.lit("JSON VALIDATION REPORT"), F.lit(RULE), _text("Total files: ", F.col("total_files")), _text("Valid files: ", F.col("valid_files")),
        _text("Invalid files: ", F.col("invalid_files")), _text("Files with warnings: ", F.col("files_with_warnings"))])
    return _union(
        summary, body, _heading(t, 1, F.when(F.col("invalid_files") > 0, F.lit("INVALID FILES"))),
        _heading(t, 2, F.when(F.col("files_with_warnings") > 0, F.lit("FILES WITH WARNINGS"))),
        _heading(clean, 3, F.when(F.col("clean") > 0, F.lit("VALID FILES"))))


def field_report(cmp: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals, fields of each document, counts of each document, and the
    unmatched names over all documents, per catalog. Each roll-up is made
    once: several sections read it, and sorting the report reads them twice."""
    t = materialize(rollup.totals(cmp))
    status = F.col("status")
    totals = _lines(t, 0, F.col("catalog"), [
        _text("FIELD COMPARISON: ", F.col("catalog")), _text("Matched: ", F.col("matched")), _text("Missing in JSON: ", F.col("missing")),
        _text("Not in catalog: ", F.col("extra")), _text("Compared: ", F.col("compared"))])
    one = F.concat_ws("/", "catalog", F.col(key).cast("string"))
    item = F.struct("field_name", "match_kind")
    docs = materialize(cmp.groupBy("catalog", key).agg(
        F.count_if(status == "matched").alias("matched"),
        F.array_sort(F.collect_list(F.when(status == "missing", item))).alias("missing"),
        F.array_sort(F.collect_list(F.when(status == "extra", item))).alias("extra")))

    def listing(title: str, col: str) -> Column:
        head = F.when(F.size(col) > 0, _text(f"  {title} (", F.size(col), "):")).otherwise(F.lit(f"  {title}: none"))
        return F.concat(F.array(head), F.transform(col, lambda x: F.concat(F.lit("    - "), x["field_name"], F.lit(": "), x["match_kind"])))

    detail = docs.where((F.size("missing") > 0) | (F.size("extra") > 0)).select(F.lit(1).alias("section"), one.alias("name"), F.posexplode(F.concat(
        F.array(_text("FILE: ", F.col(key), " (", F.col("catalog"), ")")), listing("Missing in JSON", "missing"), listing("Not in catalog", "extra"))).alias("seq", "line"))
    counts = _lines(docs, 2, one, [_text(F.col(key), " (", F.col("catalog"), ") matched: ", F.col("matched"), ", missing: ", F.size("missing"), ", extra: ", F.size("extra"))])
    unmatched = materialize(rollup.unique_unmatched(cmp))
    kind = F.when(status == "missing", F.lit("Missing in JSON")).otherwise(F.lit("Not in catalog"))
    names_ = _lines(unmatched, 3, F.concat_ws("/", "catalog", F.col("status"), "field_name"),
                    [_text("  - ", F.col("field_name"), " (", F.col("catalog"), "): ", kind, ", ", F.col("occurrences"), " times")])
    some = unmatched.agg(F.when(F.count("*") > 0, F.lit("UNMATCHED FIELDS")).alias("title"))
    any_doc = t.agg(F.when(F.sum(F.col("missing") + F.col("extra")) > 0, F.lit("FIELDS OF EACH FILE")).alias("detail"),
                    F.when(F.count("*") > 0, F.lit("COUNTS OF EACH FILE")).alias("counts"))
    detail = detail.select("section", "name", F.col("seq").cast("bigint").alias("seq"), "line")
    return _union(totals, detail, counts, names_, _heading(any_doc, 1, F.col("detail")), _heading(any_doc, 2, F.col("counts")),
                  _heading(some, 3, F.col("title")))


def special_character_report(found: DataFrame, catalog: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Catalog names with special characters (P17), then per JSON field
    its characters, a sample of 80 characters and each ``file:line``."""
    quoted = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    parts = []
    if catalog is not None:
        bad = catalog.where(names.has_special_name("field") & (F.length("field") > 0)).groupBy("field").agg(
            F.flatten(F.collect_set(names.special_chars("field", names.NAME_ALLOWED))).alias("c"))
        parts.append(_lines(bad, 1, F.col("field"), [_text("  - ", F.col("field"), ": special characters ", quoted(F.array_distinct("c")))]))
        parts.append(_heading(bad.agg(F.count("*").alias("n")), 1, F.when(F.col("n") > 0, _text("Catalog fields (", F.col("n"), ")"))))
    chars = found.select("field", F.explode("special_chars").alias("c")).distinct().groupBy("field").agg(F.collect_list("c").alias("c"))
    sample = found.groupBy("field").agg(F.min_by("sample_value", F.struct(key, "line_number")).alias("sample"))
    fields = chars.join(sample, "field")
    cut = F.when(F.length("sample") > 80, F.concat(F.substring("sample", 1, 80), F.lit("..."))).otherwise(F.col("sample"))
    parts.append(_lines(fields, 2, F.col("field"), [_text("  - ", F.col("field"), ": special characters ", quoted(F.col("c")), ', sample value: "', cut, '"')], first=-1))
    at = F.col("line_number")
    parts.append(found.select(F.lit(2).alias("section"), F.col("field").alias("name"), F.lit(0).cast("bigint").alias("seq"),
                              F.when(at.isNotNull(), _text("      file: ", F.col(key), ":", at)).otherwise(_text("      file: ", F.col(key))).alias("line")))
    n = fields.agg(F.count("*").alias("n"))
    parts.append(_heading(n, 2, F.when(F.col("n") > 0, _text("JSON fields (", F.col("n"), ")"))))
    parts.append(_lines(n, 0, F.lit(""), [F.lit("SPECIAL CHARACTERS IN VALUES"), F.lit(RULE), F.when(F.col("n") == 0, F.lit("No special characters found."))]))
    return _union(*parts)


def error_rows(load: DataFrame, val: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, stage, level, message)`` of documents that did not load
    (``files.load_status``) and of validation errors and warnings."""
    failed = load.where(~F.col("loaded")).select(key, F.lit("load").alias("stage"), F.lit("ERROR").alias("level"), F.col("error").alias("message"))
    part = lambda col, level: val.select(key, F.lit("validate").alias("stage"), F.lit(level).alias("level"), F.explode(col).alias("message"))
    return _union(failed, part("errors", "ERROR"), part("warnings", "WARNING"))


def extra_fields(file_cmp: DataFrame, rec_cmp: DataFrame | None = None, key: str = "doc_id", first: int = 10) -> DataFrame:
    """Names in JSON but in no catalog, over files and records, sorted by
    the sink: ``catalog, field_name, in_files, in_records`` (rows) and
    ``files``, the first documents that have them."""
    rows = file_cmp.where("status = 'extra'").select("catalog", "field_name", F.col(key).cast("string").alias("doc"), F.lit(False).alias("rec"))
    if rec_cmp is not None:
        rows = rows.unionByName(rec_cmp.where("status = 'extra'").select("catalog", "field_name", F.col(key).cast("string").alias("doc"), F.lit(True).alias("rec")))
    by = ["catalog", "field_name"]
    counts = rows.groupBy(*by).agg(F.count_if(~F.col("rec")).alias("in_files"), F.count_if("rec").alias("in_records"))
    docs = rollup.first_k(rows.select(*by, "doc").distinct(), by, "doc", first).groupBy(*by).agg(F.array_sort(F.collect_list("doc")).alias("files"))
    return counts.join(docs, by)
