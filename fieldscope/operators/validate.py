"""Validation of JSON documents.

Per document: size, blank check, Python-strict syntax verdict (Arrow UDF,
the one place Python's exact messages are needed), then structure, nesting
depth, blank strings, schema rules and text heuristics, all native. Output
schema (1.4): ``doc_id, valid, errors, warnings, root_type, field_count,
array_length, max_depth, file_size, file_size_mb, err_line, err_col,
err_msg, suggestions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.syntax import NO_STRUCTURE, syntax_verdict
from . import walk

# Python's str.strip()/\s whitespace, for blank tests.
_BLANK = r"(?U)^[\s\x{1C}-\x{1F}]*$"


def py_type_sql(v: str) -> str:
    """Python type name of a JSON value held in a VARIANT.

    Variant stores integral decimals (``1.0``) with scale 0; those read as
    ``int`` here where Python would say ``float`` (documented limitation).
    """
    return (
        f"CASE WHEN try_variant_get({v}, '$', 'struct<>') IS NOT NULL THEN 'dict' "
        f"WHEN try_variant_get({v}, '$', 'array<struct<>>') IS NOT NULL THEN 'list' "
        f"WHEN is_variant_null({v}) THEN 'NoneType' "
        f"WHEN schema_of_variant({v}) = 'STRING' THEN 'str' "
        f"WHEN schema_of_variant({v}) = 'BOOLEAN' THEN 'bool' "
        f"WHEN schema_of_variant({v}) IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') "
        f"  OR schema_of_variant({v}) RLIKE '^DECIMAL\\\\([0-9]+,0\\\\)$' THEN 'int' "
        f"ELSE 'float' END"
    )


# JSON-schema type name -> accepted Python type names (bool is an int).
TYPE_ACCEPTS = {
    "string": ("str",),
    "number": ("int", "float", "bool"),
    "integer": ("int", "bool"),
    "boolean": ("bool",),
    "array": ("list",),
    "object": ("dict",),
    "null": ("NoneType",),
}


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def schema_errors(v: str, schema: dict | None) -> Column:
    """V5/V6: ``required`` + ``properties.type`` rules on a root object."""
    if not schema:
        return F.array().cast("array<string>")
    parts = []
    is_obj = f"try_variant_get({v}, '$', 'struct<>') IS NOT NULL"
    for f in schema.get("required", []) or []:
        get = f"try_variant_get({v}, {_quote(_json_path(f))}, 'variant')"
        parts.append(f"CASE WHEN {is_obj} AND {get} IS NULL THEN {_quote('Missing required field: ' + str(f))} END")
    for f, fs in (schema.get("properties") or {}).items():
        t = (fs or {}).get("type") if isinstance(fs, dict) else None
        if not t or t not in TYPE_ACCEPTS:
            continue
        get = f"try_variant_get({v}, {_quote(_json_path(f))}, 'variant')"
        acc = ", ".join(_quote(x) for x in TYPE_ACCEPTS[t])
        pt = py_type_sql(get)
        parts.append(
            f"CASE WHEN {is_obj} AND {get} IS NOT NULL AND NOT ({pt} IN ({acc})) THEN "
            f"concat({_quote(f'Field {chr(39)}{f}{chr(39)} has wrong type. Expected: {t}, Got: ')}, {pt}) END"
        )
    return F.expr("filter(array(" + ", ".join(parts) + "), x -> x IS NOT NULL)")


def _json_path(field: str) -> str:
    return '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def common_issues(content: Column) -> Column:
    """V7: comment markers anywhere; first of 100 lines with ' and no "."""
    lines = F.slice(F.split(content, "\n"), 1, 100)
    first_sq = F.filter(
        F.transform(lines, lambda l, i: F.when(l.contains("'") & ~l.contains('"'), i + 1)), lambda x: x.isNotNull()
    )
    comment = F.when(content.contains("//") | content.contains("/*"), F.lit("File may contain comments (not valid in JSON)"))
    sq = F.when(
        F.size(first_sq) > 0,
        F.concat(F.lit("Possible single quotes on line "), first_sq[0].cast("string"), F.lit(" (JSON requires double quotes)")),
    )
    return F.filter(F.array(comment, sq), lambda x: x.isNotNull())


def suggestions(content: Column, line: Column, msg: Column) -> Column:
    """V8: hints from the syntax message and the offending line."""
    lines = F.split(content, "\n")
    ok_line = (line >= 1) & (line <= F.size(lines))
    pl = F.when(ok_line, F.element_at(lines, line))
    s1 = F.when(ok_line & msg.contains("Expecting") & msg.contains("property name"),
                F.lit("Check for missing quotes around property names")).when(
        ok_line & msg.contains("Expecting") & msg.contains("value"), F.lit("Check for trailing commas or missing values"))
    s2 = F.when(ok_line & msg.contains("Unterminated string"), F.lit("Check for unclosed string quotes"))
    s3 = F.when(ok_line & F.regexp_replace(pl, r"(?U)[\s\x{1C}-\x{1F}]+$", "").endswith(","),
                F.lit("Check for trailing comma before closing bracket"))
    return F.filter(F.array(s1, s2, s3), lambda x: x.isNotNull())


def with_root_structure(d: DataFrame, v: str = "v") -> DataFrame:
    """V2 columns for a parsed root. The elements of a root array are read
    once, each to its type and its key set, whose order does not matter."""
    elems = f"try_variant_get({v}, '$', 'array<variant>')"
    each = (f"transform({elems}, e -> named_struct('t', {py_type_sql('e')}, "
            "'k', to_json(array_sort(map_keys(try_variant_get(e, '$', 'map<string,variant>'))))))")
    d = d.withColumn("root_type", F.expr(py_type_sql(v))).withColumn(
        "field_count", F.expr(f"cardinality(try_variant_get({v}, '$', 'map<string,variant>'))"))
    d = d.withColumn("_each", F.when(F.col("root_type") == "list", F.expr(each)))
    first = F.element_at("_each", 1)
    return d.select(
        *[c for c in d.columns if c != "_each"], F.size("_each").alias("_size_of"),
        F.when(F.size("_each") > 0, first["t"]).alias("array_element_type"),
        F.coalesce(F.size(F.array_distinct("_each.t")) > 1, F.lit(False)).alias("_mixed"),
        F.coalesce((F.size("_each") > 0) & first["k"].isNotNull() & (F.size(F.array_distinct(F.filter("_each.k", lambda k: k.isNotNull()))) > 1),
                   F.lit(False)).alias("_inconsistent"),
    ).withColumn("array_length", F.when(F.col("root_type") == "list", F.col("_size_of"))).drop("_size_of")


def depth_and_blanks(parsed: DataFrame, key: str = "doc_id", check_nulls: bool = False) -> DataFrame:
    """V3 + V4 from the walk: max depth and blank-string (null) issues.

    Every document is walked by a plan of its own depth class; only issues
    are gathered per document, not its nodes."""
    n = walk.nodes_by_depth(walk.units(parsed.select(key, "v"), key=key), keys=(key, "unit"), with_vpath=True)
    is_str = F.expr("kind = 'scalar' AND schema_of_variant(v) = 'STRING'")
    blank = is_str & F.expr("variant_get(v, '$', 'string')").rlike(_BLANK)
    issue = F.when(F.col("keyed") & blank, F.concat(F.lit("Empty string at "), F.col("vpath")))
    if check_nulls:
        issue = F.when(F.col("keyed") & (F.col("kind") == "null"), F.concat(F.lit("Null value at "), F.col("vpath"))).otherwise(issue)
    return n.groupBy(key).agg(
        F.max("depth").alias("max_depth"),
        F.array_sort(F.collect_list(F.when(issue.isNotNull(), F.struct(F.col("vpath"), issue.alias("msg"))))).alias("_iss"),
    ).select(key, "max_depth", F.col("_iss.msg").alias("type_issues"))


def validate(docs: DataFrame, key: str = "doc_id", content: str = "content", schema: dict | None = None,
             check_nulls: bool = False, large_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """V1: the per-document verdict.

    ``content`` may be STRING or BINARY; binary content must be strict UTF-8
    (``Encoding error`` otherwise). Documents are independent, so this is a
    per-row map plus one aggregate over the walk, joined on ``key``.
    """
    d = docs
    if dict(d.dtypes)[content] == "binary":
        d = docs.withColumn("_utf8", F.expr(f"is_valid_utf8({content})")).withColumn("_size", F.length(content).cast("bigint"))
        d = d.withColumn(content, F.when(F.col("_utf8"), F.expr(f"decode({content}, 'UTF-8')")))
    else:
        d = d.withColumn("_utf8", F.lit(True)).withColumn("_size", F.octet_length(content).cast("bigint"))
    c = F.col(content)
    d = d.withColumn("_blank", c.isNull() | c.rlike(_BLANK))
    d = d.withColumn("_syn", F.when(F.col("_utf8") & ~F.col("_blank"), syntax_verdict(c)))
    d = d.withColumn("v", F.when(F.col("_syn.ok"), F.expr(f"try_parse_json({content})")))
    # the verdict feeds the walk branch and the final projection: compute once
    from ..session import materialize

    d = materialize(d)
    db = depth_and_blanks(d.where(F.col("v").isNotNull()).select(key, "v"), key, check_nulls)
    d = with_root_structure(d)
    d = d.join(db, key, "left")
    mb = F.round(F.col("_size") / F.lit(1048576.0), 2)
    large = F.when(F.col("_size") > large_bytes, F.concat(F.lit("Large file size: "), mb.cast("string"), F.lit(" MB")))
    rt = F.col("root_type")
    struct_issues = F.filter(
        F.array(
            F.when((rt == "dict") & (F.col("field_count") == 0), F.lit("Root object is empty")),
            F.when((rt == "dict") & (F.col("max_depth") > 10),
                   F.concat(F.lit("Deep nesting detected: "), F.col("max_depth").cast("string"), F.lit(" levels"))),
            F.when((rt == "list") & (F.col("array_length") == 0), F.lit("Root array is empty")),
            F.when((rt == "list") & F.col("_mixed"), F.lit("Array contains mixed element types")),
            F.when((rt == "list") & F.col("_inconsistent"), F.lit("Array objects have inconsistent field sets")),
        ),
        lambda x: x.isNotNull(),
    )
    parsed_ok = F.col("_syn.ok") & F.col("v").isNotNull()
    warn_tail = F.concat(struct_issues, F.coalesce(F.col("type_issues"), F.array().cast("array<string>")), common_issues(c))
    # valid syntax without a value: never silently valid where something was to be checked
    unread = F.col("_syn.ok") & F.col("v").isNull()
    unread_error = unread & (F.lit(schema is not None) | (F.col("_size") > large_bytes))
    warnings = F.concat(
        F.filter(F.array(large, F.when(unread & ~unread_error, F.lit(NO_STRUCTURE))), lambda x: x.isNotNull()),
        F.when(parsed_ok, warn_tail).otherwise(F.array().cast("array<string>")),
    )
    syn_err = F.format_string("JSON syntax error at line %d, column %d: %s", F.col("_syn.line"), F.col("_syn.col"), F.col("_syn.msg"))
    errors = (
        F.when(~F.col("_utf8"), F.array(F.lit("Encoding error: invalid UTF-8")))
        .when(F.col("_blank"), F.array(F.lit("File is empty")))
        .when(~F.col("_syn.ok"), F.array(syn_err))
        .when(unread_error, F.array(F.lit(NO_STRUCTURE)))
        .otherwise(F.when(F.col("v").isNotNull(), schema_errors("v", schema)).otherwise(F.array().cast("array<string>")))
    )
    out = d.select(
        key,
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.when(parsed_ok, rt).alias("root_type"),
        F.when(parsed_ok & (rt == "dict"), F.col("field_count")).alias("field_count"),
        F.when(parsed_ok & (rt == "list"), F.col("array_length")).alias("array_length"),
        F.when(parsed_ok, F.coalesce(F.col("max_depth"), F.lit(0))).alias("max_depth"),
        F.col("_size").alias("file_size"),
        mb.alias("file_size_mb"),
        F.col("_syn.line").alias("err_line"),
        F.col("_syn.col").alias("err_col"),
        F.col("_syn.msg").alias("err_msg"),
        F.when(F.col("_syn.ok") == F.lit(False), suggestions(c, F.col("_syn.line"), F.col("_syn.msg"))).alias("suggestions"),
    )
    return out.withColumn("valid", F.size("errors") == 0)


def batch_totals(val: DataFrame) -> DataFrame:
    """A10: files, valid, invalid, with warnings."""
    return val.agg(
        F.count("*").alias("total_files"),
        F.count_if("valid").alias("valid_files"),
        F.count_if(~F.col("valid")).alias("invalid_files"),
        F.count_if(F.size("warnings") > 0).alias("files_with_warnings"),
    )


def report_lines(val: DataFrame, key: str = "doc_id", name_col: str | None = None) -> DataFrame:
    """The text report as ordered lines ``(section, name, seq, line)``.

    Sections: 1 invalid files with errors, 2 files with warnings, 3 clean
    valid files. The summary block comes from ``batch_totals``.
    """
    nm = F.col(name_col) if name_col else F.col(key).cast("string")
    inv = val.where(~F.col("valid")).select(
        F.lit(1).alias("section"), nm.alias("name"),
        F.posexplode(F.concat(F.array(F.concat(F.lit("File: "), nm), F.lit("  Errors:")),
                              F.transform("errors", lambda e: F.concat(F.lit("    - "), e)))).alias("seq", "line"),
    )
    wrn = val.where(F.size("warnings") > 0).select(
        F.lit(2).alias("section"), nm.alias("name"),
        F.posexplode(F.concat(F.array(F.concat(F.lit("File: "), nm), F.lit("  Warnings:")),
                              F.transform("warnings", lambda e: F.concat(F.lit("    - "), e)))).alias("seq", "line"),
    )
    ok = val.where(F.col("valid") & (F.size("warnings") == 0)).select(
        F.lit(3).alias("section"), nm.alias("name"), F.lit(0).alias("seq"), F.concat(F.lit("  ✓ "), nm).alias("line")
    )
    return inv.unionByName(wrn).unionByName(ok)
