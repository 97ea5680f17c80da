"""Registered queries and their DuckDB oracle SQL.

Every query reads the test tables (through the document builders in
``sources.fixtures``) and runs over all rows. Oracles recompute the same
answer in SQL straight from the base tables: the documents are assembled from
table columns, so their field paths, null parents and damage are known by
construction. Fuzzy ratios are pinned literals computed with the standard
library's ``difflib`` (each residual name has at most one candidate at or
above the threshold on this data, so the greedy pass reduces to a join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, match, profile as prof_ops, rollup, validate as val_ops, walk
from ..operators import clean as clean_ops
from ..session import checkpoint_dir, configure, materialize
from ..sources import catalog as cg
from ..sources import files as src_files
from ..sources import fixtures as fx
from ..sources import reports, sinks
from . import pipeline

# ---------------------------------------------------------------------------
# fixed values: catalogs and settings used by the registered queries
# ---------------------------------------------------------------------------

# Renamed variants of order columns: exact after normalization, fuzzy, duplicates, absent.
VARIANTS = ["O_ORDER KEY", "order_status", "l-ship-dat", "o_totalprice", "o_totalprice", "O_CUSTKEY",
            "lineitems", "l_quantity", "l_tax", "l_disc"]
# Names of other tables' columns that are near misses of customer-document names.
CROSS_NAMES = ["l_orderkey", "s_acctbal", "s_nationkey", "n_name", "c_mktsegment", "o_custkey"]
# Names that compete for the same order columns, in ordinal order.
COMPETING = ["orderstatu", "o_ordrstatus", "ordr_status", "totalpric", "o_totalprc", "shipdate", "l_shpdate", "lshipdat", "orderdat",
             "o_ordrdate", "ordkey"]
# Customer/orders catalog for the multi-record documents.
CUSTOMER_ORDERS = {"customer": ["c_custkey", "c_name", "c_acctbal"], "orders": ["o_orderkey", "o_orderstatus", "o_totalprice"]}
# difflib ratios (catalog name first) of every pair at or above 0.8 on this data.
PINNED_RATIOS = [
    ("orderstatus", "oorderstatus", 0.9565217391304348),
    ("lshipdat", "lshipdate", 0.9411764705882353),
    ("lorderkey", "oorderkey", 0.8888888888888888),
    ("sacctbal", "cacctbal", 0.875),
    ("snationkey", "cnationkey", 0.9),
    ("nname", "cname", 0.8),
    ("ocustkey", "ccustkey", 0.875),
]
EXPECTED_ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "lineitems",
                         "lineitems.l_quantity", "lineitems.l_tax"]
EVENT_SCHEMA_RULES = {
    "required": ["event_id", "event_type", "user"],
    "properties": {"event_id": {"type": "integer"}, "event_type": {"type": "string"},
                   "props": {"type": "object"}, "user": {"type": "number"}},
}
EVENT_FIELDS = ["Event ID", "event-type", "user", "K", "note", "session"]
CLEAN_TOKENS = {"text": ["é", "ç"]}
USER_TOKENS = {"user": ["#"]}
# Removal and exclusion tables (catalog, field, token, ordinal) and (catalog, keyword); null: every catalog, every field.
REMOVALS = [(None, None, "-ISIS-", 0), ("alpha", "user", "#", 0), ("alpha", "user", "m@", 1), ("alpha", "KEEP NOTE", "@", 0),
            ("alpha", "KEEP NOTE", "#é#", 1), ("beta", None, "x@", 1), ("beta", "tag", "#", 0)]
EXCLUSIONS = [("beta", "Keep_Note"), ("gamma", "broken"), (None, "helm")]
CLEANING_CATALOGS = [("alpha",), ("beta",), ("gamma",)]


def _orders_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Dict catalog from table metadata: one category per table."""
    return cg.from_table_columns(
        spark, {"orders": fx.table(spark, sf, "orders"), "lineitems": fx.table(spark, sf, "lineitem")}, "orders_by_table"
    )


def _variants(spark: SparkSession) -> DataFrame:
    return cg.from_dict(spark, {"order_variants": VARIANTS})


def _rounded(cmp: DataFrame) -> DataFrame:
    return cmp.withColumn("similarity", F.round("similarity", 4))


def _join(col: str) -> F.Column:
    return F.array_join(F.col(col), ",")


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def q_field_paths(spark, sf):
    configure(spark)
    p = pipeline.file_profile(fx.order_docs(spark, sf))
    return p.select("doc_id", F.explode("paths").alias("path"))


def q_props_paths(spark, sf):
    configure(spark)
    p = pipeline.file_profile(fx.props_docs(spark, sf))
    return p.select("doc_id", F.explode("paths").alias("path"))


def q_max_depth(spark, sf):
    configure(spark)
    u = walk.units(walk.parse(fx.order_docs(spark, sf)))
    n = walk.nodes(u)
    return n.groupBy("doc_id").agg(F.max("depth").cast("bigint").alias("max_depth"))


def q_object_keys(spark, sf):
    configure(spark)
    n = walk.nodes(walk.units(walk.parse(fx.order_docs(spark, sf))))
    return walk.object_keys(n).select("doc_id", "path", F.col("depth").cast("bigint").alias("depth"))


def q_per_doc_lists(spark, sf):
    configure(spark)
    c = pipeline.compare_documents(fx.order_docs(spark, sf), _variants(spark))
    r = rollup.per_doc_lists(c)
    return r.select("catalog", "doc_id", _join("missing_fields").alias("missing_fields"),
                    _join("extra_fields").alias("extra_fields"))


def q_record_paths(spark, sf):
    configure(spark)
    p = pipeline.record_profile(fx.multi_record_docs(spark, sf))
    return p.select("doc_id", F.col("record_idx").cast("bigint").alias("record_idx"), F.explode("paths").alias("path"))


def q_null_parents(spark, sf):
    configure(spark)
    p = pipeline.record_profile(fx.multi_record_docs(spark, sf))
    return p.select("doc_id", F.col("record_idx").cast("bigint").alias("record_idx"),
                    F.explode("null_map").alias("parent", "is_null"))


def q_compare_variants(spark, sf):
    configure(spark)
    return _rounded(pipeline.compare_documents(fx.order_docs(spark, sf), _variants(spark)))


def q_fuzzy_contention(spark, sf):
    """J2 where catalog names compete: earlier ones take the better names."""
    configure(spark)
    cat = cg.from_dict(spark, {"competing": COMPETING})
    return _rounded(pipeline.compare_documents(fx.order_docs(spark, sf), cat, threshold=0.7))


def q_compare_by_table(spark, sf):
    configure(spark)
    return _rounded(pipeline.compare_documents(fx.order_docs(spark, sf), _orders_catalog(spark, sf)))


def _both_catalogs(spark, sf):
    return _variants(spark).unionByName(_orders_catalog(spark, sf))


def q_match_stats(spark, sf):
    configure(spark)
    cmp, _ = pipeline.compare_classes(fx.order_docs(spark, sf), _both_catalogs(spark, sf))
    return rollup.match_stats(cmp, weight="n")


def q_per_doc_counts(spark, sf):
    configure(spark)
    cmp = pipeline.compare_documents(fx.order_docs(spark, sf), _both_catalogs(spark, sf))
    return rollup.per_doc_counts(cmp).drop("zero_match")


def q_field_rollup(spark, sf):
    configure(spark)
    r = pipeline.rollup_fields(fx.order_docs(spark, sf), _both_catalogs(spark, sf))
    return r.withColumn("times", F.col("times").cast("bigint"))


def _arriving(spark, docs, path, batches):
    """A stream that takes the documents in so many micro batches; they are
    written by as many tasks as other shuffles have, two files a batch at least."""
    from ..streaming import ingest

    n = max(2 * batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs.repartition(n, "doc_id").write.mode("overwrite").parquet(path)
    return ingest.parquet_stream(spark, path, docs.schema, max_files=-(-n // batches))


def q_stream_rollup(spark, sf):
    """Running field statistics. Each micro batch leaves its partial
    roll-up under its batch id; the roll-up is made of the partials."""
    import uuid

    from ..session import checkpoint_dir
    from ..streaming import ingest

    configure(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/fieldscope-stream-{uuid.uuid4().hex}"
    docs = fx.order_docs(spark, sf)
    stream = _arriving(spark, docs, f"{base}/in", batches=2)
    cat = _both_catalogs(spark, sf)
    ingest.run_batches(stream, lambda batch: pipeline.field_partials(batch, cat), f"{base}/out", f"{base}/checkpoint")
    r = rollup.field_verdicts(spark.read.parquet(f"{base}/out"))
    return r.withColumn("times", F.col("times").cast("bigint"))


def q_unique_unmatched(spark, sf):
    configure(spark)
    cmp, _ = pipeline.compare_classes(fx.order_docs(spark, sf), _both_catalogs(spark, sf))
    return rollup.unique_unmatched(cmp, weight="n")


def q_run_summary(spark, sf):
    configure(spark)
    docs = fx.order_docs(spark, sf)
    cat = _variants(spark)
    cmp = pipeline.compare_documents(docs, cat)
    parsed = walk.parse(docs)
    return rollup.run_summary(cmp, None, None, cat, parsed)


def q_full_summary(spark, sf):
    """A11 over files, records and values of multi-record documents."""
    configure(spark)
    return pipeline.run_summary(fx.multi_record_docs(spark, sf), cg.from_dict(spark, {"cross_names": [*CROSS_NAMES, "c_näme"], "few": ["c_custkey"]}))


LISTED_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events")


def q_table_columns(spark, sf):
    """S9 + S10: temporary views of the tables, listed and described, with
    their observed nulls."""
    import uuid

    configure(spark)
    tag = f"fs_{uuid.uuid4().hex[:8]}_"
    for t in LISTED_TABLES:
        fx.table(spark, sf, t).createOrReplaceTempView(tag + t)
    listed = [r["table_name"] for r in cg.list_tables(spark, tag + "*").where("temporary").collect()]
    d = cg.column_details(spark, listed, observed=True)
    for t in LISTED_TABLES:
        spark.catalog.dropTempView(tag + t)
    return d.select(F.expr(f"substring(table_name, {len(tag) + 1})").alias("table_name"), (F.col("ordinal") + 1).cast("bigint").alias("ordinal"),
                    "column_name", "type", "nullable", "row_count", "null_count")


def q_category_unmatched(spark, sf):
    configure(spark)
    cmp = pipeline.compare_documents(fx.order_docs(spark, sf), _orders_catalog(spark, sf))
    return rollup.category_unmatched(cmp, category="line_items").drop("similarity")


def q_record_conformance(spark, sf):
    configure(spark)
    cat = cg.from_dict(spark, {"cross_names": CROSS_NAMES})
    c = pipeline.compare_records(fx.multi_record_docs(spark, sf), cat)
    return _rounded(c).withColumn("record_idx", F.col("record_idx").cast("bigint"))


def q_record_issues(spark, sf):
    configure(spark)
    cat = cg.from_dict(spark, {"cross_names": CROSS_NAMES})
    c = pipeline.compare_records(fx.multi_record_docs(spark, sf), cat)
    r = rollup.record_issues(c)
    return r.select("catalog", "doc_id", "records_with_issues", "missing", "extra",
                    F.array_join(F.transform("first_records", lambda x: x.cast("string")), ",").alias("first_records"))


def q_suppressed_pairs(spark, sf):
    configure(spark)
    cat = cg.from_dict(spark, {"customer_orders": CUSTOMER_ORDERS})
    c = pipeline.compare_documents(fx.multi_record_docs(spark, sf), cat, emit_suppressed=True)
    return c.where(F.col("status") == "suppressed").drop("similarity")


def q_array_parents(spark, sf):
    """P6 + J5: array parents, the last one in document order, drop pairs."""
    configure(spark)
    cat = cg.from_dict(spark, {"priced": ["id", "price", "items"]})
    return pipeline.compare_documents(fx.array_parent_docs(spark, sf), cat, emit_suppressed=True).drop("similarity")


def q_array_parent_records(spark, sf):
    """P8 + J5: a record's empty array drops pairs of its catalog category."""
    configure(spark)
    cat = cg.from_dict(spark, {"priced": {"items": ["price"], "record": ["key"]}})
    c = pipeline.compare_records(fx.priced_records(spark, sf), cat, only_issues=False, emit_suppressed=True)
    return c.withColumn("record_idx", F.col("record_idx").cast("bigint")).drop("similarity")


def q_array_maps(spark, sf):
    """P7 over root objects and root lists."""
    configure(spark)
    out = None
    for root_list in (False, True):
        d = walk.parse(fx.array_parent_docs(spark, sf, root_list))
        m = match.array_maps(d).select(F.lit(root_list).alias("root_list"), "doc_id", F.explode("arr_map").alias("field", "array"))
        m = materialize(m)  # one walk is planned and run at a time
        out = m if out is None else out.unionByName(m)
    return out


def q_mapping_suggestions(spark, sf):
    configure(spark)
    cat = cg.from_dict(spark, {"cross_names": CROSS_NAMES})
    p = pipeline.file_profile(fx.multi_record_docs(spark, sf))
    s = match.mapping_suggestions(p, cat)
    return p.select("doc_id", "sig").join(s, "sig").select(
        "doc_id", "catalog", F.col("dn").alias("name"), "suggestion", F.round("similarity", 4).alias("similarity"), "match_kind"
    )


def q_structure_diff(spark, sf):
    configure(spark)
    p = pipeline.file_profile(fx.order_docs(spark, sf))
    paths = p.select("doc_id", F.explode("paths").alias("path"))
    ids = p.select("doc_id")
    left = ids.where(F.col("doc_id") % 2 == 0).select((F.col("doc_id") / 2).cast("bigint").alias("pair_id"), "doc_id")
    right = ids.where(F.col("doc_id") % 2 == 1).select(((F.col("doc_id") - 1) / 2).cast("bigint").alias("pair_id"), "doc_id")
    d = diff.structure_diff(paths, left, right)
    return diff.structure_diff_counts(d)


def q_expected_check(spark, sf):
    configure(spark)
    p = pipeline.file_profile(fx.order_docs(spark, sf))
    e = diff.expected_check(p, EXPECTED_ORDER_FIELDS)
    return e.select("doc_id", "valid", _join("missing").alias("missing"), _join("extra").alias("extra"),
                    _join("matched").alias("matched"))


def q_load_repair(spark, sf):
    configure(spark)
    d = src_files.tolerant_load(fx.dirty_docs(spark, sf))
    return d.select("doc_id", "repair", F.col("v").isNotNull().alias("loaded"))


def _validated(spark, sf, schema=None):
    return val_ops.validate(fx.dirty_docs(spark, sf), schema=schema)


def q_validation_summary(spark, sf):
    configure(spark)
    return val_ops.batch_totals(_validated(spark, sf))


def q_validation_details(spark, sf):
    configure(spark)
    v = _validated(spark, sf)
    return v.select(
        "doc_id", "valid", F.try_element_at("errors", F.lit(1)).alias("first_error"), _join("warnings").alias("warnings"),
        F.col("err_line").cast("bigint").alias("err_line"), F.col("err_col").cast("bigint").alias("err_col"),
        F.coalesce(_join("suggestions"), F.lit("")).alias("suggestions"),
        F.col("root_type"), F.col("max_depth").cast("bigint").alias("max_depth"),
    )


def q_schema_rules(spark, sf):
    configure(spark)
    v = _validated(spark, sf, EVENT_SCHEMA_RULES)
    return v.select("doc_id", "valid", _join("errors").alias("errors"))


def q_root_array_consistency(spark, sf):
    configure(spark)
    v = val_ops.validate(fx.multi_record_docs(spark, sf))
    return v.select("doc_id", "root_type", F.col("array_length").cast("bigint").alias("array_length"),
                    _join("warnings").alias("warnings"), F.col("max_depth").cast("bigint").alias("max_depth"))


def _loaded_nodes(spark, sf):
    """Nodes of the dirty documents that load (after repairs), as far as dotted paths reach."""
    docs = fx.dirty_docs(spark, sf)
    loaded = src_files.tolerant_load(docs).where(F.col("v").isNotNull())
    return docs, walk.nodes_by_depth(walk.units(loaded.select("doc_id", "v")), only="fst")


def q_special_char_profile(spark, sf):
    configure(spark)
    docs, n = _loaded_nodes(spark, sf)
    vals = prof_ops.string_values(prof_ops.path_values(n))
    found = prof_ops.findings(vals)
    with_lines = prof_ops.line_numbers(found, docs)
    return with_lines.select("doc_id", "field", _join("special_chars").alias("special_chars"), "sample_value",
                             F.col("line_number").cast("bigint").alias("line_number"))


def q_special_char_rollup(spark, sf):
    configure(spark)
    docs, n = _loaded_nodes(spark, sf)
    found = prof_ops.line_numbers(prof_ops.findings(prof_ops.string_values(prof_ops.path_values(n))), docs)
    r = prof_ops.rollup(found)
    return r.select("field", _join("chars").alias("chars"), "occurrences",
                    F.array_join(F.transform("first_occurrences", lambda o: o["doc"].cast("string")), ",").alias("first_docs"))


def q_load_stats(spark, sf):
    configure(spark)
    return rollup.load_stats(src_files.tolerant_load(fx.dirty_docs(spark, sf)))


def q_compare_dirty(spark, sf):
    """E1 over damaged documents: the repairable ones are compared too."""
    configure(spark)
    return _rounded(pipeline.compare_documents(fx.dirty_docs(spark, sf), cg.from_dict(spark, {"events": EVENT_FIELDS})))


def q_compare_failed(spark, sf):
    """The documents that E1 could not compare, with their errors."""
    configure(spark)
    return src_files.load_status(fx.dirty_docs(spark, sf)).where(~F.col("loaded")).select("doc_id", "repair", "error")


def q_special_chars_by_lang(spark, sf):
    configure(spark)
    t = fx.text_values(spark, sf)
    f = t.withColumn("sc", F.array_sort(prof_ops.names.special_chars(F.col("value"))))
    per_lang = f.select("lang", F.explode("sc").alias("c")).distinct().groupBy("lang").agg(
        F.array_join(F.array_sort(F.collect_list("c")), "").alias("chars")
    )
    counts = f.groupBy("lang").agg(F.count_if(F.size("sc") > 0).alias("docs_with_special"), F.count("*").alias("docs"))
    return counts.join(per_lang, "lang", "left")


def q_special_char_docs(spark, sf):
    configure(spark)
    t = fx.text_values(spark, sf)
    sc = prof_ops.names.special_chars(F.col("value"))
    return t.select("doc_id", F.size(sc).cast("bigint").alias("n_special"), F.array_join(F.array_sort(sc), "").alias("chars"))


def q_clean_values(spark, sf):
    configure(spark)
    c = clean_ops.clean_column(fx.text_values(spark, sf), field_tokens=CLEAN_TOKENS)
    return c.select("doc_id", F.col("removed").cast("bigint").alias("removed"),
                    F.length("cleaned").cast("bigint").alias("cleaned_length"))


def q_clean_docs(spark, sf):
    configure(spark)
    docs = src_files.tolerant_load(fx.dirty_docs(spark, sf)).where(F.col("v").isNotNull()).withColumn("content", src_files.repaired_text())
    c = clean_ops.clean_documents(docs.select("doc_id", "content"), field_tokens=USER_TOKENS)
    return c.select("doc_id", F.col("removed").cast("bigint").alias("removed"),
                    F.col("cleaned").contains("#").alias("still_has_hash"))


def q_clean_then_profile(spark, sf):
    """Paths of the raw documents, values cleaned and profiled per catalog."""
    configure(spark)
    p = pipeline.clean_then_profile(
        fx.annotated_docs(spark, sf), spark.createDataFrame(CLEANING_CATALOGS, "catalog string"),
        spark.createDataFrame(REMOVALS, "catalog string, field string, token string, ordinal int"),
        spark.createDataFrame(EXCLUSIONS, "catalog string, keyword string"))
    return p.select("doc_id", "catalog", "field", "cleaned", "removed", "state", F.coalesce(_join("special_chars"), F.lit("")).alias("special_chars"))


def q_decode_detected(spark, sf):
    """Bytes of several encodings, decoded by rules and statistics."""
    configure(spark)
    d = src_files.decode_detected(fx.encoded_docs(spark, sf).drop("text"))
    return d.select("doc_id", "encoding", (F.col("confidence") > 0.7).alias("confident"), F.sha2("text", 256).alias("text_sha256"))


def q_deep_nesting(spark, sf):
    """V3: documents of very different depth."""
    configure(spark)
    v = val_ops.validate(fx.nested_docs(spark, sf))
    return v.select("doc_id", "valid", F.col("max_depth").cast("bigint").alias("max_depth"), _join("warnings").alias("warnings"))


def q_root_array_mixed(spark, sf):
    """V2: long root arrays, with mixed types and unequal key sets."""
    configure(spark)
    v = val_ops.validate(fx.root_array_docs(spark, sf))
    return v.select("doc_id", F.col("array_length").cast("bigint").alias("array_length"), _join("warnings").alias("warnings"),
                    F.col("max_depth").cast("bigint").alias("max_depth"))


def q_minified(spark, sf):
    configure(spark)
    a = fx.props_docs(spark, sf).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("doc"), "content")
    b = fx.dirty_docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), "content")
    u = a.unionByName(b)
    return u.select("doc", prof_ops.minified(F.col("content")).alias("minified"))


def q_catalog_from_paragraphs(spark, sf):
    configure(spark)
    c = clean_ops.catalog_from_paragraphs(fx.paragraphs(spark, sf))
    return c.select("doc_id", "catalog", "category", "field", F.col("ordinal").cast("bigint").alias("ordinal"))


def q_catalog_from_tables(spark, sf):
    """Tables of documents attached to their headings; every third
    document has none."""
    configure(spark)
    par = fx.paragraphs(spark, sf).where("doc_id % 3 <> 2")
    c = clean_ops.catalog_from_document(par, fx.table_cells(spark, sf))
    return c.select("doc_id", "catalog", "category", "field", F.col("ordinal").cast("bigint").alias("ordinal"))


def _out(spark) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/fieldscope-reports/{uuid.uuid4().hex}"


def _written(spark, lines):
    path = _out(spark)
    sinks.write_report(lines, path)
    return sinks.read_report(spark, path)


def q_validation_report(spark, sf):
    """S14, written and read back."""
    configure(spark)
    return _written(spark, reports.validation_report(materialize(_validated(spark, sf))))


def q_field_report(spark, sf):
    """S15, written and read back."""
    configure(spark)
    cmp = pipeline.compare_documents(fx.order_docs(spark, sf), _variants(spark))
    return _written(spark, reports.field_report(materialize(cmp)))


def q_special_char_report(spark, sf):
    """S16, written and read back."""
    configure(spark)
    docs, n = _loaded_nodes(spark, sf)
    found = prof_ops.line_numbers(prof_ops.findings(prof_ops.string_values(prof_ops.path_values(n))), docs)
    cat = cg.from_dict(spark, {"odd": ["user", "e-mail@", "übung", "e-mail@"]})
    return _written(spark, reports.special_character_report(materialize(found), cat))


def q_error_log(spark, sf):
    """S17, written and read back."""
    configure(spark)
    docs = fx.dirty_docs(spark, sf)
    path = _out(spark)
    sinks.write_log(reports.error_rows(src_files.load_status(docs), _validated(spark, sf)), path)
    log = spark.read.schema("doc_id bigint, stage string, message string, logged_at timestamp, level string").json(path)
    return log.select("doc_id", "stage", "level", "message", F.col("logged_at").isNotNull().alias("stamped"))


def q_results_export(spark, sf):
    """S18, written and read back."""
    configure(spark)
    cat, path = _both_catalogs(spark, sf), _out(spark)
    docs = fx.order_docs(spark, sf)
    cmp, _ = pipeline.compare_classes(docs, cat)
    sinks.export_results(pipeline.file_profile(docs), cat, rollup.totals(cmp, weight="n"), path)
    schema = "struct<catalog:string,matched:bigint,missing:bigint,extra:bigint,compared:bigint>"
    total = spark.read.schema(f"catalog_names bigint, files bigint, comparison array<{schema}>").json(f"{path}/summary")
    cats = spark.read.schema("catalog string, categories array<struct<category:string,fields:array<string>>>").json(f"{path}/catalogs")
    files = spark.read.schema("doc_id bigint, fields array<string>").json(f"{path}/files")
    return (
        total.select(F.lit("summary").alias("part"), F.lit("").alias("name"), F.concat_ws(
            ";", F.col("catalog_names").cast("string"), F.col("files").cast("string"),
            F.array_join(F.transform("comparison", lambda c: F.concat_ws(",", c["catalog"], c["matched"], c["missing"], c["extra"], c["compared"])), ";")).alias("content"))
        .unionByName(cats.select(F.lit("catalog").alias("part"), F.col("catalog").alias("name"), F.array_join(F.transform(
            "categories", lambda c: F.concat(F.coalesce(c["category"], F.lit("-")), F.lit(":"), F.array_join(c["fields"], ","))), ";").alias("content")))
        .unionByName(files.select(F.lit("file").alias("part"), F.col("doc_id").cast("string").alias("name"), F.array_join("fields", ",").alias("content")))
    )


def q_extras_export(spark, sf):
    """S19 over files and records, written and read back."""
    configure(spark)
    docs, path = fx.multi_record_docs(spark, sf), _out(spark)
    cat = cg.from_dict(spark, {"cross_names": CROSS_NAMES})
    sinks.export_extras(reports.extra_fields(pipeline.compare_documents(docs, cat), pipeline.compare_records(docs, cat)), path)
    rows = spark.read.schema("catalog string, field_name string, in_files bigint, in_records bigint, files array<string>").json(f"{path}/fields")
    total = spark.read.schema("total_extra_fields bigint").json(f"{path}/total").withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one").withColumn("files", _join("files"))


def q_stream_validate(spark, sf):
    """Validation of a document stream in micro batches (availableNow)."""
    import uuid

    from ..session import checkpoint_dir
    from ..streaming import ingest

    configure(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/fieldscope-stream-{uuid.uuid4().hex}"
    docs = fx.dirty_docs(spark, sf)
    stream = _arriving(spark, docs, f"{base}/in", batches=4)

    def per_batch(batch):
        v = val_ops.validate(batch)
        return v.select("doc_id", "valid", F.try_element_at("errors", F.lit(1)).alias("first_error"),
                        _join("warnings").alias("warnings"))

    ingest.run_batches(stream, per_batch, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("doc_id", "valid", "first_error", "warnings")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "field_paths": q_field_paths,
    "props_paths": q_props_paths,
    "max_depth": q_max_depth,
    "object_keys": q_object_keys,
    "record_paths": q_record_paths,
    "per_doc_lists": q_per_doc_lists,
    "null_parents": q_null_parents,
    "compare_variants": q_compare_variants,
    "fuzzy_contention": q_fuzzy_contention,
    "compare_by_table": q_compare_by_table,
    "match_stats": q_match_stats,
    "per_doc_counts": q_per_doc_counts,
    "field_rollup": q_field_rollup,
    "stream_rollup": q_stream_rollup,
    "unique_unmatched": q_unique_unmatched,
    "run_summary": q_run_summary,
    "full_summary": q_full_summary,
    "table_columns": q_table_columns,
    "category_unmatched": q_category_unmatched,
    "record_conformance": q_record_conformance,
    "record_issues": q_record_issues,
    "suppressed_pairs": q_suppressed_pairs,
    "array_parents": q_array_parents,
    "array_parent_records": q_array_parent_records,
    "array_maps": q_array_maps,
    "mapping_suggestions": q_mapping_suggestions,
    "structure_diff": q_structure_diff,
    "expected_check": q_expected_check,
    "load_repair": q_load_repair,
    "compare_dirty": q_compare_dirty,
    "compare_failed": q_compare_failed,
    "validation_summary": q_validation_summary,
    "validation_details": q_validation_details,
    "schema_rules": q_schema_rules,
    "root_array_consistency": q_root_array_consistency,
    "special_char_profile": q_special_char_profile,
    "special_chars_by_lang": q_special_chars_by_lang,
    "special_char_rollup": q_special_char_rollup,
    "load_stats": q_load_stats,
    "special_char_docs": q_special_char_docs,
    "clean_values": q_clean_values,
    "clean_docs": q_clean_docs,
    "clean_then_profile": q_clean_then_profile,
    "decode_detected": q_decode_detected,
    "deep_nesting": q_deep_nesting,
    "root_array_mixed": q_root_array_mixed,
    "minified": q_minified,
    "catalog_from_paragraphs": q_catalog_from_paragraphs,
    "catalog_from_tables": q_catalog_from_tables,
    "validation_report": q_validation_report,
    "field_report": q_field_report,
    "special_char_report": q_special_char_report,
    "error_log": q_error_log,
    "results_export": q_results_export,
    "extras_export": q_extras_export,
    "stream_validate": q_stream_validate,
}
