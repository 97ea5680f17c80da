"""End-to-end flows (E1 compare, E2 validate) composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, match, profile, rollup, walk
from ..session import materialize


def parse_docs(docs: DataFrame, content: str = "content", tolerant: bool = True) -> DataFrame:
    """Documents -> ``v`` VARIANT. ``tolerant`` loads as S3 does: strictly, then with repairs."""
    if tolerant:
        from ..sources.files import tolerant_load

        return tolerant_load(docs, content)
    return walk.parse(docs, content)


def file_profile(docs: DataFrame, key: str = "doc_id", content: str = "content", tolerant: bool = True,
                 spread: int | None = None, by_shape: bool = True) -> DataFrame:
    """Per document: sorted paths, signature, null-parent and array maps.

    Documents that do not load have no row here; ``files.load_status`` lists
    them with their error.

    ``by_shape`` walks one document per distinct Variant schema (see
    ``match.shape_profile``); otherwise every document is walked.
    """
    parsed = parse_docs(docs.select(key, content), content, tolerant).where(F.col("v").isNotNull())
    if by_shape:
        d = parsed.withColumn("root_is_array", F.lit(False)).withColumn("unit", F.lit(None).cast("int"))
        if tolerant:
            # re-parse the repaired text, not the original
            from ..sources.files import repaired_text

            d = d.withColumn(content, repaired_text(content))
        return match.shape_profile(d, (key,), level="file", content=content)
    u = walk.units(parsed.select(key, "v"), key=key, spread=spread)
    # read by the signature grouping and by the join back: materialize once
    return materialize(match.profile(walk.nodes(u, keys=(key, "unit")), (key,), level="file"))


def record_profile(docs: DataFrame, key: str = "doc_id", content: str = "content", tolerant: bool = True,
                   spread: int | None = None, by_shape: bool = True) -> DataFrame:
    """Per record of documents with more than one record."""
    parsed = parse_docs(docs.select(key, content), content, tolerant).where(F.col("v").isNotNull()).select(key, "v")
    u = walk.units(parsed, key=key, spread=spread)
    r = match.record_units(u, key)
    if by_shape:
        return match.shape_profile(r, (key, "record_idx"), level="record")
    n = walk.nodes(r, keys=(key, "unit", "record_idx"))
    return materialize(match.profile(n, (key, "record_idx"), level="record"))


def compare_documents(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", tolerant: bool = True, **kw) -> DataFrame:
    """E1 file level: the comparison table for every document that loads."""
    return match.compare(file_profile(docs, key, tolerant=tolerant), catalog, keys=(key,), **kw)


def compare_records(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", only_issues: bool = True, **kw) -> DataFrame:
    """Per-record comparison for multi-record documents; by default only
    records with at least one missing or extra field are kept."""
    cmp = match.compare(record_profile(docs, key), catalog, keys=(key, "record_idx"), record_level=True, **kw)
    if only_issues:
        bad = cmp.where(F.col("status").isin("missing", "extra")).select("catalog", key, "record_idx").distinct()
        cmp = cmp.join(bad, ["catalog", key, "record_idx"], "left_semi")
    return cmp


def compare_classes(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", tolerant: bool = True, first: int = 10,
                    **kw) -> tuple[DataFrame, DataFrame]:
    """E1 once per class of documents that compare alike: the comparison table
    keyed by ``class_id`` with the class's number of documents ``n``, and the
    first documents of each class."""
    prof = file_profile(docs, key, tolerant=tolerant)
    classes = materialize(match.document_classes(prof))
    return match.compare(classes, catalog, keys=("class_id", "n"), **kw), match.first_documents(prof, key, first)


def field_partials(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", top: int = 10, **kw) -> DataFrame:
    """Partial field roll-up of a set of documents, e.g. of a micro batch."""
    cmp, first = compare_classes(docs, catalog, key, first=top, **kw)
    return rollup.field_partials(materialize(cmp), first, top)


def rollup_fields(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", top: int = 10, **kw) -> DataFrame:
    """A4 + A5 over documents, at the cost of their classes."""
    return rollup.field_verdicts(field_partials(docs, catalog, key, top, **kw), top)


def clean_then_profile(docs: DataFrame, catalogs: DataFrame, removals: DataFrame, exclusions: DataFrame, key: str = "doc_id",
                       tolerant: bool = True) -> DataFrame:
    """The string value of every field path, taken from the raw document,
    cleaned with each catalog's removal table, and profiled as cleaned text
    under its exclusion table: ``doc_id, catalog, field, cleaned, removed,
    state, special_chars``."""
    loaded = parse_docs(docs.select(key, "content"), tolerant=tolerant).where(F.col("v").isNotNull())
    n = walk.nodes_by_depth(walk.units(loaded.select(key, "v"), key=key), keys=(key, "unit"), only="fst")
    values = profile.string_values(profile.path_values(n, key), key)
    cats = catalogs.agg(F.collect_set("catalog").alias("_cats")).withColumn("_one", F.lit(1))
    each = values.withColumn("_one", F.lit(1)).join(F.broadcast(cats), "_one").select(key, F.explode("_cats").alias("catalog"), "field", "value")
    return profile.value_states(clean.clean_by_table(each, removals, catalogs), exclusions).drop("value")


def run_summary(docs: DataFrame, catalog: DataFrame, key: str = "doc_id", tolerant: bool = True, **kw) -> DataFrame:
    """A11 of a whole run. The corpus is loaded and parsed once; files, records
    and values are read from the parsed table, and the comparisons run per
    class of documents and of records that compare alike."""
    loaded = materialize(parse_docs(docs.select(key, "content"), tolerant=tolerant).where(F.col("v").isNotNull()).select(key, "v"))
    whole = loaded.withColumn("root_is_array", F.lit(False)).withColumn("unit", F.lit(None).cast("int"))
    files = match.shape_profile(whole, (key,))
    units = walk.units(loaded, key=key)
    records = match.shape_profile(match.record_units(units, key), (key, "record_idx"), level="record")
    cmp = match.compare(materialize(match.document_classes(files)), catalog, keys=("class_id", "n"), **kw)
    rec = match.compare(materialize(match.document_classes(records)), catalog, keys=("class_id", "n"), record_level=True, **kw)
    found = profile.findings(profile.string_values(profile.path_values(walk.nodes_by_depth(units, (key, "unit"), only="fst"), key), key), key)
    counts = loaded.agg(F.count("*").alias("files_processed"), F.count_if(
        F.expr("size(filter(try_variant_get(v, '$', 'array<variant>'), e -> try_variant_get(e, '$', 'struct<>') IS NOT NULL)) > 1")).alias("multi_record_files"))
    return rollup.full_summary(materialize(cmp), rec, found, catalog, counts)
