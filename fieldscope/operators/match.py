"""Matching discovered field paths to a catalog.

Plan, for N documents and one or more catalogs:

1. ``profile``: one ``groupBy(keys)`` over the node table gives each document
   its sorted distinct paths, its null-parent map and its array-parent map.
2. ``sig``: the match of J1/J2 depends only on (catalog, path set). Documents
   from one producer share a handful of path sets, so matching runs once per
   distinct signature, not per document.
3. The catalog is a relation like any other: exact match, residual names,
   missing and extra rows per (catalog, sig) are equi-joins on the normalized
   name, so neither its size nor the number of catalogs is bounded.
4. Fuzzy match: distinct (catalog name, residual JSON name) pairs are
   blocked by a lossless length bound through an equi-join on length, scored
   by an Arrow UDF, and assigned greedily per (catalog, sig) in
   ``applyInPandas`` (order-dependent, so not expressible as set SQL).
5. Results join back to documents on ``sig`` (AQE broadcasts the side when
   its runtime size is small, else sort-merge with skew splitting) and the
   null-parent suppression runs per document as map lookups. Roll-ups join
   ``document_classes`` instead: documents whose comparison is the same row
   for row are one class with its number of documents.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import names

COMPARISON_COLUMNS = [
    "catalog", "field_name", "db_field", "json_field", "status", "match_kind", "similarity", "category",
]


def _norm_a_sql(x: str, case_sensitive: bool = False) -> str:
    inner = f"translate(element_at(split({x}, '\\\\.'), -1), ' _-', '')"
    return inner if case_sensitive else f"lower({inner})"


# ---------------------------------------------------------------------------
# per-document profile
# ---------------------------------------------------------------------------

def write_order() -> Column:
    """Sort key of array-map entries (P6): in document order, but the own
    members of an array's element before what is nested in them; the last
    entry of a name wins."""
    above = F.slice("ord", 1, F.greatest(F.size("ord") - 1, F.lit(0)))
    return F.concat(above, F.array(F.lit(-1), F.element_at("ord", -1)))


def _array_members(root: dict, unit: int) -> list[tuple]:
    """The names inside the arrays of an object as (unit, place, name in lower
    case, array, depth, top, name), the place as in ``write_order``: objects
    are searched to any depth, from a work list; the elements of a list inside
    a list have no array."""
    found, todo = [], [(root, None, ())]
    while todo:
        obj, name, place = todo.pop()
        for i, (k, x) in enumerate(obj.items()):
            if name is not None:
                found.append((unit, (*place, -1, i), k.translate(_NO_MARKS).lower(), name, len(place) + 1, place[0], k))
            if isinstance(x, dict):
                todo.append((x, None, (*place, i)))
            elif isinstance(x, list):
                todo += [(e, k, (*place, i, j)) for j, e in enumerate(x) if isinstance(e, dict)]
    return found


_NO_MARKS = str.maketrans("", "", " _-.")
_NAMES = T.ArrayType(T.StringType())


@arrow_udf(T.StructType().add("k", _NAMES).add("a", _NAMES))
def _array_entries(texts: pa.Array) -> pa.Array:
    """Of the JSON texts of a key: the names and their arrays in the order of
    writing. In a root object's own arrays only the members of elements count."""
    ks, arrays = [], []
    for of_key in texts.to_pylist():
        found, tops = [], set()
        for data in map(json.loads, of_key):
            if isinstance(data, dict):
                tops.update(i for i, x in enumerate(data.values()) if isinstance(x, list))
            for i, x in enumerate(data if isinstance(data, list) else [data]):
                found += _array_members(x, i) if isinstance(x, dict) else []
        kept = sorted(e for e in found if e[4] == 3 or e[5] not in tops)
        ks.append([e[6] for e in kept])
        arrays.append([e[3] for e in kept])
    return pa.StructArray.from_arrays([pa.array(ks, pa.list_(pa.string())), pa.array(arrays, pa.list_(pa.string()))], ["k", "a"])


def array_maps(docs: DataFrame, key: str = "doc_id", v: str = "v") -> DataFrame:
    """(key, ``arr_map``): normalized field -> name of the array around it.

    In a root object the members of a direct array's elements belong to that
    array (what is nested in them is not looked at), and objects are searched
    to any depth (P6). In a root list every element is searched like that, in
    order, later elements overwriting earlier ones. A document is searched
    whole, not node by node; the rows of one key share the map of all their
    documents, and rows without a key have an empty one.
    """
    g = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.to_json(v)).alias("_texts"), F.count("*").cast("int").alias("_n"))
    g = g.withColumn("_e", _array_entries("_texts")).select(key, "_n", F.map_from_arrays(F.transform("_e.k", names.norm_array), "_e.a").alias("arr_map"))
    g = g.select(key, "arr_map", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select(key, "arr_map")
    none = docs.where(F.col(key).isNull()).select(key, F.create_map().cast("map<string,string>").alias("arr_map"))
    return g.unionByName(none)


def profile(n: DataFrame, keys: tuple[str, ...] = ("doc_id",), level: str = "file") -> DataFrame:
    """Per key: ``paths`` (sorted distinct), ``sig``, ``null_map``, ``arr_map``.

    ``level='file'``: null parents are the root object's members, or for a
    root array the first element's members (P5); the array map is the
    recursive map of a root object (P6, empty for root arrays).
    ``level='record'``: ``n`` is walked per record (keys include
    ``record_idx``); null parents are the record's members and the array map
    holds the record's direct arrays (P8, without the catalog part, which
    ``compare`` adds).
    """
    keys = list(keys)
    is_member_of_root = F.col("keyed") & (
        ((F.col("depth") == 1) & ~F.col("root_is_array"))
        | ((F.col("depth") == 2) & F.col("root_is_array") & (F.col("unit") == 0))
    )
    if level == "record":
        is_member_of_root = F.col("keyed") & (
            (F.col("depth") == 1) & ~F.col("root_is_array") | (F.col("depth") == 2) & F.col("root_is_array")
        )
    is_null = (F.col("kind") == "null") | (
        (F.col("kind") == "array") & (F.expr("size(try_variant_get(v, '$', 'array<struct<>>'))") == 0)
    )
    # document order where the walk has it (the last entry of a name wins), else path order
    order = F.struct(F.coalesce("unit", F.lit(0)), write_order()) if "ord" in n.columns and "unit" in n.columns else F.col("path")
    if level == "file":
        arr_entry = F.when(
            F.col("p6") & F.col("par_arr").isNotNull() & F.col("keyed"),
            F.struct(order.alias("o"), names.norm_array("key").alias("k"), names.norm_category("par_arr").alias("a")),
        )
    else:
        # direct arrays of the record: members of objects that are elements
        # of an array that is itself a member of the record
        rec_depth = F.when(F.col("root_is_array"), F.lit(1)).otherwise(F.lit(0))
        arr_entry = F.when(
            F.col("keyed") & F.col("par_arr").isNotNull() & (F.col("depth") == rec_depth + 3),
            F.struct(order.alias("o"), names.norm_array("key").alias("k"), names.norm_category("par_arr").alias("a")),
        )
    agg = n.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("keyed") & F.col("p1"), F.col("path")))).alias("paths"),
        F.array_sort(
            F.collect_list(F.when(is_member_of_root, F.struct(F.col("key").alias("o"), names.norm_category("key").alias("k"), is_null.alias("n"))))
        ).alias("_np"),
        F.array_sort(F.collect_list(arr_entry)).alias("_ap"),
        F.collect_list(F.when(is_member_of_root, names.norm_array("key"))).alias("rec_keys"),
    )
    return agg.select(
        *keys,
        "paths",
        F.sha2(F.array_join("paths", "\u0001"), 256).alias("sig"),
        F.map_from_arrays(F.col("_np.k"), F.col("_np.n")).alias("null_map"),
        F.map_from_arrays(F.col("_ap.k"), F.col("_ap.a")).alias("arr_map"),
        "rec_keys",
        # a name inside arrays of different names: which one wins depends on the document, not on its shape
        (F.size(F.array_distinct(F.transform("_ap", lambda e: F.struct(e["k"], e["a"])))) > F.size(F.array_distinct("_ap.k"))).alias("order_counts"),
    )


def record_units(u: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records of documents with more than one record, numbered from 1."""
    from .walk import number_records

    r = number_records(u, key)
    multi = r.groupBy(key).agg(F.count("*").alias("_nrec")).where("_nrec > 1")
    return r.join(multi.select(key), key, "left_semi")


# ---------------------------------------------------------------------------
# catalog and signatures as relations
# ---------------------------------------------------------------------------

def catalog_names(catalog: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Per (catalog, normalized name ``dn``): its first ordinal, the original
    name shown (the last one wins), its number of rows and its category (J10:
    per field the last category; of fields with one normalized name the one
    that first appears last)."""
    c = catalog.withColumn("dn", names.norm_compare("field", case_sensitive))
    known = c.groupBy("catalog", "dn").agg(
        F.min("ordinal").alias("dfirst"), F.max_by("field", "ordinal").alias("orig"), F.count("*").alias("copies"))
    cats = (
        c.where(~F.col("is_category") & F.col("category").isNotNull())
        .groupBy("catalog", "dn", "field").agg(F.max_by("category", "ordinal").alias("category"), F.min("ordinal").alias("o"))
        .groupBy("catalog", "dn").agg(F.max_by("category", "o").alias("cat"))
    )
    return known.join(cats, ["catalog", "dn"], "left")


def signatures(prof: DataFrame) -> DataFrame:
    """The distinct path sets (sig, paths) of a profile."""
    from ..session import materialize

    # distinct rows need no aggregate buffer, so the documents pass a hash aggregate and are not sorted
    return materialize(prof.select("sig", "paths").distinct().groupBy("sig").agg(F.first("paths").alias("paths")))


def signature_names(sigs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Per (sig, normalized name ``jn``): the path shown (the last one wins),
    the place of its first path and its number of paths."""
    each = sigs.select("sig", F.posexplode("paths").alias("pos", "path"))
    return each.groupBy("sig", names.norm_compare("path", case_sensitive).alias("jn")).agg(
        F.max_by("path", "pos").alias("jorig"), F.min("pos").cast("int").alias("jfirst"), F.count("*").alias("jcopies"))


def _every_catalog(sigs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(catalog, sig): every signature is compared with every catalog."""
    cats = catalog.agg(F.collect_set("catalog").alias("_cats")).withColumn("_one", F.lit(1))
    return sigs.withColumn("_one", F.lit(1)).join(cats, "_one").select(F.explode("_cats").alias("catalog"), "sig")


# ---------------------------------------------------------------------------
# fuzzy pass
# ---------------------------------------------------------------------------

def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy one-to-one assignment for one (catalog, sig) group.

    Catalog names in ordinal order; each takes the best still-unused JSON name
    (highest ratio, first in path order on ties). Pairs below the threshold
    were removed upstream, which cannot change the outcome.
    """
    used: set[str] = set()
    out = []
    pdf = pdf.sort_values(["dfirst", "jfirst"])
    for dn, g in pdf.groupby("dfirst", sort=True):
        best = None
        for r in g.itertuples(index=False):
            if r.jn in used:
                continue
            if best is None or r.ratio > best.ratio:
                best = r
        if best is not None:
            used.add(best.jn)
            out.append((best.catalog, best.sig, best.dn, best.jn, float(best.ratio)))
    return pd.DataFrame(out, columns=["catalog", "sig", "dn", "jn", "ratio"])


def _similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(catalog, dn, jn, ratio) of the names of ``left(catalog, dn)`` and
    ``right(catalog, jn)`` whose ratio is positive and reaches the threshold.

    Only lengths that can reach it meet: ratio <= 2 min / (la + lb).
    """
    d = left.select("catalog", "dn").distinct().withColumn("dl", F.length("dn"))
    j = right.select("catalog", "jn").distinct().withColumn("jl", F.length("jn"))
    lengths = d.select("catalog", "dl").distinct().join(j.select("catalog", "jl").distinct(), "catalog").where(
        2 * F.least("dl", "jl") >= F.lit(threshold - 1e-9) * (F.col("dl") + F.col("jl")))
    pairs = d.join(lengths, ["catalog", "dl"]).join(j, ["catalog", "jl"]).where(F.col("dn") != F.col("jn"))
    return pairs.withColumn("ratio", _ratio_col("dn", "jn")).where((F.col("ratio") >= threshold) & (F.col("ratio") > 0)).select(
        "catalog", "dn", "jn", "ratio")


def _ratio_col(a: str, b: str) -> Column:
    from ..functions.similarity import sequence_ratio

    return sequence_ratio(F.col(a), F.col(b))


# ---------------------------------------------------------------------------
# compare
# ---------------------------------------------------------------------------

def match_signatures(prof: DataFrame, catalog: DataFrame, fuzzy: bool = True, threshold: float = 0.8,
                     case_sensitive: bool = False) -> DataFrame:
    """Per (catalog, sig): ``rows``, the comparison rows before null-parent
    handling, each with the catalog category of its name (``cat``)."""
    from ..session import materialize

    sigs = signatures(prof)
    known = materialize(catalog_names(catalog, case_sensitive))
    found = signature_names(sigs, case_sensitive)
    pairs = _every_catalog(sigs.select("sig"), known)
    c = pairs.join(known, "catalog").join(found.withColumnRenamed("jn", "dn"), ["sig", "dn"], "left")
    j = pairs.join(found, "sig").join(known.select("catalog", F.col("dn").alias("jn")), ["catalog", "jn"], "left_anti")
    exact = F.col("jorig").isNotNull()
    resid = c.where(~exact).select("catalog", "sig", "dn", "dfirst", "orig", "copies", "cat")
    if fuzzy:
        resid, j = materialize(resid), materialize(j)
        cand = resid.join(_similar(resid, j, threshold), ["catalog", "dn"]).join(j, ["catalog", "sig", "jn"])
        taken = cand.select("catalog", "sig", "dn", "dfirst", "jn", "jfirst", "ratio").groupBy("catalog", "sig").applyInPandas(
            _greedy, "catalog string, sig string, dn string, jn string, ratio double")
        taken = materialize(taken)
    else:
        taken = resid.select("catalog", "sig", "dn", F.lit(None).cast("string").alias("jn"), F.lit(0.0).alias("ratio")).limit(0)
    none = F.lit(None)

    def row(df, dn, jn, field, db, json_field, status, kind, sim, category, cat):
        return df.select("catalog", "sig", F.struct(
            dn.alias("dn"), jn.alias("jn"), field.alias("field_name"), db.alias("db_field"), json_field.alias("json_field"),
            F.lit(status).alias("status"), F.lit(kind).alias("match_kind"), sim.cast("double").alias("similarity"),
            category.cast("string").alias("category"), cat.alias("cat")).alias("r"))

    dn, jn, orig, jorig, cat = (F.col(x) for x in ("dn", "jn", "orig", "jorig", "cat"))
    text = none.cast("string")
    fz = resid.join(taken, ["catalog", "sig", "dn"]).join(found.select("sig", "jn", "jorig"), ["sig", "jn"])
    gone = resid.join(taken.select("catalog", "sig", "dn"), ["catalog", "sig", "dn"], "left_anti")
    extra = j.join(taken.select("catalog", "sig", "jn"), ["catalog", "sig", "jn"], "left_anti")
    rows = (
        row(c.where(exact), dn, dn, orig, orig, jorig, "matched", "exact", none, none, cat)
        .unionByName(row(fz, dn, jn, orig, orig, jorig, "matched", "fuzzy", F.col("ratio"), none, cat))
        # a catalog name listed twice is missing twice, a name with two paths is extra twice
        .unionByName(row(gone.withColumn("_k", F.explode(F.sequence(F.lit(1), "copies"))), dn, text, orig, orig, F.lit(""),
                         "missing", "not_found", none, F.coalesce("cat", F.lit("")), cat))
        .unionByName(row(extra.withColumn("_k", F.explode(F.sequence(F.lit(1), "jcopies"))), text, jn, jorig, F.lit(""), jorig,
                         "extra", "not_found", none, none, text))
    )
    return rows.groupBy("catalog", "sig").agg(F.collect_list("r").alias("rows"))


def document_classes(prof: DataFrame) -> DataFrame:
    """Documents with the same path set, null parents and array parents: one
    row with ``class_id`` and their number ``n``. Their comparison is the same
    row for row, so roll-ups weight a class's rows by ``n``."""
    return with_class(prof).groupBy("class_id").agg(F.count("*").alias("n"), *[
        F.first(c).alias(c) for c in ("sig", "paths", "null_map", "arr_map", "rec_keys")])


def with_class(prof: DataFrame) -> DataFrame:
    same = F.concat_ws("\u0001", "sig", F.to_json("null_map"), F.to_json("arr_map"))
    return prof.withColumn("class_id", F.sha2(same, 256))


def first_documents(prof: DataFrame, key: str = "doc_id", first: int = 10) -> DataFrame:
    """(class_id, docs): the first document names of each class, sorted."""
    from .rollup import first_k

    named = with_class(prof).select("class_id", F.col(key).cast("string").alias("doc")).distinct()
    return first_k(named, ["class_id"], "doc", first).groupBy("class_id").agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def compare(prof: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ("doc_id",), fuzzy: bool = True,
            threshold: float = 0.8, case_sensitive: bool = False, emit_suppressed: bool = False,
            record_level: bool = False) -> DataFrame:
    """J6 (and J7 with ``record_level``): the comparison table.

    Output: ``*keys, catalog, field_name, db_field, json_field, status
    ('matched'|'missing'|'extra'[|'suppressed']), match_kind ('exact'|'fuzzy'|
    'not_found'), similarity, category``.

    Null-parent rule (J5): a matched pair whose array parent (or, without an
    array parent, whose catalog category) is null or ``[]`` in the document
    is dropped; a missing field with a null array parent is dropped only when
    it has no category in the catalog.
    """
    from ..session import materialize

    keys = list(keys)
    # written once, so that its size is known before the join: few path sets are sent to the documents, which else
    # meet by path set, most of them in one task
    ms = materialize(match_signatures(prof, catalog, fuzzy, threshold, case_sensitive))
    d = prof.select(*keys, "sig", "null_map", "arr_map", "rec_keys").join(ms, "sig")
    x = d.select(*keys, "catalog", "null_map", "arr_map", "rec_keys", F.explode("rows").alias("r"))
    arr = F.when(F.col("r.dn").isNotNull(), F.expr("try_element_at(arr_map, r.dn)"))
    if record_level:
        # Catalog field -> category where the record has a member whose
        # name equals the category after normalization; the record's own
        # arrays take precedence.
        cat_raw = F.col("r.cat")
        cat_arr = F.when(
            cat_raw.isNotNull()
            & F.array_contains(F.col("rec_keys"), names.norm_array(cat_raw)),
            names.norm_category(cat_raw),
        )
        arr = F.coalesce(arr, F.when(F.col("r.dn").isNotNull(), cat_arr))
    x = x.withColumn("_arr", arr)
    x = x.withColumn("_cat", F.col("r.cat"))
    has_arr = F.col("_arr").isNotNull() & (F.col("_arr") != "")
    arr_null = has_arr & F.coalesce(F.expr("try_element_at(null_map, _arr)"), F.lit(False))
    cat_null = (
        F.col("_cat").isNotNull() & (F.col("_cat") != "") & ~has_arr
        & F.coalesce(F.expr("try_element_at(null_map, lower(translate(_cat, ' _-', '')))"), F.lit(False))
    )
    suppressed = F.when(F.col("r.status") == "matched", arr_null | cat_null).when(
        F.col("r.status") == "missing", (arr_null | cat_null) & F.col("_cat").isNull()
    ).otherwise(F.lit(False))
    x = x.withColumn("_sup", suppressed)
    if emit_suppressed:
        status = F.when(F.col("_sup"), F.lit("suppressed")).otherwise(F.col("r.status"))
    else:
        x = x.where(~F.col("_sup"))
        status = F.col("r.status")
    return x.select(
        *keys, "catalog", F.col("r.field_name").alias("field_name"), F.col("r.db_field").alias("db_field"),
        F.col("r.json_field").alias("json_field"), status.alias("status"), F.col("r.match_kind").alias("match_kind"),
        F.col("r.similarity").alias("similarity"), F.col("r.category").alias("category"),
    )


def mapping_suggestions(prof: DataFrame, catalog: DataFrame, threshold: float = 0.8,
                        case_sensitive: bool = False) -> DataFrame:
    """Per (catalog, sig, catalog name): exact name if present, else the
    best fuzzy name >= threshold (not one-to-one; ties: first in path order).
    """
    from ..session import materialize

    sigs = signatures(prof)
    known = catalog_names(catalog, case_sensitive)
    found = signature_names(sigs, case_sensitive)
    pairs = _every_catalog(sigs.select("sig"), known)
    c = materialize(pairs.join(known, "catalog").join(found.select("sig", F.col("jn").alias("dn"), "jfirst"), ["sig", "dn"], "left"))
    exact = c.where("jfirst IS NOT NULL").select(
        "catalog", "sig", "dn", F.col("dn").alias("suggestion"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("match_kind"))
    resid = c.where("jfirst IS NULL").select("catalog", "sig", "dn")
    j = pairs.join(found, "sig").select("catalog", "sig", "jn", "jfirst")
    scored = resid.join(_similar(resid, j, threshold), ["catalog", "dn"]).join(j, ["catalog", "sig", "jn"])
    best = scored.groupBy("catalog", "sig", "dn").agg(
        F.max_by(F.struct("jn", "ratio"), F.struct(F.col("ratio"), -F.col("jfirst"))).alias("b")
    ).select("catalog", "sig", "dn", F.col("b.jn").alias("suggestion"), F.col("b.ratio").alias("similarity"),
             F.lit("fuzzy").alias("match_kind"))
    return exact.unionByName(best)


# ---------------------------------------------------------------------------
# Shape-deduplicated profile
# ---------------------------------------------------------------------------

def _members_sql(v: str, level: str) -> str:
    """MAP<STRING,VARIANT> of the members that decide null parents."""
    obj = f"try_variant_get({v}, '$', 'map<string,variant>')"
    if level == "record":
        return obj
    return f"coalesce({obj}, try_variant_get({v}, '$[0]', 'map<string,variant>'))"


def _root_entries_sql(v: str, level: str) -> str:
    m = _members_sql(v, level)
    return (
        f"array_sort(transform(map_entries(coalesce({m}, map())), e -> named_struct("
        f"'o', e.key, 'k', lower(translate(e.key, ' _-', '')), "
        f"'n', is_variant_null(e.value) OR coalesce(size(try_variant_get(e.value, '$', 'array<struct<>>')) = 0, false))))"
    )


def root_maps(df: DataFrame, v: str = "v", level: str = "file") -> DataFrame:
    """Per row: ``null_map`` (P5) and ``rec_keys`` from the root members,
    computed natively without a walk."""
    ents = _root_entries_sql(v, level)
    return (
        df.withColumn("_ents", F.expr(ents))
        .withColumn("null_map", F.map_from_arrays(F.col("_ents.k"), F.col("_ents.n")))
        .withColumn("rec_keys", F.transform(F.col("_ents.o"), lambda k: names.norm_array(k)))
        .drop("_ents")
    )


def shape_profile(u: DataFrame, keys: tuple[str, ...], level: str = "file", content: str | None = None) -> DataFrame:
    """The ``profile`` of walk units, walking one unit per distinct shape.

    Field paths and array-parent maps depend only on a document's Variant
    schema when that schema has no mixed-type (``VARIANT``) parts, so units
    are keyed by ``schema_of_variant`` and only one representative per shape
    is walked (the shape grouping is a partial/final hash aggregate, so a
    shape shared by most documents never gathers in one task). Units with
    mixed-type parts are walked in full. Null-parent maps depend on values
    and are computed per row from the root members.

    ``u``: unit rows ``*keys, root_is_array, unit, v`` (file level: one row
    per document). With ``content`` (the JSON text column of ``u``) the
    materialized per-document table keeps the text instead of the parsed
    value, and only representatives and mixed-shape units are parsed again.
    """
    from ..session import materialize
    from . import walk

    keys = list(keys)
    # Root-member null checks depend on values only where the shape cannot
    # tell: a root array (first element decides) or an array typed
    # ARRAY<VOID> (empty, or holding nulls only). Elsewhere a member is null
    # exactly when it is typed VOID, so the representative's map is exact.
    sh = u.withColumn("_shape", F.expr("schema_of_variant(v)"))
    per_row = F.col("_shape").contains("ARRAY<VOID>")
    if level != "record":
        per_row = per_row | F.col("_shape").startswith("ARRAY<")
    m_ents = _root_entries_sql("v", level)
    base = sh.withColumn("_ents", F.when(per_row, F.expr(m_ents))).withColumn(
        "null_map", F.when(per_row, F.map_from_arrays(F.col("_ents.k"), F.col("_ents.n")))
    ).withColumn("rec_keys", F.when(per_row, F.transform(F.col("_ents.o"), lambda k: names.norm_array(k)))).drop("_ents")
    body = [content] if content else ["v"]
    s = materialize(base.select(*keys, "root_is_array", "unit", "_shape", "null_map", "rec_keys", *body))
    plain = F.col("_shape").contains("VARIANT")

    def value(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.expr(f"parse_json({content})")).drop(content) if content else df

    # one representative unit per shape: its smallest hash is a number, so that
    # all units pass a hash aggregate and no text is sorted
    s = s.withColumn("_at", F.xxhash64(*keys, "unit"))
    least = s.where(~plain).groupBy("_shape").agg(F.min("_at").alias("_at"))
    reps = value(
        s.where(~plain).join(F.broadcast(materialize(least)), ["_shape", "_at"], "left_semi").groupBy("_shape")
        .agg(F.min_by(F.struct("root_is_array", "unit", *body), F.struct(*keys)).alias("r"))
        .select("_shape", "r.*")
    )
    s = s.drop("_at")
    rep_units = reps if level == "record" else walk.units(reps.select("_shape", "v"), key="_shape")
    rn = walk.nodes_by_depth(rep_units, ("_shape", "unit"), with_order=True)
    rp = materialize(profile(rn, ("_shape",), level=level).select(
        "_shape", "paths", "sig", "arr_map", F.col("null_map").alias("_rnm"), F.col("rec_keys").alias("_rrk"), "order_counts"))
    fast = s.where(~plain).select(*keys, "_shape", "null_map", "rec_keys").join(rp.where("NOT order_counts"), "_shape").select(
        *keys, "paths", "sig", F.coalesce("null_map", "_rnm").alias("null_map"), "arr_map",
        F.coalesce("rec_keys", "_rrk").alias("rec_keys"),
    )
    # mixed-type shapes, and those with a name inside arrays of different names: full walk
    mixed = s.where(plain).unionByName(s.where(~plain).join(rp.where("order_counts").select("_shape"), "_shape", "left_semi").select(*s.columns))
    if mixed.isEmpty():
        return fast
    mixed = value(mixed.drop("_shape", "null_map", "rec_keys"))
    mu = mixed if level == "record" else walk.units(mixed.select(*keys, "v"), key=keys[0])
    mk = tuple(keys) + (() if level == "record" else ("unit",))
    slow = profile(walk.nodes_by_depth(mu, mk if "unit" in mk else (*mk, "unit"), with_order=True), tuple(keys), level=level)
    out = fast.unionByName(slow.select(*keys, "paths", "sig", "null_map", "arr_map", "rec_keys"))
    # heterogeneous corpora: keep the walked profile instead of walking again
    return materialize(out)
