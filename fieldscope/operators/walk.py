"""The document walk: one row per JSON node, built with a recursive CTE.

Every operator that looks inside documents (field paths, null parents, array
parents, depth, blank strings, value lookups) is a filter or aggregate over
the node table this module builds, so each document is parsed and walked once.

Plan shape: ``parse_json`` in a projection, ``variant_explode`` of root arrays
into *units* (records), an optional repartition on ``(doc_id, unit)`` so a
document with many records spreads over tasks, then one recursive CTE whose
iterations are one nesting level each. Spark caches each iteration's rows and
keeps lineage, so a lost executor only recomputes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure

# Cheap type probes: casting to an empty struct / array of empty structs
# extracts no fields, so they cost O(1) per value beyond the header check.
_IS_OBJ = "try_variant_get({v}, '$', 'struct<>') IS NOT NULL"
_ARR = "try_variant_get({v}, '$', 'array<struct<>>')"


def kind_sql(v: str) -> str:
    return (
        f"CASE WHEN {_IS_OBJ.format(v=v)} THEN 'object' "
        f"WHEN {_ARR.format(v=v)} IS NOT NULL THEN 'array' "
        f"WHEN is_variant_null({v}) THEN 'null' ELSE 'scalar' END"
    )


def has_obj_sql(v: str) -> str:
    return f"coalesce(exists({_ARR.format(v=v)}, e -> e IS NOT NULL), false)"


def parse(df: DataFrame, content: str = "content", out: str = "v", strict_dups: bool = False) -> DataFrame:
    """Add a VARIANT column parsed from ``content`` (NULL when unparseable)."""
    return df.withColumn(out, F.expr(f"try_parse_json({content})"))


def units(docs: DataFrame, v: str = "v", key: str = "doc_id", spread: int | None = None) -> DataFrame:
    """Split documents into walk units.

    A root array becomes one unit per element (``unit`` = 0-based position,
    ``root_is_array`` true); any other root is a single unit with ``unit`` NULL.
    One projection and one generator: the document is parsed once.
    ``spread`` repartitions units on ``(key, unit)`` so that the records of a
    large document are walked by many tasks.
    """
    cols = [c for c in docs.columns if c != v]
    arr = f"try_variant_get(`{v}`, '$', 'array<variant>')"
    # An empty root array stays one unit (the array itself) so that the
    # document is still seen downstream (it has no paths, every expected
    # field is missing).
    # The outer generator lets no filter on the elements be inferred below it,
    # which would parse every document once more.
    d = docs.select(
        *cols,
        F.expr(f"coalesce(size({arr}) > 0, false)").alias("root_is_array"),
        F.expr(f"CASE WHEN size({arr}) > 0 THEN {arr} WHEN `{v}` IS NOT NULL THEN array(`{v}`) END").alias("_elems"),
    )
    u = d.select(*cols, "root_is_array", F.posexplode_outer("_elems").alias("unit", "v")).where("unit IS NOT NULL").withColumn(
        "unit", F.when(F.col("root_is_array"), F.col("unit").cast("int"))
    )
    if spread:
        u = u.repartition(spread, key, "unit")
    return u


def number_records(u: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``record_idx``: 1-based rank of object units within a document.

    A root object is record 1. The window holds one row per record (not per
    node), and the record count of one document is bounded by the size of a
    single row.
    """
    from pyspark.sql import Window

    objs = u.where(F.expr(_IS_OBJ.format(v="v")))
    w = Window.partitionBy(key).orderBy(F.col("unit").asc_nulls_first())
    return objs.withColumn("record_idx", F.row_number().over(w))


def nodes(u: DataFrame, keys: list[str] | tuple[str, ...] = ("doc_id", "unit"), with_vpath: bool = False,
          levels: int | None = None, with_order: bool = False) -> DataFrame:
    """Walk every unit to all of its nodes. ``levels`` is an upper bound of
    the nesting depth, for the recursive walk; without it units are walked by
    ``nodes_by_depth``, which shuffles no nodes between levels.

    Columns: ``*keys, root_is_array, path, key, pos, v, depth, kind, keyed,
    p1, p6, arr_key, par_arr[, vpath]``.

    * ``path``: dotted path, positions erased; children of an empty path get no
      dot prefix.
    * ``p1``: node is reached by the field-path rules (a keyed array is entered
      only when some direct element is an object).
    * ``p6``/``arr_key``/``par_arr``: array-parent bookkeeping. ``arr_key`` is
      set on objects that are direct elements of a keyed array; ``par_arr`` is
      set on the members of such objects.
    * ``op``: every container above the node is an object (object-only key
      listing, P4).
    * ``fst``: node is reached when every array on the way is entered at its
      first element and that element is an object (dotted-path lookup, P10).
    * ``depth``: containers above the node in the original document (a unit
      of a root array starts at depth 1).
    * ``ord`` (``with_order``): places of the node and of the nodes above it,
      so that sorting by it gives document order.
    """
    spark = u.sparkSession
    configure(spark)
    keys = list(keys)
    if levels is None:
        return nodes_by_depth(u, keys, with_vpath, with_order)
    view = f"_fs_walk_src_{uuid.uuid4().hex}"
    u.createOrReplaceTempView(view)
    kcols = ", ".join(f"`{k}`" for k in keys)
    wk = ", ".join(f"w.`{k}`" for k in keys)
    vcol_a = ", CASE WHEN root_is_array THEN concat('root[', unit, ']') ELSE 'root' END" if with_vpath else ""
    vcol_r = (
        ", CASE WHEN x.key IS NULL THEN concat(w.vpath, '[', x.pos, ']') ELSE concat(w.vpath, '.', x.key) END"
        if with_vpath else ""
    )
    vname = ", vpath" if with_vpath else ""
    if with_order:
        vcol_a += ", CAST(array() AS ARRAY<INT>)"
        vcol_r += ", concat(w.ord, array(x.pos))"
        vname += ", ord"
    xk = kind_sql("x.value")
    # The child's type is computed once in the inner select and reused by
    # every flag in the outer one.
    sql = f"""
WITH RECURSIVE w({kcols}, root_is_array, path, key, pos, v, depth, kind, has_obj, keyed, p1, p6, fst, op, arr_key, par_arr{vname})
MAX RECURSION LEVEL {int(levels) + 2} AS (
  SELECT {kcols}, root_is_array, '', CAST(NULL AS STRING), CAST(coalesce(unit, 0) AS INT), v,
         CASE WHEN root_is_array THEN 1 ELSE 0 END,
         {kind_sql('v')}, {has_obj_sql('v')}, false, true,
         (NOT root_is_array) AND {_IS_OBJ.format(v='v')}, true, NOT root_is_array,
         CAST(NULL AS STRING), CAST(NULL AS STRING){vcol_a}
  FROM {view}
  UNION ALL
  SELECT {", ".join("c.`" + k + "`" for k in keys)}, c.root_is_array,
         CASE WHEN c.xkey IS NULL THEN c.path WHEN c.path = '' THEN c.xkey ELSE concat(c.path, '.', c.xkey) END,
         c.xkey, c.xpos, c.xv, c.depth + 1,
         c.xk, CASE WHEN c.xk = 'array' THEN {has_obj_sql('c.xv')} ELSE false END, c.xkey IS NOT NULL,
         c.p1 AND (c.kind = 'object' OR NOT c.keyed OR c.has_obj),
         c.p6 AND (c.kind = 'object' OR (c.keyed AND c.xk = 'object')),
         c.fst AND (c.kind = 'object' OR (c.xpos = 0 AND c.xk = 'object')),
         c.op AND c.kind = 'object',
         CASE WHEN c.kind = 'array' AND c.keyed AND c.xk = 'object' THEN c.key END,
         CASE WHEN c.xkey IS NOT NULL THEN c.arr_key END{vcol_r.replace("x.key", "c.xkey").replace("x.pos", "c.xpos").replace("w.vpath", "c.vpath").replace("w.ord", "c.ord")}
  FROM (SELECT w.*, x.key AS xkey, x.pos AS xpos, x.value AS xv, {xk} AS xk
        FROM w, LATERAL variant_explode(w.v) x
        WHERE w.kind IN ('object', 'array')) c
)
SELECT * FROM w
"""
    return spark.sql(sql)


def object_keys(n: DataFrame, keys: list[str] | tuple[str, ...] = ("doc_id",), nested: bool = True) -> DataFrame:
    """Keys reached through objects only (arrays are not entered), one
    row per occurrence; ``nested=False`` keeps the root object's own keys."""
    out = n.where("keyed AND op" + ("" if nested else " AND depth = 1"))
    return out.select(*keys, "path", "depth")


def field_paths(n: DataFrame, keys: list[str] | tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Distinct field paths per key (a set; sort at the consumer)."""
    return n.where("keyed AND p1").select(*keys, "path").distinct()


# ---------------------------------------------------------------------------
# Level-chained walk (one pipelined stage, no per-level jobs)
# ---------------------------------------------------------------------------

# String literals (unrolled, possessive: no backtracking stack on long text).
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def text_depth(content: str = "content") -> Column:
    """Bracket nesting depth of JSON text, string literals ignored.

    An upper bound of the expansion levels a document needs (a level more
    than needed only when the deepest containers are empty).
    """
    return text_depth_of(F.col(content))


def text_depth_of(text: Column) -> Column:
    return _bracket_depth(F.regexp_replace(F.regexp_replace(text, _JSON_STRING, ""), r"[^\[\]{}]", ""))


def _bracket_depth(brackets: Column) -> Column:
    def step(a, x):
        c = a["c"] + F.when(x.isin("[", "{"), 1).otherwise(-1)
        return F.struct(c.alias("c"), F.greatest(a["m"], c).alias("m"))

    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("c"), F.lit(0).alias("m")), step, lambda a: a["m"])


def value_depth(v: str = "v", shape: str = "_schema") -> Column:
    """Nesting depth of a parsed value: that of its schema (``shape``), where types
    do not mix (field names that hold brackets are quoted there), else of its text."""
    shape = F.col(shape)
    opened = F.translate(F.regexp_replace(F.regexp_replace(shape, "`[^`]*+`", ""), "[^<>]++", ""), "<>", "[]")
    return F.when(shape.contains("VARIANT"), text_depth_of(F.to_json(v))).otherwise(_bracket_depth(opened))


_SELF = "named_struct('s', true, 'k', CAST(NULL AS STRING), 'p', 0, 'val', CAST(NULL AS VARIANT))"
_KIDS = (
    "CASE WHEN kind = 'object' THEN transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), "
    "(e, i) -> named_struct('s', false, 'k', e.key, 'p', i, 'val', e.value)) "
    "ELSE transform(try_variant_get(v, '$', 'array<variant>'), "
    "(e, i) -> named_struct('s', false, 'k', CAST(NULL AS STRING), 'p', i, 'val', e)) END"
)


def nodes_chain(u: DataFrame, levels: int, keys: list[str] | tuple[str, ...] = ("doc_id", "unit"),
                with_vpath: bool = False, with_order: bool = False, only: str | None = None) -> DataFrame:
    """The same node table as ``nodes``, built as ``levels`` chained
    generators in one pipelined stage.

    Each level re-emits every row once (marked expanded) plus the children
    of not-yet-expanded containers, so nothing is recomputed and no level
    needs its own job. ``levels`` must be at least the nesting depth (see
    ``text_depth``); rows still pending after the last level make the query
    fail rather than return a partial walk. ``only``: a flag (``p1``, ``p6``,
    ``fst``, ``op``) that all wanted nodes have; what lies below a node without
    it has none either, so neither is emitted.
    """
    keys = list(keys)
    base = u.selectExpr(
        *[f"`{k}`" for k in keys], "root_is_array", "'' AS path", "CAST(NULL AS STRING) AS key",
        "CAST(coalesce(unit, 0) AS INT) AS pos", "v", "CASE WHEN root_is_array THEN 1 ELSE 0 END AS depth",
        f"{kind_sql('v')} AS kind", "false AS keyed", "true AS p1",
        f"(NOT root_is_array) AND {_IS_OBJ.format(v='v')} AS p6", "true AS fst",
        "NOT root_is_array AS op", "CAST(NULL AS STRING) AS arr_key", "CAST(NULL AS STRING) AS par_arr",
        *(["CASE WHEN root_is_array THEN concat('root[', unit, ']') ELSE 'root' END AS vpath"] if with_vpath else []),
        *(["CAST(array() AS ARRAY<INT>) AS ord"] if with_order else []),
        "false AS done",
    )
    base = base.withColumn("has_obj", F.expr(f"kind = 'array' AND {has_obj_sql('v')}"))
    cols = [c for c in base.columns]
    rows = base
    kc = [f"`{k}`" for k in keys]
    for _ in range(int(levels)):
        x = rows.selectExpr(
            *cols,
            f"explode(CASE WHEN NOT done AND kind IN ('object', 'array') THEN concat(array({_SELF}), {_KIDS}) "
            f"ELSE array({_SELF}) END) AS c",
        )
        x = x.selectExpr("*", f"CASE WHEN c.s THEN kind ELSE {kind_sql('c.val')} END AS ck")
        child = "NOT c.s"
        rows = x.selectExpr(
            *kc, "root_is_array",
            f"CASE WHEN c.s THEN path WHEN c.k IS NULL THEN path WHEN path = '' THEN c.k ELSE concat(path, '.', c.k) END AS path",
            "CASE WHEN c.s THEN key ELSE c.k END AS key",
            "CASE WHEN c.s THEN pos ELSE c.p END AS pos",
            # an expanded container keeps its value only while it may still be
            # read (empty-array and scalar checks use leaves and empty containers)
            "CASE WHEN c.s THEN v ELSE c.val END AS v",
            "CASE WHEN c.s THEN depth ELSE depth + 1 END AS depth",
            "ck AS kind",
            "CASE WHEN c.s THEN keyed ELSE c.k IS NOT NULL END AS keyed",
            f"CASE WHEN c.s THEN p1 ELSE p1 AND (kind = 'object' OR NOT keyed OR has_obj) END AS p1",
            f"CASE WHEN c.s THEN p6 ELSE p6 AND (kind = 'object' OR (keyed AND ck = 'object')) END AS p6",
            f"CASE WHEN c.s THEN fst ELSE fst AND (kind = 'object' OR (c.p = 0 AND ck = 'object')) END AS fst",
            "CASE WHEN c.s THEN op ELSE op AND kind = 'object' END AS op",
            f"CASE WHEN c.s THEN arr_key WHEN kind = 'array' AND keyed AND ck = 'object' THEN key END AS arr_key",
            f"CASE WHEN c.s THEN par_arr WHEN c.k IS NOT NULL THEN arr_key END AS par_arr",
            *([f"CASE WHEN c.s THEN vpath WHEN c.k IS NULL THEN concat(vpath, '[', c.p, ']') "
               f"ELSE concat(vpath, '.', c.k) END AS vpath"] if with_vpath else []),
            *(["CASE WHEN c.s THEN ord ELSE concat(ord, array(c.p)) END AS ord"] if with_order else []),
            "c.s AS done",
            f"CASE WHEN c.s THEN has_obj ELSE ck = 'array' AND {has_obj_sql('c.val')} END AS has_obj",
        )
        if only:
            rows = rows.where(f"done OR {only}")
    # a container still holding unexpanded children means ``levels`` was too small
    pending = F.expr(
        "NOT done AND ((kind = 'object' AND size(map_keys(try_variant_get(v, '$', 'map<string,variant>'))) > 0) "
        "OR (kind = 'array' AND size(try_variant_get(v, '$', 'array<struct<>>')) > 0))"
    )
    guard = F.when(pending, F.raise_error(F.lit("document nesting exceeds the walk depth"))).otherwise(F.lit(None))
    return rows.where(guard.isNull()).drop("done")


# Depth classes: documents of one class share a chained plan of that many
# levels; deeper ones go through the recursive walk.
DEPTH_CLASSES = (4, 8, 16, 32)


def nodes_by_depth(u: DataFrame, keys: list[str] | tuple[str, ...] = ("doc_id", "unit"), with_vpath: bool = False,
                   with_order: bool = False, only: str | None = None) -> DataFrame:
    """The node table with every unit walked by a plan of its own depth class,
    so that one deep document neither lengthens the plan of the others nor
    meets a limit. ``only``: a flag that all wanted nodes have; the others are
    left out."""
    from ..session import materialize

    # a scalar root has depth 0, and a unit below a root array is one level down already
    cls = F.coalesce(*[F.when(F.col("_depth") <= c, F.lit(c)) for c in DEPTH_CLASSES], F.lit(-1))
    # computed once: the classes are read from the written units, and so is the walk of each
    d = materialize(u.withColumn("_schema", F.expr("schema_of_variant(v)")).withColumn("_depth", value_depth("v", "_schema")).withColumn("_class", cls).drop("_schema"))
    present = {r["_class"]: r["d"] for r in d.groupBy("_class").agg(F.max("_depth").alias("d")).collect()}
    if not present:
        return nodes_chain(u, 0, keys, with_vpath, with_order, only).drop("has_obj")
    out = None
    for c, deepest in sorted(present.items()):
        own = d.where(F.col("_class") == c).drop("_depth", "_class")
        n = nodes(own, keys, with_vpath, int(deepest), with_order) if c < 0 else nodes_chain(own, int(deepest), keys, with_vpath, with_order, only)
        n = n.where(only) if only and c < 0 else n
        n = n.drop("has_obj")
        out = n if out is None else out.unionByName(n)
    return out
