"""DuckDB oracle SQL for the registered queries (see ``queries``).

The oracle never parses JSON: document shapes follow from how the builders
assemble them from table columns, so paths, null parents, record numbers and
damage are recomputed with joins, window functions and modular arithmetic.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from .queries import COMPETING, CROSS_NAMES, LISTED_TABLES, CUSTOMER_ORDERS, EVENT_FIELDS, EXPECTED_ORDER_FIELDS, PINNED_RATIOS, VARIANTS
from ..sources.fixtures import LINEITEM_FIELDS, ORDER_FIELDS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lit(x) -> str:
    if isinstance(x, str):
        return _q(x)
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return repr(x)


def _values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {cols}"


def _norm_a(x: str) -> str:
    return f"lower(replace(replace(replace(regexp_extract({x}, '[^.]*$'), ' ', ''), '_', ''), '-', ''))"


def _norm_d(x: str) -> str:
    return f"lower(replace(replace(replace({x}, ' ', ''), '_', ''), '-', ''))"


F2_PATHS = f"""
f2_paths AS (
  SELECT o_orderkey AS doc_id, p.path FROM orders CROSS JOIN {_values([(f,) for f in ORDER_FIELDS] + [("lineitems",)], "p(path)")}
  UNION ALL
  SELECT o_orderkey AS doc_id, 'lineitems.' || p.f AS path
  FROM orders CROSS JOIN {_values([(f,) for f in LINEITEM_FIELDS], "p(f)")}
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
)"""

F4_REC = """
f4_rec AS (
  SELECT c_custkey, c_custkey // 50 AS doc_id,
         row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS record_idx,
         c_custkey % 5 <> 0 AS has_acct,
         CASE WHEN c_custkey % 3 = 0 THEN 'null' WHEN c_custkey % 3 = 1 THEN 'empty'
              WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'array' ELSE 'empty' END AS orders_state
  FROM customer
),
f4_multi AS (SELECT doc_id FROM f4_rec GROUP BY doc_id HAVING count(*) > 1),
f4_rec_paths AS (
  SELECT r.doc_id, r.record_idx, p.path FROM f4_rec r
  CROSS JOIN (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_mktsegment'), ('orders')) AS p(path)
  UNION ALL SELECT doc_id, record_idx, 'c_acctbal' FROM f4_rec WHERE has_acct
  UNION ALL SELECT r.doc_id, r.record_idx, p.path FROM f4_rec r
  CROSS JOIN (VALUES ('orders.o_orderkey'), ('orders.o_orderstatus'), ('orders.o_totalprice')) AS p(path)
  WHERE r.orders_state = 'array'
),
f4_doc_paths AS (SELECT DISTINCT doc_id, path FROM f4_rec_paths)"""


def _catalog_rows(catalog: dict) -> list[tuple]:
    rows = []
    for name, body in catalog.items():
        o = 0
        if isinstance(body, list):
            for f in body:
                rows.append((name, f, o, None))
                o += 1
        else:
            for cat, fs in body.items():
                for f in fs:
                    rows.append((name, f, o, cat))
                    o += 1
            for cat in body:
                rows.append((name, cat, o, None))
                o += 1
    return rows


def _contention() -> str:
    """J2 by a recursion over the catalog's ordinals that carries the taken
    names, for the two path sets of the order documents."""
    squeeze = lambda x: x.split(".")[-1].replace("_", "").lower()
    always = [(f, f) for f in (*ORDER_FIELDS, "lineitems")]
    paths = sorted([(p, squeeze(p), False) for p, _ in always] + [("lineitems." + f, squeeze(f), True) for f in LINEITEM_FIELDS])
    paths = [(i, *p) for i, p in enumerate(paths)]
    ratios = [(o, c, jn, r) for o, c in enumerate(COMPETING) for _, _, jn, _ in paths
              if (r := SequenceMatcher(None, squeeze(c), jn).ratio()) >= 0.7]
    return f"""WITH RECURSIVE paths AS (SELECT * FROM {_values(paths, "p(pos, path, jn, nested)")}),
    cat AS (SELECT * FROM {_values(list(enumerate(COMPETING)), "c(ord, field)")}),
    ratios AS (SELECT * FROM {_values(ratios, "r(ord, field, jn, ratio)")}),
    forms AS (SELECT * FROM (VALUES (true), (false)) AS f(nested)),
    open AS (
      SELECT f.nested AS form, r.ord, r.field, r.jn, r.ratio, p.path, p.pos FROM forms f, ratios r JOIN paths p ON p.jn = r.jn
      WHERE f.nested OR NOT p.nested),
    steps(form, ord, used, path, ratio) AS (
      SELECT nested, -1, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM forms
      UNION ALL
      SELECT s.form, s.ord + 1,
             CASE WHEN b.path IS NULL THEN s.used ELSE list_append(s.used, b.path) END, b.path, b.ratio
      FROM steps s LEFT JOIN LATERAL (
        SELECT o.path, o.ratio FROM open o WHERE o.form = s.form AND o.ord = s.ord + 1 AND NOT list_contains(s.used, o.path)
        ORDER BY o.ratio DESC, o.pos LIMIT 1) b ON true
      WHERE s.ord + 1 < {len(COMPETING)}),
    rows AS (
      SELECT s.form, c.field AS field_name, c.field AS db_field, coalesce(s.path, '') AS json_field,
             CASE WHEN s.path IS NULL THEN 'missing' ELSE 'matched' END AS status,
             CASE WHEN s.path IS NULL THEN 'not_found' ELSE 'fuzzy' END AS match_kind, round(s.ratio, 4) AS similarity,
             CASE WHEN s.path IS NULL THEN '' END AS category
      FROM steps s JOIN cat c ON c.ord = s.ord
      UNION ALL
      SELECT f.nested, p.path, '', p.path, 'extra', 'not_found', NULL, NULL FROM forms f JOIN paths p ON f.nested OR NOT p.nested
      WHERE p.path NOT IN (SELECT s.path FROM steps s WHERE s.form = f.nested AND s.path IS NOT NULL))
    SELECT o_orderkey AS doc_id, 'competing' AS catalog, r.* EXCLUDE (form)
    FROM orders JOIN rows r ON r.form = (o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def compare_ctes(prefix: str, paths: str, keys: list[str], catalog_rows: list[tuple], nullmap: str | None = None) -> str:
    """CTEs ``{prefix}_cmp`` with the comparison rows for ``paths`` (CTE
    with ``*keys, path``) against a literal catalog; pinned fuzzy ratios;
    category-based null-parent suppression when ``nullmap`` (``*keys,
    parent, is_null`` with normalized parent) is given."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    p = prefix
    cat_vals = _values(catalog_rows, "c(catalog, field, ord, category)")
    fz = _values(PINNED_RATIOS, "f(dn, jn, ratio)")
    sup = ""
    if nullmap:
        sup = f"""
  LEFT JOIN {nullmap} nm ON {on('r', 'nm')} AND nm.parent = {_norm_d('cc.category')}"""
    status = (f"CASE WHEN r.status = 'matched' AND cc.category IS NOT NULL AND coalesce(nm.is_null, false) "
              f"THEN 'suppressed' ELSE r.status END") if nullmap else "r.status"
    return f"""
{p}_cat AS (SELECT catalog, field, ord, category, {_norm_a('field')} AS dn FROM {cat_vals}),
{p}_corig AS (SELECT catalog, dn, arg_max(field, ord) AS orig FROM {p}_cat GROUP BY catalog, dn),
{p}_cfield AS (SELECT catalog, field, arg_max(category, ord) AS category, min(ord) AS first_ord
               FROM {p}_cat WHERE category IS NOT NULL GROUP BY catalog, field),
{p}_ccat AS (SELECT catalog, {_norm_a('field')} AS dn, arg_max(category, first_ord) AS category
             FROM {p}_cfield GROUP BY catalog, {_norm_a('field')}),
{p}_jp AS (SELECT {k}, path, {_norm_a('path')} AS jn FROM {paths}),
{p}_jorig AS (SELECT {k}, jn, max(path) AS orig FROM {p}_jp GROUP BY {k}, jn),
{p}_docs AS (SELECT DISTINCT {k} FROM {paths}),
{p}_exact AS (SELECT DISTINCT c.catalog, {', '.join('j.' + x for x in keys)}, c.dn
              FROM {p}_jp j JOIN {p}_cat c ON j.jn = c.dn),
{p}_fuzzy AS (
  SELECT DISTINCT c.catalog, {', '.join('j.' + x for x in keys)}, f.dn, f.jn, f.ratio
  FROM {p}_jp j JOIN {fz} ON j.jn = f.jn JOIN (SELECT DISTINCT catalog, dn FROM {p}_cat) c ON c.dn = f.dn
  WHERE NOT EXISTS (SELECT 1 FROM {p}_exact e WHERE e.catalog = c.catalog AND {on('e', 'j')} AND e.dn = f.dn)
    AND NOT EXISTS (SELECT 1 FROM {p}_exact e WHERE e.catalog = c.catalog AND {on('e', 'j')} AND e.dn = f.jn)
),
{p}_matched AS (
  SELECT catalog, {k}, dn, dn AS jn, 'exact' AS kind, CAST(NULL AS DOUBLE) AS sim FROM {p}_exact
  UNION ALL SELECT catalog, {k}, dn, jn, 'fuzzy', ratio FROM {p}_fuzzy
),
{p}_rows AS (
  SELECT m.catalog, {', '.join('m.' + x for x in keys)}, co.orig AS field_name, co.orig AS db_field, jo.orig AS json_field,
         'matched' AS status, m.kind AS match_kind, round(m.sim, 4) AS similarity, CAST(NULL AS VARCHAR) AS category, m.dn
  FROM {p}_matched m JOIN {p}_corig co ON co.catalog = m.catalog AND co.dn = m.dn
  JOIN {p}_jorig jo ON {on('jo', 'm')} AND jo.jn = m.jn
  UNION ALL
  SELECT c.catalog, {', '.join('d.' + x for x in keys)}, co.orig, co.orig, '', 'missing', 'not_found', CAST(NULL AS DOUBLE),
         coalesce(cc.category, ''), c.dn
  FROM {p}_docs d CROSS JOIN {p}_cat c
  JOIN {p}_corig co ON co.catalog = c.catalog AND co.dn = c.dn
  LEFT JOIN {p}_ccat cc ON cc.catalog = c.catalog AND cc.dn = c.dn
  WHERE NOT EXISTS (SELECT 1 FROM {p}_matched m WHERE m.catalog = c.catalog AND {on('m', 'd')} AND m.dn = c.dn)
  UNION ALL
  SELECT c.catalog, {', '.join('j.' + x for x in keys)}, jo.orig, '', jo.orig, 'extra', 'not_found', CAST(NULL AS DOUBLE),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  FROM {p}_jp j JOIN {p}_jorig jo ON {on('jo', 'j')} AND jo.jn = j.jn
  CROSS JOIN (SELECT DISTINCT catalog FROM {p}_cat) c
  WHERE NOT EXISTS (SELECT 1 FROM {p}_matched m WHERE m.catalog = c.catalog AND {on('m', 'j')} AND m.jn = j.jn)
),
{p}_cmp AS (
  SELECT r.catalog, {', '.join('r.' + x for x in keys)}, r.field_name, r.db_field, r.json_field, {status} AS status,
         r.match_kind, r.similarity, r.category
  FROM {p}_rows r LEFT JOIN {p}_ccat cc ON cc.catalog = r.catalog AND cc.dn = r.dn{sup}
)"""


def _orders_by_table_rows() -> list[tuple]:
    return _catalog_rows({"orders_by_table": {
        "orders": list(ORDER_FIELDS),
        "lineitems": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    }})


def _both_ctes() -> str:
    rows = _catalog_rows({"order_variants": VARIANTS}) + _orders_by_table_rows()
    return F2_PATHS + "," + compare_ctes("b", "f2_paths", ["doc_id"], rows)


F3_PATHS = f"""
f3_paths AS (
  SELECT event_id AS doc_id, p.path FROM events CROSS JOIN {_values([(f,) for f in ("event_id", "event_type", "user", "props", "props.k")], "p(path)")}
  WHERE event_id % 8 NOT IN (2, 3, 4)
  UNION ALL
  SELECT event_id AS doc_id, 'note' AS path FROM events WHERE event_id % 8 = 5
)"""

_CMP_COLS = "doc_id, catalog, field_name, db_field, json_field, status, match_kind, similarity, category"

SYNTAX_ERR = """CASE event_id % 8
    WHEN 0 THEN 'JSON syntax error at line 5, column ' || CAST(length(props) + 12 AS VARCHAR) || ': Illegal trailing comma before end of object'
    WHEN 1 THEN 'JSON syntax error at line 1, column 1: Unexpected UTF-8 BOM (decode using utf-8-sig)'
    WHEN 2 THEN 'File is empty'
    WHEN 3 THEN 'JSON syntax error at line 6, column 3: Extra data'
    WHEN 4 THEN 'JSON syntax error at line 2, column 3: Expecting property name enclosed in double quotes'
  END"""

# Java/Python Unicode whitespace written out for RE2.
_WS = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPECIAL_RE = "[^a-zA-Z0-9" + _WS + "_\\-.(),:;\"']"


def oracle_sql() -> dict[str, str]:
    cross_rows = _catalog_rows({"cross_names": CROSS_NAMES})
    co_rows = _catalog_rows({"customer_orders": CUSTOMER_ORDERS})
    sql = {}
    sql["field_paths"] = f"WITH {F2_PATHS} SELECT doc_id, path FROM f2_paths"
    sql["props_paths"] = "SELECT event_id AS doc_id, 'k' AS path FROM events"
    sql["max_depth"] = """SELECT o_orderkey AS doc_id,
        CAST(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 3 ELSE 1 END AS BIGINT) AS max_depth FROM orders"""
    sql["record_paths"] = f"""WITH {F4_REC} SELECT doc_id, CAST(record_idx AS BIGINT) AS record_idx, path
        FROM f4_rec_paths WHERE doc_id IN (SELECT doc_id FROM f4_multi)"""
    sql["null_parents"] = f"""WITH {F4_REC},
      np AS (
        SELECT r.doc_id, r.record_idx, p.parent, false AS is_null FROM f4_rec r
        CROSS JOIN (VALUES ('ccustkey'), ('cname'), ('cnationkey'), ('cmktsegment')) AS p(parent)
        UNION ALL SELECT doc_id, record_idx, 'cacctbal', false FROM f4_rec WHERE has_acct
        UNION ALL SELECT doc_id, record_idx, 'orders', orders_state <> 'array' FROM f4_rec
      )
      SELECT doc_id, CAST(record_idx AS BIGINT) AS record_idx, parent, is_null FROM np WHERE doc_id IN (SELECT doc_id FROM f4_multi)"""
    sql["compare_variants"] = ("WITH " + F2_PATHS + "," + compare_ctes("v", "f2_paths", ["doc_id"], _catalog_rows({"order_variants": VARIANTS}))
                               + f" SELECT {_CMP_COLS} FROM v_cmp")
    sql["compare_by_table"] = ("WITH " + F2_PATHS + "," + compare_ctes("t", "f2_paths", ["doc_id"], _orders_by_table_rows())
                               + f" SELECT {_CMP_COLS} FROM t_cmp")
    sql["match_stats"] = f"""WITH {_both_ctes()}
      SELECT catalog, count(*) AS total, count(*) FILTER (WHERE status = 'matched') AS matched,
             count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra,
             count(*) FILTER (WHERE status = 'matched' AND match_kind = 'exact') AS exact_matches,
             count(*) FILTER (WHERE status = 'matched' AND match_kind = 'fuzzy') AS fuzzy_matches
      FROM b_cmp GROUP BY catalog"""
    sql["per_doc_counts"] = f"""WITH {_both_ctes()}
      SELECT catalog, doc_id, count(*) FILTER (WHERE status = 'matched') AS matched,
             count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra
      FROM b_cmp GROUP BY catalog, doc_id"""
    sql["field_rollup"] = f"""WITH {_both_ctes()},
      g AS (SELECT catalog, field_name,
                   count(*) FILTER (WHERE status = 'matched') AS n_matched,
                   count(*) FILTER (WHERE status = 'missing') AS n_missing,
                   count(*) FILTER (WHERE status = 'extra') AS n_extra,
                   bool_or(category <> '') FILTER (WHERE status = 'missing') AS has_category
            FROM b_cmp GROUP BY catalog, field_name),
      seen AS (SELECT DISTINCT catalog, field_name FROM b_cmp WHERE status IN ('matched', 'extra')),
      miss AS (SELECT catalog, field_name, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))) AS docs
               FROM b_cmp WHERE status = 'missing' GROUP BY catalog, field_name),
      v AS (
        SELECT g.catalog, g.field_name,
          CASE WHEN n_matched > 0 THEN 'matched'
               WHEN n_missing > 0 THEN CASE WHEN coalesce(has_category, false) OR s.field_name IS NULL THEN 'missing' END
               WHEN n_extra > 0 THEN 'extra' END AS verdict,
          CAST(CASE WHEN n_matched > 0 THEN n_matched WHEN n_missing > 0 THEN n_missing ELSE n_extra END AS BIGINT) AS times,
          CASE WHEN n_matched = 0 AND coalesce(has_category, false) THEN
            CASE WHEN len(docs) <= 10 THEN array_to_string(docs, ', ')
                 ELSE array_to_string(docs[1:10], ', ') || ' and ' || CAST(len(docs) - 10 AS VARCHAR) || ' more' END
          END AS missing_in
        FROM g LEFT JOIN seen s ON s.catalog = g.catalog AND s.field_name = g.field_name
        LEFT JOIN miss m ON m.catalog = g.catalog AND m.field_name = g.field_name)
      SELECT * FROM v WHERE verdict IS NOT NULL"""
    sql["unique_unmatched"] = f"""WITH {_both_ctes()}
      SELECT catalog, status, field_name, count(*) AS occurrences FROM b_cmp
      WHERE status IN ('missing', 'extra') GROUP BY catalog, status, field_name"""
    rec_cmp = (F4_REC + ", f4_mpaths AS (SELECT * FROM f4_rec_paths WHERE doc_id IN (SELECT doc_id FROM f4_multi)),"
               + compare_ctes("r", "f4_mpaths", ["doc_id", "record_idx"], cross_rows)
               + """, r_bad AS (SELECT DISTINCT catalog, doc_id, record_idx FROM r_cmp WHERE status IN ('missing', 'extra')),
               r_keep AS (SELECT c.* FROM r_cmp c JOIN r_bad b USING (catalog, doc_id, record_idx))""")
    sql["record_conformance"] = f"""WITH {rec_cmp}
      SELECT doc_id, CAST(record_idx AS BIGINT) AS record_idx, catalog, field_name, db_field, json_field, status,
             match_kind, similarity, category FROM r_keep"""
    sql["record_issues"] = f"""WITH {rec_cmp},
      per_rec AS (SELECT catalog, doc_id, record_idx, count(*) FILTER (WHERE status = 'missing') AS missing,
                         count(*) FILTER (WHERE status = 'extra') AS extra
                  FROM r_keep GROUP BY catalog, doc_id, record_idx HAVING missing + extra > 0)
      SELECT catalog, doc_id, count(*) AS records_with_issues, sum(missing) AS missing, sum(extra) AS extra,
             array_to_string(list_sort(list(record_idx))[1:20], ',') AS first_records
      FROM per_rec GROUP BY catalog, doc_id"""
    nullmap = """f4_first_null AS (SELECT doc_id, 'orders' AS parent, orders_state <> 'array' AS is_null
                                  FROM f4_rec WHERE record_idx = 1)"""
    sql["suppressed_pairs"] = ("WITH " + F4_REC + ", " + nullmap + ","
                               + compare_ctes("s", "f4_doc_paths", ["doc_id"], co_rows, nullmap="f4_first_null")
                               + """ SELECT doc_id, catalog, field_name, db_field, json_field, status, match_kind, category
                                     FROM s_cmp WHERE status = 'suppressed'""")
    fz = _values(PINNED_RATIOS, "f(dn, jn, ratio)")
    sql["mapping_suggestions"] = f"""WITH {F4_REC},
      cat AS (SELECT DISTINCT {_norm_a('field')} AS dn FROM {_values([(r[1],) for r in cross_rows], "c(field)")}),
      jn AS (SELECT DISTINCT doc_id, {_norm_a('path')} AS jn FROM f4_doc_paths),
      ex AS (SELECT j.doc_id, c.dn, c.dn AS suggestion, CAST(1.0 AS DOUBLE) AS similarity, 'exact' AS match_kind
             FROM jn j JOIN cat c ON j.jn = c.dn),
      fu AS (SELECT j.doc_id, f.dn, f.jn AS suggestion, round(f.ratio, 4) AS similarity, 'fuzzy' AS match_kind
             FROM jn j JOIN {fz} ON j.jn = f.jn JOIN cat c ON c.dn = f.dn
             WHERE NOT EXISTS (SELECT 1 FROM jn j2 WHERE j2.doc_id = j.doc_id AND j2.jn = f.dn))
      SELECT doc_id, 'cross_names' AS catalog, dn AS name, suggestion, similarity, match_kind FROM ex
      UNION ALL SELECT doc_id, 'cross_names', dn, suggestion, similarity, match_kind FROM fu"""
    sql["structure_diff"] = f"""WITH {F2_PATHS},
      l AS (SELECT doc_id // 2 AS pair_id, path FROM f2_paths WHERE doc_id % 2 = 0),
      r AS (SELECT (doc_id - 1) // 2 AS pair_id, path FROM f2_paths WHERE doc_id % 2 = 1),
      j AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, l.path IS NOT NULL AS hl, r.path IS NOT NULL AS hr
            FROM l FULL OUTER JOIN r ON l.pair_id = r.pair_id AND l.path = r.path)
      SELECT pair_id, count(*) FILTER (WHERE hl) AS left_count, count(*) FILTER (WHERE hr) AS right_count,
             count(*) FILTER (WHERE hl AND hr) AS common_count FROM j GROUP BY pair_id"""
    exp = _values([(x,) for x in sorted(set(EXPECTED_ORDER_FIELDS))], "e(path)")
    sql["expected_check"] = f"""WITH {F2_PATHS},
      e AS (SELECT path FROM {exp}),
      docs AS (SELECT DISTINCT doc_id FROM f2_paths),
      m AS (SELECT d.doc_id, e.path FROM docs d CROSS JOIN e
            WHERE NOT EXISTS (SELECT 1 FROM f2_paths p WHERE p.doc_id = d.doc_id AND p.path = e.path)),
      x AS (SELECT doc_id, path FROM f2_paths WHERE path NOT IN (SELECT path FROM e)),
      t AS (SELECT doc_id, path FROM f2_paths WHERE path IN (SELECT path FROM e)),
      mm AS (SELECT doc_id, count(*) AS c, array_to_string(list_sort(list(path)), ',') AS s FROM m GROUP BY doc_id),
      xx AS (SELECT doc_id, array_to_string(list_sort(list(path)), ',') AS s FROM x GROUP BY doc_id),
      tt AS (SELECT doc_id, array_to_string(list_sort(list(path)), ',') AS s FROM t GROUP BY doc_id)
      SELECT d.doc_id, coalesce(mm.c, 0) = 0 AS valid, coalesce(mm.s, '') AS missing, coalesce(xx.s, '') AS extra,
             coalesce(tt.s, '') AS matched
      FROM docs d LEFT JOIN mm USING (doc_id) LEFT JOIN xx USING (doc_id) LEFT JOIN tt USING (doc_id)"""
    sql["load_repair"] = """SELECT event_id AS doc_id,
        CASE event_id % 8 WHEN 0 THEN 'trailing_comma' WHEN 1 THEN 'bom' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed'
             WHEN 4 THEN 'failed' ELSE 'none' END AS repair,
        event_id % 8 NOT IN (2, 3, 4) AS loaded FROM events"""
    sql["compare_dirty"] = ("WITH " + F3_PATHS + "," + compare_ctes("d", "f3_paths", ["doc_id"], _catalog_rows({"events": EVENT_FIELDS}))
                            + f" SELECT {_CMP_COLS} FROM d_cmp")
    sql["compare_failed"] = f"""SELECT event_id AS doc_id, 'failed' AS repair, {SYNTAX_ERR} AS error
      FROM events WHERE event_id % 8 IN (2, 3, 4)"""
    sql["validation_summary"] = """SELECT count(*) AS total_files, count(*) FILTER (WHERE event_id % 8 IN (5, 6, 7)) AS valid_files,
        count(*) FILTER (WHERE event_id % 8 NOT IN (5, 6, 7)) AS invalid_files,
        count(*) FILTER (WHERE event_id % 8 = 5) AS files_with_warnings FROM events"""
    sql["validation_details"] = f"""SELECT event_id AS doc_id, event_id % 8 IN (5, 6, 7) AS valid,
        {SYNTAX_ERR} AS first_error,
        CASE WHEN event_id % 8 = 5 THEN 'Empty string at root.note' ELSE '' END AS warnings,
        CAST(CASE event_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 3 THEN 6 WHEN 4 THEN 2 END AS BIGINT) AS err_line,
        CAST(CASE event_id % 8 WHEN 0 THEN length(props) + 12 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 END AS BIGINT) AS err_col,
        CASE event_id % 8 WHEN 0 THEN 'Check for trailing comma before closing bracket'
             WHEN 4 THEN 'Check for missing quotes around property names,Check for trailing comma before closing bracket'
             ELSE '' END AS suggestions,
        CASE WHEN event_id % 8 IN (5, 6, 7) THEN 'dict' END AS root_type,
        CAST(CASE WHEN event_id % 8 IN (5, 6, 7) THEN 2 END AS BIGINT) AS max_depth
      FROM events"""
    sql["schema_rules"] = f"""SELECT event_id AS doc_id, false AS valid,
        coalesce({SYNTAX_ERR}, 'Field ''user'' has wrong type. Expected: number, Got: str') AS errors FROM events"""
    sql["root_array_consistency"] = f"""WITH {F4_REC},
      r AS (SELECT *, first_value(has_acct) OVER (PARTITION BY doc_id ORDER BY c_custkey) AS first_acct FROM f4_rec)
      SELECT doc_id, 'list' AS root_type, count(*) AS array_length,
             CASE WHEN count(*) > 1 AND bool_or(has_acct <> first_acct) THEN 'Array objects have inconsistent field sets' ELSE '' END AS warnings,
             CAST(CASE WHEN bool_or(orders_state = 'array') THEN 4 ELSE 2 END AS BIGINT) AS max_depth
      FROM r GROUP BY doc_id"""
    sql["special_char_profile"] = """SELECT event_id AS doc_id, 'user' AS field, '#' AS special_chars,
        'u#' || CAST(user_id AS VARCHAR) AS sample_value, CAST(4 AS BIGINT) AS line_number
      FROM events WHERE event_id % 8 IN (0, 1, 5, 6, 7)"""
    sc = f"list_distinct(regexp_extract_all(text, {_q('(' + SPECIAL_RE + ')')}, 1))"
    sql["special_char_docs"] = f"""SELECT doc_id, CAST(len({sc}) AS BIGINT) AS n_special,
        array_to_string(list_sort({sc}), '') AS chars FROM documents"""
    sql["special_chars_by_lang"] = f"""WITH d AS (SELECT lang, {sc} AS sc FROM documents),
      c AS (SELECT DISTINCT lang, unnest(sc) AS ch FROM d),
      pl AS (SELECT lang, array_to_string(list_sort(list(ch)), '') AS chars FROM c GROUP BY lang),
      cnt AS (SELECT lang, count(*) FILTER (WHERE len(sc) > 0) AS docs_with_special, count(*) AS docs FROM d GROUP BY lang)
      SELECT cnt.lang, docs_with_special, docs, chars FROM cnt LEFT JOIN pl USING (lang)"""
    t3 = "replace(replace(replace(text, '-ISIS-', ''), 'é', ''), 'ç', '')"
    sql["clean_values"] = f"""SELECT doc_id, CAST(length(text) - length({t3}) AS BIGINT) AS removed,
        CAST(length({t3}) AS BIGINT) AS cleaned_length FROM documents"""
    sql["clean_docs"] = """SELECT event_id AS doc_id, CAST(1 AS BIGINT) AS removed, false AS still_has_hash
      FROM events WHERE event_id % 8 NOT IN (2, 3, 4)"""
    sql["minified"] = """SELECT 'p' || CAST(event_id AS VARCHAR) AS doc, true AS minified FROM events
      UNION ALL SELECT 'd' || CAST(event_id AS VARCHAR), false FROM events"""
    sql["catalog_from_paragraphs"] = """WITH p AS (
        SELECT p_partkey, p_partkey // 100 AS doc_id, p_type, p_size, regexp_replace(p_brand, '[^0-9]', '', 'g') AS bn FROM part),
      f AS (SELECT doc_id, p_partkey, 1 AS pos, p_type AS field FROM p
            UNION ALL SELECT doc_id, p_partkey, 2, 'Size' || CAST(p_size AS VARCHAR) FROM p
            UNION ALL SELECT doc_id, p_partkey, 3, 'Brand' || bn FROM p)
      SELECT doc_id, 'Catalog' || CAST(doc_id AS VARCHAR) AS catalog, 'Part' || CAST(p_partkey AS VARCHAR) AS category, field,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey, pos) - 1 AS BIGINT) AS ordinal FROM f"""
    sql["catalog_from_tables"] = """WITH p AS (
        SELECT p_partkey, p_partkey // 100 AS doc_id, p_type, p_size, regexp_replace(p_brand, '[^0-9]', '', 'g') AS bn FROM part),
      lines AS (SELECT doc_id, p_partkey, 1 AS pos, p_type AS field FROM p
            UNION ALL SELECT doc_id, p_partkey, 2, 'Size' || CAST(p_size AS VARCHAR) FROM p
            UNION ALL SELECT doc_id, p_partkey, 3, 'Brand' || bn FROM p),
      cells AS (
        SELECT doc_id, p_partkey % 2 AS tbl, CASE WHEN doc_id % 3 = 1 THEN 'key_' || p_partkey ELSE 'size_' || p_size END AS field,
               min(p_partkey) AS k FROM p GROUP BY ALL),
      ends AS (SELECT doc_id, max(p_partkey) AS last_key FROM p GROUP BY doc_id),
      f AS (
        SELECT doc_id, 'Catalog' || doc_id AS catalog, 'Part' || p_partkey AS category, field, p_partkey AS a, 1 AS b, 0 AS c, pos AS d
        FROM lines WHERE doc_id % 3 <> 2
        UNION ALL
        SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Unknown' ELSE 'Catalog' || doc_id END,
               CASE WHEN doc_id % 3 = 2 THEN 'Table_' || (tbl + 1) ELSE 'Part' || last_key END, field, last_key, 0, tbl, k
        FROM cells JOIN ends USING (doc_id))
      SELECT doc_id, catalog, category, field,
             CAST(row_number() OVER (PARTITION BY doc_id, catalog ORDER BY a, b, c, d) - 1 AS BIGINT) AS ordinal FROM f"""
    sql["array_parents"] = """WITH kinds(kind, field, json, status, match_kind) AS (VALUES
        (0, 'id', 'id', 'matched', 'exact'), (0, 'price', 'nested.items.price', 'suppressed', 'exact'),
        (0, 'items', 'nested.items', 'matched', 'exact'), (0, 'nested', 'nested', 'extra', 'not_found'),
        (0, 'nested.items.more', 'nested.items.more', 'extra', 'not_found'), (0, 'nested.items.more.bits', 'nested.items.more.bits', 'extra', 'not_found'),
        (0, 'nested.items.more.bits.size', 'nested.items.more.bits.size', 'extra', 'not_found'),
        (1, 'id', 'id', 'matched', 'exact'), (1, 'price', 'price', 'matched', 'exact'), (1, 'items', 'items', 'matched', 'exact'),
        (1, 'items.more', 'items.more', 'extra', 'not_found'), (1, 'items.more.bits', 'items.more.bits', 'extra', 'not_found'),
        (1, 'items.more.bits.size', 'items.more.bits.size', 'extra', 'not_found'),
        (2, 'id', 'id', 'matched', 'exact'), (2, 'price', 'lots.stock.price', 'matched', 'exact'),
        (2, 'lots', 'lots', 'extra', 'not_found'), (2, 'lots.stock', 'lots.stock', 'extra', 'not_found'),
        (2, 'lots.stock.more', 'lots.stock.more', 'extra', 'not_found'), (2, 'lots.stock.more.bits', 'lots.stock.more.bits', 'extra', 'not_found'),
        (2, 'lots.stock.more.bits.size', 'lots.stock.more.bits.size', 'extra', 'not_found'),
        (2, 'lots.stock.more', 'lots.stock.more', 'extra', 'not_found'), (2, 'lots.stock.more.bits', 'lots.stock.more.bits', 'extra', 'not_found'),
        (2, 'lots.stock.more.bits.size', 'lots.stock.more.bits.size', 'extra', 'not_found')),
      every AS (SELECT * FROM kinds UNION ALL SELECT 3, field, json, CASE WHEN field = 'price' THEN 'suppressed' ELSE status END, match_kind FROM kinds WHERE kind = 2
                UNION ALL SELECT k, 'items', 'lots.items', 'matched', 'exact' FROM (VALUES (2), (3)) AS x(k))
      SELECT event_id AS doc_id, 'priced' AS catalog, field AS field_name, CASE WHEN status = 'extra' THEN '' ELSE field END AS db_field,
             json AS json_field, status, match_kind, CAST(NULL AS VARCHAR) AS category
      FROM events JOIN every ON kind = event_id % 4"""
    sql["array_parent_records"] = """WITH s AS (
        SELECT s_suppkey // 20 AS doc_id, s_suppkey % 3 AS kind, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) AS record_idx,
               count(*) OVER (PARTITION BY s_suppkey // 20) AS n FROM supplier),
      rows(kind, field_name, db_field, json_field, status, match_kind, category) AS (VALUES
        (0, 'key', 'key', 'key', 'matched', 'exact', NULL), (0, 'price', 'price', 'price', 'suppressed', 'exact', NULL),
        (1, 'key', 'key', 'key', 'matched', 'exact', NULL), (1, 'price', 'price', 'items.price', 'matched', 'exact', NULL),
        (2, 'key', 'key', 'key', 'matched', 'exact', NULL), (2, 'price', 'price', '', 'missing', 'not_found', 'items'),
        (0, 'items', 'items', 'items', 'matched', 'exact', NULL), (1, 'items', 'items', 'items', 'matched', 'exact', NULL),
        (2, 'items', 'items', 'items', 'matched', 'exact', NULL),
        (0, 'record', 'record', '', 'missing', 'not_found', ''), (1, 'record', 'record', '', 'missing', 'not_found', ''),
        (2, 'record', 'record', '', 'missing', 'not_found', ''))
      SELECT doc_id, record_idx, 'priced' AS catalog, field_name, db_field, json_field, status, match_kind, category
      FROM s JOIN rows USING (kind) WHERE n > 1"""
    sql["array_maps"] = """WITH kinds(kind, field, arr) AS (VALUES
        (0, 'price', 'items'), (0, 'more', 'items'), (0, 'size', 'bits'), (1, 'price', 'items'), (1, 'more', 'items'),
        (2, 'items', 'lots'), (2, 'stock', 'lots'), (3, 'items', 'lots'), (3, 'stock', 'lots')),
      lists AS (SELECT event_id // 4 AS doc_id, event_id % 4 AS kind FROM events),
      last AS (SELECT doc_id, max(kind) AS kind, max(kind) FILTER (WHERE kind < 2) AS lower_kind, bool_or(kind >= 2) AS lots FROM lists GROUP BY doc_id)
      SELECT false AS root_list, event_id AS doc_id, field, arr AS array FROM events JOIN kinds ON kind = event_id % 4
      UNION ALL SELECT true, doc_id, f.field, CASE WHEN f.field = 'size' THEN 'bits' WHEN kind = 2 THEN 'stock' ELSE 'items' END
        FROM last, (VALUES ('price'), ('more'), ('size')) AS f(field)
      UNION ALL SELECT true, doc_id, f.field, 'lots' FROM last, (VALUES ('items'), ('stock')) AS f(field) WHERE lots"""
    rule = "'" + "=" * 80 + "'"
    numbered = "SELECT row_number() OVER (ORDER BY section, name, seq, line) AS line_no, line FROM l"
    heads = lambda section, title, cond: "".join(
        f" UNION ALL SELECT {section}, '', {k}, {x} WHERE {cond}" for k, x in ((-3, "''"), (-2, title), (-1, rule)))
    sql["validation_report"] = f"""WITH v AS (SELECT CAST(event_id AS VARCHAR) AS name, {SYNTAX_ERR} AS e, event_id % 8 = 5 AS w FROM events),
      t AS (SELECT count(*) AS n, count(*) FILTER (WHERE e IS NULL) AS ok, count(e) AS bad, count(*) FILTER (WHERE w) AS warned FROM v),
      l(section, name, seq, line) AS (
        SELECT 0, '', 0, 'JSON VALIDATION REPORT' UNION ALL SELECT 0, '', 1, {rule}
        UNION ALL SELECT 0, '', 2, 'Total files: ' || n FROM t UNION ALL SELECT 0, '', 3, 'Valid files: ' || ok FROM t
        UNION ALL SELECT 0, '', 4, 'Invalid files: ' || bad FROM t UNION ALL SELECT 0, '', 5, 'Files with warnings: ' || warned FROM t
        {heads(1, "'INVALID FILES'", "(SELECT bad FROM t) > 0")}{heads(2, "'FILES WITH WARNINGS'", "(SELECT warned FROM t) > 0")}
        {heads(3, "'VALID FILES'", "(SELECT ok - warned FROM t) > 0")}
        UNION ALL SELECT 1, name, 0, 'File: ' || name FROM v WHERE e IS NOT NULL UNION ALL SELECT 1, name, 1, '  Errors:' FROM v WHERE e IS NOT NULL
        UNION ALL SELECT 1, name, 2, '    - ' || e FROM v WHERE e IS NOT NULL
        UNION ALL SELECT 2, name, 0, 'File: ' || name FROM v WHERE w UNION ALL SELECT 2, name, 1, '  Warnings:' FROM v WHERE w
        UNION ALL SELECT 2, name, 2, '    - Empty string at root.note' FROM v WHERE w
        UNION ALL SELECT 3, name, 0, '  ✓ ' || name FROM v WHERE e IS NULL AND NOT w)
      {numbered}"""
    sql["field_report"] = ("WITH " + F2_PATHS + "," + compare_ctes("v", "f2_paths", ["doc_id"], _catalog_rows({"order_variants": VARIANTS})) + f""",
      t AS (SELECT catalog, count(*) FILTER (WHERE status = 'matched') AS m, count(*) FILTER (WHERE status = 'missing') AS s,
                   count(*) FILTER (WHERE status = 'extra') AS x, count(*) AS n FROM v_cmp GROUP BY catalog),
      d AS (SELECT catalog, CAST(doc_id AS VARCHAR) AS doc, count(*) FILTER (WHERE status = 'matched') AS m,
                   coalesce(list_sort(list('    - ' || field_name || ': ' || match_kind) FILTER (WHERE status = 'missing')), []) AS s,
                   coalesce(list_sort(list('    - ' || field_name || ': ' || match_kind) FILTER (WHERE status = 'extra')), []) AS x
            FROM v_cmp GROUP BY catalog, doc_id),
      b AS (SELECT catalog || '/' || doc AS name, ['FILE: ' || doc || ' (' || catalog || ')']
              || [CASE WHEN len(s) > 0 THEN '  Missing in JSON (' || len(s) || '):' ELSE '  Missing in JSON: none' END] || s
              || [CASE WHEN len(x) > 0 THEN '  Not in catalog (' || len(x) || '):' ELSE '  Not in catalog: none' END] || x AS ls
            FROM d WHERE len(s) + len(x) > 0),
      u AS (SELECT catalog, status, field_name, count(*) AS n FROM v_cmp WHERE status IN ('missing', 'extra') GROUP BY ALL),
      l(section, name, seq, line) AS (
        SELECT 0, catalog, 0, 'FIELD COMPARISON: ' || catalog FROM t UNION ALL SELECT 0, catalog, 1, 'Matched: ' || m FROM t
        UNION ALL SELECT 0, catalog, 2, 'Missing in JSON: ' || s FROM t UNION ALL SELECT 0, catalog, 3, 'Not in catalog: ' || x FROM t
        UNION ALL SELECT 0, catalog, 4, 'Compared: ' || n FROM t
        {heads(1, "'FIELDS OF EACH FILE'", "(SELECT sum(s + x) FROM t) > 0")}{heads(2, "'COUNTS OF EACH FILE'", "(SELECT count(*) FROM t) > 0")}
        {heads(3, "'UNMATCHED FIELDS'", "(SELECT count(*) FROM u) > 0")}
        UNION ALL SELECT 1, name, unnest(generate_series(0, len(ls) - 1)), unnest(ls) FROM b
        UNION ALL SELECT 2, catalog || '/' || doc, 0, doc || ' (' || catalog || ') matched: ' || m || ', missing: ' || len(s) || ', extra: ' || len(x) FROM d
        UNION ALL SELECT 3, catalog || '/' || status || '/' || field_name, 0, '  - ' || field_name || ' (' || catalog || '): '
          || CASE status WHEN 'missing' THEN 'Missing in JSON' ELSE 'Not in catalog' END || ', ' || n || ' times' FROM u)
      {numbered}""")
    sql["special_char_report"] = f"""WITH f AS (SELECT event_id, 'u#' || user_id AS v FROM events WHERE event_id % 8 IN (0, 1, 5, 6, 7)),
      l(section, name, seq, line) AS (
        SELECT 0, '', 0, 'SPECIAL CHARACTERS IN VALUES' UNION ALL SELECT 0, '', 1, {rule}
        UNION ALL SELECT 0, '', 2, 'No special characters found.' WHERE NOT EXISTS (FROM f)
        {heads(1, "'Catalog fields (2)'", "true")}{heads(2, "'JSON fields (1)'", "EXISTS (FROM f)")}
        UNION ALL SELECT 1, 'e-mail@', 0, '  - e-mail@: special characters [''@'']' UNION ALL SELECT 1, 'übung', 0, '  - übung: special characters [''ü'']'
        UNION ALL SELECT 2, 'user', -1, '  - user: special characters [''#''], sample value: "' || arg_min(v, event_id) || '"' FROM f HAVING count(*) > 0
        UNION ALL SELECT 2, 'user', 0, '      file: ' || event_id || ':4' FROM f)
      {numbered}"""
    sql["error_log"] = f"""SELECT event_id AS doc_id, 'load' AS stage, 'ERROR' AS level, {SYNTAX_ERR} AS message, true AS stamped
        FROM events WHERE event_id % 8 IN (2, 3, 4)
      UNION ALL SELECT event_id, 'validate', 'ERROR', {SYNTAX_ERR}, true FROM events WHERE event_id % 8 < 5
      UNION ALL SELECT event_id, 'validate', 'WARNING', 'Empty string at root.note', true FROM events WHERE event_id % 8 = 5"""
    both = _catalog_rows({"order_variants": VARIANTS}) + _orders_by_table_rows()
    by_table = ";".join(f"{c}:" + ",".join(f for _, f, _, cat in _orders_by_table_rows() if cat == c) for c in ("orders", "lineitems"))
    sql["results_export"] = f"""WITH {_both_ctes()},
      t AS (SELECT catalog, count(*) FILTER (WHERE status = 'matched') AS m, count(*) FILTER (WHERE status = 'missing') AS s,
                   count(*) FILTER (WHERE status = 'extra') AS x, count(*) AS n FROM b_cmp GROUP BY catalog)
      SELECT 'summary' AS part, '' AS name, '{len([r for r in both if r[3] is not None or r[0] == "order_variants"])};' || (SELECT count(*) FROM orders) || ';'
          || string_agg(catalog || ',' || m || ',' || s || ',' || x || ',' || n, ';' ORDER BY catalog) AS content FROM t
      UNION ALL SELECT 'catalog', 'order_variants', '-:{",".join(VARIANTS)}' UNION ALL SELECT 'catalog', 'orders_by_table', '{by_table}'
      UNION ALL SELECT 'file', CAST(doc_id AS VARCHAR), array_to_string(list_sort(list(path)), ',') FROM f2_paths GROUP BY doc_id"""
    sql["extras_export"] = ("WITH " + F4_REC + ", f4_mpaths AS (SELECT * FROM f4_rec_paths WHERE doc_id IN (SELECT doc_id FROM f4_multi)),"
                            + compare_ctes("d", "f4_doc_paths", ["doc_id"], cross_rows) + ","
                            + compare_ctes("r", "f4_mpaths", ["doc_id", "record_idx"], cross_rows) + """,
      every AS (SELECT catalog, field_name, CAST(doc_id AS VARCHAR) AS doc, false AS rec FROM d_cmp WHERE status = 'extra'
                UNION ALL SELECT catalog, field_name, CAST(doc_id AS VARCHAR), true FROM r_cmp WHERE status = 'extra')
      SELECT catalog, field_name, count(*) FILTER (WHERE NOT rec) AS in_files, count(*) FILTER (WHERE rec) AS in_records,
             array_to_string(list_sort(list(DISTINCT doc))[1:10], ',') AS files, count(*) OVER () AS total_extra_fields FROM every GROUP BY ALL""")
    sql["table_columns"] = "WITH n AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, name AS column_name, (SELECT count(*) FROM {t}) AS row_count, nulls AS null_count FROM "
        f"(UNPIVOT (SELECT count(*) - count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME name VALUE nulls)" for t in LISTED_TABLES) + """)
      SELECT n.table_name, CAST(c.column_index AS BIGINT) AS ordinal, n.column_name,
        CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
             WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(c.data_type) END AS type,
        true AS nullable, n.row_count, n.null_count
      FROM n JOIN duckdb_columns() c ON c.table_name = n.table_name AND c.column_name = n.column_name"""
    summary_rows = _catalog_rows({"cross_names": [*CROSS_NAMES, "c_näme"], "few": ["c_custkey"]})
    sql["full_summary"] = ("WITH " + F4_REC + ", f4_mpaths AS (SELECT * FROM f4_rec_paths WHERE doc_id IN (SELECT doc_id FROM f4_multi)),"
                           + compare_ctes("d", "f4_doc_paths", ["doc_id"], summary_rows) + "," + compare_ctes("r", "f4_mpaths", ["doc_id", "record_idx"], summary_rows) + f"""
      SELECT catalog, CAST(any_value(CASE catalog WHEN 'few' THEN 1 ELSE {len(CROSS_NAMES) + 1} END) AS BIGINT) AS catalog_fields,
        CAST(any_value(CASE catalog WHEN 'few' THEN 0 ELSE 1 END) AS BIGINT) AS special_catalog_fields,
        count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'missing') AS missing,
        count(*) FILTER (WHERE status = 'extra') AS extra, count(*) AS compared,
        count(DISTINCT field_name) FILTER (WHERE status = 'missing') AS unique_missing, count(DISTINCT field_name) FILTER (WHERE status = 'extra') AS unique_extra,
        (SELECT count(*) FROM (SELECT DISTINCT doc_id, record_idx FROM r_cmp WHERE r_cmp.catalog = d_cmp.catalog AND status IN ('missing', 'extra'))) AS records_with_issues,
        (SELECT count(DISTINCT doc_id) FROM f4_rec) AS files_processed, (SELECT count(*) FROM f4_multi) AS multi_record_files,
        CAST(1 AS BIGINT) AS special_json_fields
      FROM d_cmp GROUP BY catalog""")
    # every string value of the annotated documents, cleaned by hand for each catalog
    sql["clean_then_profile"] = """WITH e AS (SELECT event_id AS doc_id, event_type AS t, CAST(user_id AS VARCHAR) AS u, props FROM events),
      rows AS (
        SELECT doc_id, c.catalog, f.field,
          CASE f.field WHEN 'tag' THEN CASE c.catalog WHEN 'beta' THEN t || u ELSE t || '#' || u END
            WHEN 'payload' THEN props WHEN 'broken' THEN '{' || t WHEN 'smiles_code' THEN 'C#N'
            WHEN 'user' THEN CASE c.catalog WHEN 'alpha' THEN 'u' || u ELSE 'u#' || u END
            WHEN 'meta.user' THEN CASE c.catalog WHEN 'alpha' THEN u ELSE 'm@' || u END
            WHEN 'meta.Keep-Note' THEN CASE c.catalog WHEN 'alpha' THEN 'x' || u WHEN 'beta' THEN u || '#é#' ELSE 'x@' || u || '#é#' END
            WHEN 'void' THEN '' END AS cleaned,
          CASE f.field WHEN 'tag' THEN CASE c.catalog WHEN 'beta' THEN 7 ELSE 6 END
            WHEN 'user' THEN CASE c.catalog WHEN 'alpha' THEN 1 ELSE 0 END
            WHEN 'meta.user' THEN CASE c.catalog WHEN 'alpha' THEN 1 ELSE 0 END
            WHEN 'meta.Keep-Note' THEN CASE c.catalog WHEN 'gamma' THEN 6 ELSE 8 END WHEN 'void' THEN 6 ELSE 0 END AS removed
        FROM e, (VALUES ('alpha'), ('beta'), ('gamma')) AS c(catalog),
          (VALUES ('tag'), ('payload'), ('broken'), ('smiles_code'), ('user'), ('meta.user'), ('meta.Keep-Note'), ('void')) AS f(field)),
      states AS (
        SELECT *, CASE WHEN cleaned = '' THEN 'empty'
            WHEN field = 'smiles_code' OR (catalog, field) IN (('beta', 'meta.Keep-Note'), ('gamma', 'broken')) THEN 'excluded'
            WHEN field = 'payload' THEN 'json_text'
            WHEN regexp_matches(cleaned, '[^a-zA-Z0-9_ .(),:;-]') THEN 'special' ELSE 'plain' END AS state FROM rows)
      SELECT doc_id, catalog, field, cleaned, CAST(removed AS BIGINT) AS removed, state,
        CASE WHEN state <> 'special' THEN '' WHEN field = 'broken' THEN '{' WHEN field = 'meta.Keep-Note' THEN '@,#,é'
             WHEN field = 'meta.user' THEN '@' ELSE '#' END AS special_chars FROM states"""
    sql["decode_detected"] = """WITH d AS (
        SELECT doc_id, doc_id % 5 AS k, regexp_replace(text, '[^\\x{01}-\\x{7E}\\x{A0}-\\x{FF}]', '?', 'g') AS plain
        FROM documents WHERE length(text) > 0)
      SELECT doc_id, CASE WHEN k = 2 THEN 'cp1252' WHEN k = 3 THEN 'utf-16-le' WHEN k = 4 THEN 'utf-16-be'
          WHEN k = 0 OR regexp_full_match(plain, '[\\x{01}-\\x{7E}]*') THEN 'utf-8' ELSE 'iso-8859-1' END AS encoding,
        true AS confident, sha256(CASE WHEN k = 2 THEN '“' || plain || '” – 5 €' ELSE plain END) AS text_sha256 FROM d"""
    sql["deep_nesting"] = """WITH d AS (SELECT event_id AS doc_id, event_id % 500 = 0 AS deep, event_id % 13 AS k FROM events),
      p AS (SELECT *, CASE WHEN deep THEN 72 ELSE k + 1 END AS max_depth,
              CASE WHEN deep THEN 'root.deep' || repeat('[0]', 70) ELSE 'root' || repeat('.a', CAST(k AS INTEGER)) END AS place FROM d)
      SELECT doc_id, true AS valid, CAST(max_depth AS BIGINT) AS max_depth,
        CASE WHEN max_depth > 10 THEN 'Deep nesting detected: ' || max_depth || ' levels,' ELSE '' END || 'Empty string at ' || place || '.blank' AS warnings
      FROM p"""
    sql["root_array_mixed"] = """WITH g AS (
        SELECT c_nationkey || '/' || c_mktsegment AS doc_id, c_mktsegment AS seg, count(*) AS n,
          count(*) FILTER (WHERE c_custkey % 7 = 0) AS odd, min(c_custkey) % 7 = 0 AS first_odd,
          count(*) FILTER (WHERE c_custkey % 7 <> 0) AS even FROM customer GROUP BY ALL)
      SELECT doc_id, n + CASE WHEN seg = 'FURNITURE' THEN 1 ELSE 0 END AS array_length,
        CASE WHEN seg = 'FURNITURE' OR (seg = 'HOUSEHOLD' AND odd > 0 AND even > 0) THEN 'Array contains mixed element types'
             WHEN seg = 'BUILDING' AND odd > 0 AND even > 0 THEN 'Array objects have inconsistent field sets' ELSE '' END AS warnings,
        CAST(CASE WHEN seg = 'HOUSEHOLD' AND even = 0 THEN 1 ELSE 2 END AS BIGINT) AS max_depth FROM g"""
    sql["stream_rollup"] = sql["field_rollup"]
    sql["fuzzy_contention"] = _contention()
    sql["stream_validate"] = f"""SELECT event_id AS doc_id, event_id % 8 IN (5, 6, 7) AS valid, {SYNTAX_ERR} AS first_error,
        CASE WHEN event_id % 8 = 5 THEN 'Empty string at root.note' ELSE '' END AS warnings FROM events"""
    sql["special_char_rollup"] = """SELECT 'user' AS field, '#' AS chars, count(*) AS occurrences,
        array_to_string(list_sort(list(event_id))[1:50], ',') AS first_docs
      FROM events WHERE event_id % 8 IN (0, 1, 5, 6, 7)"""
    sql["load_stats"] = """SELECT count(*) FILTER (WHERE event_id % 8 NOT IN (2, 3, 4)) AS success,
        count(*) FILTER (WHERE event_id % 8 IN (2, 3, 4)) AS failed FROM events"""
    sql["object_keys"] = f"""SELECT o_orderkey AS doc_id, p.path, CAST(1 AS BIGINT) AS depth
      FROM orders CROSS JOIN {_values([(f,) for f in ORDER_FIELDS] + [("lineitems",)], "p(path)")}"""
    sql["per_doc_lists"] = ("WITH " + F2_PATHS + "," + compare_ctes("v", "f2_paths", ["doc_id"], _catalog_rows({"order_variants": VARIANTS}))
                            + """ SELECT catalog, doc_id,
        coalesce(array_to_string(list_sort(list(field_name) FILTER (WHERE status = 'missing')), ','), '') AS missing_fields,
        coalesce(array_to_string(list_sort(list(field_name) FILTER (WHERE status = 'extra')), ','), '') AS extra_fields
      FROM v_cmp GROUP BY catalog, doc_id""")
    sql["run_summary"] = ("WITH " + F2_PATHS + "," + compare_ctes("v", "f2_paths", ["doc_id"], _catalog_rows({"order_variants": VARIANTS}))
                          + f""" SELECT catalog, count(*) FILTER (WHERE status = 'matched') AS matched,
        count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra,
        count(*) AS compared, CAST({len(VARIANTS)} AS BIGINT) AS catalog_names,
        (SELECT count(*) FROM orders) AS files_processed FROM v_cmp GROUP BY catalog""")
    sql["category_unmatched"] = ("WITH " + F2_PATHS + "," + compare_ctes("t", "f2_paths", ["doc_id"], _orders_by_table_rows())
                                 + f""" SELECT {_CMP_COLS.replace(', similarity', '')} FROM t_cmp
        WHERE status IN ('missing', 'extra') AND {_norm_d('category')} = 'lineitems'""")
    return sql
