from difflib import SequenceMatcher

from fieldscope.operators import match, walk
from fieldscope.sources import catalog as cg


def _cmp(spark, docs, catalog, **kw):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string")
    n = walk.nodes(walk.units(walk.parse(df)))
    prof = match.profile(n)
    rows = match.compare(prof, cg.from_dict(spark, catalog), **kw).collect()
    return sorted((r.doc_id, r.status, r.match_kind, r.field_name, r.json_field) for r in rows)


def test_exact_fuzzy_missing_extra(spark):
    got = _cmp(spark, ['{"O_Order_Key": 1, "order status": 2, "x": {"ship-date": 3}}'],
               {"c": ["oorderkey", "orderstatus", "ship_dat", "tax"]})
    assert (0, "matched", "exact", "oorderkey", "O_Order_Key") in got
    assert (0, "matched", "exact", "orderstatus", "order status") in got
    assert (0, "matched", "fuzzy", "ship_dat", "x.ship-date") in got
    assert (0, "missing", "not_found", "tax", "") in got
    assert (0, "extra", "not_found", "x", "x") in got
    assert len(got) == 5


def test_duplicates_and_last_original(spark):
    # duplicates of an unmatched catalog name each report; of a matched one not
    got = _cmp(spark, ['{"a": {"k": 1}, "b": {"k": 2}, "z": 1}'], {"c": ["K", "k", "q", "q"]})
    assert got.count((0, "missing", "not_found", "q", "")) == 2
    matched = [g for g in got if g[1] == "matched"]
    assert matched == [(0, "matched", "exact", "k", "b.k")]  # last originals on both sides
    assert [g for g in got if g[1] == "extra"] == [(0, "extra", "not_found", "a", "a"), (0, "extra", "not_found", "b", "b"),
                                                   (0, "extra", "not_found", "z", "z")]


def test_greedy_is_one_to_one_in_catalog_order(spark):
    # both catalog names prefer "abcd"; the first takes it, the second gets the rest
    got = _cmp(spark, ['{"abcd": 1, "abcx": 2}'], {"c": ["abce", "abcf"]}, threshold=0.7)
    m = sorted((g[3], g[4]) for g in got if g[1] == "matched")
    assert m == [("abce", "abcd"), ("abcf", "abcx")]


def test_null_parent_suppression(spark):
    cat = {"c": {"items": ["sku", "qty"], "meta": ["owner"]}}
    doc = '{"items": [], "meta": null, "owner": "me", "sku": 1}'
    got = _cmp(spark, [doc], cat, emit_suppressed=True)
    # matched pairs whose category is null/[] are suppressed
    assert (0, "suppressed", "exact", "owner", "owner") in got
    assert (0, "suppressed", "exact", "sku", "sku") in got
    # a missing field with a category is still reported
    assert (0, "missing", "not_found", "qty", "") in got
    plain = _cmp(spark, [doc], cat)
    assert not [g for g in plain if g[3] in ("owner", "sku") and g[1] != "extra"]


def test_ratio_is_asymmetric():
    r = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert round(r("tide", "diet"), 4) == 0.25 and round(r("diet", "tide"), 4) == 0.5


def test_catalog_rows_and_category_map(spark):
    c = cg.from_dict(spark, {"d": {"t1": ["a", "b"], "t2": {"sub": ["b", "c"]}, "t3": ""}})
    rows = sorted((r.ordinal, r.field, r.category, r.is_category) for r in c.collect())
    assert rows == [(0, "a", "t1", False), (1, "b", "t1", False), (2, "b", "t2", False), (3, "c", "t2", False),
                    (4, "t1", None, True), (5, "t2", None, True), (6, "t3", None, True)]
    m = {r.field: r.category for r in cg.category_map(c).collect()}
    assert m == {"a": "t1", "b": "t2", "c": "t2"}
