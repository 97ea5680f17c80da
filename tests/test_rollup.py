from fieldscope.operators import rollup

COLS = "doc_id long, catalog string, field_name string, status string, match_kind string, category string"


def test_field_rollup_listing_and_verdicts(spark):
    rows = [(i, "c", "qty", "missing", "not_found", "items") for i in range(12)]
    rows += [(1, "c", "sku", "matched", "exact", None), (2, "c", "sku", "missing", "not_found", "")]
    rows += [(3, "c", "note", "missing", "not_found", ""), (4, "c", "note", "extra", "not_found", None)]
    rows += [(5, "c", "gone", "missing", "not_found", "")]
    rows += [(6, "c", "x", "extra", "not_found", None), (7, "c", "x", "extra", "not_found", None)]
    r = {x.field_name: x for x in rollup.field_rollup(spark.createDataFrame(rows, COLS)).collect()}
    assert r["qty"].verdict == "missing" and r["qty"].times == 12
    assert r["qty"].missing_in == "0, 1, 10, 11, 2, 3, 4, 5, 6, 7 and 2 more"
    assert r["sku"].verdict == "matched" and r["sku"].times == 1
    assert "note" not in r  # missing without a category but seen elsewhere: not reported
    assert r["gone"].verdict == "missing" and r["gone"].missing_in is None
    assert r["x"].verdict == "extra" and r["x"].times == 2


def test_first_k_is_exact_under_a_hot_group(spark):
    df = spark.range(5000).selectExpr("'hot' AS g", "id AS o").unionByName(spark.range(3).selectExpr("'cold' AS g", "id AS o"))
    got = {}
    for row in rollup.first_k(df, ["g"], "o", 4, salt_buckets=16).collect():
        got.setdefault(row.g, []).append(row.o)
    assert sorted(got["hot"]) == [0, 1, 2, 3] and sorted(got["cold"]) == [0, 1, 2]


def test_record_issues(spark):
    rows = [(1, r, "c", f, s, "not_found", "") for r, f, s in
            [(1, "a", "missing"), (1, "b", "extra"), (2, "a", "matched"), (3, "a", "missing")]]
    df = spark.createDataFrame(rows, "doc_id long, record_idx int, catalog string, field_name string, status string, "
                                     "match_kind string, category string")
    r = rollup.record_issues(df).collect()[0]
    assert (r.records_with_issues, r.missing, r.extra, r.first_records) == (2, 2, 1, [1, 3])
