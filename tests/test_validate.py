import json

from fieldscope.operators import validate as V

DEEP = "bottom"
for _k in range(12):  # twelve objects inside each other
    DEEP = {f"shelf_{12 - _k}": DEEP}
FILES = [
    ("whole.json", json.dumps({"title": "Tide table", "pages": 48, "contact": "desk@harbour.example",
                               "printer": {"firm": "Quay Press", "town": "Emden", "code": "B7"},
                               "ports": ["Emden", "Leer", "Papenburg"]}, indent=2)),
    ("nested.json", json.dumps(DEEP, indent=2)),
    ("nulls.json", json.dumps({"low": None, "high": "06:12", "moon": {"phase": None}}, indent=2)),
    ("comma.json", '{\n  "port": "Leer",\n  "gauge": 4,\n}'),
    ("nothing.json", ""),
    ("mixed.json", json.dumps({"log": [7, {"h": 1, "m": 30}, "calm", {"h": 2, "m": 5}]}, indent=2)),
    ("line.json", json.dumps({"port": "Leer", "gauge": 4, "open": False}, separators=(",", ":"))),
]


def _val(spark, schema=None, rows=FILES):
    df = spark.createDataFrame(rows, "doc_id string, content string")
    return {r.doc_id: r for r in V.validate(df, schema=schema).collect()}, V.validate(df, schema=schema)


def test_batch_totals(spark):
    _, val = _val(spark)
    t = V.batch_totals(val).collect()[0]
    assert (t.total_files, t.valid_files, t.invalid_files, t.files_with_warnings) == (7, 5, 2, 1)


def test_file_verdicts(spark):
    r, _ = _val(spark)
    assert r["nested.json"].warnings == ["Deep nesting detected: 12 levels"]
    assert r["whole.json"].field_count == 5 and r["whole.json"].max_depth == 2
    assert r["nulls.json"].valid and r["nulls.json"].field_count == 3
    assert r["mixed.json"].warnings == [] and r["mixed.json"].max_depth == 3
    assert r["line.json"].max_depth == 1
    bad = r["comma.json"]
    assert bad.errors == ["JSON syntax error at line 3, column 13: Illegal trailing comma before end of object"]
    assert bad.suggestions == ["Check for trailing comma before closing bracket"]
    assert r["nothing.json"].errors == ["File is empty"]


def test_schema_rules(spark):
    schema = {"required": ["title", "pages"], "properties": {"title": {"type": "string"}, "pages": {"type": "number"},
                                                            "contact": {"type": "string"}}}
    r, _ = _val(spark, schema, [FILES[0], ("bad.json", '{"title": 5, "flag": true}')])
    assert r["whole.json"].valid
    assert r["bad.json"].errors == ["Missing required field: pages",
                                    "Field 'title' has wrong type. Expected: string, Got: int"]


def test_structure_and_text_warnings(spark):
    rows = [("a", '[1, "x"]'), ("b", '[{"a": 1}, {"b": 2}]'), ("c", '{"u": "http://x", "e": " "}'), ("d", "[]"),
            ("e", '{"a": [{"b": ""}]}')]
    r, _ = _val(spark, None, rows)
    assert r["a"].warnings == ["Array contains mixed element types"]
    assert r["b"].warnings == ["Array objects have inconsistent field sets"]
    assert r["c"].warnings == ["Empty string at root.e", "File may contain comments (not valid in JSON)"]
    assert r["d"].warnings == ["Root array is empty"]
    assert r["e"].warnings == ["Empty string at root.a[0].b"]
