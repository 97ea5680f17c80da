"""Detector, cleaning tables, array maps, depth classes, class roll-ups and reports."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import clean, match, profile, rollup, walk
from fieldscope.plans import pipeline
from fieldscope.sources import catalog as cg
from fieldscope.sources import files, sinks


def test_detector(spark):
    text = "Größe, naïve café; ça va"
    given = {
        1: (text.encode(), text, "utf-8"), 2: (text.encode("latin-1"), text, "iso-8859-1"),
        3: ("“Größe” – 5 €".encode("cp1252"), "“Größe” – 5 €", "cp1252"), 4: (text.encode("utf-16-le"), text, "utf-16-le"),
        5: (text.encode("utf-16-be"), text, "utf-16-be"), 6: ('{"a": 1}'.encode("utf-16-le"), '{"a": 1}', "utf-16-le"),
        7: (text.encode("utf-16"), text, "utf-16"), 8: (b"", "", "utf-8"), 9: (b"\xff\x01\x02", None, None), 10: (None, None, None),
    }
    df = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in given.items()], "id int, content binary")
    got = {r["id"]: (r["text"], r["encoding"]) for r in files.decode_detected(df).collect()}
    assert got == {k: (v[1], v[2]) for k, v in given.items()}


def test_cleaning_and_exclusion_tables(spark):
    values = spark.createDataFrame(
        [("a", "x.My Name", "-ISIS-#1##-ISIS-"), ("b", "x.My Name", "#1"), ("a", "other", "#"), ("a", "note", '["#"]'), ("a", "n", None)],
        "catalog string, field string, value string")
    removals = spark.createDataFrame([(None, None, "-ISIS-", 0), ("a", "my_name", "##", 0), ("a", "my_name", "#", 1), ("a", None, "", 2)],
                                     "catalog string, field string, token string, ordinal int")
    cats = spark.createDataFrame([("a",), ("b",)], "catalog string")
    c = clean.clean_by_table(values, removals, cats)
    states = profile.value_states(c, spark.createDataFrame([("b", "MY")], "catalog string, keyword string"))
    got = {(r["catalog"], r["field"]): (r["cleaned"], r["removed"], r["state"]) for r in states.collect()}
    assert got == {("a", "x.My Name"): ("1", 14, "plain"), ("b", "x.My Name"): ("#1", 0, "excluded"), ("a", "other"): ("#", 0, "special"),
                   ("a", "note"): ('["#"]', 0, "json_text"), ("a", "n"): (None, 0, "empty")}


def array_map(data):
    """The public array map, stated plainly (keys are in sorted order)."""
    norm = lambda s: s.translate(str.maketrans("", "", " _-.")).lower()

    def deep(d):
        out = {}
        for k, v in sorted(d.items()):
            for x in v if isinstance(v, list) else []:
                if isinstance(x, dict):
                    out.update({norm(f): k for f in sorted(x)})
                    out.update(deep(x))
            if isinstance(v, dict):
                out.update(deep(v))
        return out

    if isinstance(data, list):
        out = {}
        for x in data:
            out.update(deep(x) if isinstance(x, dict) else {})
        return out
    out = {}
    for k, v in sorted(data.items()) if isinstance(data, dict) else []:
        for x in v if isinstance(v, list) else []:
            out.update({norm(f): k for f in sorted(x)} if isinstance(x, dict) else {})
        out.update(deep(v) if isinstance(v, dict) else {})
    return out


def test_array_maps(spark):
    docs = [
        {"a": [{"x": 1, "y": [{"z": 1}]}], "b": {"c": [{"x": 1, "d": [{"x": 2}]}]}}, [{"a": [{"x": 1}]}, 3, {"b": [{"x": 1, "c": [{"x": 2}]}]}],
        [{"b": [{"x": 1}]}, {"a": [{"x": 1}]}], {"a": [[{"x": 1}]], "b": []}, [], {}, 5, {"a": [{"b": {"c": [{"q": 1}]}}]},
    ]
    df = walk.parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, content string"))
    got = {r["doc_id"]: r["arr_map"] for r in match.array_maps(df).collect()}
    assert got == {i: array_map(d) for i, d in enumerate(docs)}


def test_depth_classes_walk_like_the_recursion(spark):
    docs = ['{"a": [1, {"b": ""}]}', "[" * 40 + '{"x": 1}' + "]" * 40, "7", "[]", '{"a":' * 12 + "null" + "}" * 12]
    u = walk.units(walk.parse(spark.createDataFrame(list(enumerate(docs)), "doc_id int, content string")))
    cols = ["doc_id", "path", "depth", "kind", "keyed", "p1", "p6", "ord"]
    by_class = walk.nodes_by_depth(u, with_order=True).select(*cols).collect()
    recursive = walk.nodes(u, keys=("doc_id", "unit"), with_order=True).select(*cols).collect()
    assert sorted(map(str, by_class)) == sorted(map(str, recursive)) and len(by_class) > 60
    assert walk.nodes_by_depth(u.limit(0)).count() == 0


@pytest.fixture
def mixed(spark):
    rows = [(i, json.dumps({"order_id": i, **({"status": 1} if i % 3 else {}), "items": None if i % 4 == 0 else [{"sku": 1}]})) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, content string"), cg.from_dict(
        spark, {"o": {"orders": ["order_id", "state", "stat", "status"], "items": ["sku", "sku", "qty"]}, "p": ["item", "sku_"]})


def test_class_rollup_equals_row_rollup_and_partials_merge(spark, mixed):
    docs, cat = mixed
    key = lambda df: sorted(map(str, df.collect()))
    by_row = key(rollup.field_rollup(pipeline.compare_documents(docs, cat)))
    assert key(pipeline.rollup_fields(docs, cat)) == by_row
    parts = pipeline.field_partials(docs.where("doc_id < 13"), cat).unionByName(pipeline.field_partials(docs.where("doc_id >= 13"), cat))
    assert key(rollup.field_verdicts(parts)) == by_row
    cmp, _ = pipeline.compare_classes(docs, cat)
    assert key(rollup.match_stats(cmp, weight="n")) == key(rollup.match_stats(pipeline.compare_documents(docs, cat)))


def test_report_comes_back_in_order(spark):
    lines = spark.range(200).select((F.col("id") % 3).cast("int").alias("section"), F.lit("n").alias("name"), F.col("id").alias("seq"),
                                    F.concat_ws("/", (F.col("id") % 3).cast("string"), F.col("id").cast("string")).alias("line"))
    path = tempfile.mkdtemp(prefix="fieldscope-report-") + "/r"
    sinks.write_report(lines.repartition(5), path)
    got = [r["line"] for r in sinks.read_report(spark, path).orderBy("line_no").collect()]
    assert got == [f"{i % 3}/{i}" for i in sorted(range(200), key=lambda i: (i % 3, i))]
