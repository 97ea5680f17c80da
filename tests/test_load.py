"""Loading: repairs reach the comparison, failures are listed, bytes never raise."""

from pyspark.sql import functions as F

from fieldscope.operators import validate as val
from fieldscope.plans import pipeline
from fieldscope.sources import catalog, files

DOCS = [
    ("comma", '{"a": 1, "b": [1, 2,],}'),
    ("bom", '\ufeff{"a": 1}'),
    ("tail", '{"a": 1} x'),
    ("clean", '{"a": 1}'),
    ("blank", "  "),
    ("null", None),
    ("nan", '{"a": NaN}'),
    ("deep", "[" * 200000 + "]" * 200000),
]


def test_compare_keeps_repairable_documents_and_lists_the_others(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, content string")
    cmp = pipeline.compare_documents(docs, catalog.from_dict(spark, {"c": ["a"]}))
    assert {r.doc_id for r in cmp.select("doc_id").distinct().collect()} == {"comma", "bom", "clean"}
    status = {r.doc_id: (r.repair, r.loaded, r.error) for r in files.load_status(docs).collect()}
    assert len(status) == len(DOCS)
    assert status["comma"] == ("trailing_comma", True, None) and status["bom"] == ("bom", True, None)
    assert status["tail"][:2] == ("failed", False) and status["tail"][2].endswith("Extra data")
    assert status["blank"][2] == status["null"][2] == "File is empty"
    assert status["nan"][1] is False and "NaN" in status["nan"][2]
    assert status["deep"][1] is False and status["deep"][2]


def test_schema_is_an_error_where_no_structure_is_available(spark):
    docs = spark.createDataFrame([("nan", '{"a": NaN}')], "doc_id string, content string")
    assert not val.validate(docs, schema={"required": ["b"]}).first().valid
    plain = val.validate(docs).first()
    assert plain.valid and plain.warnings


def test_decode_of_any_bytes(spark):
    data = {
        "utf8": "{}".encode(), "le": "{\u00e9".encode("utf-16-le"), "bom": "{\U0001f600}".encode("utf-16"),
        "big": b"\xfe\xff" + "{\U0001f600}".encode("utf-16-be"), "lone": b"\x00\xd8", "low_first": b"\x00\xdc\x00\xd8",
        "two_high": b"\x00\xd8\x00\xd8\x00\xdc", "odd": b"\xff\xfe\x00",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "k string, content binary")
    text, enc = files.decode(F.col("content"))
    got = {r.k: (r.t, r.e) for r in df.select("k", text.alias("t"), enc.alias("e")).collect()}
    assert got["utf8"] == ("{}", "utf-8") and got["le"] == ("{\u00e9", "utf-16-le")
    assert got["bom"] == ("{\U0001f600}", "utf-16") == got["big"]
    assert all(got[k] == (None, None) for k in ("lone", "low_first", "two_high", "odd"))
