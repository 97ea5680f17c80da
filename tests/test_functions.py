import json

from pyspark.sql import functions as F

from fieldscope.functions import names
from fieldscope.operators import clean, profile


def test_normalizers(spark):
    df = spark.createDataFrame([("PD.PD_Formula",), ("Linker-Type Name",), ("A:B.c d",)], "f string")
    r = df.select(names.norm_compare("f").alias("a"), names.norm_array("f").alias("b"),
                  names.norm_exclusion("f").alias("c"), names.norm_category("f").alias("d")).collect()
    assert [x.a for x in r] == ["pdformula", "linkertypename", "cd"]
    assert [x.b for x in r] == ["pdpdformula", "linkertypename", "a:bcd"]
    assert [x.c for x in r] == ["pdpdformula", "linkertypename", "abcd"]
    assert [x.d for x in r] == ["pd.pdformula", "linkertypename", "a:b.cd"]


def test_special_chars_unicode_space(spark):
    df = spark.createDataFrame([("a b#c@#",), ("ok (1), x: y; 'q' \"r\"",), ("é\x1f",)], "v string")
    r = [x.s for x in df.select(names.special_chars("v").alias("s")).collect()]
    assert r == [["#", "@"], [], ["é"]]


def test_exclusion(spark):
    df = spark.createDataFrame([("MolStructure",), ("e",), ("weight",), ("data.SMILES_x",)], "f string")
    r = [x.x for x in df.select(names.excluded("f").alias("x")).collect()]
    assert r == [True, True, False, True]  # "e" is inside a built-in token


def test_clean_column_counts(spark):
    df = spark.createDataFrame([(1, "a.b.Note", "x-ISIS-y @@"), (2, "other", "-ISIS-@")], "doc_id int, field string, value string")
    r = {x.doc_id: (x.cleaned, x.removed) for x in clean.clean_column(df, field_tokens={"NOTE": ["@"]}).collect()}
    assert r == {1: ("xy ", 8), 2: ("@", 6)}


def test_clean_documents(spark):
    doc = json.dumps({"note": "a@b", "list": ["c@d"], "x": {"note": "-ISIS-"}})
    df = spark.createDataFrame([(1, doc), (2, "not json")], "doc_id int, content string")
    r = {x.doc_id: x for x in clean.clean_documents(df, field_tokens={"note": ["@"]}).collect()}
    assert r[1].removed == 1 + 6
    assert json.loads(r[1].cleaned) == {"note": "ab", "list": ["c@d"], "x": {"note": ""}}
    assert r[2].removed == 0 and r[2].cleaned == "not json"


def test_minified(spark):
    df = spark.createDataFrame([("{" + '"a": 1, ' * 20 + '"b": 2}',), ('{\n  "a": 1\n}',), ("",)], "c string")
    assert [x.m for x in df.select(profile.minified(F.col("c")).alias("m")).collect()] == [True, False, False]


def test_paragraph_catalog(spark):
    lines = ["I. Alpha Database details", "Beta Module", "Data fields:", "FieldA, FieldB", "- FieldC",
             "Gamma Database", "Data fields:", "Zeta"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, text string")
    r = sorted((x.catalog, x.category, x.field) for x in clean.catalog_from_paragraphs(df).collect())
    assert r == [("Alpha", "Beta", "FieldA"), ("Alpha", "Beta", "FieldB"), ("Alpha", "Beta", "FieldC"),
                 ("Gamma", "Data Fields", "Zeta")]


def test_cell_catalog(spark):
    cells = [(1, 0, 0, 0, "No."), (1, 0, 0, 1, "RDF Field Name"), (1, 0, 1, 0, "1"), (1, 0, 1, 1, "COMPOUND_ID"),
             (1, 0, 2, 1, "Assay type"), (1, 0, 3, 1, "COMPOUND_ID")]
    df = spark.createDataFrame(cells, "doc_id int, table_idx int, row int, col int, text string")
    r = sorted((x.ordinal, x.field) for x in clean.catalog_from_cells(df).collect())
    assert r == [(0, "COMPOUND_ID"), (1, "Assay")]
