import os

from pyspark.sql import functions as F

from fieldscope.operators import validate
from fieldscope.sources import files, sinks


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_folder_scan_decode_and_tolerant_load(spark, tmp_path):
    root = str(tmp_path / "docs")
    _write(f"{root}/a.json", b'{"a": 1}')
    _write(f"{root}/sub/b.json", b'\xef\xbb\xbf{"b": [1, 2,]}')
    _write(f"{root}/sub/deeper/c.json", '{"c": "é"}'.encode("utf-16"))
    _write(f"{root}/d.json", b'{"d": "\xe9"}')
    _write(f"{root}/e.json", b"")
    _write(f"{root}/notes.txt", b"ignored")
    fl = files.read_folder(spark, root)
    c = files.folder_counts(fl).first()
    assert (c.root_files, c.subfolder_files) == (3, 2)
    text, enc = files.decode(F.col("content"))
    d = fl.select(F.regexp_extract("path", "[^/]+$", 0).alias("doc_id"), text.alias("content"), enc.alias("enc"))
    got = {r.doc_id: r for r in files.tolerant_load(d).collect()}
    assert got["a.json"].enc == "utf-8" and got["a.json"].repair == "none"
    assert got["b.json"].enc == "utf-8" and got["b.json"].repair == "trailing_comma" and got["b.json"].v is not None
    assert got["c.json"].enc == "utf-16" and got["c.json"].repair == "none"
    assert got["d.json"].enc is None or got["d.json"].repair == "failed"
    assert got["e.json"].repair == "failed" and got["e.json"].v is None


def test_report_lines_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("ok.json", '{"a": 1}'), ("bad.json", "{"), ("warn.json", '{"a": ""}')],
                               "doc_id string, content string")
    val = validate.validate(df)
    out = str(tmp_path / "report")
    sinks.write_report(validate.report_lines(val), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == "File: bad.json" and lines[1] == "  Errors:"
    assert "File: warn.json" in lines and "    - Empty string at root.a" in lines
    assert lines[-1] == "  ✓ ok.json"


def test_root_is_compared_as_a_whole(spark, tmp_path):
    root = tmp_path / "docs"
    again = root / str(root).lstrip("/")  # a subfolder whose path repeats the root's
    again.mkdir(parents=True)
    (root / "a.json").write_text("{}")
    (again / "b.json").write_text("{}")
    r = files.folder_counts(files.read_folder(spark, str(root))).first()
    assert (r.root_files, r.subfolder_files) == (1, 1)


def test_navigate_has_no_depth_limit(spark):
    doc = '{"a": [[[[[[42]]]]]], "b": {"0": {"1": "k"}}}'
    v = F.parse_json(F.lit(doc))
    got = spark.range(1).select(*[files.navigate(v, p).cast("string").alias(p.replace(".", "_")) for p in ("a.0.0.0.0.0.0", "b.0.1", "a.1", "b.x")]).first()
    assert tuple(got) == ("42", "k", None, None)
