"""Shared steps at scale: one evaluation of the input, no task that holds a file or a shape."""

import json

from pyspark.sql import functions as F

from fieldscope.operators import match, walk
from fieldscope.sources import files, sinks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_is_read_in_blocks(spark, tmp_path):
    path = str(tmp_path / "report")
    lines = [f"line {i:05d}" if i % 7 else "" for i in range(3000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    rows.repartitionByRange(3, "i").sortWithinPartitions("i").select("line").write.text(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = sinks.read_report(spark, path)
        assert read.rdd.getNumPartitions() > 3  # a file is more than one task's
        assert [r["line"] for r in sorted(read.collect(), key=lambda r: r["line_no"])] == lines
        assert sorted(r["line_no"] for r in read.collect()) == list(range(1, 3001))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whole_texts_pass_by_the_python_parser(spark):
    texts = ['{"a": 1}', ' [1, 2] ', '{"a": 1} x', '{"a": 1},{"b": 2}', '{"a": 1}] x', '1, "fieldscope:end-of-text"] x', '"fieldscope:end-of-text"',
             '﻿{"a": 1}', '{"a": 1,}', "{'a': 1}", "", "  ", "null", "NaN", '{"a": NaN}', '{"a": 1}{"b": 2}', '{"a":1,"a":2}', "1", "01", '{"a": "\t"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    got = {r["doc_id"]: r for r in files.tolerant_load(df).select("doc_id", "repair", F.to_json("v").alias("v")).collect()}
    plain = {r["doc_id"]: r["k"] for r in df.select("doc_id", files._repair_kind("content").alias("k")).collect()}
    assert {k: r["repair"] for k, r in got.items()} == plain
    assert json.loads(got[0]["v"]) == {"a": 1} and json.loads(got[8]["v"]) == {"a": 1} and got[2]["v"] is None
    seen = df.where("doc_id = 0").select(files._repair_kind(F.when(F.lit(False), F.col("content"))).alias("k")).first()
    assert seen["k"] is None


def test_depth_of_a_value_without_its_text(spark):
    texts = ['{"a": {"b": [{"c": 1}]}}', "1", "[]", '{"a<b>[": 1}', '[1, {"a": [1]}]', "{}", '{"a`<": {"b": 1}}', "[null, [1]]"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    d = walk.parse(df).withColumn("_schema", F.expr("schema_of_variant(v)")).select("content", walk.value_depth().alias("d"), walk.text_depth().alias("t"))
    assert all(r["d"] == r["t"] for r in d.collect())


def test_walk_reads_its_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(x):
        runs.add(1)
        return x

    df = spark.createDataFrame([(i, json.dumps({"a": {"b": [i]}})) for i in range(6)], "doc_id int, content string").rdd.map(seen).toDF(["doc_id", "content"])
    runs_at_start = runs.value
    n = walk.nodes(walk.units(walk.parse(df)))
    assert n.count() == 24
    assert runs.value - runs_at_start == 6
    assert "UnionLoop" not in _plan(n)


def test_signatures_are_not_sorted(spark):
    prof = spark.createDataFrame([(i, "s", ["a", "b"]) for i in range(4)], "doc_id int, sig string, paths array<string>")
    assert [tuple(r) for r in match.signatures(prof).collect()] == [("s", ["a", "b"])]
