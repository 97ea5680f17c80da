"""Findings of FINDINGS_r04.md: what grows with the documents is not broadcast, and no task gets a share of its own size."""

import json
import random
import re

from pyspark.sql import functions as F

from fieldscope.functions import names
from fieldscope.operators import clean, match, profile, walk
from fieldscope.plans import pipeline
from fieldscope.sources import catalog as cg
from fieldscope.sources import files, reports


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df):
    df.collect()
    return _plan(df)


def test_findings_are_not_broadcast(spark):
    rows = [(i, json.dumps({"user": f"u#{i}", "n": i}, indent=1)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    n = walk.nodes_by_depth(walk.units(walk.parse(docs).select("doc_id", "v")), only="fst")
    found = profile.line_numbers(profile.findings(profile.string_values(profile.path_values(n))), docs)
    assert "BroadcastHashJoin" not in _final(found)
    assert sorted((r["doc_id"], r["field"], r["line_number"]) for r in found.collect()) == [(i, "user", 2) for i in range(50)]


def test_cleaning_settings_go_to_every_task(spark):
    values = spark.createDataFrame([("a", i, "user", f"u#{i}") for i in range(40)], "catalog string, doc_id long, field string, value string")
    removals = spark.createDataFrame([("a", "user", "#", 0), ("a", None, "u", 0)], "catalog string, field string, token string, ordinal int")
    exclusions = spark.createDataFrame([("a", "other")], "catalog string, keyword string")
    cats = spark.createDataFrame([("a",)], "catalog string")
    states = profile.value_states(clean.clean_by_table(values, removals, cats), exclusions)
    plan = _plan(states).split("== Initial")[0]
    assert plan.count("BroadcastHashJoin") >= 3
    assert sorted((r["cleaned"], r["removed"], r["state"]) for r in states.collect()) == sorted((str(i), 2, "plain") for i in range(40))


def test_excluded_names_are_normalized_once(spark):
    fields = ["helm", "x.Helm_Notation", "para", "meter", "Molstructure-x", "user", "", "a smile", "fragment", "s_m_i_l_e", "helms helm", "r p", None]
    df = spark.createDataFrame([(f, ["User"]) for f in fields], "f string, k array<string>")
    norm = lambda x: "".join(c for c in x if c not in " _-.:").lower()
    for reverse in (True, False):
        got = [r["x"] for r in df.select(names.excluded("f", F.col("k"), reverse).alias("x")).collect()]
        want = [None if f is None else any(t in norm(f) or reverse and norm(f) in t for t in names.DEFAULT_EXCLUDED) or any(
            t in norm(f) for t in names.ALWAYS_EXCLUDED_SUBSTRINGS) or "user" in norm(f) for f in fields]
        assert got[:-1] == want[:-1]
    text = df.select(names.excluded("f").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("translate(") <= 2


def test_container_text(spark):
    texts = ["[1]", " [1]\n", "{}", "\x1c{\"a\": [1]} ", "[1", "]", "x[1]", "[1]x", "[1]\n\n", "{1}", "[", "", "[{\n}]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [bool(r["x"]) for r in df.select(profile.is_json_container_text(F.col("t")).alias("x")).collect()]
    blank = " \n\x1c "

    def parses(t):
        try:
            json.loads(t.strip(blank))
            return True
        except ValueError:
            return False

    assert [g for g, t in zip(got, texts, strict=True) if "\x1c" not in t and " " not in t] == [
        t.strip(blank)[:1] in ("[", "{") and t.strip(blank)[-1:] in ("]", "}") and parses(t) for t in texts if "\x1c" not in t and " " not in t]


def test_walk_of_wanted_nodes(spark):
    docs = ['{"a": [{"x": 1, "y": [[{"z": 1}]]}, {"x": 2}], "b": {"c": [1, {"d": 1}]}}', "[" * 40 + '{"x": 1}' + "]" * 40, '[{"a": [{"q": 1}]}, 3]']
    u = walk.units(walk.parse(spark.createDataFrame(list(enumerate(docs)), "doc_id int, content string")))
    cols = ["doc_id", "unit", "path", "kind", "depth"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    for flag in ("fst", "p6", "p1", "op"):
        every = walk.nodes_by_depth(u).where(f"{flag} AND keyed")
        assert key(walk.nodes_by_depth(u, only=flag).where(f"{flag} AND keyed")) == key(every)


def test_array_maps_of_repeated_and_null_keys(spark):
    texts = [(1, '{"a": [{"x": 1}]}'), (1, '{"b": [{"x": 1, "y": 2}]}'), (None, '{"a": [{"x": 1}]}'), (2, None), (3, '[{"a": [{"X_y": 1}]}, 5]')]
    df = walk.parse(spark.createDataFrame(texts, "doc_id int, content string"))
    maps = match.array_maps(df)
    got = sorted(((r["doc_id"], sorted(r["arr_map"].items())) for r in maps.collect()), key=str)
    assert got == sorted([(1, [("x", "b"), ("y", "b")])] * 2 + [(None, []), (2, []), (3, [("xy", "a")])], key=str)
    assert "Join" not in _plan(maps)


def test_comparison_is_not_shuffled_by_path_set_nor_rolled_up_twice(spark):
    docs = spark.createDataFrame([(i, json.dumps({"order_id": i, "state": 1} if i % 5 else {"order_id": i})) for i in range(60)], "doc_id long, content string")
    cmp = pipeline.compare_documents(docs, cg.from_dict(spark, {"orders": ["order_id", "status"]}))
    assert "hashpartitioning(sig" not in _plan(cmp) and "BroadcastHashJoin" in _plan(cmp)
    report = reports.field_report(cmp)
    assert "collect_list" not in _plan(report)
    lines = [r["line"] for r in report.orderBy("section", "name", "seq", "line").collect()]
    assert lines[:5] == ["FIELD COMPARISON: orders", "Matched: 60", "Missing in JSON: 60", "Not in catalog: 48", "Compared: 168"]
    assert "0 (orders) matched: 1, missing: 1, extra: 0" in lines and "    - status: not_found" in lines


def test_bytes_are_counted_once_as_the_patterns_say(spark):
    rnd = random.Random(3)
    odd = [0, 0xD8, 0xDC, 0xDF, 65, 66, 0xE9, 0x81, 0x93, 10, 0xD7, 0xF7, 0xFF, 0xB0, 0x7F, 0x1F]
    rows = [bytes(rnd.choice(odd) for _ in range(rnd.randint(0, 9))) for _ in range(400)] + [b"plain", "é“”".encode(), b""]
    letter = "(?:4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|C.|D[0-68-F]|E.|F[0-68-F]) "
    high = "(?:C.|D[0-68-F]|E.|F[0-68-F]) "
    for b in rows:
        pairs = "".join(f"{x:02X} " for x in b)
        units = re.sub("(..)(..)", r"\1\2 ", b.hex().upper())
        swapped = re.sub("(..)(..)", r"\2\1 ", b.hex().upper())
        up = lambda u: not re.search("D[89A-F].. ", re.sub("D[89AB].. D[C-F].. ", "", u))
        count = lambda text, p: len(re.findall(p, text))
        beside = sum(bool(re.fullmatch(high, pairs[i:i + 3])) and bool(re.fullmatch(letter, pairs[i - 3:i] if i else "") or re.match(letter, pairs[i + 3:])) for i in range(0, len(pairs), 3))
        assert files._facts_of(b) == (
            up(swapped), up(units), count(units, "[0-9A-F]{2}00 "), count(units, "00[0-9A-F]{2} "), count(pairs, "[89A-F]. "),
            count(pairs, "(?:0[0-8BCEF]|1[0-9A-F]|7F) "), count(pairs, "[89]. "), count(pairs, "(?:8[1DF]|9[0D]) "), beside, count(pairs, "[AB]. "))
    d = files.decode_detected(spark.createDataFrame([(b,) for b in rows], "content binary"))
    assert "hex(content" not in _plan(d).split("substring")[0] and _plan(d).count("ArrowEvalPython") == 1
    assert d.where("encoding = 'utf-8' AND text IS NULL").count() == 0
