import random

from pyspark.sql import functions as F

from fieldscope.operators import walk, match


def _paths(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string")
    n = walk.nodes(walk.units(walk.parse(df)))
    out = {}
    for r in walk.field_paths(n).collect():
        out.setdefault(r.doc_id, set()).add(r.path)
    return [out.get(i, set()) for i in range(len(docs))]


def test_path_truth_table(spark):
    got = _paths(spark, [
        '{"a":[[{"x":1}]],"b":[{"y":1},[{"z":2}],5],"c":[1,2],"d":{"e":{"f":1}},"":{"g":1}}',
        '[{"a":1},[{"k":1}],3]',
        '5', '[]', '{}',
    ])
    assert got[0] == {"", "a", "b", "b.y", "b.z", "c", "d", "d.e", "d.e.f", "g"}
    assert got[1] == {"a", "k"}
    assert got[2] == got[3] == got[4] == set()


def _py_paths(data, prefix=""):
    """Plain-Python statement of the path rule, for the property test."""
    out = set()
    if isinstance(data, dict):
        for k, v in data.items():
            name = f"{prefix}.{k}" if prefix else k
            out.add(name)
            if isinstance(v, list):
                if any(isinstance(x, dict) for x in v):
                    for x in v:
                        if isinstance(x, (dict, list)):
                            out |= _py_paths(x, name)
            elif isinstance(v, dict):
                out |= _py_paths(v, name)
    elif isinstance(data, list):
        for x in data:
            if isinstance(x, (dict, list)):
                out |= _py_paths(x, prefix)
    return out


def _rand(rng, depth=0):
    r = rng.random()
    if depth > 3 or r < 0.3:
        return rng.choice([1, "s", None, True, 2.5])
    if r < 0.65:
        return {rng.choice("abcd"): _rand(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [_rand(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def test_paths_match_plain_python_on_random_trees(spark):
    import json

    rng = random.Random(7)
    trees = [_rand(rng) for _ in range(60)]
    got = _paths(spark, [json.dumps(t) for t in trees])
    for t, g in zip(trees, got):
        assert g == _py_paths(t), json.dumps(t)


def test_profile_null_and_array_maps(spark):
    df = spark.createDataFrame([(1, '{"a": null, "b": [], "c": [{"x_y": 1}], "d": {"e": [{"z": 2}]}}'),
                                (2, '[{"p": null, "q": 1}, {"p": 3}]')], "doc_id long, content string")
    n = walk.nodes(walk.units(walk.parse(df)))
    prof = {r.doc_id: r for r in match.profile(n).collect()}
    assert prof[1].null_map == {"a": True, "b": True, "c": False, "d": False}
    assert prof[1].arr_map == {"xy": "c", "z": "e"}
    # root array: null parents from the first record only, no array map
    assert prof[2].null_map == {"p": True, "q": False}
    assert prof[2].arr_map == {}


def test_depth(spark):
    df = spark.createDataFrame([(1, '{"a": {}}'), (2, '{"c": [1, 2]}'), (3, '7'), (4, '[[[]]]')], "doc_id long, content string")
    n = walk.nodes(walk.units(walk.parse(df)))
    d = {r.doc_id: r.m for r in n.groupBy("doc_id").agg(F.max("depth").alias("m")).collect()}
    assert d == {1: 1, 2: 2, 3: 0, 4: 2}


def test_chain_walk_matches_recursive_walk(spark):
    import json

    rng = random.Random(11)
    docs = [json.dumps(_rand(rng)) for _ in range(40)] + ['{"s": "]]]}}\\"[[", "t": [[[]]]}']
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string")
    depth = df.agg(F.max(walk.text_depth("content"))).first()[0]
    u = walk.units(walk.parse(df))
    cols = ["doc_id", "path", "depth", "kind", "keyed", "p1", "p6", "fst", "op", "arr_key", "par_arr"]
    a = sorted(tuple(r) for r in walk.nodes(u).select(*cols).collect())
    b = sorted(tuple(r) for r in walk.nodes_chain(u, depth).select(*cols).collect())
    assert a == b


def test_chain_walk_refuses_too_few_levels(spark):
    import pytest

    df = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}}')], "doc_id long, content string")
    with pytest.raises(Exception):
        walk.nodes_chain(walk.units(walk.parse(df)), 1).collect()


def test_shape_profile_equals_full_profile(spark):
    import json

    from fieldscope.plans import pipeline

    rng = random.Random(5)
    trees = [_rand(rng) for _ in range(40)]
    # repeated shapes with different values, root arrays, nulls and empties
    trees += [{"a": [{"x": i}], "b": None if i % 2 else []} for i in range(6)]
    trees += [[{"k": i, "m": [{"z": 1}]}, {"k": None}] for i in range(4)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "doc_id long, content string")
    cols = ["doc_id", "paths", "sig", "null_map", "arr_map", "rec_keys"]

    def rows(p):
        return sorted((r.doc_id, tuple(r.paths), r.sig, tuple(sorted(r.null_map.items())),
                       tuple(sorted(r.arr_map.items())), tuple(sorted(r.rec_keys))) for r in p.select(*cols).collect())

    assert rows(pipeline.file_profile(df, by_shape=True)) == rows(pipeline.file_profile(df, by_shape=False))
    a = pipeline.record_profile(df, by_shape=True).select("doc_id", "record_idx", "paths", "null_map", "arr_map")
    b = pipeline.record_profile(df, by_shape=False).select("doc_id", "record_idx", "paths", "null_map", "arr_map")
    norm = lambda p: sorted((r.doc_id, r.record_idx, tuple(r.paths), tuple(sorted(r.null_map.items())),
                             tuple(sorted(r.arr_map.items()))) for r in p.collect())
    assert norm(a) == norm(b)


def test_object_keys(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [{"d": 1}]}, "e": 2}'), (2, '[{"x": 1}]')], "doc_id long, content string")
    n = walk.nodes(walk.units(walk.parse(df)))
    assert sorted(r.path for r in walk.object_keys(n).collect()) == ["a", "a.b", "a.c", "e"]
    assert sorted(r.path for r in walk.object_keys(n, nested=False).collect()) == ["a", "e"]
