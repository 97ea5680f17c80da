"""The pipeline's stages take effect and hand on the columns of documents."""

import random

import corpus_pipeline
from fieldscope.llm import common, contamination, order_minhash, toxicity
from fieldscope.llm.common import Scratch
from fieldscope.llm.queries import table

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [ids(docs)]
    toxic = {r[0] for r in toxicity.score(docs, table(spark, SF, "labels")).filter("predicted = 1").select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(ids(docs))
        assert k == 4 or docs.columns == columns
        if k == 0:
            assert seen[1] == seen[0] - toxic
        if k == 1:
            assert seen[2] == {r[1] for r in order_minhash.classes(before).collect()}
        if k == 2:
            dirty = contamination.contamination(before, table(spark, SF, "benchmark")).filter("contaminated")
            assert seen[3] == seen[2] - ids(dirty)
    assert seen[3] == seen[4] == seen[5] and docs.count() == len(seen[5])


def test_near_dedup_joins_only_the_rare_end_of_a_crowd(spark, monkeypatch):
    """Of near copies that do not all link, the counts of shingles meet a fifth of
    each text's, and the rows kept are those of a plain statement."""
    monkeypatch.setattr(order_minhash, "SMALL", 2)
    given, counted = order_minhash._given, []

    def seen(wanted, shared=None):
        out = given(wanted, shared)
        counted.append((shared is not None, out.count()))
        return out

    monkeypatch.setattr(order_minhash, "_given", seen)
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(24):  # 40 words of each third, one changed: links within a third only
        w = list(base)
        w[:40] = [f"g{i % 3}x{k}" for k in range(40)]
        w[40 + 3 * i] = "changed"
        rows.append((i, " ".join(w), "en", "web", 1))
    codes = [order_minhash.word_codes(order_minhash.words_of(r[1])) for r in rows]
    root = list(range(24))
    for i in range(24):
        for j in range(i):
            if order_minhash.similarity(codes[i], codes[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(corpus_pipeline.near_dedup(spark, docs, "")) == set(root) and len(set(root)) == 3
    (_, every), (_, some) = sorted(counted)
    assert every > 24 * 100 and some < every / 3


def shuffled(plan, column, out):
    """``out`` with the data size of each shuffle of an executed plan that moves ``column``."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
        return shuffled(plan.executedPlan() if name[0] == "A" else plan.plan(), column, out)
    if name == "ShuffleExchangeExec" and column in plan.output().mkString(" "):
        out.append(plan.metrics().apply("dataSize").value())
    for i in range(plan.children().size()):
        shuffled(plan.children().apply(i), column, out)
    return out


def test_near_dedup_shuffles_only_texts_that_may_have_copies(spark, monkeypatch):
    """Without broadcasts of small tables: texts that no other shares a bucket with
    are not moved, nor words of nodes that are in no pair; the rows are the same."""
    rng = random.Random(21)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(400)]
    base = [text() for _ in range(200)]
    near = [[*base[i][:200], "other", *base[i][201:]] for i in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(300 + i, " ".join(w)) for i, w in enumerate(near)]
    rows += [(400, " ".join(base[9])), (401, None), (401, ""), (None, " ".join(base[10])), (11, " ".join(base[11])), (12, " ".join(base[13])), (None, " ".join(text()))]
    moved, keep = [], Scratch.keep

    def kept(self, df):
        if "text#" in df._jdf.queryExecution().executedPlan().toString():
            df.collect()
        shuffled(df._jdf.queryExecution().executedPlan(), "text", moved)
        return keep(self, df)

    docs = keep(Scratch(spark), spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(Scratch, "keep", kept)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = order_minhash.representatives(docs)
        got = out.collect()
        shuffled(out._jdf.queryExecution().executedPlan(), "text", moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    # copies go; of 12's rows one is of its own class, one of 13's
    gone = {300 + i for i in range(8)} | {400, 13}
    assert {r[0] for r in got if r[0] is not None} == {r[0] for r in rows if r[0] is not None} - gone
    whole = sum(len(t) for _, t in rows if t)
    assert moved and sum(moved) < whole / 2


def test_likely_loses_no_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i, str(i)) for i in range(5000)] + [(None, "x"), (7, None)], "k long, _slot string")
    keys = spark.createDataFrame([(i,) for i in range(0, 5000, 50)] + [(None,), (9999,)], "id long")
    same = lambda df: sorted(map(str, df.collect()))
    exact = rows.join(keys, rows["k"].eqNullSafe(keys["id"]), "left_semi")
    for slots in (1 << 18, 16, 1):
        monkeypatch.setattr(common, "SLOTS", slots)
        some, others = common.likely(rows, "k", keys), common.likely(rows, "k", keys, "left_anti")
        assert same(some.join(keys, some["k"].eqNullSafe(keys["id"]), "left_semi")) == same(exact) and same(some.unionByName(others)) == same(rows)
        assert others.join(keys, others["k"].eqNullSafe(keys["id"]), "left_semi").count() == 0
        if slots > 16:
            assert some.count() < 120
    assert common.likely(rows, "k", keys.limit(0)).count() == 0 and common.likely(rows, "k", keys.limit(0), "left_anti").count() == 5002
