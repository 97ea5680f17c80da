"""The operators on vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.llm import cover_tree, embedding_dedup, hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, cell string, n string, h1 long, entry string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], VECTORS).repartition(3)


def crowd(rng, n, dim, groups):
    x = rng.normal(size=(n, dim))
    for _ in range(groups):
        at = rng.choice(n, rng.integers(2, max(3, n // 8)), replace=False)
        x[at] = x[at[0]] + rng.normal(size=(len(at), dim)) * rng.uniform(0.02, 0.5)
    return x


@pytest.mark.parametrize("n, dim, groups", [(600, 16, 8), (400, 3, 4), (300, 2, 0), (500, 64, 6), (1, 4, 0), (2, 5, 0)])
def test_trees_and_traversal(n, dim, groups):
    rng = np.random.default_rng(n)
    x, y = cover_tree.unit(crowd(rng, n, dim, groups) if n > 2 else np.ones((n, dim))), cover_tree.unit(crowd(rng, 200, dim, 3))
    copies, other = rng.integers(1, 5, n), rng.integers(1, 5, 200)
    tree, tree_y = cover_tree.CoverTree.build(x), cover_tree.CoverTree.build(y)
    for k in range(len(tree.centre)):  # nested, covering, and every vector once
        below = tree.order[tree.start[k] : tree.stop[k]]
        assert tree.centre[k] in below
        assert np.linalg.norm(x[below] - x[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-6
        if tree.last[k]:
            children = range(tree.first[k], tree.last[k])
            assert sorted(v for c in children for v in tree.order[tree.start[c] : tree.stop[c]]) == sorted(below)
            assert tree.centre[k] in tree.centre[tree.first[k] : tree.last[k]]
    for a, ta, ca, b, tb, cb, same in ((x, tree, copies, y, tree_y, other, False), (x, tree, copies, x, tree, copies, True)):
        links = cover_tree.pairs_within(a, ta, ca, b, tb, cb, 0.9, same)
        linked = a @ b.T >= 0.9
        if same:
            np.fill_diagonal(linked, False)
        assert (links.degree_a == (linked * cb).sum(1)).all()
        assert same or (links.degree_b == (linked * ca[:, None]).sum(0)).all()
        k, m = np.nonzero(linked)
        u, v = links.forest()
        assert len(u) < links.n
        assert (cover_tree.smallest_of_component(links.n, u, v) == cover_tree.smallest_of_component(links.n, k, m + links.offset)).all()


def brute_links(rows, least=0.9):
    by = {}
    for i, v, *_ in rows:
        if i is not None:
            ok = v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
            by.setdefault(i, []).append(tuple(v) if ok else None)
    one = {i: min((v for v in vs if v), default=None) for i, vs in by.items()}
    ids = sorted(one)
    links = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            a, b = one[i], one[j]
            if i < j and a and b and len(a) == len(b):
                u, v = cover_tree.unit(np.array([a]))[0], cover_tree.unit(np.array([b]))[0]
                if float((u * v).sum()) >= least:
                    links[i].add(j), links[j].add(i)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return [(i, len(links[i]), root[i], root[i] == i) for i in ids]


@pytest.mark.parametrize("block", [4096, 40])
def test_near_duplicates(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    rows = [(i, v, 0) for i, v in enumerate(crowd(rng, 160, 8, 6).tolist())]
    rows += [(1000 + i, rows[3][1], 0) for i in range(70)]  # copies
    rows += [(2000, [2 * c for c in rows[3][1]], 0), (2001, [c * 1e200 for c in rows[5][1]], 0), (2002, [c * 1e-300 for c in rows[5][1]], 0)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 8, 0), (3003, [float("nan")] * 8, 0), (3004, [1.0, None] * 4, 0), (3005, [float("inf")] * 8, 0)]
    rows += [(3006, [1.0, 0.0, 0.0], 0), (3007, [0.95, 0.1, 0.1], 0), (None, rows[3][1], 0), (7, rows[7][1], 0), (8, None, 0), (9, [9.0] * 8, 0)]
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", (3, 2))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(frame(spark, rows)).collect()))
    assert got == brute_links(rows)
    assert embedding_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (0.01, 1, 300, 1e6, 1e30):
        anchors, rows = rng.normal(size=(7, 9)) * size, rng.normal(size=(70, 9)) * size
        a, r = hard_negatives.integers(anchors), hard_negatives.integers(rows)
        packed = hard_negatives.Packed(r, a.min(), a.max())
        whole = [[sum(math.floor(p * 256) * math.floor(q * 256) for p, q in zip(u, v)) for v in rows.tolist()] for u in anchors.tolist()]
        most = np.iinfo(np.int64).max
        assert packed.scores(a).tolist() == [[max(1 - most, min(most, s)) for s in row] for row in whole]
        assert size > 1 or packed.fields > 1
    same = hard_negatives.integers(np.full((3, 4), -0.5))
    assert hard_negatives.Packed(same, -128, -128).scores(same).tolist() == [[4 * 128 * 128] * 3] * 3


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    by = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            by.setdefault(i, []).append((label, tuple(v)))
    one = {i: min(r) for i, r in by.items()}
    whole = {i: [math.floor(c * 256) for c in v] for i, (_, v) in one.items()}
    out = []
    for a in filter(is_anchor, one):
        score = {i: sum(p * q for p, q in zip(whole[a], whole[i])) for i in one if i != a and len(whole[i]) == len(whole[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == one[a][0]][:positives]:
            fit = [i for i in order if one[i][0] != one[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("anchor_block, rows_a_block, tile", [(8192, 4096, 512), (6, 30, 4)])
def test_hard_negatives(spark, monkeypatch, anchor_block, rows_a_block, tile):
    rng = np.random.default_rng(tile)
    x = crowd(rng, 200, 6, 8)
    x[:60] = np.round(x[:60])  # ties
    rows = [(i, v, int(rng.integers(0, 3))) for i, v in enumerate(x.tolist())]
    rows += [(1000 + i, rows[20][1], 1) for i in range(60)] + [(10, rows[11][1], 0), (20, rows[20][1], rows[20][2])]
    rows += [(2000, None, 1), (2010, [], 1), (2020, [float("nan")] * 6, 1), (2030, [1.0, None] * 3, 1), (2040, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(2050, [0.0] * 6, 1), (2060, [1.0, 2.0], 1), (2061, [1.0, 1.5], 1), (2062, [0.5, 0.9], 2), (2070, [-1.0] * 6, 7), (2071, [1e-9] * 6, 7)]
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchor_block)
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block=rows_a_block, tile_rows=tile).collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
