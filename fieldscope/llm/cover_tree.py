"""A cover tree over a block of unit vectors, and the dual traversal of two of
them that finds all pairs within a distance.

Levels are nested and their radii halve: a node of level l stands for the
vectors within 2^(1-l) of its centre, and its centre is also the centre of its
first child. Children are a greedy net of the node's vectors. A node keeps its
covering radius, the largest distance from its centre to a vector below it,
which is at most the level's radius and often far less.

The traversal starts at the two roots. Of a pair of nodes it compares the
centres of all children at once and settles what the covering radii settle:
centres further apart than the threshold and both radii are dropped, nodes
whose vectors must all be within the threshold are linked as a whole, and the
rest go down a level.
"""

from __future__ import annotations

import numpy as np

LEAF = 16  # a node of so many vectors or fewer has them as its children
WIDE = 0.25  # and such a node wider than this is no node at all: they are its parent's children
STEP = 256  # centres tried at a time
FINEST = 24  # levels; vectors closer than 2^-23 stay together in a leaf
SLACK = 1e-7  # bounds from rounded distances settle nothing closer to the threshold than this
TILE = 2048  # centres compared at a time
DENSE = 32  # so many pairs of centres in one product cost about what one pair by itself does
HELD_PAIRS = 1 << 21
HELD_EDGES = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1, safe for very large and very small components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(x: np.ndarray, members: np.ndarray, centre: int, d: np.ndarray, reach: float):
    """A greedy net: (centre, its vectors, the largest distance among them) of
    each child. ``d`` are the distances from ``centre``, the first child's;
    further centres are the first vectors left, in order."""
    y = x[members]
    left = d > reach
    own = np.flatnonzero(~left)
    yield int(centre), members[own], float(d[own].max())
    todo = np.flatnonzero(left)
    for at in range(0, len(todo), STEP):
        at_once = todo[at : at + STEP]
        at_once = at_once[left[at_once]]
        others = np.flatnonzero(left)
        near = distances(y[at_once], y[others])
        inside = near <= reach
        for k, c in enumerate(at_once.tolist()):
            if left[c]:
                own = np.flatnonzero(inside[k] & left[others])
                own = np.union1d(own, np.searchsorted(others, [c]))
                left[others[own]] = False
                yield int(members[c]), members[others[own]], float(near[k, own].max()) if len(own) > 1 else 0.0


class CoverTree:
    """Nodes as arrays. The vectors below a node are ``order[start:stop]``; its
    children are the nodes ``first:last`` (none for a single vector)."""

    def __init__(self, order, centre, radius, start, stop, first, last):
        self.order, self.centre, self.radius = order, centre, radius
        self.start, self.stop, self.first, self.last = start, stop, first, last

    @classmethod
    def build(cls, x: np.ndarray) -> CoverTree:
        order = np.arange(len(x))
        nodes = [[0, 0.0, 0, len(x), 0, 0]]  # centre, radius, start, stop, first, last
        todo = [(0, 0)]  # node, level
        while todo:
            at, level = todo.pop()
            centre, _, start, stop, _, _ = nodes[at]
            members = order[start:stop].copy()
            d = np.sqrt(np.maximum(2.0 - 2.0 * (x[members] @ x[centre]), 0.0))
            d[members == centre] = 0.0
            nodes[at][1] = float(d.max())
            if stop - start == 1:
                continue
            nodes[at][4] = len(nodes)
            if stop - start <= LEAF or level + 1 >= FINEST:
                nodes += [[int(m), 0.0, start + i, start + i + 1, 0, 0] for i, m in enumerate(members.tolist())]
            else:
                begin = start
                for child, own, far in net(x, members, centre, d, 2.0**-level):
                    order[begin : begin + len(own)] = own
                    if len(own) == 1 or (len(own) <= LEAF and far > WIDE):
                        nodes += [[int(m), 0.0, begin + i, begin + i + 1, 0, 0] for i, m in enumerate(own.tolist())]
                    else:
                        todo.append((len(nodes), level + 1))
                        nodes.append([child, 0.0, begin, begin + len(own), 0, 0])
                    begin += len(own)
            nodes[at][5] = len(nodes)
        centre, radius, start, stop, first, last = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(order.astype(np.int32), centre.astype(np.int32), radius.astype(np.float64), start.astype(np.int32), stop.astype(np.int32), first.astype(np.int32), last.astype(np.int32))

    def arrays(self) -> list[np.ndarray]:
        return [self.order, self.centre, self.radius, self.start, self.stop, self.first, self.last]


def smallest_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 under links (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == label).all():
            return label
        label = new


class Links:
    """What a traversal finds: links per vector, weighted by the copies of the
    other side, and the components, not the links themselves."""

    def __init__(self, n_a: int, n_b: int, copies_a: np.ndarray, copies_b: np.ndarray, same: bool):
        self.same, self.offset = same, 0 if same else n_a
        self.n = n_a if same else n_a + n_b
        self.copies_a, self.copies_b = copies_a, copies_b
        self.degree_a, self.degree_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def whole(self, rows: np.ndarray, cols: np.ndarray):
        """All of ``rows`` are linked with all of ``cols``."""
        self.degree_a[rows] += self.copies_b[cols].sum()
        self.degree_b[cols] += self.copies_a[rows].sum()
        self.join(rows, np.full(len(rows), cols[0]))
        self.join(np.full(len(cols), rows[0]), cols)

    def single(self, rows: np.ndarray, cols: np.ndarray):
        """rows[i] is linked with cols[i]."""
        np.add.at(self.degree_a, rows, self.copies_b[cols])
        np.add.at(self.degree_b, cols, self.copies_a[rows])
        self.join(rows, cols)

    def join(self, rows, cols):
        self.edges.append((rows.astype(np.int64), cols.astype(np.int64) + self.offset))
        self.held += len(rows)
        if self.held > HELD_EDGES:
            self.edges = [self.forest()]
            self.held = len(self.edges[0][0])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """One link to the smallest node of its component for every other node."""
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(c) for c in zip(*self.edges, strict=True))
        root = smallest_of_component(self.n, a, b)
        linked = np.flatnonzero(root != np.arange(self.n))
        return root[linked], linked


def below(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes`` (a single vector stays), and the place in
    ``nodes`` of each one's parent."""
    count = np.maximum(tree.last[nodes] - tree.first[nodes], 1)
    parent = np.repeat(np.arange(len(nodes)), count)
    within = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
    single = tree.last[nodes] == 0
    return np.where(single, nodes, tree.first[nodes])[parent] + within, parent


def pairs_within(x: np.ndarray, tree_x: CoverTree, copies_x, y: np.ndarray, tree_y: CoverTree, copies_y, least_cosine: float, same: bool) -> Links:
    """Dual traversal of the trees over ``x`` and ``y`` (``same``: one block
    with itself, where every pair is met in both orders and none is a vector
    with itself), a level of both at a time."""
    reach = np.sqrt(2.0 - 2.0 * least_cosine)
    links = Links(len(x), len(y), copies_x, copies_y, same)

    def settle(k: np.ndarray, m: np.ndarray, cosine: np.ndarray):
        """Link what is within reach; return the pairs of nodes left open."""
        one = (tree_x.last[k] == 0) & (tree_y.last[m] == 0)
        # two single vectors: the cosine itself decides, summed anew where it is close
        u, v, cos = tree_x.centre[k[one]], tree_y.centre[m[one]], cosine[one]
        close = np.abs(cos - least_cosine) < SLACK
        cos[close] = (x[u[close]] * y[v[close]]).sum(1)
        hit = (cos >= least_cosine) & ~((u == v) if same else np.zeros(len(u), bool))
        if hit.any():
            links.single(u[hit], v[hit])
        k, m = k[~one], m[~one]
        d = np.sqrt(np.maximum(2.0 - 2.0 * cosine[~one], 0.0))
        both = tree_x.radius[k] + tree_y.radius[m]
        inside = d + both <= reach - SLACK
        if same:
            inside &= k != m  # a node with itself holds its vectors' pairs with themselves
        for s, t in zip(k[inside].tolist(), m[inside].tolist(), strict=True):
            links.whole(tree_x.order[tree_x.start[s] : tree_x.stop[s]], tree_y.order[tree_y.start[t] : tree_y.stop[t]])
        left = ~inside & (d - both <= reach + SLACK)
        return k[left], m[left]

    def within(rows: np.ndarray, cols: np.ndarray, keep=None):
        """Pairs of nodes that the covering radii do not drop, of all rows and
        columns or of those that ``keep`` marks, with the cosines of their centres."""
        for r in range(0, len(rows), TILE):
            for c in range(0, len(cols), TILE):
                some, other = rows[r : r + TILE], cols[c : c + TILE]
                cosine = x[tree_x.centre[some]] @ y[tree_y.centre[other]].T
                wide_r, wide_c = tree_x.radius[some], tree_y.radius[other]
                if wide_r.any() or wide_c.any():
                    near = cosine >= 1.0 - (reach + SLACK + wide_r[:, None] + wide_c[None, :]) ** 2 / 2.0
                    near |= wide_r[:, None] + wide_c[None, :] + reach >= 2.0
                else:
                    near = cosine >= least_cosine - SLACK
                if keep is not None:
                    near &= keep[r : r + TILE, c : c + TILE]
                k, m = np.nonzero(near)
                if len(k):
                    yield some[k], other[m], cosine[k, m]

    def by_width(tree: CoverTree, nodes: np.ndarray, parent: np.ndarray):
        """Nodes with a radius apart from those without, so that the plain test serves most."""
        wide = tree.radius[nodes] > 0
        return [(nodes[w], parent[w]) for w in (wide, ~wide) if w.any()]

    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, m = todo.pop()
        rows, of_k = np.unique(k, return_inverse=True)
        cols, of_m = np.unique(m, return_inverse=True)
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        if DENSE * len(k) >= len(rows) * len(cols) and len(rows) * len(cols) <= TILE * TILE:
            marked = np.zeros((len(rows), len(cols)), bool)
            marked[of_k, of_m] = True
            for some, p in by_width(tree_x, *below(tree_x, rows)):
                for other, q in by_width(tree_y, *below(tree_y, cols)):
                    keep = None if marked.all() else marked[p][:, q]
                    open_ += [settle(*pairs) for pairs in within(some, other, keep)]
        else:
            for at in range(0, len(k), TILE):
                # pairs of children one by one: the children of k, each with the children of m
                some, p = below(tree_x, k[at : at + TILE])
                other, q = below(tree_y, m[at : at + TILE][p])
                for i in range(0, len(other), TILE * DENSE):
                    u, v = some[q[i : i + TILE * DENSE]], other[i : i + TILE * DENSE]
                    cosine = np.einsum("ij,ij->i", x[tree_x.centre[u]], y[tree_y.centre[v]])
                    far = reach + SLACK + tree_x.radius[u] + tree_y.radius[v]
                    near = (cosine >= 1.0 - far * far / 2.0) | (far >= 2.0)
                    open_.append(settle(u[near], v[near], cosine[near]))
        open_ = [o for o in open_ if len(o[0])]
        if open_:
            k, m = (np.concatenate(c) for c in zip(*open_, strict=True))
            todo += [(k[i : i + HELD_PAIRS], m[i : i + HELD_PAIRS]) for i in range(0, len(k), HELD_PAIRS)]
    if same:  # both orders were met
        links.degree_b[:] = 0
    return links
