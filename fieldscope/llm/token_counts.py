"""Edit-aware token counts with a tree of pre-token blocks per document.

A leaf is a block of whole pre-tokens with its length and its number of tokens;
a node sums at most ``FANOUT`` children, up to the root. Blocks are cut only
where the pattern always separates pre-tokens: after a letter before anything
else, after a digit before anything else, and before white space. So the sum of
the leaves is the count of the text, in any script and in code. (A run of one
class, such as a long number or ideographs without marks, is one pre-token and
stays whole.)
An edit re-encodes the leaves that it touches, and further leaves only while
the block's new ends are not such cuts (the boundary context). Then the sums on
the path to the root change. Leaves can be stored as two arrays beside the text;
the nodes above them follow from them.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_batches, with_package

LEAF = 128  # characters of a block, about: an edit re-encodes one or two of them
FANOUT = 32
LEAVES = ArrayType(IntegerType())
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\x00-\x1f\x7f-\x9f])(?=[ \t\r\n])")
_ENCODERS: dict[str, object] = {}
_SHIPPED: dict[tuple[str, str], str] = {}


def encoder(name: str, pattern: str):
    if name not in _ENCODERS:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def is_cut(text: str, at: int) -> bool:
    return at in (0, len(text)) or bool(_CUT.match(text, at))


def blocks(text: str) -> list[str]:
    """``text`` in blocks of at least LEAF characters, cut where it is safe."""
    out, start = [], 0
    while start < len(text):
        m = _CUT.search(text, start + LEAF) if len(text) - start > LEAF else None
        stop = m.start() if m else len(text)
        out.append(text[start:stop])
        start = stop
    return out


@dataclass
class Node:
    """Characters and tokens of a leaf, or the sums of its children."""

    chars: int
    tokens: int
    kids: list[Node] | None = None

    @classmethod
    def above(cls, kids: list[Node]) -> Node:
        return cls(sum(k.chars for k in kids), sum(k.tokens for k in kids), kids)


def grouped(kids: list[Node]) -> list[Node]:
    """Nodes above ``kids``, of like sizes up to FANOUT."""
    n = -(-len(kids) // FANOUT)
    cuts = [len(kids) * i // n for i in range(n + 1)] if n else [0]
    return [Node.above(kids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def span(kids: list[Node], first: int, last: int) -> tuple[int, int, int]:
    """The children that hold characters ``first`` and ``last`` (the last child
    for places beyond the end), and the first character of the former."""
    start, i = 0, 0
    while i < len(kids) - 1 and start + kids[i].chars <= first:
        start, i = start + kids[i].chars, i + 1
    end, j = start + kids[i].chars, i
    while j < len(kids) - 1 and end <= last:
        j += 1
        end += kids[j].chars
    return i, j, start


class Tree:
    """Balanced tree of leaves: all have the same depth below ``root``."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self._grow([Node(c, t) for c, t in leaves])

    def _grow(self, top: list[Node]) -> None:
        while len(top) > FANOUT:
            top = grouped(top)
        while len(top) == 1 and top[0].kids is not None:
            top = top[0].kids
        self.root = Node.above(top)

    chars = property(lambda self: self.root.chars)
    tokens = property(lambda self: self.root.tokens)

    def leaf(self, at: int) -> tuple[int, int]:
        """First and end character of the leaf that holds character ``at``; the
        last leaf for the end of the text."""
        node, start = self.root, 0
        while node.kids is not None:
            i, _, off = span(node.kids, at - start, at - start)
            node, start = node.kids[i], start + off
        return start, start + node.chars

    def replace(self, start: int, stop: int, leaves: list[tuple[int, int]]) -> None:
        """Put ``leaves`` in place of those that hold the characters from
        ``start`` to before ``stop``, both ends of leaves."""
        fresh = [Node(c, t) for c, t in leaves]

        def splice(kids: list[Node], start: int, stop: int) -> list[Node]:
            i, j, off = span(kids, start, stop - 1)
            below = kids[i].kids
            if below is None:
                return kids[:i] + fresh + kids[j + 1 :]
            inner = [g for k in kids[i : j + 1] for g in k.kids]
            return kids[:i] + grouped(splice(inner, start - off, stop - off)) + kids[j + 1 :]

        self._grow(splice(self.root.kids, start, stop))

    @property
    def leaves(self) -> list[tuple[int, int]]:
        level = self.root.kids
        while level and level[0].kids is not None:
            level = [g for k in level for g in k.kids]
        return [(k.chars, k.tokens) for k in level]


def edit(tree: Tree, text: str, at: int, deleted: int, inserted: str, count) -> tuple[str, int]:
    """Apply one edit; returns the new text and the characters re-encoded.
    Places beyond the text are cut to its end."""
    at = min(max(at, 0), len(text))
    deleted = min(max(deleted, 0), len(text) - at)
    new = text[:at] + inserted + text[at + deleted :]
    if not text:
        tree.__init__([(len(p), count(p)) for p in blocks(new)])
        return new, len(new)
    start, stop = tree.leaf(at)[0], tree.leaf(max(at, at + deleted - 1))[1]
    shift = len(new) - len(text)
    while not is_cut(new, start):
        start = tree.leaf(start - 1)[0]
    while not is_cut(new, stop + shift):
        stop = tree.leaf(stop)[1]
    region = new[start : stop + shift]
    tree.replace(start, stop, [(len(p), count(p)) for p in blocks(region)])
    return new, len(region)


def build_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, edits)`` with ``leaf_chars`` and ``leaf_tokens``:
    the tree of each text, to be stored with it. Null texts have no leaf."""
    name = _shipped(docs, ranks_path)

    def step(b: pa.RecordBatch) -> dict:
        e = encoder(name, pattern)
        chars, tokens = [], []
        for t in b.column("text").to_pylist():
            parts = blocks(t or "")
            chars.append([len(p) for p in parts])
            tokens.append([len(e.encode_ordinary(p)) for p in parts])
        return {c: b.column(c) for c in ("doc_id", "text", "edits")} | {"leaf_chars": chars, "leaf_tokens": tokens}

    body = docs.select("doc_id", "text", "edits")
    return map_batches(body, step, body.select("*").schema.add("leaf_chars", LEAVES).add("leaf_tokens", LEAVES))


def _shipped(df: DataFrame, path: str) -> str:
    """Ship a file to the workers, under its base name. Another file of that
    name is an error, since workers could not tell the two apart."""
    spark = with_package(df.sparkSession)
    name, app = path.rsplit("/", 1)[-1], spark.sparkContext.applicationId
    if _SHIPPED.setdefault((app, name), path) != path:
        raise ValueError(f"a file named {name} is in use already: {_SHIPPED[app, name]}")
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def count_edited(trees: DataFrame, ranks_path: str, pattern: str, with_text: bool = False) -> DataFrame:
    """Counts before and after each document's ``edits``, an array of (at,
    deleted, inserted) that are applied in order, each to the text so far.

    doc_id, n_tokens, n_leaves, n_edits, n_tokens_edited, n_reencoded
    (characters), edited_sha256; on demand ``edited`` and the new leaves. Null
    texts are empty, null edits none, a null insertion empty. Rows are
    independent of each other, so repeated and null ids are safe.
    """
    name = _shipped(trees, ranks_path)

    def step(b: pa.RecordBatch) -> dict:
        e = encoder(name, pattern)
        count = lambda s: len(e.encode_ordinary(s))
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_leaves", "n_edits", "n_tokens_edited", "n_reencoded", "edited_sha256", "edited", "leaf_chars", "leaf_tokens")}
        for text, edits, chars, tokens in zip(*(b.column(c).to_pylist() for c in ("text", "edits", "leaf_chars", "leaf_tokens")), strict=True):
            tree, text, work = Tree(list(zip(chars, tokens, strict=True))), text or "", 0
            before = tree.tokens, len(chars)
            for x in edits or ():
                text, n = edit(tree, text, x["at"] or 0, x["deleted"] or 0, x["inserted"] or "", count)
                work += n
            leaves = tree.leaves
            row = (*before, len(edits or ()), tree.tokens, work, hashlib.sha256(text.encode()).hexdigest(), text, [c for c, _ in leaves], [k for _, k in leaves])
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        if not with_text:
            for c in ("edited", "leaf_chars", "leaf_tokens"):
                del out[c]
        return {"doc_id": b.column("doc_id")} | out

    schema = trees.select("doc_id").schema.add("n_tokens", "long").add("n_leaves", "integer").add("n_edits", "integer").add("n_tokens_edited", "long").add("n_reencoded", "long").add("edited_sha256", "string")
    if with_text:
        schema = schema.add("edited", "string").add("leaf_chars", LEAVES).add("leaf_tokens", LEAVES)
    return map_batches(trees.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens"), step, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``edits(doc_id, seq, at, deleted, inserted)``
    of its id as an array by ``seq``; null ids have none."""
    per_doc = edits.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "deleted", "inserted"))).alias("e"))
    put = F.transform(F.col("e"), lambda x: F.struct(x["at"].alias("at"), x["deleted"].alias("deleted"), x["inserted"].alias("inserted")))
    return docs.select("doc_id", "text").join(per_doc, "doc_id", "left").select("doc_id", "text", put.alias("edits"))


def derived_edits(docs: DataFrame, edits: int = 3) -> DataFrame:
    """``docs`` with an edit script derived from each row: ``edits`` times, at
    a place drawn by a hash, a few characters go and a piece of the text comes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    place = lambda i, salt: F.pmod(F.xxhash64(text, F.lit(i), F.lit(salt)), n).cast("int")
    one = lambda i: F.struct(place(i, 1).alias("at"), F.lit(5 + 4 * i).alias("deleted"), F.substr(text, place(i, 2) + 1, F.lit(9 + 6 * i)).alias("inserted"))
    return docs.select("doc_id", "text", F.array(*[one(i) for i in range(edits)]).alias("edits"))
