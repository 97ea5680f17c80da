"""SentencePiece encoding and decoding by a table of distinct marked words.

The tokenizer writes every space as a marker and puts one more marker before
the text. No piece of the vocabulary crosses from other characters into a
marker, so a text falls into independent marked words: a run of markers and
the characters up to the next marker. Each distinct marked word is segmented
once by the library and kept in a table; a text's ids are its words' ids
joined back by position, and its decoding is its words' decodings joined.

Each Python worker builds the table for the rows it reads. Joining 10 ids a
line back over a shuffle would move several times the input, and a table for
the whole corpus is not bounded, so it is not broadcast. A table that reaches
``TABLE_WORDS`` is begun again, which costs time only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_batches, with_package

MARK = "▁"
TABLE_WORDS = 400_000
LONGEST_KEPT = 256  # longer marked words are segmented where they stand, not kept
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker: marked words are not independent")
        if self.sp.encode(" ") != [self.sp.piece_to_id(MARK * 2)] or self.sp.encode("a", out_type=str)[:1] not in ([MARK + "a"], [MARK]):
            raise ValueError("the model does not keep white space and add a leading marker")
        self.lone = [self.sp.piece_to_id(MARK)]
        self.table: dict[str, tuple[str, int, str]] = {}

    def segment(self, word: str) -> tuple[str, int, str]:
        """Ids (joined by commas), their number, and the decoding of a marked word."""
        if word == MARK:
            return str(self.lone[0]), 1, " "
        ids = self.sp.encode(word[1:])  # the library puts the first marker back
        return ",".join(map(str, ids)), len(ids), " " + self.sp.decode(ids)

    def lookup(self, word: str) -> tuple[str, int, str]:
        if len(word) > LONGEST_KEPT:
            return self.segment(word)
        if len(self.table) >= TABLE_WORDS:
            self.table.clear()
        got = self.table[word] = self.segment(word)
        return got

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        words = MARKED_WORD.findall(MARK + text.replace(" ", MARK))
        get, lookup = self.table.get, self.lookup
        rows = [get(w) or lookup(w) for w in words]
        ids, counts, decoded = zip(*rows, strict=True)
        return sum(counts), ",".join(ids), "".join(decoded)[1:]  # without the added marker


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _CODECS:
        with open(SparkFiles.get(name), "rb") as f:
            _CODECS[name] = Codec(f.read())
    return _CODECS[name]


def _shipped(df: DataFrame, model_path: str) -> str:
    spark = with_package(df.sparkSession)
    name = model_path.rsplit("/", 1)[-1]
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(model_path)
    return name


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_tokens, ids_sha256, decoded_sha256,
    and on demand ``ids`` (array) and ``decoded`` (text).

    One row per input row, in one narrow pass. Null reads as empty: no ids,
    empty decoding. Other columns are ignored, ids of documents are carried
    only, so repeated and null ones are safe.
    """
    name = _shipped(docs, model_path)

    def step(b: pa.RecordBatch) -> dict:
        c = codec(name)
        n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
        for t in b.column("text").to_pylist():
            k, joined, back = c.encode(t)
            n.append(k)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                ids.append([int(x) for x in joined.split(",")] if k else [])
            if with_text:
                decoded.append(back)
        out = {"doc_id": b.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}
        return out | ({"ids": ids} if with_ids else {}) | ({"decoded": decoded} if with_text else {})

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    if with_text:
        schema = schema.add("decoded", "string")
    return map_batches(docs.select("doc_id", "text"), step, schema)
