"""Document sources: folders of files, string columns, decoding and the
tolerant loader (S1-S5).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.syntax import NO_STRUCTURE, syntax_verdict

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def _empty_files(spark: SparkSession, root: str, glob: str) -> list[tuple]:
    """Zero-length files matching ``glob`` under ``root``.

    File sources skip empty files, but an empty document is a finding ("File
    is empty"), so they are listed from file-system metadata (no content is
    read; the listing is the same kind the file index itself does)."""
    import fnmatch

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    out = []
    it = fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        if st.getLen() == 0 and fnmatch.fnmatch(st.getPath().getName(), glob):
            out.append((st.getPath().toString(), None, 0, bytearray()))
    return out


def read_folder(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Every ``*.json`` under ``root`` (recursive), one row per file:
    ``path, modificationTime, length, content BINARY, in_root BOOLEAN``.
    Large folders split across tasks by file; ``doc_id`` is the full path.
    Zero-length files are kept (with empty content)."""
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    empty = _empty_files(spark, root, glob)
    if empty:
        df = df.unionByName(spark.createDataFrame(empty, BINARY_FILE_SCHEMA))
    given = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  one spelling of local paths
    parent = F.regexp_replace(F.col("path"), "/[^/]*$", "")
    return df.withColumn("in_root", plain(parent) == plain(F.lit(qualified)))


def folder_counts(files: DataFrame) -> DataFrame:
    """Files directly in the root folder vs in subfolders."""
    return files.agg(F.count_if("in_root").alias("root_files"), F.count_if(~F.col("in_root")).alias("subfolder_files"))


# Classes of bytes that the detector counts.
_CONTROL = np.r_[0x00:0x09, 0x0B, 0x0C, 0x0E:0x20, 0x7F]
_UNDEFINED = np.array([0x81, 0x8D, 0x8F, 0x90, 0x9D])
_HIGH_LETTER = np.zeros(256, dtype=bool)
_HIGH_LETTER[0xC0:] = True
_HIGH_LETTER[[0xD7, 0xF7]] = False
_LETTER = _HIGH_LETTER.copy()
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_FACTS = ("le", "be", "low", "high", "n_high", "control", "c1", "undefined", "beside", "marks")


def _pairs_up(units: np.ndarray) -> bool:
    """Whether every surrogate among UTF-16 code units is one of a pair."""
    first, second = (units & 0xFC00) == 0xD800, (units & 0xFC00) == 0xDC00
    return not units.size or not (first[-1] or second[0]) and bool((first[:-1] == second[1:]).all())


def _facts_of(content: bytes) -> tuple:
    a = np.frombuffer(content, np.uint8)
    seen, even = np.bincount(a, minlength=256), a[:a.size // 2 * 2]
    le = be = True
    if seen[0xD8:0xE0].any():
        le, be = _pairs_up(even.view("<u2")), _pairs_up(even.view(">u2"))
    low, high = (np.count_nonzero(even[1::2] == 0), np.count_nonzero(even[::2] == 0)) if seen[0] else (0, 0)
    beside = 0
    if seen[_HIGH_LETTER].any():
        letter, near = _LETTER[a], np.zeros(a.size, dtype=bool)
        near[1:] = letter[:-1]
        near[:-1] |= letter[1:]
        beside = np.count_nonzero(_HIGH_LETTER[a] & near)
    return (le, be, low, high, *(int(x.sum()) for x in (seen[0x80:], seen[_CONTROL], seen[0x80:0xA0], seen[_UNDEFINED])), beside, int(seen[0xA0:0xC0].sum()))


@arrow_udf(T.StructType([T.StructField(f, T.BooleanType() if f in ("le", "be") else T.IntegerType()) for f in _FACTS]))
def _byte_facts(content: pa.Array) -> pa.Array:
    """Of bytes: whether their surrogates pair up as UTF-16 of either order,
    units with a zero in the second (``low``) and first byte, and the counts
    of single bytes that ``detect`` reads."""
    rows = [(None,) * len(_FACTS) if c is None else _facts_of(c) for c in content.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [()] * len(_FACTS)
    return pa.StructArray.from_arrays([pa.array(x, pa.bool_() if f in ("le", "be") else pa.int32()) for f, x in zip(_FACTS, columns, strict=True)], _FACTS)


# The characters of bytes 80-9F in Windows code page 1252, in
# order; U+FFFD marks the five bytes without one.
CP1252_HIGH = "€\ufffd‚ƒ„…†‡ˆ‰Š‹Œ\ufffdŽ\ufffd\ufffd‘’“”•–—˜™š›œ\ufffdžŸ"
LEAST_CONFIDENCE = 0.7


def detect(content: Column, facts: Column | None = None) -> tuple[Column, Column]:
    """S2's detector: (encoding, confidence) of bytes without a byte order
    mark, from counts over all of them.

    - Text has no NUL, UTF-16 of mostly Latin text has one in most units. The
      side of the units that holds them tells the order; confidence is how far
      that side leads.
    - Single bytes: in Latin-1 80-9F are control characters, in code page 1252
      all but five of them are punctuation. Confidence is the share of high
      bytes that stand as text does: letters beside letters, punctuation.
    - Other control characters make any text unlikely.

    ``facts``: the bytes' ``_byte_facts``, where they are known.
    """
    facts = _byte_facts(content) if facts is None else facts
    low, high, n_high, control, c1, undefined, beside, marks = (facts[f] for f in _FACTS[2:])
    zeros, n_units = low + high, F.greatest(F.floor(F.length(content) / 2), F.lit(1))
    even = F.length(content) % 2 == 0
    lead = F.abs(low - high) / F.greatest(zeros, F.lit(1))
    wide = even & (zeros * 10 >= n_units)

    stand = (beside + marks + F.when(undefined == 0, c1).otherwise(0)) / F.greatest(n_high, F.lit(1))
    single = F.when((n_high > 0) & (control == 0) & (zeros == 0), stand).otherwise(0.0)
    encoding = F.when(wide, F.when(low > high, F.lit("utf-16-le")).otherwise(F.lit("utf-16-be"))).when(
        single > 0, F.when((c1 > 0) & (undefined == 0), F.lit("cp1252")).otherwise(F.lit("iso-8859-1")))
    return encoding, F.when(wide, lead).otherwise(single)


def decode_detected(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text``, ``encoding`` and ``confidence``. UTF-8 and marked
    UTF-16 are read as ``decode`` does; other bytes, and UTF-8 that is really
    unmarked UTF-16 of ASCII, as the detector says where it is confident; the
    rest as ``decode`` does. Lone surrogates cannot be decoded (NULL)."""
    c = F.col(content)
    # bytes that are UTF-8 without a NUL, or marked, need no guess; the others are counted once
    plain = F.call_function("is_valid_utf8", c) & ~F.contains(c, F.lit(bytearray(1)))
    df = df.withColumn("_plain_utf8", plain)
    df = df.withColumn("_facts", _byte_facts(F.when(~F.col("_plain_utf8"), c)))
    text, enc = decode(c, F.col("_facts"))
    guess, confidence = detect(c, F.col("_facts"))
    d = df.withColumn("_enc", enc).withColumn("_plain", text)
    sure = (F.col("_enc") == "utf-16") | F.col("_plain_utf8")
    unsure = F.coalesce(~sure, F.lit(True)) & (F.length(c) > 0)
    d = d.withColumn("_guess", F.when(unsure, guess)).withColumn("_conf", F.when(unsure, confidence))
    found = F.when(F.col("_conf") > LEAST_CONFIDENCE, F.col("_guess"))
    latin = F.decode(c, "ISO-8859-1")
    c1 = "".join(chr(0x80 + i) for i, ch in enumerate(CP1252_HIGH) if ch != "\ufffd")
    le, be = (found == "utf-16-le") & F.col("_facts.le"), (found == "utf-16-be") & F.col("_facts.be")
    text = (
        F.when(le, F.decode(c, "UTF-16LE")).when(be, F.decode(c, "UTF-16BE"))
        .when(found == "cp1252", F.translate(latin, c1, CP1252_HIGH.replace("\ufffd", ""))).when(found == "iso-8859-1", latin)
        .otherwise(F.col("_plain"))
    )
    used = le | be | found.isin("cp1252", "iso-8859-1")
    return d.withColumn("text", text).withColumn("encoding", F.when(used, found).otherwise(F.col("_enc"))).withColumn(
        "confidence", F.when(used, F.col("_conf")).when(F.col("_enc").isNotNull(), 1.0)).drop("_enc", "_plain", "_guess", "_conf", "_facts", "_plain_utf8")


def decode(content: Column, facts: Column | None = None) -> tuple[Column, Column]:
    """S2's rules: bytes -> (text, encoding).

    Valid UTF-8 is read as UTF-8 (a UTF-8 BOM stays a U+FEFF character, as
    with Python's ``utf-8`` codec, and is removed by the loader); a UTF-16
    BOM selects UTF-16; otherwise even-length data is tried as UTF-16-LE;
    anything else, a lone surrogate included, cannot be decoded (NULL).
    ``decode_detected`` puts a statistical detector before the last two.
    ``facts``: the ``_byte_facts`` of bytes that are not UTF-8, where known.
    """
    head = F.hex(F.substring(content, 1, 2))
    utf8 = F.call_function("is_valid_utf8", content)
    facts = _byte_facts(F.when(~utf8, content)) if facts is None else facts
    even = F.length(content) % 2 == 0
    big, little = even & (head == "FEFF") & facts["be"], even & facts["le"]
    little_bom, little_bare = little & (head == "FFFE"), little & ~head.isin("FFFE", "FEFF")
    enc = F.when(utf8, F.lit("utf-8")).when(big | little_bom, F.lit("utf-16")).when(little_bare, F.lit("utf-16-le"))
    text = (
        F.when(utf8, F.decode(content, "UTF-8"))
        .when(big | little_bom, F.decode(content, "UTF-16"))
        .when(little_bare, F.decode(content, "UTF-16LE"))
    )
    return text, enc


_TRAILING = re.compile(r",(\s*[}\]])")

REPAIR_T = T.StringType()
# Fixed value: ends a text that stands in an array; texts that hold it go through Python.
_MARK = "fieldscope:end-of-text"


@pandas_udf(REPAIR_T)
def _repair_kind(text: pd.Series) -> pd.Series:
    out = []
    for t in text:
        if t is None:
            out.append(None)
            continue
        try:
            json.loads(t)
            out.append("none")
            continue
        except (ValueError, RecursionError):
            pass
        if t.startswith("\ufeff"):
            t = t[1:]
            try:
                json.loads(t)
                out.append("bom")
                continue
            except (ValueError, RecursionError):
                pass
        fixed = _TRAILING.sub(r"\1", t)
        if fixed != t:
            try:
                json.loads(fixed)
                out.append("trailing_comma")
                continue
            except (ValueError, RecursionError):
                pass
        out.append("failed")
    return pd.Series(out, dtype=object)


_repair_kind = _repair_kind.asNondeterministic()  # one evaluation, whatever filters follow


def repaired_text(content: str = "content") -> Column:
    """The text that ``tolerant_load`` parsed (needs its ``repair`` column)."""
    c = F.col(content)
    nobom = F.when(c.startswith("\ufeff"), F.expr(f"substring({content}, 2)")).otherwise(c)
    fixed = F.regexp_replace(nobom, r"(?U),(\s*[}\]])", "$1")
    return (
        F.when(F.col("repair") == "none", c)
        .when(F.col("repair") == "bom", nobom)
        .when(F.col("repair") == "trailing_comma", fixed)
    )


def tolerant_load(docs: DataFrame, content: str = "content") -> DataFrame:
    """S3: add ``repair`` (none | bom | trailing_comma | failed) and ``v``.

    Strictness follows Python's ``json`` (Variant alone accepts trailing
    text); repairs are tried only after failure: drop a BOM, then drop commas
    before a closing bracket on the BOM-less text. The text that parsed is
    parsed again natively into VARIANT.

    Python sees only the texts that the native parser does not accept as one
    whole value: a text stands alone as the first element of an array whose
    second one is a mark that the text does not hold. The native parser takes
    nothing that Python's refuses, but for text after the value, and that
    cannot reach the mark.
    """
    c = F.col(content)
    d = docs.withColumn("_whole", F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_MARK}"]'))))
    whole = F.coalesce((F.expr("try_variant_get(_whole, '$[1]', 'string')") == _MARK) & ~c.contains(_MARK), F.lit(False))
    d = d.withColumn("_strict", whole)
    d = d.withColumn("repair", _repair_kind(F.when(~F.col("_strict"), c)))
    return d.withColumn("repair", F.when(F.col("_strict"), F.lit("none")).otherwise(F.col("repair"))).withColumn("v", F.when(
        F.col("_strict"), F.expr("try_variant_get(_whole, '$[0]', 'variant')")).otherwise(F.try_parse_json(repaired_text(content)))).drop("_whole", "_strict")


def load_status(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """One row per document: ``repair``, ``loaded`` and, where it did not load
    and so has no rows in a comparison, the ``error``."""
    c = F.col(content)
    d = tolerant_load(docs.select(key, content), content)
    d = d.withColumn("_syn", syntax_verdict(F.when(F.col("repair") == "failed", c)))
    syntax = F.format_string("JSON syntax error at line %d, column %d: %s", F.col("_syn.line"), F.col("_syn.col"), F.col("_syn.msg"))
    error = (
        F.when(F.col("v").isNotNull(), None)
        .when(c.isNull() | c.rlike(r"^\s*$"), F.lit("File is empty"))
        .when(F.col("repair") == "failed", syntax)
        .otherwise(F.lit(NO_STRUCTURE))
    )
    return d.select(key, F.coalesce("repair", F.lit("failed")).alias("repair"), F.col("v").isNotNull().alias("loaded"), error.alias("error"))


def navigate(v: Column, dotted: str) -> Column:
    """Value at a dotted path where digit steps index arrays or name
    object keys (both are tried)."""
    for s in dotted.split("."):
        found = F.try_variant_get(v, '$["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]', "variant")
        # a value is an object or an array, so one of the two readings is null
        v = F.coalesce(found, F.try_variant_get(v, f"$[{int(s)}]", "variant")) if s.isdigit() else found
    return v
