"""Document tables assembled from the TPC-H-like test tables.

Every builder reads the given parquet tables and returns a lazy DataFrame
``(doc_id, content, ...)`` whose size grows with the input. The JSON text is
produced by ``to_json`` on the executors; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import CP1252_HIGH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` over as many tasks as a shuffle has: its rows are few bytes in
    the file, but a document each to those that read them."""
    return table(spark, sf_dir, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")


def props_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.props`` as documents."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("doc_id"), F.col("props").alias("content")
    )


LINEITEM_FIELDS = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
)
ORDER_FIELDS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one JSON object per order with its line items as an array.

    Orders without line items carry ``"lineitems": []``. Items are sorted by
    line number so positions are deterministic. The per-order list is bounded
    by the order's line count (TPC-H: at most 7).
    """
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct(*LINEITEM_FIELDS))).alias("lineitems"))
    )
    orders = table(spark, sf_dir, "orders").select(*ORDER_FIELDS)
    doc = orders.join(li, orders.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").alias("doc_id"),
        F.to_json(
            F.struct(
                *ORDER_FIELDS,
                F.coalesce(F.col("lineitems"), F.array().cast(li.schema["lineitems"].dataType)).alias("lineitems"),
            )
        ).alias("content"),
    )
    return doc


# Damage kinds of F3, chosen by event_id % 8 (fixed values).
DAMAGE_KINDS = {
    0: "trailing_comma",
    1: "bom",
    2: "empty",
    3: "trailing_text",
    4: "single_quotes",
    5: "blank_string",
    6: "duplicate_key",
    7: "clean",
}


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pretty-printed event documents with one kind of damage each.

    Clean form (5 lines)::

        {
          "event_id": 5,
          "event_type": "click",
          "user": "u#46",
          "props": {"k": 89}
        }
    """
    ev = events(spark, sf_dir)
    body = F.concat(
        F.lit('{\n  "event_id": '), F.col("event_id").cast("string"),
        F.lit(',\n  "event_type": "'), F.col("event_type"),
        F.lit('",\n  "user": "u#'), F.col("user_id").cast("string"),
        F.lit('",\n  "props": '), F.col("props"),
    )
    damage = (F.col("event_id") % 8).cast("int")
    content = (
        F.when(damage == 0, F.concat(body, F.lit(",\n}")))
        .when(damage == 1, F.concat(F.lit("\ufeff"), body, F.lit("\n}")))
        .when(damage == 2, F.lit(""))
        .when(damage == 3, F.concat(body, F.lit("\n} x")))
        .when(damage == 4, F.translate(F.concat(body, F.lit("\n}")), '"', "'"))
        .when(damage == 5, F.concat(body, F.lit(',\n  "note": "  "\n}')))
        .when(damage == 6, F.concat(body, F.lit(',\n  "event_type": "dup"\n}')))
        .otherwise(F.concat(body, F.lit("\n}")))
    )
    return ev.select(F.col("event_id").alias("doc_id"), content.alias("content"), damage.alias("damage"))


def annotated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event documents whose values need cleaning, look like JSON, or belong
    to exempt fields; ``list`` holds the same text where no field path reads it."""
    ev = events(spark, sf_dir)
    uid = F.col("user_id").cast("string")
    tag = F.concat(F.col("event_type"), F.lit("-ISIS-#"), uid)
    meta = F.struct(F.concat(F.lit("m@"), uid).alias("user"), F.concat(F.lit("x@"), uid, F.lit("#é-ISIS-#")).alias("Keep-Note"))
    return ev.select(F.col("event_id").alias("doc_id"), F.to_json(F.struct(
        tag.alias("tag"), F.col("props").alias("payload"), F.concat(F.lit("{"), F.col("event_type")).alias("broken"),
        F.lit("C#N").alias("smiles_code"), F.concat(F.lit("u#"), uid).alias("user"), meta.alias("meta"),
        F.array(tag).alias("list"), F.lit("-ISIS-").alias("void"))).alias("content"))


RECORDS_PER_DOC = 50


def multi_record_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root arrays of customer records, 50 customers per document.

    ``doc_id = c_custkey div 50`` bounds the records per document. In each
    record ``c_acctbal`` is left out when ``c_custkey % 5 = 0``; ``orders`` is
    null when ``c_custkey % 3 = 0``, ``[]`` when ``% 3 = 1``, else the
    customer's orders sorted by key.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("ol"))
    )
    cust = table(spark, sf_dir, "customer")
    c = cust.join(orders, cust.c_custkey == orders.o_custkey, "left")
    ol_type = orders.schema["ol"].dataType
    orders_json = (
        F.when(F.col("c_custkey") % 3 == 0, F.lit("null"))
        .when(F.col("c_custkey") % 3 == 1, F.lit("[]"))
        .otherwise(F.to_json(F.coalesce(F.col("ol"), F.array().cast(ol_type))))
    )
    # to_json drops null fields, which is how c_acctbal goes missing; the
    # orders member is spliced in as text so that it can be an explicit null.
    head = F.to_json(
        F.struct(
            "c_custkey", "c_name", "c_nationkey",
            F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
            "c_mktsegment",
        )
    )
    rec = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"orders":'), F.col("oj"), F.lit("}"))
    recs = c.select(
        (F.col("c_custkey") / RECORDS_PER_DOC).cast("bigint").alias("doc_id"),
        F.col("c_custkey"), head.alias("head"), orders_json.alias("oj"),
    ).select("doc_id", "c_custkey", rec.alias("rec"))
    return (
        recs.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("c_custkey", "rec"))).alias("rs"))
        .select("doc_id", F.concat(F.lit("["), F.array_join(F.col("rs.rec"), ","), F.lit("]")).alias("content"))
    )


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """free text as field values: ``(doc_id, field, value, lang)``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("text").alias("field"), F.col("text").alias("value"), "lang"
    )
    return docs


def array_parent_docs(spark: SparkSession, sf_dir: str, root_list: bool = False) -> DataFrame:
    """Events whose prices sit in arrays of different names, by ``event_id % 4``:
    in a nested array named like a null member, in a direct one, in arrays of
    two list elements whose order differs in the last two kinds. As root lists:
    the documents of four events each."""
    ev = events(spark, sf_dir)
    price = F.concat(F.lit('[{"price": '), F.col("event_id").cast("string"), F.lit(', "more": {"bits": [{"size": 1}]}}]'))
    items, stock = F.concat(F.lit('{"items": '), price, F.lit("}")), F.concat(F.lit('{"stock": '), price, F.lit("}"))
    kind = F.col("event_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit('{"id": 1, "items": null, "nested": '), items, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"id": 1, "items": '), price, F.lit(', "price": 2}')))
        .when(kind == 2, F.concat(F.lit('{"id": 1, "items": [], "lots": ['), items, F.lit(", "), stock, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"id": 1, "items": [], "lots": ['), stock, F.lit(", "), items, F.lit("]}")))
    )
    docs = ev.select(F.col("event_id").alias("doc_id"), body.alias("content"))
    if not root_list:
        return docs
    four = docs.groupBy(F.floor(F.col("doc_id") / 4).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "content"))).alias("r"))
    return four.select("doc_id", F.concat(F.lit("["), F.array_join("r.content", ", "), F.lit("]")).alias("content"))


def priced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root lists of records, one per 20 suppliers: by ``s_suppkey % 3`` with
    an empty ``items`` beside a price, with the price inside ``items``, and
    with a null ``items`` and no price."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    rec = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"key": '), k, F.lit(', "items": [], "price": 5}')))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('{"key": '), k, F.lit(', "items": [{"price": 5}]}')))
        .otherwise(F.concat(F.lit('{"key": '), k, F.lit(', "items": null}')))
    )
    d = s.select(F.floor(F.col("s_suppkey") / 20).alias("doc_id"), "s_suppkey", rec.alias("rec"))
    g = d.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "rec"))).alias("r"))
    return g.select("doc_id", F.concat(F.lit("["), F.array_join("r.rec", ","), F.lit("]")).alias("content"))


def nested_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside ``event_id % 13`` objects, and inside 70 arrays where
    ``event_id % 500 = 0``."""
    ev = events(spark, sf_dir)
    k = (F.col("event_id") % 13).cast("int")
    inner = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "blank": ""}'))
    deep = F.concat(F.repeat(F.lit("["), F.lit(70)), inner, F.repeat(F.lit("]"), F.lit(70)))
    content = F.when(F.col("event_id") % 500 == 0, F.concat(F.lit('{"deep": '), deep, F.lit("}"))).otherwise(
        F.concat(F.repeat(F.lit('{"a": '), k), inner, F.repeat(F.lit("}"), k)))
    return ev.select(F.col("event_id").alias("doc_id"), content.alias("content"))


def root_array_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root array of customer records per nation and market segment, in
    key order. In segment MACHINERY every record has the same keys; in
    BUILDING a record with ``c_custkey % 7 = 0`` has one more; in HOUSEHOLD
    such a record is a bare number; in FURNITURE the first element is text."""
    seg, odd = F.col("c_mktsegment"), F.col("c_custkey") % 7 == 0
    k = F.col("c_custkey").cast("string")
    plain = F.concat(F.lit('{"key": '), k, F.lit(', "name": "n"}'))
    swapped = F.concat(F.lit('{"name": "n", "key": '), k, F.lit("}"))
    rec = (
        F.when((seg == "BUILDING") & odd, F.concat(F.lit('{"key": '), k, F.lit(', "name": "n", "more": 1}')))
        .when((seg == "HOUSEHOLD") & odd, k).when(F.col("c_custkey") % 2 == 0, swapped).otherwise(plain)
    )
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", rec.alias("rec"))
    docs = c.groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "rec"))).alias("r"))
    first = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit('["x",')).otherwise(F.lit("["))
    return docs.select(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("doc_id"),
                       F.concat(first, F.array_join("r.rec", ","), F.lit("]")).alias("content"))


def encoded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` as bytes, by ``doc_id % 5``: UTF-8, Latin-1, code
    page 1252 (in curly quotes), UTF-16 little and big endian without a mark."""
    plain = F.regexp_replace("text", r"[^\x{01}-\x{7E}\x{A0}-\x{FF}]", "?")
    quoted = F.concat(F.lit("“"), plain, F.lit("” – 5 €"))
    kind = F.col("doc_id") % 5
    text = F.when(kind == 2, quoted).otherwise(plain)
    c1 = "".join(chr(0x80 + i) for i, c in enumerate(CP1252_HIGH) if c != "\ufffd")
    as_1252 = F.encode(F.translate(quoted, CP1252_HIGH.replace("\ufffd", ""), c1), "ISO-8859-1")
    content = (
        F.when(kind == 0, F.encode(plain, "UTF-8")).when(kind == 1, F.encode(plain, "ISO-8859-1")).when(kind == 2, as_1252)
        .when(kind == 3, F.encode(plain, "UTF-16LE")).otherwise(F.encode(plain, "UTF-16BE"))
    )
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", text.alias("text"), content.alias("content"))


PARTS_PER_DOC = 100


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: catalog description text, one document per 100 parts.

    Line 0 is the database heading ``I. Catalog<doc> Database details``; each
    part then contributes four lines: ``Part<key> Module``, ``Data fields:``,
    ``<p_type>, Size<p_size>`` and ``- Brand<brand number>``.
    """
    p = table(spark, sf_dir, "part")
    doc = (F.col("p_partkey") / PARTS_PER_DOC).cast("bigint")
    base = 1 + 4 * (F.col("p_partkey") % PARTS_PER_DOC)
    lines = p.select(
        doc.alias("doc_id"),
        F.posexplode(F.array(
            F.concat(F.lit("Part"), F.col("p_partkey").cast("string"), F.lit(" Module")),
            F.lit("Data fields:"),
            F.concat(F.col("p_type"), F.lit(", Size"), F.col("p_size").cast("string")),
            F.concat(F.lit("- Brand"), F.regexp_replace("p_brand", "[^0-9]", "")),
        )).alias("j", "text"),
        base.alias("base"),
    ).select("doc_id", (F.col("base") + F.col("j")).cast("int").alias("line_no"), "text")
    heads = p.select(doc.alias("doc_id")).distinct().select(
        "doc_id", F.lit(0).alias("line_no"),
        F.concat(F.lit("I. Catalog"), F.col("doc_id").cast("string"), F.lit(" Database details")).alias("text"),
    )
    return heads.unionByName(lines)


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two tables per catalog description: parts of odd and of even
    keys, with a number, a size name (repeated) and a key name per row. The
    header names the second column, the third one, or neither, by ``doc_id % 3``."""
    p = table(spark, sf_dir, "part")
    doc = (F.col("p_partkey") / PARTS_PER_DOC).cast("bigint")
    rows = p.select(doc.alias("doc_id"), (F.col("p_partkey") % 2).cast("int").alias("table_idx"),
                    (1 + F.col("p_partkey") % PARTS_PER_DOC).cast("int").alias("row"),
                    F.posexplode(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit("size_"), F.col("p_size").cast("string")),
                                         F.concat(F.lit("- key_"), F.col("p_partkey").cast("string"), F.lit(".")))).alias("col", "text"))
    kind = F.col("doc_id") % 3
    head = F.when(kind == 0, F.array(F.lit("No"), F.lit(" Field Name"), F.lit("Key"))).when(
        kind == 1, F.array(F.lit("No"), F.lit("Field name"), F.lit("RDF field name"))).otherwise(F.array(F.lit("No"), F.lit("Size"), F.lit("Key")))
    heads = rows.select("doc_id", "table_idx").distinct().select("doc_id", "table_idx", F.lit(0).alias("row"), F.posexplode(head).alias("col", "text"))
    return heads.unionByName(rows)
