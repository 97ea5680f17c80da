"""Field catalogs (expected field lists) as DataFrames.

Schema (M5): ``catalog STRING, category STRING, field STRING, ordinal INT,
is_category BOOLEAN``. ``ordinal`` is the comparison order: all fields first
(category by category, in list order, duplicates kept), then the category
names themselves. Catalogs are configuration-sized (hundreds of names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG_SCHEMA = "catalog string, category string, field string, ordinal int, is_category boolean"


def _flatten(value) -> list[str]:
    """Fields of a nested category value: lists are fields, dicts recurse."""
    out: list[str] = []
    if isinstance(value, list):
        out.extend(str(x) for x in value)
    elif isinstance(value, dict):
        for v in value.values():
            out.extend(_flatten(v))
    return out


def rows_from_dict(data: dict) -> list[tuple]:
    """``{catalog: [fields] | {category: [fields] | {...} | ""}}`` to rows."""
    rows: list[tuple] = []
    for cat_name, body in data.items():
        ordinal = 0
        if isinstance(body, list):
            for f in body:
                rows.append((cat_name, None, str(f), ordinal, False))
                ordinal += 1
        elif isinstance(body, dict):
            for category, value in body.items():
                for f in _flatten(value):
                    rows.append((cat_name, category, f, ordinal, False))
                    ordinal += 1
            for category in body.keys():
                rows.append((cat_name, None, category, ordinal, True))
                ordinal += 1
    return rows


def from_dict(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(rows_from_dict(data), CATALOG_SCHEMA)


def from_json_column(df: DataFrame, name_col: str = "catalog", body_col: str = "body") -> DataFrame:
    """S6 for catalogs stored as JSON text, one row per catalog.

    ``body`` is a JSON list of names, or an object of category -> list/object.
    Parsing and flattening run on the executors (one level of nesting under a
    category; deeper dicts are flattened by the same rule one more level).
    """
    v = df.select(F.col(name_col).alias("catalog"), F.expr(f"try_parse_json({body_col})").alias("b"))
    lst = v.select(
        "catalog", F.posexplode(F.expr("try_variant_get(b, '$', 'array<string>')")).alias("ordinal", "field")
    ).select("catalog", F.lit(None).cast("string").alias("category"), "field", "ordinal", F.lit(False).alias("is_category"))
    cats = v.where(F.expr("try_variant_get(b, '$', 'struct<>') IS NOT NULL")).select(
        "catalog", F.posexplode(F.expr("map_entries(try_variant_get(b, '$', 'map<string,variant>'))")).alias("cpos", "e")
    )
    direct = cats.select(
        "catalog", "cpos", F.col("e.key").alias("category"),
        F.expr("coalesce(try_variant_get(e.value, '$', 'array<string>'), "
               "flatten(transform(map_values(coalesce(try_variant_get(e.value, '$', 'map<string,variant>'), map())), "
               "x -> coalesce(try_variant_get(x, '$', 'array<string>'), array()))))").alias("fs"),
    )
    fields = direct.select("catalog", "cpos", "category", F.posexplode("fs").alias("fpos", "field"))
    w = Window.partitionBy("catalog").orderBy("cpos", "fpos")
    fields = fields.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))
    nf = fields.groupBy("catalog").agg(F.count("*").alias("nf"))
    catrows = cats.join(nf, "catalog", "left").select(
        "catalog", F.lit(None).cast("string").alias("category"), F.col("e.key").alias("field"),
        (F.coalesce("nf", F.lit(0)) + F.col("cpos")).cast("int").alias("ordinal"), F.lit(True).alias("is_category"),
    )
    return lst.unionByName(fields.select("catalog", "category", "field", "ordinal", F.lit(False).alias("is_category"))).unionByName(catrows)


def add_fields(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Append fields to a catalog/category, keeping the first of duplicates.

    ``new``: ``catalog, category, field`` (+ optional ``seq`` order). Ordinals
    continue after the existing rows of the catalog.
    """
    base_max = catalog.groupBy("catalog").agg(F.max("ordinal").alias("m"))
    seq = F.col("seq") if "seq" in new.columns else F.monotonically_increasing_id()
    n = new.withColumn("_s", seq).join(base_max, "catalog", "left")
    w = Window.partitionBy("catalog").orderBy("_s")
    n = n.select(
        "catalog", "category", "field",
        (F.coalesce("m", F.lit(-1)) + F.row_number().over(w)).cast("int").alias("ordinal"),
        F.lit(False).alias("is_category"),
    )
    allrows = catalog.unionByName(n)
    w2 = Window.partitionBy("catalog", "category", "field", "is_category").orderBy("ordinal")
    return allrows.withColumn("_r", F.row_number().over(w2)).where("_r = 1").drop("_r")


def fields_of(catalog: DataFrame, name: str | None = None, category: str | None = None) -> DataFrame:
    """Catalog fields (duplicates kept), optionally of one category."""
    c = catalog.where(~F.col("is_category"))
    if name is not None:
        c = c.where(F.col("catalog") == name)
    if category is not None:
        c = c.where(F.col("category") == category)
    return c


def category_map(catalog: DataFrame) -> DataFrame:
    """Field -> category; a later category overwrites an earlier one."""
    return (
        catalog.where(~F.col("is_category") & F.col("category").isNotNull())
        .groupBy("catalog", "field")
        .agg(F.max_by("category", "ordinal").alias("category"), F.min("ordinal").alias("first_ordinal"))
    )


def list_catalogs(catalog: DataFrame) -> DataFrame:
    """Catalog names."""
    return catalog.select("catalog").distinct()


def list_categories(catalog: DataFrame) -> DataFrame:
    """Category names per catalog, in order."""
    return catalog.where("is_category").select("catalog", F.col("field").alias("category"), "ordinal")


def from_table_columns(spark: SparkSession, tables: dict[str, DataFrame], catalog: str, by_table: bool = True) -> DataFrame:
    """Catalog from table metadata, columns in ordinal order.

    Works for lake tables, JDBC-backed DataFrames or files alike: column
    names come from the DataFrame schema (metadata only, no scan).
    """
    body: dict = {}
    if by_table:
        body = {t: [f.name for f in df.schema.fields] for t, df in tables.items()}
    else:
        body = [f.name for df in tables.values() for f in df.schema.fields]
    return from_dict(spark, {catalog: body})


def list_tables(spark: SparkSession, pattern: str = "*", database: str | None = None) -> DataFrame:
    """Tables and temporary views of a database of the Spark catalog whose
    name fits ``pattern`` (``*`` and ``|``): ``table_name, temporary``."""
    where = f"IN `{database}` " if database else ""
    shown = spark.sql(f"SHOW TABLES {where}LIKE '{pattern}'")
    return shown.select(F.col("tableName").alias("table_name"), F.col("isTemporary").alias("temporary"))


COLUMN_DETAILS = "table_name string, ordinal int, column_name string, type string, nullable boolean, default_value string"


def column_details(spark: SparkSession, tables: list[str], observed: bool = False) -> DataFrame:
    """The columns of tables or views by name, in order, with type,
    nullability and default as the Spark catalog states them (metadata only).
    ``observed`` adds ``row_count`` and ``null_count``, one aggregate a table,
    for sources that declare every column nullable."""
    out = spark.createDataFrame([], COLUMN_DETAILS + (", row_count bigint, null_count bigint" if observed else ""))
    for name in tables:
        df = spark.table(name)
        rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT")) for i, f in enumerate(df.schema.fields)]
        details = spark.createDataFrame(rows, COLUMN_DETAILS)
        if observed:
            quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
            nulls = df.agg(F.count("*").alias("row_count"), F.array(*[F.count_if(c.isNull()) for c in quoted]).alias("_n"))
            seen = nulls.select("row_count", F.posexplode("_n").alias("ordinal", "null_count"))
            details = details.join(seen, "ordinal").select(*details.columns, "row_count", "null_count")
        out = out.unionByName(details)
    return out


def from_catalog_tables(spark: SparkSession, catalog: str, pattern: str = "*", database: str | None = None) -> DataFrame:
    """S8 from the Spark catalog: one category per listed table, its columns in order."""
    names_ = [r["table_name"] for r in list_tables(spark, pattern, database).orderBy("table_name").collect()]
    prefix = f"`{database}`." if database else ""
    return from_table_columns(spark, {n: spark.table(f"{prefix}`{n}`") for n in names_}, catalog)


# Information-schema queries per dialect for ``spark.read.format("jdbc")``
# (S8/S9). Data, not logic: the JDBC source runs them on the database.
JDBC_COLUMNS_QUERY = {
    "mysql": "SELECT column_name FROM information_schema.columns WHERE table_name = '{table}' ORDER BY ordinal_position",
    "postgresql": "SELECT column_name FROM information_schema.columns WHERE table_name = '{table}' ORDER BY ordinal_position",
    "sqlserver": "SELECT COLUMN_NAME AS column_name FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = '{table}' ORDER BY ORDINAL_POSITION",
    "oracle": "SELECT column_name FROM user_tab_columns WHERE table_name = UPPER('{table}') ORDER BY column_id",
}
JDBC_TABLES_QUERY = {
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "sqlserver": "SELECT TABLE_NAME AS table_name FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE = 'BASE TABLE'",
    "oracle": "SELECT table_name FROM user_tables",
}


def from_jdbc(spark: SparkSession, url: str, dialect: str, table: str, catalog: str, **options) -> DataFrame:
    """S8 over JDBC: one category per table, columns in ordinal order."""
    q = JDBC_COLUMNS_QUERY[dialect].format(table=table.replace("'", "''"))
    cols = spark.read.format("jdbc").option("url", url).option("query", q).options(**options).load()
    w = Window.orderBy(F.monotonically_increasing_id())
    return cols.select(
        F.lit(catalog).alias("catalog"), F.lit(table).alias("category"), F.col(cols.columns[0]).alias("field"),
        (F.row_number().over(w) - 1).cast("int").alias("ordinal"), F.lit(False).alias("is_category"),
    )
