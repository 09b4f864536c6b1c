"""Table scans, base joins and the cleaned table bundle.

Two physical layouts are supported:

* the driver's TPC-H-like parquet tables (``load_tables``), mapped onto the
  canonical order / item / product / customer columns; and
* the original CSV layout (``load_csv_tables``), read with explicit schemas.

Both return a :class:`Tables` bundle with the same canonical columns, so
every operator downstream is layout-agnostic.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from offerlab.config import CATEGORY_LABELS, DEFAULT_PARAMS, Params

MONEY = T.DecimalType(18, 2)

# ---------------------------------------------------------------------------
# Canonical schemas of the CSV layout (A1); never inferred.
# ---------------------------------------------------------------------------
ORDERS_CSV = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("order_purchase_timestamp", T.StringType()),
    T.StructField("order_approved_at", T.StringType()),
    T.StructField("order_delivered_carrier_date", T.StringType()),
    T.StructField("order_delivered_customer_date", T.StringType()),
    T.StructField("order_estimated_delivery_date", T.StringType()),
])
ITEMS_CSV = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_item_id", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("seller_id", T.StringType()),
    T.StructField("shipping_limit_date", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("freight_value", T.DoubleType()),
])
CUSTOMERS_CSV = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_unique_id", T.StringType()),
    T.StructField("customer_zip_code_prefix", T.StringType()),
    T.StructField("customer_city", T.StringType()),
    T.StructField("customer_state", T.StringType()),
])
PRODUCTS_CSV = T.StructType([T.StructField(c, T.StringType()) for c in (
    "product_id", "product_category_name", "product_name_lenght", "product_description_lenght", "product_photos_qty",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")])
TRANSLATION_CSV = T.StructType([
    T.StructField("product_category_name", T.StringType()),
    T.StructField("product_category_name_english", T.StringType()),
])

TIME_COLUMNS = ["order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date"]


@dataclass
class Tables:
    """The cleaned bundle handed to every operator.

    orders     all orders with totals and customer_unique_id (A5)
    completed  ``orders`` filtered on the completed status (A6)
    items      order_id, order_item_id, product_id, price, freight_value
    products   product_id, product_category_name, category (A3)
    customers  customer_id, customer_unique_id
    """

    orders: DataFrame
    completed: DataFrame
    items: DataFrame
    products: DataFrame
    customers: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def category_translation(spark: SparkSession, labels: dict | None = None) -> DataFrame:
    labels = CATEGORY_LABELS if labels is None else labels
    schema = "product_category_name string, category string"
    return spark.createDataFrame(sorted(labels.items()), schema)


def translate_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """A3: products left-join the (small, fixed-size) translation table."""
    return products.join(F.broadcast(translation), "product_category_name", "left")


def order_totals(items: DataFrame) -> DataFrame:
    """A4: per-order price / freight sums and item count.

    Sums run on DECIMAL(18,2) so totals are exact money (and equal in any
    engine); an empty group sums to 0, as the source does. NULL keys drop.
    """
    return (
        items.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.coalesce(F.sum(F.col("price").cast(MONEY)), F.lit(0).cast(MONEY)).cast("double").alias("order_total"),
            F.coalesce(F.sum(F.col("freight_value").cast(MONEY)), F.lit(0).cast(MONEY)).cast("double").alias("freight_total"),
            F.count("order_item_id").alias("item_count"),
        )
    )


def enrich_orders(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """A5: orders left-join totals left-join customers."""
    return (
        orders.join(order_totals(items), "order_id", "left")
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")
    )


def completed_orders(enriched: DataFrame, status: str) -> DataFrame:
    """Completed orders. Written after the joins like the source; Catalyst
    pushes the predicate into the orders scan."""
    return enriched.where(F.col("order_status") == F.lit(status))


def parse_timestamps(df: DataFrame, columns=TIME_COLUMNS) -> DataFrame:
    """Text -> TIMESTAMP_NTZ. ANSI mode makes malformed text raise."""
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, F.to_timestamp_ntz(F.col(c)))
    return df


def load_tables(spark: SparkSession, sf_dir: str, params: Params = DEFAULT_PARAMS) -> Tables:
    """Map the driver's parquet tables onto the canonical columns.

    orders   <- orders (o_orderkey, o_custkey, o_orderstatus, o_orderdate)
    items    <- lineitem (price = l_extendedprice, freight = round(price*tax, 2))
    products <- part (category name = p_type)
    customers<- customer (customer_unique_id = c_custkey)
    """
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    items = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(MONEY), 2)
        .cast("double").alias("freight_value"),
    )
    products = translate_products(
        read_table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
        ),
        category_translation(spark),
    )
    customers = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
    )
    enriched = enrich_orders(orders, items, customers)
    return Tables(
        orders=enriched,
        completed=completed_orders(enriched, params.completed_status),
        items=items,
        products=products,
        customers=customers,
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, times: tuple = ()) -> tuple[DataFrame, DataFrame | None]:
    """A1: (rows, bad rows) of a CSV file or folder with a header line. A row is bad where a field does not
    parse, there are too many or too few fields, or a text of ``times`` is no time; bad rows are (file, line).
    ``strict``: a bad row raises, when it is read."""
    full = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    reader = spark.read.schema(full).option("header", True).option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
    if strict:
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("columnPruning", False).csv(path), None
    rows = reader.option("mode", "PERMISSIVE").csv(path).withColumn("_file", F.col("_metadata.file_name"))
    wrong = F.col("_line").isNotNull()
    for c in times:
        wrong = wrong | (F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull())
    fields = F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema.fields])
    bad = rows.where(wrong).select(F.col("_file").alias("file"), F.coalesce("_line", fields).alias("line"))
    return rows.where(~wrong).drop("_line", "_file"), bad


def load_csv_tables(spark: SparkSession, data_dir: str, status: str = "delivered", strict: bool = False, quarantine: str | None = None) -> Tables:
    """A1 + A3-A8 over the original CSV layout (header row, explicit schemas; a UTF-8 BOM and CRLF line
    ends are handled by the CSV reader). Bad rows are left out and, where ``quarantine`` names a folder,
    written there (table, file, line); with ``strict`` they raise."""
    refused = []

    def csv(name, schema, times=()):
        rows, bad = read_csv(spark, os.path.join(data_dir, name), schema, strict, times)
        if bad is not None:
            refused.append(bad.select(F.lit(name.removesuffix(".csv")).alias("table"), "file", "line"))
        return rows

    orders = csv("olist_orders_dataset.csv", ORDERS_CSV, tuple(TIME_COLUMNS))
    items = csv("olist_order_items_dataset.csv", ITEMS_CSV).select(
        "order_id", "order_item_id", "product_id", "price", "freight_value")
    customers = csv("olist_customers_dataset.csv", CUSTOMERS_CSV)
    products = csv("olist_products_dataset.csv", PRODUCTS_CSV).select("product_id", "product_category_name")
    translation = csv("product_category_name_translation.csv", TRANSLATION_CSV).withColumnRenamed(
        "product_category_name_english", "category")
    if quarantine:
        for bad in refused:
            bad.write.mode("append").partitionBy("table").parquet(quarantine)
    # the size of a translation file is not known here: the planner decides how to join it
    products = products.join(translation, "product_category_name", "left")
    enriched = enrich_orders(orders, items, customers)
    completed = parse_timestamps(completed_orders(enriched, status))
    return Tables(orders=enriched, completed=completed, items=items, products=products,
                  customers=customers.select("customer_id", "customer_unique_id"))
