"""Order-grain feature table (F1-F12) built from orders, lineitem and part.

Plan shape: lineitem is aggregated to order grain first (partial aggregation, so a hot
order key is combined map-side), joined to orders on the unique order key, then to part
on the top line's part key.  No side is force-broadcast: part grows with the data, so the
join strategy is left to the optimizer and AQE (which broadcasts at run time only under
``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions).  Customer history
uses ``running_scan`` so a customer holding a third of all orders is split over tasks.
"""
from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import rules as R
from kestrel.functions.hashing import uniform
from kestrel.operators.incremental import incremental_scan
from kestrel.operators.scan import running_scan
from kestrel.session import stored
from kestrel.sources.tables import read_table

FEATURE_COLUMNS = [
    "order_id", "product_category", "price_inr", "discount_pct", "payment_method",
    "customer_tenure_days", "num_previous_orders", "num_previous_returns",
    "delivery_distance_km", "delivery_days", "is_weekend_order", "rating_given", "returned",
]
NUMERIC_FEATURES = [
    "price_inr", "discount_pct", "customer_tenure_days", "num_previous_orders",
    "num_previous_returns", "delivery_distance_km", "delivery_days", "is_weekend_order", "rating_given",
]
CATEGORICAL_FEATURES = ["product_category", "payment_method"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-grain aggregates of lineitem (one row per order with at least one line)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])
    return li.groupBy("l_orderkey").agg(
        F.max(F.struct("l_extendedprice", "l_partkey")).alias("top"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc_sum"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_returned_lines"),
        F.min("l_shipdate").alias("first_ship"),
    )


def order_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their line aggregates and top part: the per-order columns that the tables give.

    An order without lines stays, with the stated defaults of an order and as not returned.
    """
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    lines = order_lines(spark, sf_dir)
    j = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    j = j.join(part, j["top.l_partkey"] == part.p_partkey, "left")
    day = F.to_date("o_orderdate")
    has_lines = F.col("n_lines").isNotNull()
    payment = R.map_values(F.substring("o_orderpriority", 1, 1), R.PAYMENT_BY_PRIORITY)
    return j.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        day.alias("order_day"),
        F.when(has_lines, R.map_values(F.substring_index("p_type", " ", 1), R.CATEGORY_BY_PART_TYPE))
        .otherwise(R.NO_LINES_CATEGORY).alias("product_category"),
        F.when(has_lines, F.round(F.col("top.l_extendedprice"), 0)).otherwise(R.NO_LINES_PRICE).alias("price_inr"),
        F.when(has_lines, F.round(R.clamp(F.col("disc_sum") / F.col("n_lines"), R.DISCOUNT_MIN, R.DISCOUNT_MAX), 1))
        .otherwise(R.NO_LINES_DISCOUNT).alias("discount_pct"),
        payment.alias("payment_method"),
        F.coalesce((F.col("n_returned_lines") * 2 > F.col("n_lines")).cast("int"), F.lit(0)).alias("lr"),
        F.when(has_lines, R.clamp(F.pmod(F.datediff(F.to_date("first_ship"), day), F.lit(R.DELIVERY_DAYS_MOD)) + 1,
                                  R.DELIVERY_DAYS_MIN, R.DELIVERY_DAYS_MAX))
        .otherwise(R.NO_LINES_DAYS).cast("int").alias("delivery_days"),
        F.dayofweek(day).isin(1, 7).cast("int").alias("is_weekend_order"),
    )


def with_seeded_columns(df: DataFrame) -> DataFrame:
    """The columns that seeded numbers of the order id give; they need no shuffle, so they are added behind those."""
    return df.withColumns({
        "delivery_distance_km": F.round(R.clamp(F.lit(R.DISTANCE_MIN) + R.DISTANCE_SPAN * uniform("order_id", "dist"), R.DISTANCE_MIN, R.DISTANCE_MAX), 1),
        "rating_given": F.when(
            uniform("order_id", "miss")
            < F.when(F.col("payment_method") == "COD", R.MISSING_RATE_COD).otherwise(R.MISSING_RATE_OTHER),
            F.lit(None).cast("double"),
        ).otherwise((F.floor(5 * uniform("order_id", "rate")) + 1).cast("double")),
        "_u_ret": uniform("order_id", "ret"),
    })


def order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All per-order columns: those of the tables and the seeded ones."""
    return with_seeded_columns(order_joined(spark, sf_dir))


def customer_history(base: DataFrame, num_blocks: int | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
    """Point-in-time history (F4): previous orders and returns, tenure since first order.

    With ``batch`` (state folder, number), ``base`` holds the orders of one batch only and the customers' earlier orders come from
    the carries of the batches before it (``incremental_scan``).
    """
    scan = partial(incremental_scan, path=batch[0], batch=batch[1]) if batch else running_scan
    hist = scan(
        base, ["customer_id"], ["order_day", "order_id"],
        {
            "num_previous_orders": ("count", None),
            "num_previous_returns": ("sum", "lr"),
            "first_day": ("first", "order_day", True),
        },
        num_blocks=num_blocks,
    )
    return (
        hist.withColumn("num_previous_orders", F.col("num_previous_orders").cast("int"))
        .withColumn("num_previous_returns", F.col("num_previous_returns").cast("int"))
        .withColumn(
            "customer_tenure_days",
            R.clamp(F.datediff("order_day", "first_day"), R.TENURE_MIN, R.TENURE_MAX).cast("int"),
        )
        .drop("first_day")
    )


def prev_return_ratio(df: DataFrame) -> DataFrame:
    """returns / orders, 0 when there are no previous orders."""
    return df.withColumn(
        "prev_return_ratio", R.safe_div(F.col("num_previous_returns"), F.col("num_previous_orders"))
    )


def with_logistic_score(df: DataFrame, out: str = "prob_return") -> DataFrame:
    """F6 + F7: the closed-form return probability."""
    return df.withColumn(
        out,
        R.logistic_score(
            F.col("prev_return_ratio"), F.col("product_category"), F.col("discount_pct"),
            F.col("payment_method"), F.col("delivery_days"), F.col("price_inr"),
            F.col("is_weekend_order"), F.col("customer_tenure_days"),
        ),
    )


def build_order_features(spark: SparkSession, sf_dir: str, num_blocks: int | None = None) -> DataFrame:
    """The 13-column order table plus ``prob_return`` (the F7 score) and ``customer_id``.

    The joined orders are written before the history, whose range partitioning reads them twice (sample and shuffle).
    """
    df = prev_return_ratio(customer_history(stored(order_joined(spark, sf_dir), "orders-joined"), num_blocks))
    df = with_logistic_score(with_seeded_columns(df))
    df = df.withColumn("returned", (F.col("_u_ret") < F.col("prob_return")).cast("int"))
    return df.select(*FEATURE_COLUMNS, "prob_return", "prev_return_ratio", "customer_id")


TABLE_SETTING = "kestrel.orderTable."  # + input folder: where the caller has written its order table


def write_order_features(spark: SparkSession, sf_dir: str, path: str, num_blocks: int | None = None) -> None:
    """The feature-table step: write the order table of ``sf_dir`` to ``path`` (the caller's, who also removes it)
    and let this session's queries over ``sf_dir`` read it.  After a change of the sources, write it anew."""
    build_order_features(spark, sf_dir, num_blocks).write.mode("overwrite").parquet(path)
    spark.conf.set(TABLE_SETTING + sf_dir, path)


def order_features(spark: SparkSession, sf_dir: str, num_blocks: int | None = None) -> DataFrame:
    """The order table: from where ``write_order_features`` put it in this session, else built from the sources."""
    path = spark.conf.get(TABLE_SETTING + sf_dir, None)
    return spark.read.parquet(path) if path else build_order_features(spark, sf_dir, num_blocks)


def held_order_features(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The order table (or ``columns`` of it) written once, for queries that go over it several times."""
    df = order_features(spark, sf_dir)
    df = df.select(*columns) if columns else df
    return df if spark.conf.get(TABLE_SETTING + sf_dir, None) else stored(df, "orders")
