"""A labelled application table derived from orders, line items and customers.

One row per order. Look-back counts and recency come from daily counts per
customer, so a customer with a large share of all orders is at most one row per
day in the windows, and the join back spreads that customer over the days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.roles import Roles

ROLES = Roles(
    label="label",
    date="applicationdate",
    booked="booked",
    ignore=("application_id", "customer_id"),
)

LOOKBACK_DAYS = (30, 90, 180)


def applications(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    returned = F.col("l_returnflag") == "R"
    items = (
        table("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(returned).alias("n_ret"),
            F.max(F.when(returned & (F.col("l_quantity") >= 48), F.col("l_quantity"))).alias(
                "big_ret_qty"
            ),
            F.max("l_extendedprice").alias("max_line_price"),
        )
    )
    day = F.col("o_orderdate").cast("date")
    orders = table("orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        day.alias("d"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("bigint").alias("dn"),
    )
    history = Window.partitionBy("o_custkey").orderBy("dn")
    daily = orders.groupBy("o_custkey", "dn").agg(
        F.count("*").alias("on_day"), F.min("o_orderkey").alias("first_key")
    )
    lookbacks = [
        F.coalesce(F.sum("on_day").over(history.rangeBetween(-days, -1)), F.lit(0)).alias(
            f"total_apps_in_last_{days}_days"
        )
        for days in LOOKBACK_DAYS
    ]
    customers = table("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    nations = table("nation").select("n_nationkey", F.col("n_name").alias("nation"))
    days = (
        daily.select(
            "o_custkey",
            "dn",
            "first_key",
            (F.col("dn") - F.min("dn").over(history)).alias("tenure"),
            F.lag("dn").over(history).alias("previous"),
            *lookbacks,
        )
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    since = F.when(F.col("o_orderkey") > F.col("first_key"), 0).otherwise(
        F.col("dn") - F.col("previous")
    )
    lines = F.col("n_lines")
    label = F.when(lines.isNotNull(), F.when(F.col("n_ret") >= 3, 1).otherwise(0))
    return (
        orders.join(days, ["o_custkey", "dn"], "left")
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("application_id"),
            F.col("d").alias("applicationdate"),
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("booked"),
            label.alias("label"),
            (F.col("tenure").cast("double") / 365.25).alias("max_open_age"),
            lines.alias("total_accts"),
            *[f"total_apps_in_last_{d}_days" for d in LOOKBACK_DAYS],
            since.cast("bigint").alias("days_since_last_application"),
            F.col("big_ret_qty").alias("cc_days_since_last_pd"),
            "max_line_price",
            "o_totalprice",
            "c_acctbal",
            "o_orderpriority",
            "c_mktsegment",
            "nation",
        )
    )
