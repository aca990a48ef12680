"""The shop project: staging, marts and incremental models as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.catalog_facts import pivot_sum
from ..operators.incremental import high_water_filter
from ..operators.joins import anti_join, join_on, not_in
from ..functions.scalars import guarded_ratio

# Payment methods of the shop.
PAYMENT_METHODS = ("credit_card", "coupon", "bank_transfer", "gift_card")
MONEY = "decimal(18,2)"


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("customer_id"), "first_name", "last_name")


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("order_id"), F.col("user_id").alias("customer_id"), "order_date", "status")


def stg_payments(raw: DataFrame) -> DataFrame:
    """Amounts come in cents."""
    return raw.select(F.col("id").alias("payment_id"), "order_id", "payment_method",
                      (F.col("amount").cast(MONEY) / 100).cast(MONEY).alias("amount"))


def stg_refunds(raw: DataFrame) -> DataFrame:
    """Gift-card payments count as refunds, negated."""
    return raw.filter("payment_method = 'gift_card'").select(
        F.col("id").alias("refund_id"), "order_id", (-(F.col("amount").cast(MONEY) / 100)).cast(MONEY).alias("amount"))


def customers(stg_customers: DataFrame, stg_orders: DataFrame, stg_payments: DataFrame) -> DataFrame:
    activity = stg_orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("most_recent_order"),
        F.count("order_id").alias("number_of_orders"))
    # payments shrink to one row per order before they meet the orders
    paid = stg_payments.groupBy("order_id").agg(F.sum("amount").alias("amount"))
    value = paid.join(stg_orders.select("order_id", "customer_id"), "order_id", "left").groupBy("customer_id").agg(
        F.sum("amount").alias("customer_lifetime_value"))
    return stg_customers.join(activity, "customer_id", "left").join(value, "customer_id", "left").select(
        "customer_id", "first_name", "last_name", "first_order", "most_recent_order", "number_of_orders",
        "customer_lifetime_value")


def orders(stg_orders: DataFrame, stg_payments: DataFrame, methods: Sequence[str] = PAYMENT_METHODS) -> DataFrame:
    paid = pivot_sum(stg_payments, ["order_id"], "payment_method", methods, "amount")
    filled = [F.coalesce(f"{m}_amount", F.lit(0)).alias(f"{m}_amount") for m in methods]
    return stg_orders.join(paid, "order_id", "left").select(
        "order_id", "customer_id", "order_date", "status", *filled, F.coalesce("total_amount", F.lit(0)).alias("amount"))


def customer_order_days(stg_orders: DataFrame, this: DataFrame | None = None) -> DataFrame:
    rows = stg_orders if this is None else high_water_filter(stg_orders, this, "order_date", strict=False)
    return rows.groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("orders_placed"))


def order_events_incremental(stg_orders: DataFrame, this: DataFrame | None = None) -> DataFrame:
    rows = stg_orders.select("order_id", "customer_id", "order_date", "status",
                             F.date_trunc("month", "order_date").cast("date").alias("order_date_month"))
    return rows if this is None else high_water_filter(rows, this, "order_date")


def customers_with_no_orders(stg_customers: DataFrame, stg_orders: DataFrame) -> DataFrame:
    kept = anti_join(stg_customers, stg_orders, [("customer_id", "customer_id")])
    matched = F.lit(None).cast(stg_orders.schema["customer_id"].dataType).alias("matched_customer_id")
    return kept.select("customer_id", "first_name", "last_name", matched)


def orders_never_refunded(stg_orders: DataFrame, stg_refunds: DataFrame) -> DataFrame:
    return not_in(stg_orders, "order_id", stg_refunds, "order_id").select("order_id", "customer_id", "order_date", "status")


def paid_orders(stg_orders: DataFrame, stg_payments: DataFrame) -> DataFrame:
    return stg_orders.join(stg_payments, "order_id").select("order_id", "customer_id", "order_date", "status", "amount")


def customer_orders(stg_customers: DataFrame, paid: DataFrame) -> DataFrame:
    return join_on(stg_customers, paid, [("customer_id", "customer_id")], "left").select(
        "customer_id", "first_name", "last_name", "order_id", "order_date", "status", "amount")


def order_payment_match(stg_orders: DataFrame, stg_payments: DataFrame) -> DataFrame:
    return join_on(stg_payments.select("order_id", "payment_method", "amount"), stg_orders.select("order_id", "status"),
                   [("order_id", "order_id")], "right").select("order_id", "status", "payment_method", "amount")


def enriched(customer_orders: DataFrame, match: DataFrame) -> DataFrame:
    other = match.withColumnsRenamed({"status": "_status", "amount": "_amount"})
    return customer_orders.join(other, "order_id", "full").select(
        "customer_id", "first_name", "last_name", "order_id", "order_date",
        F.coalesce("status", "_status").alias("status"), "payment_method", F.coalesce("amount", "_amount").alias("amount"))


def with_total(rows: DataFrame, paid: DataFrame, name: str = "all_orders_amount") -> DataFrame:
    """Every row beside the one-row grand total."""
    return rows.withColumn(name, paid.agg(F.sum("amount").alias("total")).scalar())


def order_metrics(stg_orders: DataFrame, stg_payments: DataFrame, stg_customers: DataFrame, stg_refunds: DataFrame,
                  refunded: str = "refunded") -> DataFrame:
    """Completed rows, then all others, then refunds; the first two together are every row that has a status."""
    paid = paid_orders(stg_orders, stg_payments)
    joined = enriched(customer_orders(stg_customers, paid), order_payment_match(stg_orders, stg_payments))
    per_total = with_total(joined, paid).select("order_id", "status", "amount", "all_orders_amount")
    settled = per_total.filter("status IS NOT NULL")
    refunds = stg_refunds.select("order_id", F.lit(refunded).alias("status"), "amount",
                                 F.lit(None).cast("double").alias("all_orders_amount"))
    statuses = settled.select("status").distinct()
    rows = settled.unionByName(refunds)
    amount, total = F.col("amount").cast("double"), F.col("all_orders_amount").cast("double")
    return rows.select("order_id", "status", "amount", "all_orders_amount",
                       guarded_ratio(amount, total, 4).alias("amount_share"),
                       statuses.agg(F.count(F.lit(1)).alias("n")).scalar().alias("distinct_status_count"))


def int_order_items(stg_orders: DataFrame) -> DataFrame:
    return stg_orders.select("order_id", "customer_id", "amount")


def fct_orders(items: DataFrame) -> DataFrame:
    return items.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("gross_revenue"))


def region_totals(sales: DataFrame, regions: Sequence[str]) -> DataFrame:
    """(part, amount): one part per listed region, and every row once more under ``combined``; one pass over the sales."""
    parts = F.array_compact(F.array(F.lit("combined"), F.when(F.col("region").isin(*regions), F.col("region"))))
    return sales.select(F.explode(parts).alias("part"), "amount")


def fct_events(stg_events: DataFrame, this: DataFrame | None = None) -> DataFrame:
    rows = stg_events.select("event_id", "occurred_at", "amount")
    return rows if this is None else high_water_filter(rows, this, "occurred_at", default=None)


def stg_states(raw: DataFrame) -> DataFrame:
    return raw.select("state_code", "state_name", "region")
