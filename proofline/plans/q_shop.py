"""Shop models over the given tables: customers, orders, and line items as payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as inc, joins
from ..operators.catalog_facts import pivot_sum
from ..session import scratch_path
from ..sources.csv import read_seed_csv
from . import shop
from .base import Derived, query, table

RAW_CUSTOMERS = Derived("""
    select c_custkey as id, split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name
    from {customer}""")
RAW_ORDERS = Derived("""
    select o_orderkey as id, o_custkey as user_id, cast(o_orderdate as date) as order_date,
           case o_orderstatus when 'F' then 'completed' when 'O' then 'placed' else 'shipped' end as status
    from {orders}""")
RAW_PAYMENTS = Derived("""
    select l_orderkey * 10 + l_linenumber as id, l_orderkey as order_id,
           case l_returnflag when 'A' then 'credit_card' when 'N' then 'bank_transfer' else 'gift_card' end
             as payment_method,
           cast(round(l_extendedprice * 100) as bigint) as amount
    from {lineitem}""")
RAW = dict(raw_customers=RAW_CUSTOMERS, raw_orders=RAW_ORDERS, raw_payments=RAW_PAYMENTS)

STAGING = """
    stg_customers as (select id as customer_id, first_name, last_name from raw_customers),
    stg_orders as (select id as order_id, user_id as customer_id, order_date, status from raw_orders),
    stg_payments as (select id as payment_id, order_id, payment_method, amount from raw_payments),
    stg_refunds as (select id as refund_id, order_id, -amount as amount from raw_payments
                    where payment_method = 'gift_card')"""


class Staged:
    def __init__(self, spark, sf):
        payments = RAW_PAYMENTS(spark, sf)
        self.customers = shop.stg_customers(RAW_CUSTOMERS(spark, sf))
        self.orders = shop.stg_orders(RAW_ORDERS(spark, sf))
        self.payments = shop.stg_payments(payments)
        self.refunds = shop.stg_refunds(payments)


def money(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("m1_stg_customers", "select id as customer_id, first_name, last_name from raw_customers", **RAW)
def _(spark, sf):
    return Staged(spark, sf).customers


@query("m2_stg_orders", "select id as order_id, user_id as customer_id, order_date, status from raw_orders", **RAW)
def _(spark, sf):
    return Staged(spark, sf).orders


@query("m3_stg_payments", "select id as payment_id, order_id, payment_method, amount / 100.0 as amount from raw_payments",
       **RAW)
def _(spark, sf):
    return money(Staged(spark, sf).payments, "amount")


@query("m4_stg_refunds", """
    select id as refund_id, order_id, -(amount / 100.0) as amount from raw_payments where payment_method = 'gift_card'""",
       **RAW)
def _(spark, sf):
    return money(Staged(spark, sf).refunds, "amount")


@query("m5_customers", f"""
    with {STAGING},
    activity as (select customer_id, min(order_date) as first_order, max(order_date) as most_recent_order,
                        count(order_id) as number_of_orders from stg_orders group by customer_id),
    value as (select o.customer_id, sum(p.amount) / 100.0 as total_amount
              from stg_payments p left join stg_orders o on p.order_id = o.order_id group by o.customer_id)
    select c.customer_id, c.first_name, c.last_name, a.first_order, a.most_recent_order, a.number_of_orders,
           v.total_amount as customer_lifetime_value
    from stg_customers c left join activity a on c.customer_id = a.customer_id
    left join value v on c.customer_id = v.customer_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return money(shop.customers(s.customers, s.orders, s.payments), "customer_lifetime_value")


@query("m6_orders", f"""
    with {STAGING},
    paid as (select order_id,
               sum(case when payment_method = 'credit_card' then amount else 0 end) as cc,
               sum(case when payment_method = 'coupon' then amount else 0 end) as cp,
               sum(case when payment_method = 'bank_transfer' then amount else 0 end) as bt,
               sum(case when payment_method = 'gift_card' then amount else 0 end) as gc,
               sum(amount) as total from stg_payments group by order_id)
    select o.order_id, o.customer_id, o.order_date, o.status,
           coalesce(cc, 0) / 100.0 as credit_card_amount, coalesce(cp, 0) / 100.0 as coupon_amount,
           coalesce(bt, 0) / 100.0 as bank_transfer_amount, coalesce(gc, 0) / 100.0 as gift_card_amount,
           coalesce(total, 0) / 100.0 as amount
    from stg_orders o left join paid p on o.order_id = p.order_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return money(shop.orders(s.orders, s.payments), *[f"{m}_amount" for m in shop.PAYMENT_METHODS], "amount")


@query("m7_customer_order_days", f"""
    with {STAGING}, prior as (select * from stg_orders where status = 'completed')
    select customer_id, order_date, count(*) as orders_placed from stg_orders
    where order_date >= (select coalesce(max(order_date), date '1900-01-01') from prior)
    group by customer_id, order_date""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    this = shop.customer_order_days(s.orders.filter("status = 'completed'"))
    return shop.customer_order_days(s.orders, this)


@query("m7_customer_order_days_full", f"""
    with {STAGING} select customer_id, order_date, count(*) as orders_placed from stg_orders
    group by customer_id, order_date""", **RAW)
def _(spark, sf):
    return shop.customer_order_days(Staged(spark, sf).orders)


@query("m8_order_events_incremental", f"""
    with {STAGING}, prior as (select max(order_date) as mark from stg_orders where order_date < date '2001-07-01')
    select order_id, customer_id, order_date, status, cast(date_trunc('month', order_date) as date) as order_date_month
    from stg_orders where order_date > (select coalesce(mark, date '1900-01-01') from prior)""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    this = shop.order_events_incremental(s.orders.filter("order_date < date'2001-07-01'"))
    return shop.order_events_incremental(s.orders, this)


@query("m9_customers_with_no_orders", f"""
    with {STAGING}, shipped as (select * from stg_orders where status = 'shipped')
    select c.customer_id, c.first_name, c.last_name, o.customer_id as matched_customer_id
    from stg_customers c left join shipped o on c.customer_id = o.customer_id where o.customer_id is null""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return shop.customers_with_no_orders(s.customers, s.orders.filter("status = 'shipped'"))


@query("m10_order_metrics", f"""
    with {STAGING},
    paid_orders as (select o.order_id, o.customer_id, o.order_date, o.status, p.amount
                    from stg_orders o join stg_payments p on o.order_id = p.order_id),
    customer_orders as (select c.customer_id, p.order_id, p.status, p.amount
                        from stg_customers c left join paid_orders p on c.customer_id = p.customer_id),
    order_payment_match as (select o.order_id, o.status, p.amount
                            from stg_payments p right join stg_orders o on p.order_id = o.order_id),
    enriched as (select coalesce(c.order_id, m.order_id) as order_id, coalesce(c.status, m.status) as status,
                        coalesce(c.amount, m.amount) as amount
                 from customer_orders c full join order_payment_match m on c.order_id = m.order_id),
    grand_total as (select cast(sum(amount) as bigint) as total from paid_orders),
    per_total as (select e.order_id, e.status, e.amount, g.total from enriched e, grand_total g),
    rows_ as (select * from per_total where status = 'completed'
              union all select * from per_total where status <> 'completed'
              union all select order_id, 'refunded', amount, null from stg_refunds),
    dim as (select status from per_total where status = 'completed' union
            select status from per_total where status <> 'completed')
    select order_id, status, amount / 100.0 as amount, total / 100.0 as all_orders_amount,
           case when total > 0 then round((amount / 100.0) / (total / 100.0), 4) else 0.0 end as amount_share,
           (select count(*) from dim) as distinct_status_count
    from rows_""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return money(shop.order_metrics(s.orders, s.payments, s.customers, s.refunds), "amount", "all_orders_amount")


@query("m11_orders_never_refunded", f"""
    with {STAGING} select order_id, customer_id, order_date, status from stg_orders
    where order_id not in (select order_id from stg_refunds)""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return shop.orders_never_refunded(s.orders, s.refunds)


ITEMS = Derived("select o_orderkey as order_id, o_custkey as customer_id, cast(o_totalprice as decimal(15,2)) as amount from {orders}")
SALES = Derived("""
    select lower(r.r_name) as region, cast(o.o_totalprice as decimal(15,2)) as amount
    from {orders} o join {customer} c on o.o_custkey = c.c_custkey
    join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey""")
EVENTS = Derived("select event_id, ts as occurred_at, value as amount, event_type from {events}")


@query("m12_fct_orders", """
    select customer_id, count(*) as order_count, cast(sum(amount) as double) as gross_revenue from items
    group by customer_id""", items=ITEMS)
def _(spark, sf):
    return money(shop.fct_orders(shop.int_order_items(ITEMS(spark, sf))), "gross_revenue")


@query("m13_fct_region_totals", """
    select 'asia' as part, count(*) as n, cast(sum(amount) as double) as amount from sales where region = 'asia'
    union all select 'europe', count(*), cast(sum(amount) as double) from sales where region = 'europe'
    union all select 'combined', count(*), cast(sum(amount) as double) from sales""", sales=SALES)
def _(spark, sf):
    tagged = shop.region_totals(SALES(spark, sf), ["asia", "europe"])
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("m14_fct_events", """
    select event_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') as occurred_at, amount from stg_events
    where occurred_at > (select max(occurred_at) from stg_events where event_type = 'error')""", stg_events=EVENTS)
def _(spark, sf):
    events = EVENTS(spark, sf)
    out = shop.fct_events(events, shop.fct_events(events.filter("event_type = 'error'")))
    return out.withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


STATES = Derived("""
    select 'S' || cast(n_nationkey as string) as state_code, n_name as state_name, cast(n_regionkey as string) as region,
           n_regionkey > 1 as is_active from {nation}""")


@query("m15_stg_states", "select state_code, state_name, region from raw_states", raw_states=STATES)
def _(spark, sf):
    path = scratch_path(spark, "states")
    STATES(spark, sf).write.option("header", True).csv(path)
    return shop.stg_states(read_seed_csv(spark, path))


# ---- the joins, unions and aggregates those models are made of, one at a time

@query("j1_inner_join", f"""
    with {STAGING} select o.order_id, o.customer_id, o.order_date, o.status, p.amount / 100.0 as amount
    from stg_orders o join stg_payments p on o.order_id = p.order_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    out = joins.join_on(s.orders, s.payments.select("order_id", "amount"), [("order_id", "order_id")])
    return money(out, "amount").select("order_id", "customer_id", "order_date", "status", "amount")


@query("j2_left_join", f"""
    with {STAGING}, placed as (select * from stg_orders where status = 'placed')
    select c.customer_id, c.last_name, o.order_id, o.status from stg_customers c
    left join placed o on c.customer_id = o.customer_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    placed = s.orders.filter("status = 'placed'").select("customer_id", "order_id", "status")
    return joins.join_on(s.customers, placed, [("customer_id", "customer_id")], "left").select(
        "customer_id", "last_name", "order_id", "status")


@query("j3_right_join", f"""
    with {STAGING} select o.order_id, o.status, p.payment_method, p.amount / 100.0 as amount
    from stg_payments p right join stg_orders o on p.order_id = o.order_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return money(shop.order_payment_match(s.orders, s.payments), "amount")


@query("j4_full_join", f"""
    with {STAGING}, per_order as (select order_id, sum(amount) / 100.0 as amount from stg_payments
                                  where payment_method = 'gift_card' group by order_id),
    done as (select order_id, status from stg_orders where status = 'completed')
    select coalesce(d.order_id, p.order_id) as order_id, d.status, p.amount
    from done d full join per_order p on d.order_id = p.order_id""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    per_order = s.payments.filter("payment_method = 'gift_card'").groupBy("order_id").agg(
        F.sum("amount").cast("double").alias("amount"))
    done = s.orders.filter("status = 'completed'").select("order_id", "status")
    return joins.join_on(done, per_order, [("order_id", "order_id")], "full").select("order_id", "status", "amount")


@query("j5_cross_one_row_total", f"""
    with {STAGING}, paid as (select o.order_id, p.amount from stg_orders o join stg_payments p on o.order_id = p.order_id),
    total as (select cast(sum(amount) as bigint) as t from paid)
    select o.order_id, o.status, total.t / 100.0 as all_orders_amount from stg_orders o cross join total""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    out = shop.with_total(s.orders.select("order_id", "status"), shop.paid_orders(s.orders, s.payments))
    return money(out, "all_orders_amount")


@query("j6_comma_product", f"""
    with {STAGING}, total as (select cast(sum(amount) as bigint) as t from stg_payments)
    select p.order_id, p.payment_method, p.amount / 100.0 as amount, t / 100.0 as total_check from stg_payments p, total""", **RAW)
def _(spark, sf):
    # FROM rows, grand_total: the second side is a one-row aggregate
    s = Staged(spark, sf)
    out = shop.with_total(s.payments.select("order_id", "payment_method", "amount"), s.payments, "total_check")
    return money(out, "amount", "total_check")


@query("j7_anti_join_is_null", f"""
    with {STAGING} select o.order_id, o.status from stg_orders o left join stg_refunds r on o.order_id = r.order_id
    where r.order_id is null""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    return joins.anti_join(s.orders, s.refunds, [("order_id", "order_id")]).select("order_id", "status")


NULLABLE = Derived("""
    select l_orderkey, case when l_linenumber = 7 and l_returnflag = 'R' then null else l_orderkey end as ref_key
    from {lineitem} where l_linestatus = 'O'""")


@query("j8_not_in", """
    select o_orderkey from orders where o_orderkey not in (
      select l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'O')""")
def _(spark, sf):
    right = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'O'")
    return joins.not_in(table(spark, sf, "orders"), "o_orderkey", right, "l_orderkey").select("o_orderkey")


@query("j8_not_in_with_nulls", """
    select count(*) as kept from orders where o_orderkey not in (select ref_key from refs)""", refs=NULLABLE)
def _(spark, sf):
    return joins.not_in(table(spark, sf, "orders"), "o_orderkey", NULLABLE(spark, sf), "ref_key").agg(
        F.count(F.lit(1)).alias("kept"))


@query("j9_not_exists", """
    select o_orderkey, o_custkey from orders o where not exists (
      select 1 from refs r where r.ref_key = o.o_orderkey)""", refs=NULLABLE)
def _(spark, sf):
    return joins.not_exists(table(spark, sf, "orders"), NULLABLE(spark, sf), [("o_orderkey", "ref_key")]).select(
        "o_orderkey", "o_custkey")


@query("j10_key_match", """
    select matched, count(*) as n from (
      select l.l_orderkey, exists (select 1 from orders o where o.o_orderkey = l.ref_key and o.o_orderstatus = 'F') as matched
      from refs l) group by matched""", refs=NULLABLE)
def _(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key"))
    as_number = done.select(F.col("key").cast("decimal(20,2)").alias("key"))  # another type, same canonical key
    return joins.key_match(NULLABLE(spark, sf), as_number, [("ref_key", "key")]).groupBy("matched").agg(
        F.count(F.lit(1)).alias("n"))


@query("u1_union_all_arms", f"""
    with {STAGING}, t as (select cast(sum(amount) as bigint) as total from stg_payments)
    select order_id, status, amount / 100.0 as amount, total / 100.0 as all_orders_amount
      from (select o.order_id, o.status, p.amount, t.total from stg_orders o join stg_payments p
            on o.order_id = p.order_id, t)
    union all select order_id, 'refunded', amount / 100.0, null from stg_refunds""", **RAW)
def _(spark, sf):
    s = Staged(spark, sf)
    paid = shop.paid_orders(s.orders, s.payments)
    rows = money(shop.with_total(paid.select("order_id", "status", "amount"), s.payments), "amount", "all_orders_amount")
    refunds = s.refunds.select("order_id", F.lit("refunded").alias("status"), F.col("amount").cast("double").alias("amount"),
                               F.lit(None).cast("double").alias("all_orders_amount"))
    return rows.unionByName(refunds)


@query("u2_union_distinct", """
    select o_orderstatus as code from orders union select l_linestatus from lineitem union select l_returnflag from lineitem""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("code")).union(
        lines.select("l_linestatus")).union(lines.select("l_returnflag")).distinct()


@query("u3_tagged_union", """
    select arm, count(*) as n, min(k) as lo, max(k) as hi from (
      select 'customers' as arm, c_custkey as k from customer union all select 'suppliers', s_suppkey from supplier
      union all select 'parts', p_partkey from part) group by arm""")
def _(spark, sf):
    arm = lambda name, key: table(spark, sf, name).select(F.col(key).alias("k"))
    tagged = joins.tagged_union({"customers": arm("customer", "c_custkey"), "suppliers": arm("supplier", "s_suppkey"),
                                 "parts": arm("part", "p_partkey")})
    return tagged.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query("a1_group_min_max_count", """
    select o_custkey as customer_id, cast(min(o_orderdate) as date) as first_order,
           cast(max(o_orderdate) as date) as most_recent_order, count(o_orderkey) as number_of_orders
    from orders group by o_custkey""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min("o_orderdate").cast("date").alias("first_order"), F.max("o_orderdate").cast("date").alias("most_recent_order"),
        F.count("o_orderkey").alias("number_of_orders"))


@query("a2_group_sum_over_join", """
    select o_custkey as customer_id, cast(sum(cast(l_extendedprice as decimal(15,2))) as double) as total_amount
    from lineitem left join orders on l_orderkey = o_orderkey group by o_custkey""")
def _(spark, sf):
    paid = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("amount"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    return paid.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("customer_id").agg(
        F.sum("amount").cast("double").alias("total_amount"))


@query("a3_conditional_pivot", """
    select o_orderpriority as priority,
      cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(15,2)) else 0 end) as double) as "F_amount",
      cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(15,2)) else 0 end) as double) as "O_amount",
      cast(sum(cast(o_totalprice as decimal(15,2))) as double) as total_amount
    from orders group by o_orderpriority""")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    out = pivot_sum(orders, ["priority"], "o_orderstatus", ["F", "O"], F.col("o_totalprice").cast("decimal(15,2)"))
    return money(out, "F_amount", "O_amount", "total_amount")


@query("a4_composite_key_count", """
    select o_custkey, cast(o_orderdate as date) as order_date, count(*) as orders_placed from orders group by 1, 2""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("order_date")).agg(
        F.count(F.lit(1)).alias("orders_placed"))


@query("a5_scalar_subquery_count", """
    select o_orderkey, (select count(distinct o_orderstatus) from orders) as distinct_status_count from orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", orders.agg(F.count_distinct("o_orderstatus").alias("n")).scalar().alias(
        "distinct_status_count"))


@query("a6_share_of_total", """
    select n_name, round(balance / total, 4) as share from (
      select n_name, cast(sum(cast(c_acctbal as decimal(15,2))) as double) as balance,
             (select cast(sum(cast(c_acctbal as decimal(15,2))) as double) from customer) as total
      from customer join nation on c_nationkey = n_nationkey group by n_name)""")
def _(spark, sf):
    customer = table(spark, sf, "customer").withColumn("bal", F.col("c_acctbal").cast("decimal(15,2)"))
    total = customer.agg(F.sum("bal").cast("double").alias("t")).scalar()
    per = customer.groupBy("c_nationkey").agg(F.sum("bal").cast("double").alias("balance"))
    named = per.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", shop.guarded_ratio(F.col("balance"), total, 4).alias("share"))


# ---- incremental loads

OLD_ORDERS = Derived("""
    select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as order_date,
           'placed' as status from {orders} where o_orderdate < timestamp '2000-01-01 00:00:00'""")
NEW_ORDERS = Derived("""
    select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as order_date,
           o_orderstatus as status from {orders} where o_orderdate >= timestamp '1999-06-01 00:00:00'""")


@query("t1_high_water_filter", """
    select order_id, customer_id, order_date, status from src
    where order_date > (select coalesce(max(order_date), date '1900-01-01') from target)""", target=OLD_ORDERS, src=NEW_ORDERS)
def _(spark, sf):
    return inc.high_water_filter(NEW_ORDERS(spark, sf), OLD_ORDERS(spark, sf), "order_date")


@query("t1_high_water_empty_target", """
    select count(*) as with_default, 0 as without_default from src""", src=NEW_ORDERS)
def _(spark, sf):
    src = NEW_ORDERS(spark, sf)
    empty = src.filter("false")
    kept = inc.high_water_filter(src, empty, "order_date").agg(F.count(F.lit(1)).alias("with_default"))
    lost = inc.high_water_filter(src, empty, "order_date", default=None).agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.withColumn("without_default", lost.cast("int"))


@query("t2_merge_upsert", """
    select * from target where order_id not in (select order_id from src) union all select * from src""",
       target=OLD_ORDERS, src=NEW_ORDERS)
def _(spark, sf):
    return inc.merge_upsert(OLD_ORDERS(spark, sf), NEW_ORDERS(spark, sf), ["order_id"])


@query("t3_delete_insert", """
    with days as (select customer_id, order_date, count(*) as orders_placed from target group by 1, 2),
    fresh as (select customer_id, order_date, count(*) as orders_placed from src group by 1, 2)
    select * from days d where not exists (select 1 from fresh f where f.customer_id = d.customer_id
      and f.order_date = d.order_date) union all select * from fresh""", target=OLD_ORDERS, src=NEW_ORDERS)
def _(spark, sf):
    days, fresh = (shop.customer_order_days(d(spark, sf)) for d in (OLD_ORDERS, NEW_ORDERS))
    return inc.delete_insert(days, fresh, ["customer_id", "order_date"])


@query("t4_full_or_incremental", """
    select 'full' as branch, count(*) as n from src union all
    select 'incremental', count(*) from src where order_date > (select max(order_date) from target)""",
       target=OLD_ORDERS, src=NEW_ORDERS)
def _(spark, sf):
    this = shop.order_events_incremental(OLD_ORDERS(spark, sf))
    run = lambda flag: inc.full_or_incremental(shop.order_events_incremental, flag, this, stg_orders=NEW_ORDERS(spark, sf))
    return joins.tagged_union({"full": run(False), "incremental": run(True)}, "branch").groupBy("branch").agg(
        F.count(F.lit(1)).alias("n"))


@query("t5_microbatch", """
    select strftime(date_trunc('day', ts), '%Y-%m-%d') as period, count(*) as n, count(distinct user_id) as users
    from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""")
def _(spark, sf):
    lit = lambda day: F.lit(day).cast("timestamp_ntz")
    batch = inc.microbatch(table(spark, sf, "events"), "ts", "day", lit("2024-01-05"), lit("2024-01-20"))
    return batch.groupBy(F.date_format("period_start", "yyyy-MM-dd").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("t5_microbatch_replay", """
    select strftime(date_trunc('day', ts), '%Y-%m-%d') as period,
           count(*) as n, count(*) filter (where ts >= timestamp '2024-01-10' and value > 50) as large_replayed
    from events where ts < timestamp '2024-01-10' or value > 50 group by 1""")
def _(spark, sf):
    # periods from the tenth on are replayed with large events only
    target = inc.with_period(table(spark, sf, "events"), "ts", "day")
    tenth = F.lit("2024-01-10").cast("timestamp_ntz")
    batch = inc.microbatch(table(spark, sf, "events").filter("value > 50"), "ts", "day", tenth)
    kept = inc.replay(inc.replay(target, batch), batch).filter((F.col("ts") < tenth) | (F.col("value") > 50))
    late = (F.col("ts") >= tenth) & (F.col("value") > 50)
    return kept.groupBy(F.date_format("period_start", "yyyy-MM-dd").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(late).alias("large_replayed"))
