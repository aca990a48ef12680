"""Table diffs: orders and parts against later versions of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff
from ..operators.contracts import schema_impact
from ..operators.data_tests import UnitTest, run_unit_test
from ..operators.numbering import number_rows
from . import shop
from .base import Derived, query, table
from .q_shop import RAW, STAGING, Staged

# the later version reprices pending orders, drops large cancelled ones, adds copies of urgent ones under new keys
OLD_ORDERS = Derived("select o_orderkey as pos, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from {orders}")
NEW_ORDERS = Derived("""
    select o_orderkey as pos, o_orderkey, o_custkey, o_orderstatus,
           case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then round(o_totalprice + 10, 2) else o_totalprice end as o_totalprice,
           case when o_custkey < 20 then upper(o_orderpriority || '!') else o_orderpriority end as o_orderpriority
    from {orders} where not (o_orderstatus = 'F' and o_totalprice > 490000)
    union all
    select o_orderkey + 1000000000, o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
    from {orders} where o_orderpriority = '1-URGENT' and o_totalprice < 20000""")
# rows that repeat many times: a few columns of the line items, in table order of their keys
OLD_LINES = Derived("select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber from {lineitem}")
NEW_LINES = Derived("""
    select l_orderkey, l_partkey, l_suppkey, case when l_quantity > 49 then 'X' else l_returnflag end as l_returnflag, l_linestatus, l_linenumber
    from {lineitem} where not (l_linenumber = 7 and l_discount = 0.1)""")
PLACED = "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos, l_returnflag, l_linestatus, l_linenumber from {lines}"
PAIR = dict(old_=OLD_ORDERS, new_=NEW_ORDERS)
LINES = dict(old_=Derived(PLACED, lines=OLD_LINES), new_=Derived(PLACED, lines=NEW_LINES))  # for the SQL side
LINE_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def lines(derived, spark, sf):
    """Line items with their place in key order."""
    return number_rows(derived(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], name="pos").select("pos", *LINE_COLUMNS)


def matched_sql(columns):
    """Common part of the checks: number copies on each side, match the k-th with the k-th, number what is left."""
    cols = ", ".join(columns)
    same = " and ".join(f"o.{c} is not distinct from n.{c}" for c in columns)
    return f"""
    o as (select *, row_number() over (partition by {cols} order by pos) as k from old_),
    n as (select *, row_number() over (partition by {cols} order by pos) as k from new_),
    eq as (select o.pos as old_pos, n.pos as new_pos from o join n on {same} and o.k = n.k),
    lo as (select *, row_number() over (order by pos) as i from old_ where pos not in (select old_pos from eq)),
    ln as (select *, row_number() over (order by pos) as i from new_ where pos not in (select new_pos from eq))"""


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
KINDS = "case when lo.pos is null then 'added' when ln.pos is null then 'removed' else 'modified' end"


def orders_diff(spark, sf):
    return diff.diff_tables(OLD_ORDERS(spark, sf), NEW_ORDERS(spark, sf), "pos", "pos")


def lines_diff(spark, sf):
    return diff.diff_tables(lines(OLD_LINES, spark, sf), lines(NEW_LINES, spark, sf), "pos", "pos")


@query("d1_diff_tables", f"""
    with {matched_sql(ORDER_COLUMNS)}
    select kind, count(*) as n_rows from (select 'unchanged' as kind from eq
      union all select {KINDS} from lo full join ln on lo.i = ln.i) group by kind""", **PAIR)
def _(spark, sf):
    return orders_diff(spark, sf).summary()


@query("d1_diff_rows", f"""
    with {matched_sql(ORDER_COLUMNS)}
    select 'unchanged' as kind, null as old_pos, new_pos, null as old_price, o_totalprice as new_price
    from eq join new_ on new_.pos = eq.new_pos
    union all select {KINDS}, lo.pos, ln.pos, lo.o_totalprice, ln.o_totalprice from lo full join ln on lo.i = ln.i""", **PAIR)
def _(spark, sf):
    return orders_diff(spark, sf).rows.select("kind", "old_pos", "new_pos", F.col("old.o_totalprice").alias("old_price"),
                                              F.col("new.o_totalprice").alias("new_price"))


@query("d1_diff_repeated_rows", f"""
    with {matched_sql(LINE_COLUMNS)}
    select 'unchanged' as kind, null as old_pos, new_pos from eq
    union all select {KINDS}, lo.pos, ln.pos from lo full join ln on lo.i = ln.i""", **LINES)
def _(spark, sf):
    return lines_diff(spark, sf).rows.select("kind", "old_pos", "new_pos")


@query("d2_diff_cells", f"""
    with {matched_sql(ORDER_COLUMNS)},
    p as (select lo.pos as old_pos, ln.pos as new_pos, {", ".join(f"lo.{c} as o{i}, ln.{c} as n{i}" for i, c in enumerate(ORDER_COLUMNS))}
          from lo join ln on lo.i = ln.i)
    {" union all ".join(f"select old_pos, new_pos, '{c}' as column, o{i} is distinct from n{i} as changed from p" for i, c in enumerate(ORDER_COLUMNS))}""",
       **PAIR)
def _(spark, sf):
    return orders_diff(spark, sf).cells().filter("kind = 'modified'").select("old_pos", "new_pos", "column", "changed")


@query("d3_diff_summary", f"""
    with {matched_sql(LINE_COLUMNS)}
    select kind, count(*) as n_rows from (select 'unchanged' as kind from eq
      union all select {KINDS} from lo full join ln on lo.i = ln.i) group by kind""", **LINES)
def _(spark, sf):
    return diff.diff_counts(*(d(spark, sf).select(*LINE_COLUMNS) for d in (OLD_LINES, NEW_LINES)))


@query("d3_has_real_change", "select true as real_change", **PAIR)
def _(spark, sf):
    return orders_diff(spark, sf).has_real_change()


@query("d3_reorder_and_reformat_is_no_change", "select 'unchanged' as kind, count(*) as n_rows from part")
def _(spark, sf):
    # the new side lists the rows backwards and stores numbers as other types
    old = table(spark, sf, "part").withColumn("pos", F.col("p_partkey"))
    new = old.withColumn("pos", -F.col("p_partkey")).withColumn("p_size", F.col("p_size").cast("decimal(10,2)")).withColumn(
        "p_partkey", F.col("p_partkey").cast("double"))
    return diff.diff_tables(old, new, "pos", "pos").summary()


@query("d3_column_summary", f"""
    with {matched_sql(ORDER_COLUMNS)},
    p as (select {", ".join(f"(lo.pos is null or ln.pos is null or lo.{c} is distinct from ln.{c}) as c{i}" for i, c in enumerate(ORDER_COLUMNS))}
          from lo full join ln on lo.i = ln.i),
    s as ({" union all ".join(f"select '{c}' as column, count(*) filter (where c{i}) as changed_cells from p" for i, c in enumerate(ORDER_COLUMNS))})
    select * from s where changed_cells > 0""", **PAIR)
def _(spark, sf):
    return orders_diff(spark, sf).column_summary()


# one small table per customer: its orders before and after
OLD_TESTS = Derived("""
    select o_custkey as test, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as ordinal, o_orderkey as pos,
           o_totalprice as amount, o_orderpriority as priority from {orders}""")
NEW_TESTS = Derived("""
    select o_custkey as test, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as ordinal, o_orderkey as pos,
           case when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 0.0 else o_totalprice end as amount, o_orderpriority as priority
    from {orders} where not (o_orderpriority = '3-MEDIUM' and o_totalprice > 450000)""")


@query("d4_diff_test_data", """
    with o as (select *, row_number() over (partition by test, ordinal, amount, priority order by pos) as k from old_),
    n as (select *, row_number() over (partition by test, ordinal, amount, priority order by pos) as k from new_),
    eq as (select o.pos as old_pos, n.pos as new_pos, o.test, o.ordinal from o join n using (test, ordinal, amount, priority, k)),
    lo as (select *, row_number() over (partition by test, ordinal order by pos) as i from old_ where pos not in (select old_pos from eq)),
    ln as (select *, row_number() over (partition by test, ordinal order by pos) as i from new_ where pos not in (select new_pos from eq))
    select test, ordinal, kind, count(*) as n_rows from (
      select test, ordinal, 'unchanged' as kind from eq union all
      select coalesce(lo.test, ln.test), coalesce(lo.ordinal, ln.ordinal),
             case when lo.pos is null then 'added' when ln.pos is null then 'removed' else 'modified' end
      from lo full join ln on lo.test = ln.test and lo.ordinal = ln.ordinal and lo.i = ln.i) group by 1, 2, 3""",
       old_=OLD_TESTS, new_=NEW_TESTS)
def _(spark, sf):
    return diff.diff_test_data(OLD_TESTS(spark, sf), NEW_TESTS(spark, sf), "test", "ordinal", "pos").summary()


@query("d4_changed_tables", """
    with d as ((select test, ordinal, amount, priority, count(*) as n from old_ group by all) except all
               (select test, ordinal, amount, priority, count(*) as n from new_ group by all)),
    e as ((select test, ordinal, amount, priority, count(*) as n from new_ group by all) except all
          (select test, ordinal, amount, priority, count(*) as n from old_ group by all))
    select distinct test, ordinal from (select test, ordinal from d union all select test, ordinal from e)""",
       old_=OLD_TESTS, new_=NEW_TESTS)
def _(spark, sf):
    return diff.changed_tables(diff.diff_test_data(OLD_TESTS(spark, sf), NEW_TESTS(spark, sf), "test", "ordinal", "pos"))


OLD_SEED = Derived("select c_custkey as pos, c_custkey, c_nationkey, c_mktsegment from {customer}")
NEW_SEED = Derived("""
    select c_custkey as pos, c_custkey, c_nationkey, case when c_nationkey = 7 then 'NONE' else c_mktsegment end as c_mktsegment,
           c_name from {customer}""")
SEED_EDGES = Derived("select 'seed.nation_' || cast(s_nationkey as string) as src, 'model.supplier_' || cast(s_suppkey as string) as dst from {supplier}")


@query("d5_diff_seeds", """
    select 'rows:modified' as item, count(*) as n from old_ union all
    select 'consumers', (select count(distinct dst) from edges where src = 'seed.nation_7')""",
       old_=OLD_SEED, new_=NEW_SEED, edges=SEED_EDGES)
def _(spark, sf):
    found, consumers = diff.diff_seeds(OLD_SEED(spark, sf), NEW_SEED(spark, sf), "pos", SEED_EDGES(spark, sf), "seed.nation_7")
    rows = found.summary().select(F.concat(F.lit("rows:"), "kind").alias("item"), F.col("n_rows").alias("n"))
    return rows.unionByName(consumers.agg(F.lit("consumers").alias("item"), F.count(F.lit(1)).alias("n")))


@query("d12_diff_schemas", """
    select t.*, case when change = 'added' then 0 else (select count(*) from orders) end as affected_values
    from (values ('orders', 'o_orderkey', 'bigint', 'bigint', 'unchanged', false),
      ('orders', 'o_custkey', 'bigint', 'int', 'type_changed', true), ('orders', 'o_orderstatus', 'string', 'string', 'unchanged', false),
      ('orders', 'o_totalprice', 'double', null, 'removed', true), ('orders', 'o_orderdate', 'timestamp_ntz', 'date', 'type_changed', true),
      ('orders', 'o_orderpriority', 'string', 'string', 'unchanged', false), ('orders', 'note', null, 'string', 'added', false))
      t(id, name, old_type, new_type, change, breaking)""")
def _(spark, sf):
    old = table(spark, sf, "orders")
    new = old.drop("o_totalprice").withColumn("o_custkey", F.col("o_custkey").cast("int")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date")).withColumn("note", F.lit(""))
    return schema_impact(old, new, "orders")


@query("q16_run_unit_test", f"""
    with {STAGING}, got as (select o.order_id, o.status, coalesce(p.total, 0) as amount from stg_orders o left join
      (select order_id, sum(amount) as total from stg_payments group by order_id) p on o.order_id = p.order_id)
    select case when status = 'shipped' then 'modified' else 'unchanged' end as kind, count(*) as n_rows from got group by 1""", **RAW)
def _(spark, sf):
    # the expectation is right for all but the shipped orders, and lists two of the model's columns
    s = Staged(spark, sf)
    totals = s.payments.groupBy("order_id").agg(F.sum("amount").alias("t"))
    expect = s.orders.join(totals, "order_id", "left").select(
        "order_id", F.when(F.col("status") == "shipped", -1).otherwise(F.coalesce("t", F.lit(0))).alias("amount"))
    return run_unit_test(UnitTest(shop.orders, {"stg_orders": s.orders, "stg_payments": s.payments}, expect))


@query("q16_incremental_unit_test", f"""
    with {STAGING} select 'unchanged' as kind, count(*) as n_rows from stg_orders where order_date > date '2001-01-01'""", **RAW)
def _(spark, sf):
    # what an incremental run emits is the delta, not the merged table
    s = Staged(spark, sf)
    this = shop.order_events_incremental(s.orders.filter("order_date <= date'2001-01-01'"))
    expect = s.orders.filter("order_date > date'2001-01-01'").select("order_id", "status")
    return run_unit_test(UnitTest(shop.order_events_incremental, {"stg_orders": s.orders}, expect, is_incremental=True, this=this))
