import pytest
from pyspark.sql import functions as F

from proofline.operators import data_tests as dt
from proofline.operators.catalog_facts import dq_summary
from proofline.operators.numbering import dense_grid
from proofline.plans import care, shop


def failures(df, test, tables={}):
    return dt.run_test(df, test, tables).count().collect()[0][0]


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(1, "a", 5.0), (1, "b", None), (2, None, 7.0), (None, "zz", 9.0)], "k int, s string, v double")


def test_single_tests(spark, t):
    assert failures(t, dt.not_null("v")) == 1 and failures(t, dt.unique("k")) == 1
    assert failures(t, dt.unique_combination(["k", "s"])) == 0 and failures(t, dt.primary_key(["k"])) == 2
    assert failures(t, dt.accepted_values("s", ["a", "b"])) == 1
    assert failures(t, dt.accepted_range("v", 5, 9)) == 0 and failures(t, dt.accepted_range("v", 5, 9, inclusive=False)) == 2
    assert failures(t, dt.between("v", None, 6, row_condition="k = 2")) == 1
    assert failures(t, dt.match_regex("s", "^.$")) == 1 and failures(t, dt.row_count_between(5, None)) == 1
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    assert failures(t, dt.relationships("k", "p", "id"), {"p": parent}) == 1


def test_unique_ignores_nulls_but_primary_key_does_not(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert failures(df, dt.unique("k")) == 0 and failures(df, dt.primary_key(["k"])) == 1
    assert failures(df, dt.unique_combination(["k"])) == 1


def test_wide_keys_give_the_same_answer(spark):
    df = spark.createDataFrame([("x" * 50,), ("x" * 50,), ("y",), (None,), (None,)], "k string")
    for make in (dt.unique, dt.column_unique):
        assert failures(df, make("k", wide=True)) == failures(df, make("k")) == 1
    assert failures(df, dt.primary_key(["k"], wide=True)) == failures(df, dt.primary_key(["k"])) == 2
    lone_null = spark.createDataFrame([("a",), (None,)], "k string")
    assert failures(lone_null, dt.primary_key(["k"], wide=True)) == 1


def test_suite_reports_modifiers(spark, t):
    t.createOrReplaceTempView("t_view")
    suite = {"t": [dt.not_null("v", severity="warn"), dt.not_null("s", where="k = 1"), dt.unique("k", limit=5), dt.not_null("k", enabled=False),
                   dt.not_null("k", severity="odd", name="odd"), dt.row_count_between(1, 9), dt.singular("select * from t_view where v > 8", name="big")]}
    got = {r["test"]: (r["status"], r["failures"], r["degraded"]) for r in dt.run_suite({"t": t}, suite).collect()}
    assert got == {"not_null_v": ("warn", 1, "warn"), "not_null_s": ("pass", 0, "where"), "unique_k": ("fail", 1, "limit"),
                   "not_null_k": ("skipped", 0, ""), "odd": ("unknown", 1, "severity"), "row_count_between": ("pass", 0, ""), "big": ("fail", 1, "")}


def test_suite_object(t):
    suite = dt.Suite({"t": [dt.not_null("v"), dt.unique("k", enabled=False)]})
    assert suite.run({"t": t}).filter("status = 'fail'").count() == 1
    assert {n: r.count().collect()[0][0] for n, r in suite.failures({"t": t}).items()} == {"t.not_null_v": 1}


def test_row_tests_of_a_table_share_one_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    suite = {"t": [dt.not_null("id"), dt.accepted_range("id", 0, 5), dt.row_count_between(1, None), dt.accepted_values("id", [1])]}
    plan = dt.run_suite({"t": df}, suite)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_verify_constraints(spark, t):
    declared = {"t": [dt.Constraint("not_null", ("v",)), dt.Constraint("unique", ("k",)), dt.Constraint("check", ("v",), "v < 8")]}
    got = {r["test"]: (r["failures"], r["support"]) for r in dt.verify_constraints({"t": t}, declared, "BigQuery").collect()}
    assert got == {"constraint_not_null_v": (1, "enforced"), "constraint_unique_k": (1, "not_supported"), "constraint_check_v": (1, "not_supported")}


def test_quarantine_takes_unknown(spark):
    good, bad = dt.split_quarantine(spark.createDataFrame([(True,), (False,), (None,)], "ok boolean"), "ok")
    assert (good.count(), bad.count()) == (1, 2)


# ---- unit tests of the bundled models

def money(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ORDERS = "order_id int, customer_id int, order_date date, status string"


def orders(spark, *rows):
    return spark.sql("select * from values " + ", ".join(f"({i}, {c}, date'{d}', '{s}')" for i, c, d, s in rows) + " as t(order_id, customer_id, order_date, status)")


def payments(spark, *rows):
    return spark.sql("select * from values " + ", ".join(f"({i}, {o}, '{m}', cast({a} as decimal(18,2)))" for i, o, m, a in rows) + " as t(payment_id, order_id, payment_method, amount)")


def test_amount_share_with_an_empty_refund_arm(spark):
    given = {"stg_orders": orders(spark, (1, 1, "2018-01-01", "completed")), "stg_payments": payments(spark, (1, 1, "credit_card", 10)),
             "stg_customers": spark.sql("select 1 as customer_id, 'A' as first_name, 'B' as last_name"),
             "stg_refunds": spark.createDataFrame([], "refund_id int, order_id int, amount decimal(18,2)")}
    expect = spark.sql("select 1 as order_id, 'completed' as status, 10 as amount, 10 as all_orders_amount, 1.0D as amount_share, 1 as distinct_status_count")
    assert dt.unit_test_passes(dt.UnitTest(shop.order_metrics, given, expect))


def test_payment_pivot(spark):
    given = {"stg_orders": orders(spark, (1, 1, "2018-01-01", "placed"), (2, 1, "2018-01-02", "placed")),
             "stg_payments": payments(spark, (1, 1, "credit_card", 10), (2, 1, "coupon", 5))}
    expect = spark.sql("select * from values (1, 10, 5, 0, 0, 15), (2, 0, 0, 0, 0, 0) as t(order_id, credit_card_amount, coupon_amount, bank_transfer_amount, gift_card_amount, amount)")
    assert dt.unit_test_passes(dt.UnitTest(shop.orders, given, expect))
    wrong = expect.withColumn("amount", F.col("amount") + 1)
    assert dict(dt.run_unit_test(dt.UnitTest(shop.orders, given, wrong)).collect()) == {"modified": 2}
    assert dt.unit_test_diff(dt.UnitTest(shop.orders, given, wrong), ["order_id"]).column_summary().collect() == [("amount", 2)]


def test_customer_roll_up_compares_listed_columns_only(spark):
    given = {"stg_customers": spark.sql("select 1 as customer_id, 'A' as first_name, 'B' as last_name"),
             "stg_orders": orders(spark, (1, 1, "2018-01-01", "placed")), "stg_payments": payments(spark, (1, 1, "coupon", 10))}
    expect = spark.sql("select 1 as customer_id, 1 as number_of_orders, 10 as customer_lifetime_value")
    assert dt.unit_test_passes(dt.UnitTest(shop.customers, given, expect))


def test_never_refunded_and_missing_given_columns(spark):
    given = {"stg_orders": spark.sql("select * from values (1), (2) as t(order_id)"), "stg_refunds": spark.sql("select 1 as order_id")}
    expect = spark.sql("select 2 as order_id")
    columns = {"stg_orders": {"customer_id": "int", "order_date": "date", "status": "string"}}
    assert dt.unit_test_passes(dt.UnitTest(shop.orders_never_refunded, given, expect, columns))
    with_null = dict(given, stg_refunds=spark.sql("select cast(null as int) as order_id"))
    assert shop.orders_never_refunded(**dt.UnitTest(None, with_null, expect, columns).inputs()).count() == 0


def test_incremental_branches(spark):
    src = orders(spark, (1, 1, "2018-01-01", "placed"), (2, 1, "2018-01-05", "placed"))
    this = shop.order_events_incremental(orders(spark, (1, 1, "2018-01-01", "placed")))
    delta, both = spark.sql("select 2 as order_id, date'2018-01-01' as order_date_month"), spark.sql("select * from values (1), (2) as t(order_id)")
    given = {"stg_orders": src}
    assert dt.unit_test_passes(dt.UnitTest(shop.order_events_incremental, given, delta, is_incremental=True, this=this))
    assert dt.unit_test_passes(dt.UnitTest(shop.order_events_incremental, given, both, is_incremental=False))


def test_events_high_water_without_default_drops_everything(spark):
    events = spark.sql("select 1 as event_id, timestamp_ntz'2024-01-01 00:00:00' as occurred_at, 2.0D as amount")
    assert shop.fct_events(events, shop.fct_events(events).filter("false")).count() == 0


def test_sentinel(spark, rows):
    payers = spark.sql("select 'a0' as payer_id, 'Acme Health' as payer_name")
    assert rows(care.dim_payers(payers)) == [(-1, "UNKNOWN", "Unknown Payer"), (1, "a0", "Acme Health")]


def test_quality_summary(spark, rows):
    enc = spark.sql("select * from values (false, false), (true, true) as t(is_valid, ts_ok)")
    med = spark.sql("select * from values (false, false), (false, true) as t(is_valid, date_ok)")
    got = dq_summary({"encounters": enc, "medications": med}, "is_valid", {"failed_timestamp": {"encounters": "ts_ok", "medications": "date_ok"}})
    assert [(e, q, n, float(r), f) for e, q, n, r, f in rows(got)] == [("encounters", 1, 2, 50.0, 1), ("medications", 2, 2, 100.0, 1)]


def test_month_state_grid(spark):
    dates = spark.sql("select * from values (date'2024-01-15'), (date'2024-01-16'), (date'2024-02-01') as t(date_actual)")
    states = spark.sql("select * from values ('Massachusetts'), ('Connecticut'), (null), ('Massachusetts') as t(state)").dropna()
    assert dense_grid(care.month_grid_rows(dates), states).count() == 4


def test_orders_and_customers_joins_keep_hot_and_lone_rows(spark, rows):
    from proofline.operators.joins import join_on
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "m")], "r int, v string")
    for how in ("inner", "left", "right", "full"):
        want = left.join(right, left["k"] == right["r"], how).select(F.coalesce("k", "r").alias("k"), "l", "v")
        if how == "left":
            want = left.join(right, left["k"] == right["r"], how).select("k", "l", "v")
        assert rows(join_on(left, right, [("k", "r")], how).select("k", "l", "v")) == rows(want), how
