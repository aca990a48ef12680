"""Report queries: line items as visits, parts as conditions, suppliers as providers, nations as payers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import bucket, guarded_ratio, hash_pii, mask, month_label, surrogate_key
from ..operators.catalog_facts import dq_summary
from ..operators.numbering import capped_preview, dense_grid, number_rows, sequence_key, top_n_with_overflow
from . import care
from .base import Derived, query, table

VISITS = Derived("""
    select l.l_orderkey as visit_id, l.l_linenumber as line_no, l.l_partkey as condition_id, l.l_suppkey as provider_id,
           o.o_custkey as patient_id, cast(o.o_orderdate as date) as visit_date, l.l_returnflag as visit_class,
           cast(l.l_extendedprice as decimal(15,2)) as cost, l.l_quantity as units, cast(l.l_discount as decimal(9,2)) as discount
    from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""")
PATIENTS = Derived("select c_custkey as patient_id, c_name as patient_name, c_nationkey as payer_id, c_acctbal as balance, c_mktsegment as segment from {customer}")
COST = "cast(sum(cost) as double)"


def cost(column="cost"):
    return F.sum(column).cast("double")


def exact_avg(column, digits=2):
    """Average of an exact decimal, rounded; both engines divide the same two doubles."""
    return F.round(F.sum(column).cast("double") / F.count(column), digits)


@query("m16_condition_frequency", """
    select condition_id, count(*) as encounter_count, count(distinct patient_id) as patient_count,
           round(count(*) * 1.0 / count(distinct patient_id), 2) as avg_encounters_per_patient
    from visits group by condition_id having count(distinct patient_id) > 0
    order by encounter_count desc, condition_id limit 20""", visits=VISITS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("encounter_count"), F.count_distinct("patient_id").alias("patient_count"))
    ratio = F.round(F.col("encounter_count").cast("double") / F.col("patient_count"), 2)
    return per.filter("patient_count > 0").withColumn("avg_encounters_per_patient", ratio).orderBy(
        F.desc("encounter_count"), "condition_id").limit(20)


@query("m16_recent_conditions", """
    select condition_id, min(visit_date) as first_date, max(visit_date) as last_date, count(distinct patient_id) as patient_count
    from visits group by condition_id having min(visit_date) >= date '1996-01-01' - interval 1 year""", visits=VISITS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("condition_id").agg(
        F.min("visit_date").alias("first_date"), F.max("visit_date").alias("last_date"),
        F.count_distinct("patient_id").alias("patient_count"))
    return care.recent(per, "first_date", F.lit("1996-01-01").cast("date"))


@query("m16_age_groups", """
    select case when p_size < 18 then '0-17' when p_size < 35 then '18-34' when p_size < 50 then '35-49'
                when p_size < 65 then '50-64' else '65+' end as age_group,
           count(distinct condition_id) as condition_count, round(cast(sum(cost) as double) / count(cost), 2) as avg_cost,
           cast(sum(cost) as double) as total_cost
    from visits join part on condition_id = p_partkey group by 1""", visits=VISITS)
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("condition_id"), "p_size")
    # visits are dealt out by condition first, so that a task sums its own conditions and not nearly all of them
    per = VISITS(spark, sf).select("condition_id", "cost").repartition("condition_id").groupBy("condition_id").agg(
        F.sum("cost").alias("cost"), F.count("cost").alias("n"))
    total = F.sum("cost").cast("double")
    return per.join(part, "condition_id").groupBy(care.age_group(F.col("p_size")).alias("age_group")).agg(
        F.count_distinct("condition_id").alias("condition_count"), F.round(total / F.sum("n"), 2).alias("avg_cost"), total.alias("total_cost"))


@query("m16_provider_panel", """
    with panel as (select provider_id, count(distinct patient_id) as active_patient_count from visits group by provider_id)
    select case when active_patient_count = 0 then '0' when active_patient_count <= 10 then '1-10'
                when active_patient_count <= 50 then '11-50' when active_patient_count <= 100 then '51-100' else '100+' end
             as panel_size_bucket, count(*) as provider_count, cast(sum(active_patient_count) as bigint) as total_patients
    from panel group by 1""", visits=VISITS)
def _(spark, sf):
    panel = VISITS(spark, sf).groupBy("provider_id").agg(F.count_distinct("patient_id").alias("active_patient_count"))
    return panel.groupBy(care.panel_size(F.col("active_patient_count")).alias("panel_size_bucket")).agg(
        F.count(F.lit(1)).alias("provider_count"), F.sum("active_patient_count").alias("total_patients"))


@query("m16_top_conditions", """
    select condition_id, count(distinct patient_id) as patient_count, count(distinct visit_id) as encounter_count from visits
    group by condition_id order by patient_count desc, condition_id limit 10""", visits=VISITS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("condition_id").agg(F.count_distinct("patient_id").alias("patient_count"),
                                                       F.count_distinct("visit_id").alias("encounter_count"))
    return per.orderBy(F.desc("patient_count"), "condition_id").limit(10)


SUMMARY = """
    summary as (select patient_id, year(visit_date) as year_actual, sum(cost) as total_cost, count(*) as encounter_count,
                count(distinct condition_id) as condition_count from visits group by 1, 2)"""


def patient_years(spark, sf):
    return VISITS(spark, sf).groupBy("patient_id", F.year("visit_date").cast("long").alias("year_actual")).agg(
        F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("encounter_count"),
        F.count_distinct("condition_id").alias("condition_count"))


@query("m16_costliest_patients", f"""
    with {SUMMARY} select s.patient_id, p.patient_name || ' / ' || p.segment as patient_name, year_actual, cast(total_cost as double) as total_cost,
      encounter_count, condition_count from summary s join patients p using (patient_id) where year_actual = 1998
    order by s.total_cost desc, patient_id limit 10""", visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    named = PATIENTS(spark, sf).select("patient_id", F.concat("patient_name", F.lit(" / "), "segment").alias("patient_name"))
    return care.top_rows(patient_years(spark, sf).filter("year_actual = 1998"), [(named, "patient_id")],
                         ["patient_id", "patient_name", "year_actual", F.col("total_cost").cast("double").alias("total_cost"), "encounter_count",
                          "condition_count"], [F.desc("total_cost"), F.col("patient_id")], 10)


@query("m16_yearly_trends", f"""
    with {SUMMARY} select year_actual, count(distinct patient_id) as patient_count, round(cast(sum(encounter_count) as double) / count(*), 2) as avg_encounters,
      round(cast(sum(condition_count) as double) / count(*), 2) as avg_conditions, cast(sum(total_cost) as double) as total_population_cost
    from summary group by 1""", visits=VISITS)
def _(spark, sf):
    return patient_years(spark, sf).groupBy("year_actual").agg(
        F.count_distinct("patient_id").alias("patient_count"), exact_avg("encounter_count").alias("avg_encounters"),
        exact_avg("condition_count").alias("avg_conditions"), cost("total_cost").alias("total_population_cost"))


@query("m16_top_providers", """
    select provider_id, s_name as provider_name, s_nationkey as specialty, count(*) as total_encounters, count(distinct patient_id) as total_patients,
      round(cast(sum(cost) as double) / count(*), 2) as avg_cost_per_encounter
    from visits join supplier on provider_id = s_suppkey where year(visit_date) = 1999 group by 1, 2, 3
    order by total_encounters desc, provider_id limit 15""", visits=VISITS)
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"),
                                                   F.col("s_nationkey").alias("specialty"))
    per = VISITS(spark, sf).filter("year(visit_date) = 1999").groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("total_encounters"), F.count_distinct("patient_id").alias("total_patients"),
        exact_avg("cost").alias("avg_cost_per_encounter"))
    return care.top_rows(per, [(supplier, "provider_id")], ["provider_id", "provider_name", "specialty", "total_encounters", "total_patients",
                                                           "avg_cost_per_encounter"], [F.desc("total_encounters"), F.col("provider_id")], 15)


@query("m16_chronic_patients", """
    select patient_id, patient_name, visit_class, min(visit_date) as first_date,
      (year(max(visit_date)) - year(min(visit_date))) * 12 + month(max(visit_date)) - month(min(visit_date)) as months, count(*) as encounter_count
    from visits join patients using (patient_id) group by 1, 2, 3
    having (year(max(visit_date)) - year(min(visit_date))) * 12 + month(max(visit_date)) - month(min(visit_date)) >= 24
    order by months desc, patient_id, visit_class limit 50""", visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("patient_id", "visit_class").agg(
        F.min("visit_date").alias("first_date"), F.max("visit_date").alias("last_date"), F.count(F.lit(1)).alias("encounter_count"))
    months = (F.year("last_date") - F.year("first_date")) * 12 + F.month("last_date") - F.month("first_date")
    long_ = per.withColumn("months", months.cast("long")).filter("months >= 24")
    return care.top_rows(long_, [(PATIENTS(spark, sf).select("patient_id", "patient_name"), "patient_id")],
                         ["patient_id", "patient_name", "visit_class", "first_date", "months", "encounter_count"],
                         [F.desc("months"), F.col("patient_id"), F.col("visit_class")], 50)


@query("a7_payer_costs", """
    select n_name as payer_name, count(distinct visit_id) as encounter_count, cast(sum(cost) as double) as total_cost,
           round(cast(sum(discount) as double) / count(discount), 2) as avg_discount
    from visits join patients using (patient_id) join nation on payer_id = n_nationkey group by n_name""",
       visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("payer_id"), F.col("n_name").alias("payer_name"))
    return VISITS(spark, sf).join(PATIENTS(spark, sf), "patient_id").join(nation, "payer_id").groupBy("payer_name").agg(
        F.count_distinct("visit_id").alias("encounter_count"), cost().alias("total_cost"),
        exact_avg("discount").alias("avg_discount"))


@query("a7_monthly_costs", """
    select strftime(visit_date, '%Y-%m') as year_month, count(distinct visit_id) as encounter_count,
           cast(sum(cost) as double) as total_cost, round(cast(sum(cost) as double) / count(cost), 2) as avg_cost
    from visits group by 1""", visits=VISITS)
def _(spark, sf):
    return VISITS(spark, sf).groupBy(month_label(F.col("visit_date")).alias("year_month")).agg(
        F.count_distinct("visit_id").alias("encounter_count"), cost().alias("total_cost"), exact_avg("cost").alias("avg_cost"))


@query("a7_provider_efficiency_having", """
    select s.s_name as provider_name, v.visit_class, count(*) as total_encounters, cast(sum(cost) as double) as total_cost,
           count(distinct patient_id) as patients
    from visits v join supplier s on v.provider_id = s.s_suppkey group by 1, 2 having count(*) >= 200""", visits=VISITS)
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    per = VISITS(spark, sf).groupBy("provider_id", "visit_class").agg(
        F.count(F.lit(1)).alias("total_encounters"), cost().alias("total_cost"), F.count_distinct("patient_id").alias("patients"))
    return per.filter("total_encounters >= 200").join(supplier, "provider_id").drop("provider_id")


@query("a8_two_level_aggregate", """
    with per as (select patient_id, count(distinct condition_id) as item_count,
                        sum(case when visit_class = 'R' then 1 else 0 end)::bigint as active_count
                 from visits group by patient_id)
    select p.patient_id, pt.patient_name, item_count, active_count from per p join patients pt using (patient_id)
    where item_count >= 40""", visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    per = care.entity_profile(VISITS(spark, sf), ["patient_id"], "condition_id", F.col("visit_class") == "R", 40)
    return per.join(PATIENTS(spark, sf).select("patient_id", "patient_name"), "patient_id").select(
        "patient_id", "patient_name", "item_count", "active_count")


@query("j20_dimension_joins_top_k", """
    select visit_id, line_no, condition_id, patient_name, n_name as payer_name, s_name as provider_name, cast(cost as double) as cost
    from visits join patients using (patient_id) join nation on payer_id = n_nationkey
    join supplier on provider_id = s_suppkey
    order by cost desc, visit_id, line_no, condition_id limit 25""", visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("payer_id"), F.col("n_name").alias("payer_name"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"))
    return care.top_rows(
        VISITS(spark, sf), [(PATIENTS(spark, sf), "patient_id"), (nation, "payer_id"), (supplier, "provider_id")],
        ["visit_id", "line_no", "condition_id", "patient_name", "payer_name", "provider_name", F.col("cost").cast("double").alias("cost")],
        [F.desc("cost"), F.col("visit_id"), F.col("line_no"), F.col("condition_id")], 25)


@query("j21_above_average", """
    with per as (select patient_id, count(*) as encounter_count, count(distinct condition_id) as condition_count
                 from visits group by patient_id),
    averages as (select avg(encounter_count) as e, avg(condition_count) as c from per)
    select patient_id, encounter_count, condition_count from per, averages
    where encounter_count > e * 1.5 and condition_count > c""", visits=VISITS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounter_count"),
                                                     F.count_distinct("condition_id").alias("condition_count"))
    return care.above_average(per, {"encounter_count": 1.5, "condition_count": 1.0})


@query("j22_dense_grid", """
    with months as (select distinct year(visit_date) * 100 + month(visit_date) as month_key from visits),
    segments as (select distinct segment from patients where segment is not null),
    facts as (select year(visit_date) * 100 + month(visit_date) as month_key, segment, count(*) as n
              from visits join patients using (patient_id) where visit_class = 'R' and units > 49 group by 1, 2)
    select cast(m.month_key as int) as month_key, s.segment, coalesce(n, 0) as n
    from months m cross join segments s left join facts f on f.month_key = m.month_key and f.segment = s.segment""",
       visits=VISITS, patients=PATIENTS)
def _(spark, sf):
    visits, patients = VISITS(spark, sf), PATIENTS(spark, sf)
    key = (F.year("visit_date") * 100 + F.month("visit_date")).alias("month_key")
    facts = visits.filter("visit_class = 'R' and units > 49").join(patients, "patient_id").groupBy(key, "segment").agg(
        F.count(F.lit(1)).alias("n"))
    return dense_grid(visits.select(key), patients.select("segment").dropna(), facts, {"n": 0})


FLAGGED = Derived("""
    select l_orderkey, l_quantity <= 45 as small_enough, l_discount < 0.1 as discount_ok,
           case when l_returnflag = 'N' then null else l_tax < 0.08 end as tax_ok, l_quantity <= 45 and l_discount < 0.1 as is_valid
    from {lineitem}""")
FLAGGED_ORDERS = Derived("""
    select o_orderkey, o_totalprice < 490000 as small_enough, o_orderdate >= timestamp '1995-02-01 00:00:00' as date_ok,
           o_totalprice < 490000 and o_orderdate >= timestamp '1995-02-01 00:00:00' as is_valid
    from {orders}""")


@query("a9_dq_summary", """
    select 'lines' as entity_type, count(*) filter (where not is_valid) as quarantined_count, count(*) as total_count,
           round(count(*) filter (where not is_valid) * 100.0 / count(*), 2) as quarantine_rate_pct,
           count(*) filter (where not small_enough) as failed_size, count(*) filter (where not tax_ok) as failed_tax,
           cast(null as bigint) as failed_date from lines_
    union all
    select 'orders', count(*) filter (where not is_valid), count(*),
           round(count(*) filter (where not is_valid) * 100.0 / count(*), 2),
           count(*) filter (where not small_enough), null, count(*) filter (where not date_ok) from orders_""",
       lines_=FLAGGED, orders_=FLAGGED_ORDERS)
def _(spark, sf):
    out = dq_summary({"lines": FLAGGED(spark, sf), "orders": FLAGGED_ORDERS(spark, sf)}, "is_valid", {
        "failed_size": {"lines": "small_enough", "orders": "small_enough"}, "failed_tax": {"lines": "tax_ok"},
        "failed_date": {"orders": "date_ok"}})
    return out.withColumn("quarantine_rate_pct", F.col("quarantine_rate_pct").cast("double"))


@query("m17_dim_payers", """
    select cast(-1 as bigint) as payer_key, 'UNKNOWN' as payer_id, 'Unknown Payer' as payer_name, null as balance
    union all select row_number() over (order by c_name), c_name, c_mktsegment, c_acctbal from customer""")
def _(spark, sf):
    payers = table(spark, sf, "customer").select(F.col("c_name").alias("payer_id"), F.col("c_mktsegment").alias("payer_name"),
                                                 F.col("c_acctbal").alias("balance"))
    return care.dim_payers(payers)


@query("w1_sequence_key", """
    select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as key, l_orderkey, l_linenumber, l_partkey
    from lineitem union all select -1, -1, null, null""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keyed = sequence_key(lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {"l_orderkey": -1})
    return keyed.select("key", "l_orderkey", "l_linenumber", "l_partkey")


@query("w2_occurrence_no", """
    select event_type, user_id, event_id, row_number() over (partition by event_type, user_id order by ts, event_id) as k from events""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id")
    return number_rows(events, ["ts", "event_id"], by=["event_type", "user_id"], name="k").drop("ts")


@query("w3_residual_no", """
    select l_linestatus, l_orderkey, l_linenumber, l_partkey,
           row_number() over (partition by l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as i from lineitem""")
def _(spark, sf):
    # two groups hold everything: each is spread over all partitions
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return number_rows(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], by=["l_linestatus"], name="i").drop("l_suppkey")


@query("w5_deterministic_order", """
    select o_orderkey, o_custkey, o_orderstatus from orders order by o_custkey, o_orderstatus, o_orderkey""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy(
        "o_custkey", "o_orderstatus", "o_orderkey")


@query("w6_top_n_with_overflow", """
    select o_orderkey, o_totalprice, (select count(*) from orders) as total, (select count(*) from orders) - 10 as overflowed
    from orders order by o_totalprice desc, o_orderkey limit 10""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return top_n_with_overflow(orders, [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("w7_top_k_report", """
    select condition_id, count(distinct patient_id) as patient_count, cast(sum(units) as bigint) as units from visits
    group by condition_id order by patient_count desc, condition_id limit 15""", visits=VISITS)
def _(spark, sf):
    per = VISITS(spark, sf).groupBy("condition_id").agg(F.count_distinct("patient_id").alias("patient_count"),
                                                       F.sum("units").cast("long").alias("units"))
    return per.orderBy(F.desc("patient_count"), "condition_id").limit(15)


@query("s7_capped_preview", """
    select count(*) as total_rows, least(count(*), 500) as shown_rows, count(*) > 500 as capped,
           (select max(p_partkey) from (select p_partkey from part order by p_partkey limit 500)) as last_shown from part""")
def _(spark, sf):
    shown, meta = capped_preview(table(spark, sf, "part"), ["p_partkey"], 500)
    return meta.withColumn("last_shown", shown.agg(F.max("p_partkey").alias("m")).scalar())


@query("v13_surrogate_key", """
    select c_custkey, md5(c_name || '-' || coalesce(cast(c_nationkey as varchar), '_null_') || '-' || c_mktsegment) as key from customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", surrogate_key(
        [F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")]).alias("key"))


@query("v14_mask", """
    select c_custkey, case when c_mktsegment = 'BUILDING' then c_name else '***' end as shown, '***' as hidden from customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", mask(F.col("c_name"), F.col("c_mktsegment") == "BUILDING").alias("shown"),
        mask(F.col("c_name"), False).alias("hidden"))


@query("v15_hash_pii", "select c_custkey, md5(c_name) as name_hash from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hash_pii(F.col("c_name")).alias("name_hash"))


@query("v16_bucket", """
    select case when l_quantity < 10 then 'small' when l_quantity < 30 then 'medium' else 'large' end as size, count(*) as n
    from lineitem group by 1""")
def _(spark, sf):
    size = bucket(F.col("l_quantity"), [(10, "small"), (30, "medium")], "large")
    return table(spark, sf, "lineitem").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("v17_date_and_string_functions", """
    select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, strftime(o_orderdate, '%Y-%m') as label,
           o_orderstatus || ':' || o_orderpriority as tag, o_orderdate >= timestamp '2001-08-01' - interval 1 year as recent,
           case when o_totalprice > 0 then round(1000.0 / o_totalprice, 4) else 0.0 end as ratio,
           coalesce(case when o_orderstatus = 'P' then null else o_orderstatus end, '-') as filled from orders""")
def _(spark, sf):
    late = F.add_months(F.lit("2001-08-01").cast("date"), -12)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), month_label(F.col("o_orderdate")).alias("label"),
        F.concat("o_orderstatus", F.lit(":"), "o_orderpriority").alias("tag"), (F.col("o_orderdate") >= late).alias("recent"),
        guarded_ratio(F.lit(1000.0), F.col("o_totalprice"), 4).alias("ratio"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("-")).alias("filled"))
