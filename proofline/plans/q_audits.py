"""Coverage audits over the given tables and over a catalog derived from them (parts as models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, findings as fd
from ..session import scratch_path
from .base import Derived, query, table


def verdicts(df):
    return df.select("check", "table", "construct", "verdict")


@query("c1_audit_union_arms", """
    select 'union_arm' as "check", 'model' as "table", 'union[all_rows]' as construct,
           case when (select count(*) from documents where n_chars < 0) = 0 then 'uncovered' else 'covered' end as verdict""")
def _(spark, sf):
    tables = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem"),
              "negative": table(spark, sf, "documents").filter("n_chars < 0"), "elsewhere": None}
    arms = {"sold": ["orders", "lineitem"], "returned": ["negative"], "external": ["elsewhere"]}
    return verdicts(audits.audit_union_arms(arms, tables, union="all_rows"))


@query("c1_audit_union_arms_unknown", """
    select 'union_arm' as "check", 'model' as "table", 'union[u]' as construct,
           case when (select count(*) from events) > 0 then 'unknown' end as verdict""")
def _(spark, sf):
    tables = {"events": table(spark, sf, "events"), "elsewhere": None}
    return verdicts(audits.audit_union_arms({"a": ["events"], "b": ["elsewhere"]}, tables, union="u"))


@query("c2_audit_left_join", """
    with f as (select (select count(*) from orders) as n,
                      (select count(*) from orders where o_orderkey in (select l_orderkey from lineitem)) as m)
    select 'left_join' as "check", 'orders_with_lines' as "table", 'left_join' as construct,
           case when n > m then 'covered' else 'uncovered' end as verdict, 'matched=' || m || ' unmatched=' || (n - m) as evidence from f""")
def _(spark, sf):
    found = audits.audit_left_join(table(spark, sf, "orders"), table(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")],
                                   "orders_with_lines")
    return found.drop("tier")


@query("c2_audit_left_join_distinct", """
    with f as (select count(*) as n from lineitem)
    select 'left_join' as "check", 'lines_with_orders' as "table", 'left_join' as construct, 'uncovered' as verdict,
           'matched=' || n || ' unmatched=0 advice=uniqueness test on the right key' as evidence from f""")
def _(spark, sf):
    found = audits.audit_left_join(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")],
                                   "lines_with_orders", distinct=True)
    return found.drop("tier")


NULL_REFS = Derived("""
    select case when l_linenumber = 7 then null else l_orderkey end as ref_key, l_returnflag from {lineitem}""")


@query("c3_audit_anti_join", """
    with f as (select count(*) as n, count(*) filter (where o_orderkey in (select ref_key from refs where ref_key is not null)) as m from orders)
    select 'anti_join' as "check", 'never_returned' as "table", 'not_in[order]' as construct,
           case when m > 0 then 'covered' else 'uncovered' end as verdict,
           'matched=' || m || ' unmatched=' || (n - m) || ' right_nulls=' || (select count(*) from refs where ref_key is null) as evidence from f""",
       refs=NULL_REFS)
def _(spark, sf):
    found = audits.audit_anti_join(table(spark, sf, "orders"), NULL_REFS(spark, sf), [("o_orderkey", "ref_key")],
                                   "never_returned", "not_in[order]")
    return found.drop("tier")


@query("c3_audit_anti_join_unknown", """
    select 'anti_join' as "check", 'm' as "table", 'anti_join' as construct,
           case when (select count(*) from customer) > 0 then 'unknown' else 'uncovered' end as verdict""")
def _(spark, sf):
    return verdicts(audits.audit_anti_join(table(spark, sf, "customer"), table(spark, sf, "orders"), [("no_such_key", "o_custkey")], "m"))


@query("c4_audit_fan_out", """
    with m as (select o.o_orderkey, count(l.l_orderkey) as k from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1)
    select count(*) as left_rows, cast(sum(greatest(k, 1)) as bigint) as joined_rows, count(*) filter (where k > 1) as repeated_left_rows,
           max(k) as max_multiplicity, max(k) > 1 as fans_out from m""")
def _(spark, sf):
    return audits.audit_fan_out(table(spark, sf, "orders"), table(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")])


@query("c9_verify_grain", """
    with k as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
    select cast(sum(n) as bigint) as n_rows, count(*) as distinct_keys, count(*) filter (where n > 1) as repeated_keys,
           cast(sum(n - 1) as bigint) as extra_rows, cast(0 as bigint) as null_key_rows, max(n) = 1 as holds from k""")
def _(spark, sf):
    return audits.verify_grain(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- a catalog with one model per part; its tests follow from the part's own attributes
MODELS = Derived("""
    select 'model.shop.part_' || cast(p_partkey as string) as "table", p_size, p_type, p_brand, p_name,
           p_type in ('ECONOMY', 'SMALL', 'MEDIUM') as key_declared,
           case when p_type = 'ECONOMY' then 'id' when p_type = 'SMALL' then 'Id,Day' else '' end as key_text,
           case when p_size < 20 then 'incremental' else 'table' end as materialized,
           case when p_type = 'LARGE' then 'MicroBatch' else 'merge' end as strategy,
           case when p_type = 'PROMO' then 'ts' end as event_time,
           case when p_size < 8 then 'id, day' when p_size < 12 then ' ' end as meta_grain from {part}""".replace('"table"', "tab"))
TESTS = Derived("""
    select 'test.' || cast(p_partkey as string) || '.a' as test, 'model.shop.part_' || cast(p_partkey as string) as tab,
           cast(null as string) as namespace, 'unique' as name, 'ID' as column_text, p_size <> 13 as enabled,
           case when p_size < 15 then 'error' when p_size < 25 then 'WARN' else 'odd' end as severity,
           case when p_size > 40 then 'x > 1' else ' ' end as row_filter, case when p_size = 17 then 100 end as row_limit from {part}
    where p_size <= 30
    union all
    select 'test.' || cast(p_partkey as string) || '.b', 'model.shop.part_' || cast(p_partkey as string), 'dbt_utils',
           'unique_combination_of_columns', 'day,id', true, 'error', cast(null as string), cast(null as int) from {part} where p_size between 20 and 45
    union all
    select 'test.' || cast(p_partkey as string) || '.c', 'model.shop.part_' || cast(p_partkey as string),
           case when p_brand < 'Brand#2' then 'dbt_constraints' else 'other' end, 'primary_key', 'id', true, 'error',
           cast(null as string), cast(null as int) from {part} where p_size between 40 and 48""")
SINGULAR = Derived("""
    select 'test.s' || cast(p_partkey as string) as test, 'model.shop.part_' || cast(p_partkey as string) as tab,
           p_brand <> 'Brand#3' as enabled from {part} where p_size > 46""")
UNITS = Derived("""
    select 'unit.' || cast(l_orderkey as string) || '.' || cast(l_linenumber as string) as test,
           'model.shop.part_' || cast(l_partkey as string) as tab,
           case l_returnflag when 'A' then true when 'N' then false end as incremental from {lineitem} where l_quantity > 45""")


def models(spark, sf):
    df = MODELS(spark, sf).withColumnRenamed("tab", "table")
    columns = F.when(F.col("key_text") != "", F.split("key_text", ","))
    return df.withColumn("unique_key", columns)


def tests(spark, sf):
    df = TESTS(spark, sf).withColumnsRenamed({"tab": "table", "row_filter": "where", "row_limit": "limit"})
    return df.withColumn("columns", F.split("column_text", ","))


def singular(spark, sf):
    return SINGULAR(spark, sf).withColumnRenamed("tab", "table")


BACKED = """
    backed as (select m.tab, max(case when t.enabled then 1 else 0 end) as live, max(case when not t.enabled then 1 else 0 end) as off
               from models m join tests t on t.tab = m.tab and t.name in ('unique', 'unique_combination_of_columns')
               and list_has_all(string_split(lower(m.key_text), ','), string_split(lower(t.column_text), ',')) where m.key_text <> '' group by 1)"""
UNIQUE_KEY = f"""
    {BACKED},
    keyed as (select 'unique_key' as check_, m.tab, 'config.unique_key' as construct,
       case when m.key_text = '' then 'unknown' when b.live = 1 then 'covered'
            when m.tab in (select tab from singular where enabled) then 'unknown' else 'uncovered' end as verdict, 'total' as tier
       from models m left join backed b on b.tab = m.tab where m.key_declared)"""
BRANCHES = """
    modes as (select tab, bool_or(coalesce(incremental, false)) as inc, bool_or(not coalesce(incremental, false)) as ful from units group by 1),
    branches as (select 'incremental_branch' as check_, m.tab, 'config.materialized' as construct,
       case when coalesce(inc, false) and coalesce(ful, false) then 'covered' else 'uncovered' end as verdict, 'total' as tier
       from models m left join modes u on u.tab = m.tab where m.materialized = 'incremental' and lower(m.strategy) <> 'microbatch'
       and m.event_time is null)"""
CATALOG = dict(models=MODELS, tests=TESTS, singular=SINGULAR, units=UNITS)


@query("c5_audit_unique_key", f"""
    with {UNIQUE_KEY} select check_ as "check", tab as "table", construct, verdict from keyed""", **CATALOG)
def _(spark, sf):
    return verdicts(audits.audit_unique_key(models(spark, sf), tests(spark, sf), singular(spark, sf)))


@query("c5_degraded_backing", f"""
    with w as (select tab, test, column_text, lower(severity) <> 'error' or trim(coalesce(row_filter, '')) <> '' or row_limit is not null as weak from tests
      where enabled and name in ('unique', 'unique_combination_of_columns'))
    select m.tab as "table", count(*) as backing, count(*) filter (where weak) as degraded from models m join w on w.tab = m.tab and m.key_text <> ''
      and list_has_all(string_split(lower(m.key_text), ','), string_split(lower(w.column_text), ',')) group by 1""", **CATALOG)
def _(spark, sf):
    found = audits.audit_unique_key(models(spark, sf), tests(spark, sf), singular(spark, sf))
    number = lambda name: F.regexp_extract("evidence", f"{name}=([0-9]+)", 1).cast("long").alias(name)
    return found.select("table", number("backing"), number("degraded")).filter("backing > 0")


CONSTRAINTS = Derived("""
    select 'model.shop.part_' || cast(p_partkey as string) as tab, 'primary_key' as kind, 'Id' as column_text from {part} where p_size > 10
    union all select 'model.shop.part_' || cast(p_partkey as string), 'primary_key', 'id' from {part} where p_size > 30
    union all select 'model.shop.part_' || cast(p_partkey as string), 'unique', 'day,ID' from {part} where p_size > 20
    union all select 'model.shop.part_' || cast(p_partkey as string), 'not_null', 'id' from {part}""")


def constraints(spark, sf):
    return CONSTRAINTS(spark, sf).withColumnRenamed("tab", "table").withColumn("columns", F.split("column_text", ","))


@query("c6_audit_constraints", """
    with d as (select distinct tab, kind, array_to_string(list_sort(string_split(lower(column_text), ',')), ',') as cols from constraints_
               where kind in ('primary_key', 'unique'))
    select 'constraint' as "check", d.tab as "table", 'constraint.' || kind || '[' || cols || ']' as construct,
      case when exists (select 1 from tests t where t.tab = d.tab and t.enabled and t.name in ('unique', 'unique_combination_of_columns')
        and list_has_all(string_split(d.cols, ','), string_split(lower(t.column_text), ','))) then 'covered' else 'uncovered' end as verdict
    from d""", constraints_=CONSTRAINTS, **CATALOG)
def _(spark, sf):
    return verdicts(audits.audit_constraints(constraints(spark, sf), tests(spark, sf), "snowflake"))


@query("c7_audit_incremental_branches", f"""
    with {BRANCHES} select check_ as "check", tab as "table", construct, verdict from branches""", **CATALOG)
def _(spark, sf):
    units = UNITS(spark, sf).withColumnRenamed("tab", "table")
    return verdicts(audits.audit_incremental_branches(models(spark, sf), units))


@query("c8_detect_grain", """
    with s as (select tab, 1 as strength, 'authored' as kind, meta_grain as cols, 'meta' as origin from models where trim(meta_grain) <> ''
      union all select tab, case name when 'primary_key' then 2 when 'unique' then 4 else 3 end,
        case name when 'primary_key' then 'primary_key' when 'unique' then 'unique' else 'compound_unique' end,
        replace(column_text, ',', ', '), test from tests where enabled and namespace is distinct from 'other')
    select m.tab as "table", coalesce(arg_min(s.kind, (strength, origin)), 'unknown') as kind, arg_min(s.cols, (strength, origin)) as columns,
      arg_min(s.origin, (strength, origin)) as origin, count(s.kind) as signals
    from models m left join s on s.tab = m.tab group by 1""", **CATALOG)
def _(spark, sf):
    return audits.detect_grain(models(spark, sf), tests(spark, sf))


@query("w8_strongest_signal", """
    with s as (select tab, 1 as strength, 'authored' as kind, 'meta' as origin from models where trim(meta_grain) <> ''
      union all select tab, case name when 'primary_key' then 2 when 'unique' then 4 else 3 end,
        case name when 'primary_key' then 'primary_key' when 'unique' then 'unique' else 'compound_unique' end, test
      from tests where enabled and namespace is distinct from 'other')
    select tab as "table", kind, origin, row_number() over (partition by tab order by strength, origin) as rank from s""", **CATALOG)
def _(spark, sf):
    return audits.grain_signals(models(spark, sf), tests(spark, sf)).select("table", "kind", "origin", F.col("rank").cast("long").alias("rank"))


SUPERSEDES = {"unique_key": ["incremental_branch"]}


def found(spark, sf):
    units = UNITS(spark, sf).withColumnRenamed("tab", "table")
    return [audits.audit_unique_key(models(spark, sf), tests(spark, sf), singular(spark, sf)),
            audits.audit_incremental_branches(models(spark, sf), units)]


def same_construct(parts):
    """Both audits speak about the model as a whole here, so that one can supersede the other."""
    return [p.withColumn("construct", F.lit("model")) for p in parts]


ALL = f"""{UNIQUE_KEY}, {BRANCHES}, both_ as (select * from keyed union all select * from branches)"""
KEPT = f"""{ALL}, kept as (select * from both_ b where not (check_ = 'incremental_branch' and tab in (select tab from keyed)))"""


@query("c10_resolve_supersedes", f"""
    with {KEPT} select check_ as "check", tab as "table", 'model' as construct, verdict from kept""", **CATALOG)
def _(spark, sf):
    parts = same_construct(found(spark, sf))
    return verdicts(fd.resolve_supersedes(parts[0].unionByName(parts[1]), SUPERSEDES))


SUPPRESS = Derived("""
    select p_partkey as rank, 'unique_key' as check_name,
           case when p_size = 1 then 'part_' || cast(p_partkey as string) else 'model.shop.part_' || cast(p_partkey as string) end as model,
           'policy' as source, p_name as reason from {part} where p_size < 4""")


def suppress(spark, sf):
    return SUPPRESS(spark, sf).withColumnRenamed("check_name", "check")


POLICY = f"""{ALL}, shown as (select b.*, p.p_size < 4 as suppressed, case when p.p_size < 4 then p.p_name end as reason
    from both_ b join models p on p.tab = b.tab where check_ = 'unique_key')"""


@query("c11_apply_policy", f"""
    with {POLICY} select tab as "table", verdict, suppressed, reason from shown""", suppress=SUPPRESS, **CATALOG)
def _(spark, sf):
    parts = found(spark, sf)
    out = fd.apply_policy(parts[0].unionByName(parts[1]), ["unique_key"], suppress(spark, sf))
    return out.select("table", "verdict", "suppressed", "reason")


@query("c12_gate", f"""
    with {POLICY} select count(*) > 0 as failed from shown where verdict = 'uncovered' and not suppressed and tier = 'total'""", **CATALOG)
def _(spark, sf):
    parts = found(spark, sf)
    shown = fd.apply_policy(parts[0].unionByName(parts[1]), ["unique_key"], suppress(spark, sf))
    return fd.gate_verdict(shown)


@query("c13_model_findings", f"""
    with {ALL} select check_ as "check", verdict, count(*) as n from both_ group by 1, 2""", **CATALOG)
def _(spark, sf):
    return fd.model_findings(found(spark, sf), SUPERSEDES).groupBy("check", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("a11_findings_tally", f"""
    with {POLICY} select count(*) filter (where verdict = 'uncovered' and not suppressed) as total_uncovered, 0::bigint as high_uncovered,
      0::bigint as advisory_uncovered, count(*) filter (where verdict = 'covered') as covered from shown""", **CATALOG)
def _(spark, sf):
    parts = found(spark, sf)
    return fd.tally(fd.apply_policy(parts[0].unionByName(parts[1]), ["unique_key"], suppress(spark, sf)))


@query("a11_table_coverage", f"""
    with {ALL} select tab as "table", count(*) filter (where verdict = 'covered') as covered,
      count(*) filter (where verdict = 'uncovered') as uncovered, count(*) filter (where verdict = 'unknown') as unknown from both_ group by 1""",
       **CATALOG)
def _(spark, sf):
    parts = found(spark, sf)
    return fd.table_coverage(parts[0].unionByName(parts[1]))


@query("s6_write_findings", f"""
    with {ALL} select 1 as schema_version, '2024-02-01' as run_date, check_ as "check", tab as "table", construct, verdict from both_""", **CATALOG)
def _(spark, sf):
    path = scratch_path(spark, "findings")
    for _ in range(2):  # the second run replaces the first
        fd.write_findings(fd.model_findings(found(spark, sf), {}), path, "2024-02-01", {"project": "shop"}, "json")
    stored = spark.read.schema("schema_version int, `check` string, `table` string, construct string, verdict string, run_date string").json(f"{path}/findings")
    return stored.select("schema_version", "run_date", "check", "table", "construct", "verdict")
