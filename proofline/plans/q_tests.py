"""Data tests and whole suites over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import data_tests as dt
from ..session import scratch_path
from .base import TABLES, query, table


def failures(name, sql_count, make, source="lineitem"):
    """Register a single test: the number of failing rows it reports."""
    @query(name, f"select cast(({sql_count}) as bigint) as failures")
    def _(spark, sf):
        tables = {t: table(spark, sf, t) for t in TABLES}
        return dt.run_test(tables[source], make(), tables).count()


failures("q1_not_null", "select count(*) from events where value is null or props is null",
         lambda: dt.not_null("value"), "events")
failures("q2_unique", "select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)",
         lambda: dt.unique("l_orderkey"))
failures("q3_unique_combination", "select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)",
         lambda: dt.unique_combination(["l_orderkey", "l_linenumber"]))
failures("q4_primary_key", "select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1 or o_orderkey is null)",
         lambda: dt.primary_key(["o_orderkey"]), "orders")
failures("q5_unique_key", "select count(*) from (select doc_id, lang from documents group by 1, 2 having count(*) > 1)",
         lambda: dt.unique_key(["doc_id", "lang"]), "documents")
failures("q6_relationships", "select count(*) from documents where doc_id not in (select doc_id from labels)",
         lambda: dt.relationships("doc_id", "labels", "doc_id"), "documents")
failures("q7_accepted_values", "select count(*) from lineitem where l_returnflag not in ('A', 'R')",
         lambda: dt.accepted_values("l_returnflag", ["A", "R"]))
failures("q8_accepted_range", "select count(*) from lineitem where l_quantity <= 1 or l_quantity >= 50",
         lambda: dt.accepted_range("l_quantity", 1, 50, inclusive=False))
failures("q9_between", "select count(*) from lineitem where l_returnflag = 'A' and (l_discount < 0.01 or l_discount > 0.09)",
         lambda: dt.between("l_discount", 0.01, 0.09, row_condition="l_returnflag = 'A'"))
failures("q10_row_count_between", "select case when count(*) between 1 and 100 then 0 else 1 end from lineitem",
         lambda: dt.row_count_between(1, 100))
failures("q11_match_regex", "select count(*) from pages where not regexp_matches(url, '^https://[a-z.]+/en/')",
         lambda: dt.match_regex("url", "^https://[a-z.]+/en/"), "pages")
failures("q12_compound_unique", "select count(*) from (select l_partkey, l_suppkey from lineitem group by 1, 2 having count(*) > 1)",
         lambda: dt.compound_unique(["l_partkey", "l_suppkey"]))
failures("q12_column_unique", "select count(*) from (select text from documents where lang = 'en' group by 1 having count(*) > 1)",
         lambda: dt.column_unique("text", row_condition="lang = 'en'", wide=True), "documents")


@query("q13_singular", "select count(*) as failures from lineitem where l_discount > 0.05 and l_tax > 0.05")
def _(spark, sf):
    test = dt.singular(f"select * from parquet.`{sf}/lineitem.parquet` where l_discount > 0.05 and l_tax > 0.05")
    return dt.run_test(table(spark, sf, "lineitem"), test).count()


@query("s8_store_failures", """
    select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity > 48""")
def _(spark, sf):
    path = scratch_path(spark, "failures")
    dt.run_test(table(spark, sf, "lineitem"), dt.accepted_range("l_quantity", high=48)).store(path)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("q14_verify_constraints", """
    select * from (select 'constraint_primary_key_o_orderkey' as test, 0::bigint as failures, 'pass' as status, 'not_enforced' as support
    union all select 'constraint_unique_o_custkey', (select count(*) from (select 1 from orders group by o_custkey having count(*) > 1)), 'fail', 'not_supported'
    union all select 'constraint_foreign_key_o_custkey', 0, 'pass', 'not_enforced'
    union all select 'constraint_not_null_o_orderdate', 0, 'pass', 'enforced'
    union all select 'constraint_check_o_totalprice', (select count(*) from orders where o_totalprice >= 400000), 'fail', 'enforced')""")
def _(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "customer")}
    declared = {"orders": [
        dt.Constraint("primary_key", ("o_orderkey",)), dt.Constraint("unique", ("o_custkey",)),
        dt.Constraint("foreign_key", ("o_custkey",), to="customer", to_columns=("c_custkey",)),
        dt.Constraint("not_null", ("o_orderdate",)), dt.Constraint("check", ("o_totalprice",), "o_totalprice < 400000")]}
    return dt.verify_constraints(tables, declared, "databricks").select("test", "failures", "status", "support")


def suite():
    return {
        "lineitem": [
            dt.not_null("l_orderkey"), dt.not_null("l_shipdate"), dt.accepted_values("l_returnflag", ["A", "N", "R"]),
            dt.accepted_values("l_linestatus", ["O"], severity="warn"), dt.accepted_range("l_quantity", 1, 50),
            dt.between("l_discount", 0, 0.09, row_condition="l_returnflag = 'R'"), dt.row_count_between(1, None),
            dt.unique_combination(["l_orderkey", "l_linenumber"], limit=10),
            dt.relationships("l_orderkey", "orders", "o_orderkey"), dt.relationships("l_partkey", "part", "p_partkey")],
        "orders": [
            dt.primary_key(["o_orderkey"]), dt.not_null("o_custkey"), dt.match_regex("o_orderpriority", "^[1-4]-"),
            dt.relationships("o_custkey", "customer", "c_custkey"), dt.accepted_range("o_totalprice", 0, 499000, where="o_orderstatus = 'F'")],
        "documents": [
            dt.unique("doc_id"), dt.unique("text"), dt.accepted_values("lang", ["en", "fr", "de"]), dt.row_count_between(1, 10)],
    }


@query("q15_test_suite", """
    with r as (
      select 'lineitem' as "table", 'not_null_l_orderkey' as test, (select count(*) from lineitem where l_orderkey is null) as n, 'error' as severity, '' as degraded
      union all select 'lineitem', 'not_null_l_shipdate', (select count(*) from lineitem where l_shipdate is null), 'error', ''
      union all select 'lineitem', 'accepted_values_l_returnflag', (select count(*) from lineitem where l_returnflag not in ('A', 'N', 'R')), 'error', ''
      union all select 'lineitem', 'accepted_values_l_linestatus', (select count(*) from lineitem where l_linestatus <> 'O'), 'warn', 'warn'
      union all select 'lineitem', 'accepted_range_l_quantity', (select count(*) from lineitem where l_quantity < 1 or l_quantity > 50), 'error', ''
      union all select 'lineitem', 'between_l_discount', (select count(*) from lineitem where l_returnflag = 'R' and l_discount > 0.09), 'error', 'where'
      union all select 'lineitem', 'row_count_between', 0, 'error', ''
      union all select 'lineitem', 'unique_combination_l_orderkey_l_linenumber',
        least(10, (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))), 'error', 'limit'
      union all select 'lineitem', 'relationships_l_orderkey', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)), 'error', ''
      union all select 'lineitem', 'relationships_l_partkey', (select count(*) from lineitem where l_partkey not in (select p_partkey from part)), 'error', ''
      union all select 'orders', 'primary_key_o_orderkey', 0, 'error', ''
      union all select 'orders', 'not_null_o_custkey', 0, 'error', ''
      union all select 'orders', 'match_regex_o_orderpriority', (select count(*) from orders where o_orderpriority like '5%'), 'error', ''
      union all select 'orders', 'relationships_o_custkey', (select count(*) from orders where o_custkey not in (select c_custkey from customer)), 'error', ''
      union all select 'orders', 'accepted_range_o_totalprice', (select count(*) from orders where o_orderstatus = 'F' and o_totalprice > 499000), 'error', 'where'
      union all select 'documents', 'unique_doc_id', 0, 'error', ''
      union all select 'documents', 'unique_text', (select count(*) from (select 1 from documents group by text having count(*) > 1)), 'error', ''
      union all select 'documents', 'accepted_values_lang', (select count(*) from documents where lang = 'es'), 'error', ''
      union all select 'documents', 'row_count_between', 1, 'error', '')
    select "table", test, cast(n as bigint) as failures, severity, degraded,
           case when n = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status from r""")
def _(spark, sf):
    tests = suite()
    tables = {t: table(spark, sf, t) for t in (*tests, "part", "customer")}
    return dt.run_suite(tables, tests).drop("kind")


@query("q14_composite_keys", """
    with lines as (select l_orderkey, case when l_linenumber = 7 then null else l_linenumber end as l_linenumber, l_partkey, l_suppkey from lineitem),
    parts as (select distinct l_partkey as pk, l_suppkey as sk from lineitem where l_quantity > 25)
    select 'constraint_foreign_key_l_partkey_l_suppkey' as test, (select count(*) from lines where (l_partkey, l_suppkey) not in (select pk, sk from parts)) as failures
    union all select 'constraint_not_null_l_orderkey', 0 union all select 'constraint_not_null_l_linenumber', (select count(*) from lines where l_linenumber is null)
    union all select 'constraint_unique_l_orderkey_l_linenumber', (select count(*) from (select 1 from lines where l_linenumber is not null group by l_orderkey, l_linenumber having count(*) > 1))""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("l_linenumber"), "l_partkey", "l_suppkey")
    parts = table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).distinct()
    declared = {"lines": [dt.Constraint("foreign_key", ("l_partkey", "l_suppkey"), to="parts", to_columns=("pk", "sk")),
                          dt.Constraint("not_null", ("l_orderkey", "l_linenumber")), dt.Constraint("unique", ("l_orderkey", "l_linenumber"))]}
    return dt.verify_constraints({"lines": lines, "parts": parts}, declared, "databricks").select("test", "failures")


@query("q15_long_keys", """
    with t as (select text from documents where text is not null group by text having count(*) > 1)
    select 'documents' as "table", 'unique_text' as test, (select count(*) from t) as failures
    union all select 'documents', 'unique_combination_text_lang', (select count(*) from (select 1 from documents group by text, lang having count(*) > 1))
    union all select 'orders', 'unique_o_orderkey', 0""")
def _(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("documents", "orders")}
    found = dt.run_suite(tables, {"documents": [dt.unique("text"), dt.unique_combination(["text", "lang"])], "orders": [dt.unique("o_orderkey")]})
    return found.select("table", "test", "failures")


@query("f2_suite", """
    select 'orders' as "table", 'not_null_o_custkey' as test, 'pass' as status, 0::bigint as failures
    union all select 'orders', 'accepted_range_o_totalprice', 'warn', count(*) from orders where o_totalprice > 400000
    union all select 'customer', 'primary_key_c_custkey', 'pass', 0""")
def _(spark, sf):
    checks = dt.Suite({"orders": [dt.not_null("o_custkey"), dt.accepted_range("o_totalprice", 0, 400000, severity="warn")], "customer": [dt.primary_key(["c_custkey"])]})
    return checks.run({t: table(spark, sf, t) for t in ("orders", "customer")}).select("table", "test", "status", "failures")
