"""Value keys, scalar functions and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, scalars
from ..functions.register import register
from ..operators import catalog_facts, data_tests
from ..operators.contracts import value_counts
from ..operators.diff import project_onto, unify_columns
from ..session import scratch_path
from ..sources.csv import read_seed_csv
from ..sources.fixtures import sparse_rows, variant_key
from .base import Derived, query, table

# the same numbers and words written in many ways
TOKENS = Derived("""
    select p_partkey as id, case
        when p_type = 'ECONOMY' then cast(p_size as string) || '.00'
        when p_type = 'SMALL' then '00' || cast(p_size as string)
        when p_type = 'MEDIUM' then '-0'
        when p_type = 'PROMO' then case when p_size < 10 then 'TRUE' when p_size < 20 then 'null' when p_size < 30 then '~' else '' end
        when p_type = 'STANDARD' then case when p_size < 25 then '"' || p_name || '"' else ' ' || cast(p_size as string) || ' ' end
        else case when p_size < 10 then cast(p_size as string) || 'e3' when p_size < 20 then '+' || cast(p_size as string) || '.50'
             when p_size < 30 then cast(p_partkey as string) || '123456789012345678901234567890123' else p_name end end as token
    from {part}""")
SHAPE = r"regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"


def number_sql(x):
    """Independent form: strip signs, zeros and exponents by hand for the shapes the derived tokens have."""
    return f"""case when regexp_full_match({x}, '[+-]?[0-9]+') then
        case when ltrim({x}, '+-0') = '' then '0' else (case when {x} like '-%' then '-' else '' end) || ltrim({x}, '+-0') end
      when {SHAPE.format(x)} then
        case when try_cast({x} as double) = floor(try_cast({x} as double)) then cast(cast({x} as double)::bigint as varchar)
             else rtrim(rtrim(cast({x}::double as varchar), '0'), '.') end end"""


@query("v4_canonical_number", f"select id, token, {number_sql('token')} as number from tokens", tokens=TOKENS)
def _(spark, sf):
    return TOKENS(spark, sf).withColumn("number", keys.canonical_number(F.col("token")))


@query("v1_csv_key", f"""
    select id, case when token = '' then 'null' when {SHAPE.format('token')} then 'number:' || {number_sql('token')}
      when lower(token) in ('true', 'false') then 'bool:' || lower(token) else 'str:' || token end as key from tokens""",
       tokens=TOKENS)
def _(spark, sf):
    return TOKENS(spark, sf).select("id", keys.key_token(keys.csv_key(F.col("token"))).alias("key"))


@query("v2_token_key", f"""
    with trimmed as (select id, trim(token) as token from tokens)
    select id, case when token like '"%"' then 'str:' || substr(token, 2, length(token) - 2)
      when token in ('', 'null', '~') then 'null' when token in ('true', 'false') then 'bool:' || token
      when {SHAPE.format('token')} then 'number:' || {number_sql('token')} else 'str:' || token end as key from trimmed""",
       tokens=TOKENS)
def _(spark, sf):
    return TOKENS(spark, sf).select("id", keys.key_token(keys.token_key(F.col("token"))).alias("key"))


@query("v3_typed_key", """
    select o_orderkey, 'number:' || cast(o_custkey as varchar) as k_int,
           'number:' || rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') as k_double, 'str:' || o_orderstatus as k_text,
           'str:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') as k_time,
           'bool:' || cast(o_orderstatus = 'F' as varchar) as k_bool,
           'str:["' || o_orderstatus || '","' || o_orderpriority || '"]' as k_array from orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("flag", F.col("o_orderstatus") == "F").withColumn(
        "pair", F.array("o_orderstatus", "o_orderpriority"))
    types = {f.name: f.dataType for f in df.schema.fields}
    key = lambda c, name: keys.key_token(keys.typed_key(F.col(c), types[c])).alias(name)
    return df.select("o_orderkey", key("o_custkey", "k_int"), key("o_totalprice", "k_double"), key("o_orderstatus", "k_text"),
                     key("o_orderdate", "k_time"), key("flag", "k_bool"), key("pair", "k_array"))


@query("v5_row_key", """
    with tok as (select c_custkey, 'number:' || cast(c_nationkey as varchar) as a, 'str:' || c_name as b, 'str:' || c_mktsegment as c from customer)
    select c_custkey, strlen(a) || ':' || a || strlen(b) || ':' || b || strlen(c) || ':' || c as row_key from tok""")
def _(spark, sf):
    df = table(spark, sf, "customer")
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [keys.typed_key(F.col(c), types[c]) for c in ("c_nationkey", "c_name", "c_mktsegment")]
    return df.select("c_custkey", keys.row_key(parts).alias("row_key"))


@query("v6_normalize_path", """
    select page_id, regexp_replace(regexp_replace(regexp_replace('.\\/./' || replace(url, '/', '\\') || '//x', '\\\\', '/', 'g'),
      '^([.]/)+', ''), '/{2,}', '/', 'g') as path from pages""")
def _(spark, sf):
    odd = F.concat(F.lit(".\\/./"), F.regexp_replace("url", "/", r"\\\\"), F.lit("//x"))
    return table(spark, sf, "pages").select("page_id", scalars.normalize_path(odd).alias("path"))


@query("v7_parse_relation", """
    select s_suppkey, cast(null as varchar) as database, 'raw ' || s_nationkey as schema, 'supplier.' || s_suppkey as identifier from supplier""")
def _(spark, sf):
    name = F.concat(F.lit('"RAW '), "s_nationkey", F.lit('"."Supplier.'), "s_suppkey", F.lit('"'))
    return table(spark, sf, "supplier").select("s_suppkey", scalars.parse_relation(name).alias("r")).select("s_suppkey", "r.*")


@query("v8_input_leaf", """
    select p_partkey, case when p_type = 'PROMO' then null else lower(p_name) end as leaf from part""")
def _(spark, sf):
    call = (F.when(F.col("p_type") == "PROMO", F.concat(F.lit("var('"), "p_name", F.lit("')")))
            .when(F.col("p_type") == "SMALL", F.concat(F.lit('source("raw", "'), F.upper("p_name"), F.lit('")')))
            .otherwise(F.concat(F.lit(" ref( '"), "p_name", F.lit("' ) "))))
    return table(spark, sf, "part").select("p_partkey", scalars.input_leaf(call).alias("leaf"))


@query("v9_bare_name", """
    select p_partkey, 'part_' || p_partkey as bare, case when p_size > 25 then 'v' || p_size else 'part_' || p_partkey end as leaf from part""")
def _(spark, sf):
    ident = F.concat(F.lit("model.shop.part_"), "p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit(".v"), "p_size")).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", scalars.bare_name(ident).alias("bare"), scalars.leaf_name(ident).alias("leaf"))


@query("v10_canonical_type", """
    select c_custkey, case c_mktsegment when 'BUILDING' then 'string' when 'MACHINERY' then 'integer' when 'HOUSEHOLD' then 'double'
      when 'FURNITURE' then 'numeric' else 'boolean' end as type from customer""")
def _(spark, sf):
    declared = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("VARCHAR("), "c_nationkey", F.lit(")")))
                .when(F.col("c_mktsegment") == "MACHINERY", "Int4").when(F.col("c_mktsegment") == "HOUSEHOLD", "double precision")
                .when(F.col("c_mktsegment") == "FURNITURE", "NUMERIC(10,2)").otherwise(" Bool "))
    return table(spark, sf, "customer").select("c_custkey", scalars.canonical_type(declared).alias("type"))


@query("v11_deprecation_state", """
    select o_orderkey, case when o_orderstatus = 'P' then null when o_orderdate > timestamp '1998-06-15' then 'scheduled' else 'elapsed' end as state,
           case when o_orderstatus = 'P' then null when o_orderdate > timestamp '1998-06-15' then 'info' else 'danger' end as severity from orders""")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    state = scalars.deprecation_state(raw, F.lit("1998-06-15").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", state.alias("s")).select("o_orderkey", "s.*")


# every document becomes a template that names its language and, in one source, a name only known at run time
TEMPLATES = Derived("""
    select doc_id, '{{{{ var("' || lang || '") }}}} ' || text || ' var("outside") {{% if var(' ||
           case when source = 'src0' then 'x' else '''' || source || '''' end || ') %}}' as body from {documents}""")


@query("v12_text_references", """
    select doc_id as id, lang as name, false as dynamic from documents
    union select doc_id, case when source = 'src0' then null else source end, source = 'src0' from documents""")
def _(spark, sf):
    return scalars.text_references(TEMPLATES(spark, sf), "doc_id", "body")


@query("v18_json_meta", """
    select event_id, 'k' as name, regexp_extract(props, '[0-9]+') as value, 'type,' || event_type as tags from events""")
def _(spark, sf):
    tags = scalars.sorted_tags(F.array(F.lit("type"), "event_type", F.lit("type")))
    ordered = F.array_sort(tags, lambda a, b: F.when(a == "type", -1).when(b == "type", 1).otherwise(0))
    df = table(spark, sf, "events").select("event_id", F.explode(scalars.meta_pairs(F.col("props"))).alias("m"),
                                           F.concat_ws(",", ordered).alias("tags"))
    return df.select("event_id", F.col("m.key").alias("name"), F.col("m.value").alias("value"), "tags")


@query("f1_sql_functions", f"""
    select id, {number_sql('token')} as number, case when token = '' then 'null' when {SHAPE.format('token')}
      then 'number:' || {number_sql('token')} when lower(token) in ('true', 'false') then 'bool:' || lower(token)
      else 'str:' || token end as csv_token from tokens""", tokens=TOKENS)
def _(spark, sf):
    register(spark)
    return spark.sql(f"select id, pl_number(token) as number, pl_csv_token(token) as csv_token from ({TOKENS.text(sf)})")


@query("p1_unify_columns", """
    select t.*, case when status = 'removed' then 0 when "column" = 'n_lines' then (select count(distinct l_orderkey) from lineitem)
      else (select count(*) from orders) end as n_values
    from (values (0, 'o_orderkey', 'present'), (1, 'o_custkey', 'present'), (2, 'o_orderstatus', 'present'),
      (3, 'o_totalprice', 'present'), (4, 'o_orderdate', 'present'), (5, 'n_lines', 'added'), (6, 'o_orderpriority', 'removed'))
      t(position, "column", status)""")
def _(spark, sf):
    old = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    new = old.drop("o_orderpriority").join(lines, "o_orderkey", "left")
    counts = value_counts(new).withColumnRenamed("name", "column")
    return unify_columns(old, new).join(counts, "column", "left").withColumn(
        "n_values", F.coalesce("n_values", F.lit(0).cast("long")))


@query("p2_project_onto", """
    select 'number' as tag, 'c_custkey' as "column", count(*) as n from customer union all
    select 'absent', 'missing', count(*) from customer union all
    select case when c_acctbal < 5000 then 'null' else 'number' end, 'c_acctbal', count(*) from customer group by 1""")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal")))
    names = ["c_custkey", "c_acctbal", "missing"]
    cells = project_onto(df, names)
    tags = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["key"]["t"].alias("tag")) for c in names])).alias("x")
    return cells.select(tags).groupBy("x.column", "x.tag").agg(F.count(F.lit(1)).alias("n"))


@query("p3_rename_stage", """
    select l_orderkey as order_id, l_quantity as units, -cast(l_extendedprice as decimal(15,2))::double as amount from lineitem where l_returnflag = 'R'""")
def _(spark, sf):
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("units"), (-F.col("l_extendedprice")).alias("amount"))


@query("p4_split_quarantine", """
    select coalesce(l_tax < 0.08 and l_returnflag <> 'N', false) as valid, count(*) as n from lineitem group by 1""")
def _(spark, sf):
    flag = F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_tax") < 0.08)
    good, bad = data_tests.split_quarantine(table(spark, sf, "lineitem").withColumn("ok", flag), "ok")
    count = lambda df, v: df.agg(F.lit(v).alias("valid"), F.count(F.lit(1)).alias("n"))
    return count(good, True).unionByName(count(bad, False))


@query("p5_test_modifiers", """
    select 'filtered' as test, (select count(*) from orders where o_orderstatus = 'F' and o_totalprice > 400000) as failures,
           'warn' as status, 'warn,where' as degraded
    union all select 'capped', 100, 'fail', 'limit' union all select 'off', 0, 'skipped', ''""")
def _(spark, sf):
    tests = [data_tests.accepted_range("o_totalprice", high=400000, where="o_orderstatus = 'F'", severity="warn", name="filtered"),
             data_tests.accepted_range("o_totalprice", high=400000, limit=100, name="capped"),
             data_tests.not_null("o_custkey", enabled=False, name="off")]
    out = data_tests.run_suite({"orders": table(spark, sf, "orders")}, {"orders": tests})
    return out.select("test", "failures", "status", "degraded")


@query("p6_row_condition", """
    select count(*) as failures from lineitem where l_returnflag = 'R' and l_discount > 0.05""")
def _(spark, sf):
    test = data_tests.between("l_discount", 0, 0.05, row_condition="l_returnflag = 'R'")
    return data_tests.run_test(table(spark, sf, "lineitem"), test).count()


RESOURCES = Derived("""
    select 'model' as kind, 'model.' || cast(p_partkey as string) as id from {part}
    union all select 'seed', 'seed.' || n_name from {nation} union all select 'source', 'source.' || cast(s_suppkey as string) from {supplier}""")


@query("p7_resource_filter", "select kind, id from r where kind = 'seed'", r=RESOURCES)
def _(spark, sf):
    return catalog_facts.resource_filter(RESOURCES(spark, sf), "seed").select("kind", "id")


@query("p8_listed_columns_only", "select o_custkey, o_orderstatus from orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return data_tests.listed_columns_only(orders, orders.select("o_custkey", "o_orderstatus"))


SEED_ROWS = Derived("""
    select p_partkey as id, case when p_size < 5 then null else p_name || ', "' || p_brand || '"' end as label, p_size as size,
           p_type || chr(10) || p_name as note from {part}""")


@query("s1_read_seed_csv", "select cast(id as bigint) as id, label, cast(size as int) as size, note from s", s=SEED_ROWS)
def _(spark, sf):
    path = scratch_path(spark, "seed")
    SEED_ROWS(spark, sf).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read_seed_csv(spark, path, column_types={"id": "long", "size": "int"})


# rows as sparse JSON objects: large parts have no price, small ones a null price, names are quoted numbers
SPARSE = Derived("""
    select p_partkey as id, '{{"size":' || cast(p_size as string) || ',"name":"' || cast(p_size as string) || '"' ||
           case when p_size > 40 then '' when p_size < 10 then ',"price":null'
                else ',"price":' || cast(p_partkey as string) || '.50' end || ',"flag":true,"nested":{{"a":[1]}}}}' as row
    from {part}""")


@query("s2_fixture_rows", """
    select id, 'number:' || p_size as size, 'str:' || p_size as name, case when p_size > 40 then 'absent' when p_size < 10 then 'null'
      else 'number:' || p_partkey || '.5' end as price, 'bool:true' as flag, 'str:{"a":[1]}' as nested, 'absent' as other
    from (select p_partkey as id, * from part)""")
def _(spark, sf):
    rows = sparse_rows(SPARSE(spark, sf), "row")
    names = ["size", "name", "price", "flag", "nested", "other"]
    return rows.select("id", *[keys.key_token(variant_key(F.col("row"), n)).alias(n) for n in names])
