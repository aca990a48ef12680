"""Catalog comparisons: one model per part, in two snapshots that differ by the parts' own attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, catalog_facts as cf, contracts as ct, joins, snapshots as sn
from ..operators.governance import governance_audit
from ..sources import catalog as cat
from . import q_audits
from .base import Derived, query, table

MODEL = "'model.shop.part_' || cast(p_partkey as string)"
CUR = Derived(f"""
    select {MODEL} as id, 'model' as kind, lower(p_brand) as package, 'models/' || lower(p_type) || '/part_' || cast(p_partkey as string) || '.sql' as path,
           'models/' || lower(p_brand) || '/_models.yml' as patch_path, md5(p_name || p_type) as checksum,
           split_part(p_name, ' ', 1) as schema_name, '"db"."' || split_part(p_name, ' ', 1) || '"' as relation_name,
           'color,noun' as macro_text, p_size > 25 as enforced, case when p_type = 'LARGE' then 'float' when p_type = 'SMALL' then 'text' else 'numeric(10,2)' end as price_type,
           case when p_type = 'ECONOMY' then 'view' when p_size < 40 then 'table' else 'incremental' end as materialized,
           p_size, p_type, p_name, p_partkey, p_name || ' v2' as body, p_brand
    from {{part}} where p_size <> 49""")
BASE = Derived(f"""
    select {MODEL} as id, 'model' as kind, lower(p_brand) as package, 'models/' || lower(p_type) || '/part_' || cast(p_partkey as string) || '.sql' as path,
           'models/' || lower(p_brand) || '/_models.yml' as patch_path, md5(p_name || case when p_size = 7 then 'old' else p_type end) as checksum,
           case when p_brand = 'Brand#4' then 'legacy' else split_part(p_name, ' ', 1) end as schema_name,
           '"' || case when p_type = 'PROMO' then 'prod' else 'db' end || '"."' || split_part(p_name, ' ', 1) || '"' as relation_name,
           case when p_size = 9 then 'noun,color,extra' else 'noun,color,noun' end as macro_text, p_size > 20 as enforced,
           case when p_type = 'LARGE' then 'double' else 'NUMERIC(12,2)' end as price_type,
           case when p_type = 'ECONOMY' and p_size < 10 then 'view' else 'table' end as materialized,
           p_size, p_type, p_name, p_partkey, case when p_type = 'MEDIUM' then p_name || ' v1' else '  ' || p_name || ' v2 ' end as body, p_brand
    from {{part}} where p_size <> 3""")
PAIR = dict(cur=CUR, base_=BASE)


def snapshot(derived, spark, sf):
    df = derived(spark, sf)
    return df.select(
        "id", "kind", "package", "path", "patch_path", "checksum", "relation_name", "materialized", "body",
        F.create_map(F.lit("schema"), "schema_name", F.lit("enabled"), F.lit("true")).alias("config"),
        F.split("macro_text", ",").alias("macros"), F.col("enforced").alias("contract_enforced"),
        F.create_map(F.lit("price"), "price_type", F.lit("id"), F.lit("bigint")).alias("columns"))


FLAGS = """
    flags as (select c.id, b.id is null as is_new, b.id is null or c.checksum <> b.checksum as body,
      b.id is null or c.schema_name <> b.schema_name as configs, b.id is null or c.relation_name <> b.relation_name as relation,
      b.id is null or b.p_size = 9 as macros, b.id is null or c.enforced <> b.enforced or c.price_type <> b.price_type as contract
      from cur c left join base_ b on b.id = c.id)"""


@query("d6_diff_snapshots", f"""
    with {FLAGS} select *, body or configs or contract as modified from flags""", **PAIR)
def _(spark, sf):
    return sn.diff_snapshots(snapshot(CUR, spark, sf), snapshot(BASE, spark, sf), ("contract", "configs"))


@query("d6_body_only_by_default", f"with {FLAGS} select id from flags where body", **PAIR)
def _(spark, sf):
    return sn.diff_snapshots(snapshot(CUR, spark, sf), snapshot(BASE, spark, sf)).filter("modified").select("id")


@query("u4_catalog_set_difference", """
    select 'new' as side, id from cur where id not in (select id from base_) union all
    select 'removed', id from base_ where id not in (select id from cur)""", **PAIR)
def _(spark, sf):
    cur, base = CUR(spark, sf), BASE(spark, sf)
    return sn.only_in(cur, base).select(F.lit("new").alias("side"), "id").unionByName(
        sn.only_in(base, cur).select(F.lit("removed").alias("side"), "id"))


@query("u5_union_of_causes", f"""
    with {FLAGS} select id, concat_ws(',', case when body then 'body' end, case when configs then 'configs' end, case when relation then 'relation' end,
      case when macros then 'macros' end, case when contract then 'contract' end) as causes
    from flags where body or configs or relation or macros or contract""", **PAIR)
def _(spark, sf):
    flags = sn.diff_snapshots(snapshot(CUR, spark, sf), snapshot(BASE, spark, sf), sn.AXES).filter("modified")
    causes = F.concat_ws(",", *[F.when(F.col(a), F.lit(a)) for a in ("body", *sn.AXES)])
    return flags.select("id", causes.alias("causes"))


@query("d7_changed_definitions", """
    select id from cur c where not exists (select 1 from base_ b where b.id = c.id and b.checksum = c.checksum and b.materialized = c.materialized)""",
       **PAIR)
def _(spark, sf):
    pick = lambda d: d(spark, sf).select("id", "checksum", "materialized")
    return sn.changed_definitions(pick(CUR), pick(BASE))


@query("d8_changed_bodies", "select c.id from cur c join base_ b on b.id = c.id where trim(c.body) <> trim(b.body)", **PAIR)
def _(spark, sf):
    return sn.changed_bodies(CUR(spark, sf), BASE(spark, sf), "id", "body")


# ---- contracts
COLUMNS = """
    select id, 'id' as name, 'bigint' as type from {{v}} union all select id, 'price', price_type from {{v}}
    union all select id, 'note', case when p_size > 45 then null else 'text' end from {{v}} where {note}"""
CONSTRAINTS = """
    select id, 'id' as column_name, 'not_null' as kind, cast(null as string) as expression from {{v}} where {nn}
    union all select id, 'id', 'custom', 'x' from {{v}} where {custom}
    union all select id, null, 'check', 'price > 0' from {{v}} where {check}"""
OLD_COLUMNS = Derived(COLUMNS.replace("{{v}}", "{base_}").format(base_="{base_}", note="p_size < 35"), base_=BASE)
NEW_COLUMNS = Derived(COLUMNS.replace("{{v}}", "{cur}").format(cur="{cur}", note="p_size < 30 or p_size > 40"), cur=CUR)
OLD_CONSTRAINTS = Derived(CONSTRAINTS.replace("{{v}}", "{base_}").format(base_="{base_}", nn="p_type <> 'PROMO'", custom="true", check="p_size > 30"), base_=BASE)
NEW_CONSTRAINTS = Derived(CONSTRAINTS.replace("{{v}}", "{cur}").format(cur="{cur}", nn="p_type <> 'MEDIUM'", custom="false", check="p_size > 35"), cur=CUR)
CONTRACT = dict(**PAIR, oc=OLD_COLUMNS, nc=NEW_COLUMNS, ok_=OLD_CONSTRAINTS, nk=NEW_CONSTRAINTS)
REASONS = """
    pair as (select b.id, b.enforced as oe, c.enforced as ne, b.enforced and c.enforced as both_on,
        b.materialized in ('table', 'incremental') as om, c.materialized in ('table', 'incremental') as nm from base_ b join cur c on c.id = b.id),
    live as (select * from pair where both_on and id not in (select b.id from base_ b join cur c on c.id = b.id where b.checksum = c.checksum and b.p_type = 'STANDARD')),
    reasons as (
      select id, 'contract_enforcement_dropped' as reason, null as detail from pair where oe and not ne
      union all select l.id, 'column_removed', oc.name from live l join oc on oc.id = l.id where not exists (select 1 from nc where nc.id = l.id and nc.name = oc.name)
      union all select l.id, 'column_type_changed', oc.name || ': ' || coalesce(oc.type, 'unknown') || ' -> ' || coalesce(nc.type, 'unknown')
        from live l join oc on oc.id = l.id join nc on nc.id = l.id and nc.name = oc.name
        where (case when lower(oc.type) like 'numeric%' then 'numeric' when oc.type in ('float', 'double') then 'double' else oc.type end)
          is distinct from (case when lower(nc.type) like 'numeric%' then 'numeric' when nc.type in ('float', 'double') then 'double' else nc.type end)
      union all select distinct l.id, 'column_constraint_removed', null from live l join ok_ o on o.id = l.id where om and o.column_name is not null and o.kind <> 'custom'
        and not exists (select 1 from nk n where n.id = o.id and n.column_name = o.column_name and n.kind = o.kind)
      union all select distinct l.id, 'model_constraint_removed', null from live l join ok_ o on o.id = l.id where om and o.column_name is null
        and not exists (select 1 from nk n where n.id = o.id and n.column_name is null and n.kind = o.kind)
      union all select l.id, 'materialization_changed', null from live l where om and not nm
        and exists (select 1 from ok_ o where o.id = l.id and (o.column_name is null or o.kind <> 'custom')))"""


def contract_inputs(spark, sf):
    # standard parts carry a contract checksum, which settles equal ones without looking further
    node = lambda d: d(spark, sf).select("id", "enforced", F.when(F.col("p_type") == "STANDARD", F.col("checksum")).alias("checksum"), "materialized")
    cons = lambda d: d(spark, sf).withColumnRenamed("column_name", "column")
    return node(BASE), node(CUR), OLD_COLUMNS(spark, sf), NEW_COLUMNS(spark, sf), cons(OLD_CONSTRAINTS), cons(NEW_CONSTRAINTS)


@query("d11_contract_reasons", f"with {REASONS} select * from reasons", **CONTRACT)
def _(spark, sf):
    return ct.contract_reasons(*contract_inputs(spark, sf))


@query("d11_classify_contract", f"""
    with {REASONS} select p.id, case when count(r.reason) > 0 then 'breaking' when not oe and ne then 'changed_not_breaking' else 'unchanged' end as change,
      count(r.reason) as n_reasons from pair p left join reasons r on r.id = p.id group by p.id, oe, ne""", **CONTRACT)
def _(spark, sf):
    return ct.classify_contract(*contract_inputs(spark, sf))


GOVERNED = Derived(f"""
    select id, kind, case when p_size <= 10 then 'private' when p_size <= 30 then 'public' when p_size <= 40 then 'protected' end as access,
           case when p_size > 5 then split_part(p_name, ' ', 2) end as grp, case when p_size > 15 then '1' end as version,
           case when p_size > 15 then case when p_size < 20 then '2' else '1' end end as latest_version,
           case when p_size = 50 then 'soon' when p_size > 45 then '2024-0' || cast(p_size - 44 as string) || '-15' end as deprecation_date, p_partkey
    from {{cur}}""", cur=CUR)
REFS = Derived(f"""
    select distinct 'model.shop.part_' || cast(up as string) as src, 'model.shop.part_' || cast(p_partkey as string) as dst from (
      select p_partkey, cast(floor(p_partkey / 2) as bigint) as up from {{part}} union all
      select p_partkey, cast(floor(p_partkey / 3) as bigint) from {{part}}) where up <> p_partkey""")
GROUPS = Derived("select split_part(p_name, ' ', 2) as grp, case when count(*) > 200 then min(p_brand) || '@example.com' end as owner_email from {part} group by 1")


@query("g15_governance_audit", f"""
    with {REASONS}, links as (select m.id, t.id as target, t.access, t.grp as tgrp, m.grp, t.deprecation_date as dep from refs r
      join gov m on m.id = r.dst join gov t on t.id = r.src)
    select id, 'public_contract_broken' as rule, null as detail, null as severity from gov where access = 'public' and id in (select id from reasons)
    union all select id, 'version_lags_latest', version || ' / ' || latest_version, null from gov where version <> latest_version
    union all select g.id, 'group_owner_touch', g.grp || ' / ' || o.owner_email, null from gov g join grps o on o.grp = g.grp where o.owner_email is not null
    union all select id, 'ref_to_deprecated', target, case when dep > '2024-04-15' then 'info' else 'danger' end from links where dep <> 'soon'
    union all select id, 'access_violation', target, null from links where access = 'private' and tgrp is distinct from grp""",
       gov=GOVERNED, refs=REFS, grps=GROUPS, **CONTRACT)
def _(spark, sf):
    nodes = GOVERNED(spark, sf).withColumnRenamed("grp", "group")
    groups = GROUPS(spark, sf).withColumnRenamed("grp", "group")
    contracts = ct.classify_contract(*contract_inputs(spark, sf))
    return governance_audit(nodes.select("id"), nodes, REFS(spark, sf), groups, contracts, F.lit("2024-04-15").cast("date"))


# ---- settings by deepest prefix
ENTITIES = Derived("""
    select 'model.shop.part_' || cast(p_partkey as string) as id, lower(p_brand) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '/') as path_text from {part}""")
RULE = """
    select '' as prefix_text, 'materialized' as key, 'view' as value
    union all select lower(p_brand), 'materialized', max(p_type) from {{part}} group by 1
    union all select lower(p_brand) || '/' || lower(p_type), 'schema', min({schema}) from {{part}} group by 1
    union all select lower(p_brand) || '/' || lower(p_type) || '/' || split_part(p_name, ' ', 1), 'materialized', max(p_name) from {{part}}
      where {deep} group by 1
    union all select 'nowhere/at/all', 'materialized', 'x'"""
OLD_RULES = Derived(RULE.format(schema="p_name", deep="p_size > 30"))
NEW_RULES = Derived(RULE.format(schema="case when p_brand < 'Brand#2' then p_name else p_brand end", deep="p_size > 40"))


def entities(spark, sf):
    return ENTITIES(spark, sf).select("id", F.split("path_text", "/").alias("path"))


def rules(derived, spark, sf):
    df = derived(spark, sf)
    prefix = F.when(F.col("prefix_text") == "", F.array().cast("array<string>")).otherwise(F.split("prefix_text", "/"))
    return df.select(prefix.alias("prefix"), "key", "value")


def won_sql(name):
    return f"""select id, key, value, depth, prefix_text from (
      select e.id, r.key, r.value, r.prefix_text, case when prefix_text = '' then 0 else len(string_split(prefix_text, '/')) end as depth,
        row_number() over (partition by e.id, r.key order by length(r.prefix_text) desc) as rn
      from entities e join {name} r on r.prefix_text = '' or starts_with(e.path_text || '/', r.prefix_text || '/')) where rn = 1"""


@query("j14_deepest_prefix", f"select id, key, value, cast(depth as int) as depth from ({won_sql('rules_')})", entities=ENTITIES, rules_=OLD_RULES)
def _(spark, sf):
    return joins.deepest_prefix(entities(spark, sf), rules(OLD_RULES, spark, sf)).drop("prefix")


@query("d14_setting_impact", f"""
    with o as ({won_sql('old_rules')}), n as ({won_sql('new_rules')})
    select coalesce(o.id, n.id) as id, coalesce(o.key, n.key) as key, o.value as old, n.value as new,
           cast(greatest(coalesce(o.depth, -1), coalesce(n.depth, -1)) as int) as depth
    from o full join n on n.id = o.id and n.key = o.key where o.value is distinct from n.value""",
       entities=ENTITIES, old_rules=OLD_RULES, new_rules=NEW_RULES)
def _(spark, sf):
    e = entities(spark, sf)
    won = lambda d: joins.deepest_prefix(e, rules(d, spark, sf))
    return sn.setting_impact(won(OLD_RULES), won(NEW_RULES)).drop("prefix")


SCOPED = """
    select lower(p_brand) as package, 'v' || cast(p_size as string) as name, {value} as value from {{part}} where {keep} group by 1, 2"""
SHARED = """
    select 'v' || cast(p_size as string) as name, {value} as value from {{part}} where {keep} group by 1
    union all select lower(p_brand), 'a package is no variable' from {{part}} group by 1"""
OLD_SCOPED = Derived(SCOPED.format(value="max(p_type)", keep="p_type <> 'LARGE'"))
NEW_SCOPED = Derived(SCOPED.format(value="case when min(p_size) < 10 then min(p_type) else max(p_type) end", keep="p_type <> 'LARGE'"))
OLD_SHARED = Derived(SHARED.format(value="max(p_name)", keep="p_size > 2"))
NEW_SHARED = Derived(SHARED.format(value="case when p_size > 40 then 'changed' else max(p_name) end".replace("p_size > 40", "min(p_size) > 40"), keep="p_size > 5"))
PACKAGES = Derived("select distinct lower(p_brand) as package from {part}")
REQUESTS = Derived("select distinct lower(b.p_brand) as package, 'v' || cast(b.p_size as string) as name from {part} b")
SETTINGS = dict(os=OLD_SCOPED, ns=NEW_SCOPED, oh=OLD_SHARED, nh=NEW_SHARED, packages=PACKAGES)


@query("j15_priority_lookup", """
    select r.package, r.name, coalesce(s.value, g.value) as value, case when s.value is not null then 'package' when g.value is not null then 'global' end as precedence
    from requests r left join os s on s.package = r.package and s.name = r.name
    left join oh g on g.name = r.name and g.name not in (select package from packages)""", requests=REQUESTS, **SETTINGS)
def _(spark, sf):
    return joins.priority_lookup(REQUESTS(spark, sf), OLD_SCOPED(spark, sf), OLD_SHARED(spark, sf), PACKAGES(spark, sf))


def settings(scoped, shared, spark, sf):
    return scoped(spark, sf).select(F.col("package").alias("scope"), "name", "value").unionByName(
        shared(spark, sf).select(F.lit(None).cast("string").alias("scope"), "name", "value"))


EDITS = """
    o as (select package as scope, name, value from os union all select null, name, value from oh),
    n as (select package as scope, name, value from ns union all select null, name, value from nh),
    edits as (select coalesce(o.scope, n.scope) as scope, coalesce(o.name, n.name) as name, o.value as old, n.value as new
      from o full join n on n.scope is not distinct from o.scope and n.name = o.name where o.value is distinct from n.value)"""


@query("d13_diff_settings", f"with {EDITS} select * from edits", **SETTINGS)
def _(spark, sf):
    return sn.diff_settings(settings(OLD_SCOPED, OLD_SHARED, spark, sf), settings(NEW_SCOPED, NEW_SHARED, spark, sf))


VAR_REFS = Derived("""
    select p_partkey as id, lower(p_brand) as package, 'direct' as tier, 'v' || cast(p_size as string) as name, false as dynamic from {part}
    union all select p_partkey, lower(p_brand), 'config', 'v' || cast(51 - p_size as string), false from {part} where p_type = 'SMALL'
    union all select l_partkey, lower(p_brand), 'macro', 'v' || cast(l_linenumber as string), false from {lineitem} join {part} on l_partkey = p_partkey
      where l_returnflag = 'R' group by 1, 2, 4
    union all select p_partkey, lower(p_brand), 'direct', cast(null as string), true from {part} where p_type = 'PROMO'""")


@query("d15_variable_impact", f"""
    with {EDITS},
    wanted as (select distinct e.name, p.package from edits e, packages p where e.scope is null),
    res as (select w.*, coalesce(a.value, b.value) as ov, coalesce(c.value, d.value) as nv from wanted w
      left join os a on a.package = w.package and a.name = w.name left join oh b on b.name = w.name and b.name not in (select package from packages)
      left join ns c on c.package = w.package and c.name = w.name left join nh d on d.name = w.name and d.name not in (select package from packages)),
    reach as (select name, package from res where ov is distinct from nv union select name, scope from edits where scope is not null),
    named as (select distinct r.name, v.id, v.tier from refs v join reach r on r.name = v.name and r.package = v.package where not v.dynamic)
    select name, id, tier from named union all
    select distinct r.name, v.id, 'dynamic' from refs v join reach r on r.package = v.package where v.dynamic
      and not exists (select 1 from named n where n.name = r.name and n.id = v.id)""", refs=VAR_REFS, **SETTINGS)
def _(spark, sf):
    load = lambda d: d(spark, sf)
    edits = sn.diff_settings(settings(OLD_SCOPED, OLD_SHARED, spark, sf), settings(NEW_SCOPED, NEW_SHARED, spark, sf))
    masked = sn.masked_packages(edits, load(PACKAGES), (load(OLD_SCOPED), load(OLD_SHARED)), (load(NEW_SCOPED), load(NEW_SHARED)))
    return sn.variable_impact(edits, masked, load(VAR_REFS), load(PACKAGES))


@query("d15_insulated_tests", f"""
    with {EDITS} select distinct 'v' || l_linenumber as name, 'unit.' || l_orderkey as test from lineitem
    where l_returnflag = 'A' and 'v' || l_linenumber in (select name from edits)""", **SETTINGS)
def _(spark, sf):
    edits = sn.diff_settings(settings(OLD_SCOPED, OLD_SHARED, spark, sf), settings(NEW_SCOPED, NEW_SHARED, spark, sf))
    pins = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        F.concat(F.lit("unit."), "l_orderkey").alias("test"), F.concat(F.lit("v"), "l_linenumber").alias("name"))
    return sn.insulated_tests(edits, pins)


@query("a12_reference_inventory", """
    with vars as (select distinct name, cast(null as varchar) as package from oh where name not in (select package from packages)
                  union all select name, package from os),
    hit as (select v.name, v.package, r.id, r.tier from vars v join refs r on r.name = v.name and not r.dynamic and (v.package is null or v.package = r.package)),
    dyn as (select distinct v.name, v.package, r.id from vars v join refs r on r.dynamic and (v.package is null or v.package = r.package))
    select v.name, v.package, (select count(distinct id) from hit h where h.name = v.name and h.package is not distinct from v.package and tier = 'direct') as direct,
      (select count(distinct id) from hit h where h.name = v.name and h.package is not distinct from v.package and tier = 'config') as config,
      (select count(distinct id) from hit h where h.name = v.name and h.package is not distinct from v.package and tier = 'macro') as macro,
      (select count(distinct id) from hit h where h.name = v.name and h.package is not distinct from v.package) as models,
      (select count(*) from dyn d where d.name = v.name and d.package is not distinct from v.package and not exists
        (select 1 from hit h where h.name = d.name and h.package is not distinct from d.package and h.id = d.id)) as dynamic
    from vars v""", refs=VAR_REFS, **SETTINGS)
def _(spark, sf):
    load = lambda d: d(spark, sf)
    shared = load(OLD_SHARED).join(load(PACKAGES), F.col("name") == F.col("package"), "left_anti")
    variables = shared.select("name", F.lit(None).cast("string").alias("package")).unionByName(load(OLD_SCOPED).select("name", "package"))
    return cf.reference_inventory(variables, load(VAR_REFS))


# ---- scope
UNIT_TESTS = Derived("""
    select 'unit.' || cast(o_orderkey as string) as id, 'model.shop.part_' || cast(o_custkey as string) as target_name, cast(null as string) as target_id,
           'tests/' || lower(o_orderpriority) || '/' || cast(o_custkey as string) || '.yml' as path, o_orderpriority as body from {orders}""")
OLD_UNIT_TESTS = Derived("""
    select 'unit.' || cast(o_orderkey as string) as id, 'model.shop.part_' || cast(o_custkey as string) as target_name, cast(null as string) as target_id,
           'tests/' || lower(o_orderpriority) || '/' || cast(o_custkey as string) || '.yml' as path,
           case when o_totalprice > 498000 then 'other' else o_orderpriority end as body from {orders} where o_totalprice > 1100""")
CHANGED_PATHS = Derived("""
    select 'models/' || lower(p_type) || '/part_' || cast(p_partkey as string) || '.sql' as path,
           case when p_size = 3 then 'added' when p_size = 49 then 'deleted' when p_size = 7 then 'renamed' else 'modified' end as status,
           case when p_size = 7 then 'models/old/part_' || cast(p_partkey as string) || '.sql' end as old_path from {part} where p_size in (3, 7, 11, 49)
    union all select 'models/' || lower(p_brand) || '/_models.yml', 'modified', null from {part} where p_brand = 'Brand#4' group by 1
    union all select 'tests/' || lower(o_orderpriority) || '/' || cast(o_custkey as string) || '.yml', 'modified', null from {orders} where o_totalprice > 499500""")


def bound_tests(derived, spark, sf):
    tests = derived(spark, sf)
    targets = joins.resolve_targets(tests.select(F.col("id").alias("ref"), "target_id", "target_name"), CUR(spark, sf).select("id"))
    return tests.join(targets, tests["id"] == targets["ref"]).select("id", "model", "path", "body")


SCOPE_SQL = """
    t as (select u.*, c.id as model from units u left join cur c on c.id = u.target_name),
    judged as (select t.*, t.model in (select id from changed) as hit, {changed_test} as touched from t),
    scoped as (select * from judged where touched or coalesce(hit, false)),
    models_in as (select distinct model as id from scoped where model is not null union
      select id from changed where id in (select id from cur) and id not in (select model from t where model is not null))"""


@query("d17_select_scope_baseline", f"""
    with {FLAGS}, changed as (select id from flags where body or macros),
    {SCOPE_SQL.format(changed_test="not exists (select 1 from old_units o where o.id = t.id and o.body = t.body)")}
    select 'model' as kind, id from models_in union all select 'test', id from scoped union all select 'changed_test', id from judged where touched""",
       units=UNIT_TESTS, old_units=OLD_UNIT_TESTS, **PAIR)
def _(spark, sf):
    tests = bound_tests(UNIT_TESTS, spark, sf)
    scope = sn.select_scope(tests, CUR(spark, sf).select("id"), snapshot(CUR, spark, sf), snapshot(BASE, spark, sf), ("macros",),
                            base_tests=bound_tests(OLD_UNIT_TESTS, spark, sf))
    return scope_rows(scope)


def scope_rows(scope):
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return tag(scope.models, "model").unionByName(tag(scope.tests, "test")).unionByName(tag(scope.changed_tests, "changed_test"))


BY_PATH = """
    paths as (select path as p from changes union select old_path from changes where old_path is not null),
    changed as (select id from cur where path in (select p from paths) union select id from cur where patch_path in (select p from paths))"""


@query("d17_select_scope_paths", f"""
    with {BY_PATH}, {SCOPE_SQL.format(changed_test="t.path in (select path from changes)")}
    select 'model' as kind, id from models_in union all select 'test', id from scoped union all select 'changed_test', id from judged where touched""",
       units=UNIT_TESTS, changes=CHANGED_PATHS, cur=CUR)
def _(spark, sf):
    scope = sn.select_scope(bound_tests(UNIT_TESTS, spark, sf), CUR(spark, sf), changes=CHANGED_PATHS(spark, sf))
    return scope_rows(scope)


@query("d17_widened_scope", f"""
    with {BY_PATH}, {SCOPE_SQL.format(changed_test="t.path in (select path from changes)")},
    o as ({won_sql('old_rules')}), n as ({won_sql('new_rules')}),
    wide as (select distinct coalesce(o.id, n.id) as id from o full join n on n.id = o.id and n.key = o.key where o.value is distinct from n.value)
    select 'model' as kind, count(*) as n from (select id from models_in union select id from wide)
    union all select 'test', count(*) from (select id from scoped union select t.id from t where model in (select id from wide))
    union all select 'changed_test', count(*) from judged where touched""",
       units=UNIT_TESTS, changes=CHANGED_PATHS, cur=CUR, entities=ENTITIES, old_rules=OLD_RULES, new_rules=NEW_RULES)
def _(spark, sf):
    e = entities(spark, sf)
    won = lambda d: joins.deepest_prefix(e, rules(d, spark, sf))
    scope = sn.select_scope(bound_tests(UNIT_TESTS, spark, sf), CUR(spark, sf), changes=CHANGED_PATHS(spark, sf))
    wide = scope.widen(sn.setting_impact(won(OLD_RULES), won(NEW_RULES)))
    return scope_rows(wide).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("d9_lifecycle_state", """
    select c.id, c.path, case when max(case when x.status = 'added' then 1 else 0 end) = 1 then 'new' else 'modified' end as state
    from cur c join changes x on x.path = c.path group by 1, 2
    union all select distinct null, path, 'removed' from changes where status = 'deleted' and path not in (select path from cur)""",
       cur=CUR, changes=CHANGED_PATHS)
def _(spark, sf):
    return sn.lifecycle_state(CUR(spark, sf).select("id", "path"), CHANGED_PATHS(spark, sf))


@query("d10_change_axes", f"""
    with {BY_PATH}, {SCOPE_SQL.format(changed_test="t.path in (select path from changes)")}
    select m.id, c.path in (select p from paths) as body, c.patch_path in (select p from paths) as config,
      m.id in (select model from scoped where model is not null) as unit_test from models_in m join cur c on c.id = m.id""",
       cur=CUR, changes=CHANGED_PATHS, units=UNIT_TESTS)
def _(spark, sf):
    models, changes = CUR(spark, sf), CHANGED_PATHS(spark, sf)
    scope = sn.select_scope(bound_tests(UNIT_TESTS, spark, sf), models, changes=changes)
    tested = scope.tests.select(F.col("model").alias("id")).dropna()
    return sn.change_axes(scope.models, joins.changed_by_path(models, changes), joins.changed_by_path(models, changes, "patch_path"), tested)


@query("j19_changed_by_path", f"with {BY_PATH} select id from cur where path in (select p from paths)", cur=CUR, changes=CHANGED_PATHS)
def _(spark, sf):
    return joins.changed_by_path(CUR(spark, sf), CHANGED_PATHS(spark, sf)).select("id")


@query("j18_resolve_targets", """
    select u.id as ref, coalesce(a.id, b.id) as model from units u left join cur a on a.id = u.target_id left join cur b on b.id = u.target_name""",
       units=UNIT_TESTS, cur=CUR)
def _(spark, sf):
    tests = UNIT_TESTS(spark, sf).select(F.col("id").alias("ref"), "target_id", "target_name")
    return joins.resolve_targets(tests, CUR(spark, sf).select("id"))


# ---- key containment, counts, context
KEYED = Derived("""
    select l_orderkey as tab, l_linenumber as key_no, min(case l_returnflag when 'A' then 'Id,Day' when 'N' then 'id,Day,Kind' else 'id' end) as columns_text
    from {lineitem} group by 1, 2""")
CLAIMS = Derived("""
    select l_orderkey as tab, l_partkey as test, min(case l_linestatus when 'O' then 'ID' else 'day,id' end) as columns_text from {lineitem} group by 1, 2""")


@query("j16_subset_containment", """
    select k.tab as "table", k.key_no as key_id, c.test from keyed k join claims c on c.tab = k.tab
    and list_has_all(string_split(lower(k.columns_text), ','), string_split(lower(c.columns_text), ','))""", keyed=KEYED, claims=CLAIMS)
def _(spark, sf):
    keys = KEYED(spark, sf).select(F.col("tab").alias("table"), F.col("key_no").alias("key_id"), F.split("columns_text", ",").alias("columns"))
    tests = CLAIMS(spark, sf).select(F.col("tab").alias("table"), "test", F.split("columns_text", ",").alias("columns"))
    return joins.covers(tests, keys)


@query("a10_test_counts", """
    select p_partkey as "table", (select count(*) from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45) as data_tests,
      (select count(*) from lineitem where l_partkey = p_partkey and l_quantity < 2) as unit_tests from part""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "table")
    return cf.test_counts(table(spark, sf, "part").select(F.col("p_partkey").alias("table")),
                          lines.filter("l_returnflag = 'R' and l_quantity > 45"), lines.filter("l_quantity < 2"))


DOCUMENTED = Derived("select p_partkey as tab, p_type as column_name, 'numeric(' || cast(p_size as string) || ')' as data_type, p_name as description from {part}")
ATTACHED = Derived("""
    select l_partkey as tab, case l_returnflag when 'A' then 'ECONOMY' when 'N' then 'SMALL' else 'LARGE' end as column_name, 'unique' as kind,
           cast(l_orderkey as string) || '.' || cast(l_linenumber as string) || '.' || cast(l_suppkey as string) as test from {lineitem} where l_quantity > 40""")


@query("a13_column_context", """
    select coalesce(d.tab, a.tab) as "table", coalesce(d.column_name, a.column_name) as "column", data_type, description, d.tab is not null as documented,
      a.kind as test_kind, a.test from d full join a on a.tab = d.tab and a.column_name = d.column_name""", d=DOCUMENTED, a=ATTACHED)
def _(spark, sf):
    names = {"tab": "table", "column_name": "column"}
    return cf.column_context(DOCUMENTED(spark, sf).withColumnsRenamed(names), ATTACHED(spark, sf).withColumnsRenamed(names))


@query("a15_direct_consumers", """
    select distinct s_nationkey as seed, l_partkey as consumer from supplier join lineitem on l_suppkey = s_suppkey where s_acctbal > 9000""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    edges = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(
        supplier.filter("s_acctbal > 9000"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("src"), F.col("l_partkey").alias("dst"))
    return cf.direct_consumers(edges, table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")))


@query("a16_macro_index", "select distinct p_name as macro, l_orderkey as id from lineitem join part on l_partkey = p_partkey")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("macro"))
    return cf.macro_index(table(spark, sf, "lineitem").join(part, "l_partkey").select("macro", F.col("l_orderkey").alias("id")))


# ---- catalog documents: one small JSON document per part
def documents(spark, sf):
    # a file of short rows has few splits, and a document takes long to write and parse
    part = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    ident = F.concat(F.lit("model.shop.part_"), "p_partkey")
    column = F.struct(F.lit("price").alias("name"), F.lit("numeric").alias("data_type"), F.array(F.struct(
        F.lit("not_null").alias("type"))).alias("constraints"), F.lit(1).alias("ignored"))
    node = F.struct(
        ident.alias("unique_id"), F.lit("model").alias("resource_type"), F.col("p_name").alias("name"), F.lower("p_brand").alias("package_name"),
        F.struct(F.md5("p_name").alias("checksum")).alias("checksum"), F.struct(F.col("p_type").alias("materialized")).alias("config"),
        F.struct(column.alias("price")).alias("columns"), F.when(F.col("p_size") != 13, F.lit("select 1")).alias("compiled_code"),
        F.struct(F.array(F.concat(F.lit("source.raw."), "p_brand"), F.concat(F.lit("seed.geo."), "p_type")).alias("nodes")).alias("depends_on"))
    unit = F.struct(F.col("p_name").alias("name"), ident.alias("model"), F.array(
        F.struct(F.lit("ref('a')").alias("input"), F.array(F.struct(F.lit(1).alias("x"))).alias("rows")),
        F.struct(F.lit("this").alias("input"), F.lit(None).cast("array<struct<x:int>>").alias("rows"))).alias("given"))
    version = F.when(F.col("p_size") == 50, F.lit("https://schemas/manifest/v11.json")).when(F.col("p_size") < 50, F.lit("https://schemas/manifest/v12.json"))
    doc = F.struct(F.struct(version.alias("dbt_schema_version"), F.lit("shop").alias("project_name")).alias("metadata"),
                   F.create_map(ident, node).alias("nodes"), F.create_map(F.concat(F.lit("unit."), "p_partkey"), unit).alias("unit_tests"))
    return part.select(F.col("p_partkey").alias("doc"), F.to_json(doc).alias("text"))


@query("s3_read_catalog_nodes", f"""
    select p_partkey as doc, 'model.shop.part_' || p_partkey as id, p_name as name, lower(p_brand) as package, md5(p_name) as checksum, p_type as materialized,
      case when p_size <> 13 then 'select 1' end as compiled_code from part""")
def _(spark, sf):
    nodes = cat.explode_catalog(documents(spark, sf), ["doc"]).nodes
    return nodes.select("doc", "id", "name", "package", "checksum", F.col("config")["materialized"].alias("materialized"), "compiled_code")


@query("s3_read_catalog_edges", """
    select p_partkey as doc, 'source.raw.' || p_brand as src, 'model.shop.part_' || p_partkey as dst from part
    union all select p_partkey, 'seed.geo.' || p_type, 'model.shop.part_' || p_partkey from part""")
def _(spark, sf):
    return cat.explode_catalog(documents(spark, sf), ["doc"]).edges


@query("s3_read_catalog_columns", """
    select 'model.shop.part_' || p_partkey as id, 'price' as "column", 'numeric' as type, 'not_null' as kind, 2::bigint as givens from part""")
def _(spark, sf):
    found = cat.explode_catalog(documents(spark, sf), ["doc"])
    givens = found.given.groupBy("doc").agg(F.count(F.lit(1)).alias("givens"))
    return found.columns.join(found.column_constraints, ["doc", "id", "column"]).join(givens, "doc").select("id", "column", "type", "kind", "givens")


@query("s4_catalog_gate", """
    select 'schema' as reason, 'doc ' || p_partkey as item, case when p_size = 50 then '11' end as detail from part where p_size >= 50
    union all select 'uncompiled', 'model.shop.part_' || p_partkey, 'unit.' || p_partkey from part where p_size = 13""")
def _(spark, sf):
    found = cat.explode_catalog(documents(spark, sf), ["doc"])
    low = cat.schema_floor(found.metadata, ["doc"]).select(F.lit("schema").alias("reason"), F.concat(F.lit("doc "), "doc").alias("item"),
                                                           F.col("version").cast("string").alias("detail"))
    tests = found.unit_tests.select("id", F.col("target_name").alias("model"))
    bare = cat.uncompiled(found.nodes.select("id", "compiled_code"), tests)
    return low.unionByName(bare.select(F.lit("uncompiled").alias("reason"), F.col("id").alias("item"), F.col("first_test").alias("detail")))


# ---- the catalog the audits look at, as JSON documents of four parts each
def audited_documents(spark, sf):
    """Tests that are off lie among the nodes for one half of the parts and in the map of disabled entries for the other."""
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entry = lambda name, body: F.concat(text(F.col(name)), F.lit(":"), body)
    kept = {"ignoreNullFields": "true"}
    key = F.when(F.col("key_text") == "", "5").when(F.col("key_text").contains(","), F.to_json(F.split("key_text", ","))).otherwise(text(F.col("key_text")))
    declared = q_audits.constraints(spark, sf).groupBy("table").agg(F.to_json(F.sort_array(F.collect_list(F.struct(
        F.col("kind").alias("type"), "columns")))).alias("constraints"))
    rest = F.to_json(F.struct("materialized", F.col("strategy").alias("incremental_strategy"), "event_time", F.struct(F.col("meta_grain").alias("grain")).alias("meta")), kept)
    config = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.when(F.col("key_declared"), F.concat(F.lit(',"unique_key":'), key)).otherwise(""), F.lit("}"))
    models = q_audits.models(spark, sf).join(declared, "table", "left").select("table", F.lit("nodes").alias("section"), entry("table", F.concat(
        F.lit('{"resource_type":"model","config":'), config, F.lit(',"constraints":'), F.coalesce("constraints", F.lit("[]")), F.lit("}"))).alias("entry"))
    off = ~F.col("enabled") & (F.substring("table", -1, 1).cast("int") % 2 == 1)
    kwargs = F.when(F.col("name") == "unique_combination_of_columns", F.to_json(F.struct(F.col("columns").alias("combination_of_columns")))).otherwise(
        F.to_json(F.struct(F.col("column_text").alias("column_name"))))
    settings = F.to_json(F.struct(F.when(~F.col("enabled") & ~off, F.lit(False)).alias("enabled"), "severity", "where", "limit"), kept)
    generic = F.concat(F.lit('{"resource_type":"test","attached_node":'), text(F.col("table")), F.lit(',"config":'), settings, F.lit(',"test_metadata":{"name":'),
                       text(F.col("name")), F.when(F.col("namespace").isNotNull(), F.concat(F.lit(',"namespace":'), text(F.col("namespace")))).otherwise(""),
                       F.lit(',"kwargs":'), kwargs, F.lit("}}"))
    tests = q_audits.tests(spark, sf).select("table", F.when(off, "disabled").otherwise("nodes").alias("section"), entry(
        "test", F.when(off, F.concat(F.lit("["), generic, F.lit(',"junk",{"resource_type":"model"}]'))).otherwise(generic)).alias("entry"))
    single = q_audits.singular(spark, sf).select("table", F.lit("nodes").alias("section"), entry("test", F.concat(
        F.lit('{"resource_type":"test","depends_on":{"nodes":['), text(F.col("table")), F.lit(']},"config":{"enabled":'), F.col("enabled").cast("string"), F.lit("}}"))).alias("entry"))
    modes = q_audits.UNITS(spark, sf).withColumn("test", F.concat_ws("#", "test", "tab", "incremental")).distinct()  # names are unique in a document
    units = modes.select(F.col("tab").alias("table"), F.lit("unit_tests").alias("section"), entry("test", F.concat(
        F.lit('{"tested_node_unique_id":'), text(F.col("tab")), F.when(F.col("incremental").isNotNull(), F.concat(
            F.lit(',"overrides":{"macros":{"is_incremental":'), F.col("incremental").cast("string"), F.lit("}}"))).otherwise(""), F.lit("}"))).alias("entry"))
    every = models.unionByName(tests).unionByName(single).unionByName(units)
    number = F.regexp_extract("table", "([0-9]+)$", 1).cast("long")
    every = every.groupBy(F.floor(number / 4).alias("doc"), "section").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ","), F.lit("}")).alias("map"))
    whole = every.groupBy("doc").agg(F.concat(F.lit('{"odd":[],"metadata":{"dbt_schema_version":"v12"},'), F.array_join(F.collect_list(
        F.concat(F.lit('"'), "section", F.lit('":'), "map")), ","), F.lit("}")).alias("text"))
    return whole


@query("s3_catalog_to_findings", f"""
    with {q_audits.UNIQUE_KEY}, {q_audits.BRANCHES},
    d as (select distinct tab, kind, array_to_string(list_sort(string_split(lower(column_text), ',')), ',') as cols from constraints_ where kind in ('primary_key', 'unique')),
    declared as (select 'constraint' as check_, d.tab, 'constraint.' || kind || '[' || cols || ']' as construct,
      case when exists (select 1 from tests t where t.tab = d.tab and t.enabled and t.name in ('unique', 'unique_combination_of_columns')
        and list_has_all(string_split(d.cols, ','), string_split(lower(t.column_text), ','))) then 'covered' else 'uncovered' end as verdict, 'high' as tier from d)
    select check_ as "check", tab as "table", construct, verdict, tier from (from keyed union all from branches union all from declared)""",
       constraints_=q_audits.CONSTRAINTS, **q_audits.CATALOG)
def _(spark, sf):
    found = cat.explode_catalog(audited_documents(spark, sf), ["doc"])
    out = audits.audit_catalog(found.audit_models, found.audit_tests, found.singular_tests, found.unit_modes, found.declared_constraints, "snowflake")
    return out.drop("evidence")


@query("s3_disabled_tests", """
    select t.tab as "table", t.test, t.column_text as columns from tests t join models m on m.tab = t.tab and m.key_text <> ''
    where not t.enabled and t.name in ('unique', 'unique_combination_of_columns')
      and list_has_all(string_split(lower(m.key_text), ','), string_split(lower(t.column_text), ','))""", **q_audits.CATALOG)
def _(spark, sf):
    found = cat.explode_catalog(audited_documents(spark, sf), ["doc"])
    return audits.disabled_backing(found.audit_models, found.audit_tests).withColumn("columns", F.array_join("columns", ","))


@query("s3_disabled_entries", """
    select case when k = 1 then t.test end as test, case when k = 1 then t.tab end as "table", case when k = 1 then 'test' else 'model' end as kind
    from tests t, range(1, 3) r(k) where not t.enabled and cast(right(t.tab, 1) as int) % 2 = 1""", **q_audits.CATALOG)
def _(spark, sf):
    off = cat.explode_catalog(audited_documents(spark, sf), ["doc"]).disabled
    return off.select(F.when(F.col("kind") == "test", F.col("id")).alias("test"), "table", "kind")


@query("s3_catalog_grain", """
    with c as (select tab, 1 as strength, 'authored' as kind, meta_grain as columns from models where trim(meta_grain) <> ''
      union all select tab, case when name = 'primary_key' then 2 when column_text like '%,%' then 3 else 4 end,
        case when name = 'primary_key' then 'primary_key' when column_text like '%,%' then 'compound_unique' else 'unique' end, replace(column_text, ',', ', ') from tests
      where enabled and (name = 'unique' and namespace is null or name = 'unique_combination_of_columns' or name = 'primary_key' and namespace = 'dbt_constraints')),
    best as (select tab, arg_min(kind, strength) as kind, arg_min(columns, strength) as columns, count(*) as signals from c group by 1)
    select m.tab as "table", coalesce(b.kind, 'unknown') as kind, b.columns, coalesce(signals, 0) as signals from models m left join best b on b.tab = m.tab""", **q_audits.CATALOG)
def _(spark, sf):
    found = cat.explode_catalog(audited_documents(spark, sf), ["doc"])
    return audits.detect_grain(found.audit_models, found.audit_tests).drop("origin")


# ---- two snapshots of one model per part
def snapshot_documents(spark, sf):
    part = table(spark, sf, "part")
    ident = F.concat(F.lit("model.shop.part_"), "p_partkey")

    def version(label, changed):
        pick = lambda now, was: F.when(changed, now).otherwise(was)
        typed = F.struct(F.struct(F.when(F.col("p_size") % 6 == 0, pick(F.lit("bigint"), F.lit("int"))).otherwise(F.lit("text")).alias("data_type")).alias("id"))
        node = F.struct(
            F.lit("model").alias("resource_type"), F.struct(F.when(F.col("p_size") % 5 == 0, pick(F.md5("p_type"), F.md5("p_name"))).otherwise(F.md5("p_name")).alias("checksum")).alias("checksum"),
            F.struct(F.when(F.col("p_size") % 7 == 0, pick(F.lit("view"), F.lit("table"))).otherwise(F.lit("table")).alias("materialized"),
                     F.struct((F.col("p_size") > 25).alias("enforced")).alias("contract")).alias("config"),
            F.concat(F.lit("db."), F.when(F.col("p_size") % 11 == 0, pick(F.lit("b"), F.lit("a"))).otherwise(F.lit("a"))).alias("relation_name"),
            F.struct(F.when(F.col("p_size") % 13 == 0, pick(F.array(F.lit("m"), F.lit("n")), F.array(F.lit("n"), F.lit("m"), F.lit("n")))).otherwise(F.array(F.lit("m"))).alias("macros")).alias("depends_on"),
            typed.alias("columns"))
        doc = F.struct(F.create_map(ident, node).alias("nodes"))
        return part.select(F.lit(label).alias("version"), F.col("p_partkey").alias("doc"), F.to_json(doc).alias("text"))
    return version("base", F.lit(False)).filter("doc % 10 <> 3").unionByName(version("now", F.lit(True)))


SNAPSHOT = f"select {MODEL.replace('string', 'varchar')} as id, p_partkey % 10 = 3 as fresh, p_size from part"


@query("s3_catalog_snapshot_diff", f"""
    with s as ({SNAPSHOT}), f as (select id, fresh as is_new, fresh or p_size % 5 = 0 as body, fresh or p_size % 7 = 0 as configs, fresh or p_size % 11 = 0 as relation,
      fresh as macros, fresh or p_size % 6 = 0 as contract from s)
    select *, body or configs or contract as modified from f""")
def _(spark, sf):
    both = cat.explode_catalog(snapshot_documents(spark, sf), ["version", "doc"])
    return sn.diff_snapshots(both.where("version = 'now'").snapshot_nodes, both.where("version = 'base'").snapshot_nodes, ("configs", "contract"))


@query("s3_catalog_contract_diff", f"""
    with s as ({SNAPSHOT}) select id, case when p_size > 25 and p_size % 5 = 0 and p_size % 6 = 0 then 'breaking' else 'unchanged' end as change from s where not fresh""")
def _(spark, sf):
    both = cat.explode_catalog(snapshot_documents(spark, sf), ["version", "doc"])
    old, new = both.where("version = 'base'"), both.where("version = 'now'")
    return ct.classify_contract(old.snapshot_nodes, new.snapshot_nodes, old.contract_columns, new.contract_columns,
                                old.contract_constraints, new.contract_constraints).select("id", "change")
