"""Closures and lineage: row-level references between the given tables, and a model graph over the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as cl, graph as g
from ..session import cut
from .base import Derived, query, table

# who refers to whom, row by row: region > nation > customer > order > line, and supplier and part > line
REFERENCES = Derived("""
    select 'region:' || cast(n_regionkey as string) as src, 'nation:' || cast(n_nationkey as string) as dst from {nation}
    union all select 'nation:' || cast(c_nationkey as string), 'customer:' || cast(c_custkey as string) from {customer}
    union all select 'nation:' || cast(s_nationkey as string), 'supplier:' || cast(s_suppkey as string) from {supplier}
    union all select 'customer:' || cast(o_custkey as string), 'order:' || cast(o_orderkey as string) from {orders}
    union all select 'order:' || cast(l_orderkey as string), 'line:' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) from {lineitem}
    union all select 'supplier:' || cast(l_suppkey as string), 'line:' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) from {lineitem}
    union all select 'part:' || cast(l_partkey as string), 'line:' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) from {lineitem}""")
# every part builds on the parts at half and a third of its key
MODEL_REFS = Derived("""
    select distinct up as src, p_partkey as dst from (
      select p_partkey, cast(floor(p_partkey / 2) as bigint) as up from {part} union all
      select p_partkey, cast(floor(p_partkey / 3) as bigint) from {part}) where up <> p_partkey""")
CHANGED = Derived("select p_partkey as node from {part} where p_size = 7")
REF = dict(edges=REFERENCES)
MODEL = dict(edges=MODEL_REFS, seeds=CHANGED)


@query("g1_lineage_edges", """
    select distinct e.src, e.dst from edges e where e.src <> e.dst and split_part(e.src, ':', 1) in ('nation', 'customer', 'supplier', 'order')
      and split_part(e.dst, ':', 1) in ('nation', 'customer', 'supplier', 'order')""", **REF)
def _(spark, sf):
    edges = REFERENCES(spark, sf)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.substring_index("id", ":", 1))
    depends = edges.select(F.col("dst").alias("id"), F.col("src").alias("upstream"))
    return g.lineage_edges(nodes, depends, ["nation", "customer", "supplier", "order"])


@query("g2_invert", "select src as producer, count(distinct dst) as consumers from edges group by 1", **REF)
def _(spark, sf):
    flipped = g.invert(g.clean_edges(REFERENCES(spark, sf)))
    return flipped.groupBy(F.col("dst").alias("producer")).agg(F.count(F.lit(1)).alias("consumers"))


@query("g3_closure_down", """
    with recursive walk as (select 'region:2' as node, 0 as depth union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node)
    select node, min(depth) as depth from walk group by node""", **REF)
def _(spark, sf):
    seeds = table(spark, sf, "region").filter("r_regionkey = 2").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))
    return g.closure(REFERENCES(spark, sf), seeds)


@query("g3_closure_up", """
    with recursive walk as (select 'line:' || l_orderkey || '-' || l_linenumber as node from lineitem where l_quantity > 49 and l_discount > 0.09
      union select e.src from walk w join edges e on e.dst = w.node) select node from walk""", **REF)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.09")
    seeds = lines.select(F.concat(F.lit("line:"), "l_orderkey", F.lit("-"), "l_linenumber").alias("node"))
    return g.closure(REFERENCES(spark, sf), seeds, "up").select("node")


@query("g3_closure_two_steps", """
    with a as (select dst as node, 1 as depth from edges where src = 'nation:3'), b as (select e.dst as node, 2 as depth from a join edges e on e.src = a.node)
    select node, min(depth) as depth from (select 'nation:3' as node, 0 as depth union all select * from a union all select * from b) group by 1""", **REF)
def _(spark, sf):
    seeds = table(spark, sf, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return g.closure(REFERENCES(spark, sf), seeds, max_depth=2)


@query("g4_blast_radius", """
    with recursive walk as (select 'nation:' || n_nationkey as node, n_nationkey as origin from nation
      union select e.dst, w.origin from walk w join edges e on e.src = w.node)
    select node, count(distinct origin) as changed_models from walk where node like 'line:%' group by 1""", **REF)
def _(spark, sf):
    edges = REFERENCES(spark, sf)
    sinks = edges.filter("dst like 'line:%'").select(F.col("dst").alias("node")).distinct()
    changed = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return g.reach_counts(edges, sinks, changed)


@query("g4_exposures_reached", """
    with recursive walk as (select 'supplier:' || s_suppkey as node from supplier where s_acctbal > 9000
      union select e.dst from walk w join edges e on e.src = w.node) select node from walk where node like 'line:%'""", **REF)
def _(spark, sf):
    edges = REFERENCES(spark, sf)
    sinks = edges.filter("dst like 'line:%'").select(F.col("dst").alias("node")).distinct()
    changed = table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node"))
    return g.exposures_reached(edges, sinks, changed)


# macros call the macros at half their number; orders use the macro of their customer
MACRO_EDGES = Derived("select p_partkey as src, cast(floor(p_partkey / 2) as bigint) as dst from {part} where p_partkey > 0")
MACRO_USERS = Derived("""
    select o_orderkey as id, o_custkey as macro, case o_orderstatus when 'F' then 'test' else 'model' end as kind,
           case o_orderpriority when '1-URGENT' then 'vendor' when '2-HIGH' then null else 'shop' end as package from {orders}""")
CHANGED_MACROS = Derived("select p_partkey as macro from {part} where p_size between 12 and 14")
MACRO = dict(calls=MACRO_EDGES, users=MACRO_USERS, changed=CHANGED_MACROS)
MACRO_SQL = """
    with recursive walk as (select macro as node, macro as changed from changed union select c.src, w.changed from walk w join calls c on c.dst = w.node),
    hit as (select distinct w.changed as macro, u.id from walk w join users u on u.macro = w.node where kind = '{kind}' and coalesce(package, 'shop') = 'shop')"""


def macro_hits(spark, sf, kind):
    users = MACRO_USERS(spark, sf)
    return g.macro_consumers(MACRO_EDGES(spark, sf), users, users.select("id", "macro"), CHANGED_MACROS(spark, sf), "shop", [kind])


@query("g5_macro_blast_radius", MACRO_SQL.format(kind="model") + " select * from hit", **MACRO)
def _(spark, sf):
    return macro_hits(spark, sf, "model")


@query("g5_macro_test_consumers", MACRO_SQL.format(kind="test") + " select macro, count(*) as tests from hit group by 1", **MACRO)
def _(spark, sf):
    return macro_hits(spark, sf, "test").groupBy("macro").agg(F.count(F.lit(1)).alias("tests"))


@query("g6_focus_set", """
    with recursive users as (select distinct l_partkey as id from lineitem where l_quantity > 49 and l_returnflag = 'R'),
    walk as (select id from users union select e.dst from walk w join edges e on e.src = w.id)
    select id, case when id in (select id from users) then 'user' else 'downstream' end as role from walk""", edges=MODEL_REFS)
def _(spark, sf):
    users = table(spark, sf, "lineitem").filter("l_quantity > 49 and l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return g.focus_set(MODEL_REFS(spark, sf), users)


REACH = """
    with recursive down as (select node, node as seed from seeds union select e.dst, d.seed from down d join edges e on e.src = d.node),
    up as (select node, node as seed from seeds union select e.src, u.seed from up u join edges e on e.dst = u.node)"""
ROLES = f"""{REACH},
    connectors as (select distinct d.node from down d join up u on u.node = d.node and u.seed <> d.seed where d.node not in (select node from seeds)),
    lone as (select node from seeds where node not in (select node from down where node <> seed) and node not in (select node from up where node <> seed)
             and node not in (select seed from down where node <> seed and node in (select node from seeds))),
    halo as (select dst as node, src, dst from edges where src in (select node from lone) union all
             select src, src, dst from edges where dst in (select node from lone)),
    rim as (select * from halo where node not in (select node from seeds) and node not in (select node from connectors))"""


@query("g7_multi_source_reach", f"{REACH} select node, seed from down", **MODEL)
def _(spark, sf):
    return g.multi_source_reach(MODEL_REFS(spark, sf), CHANGED(spark, sf))


@query("g8_connectors", f"{ROLES} select node from connectors", **MODEL)
def _(spark, sf):
    return g.ChangeGraph(MODEL_REFS(spark, sf), CHANGED(spark, sf)).connectors()


@query("g9_halo", f"{ROLES} select node, src, dst from rim", **MODEL)
def _(spark, sf):
    return g.ChangeGraph(MODEL_REFS(spark, sf), CHANGED(spark, sf)).halo()


@query("g10_change_subgraph_nodes", f"""{ROLES}
    select node, 'changed' as role, case when node in (select p_partkey from part where p_type = 'PROMO') then 'new' else 'modified' end as state from seeds
    union all select node, 'connector', null from connectors union all select distinct node, 'halo', null from rim
    union all select p_partkey, 'removed', 'deleted' from part where p_size = 49""", **MODEL)
def _(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "node")
    graph = g.ChangeGraph(MODEL_REFS(spark, sf), CHANGED(spark, sf))
    return graph.nodes(new=part.filter("p_type = 'PROMO'"), removed=part.filter("p_size = 49"))


@query("g10_change_subgraph_edges", f"""{ROLES}, core as (select node from seeds union select node from connectors)
    select src, dst from edges where src in (select node from core) and dst in (select node from core) union select src, dst from rim""", **MODEL)
def _(spark, sf):
    return g.ChangeGraph(MODEL_REFS(spark, sf), CHANGED(spark, sf)).induced()


# ---- columns
OWNERS = Derived("""
    select 'db.' || case when p_size = 50 then 'shared' else cast(p_partkey as string) end as relation,
           case when p_size < 40 then 'Part_' || cast(p_partkey as string) else replace(p_name, ' ', '_') end as identifier, p_partkey as node from {part}
    union all select 'raw.' || cast(s_suppkey as string), 'raw_' || cast(s_suppkey as string), 1000000000 + s_suppkey from {supplier}""")
COLUMN_EDGES = Derived("""
    select src, dst from {refs} union all
    select 1000000000 + min(l_suppkey), l_partkey from {lineitem} group by l_partkey union all
    select 1000000000 + max(l_suppkey), l_partkey from {lineitem} join {part} on l_partkey = p_partkey where p_size < 5
      group by l_partkey having max(l_suppkey) <> min(l_suppkey)""", refs=MODEL_REFS)
LEAVES = Derived("select e.dst as id, upper(o.identifier) as leaf from {e} e join {o} o on o.node = e.src", e=COLUMN_EDGES, o=OWNERS)
OUTPUTS = Derived("""
    select p_partkey as node, 'id' as col from {part} union all select p_partkey, 'price' from {part} where p_size > 2
    union all select p_partkey, 'discount' from {part} where p_type = 'PROMO' union all select p_partkey, 'size' from {part} where p_size < 25""")
PASS = Derived("""
    select p_partkey as node, 'price' as col, 's_price' as source_column from {part}
    union all select p_partkey, 'discount', 's_discount' from {part} where p_brand > 'Brand#15'""")
SOURCES = Derived("select 1000000000 + s_suppkey as node from {supplier}")
LINEAGE = dict(owners=OWNERS, edges=COLUMN_EDGES, leaves=LEAVES, outputs=OUTPUTS, pass_=PASS, sources=SOURCES)
BOUND = """
    rel as (select relation, lower(identifier) as ident, count(distinct node) as n, min(node) as node from owners group by 1, 2),
    ident as (select ident, count(*) as n_rel, min(case when n = 1 then node end) as node from rel group by 1),
    want as (select distinct id, lower(leaf) as leaf from leaves),
    fallback as (select w.id, w.leaf, min(r.node) as node from want w join edges e on e.dst = w.id join rel r on r.n = 1 and r.node = e.src and r.ident = w.leaf
      group by 1, 2 having count(distinct r.node) = 1),
    bound as (select w.id, w.leaf, coalesce(case when i.n_rel = 1 and exists (select 1 from edges e where e.src = i.node and e.dst = w.id) then i.node end, f.node) as upstream
      from want w left join ident i on i.ident = w.leaf left join fallback f on f.id = w.id and f.leaf = w.leaf)"""
STITCHED = f"""{BOUND},
    link as (select distinct id, upstream from bound where upstream is not null),
    direct as (select distinct l.upstream, o.col as upstream_column, l.id as downstream, o.col as downstream_column from link l
      join outputs o on o.node = l.upstream join outputs d on d.node = l.id and d.col = o.col),
    single as (select id, min(upstream) as upstream from link where upstream in (select node from sources) group by 1 having count(*) = 1),
    carried as (select s.upstream, p.source_column as upstream_column, s.id as downstream, d.col as downstream_column from single s
      join outputs d on d.node = s.id join pass_ p on p.node = d.node and p.col = d.col
      where not exists (select 1 from direct x where x.downstream = d.node and x.downstream_column = d.col)),
    stitched as (select * from direct union select * from carried)"""


def bound(spark, sf):
    return cl.bind_names(LEAVES(spark, sf), OWNERS(spark, sf), COLUMN_EDGES(spark, sf))


def stitched(spark, sf):
    named = lambda d: d(spark, sf).withColumnRenamed("col", "column")
    return cl.stitch_columns(named(OUTPUTS), bound(spark, sf), SOURCES(spark, sf), named(PASS))


@query("j17_bind_names", f"with {BOUND} select id, leaf, upstream from bound", **LINEAGE)
def _(spark, sf):
    return bound(spark, sf)


@query("g11_stitch_columns", f"with {STITCHED} select * from stitched", **LINEAGE)
def _(spark, sf):
    return stitched(spark, sf)


@query("g12_trace_to_source", f"""
    with recursive {STITCHED},
    back as (select downstream as node, downstream_column as col, count(*) as ways, min(upstream) as up, min(upstream_column) as up_col from stitched group by 1, 2),
    thin as (select distinct dst as node from edges where dst not in (select downstream from stitched)),
    walk as (select node as start_node, col as start_column, node, col, 1 as n from outputs
      union all select w.start_node, w.start_column, b.up, b.up_col, w.n + 1 from walk w join back b on b.node = w.node and b.col = w.col
        where b.ways = 1 and w.node not in (select node from sources)),
    last as (select start_node, start_column, max(n) as n from walk group by 1, 2)
    select w.start_node, w.start_column, w.node as end_node, w.col as end_column, cast(w.n as int) as n_hops,
      case when w.node in (select node from sources) then 'source' when b.ways is null then case when w.node in (select node from thin) then 'opaque' else 'root' end
           else 'opaque' end as termination
    from last l join walk w using (start_node, start_column, n) left join back b on b.node = w.node and b.col = w.col""", **LINEAGE)
def _(spark, sf):
    edges, outputs = cut(stitched(spark, sf)), OUTPUTS(spark, sf).withColumnRenamed("col", "column")
    none = SOURCES(spark, sf).filter("false")
    thin = cl.thin_nodes(outputs, COLUMN_EDGES(spark, sf), edges, none)
    out = cl.trace_to_source(edges, outputs, SOURCES(spark, sf), thin)
    return out.select("start_node", "start_column", "end_node", "end_column", "termination", F.size("hops").alias("n_hops"))


@query("g13_column_blast_radius", f"""
    with recursive {STITCHED}, starts as (select distinct upstream as node, upstream_column as col from stitched where upstream_column = 'discount'),
    walk as (select node as start_node, col as start_column, node, col from starts
      union select w.start_node, w.start_column, s.downstream, s.downstream_column from walk w join stitched s on s.upstream = w.node and s.upstream_column = w.col)
    select * exclude (col), col as "column" from walk where not (node = start_node and col = start_column)""", **LINEAGE)
def _(spark, sf):
    edges = cut(stitched(spark, sf))
    starts = edges.filter("upstream_column = 'discount'").select(F.col("upstream").alias("node"), F.col("upstream_column").alias("column")).distinct()
    out = cl.column_blast_radius(edges, starts)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start_node", "node")})


@query("g14_is_acyclic", """
    with cyc as (select count(distinct (src, dst)) as n from edges where src not like 'part:%'),
    back as (select count(*) as n from nation)
    select 'references' as graph, true as acyclic, 0::bigint as core_edges union all select 'with_back_edges', false, cyc.n + back.n from cyc, back""", **REF)
def _(spark, sf):
    edges = REFERENCES(spark, sf)
    looped = edges.unionByName(g.invert(edges.filter("src like 'region:%'")))
    row = lambda name, e: g.acyclic_core(e).agg(F.lit(name).alias("graph"), (F.count(F.lit(1)) == 0).alias("acyclic"), F.count(F.lit(1)).alias("core_edges"))
    return row("references", edges).unionByName(row("with_back_edges", looped))


# parts in one long chain; the last of them may point back at one in the middle
CHAIN = Derived("select p_partkey as src, p_partkey + 1 as dst from {part}")


@query("g14_long_chain", """
    with recursive e as (select src, dst from chain union all select max(dst), max(dst) - 100 from chain),
    walk as (select max(dst) - 100 as node from chain union select e.dst from walk join e on e.src = walk.node)
    select 'chain' as graph, not exists (select 1 from chain a join chain b on b.dst <= a.src and b.src >= a.dst) as acyclic
    union all select 'back', not exists (select 1 from walk where node = (select max(dst) from chain))""", chain=CHAIN)
def _(spark, sf):
    chain = CHAIN(spark, sf)
    back = chain.unionByName(chain.agg(F.max("dst").alias("src"), (F.max("dst") - 100).alias("dst")))
    row = lambda name, e: g.is_acyclic(e).select(F.lit(name).alias("graph"), "acyclic")
    return row("chain", chain).unionByName(row("back", back))
