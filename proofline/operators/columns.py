"""Column lineage between tables: binding names to owners, stitching, tracing back, blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .graph import closure
from .numbering import same


def bind_names(refs: DataFrame, owners: DataFrame, edges: DataFrame) -> DataFrame:
    """Bind each (id, leaf) to one producer: the only owner of the name if it feeds the node, else the one producer
    of that name that does; otherwise NULL.

    owners (relation, identifier, node); edges (src, dst). A relation claimed by two nodes belongs to nobody.
    """
    sole = owners.select("relation", F.lower("identifier").alias("identifier"), "node").distinct().groupBy(
        "relation", "identifier").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    per_name = sole.groupBy("identifier").agg(F.count(F.lit(1)).alias("n_rel"), F.min(
        F.when(F.col("n") == 1, F.col("node"))).alias("node")).filter("n_rel = 1").select(
        F.col("identifier").alias("_i"), F.col("node").alias("_only"))
    wanted = refs.select("id", F.lower("leaf").alias("leaf")).distinct()
    feeds = edges.select(F.col("src").alias("_p"), F.col("dst").alias("_c")).distinct()
    direct = wanted.join(per_name, F.col("leaf") == F.col("_i")).join(
        feeds, (F.col("_only") == F.col("_p")) & (F.col("id") == F.col("_c"))).select(
        "id", "leaf", F.col("_only").alias("direct"))
    named = feeds.join(sole.filter("n = 1").select("identifier", "node"), F.col("_p") == F.col("node")).select(
        F.col("_c").alias("id"), F.col("identifier").alias("leaf"), "node")
    fallback = named.join(wanted, ["id", "leaf"], "left_semi").groupBy("id", "leaf").agg(
        F.count_distinct("node").alias("n"), F.min("node").alias("fallback")).filter("n = 1").drop("n")
    return wanted.join(direct, ["id", "leaf"], "left").join(fallback, ["id", "leaf"], "left").select(
        "id", "leaf", F.coalesce("direct", "fallback").alias("upstream"))


def stitch_columns(outputs: DataFrame, bound: DataFrame, sources: DataFrame, passthrough: DataFrame) -> DataFrame:
    """Column edges between tables.

    outputs (node, column); bound (id, upstream) from :func:`bind_names`; sources (node) with no column list;
    passthrough (node, column, source_column). A known upstream column flows to a node that exposes it; a source
    carries by proven name only, and only where it is the node's one source.
    """
    links = cut(bound.filter("upstream IS NOT NULL").select("id", "upstream").distinct())
    up = outputs.select(F.col("node").alias("upstream"), "column")
    down = outputs.select(F.col("node").alias("id"), "column")
    named = links.join(up, "upstream").join(down, ["id", "column"], "left_semi")
    direct = named.select("upstream", F.col("column").alias("upstream_column"), F.col("id").alias("downstream"),
                          F.col("column").alias("downstream_column"))
    opaque = sources.select(F.col("node").alias("upstream")).distinct().join(
        outputs.select(F.col("node").alias("upstream")).distinct(), "upstream", "left_anti")
    single = links.join(opaque, "upstream", "left_semi").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("upstream").alias("upstream")).filter("n = 1").drop("n")
    covered = direct.select(F.col("downstream").alias("id"), F.col("downstream_column").alias("column")).distinct()
    carried = down.join(passthrough.select(F.col("node").alias("id"), "column", "source_column"), ["id", "column"]).join(
        covered, ["id", "column"], "left_anti").join(single, "id")
    return direct.unionByName(carried.select(
        "upstream", F.col("source_column").alias("upstream_column"), F.col("id").alias("downstream"),
        F.col("column").alias("downstream_column"))).distinct()


def _pair(node: str, column: str):
    return F.concat_ws("\u0001", F.col(node), F.col(column))


def column_blast_radius(col_edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, column) for every column downstream of each start (node, column)."""
    edges = col_edges.select(_pair("upstream", "upstream_column").alias("src"),
                             _pair("downstream", "downstream_column").alias("dst"))
    seeds = starts.select(_pair("node", "column").alias("node")).select("node", F.col("node").alias("start"))
    reach = closure(edges, seeds, carry=["start"]).filter("depth > 0")
    part = lambda c, i: F.substring_index(F.col(c), "\u0001", i)
    return reach.select(part("start", 1).alias("start_node"), part("start", -1).alias("start_column"),
                        part("node", 1).alias("node"), part("node", -1).alias("column"))


def trace_to_source(col_edges: DataFrame, starts: DataFrame, origins: DataFrame, thin: DataFrame) -> DataFrame:
    """Walk every start (node, column) back to where it comes from.

    origins (node): sources and seeds. thin (node): nodes whose own outputs are unknown, or that have producers but
    no column edge. Ends as ``source``, ``root`` or ``opaque``; two ways back are opaque, a loop is a root.

    What becomes of a column is looked up once, for all columns a walk may meet. A column that leads on then takes over, round by round, the
    way of the one its own has come to, so that a way of n hops takes about log2(n) rounds.
    """
    back = cut(col_edges.groupBy(F.col("downstream").alias("node"), F.col("downstream_column").alias("column")).agg(
        F.count(F.lit(1)).alias("ways"), F.min(F.struct("upstream", "upstream_column")).alias("up")))
    wanted = cut(starts.select("node", F.lower("column").alias("column")).distinct())
    ends = origins.select("node").distinct().withColumn("_origin", F.lit(True))
    thin = thin.select("node").distinct().withColumn("_thin", F.lit(True))
    met = wanted.unionByName(back.filter("ways = 1").select(F.col("up.upstream").alias("node"), F.col("up.upstream_column").alias("column"))).distinct()
    known = met.join(ends, "node", "left").join(thin, "node", "left").join(back, ["node", "column"], "left")
    end = (F.when(F.col("_origin"), "source")
           .when(F.col("ways").isNull(), F.when(F.col("_thin"), "opaque").otherwise("root"))
           .when(F.col("ways") > 1, "opaque"))
    own = F.struct("node", "column")
    ahead = F.struct(F.col("up.upstream").alias("node"), F.col("up.upstream_column").alias("column"))
    told = cut(known.select("node", "column", F.array(own).alias("path"), F.when(end.isNull(), ahead).alias("to"), end.alias("termination")))
    done, going = [told.filter("termination IS NOT NULL")], told.filter("termination IS NULL")
    while not going.isEmpty():
        # what is met may have ended in any round before, or lead on itself
        other = going
        for part in done:
            other = other.unionByName(part)
        other = other.select(F.col("node").alias("_n"), F.col("column").alias("_c"), F.col("path").alias("_path"), F.col("to").alias("_to"), F.col("termination").alias("_end"))
        both = going.join(other, same(F.col("to.node"), F.col("_n")) & same(F.col("to.column"), F.col("_c")))
        path = F.concat("path", "_path")
        joined = both.select("node", "column", path.alias("path"), F.array_distinct(path).alias("_once"), "_to", "_end")
        loops = F.size("_once") < F.size("path")  # the ways from a column are one, so what comes twice is the loop itself
        told = cut(joined.select("node", "column", F.col("_once").alias("path"), F.when(~loops, F.col("_to")).alias("to"),
                                 F.when(loops, "root").otherwise(F.col("_end")).alias("termination")))
        done.append(told.filter("termination IS NOT NULL"))
        going = told.filter("termination IS NULL")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    ways = out.select(F.col("node").alias("_n"), F.col("column").alias("_c"), "path", "termination")
    last = F.element_at("path", -1)
    return wanted.join(ways, same(F.col("node"), F.col("_n")) & same(F.col("column"), F.col("_c"))).select(
        F.col("node").alias("start_node"), F.col("column").alias("start_column"), last["node"].alias("end_node"), last["column"].alias("end_column"),
        "termination", F.transform("path", lambda p: F.concat_ws(".", p["node"], p["column"])).alias("hops"))


def thin_nodes(outputs: DataFrame, depends: DataFrame, col_edges: DataFrame, unknown: DataFrame) -> DataFrame:
    """Nodes whose lineage is thin: outputs unknown, or producers without a single inbound column edge."""
    fed = col_edges.select(F.col("downstream").alias("node")).distinct()
    hollow = depends.select(F.col("dst").alias("node")).distinct().join(fed, "node", "left_anti")
    return hollow.unionByName(unknown.select("node")).distinct()
