"""Closures and change graphs over edge tables (src, dst), all sources at once, one join per round."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from ..session import bucketed, cut
from .numbering import all_of, same

COMPACT_EVERY = 8
STRIDE = 2  # steps of a label between two looks at those already known


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edges without self loops, and only between members where a node table is given."""
    out = edges.select("src", "dst").filter("src <> dst").distinct()
    if nodes is not None:
        for end in ("src", "dst"):
            out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out


def lineage_edges(nodes: DataFrame, depends: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Producer to consumer edges between members of the given kinds; depends has (id, upstream)."""
    members = nodes.filter(F.col("kind").isin(*kinds)).select("id").distinct()
    return clean_edges(depends.select(F.col("upstream").alias("src"), F.col("id").alias("dst")), members).select(
        "src", "dst")


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    return edges.select("src", "dst") if direction == "down" else invert(edges)


HUB = 100_000  # edges of one node that are kept together
BUCKET = 250_000  # rows that make a bucket worth a task of its own
SLOTS = 1 << 16
LIGHT = 1_000_000  # rows that may be hashed in memory
SLIM = 1_000_000  # rows of a round that are broadcast to the edges at most; in a graph of fewer than 100 times as many, a hundredth of its edges,
FEW = 10_000  # or so many


def _buckets(df: DataFrame, rows: int) -> int:
    """Buckets for so many rows: no more than there are shuffle partitions, and few for a small graph, whose rounds would else open
    a file per bucket, layer and round."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(8, -(-rows // BUCKET)))


class Steps:
    """Edges in one direction, written once. Few nodes are sent to them where they lie (``near``); for many they are written a second time,
    in buckets of src, so that no round of a walk exchanges them again (``follow``).

    A node with more than ``hub`` edges has them dealt into several parts. Every edge then knows the parts of the node it leads to, so
    whoever arrives there knows how many buckets to ask.
    """

    def __init__(self, edges: DataFrame, direction: str = "down", hub: int | None = None):
        self.hub = hub or HUB
        self.plain = cut(_directed(edges, direction), "edges")
        rows = self.plain.count()
        self.buckets, self.slim = _buckets(self.plain, rows), min(SLIM, max(FEW, rows // 100))

    @cached_property
    def hubs(self) -> DataFrame | None:
        # hubs are counted among the rows of slots that hold enough for one, so that the other nodes are not grouped by name
        slot = F.pmod(F.xxhash64("src"), F.lit(SLOTS)).cast("int")
        slots = cut(self.plain.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")), "slots")
        full = slots.filter(F.col("_n") > self.hub).select("_slot")
        few = self.plain.withColumn("_slot", slot).join(F.broadcast(full), "_slot", "left_semi")
        hubs = cut(few.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > self.hub).select(
            F.col("src").alias("_hub"), F.ceil(F.col("_n") / self.hub).cast("int").alias("_parts")), "hubs")
        return None if hubs.isEmpty() else hubs

    @cached_property
    def table(self) -> DataFrame:
        """The edges in buckets of src, and of (src, _part) where there are hubs. A constant part is no key: Spark would take it out of the
        grouping, exchange the rows once more, by (src, dst), and every task would then write a file into every bucket."""
        plain, keys = self.plain, ["src"]
        if self.hubs:
            keys = ["src", "_part"]
            plain = plain.join(self.hubs, F.col("src") == F.col("_hub"), "left").withColumn("_own", F.coalesce("_parts", F.lit(1))).drop("_hub", "_parts")
            plain = plain.join(self.hubs, F.col("dst") == F.col("_hub"), "left").select(
                "src", "dst", F.pmod(F.xxhash64("dst"), F.col("_own")).cast("int").alias("_part"), F.coalesce("_parts", F.lit(1)).alias("_ahead"))
        return bucketed(plain.repartition(self.buckets, *keys).distinct(), *keys, n=self.buckets, sort=False)

    def start(self, nodes: DataFrame) -> DataFrame:
        """Nodes with the number of parts their edges lie in, ``_ahead``."""
        if not self.hubs:
            return nodes.withColumn("_ahead", F.lit(1))
        return nodes.join(self.hubs, F.col("node") == F.col("_hub"), "left").withColumn("_ahead", F.coalesce("_parts", F.lit(1))).drop("_hub", "_parts")

    def follow(self, nodes: DataFrame, *carry: str, light: bool = False) -> DataFrame:
        """The nodes one edge away from ``nodes`` (with ``_ahead``), as ``node`` and ``_ahead``, with the columns to carry.

        Nodes that are light, few to a bucket, are hashed, and the edges stream by unsorted.
        """
        asked, here, ahead = nodes.withColumnRenamed("node", "_from"), F.col("_from") == F.col("src"), F.lit(1).alias("_ahead")
        if self.hubs:
            asked = asked.withColumn("_ask", F.explode(F.sequence(F.lit(0), F.col("_ahead") - 1)))
            here, ahead = here & (F.col("_ask") == F.col("_part")), F.col("_ahead")
        asked = asked.drop("_ahead")
        met = (asked.hint("shuffle_hash") if light else asked).join(self.table, here)
        return met.select(F.col("dst").alias("node"), ahead, *carry)

    def near(self, nodes: DataFrame, *carry: str) -> DataFrame:
        """As ``follow``, for at most ``slim`` rows: they are broadcast to the edges, which need no buckets. ``_ahead`` is not known, and 1."""
        asked = nodes.select(F.col("node").alias("_from"), *carry)
        return self.plain.join(F.broadcast(asked), F.col("_from") == F.col("src")).select(F.col("dst").alias("node"), F.lit(1).alias("_ahead"), *carry)


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None,
            carry: Sequence[str] = ()) -> DataFrame:
    """Nodes reachable from the seeds (``node`` plus ``carry``), seeds at depth 0; cycles end by themselves.

    Each round joins only the nodes found in the round before. Where they are few (``Steps.slim``) they are broadcast to the edges; the edges are dealt into
    buckets when a round first has more. The nodes seen so far lie in buckets, so a round exchanges its own finds alone, and meets all
    layers of the nodes seen in one join. ``carry`` columns travel with the node, so that many sources are followed in one pass; pairs
    that outgrow their buckets are dealt into more.
    """
    steps, key = Steps(edges, direction), ["node", *carry]
    kept = lambda df, n: bucketed(df.repartition(n, *key), *key, n=n, sort=False)
    n = steps.buckets
    frontier = kept(seeds.select(*key).dropna(subset=["node"]).distinct().select(*key, F.lit(1).alias("_ahead"), F.lit(0).alias("depth")), n)
    layers, depth, size, told = [frontier], 0, frontier.count(), False
    total = size
    while (max_depth is None or depth < max_depth) and size:
        depth += 1
        if size <= steps.slim:
            met, told = steps.near(frontier, *carry), False
        else:
            asked = frontier.drop("depth") if told else steps.start(frontier.select(*key))
            met, told = steps.follow(asked, *carry, light=_light(size, steps.buckets, carry)), True
        found = met.repartition(n, *key).groupBy(*key).agg(F.max("_ahead").alias("_ahead"))
        known = _union(layers).select(*[F.col(k).alias(f"_seen{i}") for i, k in enumerate(key)], F.lit(True).alias("_old")).hint("merge")
        meets = all_of([same(F.col(k), F.col(f"_seen{i}")) if i else F.col(k) == F.col("_seen0") for i, k in enumerate(key)])
        found = found.join(known, meets, "left").filter("_old IS NULL").select(*key, "_ahead")  # an anti join would be pushed below the edges' join
        frontier = bucketed(found.withColumn("depth", F.lit(depth)), *key, n=n, sort=False)
        layers.append(frontier)
        size = frontier.count()
        total += size
        wanted = max(n, _buckets(edges, total))
        if len(layers) > COMPACT_EVERY or wanted > 2 * n:
            n = wanted
            layers = [kept(_union(layers), n)]
    return _union(layers).drop("_ahead")


def seed_extremes(edges: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """Smallest and largest seed that reaches each node (a seed reaches itself).

    Two numbers per node decide whether some seed other than a given one reaches it, so the (node, seed) pairs
    are never listed. A round takes ``STRIDE`` steps before it meets the labels known so far: rounds are short, and a label that is no
    news goes at most that far.
    """
    steps = Steps(edges, direction)
    n = steps.buckets
    start = seeds.select("node").dropna().distinct().select("node", F.col("node").alias("lo"), F.col("node").alias("hi"))
    changed = bucketed(steps.start(start).repartition(n, "node"), "node", n=n, sort=False)
    layers, size = [changed], changed.count()
    while size:
        step, ways = changed, []
        for _ in range(STRIDE):
            step = _least(steps.follow(step, "lo", "hi", light=_light(size, n)).repartition(n, "node"))
            ways.append(step)
        known = _merged(layers).select(F.col("node").alias("_known"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).hint("merge")
        offered = _least(_union(ways).repartition(n, "node"))
        joined = offered.join(known, F.col("node") == F.col("_known"), "left")
        lo, hi = F.least("lo", "_lo"), F.greatest("hi", "_hi")
        told = F.coalesce((lo == F.col("_lo")) & (hi == F.col("_hi")), F.lit(False))
        changed = bucketed(joined.filter(~told).select("node", "_ahead", lo.alias("lo"), hi.alias("hi")), "node", n=n, sort=False)
        size = changed.count()
        layers.append(changed)
        if len(layers) > COMPACT_EVERY:
            layers = [bucketed(_merged(layers), "node", n=n, sort=False)]
    return _merged(layers).drop("_ahead")


def _light(rows: int, buckets: int, carry: Sequence[str] = ()) -> bool:
    """Whether the rows of one bucket can be hashed; with columns carried, one node may hold all of them."""
    return rows <= 4_000_000 if carry else rows <= 4_000_000 * buckets


def _union(layers: list[DataFrame]) -> DataFrame:
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    return every


def _least(labels: DataFrame) -> DataFrame:
    return labels.groupBy("node").agg(F.max("_ahead").alias("_ahead"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _merged(layers: list[DataFrame]) -> DataFrame:
    """The labels of all layers, one row per node. The node is renamed below the union, as Spark 4.1 takes a union of bare bucketed scans
    for one bucketed table, but reads their buckets one after the other, and groups would then stay apart."""
    rows = _union([layer.select(F.col("node").alias("_node"), "_ahead", "lo", "hi") for layer in layers])
    return rows.groupBy("_node").agg(F.max("_ahead").alias("_ahead"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumnRenamed("_node", "node")


def multi_source_reach(edges: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """(node, seed) for every seed that reaches the node."""
    return closure(edges, seeds.select("node", F.col("node").alias("seed")), direction, carry=["seed"]).select(
        "node", "seed")


def reach_counts(edges: DataFrame, sinks: DataFrame, changed: DataFrame) -> DataFrame:
    """Per sink (``node``) the number of changed nodes that feed it; sinks nothing feeds are left out."""
    pairs = closure(edges, changed.select("node", F.col("node").alias("origin")), carry=["origin"])
    return pairs.join(sinks.select("node"), "node", "left_semi").groupBy("node").agg(
        F.count_distinct("origin").alias("changed_models"))


def exposures_reached(edges: DataFrame, exposures: DataFrame, changed: DataFrame) -> DataFrame:
    return closure(edges, changed).join(exposures.select("node"), "node", "left_semi").select("node").distinct()


def macro_consumers(macro_edges: DataFrame, nodes: DataFrame, uses: DataFrame, changed: DataFrame, project: str,
                    kinds: Sequence[str] = ("model",)) -> DataFrame:
    """(macro, id): nodes of the root project whose macros reach a changed macro, directly or through others.

    macro_edges (src uses dst), uses (id, macro), changed (macro).
    """
    reaching = closure(invert(macro_edges), changed.select(F.col("macro").alias("node"), F.col("macro").alias("changed")),
                       carry=["changed"]).select(F.col("node").alias("macro"), "changed")
    mine = nodes.filter(F.col("kind").isin(*kinds) & F.coalesce(F.col("package") == project, F.lit(True)))
    return uses.join(mine.select("id"), "id", "left_semi").join(reaching, "macro").select(
        F.col("changed").alias("macro"), "id").distinct()


def focus_set(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Users of a changed macro, and apart from them everything downstream."""
    reach = closure(edges, users.select(F.col("id").alias("node")))
    return reach.select(F.col("node").alias("id"), F.when(F.col("depth") == 0, "user").otherwise("downstream").alias(
        "role"))


class ChangeGraph:
    """Roles around a set of changed nodes; the two label passes are shared by all of them."""

    def __init__(self, edges: DataFrame, seeds: DataFrame):
        self.edges = cut(clean_edges(edges))
        self.seeds = cut(seeds.select("node").distinct())
        labels = lambda direction: cut(seed_extremes(self.edges, self.seeds, direction), "labels")
        with ThreadPoolExecutor(2) as pool:  # rounds are short jobs, so the two passes run side by side
            above, below = (pool.submit(inheritable_thread_target(self.edges.sparkSession)(labels), d) for d in ("down", "up"))
        self.above, self.below = above.result(), below.result()

    def connectors(self) -> DataFrame:
        """Nodes between two different seeds."""
        return self._connectors

    @cached_property
    def _connectors(self) -> DataFrame:
        both = self.above.join(self.below.select("node", F.col("lo").alias("blo"), F.col("hi").alias("bhi")), "node")
        one = (F.col("lo") == F.col("hi")) & (F.col("blo") == F.col("bhi")) & (F.col("lo") == F.col("blo"))
        return cut(both.filter(~one).join(self.seeds, "node", "left_anti").select("node"), "connectors")

    def isolated(self) -> DataFrame:
        """Seeds that no other seed reaches and that reach no other seed."""
        return self._isolated

    @cached_property
    def _isolated(self) -> DataFrame:
        alone = lambda labels: labels.filter((F.col("lo") == F.col("node")) & (F.col("hi") == F.col("node"))).select("node")
        return cut(self.seeds.join(alone(self.above), "node", "left_semi").join(alone(self.below), "node", "left_semi"), "isolated")

    def halo(self) -> DataFrame:
        """Edges between an isolated seed and a neighbour that has no stronger role: (node, src, dst)."""
        lone = self.isolated()
        children = self.edges.join(lone, F.col("src") == F.col("node"), "left_semi").select(
            F.col("dst").alias("node"), "src", "dst")
        parents = self.edges.join(lone, F.col("dst") == F.col("node"), "left_semi").select(
            F.col("src").alias("node"), "src", "dst")
        stronger = self.seeds.unionByName(self.connectors())
        return children.unionByName(parents).join(stronger, "node", "left_anti")

    def nodes(self, new: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        role = lambda df, name: df.select("node").distinct().withColumn("role", F.lit(name))
        out = role(self.seeds, "changed").unionByName(role(self.connectors(), "connector")).unionByName(
            role(self.halo(), "halo"))
        state = F.when(F.col("role") == "changed", "modified")
        if new is not None:
            out = out.join(new.select("node").distinct().withColumn("_new", F.lit(True)), "node", "left")
            state = F.when((F.col("role") == "changed") & F.col("_new"), "new").otherwise(state)
        out = out.select("node", "role", state.alias("state"))
        if removed is not None:
            out = out.unionByName(removed.select("node", F.lit("removed").alias("role"), F.lit("deleted").alias("state")))
        return out

    def induced(self) -> DataFrame:
        """Edges among changed nodes and connectors, and the halo's own edges."""
        core = self.seeds.unionByName(self.connectors())
        inner = self.edges.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(
            core.select(F.col("node").alias("dst")), "dst", "left_semi")
        return inner.select("src", "dst").unionByName(self.halo().select("src", "dst")).distinct()


def _among(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """Edges whose ``end`` is one of the nodes (``node``, distinct). Few nodes are hashed, and the edges stream by unsorted. It is the number of all
    nodes that counts, as adaptive execution may bring any number of partitions into one task, where a hash table can't be spilled. A semi
    join would be pushed below a union of edges, and hash or sort the nodes once for each of its inputs."""
    how = "shuffle_hash" if nodes.count() <= LIGHT else "merge"
    return edges.join(nodes.hint(how), F.col(end) == F.col("node")).select("src", "dst")


def acyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after repeatedly dropping those that start at a node nothing points to; empty without a cycle.

    An edge to a node without edges of its own holds nothing up, so the rounds look only at edges between nodes that lead on. All edges
    are met a last time where some node stays. They are read three times: edges that are dear to compute should be cut first.
    """
    edges = edges.select("src", "dst")
    inner = cut(_among(edges, "dst", cut(edges.select(F.col("src").alias("node")).distinct(), "starts")), "inner")
    size, pointed = inner.count(), inner.select(F.col("dst").alias("node")).distinct()
    while size:
        pointed = cut(inner.select(F.col("dst").alias("node")).distinct(), "pointed")
        inner = cut(_among(inner, "src", pointed), "inner")
        now = inner.count()
        if now == size:
            break
        size = now
    if not size:
        return inner  # without a row
    # dealt anew, as the edges of one node must not lie in one task, and by number, so that adaptive execution leaves the partitions apart
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _among(edges, "src", pointed).repartition(n, "src", "dst").distinct()


def contract_chains(edges: DataFrame) -> DataFrame | None:
    """One edge in place of every run of nodes that have one edge in and one out; None where such a run closes on itself.

    Each node of a run points at its successor and then, round by round, at what that points at, so a run of n nodes takes about
    log2(n) rounds. Its joins are merged: the files of a run are so small that each round would broadcast them through the driver.
    """
    alone = lambda end: edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("node")
    inner = cut(alone("src").join(alone("dst").hint("merge"), "node"), "inner")
    size = inner.count()
    if not size:
        return edges
    inner = inner.hint("merge")
    flagged = inner.select(F.col("node").alias("to"), F.lit(True).alias("on")).hint("merge")
    first = edges.join(inner, F.col("src") == F.col("node"), "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("to"))
    points = cut(first.join(flagged, "to", "left").select("node", "to", F.coalesce("on", F.lit(False)).alias("on")), "points")
    for _ in range(size.bit_length() + 1):
        if points.filter("on").isEmpty():
            heads = edges.join(inner, F.col("src") == F.col("node"), "left_anti")
            ends = points.select("node", "to")
            return heads.join(ends.hint("merge"), F.col("dst") == F.col("node"), "left").select("src", F.coalesce("to", "dst").alias("dst")).distinct()
        ahead = points.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("on").alias("_on"))
        moved = points.filter("on").join(ahead.hint("merge"), "to").select("node", F.col("_to").alias("to"), F.col("_on").alias("on"))
        points = cut(points.filter("not on").unionByName(moved), "points")
    return None


def is_acyclic(edges: DataFrame) -> DataFrame:
    """One row, ``acyclic``. Edges are dropped from both ends, where nothing leads in or nothing leads on, and chains are contracted,
    until none is left, or all that are left lead from and to others."""
    left = cut(edges.select("src", "dst").distinct(), "edges")
    size = left.count()
    while size and left.filter("src = dst").isEmpty():
        ends = lambda own, other: left.select(F.col(own).alias(other)).distinct().hint("merge")
        peeled = cut(left.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        now = peeled.count()
        if now == size:
            break
        shorter = contract_chains(peeled) if now else peeled
        if shorter is None:
            left = peeled
            break
        left = cut(shorter, "edges")
        size = left.count()
    return left.agg((F.count(F.lit(1)) == 0).alias("acyclic"))
