import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import columns as cl, graph as g
from proofline.session import cut


def edges_of(spark, pairs, schema="src int, dst int"):
    return spark.createDataFrame(pairs, schema) if pairs else spark.createDataFrame([], schema)


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        node = todo.pop()
        for a, b in pairs:
            if a == node and b not in seen:
                seen.add(b), todo.append(b)
    return seen


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node int")


def test_closure_ends_on_cycles_and_keeps_depth(spark, rows):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)])
    assert rows(g.closure(edges, nodes_of(spark, [1]))) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(g.closure(edges, nodes_of(spark, [4]), "up"), "node") == [(1,), (2,), (3,), (4,)]
    assert rows(g.closure(edges, nodes_of(spark, [1]), max_depth=1), "node") == [(1,), (2,)]


def test_long_chain_is_compacted(spark):
    chain = edges_of(spark, [(i, i + 1) for i in range(20)])
    assert g.closure(chain, nodes_of(spark, [0])).count() == 21


@pytest.mark.parametrize("seed", range(3))
def test_change_graph_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(a, b) for a, b in ((rng.randint(0, 17), rng.randint(0, 17)) for _ in range(22)) if a < b})
    seeds = sorted(rng.sample(range(18), 4))
    back = [(b, a) for a, b in pairs]
    down, up = {s: reach(pairs, s) for s in seeds}, {s: reach(back, s) for s in seeds}
    connectors = {n for n in range(18) if n not in seeds and any(n in down[a] and n in up[b] for a in seeds for b in seeds if a != b)}
    lone = {s for s in seeds if not any(o != s and (o in down[s] or o in up[s]) for o in seeds)}
    halo = {(n, a, b) for a, b in pairs for n in ([b] if a in lone else []) + ([a] if b in lone else []) if n not in seeds and n not in connectors}
    graph = g.ChangeGraph(edges_of(spark, pairs), nodes_of(spark, seeds))
    assert {r[0] for r in graph.connectors().collect()} == connectors
    assert {r[0] for r in graph.isolated().collect()} == lone
    assert {tuple(r) for r in graph.halo().collect()} == halo
    core = set(seeds) | connectors
    assert {tuple(r) for r in graph.induced().collect()} == {(a, b) for a, b in pairs if a in core and b in core} | {(a, b) for _, a, b in halo}
    pairs_found = {tuple(r) for r in g.multi_source_reach(edges_of(spark, pairs), nodes_of(spark, seeds)).collect()}
    assert pairs_found == {(n, s) for s in seeds for n in down[s]}


def test_acyclic(spark):
    assert g.is_acyclic(edges_of(spark, [(1, 2), (2, 3), (1, 3)])).collect()[0][0] is True
    assert g.is_acyclic(edges_of(spark, [(1, 2), (2, 3), (3, 2)])).collect()[0][0] is False
    assert g.is_acyclic(edges_of(spark, [])).collect()[0][0] is True


def test_macro_consumers_keep_null_package(spark, rows):
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(1, "model", None), (2, "model", "shop"), (3, "model", "vendor"), (4, "test", "shop")], "id int, kind string, package string")
    uses = spark.createDataFrame([(1, "c"), (2, "x"), (2, "a"), (3, "a"), (4, "b")], "id int, macro string")
    changed = spark.createDataFrame([("a",)], "macro string")
    assert rows(g.macro_consumers(calls, nodes, uses, changed, "shop")) == [("a", 1), ("a", 2)]
    assert rows(g.macro_consumers(calls, nodes, uses, changed, "shop", ["test"])) == [("a", 4)]


def test_bind_names(spark, rows):
    owners = spark.createDataFrame([("db.a", "A", "m1"), ("db.b", "b", "m2"), ("x.b", "b", "m3"), ("db.s", "s", "m4"), ("db.s", "s", "m5")],
                                   "relation string, identifier string, node string")
    edges = spark.createDataFrame([("m1", "t"), ("m2", "t"), ("m4", "t"), ("m2", "u"), ("m3", "u")], "src string, dst string")
    refs = spark.createDataFrame([("t", "a"), ("t", "B"), ("t", "s"), ("u", "b"), ("u", "a")], "id string, leaf string")
    got = {(i, leaf): up for i, leaf, up in rows(cl.bind_names(refs, owners, edges))}
    # one owner that feeds the node; one of two owners feeds it; a relation two nodes claim; both owners feed it; owner does not feed it
    assert got == {("t", "a"): "m1", ("t", "b"): "m2", ("t", "s"): None, ("u", "b"): None, ("u", "a"): None}


def test_trace_ends(spark, rows):
    edges = spark.createDataFrame([("src", "id", "a", "id"), ("a", "id", "b", "id"), ("a", "x", "b", "x"), ("c", "x", "b", "x"), ("l2", "q", "l1", "q"),
                                   ("l1", "q", "l2", "q")], "upstream string, upstream_column string, downstream string, downstream_column string")
    starts = spark.createDataFrame([("b", "ID"), ("b", "x"), ("c", "x"), ("l1", "q"), ("thin", "z")], "node string, column string")
    origins, thin = spark.createDataFrame([("src",)], "node string"), spark.createDataFrame([("thin",)], "node string")
    got = {(r["start_node"], r["start_column"]): (r["termination"], r["hops"]) for r in cl.trace_to_source(edges, starts, origins, thin).collect()}
    assert got == {("b", "id"): ("source", ["b.id", "a.id", "src.id"]), ("b", "x"): ("opaque", ["b.x"]), ("c", "x"): ("root", ["c.x"]),
                   ("l1", "q"): ("root", ["l1.q", "l2.q"]), ("thin", "z"): ("opaque", ["thin.z"])}
    blast = cl.column_blast_radius(edges, spark.createDataFrame([("src", "id")], "node string, column string"))
    assert rows(blast, "node", "column") == [("a", "id"), ("b", "id")]


@pytest.mark.parametrize("hub", [3, 100_000])
def test_walks_split_hubs_and_keep_the_edges_in_place(spark, rows, monkeypatch, capsys, hub):
    monkeypatch.setattr(g, "HUB", hub)
    pairs = [(0, i) for i in range(1, 12)] + [(i, 50) for i in range(1, 12)] + [(50, 0), (50, 60), (60, 61), (None, 7), (7, None)]
    edges = spark.createDataFrame(pairs + pairs, "src int, dst int")
    seeds = spark.createDataFrame([(0, "a"), (60, "b"), (0, "a"), (None, "c")], "node int, tag string")
    assert rows(g.closure(edges.dropna(), seeds, carry=["tag"])) == sorted(
        [(0, "a", 0), *[(i, "a", 1) for i in range(1, 12)], (50, "a", 2), (60, "a", 3), (61, "a", 4), (60, "b", 0), (61, "b", 1)])
    assert rows(g.closure(edges, seeds.select("node"), max_depth=1), "node", "depth") == [(None, 1)] * 0 + sorted(
        [(0, 0), (60, 0), (61, 1), *[(i, 1) for i in range(1, 12)]])
    assert rows(g.seed_extremes(edges.dropna(), seeds.select("node")).filter("node >= 50")) == [(50, 0, 0), (60, 0, 60), (61, 0, 60)]
    steps = g.Steps(edges.dropna())
    assert steps.table.count() == 25
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps.follow(steps.start(spark.range(3).withColumnRenamed("id", "node"))).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    edge_side = capsys.readouterr().out.split("Bucketed: true")[0].splitlines()
    assert not any("Exchange" in line for line in edge_side[-4:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("buckets_")]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(g, "cut", lambda df, label="": made.append(label) or cut(df, label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    chain = spark.range(5000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    closed = chain.unionByName(spark.createDataFrame([(5000, 0)], "src long, dst long"))
    branched = chain.unionByName(spark.createDataFrame([(4000, 100), (7, 9000), (9000, 3000)], "src long, dst long"))
    for edges, answer in ((chain, True), (closed, False), (branched, False), (branched.filter("src <> 4000"), True), (chain.filter("src < 0"), True)):
        made.clear()
        assert g.is_acyclic(edges).first()[0] is answer
        assert len(made) < 30
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert not g.is_acyclic(spark.createDataFrame([(1, 1)], "src long, dst long")).first()[0]


def test_contracting_chains_broadcasts_nothing(spark, monkeypatch, capsys):
    made = []
    monkeypatch.setattr(g, "cut", lambda df, label="": df.explain() or made.append(label) or cut(df, label))
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert g.is_acyclic(chain).first()[0] is True
    assert made.count("points") > 3 and "Broadcast" not in capsys.readouterr().out


def test_walks_of_small_graphs_open_few_files(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        edges = spark.range(0, 2000, 1, 10).select(F.col("id").alias("src"), (F.col("id") + 1000).alias("dst"))
        assert len(g.Steps(edges).table.inputFiles()) <= 8
        assert rows(g.closure(edges, spark.range(5).withColumnRenamed("id", "node")).groupBy("depth").count()) == [(0, 5), (1, 5), (2, 5)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_core_leaves_edges_to_dead_ends_out_of_its_rounds(spark, rows, monkeypatch):
    written = []
    def counted(df, label=""):
        out = cut(df, label)
        written.append(out.count())
        return out
    monkeypatch.setattr(g, "cut", counted)
    fan = [(i, 1000 + 100 * i + j) for i in range(4) for j in range(100)]
    chain = [(0, 1), (1, 2), (2, 3), (None, 1), (3, None)]
    assert rows(g.acyclic_core(edges_of(spark, fan + chain))) == []
    assert sum(written) < 30
    assert rows(g.acyclic_core(edges_of(spark, fan + fan + chain + [(3, 2)]))) == sorted(
        [(2, 3), (3, 2), *[e for e in fan if e[0] in (2, 3)], (3, None)], key=lambda e: (e[0], e[1] is None, e[1]))
    assert rows(g.acyclic_core(edges_of(spark, [(7, 7), (7, 8), (6, 7)]))) == [(7, 7), (7, 8)]


def test_long_traces_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(cl, "cut", lambda df, label="": made.append(label) or cut(df, label))
    pairs = [(i, "c", i + 1, "c") for i in range(40)] + [(100, "c", 101, "c"), (101, "c", 102, "c"), (102, "c", 100, "c"), (102, "c", 103, "c"), (103, "c", 104, "c")]
    edges = spark.createDataFrame(pairs, "upstream int, upstream_column string, downstream int, downstream_column string")
    starts = spark.createDataFrame([(40, "C"), (17, "c"), (104, "c")], "node int, column string")
    none = spark.createDataFrame([], "node int")
    got = {r["start_node"]: (r["termination"], r["end_node"], r["hops"]) for r in cl.trace_to_source(edges, starts, none, none).collect()}
    way = lambda ids: [f"{i}.c" for i in ids]
    assert got == {40: ("root", 0, way(range(40, -1, -1))), 17: ("root", 0, way(range(17, -1, -1))), 104: ("root", 100, way([104, 103, 102, 101, 100]))}
    assert len(made) < 12


def test_change_graph_takes_two_steps_a_round_and_reads_its_labels_once(spark, rows, monkeypatch):
    made = []
    monkeypatch.setattr(g, "cut", lambda df, label="": made.append(label) or cut(df, label))
    walked = []
    original = g.bucketed
    monkeypatch.setattr(g, "bucketed", lambda df, *keys, **more: walked.append(keys) or original(df, *keys, **more))
    graph = g.ChangeGraph(edges_of(spark, [(i, i + 1) for i in range(16)]), nodes_of(spark, [0, 16]))
    assert len(walked) < 30  # two passes of 17 steps were 38
    assert rows(graph.induced()) == [(i, i + 1) for i in range(16)] and rows(graph.connectors()) == [(i,) for i in range(1, 16)]
    assert (made.count("labels"), made.count("connectors"), made.count("isolated")) == (2, 1, 1)


def test_labels_have_one_row_per_node(spark, rows):
    pairs = [(1, 2), (1, 5), (2, 11), (5, 7), (5, 9), (5, 10), (5, 17), (10, 12), (11, 14), (11, 16), (13, 16)]
    assert rows(g.seed_extremes(edges_of(spark, pairs), nodes_of(spark, [5, 11, 16, 17]))) == [
        (5, 5, 5), (7, 5, 5), (9, 5, 5), (10, 5, 5), (11, 11, 11), (12, 5, 5), (14, 11, 11), (16, 11, 16), (17, 5, 17)]


def test_few_nodes_are_sent_to_the_edges_and_buckets_hold_one_file(spark, rows, monkeypatch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(0, 2000, 1, 10).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1000).alias("dst"))
        steps = g.Steps(edges.unionByName(edges))
        assert len(steps.table.inputFiles()) == 8 and steps.table.count() == 2000  # every task wrote a file into every bucket
        written, original = [], g.bucketed
        monkeypatch.setattr(g, "bucketed", lambda df, *keys, **more: written.append(keys) or original(df, *keys, **more))
        seeds = spark.range(5).select(F.concat(F.lit("n"), "id").alias("node"))
        few = rows(g.closure(edges, seeds))
        assert few == sorted((f"n{i + 1000 * d}", d) for i in range(5) for d in range(3))
        assert set(written) == {("node",)}  # no edges were dealt
        monkeypatch.setattr(g, "SLIM", 0)
        assert rows(g.closure(edges, seeds)) == few and ("src",) in written
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("slim", [0, 4])
def test_walks_change_between_few_and_many_nodes(spark, rows, monkeypatch, slim):
    monkeypatch.setattr(g, "HUB", 3)
    monkeypatch.setattr(g, "SLIM", slim)
    rng = random.Random(slim)
    pairs = [(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(70)] + [(0, i) for i in range(20, 40)] + [(i, 59) for i in range(20, 40)] + [(59, 0), (3, None)]
    edges = edges_of(spark, pairs + pairs[:30])
    starts = {0: "a", 7: "b", 41: "b"}
    seeds = spark.createDataFrame([*starts.items(), (None, "c")], "node int, tag string")
    known = [p for p in pairs if None not in p]
    for direction, way in (("down", known), ("up", [(b, a) for a, b in known])):
        want = sorted({(n, t) for s, t in starts.items() for n in reach(way, s)})
        assert rows(g.closure(edges.dropna(), seeds, direction, carry=["tag"]), "node", "tag") == want


def test_core_hashes_few_nodes_and_meets_a_union_of_edges_once(spark, rows, monkeypatch, capsys):
    """Partitions may be brought into one task, so nodes that are few to a partition are not few enough for a hash table."""
    monkeypatch.setattr(g, "LIGHT", 5)
    monkeypatch.setattr(g, "cut", lambda df, label="": df.explain() or cut(df, label))
    step = lambda at, n: spark.range(n).select((F.col("id") + at).alias("src"), (F.col("id") + at + 1).alias("dst"))
    ring = step(0, 8).unionByName(step(20, 3)).unionByName(spark.range(8, 9).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
    core = g.acyclic_core(ring)
    core.explain()
    plans = capsys.readouterr().out.split("== Physical Plan ==")
    assert len(plans) > 4 and not any("ShuffledHashJoin" in p or p.count("Join ") > 1 for p in plans)
    assert rows(core) == [(i, (i + 1) % 9) for i in range(9)]
    assert core.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
