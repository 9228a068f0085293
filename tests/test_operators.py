from pyspark.sql import functions as F

from tallyforge.operators import cfg, graph, intervals, scheduling, selection


def test_bfs_ties(spark):
    edges = spark.createDataFrame([("e", "A"), ("e", "B"), ("A", "t1"), ("B", "mid"), ("mid", "t2"), ("B", "t1")], "src string, dst string")
    got = {r.node: (r.depth, r.parent) for r in graph.bfs(graph.degree_order(edges), spark.createDataFrame([("e", 0)], "node string, ordinal int"), 4).collect()}
    assert got == {"e": (0, None), "A": (1, "e"), "B": (1, "e"), "t1": (2, "A"), "mid": (2, "B"), "t2": (3, "mid")}


def test_simple_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert [r.path for r in graph.simple_paths(edges, "a", "d", 5, 10).collect()] == [["a", "c", "d"], ["a", "b", "c", "d"]]


def test_dominators(spark):
    blocks = spark.createDataFrame([("f", 1, True, [2, 3]), ("f", 2, False, [4]), ("f", 3, False, [4]), ("f", 4, False, [])], "fn string, block int, entry boolean, successors array<int>")
    got = {(r.block, r.dominator) for r in graph.dominators(blocks, ["fn"]).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (4, 4)}


def test_dominators_of_large_graphs_are_a_tree_and_dealt_in_parts(spark, monkeypatch):
    import random

    n = 50_000
    parents, order = graph.dominator_tree([i == 0 for i in range(n)], [[i + 1] if i + 1 < n else [] for i in range(n)])
    assert parents == list(range(-1, n - 1)) and order == list(range(n))
    monkeypatch.setattr(graph, "PART", 4)
    r = random.Random(5)
    edges = {f: [sorted(r.sample(range(12), r.choice([0, 1, 1, 2, 3]))) for _ in range(12)] for f in "abcd"}
    blocks = spark.createDataFrame([(f, b, b == 0, nexts) for f in edges for b, nexts in enumerate(edges[f])], "fn string, block long, entry boolean, successors array<long>")
    want = []
    for f, nexts in edges.items():
        before = [{a for a in range(12) if b in nexts[a]} for b in range(12)]
        dom = [{b} if b == 0 else set(range(12)) for b in range(12)]
        for _ in range(12):
            dom = [dom[b] if b == 0 else (set.intersection(*(dom[a] for a in before[b])) if before[b] else set()) | {b} for b in range(12)]
        want += [(f, b, x) for b in range(12) for x in dom[b]]
    assert sorted(map(tuple, graph.dominators(blocks, ["fn"]).collect())) == sorted(want)


def test_dominators_of_a_long_chain_take_little_disk(spark, tmp_path):
    n = 3000
    nexts = F.array_compact(F.array(F.when(F.col("block") < n - 1, F.col("block") + 1)))
    chain = spark.range(n).select(F.lit("f").alias("fn"), F.col("id").alias("block")).select("*", (F.col("block") == 0).alias("entry"), nexts.alias("successors"))
    graph.dominators(chain, ["fn"]).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).where("dominator <= block").agg(F.count(F.lit(1)), F.countDistinct("block", "dominator")).first()
    assert tuple(got) == (n * (n + 1) // 2,) * 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n * (n + 1) // 2 * 0.25


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 9.0, 5.0), (2, 8.0, 6.0), (3, 7.0, 5.0), (4, 7.0, 0.5)], "id int, score double, cost double").withColumn("pool", F.lit(0))
    got = {r.id: r.selected for r in scheduling.budget_schedule(df, ["pool"], "score", "id", "cost", 10.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    assert all(r.selected for r in scheduling.budget_schedule(df, ["pool"], "score", "id", "cost", 0.0).collect())


def test_scores(spark):
    row = spark.range(1).select(
        scheduling.evidence_score(F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.lit(False), F.lit(True), F.lit(False), F.lit("high"), F.array(F.lit("unresolved sink"))).alias("a"),
        scheduling.route_cost(F.lit(4.0), F.lit(False), F.lit(1.0), F.lit(3.0), F.lit(2)).alias("b"),
        scheduling.variant_utility(F.lit(None).cast("int"), F.lit(1), F.lit(True), F.lit(2.0), F.lit(0.5)).alias("c"),
        intervals.classify_write(F.lit("o"), F.lit(4), F.lit(8), F.lit(0), F.lit(6))["verdict"].alias("d"),
        intervals.integer_risk(F.lit("add"), F.lit(200), F.lit(100), 8).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (5 + 4 + 1.5 + 1.5 - 0.75 - 4, 7 * 1.2, 12.0, "candidate", "overflow")


def test_seeded_score_matches_python(spark):
    import hashlib

    want = int(hashlib.sha256(b"s\0" + b"7").hexdigest()[:16], 16) / 2**64
    assert spark.range(7, 8).select(scheduling.seeded_score("s", F.col("id")).alias("x")).first().x == want


def test_paths_avoiding_barriers(spark):
    blocks = spark.createDataFrame([("f", 1, [2, 3]), ("f", 2, [4]), ("f", 3, [4]), ("f", 4, [])], "function string, block int, successors array<int>")
    asked = spark.createDataFrame([("f", 1, 1, 4, [2]), ("f", 2, 1, 4, [2, 3]), ("f", 3, 4, 1, [])], "function string, id int, source int, target int, barriers array<int>")
    assert {r.id: r.reachable for r in cfg.paths_avoiding(blocks, asked).collect()} == {1: True, 2: False, 3: False}


def test_summaries_reach_callers_up_to_the_depth(spark):
    own = spark.createDataFrame([("f0", "p", "write")], "function string, expression string, effect string")
    sites = spark.createDataFrame([(f"f{i + 1}", f"f{i}", f"a{i}") for i in range(6)], "caller string, callee string, argument string")
    got = cfg.propagate_summaries(own, sites, F.concat("argument", F.lit("+"), "expression"))
    assert {r.function: r.expression for r in got.collect()} == {"f0": "p", "f1": "a0+p", "f2": "a1+a0+p", "f3": "a2+a1+a0+p", "f4": "a3+a2+a1+a0+p"}


def test_function_ranges():
    text = "int a(int x) {\n  if (x) { return 1; }\n  return \"}\"[0];\n}\n/* void z() { */\nvoid b(void)\n{\n}\n"
    assert cfg.function_ranges(text) == [("a", 1, 4), ("b", 6, 8)]


def test_selection(spark):
    row = spark.range(1).select(
        selection.blockers_allowed(F.array(F.lit("a")), ["a", "b"]).alias("a"), selection.blockers_allowed(F.lit(None).cast("array<string>"), []).alias("b"),
        selection.exact_operation(F.lit("0x1A"), F.lit("0x1a")).alias("c"), selection.safe_method(F.lit("get_status")).alias("d"), selection.safe_method(F.lit("list_reset")).alias("e"),
    ).first()
    assert tuple(row) == (True, True, False, True, False)
    routes = spark.createDataFrame([("c", "r1", "s", True), ("c", "r2", "s", True), ("c", "r3", "t", True), ("c", "r4", "t", False)], "candidate_id string, route string, scope string, viable boolean")
    tries = spark.createDataFrame([("c", "r1", "s", "failed"), ("c", "r9", "s", "failed")], "candidate_id string, route string, scope string, outcome string")
    assert [r.route for r in selection.available_routes(routes, tries).collect()] == ["r3"]
    plan = selection.transaction_plan(spark.createDataFrame([("net",)], "object string"), spark.createDataFrame([("net", "get"), ("net", "set")], "object string, method string"), spark.createDataFrame([("net", "get", "name")], "object string, method string, argument string"))
    assert sorted((r.method, r.argument or "") for r in plan.collect()) == [("get", ""), ("get", "name")]


def test_transaction_schedule(spark):
    rows = [("a", "m1", "s1", 0, 1, 1.0, 1.0, 3), ("b", "m1", "s1", 5, 1, 1.0, 1.0, 0), ("c", "m2", "s2", 1, 1, 1.0, 1.0, 0), ("d", "m3", "s1", -1, 0, 5.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "variant_id string, method string, setup_key string, distance int, fields int, seconds double, cpu_seconds double, reaches int").withColumn("pool", F.lit(0))
    order = lambda p, wall=0.0: [r.variant_id for r in scheduling.transaction_schedule(df, ["pool"], p, wall).orderBy("step").collect()]
    assert order("fixed") == ["a", "b", "c", "d"] and order("cheapest", 2.1) == ["a", "b"]
    assert order("utility") == ["a", "b", "c", "d"] and order("adaptive")[:2] == ["a", "b"]


def test_dimensions_and_regions(spark):
    from tallyforge.sources import dims

    tax = spark.createDataFrame([("x", "memory"), ("x", "memory"), ("y", None), ("z", "odd")], "name string, backend string")
    got = {(r.key, r.fault) for r in dims.dimension_faults(tax, "name", ["backend"], {"backend": ["memory"]}).collect()}
    assert got == {("x", "duplicate"), ("y", "missing:backend"), ("y", "domain:backend"), ("z", "domain:backend")}
    assert dims.selection_faults(tax, ["memory"], ["x", "z", "q"]) == ["q", "z"]
    text = "int f() {\n  char buf[0x20];\n  unsigned int n[4];\n}"
    declared = dims.declared_arrays(spark.createDataFrame([("f", text)], "name string, text string"))
    assert {(r.var_name, r.size_bytes) for r in declared.collect()} == {("buf", 32), ("n", 16)}
    regions = spark.createDataFrame([("f", -64, 8, "buf"), ("f", -32, 4, "n"), ("f", -20, 4, "i")], "function string, start_offset int, size_bytes long, var_name string")
    assert {(r.var_name, r.size_bytes) for r in dims.repaired_regions(regions, declared).collect()} == {("buf", 32), ("n", 12), ("i", 4)}


def test_long_chains_reach_their_end(spark):
    from tallyforge.operators import graph

    chain = spark.range(80).selectExpr("CAST(id AS STRING) AS src", "CAST(id + 1 AS STRING) AS dst")
    assert graph.closure(chain).where("src = '0'").count() == 80
    assert graph.propagate(chain, spark.createDataFrame([("40",)], "node string")).agg({"depth": "max"}).first()[0] == 40


def test_breadth_first_order_goes_by_queue(spark):
    from tallyforge.operators import graph

    edges = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("x", "z", 0), ("y", "z", 5), ("b", "z", 0), ("z", "a", 0)], "src string, dst string, ordinal int")
    got = {r.node: (r.depth, r.parent, r.root) for r in graph.bfs(edges, spark.createDataFrame([("a", 0)], "node string, ordinal int")).collect()}
    assert got == {"a": (0, None, "a"), "x": (1, "a", "a"), "y": (1, "a", "a"), "z": (2, "y", "a")}


def test_later_rows_of_one_large_key(spark):
    from pyspark.sql import functions as F
    from tallyforge.operators import intervals, joins

    rows = spark.range(200_000).selectExpr("1 AS k", "id AS at", "id % 1000 AS size")
    out = joins.next_after(rows, ["k"], [F.col("at")], F.col("size") == 999, F.col("at"), "next")
    assert out.where("at < 199999").where("next <> at + 999 - size AND size < 999 OR next <> at + 1000 AND size = 999").count() == 0
    far = intervals.next_boundary(rows, ["k"], "at", "size", 8)
    assert far.where("size = 999 AND boundary <> at + 9").count() == 0 and far.where("boundary IS NULL").count() == 1


def test_merged_scalars_come_from_one_row(spark):
    from pyspark.sql import functions as F
    from tallyforge.operators import dedupe

    rows = spark.createDataFrame([(1, 5, "a", 1, ["x"]), (1, 5, "b", 0, ["y"]), (1, 4, "c", 9, ["x"])], "k int, p int, s string, n int, u array<string>")
    assert dedupe.merge_duplicates(rows, ["k"], F.col("p"), ["s", "n"], ["u"]).collect() == [(1, "b", 0, ["x", "y"], 3)]


def test_only_sums_and_products_overflow(spark):
    risk = lambda op, a, b: intervals.integer_risk(F.lit(op), F.lit(a), F.lit(b), 8).alias(op)
    assert tuple(spark.range(1).select(risk("sub", 619, 5), risk("mul", 100, 3), risk("cast", 300, 0)).first()) == ("none", "overflow", "truncation")
    assert spark.range(1).select(risk("sub", 3, 5)).first()[0] == "underflow"
