import json

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import discovery, evidence
from tallyforge.sources import readers, writers
from tallyforge.streaming import streams


def dump(path, value):
    path.write_text(json.dumps(value))
    return str(path)


EXPORT = {
    "binary": "b", "image_base": "0x400000", "pointer_size_bytes": 8,
    "functions": [
        {"address": "0x401000", "name": "main", "ordinal": 1, "pcode_calls": [
            {"call_address": "0x401010", "callee": "_system", "args": [{"repr": "argv[1]"}]},
            {"call_address": "0x401020", "callee": "helper", "args": [{"repr": "\"k3y\""}]},
            {"call_address": "0x401030", "callee": "free", "args": [{"repr": "(char *)p"}]}],
         "pcode_stores": [{"operation_address": "0x401040", "write_width": 8, "address_vars": ["p"]}],
         "string_refs": [{"address": "0x402000", "value": "k3y"}],
         "stack_regions": [{"start_offset": -16, "size_bytes": 16, "var_names": ["buf"]}]},
        {"address": "401100", "name": "helper"},
    ],
}
SPECS = {"schema_version": 12, "operations": [{"name": "system", "backend": "semantic", "aliases": ["_system"], "semantics": "execute"}, {"name": "free", "backend": "lifetime", "aliases": [], "semantics": "release"}]}


def test_export_to_candidates(spark, tmp_path):
    fns = readers.functions(spark, dump(tmp_path / "e.json", EXPORT))
    got = {r.name: (r.address, r.relative_address) for r in fns.collect()}
    assert got == {"main": ("0x401000", 0x1000), "helper": ("0x401100", 0x1100)}
    specs = readers.operation_specs(spark, dump(tmp_path / "s.json", SPECS))
    ops = discovery.operations(fns, specs).cache()
    assert {(r.kind, r.name, r.semantics) for r in ops.collect()} == {("call", "system", "execute"), ("call", "helper", None), ("call", "free", "release"), ("store", "store_8", None)}
    assert [(r.vulnerability_type, r.function) for r in discovery.semantic_candidates(ops).collect()] == [("command_injection", "main")]
    assert [(r.identity, r.action) for r in discovery.lifecycle_events(ops).where("action = 'release'").collect()] == [("p", "release")]
    assert [r.name for r in discovery.literal_consumers(discovery.strings(fns), ops).collect()] == ["helper"]
    assert [(r.name, r.capacity_bytes) for r in discovery.memory_objects(fns).collect()] == [("buf", 16)]
    assert [r.name for r in discovery.sink_audit(ops).collect()] == ["helper"]
    assert [(r.src, r.dst) for r in readers.pcode_edges(fns).collect()] == [("main", "helper")]


def test_versions_fail_closed(spark, tmp_path):
    bad = dump(tmp_path / "v.json", SPECS | {"schema_version": 3})
    with pytest.raises(Exception, match="unsupported schema_version 3"):
        readers.operation_specs(spark, bad).collect()
    old = dump(tmp_path / "o.json", {"schema_version": 1, "attempts": [{"candidate_id": "a", "variant_id": "zz"}]})
    assert readers.schedules(spark, old).first().variant_id == ""


def test_traces_and_listings(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"operation_address":"0xA"}\n\n{"operation_address":"0x0B"}\n')
    assert [(r.offset, r.operation_address) for r in readers.trace_hits(spark, str(tmp_path / "t.jsonl")).orderBy("offset").collect()] == [(0, "0xa"), (29, "0xb")]
    df = spark.createDataFrame([(1, "'net' @1\n\t\"status\":{}\n\t\"set\":{\"name\":\"String\"}\n")], "id int, out string")
    assert [tuple(r)[1:] for r in readers.verbose_methods(df, "id", "out").collect()] == [("net", "status", None, None), ("net", "set", "name", "String")]
    with pytest.raises(Exception, match="malformed line"):
        readers.verbose_methods(spark.createDataFrame([(1, "garbage")], "id int, out string"), "id", "out").collect()


def test_inventories(spark, tmp_path):
    elf = b"\x7fELF\x02\x01" + b"\0" * 12 + b"\x3e\x00" + b"hello world\0ab\0hello world\0"
    (tmp_path / "bin").write_bytes(elf)
    r = readers.binaries(spark, str(tmp_path)).first()
    assert (r.is_elf, r.arch, r.bits, r.size) == (True, "x86_64", 64, len(elf))
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert [x.value for x in readers.binary_strings(raw).orderBy("position").collect()] == ["hello world"]
    files = spark.createDataFrame([("/etc/init.d/web", "exec /usr/bin/httpd\nport=8080 port=80"), ("/app/x.env", "export API_KEY=1\nDEBUG=0"), ("/app/r.txt", "go('/api/v1') and \"/api/v1\"")], "path string, text string")
    s = readers.service_inventory(files).first()
    assert s.commands == ["/usr/bin/httpd"] and s.ports == [80, 8080]
    assert [(c.kind, c.env_keys) for c in readers.config_inventory(files).collect()] == [("env", ["API_KEY", "DEBUG"])]
    assert [x.route for x in readers.route_inventory(files).where("path LIKE '%r.txt'").collect()] == ["/api/v1"]
    src = spark.createDataFrame([("m", "helper(1); pthread_create(&t, 0, worker, 0);")], "name string, text string")
    names = spark.createDataFrame([("helper",), ("worker",)], "name string")
    assert [r.dst for r in readers.text_call_edges(src, names).collect()] == ["helper"]
    assert [r.dst for r in readers.thread_edges(src, names).collect()] == ["worker"]


def test_lanes_and_flaws(spark, tmp_path):
    lanes = [{"lane_id": "a", "role": "vulnerable", "comparison_group": "g"}, {"lane_id": "b", "role": "fixed", "comparison_group": "g"}, {"lane_id": "c", "role": "fixed", "comparison_group": "h"}]
    got = readers.lanes(spark, dump(tmp_path / "l.json", {"schema_version": 2, "lanes": lanes})).collect()
    assert {r.lane_id: r.fault for r in got} == {"a": None, "b": None, "c": "unpaired_group"}
    (tmp_path / "m.xml").write_text('<container><testcase><file path="x.c"><flaw line="7" name="CWE-121: Stack"/></file></testcase></container>')
    assert [(r.file, r.line) for r in readers.flaw_manifest(spark, str(tmp_path / "m.xml"), "CWE-121").collect()] == [("x.c", 7)]


def test_promotion(spark):
    states = spark.createDataFrame([(c, "memory_access", "candidate", []) for c in "abcd"], "candidate_id string, backend string, status string, blockers array<string>").withColumn("expected_effect", F.lit(None).cast("string")).withColumn("effect_kind", F.lit(None).cast("string"))
    proofs = spark.createDataFrame([("a", "memory_access", "proven", True, "write", None), ("b", "memory_access", "refuted", False, None, None), ("c", "memory_access", "proven", None, "write", None)], "candidate_id string, backend string, status string, exact_operation_reached boolean, memory_access string, blocker string")
    for c in ("lifetime_violation", "scope", "process_setup", "concrete_input", "effect_observation", "static_evidence"):
        proofs = proofs.withColumn(c, F.lit(None).cast("string"))
    got = evidence.promote(states, proofs).cache()
    assert {r.candidate_id: (r.status, r.blockers) for r in got.collect()} == {"a": ("report_ready", []), "b": ("rejected", []), "c": ("candidate", ["proof_proven"]), "d": ("candidate", [])}
    assert evidence.promotion_events(got, F.lit("now")).count() == 2
    replays = spark.createDataFrame([("a", "blocked", False, False, False, 1), ("a", "confirmed", True, True, False, 2), ("a", "confirmed", True, True, True, 3)], "candidate_id string, result string, sink_reached boolean, bug_observed boolean, crash_observed boolean, n int")
    assert evidence.best_replay(replays, F.col("n")).first().n == 2


def test_block_relation(spark):
    blocks = spark.createDataFrame([("f", 0, 9), ("f", 10, 19)], "function string, start long, end long")
    pairs = spark.createDataFrame([("f", 1, 2, 5), ("f", 2, 5, 2), ("f", 3, 2, 12), ("f", 4, 2, 99)], "function string, id int, before long, after long")
    assert {r.id: r.relation for r in discovery.block_relation(blocks, pairs).collect()} == {1: "same_block_before", 2: "same_block_after", 3: "different_blocks", 4: "unresolved_block"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "id int, v string")
    writers.write_table(df, str(tmp_path / "t"), "id")
    with pytest.raises(ValueError, match="not unique"):
        writers.write_table(df.union(df), str(tmp_path / "u"), "id")
    writers.write_envelope(df, str(tmp_path / "e"), "rows", 2, "id")
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "e")).collect()] == [{"schema_version": 2, "rows": [{"id": 1, "v": "x"}, {"id": 2, "v": None}]}]
    writers.write_csv(df, str(tmp_path / "c"))
    writers.append_log(df, str(tmp_path / "log"), "id")
    writers.append_log(df, str(tmp_path / "log"), "id")
    assert spark.read.parquet(str(tmp_path / "log")).select("record_id").distinct().count() == 2
    assert writers.markdown(df.orderBy("id"), "T").endswith("| 1 | x |\n| 2 |  |\n")


def test_streams_equal_batch(spark, tmp_path):
    from tallyforge.queries import ledger

    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    events = streams.read_stream(spark, path, schema, "events.parquet")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "acquire").when(kind == "purchase", "release").when(kind == "error", "scope_exit").otherwise("use")
    got = streams.drain(streams.ledger_stream(events, F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")), action), "ledger_rows", "append", str(tmp_path / "cp"))
    pick = lambda df: sorted(map(str, df.groupBy("action", "generation", "live_before", "violation").count().collect()))
    assert pick(got) == pick(ledger(spark, path))
    counts = streams.drain(streams.window_counts(events, "ts", ["event_type"], "1 day"), "window_rows", "complete", str(tmp_path / "cp2"))
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{path}/events.parquet").count()


def test_lifetimes_read_statements_once(spark):
    from tallyforge.plans import extract

    text = "void f(void) {\n char *h = malloc(8);\n free(h); h[0] = 1;\n free(h);\n char *g = malloc(4);\n g[1] = h; g[2] = h;\n return h;\n}"
    rows = extract.statements(spark.createDataFrame([("f", text), ("e", "void e(int a) { free(a); return; }")], "function string, text string"))
    events = extract.lifetime_events(rows)
    assert sorted((r.line, r.identity, r.action) for r in events.collect()) == [
        (1, "a", "release"), (2, "h", "acquire"), (3, "h", "release"), (4, "h", "release"), (5, "g", "acquire"), (6, "g", "use"), (6, "h", "use"), (7, "g", "scope_exit"),
    ]
    assert {(r.line, r.target, r.vulnerability_type) for r in extract.lifetime(rows).collect()} == {(4, "h", "double_free"), (6, "h", "use_after_free"), (7, "g", "memory_leak")}
    assert events._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_findings_of_functions_are_gathered_once(spark):
    from tallyforge.plans import proof

    c = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "candidate_id int, function string")
    tools = spark.createDataFrame([("f", "scan", "b"), ("f", "scan", "a")], "function string, tool string, finding string")
    packs = proof.evidence_packs(c, spark.createDataFrame([("f", "x")], "function string, name string"), tools)
    assert {r.candidate_id: [x.finding for x in r.pack.tools] for r in packs.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: []}


def test_ranges_of_loops_join_by_values(spark):
    from tallyforge.plans import extract

    text = "void f(int u) {\n char a[8];\n int i;\n for (i = 0; i < 8; i++) {\n a[i] = u;\n }\n for (i = 0; i < 9; i++) {\n a[i] = u;\n }\n a[i] = 1;\n}"
    got = extract.spatial(spark.createDataFrame([("f", text)], "function string, text string"))
    assert {(r.line, r.relation) for r in got.where("kind = 'index_write'").collect()} == {(5, "proven_safe"), (8, "symbolic_offset"), (10, "symbolic_offset")}
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().analyzed().toString()
