"""Queries of sources, sinks, C text and graphs: artifacts are made from the driver's tables, written, and read by the library's readers.

Artifacts go into the session's warehouse, one folder per artifact and input, written anew each time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clex
from .operators import cfg, graph, scheduling
from .plans import discovery, evidence
from .queries import query, t
from .sources import dims, readers, writers


def folder(spark: SparkSession, d: str, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/artifacts/{name}_{hashlib.sha256(d.encode()).hexdigest()[:12]}"


def documents_of(df: DataFrame, path: str) -> str:
    """One JSON document a file."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)
    return path


def text_of(df: DataFrame, column: Column, path: str) -> str:
    df.select(column.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def exports(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the functions of their brand's binary, written as exports and read back."""
    key, size = F.col("p_partkey"), F.col("p_size")
    address = F.concat(F.lit("0x00"), F.hex(key + 4096))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    call = F.struct(F.concat(F.lit("0X"), F.hex(key * 16 + 7)).alias("call_address"), F.when(size % 2 == 0, "std::memcpy@GLIBC").otherwise(F.concat(F.lit("f"), (key + 1).cast("string"))).alias("callee"), F.array(F.struct(F.concat(F.lit("(char *)"), F.col("p_type")).alias("repr")), F.struct(F.col("p_name").alias("repr"))).alias("args"))
    region = F.struct((-size).alias("start_offset"), F.lit(0).alias("end_offset"), size.alias("size_bytes"), F.when(size > 10, F.array(F.lit("buf"))).otherwise(none("string")).alias("var_names"))
    string = F.struct(address.alias("address"), F.col("p_name").alias("value"))
    f = F.struct(
        address.alias("address"), F.when(size > 5, F.concat(F.lit("f"), key.cast("string"))).otherwise(" ").alias("name"), F.when(size < 40, size).alias("ordinal"), F.when(size > 30, True).alias("is_thunk"), F.when(size > 3, size).alias("line_count"),
        F.when(size > 45, "known").alias("source_symbol"), F.array(call).alias("pcode_calls"), F.array(region).alias("stack_regions"), F.array(string).alias("string_refs"),
    )
    made = t(spark, d, "part").groupBy(F.col("p_brand").alias("binary")).agg(F.lit("0x1000").alias("image_base"), F.lit(8).alias("pointer_size_bytes"), F.collect_list(f).alias("functions"))
    return readers.functions(spark, documents_of(made, folder(spark, d, "exports")))


FUNCTIONS_SQL = """f AS (SELECT p_brand AS "binary", '0x' || lower(to_hex(p_partkey + 4096)) AS address, p_partkey AS relative_address, CASE WHEN p_size > 5 THEN 'f' || p_partkey ELSE 'FUN_' || lower(to_hex(p_partkey + 4096)) END AS name,
    coalesce(p_size > 30, FALSE) AS is_thunk, CASE WHEN p_size > 3 THEN p_size ELSE 0 END AS line_count, CASE WHEN p_size < 40 THEN p_size ELSE 1000000 END AS ordinal, p_size, p_partkey, p_type, p_name FROM part)"""


@query(f"""WITH {FUNCTIONS_SQL} SELECT "binary", address, relative_address, name, is_thunk, line_count, ordinal FROM f""")
def export_functions(spark: SparkSession, d: str) -> DataFrame:
    return exports(spark, d).select("binary", "address", "relative_address", "name", "is_thunk", "line_count", "ordinal")


@query(f"""WITH {FUNCTIONS_SQL}, s AS (SELECT '0x' || lower(to_hex(s_suppkey + 4096)) AS address, s_name FROM supplier) SELECT "binary", f.address, CASE WHEN p_size > 45 THEN 'known' ELSE s_name END AS source_symbol FROM f LEFT JOIN s ON f.address = s.address""")
def symbol_sidecar(spark: SparkSession, d: str) -> DataFrame:
    side = t(spark, d, "supplier").select(F.hex(F.col("s_suppkey") + 4096).alias("address"), F.col("s_name").alias("symbol"))
    return readers.with_symbols(exports(spark, d), side).select("binary", "address", "source_symbol")


@query(f"""WITH {FUNCTIONS_SQL} SELECT DISTINCT a."binary", a.name AS src, b.name AS dst FROM f a JOIN f b ON a."binary" = b."binary" AND b.name = 'f' || (a.p_partkey + 1) WHERE a.p_size % 2 = 1""")
def export_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.pcode_edges(exports(spark, d))


TEXT_SQL = "SELECT p_brand AS \"binary\", 'f' || p_partkey AS src, 'f' || (p_partkey {0}) AS dst FROM part WHERE {1}"


@query(f"""WITH e AS ({TEXT_SQL.format('+ 1', 'TRUE')} UNION {TEXT_SQL.format('+ 0', "p_size > 25")} UNION {TEXT_SQL.format('+ 25', 'TRUE')}), n AS (SELECT p_brand AS "binary", 'f' || p_partkey AS dst FROM part)
    SELECT e."binary", src, e.dst, CASE WHEN CAST(substr(e.dst, 2) AS BIGINT) - CAST(substr(src, 2) AS BIGINT) = 25 THEN 'thread' ELSE 'call' END AS kind FROM e JOIN n ON e."binary" = n."binary" AND e.dst = n.dst""")
def text_call_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda i: F.concat(F.lit("f"), (k + i).cast("string"))
    text = F.concat(F.lit("int "), name(0), F.lit("(int a) { /* "), name(2), F.lit("(0) */ puts(\""), name(3), F.lit("(1)\"); // "), name(4), F.lit("()\n "), name(1), F.lit(" (a); "), F.when(F.col("p_size") > 25, F.concat(name(0), F.lit("(a - 1);"))).otherwise(""), F.lit(" pthread_create(&t, NULL, (void *)"), name(25), F.lit(", 0); }"))
    sources = t(spark, d, "part").select(F.col("p_brand").alias("binary"), name(0).alias("name"), text.alias("text"))
    names = sources.select("binary", "name")
    return readers.text_call_edges(sources, names).withColumn("kind", F.lit("call")).unionByName(readers.thread_edges(sources, names).withColumn("kind", F.lit("thread")))


@query("""SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS src, n_name AS dst FROM nation""")
def cached_call_graph(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("k")).agg(F.collect_list("n_name").alias("v"))
    made = n.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("edges"))
    return readers.cached_edges(spark, documents_of(made, folder(spark, d, "call_graph")))


@query("""SELECT DISTINCT lower(unnest([n_name, n_name || '2'])) AS alias, n_name AS name, 'r' || n_regionkey AS semantics FROM nation""")
def operation_specs(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("n_name").alias("name"), F.lit("memory").alias("backend"), F.array(F.concat(F.lit("libc::"), "n_name", F.lit("2@V")), F.concat(F.lit("__"), "n_name")).alias("aliases"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("semantics"), F.lit("write").alias("effect_kind"))
    made = t(spark, d, "nation").agg(F.lit(12).alias("schema_version"), F.collect_list(row).alias("operations"))
    return readers.operation_specs(spark, documents_of(made, folder(spark, d, "specs"))).select("alias", "name", "semantics")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, CASE s_nationkey % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'inconclusive' ELSE 'refuted' END AS status FROM supplier""")
def proof_scan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey") % 3
    row = F.struct(F.col("s_suppkey").cast("string").alias("candidate_id"), F.when(n == 0, "proven").when(n == 1, "certainly").otherwise("refuted").alias("status"))
    made = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.lit(2).alias("schema_version"), F.collect_list(row).alias("results")).drop("s_nationkey")
    return readers.proofs(spark, documents_of(made, folder(spark, d, "proofs"))).select("candidate_id", "status")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, 'c' || s_nationkey AS mechanism, s_acctbal > 0 AS sink_reached, s_name AS artifact FROM supplier""")
def candidate_and_replay_scan(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    row = F.struct(F.col("s_suppkey").cast("string").alias("candidate_id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("mechanism"))
    made = s.groupBy("s_nationkey").agg(F.lit(2).alias("schema_version"), F.collect_list(row).alias("candidates")).drop("s_nationkey")
    states = readers.candidates(spark, documents_of(made, folder(spark, d, "candidates")))
    replays = s.select(F.col("s_suppkey").cast("string").alias("candidate_id"), (F.col("s_acctbal") > 0).alias("sink_reached"), F.array("s_name").alias("artifacts"), F.col("s_nationkey").alias("part"))
    path = folder(spark, d, "replays")
    replays.write.mode("overwrite").partitionBy("part").option("maxRecordsPerFile", 1).json(path)
    return states.select("candidate_id", "mechanism").join(readers.replays(spark, path).select("candidate_id", "sink_reached", F.element_at("artifacts", 1).alias("artifact")), "candidate_id")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS schema_version, CASE WHEN s_nationkey % 2 = 0 THEN '' WHEN s_acctbal > 0 THEN 'v' ELSE '' END AS variant_id FROM supplier""")
def schedule_scan(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("s_suppkey").cast("string").alias("candidate_id"), F.when(F.col("s_acctbal") > 0, "v").alias("variant_id"))
    made = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(row).alias("attempts")).select((F.col("s_nationkey") % 2 + 1).alias("schema_version"), "attempts")
    return readers.schedules(spark, documents_of(made, folder(spark, d, "schedules"))).select("candidate_id", "schema_version", "variant_id")


@query("""WITH l AS (SELECT c_name AS lane_id, CASE c_nationkey WHEN 1 THEN 'vulnerable' WHEN 2 THEN 'fixed' ELSE 'other' END AS role, c_mktsegment || c_nationkey // 2 AS grp FROM customer),
    g AS (SELECT grp, count(*) FILTER (role = 'vulnerable') = 1 AND count(*) FILTER (role = 'fixed') = 1 AS one FROM l GROUP BY 1) SELECT lane_id, CASE WHEN role = 'other' THEN 'unknown_role' WHEN NOT one THEN 'unpaired_group' END AS fault FROM l JOIN g USING (grp)""")
def lane_scan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    row = F.struct(F.col("c_name").alias("lane_id"), F.when(n == 1, "vulnerable").when(n == 2, "fixed").otherwise("other").alias("role"), F.concat("c_mktsegment", F.floor(n / 2).cast("string")).alias("comparison_group"))
    made = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.lit(2).alias("schema_version"), F.collect_list(row).alias("lanes")).drop("c_mktsegment")
    return readers.lanes(spark, documents_of(made, folder(spark, d, "lanes"))).select("lane_id", "fault")


@query("""SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS "binary", c_name AS function, CASE WHEN c_acctbal > 5000 THEN 'positive' WHEN c_acctbal > 0 THEN 'negative' ELSE 'ignored' END AS kind FROM customer""")
def truth_scan(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    some = lambda c: F.collect_list(F.when(c, F.col("c_name")))
    made = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("binary")).agg(some(b > 5000).alias("positives"), some((b > 0) & (b <= 5000)).alias("negatives"), some(b <= 0).alias("ignored"))
    return readers.ground_truth(spark, documents_of(made, folder(spark, d, "truth")))


@query("""SELECT 'n' || s_nationkey || '.c' AS file, CAST(s_suppkey + 1 AS INTEGER) AS line, 'CWE-121: ' || s_name AS name FROM supplier WHERE s_acctbal > 0""")
def flaw_scan(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") > 0, "CWE-121: ").otherwise("CWE-122: ")
    flaw = F.concat(F.lit("<flaw line=\""), (F.col("s_suppkey") + 1).cast("string"), F.lit("\" name=\""), kind, F.col("s_name"), F.lit("\"/>"))
    case = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(flaw), "").alias("x"))
    line = F.concat(F.lit("<container><testcase><file path=\"n"), F.col("s_nationkey").cast("string"), F.lit(".c\">"), F.col("x"), F.lit("</file></testcase></container>"))
    return readers.flaw_manifest(spark, text_of(case, line, folder(spark, d, "flaws")), "CWE-121")


@query("""WITH l AS (SELECT user_id, event_id, '{"operation_address":"0X0' || upper(to_hex(event_id)) || '","event":"é' || event_type || '"}' AS line FROM events), o AS (SELECT user_id, event_id, sum(strlen(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id) - strlen(line) - 1 AS p FROM l)
    SELECT user_id, CAST(p AS BIGINT) AS "offset", '0x' || lower(to_hex(event_id)) AS operation_address, 'é' || event_type AS event FROM o JOIN events USING (user_id, event_id)""")
def trace_scan(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit('{"operation_address":"0X0'), F.hex("event_id"), F.lit('","event":"é'), F.col("event_type"), F.lit('"}'))
    each = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x")).select("user_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("value"))
    path = folder(spark, d, "traces")
    each.write.mode("overwrite").partitionBy("user_id").option("maxRecordsPerFile", 1).text(path)
    hits = readers.trace_hits(spark, path)
    return hits.select(F.regexp_extract("trace", r"user_id=(\d+)", 1).cast("long").alias("user_id"), "offset", "operation_address", "event")


@query("""SELECT c_custkey, 'o' || c_custkey AS object, unnest(['list', 'set']) AS method, unnest(['name', 'value']) AS field, unnest(['String', 'Integer']) AS type FROM customer UNION ALL SELECT c_custkey, 'o' || c_custkey, 'drop', NULL, NULL FROM customer""")
def method_listings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("'o"), F.col("c_custkey").cast("string"), F.lit("' @1\n\t\"list\":{\"name\":\"String\"}\n\n\t\"set\":{\"value\":\"Integer\"}\n\t\"drop\":{}"))
    return readers.verbose_methods(t(spark, d, "customer").select("c_custkey", text.alias("out")), "c_custkey", "out")


@query("""WITH f AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '/etc/init.d/s' WHEN 1 THEN '/app/x.conf' ELSE '/app/y.bin' END || c_custkey AS p, c_nationkey FROM customer)
    SELECT p AS path, CASE WHEN c_nationkey % 3 = 0 THEN 'service' ELSE 'config' END AS kind, CASE WHEN c_nationkey % 3 = 0 THEN '/bin/d' || c_custkey || ':8080' ELSE 'KEY_' || c_nationkey || ',PATH' END AS found
    FROM (SELECT CASE WHEN c_nationkey % 3 = 1 THEN '/app/' || c_custkey || '.conf' ELSE p END AS p, c_nationkey, c_custkey FROM f) WHERE c_nationkey % 3 < 2""")
def intake_inventories(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    path = F.when(n % 3 == 0, F.concat(F.lit("/etc/init.d/s"), k)).when(n % 3 == 1, F.concat(F.lit("/app/"), k, F.lit(".conf"))).otherwise(F.concat(F.lit("/app/y.bin"), k))
    text = F.concat(F.lit("exec /bin/d"), k, F.lit("\nport=8080\nexport PATH=1\nKEY_"), n.cast("string"), F.lit("=2\nlower=3"))
    files = t(spark, d, "customer").select(path.alias("path"), text.alias("text"))
    s = readers.service_inventory(files).select("path", F.lit("service").alias("kind"), F.concat_ws(":", F.element_at("commands", 1), F.element_at("ports", 1).cast("string")).alias("found"))
    return s.unionByName(readers.config_inventory(files).select("path", F.lit("config").alias("kind"), F.array_join("env_keys", ",").alias("found")))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\\x20-\\x7e]', chr(10), 'g'), '[\\x20-\\x7e]{12,}')) AS value FROM documents) SELECT DISTINCT 'd' || doc_id AS path, value FROM x""")
def printable_strings(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.binary_strings(files, 12).select("path", "value")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'missing:p_x' AS fault FROM part WHERE p_size <= 10 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'domain:p_type' FROM part WHERE p_type <> 'ECONOMY'""")
def dimension_checks(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") > 10, 1).alias("p_x"))
    return dims.dimension_faults(p, "p_partkey", ["p_x"], {"p_type": ["ECONOMY"]})


@query("""WITH r AS (SELECT p_brand AS function, p_partkey AS start_offset, p_size AS s, 'v' || p_partkey AS var_name, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) - p_partkey AS room FROM part)
    SELECT function, var_name, start_offset, CAST(greatest(s, least(CASE WHEN s > 20 THEN 4 * s ELSE s END, coalesce(room, CASE WHEN s > 20 THEN 4 * s ELSE s END))) AS BIGINT) AS size_bytes FROM r""")
def repaired_regions(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    text = F.concat(F.lit("void f(void) {\n  unsigned int v"), F.col("p_partkey").cast("string"), F.lit("["), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("0x"), F.hex("p_size"))).otherwise(F.col("p_size").cast("string")), F.lit("];\n}"))
    declared = dims.declared_arrays(p.where("p_size > 20").select(F.col("p_brand").alias("name"), text.alias("text")))
    regions = p.select(F.col("p_brand").alias("function"), F.col("p_partkey").alias("start_offset"), F.col("p_size").cast("long").alias("size_bytes"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("var_name"))
    return dims.repaired_regions(regions, declared).select("function", "var_name", "start_offset", "size_bytes")


@query("""SELECT p_partkey, p_size::BIGINT * 4 + 6 AS constant, 4 AS length, 'memcpy(dst,"a,(b",f(1, ' || p_partkey || '));f(1,' || p_partkey || ')' AS calls, '  ' || chr(10) || ' x = 1;  ' || chr(10) || '  y' AS stripped FROM part""")
def c_text(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    code = F.concat(F.lit('/* f(9) */ memcpy(dst, "a,(b", f(1, '), k, F.lit(")); if (x) {}"))
    out = t(spark, d, "part").select("p_partkey", clex.constant_udf(F.concat(F.lit("("), n, F.lit(" << 2) + 0x10 / 2 - (7 & 3) + ~0 + 2"))).alias("constant"), clex.string_length_udf(F.lit('"ab\\n" "\\x41cde"')).alias("length"), clex.calls_udf(code).alias("c"), clex.strip_comments_udf(F.lit(" /* a\n */ x = 1; // b\n  y")).alias("stripped"))
    calls = F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("("), F.array_join(x["args"], ","), F.lit(")"))), ";")
    return out.select("p_partkey", "constant", F.col("length").cast("int").alias("length"), calls.alias("calls"), "stripped")


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Each brand a function whose blocks are its parts in order, each leading to the next; large ones also to the one after."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = t(spark, d, "part").select("p_brand", "p_partkey", "p_size", F.lead("p_partkey").over(w).alias("n1"), F.lead("p_partkey", 2).over(w).alias("n2"), (F.row_number().over(w) == 1).alias("entry"))
    return p.select(F.col("p_brand").alias("function"), F.col("p_partkey").alias("block"), "entry", F.array_compact(F.array("n1", F.when(F.col("p_size") > 25, F.col("n2")))).alias("successors"), "p_size")


FLOW_SQL = """WITH RECURSIVE b AS (SELECT p_brand AS function, p_partkey AS block, p_size, lead(p_partkey) OVER w AS n1, lead(p_partkey, 2) OVER w AS n2, row_number() OVER w AS k FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
    e AS (SELECT function, block AS src, n1 AS dst FROM b WHERE n1 IS NOT NULL UNION SELECT function, block, n2 FROM b WHERE n2 IS NOT NULL AND p_size > 25),"""


@query(FLOW_SQL + """ d AS (SELECT b.function, b.block, x.block AS dominator FROM b JOIN b x ON b.function = x.function AND x.k <= b.k
      AND (x.block = b.block OR NOT EXISTS (SELECT 1 FROM e JOIN b s ON e.src = s.block AND e.function = s.function JOIN b q ON e.dst = q.block AND q.function = e.function WHERE e.function = b.function AND s.k < x.k AND q.k > x.k AND q.k <= b.k)))
    SELECT function, block, dominator FROM d""")
def block_dominators(spark: SparkSession, d: str) -> DataFrame:
    return graph.dominators(flow(spark, d).drop("p_size"), ["function"])


@query(FLOW_SQL + """ q AS (SELECT function, min(block) AS source, max(block) AS target, arg_min(block, k) FILTER (k = 3) AS stop FROM b GROUP BY 1),
    r AS (SELECT function, source AS node, target, stop FROM q UNION SELECT r.function, e.dst, r.target, r.stop FROM r JOIN e ON r.function = e.function AND r.node = e.src WHERE (e.dst = r.target OR e.dst IS DISTINCT FROM r.stop) AND r.node <> r.target)
    SELECT q.function, EXISTS (SELECT 1 FROM r WHERE r.function = q.function AND r.node = q.target) AS reachable FROM q""")
def paths_avoiding_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = flow(spark, d)
    place = F.row_number().over(Window.partitionBy("function").orderBy("block"))
    asked = f.withColumn("k", place).groupBy("function").agg(F.lit(1).alias("id"), F.min("block").alias("source"), F.max("block").alias("target"), F.array_compact(F.array(F.max(F.when(F.col("k") == 3, F.col("block"))))).alias("barriers"))
    return cfg.paths_avoiding(f.select("function", "block", "successors"), asked).select("function", "reachable")


@query("""WITH RECURSIVE g AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst FROM customer JOIN supplier ON c_custkey = s_suppkey),
    s AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS function, 'p' AS expression, 'write' AS effect FROM supplier WHERE s_acctbal > 5000),
    r(function, expression, depth) AS (SELECT function, expression, 0 FROM s UNION SELECT g.src, '(' || expression || '+1)', depth + 1 FROM r JOIN g ON g.dst = r.function WHERE depth < 3)
    SELECT DISTINCT function, expression FROM r""")
def carried_summaries(spark: SparkSession, d: str) -> DataFrame:
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    sites = c.join(s, c["c_custkey"] == s["s_suppkey"]).select(F.col("c_nationkey").cast("string").alias("caller"), F.col("s_nationkey").cast("string").alias("callee")).distinct()
    first = s.where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("function"), F.lit("p").alias("expression"), F.lit("write").alias("effect")).distinct()
    out = cfg.propagate_summaries(first, sites, F.concat(F.lit("("), "expression", F.lit("+1)")), depth=3, per_function=1000)
    return out.select("function", "expression").distinct()


def index_operations(spark: SparkSession, f: DataFrame) -> DataFrame:
    specs = spark.createDataFrame([("memcpy", "memory_copy", "copy", "write")], "alias string, name string, semantics string, effect_kind string")
    empty = F.array().cast("array<struct<operation_address:string,write_width:int,read_width:int,address_vars:array<string>,address_constants:array<bigint>,pcode:string>>")
    return discovery.operations(f.withColumn("pcode_stores", F.coalesce("pcode_stores", empty)).withColumn("pcode_loads", F.coalesce("pcode_loads", empty)), specs)


@query(f"""WITH {FUNCTIONS_SQL} SELECT "binary", name AS function, '0x' || lower(to_hex(p_partkey * 16 + 7)) AS address, 'call' AS kind, CASE WHEN p_size % 2 = 0 THEN 'memory_copy' ELSE 'f' || (p_partkey + 1) END AS name, CASE WHEN p_size % 2 = 0 THEN 'copy' END AS semantics FROM f""")
def program_operations(spark: SparkSession, d: str) -> DataFrame:
    return index_operations(spark, exports(spark, d)).select("binary", "function", "address", "kind", "name", "semantics")


@query(f"""WITH {FUNCTIONS_SQL} SELECT "binary", name AS function, CASE WHEN p_size > 10 THEN 'buf' WHEN p_size = 0 THEN 'stack+0x0' ELSE 'stack-0x' || lower(to_hex(p_size)) END AS object, CAST(p_size AS BIGINT) AS capacity_bytes FROM f""")
def stack_objects(spark: SparkSession, d: str) -> DataFrame:
    out = discovery.memory_objects(exports(spark, d))
    size = "capacity_bytes" if "capacity_bytes" in out.columns else "size_bytes"
    return out.select("binary", "function", F.col("name").alias("object"), F.col(size).alias("capacity_bytes"))


@query(f"""WITH {FUNCTIONS_SQL} SELECT "binary", name AS function, address, substr(sha256(p_name), 1, 16) AS fingerprint, '0x' || lower(to_hex(p_partkey * 16 + 7)) AS call_address, CASE WHEN p_size % 2 = 0 THEN 'memory_copy' ELSE 'f' || (p_partkey + 1) END AS name,
    CASE WHEN contains('(char *)' || p_type, p_name) THEN 0 ELSE 1 END AS position FROM f""")
def literal_uses(spark: SparkSession, d: str) -> DataFrame:
    f = exports(spark, d)
    return discovery.literal_consumers(discovery.strings(f), index_operations(spark, f)).select("binary", "function", "address", "fingerprint", "call_address", "name", "position")


@query(f"""WITH {FUNCTIONS_SQL} SELECT 'f' || (p_partkey + 1) AS name, count(*) AS n, "binary" || ':' || any_value(name) || ':0x' || lower(to_hex(any_value(p_partkey) * 16 + 7)) AS examples FROM f WHERE p_size % 2 = 1 GROUP BY p_partkey, "binary" ORDER BY n DESC, 1 LIMIT 20""")
def unknown_calls(spark: SparkSession, d: str) -> DataFrame:
    return discovery.sink_audit(index_operations(spark, exports(spark, d))).select("name", "n", F.array_join("examples", ",").alias("examples"))


@query("""WITH b AS (SELECT user_id, min(epoch_us(ts)) AS lo FROM events GROUP BY 1), x AS (SELECT event_id, user_id, epoch_us(ts) // 3600000000 AS h, lead(epoch_us(ts) // 3600000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS h2, epoch_us(ts) AS "at", lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at2 FROM events)
    SELECT event_id, CASE WHEN h <> h2 THEN 'different_blocks' WHEN "at" < at2 THEN 'same_block_before' ELSE 'same_block_after' END AS relation FROM x WHERE at2 IS NOT NULL""")
def block_relations(spark: SparkSession, d: str) -> DataFrame:
    at, hour = F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000
    e = t(spark, d, "events").select(F.col("user_id").alias("function"), "event_id", at.alias("before"), F.lead(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("after"))
    start = F.floor(F.col("before") / hour).cast("long") * hour
    blocks = e.select("function", start.alias("start")).distinct().withColumn("end", F.col("start") + hour - 1)
    return discovery.block_relation(blocks, e.where("after IS NOT NULL").withColumnRenamed("event_id", "id")).select(F.col("id").alias("event_id"), "relation")


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'local_source' WHEN c_nationkey < 10 THEN 'source_path' WHEN c_nationkey < 15 THEN 'entry_path' ELSE 'unknown' END AS reach, c_nationkey % 4 = 1 OR c_nationkey < 3 AS transparent FROM customer""")
def reach_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    path = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    none = lambda x: F.lit(None).cast("string").alias(x)
    c = t(spark, d, "customer").select("c_custkey", (n < 5).alias("has_local_source"), path(n < 10).alias("source_path"), path(n < 15).alias("entry_path"), (n % 4 == 1).alias("is_thunk"), none("wrapper_type"), none("stub_kind"), F.when(n < 3, 4).otherwise(90).alias("line_count"),
        F.when(n < 3, 1).otherwise(2).alias("callees"), F.lit(True).alias("has_store"), F.lit(False).alias("has_control"), F.lit(False).alias("has_assignment"), none("label"))
    return c.select("c_custkey", evidence.reachability_kind().alias("reach"), graph.transparent(c).alias("transparent"))


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, CAST(round(p_retailprice * 10) AS BIGINT) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part),
    r AS (SELECT p_brand, p_partkey, k, c <= 200000 AS selected, CASE WHEN c <= 200000 THEN c ELSE 0 END AS spent FROM o WHERE k = 1 UNION ALL
      SELECT o.p_brand, o.p_partkey, o.k, r.spent + o.c <= 200000, CASE WHEN r.spent + o.c <= 200000 THEN r.spent + o.c ELSE r.spent END FROM r JOIN o ON o.p_brand = r.p_brand AND o.k = r.k + 1)
    SELECT p_brand, p_partkey, k AS rank, selected, CAST(spent AS DOUBLE) AS spent FROM r""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("score"), F.round(F.col("p_retailprice") * 10).alias("cost"))
    return scheduling.budget_schedule(p, ["p_brand"], "score", "p_partkey", "cost", 200_000.0).select("p_brand", "p_partkey", "rank", "selected", "spent")


# sinks, read back


@query("""SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS nation FROM customer""")
def table_and_json_sinks(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("nation"))
    table, lines, rows = (folder(spark, d, f"sink_{x}") for x in ("table", "json", "csv"))
    writers.write_table(c, table, "c_custkey")
    writers.write_json(spark.read.parquet(table), lines)
    writers.write_csv(spark.read.schema(c.schema).json(lines), rows)
    return spark.read.schema(c.schema).option("header", True).csv(rows)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id, CASE WHEN s_acctbal > 5000 THEN 'proven' ELSE 'refuted' END AS status FROM supplier""")
def envelope_sink(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("candidate_id"), F.when(F.col("s_acctbal") > 5000, "proven").otherwise("refuted").alias("status"))
    path = folder(spark, d, "sink_envelope")
    writers.write_envelope(s, path, "results", 2, "candidate_id")
    return readers.proofs(spark, path).select("candidate_id", "status")


@query("""SELECT event_type, user_id, count(*) AS n, substr(sha256(event_type || '|' || user_id), 1, 16) AS record_id FROM events GROUP BY 1, 2""")
def log_and_document_sinks(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    log, docs = folder(spark, d, "sink_log"), folder(spark, d, "sink_documents")
    e.limit(0).withColumn("record_id", F.lit("")).write.mode("overwrite").parquet(log)
    for half in ("n < 15", "n >= 15"):
        writers.append_log(e.where(half), log, "event_type", "user_id")
    writers.write_documents(spark.read.parquet(log), docs, "event_type")
    return spark.read.schema("event_type string, user_id long, n long, record_id string").json(docs)
