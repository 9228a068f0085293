"""Queries of the rules over candidates, of evaluation, and of resolution, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import candidates as C
from .functions import records as R
from .functions import text as X
from .operators import evaluation, intervals, resolve, scheduling, selection
from .plans import evidence
from .queries import query, t

# a lineitem as a candidate: what stands for which field, in Spark and in SQL
KIND_SQL = "CASE l_linenumber WHEN 1 THEN 'read_index' WHEN 2 THEN 'pcode_load' WHEN 3 THEN 'source_read' ELSE 'store' END"
DEST_SQL = "CASE l_returnflag WHEN 'A' THEN 'Heap object' WHEN 'N' THEN 'stack_region' END"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
LINE_SQL = ", ".join(LINE)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem")


@query(f"""SELECT {LINE_SQL}, CASE WHEN ({KIND_SQL}) IN ('read_index', 'pcode_load', 'source_read') AND ({KIND_SQL}) <> 'source_read' THEN 'out_of_bounds_read'
    WHEN l_returnflag = 'A' THEN 'heap_overflow' WHEN l_returnflag = 'N' THEN 'stack_overflow' ELSE 'out_of_bounds_write' END AS memory_type FROM lineitem""")
def memory_type(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*LINE, C.memory_type(F.lit(None).cast("string"), F.expr(KIND_SQL), F.expr(DEST_SQL)).alias("memory_type"))


@query(f"""SELECT {LINE_SQL}, NOT (l_linestatus = 'O') OR coalesce(l_returnflag = 'R', FALSE) OR l_discount > 0.08 OR (l_suppkey > 5 AND l_tax > 0.03 AND l_quantity > 10) AS grounded FROM lineitem""")
def grounded_reads(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "O", "out_of_bounds_read").otherwise("stack_overflow")
    relation, verdict = F.when(F.col("l_returnflag") == "R", "proven_oob_read"), F.when(F.col("l_discount") > 0.08, "overflow")
    address = F.when(F.col("l_suppkey") > 5, F.col("l_suppkey").cast("string"))
    return lines(spark, d).select(*LINE, C.grounded_read(kind, relation, verdict, address, F.col("l_tax") > 0.03, F.col("l_quantity") > 10).alias("grounded"))


@query(f"""SELECT {LINE_SQL}, l_linestatus = 'O' AND (l_linenumber = 1 OR l_returnflag = 'N') AS weak FROM lineitem""")
def weak_objects(spark: SparkSession, d: str) -> DataFrame:
    verdict, split = F.when(F.col("l_linestatus") == "O", "overflow").otherwise("safe"), F.when(F.col("l_linenumber") == 1, "likely_decompiler_split")
    basis = F.when(F.col("l_returnflag") == "N", "Decompiler local").otherwise("declared")
    return lines(spark, d).select(*LINE, C.weak_object(verdict, split, basis, F.when(F.col("l_returnflag") == "N", "Fragment")).alias("weak"))


@query(f"""SELECT {LINE_SQL}, CASE l_linenumber WHEN 1 THEN 'CWE-125' WHEN 2 THEN 'CWE-190' WHEN 3 THEN 'CWE-798' WHEN 4 THEN 'CWE-862' ELSE
    CASE WHEN l_linestatus = 'O' THEN 'CWE-120' WHEN l_returnflag = 'N' THEN 'CWE-121' ELSE 'CWE-787' END END AS weakness FROM lineitem""")
def weakness_guess(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "out_of_bounds_read").when(n == 2, "integer_overflow_to_memory_access").when(n == 3, "hardcoded_credential").when(n == 4, "auth_bypass").otherwise("memory_overflow")
    return lines(spark, d).select(*LINE, C.guess_weakness(kind, F.lit("x"), F.when(F.col("l_linestatus") == "O", "StrCpy").otherwise("memcpy"), F.lit(None).cast("string"), F.expr(DEST_SQL)).alias("weakness"))


@query("""SELECT p_partkey, lower(coalesce(p_name, '') || chr(10) || coalesce(p_brand, '') || chr(10) || p_type || ' ' || p_size) AS haystack, lower(p_name || '(' || p_brand) LIKE '%(%' AND (lower(p_name) LIKE '%cold%' OR lower(p_brand) LIKE '%#1%') AS may_call FROM part""")
def haystacks(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    text = F.concat("p_name", F.lit("("), "p_brand")
    return p.select("p_partkey", C.haystack([F.col("p_name"), F.col("p_brand")], [F.array("p_type", F.col("p_size").cast("string"))]).alias("haystack"), C.may_call(text, ["cold", "#1"]).alias("may_call"))


@query("""SELECT event_id, event_type IN ('view', 'click') AS weak_crypto, CASE event_type WHEN 'signup' THEN TRUE WHEN 'purchase' THEN user_id % 2 = 0 WHEN 'error' THEN user_id % 3 = 0 AND value < 50 ELSE FALSE END AS tls_disabled FROM events""")
def call_predicates(spark: SparkSession, d: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    observed = F.when(kind == "view", "__MD5").when(kind == "click", "").otherwise("sha256")
    name = F.when(kind == "signup", "disable_tls_verify").when(kind == "purchase", "ssl_ctx_set_verify").when(kind == "error", "curl_easy_setopt").when(kind == "click", "_sha1").otherwise("open")
    mode = F.when(user % 2 == 0, "( SSL_VERIFY_NONE )").otherwise("SSL_VERIFY_PEER")
    option, value = F.when(user % 3 == 0, "CURLOPT_SSL_VERIFYHOST").otherwise("CURLOPT_URL"), F.when(F.col("value") < 50, "0UL").otherwise("1L")
    return t(spark, d, "events").select("event_id", C.weak_crypto(observed, name).alias("weak_crypto"), C.tls_disabled(name, mode, option, value).alias("tls_disabled"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN FALSE WHEN c_nationkey % 4 = 1 THEN len(list_distinct(string_split('0' || c_name, ''))) >= 8 ELSE FALSE END AS private_key FROM customer""")
def private_keys(spark: SparkSession, d: str) -> DataFrame:
    mode = F.col("c_nationkey") % 4
    body = F.base64(F.concat(F.when(mode == 0, "1").otherwise("0"), F.col("c_name")).cast("binary"))
    pem = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\\n"), body, F.when(mode == 2, "%").otherwise(""), F.lit("\n-----END "), F.when(mode == 3, "").otherwise("RSA "), F.lit("PRIVATE KEY-----"))
    return t(spark, d, "customer").select("c_custkey", C.private_key(pem).alias("private_key"))


@query("""SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 'memory_read' WHEN 'click' THEN 'memory_write' ELSE trim(regexp_replace('a ' || event_type || '()!', '[^a-z0-9]+', '_', 'g'), '_') END AS sink FROM events GROUP BY 1""")
def sink_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "ReadFile").when(kind == "click", "").otherwise(F.concat(F.lit("A "), F.upper(kind), F.lit("()!")))
    e = t(spark, d, "events").select(kind, C.sink_name(name, F.when(kind == "click", "pcode_STORE").otherwise("call")).alias("sink"))
    return e.groupBy("event_type", "sink").agg(F.count(F.lit(1)).alias("n")).select("event_type", "n", "sink")


@query("""SELECT conv_id, '[' || string_agg('"' || CASE role WHEN 'user' THEN 'input' WHEN 'assistant' THEN 'sink' ELSE 't' || turn END || '"', ',' ORDER BY turn, role, text) || ']' AS trace FROM conversations GROUP BY 1""")
def trace_token_lists(spark: SparkSession, d: str) -> DataFrame:
    step = F.struct(F.when(F.col("role") == "user", "input").otherwise("").alias("kind"), F.when(F.col("role") == "assistant", "sink").alias("role"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("r"), "text", step.alias("s"))))
    return t(spark, d, "conversations").groupBy("conv_id").agg(ordered.alias("x")).select("conv_id", C.trace_tokens(F.transform("x", lambda x: x["s"])).alias("trace"))


@query(r"""SELECT o_orderkey, trim(regexp_replace(lower('-' || o_orderpriority || '/É é' || o_orderstatus || '.'), '[^\p{L}\p{N}]', '_', 'g'), '_') AS label,
    'FUN at 0xADDR and fun_x ' || o_orderstatus AS pair_token, CASE o_orderstatus WHEN 'F' THEN 'process_input_model' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ambiguous' ELSE 'unsupported' END ELSE 'left' END AS category FROM orders""")
def label_normalizers(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("-"), "o_orderpriority", F.lit("/É é"), "o_orderstatus", F.lit("."))
    pair = F.concat(F.lit("fun_"), F.hex("o_orderkey"), F.lit(" at 0X"), F.hex("o_custkey"), F.lit(" and fun_x "), "o_orderstatus")
    reason = F.when(F.col("o_orderstatus") == "F", "unsupported_process_input_model:tty").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "two ambiguous inputs").otherwise("")).otherwise("left:right:x")
    return t(spark, d, "orders").select("o_orderkey", C.expectation_label(label).alias("label"), C.pair_token(pair).alias("pair_token"), C.unsupported_category(reason).alias("category"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'high' WHEN p_size < 10 THEN 'metadata' WHEN p_size < 20 THEN 'low' ELSE 'medium' END AS trust,
    CASE WHEN p_size % 5 > 0 THEN p_size END::BIGINT AS fixed_bytes, CASE WHEN p_size % 5 > 0 THEN '' ELSE p_name END AS symbolic_expr, p_size::BIGINT AS lower_bound FROM part""")
def capacity_models(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size < 10, "static_local").when(size < 20, "merged_frame_region").otherwise("heap")
    trust = C.object_trust(F.when(F.col("p_type") == "ECONOMY", "Declared array").otherwise("allocation"), kind)
    model = C.capacity_model(F.when(size % 5 > 0, size).otherwise(0), F.col("p_name"), size, F.lit(None).cast("int"), F.col("p_brand"), trust)
    return t(spark, d, "part").select("p_partkey", model.alias("m")).select("p_partkey", "m.trust", "m.fixed_bytes", "m.symbolic_expr", "m.lower_bound")


@query("""WITH r(arch, regs) AS (VALUES ('x86_64', ['rdi', 'rsi', 'rdx', 'rcx', 'r8', 'r9']), ('aarch64', ['x0', 'x1', 'x2', 'x3', 'x4', 'x5', 'x6', 'x7']), ('arm', ['r0', 'r1', 'r2', 'r3']), ('mips', []))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, arch, regs[l_linenumber + 1] AS register,
    CAST((18446744073709550000 + l_partkey::HUGEINT * l_linenumber + CAST(l_quantity AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS address
    FROM lineitem JOIN r ON arch = ['x86_64', 'aarch64', 'arm', 'mips'][1 + l_suppkey % 4]""")
def machine_addresses(spark: SparkSession, d: str) -> DataFrame:
    arch = F.element_at(F.array(*[F.lit(a) for a in ("x86_64", "aarch64", "arm", "mips")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    base = F.lit("18446744073709550000").cast("decimal(38,0)")
    where = C.effective_address(base, F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity"), 64)
    return lines(spark, d).select(*LINE, arch.alias("arch"), C.argument_register(arch, F.col("l_linenumber")).alias("register"), where.cast("string").alias("address"))


@query("""SELECT p_brand, round(count(*) FILTER (p_size > 25) / nullif(count(*), 0), 6) AS share, CAST(CASE WHEN count(*) FILTER (p_type = 'ECONOMY') = 0 THEN 0.0 ELSE 0.0078120 END AS DOUBLE) AS tie FROM part GROUP BY 1""")
def six_place_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("a"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_type") == "ECONOMY").alias("e"))
    return g.select("p_brand", C.ratio(F.col("a"), F.col("n")).alias("share"), C.ratio(F.lit(1), F.when(F.col("e") > 0, 128).otherwise(0)).alias("tie"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linenumber - 1 AS a, l_suppkey AS c, ['>=', '>', '<=', '<', '=='][1 + l_partkey % 5] AS op, l_returnflag = 'R' AS rej, CAST(l_quantity AS BIGINT) AS v FROM lineitem),
    y AS (SELECT *, CASE WHEN rej THEN CASE op WHEN '>=' THEN '<' WHEN '>' THEN '<=' WHEN '<=' THEN '>' WHEN '<' THEN '>=' END ELSE op END AS w, (v - c) / a AS e FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN a > 0 THEN CASE w WHEN '>=' THEN ceil(e) WHEN '>' THEN floor(e) + 1 END END::BIGINT AS lower,
      CASE WHEN a > 0 THEN CASE w WHEN '<=' THEN floor(e) WHEN '<' THEN ceil(e) - 1 END END::BIGINT AS upper FROM y""")
def linear_bounds(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(o) for o in (">=", ">", "<=", "<", "==")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    scale = F.nullif(F.col("l_linenumber") - 1, F.lit(0))
    b = C.linear_bound(scale, F.col("l_suppkey"), op, F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R")
    return lines(spark, d).select(*LINE, b["lower"].alias("lower"), b["upper"].alias("upper"))


@query("""SELECT page_id, replace(replace(url, 'http://', '/root/'), '/root/m.', '/mobile/') AS path FROM pages""")
def replaced_paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", C.replace_paths(F.col("url"), {"http://": "/root/", "/root/m.": "/mobile/"}).alias("path"))


@query("""WITH c AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, CASE conv_id % 3 WHEN 2 THEN string_agg('f' || k || ' -> g' || k, '; ' ORDER BY k) ELSE 'f0' || string_agg(' -> f' || k, '' ORDER BY k) END AS chain FROM c GROUP BY conv_id""")
def wrapper_chains(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    name = lambda i: F.concat(F.lit("f"), i.cast("string"))
    hop = lambda i: F.when(F.col("conv_id") % 3 == 2, F.struct(name(i).alias("caller"), F.concat(F.lit("g"), i.cast("string")).alias("callee"))).otherwise(F.struct(name(i - 1).alias("caller"), name(i).alias("callee")))
    hops = F.transform(F.sequence(F.lit(1), F.col("n")), hop)
    hops = F.when(F.col("conv_id") % 3 == 1, F.reverse(hops)).otherwise(hops)
    single = F.when((F.col("conv_id") % 3 == 2) & (F.col("n") == 1), F.concat(hops, hops)).otherwise(hops)
    return c.select("conv_id", F.when((F.col("conv_id") % 3 == 2) & (F.col("n") == 1), "f1 -> g1").otherwise(C.chain_text(single)).alias("chain"))


@query("""SELECT p_brand || '/' || p_type AS root, p_type AS payload, count(DISTINCT p_partkey) AS members, min(p_partkey) AS first_member FROM part GROUP BY 1, 2""")
def root_cause_groups(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("root"), "p_type", "p_partkey")
    return evaluation.root_causes(p, "root", F.col("p_type"), "p_partkey")


@query("""SELECT event_type, count(*) AS artifacts, count(*) FILTER (value > 40) AS accepted, count(*) FILTER (NOT coalesce(value > 40, FALSE)) AS rejected,
    count(*) FILTER (user_id % 7 = 0) AS missing_fixture, count(*) FILTER (user_id % 2 = 1) AS overrides FROM events GROUP BY 1""")
def hypothesis_metrics(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("user_id") % 7 == 0, "missing_fixture")
    return evaluation.system_metrics(t(spark, d, "events"), "event_type", F.col("value") > 40, reason, F.col("user_id") % 2 == 1)


@query("""SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS model_calls, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(coalesce(CASE WHEN l_suppkey > 2 THEN l_suppkey END, 0)) AS BIGINT) AS output_tokens,
    CAST(sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE l_partkey + coalesce(CASE WHEN l_suppkey > 2 THEN l_suppkey END, 0) END) AS BIGINT) AS total_tokens, CAST(sum(l_quantity) AS DOUBLE) AS wall_time_seconds FROM lineitem GROUP BY 1""")
def cost_totals(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")).otherwise(F.lit(0))
    return evaluation.cost_totals(lines(spark, d), ["l_returnflag"], F.col("l_linenumber"), F.col("l_partkey"), F.when(F.col("l_suppkey") > 2, F.col("l_suppkey")), total, F.col("l_quantity"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS completed_corpora, count(*) FILTER (o_orderstatus = 'P') AS skipped_corpora, CAST(sum(o_custkey) AS BIGINT) AS o_custkey, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END) AS BIGINT) AS proven FROM orders""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "skipped_missing").otherwise("failed")
    o = t(spark, d, "orders").select("o_orderstatus", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("proven"))
    return evaluation.corpus_totals(o, status, ["o_custkey", "proven"])


@query("""SELECT c_mktsegment, CAST(sum(c_nationkey) AS BIGINT) AS binaries, CAST(sum(CASE WHEN c_acctbal > 0 THEN c_custkey ELSE 0 END) AS BIGINT) AS reports FROM customer GROUP BY 1""")
def campaign_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").alias("binaries"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("reports"))
    return evaluation.sum_columns(c, ["c_mktsegment"], ["binaries", "reports"])


@query("""SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS candidates, CAST(sum(l_suppkey) AS BIGINT) AS reports, CAST(sum(l_quantity) AS DOUBLE) AS seconds, max(l_partkey) AS rss,
    count(*) FILTER (l_linenumber < 4) AS targets, count(*) FILTER (l_linenumber < 4 AND l_quantity > 30) AS target_hits FROM lineitem GROUP BY 1""")
def engine_totals(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_returnflag", F.col("l_linenumber").alias("candidates"), F.col("l_suppkey").alias("reports"), F.col("l_quantity").alias("seconds"), F.col("l_partkey").alias("rss"))
    return evaluation.engine_totals(li, "l_returnflag", ["candidates", "reports"], "seconds", "rss", F.when(F.col("candidates") < 4, F.col("seconds") > 30))


@query("""SELECT event_type AS rule, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1""")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rule_counts(t(spark, d, "events"), F.col("event_type"), ["view", "error", "absent"])


@query("""WITH a AS (SELECT event_type AS policy, user_id AS id, value, user_id % 4 AS m FROM events), k AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN TRUE WHEN c_nationkey < 18 THEN FALSE END AS expected FROM customer)
    SELECT policy, count(*) AS attempts, count(*) FILTER (m < 2) AS completed, count(*) FILTER (value > 20) AS reached, count(*) FILTER (value > 60) AS reports, count(DISTINCT a.id) FILTER (value > 60 AND expected) AS known_positive_reports,
      count(DISTINCT a.id) FILTER (value > 60 AND NOT expected) AS known_false_reports, count(*) FILTER (m = 3) AS setup_reuse, CAST(sum(a.id) AS DOUBLE) AS wall_seconds FROM a LEFT JOIN k ON a.id = k.id GROUP BY 1""")
def portfolio_rows(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("user_id") % 4
    a = t(spark, d, "events").select(F.col("event_type").alias("policy"), F.col("user_id").alias("id"), F.when(m == 0, "proven").when(m == 1, "refuted").otherwise("blocked").alias("status"), (F.col("value") > 20).alias("reached"), (F.col("value") > 60).alias("reported"), (m == 3).alias("setup_reused"), F.col("user_id").cast("double").alias("wall_seconds"))
    n = F.col("c_nationkey")
    return evaluation.evaluation_rows(a, t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(n < 10, True).when(n < 18, False).alias("expected")), "policy", "id")


@query("""SELECT p_brand, p_partkey, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size > 30) WHERE k <= 3""")
def oracle_bound(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.oracle_bound(t(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", F.col("p_size") > 30, 3)


BENCH_SQL = """WITH m AS (SELECT l_returnflag AS policy, count(*) AS repetitions, median(l_linenumber) AS reports, median(l_quantity) AS seconds FROM lineitem GROUP BY 1), b AS (SELECT reports AS br, seconds AS bs FROM m WHERE policy = 'N'), x AS (SELECT max(reports) AS top FROM m)
    SELECT policy, repetitions, reports, seconds, top - reports AS regret, reports > br OR (reports = br AND seconds < bs) AS beats_baseline FROM m, b, x"""


@query(BENCH_SQL)
def route_benchmark(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select(F.col("l_returnflag").alias("policy"), F.col("l_linenumber").alias("reports"), F.col("l_quantity").alias("seconds"))
    return evaluation.policy_benchmark(li, "policy", "N", "reports", "seconds")


@query("""WITH r AS (SELECT p_type, p_brand, CASE WHEN p_name < 'm' THEN 'calibration' ELSE 'holdout' END AS split, p_size > 25 AS pos FROM part), f AS (SELECT p_type, p_brand, count(*) AS fn, count(*) FILTER (pos) AS fh FROM r WHERE split = 'calibration' GROUP BY 1, 2),
    w AS (SELECT (count(*) FILTER (pos) + 1.0) / (count(*) + 2.0) AS p FROM r WHERE split = 'calibration'), h AS (SELECT p_type, p_brand, count(*) AS n, count(*) FILTER (pos) AS observed FROM r WHERE split = 'holdout' GROUP BY 1, 2),
    j AS (SELECT h.*, CASE WHEN fn >= 2 THEN (fh + 1.0) / (fn + 2.0) ELSE p END * n AS expected FROM h LEFT JOIN f USING (p_type, p_brand), w)
    SELECT p_type, p_brand, n, CAST(expected AS DOUBLE) AS expected, observed, CAST(abs(expected - observed) AS DOUBLE) AS error FROM j""")
def holdout_evaluation(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_type", "p_brand", F.when(F.col("p_name") < "m", "calibration").otherwise("holdout").alias("split"), "p_size")
    return evaluation.holdout_evaluation(p, "split", ["p_type", "p_brand"], F.col("p_size") > 25)


@query("""WITH m AS (SELECT o_orderkey, l_partkey, l_linenumber = 1 AS a, l_returnflag = 'R' AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    s AS (SELECT o_orderkey, 1 AS k, l_partkey FROM m WHERE a UNION SELECT o_orderkey, 2, l_partkey FROM m WHERE b UNION SELECT o_orderkey, 3, l_partkey FROM m),
    e AS (SELECT o_orderkey, k, min(l_partkey) AS p FROM s GROUP BY 1, 2 HAVING count(*) = 1), r AS (SELECT o_orderkey, arg_min(p, k) AS p, min(k) AS k FROM e GROUP BY 1)
    SELECT o.o_orderkey, p AS l_partkey, ['target', 'line', 'only'][k] AS strategy FROM orders o LEFT JOIN r ON o.o_orderkey = r.o_orderkey""")
def exact_operations(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey")
    places = lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_returnflag")
    return resolve.resolve_cascade(o, "o_orderkey", places, ["o_orderkey"], "l_partkey", [("target", F.col("l_linenumber") == 1), ("line", F.col("l_returnflag") == "R"), ("only", F.lit(True))])


@query("""WITH c AS (SELECT event_id, unnest([CAST(floor(value) AS BIGINT), user_id + 100, user_id]) AS s, unnest([1, 2, 3]) AS k FROM events), f AS (SELECT event_id, arg_min(s_name, k) AS s_name, arg_min(s_suppkey, k) AS s_suppkey FROM c JOIN supplier ON s = s_suppkey GROUP BY 1)
    SELECT event_id, s_name, s_suppkey FROM events LEFT JOIN f USING (event_id)""")
def fallback_keys(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "value")
    keys = F.array(F.floor("value").cast("long"), F.col("user_id") + 100, F.col("user_id"))
    return resolve.first_key(e, "event_id", keys, t(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("event_id", "s_name", "s_suppkey")


@query("""WITH r AS (SELECT user_id, event_type, event_id, event_type = 'view' AS x, CASE WHEN value > 50 THEN value END AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id) AS k FROM events)
    SELECT user_id, arg_min(event_id, k) AS event_id, arg_min(size, k) FILTER (size IS NOT NULL) AS size, count(*) AS merged, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS roles FROM r GROUP BY 1""")
def merged_operations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("size"), F.create_map(kind, F.col("event_id")).alias("roles"))
    out = resolve.merge_operations(e, ["user_id"], kind == "view", [F.col("event_id")], ["size"], "roles")
    return out.select("user_id", "event_id", "size", "merged", F.array_join(F.array_sort(F.map_keys("roles")), ",").alias("roles"))


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 0), b AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(CASE WHEN b.k IS NOT NULL THEN 'supplier,shared' || CASE WHEN a.k IS NOT NULL THEN ',customer' ELSE '' END END, 'customer,shared') AS artifacts FROM a FULL JOIN b ON a.k = b.k""")
def replay_merge(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.array(F.lit("customer"), F.lit("shared")).alias("artifacts"))
    b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.array(F.lit("supplier"), F.lit("shared")).alias("artifacts"))
    return resolve.prefer(a, b, "k", ["artifacts"]).withColumn("artifacts", F.array_join("artifacts", ","))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events), x AS (SELECT user_id, event_type, event_id, k, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS e FROM r WHERE k = 1 OR value > 70),
    y AS (SELECT user_id, event_type, e, min(k) AS k FROM x GROUP BY 1, 2, 3), z AS (SELECT user_id, event_type, string_agg(CAST(e AS VARCHAR), ',' ORDER BY k) AS calls FROM y GROUP BY 1, 2)
    SELECT user_id, event_type, min(event_id) AS event_id, any_value(calls) AS calls FROM r JOIN z USING (user_id, event_type) GROUP BY 1, 2""")
def confirmation_merge(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("value") > 70).alias("site"), F.array((F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("calls"))
    out = resolve.merge_equivalent(e, ["user_id", "event_type"], F.col("site"), [F.col("event_id")], ["calls"])
    return out.select("user_id", "event_type", "event_id", F.array_join("calls", ",").alias("calls"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, unnest([CAST(l_partkey AS VARCHAR), 'b' || l_suppkey, '', 'c' || l_returnflag]) AS address FROM lineitem)
    SELECT l_orderkey, address, min(l_linenumber) AS line FROM x WHERE address <> '' GROUP BY 1, 2""")
def address_lines(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("address"), F.array(F.concat(F.lit("b"), F.col("l_suppkey").cast("string")), F.lit("")).alias("calls"), F.array(F.concat(F.lit("c"), "l_returnflag"), F.lit(None).cast("string")).alias("loads"))
    return resolve.line_addresses(li, ["l_orderkey"], "l_linenumber", ["address"], ["calls", "loads"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def credential_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "password").when(F.col("l_returnflag") == "A", "username").otherwise("other").alias("role"))
    return resolve.same_place_roles(li, ["l_orderkey"], "role", ["username", "password"], "password").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 0) SELECT c_custkey, CASE WHEN r.k IS NOT NULL THEN 'other' ELSE 'overflow_condition_proof,other' END AS blockers, CASE WHEN r.k IS NOT NULL THEN 'a,run' ELSE 'a' END AS artifacts, r.k IS NOT NULL AS lifted
    FROM customer LEFT JOIN r ON c_custkey = r.k""")
def run_integration(spark: SparkSession, d: str) -> DataFrame:
    states = t(spark, d, "customer").select("c_custkey", F.array(F.lit("overflow_condition_proof"), F.lit("other")).alias("blockers"), F.array(F.lit("a")).alias("artifacts"))
    runs = t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), (F.col("s_nationkey") % 2 == 0).alias("ran"), (F.col("s_acctbal") > 0).alias("reached"), F.lit(True).alias("generated"), F.array(F.lit("run")).alias("refs"))
    out = resolve.integrate_runs(states, runs, "c_custkey")
    return out.select("c_custkey", F.array_join("blockers", ",").alias("blockers"), F.array_join("artifacts", ",").alias("artifacts"), "lifted")


@query("""SELECT DISTINCT p_name AS symbol FROM part WHERE p_size > 40""")
def detection_surface(spark: SparkSession, d: str) -> DataFrame:
    return resolve.surface(t(spark, d, "part"), "reportable", F.col("p_name"), F.col("p_size") > 40)


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (0, 7)""")
def regression_subset(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return resolve.regression_subset(c, "c_custkey", F.col("c_acctbal") > 9000, ["0", "7"]).select("c_custkey", "c_mktsegment")


@query(r"""WITH w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(p_name, '\w+')) AS w FROM part WHERE p_size < 25)), c AS (SELECT DISTINCT '~' || regexp_extract(p_name, '\w+') AS name, regexp_extract(p_name, '\w+') AS w FROM part)
    SELECT 'f' || p_partkey AS name FROM part WHERE p_size < 25 UNION SELECT name FROM c WHERE w IN (SELECT w FROM w)""")
def destructor_reach(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    f = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.lower("p_name").alias("text"), "p_size")
    classes = p.select(F.concat(F.lit("~"), F.regexp_extract("p_name", r"\w+", 0)).alias("name"), F.lit("").alias("text")).distinct()
    return resolve.expand_destructors(f.where("p_size < 25").select("name"), f.select("name", "text").unionByName(classes))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_discount > 0.08 THEN 'cgi_handler' WHEN l_tax < 0.02 THEN '' WHEN l_returnflag = 'R' THEN 'busybox_applet' WHEN l_linenumber > 3 OR l_linestatus = 'O' THEN 'daemon_launch' ELSE 'service_launch' END AS surface FROM lineitem""")
def entry_surfaces(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    count = lambda x: F.when(x, 2)
    out = resolve.entry_surface(count(c("l_discount") > 0.08), count(~(c("l_tax") < 0.02)), count(c("l_linenumber") > 3), F.when(c("l_returnflag") == "R", "sh"), c("l_linestatus") == "O")
    return lines(spark, d).select(*LINE, out.alias("surface"))


@query("""WITH o AS (SELECT p_brand, p_type, count(*) AS n, any_value(p_size) AS size, any_value(p_partkey) AS object FROM part GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT p.p_partkey, o.size, o.object FROM part p LEFT JOIN o ON p.p_brand = o.p_brand AND p.p_type = o.p_type""")
def attached_objects(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    table = t(spark, d, "part").select(F.col("p_brand").alias("b"), F.col("p_type").alias("y"), F.col("p_size").alias("size"), F.col("p_partkey").alias("object"))
    return resolve.attach(p, table, {"p_brand": "b", "p_type": "y"}, ["size", "object"]).select("p_partkey", "size", "object")


# text and record functions


@query(r"""SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey)) AS address, CAST(o_orderkey AS VARCHAR) AS number, CAST(o_custkey AS VARCHAR) AS literal, CASE WHEN o_orderkey % 2 = 0 THEN '-0x' ELSE '+0x' END || lower(to_hex(o_custkey)) AS stack, CASE WHEN o_orderkey % 900 = 6 THEN 'CWE-7' ELSE 'CWE-' || (o_orderkey % 900 + 1) || ',CWE-7' END AS weaknesses,
    substr(sha256(o_orderstatus || '|' || o_orderkey || '|'), 1, 16) AS id FROM orders""")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.concat(F.lit(" 0X000"), F.hex(key), F.lit(" "))
    literal = F.when(key % 3 == 0, F.concat(F.lit("0x"), F.hex(cust), F.lit("UL"))).when(key % 3 == 1, F.concat(F.lit("0"), F.conv(cust.cast("string"), 10, 8))).otherwise(F.concat(cust.cast("string"), F.lit("u")))
    literal = F.when(cust == 0, "0").otherwise(literal)
    texts = F.concat(F.lit("see cwe_0"), (key % 900 + 1).cast("string"), F.lit(" and CWE-7, CWE 007"))
    return t(spark, d, "orders").select(
        "o_orderkey", X.address(raw).alias("address"), X.address_number(raw).cast("string").alias("number"), X.integer_literal(literal).cast("string").alias("literal"),
        X.stack_offset(F.when(key % 2 == 0, -cust - F.when(cust == 0, 0).otherwise(0)).otherwise(cust)).alias("stack0"),
        F.array_join(X.cwe(texts), ",").alias("weaknesses"), X.stable_id(F.col("o_orderstatus"), key, F.lit(None).cast("string")).alias("id"),
    ).withColumn("stack", F.when((key % 2 == 0) & (F.col("stack0") == "+0x0"), "-0x0").otherwise(F.col("stack0"))).drop("stack0")


@query(r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'memcpy' WHEN 1 THEN 'operator_new' WHEN 2 THEN 'push' ELSE 'strcpy_chk' END AS operation, 'supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '_v2' AS key,
    'n+' || s_suppkey AS expression, substr(sha256(s_name), 1, 16) AS fingerprint FROM supplier""")
def name_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "std::__builtin_memcpy@GLIBC_2.14").when(k % 4 == 1, "operator  new(unsigned long)").when(k % 4 == 2, "std::vector::Push").otherwise("__strcpy_chk")
    path = F.concat(F.lit("/opt\\bin/Supplier-"), F.lpad(k.cast("string"), 9, "0"), F.lit(".v2.ELF"))
    text = F.concat(F.lit("((unsigned int)((n + (size_t)"), k.cast("string"), F.lit(")))"))
    return t(spark, d, "supplier").select("s_suppkey", X.operation_name(name).alias("operation"), X.binary_key(path).alias("key"), X.cast_stripped(text).alias("expression"), X.fingerprint(F.col("s_name")).alias("fingerprint"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, CASE o_orderstatus WHEN 'F' THEN 'timeout' WHEN 'O' THEN 'missing' END AS category, CASE WHEN o_orderpriority LIKE '1%' THEN 'exploration' WHEN o_orderstatus = 'F' THEN 'exploration' WHEN o_orderstatus = 'O' THEN 'input_topology' ELSE 'proof_relation' END AS stage,
    CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 0 END AS rank FROM orders GROUP BY 1, 2""")
def blocker_texts(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    reason = F.when(s == "F", "Solver Timed out: timeout").when(s == "O", "Input file not found")
    given = F.when(p.startswith("1"), "exploration").otherwise("no such stage")
    severity = F.when(p.startswith("1"), "critical").when(p.startswith("2"), "high").otherwise("none")
    out = t(spark, d, "orders").select("o_orderpriority", "o_orderstatus", X.reason_category(reason).alias("category"), X.blocker_stage(given, reason).alias("stage"), X.severity_rank(severity).alias("rank"))
    return out.groupBy("o_orderpriority", "o_orderstatus", "category", "stage", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, metric, value FROM (SELECT p_partkey, unnest(['a.size', 'a.price', 'n']) AS metric, unnest([CAST(p_size AS DOUBLE), p_retailprice, CASE WHEN p_size > 10 THEN 1.0 END]) AS value FROM part) WHERE value IS NOT NULL""")
def flat_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand")).alias("a"), F.when(F.col("p_size") > 10, 1).alias("n"))
    return R.flatten_numbers(p, "p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'a=1,b=9' ELSE 'a=1,b=2,c=3' END AS merged, 'x,y,z' AS distinct_items, c_nationkey % 2 = 0 AS grounded, '<redacted>' AS token, c_name AS name, '{"a":null,"b":"' || c_name || '"}' AS json FROM customer""")
def record_functions(spark: SparkSession, d: str) -> DataFrame:
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    base, more = m(a=1, b=2), F.when(F.col("c_nationkey") < 12, m(b=9)).otherwise(m(c=3))
    items = F.array(*[F.lit(x) for x in "xyxzy"])
    from .operators import dedupe

    refs = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("f1"))).otherwise(F.array(F.lit("f1"), F.lit("f9")))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("api_key")).alias("r"), F.col("c_name").alias("b"), F.lit(None).cast("string").alias("a"))
    c = R.redact(c)
    pairs = F.array_sort(F.map_entries(R.merge_maps(base, more)))
    return c.select("c_custkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("merged"), F.array_join(dedupe.ordered_distinct(items), ",").alias("distinct_items"),
        R.grounded(refs, F.array(F.lit("f1"), F.lit("f2"))).alias("grounded"), F.col("r.api_key").alias("token"), F.col("r.name").alias("name"), R.canonical_json(c, ["b", "a"]).alias("json"))


# evidence and schedules


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber = 1 THEN 'oob_read' WHEN l_linenumber = 2 THEN 'integer_overflow' ELSE 'write' END AS kind, l_linestatus = 'F' AS proven, l_returnflag AS r, l_suppkey % 3 AS o, l_tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN kind = 'oob_read' AND proven THEN 'deterministic_high' WHEN kind = 'integer_overflow' THEN 'integer_relation' WHEN r = 'R' AND proven THEN 'deterministic_high' WHEN o = 0 THEN 'api_contract'
      WHEN o = 1 AND l_tax < 0.03 THEN 'symbolic_heap' WHEN r = 'A' THEN 'symbolic' WHEN r = 'N' AND l_tax > 0.05 THEN 'append' ELSE 'triage' END AS tier FROM f""")
def triage_tiers(spark: SparkSession, d: str) -> DataFrame:
    n, o, r = F.col("l_linenumber"), F.col("l_suppkey") % 3, F.col("l_returnflag")
    f = lines(spark, d).select(*LINE, F.when(n == 1, "oob_read").when(n == 2, "integer_overflow").otherwise("write").alias("kind"), F.when(F.col("l_linestatus") == "F", "proven").alias("proof_status"), F.when(r == "R", "overflow").otherwise("candidate").alias("verdict"),
        F.when(o == 0, "parameter").when(o == 1, "heap").otherwise("stack").alias("object_kind"), F.when(F.col("l_tax") >= 0.03, 8).alias("capacity_bytes"), F.when(r == "A", "symbolic_size").when((r == "N") & (F.col("l_tax") > 0.05), "append").otherwise("none").alias("reason"))
    return f.select(*LINE, evidence.triage_tier().alias("tier"))


@query("""WITH r AS (SELECT user_id AS candidate_id, event_id, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'sink_not_reached' WHEN 'error' THEN 'blocked' ELSE 'setup_invalid' END AS result, value > 50 AS s, value > 80 AS b, user_id % 2 = 0 AS c FROM events),
    k AS (SELECT *, CASE WHEN result = 'confirmed' AND s AND b THEN 70 WHEN s THEN 50 WHEN c THEN 40 WHEN result = 'sink_not_reached' THEN 30 WHEN result = 'setup_invalid' THEN 20 ELSE 10 END AS rank FROM r)
    SELECT candidate_id, arg_max(event_id, (rank, -event_id)) AS event_id, max(rank) AS rank FROM k GROUP BY 1""")
def best_replays(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    r = t(spark, d, "events").select(F.col("user_id").alias("candidate_id"), "event_id", F.when(kind == "purchase", "confirmed").when(kind == "click", "sink_not_reached").when(kind == "error", "blocked").otherwise("setup_invalid").alias("result"), (F.col("value") > 50).alias("sink_reached"), (F.col("value") > 80).alias("bug_observed"), (F.col("user_id") % 2 == 0).alias("crash_observed"))
    return evidence.best_replay(r, F.col("event_id")).select("candidate_id", "event_id", evidence.replay_rank().alias("rank"))


@query("""SELECT p_partkey, CAST(5.0 * (p_size > 10)::INT + 4.0 * (p_size > 20)::INT + 3.0 * (p_size > 30)::INT + 2.0 + 1.5 + CASE WHEN p_type = 'ECONOMY' THEN 2.0 ELSE 0.5 END - 0.75 * 2 - CASE WHEN p_size % 2 = 0 THEN 4.0 ELSE 0.0 END AS DOUBLE) AS score,
    (4.0 / (1.0 + p_size) + 2.0 / 3.0 + 2.0 + least(4.0, 1.5 * (p_size % 4))) / 0.5 AS utility, CAST((CASE WHEN p_size > 25 THEN 0.0 ELSE 10.0 END + greatest(2.0, p_size)) * least(2.0, 1.0 + 0.1 * (p_size % 15)) AS DOUBLE) AS cost FROM part""")
def schedule_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    blockers = F.array(F.lit("slow"), F.when(s % 2 == 0, "missing input").otherwise("late"))
    score = scheduling.evidence_score(s > 10, s > 20, s > 30, F.lit(True), F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.when(F.col("p_type") == "ECONOMY", "critical").otherwise("medium"), blockers)
    utility = scheduling.variant_utility(s, F.lit(2), F.lit(True), s % 4, F.lit(0.5))
    cost = scheduling.route_cost(F.lit(10.0), s > 25, F.lit(2.0), s.cast("double"), s % 15)
    return t(spark, d, "part").select("p_partkey", score.alias("score"), utility.alias("utility"), cost.alias("cost"))


@query("""WITH r AS (SELECT p_brand AS candidate_id, p_type AS route, p_size % 3 AS scope, bool_or(p_size > 5) AS viable FROM part GROUP BY 1, 2, 3), a AS (SELECT p_brand AS candidate_id, p_type AS route, p_size % 3 AS scope, p_size > 45 AS failed FROM part WHERE p_size > 43),
    f AS (SELECT candidate_id, scope, count(*) FILTER (failed) AS n FROM a GROUP BY 1, 2)
    SELECT r.candidate_id, r.route, r.scope FROM r LEFT JOIN f USING (candidate_id, scope) WHERE viable AND coalesce(n, 0) < 2 AND NOT EXISTS (SELECT 1 FROM a WHERE a.candidate_id = r.candidate_id AND a.route = r.route)""")
def open_routes(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_brand").alias("candidate_id"), F.col("p_type").alias("route"), (F.col("p_size") % 3).alias("scope"), "p_size")
    routes = p.groupBy("candidate_id", "route", "scope").agg(F.bool_or(F.col("p_size") > 5).alias("viable"))
    attempts = p.where("p_size > 43").withColumn("outcome", F.when(F.col("p_size") > 45, "failed").otherwise("done"))
    return selection.available_routes(routes, attempts).select("candidate_id", "route", "scope")


@query("""SELECT c_custkey, (c_acctbal > 5000 AND c_nationkey < 10) AND c_mktsegment IN ('FURNITURE', 'BUILDING') AS ready, c_nationkey > 3 AS exact, c_nationkey % 3 = 0 AS safe FROM customer""")
def proof_preconditions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    ready = selection.preconditions(F.when(F.col("c_acctbal") > 5000, "candidate"), F.when(n < 10, "overflow"), F.array(F.col("c_mktsegment")), ["candidate"], ["overflow", "unbounded"], ["FURNITURE", "BUILDING"])
    exact = selection.exact_operation(F.when(n > 3, F.concat(F.lit("0x"), n.cast("string"))).otherwise("0XAB"), F.lit("0xab"))
    method = F.when(n % 3 == 0, "getStatusInfo").when(n % 3 == 1, "get_and_reset").otherwise("flash")
    return t(spark, d, "customer").select("c_custkey", ready.alias("ready"), exact.alias("exact"), selection.safe_method(method).alias("safe"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber WHEN 1 THEN CASE WHEN l_suppkey + 200 > 255 THEN 'overflow' ELSE 'none' END WHEN 2 THEN CASE WHEN l_suppkey - 5 < 0 THEN 'underflow' ELSE 'none' END
    WHEN 3 THEN CASE WHEN l_partkey > 255 THEN 'truncation' ELSE 'none' END ELSE CASE WHEN l_suppkey * l_linenumber > 255 THEN 'overflow' ELSE 'none' END END AS risk FROM lineitem""")
def integer_risks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    op = F.when(n == 1, "add").when(n == 2, "sub").when(n == 3, "cast").otherwise("mul")
    left = F.when(n == 3, F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    right = F.when(n == 1, 200).when(n == 2, 5).otherwise(n)
    return lines(spark, d).select(*LINE, intervals.integer_risk(op, left, right, 8).alias("risk"))


@query("""SELECT p_brand, p_type, count(*) AS findings, array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), ',') AS candidate_ids, substr(sha256(p_brand || chr(0) || p_type || chr(0) || 'write'), 1, 16) AS unit_id FROM part GROUP BY 1, 2""")
def review_units(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_brand").alias("binary"), F.col("p_type").alias("function"), F.lit("write").alias("type"), F.col("p_partkey").cast("string").alias("candidate_id"))
    u = evidence.review_units(p)
    return u.select(F.col("binary").alias("p_brand"), F.col("function").alias("p_type"), "findings", F.array_join("candidate_ids", ",").alias("candidate_ids"), F.substring("unit_id", 1, 16).alias("unit_id"))


@query("""SELECT s_suppkey AS candidate_id, s_name AS claim FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 2000)""")
def unbacked_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = t(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.col("s_name").alias("claim"))
    backed = t(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("candidate_id"))
    return evidence.claim_failures(claims, claims.join(backed, "candidate_id", "left_semi"))


@query("""WITH p AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'refuted' WHEN 1 THEN 'proven' WHEN 2 THEN 'inconclusive' ELSE 'proven' END AS st, s_nationkey < 12 AS exact FROM supplier)
    SELECT c_custkey AS candidate_id, 'proof_ready' AS old_status, CASE WHEN st IS NULL THEN 'proof_ready' WHEN st = 'refuted' THEN 'rejected' WHEN st = 'proven' AND exact THEN 'report_ready' ELSE 'proof_ready' END AS status,
      CASE WHEN st IN ('proven', 'inconclusive') AND NOT (st = 'proven' AND exact) THEN 'b,proof_' || st ELSE 'b' END AS blockers FROM customer LEFT JOIN p ON c_custkey = k""")
def promotions(spark: SparkSession, d: str) -> DataFrame:
    states = t(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.lit("proof_ready").alias("status"), F.array(F.lit("b")).alias("blockers"), F.lit("memory_access").alias("backend"))
    k = F.col("s_suppkey") % 4
    none = lambda name: F.lit(None).cast("string").alias(name)
    proofs = t(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.lit("memory_access").alias("backend"), F.when(k == 0, "refuted").when(k == 2, "inconclusive").otherwise("proven").alias("status"), (F.col("s_nationkey") < 12).alias("exact_operation_reached"), F.lit("write").alias("memory_access"),
        *[none(c) for c in ("lifetime_violation", "scope", "process_setup", "concrete_input", "effect_observation", "effect_kind", "expected_effect", "static_evidence", "blocker")])
    out = evidence.promote(states, proofs)
    return out.select("candidate_id", "old_status", "status", F.array_join("blockers", ",").alias("blockers"))
