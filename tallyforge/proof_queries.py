"""Queries of offset sets, obligations, certificates, packs and entry points, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import offsets
from .plans import proof
from .queries import TRADE, query, t, trade

SETS = """WITH a AS (SELECT DISTINCT o_custkey, unnest(range(day, day + 40)) AS day FROM (SELECT o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS day FROM orders WHERE o_orderstatus = 'F')),
    b AS (SELECT DISTINCT o_custkey, unnest(range(day, day + 25)) AS day FROM (SELECT o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS day FROM orders WHERE o_orderstatus = 'O')),
    k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'),"""


def sets(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", day.alias("day"))
    one = lambda s, n, name: offsets.collect(o.where(F.col("o_orderstatus") == s).withColumn("end", F.col("day") + n), ["o_custkey"], "day", "end", name)
    return one("F", 40, "a").join(one("O", 25, "b"), "o_custkey")


@query(SETS + """ u AS (SELECT * FROM a UNION SELECT * FROM b), x AS (SELECT * FROM a INTERSECT SELECT * FROM b), r AS (SELECT * FROM a EXCEPT SELECT * FROM b),
    g AS (SELECT o_custkey, day - row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS i FROM r)
    SELECT o_custkey, (SELECT count(*) FROM u WHERE u.o_custkey = k.o_custkey) AS covered, EXISTS (SELECT 1 FROM x WHERE x.o_custkey = k.o_custkey) AS meet, (SELECT count(*) FROM r WHERE r.o_custkey = k.o_custkey) AS rest,
      (SELECT count(DISTINCT i) FROM g WHERE g.o_custkey = k.o_custkey) AS pieces, NOT EXISTS (SELECT 1 FROM r WHERE r.o_custkey = k.o_custkey) AS inside FROM k""")
def offset_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    size = lambda s: F.aggregate(s["items"], F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    rest = offsets.subtract(a, b)
    return sets(spark, d).select("o_custkey", size(offsets.union(a, b)).alias("covered"), offsets.intersects(a, b).alias("meet"), size(rest).alias("rest"), F.size(rest["items"]).cast("bigint").alias("pieces"), offsets.subset(a, b).alias("inside"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '?' WHEN p_size % 3 = 1 THEN '0-1/1' ELSE (p_size * 4 + 1) || '-' || (p_size * 4 + 2) || '/1' END AS offsets, CASE WHEN p_size % 3 = 2 THEN '?' ELSE CASE WHEN p_size % 3 = 1 THEN '0-1/1,' WHEN p_size * 4 + 1 < 100 THEN (p_size * 4 + 1) || '-' || (p_size * 4 + 2) || '/1,' ELSE '' END || '100-108/4' || CASE WHEN p_size % 3 = 0 AND p_size * 4 + 1 >= 100 THEN ',' || (p_size * 4 + 1) || '-' || (p_size * 4 + 2) || '/1' ELSE '' END END AS joined FROM part""")
def expression_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    expression = F.when(n % 3 == 2, "i + 1").when(n % 3 == 1, " ").otherwise(F.concat(F.lit("(int)("), n.cast("string"), F.lit(" * 4 + 1)")))
    found = offsets.from_expression(expression)
    strided = offsets.known(F.array(offsets.interval(F.lit(100), F.lit(108), 4)))
    shown = lambda s: F.when(s["unknown"], "?").otherwise(F.array_join(F.transform(s["items"], lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit("/"), x["stride"].cast("string"))), ","))
    p = t(spark, d, "part").select("p_partkey", found.alias("s"))
    return p.select("p_partkey", shown(F.col("s")).alias("offsets"), shown(offsets.union(F.col("s"), strided)).alias("joined"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'no_obligation' WHEN p_size < 20 THEN CASE WHEN p_type = 'ECONOMY' THEN 'discharged' ELSE 'open' END ELSE 'open' END AS status,
    CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN CASE WHEN p_type = 'ECONOMY' THEN '' ELSE 'reachable' END WHEN p_type = 'ECONOMY' THEN 'input_reaches_sink' ELSE 'reachable,input_reaches_sink' END AS missing FROM part""")
def proof_obligations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    facts = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("exact_operation"), F.lit("reachable"))).otherwise(F.array(F.lit("exact_operation")))
    o = proof.obligations(F.when(n < 10, "other").when(n < 20, "proven_overflow").otherwise("unbounded"), facts)
    return t(spark, d, "part").select("p_partkey", o["status"].alias("status"), F.array_join(o["missing"], ",").alias("missing"))


@query("""WITH r(vulnerability_type, route, cost, need) AS (VALUES ('ECONOMY', 'replay', 5, 0), ('ECONOMY', 'static', 1, 20), ('STANDARD', 'static', 1, 0), ('ECONOMY', 'trace', 5, 30)), j AS (SELECT p_partkey, route, cost FROM part JOIN r ON p_type = vulnerability_type WHERE p_size >= need)
    SELECT p_partkey AS candidate_id, route, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY cost, route) AS INTEGER) AS step FROM j""")
def proof_plans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    facts = F.array_compact(F.array(F.when(n >= 20, "n20"), F.when(n >= 30, "n30")))
    c = t(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("vulnerability_type"), facts.alias("facts"))
    routes = spark.createDataFrame([("ECONOMY", "replay", 5, []), ("ECONOMY", "static", 1, ["n20"]), ("STANDARD", "static", 1, []), ("ECONOMY", "trace", 5, ["n30"])], "vulnerability_type string, route string, cost int, requires array<string>")
    return proof.proof_plans(c, routes)


def rules() -> list:
    q = F.col("l_quantity")
    return [("bounded", q < 10, F.lit("safe")), ("literal", F.col("l_returnflag") == "R", F.when(q > 40, "overflow").otherwise("safe")), ("fixed", F.col("l_discount") > 0.05, F.lit("safe"))]


CERTIFIED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_quantity < 10 THEN 'bounded' WHEN l_returnflag = 'R' THEN 'literal' WHEN l_discount > 0.05 THEN 'fixed' END AS rule,
    CASE WHEN l_quantity < 10 THEN 'safe' WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 40 THEN 'overflow' ELSE 'safe' END WHEN l_discount > 0.05 THEN 'safe' END AS certificate FROM lineitem"""


@query(CERTIFIED)
def certificates(spark: SparkSession, d: str) -> DataFrame:
    return proof.certify(t(spark, d, "lineitem"), rules()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "rule", "certificate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R' AND l_quantity > 40 AND l_tax > 0.04""")
def stale_certificates(spark: SparkSession, d: str) -> DataFrame:
    certified = proof.certify(t(spark, d, "lineitem"), rules())
    stale = certified.withColumn("certificate", F.when((F.col("certificate") == "overflow") & (F.col("l_tax") > 0.04), "safe").otherwise(F.col("certificate")))
    return proof.recheck(stale, rules()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""WITH t AS (SELECT s_nationkey AS k, count(*) AS tools, min(s_name) AS first FROM supplier GROUP BY 1) SELECT c_custkey AS candidate_id, r_name AS region, coalesce(tools, 0) AS tools, first AS first_finding, c_name || ',' || c_mktsegment || ',' || n_name AS strings
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN t ON k = c_nationkey""")
def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("function"), "c_name", "c_mktsegment")
    tools = t(spark, d, "supplier").select(F.col("s_nationkey").alias("function"), F.lit("scan").alias("tool"), F.col("s_name").alias("finding"))
    packs = proof.evidence_packs(c, n.select(F.col("n_nationkey").alias("function"), "n_name", "r_name"), tools)
    regions = proof.fact_request(packs, "context.r_name").withColumnRenamed("value", "region")
    whole = F.to_json(F.struct("pack.candidate.c_name", "pack.candidate.c_mktsegment", "pack.context.n_name"))
    rest = packs.select("candidate_id", F.size("pack.tools").cast("long").alias("tools"), F.get("pack.tools", F.lit(0))["finding"].alias("first_finding"), F.array_join(proof.json_strings(whole), ",").alias("strings"))
    return regions.join(rest, "candidate_id")


@query("""WITH e AS (SELECT event_id, user_id % 4 AS m, value FROM events) SELECT event_id, CASE WHEN m = 0 THEN 'same_block_before' WHEN m = 1 THEN 'dominates' WHEN value < 30 THEN 'text_before' WHEN value > 60 THEN 'text_after' ELSE 'unknown' END AS relation FROM e""")
def event_relations(spark: SparkSession, d: str) -> DataFrame:
    m, v = F.col("user_id") % 4, F.col("value")
    block = F.when(m == 0, "same_block_before").when(m == 1, "different_blocks").otherwise("unresolved_block")
    after = F.when(v < 30, 9).when(v > 60, 2)
    return t(spark, d, "events").select("event_id", proof.event_relation(block, m == 1, F.lit(5), after).alias("relation"))


@query(TRADE + """ r(node, depth) AS (SELECT n_nationkey::VARCHAR, 0 FROM nation WHERE n_regionkey = 1 UNION SELECT dst, depth + 1 FROM r JOIN g ON node = src WHERE depth < 16), s(node, depth) AS (SELECT '7', 0 UNION SELECT dst, depth + 1 FROM s JOIN g ON node = src WHERE depth < 16)
    SELECT n_nationkey::VARCHAR AS node, (SELECT min(depth) FROM r WHERE node = n_nationkey::VARCHAR) AS from_entry, (SELECT min(depth) FROM s WHERE node = n_nationkey::VARCHAR) AS from_source FROM nation""")
def reachability_context(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), "n_regionkey")
    return proof.reachability_context(n, trade(spark, d), n.where("n_regionkey = 1"), n.where("node = '7'"))


@query(TRADE + """ r(node, depth) AS (SELECT n_nationkey::VARCHAR, 0 FROM nation WHERE n_regionkey = 2 UNION SELECT dst, depth + 1 FROM r JOIN g ON node = src WHERE depth < 16)
    SELECT n_nationkey::VARCHAR AS node, min(depth) AS depth, min(depth) + 1 AS path_length, min(depth) IS NOT NULL AS starts_at_entry FROM nation LEFT JOIN r ON node = n_nationkey::VARCHAR WHERE n_regionkey = 3 GROUP BY 1""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), "n_regionkey")
    out = proof.entry_points(trade(spark, d), n.where("n_regionkey = 3"), n.where("n_regionkey = 2"))
    return out.select("node", "depth", F.when(F.col("path").isNotNull(), F.size("path")).alias("path_length"), F.coalesce(F.get("path", F.lit(0)) == F.col("entry"), F.lit(False)).alias("starts_at_entry"))


@query("""SELECT p_brand AS function, 'v' || p_partkey AS name, 'v' || min(p_partkey) OVER (PARTITION BY p_brand, island) AS root FROM (SELECT *, sum(CASE WHEN p_size < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS island FROM part)
    QUALIFY min(p_partkey) OVER (PARTITION BY p_brand, island) <> p_partkey""")
def alias_roots(spark: SparkSession, d: str) -> DataFrame:
    """Each part takes its brand's part before it as origin, unless it is small."""
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = t(spark, d, "part").withColumn("before", before).where("before IS NOT NULL AND p_size >= 8")
    return proof.alias_roots(p.select(F.col("p_brand").alias("function"), name(F.col("p_partkey")).alias("name"), name(F.col("before")).alias("origin")))
