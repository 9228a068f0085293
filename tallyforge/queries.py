"""Queries on the driver's tables, one or more per operator family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records as R
from .functions import text as X
from .operators import dedupe, differential, graph, intervals, joins, lifecycle, metrics, scheduling, selection
from .sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as evaluation cases."""
    o = t(spark, d, "orders")
    bad = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    decision = F.when(F.col("o_orderstatus") == "P", "blocked").when(F.col("o_orderstatus") == "F", F.when(bad, "reported").otherwise("false_positive")).otherwise(F.when(bad, "missed").otherwise("clean"))
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(bad, "vulnerable").otherwise("fixed").alias("lane"), decision.alias("decision"), F.floor("o_totalprice").cast("double").alias("cpu_seconds"))


CASES_SQL = """WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority IN ('1-URGENT', '2-HIGH') AS bad, o_orderstatus AS st, floor(o_totalprice) AS cpu,
    o_orderstatus <> 'P' AS done FROM orders) """
RATES_SQL = """count(*) AS cases, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS blocked,
    count(*) FILTER (done) / count(*) AS coverage,
    coalesce(count(*) FILTER (done AND bad) / nullif(count(*) FILTER (bad), 0), 0.0) AS positive_coverage,
    coalesce(count(*) FILTER (done AND NOT bad) / nullif(count(*) FILTER (NOT bad), 0), 0.0) AS negative_coverage,
    count(*) FILTER (st = 'F' AND bad) / nullif(count(*) FILTER (done AND bad), 0) AS conditional_recall,
    count(*) FILTER (st = 'F' AND NOT bad) / nullif(count(*) FILTER (done AND NOT bad), 0) AS conditional_fpr,
    count(*) FILTER (st = 'F' AND bad) * 3600.0 / nullif(sum(cpu), 0) AS reports_per_cpu_hour"""


@query(CASES_SQL + "SELECT month, " + RATES_SQL + " FROM c GROUP BY month")
def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_metrics(cases(spark, d), ["month"])


@query("""WITH s(position, stage) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase'), (4, 'refund')),
    n AS (SELECT event_type, count(DISTINCT user_id) AS e FROM events GROUP BY 1)
    SELECT stage, coalesce(e, 0) AS entities, coalesce(coalesce(e, 0) / nullif((SELECT e FROM n WHERE event_type = 'view'), 0), 0.0) AS share FROM s LEFT JOIN n ON stage = event_type""")
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_funnel(t(spark, d, "events"), "user_id", F.col("event_type"), ["view", "click", "signup", "purchase", "refund"])


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) || ':' || event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def blocker_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_counts(t(spark, d, "events"), F.concat_ws(":", F.get_json_object("props", "$.k"), "event_type"))


@query("""WITH j AS (SELECT p_type, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'vulnerable' ELSE 'fixed' END AS lane, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT p_type, l_returnflag, count(*) AS blocks, count(*) FILTER (lane = 'vulnerable') AS vulnerable, count(*) FILTER (lane = 'fixed') AS fixed,
      count(DISTINCT l_suppkey) AS targets, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR)))[1:5], ',') AS first_targets FROM j GROUP BY 1, 2)
    SELECT *, vulnerable - fixed AS difference FROM g""")
def blocker_inventory(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", F.when(F.col("l_linestatus") == "O", "vulnerable").otherwise("fixed").alias("lane"))
    j = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return metrics.blocker_inventory(j, ["p_type", "l_returnflag"], "lane", "l_suppkey")


@query("""SELECT c_mktsegment, o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), (c_mktsegment, o_orderpriority))""")
def lane_family_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    j = o.join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return metrics.rollup_totals(j, [["c_mktsegment"], ["o_orderpriority"], ["c_mktsegment", "o_orderpriority"]], ["c_mktsegment", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus, l_quantity) AS INTEGER) AS margin
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_quantity)""")
def adjudication_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return metrics.crosstab(t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query("""WITH g AS (SELECT l_partkey, l_suppkey, max({'p': l_extendedprice, 'o': l_orderkey, 'n': l_linenumber}) AS m, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags,
    array_to_string(list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m'))), ',') AS months, count(*) AS merged FROM lineitem GROUP BY 1, 2)
    SELECT l_partkey, l_suppkey, m.p AS best_price, m.o AS l_orderkey, m.n AS l_linenumber, flags, months, merged FROM g""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("best_price"), F.array("l_returnflag").alias("flags"), F.array(F.date_format("l_shipdate", "yyyy-MM")).alias("months"))
    out = dedupe.merge_duplicates(li, ["l_partkey", "l_suppkey"], F.col("best_price"), ["best_price", "l_orderkey", "l_linenumber"], ["flags", "months"])
    return out.withColumn("flags", F.array_join("flags", ",")).withColumn("months", F.array_join("months", ","))


@query("""SELECT p_partkey, 'cluster:' || substr(sha256(p_brand || '|' || p_type), 1, 16) AS cluster_id,
    CAST(row_number() OVER w AS INTEGER) AS member_rank, first_value(p_partkey) OVER w AS representative, row_number() OVER w > 1 AS suppressed
    FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey DESC)""")
def mechanism_cluster(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return dedupe.cluster(p, ["p_brand", "p_type"], F.col("p_size"), "p_partkey").select("p_partkey", "cluster_id", "member_rank", "representative", "suppressed")


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text""")
def reconcile_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    kept, lost = dedupe.reconcile(docs, ["digest"], F.lit(0), F.col("doc_id"))
    return kept.join(lost.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest", "left").select("doc_id", "digest", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("copies"))


@query("""SELECT event_id, user_id, user_id || CASE WHEN k = 1 THEN '' ELSE '#raw' || k END AS unique_id FROM
    (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)""")
def fact_id_suffix(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.unique_suffix(t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) > 1 AS dup FROM events),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, dup ORDER BY ts, event_id) AS k FROM a)
    SELECT event_id, CASE WHEN dup THEN 'duplicate' WHEN k > 3 THEN 'capped' ELSE 'accepted' END AS outcome FROM b""")
def seed_caps(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("day"))
    return dedupe.seed_caps(e, ["user_id", "event_type", "day"], ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 3).select("event_id", "outcome")


@query("""SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, min(o_orderkey) AS position FROM orders GROUP BY 1""")
def report_representative(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedupe.report_representatives(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], F.col("o_orderkey")).select("o_custkey", "o_orderkey", "position")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def best_proof_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return dedupe.best_per_key(e, ["user_id"], rank, F.col("event_id"), last_wins=True).select("user_id", "event_id", "value")


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, bool_and(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_orderstatus, q AS quantity, coalesce(o_orderstatus = 'F' AND f AND q >= 50, FALSE) AS reportable FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def proof_gate_join(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.bool_and(F.col("l_linestatus") == "F").alias("f"))
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return joins.gate(o, l, ["o_orderkey"], (F.col("o_orderstatus") == "F") & F.col("f") & (F.col("quantity") >= 50)).drop("f")


@query("""WITH a AS (SELECT l_suppkey || ':' || l_returnflag AS metric, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
    b AS (SELECT l_suppkey || ':' || l_returnflag AS metric, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1)
    SELECT coalesce(a.metric, b.metric) AS metric, a.v AS now, b.v AS before, a.v - b.v AS delta,
      CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged'
           WHEN (coalesce(a.metric, b.metric) LIKE '%:R' AND a.v < b.v) OR (coalesce(a.metric, b.metric) NOT LIKE '%:R' AND a.v > b.v) THEN 'improved' ELSE 'regressed' END AS status
    FROM a FULL JOIN b ON a.metric = b.metric""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.concat_ws(":", "l_suppkey", "l_returnflag").alias("metric"), F.col("l_quantity").cast("long").alias("q"), F.year("l_shipdate").alias("y"))
    year = lambda y: li.where(F.col("y") == y).groupBy("metric").agg(F.sum("q").alias("value"))
    return metrics.metric_delta(year(1997), year(1996), F.col("metric").endswith(":R"))


@query("""WITH m AS (SELECT event_type AS metric, count(*) AS value FROM events GROUP BY 1), l(metric, least) AS (VALUES ('click', 1000000), ('view', 1), ('refund', 1))
    SELECT l.metric, CAST(least AS BIGINT) AS least, value, CASE WHEN value IS NULL THEN 'missing' ELSE 'below' END AS failure FROM l LEFT JOIN m USING (metric) WHERE value IS NULL OR value < least""")
def threshold_check(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    limits = spark.createDataFrame([("click", 1000000), ("view", 1), ("refund", 1)], "metric string, least long")
    return metrics.threshold_failures(m, limits)


@query("""SELECT c_nationkey AS nation, 'missing_expected' AS error FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    UNION ALL SELECT DISTINCT s_nationkey, 'forbidden_present' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def expectation_errors(spark: SparkSession, d: str) -> DataFrame:
    expected = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    observed = t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    forbidden = t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("nation"))
    return joins.expectation_errors(expected, observed, forbidden, ["nation"])


@query("""WITH f AS (SELECT doc_id, lang FROM documents WHERE n_chars > 1500), tr AS (SELECT l.doc_id, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN quality = 0 THEN 'negative' ELSE 'ignored' END AS kind FROM labels l JOIN documents USING (doc_id)),
    j AS (SELECT coalesce(f.lang, tr.lang) AS lang, f.doc_id IS NOT NULL AS hit, kind FROM f FULL JOIN tr ON f.doc_id = tr.doc_id),
    g AS (SELECT lang, count(*) FILTER (hit AND kind = 'positive') AS tp, count(*) FILTER (hit AND kind = 'negative') AS fp, count(*) FILTER (NOT hit AND kind = 'positive') AS fn,
      count(*) FILTER (hit AND (kind IS NULL OR kind = 'ignored')) AS ignored FROM j GROUP BY 1),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM g)
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive").when(F.col("quality") == 0, "negative").otherwise("ignored")
    truth = t(spark, d, "labels").select("doc_id", kind.alias("kind")).join(docs.select("doc_id", "lang"), "doc_id")
    return metrics.precision_recall(docs.where("n_chars > 1500"), truth, ["lang"], "doc_id")


@query("""WITH s AS (SELECT p_type, p_size, count(*) FILTER (p_brand = 'Brand#11') AS vulnerable, count(*) FILTER (p_brand = 'Brand#22') AS fixed FROM part GROUP BY 1, 2 HAVING count(*) FILTER (p_brand IN ('Brand#11', 'Brand#22')) > 0)
    SELECT *, least(vulnerable, fixed) AS shared, vulnerable - least(vulnerable, fixed) AS only_vulnerable, fixed - least(vulnerable, fixed) AS only_fixed FROM s""")
def pair_differential(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22")).select("p_type", "p_size", F.when(F.col("p_brand") == "Brand#11", "vulnerable").otherwise("fixed").alias("lane"))
    return differential.multiset_differential(p, ["p_type", "p_size"], "lane")


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F'),
    f AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT o_orderkey, k <= coalesce(n, 0) AND o_orderstatus = 'O' AS suppressed FROM v LEFT JOIN f USING (o_custkey, o_orderpriority)""")
def pair_suppression(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("vulnerable").alias("lane"))
    return differential.suppress_shared(o, ["o_custkey", "o_orderpriority"], "lane", [F.col("o_orderkey")], F.col("o_orderstatus") == "O").select("o_orderkey", "suppressed")


@query("""SELECT count(*) FILTER (s IS NULL) AS only_left, count(*) FILTER (c IS NULL) AS only_right, count(*) FILTER (s IS NULL OR c IS NULL) = 0 AS equal
    FROM (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON c = s""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    return differential.same_set(t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("""WITH w AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
    g AS (SELECT w.k, count(p.k) AS parts FROM w LEFT JOIN p ON w.k = p.k GROUP BY 1)
    SELECT k AS o_orderkey, parts, CASE WHEN parts = 0 THEN 'missing' ELSE 'overlap' END AS fault FROM g WHERE parts <> 1""")
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return differential.partition_check(o, [o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'F'")], "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_quantity > p_size THEN 'overflow' WHEN l_linenumber - 1 <= p_size - l_quantity THEN 'safe' ELSE 'overflow' END AS verdict,
    CASE WHEN l_quantity > p_size THEN 'width_exceeds_capacity' WHEN l_linenumber - 1 <= p_size - l_quantity THEN 'within_capacity' ELSE 'outside_capacity' END AS reason
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def write_classification(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    j = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    at = F.col("l_linenumber") - 1
    v = intervals.classify_write(F.col("l_partkey"), F.col("l_quantity"), F.col("p_size"), at, at)
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


ORDER_DAYS = "SELECT o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 90 AS e FROM orders"


def epoch_day(at: str) -> Column:
    """Day since 1970 of the nearest second, towards 1970."""
    return (F.rint(F.unix_micros(F.col(at).cast("timestamp")) / 1e6) / 86400).cast("long")


def order_days(spark: SparkSession, d: str) -> DataFrame:
    day = epoch_day("o_orderdate")
    return t(spark, d, "orders").select("o_custkey", day.alias("start"), (day + 90).alias("end"))


@query(f"""WITH i AS ({ORDER_DAYS}), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
    g AS (SELECT *, sum(CASE WHEN r >= s THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT o_custkey, min(s) AS start, max(e) AS "end", count(*) AS members FROM g GROUP BY o_custkey, k""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_intervals(order_days(spark, d), ["o_custkey"], "start", "end")


@query("""WITH d AS (SELECT DISTINCT o_custkey, epoch(o_orderdate)::BIGINT // 86400 AS s FROM orders), x AS (SELECT o_custkey, unnest(range(s, s + 90)) AS day FROM d),
    y AS (SELECT o_custkey, unnest(range(epoch(o_orderdate)::BIGINT // 86400, epoch(o_orderdate)::BIGINT // 86400 + 30)) AS day FROM orders WHERE o_orderstatus = 'F'),
    z AS (SELECT DISTINCT o_custkey, day FROM x EXCEPT SELECT o_custkey, day FROM y),
    g AS (SELECT *, day - row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS k FROM z)
    SELECT o_custkey, min(day) AS start, max(day) + 1 AS "end" FROM g GROUP BY o_custkey, k""")
def interval_difference(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where("o_orderstatus = 'F'")
    day = epoch_day("o_orderdate")
    return intervals.subtract_intervals(order_days(spark, d), o.select("o_custkey", day.alias("start"), (day + 30).alias("end")), ["o_custkey"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS a FROM lineitem), g AS (SELECT *, a - row_number() OVER (PARTITION BY l_orderkey ORDER BY a) AS k FROM l)
    SELECT l_orderkey, min(a) AS start, max(a) + 1 AS "end", count(*) AS regions FROM g GROUP BY l_orderkey, k""")
def stack_region_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_contiguous(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber", F.lit(1))


@query("""SELECT p_brand, max(p_size) AS low, min(p_retailprice) AS high, count(*) AS facts, max(p_size) > min(p_retailprice) AS empty FROM part GROUP BY 1""")
def tightest_bounds(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tightest_bounds(t(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query("""SELECT p_partkey, (SELECT min(q.p_partkey) FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey > p.p_partkey AND q.p_size >= 8) AS boundary FROM part p""")
def next_boundary(spark: SparkSession, d: str) -> DataFrame:
    return intervals.next_boundary(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_partkey", "p_size").select("p_partkey", "boundary")


def micros(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


SPANS = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS "at" FROM events),
    s AS (SELECT user_id, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS k FROM e WHERE event_type = 'signup'),
    p AS (SELECT user_id, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS k FROM e WHERE event_type = 'purchase'),
    sp AS (SELECT s.user_id, CAST(s.k AS INTEGER) AS k, s."at" AS "start", p."at" AS "end" FROM s JOIN p ON s.user_id = p.user_id AND s.k = p.k)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return joins.paired_spans(micros(spark, d), ["user_id"], [F.col("at"), F.col("event_id")], kind == "signup", kind == "purchase", "at")


@query(SPANS + """ SELECT sp.user_id, k, "start", "end", v.event_type, count(e.event_id) AS hits, count(e.event_id) > 0 AS observed
    FROM sp CROSS JOIN (VALUES ('click'), ('error')) v(event_type) LEFT JOIN e ON e.user_id = sp.user_id AND e.event_type = v.event_type AND e."at" >= "start" AND e."at" < "end" GROUP BY ALL""")
def trace_attribution(spark: SparkSession, d: str) -> DataFrame:
    e = micros(spark, d)
    return lifecycle.attribute_hits(spans(spark, d), e.where(F.col("event_type").isin("click", "error")), ["user_id"], "at", "event_type", ["click", "error"], 6 * 3600e6)


@query(SPANS + """, b AS (SELECT user_id, min("at") AS base FROM e WHERE event_type = 'view' GROUP BY 1)
    SELECT e.event_id, CASE WHEN base IS NULL OR "at" < base THEN 'startup_or_setup' ELSE 'idle_after_initialization' END AS phase
    FROM e LEFT JOIN b USING (user_id) WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.user_id = e.user_id AND e."at" >= "start" AND e."at" < "end")""")
def idle_hits(spark: SparkSession, d: str) -> DataFrame:
    e = micros(spark, d)
    outside = joins.range_join(e.where("event_type = 'error'"), spans(spark, d), ["user_id"], "at", "start", "end", 6 * 3600e6, "left_anti")
    base = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("at").alias("base"))
    return outside.join(base, "user_id", "left").select("event_id", F.when(F.coalesce(F.col("at") < F.col("base"), F.lit(True)), "startup_or_setup").otherwise("idle_after_initialization").alias("phase"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS "at" FROM events WHERE event_type = 'error'), v AS (SELECT event_id, user_id, epoch_us(ts) AS "at" FROM events WHERE event_type = 'view'),
    j AS (SELECT e.user_id, e."at", e.event_id, v."at" AS nearest_at, v.event_id AS nearest_id, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e."at" - v."at"), v."at", v.event_id) AS k FROM e LEFT JOIN v USING (user_id))
    SELECT user_id, "at", event_id, nearest_at, nearest_id FROM j WHERE k = 1""")
def nearest_operation(spark: SparkSession, d: str) -> DataFrame:
    e = micros(spark, d).select("event_id", "user_id", "event_type", "at")
    return joins.nearest(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), ["user_id"], "at", "event_id")


@query("""SELECT event_id, (SELECT arg_min(n.event_id, (n.ts, n.event_id)) FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'purchase' AND (n.ts, n.event_id) > (e.ts, e.event_id)) AS consumer FROM events e WHERE event_type = 'signup'""")
def asof_consumer(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    out = joins.next_after(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", F.col("event_id"), "consumer")
    return out.where("event_type = 'signup'").select("event_id", "consumer")


ACTION = "CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'purchase' THEN 'release' WHEN 'error' THEN 'scope_exit' ELSE 'use' END"
LEDGER = f"""WITH e AS (SELECT event_id, user_id, ts, {ACTION} AS action FROM events),
    g AS (SELECT *, CAST(sum(CASE WHEN action = 'acquire' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS generation,
      last_value(CASE WHEN action IN ('acquire', 'release') THEN action = 'acquire' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM e),
    l AS (SELECT event_id, user_id, ts, action, generation, coalesce(lb, FALSE) AS live_before FROM g WHERE generation > 0)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "acquire").when(kind == "purchase", "release").when(kind == "error", "scope_exit").otherwise("use")
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return lifecycle.resource_ledger(e, ["user_id"], [F.col("ts"), F.col("event_id")], action)


@query(LEDGER + """ SELECT event_id, user_id, action, generation, live_before, CASE WHEN action = 'release' AND NOT live_before THEN 'duplicate_release' WHEN action = 'use' AND NOT live_before THEN 'use_after_release'
    WHEN action = 'scope_exit' AND live_before THEN 'leak' END AS violation FROM l""")
def resource_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("event_id", "user_id", "action", "generation", "live_before", "violation")


@query(LEDGER + """ SELECT user_id, max(generation) AS generation FROM l WHERE action IN ('acquire', 'release') GROUP BY 1 HAVING arg_max(action, (ts, event_id)) = 'acquire'""")
def open_resources(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.open_resources(ledger(spark, d), ["user_id"], F.struct("ts", "event_id"))


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {ACTION} AS action FROM events),
    s AS (SELECT *, last_value(CASE WHEN action IN ('acquire', 'release') THEN action || ':' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e)
    SELECT user_id, CAST(split_part(st, ':', 2) AS BIGINT) AS release_id, event_id AS use_id FROM s WHERE action = 'use' AND st LIKE 'release:%'""")
def release_use_pairs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "acquire").when(kind == "purchase", "release").when(kind == "error", "scope_exit").otherwise("use")
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return lifecycle.release_use_pairs(e, ["user_id"], [F.col("ts"), F.col("event_id")], action, "event_id")


REACH = """WITH c AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
      row_number() OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS INTEGER) ORDER BY ts, event_id) = 1 AS fresh, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS reused, ts FROM events),
    r AS (SELECT user_id, event_id, CAST(step AS INTEGER) AS step, reused, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step) AS BIGINT) AS reached FROM c)"""


def reach(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("item"), F.lit(1).alias("cost"))
    return lifecycle.cumulative_reach(e, ["user_id"], [F.col("ts"), F.col("event_id")], "item", "cost", "event_type")


@query(REACH + " SELECT user_id, event_id, step, reused, reached FROM r")
def cumulative_reach(spark: SparkSession, d: str) -> DataFrame:
    return reach(spark, d).select("user_id", "event_id", "step", "reused", "reached")


@query(REACH + " SELECT user_id, CAST(sum(reached) AS BIGINT) AS auc, max(reached) AS reach, count(*) FILTER (reused) AS reuse, CAST(1 AS BIGINT) AS first_cost FROM r GROUP BY 1")
def reach_summary(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reach_summary(reach(spark, d), ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 7200 THEN 0 ELSE 1 END AS n FROM e),
    k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS INTEGER) AS session FROM g)
    SELECT user_id, session, min(s) AS "start", max(s) AS "end", count(*) AS events FROM k GROUP BY 1, 2""")
def quiescence_sessions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.sessions(micros(spark, d), ["user_id"], [F.col("at"), F.col("event_id")], F.col("at") / 1e6, 7200)


@query("""WITH r AS (SELECT p_type, l_returnflag, l_linestatus = 'F' AS ok FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT p_type, l_returnflag, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS x FROM r GROUP BY 1, 2),
    b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS route_n, CAST(sum(x) OVER (PARTITION BY l_returnflag) AS BIGINT) AS route_x FROM a)
    SELECT *, CASE WHEN n >= 2 THEN (1 + x) / (2 + n) WHEN route_n >= 2 THEN (1 + route_x) / (2 + route_n) ELSE 0.5 END AS probability, CASE WHEN n >= 2 THEN 'pair' WHEN route_n >= 2 THEN 'route' ELSE 'uniform' END AS basis FROM b""")
def yield_model(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_linestatus").join(t(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return scheduling.yield_model(j, "p_type", "l_returnflag", F.col("l_linestatus") == "F")


@query("""SELECT CASE WHEN l_linenumber > 5 THEN 'unshared:' || l_orderkey || ':' || l_partkey ELSE 'supplier:' || l_suppkey END AS setup_key, l_returnflag, count(*) AS attempts,
    CAST(sum(l_linenumber + l_quantity) AS DOUBLE) AS unbatched, CAST(max(l_linenumber) + sum(l_quantity) AS DOUBLE) AS batched, greatest(0.0, CAST(sum(l_linenumber + l_quantity) - max(l_linenumber) - sum(l_quantity) AS DOUBLE)) AS saved FROM lineitem GROUP BY 1, 2""")
def proof_batches(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_linenumber").cast("double").alias("setup"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("marginal"))
    key = F.when(F.col("line") > 5, F.concat_ws(":", F.lit("unshared"), "l_orderkey", "l_partkey")).otherwise(F.concat_ws(":", F.lit("supplier"), "l_suppkey"))
    return scheduling.proof_batches(li, key, "l_returnflag", "setup", "marginal")


@query("""SELECT event_type, median(value) AS median, count(value) AS n FROM events WHERE value > 0 GROUP BY 1""")
def measured_cost(spark: SparkSession, d: str) -> DataFrame:
    return metrics.medians(t(spark, d, "events").where("value > 0"), ["event_type"], F.col("value"))


@query("""SELECT c_custkey, CAST(CAST('0x' || substr(sha256('seed' || chr(0) || c_custkey), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS score FROM customer""")
def seeded_random_order(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", scheduling.seeded_score("seed", F.col("c_custkey")).alias("score"))


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS score, p_retailprice AS cost, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part),
    r AS (SELECT p_brand, p_partkey, score, cost, k, cost <= 20000 AS selected, CASE WHEN cost <= 20000 THEN cost ELSE 0.0::DOUBLE END AS spent FROM o WHERE k = 1 UNION ALL
      SELECT o.p_brand, o.p_partkey, o.score, o.cost, o.k, r.spent + o.cost <= 20000, CASE WHEN r.spent + o.cost <= 20000 THEN r.spent + o.cost ELSE r.spent END FROM r JOIN o ON o.p_brand = r.p_brand AND o.k = r.k + 1)
    SELECT p_brand, p_partkey, score, cost, k AS rank, selected, spent FROM r""")
def budget_schedule(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("score"), F.col("p_retailprice").alias("cost"))
    return scheduling.budget_schedule(p, ["p_brand"], "score", "p_partkey", "cost", 20_000.0)


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nation graph: from a customer's nation to the nations of suppliers with the same last digit of the key."""
    c = t(spark, d, "customer").select((F.col("c_custkey") % 500).alias("k"), F.col("c_nationkey").cast("string").alias("src"))
    s = t(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 500).alias("k"), F.col("s_nationkey").cast("string").alias("dst"))
    return c.join(s, "k").where("CAST(src AS INT) % 5 = CAST(dst AS INT) % 5 OR CAST(dst AS INT) = CAST(src AS INT) + 1").select("src", "dst").distinct()


TRADE = """WITH RECURSIVE g AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst FROM customer JOIN supplier ON c_custkey % 500 = s_suppkey * 7 % 500
    WHERE (c_nationkey % 5 = s_nationkey % 5 OR s_nationkey = c_nationkey + 1)),"""


@query(TRADE + """ r(node, depth) AS (SELECT '0', 0 UNION SELECT dst, depth + 1 FROM r JOIN g ON node = src WHERE depth < 16) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("0", 0)], "node string, ordinal int")
    return graph.bfs(graph.degree_order(trade(spark, d)), start).select("node", "depth")


@query(TRADE + """ c(src, dst) AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src) SELECT src, dst FROM c""")
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(trade(spark, d)).select("src", "dst")


@query(TRADE + """ n AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS node FROM nation) SELECT node FROM n WHERE node NOT IN (SELECT dst FROM g WHERE src <> dst)""")
def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node")), trade(spark, d))


@query(TRADE + """ tr AS (SELECT src, dst FROM g WHERE CAST(src AS INT) % 3 = 0), c(src, dst) AS (SELECT src, dst FROM tr UNION SELECT c.src, tr.dst FROM c JOIN tr ON c.dst = tr.src)
    SELECT src, dst FROM g UNION SELECT g.src, c.dst FROM g JOIN c ON g.dst = c.src WHERE g.src <> c.dst AND c.src <> c.dst""")
def transparent_contraction(spark: SparkSession, d: str) -> DataFrame:
    nodes = t(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("node"))
    return graph.contract(trade(spark, d), nodes)


@query(TRADE + """ u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r(node, depth) AS (SELECT '3', 0 UNION SELECT dst, depth + 1 FROM r JOIN u ON node = src WHERE depth < 25) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def taint_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.propagate(trade(spark, d), spark.createDataFrame([("3",)], "node string"))


@query("""WITH c AS (SELECT *, CASE role WHEN 'user' THEN 'source' WHEN 'assistant' THEN 'internal_local' ELSE 'constant' END AS kind FROM conversations),
    r AS (SELECT *, list_position(['constant', 'internal_local', 'unknown', 'parameter', 'source'], kind) AS k FROM c)
    SELECT conv_id, turn, coalesce(['constant', 'internal_local', 'unknown', 'parameter', 'source'][max(k) OVER w], 'unknown') AS strongest, coalesce(last_value(kind IGNORE NULLS) OVER w, 'unknown') AS last_write
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)""")
def taint_lattice(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    kind = F.when(F.col("role") == "user", "source").when(F.col("role") == "assistant", "internal_local").otherwise("constant")
    return lifecycle.taint_state(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], kind, 2).select("conv_id", "turn", "strongest", "last_write")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]{20,}')) AS x FROM documents), s AS (SELECT DISTINCT doc_id, x, len(list_distinct(string_split(x, ''))) AS n,
    regexp_matches(x, '[a-z]')::INT + regexp_matches(x, '[A-Z]')::INT + regexp_matches(x, '[0-9]')::INT + regexp_matches(x, '[_.-]')::INT AS c FROM w)
    SELECT doc_id, substr(sha256(x), 1, 16) AS fingerprint, CAST(length(x) AS INTEGER) AS length FROM s WHERE c >= 2 AND n >= 10 AND n > length(x) // 4 AND NOT regexp_matches(lower(x), 'example|template|placeholder|changeme|your_|xxxx')""")
def literal_scan(spark: SparkSession, d: str) -> DataFrame:
    words = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.-]{20,}"), F.lit(0)))).alias("x"))
    return words.where(X.token_shape(F.col("x"), classes=2)).select("doc_id", X.fingerprint(F.col("x")).alias("fingerprint"), F.length("x").alias("length"))


@query(r"""WITH r AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '["''](/[A-Za-z0-9_./-]{2,})["'']', 1))) AS route FROM pages) SELECT route, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM r GROUP BY 1""")
def route_inventory(spark: SparkSession, d: str) -> DataFrame:
    r = readers.route_inventory(t(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text")))
    return r.groupBy("route").agg(F.count_distinct("path").alias("pages"), F.min("path").alias("first_page"))


@query("""SELECT source, sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || sha256(text), chr(10) ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS digest, count(*) AS files FROM documents GROUP BY 1""")
def tree_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return R.tree_hash(docs, ["source"], "path", F.col("text"))


@query("""SELECT event_type || ':k' AS key, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS n FROM events GROUP BY 1""")
def map_count_merge(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform_keys(F.from_json("props", "map<string,int>"), lambda k, _: F.concat_ws(":", F.col("event_type"), k))
    return metrics.merge_count_maps(t(spark, d, "events").select("event_type", m.alias("m")), F.col("m"))


@query(r"""WITH r AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(o_orderpriority || ' Order#' || o_orderkey || ' at 0x' || to_hex(o_custkey) || '!!'), '0x[0-9a-f]+', '<address>', 'g'), '\b\d+\b', '<n>', 'g'), '[^a-z0-9_< >]+', '_', 'g'), '_+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g') AS reason FROM orders)
    SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def reason_normalizer(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("o_orderpriority", F.lit(" Order#"), F.col("o_orderkey").cast("string"), F.lit(" at 0x"), F.hex("o_custkey"), F.lit("!!"))
    return t(spark, d, "orders").select(X.normalize_reason(raw).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT p_brand, p_container, count(*) FILTER (lane = 'vulnerable') AS vulnerable, count(*) FILTER (lane = 'fixed') AS fixed FROM (SELECT p_brand, p_type AS p_container, CASE WHEN p_size > 25 THEN 'vulnerable' ELSE 'fixed' END AS lane, p_retailprice FROM part) GROUP BY 1, 2)
    SELECT p_brand || '/' || p_container AS grp, vulnerable, fixed, vulnerable > 0 AND fixed = 0 AS separated FROM g""")
def historical_separation(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("grp"), F.when(F.col("p_size") > 25, "vulnerable").otherwise("fixed").alias("lane"))
    return metrics.lane_separation(p, "grp", "lane", F.lit(True))


@query("""SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 10""")
def node_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.skip_take(t(spark, d, "part").select("p_partkey", "p_size"), [F.desc("p_size"), F.asc("p_partkey")], 10, 25)


@query("""SELECT p_type, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5""")
def top_clusters_per_class(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_type", "p_partkey", "p_retailprice")
    return selection.top_per_class(p, ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_type", "p_partkey", "place")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM f WHERE k = 1)
    SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM g WHERE place <= 2""")
def replay_plan_select(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return selection.unique_then_limit(o, ["o_custkey", "o_orderpriority"], ["o_custkey"], [F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "place")


@query("""WITH c AS (SELECT l_quantity > 25 AS truth, p.policy, CASE p.policy WHEN 'always' THEN TRUE WHEN 'never' THEN FALSE WHEN 'discount' THEN CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount > 0.05 END ELSE l_linestatus = 'F' END AS v
      FROM lineitem, (VALUES ('always'), ('never'), ('discount'), ('status')) p(policy)),
    g AS (SELECT policy, count(*) FILTER (v AND truth) AS reported, count(*) FILTER (v AND NOT truth) AS false_positive, count(*) FILTER (NOT v AND truth) AS missed, count(*) FILTER (NOT v AND NOT truth) AS clean, count(*) FILTER (v IS NULL) AS blocked FROM c GROUP BY 1)
    SELECT *, reported / nullif(reported + missed, 0) AS conditional_recall, false_positive / nullif(false_positive + clean, 0) AS conditional_fpr FROM g""")
def baseline_policies(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    rules = {"always": F.lit(True), "never": F.lit(False), "discount": F.when(F.col("l_returnflag") != "N", F.col("l_discount") > 0.05), "status": F.col("l_linestatus") == "F"}
    return selection.policies(li, rules, F.col("l_quantity") > 25)


@query("""WITH r AS (SELECT p_partkey, p_brand, p_type AS route, p_size % 2 = 0 AS viable, p_retailprice / 100.0 * 0.5 / greatest(0.05, p_size) AS v FROM part)
    SELECT p_brand, coalesce(max(CASE WHEN viable THEN v END), -1000000.0) AS ranking, arg_max(route, (v, route)) FILTER (viable) AS route FROM r GROUP BY 1""")
def route_choice(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_brand", F.col("p_type").alias("route"), (F.col("p_size") % 2 == 0).alias("viable"), "p_retailprice", "p_size")
    return selection.route_choice(p, "p_brand", F.col("p_retailprice") / 100.0, F.lit(0.5), F.col("p_size"))


@query(SPANS + """ SELECT user_id, median("end" - "start") AS median, count(*) AS spans FROM sp WHERE "end" >= "start" GROUP BY 1""")
def span_medians(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return selection.median_spans(micros(spark, d), ["user_id"], [F.col("at"), F.col("event_id")], kind == "signup", kind == "purchase", "at")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'candidate' WHEN 'view' THEN 'proof_ready' WHEN 'click' THEN 'proving' WHEN 'purchase' THEN 'proven' ELSE 'blocked' END AS state FROM events),
    l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e)
    SELECT event_id, previous, state FROM l WHERE previous <> state AND (previous || '>' || state) NOT IN ('candidate>proof_ready', 'candidate>blocked', 'proof_ready>proving', 'proof_ready>blocked', 'proving>proven', 'proving>blocked', 'proven>blocked', 'blocked>candidate', 'blocked>proof_ready')""")
def status_machine(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "signup", "candidate").when(kind == "view", "proof_ready").when(kind == "click", "proving").when(kind == "purchase", "proven").otherwise("blocked")
    e = t(spark, d, "events").select("event_id", "user_id", "ts", state.alias("state"))
    return selection.illegal_moves(e, ["user_id"], [F.col("ts"), F.col("event_id")], "state").select("event_id", "previous", "state")


@query("""SELECT l_suppkey % 10 AS grp, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, count(DISTINCT l_partkey) AS parts, median(l_quantity) AS median_quantity, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1""")
def scale_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("grp"), "l_returnflag", "l_partkey", "l_quantity", "l_shipdate")
    return metrics.scale_rollup(li, ["grp"], {"returned": F.col("l_returnflag") == "R"}, {"parts": "l_partkey"}, {"median_quantity": "l_quantity"}, {"last_ship": "l_shipdate"})


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_totalprice > 300000""")
def seed_enrichment(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = t(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    found = joins.enrich(o, [(c, ["c_custkey"]), (n, ["n_nationkey"]), (t(spark, d, "region").where("r_name = 'ASIA'"), ["r_regionkey"])])
    return found.select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT conv_id, array_to_string(list(role ORDER BY turn, role, text), '>') AS roles, count(*) AS turns FROM conversations GROUP BY 1""")
def trace_construction(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    out = R.ordered_lists(c, ["conv_id"], ["turn", "role", "text"], "role")
    return out.select("conv_id", F.array_join("items", ">").alias("roles"), F.col("n").alias("turns"))


from . import extract_queries, gate_queries, proof_queries, rule_queries, source_queries  # noqa: E402, F401  (they register their queries here)
