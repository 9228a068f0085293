"""Queries of gates, ELF parts and p-code candidates, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import candidates as C
from .functions import gates
from .plans import extract
from .queries import query, t
from .source_queries import documents_of, folder
from .sources import elf, readers

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_quantity < 5 THEN NULL WHEN l_linenumber = 1 THEN CASE WHEN l_tax > 0.03 THEN 'exact_overflow' END WHEN l_linenumber = 2 THEN CASE WHEN l_tax > 0.03 THEN 'unbounded_sink' END
      WHEN l_linenumber = 3 THEN CASE WHEN l_returnflag <> 'N' AND l_discount > 0.02 THEN 'controlled_offset' END WHEN l_linenumber = 4 THEN CASE WHEN l_suppkey > 4 AND l_discount > 0.02 THEN 'controlled_extent' END WHEN l_linenumber = 5 THEN CASE WHEN l_linestatus = 'O' THEN 'loop_alias_frontier' END END AS rule,
    CASE WHEN l_quantity < 5 THEN NULL WHEN l_linenumber = 1 THEN CASE WHEN l_tax > 0.03 THEN 'exact_oob_read' END WHEN l_discount > 0.02 THEN CASE l_linenumber WHEN 4 THEN 'controlled_extent' WHEN 2 THEN 'controlled_read_offset' END END AS read_rule FROM lineitem""")
def confirmation_rules(spark: SparkSession, d: str) -> DataFrame:
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    relation = F.when(n == 3, "symbolic_offset").when(n == 4, "append_length_unknown").when(n == 5, "iterated_alias_unproven").when(n <= 2, "none")
    verdict = F.when(n == 1, "overflow").when(n == 2, "unbounded").otherwise("candidate")
    offset = F.when(flag == "R", "source_controlled").when(flag == "A", "unknown").otherwise("constant")
    able, path, act = F.col("l_quantity") >= 5, F.col("l_tax") > 0.03, F.col("l_discount") > 0.02
    rule = gates.confirmation_rule(able, verdict, relation, path, offset, F.col("l_suppkey") > 4, F.col("l_linestatus") == "O", act)
    read = gates.read_confirmation_rule(able, F.when(n == 1, "proven_oob_read").when(n == 4, "symbolic_size").when(n == 2, "symbolic_read_offset"), path, act)
    return t(spark, d, "lineitem").select(*LINE, rule.alias("rule"), read.alias("read_rule"))


@query("""SELECT c_custkey, (c_nationkey < 6 AND c_acctbal > 0) OR (c_nationkey % 2 = 0 AND c_mktsegment = 'FURNITURE') OR (c_nationkey % 3 = 0 AND c_mktsegment IN ('FURNITURE', 'BUILDING')) AS deterministic, c_nationkey = 4 OR c_acctbal > 9000 OR c_nationkey < 3 AS reportable FROM customer""")
def input_gates(spark: SparkSession, d: str) -> DataFrame:
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    blockers = F.when(F.col("c_acctbal") > 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b")))
    role = F.struct(F.lit("write_size").alias("name"), F.when(seg == "FURNITURE", "source_controlled").when(seg == "BUILDING", "parameter_controlled").otherwise("constant").alias("class"), F.lit(True).alias("complete"))
    ready = gates.deterministic_input(F.when(n < 6, "Complete"), F.lit(True), blockers, F.lit(True), n % 2 == 0, n % 3 == 0, F.array(role))
    report = gates.reportable_flow(F.array(F.lit(None).cast("boolean"), n == 4), F.when(F.col("c_acctbal") > 9000, True), F.when(n < 3, "proven"))
    return t(spark, d, "customer").select("c_custkey", ready.alias("deterministic"), report.alias("reportable"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'token-' || p_size || '=function_string;' ELSE '' END || CASE WHEN p_name LIKE '%widget%' THEN '/api/widget/token=route' ELSE '' END AS signals FROM part""")
def string_signals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    strings = F.array(F.concat(F.when(F.col("p_size") % 2 == 0, "token-").otherwise("key-"), n), F.concat(F.when(F.col("p_size") % 2 == 0, "token-").otherwise("key-"), n))
    out = gates.string_signals(strings, F.array(F.lit("/api/widget/token"), F.lit("/zz/qq/token")), C.haystack([F.col("p_name")], []), "token")
    joined = F.array_join(F.transform(out, lambda x: F.concat(x["anchor"], F.lit("="), x["kind"])), ";")
    return t(spark, d, "part").select("p_partkey", F.when(joined.rlike("function_string$"), F.concat(joined, F.lit(";"))).otherwise(joined).alias("signals"))


def _le(value: Column, size: int) -> Column:
    """Little-endian hexadecimal of a number below 2**31."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


@query("""SELECT 'b' || s_suppkey AS path, sha256(unhex(lpad(to_hex(s_suppkey + 4), 16, '0') || repeat('90', CAST(s_suppkey + 4 AS INTEGER)))) AS sha256, CAST(s_suppkey + 4 AS BIGINT) AS size_bytes, 1 AS segments, CAST(4194304 + s_suppkey AS VARCHAR) AS address FROM supplier""")
def elf_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier as a 64-bit file with one executable segment of its own size, and one of data."""
    k = F.col("s_suppkey")
    size, zero = k + 4, F.lit(0)
    head = F.concat(F.lit("7f454c46020101" + "00" * 9 + "02003e0001000000"), _le(zero, 8), _le(F.lit(64), 8), _le(zero, 8), _le(zero, 4), F.lit("40003800020040000000" + "0000"))
    program = lambda flags, n: F.concat(_le(F.lit(1), 4), _le(F.lit(flags), 4), _le(F.lit(176), 8), _le(k + 4194304, 8), _le(zero, 8), _le(n, 8), _le(n, 8), _le(zero, 8))
    content = F.unhex(F.concat(head, program(5, size), program(6, F.lit(2)), F.expr("repeat('90', CAST(s_suppkey + 4 AS INT))")))
    files = t(spark, d, "supplier").select(F.concat(F.lit("b"), k.cast("string")).alias("path"), content.alias("content"))
    code = elf.parts(files).where("kind = 'segment' AND flags = 5").select("path", F.col("address").cast("string").alias("address"))
    return elf.fingerprints(files).join(code, "path")


@query("""SELECT p_brand AS "binary", 'f' || p_partkey AS function, 'pcode_call' AS kind, CASE WHEN p_size > 16 THEN 'overflow' ELSE 'safe' END AS verdict, CAST(p_size AS BIGINT) AS width FROM part
    UNION ALL SELECT p_brand, 'f' || p_partkey, 'pcode_store', CASE WHEN p_size + 4 > 16 THEN 'overflow' ELSE 'safe' END, 4 FROM part""")
def pcode_candidates(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    arg = lambda name, constant: F.struct(name.cast("string").alias("var_name"), constant.cast("bigint").alias("constant"))
    none = F.lit(None)
    call = F.struct(F.concat(F.lit("0x"), F.hex(k * 16)).alias("call_address"), F.lit("__builtin_memcpy").alias("callee"), F.array(arg(F.lit("buf"), none), arg(F.lit("src"), none), arg(none, n)).alias("args"))
    store = F.struct(F.concat(F.lit("0x"), F.hex(k * 16 + 4)).alias("operation_address"), F.lit(4).alias("write_width"), F.array(F.lit("buf")).alias("address_vars"), F.array(n.cast("bigint")).alias("address_constants"))
    region = F.struct(F.lit(-16).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit(16).alias("size_bytes"), F.array(F.lit("buf")).alias("var_names"))
    f = F.struct(F.concat(F.lit("0x"), F.hex(k + 4096)).alias("address"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.array(call).alias("pcode_calls"), F.array(store).alias("pcode_stores"), F.array(region).alias("stack_regions"))
    made = t(spark, d, "part").groupBy(F.col("p_brand").alias("binary")).agg(F.lit("0x1000").alias("image_base"), F.collect_list(f).alias("functions"))
    out = extract.pcode_candidates(readers.functions(spark, documents_of(made, folder(spark, d, "pcode_exports"))))
    return out.select("binary", "function", "kind", "verdict", "width")
