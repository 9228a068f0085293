"""Program index and discovery rules over decompiler exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def operations(functions: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per call, store or load: function, address, kind, name, semantics and arguments."""
    call = functions.select("binary", F.col("name").alias("function"), F.explode("pcode_calls").alias("c")).select("binary", "function", X.address(F.col("c.call_address")).alias("address"), F.lit("call").alias("kind"), X.operation_name(F.col("c.callee")).alias("alias"), F.transform("c.args", lambda a: a["repr"]).alias("arguments"))
    access = lambda column, kind, width: functions.select("binary", F.col("name").alias("function"), F.explode(column).alias("c")).select("binary", "function", X.address(F.col("c.operation_address")).alias("address"), F.lit(kind).alias("kind"), F.concat(F.lit(kind + "_"), F.coalesce(F.col(f"c.{width}").cast("string"), F.lit("?"))).alias("alias"), F.col("c.address_vars").alias("arguments"))
    every = call.unionByName(access("pcode_stores", "store", "write_width")).unionByName(access("pcode_loads", "load", "read_width"))
    known = every.join(specs.select("alias", F.col("name").alias("canonical"), "semantics", "effect_kind"), "alias", "left")  # small: AQE broadcasts it by its measured size
    return known.select("binary", "function", "address", "kind", F.coalesce("canonical", "alias").alias("name"), "semantics", "effect_kind", "arguments").distinct()


def memory_objects(functions: DataFrame) -> DataFrame:
    """Stack objects of the exports, with capacity."""
    r = functions.select("binary", F.col("name").alias("function"), F.explode("stack_regions").alias("r"))
    name = F.coalesce(F.get("r.var_names", F.lit(0)), F.concat(F.lit("stack"), X.stack_offset(F.col("r.start_offset").cast("long"))))
    return r.select("binary", "function", F.concat_ws(":", F.lit("stack"), "function", F.col("r.start_offset").cast("string")).alias("identity"), name.alias("name"), F.lit("stack").alias("kind"), F.col("r.size_bytes").cast("long").alias("capacity_bytes"))


def strings(functions: DataFrame) -> DataFrame:
    s = functions.select("binary", F.col("name").alias("function"), F.explode("string_refs").alias("s"))
    return s.select("binary", "function", X.address(F.col("s.address")).alias("address"), F.col("s.value").alias("value")).distinct()


def literal_consumers(literals: DataFrame, ops: DataFrame) -> DataFrame:
    """Literals with the calls of the same function that take them, by value or by address."""
    calls = ops.where("kind = 'call'").select("binary", "function", F.col("address").alias("call_address"), "name", F.posexplode("arguments").alias("position", "argument"))
    j = literals.join(calls, ["binary", "function"])
    hit = F.contains("argument", "value") | F.contains("argument", "address")
    first = Window.partitionBy("binary", "function", "address", "value", "call_address").orderBy("position")
    return j.where(hit).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("binary", "function", "address", X.fingerprint(F.col("value")).alias("fingerprint"), "call_address", "name", "position")


def lifecycle_events(ops: DataFrame) -> DataFrame:
    """allocate / use / release rows of resources named by a call's first argument."""
    action = F.when(F.col("semantics") == "allocate", "acquire").when(F.col("semantics") == "release", "release").when(F.col("semantics").isNotNull(), "use")
    return ops.where("kind = 'call'").select("binary", "function", "address", X.cast_stripped(F.get("arguments", F.lit(0))).alias("identity"), action.alias("action")).where("action IS NOT NULL AND identity IS NOT NULL")


#: Sinks of the text rules, and the argument that must be untrusted.
PATTERNS = {
    "command_injection": ("system|popen|execl|execlp|execv|execvp", 1),
    "path_traversal": ("open|fopen|unlink|rename|chmod|opendir", 1),
    "format_string": ("printf|vprintf|syslog", 1),
    "unsafe_copy": ("strcpy|strcat|gets|sprintf|vsprintf", 2),
}
UNTRUSTED = r"(?i)argv|getenv|recv|read|input|param|request|query|buf"


def untrusted(expression: Column) -> Column:
    """Not a literal or number, and named like outside data."""
    fixed = expression.rlike(r'^\s*"') | expression.rlike(r"^\s*-?(0x)?[0-9a-fA-F]+\s*$")
    return F.coalesce(~fixed & expression.rlike(UNTRUSTED), F.lit(False))


def semantic_candidates(ops: DataFrame) -> DataFrame:
    """Calls of pattern sinks whose deciding argument looks untrusted, with a stable id."""
    rows = None
    for kind, (names, position) in PATTERNS.items():
        hit = ops.where((F.col("kind") == "call") & F.col("name").rlike(f"^({names})$") & untrusted(F.get("arguments", F.lit(position - 1))))
        hit = hit.withColumn("vulnerability_type", F.lit(kind)).withColumn("expression", F.get("arguments", F.lit(position - 1)))
        rows = hit if rows is None else rows.unionByName(hit)
    return rows.select(X.stable_id(F.col("binary"), F.col("function"), F.col("address"), F.col("vulnerability_type")).alias("candidate_id"), "binary", "function", "address", "vulnerability_type", "name", "expression")


def sink_audit(ops: DataFrame, n: int = 20) -> DataFrame:
    """Call names without a specification, most frequent first, with five example places."""
    place = F.concat_ws(":", "binary", "function", "address")
    unknown = ops.where("kind = 'call' AND semantics IS NULL")
    each = unknown.groupBy("name", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy("place")))
    first = F.array_sort(F.collect_list(F.when(F.col("_rn") <= 5, F.col("place"))))
    return each.groupBy("name").agg(F.sum("n").alias("n"), first.alias("examples")).orderBy(F.desc("n"), "name").limit(n)


def block_relation(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether two addresses lie in one block (and in which order) or in different ones.

    ``blocks``: function, start, end (numbers). ``pairs``: function, id, before, after.
    Addresses find their block by the last start at or before them, not by a range join.
    """

    def locate(column: str) -> DataFrame:
        at = pairs.select("function", "id", F.col(column).alias("at"), F.lit(None).cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"))
        b = blocks.select("function", F.lit(None).cast(pairs.schema["id"].dataType).alias("id"), F.col("start").alias("at"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        w = Window.partitionBy("function").orderBy(F.col("at"), F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        got = b.unionByName(at).withColumn("_b", F.last(F.when(F.col("_start").isNotNull(), F.struct("_start", "_end")), ignorenulls=True).over(w))
        inside = F.when(F.col("at") <= F.col("_b._end"), F.col("_b._start"))
        return got.where("id IS NOT NULL").select("function", "id", inside.alias(f"{column}_block"))

    j = pairs.join(locate("before"), ["function", "id"]).join(locate("after"), ["function", "id"])
    kind = (
        F.when(F.col("before_block").isNull() | F.col("after_block").isNull(), "unresolved_block")
        .when((F.col("before_block") == F.col("after_block")) & (F.col("before") < F.col("after")), "same_block_before")
        .when(F.col("before_block") == F.col("after_block"), "same_block_after")
        .otherwise("different_blocks")
    )
    return j.withColumn("relation", kind)
