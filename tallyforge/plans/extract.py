"""Candidates from C text: statements, calls, objects and loops as tables, joined and classified.

A function's text becomes rows once (Arrow UDFs of ``clex``); all later steps are joins on
(function, name) and column expressions, so functions spread over the cluster and each
rule adds a projection, not a pass. Tables carry ``function`` as their only key: make it
unique (binary and name) where names repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clex
from ..functions import text as X
from ..operators import dedupe, intervals, lifecycle
from ..sources import dims

#: Calls that write, with what bounds them and the places of destination, source and size (from 0).
WRITERS = [
    ("strcpy", "unbounded", 0, 1, None), ("strcat", "append", 0, 1, None), ("gets", "unbounded", 0, None, None), ("sprintf", "unbounded", 0, None, None), ("vsprintf", "unbounded", 0, None, None),
    ("memcpy", "bounded", 0, 1, 2), ("memmove", "bounded", 0, 1, 2), ("memset", "bounded", 0, None, 2), ("strncpy", "bounded", 0, 1, 2), ("snprintf", "bounded", 0, None, 1), ("read", "bounded", 1, None, 2), ("recv", "bounded", 1, None, 2), ("fgets", "bounded", 0, None, 1),
]
#: Calls that make or end a heap object.
ALLOCATORS, RELEASERS = ("malloc", "calloc", "realloc", "xmalloc", "operator_new"), ("free", "operator_delete")
#: Words of an authorization check, and operations that need one.
CHECKS, SENSITIVE_CALLS = "(?i)(auth|check_?(perm|user|login|token)|is_?admin|verify)", "(?i)^(reboot|factory_?reset|set_?config|delete_?user|upgrade|exec_?command)$"
#: Relations that stay open, and so may be suppressed by a proof.
OPEN_RELATIONS = ("append_length_unknown", "iterated_alias_unproven", "symbolic_offset", "symbolic_read_offset", "symbolic_size", "unbounded")
CANDIDATE = ["function", "line", "kind", "sink", "target", "vulnerability_type", "verdict", "relation", "width", "capacity"]
_NAME = r"[A-Za-z_]\w*"


def statements(functions: DataFrame) -> DataFrame:
    """function, line, depth, text: one row per logical statement. ``functions``: function, text.

    Functions are dealt out by name first: a small file holds many texts' worth of work, and what follows by function needs no other exchange.
    """
    return functions.select("function", "text").repartition("function").select("function", F.explode(clex.statements_udf(F.col("text"))).alias("s")).select("function", "s.line", "s.depth", "s.text")


def statements_and_calls(rows: DataFrame) -> DataFrame:
    """The columns of ``calls`` and the statement's text; a statement without calls has one row, whose position is NULL."""
    c = rows.select("function", "line", "depth", "text", F.posexplode_outer(clex.calls_udf(F.col("text"))).alias("position", "c"))
    result = F.regexp_extract("text", rf"^(?:[\w ]+[ *]+)?({_NAME})\s*=\s*(?:\([^()]*\)\s*)*{_NAME}\s*\(", 1)
    first = F.col("position") == 0
    return c.select("function", "line", "depth", "position", X.operation_name(F.col("c.name")).alias("name"), F.col("c.args").alias("args"), F.when(first, X.missing(result)).alias("result"), "text")


def calls(rows: DataFrame) -> DataFrame:
    """function, line, depth, position, name, args, result: calls of statements, with the variable that takes the result."""
    return statements_and_calls(rows).where("position IS NOT NULL").drop("text")


def heap_objects(call_rows: DataFrame) -> DataFrame:
    """function, name, kind, capacity, element, line of results of allocations; capacity NULL where no constant."""
    size = F.when(F.col("name") == "calloc", F.concat(F.lit("("), F.get("args", F.lit(0)), F.lit(")*("), F.get("args", F.lit(1)), F.lit(")"))).otherwise(F.element_at("args", -1))
    a = call_rows.where(F.col("name").isin(*ALLOCATORS) & F.col("result").isNotNull() & (F.size("args") > 0))
    return a.select("function", F.col("result").alias("name"), F.lit("heap").alias("kind"), clex.constant_udf(size).alias("capacity"), F.lit(1).alias("element"), "line")


def stack_objects(functions: DataFrame) -> DataFrame:
    """function, name, kind, capacity, element, line of declared arrays; they come before heap objects of their names."""
    declared = dims.declared_arrays(functions.select(F.col("function").alias("name"), "text"))
    element = F.lit(1)
    return declared.groupBy("function", F.col("var_name").alias("name")).agg(F.max("size_bytes").alias("capacity")).select("function", "name", F.lit("stack").alias("kind"), "capacity", element.alias("element"), F.lit(0).alias("line"))


def objects(functions: DataFrame, call_rows: DataFrame) -> DataFrame:
    """function, name, kind, capacity, element, line: declared arrays and heap objects, the first of a name."""
    return dedupe.first_wins(stack_objects(functions).unionByName(heap_objects(call_rows)), ["function", "name"], [F.col("line")])


def loops(rows: DataFrame) -> DataFrame:
    """function, line, depth, variable, low, high (inclusive, NULL if unknown) of counting loops."""
    head = rf"^for\s*\(\s*(?:\w+\s+)?({_NAME})\s*=\s*([^;]+);\s*\1\s*(<=|<)\s*([^;]+);\s*(?:\1\s*\+\+|\+\+\s*\1|\1\s*\+=\s*1)\s*\)"
    f = rows.where(F.col("text").rlike(head))
    part = lambda i: F.regexp_extract("text", head, i)
    stop = clex.constant_udf(part(4))
    return f.select("function", "line", "depth", part(1).alias("variable"), clex.constant_udf(part(2)).alias("low"), (stop - F.when(part(3) == "<", 1).otherwise(0)).alias("high"))


def _destination(c: Column) -> tuple[Column, Column]:
    """Base name and offset expression of ``name``, ``&name[i]``, ``name + i``; casts are dropped."""
    bare = F.regexp_replace(c, r"^\s*(?:\([A-Za-z_][\w\s]*\**\s*\)\s*)+", "")
    shape = rf"^\s*\(?\s*&?\s*({_NAME})\s*(?:\[\s*(.+)\s*\]|\+\s*(.+?))?\s*\)?\s*$"
    offset = F.coalesce(X.missing(F.regexp_extract(bare, shape, 2)), X.missing(F.regexp_extract(bare, shape, 3)), F.lit("0"))
    return X.missing(F.regexp_extract(bare, shape, 1)), offset


def _classified(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Adds verdict and relation from width, capacity and offsets [low, high]."""
    v = intervals.classify_write(F.col("target"), F.col("width"), F.col("capacity"), low, high)
    names = {"width_exceeds_capacity": "proven_overflow", "outside_capacity": "proven_overflow", "within_capacity": "proven_safe", "partial_range": "symbolic_offset"}
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn("_v", v).withColumn("verdict", F.col("_v.verdict")).withColumn("relation", F.coalesce(F.try_element_at(named, F.col("_v.reason")), F.col("_v.reason"))).drop("_v")


def call_candidates(call_rows: DataFrame, things: DataFrame) -> DataFrame:
    """Writes by known calls into known objects, with verdict and relation.

    A copy of a literal has its length; other unbounded calls are unbounded; an append adds
    to an unknown length unless the literal alone is too long.
    """
    table = call_rows.sparkSession.createDataFrame(WRITERS, "name string, bound string, dest int, src int, size int")
    j = call_rows.join(F.broadcast(table), "name").where(F.size("args") > F.col("dest"))  # a table of WRITERS' rows
    base, offset = _destination(F.get("args", F.col("dest")))
    literal = clex.string_length_udf(F.get("args", F.col("src"))) + 1
    j = j.withColumns({"target": base, "_offset": clex.constant_udf(offset), "_literal": literal, "_given": clex.constant_udf(F.get("args", F.col("size")))})
    j = j.withColumn("width", F.when(F.col("bound") == "bounded", F.col("_given")).otherwise(F.col("_literal")).cast("long")).join(things.select("function", F.col("name").alias("target"), F.col("kind").alias("_object"), "capacity"), ["function", "target"])
    out = _classified(j, F.col("_offset"), F.col("_offset"))
    free = (F.col("bound") != "bounded") & F.col("_literal").isNull()
    joined = (F.col("bound") == "append") & (F.col("verdict") != "overflow") & F.col("_literal").isNotNull()
    verdict = F.when(free, "unbounded").when(joined, "candidate").otherwise(F.col("verdict"))
    relation = F.when(free, "unbounded").when(joined, "append_length_unknown").otherwise(F.col("relation"))
    kind = F.concat("_object", F.lit("_overflow"))
    return out.withColumns({"verdict": verdict, "relation": relation}).select("function", "line", F.lit("call").alias("kind"), F.col("name").alias("sink"), "target", kind.alias("vulnerability_type"), "verdict", "relation", "width", "capacity")


def scanf_candidates(call_rows: DataFrame, things: DataFrame) -> DataFrame:
    """Storing string conversions of scanf calls into known objects; each takes the destination of its place."""
    s = call_rows.where(F.col("name").isin("scanf", "sscanf", "fscanf"))
    at = F.when(F.col("name") == "scanf", 0).otherwise(1)
    conversions = F.posexplode(clex.scanf_udf(F.get("args", at))).alias("k", "c")
    s = s.select("function", "line", "name", "args", at.alias("_at"), conversions).where(F.col("c.conversion").isin("s", "["))
    base, _ = _destination(F.get("args", F.col("_at") + 1 + F.col("k")))
    s = s.withColumn("target", base).join(things.select("function", F.col("name").alias("target"), F.col("kind").alias("_object"), "capacity"), ["function", "target"])
    s = s.withColumn("width", (F.col("c.width") + 1).cast("long"))
    out = _classified(s, F.lit(0), F.lit(0))
    free = F.col("width").isNull()
    return out.select("function", "line", F.lit("call").alias("kind"), F.col("name").alias("sink"), "target", F.concat("_object", F.lit("_overflow")).alias("vulnerability_type"), F.when(free, "unbounded").otherwise(F.col("verdict")).alias("verdict"), F.when(free, "unbounded").otherwise(F.col("relation")).alias("relation"), "width", "capacity")


def _ranged(rows: DataFrame, loop_rows: DataFrame) -> DataFrame:
    """Rows (function, line, depth, index) with low and high of a constant index or of the loop that counts it.

    The loop is the last one on the variable before the row whose body the row can be in.
    """
    at = ["function", "line", "depth", "variable"]  # no made-up row ids: a plan that reads the rows twice would number them differently
    keyed = rows.withColumns({"variable": F.trim("index"), "_const": clex.constant_udf(F.col("index"))})
    around = rows.select("function", "line", "depth", F.trim("index").alias("variable")).join(loop_rows.select("function", "variable", F.col("line").alias("_l"), F.col("depth").alias("_d"), "low", "high"), ["function", "variable"])
    last = around.where((F.col("_l") <= F.col("line")) & (F.col("_d") < F.col("depth"))).groupBy(*at).agg(F.max_by(F.struct("low", "high"), F.struct("_l", "_d", "low", "high")).alias("_b"))
    j = keyed.join(last, at, "left")
    return j.withColumns({"_low": F.coalesce("_const", "_b.low"), "_high": F.coalesce("_const", "_b.high")}).drop("variable", "_b", "_const")


def _access(rows: DataFrame, things: DataFrame, loop_rows: DataFrame, kind: str, read: bool) -> DataFrame:
    known = rows.join(things.select("function", F.col("name").alias("target"), F.col("kind").alias("_object"), "capacity", "element"), ["function", "target"])
    out = _classified(_ranged(known.withColumn("width", F.col("element").cast("long")), loop_rows), F.col("_low"), F.col("_high"))
    if read:
        named = F.when(F.col("relation") == "proven_overflow", "proven_oob_read").when(F.col("relation") == "symbolic_offset", "symbolic_read_offset").otherwise(F.col("relation"))
        out = out.withColumn("relation", named)
    kinds = F.lit("out_of_bounds_read") if read else F.concat("_object", F.lit("_overflow"))
    return out.select("function", "line", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("sink"), "target", kinds.alias("vulnerability_type"), "verdict", "relation", "width", "capacity")


_STORE = rf"^\s*({_NAME})\s*\[([^\]]+)\]\s*[-+*/|&^]?=(?!=)"


def index_writes(rows: DataFrame, things: DataFrame, loop_rows: DataFrame) -> DataFrame:
    """``name[index] = ...`` of known objects."""
    w = rows.where(F.col("text").rlike(_STORE)).select("function", "line", "depth", F.regexp_extract("text", _STORE, 1).alias("target"), F.regexp_extract("text", _STORE, 2).alias("index"))
    return _access(w, things, loop_rows, "index_write", False)


def index_reads(rows: DataFrame, things: DataFrame, loop_rows: DataFrame) -> DataFrame:
    """``name[index]`` on the right of an assignment, in a return or among arguments."""
    declared = rf"^(?:(?:unsigned|signed|const|static)\s+)*(?:\w+)\s+{_NAME}\s*\[[^\]]*\]\s*$"
    right = F.regexp_replace(F.regexp_replace("text", _STORE, ""), r'"(?:\\.|[^"\\])*"', '""')
    r = rows.where(~F.col("text").rlike(declared)).withColumn("_r", right)
    pairs = F.arrays_zip(F.regexp_extract_all("_r", F.lit(rf"\b({_NAME})\s*\[([^\[\]]+)\]"), F.lit(1)).alias("n"), F.regexp_extract_all("_r", F.lit(rf"\b({_NAME})\s*\[([^\[\]]+)\]"), F.lit(2)).alias("i"))
    r = r.select("function", "line", "depth", F.explode(F.array_distinct(pairs)).alias("x")).select("function", "line", "depth", F.col("x.n").alias("target"), F.col("x.i").alias("index"))
    return _access(r, things, loop_rows, "index_read", True)


_POINTER = rf"\*\s*\(?\s*(?:\([^()]*\)\s*)*\(?\s*({_NAME})\s*(?:\+\s*([^()]+?))?\s*\)?\s*\)?"


def pointer_stores(rows: DataFrame, things: DataFrame, loop_rows: DataFrame) -> DataFrame:
    """``*(name + offset) = ...`` of known objects."""
    shape = rf"^\s*{_POINTER}\s*=(?!=)"
    w = rows.where(F.col("text").rlike(shape)).select("function", "line", "depth", F.regexp_extract("text", shape, 1).alias("target"), F.coalesce(X.missing(F.regexp_extract("text", shape, 2)), F.lit("0")).alias("index"))
    return _access(w, things, loop_rows, "pointer_store", False)


def pointer_reads(rows: DataFrame, things: DataFrame, loop_rows: DataFrame) -> DataFrame:
    """``... = *(name + offset)`` of known objects."""
    shape = rf"=\s*{_POINTER}\s*$"
    w = rows.where(F.col("text").rlike(shape)).select("function", "line", "depth", F.regexp_extract("text", shape, 1).alias("target"), F.coalesce(X.missing(F.regexp_extract("text", shape, 2)), F.lit("0")).alias("index"))
    return _access(w, things, loop_rows, "pointer_read", True)


def integer_allocations(call_rows: DataFrame) -> DataFrame:
    """Allocations whose size multiplies or adds something that is no constant: it may wrap."""
    a = call_rows.where(F.col("name").isin(*ALLOCATORS) & (F.size("args") > 0)).withColumn("_size", F.element_at("args", -1))
    a = a.where(F.col("_size").rlike(r"[*+]") & clex.constant_udf(F.col("_size")).isNull())
    return a.select("function", "line", F.lit("allocation").alias("kind"), F.col("name").alias("sink"), F.coalesce("result", F.lit("")).alias("target"), F.lit("integer_overflow_to_memory_access").alias("vulnerability_type"), F.lit("candidate").alias("verdict"), F.lit("symbolic_size").alias("relation"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("capacity"))


def split_safe(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): what is proven within its capacity is suppressed with its reason."""
    safe = F.col("verdict") == "safe"
    return candidates.where(~safe), candidates.where(safe).withColumn("reason", F.lit("bounded_capacity_proven_safe"))


def spatial(functions: DataFrame) -> DataFrame:
    """All memory candidates of functions (function, text), safe ones included, each once."""
    rows = statements(functions)
    call_rows, loop_rows = calls(rows), loops(rows)
    things = objects(functions, call_rows)
    found = call_candidates(call_rows, things).unionByName(scanf_candidates(call_rows, things)).unionByName(integer_allocations(call_rows))
    for rule in (index_writes, index_reads, pointer_stores, pointer_reads):
        found = found.unionByName(rule(rows, things, loop_rows))
    return found.distinct()


# lifetimes


def lifetime_events(rows: DataFrame) -> DataFrame:
    """function, line, position, identity, action: acquire, release, use and scope_exit of heap names.

    A use is any other statement that names the variable; a return is a scope exit of all
    names but the one that it returns. A function's statements are read once and meet in
    one exchange by function.
    """
    c = statements_and_calls(rows)
    made, gone, ret = F.col("name").isin(*ALLOCATORS) & F.col("result").isNotNull(), F.col("name").isin(*RELEASERS), F.col("text").rlike(r"^return\b")
    event = lambda position, action, words: F.struct(F.lit(position).alias("position"), F.lit(action).alias("action"), words.alias("words"))
    call = F.when(made, event(1, "acquire", F.array("result"))).when(gone, event(1, "release", F.array(X.cast_stripped(F.get("args", F.lit(0))))))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\b{_NAME}\b"), F.lit(0)))
    said = F.when(F.coalesce("position", F.lit(0)) == 0, F.when(ret, event(2, "scope_exit", words)).otherwise(event(0, "use", words)))
    e = c.select("function", "line", F.explode(F.array_compact(F.array(call, said))).alias("e")).select("function", "line", "e.*")
    e = e.withColumn("_names", F.array_distinct(F.flatten(F.collect_set(F.when(F.col("action") == "acquire", F.col("words"))).over(Window.partitionBy("function")))))
    named = F.when(F.col("action") == "scope_exit", F.array_except("_names", "words")).when(F.col("action") == "use", F.array_intersect("words", "_names")).otherwise(F.col("words"))
    e = e.select("function", "line", "position", F.explode(named).alias("identity"), "action")
    place = Window.partitionBy("function", "line", "identity")
    e = e.withColumns({"_called": F.max(F.col("action").isin("acquire", "release")).over(place), "_n": F.row_number().over(place.orderBy("position"))})
    return e.where((F.col("action") != "use") | (~F.col("_called") & (F.col("_n") == 1))).drop("_called", "_n")


def lifetime(rows: DataFrame) -> DataFrame:
    """function, line, target, vulnerability_type: use after free, double free and leaks in statement order."""
    events = lifetime_events(rows)
    ledger = lifecycle.resource_ledger(events, ["function", "identity"], [F.col("line"), F.col("position")], F.col("action"))
    kind = F.when(F.col("violation") == "use_after_release", "use_after_free").when(F.col("violation") == "duplicate_release", "double_free").when(F.col("violation") == "leak", "memory_leak")
    return ledger.where("violation IS NOT NULL").select("function", "line", F.col("identity").alias("target"), kind.alias("vulnerability_type"))


def invalid_frees(call_rows: DataFrame, things: DataFrame) -> DataFrame:
    """Releases of stack objects, of addresses inside an object, and of literals."""
    c = call_rows.where(F.col("name").isin(*RELEASERS)).withColumn("_a", X.cast_stripped(F.get("args", F.lit(0))))
    c = c.withColumn("target", F.regexp_extract("_a", _NAME, 0)).join(things.where("kind = 'stack'").select("function", F.col("name").alias("target"), F.lit(True).alias("_stack")), ["function", "target"], "left")
    why = F.when(F.col("_stack"), "stack_object").when(F.col("_a").rlike(r'^"'), "literal").when(F.col("_a").rlike(rf"^&|^\(?{_NAME}\)?[-+\[]"), "interior_pointer")
    return c.withColumn("reason", why).where("reason IS NOT NULL").select("function", "line", "target", F.lit("invalid_free").alias("vulnerability_type"), "reason")


# rules over operations


def null_address(address: Column, constants: Column) -> Column:
    """The access is at address 0, by its constants or its expression."""
    bare = F.lower(F.regexp_replace(F.coalesce(address, F.lit("")), r"[()\s]", ""))
    return F.coalesce(F.array_contains(constants, F.lit(0).cast("bigint")), F.lit(False)) | bare.isin("0", "0x0", "null", "void*0")


def overlap(destination: Column, source: Column, size: Column) -> Column:
    """exact, possible or NULL: whether a copy's two ranges share bytes. Columns are expressions."""
    base = lambda c: F.regexp_extract(X.cast_stripped(c), rf"^&?({_NAME})", 1)
    offset = lambda c: F.coalesce(clex.constant_udf(X.missing(F.regexp_extract(X.cast_stripped(c), rf"^&?{_NAME}(?:\+(.+)|\[(.+)\])$", 1))), F.lit(0))
    same = (base(destination) == base(source)) & (base(destination) != "")
    n, a, b = clex.constant_udf(size), offset(destination), offset(source)
    shared = F.greatest(a, b) < F.least(a, b) + n
    return F.when(same & n.isNotNull() & shared, "exact").when(same & n.isNull(), "possible")


def undefined_loads(ops: DataFrame) -> DataFrame:
    """Loads of undefined stack addresses that no store of the function fills. ``ops``: function, kind, address, definedness."""
    loads = ops.where((F.col("kind") == "load") & (F.col("definedness") == "undefined") & F.col("address").rlike("(?i)local_|stack"))
    return loads.join(ops.where("kind = 'store'").select("function", "address").distinct(), ["function", "address"], "left_anti").select("function", "address").distinct()


def missing_checks(call_rows: DataFrame) -> DataFrame:
    """Sensitive calls that no authorization check of the function precedes."""
    w = Window.partitionBy("function").orderBy("line", "position").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.col("name").rlike(CHECKS).cast("int")).over(w)
    c = call_rows.withColumn("_seen", F.coalesce(seen, F.lit(0)))
    return c.where(F.col("name").rlike(SENSITIVE_CALLS) & (F.col("_seen") == 0)).select("function", "line", "name", F.lit("auth_bypass").alias("vulnerability_type"))


def fixed_credentials(call_rows: DataFrame, consumers: Column, position: int) -> DataFrame:
    """Calls of credential consumers whose secret argument is a varied literal; only its fingerprint is given."""
    value = F.regexp_extract(F.get("args", F.lit(position)), r'^\s*"((?:\\.|[^"\\])*)"\s*$', 1)
    c = call_rows.where(consumers).withColumn("_v", value).where((F.length("_v") >= 4) & ~X.placeholder(F.col("_v")))
    return c.select("function", "line", "name", X.fingerprint(F.col("_v")).alias("fingerprint"), F.lit("hardcoded_credential").alias("vulnerability_type"))


def write_summaries(functions: DataFrame, call_rows: DataFrame) -> DataFrame:
    """function, parameter (from 0), sink, width: what calls write through a function's own parameters."""
    head = rf"^[^({{;]*\b{_NAME}\s*\(([^)]*)\)\s*\{{"
    names = F.transform(clex.split_arguments_udf(F.regexp_extract("text", head, 1)), lambda p: F.regexp_extract(p, rf"({_NAME})\s*(?:\[\s*\])?\s*$", 1))
    params = functions.select("function", F.posexplode(names).alias("parameter", "target"))
    table = call_rows.sparkSession.createDataFrame(WRITERS, "name string, bound string, dest int, src int, size int")
    j = call_rows.join(F.broadcast(table), "name").where(F.size("args") > F.col("dest"))  # a table of WRITERS' rows
    base, _ = _destination(F.get("args", F.col("dest")))
    width = F.when(F.col("bound") == "bounded", clex.constant_udf(F.get("args", F.col("size")))).otherwise(clex.string_length_udf(F.get("args", F.col("src"))) + 1)
    return j.withColumn("target", base).withColumn("width", width.cast("long")).join(params, ["function", "target"]).select("function", "parameter", F.col("name").alias("sink"), "width")


def summary_candidates(call_rows: DataFrame, summaries: DataFrame, things: DataFrame) -> DataFrame:
    """Calls of summarised functions with known objects as arguments: the summary's write, at the caller."""
    s = summaries.select(F.col("function").alias("name"), "parameter", "sink", "width")
    j = call_rows.join(s, "name").where(F.size("args") > F.col("parameter"))
    base, offset = _destination(F.get("args", F.col("parameter")))
    j = j.withColumns({"target": base, "_offset": clex.constant_udf(offset)}).join(things.select("function", F.col("name").alias("target"), F.col("kind").alias("_object"), "capacity"), ["function", "target"])
    out = _classified(j, F.col("_offset"), F.col("_offset"))
    free = F.col("width").isNull()
    return out.select("function", "line", F.lit("summary").alias("kind"), "sink", "target", F.concat("_object", F.lit("_overflow")).alias("vulnerability_type"), F.when(free, "unbounded").otherwise(F.col("verdict")).alias("verdict"), F.when(free, "unbounded").otherwise(F.col("relation")).alias("relation"), "width", "capacity")


def discover(functions: DataFrame) -> DataFrame:
    """candidate_id, backend and the candidate's fields, of the spatial and lifetime rules together; ids are stable and unique."""
    rows = statements(functions)
    kept, _ = split_safe(spatial(functions))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    life = lifetime(rows).select("function", "line", F.lit("lifetime").alias("kind"), none("string", "sink"), "target", "vulnerability_type", F.lit("candidate").alias("verdict"), F.lit("ordered_events").alias("relation"), none("long", "width"), none("long", "capacity"))
    every = kept.withColumn("backend", F.lit("memory_access")).unionByName(life.withColumn("backend", F.lit("lifetime")))
    named = every.withColumn("candidate_id", X.stable_id(*[F.col(c) for c in ("backend", "function", "line", "kind", "sink", "target", "vulnerability_type")]))
    return dedupe.first_wins(named, ["candidate_id"], [F.col("relation"), F.col("width").asc_nulls_last()])


def write_facts(candidates: DataFrame) -> DataFrame:
    """Candidates as write facts: an object, a range and a classification, nested."""
    return candidates.select(
        X.stable_id(F.lit("fact"), F.col("function"), F.col("line"), F.col("kind"), F.col("target")).alias("fact_id"),
        F.struct(F.col("function").alias("function_name"), F.col("line").alias("line_number")).alias("location"),
        F.struct(F.col("target").alias("name"), F.substring_index("vulnerability_type", "_", 1).alias("kind"), F.col("capacity").alias("capacity_bytes")).alias("destination"),
        F.struct(F.col("width").alias("width_bytes"), F.col("relation").alias("relation")).alias("write"),
        F.struct("verdict", F.col("relation").alias("reason")).alias("classification"),
    )


def candidate_states(candidates: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Candidates as states of the lifecycle: backend and severity from the taxonomy (name, backend, severity), blockers by verdict."""
    tax = taxonomy.select(F.col("name").alias("vulnerability_type"), F.col("backend").alias("_backend"), "severity")
    open_ = F.when(F.col("verdict") == "overflow", F.array().cast("array<string>")).when(F.col("verdict") == "unbounded", F.array(F.lit("attacker_input_reaches_sink"))).otherwise(F.array(F.lit("overflow_condition_proof"), F.lit("attacker_input_reaches_sink")))
    j = candidates.join(tax, "vulnerability_type", "left")
    return j.select(
        X.stable_id(F.col("function"), F.col("line"), F.col("kind"), F.col("target"), F.col("vulnerability_type")).alias("candidate_id"), "vulnerability_type",
        F.coalesce("_backend", F.lit("unsupported")).alias("backend"), F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.when(F.col("_backend").isNull(), "blocked").when(F.col("verdict").isin("overflow", "unbounded"), "proof_ready").otherwise("candidate").alias("status"), open_.alias("blockers"),
    )


# p-code of exports


def pcode_candidates(functions: DataFrame) -> DataFrame:
    """Writes by exported calls and stores into stack regions, classified as C text's are.

    ``functions``: rows of ``readers.functions``. A call's destination is its argument's
    variable and its width the size argument's constant; a store's are its first address
    variable and its write width, at the first address constant.
    """
    base = functions.select("binary", F.col("name").alias("function"), "pcode_calls", "pcode_stores", "stack_regions")
    regions = base.select("binary", "function", F.explode("stack_regions").alias("r")).select("binary", "function", F.explode("r.var_names").alias("target"), F.col("r.size_bytes").cast("long").alias("capacity"))
    table = functions.sparkSession.createDataFrame(WRITERS, "name string, bound string, dest int, src int, size int").where("bound = 'bounded'")
    c = base.select("binary", "function", F.explode("pcode_calls").alias("c")).select("binary", "function", X.address(F.col("c.call_address")).alias("address"), X.operation_name(F.col("c.callee")).alias("name"), F.col("c.args").alias("args"))
    c = c.join(F.broadcast(table), "name")  # a table of WRITERS' rows
    calls_ = c.select("binary", "function", "address", F.lit("pcode_call").alias("kind"), F.col("name").alias("sink"), F.get("args", F.col("dest"))["var_name"].alias("target"), F.get("args", F.col("size"))["constant"].alias("width"), F.lit(0).cast("bigint").alias("_offset"))
    s = base.select("binary", "function", F.explode("pcode_stores").alias("s")).select("binary", "function", X.address(F.col("s.operation_address")).alias("address"), F.lit("pcode_store").alias("kind"), F.lit(None).cast("string").alias("sink"), F.get("s.address_vars", F.lit(0)).alias("target"), F.col("s.write_width").cast("bigint").alias("width"), F.coalesce(F.get("s.address_constants", F.lit(0)), F.lit(0).cast("bigint")).alias("_offset"))
    out = _classified(calls_.unionByName(s).join(regions, ["binary", "function", "target"]), F.col("_offset"), F.col("_offset"))
    return out.select("binary", "function", "address", "kind", "sink", "target", "verdict", "relation", "width", "capacity")
