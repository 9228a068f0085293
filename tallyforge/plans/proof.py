"""Obligations, certificates, evidence packs and entry points of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph

#: Facts that must be shown for a candidate of a relation.
OBLIGATIONS = {
    "proven_overflow": ["exact_operation", "reachable"],
    "unbounded": ["exact_operation", "reachable", "input_reaches_sink"],
    "symbolic_size": ["exact_operation", "reachable", "size_controlled"],
    "symbolic_offset": ["exact_operation", "reachable", "offset_controlled"],
    "append_length_unknown": ["exact_operation", "reachable", "length_controlled"],
}


def obligations(relation: Column, facts: Column) -> Column:
    """struct<required, missing, status> of a relation's obligations, given the facts that are known."""
    table = F.create_map(*[x for k, v in OBLIGATIONS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    required = F.coalesce(F.try_element_at(table, relation), F.array().cast("array<string>"))
    missing = F.array_except(required, F.coalesce(facts, F.array().cast("array<string>")))
    status = F.when(F.size(required) == 0, "no_obligation").when(F.size(missing) == 0, "discharged").otherwise("open")
    return F.struct(required.alias("required"), missing.alias("missing"), status.alias("status"))


def proof_plans(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """candidate_id, route, step: the routes (vulnerability_type, route, requires array) whose requirements a candidate's facts meet, cheapest first."""
    from pyspark.sql import Window

    j = candidates.join(routes, "vulnerability_type")
    able = j.where(F.size(F.array_except("requires", "facts")) == 0)
    return able.withColumn("step", F.row_number().over(Window.partitionBy("candidate_id").orderBy("cost", "route"))).select("candidate_id", "route", "step")


def certify(rows: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Adds ``rule`` and ``certificate``: of rules (name, applies, verdict) the first that applies; NULLs where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, applies, value in reversed(rules):
        rule, verdict = F.when(F.coalesce(applies, F.lit(False)), F.lit(name)).otherwise(rule), F.when(F.coalesce(applies, F.lit(False)), value).otherwise(verdict)
    return rows.withColumns({"rule": rule, "certificate": verdict})


def recheck(certified: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Certificates that a second run of the rules does not give again."""
    again = certify(certified.withColumnsRenamed({"rule": "_rule", "certificate": "_certificate"}), rules)
    return again.where(~(F.col("rule").eqNullSafe(F.col("_rule")) & F.col("certificate").eqNullSafe(F.col("_certificate"))))


def evidence_packs(candidates: DataFrame, contexts: DataFrame, tools: DataFrame) -> DataFrame:
    """candidate_id and ``pack``: the candidate, its function's context and its tools' findings as one nested record.

    ``tools``: tool, finding, and candidate_id or, for findings of whole functions, function:
    these are gathered once a function, not once a candidate.
    """
    of = "candidate_id" if "candidate_id" in tools.columns else "function"
    found = tools.groupBy(of).agg(F.array_sort(F.collect_list(F.struct("tool", "finding"))).alias("tools"))
    fields = [c for c in candidates.columns if c != "candidate_id"]
    j = candidates.join(contexts.select("function", F.struct(*[c for c in contexts.columns if c != "function"]).alias("context")), "function", "left").join(found, of, "left")
    none = F.array().cast(found.schema["tools"].dataType)
    return j.select("candidate_id", F.struct(F.lit(3).alias("schema_version"), F.struct(*fields).alias("candidate"), "context", F.coalesce("tools", none).alias("tools")).alias("pack"))


def fact_request(packs: DataFrame, path: str) -> DataFrame:
    """candidate_id, value: one fact of each pack by its dotted path, as text; a path that no pack has fails."""
    value = F.col("pack")
    for part in path.split("."):
        value = value[part]
    return packs.select("candidate_id", value.cast("string").alias("value"))


def json_strings(text: Column) -> Column:
    """All string values of a JSON text in order, at any depth; keys are none."""
    part = lambda i: F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?'), F.lit(i))
    both = F.arrays_zip(part(1).alias("value"), part(2).alias("colon"))
    return F.transform(F.filter(both, lambda x: x["colon"] == ""), lambda x: x["value"])


def text_relation(before: Column, after: Column) -> Column:
    """Order of two events by their lines, where nothing better is known."""
    return F.when(before.isNull() | after.isNull(), "unknown").when(before < after, "text_before").when(before == after, "same_line").otherwise("text_after")


def event_relation(block: Column, dominates: Column, before: Column, after: Column) -> Column:
    """Order of two events: by their block, else by dominance of blocks, else by the text."""
    same = F.when(block.isin("same_block_before", "same_block_after"), block)
    return F.coalesce(same, F.when(dominates, "dominates"), text_relation(before, after))


def entry_points(edges: DataFrame, targets: DataFrame, entries: DataFrame, max_depth: int = 16) -> DataFrame:
    """node, entry, depth, path: each target's nearest entry (ties: by name) over call edges, found from the entries on.

    One search starts from all entries; the path is that of the breadth-first order.
    """
    ordered = entries.select("node").distinct().withColumn("ordinal", F.lit(0))
    reach = graph.bfs(graph.degree_order(edges), ordered, max_depth)
    path = F.transform("queue", lambda x: x["n"])
    found = reach.select("node", F.col("root").alias("entry"), "depth", path.alias("path"))
    return targets.select("node").distinct().join(found, "node", "left")


def reachability_context(nodes: DataFrame, edges: DataFrame, entries: DataFrame, sources: DataFrame, max_depth: int = 16) -> DataFrame:
    """node, from_entry, from_source: depths from the nearest entry and the nearest input source, NULL if none reaches."""
    walk = lambda start, name: graph.bfs(graph.degree_order(edges), start.select("node").distinct().withColumn("ordinal", F.lit(0)), max_depth).select("node", F.col("depth").alias(name))
    return nodes.select("node").distinct().join(walk(entries, "from_entry"), "node", "left").join(walk(sources, "from_source"), "node", "left")


def alias_roots(assignments: DataFrame) -> DataFrame:
    """function, name, root: what a name stands for after chains of plain assignments (name = origin), to the fixpoint.

    The right-hand side is the origin. A name assigned twice has the smaller origin; a
    cycle's names have no root of their own and stand for its smallest.
    """
    one = assignments.where("name <> origin").groupBy("function", "name").agg(F.min("origin").alias("root"))
    state, size = graph._cut(one), -1
    while True:
        up = state.select("function", F.col("name").alias("root"), F.col("root").alias("_up"))
        step = state.join(up, ["function", "root"], "left").select("function", "name", F.when(F.col("_up").isNull() | (F.col("_up") == F.col("name")), F.col("root")).otherwise(F.col("_up")).alias("root"))
        fresh = graph._cut(step)
        moved = fresh.join(state.withColumnRenamed("root", "_was"), ["function", "name"]).where("root <> _was").count()
        state = fresh
        if moved == 0 or moved == size:
            return state
        size = moved
