"""Paths in control-flow graphs, and summaries propagated over call graphs."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clex import function_ranges  # noqa: F401


def paths_avoiding(blocks: DataFrame, queries: DataFrame, key: str = "function") -> DataFrame:
    """key, id, reachable: whether a path leads from ``source`` to ``target`` without a barrier block.

    ``blocks``: key, block, successors. ``queries``: key, id, source, target, barriers array.
    One function's graph and its questions are one group; functions run in parallel.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        nexts = {b: list(s) if s is not None else [] for b, s in zip(graph["block"], graph["successors"], strict=True)}
        out = []
        for k, i, source, target, barriers in zip(asked[key], asked["id"], asked["source"], asked["target"], asked["barriers"], strict=True):
            stop = set(barriers) if barriers is not None else set()
            seen, queue = {source}, deque([source])
            hit = source == target and source in nexts
            while queue and not hit:
                for b in nexts.get(queue.popleft(), []):
                    if b == target:
                        hit = True
                        break
                    if b not in seen and b not in stop:
                        seen.add(b)
                        queue.append(b)
            out.append((k, i, hit))
        return pd.DataFrame(out, columns=[key, "id", "reachable"])

    return blocks.groupBy(key).cogroup(queries.groupBy(key)).applyInPandas(run, f"{key} {kinds[key]}, id {kinds['id']}, reachable boolean")


def propagate_summaries(summaries: DataFrame, callsites: DataFrame, bind: Column, depth: int = 4, per_function: int = 20, nodes: int = 32) -> DataFrame:
    """Function summaries carried to callers until nothing changes, at most ``depth`` calls up.

    ``summaries``: function, expression, effect. ``callsites``: caller, callee, mapping
    (parameter -> argument). ``bind`` builds the caller's expression from ``expression`` and
    ``mapping``; expressions of more than ``nodes`` identifiers, and all but the first
    ``per_function`` in order per function, are not carried on, as the semantics ask.
    """
    from pyspark.sql import Window

    from .graph import _cut

    every = summaries.select("function", "expression", "effect", F.lit(0).alias("depth"))
    delta = every
    for d in range(1, depth + 1):
        up = delta.join(callsites, delta["function"] == callsites["callee"]).select(F.col("caller").alias("function"), bind.alias("expression"), "effect")
        up = up.where(F.size(F.regexp_extract_all("expression", F.lit(r"[A-Za-z_]\w*"), F.lit(0))) <= nodes).distinct()
        fresh = up.join(every.select("function", "expression", "effect"), ["function", "expression", "effect"], "left_anti").withColumn("depth", F.lit(d))
        w = Window.partitionBy("function").orderBy("depth", "expression", "effect")
        merged = every.unionByName(fresh).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_function).drop("_n")
        every = _cut(merged)
        delta = every.where(F.col("depth") == d)
        if not delta.head(1):
            break
    return every
