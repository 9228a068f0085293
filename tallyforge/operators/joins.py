"""Joins whose conditions are ranges, times or nearness, as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points p with start <= p < end per key. Spans are dealt to buckets of ``width``.

    Each point probes one bucket, so rows made follow matches; a span costs one row per
    bucket that it touches. ``how``: inner, left or left_anti from the points' side.
    """
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    last = F.floor((F.col(end) - F.lit(1e-9)) / width)
    first = F.floor(F.col(start) / width)
    s = spans.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    left, right = p.alias("p"), s.alias("s")
    on = (F.col("p._bucket") == F.col("s._bucket")) & (F.col(f"p.{point}") >= F.col(f"s.{start}")) & (F.col(f"p.{point}") < F.col(f"s.{end}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    joined = left.join(right, on, how)
    own = [F.col(f"p.{c}") for c in points.columns]
    if how == "left_anti":
        return joined.select(*own)
    return joined.select(*own, *[F.col(f"s.{c}") for c in spans.columns if c not in keys])


def paired_spans(events: DataFrame, keys: Sequence[str], order: Sequence[Column], is_start: Column, is_end: Column, value: str) -> DataFrame:
    """k-th start with k-th end of each key: keys, k, start, end. Unpaired brackets have no row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    number = lambda cond, name: events.where(cond).select(*keys, F.col(value).alias(name), F.row_number().over(w).alias("k"))
    return number(is_start, "start").join(number(is_end, "end"), [*keys, "k"])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """For each left row its nearest right row by |at| difference (ties: earlier, then ``tie``), or NULL.

    Only the last right row at or before, and the first at or after, can be nearest:
    both come from window frames over the union, so no pair is ever made.
    """
    l_cols = [c for c in left.columns if c not in (*keys, at)]
    kept = F.struct(*[F.col(c) for c in l_cols]) if l_cols else F.struct(F.lit(1).alias("_"))
    kind = left.select(kept.alias("x")).schema["x"].dataType
    id_kind = right.schema[tie].dataType
    u = left.select(*keys, at, F.lit(1).alias("_side"), F.lit(None).cast(id_kind).alias("_id"), kept.alias("_l"))
    u = u.unionByName(right.select(*keys, at, F.lit(0).alias("_side"), F.col(tie).alias("_id"), F.lit(None).cast(kind).alias("_l")))
    u = u.withColumn("_first", F.min(F.when(F.col("_side") == 0, F.col("_id"))).over(Window.partitionBy(*keys, at)))
    seen = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("at"), F.col("_first").alias("id")))
    past = Window.partitionBy(*keys).orderBy(F.col(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.col(at).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_prev", F.last(seen, ignorenulls=True).over(past)).withColumn("_next", F.last(seen, ignorenulls=True).over(future))
    gap_prev, gap_next = F.col(at) - F.col("_prev.at"), F.col("_next.at") - F.col(at)
    pick = F.when(F.col("_prev").isNull(), F.col("_next")).when(F.col("_next").isNull() | (gap_prev <= gap_next), F.col("_prev")).otherwise(F.col("_next"))
    out = u.where("_side = 1").withColumn("_pick", pick)
    return out.select(*keys, at, *([F.col("_l")[c].alias(c) for c in l_cols]), F.col("_pick.at").alias("nearest_at"), F.col("_pick.id").alias("nearest_id"))


def next_after(events: DataFrame, keys: Sequence[str], order: Sequence[Column], matches: Column, value: Column, name: str) -> DataFrame:
    """The first later row of the key that matches (as-of forward), as a value; NULL if none.

    ``order``: columns, ascending. The window runs backwards, so its frame only grows.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(matches, value), ignorenulls=True).over(w))


def gate(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column, name: str = "reportable") -> DataFrame:
    """Left join with a fail-closed predicate: a missing right row, or a NULL, is false."""
    return left.join(right, list(keys), "left").withColumn(name, F.coalesce(condition, F.lit(False)))


def expectation_errors(expected: DataFrame, observed: DataFrame, forbidden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected but not observed, and observed although forbidden."""
    k = list(keys)
    missing = expected.select(*k).distinct().join(observed.select(*k), k, "left_anti").withColumn("error", F.lit("missing_expected"))
    present = observed.select(*k).distinct().join(forbidden.select(*k), k, "left_semi").withColumn("error", F.lit("forbidden_present"))
    return missing.unionByName(present)


def enrich(seeds: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Seeds with the columns of a chain of tables, each joined on its keys; seeds that any table lacks go."""
    for table, keys in tables:
        seeds = seeds.join(table, list(keys))
    return seeds
