"""Sets of byte offsets: sorted arrays of half-open intervals with strides, or unknown.

A set is struct<unknown: boolean, items: array<struct<start, end, stride>>>. Sets belong to
one record and stay small, so they are values of a row and not tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clex
from ..functions import text as X

ITEM = "struct<start:bigint,end:bigint,stride:bigint>"


def _none() -> Column:
    return F.array().cast(f"array<{ITEM}>")


def interval(start: Column, end: Column, stride: Column | int = 1) -> Column:
    step = stride if isinstance(stride, Column) else F.lit(stride)
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), step.cast("bigint").alias("stride"))


def known(items: Column) -> Column:
    return F.struct(F.lit(False).alias("unknown"), items.cast(f"array<{ITEM}>").alias("items"))


def unknown() -> Column:
    return F.struct(F.lit(True).alias("unknown"), _none().alias("items"))


def from_expression(expression: Column) -> Column:
    """The single offset of a constant C expression, 0 of an empty one, else unknown."""
    bare = F.trim(F.coalesce(X.cast_stripped(expression), F.lit("")))
    value = F.when(bare == "", F.lit(0).cast("bigint")).otherwise(clex.constant_udf(bare))
    return F.when(value.isNull(), unknown()).otherwise(known(F.array(interval(value, value + 1))))


def union(a: Column, b: Column) -> Column:
    """Touching neighbours of one stride become one interval; empty ones go; unknown stays unknown."""
    both = F.array_sort(F.filter(F.concat(a["items"], b["items"]), lambda x: x["end"] > x["start"]))

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = F.coalesce((last["end"] >= x["start"]) & (last["stride"] == x["stride"]), F.lit(False))
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["stride"].alias("stride"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(out, F.array(x)))

    return F.when(a["unknown"] | b["unknown"], unknown()).otherwise(known(F.aggregate(both, _none(), add)))


def intersects(a: Column, b: Column) -> Column:
    """Whether the sets can share an offset; an unknown set can with any."""
    meet = F.exists(a["items"], lambda x: F.exists(b["items"], lambda y: F.greatest(x["start"], y["start"]) < F.least(x["end"], y["end"])))
    return a["unknown"] | b["unknown"] | meet


def subtract(a: Column, b: Column) -> Column:
    """What of the first set the second does not cover; nothing of a known set is left by an unknown one."""

    def cut(out: Column, y: Column) -> Column:
        left = lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], y["start"]).alias("end"), x["stride"].alias("stride"))
        right = lambda x: F.struct(F.greatest(x["start"], y["end"]).alias("start"), x["end"].alias("end"), x["stride"].alias("stride"))
        apart = lambda x: F.greatest(x["start"], y["start"]) >= F.least(x["end"], y["end"])
        pieces = F.flatten(F.transform(out, lambda x: F.when(apart(x), F.array(x)).otherwise(F.array(left(x), right(x)))))
        return F.filter(pieces, lambda x: x["end"] > x["start"])

    rest = F.aggregate(b["items"], a["items"], cut)
    return F.when(a["unknown"], unknown()).when(b["unknown"], known(_none())).otherwise(known(rest))


def subset(a: Column, b: Column) -> Column:
    """Whether the second set certainly covers the first."""
    return ~a["unknown"] & ~b["unknown"] & (F.size(subtract(a, b)["items"]) == 0)


def collect(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """One set per key from rows of intervals."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(interval(F.col(start), F.col(end)))).alias("_i")).select(*keys, union(known(F.col("_i")), known(_none())).alias(name))
