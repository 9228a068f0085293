"""Multiset differences between a vulnerable and a fixed lane, and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_differential(df: DataFrame, signature: Sequence[str], lane: str) -> DataFrame:
    """Per signature: counts in both lanes, shared = min, and what only one lane has."""
    n = lambda x: F.count_if(F.col(lane) == x)
    out = df.groupBy(*signature).agg(n("vulnerable").alias("vulnerable"), n("fixed").alias("fixed"))
    out = out.withColumn("shared", F.least("vulnerable", "fixed"))
    return out.withColumn("only_vulnerable", F.col("vulnerable") - F.col("shared")).withColumn("only_fixed", F.col("fixed") - F.col("shared"))


def suppress_shared(df: DataFrame, signature: Sequence[str], lane: str, order: Sequence[Column], may_suppress: Column) -> DataFrame:
    """Vulnerable rows with ``suppressed``: the first min-count rows of a shared signature, if they may be."""
    fixed = df.where(F.col(lane) == "fixed").groupBy(*signature).agg(F.count(F.lit(1)).alias("_fixed"))
    place = F.row_number().over(Window.partitionBy(*signature).orderBy(*order))
    rows = df.where(F.col(lane) == "vulnerable").withColumn("_k", place).join(fixed, list(signature), "left")
    shared = F.col("_k") <= F.coalesce("_fixed", F.lit(0))
    return rows.withColumn("suppressed", shared & F.coalesce(may_suppress, F.lit(False))).drop("_k", "_fixed")


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows only in a, only in b, and whether the two hold the same distinct keys."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    out = j.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def partition_check(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys of the whole that lie in no part, or in several; and part keys outside the whole."""
    u = whole.select(key).distinct().withColumn("_w", F.lit(1)).withColumn("_p", F.lit(0))
    for p in parts:
        u = u.unionByName(p.select(key).distinct().withColumn("_w", F.lit(0)).withColumn("_p", F.lit(1)))
    got = u.groupBy(key).agg(F.max("_w").alias("in_whole"), F.sum("_p").cast("long").alias("parts"))
    fault = F.when(F.col("in_whole") == 0, "outside").when(F.col("parts") == 0, "missing").when(F.col("parts") > 1, "overlap")
    return got.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "parts", "fault")
