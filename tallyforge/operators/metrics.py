"""Aggregations over evaluation records. Blocked rows never count as clean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETED = ("reported", "clean", "missed", "false_positive")


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _share(part: Column, whole: Column) -> Column:
    """NULL on an empty denominator."""
    return F.when(whole > 0, part / whole)


def coverage_metrics(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns lane, decision, attempted, cpu_seconds -> coverage and conditional rates.

    Coverage ratios are 0.0 on an empty denominator, conditional rates NULL.
    """
    done = F.col("decision").isin(*COMPLETED)
    bad, good = F.col("lane") == "vulnerable", F.col("lane") == "fixed"
    ratio = lambda a, b: F.coalesce(_share(a, b), F.lit(0.0))
    reports = _n(F.col("decision") == "reported")
    cpu = F.sum(F.greatest(F.col("cpu_seconds"), F.lit(0.0)))
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        _n(done).alias("completed"),
        _n(~done).alias("blocked"),
        ratio(_n(done), F.count(F.lit(1))).alias("coverage"),
        ratio(_n(done & bad), _n(bad)).alias("positive_coverage"),
        ratio(_n(done & good), _n(good)).alias("negative_coverage"),
        _share(_n((F.col("decision") == "reported") & bad), _n(done & bad)).alias("conditional_recall"),
        _share(_n((F.col("decision") == "false_positive") & good), _n(done & good)).alias("conditional_fpr"),
        _share(reports * 3600.0, cpu).alias("reports_per_cpu_hour"),
    )


def top_counts(df: DataFrame, key: Column, n: int = 10) -> DataFrame:
    """value, n: the most frequent non-null keys, by (-count, key)."""
    return df.select(key.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def stage_funnel(events: DataFrame, entity: str, stage: Column, stages: Sequence[str]) -> DataFrame:
    """Distinct entities per stage (zero-filled), and their share of the first stage's."""
    seen = events.select(stage.alias("stage"), F.col(entity).alias("e")).groupBy("stage").agg(F.count_distinct("e").alias("n"))
    spine = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "position int, stage string")
    out = spine.join(seen, "stage", "left").select("position", "stage", F.coalesce("n", F.lit(0)).cast("long").alias("entities"))
    first = out.agg(F.max(F.when(F.col("position") == 0, F.col("entities"))).alias("first"))
    # one-row side: the first stage's count
    return out.join(F.broadcast(first)).select("stage", "entities", F.coalesce(_share(F.col("entities"), F.col("first")), F.lit(0.0)).alias("share"))


def rollup_totals(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], passed: Column) -> DataFrame:
    """pass, fail and total for each of several groupings in one pass."""
    wide = df.withColumn("_ok", passed)
    return wide.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        _n(F.col("_ok")).alias("passed"), _n(~F.col("_ok")).alias("failed"), F.count(F.lit(1)).alias("total")
    )


def crosstab(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of every combination of up to three keys, with all margins."""
    return df.cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("margin"))


def blocker_inventory(df: DataFrame, keys: Sequence[str], lane: str, target: str) -> DataFrame:
    """Blocks per key, distinct targets with the first five by name, and the vulnerable-minus-fixed difference.

    Targets are counted one row each, so no set of a group's targets is ever held.
    """
    bad, good = _n(F.col(lane) == "vulnerable"), _n(F.col(lane) == "fixed")
    each = df.groupBy(*keys, F.col(target).cast("string").alias("_t")).agg(F.count(F.lit(1)).alias("blocks"), bad.alias("vulnerable"), good.alias("fixed"))
    each = each.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_last())))
    first = F.array_join(F.array_sort(F.collect_list(F.when((F.col("_rn") <= 5), F.col("_t")))), ",")
    out = each.groupBy(*keys).agg(
        F.sum("blocks").alias("blocks"), F.sum("vulnerable").alias("vulnerable"), F.sum("fixed").alias("fixed"), F.count("_t").alias("targets"), first.alias("first_targets"),
    )
    return out.withColumn("difference", F.col("vulnerable") - F.col("fixed"))


def metric_delta(current: DataFrame, baseline: DataFrame, lower_is_better: Column) -> DataFrame:
    """Full outer comparison of (metric, value) tables."""
    a, b = current.select("metric", F.col("value").alias("now")), baseline.select("metric", F.col("value").alias("before"))
    out = a.join(b, "metric", "full_outer")
    better = F.when(lower_is_better, F.col("now") < F.col("before")).otherwise(F.col("now") > F.col("before"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("before"), "unchanged").when(better, "improved").otherwise("regressed")
    return out.select("metric", "now", "before", (F.col("now") - F.col("before")).alias("delta"), status.alias("status"))


def threshold_failures(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Limits (metric, least) that a metric misses; a missing metric fails."""
    joined = limits.join(metrics, "metric", "left")
    return joined.where(F.coalesce(F.col("value") < F.col("least"), F.lit(True))).select("metric", "least", "value", F.when(F.col("value").isNull(), "missing").otherwise("below").alias("failure"))


def precision_recall(found: DataFrame, truth: DataFrame, by: Sequence[str], key: str, strict: bool = False) -> DataFrame:
    """``truth``: by + key + kind in positive / negative / ignored. 0.0 on empty denominators."""
    keys = [*by, key]
    j = found.select(*keys).distinct().withColumn("_found", F.lit(True)).join(truth.select(*keys, "kind"), keys, "full_outer")
    hit = F.coalesce("_found", F.lit(False))
    tp, fn = _n(hit & (F.col("kind") == "positive")), _n(~hit & (F.col("kind") == "positive"))
    wrong = (F.col("kind") == "negative") | (F.lit(strict) & F.col("kind").isNull())
    fp, ignored = _n(hit & wrong), _n(hit & ~F.coalesce(wrong, F.lit(False)) & ~F.coalesce(F.col("kind") == "positive", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = j.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ignored.alias("ignored"))
    p, r = zero(_share(F.col("tp"), F.col("tp") + F.col("fp"))), zero(_share(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", zero(_share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def merge_count_maps(df: DataFrame, maps: Column) -> DataFrame:
    """key, n: the sum of many count maps."""
    return df.select(F.explode(maps).alias("key", "n")).groupBy("key").agg(F.sum("n").cast("long").alias("n"))


def medians(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Median of the non-null values per group."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def lane_separation(df: DataFrame, group: str, lane: str, matches: Column) -> DataFrame:
    """Matches per group pivoted by lane; separated when only the vulnerable lane has any."""
    out = df.groupBy(group).agg(_n(matches & (F.col(lane) == "vulnerable")).alias("vulnerable"), _n(matches & (F.col(lane) == "fixed")).alias("fixed"))
    return out.withColumn("separated", (F.col("vulnerable") > 0) & (F.col("fixed") == 0))


def scale_rollup(df: DataFrame, by: Sequence[str], counts: dict[str, Column], distincts: dict[str, str], medians_: dict[str, str], tops: dict[str, str]) -> DataFrame:
    """Per group: rows that meet conditions, distinct values, medians and maxima, under their names."""
    return df.groupBy(*by).agg(
        *[_n(c).alias(n) for n, c in counts.items()], *[F.count_distinct(c).alias(n) for n, c in distincts.items()], *[F.median(c).alias(n) for n, c in medians_.items()], *[F.max(c).alias(n) for n, c in tops.items()]
    )
