"""Evaluation of campaigns, systems and portfolios: grouped sums over result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def root_causes(found: DataFrame, root: str, payload: Column, id_col: str) -> DataFrame:
    """root, members and the smallest id of each root cause; two payloads under one root fail the job.

    Members are counted, not listed: join the input for them, as a root may have any number.
    """
    text = payload.cast("string")
    clash = F.raise_error(F.concat(F.lit("root cause with incompatible facts: "), F.first(root).cast("string")))
    same = F.min(text).eqNullSafe(F.max(text)) & (F.count(text) % F.count(F.lit(1)) == 0)
    return found.where(F.col(root).isNotNull()).groupBy(root).agg(
        F.when(same, F.min(text)).otherwise(clash.cast("string")).alias("payload"), F.count_distinct(id_col).alias("members"), F.min(id_col).alias("first_member")
    )


def system_metrics(artifacts: DataFrame, kind: str, accepted: Column, reason: Column, overridden: Column) -> DataFrame:
    """Per hypothesis kind: artifacts accepted, rejected, without fixture and overridden."""
    return artifacts.groupBy(kind).agg(F.count(F.lit(1)).alias("artifacts"), _n(accepted).alias("accepted"), _n(~F.coalesce(accepted, F.lit(False))).alias("rejected"), _n(reason == "missing_fixture").alias("missing_fixture"), _n(overridden).alias("overrides"))


def cost_totals(rows: DataFrame, by: Sequence[str], calls: Column, tokens_in: Column, tokens_out: Column, total: Column, seconds: Column) -> DataFrame:
    """Sums of costs; a total that is missing or not positive is what went in and out."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = F.when(zero(total) > 0, total).otherwise(zero(tokens_in) + zero(tokens_out))
    return rows.groupBy(*by).agg(
        F.sum(zero(calls)).cast("long").alias("model_calls"), F.sum(zero(tokens_in)).cast("long").alias("input_tokens"), F.sum(zero(tokens_out)).cast("long").alias("output_tokens"),
        F.sum(whole).cast("long").alias("total_tokens"), F.sum(zero(seconds)).cast("double").alias("wall_time_seconds"),
    )


def sum_columns(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of counters, missing ones as 0."""
    return rows.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in columns])


def corpus_totals(corpora: DataFrame, status: Column, columns: Sequence[str]) -> DataFrame:
    """One row: completed and skipped corpora, and the sums of their counters."""
    sums = [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in columns]
    return corpora.agg(_n(status == "completed").alias("completed_corpora"), _n(status.startswith("skipped")).alias("skipped_corpora"), *sums)


def engine_totals(runs: DataFrame, engine: str, counters: Sequence[str], seconds: str, memory: str, hit: Column) -> DataFrame:
    """Per engine: counters and seconds summed, the largest memory, targets and target hits."""
    return runs.groupBy(engine).agg(
        *[F.sum(c).cast("long").alias(c) for c in counters], F.sum(seconds).alias(seconds), F.max(memory).alias(memory), F.count(hit).alias("targets"), _n(hit).alias("target_hits")
    )


def rule_counts(rows: DataFrame, rule: Column, rules: Sequence[str]) -> DataFrame:
    """rule, n of the known rules that occur."""
    return rows.select(rule.alias("rule")).where(F.col("rule").isin(*rules)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def evaluation_rows(attempts: DataFrame, truth: DataFrame, policy: str, id_col: str) -> DataFrame:
    """Per policy: attempts, completed proofs, reached places, reports, and distinct reports of known truth.

    ``attempts``: policy, id, status, reached, reported, setup_reused, wall_seconds.
    ``truth``: id, expected (boolean). Unknown ids count in no truth column.
    """
    j = attempts.join(truth.select(id_col, "expected"), id_col, "left")
    known = lambda flag: F.count_distinct(F.when(F.col("reported") & (F.col("expected") == flag), F.col(id_col)))
    return j.groupBy(policy).agg(
        F.count(F.lit(1)).alias("attempts"), _n(F.col("status").isin("proven", "refuted")).alias("completed"), _n(F.col("reached")).alias("reached"), _n(F.col("reported")).alias("reports"),
        known(True).alias("known_positive_reports"), known(False).alias("known_false_reports"), _n(F.col("setup_reused")).alias("setup_reuse"), F.sum("wall_seconds").alias("wall_seconds"),
    )


def oracle_bound(cases: DataFrame, by: Sequence[str], id_col: str, expected: Column, budget: int) -> DataFrame:
    """The most that any policy could report per group: its positives, first by id, within the budget."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(id_col))
    return cases.where(expected).withColumn("place", place).where(F.col("place") <= max(0, budget)).select(*by, id_col, "place")


def policy_benchmark(runs: DataFrame, policy: str, baseline: str, reports: str, seconds: str) -> DataFrame:
    """Per policy: median reports and seconds over repetitions, regret against the best policy, and whether it beats the baseline.

    It beats the baseline with more reports, or as many in less time.
    """
    m = runs.groupBy(policy).agg(F.count(F.lit(1)).alias("repetitions"), F.median(reports).alias("reports"), F.median(seconds).alias("seconds"))
    every = Window.partitionBy()  # one row a policy
    base = lambda c: F.max(F.when(F.col(policy) == baseline, F.col(c))).over(every)
    better = (F.col("reports") > base("reports")) | ((F.col("reports") == base("reports")) & (F.col("seconds") < base("seconds")))
    return m.select(policy, "repetitions", "reports", "seconds", (F.max("reports").over(every) - F.col("reports")).alias("regret"), F.coalesce(better, F.lit(False)).alias("beats_baseline"))


def holdout_evaluation(rows: DataFrame, split: str, keys: Sequence[str], positive: Column, least: int = 2) -> DataFrame:
    """Fits smoothed rates on the calibration rows and scores the holdout with them.

    keys, n (holdout rows), expected and observed positives, absolute error. Keys that
    calibration has not seen ``least`` times fall back to the rate of all its rows.
    """
    rate = lambda hits, n: (hits + 1.0) / (n + 2.0)
    calibration = rows.where(F.col(split) == "calibration")
    fitted = calibration.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _n(positive).alias("_hits"))
    whole = calibration.agg(rate(_n(positive), F.count(F.lit(1))).alias("_all"))
    held = rows.where(F.col(split) == "holdout").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _n(positive).alias("observed"))
    j = held.join(fitted, list(keys), "left").join(F.broadcast(whole))  # one row
    p = F.when(F.col("_n") >= least, rate(F.col("_hits"), F.col("_n"))).otherwise(F.col("_all"))
    return j.select(*keys, "n", (p * F.col("n")).alias("expected"), "observed", F.abs(p * F.col("n") - F.col("observed")).alias("error"))
