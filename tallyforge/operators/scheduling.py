"""Yield model, batching, costs, scores and budgeted schedules."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yield_model(training: DataFrame, kind: str, route: str, success: Column, least: int = 2) -> DataFrame:
    """(1 + x) / (2 + n) per (kind, route); backs off to the route, then to 0.5, below ``least`` rows."""
    rows = training.withColumn("_ok", success.cast("int"))
    smooth = lambda x, n: (1.0 + x) / (2.0 + n)
    pair = rows.groupBy(kind, route).agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("x"))
    # the route's totals follow from the pairs': no second pass over the rows
    whole = Window.partitionBy(route)
    pair = pair.withColumn("route_n", F.sum("n").over(whole)).withColumn("route_x", F.sum("x").over(whole))
    p = F.when(F.col("n") >= least, smooth(F.col("x"), F.col("n"))).when(F.col("route_n") >= least, smooth(F.col("route_x"), F.col("route_n"))).otherwise(F.lit(0.5))
    basis = F.when(F.col("n") >= least, "pair").when(F.col("route_n") >= least, "route").otherwise("uniform")
    return pair.withColumn("probability", p).withColumn("basis", basis)


def proof_batches(df: DataFrame, setup_key: Column, route: str, setup: str, marginal: str) -> DataFrame:
    """Rows that share a setup pay it once: unbatched, batched and saved cost per batch."""
    out = df.withColumn("setup_key", setup_key).groupBy("setup_key", route).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.col(setup) + F.col(marginal)).alias("unbatched"), (F.max(setup) + F.sum(marginal)).alias("batched")
    )
    return out.withColumn("saved", F.greatest(F.lit(0.0), F.col("unbatched") - F.col("batched")))


def seeded_score(seed: str, id_: Column) -> Column:
    """A reproducible number in [0, 1) from sha256(seed NUL id)."""
    digest = F.sha2(F.concat(F.lit(seed), F.decode(F.unhex(F.lit("00")), "UTF-8"), id_.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def evidence_score(ready: Column, exact: Column, trace: Column, entry: Column, inputs: Column, capacity: Column, same: Column, severity: Column, blockers: Column) -> Column:
    """Additive evidence score; ``blockers`` is an array of reasons."""
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    grade = F.when(severity == "critical", 2.0).when(severity == "high", 1.5).when(severity == "medium", 0.5).otherwise(0.0)
    hard = F.exists(blockers, lambda b: b.rlike("unsupported|unresolved|missing"))
    total = add(ready, 5.0) + add(exact, 4.0) + add(trace, 3.0) + add(entry, 2.0) + add(inputs, 2.0) + add(capacity, 1.5) + add(same, 1.5) + grade
    return total - 0.75 * F.size(blockers) - add(hard, 4.0)


def route_cost(setup: Column, warm: Column, marginal: Column, measured: Column, blockers: Column) -> Column:
    """Setup unless warm, plus the larger of configured and measured marginal cost, times a blocker factor."""
    own = F.greatest(marginal, F.when(measured > 0, measured))
    return (F.when(warm, 0.0).otherwise(setup) + own) * F.least(F.lit(2.0), 1.0 + 0.1 * blockers)


def variant_utility(distance: Column, fields: Column, reused: Column, reaches: Column, seconds: Column) -> Column:
    near = F.when(F.coalesce(distance, F.lit(-1)) < 0, 0.0).otherwise(4.0 / (1.0 + distance))
    return (near + 2.0 / (1.0 + fields) + F.when(reused, 2.0).otherwise(0.0) + F.least(F.lit(4.0), 1.5 * reaches)) / F.greatest(F.lit(0.05), seconds)


def ranking_score(score: Column, probability: Column, cost: Column) -> Column:
    """Expected value of a route per unit of cost."""
    return score * probability / F.greatest(F.lit(0.05), cost)


def budget_schedule(df: DataFrame, keys: Sequence[str], score: str, id_col: str, cost: str, budget: float) -> DataFrame:
    """Greedy by (-score, id): what does not fit is deferred, and later rows may still fit. 0: no limit.

    The choice depends on all earlier ones, so a schedule is one sequential pass. Keys
    split independent schedules (per worker pool); one pass reads ids, scores and costs only.
    """
    names = [*keys, id_col, score, cost]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema) + ", rank long, selected boolean, spent double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        spent, chosen, sums = 0.0, [], []
        for c in rows[cost]:
            fits = budget <= 0 or spent + c <= budget
            spent += c if fits else 0.0
            chosen.append(fits)
            sums.append(spent)
        return rows.assign(rank=range(1, len(rows) + 1), selected=chosen, spent=sums)

    return df.select(*names).groupBy(*keys).applyInPandas(run, schema)


def online_order(df: DataFrame, attempts: Column, score: Column, id_col: str) -> DataFrame:
    """Schedule order: fewer prior attempts, higher score, smaller id."""
    return df.orderBy(attempts.asc(), score.desc(), F.col(id_col).asc())


def transaction_schedule(df: DataFrame, keys: Sequence[str], policy: str, wall: float = 0.0, cpu: float = 0.0) -> DataFrame:
    """Order of variants under wall and CPU budgets (0: none), scored anew after every choice.

    Columns: variant_id, method, setup_key, distance, fields, seconds, cpu_seconds, reaches.
    Policies: fixed (input order by id), cheapest, utility (reach 0), adaptive (a method's last
    measured reach feeds its later variants). A variant that does not fit is passed over for good.
    A schedule is sequential by definition; schedules of different keys run in parallel.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "variant_id"]) + ", step long, score double, setup_reused boolean, spent_wall double, spent_cpu double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values("variant_id", kind="stable").to_dict("records")
        warm: set = set()
        reach: dict = {}
        spent, used, out = 0.0, 0.0, []

        def score(r: dict) -> float:
            if policy == "fixed":
                return 0.0
            if policy == "cheapest":
                return -r["seconds"]
            near = 0.0 if r["distance"] is None or r["distance"] != r["distance"] or r["distance"] < 0 else 4.0 / (1.0 + r["distance"])
            seen = reach.get(r["method"], 0) if policy == "adaptive" else 0
            return (near + 2.0 / (1.0 + r["fields"]) + 2.0 * (r["setup_key"] in warm) + min(4.0, 1.5 * seen)) / max(0.05, r["seconds"])

        while left:
            best = min(left, key=lambda r: (-score(r), r["variant_id"]))
            left.remove(best)
            if (wall > 0 and spent + best["seconds"] > wall) or (cpu > 0 and used + best["cpu_seconds"] > cpu):
                continue
            value, reused = score(best), best["setup_key"] in warm
            spent, used = spent + best["seconds"], used + best["cpu_seconds"]
            warm.add(best["setup_key"])
            reach[best["method"]] = best["reaches"]
            out.append((*(best[k] for k in keys), best["variant_id"], len(out) + 1, value, reused, spent, used))
        return pd.DataFrame(out, columns=[*keys, "variant_id", "step", "score", "setup_reused", "spent_wall", "spent_cpu"])

    return df.groupBy(*keys).applyInPandas(run, schema)
