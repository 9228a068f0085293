"""Selections: prefixes of stable orders, top-k, predicates, policies and state machines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_take(df: DataFrame, order: Sequence[Column], skip: int, take: int | None) -> DataFrame:
    """Rows ``skip`` .. ``skip + take`` of a stable order."""
    out = df.orderBy(*order).offset(skip)
    return out if take is None else out.limit(take)


def top_per_class(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each class, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def unique_then_limit(df: DataFrame, unique: Sequence[str], owner: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """One row per obligation, then at most ``limit`` per owner."""
    first = top_per_class(df, unique, order, 1).drop("place")
    return top_per_class(first, owner, order, limit)


def blockers_allowed(blockers: Column, allowed: Sequence[str]) -> Column:
    """No blocker outside the allowed ones; NULL blockers mean none."""
    return F.size(F.array_except(F.coalesce(blockers, F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed]))) == 0


def preconditions(status: Column, verdict: Column, blockers: Column, statuses: Sequence[str], verdicts: Sequence[str], allowed: Sequence[str]) -> Column:
    """Whether a candidate may be proven; any NULL is no."""
    return F.coalesce(status.isin(*statuses) & verdict.isin(*verdicts), F.lit(False)) & blockers_allowed(blockers, allowed)


def exact_operation(operation: Column, function: Column) -> Column:
    """The operation has an address of its own (compared without case)."""
    return F.coalesce((F.lower(operation) != F.lower(function)) & (F.trim(operation) != ""), F.lit(False))


#: Prefixes of read-only methods, and words of those that change state.
SAFE_METHODS = "^(get|list|status|info|read|dump|show|query|stat)"
UNSAFE_METHODS = "set|write|delete|remove|reset|reboot|restart|stop|kill|exec|add|apply|commit|flash|upgrade"


def safe_method(name: Column) -> Column:
    x = F.lower(name)
    return F.coalesce(x.rlike(SAFE_METHODS) & ~x.rlike(UNSAFE_METHODS), F.lit(False))


def transaction_plan(objects: DataFrame, methods: DataFrame, options: DataFrame) -> DataFrame:
    """Variants: each object's safe methods, bare and once per optional argument."""
    m = objects.join(methods.where(safe_method(F.col("method"))), "object")
    bare = m.withColumn("argument", F.lit(None).cast("string"))
    one = m.join(options, ["object", "method"])
    return bare.unionByName(one.select(bare.columns)).withColumn("variant_id", F.substring(F.sha2(F.concat_ws("|", "object", "method", F.coalesce("argument", F.lit(""))), 256), 1, 12))


def policies(cases: DataFrame, rules: Mapping[str, Column], truth: Column) -> DataFrame:
    """Outcomes of several what-if policies over the same cases, in one pass. NULL verdicts are blocked."""
    pairs = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("verdict")) for n, c in rules.items()])
    long = cases.withColumn("_truth", truth).select("_truth", F.explode(pairs).alias("x")).select("_truth", "x.policy", "x.verdict")
    v, t = F.col("verdict"), F.col("_truth")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = long.groupBy("policy").agg(n(v & t).alias("reported"), n(v & ~t).alias("false_positive"), n(~v & t).alias("missed"), n(~v & ~t).alias("clean"), n(v.isNull()).alias("blocked"))
    recall = F.when(F.col("reported") + F.col("missed") > 0, F.col("reported") / (F.col("reported") + F.col("missed")))
    fpr = F.when(F.col("false_positive") + F.col("clean") > 0, F.col("false_positive") / (F.col("false_positive") + F.col("clean")))
    return out.withColumn("conditional_recall", recall).withColumn("conditional_fpr", fpr)


def route_choice(routes: DataFrame, key: str, score: Column, probability: Column, cost: Column) -> DataFrame:
    """Per candidate the viable route of highest score * p / cost; -1e6 and no route if none is viable."""
    value = score * probability / F.greatest(F.lit(0.05), cost)
    r = routes.withColumn("_v", F.when(F.col("viable"), value))
    best = F.max_by("route", F.struct("_v", "route"))
    return r.groupBy(key).agg(F.coalesce(F.max("_v"), F.lit(-1e6)).alias("ranking"), F.when(F.max("_v").isNotNull(), best).alias("route"))


def available_routes(routes: DataFrame, attempts: DataFrame, failures: int = 2) -> DataFrame:
    """Viable routes not yet attempted, whose scope has failed fewer than ``failures`` times."""
    tried = attempts.select("candidate_id", "route").distinct()
    failed = attempts.where("outcome = 'failed'").groupBy("candidate_id", "scope").agg(F.count(F.lit(1)).alias("_failed"))
    return routes.where("viable").join(tried, ["candidate_id", "route"], "left_anti").join(failed, ["candidate_id", "scope"], "left").where(F.coalesce("_failed", F.lit(0)) < failures).drop("_failed")


#: Candidate states and the moves between them.
MOVES = {"candidate": ["proof_ready", "blocked", "rejected"], "proof_ready": ["proving", "blocked", "rejected"], "proving": ["proven", "rejected", "blocked"], "proven": ["report_ready", "blocked"], "blocked": ["candidate", "proof_ready"], "report_ready": [], "rejected": []}


def illegal_moves(log: DataFrame, keys: Sequence[str], order: Sequence[Column], state: str) -> DataFrame:
    """Consecutive states of a key that the state machine does not allow."""
    w = Window.partitionBy(*keys).orderBy(*order)
    allowed = F.create_map(*[x for a, bs in MOVES.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    moved = log.withColumn("previous", F.lag(state).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))
    return moved.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("previous")), F.col(state)), F.lit(False)))


def median_spans(events: DataFrame, keys: Sequence[str], order: Sequence[Column], is_start: Column, is_end: Column, at: str) -> DataFrame:
    """Median duration of FIFO-paired spans per key."""
    from .joins import paired_spans

    spans = paired_spans(events, keys, order, is_start, is_end, at)
    return spans.where(F.col("end") >= F.col("start")).groupBy(*keys).agg(F.median(F.col("end") - F.col("start")).alias("median"), F.count(F.lit(1)).alias("spans"))
