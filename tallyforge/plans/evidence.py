"""Candidate lifecycle: gates, promotion, triage and reports over evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def reportable(policy: Column) -> Column:
    """Fail-closed gate over a candidate joined with its proof. Any missing fact is false."""
    proven = F.col("proof_status") == "proven"
    memory = _true(F.col("exact_operation_reached")) & F.col("memory_access").isin("write", "read")
    lifetime = _true(F.col("exact_operation_reached")) & F.col("lifetime_violation").isNotNull()
    semantic = (F.col("scope") == "process") & F.col("process_setup").isin("configured") & F.col("concrete_input").isNotNull() & F.col("effect_observation").isNotNull() & (F.col("effect_kind") == F.col("expected_effect"))
    static = _true(F.col("exact_operation_reached")) & (F.col("static_evidence") == "exact_reachable")
    own = F.when(policy == "memory_access", memory).when(policy == "lifetime", lifetime).when(policy == "semantic", semantic).when(policy == "static_evidence", static)
    return _true((F.col("backend") == F.col("proof_backend")) & proven & own)


def promote(states: DataFrame, proofs: DataFrame, policy: str = "backend") -> DataFrame:
    """States with status and blockers after their proofs; candidates without a proof are unchanged.

    refuted becomes rejected, reportable becomes report_ready; anything else gains a blocker.
    """
    p = proofs.select("candidate_id", F.col("backend").alias("proof_backend"), F.col("status").alias("proof_status"), *[c for c in proofs.columns if c not in ("candidate_id", "backend", "status")])
    j = states.join(p, "candidate_id", "left").withColumn("_ok", reportable(F.col(policy)))
    reason = F.coalesce(F.col("blocker"), F.concat(F.lit("proof_"), F.col("proof_status")))
    status = F.when(F.col("proof_status").isNull(), F.col("status")).when(F.col("proof_status") == "refuted", "rejected").when(F.col("_ok"), "report_ready").otherwise(F.col("status"))
    held = F.col("proof_status").isNotNull() & (F.col("proof_status") != "refuted") & ~F.col("_ok")
    blockers = F.when(held, F.array_union(F.coalesce("blockers", F.array().cast("array<string>")), F.array(reason))).otherwise(F.col("blockers"))
    out = j.withColumn("new_status", status).withColumn("new_blockers", blockers)
    return out.select(*[c for c in states.columns if c not in ("status", "blockers")], F.col("status").alias("old_status"), F.col("new_status").alias("status"), F.col("new_blockers").alias("blockers"))


def promotion_events(promoted: DataFrame, at: Column) -> DataFrame:
    """The append log of actual status changes."""
    moved = promoted.where(F.col("old_status") != F.col("status"))
    return moved.select("candidate_id", F.col("old_status").alias("from_status"), F.col("status").alias("to_status"), at.alias("timestamp"))


def replay_rank(result: str = "result") -> Column:
    return (
        F.when((F.col(result) == "confirmed") & _true(F.col("sink_reached")) & _true(F.col("bug_observed")), 70)
        .when(_true(F.col("sink_reached")), 50)
        .when(_true(F.col("crash_observed")), 40)
        .when(F.col(result) == "sink_not_reached", 30)
        .when(F.col(result) == "setup_invalid", 20)
        .when(F.col(result) == "blocked", 10)
        .otherwise(0)
    )


def best_replay(replays: DataFrame, ordinal: Column) -> DataFrame:
    """Per candidate the replay of highest rank; only a strictly higher one replaces."""
    return dedupe.best_per_key(replays, ["candidate_id"], replay_rank(), ordinal)


def best_proof(proofs: DataFrame, ordinal: Column) -> DataFrame:
    """proven > refuted > inconclusive > unsupported; the last of equals wins."""
    rank = F.when(F.col("status") == "proven", 3).when(F.col("status") == "refuted", 2).when(F.col("status") == "inconclusive", 1).otherwise(0)
    return dedupe.best_per_key(proofs, ["candidate_id"], rank, ordinal, last_wins=True)


def triage_tier() -> Column:
    """First tier that applies."""
    verdict, proven = F.col("verdict"), F.col("proof_status") == "proven"
    return (
        F.when((F.col("kind") == "oob_read") & proven, "deterministic_high")
        .when(F.col("kind").isin("integer_overflow", "integer_truncation"), "integer_relation")
        .when((verdict == "overflow") & proven, "deterministic_high")
        .when(F.col("object_kind").isin("caller_buffer", "parameter"), "api_contract")
        .when((F.col("object_kind") == "heap") & F.col("capacity_bytes").isNull(), "symbolic_heap")
        .when(F.col("reason").startswith("symbolic"), "symbolic")
        .when(F.col("reason") == "append", "append")
        .when(F.col("reason") == "loop_alias", "loop_alias")
        .otherwise("triage")
    )


def lift_class() -> Column:
    """What a hypothesis added over the baseline."""
    seen = _true(F.col("replayed")) & _true(F.col("sink_reached")) & _true(F.col("bug_observed"))
    return F.when((F.col("system") == "D0") | (F.col("decision") == "rejected"), "no_lift").when(seen, "proof_lift").when(F.col("kind") == "candidate", "discovery_lift").when(F.col("kind") == "ranking", "ranking_lift").when(F.col("kind") == "explanation", "explanation_lift").otherwise("no_lift")


def reachability_kind() -> Column:
    """local_source > source_path > entry_path > unknown."""
    return F.when(_true(F.col("has_local_source")), "local_source").when(F.size("source_path") > 0, "source_path").when(F.size("entry_path") > 0, "entry_path").otherwise("unknown")


def claim_failures(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Report claims without an artifact behind them."""
    return claims.join(artifacts.select("candidate_id", "claim").distinct(), ["candidate_id", "claim"], "left_anti")


def review_units(findings: DataFrame) -> DataFrame:
    """One unit per (binary, function, type) with a stable id."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("binary", "function", "type")]
    key = F.concat(parts[0], nul, parts[1], nul, parts[2])
    return findings.groupBy("binary", "function", "type").agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids")).withColumn("unit_id", F.substring(F.sha2(key, 256), 1, 16))


def policy_views(findings: DataFrame) -> dict[str, DataFrame]:
    """Reportable, confirmation and triage views of one input, and a histogram of tiers."""
    tiered = findings.withColumn("tier", triage_tier())
    return {
        "reportable": tiered.where(F.col("tier") == "deterministic_high"),
        "confirmation": tiered.where(F.col("tier").isin("integer_relation", "api_contract", "symbolic_heap")),
        "triage": tiered.where(~F.col("tier").isin("deterministic_high", "integer_relation", "api_contract", "symbolic_heap")),
        "histogram": tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("n")),
    }
