"""Gates that decide which candidates go on: confirmation rules, input and flow predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of roles that outside input controls.
CONTROLLED = ("source_controlled", "parameter_controlled")
#: Roles by which input can steer an access.
STEERING_ROLES = ("write_source", "write_size", "write_offset", "read_source", "read_size", "read_offset")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def confirmation_rule(admissible: Column, verdict: Column, relation: Column, confirmed_path: Column, offset_class: Column, extent_controlled: Column, loop_frontier: Column, actionable: Column) -> Column:
    """The one rule that admits a write candidate to confirmation, or NULL.

    ``admissible`` sums up the object, alignment and safety checks before all rules.
    """
    decided = _true(verdict.isin("overflow", "unbounded"))
    unbounded = _true((verdict == "unbounded") | (relation == "unbounded"))
    steered = _true(offset_class.isin(*CONTROLLED, "unknown")) & _true(actionable)
    return F.when(~_true(admissible), F.lit(None).cast("string")).when(decided, F.when(_true(confirmed_path), F.when(unbounded, "unbounded_sink").otherwise("exact_overflow"))).when(
        (relation == "symbolic_offset") & steered, "controlled_offset"
    ).when(relation.isin("symbolic_size", "append_length_unknown") & _true(extent_controlled) & _true(actionable), "controlled_extent").when((relation == "iterated_alias_unproven") & _true(loop_frontier), "loop_alias_frontier")


def read_confirmation_rule(admissible: Column, relation: Column, confirmed_path: Column, actionable: Column) -> Column:
    """The rule that admits a read candidate, or NULL."""
    open_ = F.when(relation == "symbolic_size", "controlled_extent").when(relation == "symbolic_read_offset", "controlled_read_offset")
    return F.when(~_true(admissible), F.lit(None).cast("string")).when(relation == "proven_oob_read", F.when(_true(confirmed_path), "exact_oob_read")).when(_true(actionable), open_)


def deterministic_input(trace_status: Column, reaches: Column, blockers: Column, causal: Column, entry_ready: Column, harness: Column, roles: Column) -> Column:
    """Whether a run can be given input that decides the access.

    Either a complete, unblocked and causal trace, or something executable (a derived entry
    or a harness) with a complete role that input controls; a parameter counts in a harness
    only. ``roles``: array<struct<name, class, complete>>.
    """
    traced = _true(F.lower(trace_status).isin("complete", "proven")) & _true(reaches) & (F.coalesce(F.size(blockers), F.lit(0)) <= 0) & _true(causal)
    steers = lambda r: r["name"].isin(*STEERING_ROLES) & _true(r["complete"]) & ((r["class"] == "source_controlled") | ((r["class"] == "parameter_controlled") & _true(harness)))
    return traced | ((_true(entry_ready) | _true(harness)) & _true(F.exists(roles, steers)))


def reportable_flow(proofs: Column, override: Column, trace_status: Column) -> Column:
    """A flow may be reported on any process proof, an override artifact, or a proven trace."""
    return _true(F.exists(proofs, lambda p: _true(p))) | _true(override) | _true(trace_status == "proven")


def string_signals(strings: Column, routes: Column, hay: Column, pattern: str) -> Column:
    """array<struct<anchor, kind>> of a class's words in a function's strings, then in routes whose tokens the function names; each anchor once."""
    hit = lambda x: x.rlike(pattern)
    own = F.transform(F.filter(strings, hit), lambda x: F.struct(x.alias("anchor"), F.lit("function_string").alias("kind")))
    tokens = lambda r: F.filter(F.split(F.lower(r), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    named = lambda r: (F.size(tokens(r)) == 0) | F.exists(tokens(r), lambda w: F.contains(hay, w))
    others = F.transform(F.filter(routes, lambda r: hit(r) & named(r)), lambda r: F.struct(r.alias("anchor"), F.lit("route").alias("kind")))
    both = F.concat(own, others)
    first = F.transform(both, lambda x, i: F.struct(x["anchor"].alias("anchor"), x["kind"].alias("kind"), F.array_position(F.transform(both, lambda y: y["anchor"]), x["anchor"]).alias("at"), (i + 1).alias("i")))
    return F.transform(F.filter(first, lambda x: x["at"] == x["i"]), lambda x: F.struct(x["anchor"].alias("anchor"), x["kind"].alias("kind")))
