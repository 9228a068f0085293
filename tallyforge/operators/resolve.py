"""Resolving and merging records that several sources describe: exact matches, cascades, fall-backs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_cascade(rows: DataFrame, id_col: str, places: DataFrame, keys: Sequence[str], place: str, strategies: Sequence[tuple[str, Column]]) -> DataFrame:
    """id, place, strategy: the place of the first strategy that leaves exactly one, else NULL.

    ``rows`` and ``places`` are joined once on ``keys``; a strategy is a condition over
    the joined row. Several matches of a strategy do not decide, and the next one is asked.
    """
    matched = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, (_, c) in enumerate(strategies)])
    hits = rows.join(places, list(keys)).select(id_col, place, F.explode(F.array_compact(matched)).alias("_s")).distinct()
    each = hits.groupBy(id_col, "_s").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias(place)).where("n = 1")
    best = each.groupBy(id_col).agg(F.min(F.struct("_s", place)).alias("b"))
    names = F.array(*[F.lit(n) for n, _ in strategies])
    return rows.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.col("b")[place].alias(place), F.when(F.col("b").isNotNull(), F.element_at(names, F.col("b._s") + 1)).alias("strategy"))


def first_key(rows: DataFrame, id_col: str, candidates: Column, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the table's columns at the first of several keys that it holds (ordered fall-backs); NULLs if none."""
    asked = rows.select(id_col, F.posexplode(candidates).alias("_pos", key))
    value = F.struct(*[F.col(c) for c in table.columns])
    found = asked.join(table, key).groupBy(id_col).agg(F.min_by(value, "_pos").alias("_v"))
    return rows.join(found, id_col, "left").select(*rows.columns, *[F.col("_v")[c].alias(c) for c in table.columns])


def merge_operations(rows: DataFrame, keys: Sequence[str], exact: Column, order: Sequence[Column], fill: Sequence[str], roles: str | None = None) -> DataFrame:
    """One row per key: the first exact row, or the first of all; others only fill what it lacks.

    ``roles``: a map column whose entries others may add to but not replace.
    """
    rank = F.when(F.coalesce(exact, F.lit(False)), 0).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(rank, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = Window.partitionBy(*keys).orderBy(rank, *order)
    out = rows.withColumns({f"_{c}": F.first(c, ignorenulls=True).over(w) for c in fill})
    out = out.withColumns({"_rn": F.row_number().over(place), "merged": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    if roles:
        # entries by name: the value of the first row that has the name
        entry = rows.withColumn("_rn", F.row_number().over(place)).select(*keys, "_rn", F.explode(roles).alias("_k", "_v"))
        kept = entry.groupBy(*keys, "_k").agg(F.min_by("_v", "_rn").alias("_v")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_roles"))
        out = out.join(kept, list(keys), "left")
    chosen = [F.col(f"_{c}").alias(c) if c in fill else F.coalesce("_roles", roles).alias(c) if c == roles else F.col(c) for c in rows.columns]
    return out.where("_rn = 1").select(*chosen, "merged")


def prefer(primary: DataFrame, secondary: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """One row per key: the primary's where there is one; lists are both's, the secondary's entries first."""
    names = [c for c in primary.columns if c != key]
    a, b = primary.select(key, F.struct(*names).alias("_a")), secondary.select(key, F.struct(*names).alias("_b"))
    j = a.join(b, key, "full_outer")
    none = lambda side, c: F.coalesce(F.col(side)[c], F.array().cast(primary.schema[c].dataType))
    pick = lambda c: F.array_distinct(F.concat(none("_b", c), none("_a", c))) if c in lists else F.when(F.col("_a").isNotNull(), F.col("_a")[c]).otherwise(F.col("_b")[c])
    return j.select(key, *[pick(c).alias(c) for c in names])


def merge_equivalent(rows: DataFrame, signature: Sequence[str], mergeable: Column, order: Sequence[Column], lists: Sequence[str]) -> DataFrame:
    """The first row per signature; lists also take, in order, the entries of later rows that may be merged."""
    w = Window.partitionBy(*signature).orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_m", (F.col("_rn") == 1) | F.coalesce(mergeable, F.lit(False)))
    first = ranked.where("_rn = 1").drop(*lists, "_m", "_rn")
    out = first
    for c in lists:
        entry = ranked.where("_m").select(*signature, "_rn", F.posexplode(c).alias("_pos", "_e"))
        entry = entry.groupBy(*signature, "_e").agg(F.min(F.struct("_rn", "_pos")).alias("_at"))
        joined = entry.groupBy(*signature).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias(c))
        out = out.join(joined, list(signature), "left").withColumn(c, F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)))
    return out.select(*rows.columns)


def line_addresses(rows: DataFrame, keys: Sequence[str], line: str, scalars: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """keys, address, line: every address that a line's record names, at its first line by order of lines."""
    named = F.concat(F.array(*[F.col(c) for c in scalars]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    each = rows.select(*keys, F.col(line).alias("line"), F.explode(F.array_distinct(F.array_compact(named))).alias("address")).where("address <> ''")
    return each.groupBy(*keys, "address").agg(F.min("line").alias("line"))


def same_place_roles(consumers: DataFrame, place: Sequence[str], role: str, wanted: Sequence[str], of: str) -> DataFrame:
    """Rows of role ``of`` at places where all wanted roles meet (such as user name and password of one call)."""
    full = consumers.where(F.col(role).isin(*wanted)).groupBy(*place).agg(F.count_distinct(role).alias("_roles")).where(F.col("_roles") == len(set(wanted)))
    return consumers.where(F.col(role) == of).join(full.select(*place), list(place), "left_semi")


#: Blockers that a run which reached the sink removes.
PROOF_BLOCKERS = ("overflow_condition_proof", "attacker_input_reaches_sink")


def integrate_runs(states: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """States with blockers removed and artifacts added where a run reached the sink on generated input.

    ``states``: key, blockers, artifacts. ``runs``: key, ran, reached, generated, refs.
    ``lifted`` says whether a blocker went. Other states stay as they are.
    """
    good = runs.where("ran AND reached AND generated").select(key, "refs")
    j = states.join(good, key, "left")
    left = F.filter("blockers", lambda b: ~b.isin(*PROOF_BLOCKERS))
    hit = F.col("refs").isNotNull()
    return j.select(
        *[F.when(hit, left).otherwise(F.col(c)).alias(c) if c == "blockers" else F.when(hit, F.concat(c, "refs")).otherwise(F.col(c)).alias(c) if c == "artifacts" else F.col(c) for c in states.columns],
        (hit & (F.size(left) < F.size("blockers"))).alias("lifted"),
    )


def surface(rows: DataFrame, kind: str, symbol: Column, reportable: Column) -> DataFrame:
    """Distinct symbols that a surface detects: ``candidate`` and ``confirmation`` take all rows, ``reportable`` only those."""
    if kind not in ("candidate", "confirmation", "reportable"):
        raise ValueError(f"unknown surface {kind}")
    some = rows.where(F.coalesce(reportable, F.lit(False))) if kind == "reportable" else rows
    return some.select(symbol.alias("symbol")).where("symbol IS NOT NULL AND symbol <> ''").distinct()


def regression_subset(cases: DataFrame, id_col: str, flagged: Column, default: Sequence[str]) -> DataFrame:
    """Flagged cases and the default ones; a default case that is missing fails the job."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(x,) for x in default], "want string")
    missing = wanted.join(cases.select(F.col(id_col).cast("string").alias("want")), "want", "left_anti")
    absent = missing.agg(F.array_sort(F.collect_list("want")).alias("m")).select(F.when(F.size("m") > 0, F.raise_error(F.concat(F.lit("regression subset lacks "), F.array_join("m", ", "))).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    some = cases.where(F.coalesce(flagged, F.lit(False)) | F.col(id_col).cast("string").isin(*default))
    return some.join(F.broadcast(absent)).where("_ok").drop("_ok")  # one row


def expand_destructors(reached: DataFrame, functions: DataFrame) -> DataFrame:
    """Reached names and the destructors (``~Class``) of classes that a reached function's text names.

    ``reached``: name. ``functions``: name, text. Words of the texts meet class names in an
    equi-join, not by searching every text for every class.
    """
    classes = functions.where("name LIKE '~_%'").select(F.col("name").alias("destructor"), F.substring("name", 2, 1_000).alias("word"))
    words = functions.join(reached.select("name").distinct(), "name", "left_semi").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word")).distinct()
    more = classes.join(words, "word", "left_semi").select(F.col("destructor").alias("name"))
    return reached.select("name").unionByName(more).distinct()


def entry_surface(routes: Column, services: Column, ports: Column, applet: Column, daemon: Column) -> Column:
    """How outside input enters: by matched routes first, then by matched services; empty if none match."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    return (
        F.when(~none(routes), "cgi_handler")
        .when(none(services), "")
        .when(F.coalesce(applet, F.lit("")) != "", "busybox_applet")
        .when(~none(ports) | F.coalesce(daemon, F.lit(False)), "daemon_launch")
        .otherwise("service_launch")
    )


def attach(rows: DataFrame, table: DataFrame, keys: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """Columns of the one table row with a row's keys; NULL where there is none or several."""
    one = table.groupBy(*keys.values()).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns]).where("_n = 1").drop("_n")
    right = one.select(*[F.col(v).alias(f"_{v}") for v in keys.values()], *columns)
    on = [F.col(k) == F.col(f"_{v}") for k, v in keys.items()]
    return rows.join(right, on, "left").select(*rows.columns, *columns)
