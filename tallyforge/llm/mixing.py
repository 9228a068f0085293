"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the sum of all sizes; a target stops at ``most`` times its source's size and
the excess is shared again by weight, in rounds over the table of sources, until none
is above.

Rates: of all document rates 0 <= r_d <= ``most`` whose tokens meet their source's
target, sum(size_d r_d) = T_s, the ones of least divergence sum(r_d log r_d - r_d + 1)
from the plain corpus are exponential tilts r_d = min(most, exp(lambda_s size_d)): a
source above its share favours its long documents, one below its short ones. The
concave dual, sum_s lambda_s T_s - sum_d integral of r_d, has one multiplier a source
and no closed form. Each Newton step of all sources at once sums gradient and Hessian
over the counts of equal sizes per source, by grouped aggregation; a step that leaves
the bracket known so far is replaced by its middle, so every source converges.

Rounding: within groups of about ``GROUP`` documents of one source, from large to
small, the words not yet placed are carried to the next document, and no more are left
than the smaller ones can give or take. Of ``2 TRIES - 1`` such passes, which start a
fraction of a mean document ahead or behind, the nearest to the target stays; a group's
error is below its smallest document. Groups are hashed, so a source with a third of
all rows is spread over as many groups as it needs.

Null text counts no words. A null source is a source. Documents of size 0 have rate 1.
Long texts weigh as their words. Rows that repeat are documents of their own; ties of
size go by hash. An empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, shared_checkpoint, table

GROUP = 250
#: Newton steps at most; the bracket halves at least, so 60 exhaust double precision.
STEPS = 60
#: Newton ends when every source's expected tokens are so near its target, relatively.
NEAR = 1e-9
MOST = 3
TRIES = 4


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sums: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, n -> with target. One row per source.

    Ranks come from a range partitioning: a source's place is its place in its
    partition plus the rows of the partitions before.
    """
    ranged = shared_checkpoint(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())  # a row for each partition
    before = ranged.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes] or [(0, 0)], "_p int, _before long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * F.lit(float(most))
    weighed = shared_checkpoint(ranged.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("_w", ((F.col("_i") + F.col("_before")) % 3 + 1).cast("double")).withColumn("_cap", cap).drop("_p", "_i", "_before"))
    # the level at which open sources share what the capped ones leave; it only rises
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("_cap"))).alias("gone"), F.sum(F.when(~over, F.col("_w"))).alias("open"), F.count(F.when(over, 1)).alias("capped")
        ).first()
        if got["capped"] == capped or not got["open"]:
            break
        level, capped = (got["all"] - (got["gone"] or 0.0)) / got["open"], got["capped"]
    return weighed.withColumn("target", F.least("_cap", F.lit(level) * F.col("_w"))).select("source", "source_size", "n", "target")


def _rate(size: Column, multiplier: Column, most: int) -> Column:
    """The tilted rate; the exponent is cut where the rate is capped anyway."""
    return F.when(multiplier.isNull(), F.lit(float(most))).otherwise(F.least(F.exp(F.least(multiplier * size, F.lit(50.0))), F.lit(float(most))))


def multipliers(counts: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``targets`` with ``multiplier``, that of the source's tilt (null: all rates at the cap).

    ``counts``: source, size, n, one row per size of a source.
    """
    # sizes are scaled by their source's mean, so all multipliers are of order 1
    open_ = targets.where((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size")))
    state = open_.select("source", "target", (F.col("source_size") / F.col("n")).alias("unit"), F.lit(0.0).alias("x"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = shared_checkpoint(state)
    counts = shared_checkpoint(counts.where("size > 0"))
    for _ in range(STEPS):
        z = F.col("size") / F.col("unit")
        rate = _rate(z, F.col("x"), most)
        joined = join_checked(counts, state, ["source"], how="inner").withColumns({"z": z, "r": rate})
        got = F.sum(F.col("n") * F.col("size") * F.col("r"))
        slope = F.sum(F.when(F.col("r") < most, F.col("n") * F.col("size") * F.col("z") * F.col("r")))
        sums = joined.groupBy("source").agg(*[F.first(c).alias(c) for c in ("target", "unit", "x", "low", "high")], (got - F.first("target")).alias("off"), F.coalesce(slope, F.lit(0.0)).alias("slope"))
        newton = F.col("x") - F.when(F.col("slope") > 0, F.col("off") / F.col("slope"))
        low = F.when(F.col("off") < 0, F.col("x")).otherwise(F.col("low"))
        high = F.when(F.col("off") > 0, F.col("x")).otherwise(F.col("high"))
        step = F.when((newton > low) & (newton < high), newton).otherwise(F.when(F.abs(high - low) > 1e5, F.when(F.col("off") > 0, F.least(F.col("x") * 2, F.lit(-1.0))).otherwise(F.greatest(F.col("x") * 2, F.lit(1.0)))).otherwise((low + high) / 2))
        done = F.abs("off") <= NEAR * F.greatest("target", F.lit(1.0))
        state = shared_checkpoint(sums.select("source", "target", "unit", F.when(done, F.col("x")).otherwise(step).alias("x"), low.alias("low"), high.alias("high"), done.alias("done")))
        if state.where("NOT done").isEmpty():
            break
    found = state.select(F.col("source").alias("_s"), (F.col("x") / F.col("unit")).alias("multiplier"))
    joined = targets.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return shared_checkpoint(joined.withColumn("multiplier", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("multiplier"))))


def mix_sources(docs: DataFrame, size: Column | None = None, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` plus _size, _source_size, _target, _rate and _copies.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; columns of its own that have
    one of these five names are replaced. ``size``: words of the text by default.
    """
    own = [c for c in docs.columns if c not in ("_size", "_source_size", "_target", "_rate", "_copies")]
    size = word_count("text") if size is None else size
    sized = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs["source"].cast("string").alias("source"), size.alias("_size"))
    counts = shared_checkpoint(sized.groupBy("source", F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    sums = shared_checkpoint(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")))
    joined = join_checked(sized, multipliers(counts, source_targets(sums, most), most), ["source"])
    joined = joined.withColumn("rate", _rate(F.col("_size"), F.col("multiplier"), most))
    groups = F.ceil(F.col("n") / F.lit(GROUP)).cast("long")
    spot = F.xxhash64(F.col("row.doc_id"), F.col("row.text"))
    member = F.struct((-F.col("_size")).alias("k"), spot.alias("h"), F.col("rate"), F.col("row"))
    grouped = joined.groupBy("source", "source_size", "n", "target", F.pmod(spot, groups).alias("g")).agg(F.array_sort(F.collect_list(member), _by_size).alias("m"))

    def tokens(x: Column) -> Column:
        return (-x["k"]).cast("double")

    def place(state: Column, x: Column) -> Column:
        size, less, more = tokens(x), state["less"] - tokens(x) * x["rate"], state["more"] - tokens(x) * (most - x["rate"])
        want = size * x["rate"] + state["left"]
        # what is left over must be within what the smaller documents can still give or take
        enough, few = F.ceil((want - F.greatest(more, F.lit(0.0))) / size - 1e-9), F.floor((want + F.greatest(less, F.lit(0.0))) / size + 1e-9)
        near = F.least(F.greatest(F.floor(want / size + 0.5), enough), F.greatest(few, enough))
        copies = F.when(size > 0, F.least(F.greatest(near, F.lit(0)), F.lit(most))).otherwise(F.lit(1)).cast("int")
        return F.struct((want - copies * size).alias("left"), less.alias("less"), more.alias("more"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    expected = F.aggregate("m", F.lit(0.0), lambda total, x: total + tokens(x) * x["rate"])
    spare = F.aggregate("m", F.lit(0.0), lambda total, x: total + tokens(x) * (most - x["rate"]))

    def tried(shift: Column) -> Column:
        """The group placed with some words ahead or behind at first, and by how much it ends off."""
        start = F.struct(shift.alias("left"), F.col("less"), F.col("more"), F.array().cast("array<int>").alias("copies"))
        return F.aggregate("m", start, place, lambda end: F.struct(F.abs(end["left"] - shift).alias("off"), end["copies"].alias("copies")))

    shifts = F.transform(F.array(*[F.lit(x / (2.0 * TRIES)) for x in range(-TRIES + 1, TRIES)]), lambda x: x * F.col("source_size") / F.col("n"))
    grouped = grouped.withColumns({"less": expected, "more": spare})
    placed = grouped.withColumn("c", F.array_min(F.transform(shifts, tried))["copies"])
    out = placed.select("source_size", "target", F.explode(F.arrays_zip("m", "c")).alias("x"))
    return out.select("x.m.row.*", (-F.col("x.m.k")).alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("x.m.rate").alias("_rate"), F.col("x.c").alias("_copies"))


def _by_size(a: Column, b: Column) -> Column:
    """Large documents first, then by hash and doc_id."""
    key = lambda x: F.struct(x["k"], x["h"], x["row"]["doc_id"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the text only feeds the word count and the order of groups: a hash of it is enough to carry
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("text"), word_count("text").alias("n_words"))
    out = mix_sources(slim, F.col("n_words"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_rate").alias("rate"),
    )
