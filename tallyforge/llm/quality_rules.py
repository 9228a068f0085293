"""Quality rules: fixed base rules, and robust multivariate outliers by language and source.

Counts come from one vectorised pass over the texts; the rest works on a narrow table.
The statistic vector of a document that passes the base rules is, in logs: characters
per word, and percentages of symbols, repeated lines and repeated words. Each group
gets a minimum-covariance-determinant estimate by distributed concentration steps from
a median start: the ``SHARE`` of rows nearest by the present estimate (a grouped
quantile) give the next mean and covariance (grouped sums), until no group's determinant
still falls by more than ``SETTLED`` of itself. A hot group costs no more
than its rows: only sums and quantile sketches leave a task. Rows whose Mahalanobis
distance exceeds the chi-square quantile are rejected.

``FLOOR`` is the least standard deviation, so statistics that are zero in most of a
group do not make every other value an outlier. Groups under ``LEAST`` rows pool by
language, then together; a pool that stays under it rejects by the base rules alone
(``pool`` names the pool that judged a row). Null text has no words, and so fails. Null
languages and sources are groups. Rows that repeat count and are judged each; equal
distances get equal verdicts. Texts of any length count whole. An empty table gives no
rows; columns beside doc_id, lang, source and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _WS, U64, Rolling, join_checked, mix, range_hashes, shared_checkpoint, slices, table, text_buffer, window_starts, word_bounds

DIMS = 4
SHARE = 0.75
#: SHARE / P(chi2 with 6 df <= the chi2 quantile with 4 df at SHARE): undoes the trimming.
CONSISTENCY = 1.487
#: Chi-square quantile with 4 degrees of freedom at 1 - 1e-6.
CUTOFF = 33.38
FLOOR = (0.08, 0.6, 0.6, 0.6)
#: Concentration steps at most, and the change of the log determinant that ends them.
STEPS = 15
SETTLED = 0.01
LEAST = 40
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """64-bit hashes told apart by row: scrambled, so that rows of a slice don't meet."""
    return mix(hashes ^ mix(row.astype(U64) + U64(1)))


def _repeats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """All five counts of each row of one slice."""
    rows = len(offsets) - 1
    table_ = np.zeros(256, bool)
    table_[list(SYMBOLS)] = True
    solid = ~_WS[data]
    chars, symbols = _by_row(solid & ((data & 0xC0) != 0x80), offsets), _by_row(table_[data], offsets)
    starts, ends, before = word_bounds(data, offsets)
    # lines: between newlines and the rows' bounds
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    here = np.searchsorted(line_start, breaks, side="right") - 1
    line_end = np.append(line_start[1:], len(data))
    line_end[here] = breaks
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    worded &= line_row < rows
    line_row = line_row[worded]
    keys = _in_row(range_hashes(data, line_start[worded], line_end[worded]), line_row)
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    dup_lines = np.bincount(line_row[again], minlength=rows)
    # five-word windows
    at = window_starts(before, WINDOW)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        row = np.repeat(np.arange(rows), np.maximum(np.diff(before) - WINDOW + 1, 0))
        keys = _in_row(Rolling(range_hashes(data, starts, ends)).ranges(at, at + WINDOW), row)
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = at[twice[spot] == keys]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
    repeat = _by_row(np.cumsum(covered)[:-1] > 0, before)
    return np.diff(before), chars, symbols, dup_lines, repeat


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        for a, b in slices(offsets):
            for at in range(a, b, 60_000):
                to = min(at + 60_000, b)
                part = batch.slice(at, to - at)
                counts = _repeats(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                yield pa.record_batch([part["doc_id"], part["lang"], part["source"], *[pa.array(x, pa.int64()) for x in counts]], names=names)


def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverse of each group's covariance, whose standard deviations are at least FLOOR."""
    for batch in batches:
        out, size = [], []
        for cov in batch["cov"].to_pylist():
            m = np.array(cov).reshape(DIMS, DIMS) * CONSISTENCY
            low = np.maximum(np.array(FLOOR) ** 2 - np.diag(m), 0)
            out.append(np.linalg.inv(m + np.diag(low + 1e-12)).reshape(-1).tolist())
            size.append(np.linalg.slogdet(m + np.diag(low + 1e-12))[1])
        yield pa.record_batch({"g": batch["g"], "mean": batch["mean"], "inverse": pa.array(out, pa.list_(pa.float64())), "spread": pa.array(size, pa.float64())})


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _distance() -> Column:
    off = [_x(i) - F.get("mean", F.lit(i)) for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(DIMS):
            total = total + off[i] * off[j] * F.get("inverse", F.lit(i * DIMS + j))
    return total


def _moments(rows: DataFrame) -> DataFrame:
    """g, mean and covariance from sums over centred values."""
    sums = [F.avg(_x(i)).alias(f"m{i}") for i in range(DIMS)] + [F.covar_pop(_x(i), _x(j)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    pair = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    return rows.groupBy("g").agg(*sums).select("g", F.array(*[F.col(f"m{i}") for i in range(DIMS)]).alias("mean"), F.array(*[pair(i, j) for i in range(DIMS) for j in range(DIMS)]).alias("cov"))


def fit(rows: DataFrame) -> DataFrame:
    """g, mean, inverse for each group in ``rows`` (columns g, x0 .. x3)."""
    shape = "g string, mean array<double>, inverse array<double>, spread double"
    quarter = rows.groupBy("g").agg(*[F.percentile_approx(_x(i), [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(DIMS)])
    spread = [((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349) ** 2 for i in range(DIMS)]
    start = quarter.select("g", F.array(*[F.get(f"q{i}", F.lit(1)) for i in range(DIMS)]).alias("mean"), F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]).alias("cov"))
    now = shared_checkpoint(start.mapInArrow(invert, shape))
    for _ in range(STEPS):
        before = now
        near = join_checked(rows, now, ["g"]).withColumn("d", _distance()).select("g", "d", *[f"x{i}" for i in range(DIMS)])
        cut = shared_checkpoint(near.groupBy("g").agg(F.percentile_approx("d", SHARE, 10_000).alias("cut")))
        now = shared_checkpoint(_moments(join_checked(near, cut, ["g"]).where("d <= cut")).mapInArrow(invert, shape))
        fallen = before.select("g", F.col("spread").alias("was")).join(now, "g").where(F.col("was") - F.col("spread") > SETTLED)
        if fallen.isEmpty():
            break
    return now.select("g", "mean", "inverse")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base verdict, distance and verdict."""
    cast = [F.col(c).cast(k).alias(c) for c, k in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))]
    counts = shared_checkpoint(docs.select(*cast).mapInArrow(count_rows, COUNTS).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.col(b))
    vector = [F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols", "word_chars"), share("n_dup_lines", "n_words"), share("n_repeat_words", "n_words")]
    groups = counts.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    name = F.to_json(F.struct("lang", "source"))
    small = groups.where(F.col("n") < LEAST).groupBy("lang").agg(F.sum("n").alias("pool"))
    pooled = groups.join(small.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    wide = F.when(F.col("pool") >= LEAST, F.to_json(F.struct("lang", F.lit(True).alias("pool")))).otherwise(F.lit("{}"))
    keyed = shared_checkpoint(pooled.select("lang", "source", F.when(F.col("n") >= LEAST, name).otherwise(wide).alias("g"), "n"))
    rows = join_checked(counts, keyed.select("lang", "source", "g"), ["lang", "source"])
    rows = rows.withColumns({f"x{i}": F.when(~F.col("base_failed"), v) for i, v in enumerate(vector)})
    enough = keyed.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("g")
    passed = rows.where("NOT base_failed").select("g", *[f"x{i}" for i in range(DIMS)])
    fitted = fit(join_checked(passed, enough.withColumn("ok", F.lit(True)), ["g"]).where("ok").drop("ok"))
    out = join_checked(rows, fitted, ["g"]).withColumn("pool", F.when(F.col("mean").isNotNull(), F.col("g"))).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "pool")
