"""Sinks: tables, envelopes, append logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def write_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """Parquet; with ``key``, repeated ids fail the write before anything is written."""
    if key is not None:
        twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{key} is not unique: {twice[0][key]!r}")
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, keys in sorted order, nulls kept."""
    ordered = df.select(*sorted(df.columns))
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_envelope(df: DataFrame, path: str, name: str, version: int, order: str) -> None:
    """The versioned single-document form, for consumers that need one; rows sorted by ``order``.

    A single document is a single task by nature: use ``write_table`` for large results.
    """
    body = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*sorted(df.columns)).alias("row")))).alias("rows"))
    out = body.select(F.lit(version).alias("schema_version"), F.transform("rows", lambda x: x["row"]).alias(name))
    out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str, *parts: str) -> None:
    """Appends records under a stable id of the named columns."""
    df.withColumn("record_id", X.stable_id(*[F.col(p) for p in parts])).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One folder per key value."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A report table of at most ``rows`` rows, for reading; results go to tables."""
    names = df.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in df.limit(rows).collect():
        lines.append("| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |")
    return "\n".join(lines) + "\n"
