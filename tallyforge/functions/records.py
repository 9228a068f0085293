"""Functions over maps, arrays, JSON and whole record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_numbers(df: DataFrame, id_col: str, prefix: str = "") -> DataFrame:
    """id, metric (dotted path), value for every numeric leaf of nested struct columns."""
    leaves: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, c: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, c[f.name])
        elif isinstance(kind, T.NumericType):
            leaves.append((path, c.cast("double")))

    for f in df.schema.fields:
        if f.name != id_col:
            walk(f.dataType, prefix + f.name, F.col(f.name))
    pairs = F.array(*[F.struct(F.lit(p).alias("metric"), c.alias("value")) for p, c in leaves])
    return df.select(id_col, F.explode(pairs).alias("x")).select(id_col, "x.metric", "x.value").where("value IS NOT NULL")


def canonical_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys; nulls are kept, so hashes do not depend on them silently."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def tree_hash(df: DataFrame, by: Sequence[str], path: str, content: Column) -> DataFrame:
    """One digest per group over its (path, content hash) rows in path order.

    Contents are hashed row by row before they meet, so a group gathers 64 characters a row.
    """
    leaf = F.struct(F.col(path).cast("string").alias("p"), F.sha2(content, 256).alias("h"))
    ordered = F.array_sort(F.collect_list(leaf))
    line = F.transform(ordered, lambda x: F.concat(x["p"], F.lit(":"), x["h"]))
    return df.groupBy(*by).agg(F.sha2(F.array_join(line, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("files"))


#: Key names whose values are never shown.
SENSITIVE = "(?i)(pass(word|wd)?|secret|token|api_?key|credential|private_?key|authorization)"


def redact(df: DataFrame) -> DataFrame:
    """Values under sensitive names become ``<redacted>``, at any depth of structs, arrays and maps."""

    def walk(kind: T.DataType, c: Column, name: str) -> Column:
        import re

        if re.search(SENSITIVE, name) and not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(c.isNotNull(), F.lit("<redacted>")).cast("string")
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(f.dataType, c[f.name], f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(kind.elementType, x, name))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("<redacted>")).otherwise(v))
        return c

    return df.select(*[walk(f.dataType, F.col(f.name), f.name).alias(f.name) for f in df.schema.fields])


def grounded(refs: Column, facts: Column) -> Column:
    """Whether every reference is among the facts."""
    return F.coalesce(F.size(F.array_except(refs, facts)) == 0, F.lit(False))


def merge_maps(a: Column, b: Column) -> Column:
    """Union of two maps; the second wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)


def ordered_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, items (the values of a key's rows in order) and n. A key's rows become one value: keep keys fine."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_v"]).alias("items"), F.count(F.lit(1)).alias("n"))
