"""Readers of exports, artifacts, traces and trees. Bad rows fail the read, never vanish."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clex
from ..functions import text as X
from . import schemas as S


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str, recursive: bool = False) -> DataFrame:
    """Multi-line JSON documents under a declared schema; malformed input raises."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.option("recursiveFileLookup", recursive).json(path)


def versioned(df: DataFrame, supported: Sequence[int], rows: str) -> DataFrame:
    """Rows of an envelope whose schema_version is supported; any other version raises."""
    allowed = F.array(*[F.lit(v) for v in supported])
    ok = F.array_contains(allowed, F.coalesce(F.col("schema_version"), F.lit(1)))
    message = F.concat(F.lit("unsupported schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))
    kept = F.when(ok, F.col(rows)).otherwise(F.raise_error(message).cast(df.schema[rows].dataType))
    return df.select("schema_version", F.explode(kept).alias("row")).select("schema_version", "row.*")


def functions(spark: SparkSession, path: str) -> DataFrame:
    """The canonical function table of decompiler exports, in (ordinal, address) order per binary."""
    raw = read_json(spark, path, S.EXPORT)
    f = raw.select("binary", "image_base", "pointer_size_bytes", F.explode("functions").alias("f")).select("binary", "image_base", "pointer_size_bytes", "f.*")
    base = F.coalesce(X.address_number(F.col("image_base")), F.lit(0))
    return f.withColumns({
        "address": X.address(F.col("address")),
        "relative_address": (X.address_number(F.col("address")) - base).cast("long"),
        "name": F.coalesce(X.missing(F.col("name")), F.concat(F.lit("FUN_"), F.substring(X.address(F.col("address")), 3, 16))),
        "is_thunk": F.coalesce("is_thunk", F.lit(False)),
        "line_count": F.coalesce("line_count", F.lit(0)),
        "ordinal": F.coalesce("ordinal", F.lit(1_000_000)),
    })


def with_symbols(functions_: DataFrame, symbols: DataFrame) -> DataFrame:
    """Left join of a symbol side-car (address, symbol) on normalised addresses."""
    s = symbols.select(X.address(F.col("address")).alias("address"), F.col("symbol").alias("_symbol")).dropDuplicates(["address"])
    out = functions_.join(s, "address", "left")
    return out.withColumn("source_symbol", F.coalesce(X.missing(F.col("source_symbol")), "_symbol")).drop("_symbol")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return versioned(read_json(spark, path, f"schema_version int, candidates array<struct<{S.CANDIDATE.replace(', ', ',').replace(' ', ':')}>>"), [2], "candidates")


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Proof results; a status outside the domain counts as inconclusive, so it can prove nothing."""
    p = versioned(read_json(spark, path, f"schema_version int, results array<struct<{S.PROOF.replace(', ', ',').replace(' ', ':')}>>"), [2], "results")
    return p.withColumn("status", F.when(F.col("status").isin(*S.STATUSES), F.col("status")).otherwise("inconclusive"))


def replays(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.REPLAY, recursive=True)


def schedules(spark: SparkSession, path: str) -> DataFrame:
    """Version 1 schedules have no variants; they read as ''."""
    rows = versioned(read_json(spark, path, S.SCHEDULE), [1, 2], "attempts")
    return rows.withColumn("variant_id", F.when(F.col("schema_version") >= 2, F.coalesce("variant_id", F.lit(""))).otherwise(""))


def lanes(spark: SparkSession, path: str) -> DataFrame:
    """Corpus lanes, with ``fault`` where a group does not hold one vulnerable and one fixed lane."""
    rows = versioned(read_json(spark, path, S.LANES), [2], "lanes")
    pair = Window.partitionBy("comparison_group")
    one = (F.count_if(F.col("role") == "vulnerable").over(pair) == 1) & (F.count_if(F.col("role") == "fixed").over(pair) == 1)
    bad = F.when(~F.col("role").isin("vulnerable", "fixed"), "unknown_role").when(F.count(F.lit(1)).over(Window.partitionBy("lane_id")) > 1, "duplicate_lane").when(~one, "unpaired_group")
    return rows.withColumn("fault", bad)


def operation_specs(spark: SparkSession, path: str) -> DataFrame:
    """alias, name and semantics: one row per accepted spelling."""
    rows = versioned(read_json(spark, path, S.SPEC), [12], "operations")
    spelled = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return rows.select(spelled.alias("_a"), "name", "backend", "semantics", "effect_kind").select(X.operation_name(F.col("_a")).alias("alias"), "name", "backend", "semantics", "effect_kind").distinct()


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """binary, function, kind: long form."""
    raw = read_json(spark, path, S.TRUTH)
    part = lambda c, k: raw.select("binary", F.explode(c).alias("function"), F.lit(k).alias("kind"))
    return part("positives", "positive").unionByName(part("negatives", "negative")).unionByName(part("ignored", "ignored")).distinct()


def flaw_manifest(spark: SparkSession, path: str, cwe: str | None = None) -> DataFrame:
    """file, line, name of flaws in a test-case manifest (XML)."""
    raw = spark.read.format("xml").option("rowTag", "testcase").schema("file array<struct<_path:string,flaw:array<struct<_line:int,_name:string>>>>").load(path)
    f = raw.select(F.explode("file").alias("f")).select(F.col("f._path").alias("file"), F.explode("f.flaw").alias("x"))
    out = f.select("file", F.col("x._line").alias("line"), F.col("x._name").alias("name"))
    return out.where(F.col("name").startswith(cwe)) if cwe else out


def trace_hits(spark: SparkSession, path: str) -> DataFrame:
    """trace, offset (of the line's first byte), operation_address from JSON-lines traces.

    One file is one ordered stream: its lengths are summed per file, files in parallel.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("trace"), "value")
    line = raw.select("trace", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = Window.partitionBy("trace").orderBy("n")
    at = line.withColumn("offset", F.sum(F.octet_length("line") + 1).over(w) - F.octet_length("line") - 1)
    got = F.from_json("line", "operation_address string, event string")
    return at.where(F.trim("line") != "").select("trace", F.col("offset").cast("long").alias("offset"), X.address(got["operation_address"]).alias("operation_address"), got["event"].alias("event"))


def verbose_methods(df: DataFrame, id_col: str, output: str) -> DataFrame:
    """object, method, field, type rows of a line-oriented method listing; a malformed line raises."""
    line = df.select(id_col, F.posexplode(F.split(output, "\n")).alias("n", "line")).where(F.trim("line") != "")
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    object_ = F.regexp_extract("line", r"^'([^']+)'", 1)
    line = line.withColumn("object", F.last(F.when(object_ != "", object_), ignorenulls=True).over(w))
    method = F.regexp_extract("line", r'^\s+"([^"]+)"\s*:\s*\{', 1)
    bad = (object_ == "") & (method == "")
    line = line.withColumn("method", F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), "line")).cast("string")).otherwise(method)).where("method <> ''")
    fields = F.regexp_extract_all("line", F.lit(r'"([^"]+)"\s*:\s*"[^"]+"'), F.lit(1))
    types = F.regexp_extract_all("line", F.lit(r'"[^"]+"\s*:\s*"([^"]+)"'), F.lit(1))
    pair = F.explode_outer(F.arrays_zip(fields.alias("field"), types.alias("type")))
    return line.select(id_col, "object", "method", pair.alias("x")).select(id_col, "object", "method", "x.field", "x.type")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and architecture of the files of a tree, from their bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 20))
    machine = F.conv(F.when(F.substring(head, 11, 2) == "02", F.substring(head, 37, 4)).otherwise(F.concat(F.substring(head, 39, 2), F.substring(head, 37, 2))), 16, 10).cast("int")
    arch = F.when(machine == 62, "x86_64").when(machine == 3, "x86").when(machine == 40, "arm").when(machine == 183, "aarch64").when(machine == 8, "mips").when(machine == 243, "riscv").otherwise("unknown")
    elf = head.startswith("7F454C46")
    bits = F.when(elf, F.when(F.substring(head, 9, 2) == "02", 64).otherwise(32))
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), elf.alias("is_elf"), F.when(elf, arch).alias("arch"), bits.alias("bits"))


def binary_strings(files: DataFrame, least: int = 4) -> DataFrame:
    """path, position, value: distinct printable runs of file contents, in order of occurrence."""
    import re

    pattern = re.compile(rb"[\x20-\x7e]{%d,}" % least)

    @F.pandas_udf("array<string>")
    def runs(content: pd.Series) -> pd.Series:
        return content.map(lambda b: list(dict.fromkeys(x.decode("ascii") for x in pattern.findall(b or b""))))

    return files.select("path", F.posexplode(runs("content")).alias("position", "value"))


#: Places of service definitions, and shapes of configuration names.
SERVICE_PATHS = r"/(etc/init\.d|etc/rc\.d|etc/systemd/system|lib/systemd/system|etc/xinetd\.d)/|inetd\.conf$"
CONFIG_KINDS = {"env": r"\.env$", "ini": r"\.(ini|cfg)$", "conf": r"\.conf$", "json": r"\.json$", "yaml": r"\.ya?ml$", "xml": r"\.xml$"}


def service_inventory(files: DataFrame) -> DataFrame:
    """path, commands and ports of service definitions. ``files``: path, text."""
    command = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:ExecStart=|exec\s+|server\s*=\s*)(\S+)"), F.lit(1))
    ports = F.regexp_extract_all("text", F.lit(r"(?i)(?:port\s*=?\s*|ListenStream=|:)(\d{2,5})\b"), F.lit(1))
    return files.where(F.col("path").rlike(SERVICE_PATHS)).select("path", F.array_distinct(command).alias("commands"), F.array_sort(F.array_distinct(F.transform(ports, lambda p: p.cast("int")))).alias("ports"))


def config_inventory(files: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(CONFIG_KINDS.items()):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:export\s+)?([A-Z][A-Z0-9_]{2,})="), F.lit(1))))
    return files.select("path", kind.alias("kind"), keys.alias("env_keys")).where("kind IS NOT NULL")


def route_inventory(files: DataFrame) -> DataFrame:
    """path, route: distinct quoted absolute paths in text files."""
    found = F.regexp_extract_all("text", F.lit(r"[\"'](/[A-Za-z0-9_./-]{2,})[\"']"), F.lit(1))
    return files.select("path", F.explode(F.array_distinct(found)).alias("route"))


def _within(df: DataFrame) -> list[str]:
    """Edges stay inside a binary where the tables name it."""
    return ["binary"] if "binary" in df.columns else []


def _known(calls: DataFrame, names: DataFrame) -> DataFrame:
    own = [c for c in _within(calls) if c in names.columns]
    return calls.join(names.select(*own, F.col("name").alias("dst")).distinct(), [*own, "dst"], "left_semi").select(*_within(calls), "src", "dst")


def text_call_edges(sources: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst: call tokens in function texts that are known names, of the same binary where given.

    ``sources``: name, text. Comments and the contents of strings are no calls; a
    function that calls itself has an edge to itself.
    """
    plain = clex.mask_strings_udf(F.col("text"))
    token = F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))
    # a text's own signature is no call: its name counts only where it occurs again
    again = F.regexp_count(plain, F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\s*\(")))
    calls = sources.select(*_within(sources), F.col("name").alias("src"), token.alias("dst"), again.alias("_own"))
    return _known(calls.where("src <> dst OR _own > 1").drop("_own"), names)


def thread_edges(sources: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst: third arguments of thread creation that are known names."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"pthread_create\s*\([^,]*,[^,]*,\s*(?:\([^)]*\)\s*)?&?\s*([A-Za-z_]\w*)"), F.lit(1))))
    return _known(sources.select(*_within(sources), F.col("name").alias("src"), target.alias("dst")), names)


def pcode_edges(functions_: DataFrame) -> DataFrame:
    calls = functions_.select(*_within(functions_), F.col("name").alias("src"), F.explode("pcode_calls").alias("c")).select(*_within(functions_), "src", F.col("c.callee").alias("dst")).distinct()
    return _known(calls, functions_)


def cached_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from an adjacency map in JSON."""
    raw = read_json(spark, path, "edges map<string,array<string>>")
    return raw.select(F.explode("edges").alias("src", "d")).select("src", F.explode("d").alias("dst")).distinct()


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
