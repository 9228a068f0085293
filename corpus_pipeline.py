"""A training corpus from ``documents``: identify, deduplicate, redact, mix, pack.

Each stage works on all that its predecessor kept. All but the last return the columns
of ``documents``. ``run`` writes every stage's result as Parquet into the folder that
``spark.checkpoint.dir`` names (the warehouse where it is unset) and reads it again, so
a lost executor costs at most the stage that runs. A stage's files go when its successor
has written its own; the last stage's stay, as the result reads them.

Null and empty texts have no language and go in the first stage. Null languages, sources
and ids are kept: a null source is a source, rows of a null id are told apart by their
text. Rows that repeat are near duplicates, of which one stays; ties go to the smallest
doc_id. Texts of any length pass whole. An empty table gives no rows at every stage.
Extra columns of ``documents`` pass through, whatever their names, up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.llm.language_id import document_evidence, identify
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.near_dedup import near_duplicates
from tallyforge.llm.packing import pack
from tallyforge.llm.pii import redact


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 8)."""
    others = [c for c in docs.columns if c != "text"]
    out = identify(document_evidence(docs, F.struct(*others)), keep_text=True).where("kept")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id (operator 5)."""
    key = lambda text: F.xxhash64(F.col("doc_id").cast("long"), text)
    stays = near_duplicates(docs).where("stays").select(key(F.col("h")).alias("__stays")).distinct()
    keyed = docs.withColumn("__stays", key(F.xxhash64(F.col("text").cast("string"))))
    return keyed.join(stays, "__stays", "left_semi").dropDuplicates(["__stays"]).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets (operator 2)."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the sources' target weights ask for (operator 9)."""
    mixed = mix_sources(docs).where("_copies > 0")
    return mixed.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in fixed-length sequences (operator 3)."""
    return pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_distinct),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Fitted models, sampling and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{where.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
