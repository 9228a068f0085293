"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers. An index block holds ``BLOCK`` vectors; in each dimension
their components are quantised to ``LEVELS`` equal steps, and a posting segment is the
vectors of one level. For a query, segments of all dimensions are processed by
descending quantised impact (the most that one of their components can change a score,
up or down) into accumulators. What is processed counts with its segment's greatest
contribution; what is not yet processed is bounded by Cauchy and Schwarz, from the
energy that the query and the vector have left there. A vector is let go only when that
upper bound is below the k-th best of the exact scores of the likeliest vectors so far;
those left when few are, or all segments are done, are scored exactly. Blocks' answers
are merged by a grouped top-k.

Queries are packed too and meet every index block in blocks, so a row is a pair of
blocks and memory follows the block sizes. Null vectors, and vectors with null or non-finite
components, take no part; a shorter vector counts as padded with zeros. Rows with
equal vec_id are rows of their own, except that a query skips candidates of its own id.
Fewer than k candidates are all returned. A null vec_id takes no part. Empty tables give
no rows; columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_partitions, table

BLOCK = 8192
QUERIES = 64
LEVELS = 128
ROUNDS = 12
#: Exact scoring takes over once it is proven that the best are among this share of a block.
FEW = 1 / 8
SCALE = 1024
K = 10
PACKED = "b long, ids binary, wide boolean, vectors binary"
FOUND = "query_id long, query_row long, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: integer components; rows that take no part are gone."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def pack_rows(size: int):
    """Blocks of ``size`` rows: ids, and a matrix padded with zeros (32 bits wide if that holds it)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["vec_id"].to_numpy(), kind="stable"))
        ids, blobs, wides = [], [], []
        for at in range(0, rows.num_rows, size):
            part = rows.slice(at, size)
            vectors = part["v"].to_pylist()
            matrix = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            wide = bool(len(matrix) and matrix.size and np.abs(matrix).max() >= 1 << 31)
            ids.append(part["vec_id"].to_numpy().astype("<i8").tobytes())
            blobs.append(matrix.astype("<i8" if wide else "<i4").tobytes())
            wides.append(wide)
        return pa.table({"b": pa.array([key[0].as_py()] * len(ids), pa.int64()), "ids": pa.array(ids, pa.binary()), "wide": pa.array(wides, pa.bool_()), "vectors": pa.array(blobs, pa.binary())})

    return run


def unpack(ids: bytes, wide: bool, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(vectors, "<i8" if wide else "<i4").reshape(len(ids), -1).astype(np.int64)


class ImpactIndex:
    """Posting segments of one block of integer vectors, by dimension and level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        dims = vectors.shape[1]
        self.low = vectors.min(axis=0)
        self.step = -(-(vectors.max(axis=0) - self.low + 1) // LEVELS)
        level = (vectors - self.low) // self.step
        cell = (level + np.arange(dims) * LEVELS).T.reshape(-1)
        order = np.argsort(cell, kind="stable")
        self.postings = np.tile(np.arange(len(ids)), dims)[order]
        self.size = np.bincount(cell, minlength=dims * LEVELS)
        self.begin = np.cumsum(self.size) - self.size
        self.filled = self.size.reshape(dims, LEVELS) > 0
        # the components that a segment really holds, from least to most
        sorted_, at = vectors.T.reshape(-1)[order], np.flatnonzero(self.size)
        self.least, self.most = np.zeros((2, dims * LEVELS), np.int64)
        if len(at):
            self.least[at], self.most[at] = np.minimum.reduceat(sorted_, self.begin[at]), np.maximum.reduceat(sorted_, self.begin[at])
        self.least, self.most = self.least.reshape(dims, LEVELS), self.most.reshape(dims, LEVELS)
        near = np.where((self.least < 0) & (self.most > 0), 0, np.minimum(np.abs(self.least), np.abs(self.most)))
        self.energy = near.astype(float) ** 2
        self.norms = np.einsum("ij,ij->i", vectors, vectors, dtype=float)
        self.read = self.rescored = 0

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k of the block, ties to the smaller id."""
        dims = min(len(query), self.vectors.shape[1])
        q = query[:dims].astype(float)[:, None]
        live = np.flatnonzero(self.ids != own)
        a, b = q * self.least[:dims], q * self.most[:dims]
        impact = np.where(self.filled[:dims], np.maximum(np.abs(a), np.abs(b)), 0).reshape(-1)
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        gain, weight, energy = np.maximum(a, b).reshape(-1), np.repeat(q[:, 0] ** 2, LEVELS), self.energy[:dims].reshape(-1)
        norms = self.norms if dims == self.vectors.shape[1] else (self.vectors[:, :dims].astype(float) ** 2).sum(axis=1)
        whole = float((q**2).sum())
        slack = 1 + 1e-9 * np.sqrt(whole * norms.max(initial=0))
        seen, query_left, own_left = np.zeros(len(self.ids)), np.full(len(self.ids), whole), norms.copy()
        scores = np.full(len(self.ids), np.iinfo(np.int64).min)
        ends = np.searchsorted(np.cumsum(self.size[order]), np.linspace(0, self.size[order].sum(), ROUNDS + 1)[1:], side="left") + 1
        at = 0
        for end in ends:
            if len(live) <= max(4 * k, FEW * len(self.ids)) or at >= len(order):
                break
            cells, at = order[at:end], end
            size = self.size[cells]
            rows = self.postings[np.repeat(self.begin[cells] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            self.read += len(rows)
            n = len(self.ids)
            seen += np.bincount(rows, np.repeat(gain[cells], size), n)
            query_left -= np.bincount(rows, np.repeat(weight[cells], size), n)
            own_left -= np.bincount(rows, np.repeat(energy[cells], size), n)
            # the bar: exact scores of the likeliest ones so far
            fresh = live[np.argpartition(seen[live], len(live) - 2 * k)[len(live) - 2 * k :]]
            fresh = fresh[scores[fresh] == np.iinfo(np.int64).min]
            scores[fresh] = self.vectors[fresh, :dims] @ query[:dims]
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            rest = np.sqrt(np.maximum(query_left[live], 0) * np.maximum(own_left[live], 0))
            live = live[seen[live] + rest + slack >= bar]
        self.rescored += len(live)
        scores = self.vectors[live, :dims] @ query[:dims]
        top = np.lexsort([self.ids[live], -scores])[:k]
        return self.ids[live][top], scores[top]


def search_blocks(k: int):
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                if kept[0] != row["ids"]:
                    kept = (row["ids"], ImpactIndex(*unpack(row["ids"], row["wide"], row["vectors"])))
                out = []
                for i, (own, query) in enumerate(zip(*unpack(row["q_ids"], row["q_wide"], row["q_vectors"]), strict=True)):
                    ids, scores = kept[1].search(query, own, k)
                    out.append((np.full(len(ids), own), np.full(len(ids), ((row["q_block"] & ((1 << 40) - 1)) << 20) + i), ids, scores))
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=names)

    return run


def _packed(vectors: DataFrame, size: int, blocks: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    return vectors.withColumn("b", bucket).groupBy("b").applyInArrow(pack_rows(size), PACKED)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id, embedding."""
    spark = candidates.sparkSession
    index, asked = whole_vectors(candidates), whole_vectors(queries)
    n, m = index.count(), asked.count()
    blocks = max(1, -(-n // BLOCK), min(shuffle_partitions(spark), n // 256))
    index = _packed(index, BLOCK, blocks)
    asked = shared_checkpoint(_packed(asked, QUERIES, max(1, -(-m // QUERIES))))
    asked = asked.select(F.xxhash64("ids", "vectors").alias("q_block"), F.col("ids").alias("q_ids"), F.col("wide").alias("q_wide"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    pairs = index.hint("shuffle_merge").join(asked, "b").select("ids", "wide", "vectors", "q_block", "q_ids", "q_wide", "q_vectors")
    found = pairs.mapInArrow(search_blocks(k), FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))
