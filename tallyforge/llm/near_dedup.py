"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five words (a shorter text is one shingle); its weight is
(1 + ln tf) * (1 + log10(N / df) / 2). The damped idf keeps weight on the shingles that a
large group of copies shares. Document frequencies of all documents are kept in
2**18 hashed cells, a table of fixed size, so a rare shingle's df is its cell's load
and common ones stand out at every size of corpus.

1. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples; the gamma
   and uniform variates come from a fixed pool by a hash of shingle and sample.
2. Equal word sequences become one node before anything is compared. Nodes meet in
   band buckets; each is compared with its bucket's first node (a star, no pairs).
3. Buckets of three or more whose nodes are then in different components are compared
   exhaustively across components, in blocks of ``BLOCK`` nodes, and give a spanning
   set of links.
A link is a weighted Jaccard similarity of ``SIMILARITY`` or more of whole texts. A class is a connected component; its id is its smallest doc_id.

Texts without words form one class. Null text counts as empty. Rows that repeat, and
null doc_ids, are rows of their content's node; a class of null ids only has a null id.
Texts of any length are compared whole; an empty table gives no rows. Of a class, the row
of the smallest doc_id stays (ties: of the smallest hash of the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, mix, row_hashes, shared_checkpoint, slices, table, text_buffer, window_starts, word_hashes, worker_cache

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
CELL_BITS = 18
SEGMENTS = 64
BLOCK = 1500
SEED = 5
LOW48 = (1 << 48) - 1
SIGNED = "doc_id long, h long, c long, bands array<long>"


def shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row: keys (row << 48 | hash), counts, first key of each row, content hashes."""
    words, before = word_hashes(column)
    rolling = Rolling(words)
    n = np.diff(before)
    starts = window_starts(before, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h = np.concatenate([rolling.ranges(starts, starts + SHINGLE), rolling.ranges(before[short], before[short + 1])])
    row = np.concatenate([np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0)), short]).astype(U64)
    keys = np.sort((row << U64(48)) | (h & U64(LOW48)))
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    content = row_hashes(words, before)
    return keys, counts, np.searchsorted(keys, np.arange(len(n) + 1, dtype=U64) << U64(48)), content


def _cell(keys: np.ndarray) -> np.ndarray:
    return ((keys & U64(LOW48)) >> U64(48 - CELL_BITS)).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a, b in slices(text_buffer(batch["text"])[1]):
        for at in range(a, b, 60_000):
            yield batch.slice(at, min(60_000, b - at))


def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("near_dedup")
    total, rows = np.zeros(1 << CELL_BITS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for part in _parts(batch):
            total += np.bincount(_cell(shingles(part["text"])[0]), minlength=1 << CELL_BITS)
    if rows:
        yield pa.record_batch({"segment": pa.array(range(SEGMENTS), pa.int32()), "rows": pa.array([rows] * SEGMENTS, pa.int64()), "counts": pa.array([x.astype("<i8").tobytes() for x in np.split(total, SEGMENTS)], pa.binary())})


def add_cells(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    total = np.zeros((1 << CELL_BITS) // SEGMENTS, np.int64)
    for x in parts["counts"]:
        total += np.frombuffer(x.as_py(), "<i8")
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sum(parts["rows"].to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """1 + log10(N / df) / 2 of each hashed cell: 2**18 numbers, whatever the input."""
    found = docs.select("text").mapInArrow(count_cells, "segment int, rows long, counts binary").groupBy("segment").applyInArrow(add_cells, "segment int, rows long, counts binary").collect()
    df = np.zeros(((1 << CELL_BITS) // SEGMENTS) * SEGMENTS, np.int64).reshape(SEGMENTS, -1)
    for r in found:
        df[r.segment] = np.frombuffer(r["counts"], "<i8")
    n = max((r.rows for r in found), default=0)
    return (1 + np.log10(np.maximum((n + 1) / (df.reshape(-1) + 1), 1)) / 2).astype(np.float32)


def weights(keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[_cell(keys)]


def _pool() -> dict:
    """Variates of the sampler, and for each weight level the packed (ln a, t) of each."""
    kept = worker_cache("near_dedup")
    if "r" not in kept:
        rng = np.random.default_rng(SEED)
        kept |= {"r": rng.gamma(2, 1, 1 << 16), "c": np.log(rng.gamma(2, 1, 1 << 16)), "b": rng.random(1 << 16), "levels": {}}
    return kept


def _drawn(level: int) -> np.ndarray:
    pool = _pool()
    if level not in pool["levels"]:
        t = np.floor(level / 10 / pool["r"] + pool["b"])
        y = pool["r"] * (t - pool["b"])
        raw = (pool["c"] - y - pool["r"]).astype(np.float32).view(np.uint32)
        raw = np.where(raw >> 31, ~raw, raw | np.uint32(1 << 31)).astype(U64)
        pool["levels"][level] = (raw << U64(32)) | (mix(t.astype(np.int64).astype(U64)) & U64(0xFFFFFFFF))
    return pool["levels"][level]


def signatures(keys: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band hashes, one row per non-empty document. Weights are rounded to tenths of their log."""
    level = np.rint(10 * np.log(w)).astype(np.int64)
    top = int(level.max(initial=0))
    packed = np.concatenate([_drawn(x) for x in range(top + 1)])
    base, h = level << 16, mix(keys & U64(LOW48))
    starts = first[:-1][first[:-1] < first[1:]]
    out = np.empty((len(starts), BANDS), U64)
    for band in range(BANDS):
        acc = np.full(len(starts), mix(np.array([band + 1], U64))[0])
        for row in range(ROWS):
            x = (h ^ U64(0x9E3779B97F4A7C15 * (band * ROWS + row + 1) % (1 << 64))) * U64(0xD6E8FEB86659FD93)
            best = np.minimum.reduceat(packed[base + (x >> U64(48)).astype(np.int64)] ^ ((x >> U64(16)) & U64(0xFFFFFFFF)), starts)
            acc = mix(acc ^ (best & U64(0xFFFFFFFF))) * U64(3)
        out[:, band] = acc
    return out


def sign(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                keys, counts, first, content = shingles(part["text"])
                sizes = np.where(first[1:] > first[:-1], BANDS, 0)
                bands = signatures(keys, weights(keys, counts, idf.value), first) if len(keys) else np.zeros((0, BANDS), U64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.record_batch({"doc_id": part["doc_id"], "h": part["h"], "c": pa.array(content.view(np.int64)), "bands": lists})

    return run


def similar(left, right, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (ka, na, *_), (kb, nb, *_) = shingles(left), shingles(right)
    wa, wb = weights(ka, na, idf), weights(kb, nb, idf)
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    both = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    rows = len(left)
    add = lambda keys, w: np.bincount((keys >> U64(48)).astype(np.int64), w, rows)
    least = add(ka[both], np.minimum(wa[both], wb[at[both]]))
    return least / np.maximum(add(ka, wa) + add(kb, wb) - least, 1e-9)


def verify(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ok = pa.array(similar(part["left"], part["right"], idf.value) >= least - 1e-12)
                yield pa.record_batch({"u": part["a"].filter(ok), "v": part["c"].filter(ok)})

    return run


def link_block(idf, least: float):
    """Links of a block of a bucket, across the components that its nodes are in."""

    def run(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        nodes = nodes.combine_chunks()
        c = nodes["c"].to_numpy()
        comp = np.unique(nodes["comp"].to_numpy(), return_inverse=True)[1]
        keys, counts, first, _ = shingles(nodes["text"])
        w = weights(keys, counts, idf.value)
        row, h = (keys >> U64(48)).astype(np.int64), keys & U64(LOW48)
        order = np.argsort(h, kind="stable")
        post_row, post_w, post_h = row[order], w[order], h[order]
        sums = np.bincount(row, w, len(c))
        begin, end = np.searchsorted(post_h, h, "left"), np.searchsorted(post_h, h, "right")
        parent = comp.copy()  # of each node's component, by its current root
        links, largest = [], np.bincount(comp).argmax()
        for x in np.flatnonzero(comp != largest):
            mine = slice(first[x], first[x + 1])
            size = end[mine] - begin[mine]
            if not size.sum():
                continue
            at = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            small = np.bincount(post_row[at], np.minimum(np.repeat(w[mine], size), post_w[at]), len(c))
            best = small / (sums + sums[x] - small)
            for y in np.flatnonzero((best >= least - 1e-12) & (parent != parent[x])):
                if parent[y] != parent[x]:
                    links.append((c[x], c[y]))
                    parent[parent == parent[y]] = parent[x]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """c, comp (smallest node) for every node with a link: alternating large and small stars."""
    edges = shared_checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        large = shared_checkpoint(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = shared_checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).unionByName(edges.select("v", "v").toDF("c", "comp").distinct())
        state = now


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, h (hash of the text), class_id, class_size and whether the row stands for its class."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.withColumn("h", F.xxhash64("text"))
    idf = spark.sparkContext.broadcast(inverse_frequency(text))
    signed = shared_checkpoint(text.mapInArrow(sign(idf), SIGNED))
    nodes = signed.groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("id"), F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands"))
    nodes = shared_checkpoint(nodes.select("c", "id", "low", "first", "n", "bands"))
    member = nodes.select("c", F.explode("bands").alias("b"))
    bucket = member.groupBy("b").agg(F.min("c").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    member = shared_checkpoint(member.join(bucket, "b"))
    stars = shared_checkpoint(member.where("a <> c").select("a", "c").distinct())

    def texts(of: DataFrame) -> DataFrame:
        """c, text of the nodes in ``of``, by the key of one of their rows."""
        want = of.join(nodes.select("c", "id"), "c").select("c", F.col("id.doc_id").alias("_d"), F.col("id.h").alias("_h"))
        found = text.join(want, text["doc_id"].eqNullSafe(want["_d"]) & text["h"].eqNullSafe(want["_h"]))
        return found.select("c", "text").dropDuplicates(["c"])

    wanted = stars.select("c").unionByName(stars.select(F.col("a").alias("c"))).distinct()
    known = shared_checkpoint(texts(wanted))
    pairs = stars.join(known.select(F.col("c").alias("a"), F.col("text").alias("left")), "a").join(known.select("c", F.col("text").alias("right")), "c")
    links = shared_checkpoint(pairs.select("a", "c", "left", "right").mapInArrow(verify(idf, least), "u long, v long"))
    comps = components(links)
    placed = member.where("members > 2").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed = placed.groupBy("b").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("b")
    rest = shared_checkpoint(placed.join(mixed, "b").select("b", "c", "comp"))
    if rest.head(1):
        links = links.unionByName(_within(rest, known, idf, least))
        comps = components(links)
    classed = nodes.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    whole = classed.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("first.doc_id").isNull().alias("none"), "first")).alias("rep"))
    classed = classed.join(whole, "comp").select("c", "class_id", "class_size", F.col("rep.first").alias("rep"))
    rows = signed.select("doc_id", "h", "c").join(classed, "c")
    own = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & F.col("h").eqNullSafe(F.col("rep.h"))
    return rows.select("doc_id", "h", "class_id", "class_size", own.alias("stays"))


def _within(rest: DataFrame, known: DataFrame, idf, least: float) -> DataFrame:
    """Links inside buckets, block against block; blocks of a bucket's largest component skip each other.

    A node's block is a hash of it, among the blocks of the largest component or of the
    others, so a bucket of any size is spread without an order over its rows.
    """
    sizes = rest.groupBy("b", "comp").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("b").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    whole = shared_checkpoint(whole.select("b", "main", blocks(F.col("inside")).alias("own"), blocks(F.col("n") - F.col("inside")).alias("others")))
    spot = F.xxhash64("c", "b")
    block = F.when(F.col("comp") == F.col("main"), F.pmod(spot, F.col("own"))).otherwise(F.col("own") + F.pmod(spot, F.col("others"))).cast("int")
    placed = rest.join(whole, "b").select("b", "c", "comp", block.alias("block"))
    last = F.col("own") + F.col("others") - 1
    pairs = whole.select("b", "own", "others", F.explode(F.sequence(F.lit(0), last)).alias("x"))
    pairs = pairs.select("b", "x", F.explode(F.sequence(F.greatest("x", "own"), last)).alias("y"))
    sides = pairs.select("b", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = placed.join(sides, ["b", "block"]).join(known, "c")
    return rows.select("b", "x", "y", "c", "comp", "text").groupBy("b", "x", "y").applyInArrow(link_block(idf, least), "u long, v long")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "stays")
