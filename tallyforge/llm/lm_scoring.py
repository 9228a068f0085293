"""Scoring texts with a language model whose bigram counts live in a Bloom filter.

Training: distinct unigrams and bigrams of each slice go, with counts, to the shard
that owns their hash. A shard inserts each bigram once per level of its quantised
log count (level j stands for 2**((j-1)/2)) into its own segment of the filter, sized
at ``BITS`` bits per insertion, and counts its unigrams' tokens and types.

Scoring: segments are broadcast when together they fit ``FILTER_BYTES``; beyond that
a chunk sends its distinct bigrams to the shards, which probe the same segments and
return levels, so both ways give equal scores. A count is read back by probing level
after level until one is absent. Exact unigram
counts always come by exchange between chunks and shards, as they are unbounded.

p(w|h) = (c(hw) + MU p(w)) / (c(h) + MU), with p(w) the contract's add-half unigram;
a document's first token has no history.

Null text is empty: the end token alone. A null doc_id has no checksum and trains.
Rows that repeat are separate documents. An empty training set gives N = V = 0. Words
are 64-bit hashes of their lower-cased bytes; filter keys keep 40 bits and the shard.
Counts are whole numbers of up to 63 bits. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, by_shard, mix, pack40, pack_counts, parts_for, shared_checkpoint, slices, spread, table, text_buffer, unpack40, unpack_counts, word_hashes

END = 0x5EED0E4D
MU = 4.0
#: Bits and probes for each inserted level: an absent one is taken for present once in 270.
BITS = 12
PROBES = 6
#: Enough for counts below 2**63.
LEVELS = 128
FILTER_BYTES = 128_000_000
HELD_OUT = (5, 1)
CHUNKS_PER_PART = 4
LOW40 = (1 << 40) - 1
COUNTS = "order int, shard long, hashes binary, counts binary"
TOTALS = "shard long, tokens long, types long, size long, segment binary"
ASKED = "chunk long, order int, shard long, hashes binary, counts binary"
REPLY = "chunk long, order int, shard long, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token after each row, and tokens before each row."""
    words, before = word_hashes(column, lower=True)
    out = np.full(len(words) + len(before) - 1, END, U64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(before) - 1), np.diff(before))] = words
    return out, before + np.arange(len(before))


def pairs_of(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it, and where: all but rows' first tokens."""
    inner = np.ones(len(tokens), bool)
    inner[before[:-1]] = False
    at = np.flatnonzero(inner)
    return mix(mix(tokens[at - 1]) * U64(3) + tokens[at]), at


def _keys(hashes: np.ndarray, shards: int, order: int) -> np.ndarray:
    """Sortable by shard: whole hashes for exact unigrams, shard and 40 bits for filter keys."""
    hashes = mix(hashes)
    if order == 1:
        return hashes
    shard, rest = spread(hashes, shards)
    return (shard << U64(40)) | rest


def _shard_of(keys: np.ndarray, shards: int, order: int) -> np.ndarray:
    return spread(keys, shards)[0] if order == 1 else keys >> U64(40)


def _packed(keys: np.ndarray, order: int) -> bytes:
    return keys.astype("<u8").tobytes() if order == 1 else pack40(keys & U64(LOW40))


def _unpacked(blob: bytes, order: int) -> np.ndarray:
    return np.frombuffer(blob, "<u8") if order == 1 else unpack40(blob)


def _counted(hashes: np.ndarray, shards: int, order: int, weights: np.ndarray | None = None):
    """(shard, keys packed, counts packed) rows of the distinct hashes."""
    keys = _keys(hashes, shards, order)
    if weights is None:
        keys, counts = np.unique(keys, return_counts=True)
    else:
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, weights=weights, minlength=len(keys)).astype(np.int64)
    for s, a, b in by_shard(_shard_of(keys, shards, order)):
        yield s, _packed(keys[a:b], order), pack_counts(counts[a:b])


def count_ngrams(shards: int):
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch["text"])
            for a, b in slices(offsets, 16_000_000):
                tokens, before = tokens_of(batch["text"].slice(a, b - a))
                rows = [(1, *x) for x in _counted(tokens, shards, 1)] + [(2, *x) for x in _counted(pairs_of(tokens, before)[0], shards, 2)]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def merged(order: int, hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one shard and order, and their summed counts."""
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys = np.concatenate([_unpacked(x, order) for x in hashes])
    keys, back = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, back, np.concatenate([unpack_counts(x).astype(np.int64) for x in counts]))
    return keys[sums > 0], sums[sums > 0]


def levels_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9)).astype(np.int64)


def _places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    a = mix(keys * U64(2 * LEVELS) + U64(level))
    b = mix(a + U64(0x9E3779B97F4A7C15)) | U64(1)
    for i in range(PROBES):
        yield ((a + U64(i) * b) >> U64(32)) * U64(bits) >> U64(32)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Packed bits of a shard's filter; every level up to a key's own is inserted."""
    levels = levels_of(counts)
    bits = max(64, int(levels.sum()) * BITS)
    flags = np.zeros(-(-bits // 8) * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= level], level, len(flags)):
            flags[place.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def quantised(levels: np.ndarray) -> np.ndarray:
    """The counts that levels stand for; level 0 is none."""
    return np.where(levels > 0, 2.0 ** ((levels.astype(float) - 1) / 2), 0.0)


def probe(segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels: the last one of an unbroken run of hits, 0 if none."""
    out, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for level in range(1, LEVELS + 1):
        hit = np.ones(len(left), bool)
        for place in _places(keys[left], level, 8 * len(segment)):
            hit &= (segment[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
        left = left[hit]
        if not len(left):
            break
        out[left] = level
    return out


def total_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    of = {n: ([], []) for n in (1, 2)}
    for order, hashes, counts in zip(*(rows[c].to_pylist() for c in ("order", "hashes", "counts")), strict=True):
        of[order][0].append(hashes)
        of[order][1].append(counts)
    _, sums = merged(1, *of[1])
    segment = build_segment(*merged(2, *of[2])).tobytes()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([int(sums.sum())], pa.int64()), "types": pa.array([len(sums)], pa.int64()), "size": pa.array([len(segment)], pa.int64()), "segment": pa.array([segment], pa.binary())})


def _training(docs: pa.Table) -> np.ndarray:
    return ~docs["held_out"].to_numpy().astype(bool)


def ask_chunk(shards: int, orders: tuple[int, ...]):
    names = [x.split()[0] for x in ASKED.split(", ")]

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        tokens, before = tokens_of(docs["text"])
        weight = np.repeat(_training(docs), np.diff(before)).astype(float)
        rows = [(key[0].as_py(), 1, *x) for x in _counted(tokens, shards, 1, weight)]
        if 2 in orders:
            pairs, at = pairs_of(tokens, before)
            rows += [(key[0].as_py(), 2, *x) for x in _counted(pairs, shards, 2, weight[at])]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def answer_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For each chunk's keys: exact counts of unigrams, probed levels of bigrams."""
    order = rows["order"].to_numpy()
    hashes, counts, replies = rows["hashes"].to_pylist(), rows["counts"].to_pylist(), [b""] * len(order)
    for n in (1, 2):
        own = np.flatnonzero(order == n)
        if not len(own):
            continue
        keys, sums = merged(n, [hashes[i] for i in own], [counts[i] for i in own])
        segment = build_segment(keys, sums) if n == 2 else None
        for i in own:
            asked = _unpacked(hashes[i], n)
            if n == 2:
                replies[i] = probe(segment, asked).tobytes()
            else:
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                replies[i] = pack_counts(np.where(keys[at] == asked, sums[at], 0) if len(keys) else np.zeros(len(asked), np.int64))
    return pa.table({"chunk": rows["chunk"], "order": rows["order"], "shard": rows["shard"], "counts": pa.array(replies, pa.binary())})


def _looked_up(hashes: np.ndarray, shards: int, order: int, reply) -> np.ndarray:
    """Numbers for hashes, from a function of (shard, sorted distinct keys of that shard)."""
    keys, back = np.unique(_keys(hashes, shards, order), return_inverse=True)
    out = np.zeros(len(keys))
    for s, a, b in by_shard(_shard_of(keys, shards, order)):
        out[a:b] = reply(s, keys[a:b])
    return out[back]


def score_chunk(shards: int, n: int, v: int, segments):
    """``segments``: a broadcast of shard -> packed bits, or None if replies carry bigrams."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        got = {(o, s): c for o, s, c in zip(*(replies[x].to_pylist() for x in ("order", "shard", "counts")), strict=True)}
        tokens, before = tokens_of(docs["text"])
        counts = _looked_up(tokens, shards, 1, lambda s, _: unpack_counts(got[1, s]))
        pairs, at = pairs_of(tokens, before)
        if segments is None:
            levels = _looked_up(pairs, shards, 2, lambda s, _: np.frombuffer(got[2, s], np.uint8))
        else:
            bits = segments.value
            levels = _looked_up(pairs, shards, 2, lambda s, keys: probe(np.frombuffer(bits[s], np.uint8), keys & U64(LOW40)) if s in bits else 0)
        joint = quantised(levels)
        p = (counts + 0.5) / (n + 0.5 * (v + 1))
        base = np.log10(p)
        model, history = base.copy(), counts[at - 1]
        model[at] = np.log10((np.minimum(joint, history) + MU * p[at]) / (history + MU))
        summed = lambda x: np.add.reduceat(np.append(x, 0), before[:-1]) if len(before) > 1 else x
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "held_out": docs["held_out"],
            "n_tokens": pa.array(np.diff(before), pa.int64()),
            "n_known": pa.array(summed((counts > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(docs.num_rows, n), pa.int64()),
            "base_score": pa.array(summed(base), pa.float64()),
            "score": pa.array(summed(model), pa.float64()),
        })

    return run


def score(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document, training and held out alike."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    shards, chunks = parts, parts * CHUNKS_PER_PART
    buckets, held = HELD_OUT
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == held, F.lit(False))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"))
    counts = text.where("NOT held_out").select("text").mapInArrow(count_ngrams(shards), COUNTS)
    totals = shared_checkpoint(counts.groupBy("shard").applyInArrow(total_shard, TOTALS))
    n, v, size = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("types"), F.sum("size")).first())
    segments, orders = None, (1, 2)
    if size <= filter_bytes:
        segments, orders = spark.sparkContext.broadcast({r.shard: bytes(r.segment) for r in totals.select("shard", "segment").toLocalIterator()}), (1,)
    text = text.withColumn("chunk", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks))).repartition(parts, "chunk")
    replies = text.groupBy("chunk").applyInArrow(ask_chunk(shards, orders), ASKED).groupBy("shard").applyInArrow(answer_shard, REPLY)
    return text.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score_chunk(shards, n, v, segments), RESULT)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
