"""Exact removal of repeated passages by compressed full-text indexes, one per shard.

1. A document's windows of ``k`` words are hashed; each chunk of documents sends
   its distinct hashes, once each, to the shard that owns them, and gets back one
   bit per hash: is the window elsewhere too. A hash keeps 32 bits beside its shard, so
   about one window in 2,000 passes for nothing, at any size of corpus. Copies inside a chunk meet there, so
   a passage held by a third of all rows is one entry per chunk in its shard.
2. Runs of repeated windows are cut where the smallest hash of ``ANCHOR`` words in
   the window changes. Equal windows have equal anchors, so they meet in one shard.
3. The shard indexes its records (``fm_index``) and streams them through it by
   backward search; every window's suffix range gives all its occurrences, of which
   the first by (doc_id, position) stays.
4. Each chunk applies the returned spans to its texts.

Texts move once, in the shuffle that makes the chunks, which all steps reuse.
Hashes only pass work on; equality of windows is decided on word symbols (64-bit
hashes of words). A null text has no words. Rows with one doc_id are ordered by
their text; of equal rows all but one count as later. A null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, by_shard, mix, pack_sorted, parts_for, spread, table, text_buffer, unpack_sorted, window_starts, word_hashes
from .fm_index import FMIndex

ANCHOR = 8
CHUNKS_PER_PART = 4
NO_ID = -(1 << 63)


def _ordered(docs: pa.Table) -> pa.Table:
    """Rows by doc_id (null first), then by text."""
    ids = docs["doc_id"].fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) and (ids[order][1:] == ids[order][:-1]).any():
        texts = docs["text"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")), np.int64)
    return docs.take(order)


def _windows(docs: pa.Table, k: int, shards: int):
    """Words, words before each row, window starts and each window's shard and rest as one key."""
    words, before = word_hashes(docs["text"])
    starts = window_starts(before, k)
    rolling = Rolling(words)
    shard, rest = spread(rolling.ranges(starts, starts + k), shards)
    return words, before, starts, rolling, (shard << U64(32)) | (rest >> U64(8))


SIEVE = "chunk long, shard long, hashes binary, often binary"
BITS = "chunk long, shard long, bits binary"
RECORDS = "chunk long, shard long, docs binary, places binary, lengths binary, words binary, holders binary"
SPANS = "chunk long, spans binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def hash_chunk(k: int, shards: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        *_, keys = _windows(docs, k, shards)
        keys, counts = np.unique(keys, return_counts=True)
        often, rows = counts > 1, by_shard(keys >> U64(32))
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "shard": pa.array([s for s, _, _ in rows], pa.int64()),
            "hashes": pa.array([pack_sorted(keys[a:b] & U64((1 << 32) - 1)) for _, a, b in rows], pa.binary()),
            "often": pa.array([np.packbits(often[a:b]).tobytes() for _, a, b in rows], pa.binary()),
        })

    return run


def sieve(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One bit per hash that a chunk sent: whether any other window has it."""
    hashes = [unpack_sorted(x) for x in rows["hashes"].to_pylist()]
    often = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["often"].to_pylist(), hashes, strict=True)]
    every = np.sort(np.concatenate(hashes))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for h, o in zip(hashes, often, strict=True):
        at = np.searchsorted(twice, h)
        bits.append(np.packbits(o | ((at < len(twice)) & (np.append(twice, U64(0))[at] == h))).tobytes())
    return pa.table({"chunk": rows["chunk"], "shard": rows["shard"], "bits": pa.array(bits, pa.binary())})


def cut_records(k: int, shards: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, bits: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        docs = _ordered(docs)
        words, before, starts, rolling, keys = _windows(docs, k, shards)
        keys, back = np.unique(keys, return_inverse=True)
        again = np.zeros(len(keys), bool)
        replies = dict(zip(bits["shard"].to_pylist(), bits["bits"].to_pylist(), strict=True))
        for s, a, b in by_shard(keys >> U64(32)):
            again[a:b] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=b - a)
        starts = starts[again[back]]
        best, anchor = np.full(len(starts), U64((1 << 64) - 1)), np.full(len(starts), -1)
        for j in range(k - ANCHOR + 1):
            h = rolling.ranges(starts + j, starts + j + ANCHOR)
            less = h < best
            best, anchor = np.where(less, h, best), np.where(less, starts + j, anchor)
        doc = np.searchsorted(before, starts, side="right") - 1
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1]))[: len(starts)]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(starts))) + k - 1
        start, doc = starts[first], doc[first]
        shard, _ = spread(mix(best[first]), shards)
        content = rolling.ranges(start, start + length)
        order = np.lexsort([start, content, shard])
        ids = docs["doc_id"].fill_null(NO_ID).to_numpy()
        out = {n: [] for n in names}
        for s, a, b in by_shard(shard[order]):
            own = order[a:b]
            _, rep, at = np.unique(content[own], return_index=True, return_inverse=True)
            rep = own[rep]
            size = length[rep]
            span = np.repeat(start[rep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out["chunk"].append(key[0].as_py())
            out["shard"].append(s)
            out["docs"].append(ids[doc[rep]].astype("<i8").tobytes())
            out["places"].append((start[rep] - before[doc[rep]]).astype("<i8").tobytes())
            out["lengths"].append(size.astype(np.uint8).tobytes())
            out["words"].append(words[span].astype("<u8").tobytes())
            out["holders"].append(np.stack([at, start[own]]).astype("<i4").tobytes())
        return pa.table({n: pa.array(v, pa.int64() if n in ("chunk", "shard") else pa.binary()) for n, v in out.items()})

    return run


def index_shard(k: int):
    """Builds the shard's index; returns removable windows as (first word, bit mask) pairs."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        take = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
        docs, places, lengths, words = take("docs", "<i8"), take("places", "<i8"), take("lengths", np.uint8), take("words", "<u8")
        holders = [x.reshape(2, -1) for x in take("holders", "<i4")]
        base = np.cumsum([0] + [len(x) for x in docs])
        docs, places, lengths, words = np.concatenate(docs), np.concatenate(places), np.concatenate(lengths).astype(np.int64), np.concatenate(words)
        order = np.lexsort([places, docs])
        offset = np.cumsum(lengths) - lengths
        size = lengths[order]
        gather = np.repeat(offset[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        index = FMIndex(words[gather], size, k)
        at, low, high = index.matching_windows(index.starts, size)
        later = index.first_of(low, high) != at
        record = np.searchsorted(index.starts, at, side="right") - 1
        mask = np.zeros(len(order), np.int64)
        np.bitwise_or.at(mask, record[later], np.left_shift(1, (at - index.starts[record])[later]))
        masks, full = np.empty(len(order), np.int64), np.left_shift(1, lengths - k + 1) - 1
        masks[order] = mask
        spans = []
        for i, (own, start) in enumerate(holders):
            own = own + base[i]
            mine = np.where(np.append(True, own[1:] != own[:-1])[: len(own)], masks[own], full[own])
            spans.append(np.stack([start.astype(np.int64), mine])[:, mine != 0].astype("<i8").tobytes())
        return pa.table({"chunk": rows["chunk"], "spans": pa.array(spans, pa.binary())})

    return run


def apply_spans(k: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        data, offsets = text_buffer(docs["text"])
        raw = data.tobytes()
        texts = [raw[offsets[i] : offsets[i + 1]].split() for i in range(docs.num_rows)]
        before = np.cumsum([0] + [len(x) for x in texts])
        step = np.zeros(int(before[-1]) + 1, np.int64)
        for blob in spans["spans"].to_pylist():
            start, mask = np.frombuffer(blob, "<i8").reshape(2, -1)
            for j in range(k - ANCHOR + 1):
                on = start[(mask >> j) & 1 == 1] + j
                np.add.at(step, on, 1)
                np.add.at(step, on + k, -1)
        keep = np.cumsum(step)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[before]
        shas = []
        for i, own in enumerate(texts):
            if kept[i + 1] - kept[i] != len(own):
                own = compress(own, keep[before[i] : before[i + 1]].tolist())
            shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
        n = np.diff(before)
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(n - np.diff(kept), pa.int64()),
            "kept_sha256": pa.array(shas, pa.string()),
        })

    return run


def dedup_substrings(docs: DataFrame, k: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of what is left of each text."""
    parts = parts_for(docs)
    chunks, shards = parts * CHUNKS_PER_PART, parts
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).repartition(parts, "chunk")
    hashes = text.groupBy("chunk").applyInArrow(hash_chunk(k, shards), SIEVE)
    bits = hashes.groupBy("shard").applyInArrow(sieve, BITS)
    records = text.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(cut_records(k, shards), RECORDS)
    spans = records.groupBy("shard").applyInArrow(index_shard(k), SPANS)
    return text.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(apply_spans(k), RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


