"""Shared helpers: whole-batch tokenising in numpy, sizing, checked broadcasts.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; a word is
carried as a 64-bit hash of its bytes: a chain of bijective scrambles over its 8-byte
pieces, injective among words of one length up to 8 bytes, and BLAKE2 beyond ``LONG``
bytes. ``Rolling`` hashes short runs of such hashes (a few dozen at most); it must not be
used on raw bytes or long runs, where polynomials modulo 2**64 collide on regular input.
Batches are cut into slices of a few MB, so memory follows the longest single text and
not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled at once in a worker.
SLICE_BYTES = 1_000_000
#: A small side is broadcast only when it has at most so many rows.
BROADCAST_ROWS = 50_000
#: Partitions that the input's size may ask for.
MOST_PARTS = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def worker_cache(owner: str) -> dict:
    """What a worker process keeps between tasks; only one operator's at a time."""
    kept = sys.modules.setdefault("_tallyforge_kept", types.ModuleType("_tallyforge_kept")).__dict__
    others = [x for x in kept if not x.startswith("__") and x != owner]
    for name in others:
        del kept[name]
    if others:
        _return_memory()
    return kept.setdefault(owner, {})


def _return_memory() -> None:
    """Hands freed memory of this process back to the system, as its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class Rolling:
    """Hashes of short ranges of a sequence of scrambled 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.inv = powers(_INV, n)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * powers(_BASE, n)[:n], dtype=U64, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(raw ^ (np.asarray(end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer single row is its own range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and words before each row (n+1)."""
    solid = ~_WS[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    own = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[own] = solid[own]
    own = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[own] = solid[own]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strong 64-bit hashes of byte ranges, any bytes and lengths."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(size.astype(U64) + U64(0x632BE59BD9B4E019))
    short = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(short):
        piece = eight[starts[short] + at] & _LOW[np.minimum(size[short] - at, 8)]
        out[short] = mix(out[short] ^ piece) + U64(_BASE)
        at += 8
        short = short[size[short] > at]
    raw = memoryview(padded)
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def row_hashes(symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Strong 64-bit hashes of whole rows of 64-bit symbols."""
    raw = memoryview(np.ascontiguousarray(symbols, "<u8")).cast("B")
    digest = (hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True))
    return np.frombuffer(b"".join(digest), "<u8").astype(U64)


def word_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and words before each row."""
    data, offsets = text_buffer(column)
    hashes, counts = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    total = 0
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, before = word_bounds(part, own)
        hashes.append(range_hashes(part, starts, ends))
        counts.append(before[1:] + total)
        total += len(starts)
    return np.concatenate(hashes), np.concatenate(counts)


def window_starts(before: np.ndarray, k: int) -> np.ndarray:
    """Indices of words at which a window of k words of one row starts."""
    n = np.maximum(np.diff(before) - k + 1, 0)
    return np.repeat(before[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pack40(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def pack_counts(values: np.ndarray) -> bytes:
    """Whole numbers below 2**64, each as wide as the largest needs."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct 32-bit values as differences: three bytes each if all fit, else four."""
    gaps = np.diff(values, prepend=U64(0)).astype("<u4")
    width = 3 if not len(gaps) or gaps.max() < 1 << 24 else 4
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros((len(blob) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(out.reshape(-1).view("<u4"), dtype=U64)


def spread(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard below ``shards`` and a 40-bit rest for each 64-bit hash."""
    return ((h >> U64(32)) * U64(shards)) >> U64(32), h & U64((1 << 40) - 1)


def by_shard(shard: np.ndarray):
    """(shard, from, to) for each run of a sorted array."""
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else [0]
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def input_bytes(df: DataFrame) -> int:
    """Stored size of what a plan reads, from its leaves' statistics; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [x for x in known if x < 1 << 50]  # more is a guess at a join's size
    return sum(known) if known else 64_000_000 * shuffle_partitions(df.sparkSession)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, part_bytes: int = 8_000_000) -> int:
    """Partitions of about ``part_bytes`` stored bytes, the session's number at least.

    Above ``MOST_PARTS`` (2 TB at the default) they grow in size and not in number, as
    operators that exchange by shard send messages from every part to every shard.
    """
    return max(shuffle_partitions(df.sparkSession), min(MOST_PARTS, -(-input_bytes(df) // part_bytes)))


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names.

    Where the setting is missing (tests on one machine), Spark's warehouse
    folder takes the files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table of totals; broadcast only if it has at most ``bound`` rows.

    Above that a sort-merge join runs, whose hot keys AQE splits. ``keys`` compare
    null-safely. ``small`` should be cheap to recompute, or checkpointed.
    """
    few = small.limit(bound + 1).count() <= bound
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        same = big[k].eqNullSafe(right[f"__{k}"])
        on = same if on is None else on & same
    return big.join(F.broadcast(right) if few else right, on, how).drop(*[f"__{k}" for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
