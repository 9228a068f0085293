"""Packing tokenised documents into fixed-length sequences: first-fit decreasing.

Tokenising happens where the text is read; only piece lengths and checksums move. A
document is cut into full sequences and a remainder. Remainders go to randomised
groups (a seeded hash of the document), and each group packs its own by first-fit
decreasing, with a tournament tree over the bins' free space that finds the first bin
with room in logarithmic time. Groups grow in number with the input, not in size.

Text decides ids only between spaces, so each distinct piece between spaces of a few
MB of text is merged once, by `BytePairs` with the tokenizer's merges; pieces that it
refuses go to the tokenizer, through a bounded cache. Texts with runs of white space
that such cuts would change, or with a special token's string, go to the tokenizer whole. Null or empty text is the end id alone. Rows that
repeat are packed each. A sequence whose length is a power of two needs no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_pairs import LONGEST, BytePairs
from .common import parts_for, slices, table, text_buffer, worker_cache

SEQUENCE = 2048
END_ID = 1
SEED = 20_240_607
GROUP_BYTES = 8_000_000
#: Bytes of text whose pieces are told apart together.
TEXT_BYTES = 4_000_000
#: Pieces of the tokenizer's that a worker keeps ids of; a full cache starts afresh.
CACHE = 100_000
#: What a word that is empty or opens with white space begins with.
WHITE = {"", *(chr(i) for i in range(0x10000) if chr(i).isspace())}
WHITE_LEADS = np.isin(np.arange(256), [x.encode()[0] for x in WHITE if x])
PIECES = "doc_id long, doc_tokens long, crcs binary"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceCodec:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # three white-space characters in a row or two at the end: the cuts would change the ids
        self.odd = re.compile(r"\s\s(?:\s|\Z)")
        self.pairs = BytePairs(path) if BytePairs.covers(path) else None
        self.known: dict[str, np.ndarray] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct pieces, in any order of pieces; where each starts and how many it has."""
        if self.pairs:
            ids, many, refused = self.pairs.encode(pieces)
            left = np.flatnonzero(refused)
        else:
            ids, many, left = np.zeros(0, np.int32), np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        start = np.cumsum(many) - many
        rest = pieces.take(pa.array(left)).to_pylist()
        fresh = [x for x in rest if x not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known, fresh = {}, rest
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.known.update(zip(part, self._ids(part), strict=True))
        found = [self.known[x] for x in rest]
        for x in fresh:
            if len(x) > LONGEST:  # a bound on entries bounds memory only if they are short
                del self.known[x]
        many[left] = [len(x) for x in found]
        start[left] = len(ids) + np.cumsum(many[left]) - many[left]
        return np.concatenate([ids.astype("<u4"), *found]), start, many

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Arrow tells words apart, so a piece is handled once a call; null counts as empty."""
        if not len(texts):
            return []
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column, "") if column.null_count else column
        cut = pc.split_pattern(column, pattern=" ")
        offsets = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # a word that opens its text has no space before it
        opening = offsets[:-1]
        bare, own = np.unique(which[opening], return_inverse=True)
        which[opening] = len(words) + own
        spaced = pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))
        ids, start, many = self._pieces(pa.concat_arrays([spaced, words.take(pa.array(bare))]))
        count = many[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = ids[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], count)]
        ends = ends[offsets]
        # only a word that is empty or opens with white space follows a cut inside such a run
        data, at = text_buffer(words)
        lead = np.append(data, np.uint8(0x20))[at[:-1]]
        blank = np.zeros(len(words) + len(bare), bool)
        for i in np.flatnonzero(WHITE_LEADS[lead] | (at[1:] == at[:-1])).tolist():
            blank[i] = words[i].as_py()[:1] in WHITE
        whole = np.diff(np.concatenate([[0], np.cumsum(blank[which])])[offsets]) > 0
        for i in np.flatnonzero(whole).tolist():
            whole[i] = self.odd.search(column[i].as_py()) is not None
        for x in self.special:
            whole |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        out = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        left = np.flatnonzero(whole).tolist()
        for i, x in zip(left, self._ids([column[i].as_py() for i in left]), strict=True):
            out[i] = x.tobytes()
        return out


def _codec(path: str) -> PieceCodec:
    """One codec for each worker process."""
    kept = worker_cache("packing")
    if path not in kept:
        kept[path] = PieceCodec(path)
    return kept[path]


def cut_documents(path: str, size: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = _codec(path)
        for batch in batches:
            _, offsets = text_buffer(batch["text"])
            for at, to in slices(offsets, TEXT_BYTES):
                part = batch.slice(at, to - at)
                blobs = [x + end for x in codec.encode(part["text"])]
                step = 4 * size
                crcs = [np.array([zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)], "<u4").tobytes() for x in blobs]
                yield pa.record_batch({"doc_id": part["doc_id"], "doc_tokens": pa.array([len(x) // 4 for x in blobs], pa.int64()), "crcs": pa.array(crcs, pa.binary())})

    return run


class Tournament:
    """Free space of bins 0, 1, 2, ...; each inner node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Puts ``need`` into the first bin with room; gives the bin and its free space before."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.best[node] < need:
                node += 1
        bin_, free = node - self.leaves, self.best[node]
        self.best[node] = free - need
        while node > 1:
            node //= 2
            top = max(self.best[2 * node], self.best[2 * node + 1])
            if self.best[node] == top:
                break
            self.best[node] = top
        return bin_, free


def pack_group(size: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        ids = docs["doc_id"].to_pylist()
        tokens = docs["doc_tokens"].to_numpy()
        crcs = docs["crcs"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-(tokens[i] % size), ids[i] is not None, ids[i] or 0, crcs[i]))
        full, rest = tokens // size, tokens % size
        tree = Tournament(max(1, int((rest > 0).sum())), size)
        first = key[0].as_py() << 32
        whole = int(full.sum())  # full sequences come first in a group's numbers
        used, rows = 0, []
        for i in order:
            sums = np.frombuffer(crcs[i], "<u4").tolist()
            for j in range(int(full[i])):
                rows.append((ids[i], j * size, size, sums[j], tokens[i], first + used, 0))
                used += 1
            if need := int(rest[i]):
                bin_, free = tree.place(need)
                rows.append((ids[i], int(full[i]) * size, need, sums[-1], tokens[i], first + whole + bin_, size - free))
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)})

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    path = path or default_tokenizer()
    groups = parts_for(docs, GROUP_BYTES) * 2
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = text.mapInArrow(cut_documents(path, size), PIECES)
    group = F.pmod(F.xxhash64("doc_id", "crcs", F.lit(SEED)), F.lit(groups))
    return pieces.withColumn("group", group).groupBy("group").applyInArrow(pack_group(size), RESULT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
