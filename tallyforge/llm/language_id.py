"""Language identification by Bayesian fusion of text, declared language, address and host.

log P(l | document) = text + log P(declared | l) + log P(suffix | l) + log P(l | host).

Text: byte trigrams in ``CELLS`` hashed cells per language, counted over all rows with
a declared language; a share ``NOISE`` of any text is taken to be of no language, so one
odd trigram says little. Every declared language is modelled, however rare: counts are a
table keyed by language and cell, and workers hold ``BLOCK`` languages at a time, so only
the time grows with their number. Trigrams of one text are dependent, so a text counts
as at most ``EVIDENCE`` of them.
Host: declared languages per host are smoothed towards the host's parent domain, and
those towards the whole, by grouped sums; the table of hosts is broadcast only when few.

One more answer is none of the languages: prior ``NONE``, all cells and declarations
alike. Text unlike every language, such as random letters or an undeclared script, ends
there, whatever it declares. A document is rejected if it has no letters, or no language
has a posterior of ``POSTERIOR``. Null text has no letters. A missing declaration, suffix
or host says nothing (the host prior is then the whole's). Ties go to the language first
by code point. Rows that repeat are judged each, long texts as a whole. With no declared
language at all, every row is rejected; an empty table gives no rows. Columns beyond
those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, join_checked, shared_checkpoint, slices, table, text_buffer, worker_cache

CELLS = 1 << 15
#: Languages whose trigram tables a worker holds at once.
BLOCK = 64
EVIDENCE = 100
POSTERIOR = 0.5
NOISE = 0.1
NONE = 0.01
HONEST = 0.9
HONEST_SUFFIX = 0.7
PRIOR_WEIGHT = 20.0
#: Country suffixes of single-language hosts.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the trigram at each byte, and whether it lies in one row and has a letter."""
    folded = _FOLD[data].astype(U64)
    if len(folded) < 3:
        return np.zeros(len(folded), np.int64), np.zeros(len(folded), bool)
    code = (folded[:-2] << U64(16)) | (folded[1:-1] << U64(8)) | folded[2:]
    cell = np.zeros(len(folded), np.int64)
    cell[:-2] = ((code * U64(0x9E3779B97F4A7C15)) >> U64(49)).astype(np.int64)
    good = np.append(code != U64(0x202020), [False, False])
    for back in (1, 2):
        edge = offsets[1:] - back
        good[edge[edge >= offsets[:-1]]] = False
    return cell, good


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """declared, cell, n: sums of at most ``BLOCK`` languages are held, then sent on."""
    worker_cache("language_id")
    held: dict[str, np.ndarray] = {}

    def sums() -> pa.RecordBatch:
        cells = {x: np.flatnonzero(c) for x, c in held.items()}
        n = [held[x][at] for x, at in cells.items()]
        names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(held)), [len(x) for x in n]).astype(np.int32), pa.array(list(held), pa.string()))
        return pa.record_batch({"declared": names.cast(pa.string()), "cell": pa.array(np.concatenate(list(cells.values())), pa.int32()), "n": pa.array(np.concatenate(n), pa.int64())})

    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        said = batch["declared"].to_pylist()
        for a, b in slices(offsets):
            own = offsets[a : b + 1] - offsets[a]
            cell, good = trigrams(data[offsets[a] : offsets[b]], own)
            names = sorted(set(said[a:b]))
            index = {x: i for i, x in enumerate(names)}
            lang = np.repeat([index[x] for x in said[a:b]], np.diff(own))[good]
            cell = cell[good]
            for lo in range(0, len(names), BLOCK):
                some = names[lo : lo + BLOCK]
                if len(held.keys() | set(some)) > BLOCK:
                    yield sums()
                    held.clear()
                here = slice(None) if len(names) <= BLOCK else (lang >= lo) & (lang < lo + BLOCK)
                got = np.bincount((lang[here] - lo) * CELLS + cell[here], minlength=len(some) * CELLS).reshape(len(some), CELLS)
                for x, c in zip(some, got, strict=True):
                    held[x] = held[x] + c if x in held else c.copy()
    if held:
        yield sums()


def text_model(rows: DataFrame, languages: list[str]) -> list[Broadcast]:
    """log P(cell | language), one row per language, in blocks of ``BLOCK`` languages."""
    parts = rows.select("text", "declared").mapInArrow(count_texts, "declared string, cell int, n long")
    table = shared_checkpoint(parts.groupBy("declared", "cell").agg(F.sum("n").alias("n")))
    out = []
    for lo in range(0, len(languages), BLOCK):
        some = languages[lo : lo + BLOCK]
        got = table.where(F.col("declared").isin(some)).toArrow()
        at = pc.index_in(got["declared"], pa.array(some, pa.string())).to_numpy()
        counts = np.zeros((len(some), CELLS))
        counts[at, got["cell"].to_numpy()] = got["n"].to_numpy()
        model = np.log((1 - NOISE) * (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * CELLS) + NOISE / CELLS)
        out.append(rows.sparkSession.sparkContext.broadcast(model.astype(np.float32)))
    return out


def host_counts(rows: DataFrame) -> DataFrame:
    """host, its declared languages and its parent's, each array<struct<declared, n>>."""
    ours = rows.where("declared IS NOT NULL AND host IS NOT NULL")
    each = shared_checkpoint(ours.groupBy("host", "parent", "declared").agg(F.count(F.lit(1)).alias("n")))
    pair = F.collect_list(F.struct("declared", "n"))
    hosts = each.groupBy("host", "parent").agg(pair.alias("seen"))
    parents = each.groupBy("parent", "declared").agg(F.sum("n").alias("n")).groupBy("parent").agg(pair.alias("above"))
    return join_checked(shared_checkpoint(hosts), shared_checkpoint(parents), ["parent"]).select("host", "seen", "above")


class Counts:
    """Counts of languages per host of a slice, of which blocks of columns are asked for."""

    def __init__(self, entries: list, index: dict[str, int]):
        flat = [(i, index[x["declared"]], x["n"]) for i, e in enumerate(entries) for x in e or []]
        self.host, self.lang, self.n = np.array(flat, np.int64).reshape(-1, 3).T
        self.total = np.bincount(self.host, self.n, len(entries))[:, None]

    def block(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(self.total), hi - lo))
        here = (self.lang >= lo) & (self.lang < hi)
        out[self.host[here], self.lang[here] - lo] = self.n[here]
        return out

    def smooth(self, lo: int, hi: int, above: np.ndarray) -> np.ndarray:
        return (self.block(lo, hi) + PRIOR_WEIGHT * above) / (self.total + PRIOR_WEIGHT)


def fuse(languages: list[str], model: list[Broadcast], whole: np.ndarray, keep: list[str]):
    names = ["language", "posterior", "letters"]
    index = {x: i for i, x in enumerate(languages)}
    n = len(languages)

    def told(values: list, honest: float):
        at = np.array([index.get(x, -1) for x in values])

        def block(lo: int, hi: int) -> np.ndarray:
            out = np.zeros((len(at), hi - lo))
            if n > 1:
                out[at >= 0] = np.log((1 - honest) / (n - 1))
                here = np.flatnonzero((at >= lo) & (at < hi))
                out[here, at[here] - lo] = np.log(honest)
            return out

        return block, np.where(at >= 0, -np.log(n), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            for a, b in slices(offsets):
                part, own = batch.slice(a, b - a), offsets[a : b + 1] - offsets[a]
                cell, good = trigrams(data[offsets[a] : offsets[b]], own)
                at = np.concatenate([[0], np.cumsum(good)])[own]
                count = np.diff(at)
                cell = cell[good]
                weight = (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
                first: dict[str | None, int] = {}
                for i, x in enumerate(part["host"].to_pylist()):
                    first.setdefault(x, i)
                slot = {x: i for i, x in enumerate(first)}
                host = np.array([slot[x] for x in part["host"].to_pylist()])
                seen, above = [Counts([part[c][i].as_py() for i in first.values()], index) for c in ("seen", "above")]
                (declared, any_declared), (suffix, any_suffix) = told(part["declared"].to_pylist(), HONEST), told([SUFFIXES.get(x) for x in part["suffix"].to_pylist()], HONEST_SUFFIX)
                top, mass, best = np.full(len(count), -np.inf), np.zeros(len(count)), np.zeros(len(count), np.int64)
                for lo, shared in zip(range(0, n, BLOCK), model, strict=True):
                    likely = shared.value
                    hi = lo + len(likely)
                    total = np.stack([np.diff(np.concatenate([[0], np.cumsum(x[cell], dtype=np.float64)])[at]) for x in likely], axis=1) * weight
                    total += np.log(seen.smooth(lo, hi, above.smooth(lo, hi, whole[lo:hi])))[host] + declared(lo, hi) + suffix(lo, hi)
                    most = np.maximum(top, total.max(axis=1))
                    best = np.where(total.max(axis=1) > top, lo + total.argmax(axis=1), best)
                    mass = mass * np.exp(top - most) + np.exp(total - most[:, None]).sum(axis=1)
                    top = most
                    if n > BLOCK and shared._path:  # the next use reads the file again
                        del shared._value
                none = np.minimum(count, EVIDENCE) * -np.log(CELLS) + np.log(NONE) + any_declared + any_suffix
                mass += np.exp(np.minimum(none - top, 700))
                fresh = [pa.array([languages[i] for i in best], pa.string()), pa.array(1 / mass), pa.array(count, pa.int64())]
                yield pa.record_batch([part[c] for c in keep] + fresh, names=keep + names)

    return run


def identify(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """``rows``: row (any type), text, declared, suffix, host, parent -> row, language, posterior, kept.

    With ``keep_text`` the text comes back too, after ``row``.
    """
    keep = ["row", "text"] if keep_text else ["row"]
    said = rows.where("declared IS NOT NULL")
    counted = {r.declared: r.n for r in said.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counted)
    if not languages:
        return rows.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    n = np.array([counted[x] for x in languages])
    joined = join_checked(rows, shared_checkpoint(host_counts(rows)), ["host"]).select("row", "text", "declared", "suffix", "host", "seen", "above")
    kind = dict(rows.dtypes)["row"]
    shape = f"row {kind}, " + ("text string, " if keep_text else "") + "language string, posterior double, letters long"
    out = joined.mapInArrow(fuse(languages, text_model(said, languages), (n + 1) / (n.sum() + len(n)), keep), shape)
    return out.select(*keep, "language", "posterior", ((F.col("letters") > 0) & (F.col("posterior") >= POSTERIOR)).alias("kept"))


def document_evidence(docs: DataFrame, row: Column) -> DataFrame:
    """documents: ``lang`` is the declared language and ``source`` the host."""
    parent = F.regexp_replace(F.col("source"), "[0-9]+$", "")
    return docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), parent.alias("parent"))


def page_evidence(pages: DataFrame, row: Column | None = None) -> DataFrame:
    """pages: the markup's lang attribute, the address's suffix and its host. Tags are no text."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    host = F.when(F.length(host) > 0, host)
    said = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    row = F.struct("page_id") if row is None else row
    return pages.select(row.alias("row"), text.alias("text"), F.when(F.length(said) > 0, said).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("parent"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages, judged together; ``kind`` tells them apart."""
    none, kind = F.lit(None).cast("long"), F.lit("document")
    docs = table(spark, sf_dir, "documents")
    docs = document_evidence(docs, F.struct(kind.alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")))
    pages = page_evidence(table(spark, sf_dir, "pages"), F.struct(F.lit("page").alias("kind"), none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")))
    out = identify(docs.unionByName(pages).withColumn("row", F.struct("row.*", "declared")))
    return out.select("row.doc_id", "row.declared", "language", "posterior", "kept", "row.kind", "row.page_id")
