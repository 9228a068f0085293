"""Each operator against brute force, on edge cases and on a driver table."""

import math
import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, pii, quality_rules, substring_dedup, topk_search
from tallyforge.llm.fm_index import FMIndex, WaveletMatrix

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "chunk", "shard", "h", "c", "b", "g", "k", "bands", "held_out", "kept", "size", "_size", "n", "declared", "group", "spans", "stays", "class_id", "x0", "mean"]
NAMES = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(NAMES) + r.choice(["", "s", ",", "."]) for _ in range(n))


def edge_rows():
    passage = prose(99, 30)
    long_text = prose(7, 30_000)
    texts = [
        None, "", "   \n\t ", "one", "one two three four", prose(1, 60), prose(1, 60), prose(2, 40) + "\n" + passage, passage + "\n" + prose(3, 40),
        long_text, long_text + " end", "x" * 200_000, "line a b c d e f g h i j\n" * 30, "é𝄞 Ünïcode wörds 漢字 " + passage, "#*$% " * 40,
        "mail a.b@c.example.org or +1 (269) 555-3296 from 10.0.0.255 card 4111 1111 1111 1111", "\x0b\x0cvertical\x0bfeeds\x1cunit", "tail  ", "a   b",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t) if t else None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ids_only(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def test_wavelet_matrix_ranks():
    import numpy as np

    r = np.random.default_rng(1)
    seq = r.integers(0, 11, 500)
    m = WaveletMatrix(seq, 11)
    at = r.integers(0, 501, 300)
    sym = r.integers(0, 11, 300)
    assert m.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(sym, at)]


def test_fm_index_windows_match_brute_force():
    import numpy as np

    r = random.Random(3)
    records = [[r.randrange(4) for _ in range(r.randrange(5, 12))] for _ in range(80)]
    words = np.array([w for x in records for w in x], np.uint64)
    index = FMIndex(words, np.array([len(x) for x in records]), 5)
    at, low, high = index.matching_windows(index.starts, np.array([len(x) for x in records]))
    places = defaultdict(list)
    for s, rec in zip(index.starts, records):
        for i in range(len(rec) - 4):
            places[tuple(rec[i : i + 5])].append(int(s) + i)
    of = {p: w for w, ps in places.items() for p in ps}
    assert sorted(at.tolist()) == sorted(of)
    for a, lo, hi, first in zip(at.tolist(), low.tolist(), high.tolist(), index.first_of(low, high).tolist()):
        assert hi - lo == len(places[of[a]]) and first == places[of[a]][0]
    lo, hi = index.search(np.array([[0, 1, 2], [9, 9, 9]], np.uint64))
    assert hi[0] - lo[0] == sum(rec[i : i + 3] == [0, 1, 2] for rec in records for i in range(len(rec) - 2)) and hi[1] == lo[1]


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_substring_dedup(name, request):
    df = request.getfixturevalue(name)
    got = sorted(map(tuple, substring_dedup.dedup_substrings(df).collect()))
    assert got == sorted(brute.substring_dedup(pairs(df)))


def test_substring_dedup_repeated_rows_and_null_ids(spark):
    rows = [(None, prose(5, 30)), (4, prose(5, 30)), (4, prose(5, 30)), (4, prose(6, 25)), (None, None)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.substring_dedup(rows)))


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_pii_base_spans(name, request):
    df = request.getfixturevalue(name)
    texts = dict(pairs(df))
    got = pii.find(df).select("doc_id", *[F.size(k).alias(k) for k in pii.KINDS], pii._joined("base").alias("base")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert ([r.email, r.ip, r.card, r.phone], r.base) == brute.base_spans(texts[r.doc_id])


def test_pii_fuzz(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("ab@..+-1234 ()%é_") for _ in range(r.randrange(60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(df).select("doc_id", pii._joined("base").alias("base")).collect():
        assert row.base == brute.base_spans(texts[row.doc_id])[1]


def test_pii_bootstraps_unseen_identifiers(spark):
    rows = [(i, f"{prose(i, 5)} mailto user{i}@host{i}.example.org {prose(i + 50, 3)}") for i in range(30)]
    rows += [(100, f"{prose(3, 4)} mailto nobody77(at)host {prose(4, 4)}"), (101, f"{prose(5, 4)} room 12b {prose(6, 4)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii._joined("spans").alias("s")).collect()}
    at = rows[30][1].index("nobody77")
    assert got[100] == f"email:{at}:{at + len('nobody77(at)host')}" and got[101] == ""
    texts = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "nobody77" not in texts[100] and "[email]" in texts[100] and texts[101] == rows[31][1]


def test_pii_bootstraps_where_many_identifiers_escape(spark):
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    escaped = [f"some{letters(i)}(at)host" for i in range(20)] + [f"any{letters(i)} at host dot org" for i in range(5)]
    rows = [(i, f"{prose(i, 5)} mailto user{i}@host{i}.example.org {prose(i + 50, 3)}") for i in range(30)]
    rows += [(100 + i, f"{prose(i, 4)} mailto {x} {prose(i + 70, 4)}") for i, x in enumerate(escaped)]
    rows += [(200 + i, f"{prose(i, 4)} dial +1 (269) 555-{3000 + i} {prose(i, 2)}") for i in range(30)] + [(250 + i, f"{prose(i, 4)} dial 555 {100 + i} 4444 {prose(i, 2)}") for i in range(10)]
    mixed = [f"user{i}@host{i}.example.org" if i % 2 else f"10.0.0.{i}" for i in range(30)]
    rows += [(300 + i, f"{prose(i, 4)} from {x} {prose(i, 2)}") for i, x in enumerate(mixed)] + [(400 + i, f"{prose(i, 4)} from {i}b {prose(i, 2)}") for i in range(10)]
    got = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._joined("spans").alias("s")).collect()}
    for d, text in rows:
        if 100 <= d < 200:
            assert got[d] == f"email:{text.index(escaped[d - 100])}:{text.index(escaped[d - 100]) + len(escaped[d - 100])}"
        if 250 <= d < 300:
            assert got[d] == f"phone:{text.index('555')}:{text.index('4444') + 4}"
        assert d < 400 or got[d] == ""


def test_redact_keeps_rows_and_columns(edge):
    out = pii.redact(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[15] == "mail [email] or [phone] from [ip] card [card]"


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_packing_round_trip(name, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    df = df.where(F.length(F.coalesce("text", F.lit(""))) < 150_000)
    model = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: model.encode(x or "", add_special_tokens=False).ids + [1] for d, x in pairs(df)}
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(df).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        whole[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(whole) == set(ids)
    for runs in [*whole.values(), *sequences.values()]:
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) <= 2048 for x in sequences.values())
    assert all(sum(n for _, n in whole[d]) == len(x) for d, x in ids.items())


def test_piece_codec_equals_tokenizer():
    import numpy as np

    codec = packing.PieceCodec(packing.default_tokenizer())
    r = random.Random(2)
    texts = ["".join(r.choice(" \n\tab1,'é  sll.²½\x1c\x85中\0") for _ in range(r.randrange(25))) for _ in range(3000)] + ["<|endoftext|> x", " ", "  ", "a  "]
    want = [np.array(x.ids, "<u4").tobytes() for x in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want


def test_byte_pairs_equal_tokenizer():
    import pyarrow as pa

    from tallyforge.llm.byte_pairs import BytePairs

    path, r = packing.default_tokenizer(), random.Random(6)
    assert BytePairs.covers(path)
    pairs, model = BytePairs(path), packing.PieceCodec(path).tokenizer
    every = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    draws = [("abcdethinors", 14), ("aA1\n,.-'é中½² \x1c\x85\0ßЖ", 12), ("ab", 90), (every, 5)]
    pieces = [r.choice(["", " "]) + "".join(r.choices(signs, k=r.randrange(most))) for signs, most in draws for _ in range(4000)]
    pieces += ["", " ", " \n", "\n", "a\n", "a\nb", "a\n\nb", "'s", "it's", " " + "x" * 62, "x" * 64, "x" * 100_000]
    ids, many, refused = pairs.encode(pa.array(pieces, pa.large_string()))
    at = 0
    for piece, n, no, want in zip(pieces, many.tolist(), refused.tolist(), model.encode_batch(pieces, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == ([] if no else want.ids), piece
        at += n
    assert at == len(ids) and not refused[:4000][[x != " " for x in pieces[:4000]]].any()
    assert [len(x) for x in pairs.encode(pa.array([], pa.large_string()))] == [0, 0, 0]


def test_plain_words_need_no_tokenizer(docs):
    """The tokenizer takes 14 microseconds a piece, so it should see few: none of plain prose."""
    codec, seen = packing.PieceCodec(packing.default_tokenizer()), []
    texts = [prose(i, 300) + "\nNew line, 12 words." for i in range(50)] + [x or "" for _, x in pairs(docs)]
    want = [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids = codec._ids
    codec._ids = lambda x: seen.extend(x) or ids(x)
    assert codec.encode(texts[:50]) == want[:50] and not seen
    assert codec.encode(texts) == want and len(seen) < 0.1 * len({w for t in texts for w in t.split(" ")})
    plain = packing.PieceCodec(packing.default_tokenizer())
    plain.pairs = None  # another kind of tokenizer takes all pieces
    assert plain.encode(texts) == want


def test_tournament_is_first_fit():
    r = random.Random(4)
    tree, free = packing.Tournament(200, 100), [100] * 200
    for _ in range(200):
        need = r.randrange(1, 101)
        first = next(i for i, x in enumerate(free) if x >= need)
        assert tree.place(need) == (first, free[first])
        free[first] -= need


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_lm_base_scores(name, request):
    df = request.getfixturevalue(name)
    want = brute.lm_base(pairs(df))
    got = lm_scoring.score(df).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


def test_lm_paths_agree_and_beat_the_base_on_held_out_text(docs):
    a = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    b = {r.doc_id: r.score for r in lm_scoring.score(docs, filter_bytes=0).collect()}
    assert all(r.score == b[d] for d, r in a.items())
    held = [r for r in a.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_never_loses_a_count():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 1000, 5000)
    counts[:3] = [5_000_000_000, 2**40 + 1, 2**62]
    got = lm_scoring.probe(lm_scoring.build_segment(keys, counts), keys)
    assert (got >= lm_scoring.levels_of(counts)).all() and (got == lm_scoring.levels_of(counts)).mean() > 0.99
    near = lm_scoring.quantised(got[:3])
    assert (near <= counts[:3] * 1.01).all() and (near * 1.42 >= counts[:3]).all()
    others = np.random.default_rng(3).integers(1 << 40, 1 << 41, 50_000).astype(np.uint64)
    assert (lm_scoring.probe(lm_scoring.build_segment(keys, counts), others) > 0).mean() < 0.005


def test_counts_beyond_32_bits_survive():
    import numpy as np

    keys, counts = np.array([3, 9], np.uint64), np.array([5_000_000_000, 7], np.int64)
    for order in (1, 2):
        got = lm_scoring.merged(order, [lm_scoring._packed(keys, order)] * 2, [common.pack_counts(counts)] * 2)
        assert got[0].tolist() == [3, 9] and got[1].tolist() == [10_000_000_000, 14]
    for x in ([0], [], [255, 256], [65536], [1, 2**40]):
        assert common.unpack_counts(common.pack_counts(np.array(x, np.int64))).tolist() == x


def test_lm_repeated_rows_and_null_ids(spark):
    rows = [(None, prose(1, 40))] * 3 + [(1, prose(2, 30))] * 2 + [(2, prose(1, 40)), (5, None), (None, None)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((d, len(brute.words(t)) + 1)) for d, t in rows)
    assert len({(r.doc_id, r.n_tokens, r.base_score, r.score) for r in got}) == len(set(rows))


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_regular_words_and_lines_are_told_apart(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    run, back = " ".join(thue_morse(2048, "x", "y")), " ".join(thue_morse(2048, "y", "x"))
    around = prose(1, 12)
    rows = [(1, f"{around} {one} {around}"), (2, f"{around} {two} {around}"), (3, f"{one} k\n{two} k\n{prose(4, 15)}"), (4, run), (5, back), (6, "z " * 5 + one), (7, "z " * 5 + two)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    assert sorted(map(tuple, substring_dedup.dedup_substrings(df).collect())) == sorted(brute.substring_dedup(rows))
    for r in quality_rules.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(rows[r.doc_id - 1][1])
    want = brute.lm_base(rows)
    assert all(r.n_known == want[r.doc_id][2] and r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) for r in lm_scoring.score(df).collect())
    import pyarrow as pa

    assert len(set(near_dedup.shingles(pa.array([run, back, one, two]))[3].tolist())) == 4


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_near_duplicate_classes(name, request):
    df = request.getfixturevalue(name)
    want = brute.near_classes(pairs(df))
    got = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.stays for r in got) == len(set(want.values()))


def test_near_duplicates_in_a_large_group(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = base[:]
        for _ in range(r.randrange(1, 6)):
            copy[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(f"z{i}_{j}" for j in range(50))) for i in range(5)] + [(300, rows[5][1]), (301, None), (302, "")]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    rows = [(None, prose(1, 40))] * 2 + [(None, prose(2, 40)), (7, prose(1, 40)), (7, prose(1, 40)), (9, prose(3, 40)), (None, None), (None, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_classes(rows)
    assert sorted(str((r.doc_id, r.class_id)) for r in got) == sorted(str((d, want[d if d is not None else ("null", i)])) for i, (d, _) in enumerate(rows))


def test_near_duplicate_recall(spark, monkeypatch):
    """Pairs from 0.8 up, each of its own class: at least 0.9 are found (bands alone, no chance of help by others)."""
    r = random.Random(77)
    rows = []
    for i in range(400):
        base = [f"v{i}_{j}" for j in range(200)]
        copy = base[:]
        for at in r.sample(range(200), r.randrange(1, 7)):
            copy[at] = f"new{i}_{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs_ = [(a, b, w) for a, b, w, _ in brute.near_pairs(rows)]
    linked = [(a, b) for a, b, w in pairs_ if w >= 0.8]
    assert len(linked) > 250 and sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    assert all(got[a] != got[b] for a, b, w in pairs_ if w < 0.8 - 1e-3)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    test_near_duplicates_in_a_large_group(spark)


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(700)] + [(i, [0.5] * 16) for i in range(700, 720)]
    rows += [(800, None), (900, [1.0, None]), (1000, [float("nan")] * 16), (1100, [float("inf")] * 16), (1200, [1.0, 2.0]), (None, [1.0] * 16), (1300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == brute.top_k(rows)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(few, few.where("vec_id % 100 = 0")).collect())) == brute.top_k(rows[:4])
    none = df.where("vec_id < 0")
    assert topk_search.top_k(none, none).count() == 0


def test_top_k_stops_on_proof(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow()
    found = np.floor(1024 * np.array(rows["embedding"].to_pylist(), float)).astype(np.int64)
    ids = rows["vec_id"].to_numpy()
    index = topk_search.ImpactIndex(ids, found)
    shares = []
    for i in range(0, len(ids), 50):
        index.read = 0
        got, scores = index.search(found[i], ids[i], 10)
        shares.append(index.read / found.size)
        every = found @ found[i]
        want = [x for x in np.lexsort([ids, -every]) if ids[x] != ids[i]][:10]
        assert got.tolist() == ids[want].tolist() and scores.tolist() == every[want].tolist()
    assert np.mean(shares) < 0.7 and index.rescored < 0.25 * len(ids) * len(shares)


def test_license_scan(spark, edge, empty):
    apache = license_scan.TEMPLATES["apache-2.0"]
    rows = [(1, f"{prose(1, 50)}\n{apache}\n{prose(2, 50)}"), (2, apache.replace("compliance", "accordance").replace("WARRANTIES", "GUARANTEES")), (3, prose(3, 80)), (4, "released UNDER the mit license"), (5, "licensed under the sea"), (6, None)]
    rows.append((7, prose(5, 300) + " license under the version apache " * 3 + " Licensed under the Apache License, Version 2.0. " + prose(6, 300)))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 8)] == ["apache-2.0", "apache-2.0-notice", None, "mit-notice", None, None, "apache-2.0-notice"]
    only = {"apache-2.0": apache}
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), only).collect()}
    assert got[1].coverage == 1.0 and 0.9 < got[2].coverage < 1 and rows[0][1][got[1].start : got[1].end] == apache[:-1]
    assert license_scan.scan(edge).count() == edge.count() and license_scan.scan(empty).count() == 0


def test_license_scan_lists_every_verbatim_notice(docs):
    words = lambda t: [w.lower() for w in license_scan.WORD.findall(t or "")]
    texts = dict(pairs(docs))
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert set(got) == set(texts)
    seen = 0
    for d, t in texts.items():
        spans = [(n, int(a), int(b)) for n, a, b in (x.rsplit(":", 2) for x in got[d].matches.split(",") if x)]
        assert got[d].n_matches == len(spans) and (got[d].license is None) == (not spans)
        own, places = words(t), [m.span() for m in license_scan.WORD.finditer(t or "")]
        for name, template in license_scan.TEMPLATES.items():
            side = words(template)
            for i in range(len(own) - len(side) + 1):
                if own[i : i + len(side)] == side:
                    seen += 1
                    assert any(a <= places[i][0] and places[i + len(side) - 1][1] <= b for _, a, b in spans), (d, name)
    assert seen > 0


def test_license_texts_that_repeat_and_mix(spark, empty):
    t = license_scan.TEMPLATES
    text = "\n".join([prose(1, 30), t["mit"], prose(2, 20), t["bsd-3-clause"], t["mit"], prose(3, 10), t["mit-notice"], t["zlib"].replace("warranty", "promise"), t["mit"]])
    rows = [(1, text), (1, text), (2, ""), (None, t["isc"]), (3, (prose(4, 400) + " " + t["mpl-2.0"] + " ") * 20)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = lambda r: [x.split(":")[0] for x in r.matches.split(",") if x]
    assert names(got[0]) == ["mit", "bsd-3-clause", "mit", "mit-notice", "zlib", "mit"] and got[0] == got[1]
    assert names(got[2]) == [] and got[3].license == "isc" and got[3].doc_id is None and names(got[4]) == ["mpl-2.0"] * 20
    assert license_scan.scan(empty).collect() == []


def test_alignment_of_distinct_words_is_the_longest():
    r = random.Random(16)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    for _ in range(150):
        b = r.sample(range(60), r.randrange(1, 40))
        a = r.sample(range(60), r.randrange(1, 40))
        assert len(license_scan.align([str(x) for x in a], [str(x) for x in b])) == lcs(a, b)
    near = 0
    for name, template in license_scan.TEMPLATES.items():
        b = license_scan.WORD.findall(template.lower())
        for _ in range(5):
            a = [w if r.random() > 0.08 else r.choice(b + ["zz"]) for w in b for _ in range(r.choice([1] * 20 + [0, 2]))]
            got, best = len(license_scan.align(a, b)), lcs(a, b)
            assert got <= best
            near += got >= 0.95 * best
    assert near >= 0.95 * 5 * len(license_scan.TEMPLATES)


def test_license_notices_that_repeat():
    words = lambda t: [w.lower() for w in license_scan.WORD.findall(t)]
    apache, gpl = [words(license_scan.TEMPLATES[x]) for x in ("apache-2.0-notice", "gpl-3.0-notice")]
    filler = words(prose(1, 60))
    assert len(license_scan.regional(filler + words("licensed content.") + filler + apache * 2 + filler, apache)) == len(apache)
    near = words("The work is licensed under the GNU General Public License, version 3.")
    assert len(license_scan.regional(["this", *filler, *near, *filler, *near, *filler], gpl)) == len(gpl) - 1


def test_alignment_is_increasing_and_close_to_the_longest():
    r = random.Random(6)
    for _ in range(200):
        a, b = [r.choice("abcdefghij") for _ in range(r.randrange(25))], [r.choice("abcdefghij") for _ in range(r.randrange(15))]
        got = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    values = [r.randrange(100) for _ in range(60)]
    best = [1] * 60
    for i in range(60):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    assert len(license_scan.increasing(values)) == max(best)


def test_language_id(spark, docs, edge, empty):
    out = language_id.identify(language_id.document_evidence(docs, F.struct("doc_id", "lang")))
    rows = out.select("row.*", "language", "posterior", "kept").collect()
    assert len(rows) == docs.count() and sum(r.lang == r.language for r in rows) >= 0.99 * len(rows) and all(r.kept for r in rows)
    flipped = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(language_id.document_evidence(flipped, F.struct("doc_id"))).select("row.doc_id", "language").collect()
    assert sum(truth[r.doc_id] == r.language for r in got) >= 0.97 * len(got)
    bad = {r.doc_id: r.kept for r in language_id.identify(language_id.document_evidence(edge, F.struct("doc_id"))).select("row.doc_id", "kept").collect()}
    assert len(bad) == edge.count() and not bad[0] and not bad[1] and not bad[14] and bad[6]
    assert language_id.identify(language_id.document_evidence(empty, F.struct("doc_id"))).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = language_id.page_evidence(pages).select("declared", "suffix", "host", "parent").collect()
    assert all(r.host.endswith(r.suffix) and r.host.endswith(r.parent) and r.declared for r in seen)


def test_language_id_models_every_declared_language(spark, docs):
    rare = [(10**6 + i, f"{''.join(chr(0x10D0 + (7 * i + j) % 33) for j in range(9))} " * 20, "ka", "src0", 200) for i in range(8)]
    many = docs.unionByName(docs.where("lang = 'en'").crossJoin(spark.range(80)).drop("id"))
    both = many.unionByName(spark.createDataFrame(rare, docs.schema))
    assert both.count() * 0.005 > len(rare)
    out = language_id.identify(language_id.document_evidence(both, F.struct("doc_id", "lang"))).select("row.*", "language", "kept").collect()
    assert all(r.language == "ka" and r.kept for r in out if r.lang == "ka") and sum(r.lang == "ka" for r in out) == len(rare)


def test_language_id_judges_pages_by_all_evidence(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = language_id.op8_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in out if r.kind == "document") == sorted(r.doc_id for r in docs.collect())
    assert sorted(r.page_id for r in out if r.kind == "page") == sorted(r.page_id for r in pages.collect())
    assert all(r.language == r.declared and r.kept for r in out if r.kind == "page")
    rows = language_id.page_evidence(spark.createDataFrame([(i, f"http://{'a.de' if i % 2 else 'b.fr'}/{i}", f"<html lang={['fr', 'de'][i % 2]}>{prose(i, 20)}") for i in range(40)] + [(90, "http://c.de/1", "<p>oak</p>"), (91, "http://c.fr/1", "<p>oak</p>")], pages.select("page_id", "url", "html").schema))
    got = {r.page_id: r.language for r in language_id.identify(rows).select("row.page_id", "language").collect()}
    assert got[90] == "de" and got[91] == "fr"


def test_language_id_against_brute_force(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60)
    evidence = language_id.page_evidence(pages, F.col("page_id").cast("long")).unionByName(language_id.document_evidence(docs.where("n_chars < 4000"), F.col("doc_id").cast("long") + 10**6))
    odd = [(-1, "oak pine", None, "de", "x.de", "x.de"), (-2, None, "en", None, None, None), (-3, "xq zvk jjw qqk", "en", "fr", "a.fr", "a.fr"), (-4, "qpx vvz", None, None, None, None)]
    rows = evidence.unionByName(spark.createDataFrame(odd, "row long, text string, declared string, suffix string, host string, parent string")).collect()
    got = {r.row: r for r in language_id.identify(spark.createDataFrame(rows, "row long, text string, declared string, suffix string, host string, parent string")).collect()}
    want = brute.languages([(r.text, r.declared, r.suffix, r.host, r.parent) for r in rows], language_id.SUFFIXES)
    for r, (language, posterior, letters) in zip(rows, want, strict=True):
        assert got[r.row].posterior == pytest.approx(posterior, rel=1e-2, abs=1e-9), r.row
        assert got[r.row].language == language or posterior < 0.51
        assert got[r.row].kept == (letters and posterior >= 0.5) or abs(posterior - 0.5) < 0.01


def test_language_id_rejects_what_no_language_explains(spark, docs):
    r = random.Random(12)
    junk = ["".join(r.choice("qxzjkvwpbg ") for _ in range(400)) for _ in range(20)] + [" ".join(chr(0x10D0 + r.randrange(33)) * 5 for _ in range(40)) for _ in range(5)]
    rows = [(10**6 + i, t, "en" if i < 20 and i % 2 else None, f"src{i % 3}", len(t)) for i, t in enumerate(junk)]
    out = language_id.identify(language_id.document_evidence(docs.unionByName(spark.createDataFrame(rows, docs.schema)), F.struct("doc_id"))).select("row.doc_id", "kept").collect()
    kept = {x.doc_id for x in out if x.kept}
    assert {d for d in kept if d >= 10**6} == set() and kept == {x.doc_id for x in docs.collect()}


def test_language_id_with_declarations_withheld(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    out = language_id.identify(language_id.document_evidence(hidden, F.struct("doc_id"))).select("row.doc_id", "language", "kept").where("row.doc_id % 5 = 0").collect()
    assert len(out) >= 30 and sum(r.language == truth[r.doc_id] and r.kept for r in out) >= 0.97 * len(out)


def test_language_blocks_agree(spark, docs, monkeypatch):
    rows = language_id.document_evidence(docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 40).cast("string"))), F.struct("doc_id"))
    got = []
    for block in (64, 200, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got.append({r.doc_id: (r.language, round(r.posterior, 6), r.kept) for r in language_id.identify(rows).select("row.doc_id", "language", "posterior", "kept").collect()})
    assert rows.select("declared").distinct().count() > 64 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    out = mixing.mix_sources(df)
    assert out.columns[: len([c for c in df.columns if c != "_size"])] == [c for c in df.columns if c != "_size"]
    rows = out.collect()
    sizes = defaultdict(int)
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(brute.words(r.text))
    want, taken, smallest = brute.targets(dict(sizes)), defaultdict(int), defaultdict(lambda: 10**9)
    assert len(rows) == df.count()
    for r in rows:
        assert r._source_size == sizes[r.source] and r._target == pytest.approx(want[r.source]) and 0 <= r._copies <= 3
        taken[r.source] += r._copies * r._size
        if r._size:
            smallest[r.source] = min(smallest[r.source], r._size)
    again = {(r.doc_id, r._copies) for r in mixing.mix_sources(df).collect()}
    assert again == {(r.doc_id, r._copies) for r in rows}
    if name == "docs":
        assert {s: (taken[s], want[s]) for s in want if abs(taken[s] - want[s]) > max(60, 0.02 * want[s])} == {}


def test_mixing_caps_and_ties(spark):
    rows = [(i, prose(i, 20), "big", 0) for i in range(900)] + [(1000 + i, prose(i, 10), "small", 0) for i in range(3)] + [(2000, prose(1, 15), None, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    sizes = {"big": 18000, "small": 30, None: 30}
    want = brute.targets(sizes)
    taken = defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        assert r._target == pytest.approx(want[r.source])
        taken[r.source] += r._copies * r._size
    assert taken["small"] == want["small"] == 90 and taken[None] == 90 and abs(taken["big"] - want["big"]) <= 200


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_quality_counts(name, request):
    df = request.getfixturevalue(name)
    texts = dict(pairs(df))
    got = quality_rules.judge(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_rejects_planted_outliers_only(spark):
    rows = [(i, prose(i, 200), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 200).split()), "en", "s") for i in range(20)]
    rows += [(2000 + i, prose(i + 400, 200), None, f"tiny{i}") for i in range(50)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [d for d, k in got.items() if not k] and all(k == (not 1000 <= d < 2000) for d, k in got.items() if d < 2000)
    assert all(k for d, k in got.items() if d >= 2000)


def test_mixing_rates_solve_the_dual(spark):
    r = random.Random(21)
    sizes = {"a": [1 + int(r.paretovariate(0.8)) for _ in range(700)], "b": [r.randrange(1, 40) for _ in range(500)], "c": [5] * 40, None: [r.choice([1, 3000]) for _ in range(300)], "d": [0, 0]}
    rows = [(f"{s}{i}", s, min(n, 20_000)) for s, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame([(i, x, s, n) for i, (x, s, n) in enumerate(rows)], "doc_id long, text string, source string, n long")
    got = mixing.mix_sources(df, F.col("n")).collect()
    want = brute.targets({s: sum(n for _, t, n in rows if t == s) for s in sizes})
    for s, target in want.items():
        own = [x for x in got if x.source == s]
        rate = lambda m: sum(x.n * min(3.0, math.exp(min(m * x.n, 50))) for x in own)
        low, high = -50.0, 50.0
        for _ in range(200):
            low, high = (low, (low + high) / 2) if rate((low + high) / 2) > target else ((low + high) / 2, high)
        assert sum(x.n * x._rate for x in own) == pytest.approx(target, rel=1e-6)
        if target < 3 * sum(x.n for x in own):
            assert all(x._rate == pytest.approx(min(3.0, math.exp(min(low * x.n, 50))), rel=1e-4, abs=1e-9) for x in own)
        assert abs(sum(x._copies * x.n for x in own) - target) <= 0.01 * target + 60


def test_mixing_targets_of_many_sources(spark):
    r = random.Random(2)
    sizes = {f"s{i:03d}": r.choice([1, 5, 100, 4000]) * r.randrange(1, 9) for i in range(400)} | {None: 7, "é": 3, "𝄞": 3000, "ﬀ": 5}
    sums = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    want = brute.targets(sizes)
    assert {x.source: pytest.approx(x.target) for x in mixing.source_targets(sums).collect()} == want


def test_quality_distances_against_brute_force(docs):
    rows = quality_rules.judge(docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))).where("NOT base_failed").collect()
    share = lambda a, b: math.log1p(100 * a / b)
    vectors = [[math.log(r.word_chars / r.n_words), share(r.n_symbols, r.word_chars), share(r.n_dup_lines, r.n_words), share(r.n_repeat_words, r.n_words)] for r in rows]
    want = brute.robust_distances(vectors, quality_rules.FLOOR)
    for r, d in zip(rows, want, strict=True):
        assert r.distance == pytest.approx(d, rel=1e-6, abs=1e-6) and r.kept == (d <= quality_rules.CUTOFF)


def test_quality_repeated_rows_and_pools(spark, empty):
    rows = [(1, prose(1, 90), "en", "s")] * 3 + [(None, prose(i, 60), "en", "s") for i in range(60)] + [(5, None, None, None)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and len({(r.kept, r.distance) for r in got if r.doc_id == 1}) == 1
    assert {r.pool for r in got if r.lang == "en"} == {'{"lang":"en","source":"s"}'} and [r.kept for r in got if r.doc_id == 5] == [False]
    assert quality_rules.judge(empty).collect() == []


def test_pii_contexts_are_whole_words(spark):
    word = "w" * 5000
    text = f"{word} a1 {'v' * 100} b@c.de {word}\n{'u' * 63} 10.0.0.1 {'t' * 64} c3"
    seen = {x.m: (x.left, x.right) for x in pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().seen}
    assert seen["a1"] == (word, "v" * 100) and seen["b@c.de"] == ("v" * 100, word) and seen["10.0.0.1"] == ("u" * 63, "t" * 64) and seen["c3"] == ("t" * 64, "")


def test_pii_repeated_rows_get_the_same_spans(spark):
    rows = [(1, "mail a@b.de"), (1, "mail a@b.de"), (None, "mail a@b.de"), (1, None)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._joined("spans").alias("s")).collect()
    assert sorted(map(str, ((r.doc_id, r.s) for r in got))) == sorted(map(str, [(1, "email:5:11"), (1, "email:5:11"), (None, "email:5:11"), (1, "")]))


def test_packing_long_texts_repeats_and_null_ids(spark):
    rows = [(None, prose(1, 50)), (None, prose(1, 50)), (3, "x" * 200_000), (4, prose(4, 30_000)), (5, None), (5, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(str((d, len(model.encode(t or "", add_special_tokens=False).ids) + 1)) for d, t in rows)
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_packing_wastes_little_and_is_first_fit_decreasing(spark, docs):
    size, got = 2048, packing.pack(docs).collect()
    tails, groups = [r for r in got if r.length < size], defaultdict(list)
    for r in tails:
        groups[r.sequence_id >> 32].append(r)
    for rows in groups.values():
        free, order = [], sorted(rows, key=lambda r: -r.length)
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append(r.length)
        for r in order:
            spot = next((i for i, f in enumerate(free) if f >= r.length), None)
            if spot is None:
                free.append(size)
                spot = len(free) - 1
            free[spot] -= r.length
        assert sorted(size - sum(x) for x in bins.values()) == sorted(free)
    used = len({r.sequence_id for r in got})
    assert sum(r.length for r in got) >= 0.75 * used * size
