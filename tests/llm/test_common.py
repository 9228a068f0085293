import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import common

from . import brute


def test_sorted_values_round_trip():
    for values in ([0], [5], [0, 1, 2**32 - 1], [3, 2**24 + 2], [3, 2**24 + 3], sorted(random.Random(1).sample(range(2**32), 5000))):
        x = np.array(values, np.uint64)
        assert common.unpack_sorted(common.pack_sorted(x)).tolist() == values
    x = np.random.default_rng(2).integers(0, 1 << 40, 100).astype(np.uint64)
    assert common.unpack40(common.pack40(x)).tolist() == x.tolist()


def test_words_are_split_as_the_contract_says():
    r = random.Random(3)
    texts = ["".join(r.choice("ab \t\n\x0b\x0c\r\x1c\x85é𝄞") for _ in range(r.randrange(30))) for _ in range(500)] + [None, "", " ", "x"]
    column = pa.array(texts, pa.string())
    data, offsets = common.text_buffer(column)
    starts, ends, before = common.word_bounds(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        assert [raw[s:e].decode() for s, e in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]])] == brute.words(t)
    hashes, counts = common.word_hashes(column.slice(3, 200))
    assert counts.tolist() == np.cumsum([0] + [len(brute.words(t)) for t in texts[3:203]]).tolist()
    seen = {}
    for h, w in zip(hashes.tolist(), [w for t in texts[3:203] for w in brute.words(t)], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows_and_keep_long_ones_whole():
    offsets = np.array([0, 10, 10, 500, 505, 900, 901])
    got = list(common.slices(offsets, 100))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == 6


def test_small_sides_only_are_broadcast(spark):
    big = spark.range(20).selectExpr("CASE WHEN id > 1 THEN id % 5 END AS k", "id")
    small = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "k long, v string")
    for bound, node in ((10, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        out = common.join_checked(big, small, ["k"], bound=bound)
        assert node in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.k, r.v) for r in out.collect()} == {(None, "n"), (0, None), (1, "a"), (2, "b"), (3, None), (4, None)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
