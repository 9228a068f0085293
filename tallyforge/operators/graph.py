"""Call graphs as edge tables: reachability, paths, roots, contraction, propagation.

Traversals are driver loops over frontiers: each level is one join of the frontier with
the edges and one anti-join with what is visited. Lineage is cut each level.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoints in the folder of spark.checkpoint.dir (the warehouse where it is unset)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int = 16) -> DataFrame:
    """node, depth, parent, root: first discovery in breadth-first order from all sources.

    ``edges``: src, dst, ordinal of dst among src's neighbours. ``sources``: node, ordinal.
    Ties go to the parent earlier in the queue, then to the smaller child ordinal.
    """
    # ``queue``: a node's place in the queue as the path of (ordinal, name) steps to it; paths of one level have one length
    step = lambda node: F.array(F.struct(F.col("ordinal").cast("long").alias("o"), F.col(node).cast("string").alias("n")))
    frontier = sources.groupBy("node").agg(F.min("ordinal").alias("ordinal"))
    frontier = _cut(frontier.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.col("node").alias("root"), step("node").alias("queue")))
    seen = frontier
    for depth in range(1, max_depth + 1):
        tried = frontier.select(F.col("node").alias("src"), "root", "queue").join(edges, "src").withColumn("queue", F.concat("queue", step("dst")))
        found = tried.groupBy("dst").agg(F.min("queue").alias("queue"), F.min_by("src", "queue").alias("parent"), F.min_by("root", "queue").alias("root"))
        found = found.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        frontier = _cut(found.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent", "root", "queue"))
        if not frontier.head(1):
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """src, dst, depth: every reachable pair with its least number of steps (semi-naive, to the fixpoint)."""
    one = edges.select("src", "dst").distinct()
    delta = _cut(one.withColumn("depth", F.lit(1)))
    seen = delta
    for depth in itertools.count(2):
        step = delta.select("src", F.col("dst").alias("mid")).join(one.select(F.col("src").alias("mid"), "dst"), "mid")
        delta = _cut(step.select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if not delta.head(1):
            break
        seen = _cut(seen.unionByName(delta))
    return seen


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node calls."""
    called = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    return nodes.join(called, "node", "left_anti")


def contract(edges: DataFrame, transparent: DataFrame) -> DataFrame:
    """Adds caller-to-callee shortcuts across chains of transparent nodes; keeps the edges."""
    through = edges.join(transparent.select(F.col("node").alias("src")), "src", "left_semi")
    reach = closure(through)
    last = reach.where(F.col("src") != F.col("dst")).select(F.col("src").alias("mid"), "dst")
    short = edges.select("src", F.col("dst").alias("mid")).join(last, "mid").where("src <> dst").select("src", "dst")
    return edges.select("src", "dst").unionByName(short).distinct()


def simple_paths(edges: DataFrame, source: str, target: str, max_depth: int, limit: int) -> DataFrame:
    """Up to ``limit`` simple paths by (length, path); each level extends paths by one node."""
    paths = edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>")
    found = None
    for _ in range(max_depth):
        paths = _cut(paths.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        done = paths.where(F.col("node") == target)
        found = done if found is None else found.unionByName(done)
        paths = paths.where(F.col("node") != target)
        if not paths.head(1):
            break
    return found.select("path", F.size("path").alias("nodes")).orderBy("nodes", F.array_join("path", "\n")).limit(limit)


def propagate(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """node, depth: nodes that a mark reaches over edges in either direction, to the fixpoint."""
    both = _cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    frontier = _cut(marked.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in itertools.count(1):
        found = frontier.select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct()
        frontier = _cut(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


#: Blocks and dominators of a tile at most, pairs dealt out together, pairs of a task, and ids that a batch of tiles holds.
PART, RUN, DEAL, TASK, BATCH = 4096, 512, 1 << 22, 1 << 25, 1 << 19


def dominator_tree(entry: Sequence[bool], successors: Sequence[Sequence[int]]) -> tuple[list[int], list[int]]:
    """(parents, order) of blocks 0 .. n - 1: immediate dominators, -1 for roots, and the reachable blocks, parents first.

    Roots are the entries and the blocks that nothing leads to. Immediate dominators are
    refined in reverse post-order until none changes (Cooper, Harvey and Kennedy).
    """
    n = len(entry)
    before: list[list[int]] = [[] for _ in range(n)]
    for b, nexts in enumerate(successors):
        for s in nexts:
            before[s].append(b)
    top = [b for b in range(n) if entry[b] or not before[b]]
    state, post = bytearray(n), []
    for root in top:
        stack = [(root, iter(successors[root]))] if not state[root] else []
        state[root] = 1
        while stack:
            b, rest = stack[-1]
            for s in rest:
                if not state[s]:
                    state[s] = 1
                    stack.append((s, iter(successors[s])))
                    break
            else:
                post.append(stack.pop()[0])
    order = post[::-1]
    place = [0] * n  # 0: above all roots
    for i, b in enumerate(order, 1):
        place[b] = i
    up = [0] * (len(order) + 1)  # by place
    fixed, known = {place[b] for b in top}, bytearray(len(order) + 1)
    for i in fixed:
        known[i] = 1
    changed = True
    while changed:
        changed = False
        for i, b in enumerate(order, 1):
            if i in fixed:
                continue
            best = -1
            for q in before[b]:
                j = place[q]
                if not j or not known[j]:
                    continue
                while best >= 0 and best != j:
                    if best > j:
                        best = up[best]
                    else:
                        j = up[j]
                best = j
            if not known[i] or up[i] != best:
                up[i], known[i], changed = best, 1, True
    parents = [-1] * n
    for i, b in enumerate(order, 1):
        parents[b] = order[up[i] - 1] if up[i] else -1
    return parents, order


def dominator_depths(parents: Sequence[int], order: Sequence[int]) -> list[int]:
    """How many blocks dominate each reachable block, itself included; 0 for the others."""
    depth = [0] * len(parents)
    for b in order:
        depth[b] = depth[parents[b]] + 1 if parents[b] >= 0 else 1
    return depth


def dominator_tiles(parents: Sequence[int], order: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(blocks, dominators), each pair of the two once over all tiles: what dominates all blocks of a run, then of its halves.

    A run is consecutive in the tree's preorder, so its common dominators are the start of
    its first block's path: those whose subtrees end with the run or later.
    """
    n, depth = len(parents), dominator_depths(parents, order)
    below: list[list[int]] = [[] for _ in range(n)]
    stack, size = [], [1] * n
    for b in order:
        (below[parents[b]] if parents[b] >= 0 else stack).append(b)
    for b in reversed(order):
        if parents[b] >= 0:
            size[parents[b]] += size[b]
    line: list[int] = []
    while stack:
        line.append(b := stack.pop())
        stack += below[b]
    blocks, path, ends, at = np.array(line, np.int64), np.zeros(n, np.int64), [0] * n, 0

    def tiles(who: np.ndarray, doms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(who), PART):
            for j in range(0, len(doms), RUN):
                yield who[i : i + PART], doms[j : j + RUN].copy()

    runs = [(0, len(line), 0)] if line else []
    while runs:
        low, high, have = runs.pop()
        while at <= low:  # runs start further on each time
            path[depth[line[at]] - 1], ends[depth[line[at]] - 1] = line[at], at + size[line[at]]
            at += 1
        common, top = have, depth[line[low]]
        while common < top:
            middle = (common + top) // 2
            common, top = (middle + 1, top) if ends[middle] >= high else (common, middle)
        yield from tiles(blocks[low:high], path[have:common])
        if high - low > 1:
            middle = (low + high) // 2
            runs += [(middle, high, common), (low, middle, common)]
    if len(line) < n:
        yield from tiles(np.array([b for b in range(n) if not depth[b]], np.int64), np.arange(n))


def dominators(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, dominator. ``blocks``: keys, block, entry flag, successors array.

    A graph's tree of immediate dominators is sequential work and small; its pairs can be
    many more than its blocks. So they leave as tiles, blocks by dominators, which are dealt
    to as many tasks as their pairs need and unfold there. In a tile a block stays the same
    for a run of rows and the run repeats, so files of many pairs stay small. A block that
    no root reaches is dominated by all blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def tree(rows: pa.Table) -> tuple[pa.Array, list[int], list[int]]:  # ids, and their tree
        names = rows["block"].combine_chunks()
        at: dict = {}
        for b in names.to_pylist():
            at.setdefault(b, len(at))
        first, entry, nexts = [-1] * len(at), [False] * len(at), [[] for _ in at]
        for i, (b, e, s) in enumerate(zip(names.to_pylist(), rows["entry"].to_pylist(), rows["successors"].to_pylist(), strict=True)):
            first[at[b]], entry[at[b]] = i, entry[at[b]] or bool(e)
            nexts[at[b]] += [at[x] for x in s or [] if x in at]
        return names.take(pa.array(first)), *dominator_tree(entry, nexts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parents, order = tree(pa.Table.from_batches(list(batches)))
        n = len(parents)
        yield pa.RecordBatch.from_pydict({"pairs": pa.array([float(sum(dominator_depths(parents, order)) + (n - len(order)) * n)])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        names, parents, order = tree(rows)
        same = {k: rows[k].combine_chunks().slice(0, 1) for k in keys}

        def batch(deals: list[int], *sides: list[np.ndarray]) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), names.take(pa.array(np.concatenate(x)))) for x in sides]
            zeros = pa.array(np.zeros(len(deals), np.int64))
            return pa.RecordBatch.from_arrays([*[same[k].take(zeros) for k in keys], pa.array(deals, pa.int64()), *lists], [*keys, "_deal", "blocks", "dominators"])

        deals, who, doms, held, pairs = [], [], [], 0, 0
        for b, x in dominator_tiles(parents, order):
            deals.append(pairs // DEAL)
            who.append(b)
            doms.append(x)
            pairs, held = pairs + len(b) * len(x), held + len(b) + len(x)
            if held >= BATCH:
                yield batch(deals, who, doms)
                deals, who, doms, held = [], [], [], 0
        if who:
            yield batch(deals, who, doms)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            (who, b), (doms, x) = ((c.values, c.offsets.to_numpy().tolist()) for c in (rows.column("blocks"), rows.column("dominators")))

            def batch(parts: list[tuple[np.ndarray, ...]], rows=rows, who=who, doms=doms) -> pa.RecordBatch:
                tile, block, long, ids = map(np.concatenate, zip(*parts, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]), pa.int32()), doms.take(pa.array(ids)))
                return pa.RecordBatch.from_arrays([*[rows.column(k).take(pa.array(tile)) for k in keys], who.take(pa.array(block)), lists], [*keys, "block", "dominators"])

            parts, held = [], 0
            for i in range(rows.num_rows):
                long = x[i + 1] - x[i]
                step = max(1, BATCH // long)
                for low in range(b[i], b[i + 1], step):
                    some = np.arange(low, min(low + step, b[i + 1]))
                    parts.append((np.full(len(some), i), some, np.full(len(some), long), np.tile(np.arange(x[i], x[i + 1]), len(some))))
                    held += len(some) * long
                    if held >= BATCH:
                        yield batch(parts)
                        parts, held = [], 0
            if parts:
                yield batch(parts)

    graphs = blocks.select(*keys, "block", "entry", "successors").groupBy(*keys)
    pairs = graphs.applyInArrow(count, "pairs double").agg(F.sum("pairs")).first()[0] or 0
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK))  # by bytes AQE would join tiles of many pairs
    tiles = graphs.applyInArrow(run, f"{head}, _deal long, blocks array<{kinds['block']}>, dominators array<{kinds['block']}>")
    unfolded = tiles.repartition(tasks, *keys, "_deal").mapInArrow(unfold, f"{head}, block {kinds['block']}, dominators array<{kinds['block']}>")
    return unfolded.select(*keys, "block", F.explode("dominators").alias("dominator"))


def transparent(nodes: DataFrame, tiny: int = 5) -> Column:
    """Thunks, wrappers, stubs, tiny single callers and plain forwarders."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = F.col("callees") == 1
    plain = ~flag("has_store") & ~flag("has_control") & ~flag("has_assignment") & F.col("label").isNull()
    return flag("is_thunk") | F.col("wrapper_type").isNotNull() | F.col("stub_kind").isNotNull() | ((F.col("line_count") <= tiny) & one) | (one & plain)


def degree_order(edges: DataFrame) -> DataFrame:
    """Edges with the ordinal of dst among its source's neighbours, by name."""
    return edges.select("src", "dst").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
