"""Exact nearest rows of a set of queries, by lists with box bounds.

The base is cut into lists, cells of a median-split tree fitted on a bounded sample. A query first searches the list it falls
into, which bounds the distance of its k-th neighbour; then only lists whose bounding box lies within that bound are searched.
A list of many rows, such as copies of one vector, is searched in pieces, and one that many queries ask by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import small, store

#: Rows of a list as planned, lists at most, and sample rows for each list at most.
LIST_SIZE, MAX_LISTS, SAMPLE = 2048, 32_768, 24
#: Base rows and queries that one task compares; rows of a block of either.
PIECE, ASKERS, BLOCK = 50_000, 50_000, 256


class Lists:
    """A median-split tree over vectors; its leaves are the lists."""

    def __init__(self, sample: np.ndarray, leaves: int):
        depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.depth, n = depth, (1 << depth) - 1
        self.dim, self.at = np.zeros(n, np.int32), np.full(n, np.inf)
        parts = [sample]
        for level in range(depth):
            below = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part) > 1:
                    self.dim[node] = np.argmax(part.max(0) - part.min(0))
                    self.at[node] = np.median(part[:, self.dim[node]])
                left = part[:, self.dim[node]] <= self.at[node]
                below += [part[left], part[~left]]
            parts = below

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)


def cells(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which every ``size`` consecutive ones are a cell of a median-split tree."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            continue
        own = order[lo:hi]
        part = x[own]
        dim = np.argmax(part.max(0) - part.min(0))
        # The cut falls between two blocks.
        half = size * max(1, (hi - lo) // size // 2)
        order[lo:hi] = own[np.argpartition(part[:, dim], half - 1)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


def best(i: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (distance, id) of each query row."""
    order = np.lexsort((ids, d2, i))
    s = i[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
    return order[rank < k]


def matrix(column) -> np.ndarray:
    """A list column of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def boxes_of(placed: DataFrame, dims: int, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, low, high): the bounding box of each list's vectors ``x``, turned if a rotation is given. One row a list is fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x, at = matrix(b["x"]), np.asarray(b["list"])
            x = x if turn is None else x @ turn
            order = np.argsort(at, kind="stable")
            begin = np.flatnonzero(np.r_[len(at) > 0, np.diff(at[order]) > 0])
            for n, lo, hi in zip(at[order][begin].tolist(), np.minimum.reduceat(x[order], begin), np.maximum.reduceat(x[order], begin), strict=True) if len(at) else ():
                old = found.get(n, (lo, hi))
                found[n] = (np.minimum(lo, old[0]), np.maximum(hi, old[1]))
        lo, hi = ([v[i].tolist() for v in found.values()] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(lo, pa.list_(pa.float64())), pa.array(hi, pa.list_(pa.float64()))], ["list", "lo", "hi"])

    # Each task leaves a row a list: of a list at most as many rows meet as there are tasks.
    got = placed.select("list", "x").mapInArrow(run, "list int, lo array<double>, hi array<double>").groupBy("list").agg(F.collect_list(F.struct("lo", "hi")).alias("all")).toArrow()
    names = np.asarray(got["list"])
    low = np.array([np.min([b["lo"] for b in r], axis=0) for r in got["all"].to_pylist()]).reshape(len(names), dims)
    high = np.array([np.max([b["hi"] for b in r], axis=0) for r in got["all"].to_pylist()]).reshape(len(names), dims)
    return names, low, high


def _compare(k: int):
    """The k nearest base rows of each asking query among one piece of a list; a query is not its own neighbour."""

    def run(asked: pa.Table, t: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "near": pa.array([], pa.int64())})
        if not len(asked) or not len(t):
            return none
        q, x = matrix(asked["x"]), matrix(t["x"])
        a, b = cells(q, BLOCK), cells(x, BLOCK)
        q, x, qid, ids, limit = q[a], x[b], np.asarray(asked["key"])[a], np.asarray(t["key"])[b], np.array(asked["reach"], np.float64)[a]
        starts = np.arange(0, len(x), BLOCK)
        low, high = (np.stack([f(x[s : s + BLOCK], axis=0) for s in starts]) for f in (np.min, np.max))
        out = []
        for lo in range(0, len(q), BLOCK):
            part, top = q[lo : lo + BLOCK], limit[lo : lo + BLOCK]
            gap = (np.maximum(0, np.maximum(low - part.max(0), part.min(0) - high)) ** 2).sum(1)
            i, j, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for s in starts[np.argsort(gap, kind="stable")].tolist():
                if gap[s // BLOCK] > top.max() * (1 + 1e-9):
                    break
                d = np.zeros((len(part), min(BLOCK, len(x) - s)))
                for n in range(x.shape[1]):
                    d += (part[:, n, None] - x[None, s : s + BLOCK, n]) ** 2
                d[qid[lo : lo + BLOCK, None] == ids[None, s : s + BLOCK]] = np.inf
                r, c = np.nonzero((d <= top[:, None]) & np.isfinite(d))
                i, j, d2 = np.r_[i, r], np.r_[j, c + s], np.r_[d2, d[r, c]]
                keep = best(i, ids[j], d2, k)
                i, j, d2 = i[keep], j[keep], d2[keep]
                last = np.flatnonzero(np.r_[i[1:] != i[:-1], True])[: len(i)]
                full = last[np.bincount(i, minlength=len(part))[i[last]] == k]
                top[i[full]] = np.minimum(top[i[full]], d2[full])
            out.append((qid[lo + i], d2, ids[j]))
        return pa.table(dict(zip(("query", "d2", "near"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _search(asks: DataFrame, placed: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """(query, d2, near) of asks (list, key, x, reach) in placed (list, key, x); pieces: (list, pieces)."""
    parts = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts"))
    plan = small(pieces.join(parts, "list"))  # a row a list
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asks.join(plan, "list").select("list", spread("key", "parts").alias("part"), every("pieces").alias("piece"), "key", "x", "reach")
    b = placed.join(plan, "list").select("list", spread("key", "pieces").alias("piece"), every("parts").alias("part"), "key", "x")
    keys = ["list", "piece", "part"]
    # Little data, much work: a stated number of partitions is not merged by size.
    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(n, *keys), b.repartition(n, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_compare(k), "query long, d2 double, near long")


def nearest_rows(queries: DataFrame, base: DataFrame, dims: int, *, k: int) -> DataFrame:
    """(query, rank, near, d2): the k nearest base rows of each query by squared distance, ties by the smaller key; exact.

    queries and base: (key long, x array<double>) of one length, free of null and NaN; a query is not its own neighbour. An
    empty side gives none. Both should be stored: the base is read several times.
    """
    spark = base.sparkSession
    total = base.count()
    lists = min(MAX_LISTS, max(1, math.ceil(total / LIST_SIZE)))
    share = SAMPLE * lists / max(1, total)
    sample = base.select("x")
    if share < 1:
        sample = base.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x")
    got = sample.toArrow()
    tree = Lists(matrix(got["x"]) if len(got) else np.zeros((0, dims)), lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["x"]) if b.num_rows else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([pa.array(tree.place(x), pa.int32()), b["key"], b["x"]], ["list", "key", "x"])

    schema = "list int, key long, x array<double>"
    placed = store(base.select("key", "x").mapInArrow(place, schema))
    pieces = store(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")))
    boxes = spark.sparkContext.broadcast(boxes_of(placed, dims))
    home = queries.select("key", "x").mapInArrow(place, schema).withColumn("reach", F.lit(float("inf")))
    first = store(_search(store(home), placed, pieces, k))
    reach = first.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("d2")).alias("d"))
    # A list in several pieces gives k rows each; the k-th of all is the bound.
    reach = reach.select("key", F.when(F.col("n") >= k, F.get("d", F.lit(k - 1))).otherwise(float("inf")).alias("reach"))
    known = home.drop("reach").join(reach, "key", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, low, high = boxes.value
        for b in batches:
            x, own, bound = matrix(b["x"]) if b.num_rows else np.zeros((0, dims)), np.asarray(b["list"]), np.asarray(b["reach"])
            for n, lo, hi in zip(where.tolist(), low, high, strict=True):
                hit = np.flatnonzero(((np.maximum(0, np.maximum(lo - x, x - hi)) ** 2).sum(1) <= bound * (1 + 1e-9)) & (own != n))
                if len(hit):
                    part = b.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), n), pa.int32()), part["key"], part["x"], part["reach"]], ["list", "key", "x", "reach"])

    asks = store(known.mapInArrow(probe, f"{schema}, reach double"))
    found = first.unionByName(_search(asks, placed, pieces, k)).distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d2", "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "near", "d2")
