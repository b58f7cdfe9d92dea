"""The k nearest vectors of every vector, by an adaptive dimension scan of probed lists.

Vectors are rotated by a fixed random rotation and placed in lists, the cells of a median-split tree
fitted on a bounded sample; inside a list they stand in blocks, cells of a finer tree over the list itself, so a long list
is searched by its nearest blocks first and not from end to end. A block is held as columns: the scan adds up squared
differences column by column and, after each few columns, tests every candidate: were it among the k nearest, its partial
distance would be at most a certain share of the k-th distance so far. The shares are calibrated on pairs of
neighbours of the sample, at a stated rate of error for each test, so they hold for any number of dimensions. Every
vector first searches its own list; the bounding boxes of the other lists tell which of them can hold a nearer
vector, and those are probed.

A candidate that the test rejects is done with where some loss is accepted. In exact mode it is put back: once the k-th
distance is final, those that it does not rule out by itself are computed to the end. The test then
saves the work that the shrinking distance would make needless, and no neighbour is lost.

Equal vectors are one entry of the index with its least ids, so a group of copies, however large,
costs one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.operators.lists import Lists, best, boxes_of, cells, matrix
from sondera.session import meet, small, store

#: Vectors of a list as planned, lists at most, and vectors of the sample for each list at most. Beyond MAX_LISTS * LIST_SIZE
#: vectors lists grow; the scan of a list then grows with its blocks near a query, not with its length.
LIST_SIZE, MAX_LISTS, SAMPLE = 8192, 32_768, 24
#: Rows of queries scanned together, rows and columns of a block.
QUERIES, BLOCK, COLUMNS = 128, 128, 2
#: Vectors that one task asks of one list.
ASKERS = 100_000
#: Sample rows whose neighbours calibrate the test.
CALIBRATION = 1500


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def calibrated(sample: np.ndarray, k: int, miss: float) -> np.ndarray:
    """Entry n: the share of the squared distance that the first n columns of near pairs hold at most, but for ``miss`` of them.

    sample: rotated vectors. Entry 0 is 0, those of all columns and of a sample without pairs are 1.
    """
    dims = sample.shape[1]
    out = np.r_[0.0, np.ones(dims)]
    x = sample[:CALIBRATION]
    if len(x) <= k:
        return out
    norm = (x**2).sum(1)
    d = norm[:, None] + norm - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    parts = np.cumsum((x[:, None] - x[near]) ** 2, axis=2).reshape(-1, dims)
    parts = parts[parts[:, -1] > 0]
    if len(parts):
        out[1:] = np.quantile(parts / parts[:, -1:], 1 - miss, axis=0)
        out[dims] = 1.0
    return out


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, exact, k: int, shares: np.ndarray, whole: bool, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, list row, squared distance, counts) of what may be among the k nearest of each query in one list.

    q, x: rotated and in the order of cells; limit: squared distance beyond which a query needs nothing (inf at first),
    lowered here; exact(i, j): squared distances of query rows i and list rows j in the stored numbers; shares: of
    :func:`calibrated`; whole: put rejected candidates back; same[i]: the list row that is query i itself.
    counts: candidates compared, rejected by the test though the plain distance would keep them, put back.
    """
    dims = x.shape[1]
    cols = np.ascontiguousarray(x.T)
    starts = np.arange(0, len(x), BLOCK)
    low, high = (np.stack([f(x[b : b + BLOCK], axis=0) for b in starts]) for f in (np.min, np.max)) if len(x) else (x, x)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counts = np.zeros(3, np.int64)
    slack = 1 + 1e-9
    for lo in range(0, len(q), QUERIES):
        part, top = q[lo : lo + QUERIES], limit[lo : lo + QUERIES]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        put: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gap = (np.maximum(0, np.maximum(low - part.max(0), part.min(0) - high)) ** 2).sum(1)

        def settle(i: np.ndarray, j: np.ndarray, lo: int = lo, top: np.ndarray = top, got: list = got) -> None:
            """Exact distances of candidates, and the bounds that follow from them."""
            if not len(i):
                return
            d2 = exact(lo + i, j)
            keep = d2 <= top[i] * slack
            got.append((i[keep], j[keep], d2[keep]))
            rows, dist = (np.concatenate([g[n] for g in got]) for n in (0, 2))
            order = np.lexsort((dist, rows))
            rows, dist = rows[order], dist[order]
            begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
            full = np.diff(np.r_[begin, len(rows)]) >= k
            at = rows[begin[full]]
            top[at] = np.minimum(top[at], dist[begin[full] + k - 1])

        for b in starts[np.argsort(gap, kind="stable")].tolist():
            if gap[b // BLOCK] > top.max() * slack:
                break
            # Only queries whose bound reaches the block's box.
            near = np.flatnonzero((np.maximum(0, np.maximum(low[b // BLOCK] - part, part - high[b // BLOCK])) ** 2).sum(1) <= top * slack)
            c = cols[:, b : b + BLOCK]
            open_ = np.isinf(top[near]).any()
            seen = dims if open_ else min(COLUMNS, dims)
            d = np.zeros((len(near), c.shape[1]))
            for n in range(seen):
                d += (part[near, n, None] - c[None, n]) ** 2
            counts[0] += d.size
            least = k + (same is not None)
            if seen == dims and c.shape[1] >= least:
                top[near] = np.minimum(top[near], np.partition(d, least - 1, axis=1)[:, least - 1] * slack)
            i, j = np.nonzero(d <= (top[near] * slack)[:, None])
            partial = d[i, j]
            i = near[i]
            while len(i):
                if seen < dims:
                    ok = partial <= top[i] * (shares[seen] * slack)
                    counts[1] += (~ok).sum()
                    if whole:
                        put.append((i[~ok], b + j[~ok], partial[~ok]))
                    i, j, partial = i[ok], j[ok], partial[ok]
                if seen == dims:
                    break
                more = min(seen + COLUMNS, dims)
                for n in range(seen, more):
                    partial = partial + (part[i, n] - c[n, j]) ** 2
                seen = more
                keep = partial <= top[i] * slack
                i, j, partial = i[keep], j[keep], partial[keep]
            if same is not None:
                keep = same[lo + i] != b + j
                i, j = i[keep], j[keep]
            settle(i, b + j)
        if put:
            i, j, partial = (np.concatenate(a) for a in zip(*put, strict=True))
            keep = partial <= top[i] * slack
            if same is not None:
                keep &= same[lo + i] != j
            counts[2] += keep.sum()
            settle(i[keep], j[keep])
        for i, j, d2 in got:
            keep = d2 <= top[i]
            out.append((lo + i[keep], j[keep], d2[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), counts
    i, j, d2 = (np.concatenate(a) for a in zip(*out, strict=True))
    return i, j, d2, counts


def _lists_of(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind))


NEAR = "array<struct<d2: double, near: bigint>>"


def nearest(vectors: DataFrame, dims: int, *, k: int = 3, miss: float = 0.02, whole: bool = True, probes: int | None = None, list_size: int = LIST_SIZE, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(v, ids, near array<struct<d2, near>>) of each distinct vector: its least ids, k + 1 at most, and
    the k nearest ids among the other vectors; and counts (compared, rejected, put_back) of the scans of own lists.

    vectors: (id long, v array<double>) of one length, free of null and NaN, one row an id. d2 is
    the squared Euclidean distance of the stored numbers; equal ones are ordered by id. An empty
    table gives none; one vector alone has an empty list. With ``whole`` and no ``probes`` the answers are exact; without
    ``whole`` a share ``miss`` of the tests may lose a neighbour, and ``probes`` bounds the other lists that a vector
    probes, the nearest boxes first.
    """
    spark = vectors.sparkSession
    # Rows are sorted by a number, the hash, before vectors are compared.
    order = Window.partitionBy("h", "v").orderBy("id")
    few = vectors.select(F.xxhash64("v").alias("h"), "v", "id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    entries = store(few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("id")))
    total = entries.count()
    lists = min(MAX_LISTS, max(1, math.ceil(total / list_size)))
    share = SAMPLE * max(lists, CALIBRATION // SAMPLE) / max(1, total)
    sample = entries.select("v")
    if share < 1:
        sample = entries.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    turn = rotation(dims, seed)
    got = sample.toArrow()
    turned = matrix(got["v"]) @ turn if len(got) else np.zeros((0, dims))
    tree, shares = Lists(turned, lists), calibrated(turned, k, miss)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.place(matrix(b["v"]) @ turn), pa.int32()), b["id"], b["v"]], ["list", "id", "v"])

    placed = store(entries.select("id", "v").mapInArrow(place, "list int, id long, v array<double>"))

    # A box for each list, MAX_LISTS at most: a few megabytes.
    boxes = spark.sparkContext.broadcast(boxes_of(placed.select("list", F.col("v").alias("x")), dims, turn))

    def own(t: pa.Table) -> pa.Table:
        """A row with each vector's neighbours in its own list, and a row for each other list that it must probe."""
        v, ids, home = matrix(t["v"]), np.asarray(t["id"]), t["list"][0].as_py()
        x = v @ turn
        order = cells(x, BLOCK)
        v, ids, x = v[order], ids[order], x[order]
        limit = np.full(len(ids), np.inf)
        i, j, d2, counts = scan(x, x, limit, lambda a, b: ((v[a] - v[b]) ** 2).sum(1), k, shares, whole, np.arange(len(ids)))
        pick = best(i, ids[j], d2, k)
        i, j, d2 = i[pick], j[pick], d2[pick]
        count = np.bincount(i, minlength=len(ids))
        reach = np.where(count >= k, limit, np.inf)
        where, low, high = boxes.value
        mine = np.flatnonzero(where == home)[0]
        gap = np.maximum(0, np.maximum(low - high[mine], low[mine] - high))
        able = np.flatnonzero(((gap**2).sum(1) <= reach.max() * (1 + 1e-9)) & (where != home))
        far = [(np.maximum(0, np.maximum(low[b] - x, x - high[b])) ** 2).sum(1) for b in able]
        if probes is not None and len(able) > probes:
            edge = np.partition(np.stack(far), probes - 1, axis=0)[probes - 1]
            far = [np.where(f <= edge, f, np.inf) for f in far]
        hits = [np.flatnonzero((f <= reach * (1 + 1e-9)) & np.isfinite(f)) for f in far]
        q = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        probe = np.repeat(where[able], [len(h) for h in hits])
        n = len(ids)
        sizes = np.r_[count, np.zeros(len(q), np.int64)]
        told = [counts.tolist(), *[None] * (n + len(q) - 1)]
        return pa.table(
            {
                "id": np.r_[ids, ids[q]],
                "probe": pa.array(np.r_[np.full(n, -1), probe], pa.int32()),
                "v": _lists_of(v[q].ravel(), np.r_[np.zeros(n, np.int64), np.full(len(q), dims)], pa.float64()),
                "reach": np.r_[reach, reach[q]],
                "d2": _lists_of(d2, sizes, pa.float64()),
                "near": _lists_of(ids[j], sizes, pa.int64()),
                "counts": pa.array(told, pa.list_(pa.int64())),
            }
        )

    first = store(placed.groupBy("list").applyInArrow(own, "id long, probe int, v array<double>, reach double, d2 array<double>, near array<long>, counts array<long>"))
    asks = first.where("probe >= 0").select("id", "probe", "v", "reach")

    def probe(asked: pa.Table, t: pa.Table) -> pa.Table:
        if not len(asked) or not len(t):
            return pa.table({"id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "near": pa.array([], pa.int64())})
        qv, v, ids = matrix(asked["v"]), matrix(t["v"]), np.asarray(t["id"])
        qx, x = qv @ turn, v @ turn
        a, b = cells(qx, QUERIES), cells(x, BLOCK)
        qv, qx, v, x, ids = qv[a], qx[a], v[b], x[b], ids[b]
        qid, limit = np.asarray(asked["id"])[a], np.array(asked["reach"], np.float64)[a]
        i, j, d2, _ = scan(qx, x, limit, lambda a, b: ((qv[a] - v[b]) ** 2).sum(1), k, shares, whole)
        pick = best(i, ids[j], d2, k)
        return pa.table({"id": qid[i[pick]], "d2": d2[pick], "near": ids[j[pick]]})

    # A list that very many vectors probe is searched by several tasks: its askers are salted, its vectors repeated.
    parts = small(store(asks.groupBy("probe").agg(F.ceil(F.count("id") / ASKERS).cast("int").alias("parts"))))
    asks = asks.join(parts, "probe").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    data = placed.join(parts, placed["list"] == parts["probe"]).select("list", "id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    probed = asks.select("probe", "part", "id", "v", "reach").groupBy("probe", "part").cogroup(data.groupBy("list", "part")).applyInArrow(probe, "id long, d2 double, near long")
    # Of equal vectors the least ids take the place of the entry's own.
    copies = entries.where(F.size("ids") > 1).select(F.col("id").alias("near"), "ids")
    found = first.where("probe < 0").select("id", F.inline(F.arrays_zip("d2", "near"))).unionByName(probed)
    found = meet(found, copies, ["near"], "left").select("id", "d2", F.explode(F.coalesce("ids", F.array("near"))).alias("near"))
    tops = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "near"))), 1, k).alias("near"))
    counts = first.where("counts is not null").agg(*(F.sum(F.col("counts")[i]).alias(c) for i, c in enumerate(("compared", "rejected", "put_back"))))
    return entries.join(tops, "id", "left").select("v", "ids", F.coalesce("near", F.array().cast(NEAR)).alias("near")), counts


def neighbour_rows(vectors: DataFrame, dims: int, *, k: int = 3, **how) -> DataFrame:
    """(id, rank, near, d2): the k nearest others of every id, equal distances ordered by the smaller id.

    Same input as :func:`nearest`. Ids of equal vectors are each other's neighbours at distance 0.
    """
    vectors = vectors.select("id", "v")
    entries = store(nearest(vectors, dims, k=k, **how)[0])
    same = F.transform("ids", lambda x: F.struct(F.lit(0.0).alias("d2"), x.alias("near"))).cast(NEAR)
    lists = entries.select(F.explode("ids").alias("id"), F.slice(F.concat(same, "near"), 1, k + 1).alias("all"))
    # Ids beyond the least k + 1 of equal vectors: the k least of them are their neighbours.
    crowd = entries.where(F.size("ids") > k).select("v", F.col("ids")[k].alias("last"), F.slice(same, 1, k).alias("all"))
    beyond = meet(vectors, crowd, ["v"]).where("id > last").select("id", "all")
    others = lists.unionByName(beyond).select("id", F.slice(F.filter("all", lambda x: x["near"] != F.col("id")), 1, k).alias("near"))
    return others.select("id", F.posexplode("near").alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), F.col("n.near").alias("near"), F.col("n.d2").alias("d2"))
