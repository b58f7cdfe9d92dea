"""Signature q-grams, routes, nearest windows, proposals and twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.scores import foreground, proposal_score
from sondera.operators import lists
from sondera.session import small, store


def signature_qgrams(events: DataFrame, entity: str, order: list[str], signature: str, key: str, q: int = 3) -> DataFrame:
    """(entity, key, qgram): the q signatures that end with each event, joined by '|'; an entity with fewer has one shorter."""
    w = Window.partitionBy(entity).orderBy(*order)
    gram = F.collect_list(signature).over(w.rowsBetween(-(q - 1), 0))
    last = F.lead(key).over(w).isNull()
    rows = events.where(F.col(signature).isNotNull()).select(F.col(entity).alias("entity"), F.col(key).alias("key"), gram.alias("g"), last.alias("last"), F.row_number().over(w).alias("rn"))
    full = F.size("g") == q
    return rows.where(full | (F.col("last") & (F.col("rn") < q))).select("entity", "key", F.array_join("g", "|").alias("qgram"))


def qgram_hits(postings: DataFrame, seeds: DataFrame, *, top: int = 200) -> DataFrame:
    """(key, hits): the keys that share most q-grams (qgram) with the seeds, ties by key."""
    found = postings.join(small(seeds.select("qgram").distinct()), "qgram").groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    return found.orderBy(F.desc("hits"), "key").limit(top)


def route(windows: DataFrame, *, min_coh: float, max_ent: float, min_stab: float, keep: tuple[int, int] = (100, 300)) -> DataFrame:
    """(route, rank, id): foreground and deferred windows, each by coherence down, entropy up, id; at most ``keep`` of each."""
    r = F.when(foreground(min_coh, max_ent, min_stab), "foreground").otherwise("deferred")
    order = Window.partitionBy("route").orderBy(F.desc("coherence"), "entropy", "id")
    ranked = windows.withColumn("route", r).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.when(F.col("route") == "foreground", keep[0]).otherwise(keep[1])).select("route", "rank", "id")


def seen(windows: DataFrame, seeds: DataFrame, *, entity: str, order: list[str], dims: tuple[str, ...], q: int = 3, top: int = 200, max_distance: float = 0.2, **limits: float) -> DataFrame:
    """(route, rank, id): windows that recall the seeds (id): the seeds, those that share q-grams with them, and the nearest to their centroid.

    A q-gram belongs to the q windows it spans: every gram that spans a seed is looked up, and what shares most of them, ``top`` at most with
    ties by id, is recalled by its last window. Of the windows within ``max_distance`` of the centroid the ``top`` nearest are. Without seeds there is
    nothing. limits: those of :func:`route`.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    grams = store(signature_qgrams(windows.where("signature is not null"), entity, order, "signature", "id", q))
    span = windows.where("signature is not null").select("id", *((F.lead("id", i).over(w) if i else F.col("id")).alias(f"k{i}") for i in range(q)))
    span = span.select("id", F.explode(F.array_compact(F.array(*(f"k{i}" for i in range(q))))).alias("key"))
    asked = span.join(seeds.select("id").distinct(), "id", "left_semi").select("key").distinct()
    own = grams.join(asked, "key").select("qgram")
    shared = qgram_hits(grams, own, top=top).select(F.col("key").alias("id"))
    center = windows.join(seeds.select("id").distinct(), "id", "left_semi").agg(*(F.avg(d).alias(f"c_{d}") for d in dims))
    d = l2([F.col(x) for x in dims], [F.col(f"c_{x}") for x in dims])
    near = windows.select("id", *dims).join(F.broadcast(center)).where(d <= max_distance).select("id", d.alias("d")).orderBy("d", "id").limit(top).select("id")
    found = seeds.select("id").unionByName(shared).unionByName(near).distinct()
    return route(windows.join(found, "id", "left_semi"), **limits)


def l2(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def vectors(df: DataFrame, key: str, x: Column) -> DataFrame:
    """(key, x) of the rows whose key is there and whose vector holds numbers only."""
    rows = df.select(F.col(key).cast("long").alias("key"), x.cast("array<double>").alias("x"))
    return rows.where(F.col("key").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False)))


def knn_scan(queries: DataFrame, base: DataFrame, dims: tuple[str, ...], *, k: int, query_key: str, base_key: str) -> DataFrame:
    """(query, rank, neighbour, distance): exact k nearest rows of ``base`` for each query, itself left out.

    Ties fall to the smaller key. Keys are whole numbers, each once; rows with a null or NaN dimension are left out.
    """
    x = F.array(*dims)
    found = lists.nearest_rows(store(vectors(queries, query_key, x)), store(vectors(base, base_key, x)), len(dims), k=k)
    return found.select("query", "rank", F.col("near").alias("neighbour"), F.sqrt("d2").alias("distance"))


def propose(strings: DataFrame, seeds: list[str], *, top: int = 25, min_connector: float = 0.0, min_pattern: float = 0.0, dims: tuple[str, ...] = ("coherence", "stability", "entropy", "rupture")) -> DataFrame:
    """(string, distance, score): strings nearest to the seeds' centroid, scored with connector and rarity; seeds are left out."""
    centroid = strings.where(F.col("string").isin(seeds)).agg(*(F.avg(d).alias(f"c_{d}") for d in dims))
    rest = strings.where(~F.col("string").isin(seeds) & (F.col("connector") >= min_connector) & (F.col("patternability") >= min_pattern))
    d = l2([F.col(x) for x in dims], [F.col(f"c_{x}") for x in dims])
    scored = rest.join(F.broadcast(centroid)).select("string", d.alias("distance"), proposal_score(d, F.col("connector"), F.col("occurrences")).alias("score"))
    return scored.where("distance is not null").orderBy(F.desc("score"), "string").limit(top)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _unit_vectors(side: int):
    """Vectors of length 1 and two more columns, of which a zero vector has the one of its side: it is as far from every other as an orthogonal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = lists.matrix(b["x"]) if b.num_rows else np.zeros((0, 1))
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            extra = np.zeros((len(x), 2))
            extra[:, side] = norm[:, 0] == 0
            x = np.concatenate([x / np.where(norm > 0, norm, 1), extra], axis=1)
            yield pa.RecordBatch.from_arrays([b["key"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["key", "x"])

    return run


def cosine_topk(queries: DataFrame, base: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """(query, rank, neighbour, similarity): exact, ties by key, through the nearest vectors of length 1.

    Of unit vectors the squared distance is 2 - 2 * similarity. Candidates beyond k are taken so that rounding can't change a
    rank; the similarity of the vectors as stored orders them. Keys are whole numbers, each once; a zero vector has similarity 0.
    """
    q, b = (store(vectors(d, key, F.col(vector))) for d in (queries, base))
    dims = b.agg(F.max(F.size("x"))).first()[0] or 0
    q, b = (d.where(F.size("x") == dims) for d in (q, b))
    qu, bu = (store(d.mapInArrow(_unit_vectors(i), "key long, x array<double>")) for i, d in enumerate((q, b)))
    near = lists.nearest_rows(qu, bu, dims + 2, k=k + 2)
    pairs = near.select("query", F.col("near").alias("neighbour")).join(q.select(F.col("key").alias("query"), F.col("x").alias("qv")), "query").join(b.select(F.col("key").alias("neighbour"), F.col("x").alias("v")), "neighbour")
    sims = pairs.select("query", "neighbour", cosine(F.col("qv"), F.col("v")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "neighbour", "similarity")


def merge_twins(direct: DataFrame, indexed: DataFrame, *, limit: int = 3) -> DataFrame:
    """(query, string, source, distance): direct and indexed twins, a string once a query with direct ones first, ``limit`` a query."""
    both = direct.withColumn("prio", F.lit(0)).unionByName(indexed.withColumn("prio", F.lit(1)))
    once = F.row_number().over(Window.partitionBy("query", "string").orderBy("prio", "distance"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("prio", "distance", "string"))
    kept = both.withColumn("_o", once).where("_o = 1").withColumn("rank", rank).where(F.col("rank") <= limit)
    return kept.select("query", "rank", "string", F.when(F.col("prio") == 0, "direct").otherwise("index").alias("source"), "distance")
