"""Co-occurrence graphs, components and centrality."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import cut, fits, store


#: Items of a group in one block of pairs.
BLOCK = 256


def cooccurrence(members: DataFrame, group: str, item: str, *, cap: int | None = 50, min_weight: int = 1) -> DataFrame:
    """(u, v, weight): groups that hold both items, u < v. Of a group the first ``cap`` items in order count.

    The cap is the operator's parameter: with it a group gives at most cap * (cap - 1) / 2 pairs.
    Without one (None) all items count, and the pairs of a large group are made block by block.
    """
    if cap is None:
        return _all_pairs(members, group, item).groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    m = members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    rn = F.row_number().over(Window.partitionBy("g").orderBy("x"))
    m = m.withColumn("rn", rn).where(F.col("rn") <= cap)
    # Pairs come from the sorted array of each group: one shuffle, no self-join.
    a = m.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    rows = a.select("xs", F.posexplode("xs").alias("i", "u")).select("u", F.explode(F.slice("xs", F.col("i") + 2, F.greatest(F.size("xs") - F.col("i") - 1, F.lit(0)))).alias("v"))
    return rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)


def _all_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """(u, v), u < v, once for each group that holds both; no task holds more than two blocks of a group."""
    m = members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    sizes = m.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = m.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks").cast("long")).cast("int"))
    blocks = placed.groupBy("g", "block", "blocks").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    own = blocks.select("xs", F.posexplode("xs").alias("i", "u")).select("u", F.explode(F.slice("xs", F.col("i") + 2, F.greatest(F.size("xs") - F.col("i") - 1, F.lit(0)))).alias("v"))
    left = blocks.where("block < blocks - 1").select("g", F.col("xs").alias("us"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    both = left.join(blocks.where("block > 0").select("g", "block", F.col("xs").alias("vs")), ["g", "block"])
    across = both.select(F.explode("us").alias("a"), "vs").select("a", F.explode("vs").alias("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return own.unionByName(across)


def with_pmi(edges: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Edges with pmi = ln(weight * total / (count_u * count_v)). counts: (item, n)."""
    cu, cv = (counts.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}")) for c in ("u", "v"))
    return edges.join(cu, "u").join(cv, "v").withColumn("pmi", F.log(F.col("weight") * F.lit(float(total)) / (F.col("n_u") * F.col("n_v")))).drop("n_u", "n_v")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, degree_centrality, neighbour_entropy) of an undirected graph of edges u < v."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "weight").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "weight"))
    deg = store(both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength")))
    n = deg.count()
    # Entropy of the neighbours' degrees: log2 S - (sum d log2 d) / S.
    other = both.join(deg.select(F.col("node").alias("other"), F.col("degree").alias("d")), "other").groupBy("node").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.log2("d")).alias("dl"))
    h = F.log2("s") - F.col("dl") / F.col("s")
    return deg.join(other, "node").select("node", "degree", "strength", (F.col("degree") / F.lit(max(1, n - 1))).alias("degree_centrality"), h.alias("neighbour_entropy"))


def limit_degree(edges: DataFrame, most: int) -> DataFrame:
    """Edges among the ``most`` heaviest of both ends, ties by names: an order-free form of a greedy degree limit."""
    both = edges.select("u", "v", "weight", F.col("u").alias("end")).unionByName(edges.select("u", "v", "weight", F.col("v").alias("end")))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("weight"), "u", "v"))
    return both.withColumn("r", rank).where(F.col("r") <= most).groupBy("u", "v", "weight").agg(F.count(F.lit(1)).alias("k")).where("k = 2").drop("k")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component.

    Alternating large-star and small-star steps: every step is a grouped minimum, the number of
    steps grows with the logarithm of the longest path, and edges stay at their number.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()

    def stars(x: DataFrame, large: bool) -> DataFrame:
        both = x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else x
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        j = both.join(least, "a")
        if large:  # neighbours above the node go to the least
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # the node and its lesser neighbours go to the least
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    while True:
        new = cut(stars(stars(e, True), False))
        # Both sides hold distinct rows.
        changed = new.count() != e.count() or new.exceptAll(e).limit(1).count()
        e = new
        if not changed:
            break
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _brandes(adjacency: dict, sources: list) -> dict:
    score: dict = {}
    for s in sources:
        order, parents, paths, dist = [], {s: []}, {s: 1.0}, {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacency.get(v, ()):
                if w not in dist:
                    dist[w], paths[w], parents[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    parents[w].append(v)
        load = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in parents[w]:
                load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != s:
                score[w] = score.get(w, 0.0) + load[w]
    return score


def _load_by_joins(both: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): dependencies on each node of all paths from the sources, level by level as joins; both: (u, v) in either direction."""
    front = store(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))
    levels, met = [], front.select("s", "v")
    while front.limit(1).count():
        levels.append(front)
        ahead = front.select("s", F.col("v").alias("u"), "paths").join(both, "u").groupBy("s", "v").agg(F.sum("paths").alias("paths"))
        front = store(ahead.join(met, ["s", "v"], "left_anti"))
        # A node's neighbours are one level nearer, as near or one level farther, so two levels tell what was met.
        met = levels[-1].select("s", "v").unionByName(front.select("s", "v"))
    out, load = None, None
    for i in range(len(levels) - 1, 0, -1):
        here = levels[i] if load is None else levels[i].join(load, ["s", "v"], "left")
        here = store(here.withColumn("load", F.lit(0.0) if load is None else F.coalesce("load", F.lit(0.0))))
        part = here.select(F.col("v").alias("node"), F.col("load").alias("b"))
        out = part if out is None else out.unionByName(part)
        down = here.select("s", F.col("v").alias("u"), ((1 + F.col("load")) / F.col("paths")).alias("x")).join(both, "u")
        load = down.join(levels[i - 1].select("s", "v", F.col("paths").alias("own")), ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("own") * F.col("x")).alias("load"))
    none = sources.select("node", F.lit(0.0).alias("b")).limit(0)
    return none if out is None else out


def betweenness(edges: DataFrame, *, pivots: int | None = None) -> DataFrame:
    """(node, betweenness), normalised, of an undirected graph of distinct edges (u, v).

    Edges of proven size are broadcast and sources spread over tasks; a larger graph goes level by level through joins on (source, node), with
    the same result. ``pivots`` takes that many sources by hash and scales: the sampled mode.
    """
    edges = store(edges.select("u", "v").where("u <> v").distinct())
    spark = edges.sparkSession
    nodes = store(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct())
    kind, n = dict(nodes.dtypes)["node"], nodes.count()
    sources = nodes if pivots is None or pivots >= n else nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    scale = 1.0 if pivots is None or pivots >= n else n / pivots
    if fits(edges):
        adjacency: dict = {}
        for r in edges.collect():
            adjacency.setdefault(r.u, []).append(r.v)
            adjacency.setdefault(r.v, []).append(r.u)
        shared = spark.sparkContext.broadcast(adjacency)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = _brandes(shared.value, pdf["node"].tolist())
                yield pd.DataFrame({"node": list(s), "b": list(s.values())})

        parts = sources.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, f"node {kind}, b double")
    else:
        parts = _load_by_joins(store(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))), sources)
    norm = (n - 1) * (n - 2) if n > 2 else 1
    return nodes.join(parts.groupBy("node").agg(F.sum("b").alias("b")), "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale / norm).alias("betweenness"))
