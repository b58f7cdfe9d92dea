"""Queries over candidates and orders as graphs, and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.functions.scores import METRICS, clean_metric
from sondera.operators import graph, profiles, retrieval
from sondera.plans.registry import query
from sondera.session import latest, store, table

_P = """
WITH basket AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem), e AS (SELECT a.x AS u, b.x AS v, count(*) AS weight FROM basket a JOIN basket b ON a.g = b.g AND a.x < b.x GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(_P + " SELECT u, v, weight FROM e WHERE weight >= 2")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together at least twice."""
    return _edges(spark, sf_dir).where("weight >= 2")


@query(
    _P
    + """, n AS (SELECT x, count(*) AS n FROM basket GROUP BY x), t AS (SELECT count(DISTINCT g) AS t FROM basket)
  SELECT u, v, weight, round(ln(weight * t.t / (a.n * b.n)::DOUBLE), 6) AS pmi FROM e JOIN n a ON a.x = u JOIN n b ON b.x = v, t WHERE weight >= 2"""
)
def pmi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    total = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey")).first()[0]
    counts = b.groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return graph.with_pmi(_edges(spark, sf_dir).where("weight >= 2"), counts, total).select("u", "v", "weight", F.round("pmi", 6).alias("pmi"))


@query(
    _P
    + """, s AS (SELECT u, v, weight FROM e WHERE weight >= 2), b AS (SELECT u AS node, v AS other, weight FROM s UNION ALL SELECT v, u, weight FROM s),
  d AS (SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM b GROUP BY node), o AS (SELECT b.node, log2(sum(d.degree)) - sum(d.degree * log2(d.degree)) / sum(d.degree) AS h FROM b JOIN d ON d.node = b.other GROUP BY b.node)
  SELECT node, degree, strength, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS degree_centrality, round(h, 6) AS neighbour_entropy FROM d JOIN o USING (node)"""
)
def degree_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(store(_edges(spark, sf_dir).where("weight >= 2")))
    return d.select("node", "degree", "strength", F.round("degree_centrality", 6).alias("degree_centrality"), F.round("neighbour_entropy", 6).alias("neighbour_entropy"))


@query(
    _P
    + """, s AS (SELECT u, v, weight FROM e WHERE weight >= 2), b AS (SELECT u, v, weight, u AS n FROM s UNION ALL SELECT u, v, weight, v FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY weight DESC, u, v) AS r FROM b)
  SELECT u, v, weight FROM r WHERE r <= 2 GROUP BY u, v, weight HAVING count(*) = 2"""
)
def degree_limited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_degree(_edges(spark, sf_dir).where("weight >= 2"), 2)


@query(
    "WITH RECURSIVE "
    + _P.strip().removeprefix("WITH ")
    + """, s AS (SELECT u, v FROM e WHERE weight >= 3 UNION ALL SELECT v, u FROM e WHERE weight >= 3), reach AS (SELECT DISTINCT u AS node, u AS seen FROM s UNION SELECT r.node, s.v FROM reach r JOIN s ON s.u = r.seen)
  SELECT node, min(seen) AS component FROM reach GROUP BY node"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir).where("weight >= 3"))


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = graph.betweenness(store(_edges(spark, sf_dir).where("weight >= 3")))
    return b.select("node", F.round("betweenness", 9).alias("betweenness"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cand_id, the one loaded last; text trimmed and lower-cased as ``string``, metrics flat and defaulted."""
    c = latest(table(spark, sf_dir, "candidates"), "cand_id", "loaded_at").where("text is not null")
    flat = [F.coalesce(clean_metric(F.col(f"metrics.{m}")), F.lit(1.0 if m == "entropy" else 0.0)).alias(m) for m in METRICS]
    occ = F.greatest(F.coalesce("occurrences", F.lit(0)), F.lit(0)).cast("long")
    return c.select("cand_id", "file_id", F.lower(F.trim("text")).alias("string"), occ.alias("occurrences"), "patternability", "connector", "window_ids", "themes", *flat)


_D = lambda m, d: f"coalesce(CASE WHEN isnan(metrics.{m}) THEN NULL ELSE metrics.{m} END, {d}) AS {m}"
_CAND = f"""
WITH cand AS (SELECT cand_id, file_id, lower(trim(text, ' ')) AS string, greatest(coalesce(occurrences, 0), 0)::BIGINT AS occurrences, patternability, connector, window_ids, themes, {_D('coherence', 0)}, {_D('stability', 0)}, {_D('entropy', 1)}, {_D('rupture', 0)}, {_D('lambda_hazard', 0)}
  FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) = 1) WHERE text IS NOT NULL)"""


@query(_CAND + " SELECT cand_id, string, occurrences, patternability FROM cand WHERE occurrences >= 2 AND connector >= 0.1 AND coherence >= 0.5 AND entropy <= (SELECT quantile_cont(entropy, 0.6) FROM cand)")
def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that pass minimum counts, connector and the filter "coh>=0.5,ent<=P60"."""
    from sondera.functions.scores import apply_filter

    return apply_filter(store(candidates(spark, sf_dir)), "coh>=0.5,ent<=P60").where("occurrences >= 2 and connector >= 0.1").select("cand_id", "string", "occurrences", "patternability")


@query(
    _CAND
    + """, s AS (SELECT cand_id, 1 / (1 + exp(-(0.5 * coherence + 0.3 * stability - 0.2 * entropy - 0.2 * rupture))) AS pattern, 1 / (1 + exp(-(0.4 * coherence + 0.3 * stability + 0.1 * entropy - 0.2 * rupture))) AS conn FROM cand)
  SELECT cand_id, round(pattern, 6) AS pattern, round(conn, 6) AS conn FROM s"""
)
def string_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patternability and connector of each candidate from its metrics."""
    c = candidates(spark, sf_dir)
    p = profiles.patternability(*(F.col(m) for m in METRICS[:4]))
    k = profiles.connector(F.col("coherence"), F.col("stability"), F.lit(0.0), F.col("entropy"), F.col("rupture"))
    return c.select("cand_id", F.round(p, 6).alias("pattern"), F.round(k, 6).alias("conn"))


@query(
    _CAND
    + """, g AS (SELECT string, sum(occurrences)::BIGINT AS occurrences, avg(coherence) AS coherence, avg(stability) AS stability, avg(entropy) AS entropy, avg(rupture) AS rupture, avg(patternability) AS patternability, avg(connector) AS connector FROM cand GROUP BY string),
  c AS (SELECT avg(coherence) AS c, avg(stability) AS s, avg(entropy) AS e, avg(rupture) AS r FROM g WHERE string IN ('theme store', 'span merge')),
  d AS (SELECT string, connector, occurrences, sqrt((coherence - c) ** 2 + (stability - s) ** 2 + (entropy - e) ** 2 + (rupture - r) ** 2) AS distance FROM g, c WHERE string NOT IN ('theme store', 'span merge') AND connector >= 0.1)
  SELECT string, round(distance, 6) AS distance, round(0.55 / (1 + 3 * distance) + 0.30 * connector + 0.15 / (1 + ln(occurrences + 1)), 6) AS score FROM d ORDER BY score DESC, string LIMIT 25"""
)
def propose_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).groupBy("string").agg(F.sum("occurrences").alias("occurrences"), *(F.avg(m).alias(m) for m in ("coherence", "stability", "entropy", "rupture", "patternability", "connector")))
    p = retrieval.propose(c, ["theme store", "span merge"], min_connector=0.1, top=1_000_000)
    return p.select("string", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "string").limit(25)


@query(
    _CAND
    + """, c AS (SELECT DISTINCT string, unnest(window_ids) AS window_id FROM cand)
  SELECT a.string AS u, b.string AS v, count(*) AS weight FROM c a JOIN c b ON a.window_id = b.window_id AND a.string < b.string GROUP BY ALL HAVING count(*) >= 2"""
)
def theme_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that share at least two windows, all strings of each window."""
    w = candidates(spark, sf_dir).select("string", F.explode("window_ids").alias("window_id"))
    return graph.cooccurrence(w, "window_id", "string", cap=None, min_weight=2)


@query(
    _CAND
    + """, t AS (SELECT unnest(themes) AS theme, string, connector, patternability FROM cand), k AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY connector DESC, string) AS rn, count(*) OVER (PARTITION BY theme) AS n FROM (SELECT DISTINCT * FROM t) q)
  SELECT theme, n, rn, string FROM k WHERE rn <= 3 AND theme IS NOT NULL"""
)
def theme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each theme and its three strings of highest connector."""
    t = candidates(spark, sf_dir).select(F.explode("themes").alias("theme"), "string", "connector", "patternability").where("theme is not null").distinct()
    rn = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc_nulls_last("connector"), "string"))
    n = F.count(F.lit(1)).over(Window.partitionBy("theme"))
    return t.withColumn("rn", rn).withColumn("n", n).where("rn <= 3").select("theme", "n", "rn", "string")


@query(
    _CAND
    + """, h AS (SELECT string, cand_id % 2 AS half, occurrences, patternability FROM cand)
  SELECT string, sum(occurrences)::BIGINT AS occurrences, round(CASE WHEN sum(occurrences) > 0 THEN sum(patternability * occurrences) / sum(occurrences) ELSE 0 END + 1e-9, 6) AS patternability, count(DISTINCT half) AS n_states FROM h GROUP BY string"""
)
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the strings merged, metrics weighted by occurrences; merging twice gives the same."""
    c = candidates(spark, sf_dir).select("string", (F.col("cand_id") % 2).alias("half"), "occurrences", "patternability")
    halves = [c.where(F.col("half") == h).groupBy("string", "half").agg(F.sum("occurrences").alias("o"), F.sum(F.col("patternability") * F.col("occurrences")).alias("p")) for h in (0, 1)]
    m = halves[0].unionByName(halves[1]).groupBy("string").agg(F.sum("o").alias("occurrences"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n_states"))
    share = F.when(F.col("occurrences") > 0, F.col("p") / F.col("occurrences")).otherwise(0.0)
    return m.select("string", "occurrences", F.round(share + 1e-9, 6).alias("patternability"), "n_states")


@query(
    _CAND
    + """, top AS (SELECT file_id, string, occurrences, patternability, row_number() OVER (PARTITION BY file_id ORDER BY occurrences DESC, patternability DESC, string, cand_id) AS rank FROM cand WHERE file_id IS NOT NULL)
  SELECT file_id, rank, string FROM top WHERE rank <= 8"""
)
def file_top_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strings of each file by occurrences and pattern."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("occurrences"), F.desc_nulls_last("patternability"), "string", "cand_id"))
    return candidates(spark, sf_dir).where("file_id is not null").withColumn("rank", rank).where("rank <= 8").select("file_id", "rank", "string")


@query(_CAND + " SELECT string LIKE '%scan%' AS structural, count(*) AS n, round(sum(occurrences) / (SELECT sum(occurrences) FROM cand), 6) AS share FROM cand GROUP BY 1")
def structural_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of occurrences that strings with a given part hold."""
    c = candidates(spark, sf_dir).groupBy(F.col("string").contains("scan").alias("structural")).agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("o"))
    c = store(c)
    return c.join(F.broadcast(c.agg(F.sum("o").alias("t")))).select("structural", "n", F.round(F.col("o") / F.col("t"), 6).alias("share"))
