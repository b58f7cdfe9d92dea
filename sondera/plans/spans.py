"""Queries over span inventories, signature tables, twins, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.functions.numbers import unit_value
from sondera.functions.text import strip_blanks
from sondera.operators import evaluation, retrieval, spans
from sondera.plans.registry import query
from sondera.plans.signals import SIG, signals
from sondera.session import latest, store, table

_B = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SP = "WITH sp AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1)"


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "spans"), "rec_id", "loaded_at")


@query(_SP + " SELECT rec_id, occurrences, coalesce(list_sum(map_values(sources)), 0)::BIGINT AS from_sources, coalesce(cardinality(sources), 0)::INT AS n_sources, occurrences IS NOT DISTINCT FROM list_sum(map_values(sources)) AS agrees FROM sp")
def span_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each span against the sum of its sources."""
    total = F.aggregate(F.map_values("sources"), F.lit(0).cast("long"), lambda s, x: s + x)
    return span_rows(spark, sf_dir).select("rec_id", "occurrences", F.coalesce(total, F.lit(0)).alias("from_sources"), F.coalesce(F.when(F.col("sources").isNotNull(), F.size("sources")), F.lit(0)).alias("n_sources"), F.col("occurrences").cast("long").eqNullSafe(F.when(F.size("sources") > 0, total)).alias("agrees"))


@query(_SP + ", e AS (SELECT unnest(map_entries(span_types)) AS e FROM sp) SELECT e.key AS name, sum(e.value)::BIGINT AS n FROM e GROUP BY 1")
def span_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.explode_counts(span_rows(spark, sf_dir), "rec_id", "span_types").groupBy("name").agg(F.sum("n").alias("n"))


@query(_SP + ", e AS (SELECT pack, unnest(map_entries(sources)) AS e FROM sp) SELECT pack, e.key AS name, sum(e.value)::BIGINT AS n FROM e GROUP BY ALL")
def span_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by pack and source, built as maps and read out again."""
    rows = span_rows(spark, sf_dir).select("pack", F.explode("sources").alias("name", "n"))
    return spans.to_counts(rows, "pack").select("pack", F.explode("counts").alias("name", "n"))


@query(_SP + ', c AS (SELECT rec_id, unnest(left_contexts) AS c FROM sp), k AS (SELECT rec_id, c."text" AS text, c.count AS count, row_number() OVER (PARTITION BY rec_id ORDER BY c.count DESC, c."text" DESC) AS rank FROM c) SELECT rec_id, rank, text, count FROM k WHERE rank <= 2')
def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.context_topk(span_rows(spark, sf_dir), "rec_id", "left_contexts", 2)


@query(
    _SP
    + """, c AS (SELECT pack, unnest(list_concat(coalesce(left_contexts, []), coalesce(right_contexts, []))) AS c FROM sp) SELECT c."text" AS context, sum(c.count)::BIGINT AS count, count(DISTINCT pack) AS unique_packs, sum(c.reinforcement)::BIGINT AS reinforcement FROM c GROUP BY 1"""
)
def context_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each context's counts, distinct packs and reinforcement."""
    none = F.array().cast(dict(span_rows(spark, sf_dir).dtypes)["left_contexts"])
    rows = span_rows(spark, sf_dir).select("pack", F.explode(F.concat(F.coalesce("left_contexts", none), F.coalesce("right_contexts", none))).alias("c"))
    per = rows.groupBy(F.col("c.text").alias("context"), "pack").agg(F.sum("c.count").alias("k"), F.sum("c.reinforcement").alias("r"))
    return per.groupBy("context").agg(F.sum("k").alias("count"), F.count("pack").alias("unique_packs"), F.sum("r").alias("reinforcement"))


_SHORT = f"""WITH c AS (SELECT cand_id, lower(trim(regexp_replace(text, '{_B}', ' ', 'g'))) AS t FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) = 1) WHERE text IS NOT NULL),
  u AS (SELECT min(cand_id) AS id, t FROM c WHERE t <> '' GROUP BY t),
  bl AS (SELECT id, t, unnest(list_distinct(['p:' || t[1:6], 's:' || right(t, 6), 'w:' || split_part(t, ' ', 1)])) AS block FROM u),
  cd AS (SELECT DISTINCT a.id AS q, a.t AS qt, b.id AS m, b.t AS bt FROM bl a JOIN bl b USING (block) WHERE a.id <> b.id AND abs(length(a.t) - length(b.t)) <= 3),
  g AS (SELECT q, m, levenshtein(regexp_replace(qt, '[^\x00-\x7F]', '?', 'g'), regexp_replace(bt, '[^\x00-\x7F]', '?', 'g')) AS distance, list_distinct([('##' || qt || '##')[i:i + 2] FOR i IN range(1, length(qt) + 3)]) AS a, list_distinct([('##' || bt || '##')[i:i + 2] FOR i IN range(1, length(bt) + 3)]) AS b FROM cd),
  s AS (SELECT q, m, distance, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS overlap FROM g)
"""


@query(_SHORT + " SELECT q AS query, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, distance, m) AS rank, m AS match, distance, overlap FROM s QUALIFY rank <= 5")
def near_dup_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings near each string by blocks, q-gram overlap and edit distance; equal strings are one."""
    c = latest(table(spark, sf_dir, "candidates"), "cand_id", "loaded_at").select("cand_id", spans.normalise(F.col("text")).alias("t")).where("t <> ''")
    u = store(c.groupBy("t").agg(F.min("cand_id").alias("id")))
    return spans.near_duplicates(u, u, key="id", text="t").withColumn("distance", F.col("distance").cast("long"))


def windows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a window_id: source trimmed and in lower case, metrics valid or null."""
    s = latest(table(spark, sf_dir, "signature_stats"), "window_id", "updated_at")
    return s.select("window_id", "sig", F.lower(strip_blanks(F.col("source"))).alias("source"), "repetitions", unit_value(F.col("lambda_")).alias("lambda_hazard"), *(unit_value(F.col(m)).alias(m) for m in ("coherence", "stability", "patternability", "entropy", "rupture")))


_V = lambda c, a: f"CASE WHEN isnan({c}) OR {c} < 0 OR {c} > 1 THEN NULL ELSE {c}::DOUBLE END AS {a}"
_ST = f"""WITH st AS (SELECT window_id, sig, lower(regexp_replace(source, '^{_B}|{_B}$', '', 'g')) AS source, repetitions, {_V('lambda_', 'lambda_hazard')}, {_V('coherence', 'coherence')}, {_V('stability', 'stability')}, {_V('patternability', 'patternability')}, {_V('entropy', 'entropy')}, {_V('rupture', 'rupture')}
  FROM signature_stats QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY updated_at DESC) = 1)"""


@query(_ST + " SELECT hex(sig) AS sig, count(*) AS n_windows, sum(repetitions)::BIGINT AS repetitions, round(avg(lambda_hazard), 6) AS lambda_hazard, min(window_id) AS window_id, round(arg_min(entropy, window_id) FILTER (WHERE entropy IS NOT NULL), 6) AS entropy FROM st GROUP BY sig")
def signature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signature's repetitions, mean hazard over its windows, first window and that window's entropy."""
    w = windows_table(spark, sf_dir)
    return w.groupBy(F.hex("sig").alias("sig")).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("repetitions").alias("repetitions"), F.round(F.avg("lambda_hazard"), 6).alias("lambda_hazard"), F.min("window_id").alias("window_id"), F.round(F.min_by("entropy", F.when(F.col("entropy").isNotNull(), F.col("window_id"))), 6).alias("entropy"))


_GATE = (
    _ST
    + """, q AS (SELECT DISTINCT query_window_id AS window_id FROM twin_suggestions), m AS (SELECT window_id, repetitions, lambda_hazard, patternability AS semantic, coherence, entropy FROM st),
  g AS (SELECT q.window_id, coalesce(repetitions, 0) AS repetitions, coalesce(lambda_hazard, 1) AS lambda_hazard, coalesce(semantic, 0) AS semantic, coalesce(coherence, 0) AS coherence FROM q LEFT JOIN m USING (window_id)),
  t AS (SELECT window_id, repetitions >= 2 AS repeat_ok, lambda_hazard <= 0.55 AS hazard_ok, semantic >= 0.15 AS semantic_ok, coherence >= 0.2 AS structural_ok FROM g)"""
)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "twin_suggestions").select(F.col("query_window_id").alias("window_id")).distinct()
    m = windows_table(spark, sf_dir).select("window_id", "repetitions", "lambda_hazard", F.col("patternability").alias("semantic"), "coherence", "entropy")
    return spans.gate(q, m, "window_id", r_min=2, c_min=0.2)


@query(_GATE + " SELECT *, repeat_ok AND hazard_ok AND semantic_ok AND structural_ok AS admitted FROM t")
def span_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("window_id", "repeat_ok", "hazard_ok", "semantic_ok", "structural_ok", "admitted")


@query(_GATE + " SELECT count(*) AS n, count_if(repeat_ok AND hazard_ok AND semantic_ok AND structural_ok) AS approved, count_if(semantic_ok AND NOT structural_ok) AS semantic_only, count_if(structural_ok AND NOT semantic_ok) AS structural_only, count_if(semantic_ok AND structural_ok) AS both FROM t")
def gate_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved spans, and each guard alone against both together."""
    g = _gated(spark, sf_dir)
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("admitted").alias("approved"), F.count_if(F.col("semantic_ok") & ~F.col("structural_ok")).alias("semantic_only"), F.count_if(F.col("structural_ok") & ~F.col("semantic_ok")).alias("structural_only"), F.count_if(F.col("semantic_ok") & F.col("structural_ok")).alias("both"))


_TW = "WITH q AS (SELECT DISTINCT query_window_id AS window_id FROM twin_suggestions WHERE query_window_id IS NOT NULL)"


@query(_TW + " SELECT q.window_id FROM q SEMI JOIN signals s ON s.id = q.window_id")
def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "twin_suggestions").select(F.col("query_window_id").alias("window_id")).where("window_id is not null").distinct()
    return q.join(table(spark, sf_dir, "signals").select(F.col("id").alias("window_id")), "window_id", "left_semi")


@query(_TW + " SELECT q.window_id FROM q ANTI JOIN (SELECT DISTINCT window_id FROM signature_stats WHERE repetitions >= 2) s USING (window_id)")
def membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "twin_suggestions").select(F.col("query_window_id").alias("window_id")).where("window_id is not null").distinct()
    """Queried windows that signature_stats does not have as repeated."""
    often = table(spark, sf_dir, "signature_stats").where("repetitions >= 2").select("window_id")
    return spans.membership(q, often, "window_id").where("not member").select("window_id")


_TS = "WITH t AS (SELECT DISTINCT query_window_id, window_id, signature, distance FROM twin_suggestions WHERE distance >= 0)"


@query(_TS + " SELECT query_window_id, count(*) AS n, round(avg(distance), 6) AS mean_distance, min(distance) AS least, max(distance) AS most FROM t GROUP BY 1")
def twin_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "twin_suggestions").where("distance >= 0").select("query_window_id", "window_id", "signature", "distance").distinct()
    return t.groupBy("query_window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.min("distance").alias("least"), F.max("distance").alias("most"))


@query(_TS + ", g AS (SELECT unnest([0.001, 0.003, 0.01, 0.1]::DOUBLE[]) AS tau), m AS (SELECT query_window_id, min(distance) AS d FROM t GROUP BY 1) SELECT tau, round(avg(CASE WHEN d <= tau THEN 1.0 ELSE 0.0 END), 6) AS rate FROM m, g GROUP BY tau")
def twin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a twin within each of four stated distances."""
    m = table(spark, sf_dir, "twin_suggestions").where("distance >= 0").groupBy("query_window_id").agg(F.min("distance").alias("d"))
    taus = [0.001, 0.003, 0.01, 0.1]
    row = m.agg(*(F.avg((F.col("d") <= t).cast("double")).alias(f"r{i}") for i, t in enumerate(taus)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(t).alias("tau"), F.round(f"r{i}", 6).alias("rate")) for i, t in enumerate(taus)))))


@query(
    _ST
    + """, d AS (SELECT query_window_id AS query, window_id AS string, min(distance) AS distance FROM twin_suggestions WHERE distance >= 0 AND query_window_id IS NOT NULL AND window_id IS NOT NULL GROUP BY ALL),
  qs AS (SELECT DISTINCT query FROM d), ok AS (SELECT * FROM st WHERE coherence IS NOT NULL AND stability IS NOT NULL AND entropy IS NOT NULL AND rupture IS NOT NULL AND lambda_hazard IS NOT NULL),
  k AS (SELECT a.window_id AS query, b.window_id AS string, sqrt((a.coherence - b.coherence) ** 2 + (a.stability - b.stability) ** 2 + (a.entropy - b.entropy) ** 2 + (a.rupture - b.rupture) ** 2 + (a.lambda_hazard - b.lambda_hazard) ** 2) AS distance
    FROM ok a JOIN qs ON qs.query = a.window_id JOIN ok b ON a.window_id <> b.window_id QUALIFY row_number() OVER (PARTITION BY a.window_id ORDER BY distance, b.window_id) <= 3),
  u AS (SELECT query, string, distance, 0 AS prio FROM d UNION ALL SELECT query, string, distance, 1 FROM k), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, string ORDER BY prio, distance) = 1)
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY prio, distance, string) AS rank, string, CASE WHEN prio = 0 THEN 'direct' ELSE 'index' END AS source, round(distance, 6) AS distance FROM o QUALIFY rank <= 3"""
)
def merged_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested twins before nearest windows, three a query, a window once."""
    t = table(spark, sf_dir, "twin_suggestions").where("distance >= 0 and query_window_id is not null and window_id is not null")
    d = store(t.groupBy(F.col("query_window_id").alias("query"), F.col("window_id").alias("string")).agg(F.min("distance").alias("distance")))
    dims = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")
    ok = store(windows_table(spark, sf_dir).dropna(subset=list(dims)).select("window_id", *dims))
    q = ok.join(d.select(F.col("query").alias("window_id")).distinct(), "window_id", "left_semi")
    k = retrieval.knn_scan(q, ok, dims, k=3, query_key="window_id", base_key="window_id").select("query", F.col("neighbour").alias("string"), "distance")
    return retrieval.merge_twins(d, k).withColumn("distance", F.round("distance", 6))


_L = """WITH v AS (SELECT DISTINCT doc_id, rater, replace(lower(trim(subject)), ' ', '_') AS subject FROM doc_labels),
  p AS (SELECT a.subject AS expected, b.subject AS predicted FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.rater < b.rater WHERE a.subject IS NOT NULL AND b.subject IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(expected, predicted): the labels of two raters of one document."""
    v = table(spark, sf_dir, "doc_labels").select("doc_id", "rater", F.translate(F.lower(F.trim("subject")), " ", "_").alias("subject")).distinct().where("subject is not null")
    return v.select("doc_id", F.col("rater").alias("r1"), F.col("subject").alias("expected")).join(v.select("doc_id", F.col("rater").alias("r2"), F.col("subject").alias("predicted")), "doc_id").where("r1 < r2").select("expected", "predicted")


@query(_L + " SELECT expected, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_pairs(spark, sf_dir))


@query(
    _L
    + """, c AS (SELECT s AS label, count_if(expected = s AND predicted = s) AS tp, count_if(predicted = s) AS pp, count_if(expected = s) AS ap FROM p, (SELECT DISTINCT expected AS s FROM p UNION SELECT DISTINCT predicted FROM p) GROUP BY s)
  SELECT label, round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 6) AS precision, round(CASE WHEN ap > 0 THEN tp / ap ELSE 0 END, 6) AS recall, round(CASE WHEN pp + ap > 0 THEN 2 * tp / (pp + ap) ELSE 0 END, 6) AS f1 FROM c"""
)
def label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_class(evaluation.confusion(_pairs(spark, sf_dir)))


@query(
    SIG
    + """, p AS (SELECT coherence AS prob, (stability >= 0.5)::INT AS label FROM sig WHERE coherence BETWEEN 0 AND 1), b AS (SELECT least(14, floor(prob * 15)) AS bin, count(*) AS n, avg(prob) AS conf, avg(label) AS acc FROM p GROUP BY 1)
  SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((prob - label) ** 2) FROM p), 6) AS brier, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b"""
)
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = signals(spark, sf_dir).where("coherence between 0 and 1").select(F.col("coherence").alias("prob"), (F.col("stability") >= 0.5).cast("int").alias("label"))
    return evaluation.calibration(p, 15).select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query(
    SIG
    + """, p AS (SELECT coherence AS prob, stability >= 0.5 AS y FROM sig), g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count_if(prob >= threshold AND y) AS tp, count_if(prob >= threshold AND NOT y) AS fp, count_if(prob < threshold AND y) AS fn FROM p, g GROUP BY threshold)
  SELECT threshold, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = signals(spark, sf_dir).select(F.col("coherence").alias("prob"), (F.col("stability") >= 0.5).alias("y"))
    return evaluation.sweep(p, [0.1, 0.3, 0.5, 0.7, 0.9]).withColumn("f1", F.round("f1", 6))


_E = "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"


@query(_E + " SELECT q.vec_id AS query, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank, e.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id QUALIFY rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most similar vectors of every vector whose id is divisible by 100, against all."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(e.where("vec_id % 100 = 0"), e, key="vec_id", vector="embedding", k=5).withColumn("similarity", F.round("similarity", 6))


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS v FROM embeddings) SELECT label, dim::INT - 1 AS dim, round(avg(v::DOUBLE), 6) AS mean FROM e GROUP BY ALL")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


_DIMS = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")


@query(
    SIG
    + """, q AS (SELECT * FROM sig WHERE id % 100 = 0) SELECT q.id AS query, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.coherence - s.coherence) * (q.coherence - s.coherence) + (q.stability - s.stability) * (q.stability - s.stability) + (q.entropy - s.entropy) * (q.entropy - s.entropy) + (q.rupture - s.rupture) * (q.rupture - s.rupture) + (q.lambda_hazard - s.lambda_hazard) * (q.lambda_hazard - s.lambda_hazard)), s.id) AS rank, s.id AS neighbour FROM q JOIN sig s ON s.id <> q.id QUALIFY rank <= 3"""
)
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest windows of every window whose id is divisible by 100, against all."""
    s = store(signals(spark, sf_dir).select("id", *_DIMS))
    return retrieval.knn_scan(s.where("id % 100 = 0"), s, _DIMS, k=3, query_key="id", base_key="id").select("query", "rank", "neighbour")


@query(
    _SP
    + """, h AS (SELECT rec_id, sha256(translate(text, '_', ' ')) AS h FROM sp WHERE text IS NOT NULL), b AS (SELECT rec_id, [('0x' || substr(h, 2 * i - 1, 2))::INT / 255.0 FOR i IN range(1, 33)] AS v FROM h),
  c AS (SELECT rec_id, [x - list_avg(v) FOR x IN v] AS v FROM b), n AS (SELECT rec_id, v, sqrt(8 * list_sum([x * x FOR x IN v])) AS norm FROM c)
  SELECT rec_id, dim::INT AS dim, round(v[dim % 32 + 1] / norm, 6) AS value FROM n, (SELECT unnest(range(0, 256)) AS dim)"""
)
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-embedding of every span text, a row a dimension."""
    v = span_rows(spark, sf_dir).where("text is not null").select("rec_id", spans.hash_embedding(F.col("text")).alias("v"))
    return v.select("rec_id", F.posexplode("v").alias("dim", "value")).select("rec_id", "dim", F.round("value", 6).alias("value"))


@query(
    _SP
    + r""", t AS (SELECT rec_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 8192 AS dim, count(*) AS n FROM (SELECT rec_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM sp WHERE text IS NOT NULL) GROUP BY ALL)
  SELECT rec_id, dim::INT AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY rec_id)), 6) AS value FROM t"""
)
def hashed_token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hashed vectors of spans, of length 1."""
    t = span_rows(spark, sf_dir).where("text is not null").select("rec_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("token"))
    return spans.hash_vector(t, "rec_id", "token").select("rec_id", "dim", F.round("value", 6).alias("value"))


_IR = (
    _ST
    + """, rel AS (SELECT DISTINCT query_window_id AS q, window_id AS d FROM twin_suggestions WHERE distance BETWEEN 0 AND 0.01), run AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY x, d) AS rank FROM (SELECT query_window_id AS q, window_id AS d, min(distance) AS x FROM twin_suggestions WHERE distance >= 0 GROUP BY 1, 2)),
  h AS (SELECT run.q, rank, rel.d IS NOT NULL AS hit FROM run LEFT JOIN rel ON rel.q = run.q AND rel.d = run.d), n AS (SELECT q, count(*) AS n FROM rel GROUP BY q),
  s AS (SELECT n.q, n.n, count_if(hit AND rank <= 5) AS k, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr, coalesce(sum(CASE WHEN hit AND rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM n LEFT JOIN h USING (q) GROUP BY n.q, n.n)
  SELECT count(*) AS n_queries, round(avg(k / 5.0), 6) AS precision_at, round(avg(k / n), 6) AS recall_at, round(avg(rr), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg FROM (SELECT *, list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 5) + 1)]) AS ideal FROM s)"""
)


@query(_IR)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at 5, MRR and nDCG of the suggestions ranked by distance against the near ones."""
    t = table(spark, sf_dir, "twin_suggestions").where("distance >= 0")
    run = t.groupBy(F.col("query_window_id").alias("q"), F.col("window_id").alias("d")).agg(F.min("distance").alias("x"))
    run = run.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("x", "d"))).select("q", "d", "rank")
    rel = t.where("distance <= 0.01").select(F.col("query_window_id").alias("q"), F.col("window_id").alias("d")).distinct()
    m = evaluation.ranking(run, rel, 5)
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in ("precision_at", "recall_at", "mrr", "ndcg")))
