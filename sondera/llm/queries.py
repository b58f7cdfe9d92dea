"""The pN_ queries: each operator applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions.numbers import unit_value
from sondera.functions.text import strip_blanks
from sondera.llm import cutoffs, leakage, neighbours, percentiles, runs, shared_spans, subjects, term_frequency, tokenise
from sondera.operators.lists import nearest_rows
from sondera.session import cut, latest, small, store, table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequency.marked_terms(term_frequency.latest_candidates(table(spark, sf_dir, "candidates")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


METRICS = ("coherence", "stability", "entropy", "rupture", "lambda_")


def _window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v) of the windows whose five numbers are valid."""
    rows = table(spark, sf_dir, "signature_stats").select("window_id", *METRICS, "updated_at").where("window_id is not null")
    rows = latest(rows, "window_id", "updated_at").select(F.col("window_id").alias("id"), *(unit_value(F.col(m)).alias(m) for m in METRICS)).dropna()
    return store(rows.select("id", F.array(*METRICS).alias("v")))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_rows(_window_vectors(spark, sf_dir), len(METRICS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select(F.least("id", "near").alias("window_a"), F.greatest("id", "near").alias("window_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's neighbours beside the distance that twin_suggestions gives for the pair, if it has one."""
    told = table(spark, sf_dir, "twin_suggestions").where("distance >= 0").groupBy("query_window_id", "window_id").agg(F.min("distance").alias("suggested"))
    found = _neighbours(spark, sf_dir)
    pair = (F.col("id") == told["query_window_id"]) & (F.col("near") == told["window_id"])
    return found.join(told, pair, "left").select(F.col("id").alias("query_window_id"), F.col("near").alias("neighbour_id"), "rank", F.round(F.sqrt("d2"), 6).alias("distance"), "suggested")


#: Of an embedding's neighbours: how many, lists probed beside the own one, vectors of a list, share of tests that may err.
EMBEDDING = {"k": 5, "probes": 6, "list_size": 256, "miss": 0.005, "whole": False}


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(id, v) of the embeddings of full length without null or NaN, and that length."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    ok = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return store(rows.where(ok).dropDuplicates(["id"])), max(0, dims)


def p2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of every embedding, but for a small share; p2_recall gives that share."""
    rows, dims = _embeddings(spark, sf_dir)
    found = neighbours.neighbour_rows(rows, dims, **EMBEDDING)
    return found.select(F.col("id").alias("vec_id"), "rank", F.col("near").alias("neighbour_id"), F.round(F.sqrt("d2"), 6).alias("distance"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, n_queries, recall, compared, rejected, put_back): the found share of the true neighbours of ids divisible by 100, and the test's work."""
    embedded, dims = _embeddings(spark, sf_dir)
    windows = _window_vectors(spark, sf_dir)
    out = None
    for tbl, rows, n, how in (("embeddings", embedded, dims, EMBEDDING), ("signature_stats", windows, len(METRICS), {"k": 3})):
        plain = rows.select(F.col("id").alias("key"), F.col("v").alias("x"))
        true = nearest_rows(plain.where("key % 100 = 0"), plain, n, k=how["k"]).select(F.col("query").alias("id"), "near")
        got = neighbours.neighbour_rows(rows, n, **how).select("id", "near").withColumn("hit", F.lit(1))
        share = true.join(got, ["id", "near"], "left").agg(F.countDistinct("id").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
        one = share.join(neighbours.nearest(rows, n, **how)[1]).select(F.lit(tbl).alias("tbl"), "n_queries", "recall", "compared", "rejected", "put_back")
        out = one if out is None else out.unionByName(one)
    return out


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "spans").select(F.col("rec_id").alias("id"), "text", "loaded_at").where("id is not null")
    return store(latest(rows, "id", "loaded_at").select("id", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _spans(spark, sf_dir)
    return shared_spans.expand(*shared_spans.shared(records), records)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct texts, named by their least records: the longest shared run and the fuzzy passage around it."""
    return shared_spans.shared(_spans(spark, sf_dir))[0].select("a", "b", "longest", "passage")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text, by its least record, of every record with one: with p3_links it says all that p3_found lists."""
    return shared_spans.shared(_spans(spark, sf_dir))[1].select(F.col("id").alias("rec_id"), F.col("rep").alias("text_id"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record's text is found elsewhere, beside its occurrences and number of sources."""
    records = _spans(spark, sf_dir)
    rows = latest(table(spark, sf_dir, "spans").select("rec_id", "occurrences", F.size("sources").alias("n_sources"), "loaded_at"), "rec_id", "loaded_at")
    found = shared_spans.coverage(*shared_spans.shared(records), records)
    return found.join(rows, found["id"] == rows["rec_id"]).select("rec_id", "n_chars", "shared_chars", "n_links", "occurrences", "n_sources")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, grp, coherence, stability, entropy) of signature_stats, one row a window, values valid or null."""
    rows = table(spark, sf_dir, "signature_stats").select("window_id", "source", "coherence", "stability", "entropy", "updated_at")
    rows = latest(rows.where("window_id is not null"), "window_id", "updated_at")
    return rows.select("window_id", F.lower(strip_blanks(F.col("source"))).alias("grp"), *(unit_value(F.col(m)).alias(m) for m in ("coherence", "stability", "entropy")))


def _long(scores: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))
    return scores.where("grp is not null").select("window_id", "grp", F.inline(pairs)).where("v is not null")


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values with greater as better, and the cutoffs that hold for them."""
    long = cut(_long(_scores(spark, sf_dir), ("coherence", "stability", "entropy")))
    values = long.withColumn("v", F.when(F.col("metric") == "entropy", -F.col("v")).otherwise(F.col("v")))
    goals = table(spark, sf_dir, "cutoff_targets").select(F.lower(strip_blanks(F.col("source"))).alias("grp"), "metric", "keep_permille")
    return values, cutoffs.refine_cutoffs(values, goals)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, limits = _kept(spark, sf_dir)
    return values.join(small(limits), ["grp", "metric"]).where("v >= cutoff").select(F.col("grp").alias("source"), "metric", "window_id")


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, limits = _kept(spark, sf_dir)
    sizes = values.join(small(limits), ["grp", "metric"]).where("v >= cutoff").groupBy("grp", "metric").agg(F.count("v").alias("kept"))
    return limits.join(sizes, ["grp", "metric"]).select(F.col("grp").alias("source"), "metric", "keep_permille", "n", F.abs("cutoff").alias("cutoff"), "kept")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "signals").select(F.col("instrument").alias("entity"), F.col("window_start").alias("start"), F.col("window_end").alias("end"), "id", "signature")
    return runs.near_runs(events, numbers=runs.signature_numbers(F.col("signature")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("entity").alias("instrument"), "first_id", "last_id")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("entity").alias("instrument"), "first_id", "last_id", F.col("n").alias("n_events"), F.col("start").alias("run_start"), (F.col("end") - F.col("start")).alias("duration_ms"))


def _percentile_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored values (tbl, grp, metric, v) of every metric that percentile_limits names, and its rows (tbl, metric, pct, lim)."""
    limits = table(spark, sf_dir, "percentile_limits").select("tbl", "metric", "pct", F.col("upper_limit").alias("lim")).where("pct is not null and lim is not null").distinct()
    day = F.date_from_unix_date(F.floor(F.col("window_start") / 86_400_000).cast("int")).cast("string")
    names = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")
    # A handful of rows, a limit each.
    told = limits.select("tbl", "metric").distinct().collect()
    wanted = [m for m in names if any(r.tbl == "signals" and r.metric == m for r in told)]
    stated = tuple(m for m in names[:3] if any(r.tbl == "signature_stats" and r.metric == m for r in told))
    signals = table(spark, sf_dir, "signals").where("id is not null").select("id", "instrument", "window_start", *(F.col(f"metrics.{m}").alias(m) for m in wanted))
    parts = []
    if wanted:
        # Deliveries of one id have the same content, so distinct content is distinct ids.
        pairs = F.array(*(F.struct(F.lit(m).alias("metric"), unit_value(F.col(m)).alias("v")) for m in wanted))
        one = signals.distinct().where("instrument is not null and window_start is not null")
        parts.append(one.select(F.lit("signals").alias("tbl"), F.concat_ws("|", "instrument", day).alias("grp"), F.inline(pairs)).where("v is not null"))
    if stated:
        parts.append(_long(_scores(spark, sf_dir), stated).select(F.lit("signature_stats").alias("tbl"), "grp", "metric", "v"))
    if not parts:
        return spark.createDataFrame([], "tbl string, grp string, metric string, v double"), limits
    return store(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), limits


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 20 values at least whose percentile, read from their sketches, is above a limit."""
    values, limits = _percentile_values(spark, sf_dir)
    return percentiles.above(values, ["tbl", "grp", "metric"], limits, ["tbl", "metric"], least=20).select("tbl", "grp", "metric").distinct()


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 90th percentiles of signals by instrument and day and of signature_stats by source.

    Each is merged from sketches of two halves of the ids.
    """
    names = ("coherence", "stability", "entropy", "rupture", "lambda_hazard")
    day = F.date_from_unix_date(F.floor(F.col("window_start") / 86_400_000).cast("int")).cast("string")
    signals = table(spark, sf_dir, "signals").where("id is not null").select("id", "instrument", "window_start", *(F.col(f"metrics.{m}").alias(m) for m in names)).distinct()
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), unit_value(F.col(m)).alias("v")) for m in names))
    # A null instrument or day names no group.
    signals = signals.where("instrument is not null and window_start is not null").select(F.lit("signals").alias("tbl"), F.concat_ws("|", "instrument", day).alias("grp"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"), F.inline(pairs)).where("v is not null")
    stats = _long(_scores(spark, sf_dir), ("coherence", "entropy")).select(F.lit("signature_stats").alias("tbl"), "grp", F.pmod("window_id", F.lit(2)).alias("half"), "metric", "v")
    keys = ["tbl", "grp", "metric"]
    halves = percentiles.sketch(signals.unionByName(stats), [*keys, "half"])
    merged = store(percentiles.merge(halves.drop("half"), keys=keys))
    return percentiles.read(merged.withColumn("pct", F.explode(F.array(F.lit(50), F.lit(90)))), [*keys, "pct"], F.col("pct")).select(*keys, "pct", F.col("total").alias("n"), F.round("estimate", 6).alias("estimate"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and proximity matches with the number of words found."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slop=1)
    return found.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "kind", "n_words")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = sorted(r.subject for r in table(spark, sf_dir, "subjects").select("subject").distinct().collect() if r.subject)
    return subjects.assign(docs, subjects.fit(docs, table(spark, sf_dir, "doc_labels"), names))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject; a document of several counts under each."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit() and callable(v)}
