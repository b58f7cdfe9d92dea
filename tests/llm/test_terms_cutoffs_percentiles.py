import math
import random
from collections import defaultdict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sondera.llm import cutoffs, percentiles, queries, runs, term_frequency


def brute_terms(rows):
    total, files = defaultdict(int), defaultdict(set)
    for t, f, n in rows:
        if t is not None:
            total[t] += max(n or 0, 0)
            files[t] |= {f} - {None}
    return {t: (total[t], len(files[t])) for t in total}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.9])
def test_terms_match_brute_force_with_a_hot_term(spark, share):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.4 else f"t{r.randrange(60)}", r.choice(["a", "b", None, f"f{r.randrange(30)}"]), r.choice([None, -2, 0, 1, 5])) for _ in range(3000)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "term string, file string, n int").withColumn("total", F.lit("clash")).repartition(5)
    got = {r.term: (r.total, r.files) for r in term_frequency.term_frequencies(df, share=share).collect()}
    assert got == brute_terms(rows)


def test_terms_of_one_hot_file(spark):
    rows = [(f"t{i % 7}", "f" if i % 3 else f"g{i}", 1) for i in range(600)]
    got = {r.term: (r.total, r.files) for r in term_frequency.term_frequencies(spark.createDataFrame(rows, "term string, file string, n int")).collect()}
    assert got == brute_terms(rows)


def test_a_long_heavy_term_is_counted_in_place(spark):
    rows = [("x" * 20_000, f"f{i % 9}", 2) for i in range(300)] + [(f"t{i}", "f", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, file string, n int")
    assert len(term_frequency.heavy_terms(df, 0.2)) <= 5
    for share in (0.2, 0.9999):
        assert {r.term: (r.total, r.files) for r in term_frequency.term_frequencies(df, share=share).collect()} == brute_terms(rows)


def test_heavy_terms_without_files_and_counts_stay(spark):
    rows = [("bare", None, n) for n in (None, 0, -3) * 50] + [("once", None, None), ("full", "f", 2)]
    df = spark.createDataFrame(rows, "term string, file string, n int").repartition(3)
    assert len(term_frequency.heavy_terms(df, 0.001)) == 3
    got = {r.term: (r.total, r.files, r.mark) for r in term_frequency.marked_terms(df).collect()}
    assert got == {"bare": (0, 0, "rare"), "once": (0, 0, "rare"), "full": (2, 1, "rare")}


def test_marks_spelling_deliveries_and_empty_table(spark):
    schema = "cand_id long, file_id string, text string, occurrences int, loaded_at timestamp, term string"
    rows = [(1, "a", " Big  Word ", 9, 1, "x"), (1, "a", "big word", 2, 2, "x"), (2, "b", "BIG\tword", 4, 1, "x"), (3, None, "solo", 50, 1, "x"), (4, "c", "  ", 3, 1, None), (5, "c", None, None, 1, None)]
    from datetime import datetime

    df = spark.createDataFrame([(*r[:4], datetime(2020, 1, r[4]), r[5]) for r in rows], schema)
    got = {r.term: (r.total, r.files, r.mark) for r in term_frequency.marked_terms(term_frequency.latest_candidates(df)).collect()}
    assert got == {"big word": (6, 2, "common"), "solo": (50, 0, "rare")}
    assert term_frequency.marked_terms(term_frequency.latest_candidates(df.limit(0))).count() == 0


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_cutoffs_match_sorting(spark, bins):
    r = random.Random(5)
    values = [("g0" if r.random() < 0.5 else f"g{r.randrange(1, 4)}", "m", r.choice([0.5, 1.0, r.random(), r.random() * 1e-9])) for _ in range(2000)]
    targets = [(f"g{i}", "m", k) for i, k in enumerate([20, 500, 1000, None])] + [("none", "m", 10)]
    v, t = spark.createDataFrame(values, "grp string, metric string, v double"), spark.createDataFrame(targets, "grp string, metric string, keep_permille int")
    v = v.withColumns({c: F.lit(0) for c in ("lo", "hi", "rank", "n", "keep_permille")})
    got = {x.grp: x.cutoff for x in cutoffs.refine_cutoffs(v, t, bins=bins).collect()}
    want = {}
    for g, _, k in targets:
        own = sorted((x for h, _, x in values if h == g), reverse=True)
        if own and k is not None:
            want[g] = own[max(1, math.ceil(len(own) * k / 1000)) - 1]
    assert got == want


def test_cutoffs_of_empty_tables_and_equal_values(spark):
    v = spark.createDataFrame([("a", "m", 0.3)] * 5, "grp string, metric string, v double")
    t = spark.createDataFrame([("a", "m", 400)], "grp string, metric string, keep_permille int")
    assert cutoffs.refine_cutoffs(v, t).first().cutoff == 0.3
    assert cutoffs.refine_cutoffs(v.limit(0), t).count() == 0 and cutoffs.refine_cutoffs(v, t.limit(0)).count() == 0


def test_percentiles_keep_their_error_and_merge(spark):
    r = random.Random(9)
    values = [(r.choice("ab"), r.choice([0.0, -r.expovariate(1), r.expovariate(0.01), float("nan"), None, 1e-12])) for _ in range(4000)]
    df = spark.createDataFrame(values, "g string, v double")
    whole = percentiles.sketch(df, ["g"], error=0.01)
    halves = [percentiles.sketch(df.where(F.hash("v") % 2 == k), ["g"], error=0.01) for k in (0, 1, -1)]
    merged = percentiles.merge(*halves, keys=["g"])
    for pct in (1, 50, 90, 100):
        one = {x.g: x.estimate for x in percentiles.read(whole, ["g"], F.lit(pct), error=0.01).collect()}
        two = {x.g: x.estimate for x in percentiles.read(merged, ["g"], F.lit(pct), error=0.01).collect()}
        assert one == two
        for g in "ab":
            own = sorted(v for h, v in values if h == g and v is not None and not math.isnan(v))
            true = own[max(1, math.ceil(pct / 100 * len(own))) - 1]
            assert abs(one[g] - true) <= 0.0101 * abs(true)
    assert percentiles.read(percentiles.sketch(df.limit(0), ["g"]), ["g"], F.lit(50)).count() == 0


def test_several_percents_and_limits_of_one_group(spark):
    r = random.Random(12)
    values = [(g, m, r.choice([0.2, 0.5, r.random(), r.uniform(0.498, 0.502)])) for g in "abcd" for m in "xy" for _ in range({"a": 19, "b": 20, "c": 333, "d": 90}[g])]
    limits = [(m, pct, lim) for m in "xy" for pct in (1, 50, 90, 100) for lim in (0.2, 0.4999, 0.5, 0.5005, 0.9)]
    v, t = spark.createDataFrame(values, "g string, m string, v double").withColumn("n", F.lit(1)), spark.createDataFrame(limits, "m string, pct int, lim double")
    got = {(x.g, x.m, x.pct, x.lim) for x in percentiles.above(v, ["g", "m"], t, ["m"], least=20).collect()}
    want = set()
    for g in "bcd":
        for m, pct, lim in limits:
            own = sorted(x for h, k, x in values if (h, k) == (g, m))
            if own[math.ceil(pct * len(own) / 100) - 1] > lim:
                want.add((g, m, pct, lim))
    assert got == want
    assert percentiles.above(v.limit(0), ["g", "m"], t, ["m"]).count() == 0 and percentiles.above(v, ["g", "m"], t.limit(0), ["m"]).count() == 0


def test_collapse_joins_near_symbols_across_repeats():
    import numpy as np

    v = [np.array([5, 5, 7, 7, 7, 40, 40, 40, 5]), np.zeros(9, int), np.zeros(9, int)]
    code = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    ok = np.array([1, 1, 1, 1, 0, 1, 1, 1, 1], bool)
    assert runs.collapse(code, ok, v, 2) == [(0, 4), (5, 6), (6, 8), (8, 9)]
    assert runs.collapse(code, ~ok & False, v, 2) == [] and runs.collapse(code[:0], ok[:0], [x[:0] for x in v], 2) == []


def brute_runs(events, step=10_000):
    out, by = set(), defaultdict(dict)
    for e, t, _, i, *n in events:
        if e is not None and t is not None:
            by[e][(t, i)] = n
    for e, rows in by.items():
        cur = []
        for (_, i), n in sorted(rows.items()):
            if cur and n[0] is not None and all(abs(x - y) <= step for x, y in zip(n, cur[-1][1], strict=True)):
                cur.append((i, n))
                continue
            if len(cur) > 1:
                out.add((e, cur[0][0], cur[-1][0], len(cur)))
            cur = [(i, n)] if n[0] is not None else []
        if len(cur) > 1:
            out.add((e, cur[0][0], cur[-1][0], len(cur)))
    return out


@pytest.mark.parametrize("seed,batch", [(1, 10_000), (2, 7), (3, 64)])
def test_runs_match_brute_force_over_partitions_and_batches(spark, seed, batch):
    r = random.Random(seed)
    events = []
    for i in range(1500):
        e = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c"])
        n = (None, None, None) if r.random() < 0.08 else tuple(10_000 * r.randrange(0, 3) if r.random() < 0.5 else 10_000 for _ in range(3))
        events.append((e, r.randrange(0, 4000), None, i, *n))
    events += r.sample(events, 100)  # delivered again
    events += [(None, 1, 2, 9000, 1, 1, 1), ("a", None, 2, 9001, 1, 1, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(events, "entity string, start long, end long, id long, a long, b long, c long").repartition(3)
        got = {(x.entity, x.first_id, x.last_id, x.n) for x in runs.near_runs(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_runs(events)
    assert runs.near_runs(df.limit(0)).count() == 0


def test_signature_numbers(spark):
    texts = [" C0.10 _s0.5_e1.0 ", "c0.1_s0.500_e1", "c0.1_s0.5", "n/a", "", None, "c1e3_s0_e0"]
    a, b, c = runs.signature_numbers(F.col("s"))
    got = [tuple(x) for x in spark.createDataFrame([(t,) for t in texts], "s string").select(a, b, c).collect()]
    assert got == [(100_000, 500_000, 1_000_000)] * 2 + [(None, None, None)] * 5


def test_percentiles_of_signals_and_sources(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.tbl, r.grp, r.metric, r.pct): (r.n, r.estimate) for r in queries.p6_percentiles(spark, sf).collect()}
    want = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/signals.parquet").where("id is not null and instrument is not null and window_start is not null").select("id", "instrument", "window_start", "metrics").collect():
        day = datetime.fromtimestamp(r.window_start / 1000, UTC).date()
        for m in ("coherence", "stability", "entropy", "rupture", "lambda_hazard"):
            v = r.metrics and r.metrics[m]
            if v is not None and 0 <= v <= 1:
                want["signals", f"{r.instrument}|{day}", m][r.id] = v
    assert {k[:3] for k in got if k[0] == "signals"} == set(want) and any(k[0] == "signature_stats" for k in got)
    for key, values in want.items():
        for pct in (50, 90):
            n, estimate = got[*key, pct]
            true = sorted(values.values())[max(1, math.ceil(pct * len(values) / 100)) - 1]
            assert n == len(values) and estimate == pytest.approx(true, rel=0.0101, abs=1e-6)
