import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera import session
from sondera.functions import chance, kernel
from sondera.operators import dilution, evaluation, graph, guardrail, lists, market, profiles, reports, retrieval, spans, telemetry, windows
from sondera.operators.prefix import running_total
from sondera.plans import corpus, graphs
from sondera.session import latest

SEEN = {}


def brute_windows(texts, width, step):
    data = b"".join((t or "").encode() + b"\0" for t in texts)
    n = len(data)
    ends = list(range(width, n + 1, step)) if n > width else [n]
    starts = [max(0, e - width) for e in ends]
    if n > width and ends[-1] < n:
        starts.append(n - width)
    out = []
    for i, s in enumerate(starts):
        bits = np.unpackbits(np.frombuffer(data[s : s + width], np.uint8))
        out.append((i, s, int(bits.sum()), int((bits[1:] != bits[:-1]).sum())))
    return out


@pytest.mark.parametrize("width,step,texts", [(64, 32, ["Alpha beta alpha", "Gamma beta delta", None, "", "é" * 90]), (4, 3, ["abc", "d", "", "ef", "ghijk"]), (8, 16, ["x" * 50, "y" * 9]), (64, 32, ["a"])])
def test_byte_windows_over_file_edges(spark, width, step, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    w = windows.byte_windows(windows.byte_files(docs, key="doc_id"), width=width, step=step)
    assert sorted((r.window_id, r.window_start, r.ones, r.transitions) for r in w.collect()) == brute_windows(texts, width, step)


def test_byte_windows_reject_bad_sizes_and_take_no_file(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert windows.byte_windows(windows.byte_files(docs, key="doc_id")).count() == 0
    with pytest.raises(ValueError):
        windows.byte_windows(docs, width=0)


def test_profiles_of_a_small_corpus(spark):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "Gamma beta delta")], "doc_id long, text string")
    files = windows.byte_files(docs, key="doc_id")
    occ = profiles.occurrences(files)
    assert occ.count() == 6
    p = {r.string: r for r in profiles.string_profiles(occ, windows.byte_windows(files), width=64, step=32).collect()}
    assert p["alpha"].occurrences == 2 and set(p) == {"alpha", "beta", "gamma", "delta"}
    assert all(0 <= r[m] <= 1 for r in p.values() for m in profiles.METRICS)


def test_running_total(spark):
    rows = [(i, i % 7 if i % 5 else None) for i in range(300)]
    got = {r.k: r.before for r in running_total(spark.createDataFrame(rows, "k long, v long").repartition(4), ["k"], "v", "before").collect()}
    assert got == {k: sum(v or 0 for _, v in rows[:k]) for k, _ in rows}


def test_latest_keeps_one_row_of_each_key(spark):
    df = spark.createDataFrame([(1, 5, "new"), (1, 2, "old"), (2, None, "only"), (1, 5, "new")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in latest(df, "k", "t").collect()) == [(1, "new"), (2, "only")]


def test_path_dilution(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate("abac")], "e int, i int, s string")
    got = {r.signature: r.path for r in dilution.path_dilution(df, "e", ["i"], "s").collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.0}


def test_semantic_dilution(spark):
    same = spark.createDataFrame([(x, x) for x in "aabbcc"], "s string, t string")
    assert dilution.semantic_dilution(same, "s", "t").first().semantic == pytest.approx(0)
    constant = spark.createDataFrame([(x, "t") for x in "abc"], "s string, t string")
    assert dilution.semantic_dilution(constant, "s", "t").first().semantic == 1
    assert dilution.semantic_dilution(same.limit(0), "s", "t").first().n == 0


def test_signature_qgrams_of_short_and_long_entities(spark):
    df = spark.createDataFrame([("x", 1, 1, "a"), ("x", 2, 2, "b"), ("y", 1, 3, "a"), ("y", 2, 4, "b"), ("y", 3, 5, "c"), ("y", 4, 6, "d")], "e string, o int, k long, s string")
    assert sorted((r.key, r.qgram) for r in retrieval.signature_qgrams(df, "e", ["o"], "s", "k").collect()) == [(2, "a|b"), (5, "a|b|c"), (6, "b|c|d")]


@pytest.mark.parametrize("size", [2048, 20])
def test_knn_scan_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lists, "LIST_SIZE", size)
    monkeypatch.setattr(lists, "PIECE", 3 * size // 2)
    monkeypatch.setattr(lists, "ASKERS", 4)
    monkeypatch.setattr(lists, "BLOCK", 8)
    r = random.Random(1)
    rows = [(i, r.choice([0.0, 0.5, r.random()]), r.choice([0.0, 1.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    got = {}
    for q in retrieval.knn_scan(df.where("k % 29 = 0"), df, ("x", "y"), k=4, query_key="k", base_key="k").orderBy("query", "rank").collect():
        got.setdefault(q.query, []).append(q.neighbour)
    for q, near in got.items():
        want = sorted(((x - rows[q][1]) ** 2 + (y - rows[q][2]) ** 2, k) for k, x, y in rows if k != q)[:4]
        assert near == [k for _, k in want]
    assert len(got) == 11


def test_components_and_betweenness(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (20, 22)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "u long, v long, weight long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    b = {r.node: r.betweenness for r in graph.betweenness(df.where("u < 10")).collect()}
    assert b[2] == pytest.approx(4 / 6) and b[1] == 0
    whole = {r.node: r.betweenness for r in graph.betweenness(df.unionByName(df.selectExpr("u + 1 AS u", "v + 5 AS v", "weight"))).collect()}
    with monkeypatch.context() as m:
        m.setattr(session, "BROADCAST_BYTES", 0)
        joined = {r.node: r.betweenness for r in graph.betweenness(df.unionByName(df.selectExpr("u + 1 AS u", "v + 5 AS v", "weight"))).collect()}
    assert joined == pytest.approx(whole) and max(whole.values()) > 0
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(60)], "u long, v long, weight long")
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_cooccurrence_and_degree(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, None)], "g int, x string")
    assert {(r.u, r.v): r.weight for r in graph.cooccurrence(df, "g", "x").collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert graph.cooccurrence(df, "g", "x", cap=2).count() == 1
    d = {r.node: r.degree for r in graph.degrees(graph.cooccurrence(df, "g", "x")).collect()}
    assert d == {"a": 2, "b": 2, "c": 2}


@pytest.mark.parametrize("block", [4, 256])
def test_cooccurrence_without_a_cap_is_whole(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    r = random.Random(2)
    rows = [(1, f"s{i:03}") for i in range(60)] + [(g, f"s{r.randrange(80):03}") for g in range(2, 9) for _ in range(r.randrange(1, 40))] + [(None, "s001"), (3, None)]
    held = defaultdict(set)
    for g, x in rows:
        if g is not None and x is not None:
            held[g].add(x)
    want = Counter(p for xs in held.values() for p in itertools.combinations(sorted(xs), 2))
    got = graph.cooccurrence(spark.createDataFrame(rows, "g int, x string"), "g", "x", cap=None)
    assert {(e.u, e.v): e.weight for e in got.collect()} == want


def test_theme_edges_take_every_string_of_a_window(spark, tmp_path):
    rows = [(i, f"f{i % 3}", f"string {i:02}", 1, [1, 2]) for i in range(30)]
    schema = "cand_id long, file_id string, text string, occurrences int, window_ids array<long>"
    df = spark.createDataFrame(rows, schema).withColumns({"patternability": F.lit(0.5), "connector": F.lit(0.5), "themes": F.array(F.lit("t")), "loaded_at": F.current_timestamp()})
    df = df.withColumn("metrics", F.struct(*(F.lit(0.5).alias(m) for m in ("coherence", "stability", "entropy", "rupture", "lambda_hazard"))))
    df.write.parquet(str(tmp_path / "candidates.parquet"))
    assert graphs.theme_edges(spark, str(tmp_path)).where("weight = 2").count() == 30 * 29 // 2


@pytest.mark.parametrize("rows_of_a_range", [7, 200_000])
def test_kendall_is_exact_over_all_rows(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(reports, "RANGE", rows_of_a_range)
    r = random.Random(9)
    rows = [(r.choice([0.5, -1.0, r.random() / 100, r.random() * 3]), r.choice([0.25, r.random() / 1000, r.random() * 5])) for _ in range(150)]
    sign = lambda u, v: (u > v) - (u < v)
    pairs = [(sign(p[0], q[0]), sign(p[1], q[1])) for p, q in itertools.combinations(rows, 2)]
    want = sum(u * v for u, v in pairs) / math.sqrt(sum(u != 0 for u, _ in pairs) * sum(v != 0 for _, v in pairs))
    df = spark.createDataFrame([*rows, (None, 0.1), (math.nan, 0.2)], "a double, b double")
    got = reports.kendall(df, "a", "b").first()
    assert got.n == 150 and got.tau == pytest.approx(want, abs=1e-12)
    assert reports.kendall(df.limit(0), "a", "b").first().tau is None


def test_run_length_events_of_documents(spark, tmp_path):
    texts = ["aab", "é\x00\x00", "", None, "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for t in texts:
        bits = "".join(f"{b:08b}" for b in (t or "").encode())
        states = [{"00": "NULL", "11": "RUPTURE"}.get(bits[i : i + 2], "FLIP") for i in range(len(bits) - 1)]
        want.update((s, len(list(g))) for s, g in itertools.groupby(states))
    assert {(e.state, e.length): e.n for e in corpus.run_length_events(spark, str(tmp_path)).collect()} == want


def test_permutation_p(spark):
    rows = [(n, k, m) for n, k, m in itertools.product([1, 5, 12], [0, 1, 3], [0, 1, 4]) if k <= n and m <= n]
    got = spark.createDataFrame(rows, "n long, k long, m long").select("*", chance.permutation_p(F.col("n"), F.col("k"), F.col("m")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(guardrail.exact_permutation_p(r.n, r.k, r.m))
    assert guardrail.exact_permutation_p(5, 2, 3) == pytest.approx(0.9)


def test_lead_times_and_alignment(spark):
    ev = lambda xs: spark.createDataFrame([("t", x) for x in xs], "e string, i long")
    lead = lambda a, f: [r.lead for r in guardrail.lead_times(ev(a), ev(f), "e", "i").orderBy("failure").collect()]
    assert lead([2, 6, 10], [6, 12]) == [0, 2] and lead([3], [1, 8]) == [-2, 5]
    r = guardrail.greedy_alignment(ev([2, 5, 8]), ev([5, 9]), "e", "i", 0).first()
    assert (r.precision, r.recall) == (pytest.approx(1 / 3), 0.5)
    assert guardrail.greedy_alignment(ev([4]), ev([5]), "e", "i", 1).first().f1 == 1


def test_calibration_band(spark):
    df = spark.createDataFrame([(0.95, 0.1, 0.92)] * 4 + [(0.5, 0.5, 0.3)] * 6, "coherence double, entropy double, stability double")
    g = guardrail.threshold_grid(spark, [0.4, 0.9], [0.1, 0.6], [0.2, 0.9])
    best = guardrail.choose_thresholds(guardrail.coverage_grid(df, g), 0.35, 0.45).first()
    assert best.inside and best.coverage == pytest.approx(0.4) and best.max_ent == 0.1


def test_onsets_start_afresh(spark):
    df = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([1, 1, 1, 1, 0, 1, 1, None, 1])], "e string, i int, ok int")
    got = [(r.onset, r.emitted) for r in guardrail.onsets(df, "e", ["i"], "i", F.col("ok") == 1, 2).orderBy("emitted").collect()]
    assert got == [(0, 1), (2, 3), (5, 6)]


def test_as_of_takes_last_before_else_first_after(spark):
    left = spark.createDataFrame([("a", t, f"e{t}") for t in (1, 5, 9)], "k string, t long, id string")
    right = spark.createDataFrame([("a", 4, 0.4), ("a", 6, None), ("a", 8, 0.8), ("b", 1, 1.0)], "k string, t long, v double")
    assert {r.id: r.v for r in market.as_of(left, right, "k", "t", "v").collect()} == {"e1": 0.4, "e5": 0.4, "e9": 0.8}


def test_trades_close_by_their_rules(spark):
    prices = [100, 100, 101, 102, 140, 141, 142]
    rows = [("x", i * 60_000, float(p), 1.0, 1.0, 0.0, 0.1, 5) for i, p in enumerate(prices)]
    rows += [("flat", i * 60_000, 5.0, 1.0, 1.0, 0.0, 0.1, 5) for i in range(4)]
    s = spark.createDataFrame(rows, "instrument string, timestamp_ms long, price double, coherence double, stability double, entropy double, lambda_hazard double, repetition_count long")
    base = (1, 0.5, 0.1, 0.0, 1.0, None, None, "momentum", "unit")
    sets = [(0, *base, 9, None, "BPS", 0.0, 2000.0), (1, *base, 2, None, None, None, None), (2, 99, *base[1:], 2, None, None, None, None), (3, *base[:7], "mean_reversion", "unit", None, 0.05, None, None, None)]
    t = market.simulate_trades(s, spark.createDataFrame(sets, market.PARAMS)).orderBy("params", "entry_ms").collect()
    assert [(r.params, r.reason, r.bars, r.direction) for r in t] == [
        (0, "take_profit", 2, 1), (0, "close_eod", 3, 1), (1, "exit_horizon", 2, 1), (1, "exit_horizon", 2, 1), (1, "close_eod", 1, 1),
        (3, "hazard_exit", 1, -1), (3, "hazard_exit", 1, -1), (3, "hazard_exit", 1, -1), (3, "hazard_exit", 1, -1), (3, "close_eod", 1, -1),
    ]
    assert {r.instrument for r in t} == {"x"}  # equal prices open nothing
    many = spark.range(11_000).select(F.col("id").cast("int").alias("params"), *(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(sets[1][1:], [x.split() for x in market.PARAMS.split(", ")][1:], strict=True)))
    assert market.simulate_trades(s.where("timestamp_ms >= 240000"), many).select("params").distinct().count() == 11_000


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i % 7) - 2, i) for i in range(500)], "k string, v double, i long")
    one, many = (sorted(map(tuple, market.bootstrap(d, "k", "v", "i").collect())) for d in (df.coalesce(1), df.repartition(7, "i")))
    for x, y in zip(one, many, strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])
        assert x[2] < x[1] < x[3]


def test_hot_keys_meet_alike_either_way(spark, monkeypatch):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(400)], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, j long")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    for how in ("inner", "left", "left_semi"):
        plain = rows(session.meet(left, right, ["k"], how))
        with monkeypatch.context() as m:
            m.setattr(session, "BROADCAST_BYTES", 0)
            m.setattr(session, "HOT_ROWS", 50)
            assert rows(session.meet(left, right, ["k"], how)) == plain == rows(left.join(right, ["k"], how))
    monkeypatch.setattr(session, "PAIR_BLOCK", 16)
    assert rows(session.meet_in_blocks(left, right, ["k"])) == rows(left.join(right, ["k"]))


def test_near_duplicates_without_a_block(spark):
    base = spark.createDataFrame([(1, "xalpha signaly"), (2, "omega"), (3, "a much longer text of many words")], "id long, t string")
    ask = spark.createDataFrame([(10, "zalpha signalz"), (11, "quite another text that is far longer than any other one here")], "id long, t string")
    got = {(r.query, r.rank): r.match for r in spans.near_duplicates(ask, base, key="id", text="t").collect()}
    assert got[10, 1] == 1 and (10, 2) not in got and {m for (q, _), m in got.items() if q == 11} == {1, 2, 3}


def test_rolling_equals_brute_force():
    r = np.random.default_rng(1)
    v = np.where(r.random(300) < 0.1, np.nan, r.random(300))
    med, sd = telemetry.rolling(v, 7, 11)
    for i in range(300):
        w = v[max(0, i - 7) : i + 8]
        assert med[i] == pytest.approx(np.nanmedian(w))
        w = v[max(0, i - 11) : i + 12]
        assert sd[i] == pytest.approx(np.nanstd(w, ddof=1))


@pytest.mark.parametrize("stretch", [20_000, 40])
def test_structure_bits_of_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(telemetry, "STRETCH", stretch)
    r = np.random.default_rng(2)
    df = spark.createDataFrame([("a" if i % 4 else "b", i, float(x)) for i, x in enumerate(r.random(600))], "ch string, i int, v double").repartition(3)
    got = {r.i: (r.tokens, round(r.med, 9)) for r in telemetry.structure_bits(df, "ch", ["i"], "v", half_median=5, half_deviation=9).collect()}
    assert len(got) == 600 and SEEN.setdefault("bits", got) == got


@pytest.mark.parametrize("stretch", [8192, 8])
def test_candle_signals_of_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(market, "STRETCH", stretch)
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(n, i * 60_000, *map(float, sorted(r.random(4))), 1.0) for n, k in (("a", 300), ("b", 40), ("c", 5)) for i in range(k)], "instrument string, timestamp_ms long, low double, open double, close double, high double, volume double")
    bits = {n: [x.bit for x in market.with_bits(df).where(F.col("instrument") == n).orderBy("timestamp_ms").collect()] for n in "abc"}
    got = {(x.instrument, x.window_index): (x.coherence, x.timestamp_ms) for x in market.candle_signals(df).collect()}
    want = {}
    for n, b in bits.items():
        width, step = market.window_rule(len(b))
        for k, e in enumerate(range(width, len(b) + 1, step)):
            want[n, k] = (kernel.full_kernel(b[e - width : e])["coherence"], (e - 1) * 60_000)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_window_rule_and_sessions(spark):
    assert [market.window_rule(n)[0] for n in (0, 5, 12, 24, 30, 300)] == [0, 5, 12, 12, 23, 128]
    df = spark.sql("SELECT timestamp'2020-01-01 23:30:00' AS ts UNION ALL SELECT timestamp'2020-01-01 12:00:00'")
    assert df.where(market.in_session(F.col("ts"), *market.SESSIONS["SYD"])).count() == 1


def test_structure_bits_and_interpolation(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 3.0, 2.0, 9.0])], "ch string, i int, v double")
    got = [r.tokens for r in telemetry.structure_bits(df, "ch", ["i"], "v").orderBy("i").collect()]
    assert got[0] == "" and got[1].startswith("UP ACCEL") and "ZPOS" in got[3]
    gap = spark.createDataFrame([("c", 0, None), ("c", 1, 1.0), ("c", 2, None), ("c", 3, 3.0)], "ch string, i int, v double")
    assert [r.v for r in telemetry.interpolate(gap, ["ch"], "i", "v").orderBy("i").collect()] == [None, 1.0, 2.0, 3.0]


def test_gate_blocks_unknown_spans(spark):
    q = spark.createDataFrame([("a",), ("b",)], "k string")
    m = spark.createDataFrame([("a", 3, 0.2, 0.4, 0.5, 0.1)], "k string, repetitions long, lambda_hazard double, semantic double, coherence double, entropy double")
    got = {r.k: (r.admitted, r.entropy, r.lambda_hazard) for r in spans.gate(q, m, "k").collect()}
    assert got == {"a": (True, 0.1, 0.2), "b": (False, 1.0, 1.0)}


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, "alpha signal"), (2, "alpha signel"), (3, "omega thing"), (4, None)], "id long, t string")
    got = {(r.query, r.match): r.distance for r in spans.near_duplicates(df, df, key="id", text="t").collect()}
    assert got == {(1, 2): 1, (2, 1): 1}


def test_hash_embedding_is_deterministic_and_normal(spark):
    df = spark.createDataFrame([("alpha_signal",), ("alpha signal",), ("beta_signal",), (None,)], "t string")
    v = [r.v for r in df.select(spans.hash_embedding(F.col("t"), 32).alias("v")).collect()]
    assert v[0] == v[1] != v[2] and v[3] is None and math.isclose(sum(x * x for x in v[0]), 1)


def test_evaluation_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "expected string, predicted string")
    f1 = {r.label: r.f1 for r in evaluation.per_class(evaluation.confusion(pairs)).collect()}
    assert f1 == {"a": 0.5, "b": pytest.approx(0.666667), "c": 0.0}
    assert evaluation.macro_f1(evaluation.confusion(pairs)).first().n_labels == 3
    p = spark.createDataFrame([(0.9, 1), (0.1, 0)], "prob double, label int")
    assert evaluation.calibration(p, 15).first().brier == pytest.approx(0.01)
    run = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "q string, d string, rank int")
    rel = spark.createDataFrame([("q", "d2"), ("r", "d9")], "q string, d string")
    m = evaluation.ranking(run, rel, 2).first()
    assert (m.n_queries, m.recall_at, m.mrr) == (2, 0.5, 0.25)


def test_phrases_of_many_rare_words_in_little_memory(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    docs = [[f"w{rng.randrange(10**9)}" for _ in range(rng.choice([0, 1, 4, 20_000]))] for _ in range(40)]
    docs += [[rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 60]))] for _ in range(60)] + [["a", "b"]]
    cls, plain = type(spark.range(1)), type(spark.range(1)).mapInArrow
    folder = str(tmp_path)

    def measured(df, f, *args, **kw):
        def run(batches):
            import os
            import tracemalloc
            import uuid

            tracemalloc.start()
            yield from f(batches)
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

        return plain(df, run, *args, **kw)

    monkeypatch.setattr(cls, "mapInArrow", measured)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, w array<string>").coalesce(1)
    got = {(r.size, r.phrase): (r.n, r.n_docs, r.mean_gap, r.gap_variance) for r in profiles.phrases(df, "doc_id", "w", (2, 3, 4, 5), least=5).collect()}
    gaps, count, holders = defaultdict(list), Counter(), Counter()
    for d in docs:
        last = {}
        for n in (2, 3, 4, 5):
            for i in range(len(d) - n + 1):
                k = n, " ".join(d[i : i + n])
                count[k] += 1
                if k in last:
                    gaps[k].append(i - last[k])
                else:
                    holders[k] += 1
                last[k] = i
    want = {k for k, n in count.items() if n >= 5}
    assert set(got) == want and want
    for k in want:
        n, n_docs, mean, variance = got[k]
        assert (n, n_docs) == (count[k], holders[k])
        assert mean is None if not gaps[k] else mean == pytest.approx(np.mean(gaps[k]))
        assert variance is None if len(gaps[k]) < 2 else variance == pytest.approx(np.var(gaps[k], ddof=1))
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 150e6
