import math

import pytest
from pyspark.sql import functions as F

from sondera.functions import chance, kernel, scores
from sondera.functions.text import collapse_blanks, lower_words, words
from sondera.operators import windows


@pytest.mark.parametrize("bits,coherence", [([0] * 32, 0.67900002), ([0, 1] * 16, 0.90786785), ([1] * 32, 0.59683347)])
def test_full_kernel_golden_values(bits, coherence):
    assert kernel.full_kernel(bits)["coherence"] == pytest.approx(coherence, abs=1e-5)


def test_full_kernel_of_ones_collapses_and_bad_bits_give_zeros():
    got = kernel.full_kernel([1] * 32)
    assert got["rupture"] == 1 and got["collapse"] == 1
    assert set(kernel.full_kernel([0, 2, 1]).values()) == {0.0} == set(kernel.full_kernel([]).values())


def test_event_states(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 0],), ([0, 2, 1],), ([],), ([1],)], "b array<int>")
    got = [r[0] for r in df.select(kernel.event_states(F.col("b"))).collect()]
    assert got == [["NULL", "FLIP", "RUPTURE", "FLIP"], [], [], []]


def test_bit_kernel_and_kernel_of_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"), [0] * 32), (2, None, None), (3, bytearray(b"\x5a\x13\x77"), [0, 1])], "k long, d binary, b array<int>")
    rows = df.select(kernel.bit_kernel("b").alias("k")).collect()
    assert rows[0].k.coherence == pytest.approx(0.679) and rows[1].k.coherence == 0
    got = {r.k: r.coherence for r in windows.byte_kernel(df, "k", "d").collect()}
    assert got == {1: kernel.full_kernel([0] * 8 + [1] * 8)["coherence"], 2: 0, 3: kernel.full_kernel([int(x) for x in "010110100001001101110111"])["coherence"]}


def test_throttle_by_hand(spark):
    df = spark.createDataFrame([(0.8, 0.6, 0.5, 0.2, None, None), (0.8, 0.6, 0.5, 0.2, 0.7, 0.9), (-1.0, 0.4, 9.0, 0.2, 0.1, 0.1)], "c double, s double, e double, l double, pc double, ps double")
    got = [r[0] for r in df.select(scores.throttle(*(F.col(c) for c in ("c", "s", "e", "l", "pc", "ps")))).collect()]
    assert got == pytest.approx([0.7 * 0.9 * 0.8, 0.7 * 0.9 * 0.8 / 1.4, 0.0])


def test_filter_names():
    got = scores.parse_filter("c>=0.1, s>0.2,e<=P35,r<0.4,λ<=0.5,pattern>=0.6,connector>0.7")
    assert set(got) == {"coherence", "stability", "entropy", "rupture", "lambda_hazard", "patternability", "connector"} and got["entropy"].is_percentile


def test_signature_dialects(spark):
    df = spark.createDataFrame([(0.0, 0.455, 1.0), (0.125, 0.5, 0.985)], "c double, s double, e double")
    c, s, e = F.col("c"), F.col("s"), F.col("e")
    got = df.select(kernel.signature_plain(c, s, e).alias("a"), kernel.signature_fixed(c, s, e).alias("b"), kernel.signature_milli((c * 1000).cast("int"), (s * 1000).cast("int"), (e * 1000).cast("int")).alias("d")).collect()
    assert [r.a for r in got] == ["c0.0_s0.46_e1.0", "c0.12_s0.5_e0.98"]
    assert got[1].b == "c0.13_s0.50_e0.99" and got[1].d == "c0.125_s0.500_e0.985"
    parts = spark.createDataFrame([("c0.13_s0.5_e1",), ("x",), (None,)], "g string").select(kernel.signature_parts(F.col("g")).alias("p"), kernel.rebucket(F.col("g")).alias("r")).collect()
    assert tuple(parts[0].p) == (0.13, 0.5, 1.0) and parts[1].p is None and parts[0].r == "c0.00_s0.50_e1.00"


def test_filter_language(spark):
    assert scores.parse_filter("coh>=0.5, coh>=0.8,ent<=P35") == {"coherence": scores.Clause("coherence", ">=", 0.8, False), "entropy": scores.Clause("entropy", "<=", 35.0, True)}
    assert scores.parse_filter("") == {}
    for bad in ("what>=1", "coh=1", "coh>=P101", "coh>="):
        with pytest.raises(ValueError):
            scores.parse_filter(bad)
    df = spark.createDataFrame([(0.9, 0.1), (0.8, 0.5), (None, 0.0), (float("nan"), 0.1), (0.2, 0.1)], "coherence double, entropy double")
    assert scores.apply_filter(df, "coh>=0.8").count() == 2
    assert scores.apply_filter(df, "coh>=P0").count() == 3
    assert scores.apply_filter(df, "coh>=0.8,ent<0.5").count() == 1
    assert scores.apply_filter(df.limit(0), "coh>=P50").count() == 0


def test_signals_are_defaulted(spark):
    m = "struct<coherence: double, stability: double, entropy: double, rupture: double, lambda_hazard: double>"
    df = spark.createDataFrame([(1, None, None), (2, (0.5, None, None, 0.3, None), None), (3, (0.5, 0.1, 0.2, 0.3, 0.4), float("nan"))], f"id int, metrics {m}, lambda_hazard double")
    got = {r.id: (r.coherence, r.stability, r.entropy, r.rupture, r.lambda_hazard) for r in scores.normalize_signals(df).collect()}
    assert got == {1: (0, 0, 1, 0, 0), 2: (0.5, 0, 1, 0.3, 0.3), 3: (0.5, 0.1, 0.2, 0.3, 0.4)}


def test_text_columns(spark):
    df = spark.createDataFrame([("  A   b\t\n c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(collapse_blanks(F.col("t"))).collect()] == ["A b c", "", None]
    got = [r[0] for r in spark.createDataFrame([("naïve_x-1 漢字!",), ("__",), (None,)], "t string").select(words(F.col("t"))).collect()]
    assert got == [["naïve", "x", "1", "漢字"], [], []]


def test_lower_words_keep_the_dotted_capital_whole(spark):
    texts = ["İstanbul Ab_C", "ÄÖ X1", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lower_words(F.col("t"))).collect()]
    assert got == [["i̇stanbul", "ab", "c"], ["äö", "x1"], [], []]


def test_chances_equal_sums_of_terms():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.4), (50, 50, 0.9), (400, 210, 0.5), (900, 20, 0.01), (7, 8, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert chance.binomial_at_least(n, k, p) == pytest.approx(want, rel=1e-9, abs=1e-15)
    assert chance.binomial_at_least(10**9, 10**8 + 10_000, 0.1) == pytest.approx(0.1459, abs=2e-3)
    assert chance.meets(20, 3, 4) == pytest.approx(1 - math.comb(16, 3) / math.comb(20, 3)) and chance.meets(5, 4, 2) == 1 and chance.meets(5, 0, 2) == 0
