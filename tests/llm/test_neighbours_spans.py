import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.llm import neighbours, shared_spans


def brute_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        d = ((x - v) ** 2).sum(1)
        order = sorted((dd, j) for dd, j in zip(d, ids, strict=True) if j != i)[:k]
        out[int(i)] = [int(j) for _, j in order]
    return out


def found(spark, rows, k, **how):
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumns({c: F.lit(1) for c in ("salt", "all", "last", "near", "list")})
    got = {}
    for r in neighbours.neighbour_rows(df, len(rows[0][1]) if rows else 5, k=k, **how).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.near)
    return got


@pytest.mark.parametrize("dims,list_size", [(5, 64), (5, 2000), (2, 32)])
def test_all_neighbours_match_brute_force_with_copies_and_ties(spark, dims, list_size):
    r = np.random.default_rng(4)
    x = np.round(r.random((1200, dims)), 2 if dims == 2 else 3)
    x[:400] = x[0]  # a third are copies
    x[400:430] = x[400:415].repeat(2, 0)
    ids = r.permutation(5000)[:1200]
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)]
    assert found(spark, rows, 3, list_size=list_size) == brute_neighbours(rows, 3)


def test_few_vectors(spark):
    assert found(spark, [], 3) == {}
    assert found(spark, [(7, [0.1, 0.2])], 3) == {}
    assert found(spark, [(7, [0.1, 0.2]), (3, [0.1, 0.2]), (9, [0.5, 0.2])], 3) == {7: [3, 9], 3: [7, 9], 9: [3, 7]}


def test_recall_with_many_dimensions(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((800, 32)) + 3 * r.standard_normal((8, 32))[r.integers(0, 8, 800)]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want, got = brute_neighbours(rows, 5), found(spark, rows, 5, list_size=100)
    assert got == want
    got = found(spark, rows, 5, list_size=100, whole=False, miss=0.005, probes=3)
    assert np.mean([len(set(want[i]) & set(got[i])) / 5 for i in want]) >= 0.9


def test_the_test_rejects_and_exact_mode_puts_back(spark):
    r = np.random.default_rng(3)
    v = r.random((3000, 5))
    x = v @ neighbours.rotation(5)
    order = neighbours.cells(x, neighbours.BLOCK)
    v, x = v[order], x[order]
    shares = neighbours.calibrated(x, 3, 0.02)
    assert shares[0] == 0 and 0 < shares[2] < shares[4] < 1 and shares[5] == 1
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    for whole in (True, False):
        limit = np.full(len(x), np.inf)
        i, j, d2, counts = neighbours.scan(x, x, limit, lambda a, b: ((v[a] - v[b]) ** 2).sum(1), 3, shares, whole, np.arange(len(x)))
        pick = neighbours.best(i, j, d2, 3)
        got = np.full((len(x), 3), np.inf)
        got[i[pick], (np.arange(len(pick)) - np.searchsorted(i[pick], i[pick]))] = d2[pick]
        assert counts[1] > 0 and counts[0] < len(x) ** 2 / 2
        assert np.allclose(got, want) if whole else np.isclose(got, want).mean() > 0.95


def shares(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def brute_pairs(rows, n=100):
    t = sorted((i, x) for i, x in rows if x)
    return {(i, j) for k, (i, a) in enumerate(t) for j, b in t[k + 1 :] if shares(a, b, n)}


def corpus():
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefgh é\U0001f600") for _ in range(n))
    p, q, short = noise(130), noise(100), noise(99)
    texts = [noise(50) + p + noise(80), noise(10) + p, q + p, p[:60] + noise(5) + p[60:], q, noise(20) + q + noise(30), short, short + noise(40), noise(30) + short, None, "", "x", "ab" * 400, "ba" * 90, "z" * 150, "z" * 99 + "y", "0000111100001111" * 20 + q[:50]]
    texts += [texts[0], texts[0], p + noise(20) + q, q + noise(20) + p, noise(3000)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


SEEN = {}


@pytest.mark.parametrize("hot", [200, 1])
def test_shared_runs_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    monkeypatch.setattr(shared_spans, "BLOCK", 2)
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit("x") for c in ("rep", "a", "seed", "s")})
    pairs, members = shared_spans.shared(df)
    got = {tuple(r) for r in shared_spans.expand(pairs, members, df).collect()}
    assert got == brute_pairs(rows)
    full = {(r.a, r.b): (r.longest, r.passage, r.in_a, r.in_b) for r in pairs.collect()}
    assert SEEN.setdefault("full", full) == full  # whatever is hot
    text = dict(rows)
    for (a, b), (longest, _, in_a, in_b) in full.items():
        assert all(text[a][s:e] in text[b] for s, e in in_a) and all(text[b][s:e] in text[a] for s, e in in_b)
        size = max(n for i in range(len(text[a])) for n in [longest + 1] if i + n <= len(text[a]) and text[a][i : i + n] in text[b]) if any(text[a][i : i + longest + 1] in text[b] for i in range(len(text[a]) - longest)) else longest
        assert size == longest
    cover = {r.id: r for r in shared_spans.coverage(pairs, members, df).collect()}
    assert len(cover) == len(rows) and cover[1].shared_chars == len(rows[0][1]) and cover[34].shared_chars == 0
    assert cover[4].shared_chars == 130


def test_coverage_counts_every_copy_on_both_sides(spark):
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    p = noise(120)
    once, twice = "<" + p + ">" + noise(40), p + "|" + noise(30) + "|" + p + "|"
    for texts in ((once, twice), (twice, once)):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        pairs, members = shared_spans.shared(df)
        got = {x.id: x.shared_chars for x in shared_spans.coverage(pairs, members, df).collect()}
        assert [got[texts.index(t)] for t in (once, twice)] == [120, 240]


def test_no_records(spark):
    df = spark.createDataFrame([], "id long, text string")
    pairs, members = shared_spans.shared(df)
    assert shared_spans.expand(pairs, members, df).count() == 0


def test_chains_keep_order_and_take_every_anchor():
    anchors = [(0, 500, 50), (10, 10, 50), (30, 30, 50), (60, 62, 50), (200, 0, 50)]
    chains = shared_spans.chains(anchors)
    assert sorted(x for c in chains for x in c) == sorted(anchors)
    assert chains[0] == [(10, 10, 50), (30, 30, 50), (60, 62, 50)]


def test_many_crossing_anchors_stay_cheap_and_whole():
    anchors = [(i, 20_000 - i, 50) for i in range(20_000)]
    assert sorted(x for c in shared_spans.chains(anchors) for x in c) == anchors


def test_periodic_texts_give_an_anchor_a_diagonal():
    a, b = "-" * 60_000, "x" + "-" * 50_000
    sides = [shared_spans.seed_places([t], 50, 100) for t in (a, b)]
    anchors = shared_spans.anchors_of(sides[0][2], sides[0][1], sides[1][2], sides[1][1], 50)
    assert len(anchors) == len({i - j for i, j, _ in anchors}) <= 110_000
    runs = [r for c in shared_spans.chains(anchors)[:3] for r in shared_spans.align(a, b, c)]
    assert max(n for _, _, n in runs) == 50_000 and max(s + n for _, s, n in runs) == 50_001


def test_anchors_equal_those_of_all_matches():
    r = random.Random(5)
    pieces = ["ab" * 60, "-" * 70, "xyz" * 50, "The quick brown fox jumps over the lazy dog and runs away again. "]
    for _ in range(30):
        a, b = ("".join(r.choice(pieces)[: r.randrange(30, 150)] for _ in range(r.randrange(2, 9))) for _ in "ab")
        (_, sa, xa), (_, sb, xb) = (shared_spans.seed_places([t], 50, 100) for t in (a, b))
        by = {}
        for s, i in zip(sa.tolist(), xa.tolist(), strict=True):
            for t, j in zip(sb.tolist(), xb.tolist(), strict=True):
                if s == t:
                    by.setdefault(i - j, []).append(i)
        want = []
        for d, at in by.items():
            at.sort()
            start = end = None
            for i in at:
                if end is None or i > end:
                    if end is not None:
                        want.append((start, start - d, end - start))
                    start = i
                end = i + 50
            want.append((start, start - d, end - start))
        assert sorted(shared_spans.anchors_of(xa, sa, xb, sb, 50)) == sorted(want)


def test_joined_seeds_equal_those_of_each_text(monkeypatch):
    texts = [t or "" for _, t in corpus()]
    got = set(zip(*(x.tolist() for x in shared_spans.seed_places(texts, 50, 100)), strict=True))
    want = set()
    for i, t in enumerate(texts):
        h = shared_spans.gram_hashes(t, 50)
        at = shared_spans.winnow(h, 51)
        want |= set(zip([i] * len(at), h[at].tolist(), at.tolist(), strict=True))
    assert got == want
    assert all(len(x) == 0 for x in shared_spans.seed_places([], 50, 100))
    i, s, p = shared_spans.seed_places([texts[12], texts[13]], 50, 100)
    sides = (p[i == 0], s[i == 0], p[i == 1], s[i == 1])
    one = shared_spans.anchors_of(*sides, 50)
    monkeypatch.setattr(shared_spans, "MATCHES", 7)
    assert shared_spans.anchors_of(*sides, 50) == one and one


def test_winnow_takes_a_seed_of_every_stretch():
    text = corpus()[-1][1]
    h = shared_spans.gram_hashes(text, 50)
    at = set(shared_spans.winnow(h, 51).tolist())
    assert all(any(i + j in at for j in range(51)) for i in range(len(h) - 50))
    assert (shared_spans.gram_hashes("qq" + text, 50)[2:] == h).all()
