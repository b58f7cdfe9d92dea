"""Spans that stand verbatim in more than one record, by seeding, collinear chaining and alignment.

Seeds are k-mers chosen by winnowing: in every stretch of ``least`` characters the k-mer of least
hash is a seed, so two records that share such a stretch share a seed of it at the same place of the stretch.
Records are joined by seed. For each pair all matches of seeds, repeated ones included, are laid on their
diagonals, where adjoining ones are one anchor; the anchors are chained in the order of both texts with gap costs, the
best predecessor coming from a Fenwick tree of prefix maxima; chains are aligned outwards from their
anchors to exact runs and to the fuzzy passage they span.

A seed in very many records would pair them all whether or not they share ``least`` characters. To find pairs, such
seeds are replaced by the stretches around them, so that every pair they give is a result, and
their groups are paired block by block. Which way a pair is found changes nothing else: its
matches come from both texts. Equal texts are one record here; their copies are members of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.session import meet, small, store

#: Records of a seed from which its stretches take its place in the search for pairs, and records of a block of pairs.
HOT, BLOCK = 200, 256
BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
GAP_COST = 0.05
#: Characters whose grams are hashed together, and matches that are laid on diagonals together.
JOINED, MATCHES = 400_000, 4_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
    return up, down


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of the k characters from each position on, by prefix sums of powers."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(code)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum((code + np.uint64(0x51ED)) * up[:n], dtype=np.uint64)]
        h = (prefix[k:] - prefix[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some ``window`` consecutive ones, the leftmost of equals."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    step = 4096  # windows at a time: memory stays small for any text
    picks = [np.unique(views[i : i + step].argmin(1) + np.arange(i, min(i + step, len(views)))) for i in range(0, len(views), step)]
    return np.unique(np.concatenate(picks))


def seed_places(texts: list[str], k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed, place) of every seed of each text; all texts in one run over their joined characters.

    A gram's hash does not depend on its place, so those of the joined text are those of its parts; grams
    and stretches that cross from one text into the next are masked.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    h = gram_hashes("".join(texts), k)
    w = least - k + 1
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return none, none.view(np.uint64), none
    ends = np.cumsum(sizes)
    # Starts of stretches that lie in one text.
    room = np.maximum(sizes - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), room)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(ends - sizes, room)
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.concatenate([start[i : i + 65_536] + views[start[i : i + 65_536]].argmin(1) for i in range(0, len(start), 65_536)] or [none])
    at, keep = np.unique(at, return_index=True)
    owner = owner[keep]
    return owner, h[at], at - (ends - sizes)[owner]


def _joined(sizes: list[int]) -> list[np.ndarray]:
    """Rows in stretches of about JOINED characters; a longer text is taken alone."""
    part = np.cumsum(sizes) // JOINED
    return [c for c in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1) if len(c)]


def _seeds(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, texts = np.asarray(batch["rep"]), batch["text"].to_pylist()
            for cut in _joined([len(t) for t in texts]):
                i, seed, _ = seed_places([texts[j] for j in cut], k, least)
                order = np.lexsort((seed, i))
                i, seed = i[order], seed[order]
                once = np.r_[len(i) > 0, (i[1:] != i[:-1]) | (seed[1:] != seed[:-1])][: len(i)]
                yield pa.RecordBatch.from_arrays([pa.array(reps[cut][i[once]], pa.int64()), pa.array(seed[once].view(np.int64))], ["rep", "seed"])

    return run


def _stretches(k: int, least: int):
    """The stretches of ``least`` characters whose seed is hot, each as a seed of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, seed = [], []
            for r, t, hot in zip(batch["rep"].to_pylist(), batch["text"], batch["hot"], strict=True):
                text = t.as_py()
                h = gram_hashes(text, k)
                if len(h) < least - k + 1:
                    continue
                whole = gram_hashes(text, least)
                views = np.lib.stride_tricks.sliding_window_view(h, least - k + 1)
                chosen = np.concatenate([views[i : i + 4096].min(1) for i in range(0, len(views), 4096)])
                value = np.unique(whole[np.isin(chosen, np.asarray(hot.as_py(), np.int64).view(np.uint64))])
                rep.append(np.full(len(value), r, np.int64))
                seed.append(value.view(np.int64))
            parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rep, seed)]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64())], ["rep", "seed"])

    return run


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def raise_to(self, i: int, score: float, index: int) -> None:
        i += 1
        while i < len(self.best):
            if score > self.best[i][0]:
                self.best[i] = (score, index)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The greatest among places 0 to i - 1."""
        found = (-np.inf, -1)
        while i > 0:
            if self.best[i][0] > found[0]:
                found = self.best[i]
            i -= i & -i
        return found


def chains(anchors: list[tuple[int, int, int]], gap: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """All anchors (a, b, length) split into collinear chains, the best first, each anchor in one of them.

    A chain's score is its anchors' lengths less ``gap`` for every character between the starts of two that follow
    each other, in either text. With w = score + gap * (a + b) the best predecessor of (a, b) is the greatest w
    among anchors before it in both texts: a prefix maximum over b when a rises. Scores are computed once;
    chains are read off from the best end left back to an anchor that is taken or has no predecessor.
    """
    left = sorted(set(anchors))
    rank = {b: i for i, b in enumerate(sorted({b for _, b, _ in left}))}
    tree = Fenwick(len(rank))
    score, back = [0.0] * len(left), [-1] * len(left)
    i = 0
    while i < len(left):
        j = i
        while j < len(left) and left[j][0] == left[i][0]:  # equal a: none precedes the other
            a, b, n = left[j]
            w, p = tree.upto(rank[b])
            gain = w - gap * (a + b)
            score[j], back[j] = (n + gain, p) if p >= 0 and gain > 0 else (float(n), -1)
            j += 1
        for m in range(i, j):
            a, b, _ = left[m]
            tree.raise_to(rank[b], score[m] + gap * (a + b), m)
        i = j
    out, taken = [], [False] * len(left)
    for at in sorted(range(len(left)), key=lambda m: (-score[m], m)):
        chain = []
        while at >= 0 and not taken[at]:
            taken[at] = True
            chain.append(left[at])
            at = back[at]
        if chain:
            out.append(chain[::-1])
    return out


def _reach(a: str, i: int, b: str, j: int) -> int:
    """Length of the common run from a[i] and b[j] on, by growing and then halving steps."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while step:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        else:
            step = min(step // 2, most - n)
    return n


def align(a: str, b: str, chain: list[tuple[int, int, int]], backward: tuple[str, str] | None = None) -> list[tuple[int, int, int]]:
    """Exact runs (start in a, start in b, length) through the chain's anchors. backward: both texts reversed, if at hand."""
    ra, rb = backward or (a[::-1], b[::-1])
    runs: list[tuple[int, int, int]] = []
    for i, j, _ in chain:
        if runs and runs[-1][0] - runs[-1][1] == i - j and i < runs[-1][0] + runs[-1][2]:
            continue
        right = _reach(a, i, b, j)
        if right:
            left = _reach(ra, len(a) - i, rb, len(b) - j)
            runs.append((i - left, j - left, left + right))
    return runs


def _steps(seed: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """seed, place, step, next step and repeats, by seed and place.

    A step is the distance to the neighbouring place of the same seed, 0 where that is beyond k; repeats are the places
    that follow at the same next step without a break.
    """
    order = np.lexsort((place, seed))
    seed, place = seed[order], place[order]
    gap = np.diff(place)
    gap = np.where((seed[1:] == seed[:-1]) & (gap <= k), gap, 0)
    before, after = np.r_[0, gap][: len(seed)], np.r_[gap, 0][: len(seed)]
    # The last place of a stretch of equal next steps has the fewest repeats, one if there is a step at all.
    last = np.flatnonzero(np.r_[after[1:] != after[:-1], True])[: len(seed)]
    repeats = np.where(after > 0, last[np.searchsorted(last, np.arange(len(seed)))] - np.arange(len(seed)) + 1, 0)
    return seed, place, before, after, repeats


def anchors_of(pa_: np.ndarray, sa: np.ndarray, pb: np.ndarray, sb: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Anchors (a, b, length) of one pair: all matches of its seeds, adjoining ones of a diagonal made one.

    pa_, sa and pb, sb: places and seeds of both texts. Where a seed recurs at the same step in both texts, as in
    periodic ones, a match goes on from the one before it and is only counted into its length. Other matches are formed
    in stretches of about MATCHES, and each stretch leaves only its anchors.
    """
    sa, pa_, ga, na, ra = _steps(sa, pa_, k)
    sb, pb, gb, nb, rb = _steps(sb, pb, k)
    _, code = np.unique(np.r_[sa, sb], return_inverse=True)
    ca, cb = code[: len(sa)].astype(np.int64) * (k + 1), code[len(sa) :].astype(np.int64) * (k + 1)
    order = np.argsort(cb + gb, kind="stable")
    pb, nb, rb, key = pb[order], nb[order], rb[order], (cb + gb)[order]
    lo, hi = np.searchsorted(key, ca, "left"), np.searchsorted(key, ca + k, "right")
    # Those of b with the same step before them are left out.
    low, high = np.where(ga > 0, np.searchsorted(key, ca + ga, "left"), lo), np.where(ga > 0, np.searchsorted(key, ca + ga, "right"), lo)
    n1 = low - lo
    n = n1 + hi - high
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // MATCHES)) + 1

    def merged(a: np.ndarray, d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, diagonals and ends; those that meet on a diagonal become one."""
        order = np.lexsort((a, d))
        a, d, e = a[order], d[order], e[order]
        if not len(a):
            return a, d, e
        # Ends reached so far on each diagonal: ends of a diagonal lie below those of the next.
        span = int(e.max()) + 1
        row = np.cumsum(np.r_[0, d[1:] != d[:-1]])
        reach = np.maximum.accumulate(e + row * span) - row * span
        begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] > reach[:-1])])
        return a[begin], d[begin], np.maximum.reduceat(e, begin)

    got = []
    for part in np.split(np.arange(len(n)), cuts):
        m = n[part]
        i = np.repeat(part, m)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        j = np.where(nth < n1[i], lo[i] + nth, high[i] + nth - n1[i])
        more = np.where((na[i] == nb[j]) & (na[i] > 0), na[i] * np.minimum(ra[i], rb[j]), 0)
        got.append(merged(pa_[i], pa_[i] - pb[j], pa_[i] + k + more))
    a, d, e = merged(*(np.concatenate(x) for x in zip(*got, strict=True)))
    return list(zip(a.tolist(), (a - d).tolist(), (e - a).tolist(), strict=True))


def _check(k: int, least: int):
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch[c].to_pylist() for c in ("a", "b")]
            texts = [batch[c].to_pylist() for c in ("text_a", "text_b")]
            rows = []
            for cut in _joined([len(x) + len(y) for x, y in zip(*texts, strict=True)]):
                # A pair's two texts stand beside each other.
                owner, seed, place = seed_places([t[i] for i in cut for t in texts], k, least)
                begin = np.searchsorted(owner, np.arange(2 * len(cut) + 1))
                for n, i in enumerate(cut.tolist()):
                    x, y, z = begin[2 * n : 2 * n + 3]
                    a, b = texts[0][i], texts[1][i]
                    backward, runs, fuzzy = (a[::-1], b[::-1]), [], 0
                    for chain in chains(anchors_of(place[x:y], seed[x:y], place[y:z], seed[y:z], k)):
                        exact = align(a, b, chain, backward)
                        runs += exact
                        if exact:
                            fuzzy = max(fuzzy, max(s + m for s, _, m in exact) - min(s for s, _, _ in exact))
                    runs = sorted({r for r in runs if r[2] >= least})
                    if runs:
                        best = max(r[2] for r in runs)
                        rows.append((ids[0][i], ids[1][i], best, max(fuzzy, best), [{"s": s, "e": s + m} for s, _, m in runs], [{"s": s, "e": s + m} for _, s, m in runs]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), spans, spans)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "longest", "passage", "in_a", "in_b"])

    return run


def classes(records: DataFrame) -> DataFrame:
    """(id, rep): for each record with a text the least id of those whose text is equal. records: (id, text)."""
    keyed = records.where("text is not null").select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    keyed = store(keyed)
    least = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("id").alias("n"))
    copied = small(least.where("n > 1").select("digest", "rep"))
    return keyed.join(copied, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def block_pairs(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b), a < b, of the items that share a key. Every pair of blocks of a group is a join key of its own, so no task holds a whole group."""
    groups = rows.groupBy(key).agg(F.count(item).alias("g")).where(F.col("g") > BLOCK).select(key, F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    # A group of one block needs no entry; those of several are at most one in BLOCK rows.
    placed = meet(rows.select(key, item), groups, [key], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks").cast("long")).cast("int"))
    left = placed.select(key, F.col(item).alias("x"), F.col("block").alias("bx"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("by"))
    right = placed.select(key, F.col(item).alias("y"), F.col("block").alias("by"), F.explode(F.sequence(F.lit(0), "block")).alias("bx"))
    both = left.join(right, [key, "bx", "by"]).where("x <> y and (bx < by or x < y)")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared(records: DataFrame, *, least: int = 100, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of records (id, text).

    pairs: (a, b, longest, passage, in_a, in_b), a < b, of distinct texts, named by their least ids, that
    share a run of at least ``least`` characters (code points, as stored): the longest run, the
    length of the fuzzy passage around it in a, and the places in both of every such run. members: (id, rep) of
    every record with a text. Null and shorter texts share nothing; an empty table gives none. HOT and BLOCK
    change the way to the pairs, never the rows.
    """
    if not 0 < k <= least:
        raise ValueError("k must lie between 1 and least")
    members = store(classes(records.select("id", "text")))
    reps = members.where("id = rep").select("rep")
    texts = store(records.select(F.col("id").alias("rep"), "text").where(F.length("text") >= least).join(reps, "rep", "left_semi"))
    seeds = store(texts.mapInArrow(_seeds(k, least), "rep long, seed long"))
    sizes = store(seeds.groupBy("seed").agg(F.count("rep").alias("g")).where("g > 1"))
    x, y = (meet(seeds, sizes.where(F.col("g") <= HOT).select("seed"), ["seed"], "left_semi").select("seed", F.col("rep").alias(r)) for r in ("a", "b"))
    pairs = x.join(y, "seed").where("a < b").select("a", "b")
    hot = sizes.where(F.col("g") > HOT).select("seed")
    if hot.limit(1).count():
        per = meet(seeds, hot, ["seed"]).groupBy("rep").agg(F.collect_set("seed").alias("hot"))
        wide = store(texts.join(per, "rep").mapInArrow(_stretches(k, least), "rep long, seed long"))
        pairs = pairs.unionByName(block_pairs(wide, "seed", "rep"))
    full = pairs.distinct().join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    place = "array<struct<s: int, e: int>>"
    found = full.mapInArrow(_check(k, least), f"a long, b long, longest int, passage int, in_a {place}, in_b {place}")
    return store(found), members


def expand(pairs: DataFrame, members: DataFrame, records: DataFrame, *, least: int = 100) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of records, copies among each other included."""
    crowd = members.where("id <> rep").select("rep").distinct()
    copies = store(members.join(small(crowd), "rep", "left_semi"))
    several = small(copies)
    grown = pairs.select("a", "b")
    for c in ("a", "b"):
        m = several.select(F.col("rep").alias(c), F.col("id").alias("_id"))
        grown = grown.join(m, c, "left").withColumn(c, F.coalesce("_id", c)).drop("_id")
    long_ = copies.join(records.where(F.length("text") >= least).select("id"), "id", "left_semi")
    same = block_pairs(long_, "rep", "id")
    return grown.unionByName(same).select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).distinct()


def coverage(pairs: DataFrame, members: DataFrame, records: DataFrame, *, least: int = 100) -> DataFrame:
    """(id, n_chars, shared_chars, n_links): how much of each record stands in another one.

    A record with a copy is shared wholly if it is at least ``least`` long. n_links counts other
    distinct texts that share a run.
    """
    sides = pairs.select(F.col("a").alias("rep"), F.inline("in_a")).unionByName(pairs.select(F.col("b").alias("rep"), F.inline("in_b")))
    spans = F.sort_array(F.collect_set(F.struct("s", "e")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e"))
    merged = sides.groupBy("rep").agg(spans.alias("spans")).select("rep", F.aggregate("spans", zero, step)["n"].alias("covered"))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    crowded = members.where("id <> rep").select("rep").distinct().withColumn("copied", F.lit(True))
    out = records.select("id", F.length("text").alias("n_chars")).join(members, "id", "left").join(merged, "rep", "left").join(links, "rep", "left").join(crowded, "rep", "left")
    share = F.when(F.col("copied") & (F.col("n_chars") >= least), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select("id", "n_chars", share.alias("shared_chars"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
