"""Tokens with byte offsets, the windows that cover them, and token profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.operators.windows import bit_sums, byte_windows, layout, metric_tables
TOKEN = regex.compile(r"[\p{L}\p{N}_]+")
METRICS = ["coherence", "stability", "entropy", "rupture", "lambda_hazard"]


def token_spans(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens in lower case with the bytes at which they start and end."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    at = np.array(spans, np.int64).reshape(-1, 2)
    if spans and not text.isascii():
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        at = np.r_[0, np.cumsum(size)][at]
    return [text[a:b].lower() for a, b in spans], at[:, 0], at[:, 1]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, words, starts, ends = [], [], [], []
        for f, t, offset in zip(batch["file_id"].to_pylist(), batch["text"], batch["byte_offset"].to_pylist(), strict=True):
            found, a, b = token_spans(t.as_py())
            words += found
            files += [f] * len(found)
            starts.append(a + offset)
            ends.append(b + offset)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(words, pa.string()), pa.array(flat[0]), pa.array(flat[1])], ["file_id", "string", "byte_start", "byte_end"])


def occurrences(files: DataFrame) -> DataFrame:
    """(file_id, string, byte_start, byte_end) of each token of files (file_id, text, byte_offset), in global bytes."""
    return files.where("text is not null").select("file_id", "text", "byte_offset").mapInArrow(_tokens, "file_id long, string string, byte_start long, byte_end long")


def covering(occurrence: DataFrame, windows: DataFrame, *, width: int, step: int) -> DataFrame:
    """(string, window_id, metrics) for each occurrence and each window that holds it whole.

    Starts are regular, so the covering windows of an occurrence are a range of ids: an equi-join on the
    exploded range instead of an interval join. The one irregular last window is joined apart.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("byte_end") - width) / step)).cast("long")
    last = F.floor(F.col("byte_start") / step).cast("long")
    ids = occurrence.withColumn("lo", first).withColumn("hi", last)
    regular = ids.where("lo <= hi").select("string", F.explode(F.sequence("lo", "hi")).alias("window_id"))
    plain = windows.where(F.col("window_start") == F.col("window_id") * step)
    odd = F.broadcast(windows.where(F.col("window_start") != F.col("window_id") * step))  # one window at most
    tail = occurrence.join(odd, (F.col("byte_start") >= F.col("window_start")) & (F.col("byte_end") <= F.col("window_end")))
    cols = ["string", "window_id", *METRICS]
    return regular.join(plain, "window_id").select(*cols).unionByName(tail.select(*cols))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def patternability(c: Column, s: Column, e: Column, r: Column) -> Column:
    return logistic(0.5 * c + 0.3 * s - 0.2 * e - 0.2 * r)


def connector(centrality: Column, bridging: Column, pmi: Column, entropy: Column, redundancy: Column) -> Column:
    return logistic(0.4 * centrality + 0.3 * bridging + 0.2 * pmi + 0.1 * entropy - 0.2 * redundancy)


PARTIAL = "string string, occurrences long, n_windows long, pairs long, coherence double, stability double, entropy double, rupture double, lambda_hazard double"
FIELDS = [x.split()[0] for x in PARTIAL.split(", ")]
EDGES = "string string, window_id long"


def _scan(width: int, step: int, total: int, last: int, tail: bool, edges: bool):
    """Partial sums of each string over a batch's files (``edges`` false), or its occurrences in windows that cross a file's edge.

    The windows that cover an occurrence are a range of window ids, so sums over them are differences of prefix sums
    over the windows of the file; a window is met as often as occurrences lie in it, and n_windows counts it once a
    string: an occurrence counts those that the string's previous occurrence did not reach.
    """
    entropy, rupture = metric_tables(8 * min(width, total)) if total else (np.zeros(1), np.zeros(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[str] = []
            parts: list[np.ndarray] = []
            crossing: list[np.ndarray] = []
            for t, offset in zip(batch["text"], batch["byte_offset"].to_pylist(), strict=True):
                found, a, b = token_spans(t.as_py())
                if not found:
                    continue
                n_bytes = len(t.as_buffer()) + 1
                # Windows with an end beyond the file on either side.
                first_in, last_in = -(-offset // step), (offset + n_bytes - width) // step
                if total <= width:
                    first_in, last_in = 0, (0 if n_bytes == total else -1)
                lo, hi = np.maximum(0, -((width - b - offset) // step)), np.minimum(last, (a + offset) // step)
                if total <= width:
                    lo, hi = np.zeros_like(a), np.zeros_like(a)
                code = {w: i for i, w in enumerate(dict.fromkeys(found))}
                c = np.array([code[w] for w in found], np.int64)
                order = np.lexsort((a, c))
                c, lo, hi, a, b = c[order], lo[order], hi[order], a[order], b[order]
                names = list(code)
                if edges:
                    # Ids of covering windows outside the file, and the one irregular window at the corpus's end.
                    for x, y in ((lo, np.minimum(hi, first_in - 1)), (np.maximum(lo, max(first_in, last_in + 1)), hi)):
                        n = np.maximum(0, y - x + 1)
                        i = np.repeat(np.arange(len(c)), n)
                        crossing.append(np.stack([c[i] + len(words), x[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)], 1))
                    if tail:
                        i = np.flatnonzero(a + offset >= total - width)
                        crossing.append(np.stack([c[i] + len(words), np.full(len(i), last + 1)], 1))
                    words += names
                    continue
                w = np.arange(max(0, first_in), min(last, last_in) + 1)
                bits, ones, turns = bit_sums(t.as_buffer())
                at = 8 * (w * step - offset)
                size = 8 * min(width, total)
                h, r = entropy[ones[at + size] - ones[at]], rupture[turns[at + size - 1] - turns[at]]
                sums = np.concatenate([np.zeros((5, 1)), np.cumsum([1 - h, 1 - r, h, r, r], axis=1)], axis=1)
                x, y = np.maximum(lo, first_in) - first_in, np.minimum(hi, last_in) - first_in
                some = y >= x
                x, y = np.where(some, x, 0), np.where(some, y + 1, 0)
                # Occurrences of a string stand in order, so windows new to it begin after the furthest reached so far.
                new = np.r_[True, c[1:] != c[:-1]]
                span = len(w) + 1
                reach = np.maximum.accumulate(y + c * span) - c * span
                before = np.where(new, 0, np.r_[0, reach[:-1]])
                fresh = np.maximum(0, y - np.maximum(x, before))
                begin = np.flatnonzero(new)
                rows = np.stack([np.ones(len(c)), fresh, y - x, *(sums[:, y] - sums[:, x])])
                parts.append(np.add.reduceat(rows, begin, axis=1))
                words += names
            if edges:
                both = np.concatenate(crossing) if crossing else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(both[:, 0])), pa.array(both[:, 1])], ["string", "window_id"])
                continue
            flat = np.concatenate(parts, axis=1) if parts else np.zeros((8, 0))
            # One row a string and batch.
            group = pa.table({"string": pa.array(words, pa.string()), **{f: pa.array(v.astype(np.int64) if i < 3 else v) for i, (f, v) in enumerate(zip(FIELDS[1:], flat, strict=True))}})
            group = group.group_by("string").aggregate([(f, "sum") for f in FIELDS[1:]]).rename_columns({f"{f}_sum": f for f in FIELDS[1:]}).select(FIELDS)
            yield from group.to_batches() or [pa.RecordBatch.from_pylist([], schema=group.schema)]

    return run


def corpus_profiles(files: DataFrame, *, width: int, step: int, min_occurrences: int = 1) -> DataFrame:
    """The rows of :func:`string_profiles` from the texts alone: neither windows nor occurrences are written.

    files: a stored :func:`windows.byte_files`. Each file's windows are summed where its text is, and only sums by string are
    shuffled. Windows that cross a file's edge, less than width / step of them a file, are made whole apart and meet the
    few occurrences in them by window id.
    """
    total, last, tail = layout(files, width, step)
    texts = files.where("text <> ''").select("text", "byte_offset")
    inside = texts.mapInArrow(_scan(width, step, total, last, tail, False), PARTIAL)
    crossing = texts.mapInArrow(_scan(width, step, total, last, tail, True), EDGES).groupBy("string", "window_id").agg(F.count(F.lit(1)).alias("k"))
    windows = byte_windows(files, width=width, step=step, crossing=True)
    across = crossing.join(windows, "window_id").select("string", F.lit(0).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("n_windows"), F.col("k").alias("pairs"), *((F.col(m) * F.col("k")).alias(m) for m in METRICS))
    sums = inside.unionByName(across).groupBy("string").agg(*(F.sum(f).alias(f) for f in FIELDS[1:])).where(F.col("occurrences") >= min_occurrences)
    mean = lambda m: F.when(F.col("pairs") > 0, F.col(m) / F.col("pairs")).otherwise(0.0)
    out = sums.select("string", "occurrences", "n_windows", *(mean(m).alias(m) for m in METRICS))
    return out.withColumn("patternability", patternability(*(F.col(m) for m in METRICS[:4])))


def string_profiles(occurrence: DataFrame, windows: DataFrame, *, width: int, step: int, min_occurrences: int = 1) -> DataFrame:
    """(string, occurrences, n_windows, mean metrics, patternability) of each token.

    Means run over pairs of an occurrence and a covering window; uncovered occurrences count as
    occurrences only, and a token without any window has metrics 0.
    """
    counts = occurrence.groupBy("string").agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") >= min_occurrences)
    per = covering(occurrence, windows, width=width, step=step).groupBy("string", "window_id").agg(F.count(F.lit(1)).alias("k"), *(F.first(m).alias(m) for m in METRICS))
    means = per.groupBy("string").agg(F.count(F.lit(1)).alias("n_windows"), *((F.sum(F.col(m) * F.col("k")) / F.sum("k")).alias(m) for m in METRICS))
    out = counts.join(means, "string", "left").fillna(0)
    return out.withColumn("patternability", patternability(*(F.col(m) for m in METRICS[:4])))


#: Slots of phrase hashes in bits, of them those that number the range, and those that a bit of the filter stands for.
SLOT, RANGE, COARSE = 36, 10, 8
#: Words of a piece that is worked on at once (a longer document is a piece of its own), and slots a task or a range holds before it merges or sends them.
PIECE, HELD = 1 << 21, 1 << 22
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole documents of a batch, about PIECE words at once, with the places where their words start and the last ends."""
    for batch in batches:
        at = batch.column(0).offsets.to_numpy()
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            yield batch.slice(i, j - i), at[i : j + 1]
            i = j


def _phrase_slots(words: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, whether a phrase of n words starts there, its slot) for every word of a piece; words are hashes."""
    rest = np.repeat(starts[1:] - starts[0], np.diff(starts)) - np.arange(len(words), dtype=np.int32)
    h = words.view(np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h, k = h.copy(), max(0, len(h) - n + 1)
            h[:k] = h[:k] * np.uint64(0x9E3779B97F4A7C15) + words.view(np.uint64)[n - 1 :]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        if n in sizes:
            yield n, rest >= n, h >> np.uint64(64 - SLOT)


def _summed(parts: list[np.ndarray], cap: int) -> np.ndarray:
    """Entries (slot * 8 + count) as one sorted array, equal slots added up to ``cap``."""
    x = np.concatenate(parts)
    x.sort()
    if not len(x):
        return x
    first = np.flatnonzero(np.r_[True, (x[1:] ^ x[:-1]) > 7])
    k = np.minimum(np.add.reduceat((x & x.dtype.type(7)).astype(np.uint8), first, dtype=np.uint32), cap)
    return x[first] & ~x.dtype.type(7) | k.astype(x.dtype)


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 as differences, byte by byte, compressed."""
    d = np.diff(x.astype("<u4"), prepend=np.uint32(0))
    return pa.compress(d.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _slot_counts(sizes: tuple[int, ...], cap: int):
    """Slots of a task's phrases with their counts, a packed row a range of slots."""
    width = SLOT - RANGE

    def rows(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(x, np.arange((1 << RANGE) + 1, dtype=np.uint64) << np.uint64(width + 3))
        some = np.flatnonzero(np.diff(edges))
        if len(some):
            mask = np.uint64((1 << width + 3) - 1)
            blobs = [_packed(x[edges[r] : edges[r + 1]] & mask) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(edges)[some]), pa.array(blobs, pa.binary())], ["r", "k", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for piece, starts in _pieces(batches):
            words = piece.column(0).flatten().to_numpy()
            for _, there, slot in _phrase_slots(words, starts, sizes):
                held.append(_summed([slot[there] << np.uint64(3) | np.uint64(1)], cap))
                if sum(map(len, held)) > HELD:
                    held = [_summed(held, cap)]
                    if len(held[0]) > HELD:
                        yield from rows(held.pop())
        if held:
            yield from rows(_summed(held, cap))

    return run


def _often(cap: int):
    """Of each range of slots, sorted by it, the filter's bits of slots counted ``cap`` times, compressed."""
    size = 1 << SLOT - RANGE - COARSE

    def bits(r: int, held: list[np.ndarray]) -> pa.RecordBatch:
        x = _summed(held, cap)
        on = np.zeros(size, np.uint8)
        on[x[x & np.uint32(7) >= cap] >> np.uint32(3 + COARSE)] = 1
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pa.compress(np.packbits(on, bitorder="little").tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["r", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for r, k, blob in zip(batch["r"].to_pylist(), batch["k"].to_pylist(), batch["slots"], strict=True):
                if r != now and held:
                    yield bits(now, held)
                    held = []
                now = r
                held.append(_unpacked(blob.as_py(), k))
                if len(held) > 1 and len(held[0]) < HELD < sum(map(len, held)) or len(held) > 1000:
                    held = [_summed(held, cap)]
        if held:
            yield bits(now, held)

    return run


def _phrase_rows(sizes: tuple[int, ...], often: dict[int, bytes] | None):
    """Figures of a piece's phrases; with ``often``, of those whose bit in the filter is set, as are those of the phrases in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << SLOT - RANGE - COARSE - 3
        if often is not None:
            table = np.zeros((1 << RANGE, size), np.uint8)
            for r, b in often.items():
                table[r] = np.frombuffer(pa.decompress(b, size, codec="zstd", asbytes=True), np.uint8)
            table = table.ravel()
        for piece, starts in _pieces(batches):
            hashes, words = piece.column(0).flatten().to_numpy(), piece.column(1).flatten()
            code = words.dictionary_encode()
            n_words, code = len(code.dictionary), code.indices.to_numpy()
            doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
            # Of the size before: its phrases' starts, and a number of each phrase by the place where it starts.
            m, before, ids = 1, np.ones(len(code), bool), code
            for n, there, slot in _phrase_slots(hashes, starts, sizes):
                if often is not None:
                    k = max(0, len(there) - n + m)
                    there[:k] &= before[:k] & before[n - m :]
                    at = np.flatnonzero(there)
                    bit = slot[at] >> np.uint64(COARSE)
                    at = at[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                else:
                    at = np.flatnonzero(there)
                own = ids[at]
                for j in range(m, n):
                    own = pa.array(own.astype(np.int64) * n_words + code[at + j]).dictionary_encode().indices.to_numpy()
                m, before, ids = n, np.zeros(len(code), bool), np.zeros(len(code), np.int32)
                before[at], ids[at] = True, own
                if not len(at):
                    continue
                order = np.argsort(own, kind="stable")
                own, at = own[order], at[order]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                again = np.r_[False, (own[1:] == own[:-1]) & (doc[at[1:]] == doc[at[:-1]])]
                gap = np.where(again, np.diff(at, prepend=0), 0)
                count = np.diff(np.r_[first, len(at)])
                figures = [count, count - np.add.reduceat(again.astype(np.int64), first), np.add.reduceat(gap, first), np.add.reduceat(gap * gap, first)]
                for i in range(0, len(first), 1 << 16):
                    some = slice(i, i + (1 << 16))
                    start = at[first[some]]
                    text = pc.binary_join_element_wise(*(words.take(pa.array(start + j)) for j in range(n)), " ")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), n, np.int32)), text, *(pa.array(f[some]) for f in figures)], ["size", "phrase", "n", "n_docs", "gaps", "squares"])

    return run


def phrases(docs: DataFrame, key: str, words: str, sizes: tuple[int, ...], *, least: int = 2) -> DataFrame:
    """(size, phrase, n, n_docs, mean_gap, gap_variance) of the phrases of ``sizes`` words that stand ``least`` times or more.

    A gap is the distance between two places of a phrase that follow each other in a document; without one its figures are null, the variance
    with one alone. docs: one row a document, words an array.

    A first pass counts slots of phrase hashes, packed to about two bytes each, and leaves a filter of 32 MB at most; it passes every phrase that stands
    often enough and some that don't. The second pass makes, groups and sums the phrases that pass, by their words, and drops those below ``least``.
    """
    sizes = tuple(sorted(sizes))
    hashes = F.transform(words, lambda x: F.xxhash64(x)).alias("h")
    often = None
    if least > 1:
        cap = min(least, 7)
        conf, was = docs.sparkSession.conf, docs.sparkSession.conf.get(CLEANUP, "false")
        # The packed slots leave the disk once they are counted, before the second pass writes.
        conf.set(CLEANUP, "true")
        try:
            slots = docs.select(hashes).mapInArrow(_slot_counts(sizes, cap), "r int, k long, slots binary")
            found = slots.repartition("r").sortWithinPartitions("r").mapInArrow(_often(cap), "r int, bits binary")
            often = {r: bytes(b) for r, b in found.collect()}
        finally:
            conf.set(CLEANUP, was)
    rows = docs.select(hashes, F.col(words).alias("w")).mapInArrow(_phrase_rows(sizes, often), "size int, phrase string, n long, n_docs long, gaps long, squares long")
    g = rows.groupBy("size", "phrase").agg(*(F.sum(c).alias(c) for c in ("n", "n_docs", "gaps", "squares"))).where(F.col("n") >= least)
    k = F.col("n") - F.col("n_docs")
    return g.select("size", "phrase", "n", "n_docs", F.when(k > 0, F.col("gaps") / k).alias("mean_gap"), F.when(k > 1, (F.col("squares") - F.col("gaps").cast("double") * F.col("gaps") / k) / (k - 1)).alias("gap_variance"))
