"""Sliding windows over the concatenated bytes of a corpus.

Files follow each other in the order of their id, a NUL byte after each. A window that lies in one
file is counted where the file is; only the pieces of windows that cross into another file meet in
a shuffle. The counts (ones, transitions) are prefix-sum differences over numpy bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.kernel import FIELDS, kernel_rows, signature_plain, simple_metrics
from sondera.operators.prefix import running_total
from sondera.session import small

COUNTS = "window_id long, at long, size int, ones int, transitions int, first_bit int, last_bit int"


def byte_files(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """(file_id, text, n_bytes, byte_offset): each text, null as empty, and the place of its UTF-8 bytes and NUL.

    Only ids and lengths are put in order; the texts meet their offsets in one join.
    """
    files = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("file_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = files.select("file_id", (F.octet_length("text") + 1).cast("long").alias("n_bytes"))
    return files.join(small(running_total(sizes, ["file_id"], "n_bytes", "byte_offset")), "file_id")


def bit_sums(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the bytes and a NUL after them; ones and transitions before each bit."""
    bits = np.unpackbits(np.append(np.frombuffer(data, np.uint8), np.uint8(0)))
    return bits, np.r_[0, np.cumsum(bits, dtype=np.int64)], np.r_[0, np.cumsum(bits[1:] != bits[:-1], dtype=np.int64)]


def metric_tables(n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy by number of ones, and rupture by number of transitions, of a window of ``n_bits``."""
    p = np.arange(n_bits + 1) / n_bits
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.nan_to_num(-p * np.log2(p)) + np.nan_to_num(-(1 - p) * np.log2(1 - p))
    return h, np.arange(n_bits) / max(1, n_bits - 1)


def layout(files: DataFrame, width: int, step: int) -> tuple[int, int, bool]:
    """(bytes of the corpus, id of the last regular window, whether one more window ends with the corpus)."""
    if width <= 0 or step <= 0:
        raise ValueError("width and step must be positive")
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    return total, max(0, (total - width) // step), total > width and (total - width) % step != 0


def _pieces(width: int, step: int, total: int, tail: bool):
    last = max(0, (total - width) // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for data, offset in zip(batch["text"], batch["byte_offset"].to_pylist(), strict=True):
                bits, ones, turns = bit_sums(data.as_buffer())
                end = offset + len(bits) // 8
                # Windows that share a byte with this file.
                lo, hi = max(0, (offset - width) // step + 1), min(last, (end - 1) // step)
                w = np.arange(lo, hi + 1, dtype=np.int64)
                start = w * step
                if tail and end > total - width:
                    w, start = np.r_[w, last + 1], np.r_[start, total - width]
                a, b = np.maximum(start, offset) - offset, np.minimum(np.minimum(start + width, total), end) - offset
                ok = b > a
                w, a, b = w[ok], a[ok], b[ok]
                if not len(w):
                    continue
                values = (w, a + offset, b - a, ones[8 * b] - ones[8 * a], turns[8 * b - 1] - turns[8 * a], bits[8 * a], bits[8 * b - 1])
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flat, types, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    return run


def byte_windows(files: DataFrame, *, width: int = 64, step: int = 32, crossing: bool = False) -> DataFrame:
    """(window_id, window_start, window_end, ones, transitions, metrics) of every window.

    Starts are multiples of ``step``; if the last such window ends before the corpus does, one more of full
    width ends with it. A corpus of at most ``width`` bytes is one window. files: :func:`byte_files`.
    An empty table has no window. With ``crossing`` only windows that do not lie in one file are given, and the irregular last one.
    """
    total, _, tail = layout(files, width, step)
    pieces = files.select("text", "byte_offset").mapInArrow(_pieces(width, step, total, tail), COUNTS)
    size = min(width, total)
    odd = (F.col("window_id") > max(0, (total - width) // step)) if crossing else F.lit(True)
    done = pieces.where((F.col("size") == size) & odd).select("window_id", F.col("at").alias("window_start"), "ones", "transitions")
    order = Window.partitionBy("window_id").orderBy("at")
    seam = (F.col("first_bit") != F.lag("last_bit").over(order)).cast("int")
    parts = pieces.where(F.col("size") < size).withColumn("seam", F.coalesce(seam, F.lit(0)))
    joined = parts.groupBy("window_id").agg(F.min("at").alias("window_start"), F.sum("ones").cast("int").alias("ones"), F.sum(F.col("transitions") + F.col("seam")).cast("int").alias("transitions"))
    all_ = done.unionByName(joined).withColumn("n_bits", F.lit(8 * size))
    m = simple_metrics(F.col("ones"), F.col("transitions"), F.col("n_bits"))
    return all_.select("window_id", "window_start", (F.col("window_start") + size).alias("window_end"), "ones", "transitions", *(v.alias(k) for k, v in m.items()))


def event_counts(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, nulls, flips, ruptures): events between neighbouring bits of each binary value, most significant first.

    A value of less than a byte has none. A null value counts as empty.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, d in enumerate(batch["d"]):
                bits = np.unpackbits(np.frombuffer(d.as_buffer(), np.uint8)) if d.is_valid else np.zeros(0, np.uint8)
                both, flips = int((bits[1:] & bits[:-1]).sum()), int((bits[1:] != bits[:-1]).sum())
                out[:, i] = max(0, len(bits) - 1) - both - flips, flips, both
            yield pa.RecordBatch.from_arrays([batch["k"], *map(pa.array, out)], [key, "nulls", "flips", "ruptures"])

    return files.select(F.col(key).alias("k"), F.col(data).alias("d")).mapInArrow(run, f"{key} {kind}, nulls long, flips long, ruptures long")


def byte_kernel(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, coherence, entropy, flip, rupture, lambda_hazard, collapse): the full event kernel over the bits of each binary value.

    Most significant bit first. A null or empty value gives zeros.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernel_rows(np.unpackbits(np.frombuffer(d.as_buffer(), np.uint8) if d.is_valid else np.zeros(0, np.uint8))[None]) for d in batch["d"]]
            cols = [pa.array([float(r[f][0]) for r in rows], pa.float64()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([batch["k"], *cols], [key, *FIELDS])

    return files.select(F.col(key).alias("k"), F.col(data).alias("d")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{f} double" for f in FIELDS))


#: Bits beside which a stretch of windows is read.
KERNELS = ("simple", "full")


def bit_windows(files: DataFrame, key: str, data: str, *, bits: int = 64, step: int = 16, kernel: str = "simple", most: int | None = None, lsb: bool = False) -> DataFrame:
    """(key, window_id, start_bit, coherence, stability, entropy, rupture, lambda_hazard) of windows of bits within each binary value.

    Starts are multiples of ``step``; only whole windows count, of a value the last ``most`` if given (the operator's parameter). kernel 'simple'
    counts ones and transitions, 'full' is the event kernel with stability 1 - rupture. lsb reads the least significant bit of each byte first. A null
    value has no window.
    """
    if kernel not in KERNELS or bits <= 1 or step <= 0:
        raise ValueError(f"kernel must be one of {KERNELS}, bits above 1 and step positive")
    kind = dict(files.dtypes)[key]
    names = ["coherence", "stability", "entropy", "rupture", "lambda_hazard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, d in zip(batch["k"], batch["d"], strict=True):
                if not d.is_valid:
                    continue
                b = np.unpackbits(np.frombuffer(d.as_buffer(), np.uint8), bitorder="little" if lsb else "big")
                starts = np.arange(0, len(b) - bits + 1, step)
                ids = np.arange(len(starts))
                if most is not None:
                    starts, ids = starts[-most:], ids[-most:]
                for lo in range(0, len(starts), 4096):
                    own = np.lib.stride_tricks.sliding_window_view(b, bits)[starts[lo : lo + 4096]]
                    if kernel == "full":
                        m = kernel_rows(own)
                        m["stability"] = 1 - m["rupture"]
                    else:
                        h, r = (t[c] for t, c in zip(metric_tables(bits), (own.sum(1, dtype=np.int64), (own[:, 1:] != own[:, :-1]).sum(1)), strict=True))
                        m = {"coherence": 1 - h, "stability": 1 - r, "entropy": h, "rupture": r, "lambda_hazard": r}
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, k.type), pa.array(ids[lo : lo + n]), pa.array(starts[lo : lo + n]), *(pa.array(m[x]) for x in names)], [key, "window_id", "start_bit", *names])

    return files.select(F.col(key).alias("k"), F.col(data).alias("d")).mapInArrow(run, f"{key} {kind}, window_id long, start_bit long, " + ", ".join(f"{x} double" for x in names))


def with_signature(windows: DataFrame) -> DataFrame:
    return windows.withColumn("signature", signature_plain(F.col("coherence"), F.col("stability"), F.col("entropy")))


STATES = ("NULL", "FLIP", "RUPTURE")


def event_runs(files: DataFrame, data: str) -> DataFrame:
    """(state, length, n): partial counts of the runs of equal events in each binary value, most significant bit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[int, int] = {}
            for d in batch["d"]:
                bits = np.unpackbits(np.frombuffer(d.as_buffer(), np.uint8)) if d.is_valid else np.zeros(0, np.uint8)
                if len(bits) < 2:
                    continue
                state = np.where(bits[1:] != bits[:-1], 1, 2 * bits[1:])
                starts = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
                lengths = np.diff(np.r_[starts, len(state)])
                keys, n = np.unique(lengths * 3 + state[starts], return_counts=True)
                for key, k in zip(keys.tolist(), n.tolist(), strict=True):
                    total[key] = total.get(key, 0) + k
            yield pa.RecordBatch.from_arrays(
                [pa.array([STATES[k % 3] for k in total], pa.string()), pa.array([k // 3 for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["state", "length", "n"]
            )

    return files.select(F.col(data).alias("d")).mapInArrow(run, "state string, length long, n long")
