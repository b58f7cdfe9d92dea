"""Bit kernels: window metrics from counts, bucketed signatures, and the full event kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the full kernel: entropy normaliser and floor, coherence weights and bounds,
# trajectory length and constants, damping range, hazard weights, collapse level.
MAX_ENTROPY, ENTROPY_FLOOR = 1.585, 0.05
W_ENTROPY, W_RUPTURE, W_FLIP = 0.6, 0.3, 0.1
COHERENCE_LOW, COHERENCE_HIGH = 0.01, 0.99
TRAJECTORY_BITS, K1, K2 = 20, 0.30, 0.20
COLLAPSE = 0.5


def binary_entropy(p: Column) -> Column:
    """Entropy of a coin in bits; 0 at p = 0 and p = 1."""
    term = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return term(p) + term(1 - p)


def simple_metrics(ones: Column, transitions: Column, n_bits: Column) -> dict[str, Column]:
    """coherence, stability, entropy, rupture and hazard of a window of bits; all 0 for an empty one."""
    h = binary_entropy(ones / F.nullif(n_bits, F.lit(0)))
    r = F.when(n_bits > 1, transitions / F.nullif(n_bits - 1, F.lit(0))).otherwise(0.0)
    empty = n_bits == 0
    zero = lambda c: F.when(empty, 0.0).otherwise(c)
    return {"coherence": zero(1 - h), "stability": zero(1 - r), "entropy": zero(h), "rupture": zero(r), "lambda_hazard": zero(r)}


def signature_plain(c: Column, s: Column, e: Column, precision: int = 2) -> Column:
    """Signature of half-even buckets with unpadded numbers, as in c0.0_s0.46_e1.0."""
    f = 10**precision
    part = lambda x: (F.bround(x * f) / f).cast("string")
    return F.concat(F.lit("c"), part(c), F.lit("_s"), part(s), F.lit("_e"), part(e))


def signature_fixed(c: Column, s: Column, e: Column) -> Column:
    """Signature of half-away buckets with two digits, as in c0.01_s0.49_e0.99."""
    return F.format_string("c%.2f_s%.2f_e%.2f", F.round(c, 2), F.round(s, 2), F.round(e, 2))


def signature_milli(c: Column, s: Column, e: Column) -> Column:
    """Signature of whole thousandths, each column an integer."""
    return F.format_string("c%.3f_s%.3f_e%.3f", c / 1000.0, s / 1000.0, e / 1000.0)


def signature_parts(signature: Column) -> Column:
    """struct(c, s, e) of a signature; null where it is unreadable."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    pattern = f"^c{number}_s{number}_e{number}$"
    get = lambda i: F.regexp_extract(signature, pattern, i).try_cast("double")
    return F.when(signature.rlike(pattern), F.struct(get(1).alias("c"), get(2).alias("s"), get(3).alias("e")))


def rebucket(signature: Column, step: float = 0.25) -> Column:
    """Signature with each number floored to a multiple of ``step``."""
    p = signature_parts(signature)
    down = lambda x: F.floor(x / step) * step
    return F.format_string("c%.2f_s%.2f_e%.2f", down(p["c"]), down(p["s"]), down(p["e"]))


def hazard(entropy: Column, coherence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), K1 * entropy + K2 * (1 - coherence)))


def event_states(bits: Column) -> Column:
    """State of each neighbouring pair of an array of bits: NULL for 00, RUPTURE for 11, FLIP else; a value that is no bit gives an empty array."""
    state = lambda a, b: F.when((a == 0) & (b == 0), "NULL").when((a == 1) & (b == 1), "RUPTURE").otherwise("FLIP")
    pairs = F.zip_with(F.slice(bits, 1, F.greatest(F.size(bits) - 1, F.lit(0))), F.slice(bits, 2, F.greatest(F.size(bits) - 1, F.lit(0))), state)
    ok = F.forall(bits, lambda b: b.isin(0, 1)) & (F.size(bits) > 1)
    return F.when(ok, pairs).otherwise(F.array().cast("array<string>"))


def _entropy3(flip: np.ndarray, rupture: np.ndarray) -> np.ndarray:
    p = np.stack([1 - flip - rupture, flip, rupture])
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -np.where(p > 0, p * np.log2(p), 0.0).sum(0)
    return np.clip(h / MAX_ENTROPY, ENTROPY_FLOOR, 1.0)


def _ratios(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(1, bits.shape[1] - 1)
    return (bits[:, 1:] != bits[:, :-1]).sum(1) / n, ((bits[:, 1:] == 1) & (bits[:, :-1] == 1)).sum(1) / n


def _likeness(path: np.ndarray) -> np.ndarray:
    """Greatest cosine of each path with a decay, a line and a swing of the same ends; between 0 and 1."""
    m = path.shape[1]
    if m < 3:
        return np.full(len(path), 0.5)
    i = np.arange(m)
    first, last = path[:, :1], path[:, -1:]
    own = np.linalg.norm(path, axis=1)
    best = np.full(len(path), -1.0)
    for shape in (first * np.exp(-0.1 * i), first + i * (last - first) / (m - 1), (first + last) / 2 + (last - first) / 2 * np.sin(2 * np.pi * i / m)):
        norm = np.linalg.norm(shape, axis=1) * own
        best = np.maximum(best, np.where(norm > 0, (shape * path).sum(1) / np.where(norm > 0, norm, 1), 0.0))
    return np.clip(best, 0.0, 1.0)


def kernel_rows(bits: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of each row of a matrix of bits: events, damped trajectory and collapse. Rows of fewer than two bits give zeros."""
    b = np.asarray(bits, np.int64)
    if b.shape[1] < 2:
        return {f: np.zeros(len(b)) for f in FIELDS}
    flip, rupture = _ratios(b)
    h = _entropy3(flip, rupture)
    c = np.clip(W_ENTROPY * (1 - h) + W_RUPTURE * (1 - rupture) + W_FLIP * (1 - flip), COHERENCE_LOW, COHERENCE_HIGH)
    if b.shape[1] > 10:
        near = _entropy3(*_ratios(b[:, :TRAJECTORY_BITS]))
        damping = np.clip((K1 + K2) * near, 0.01, 1.0)
        drift = np.cumsum((b[:, 1:] - b[:, :1]) * np.exp(-damping[:, None] * np.arange(1, b.shape[1])), axis=1)
        c = 0.7 * c + 0.3 * _likeness(np.concatenate([b[:, :1].astype(float), drift], axis=1))
        end = np.abs(drift[:, -1])
        c = np.where(end < 2, c / (1 + 0.1 * end), c)
    c = np.clip(c, 0.0, 1.0)
    lam = np.clip(K1 * h + K2 * (1 - c), 0.0, 1.0)
    return {"coherence": c, "entropy": h, "flip": flip, "rupture": rupture, "lambda_hazard": lam, "collapse": (rupture >= COLLAPSE).astype(float)}


def full_kernel(bits: list[int] | np.ndarray) -> dict[str, float]:
    """:func:`kernel_rows` of one bit stream. Fewer than two bits, or a value that is none, give zeros."""
    b = np.asarray(bits, np.int64)
    if len(b) < 2 or not np.isin(b, (0, 1)).all():
        return dict.fromkeys(FIELDS, 0.0)
    return {k: float(v[0]) for k, v in kernel_rows(b[None]).items()}


FIELDS = ["coherence", "entropy", "flip", "rupture", "lambda_hazard", "collapse"]


@F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS]))
def bit_kernel(bits: pd.Series) -> pd.DataFrame:
    """The full kernel over a column of bit arrays."""
    return pd.DataFrame([full_kernel([] if b is None else b) for b in bits], columns=FIELDS)
