"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers: a pre-token that is in the vocabulary as a whole is found by a minimal perfect hash;
any other is merged by a heap of ranked pairs over a linked list of its bytes, the ranks coming
from the same hash. The vocabulary is read once and broadcast (its size is that of the file, about
a megabyte); rows are mapped in place, nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMORY = 200_000
_MASK = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
    return (x >> 32) % n


class PerfectHash:
    """A minimal perfect hash from distinct byte strings to numbers: n keys in n slots, one probe a lookup.

    Keys sharing a first hash value form a bucket. The largest buckets are placed first, each by the
    first displacement that sends its keys to free slots; a bucket of one key names its slot directly.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.displacement, self.keys, self.values = n, array("q", bytes(8 * n)), [b""] * n, array("q", bytes(8 * n))
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % n, []).append((h, i))
        free = bytearray(b"\1" * n)
        ordered = sorted(buckets.items(), key=lambda b: -len(b[1]))
        for at, bucket in ordered:
            if len(bucket) == 1:
                break
            d = 1
            while True:
                slots = [_slot(h, d, n) for h, _ in bucket]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.displacement[at] = d
            for s, (_, i) in zip(slots, bucket, strict=True):
                free[s], self.keys[s], self.values[s] = 0, keys[i], values[i]
        rest = (s for s in range(n) if free[s])
        for at, bucket in ordered:
            if len(bucket) == 1:
                s, i = next(rest), bucket[0][1]
                self.displacement[at], self.keys[s], self.values[s] = -s - 1, keys[i], values[i]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.n]
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.values[s] if self.keys[s] == key else None


def read_vocabulary(path: str) -> PerfectHash:
    """The ranks of a vocabulary file of lines "base64 rank"."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    return PerfectHash([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])


def merge_bytes(piece: bytes, rank: PerfectHash) -> list[int]:
    """Ids of a piece: the pair of least rank, leftmost first, is joined until none is left."""
    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(piece[i : stop[j]])) is not None:
            heapq.heappush(heap, (r, i, stop[j]))

    for i in range(n - 1):
        offer(i)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or stop[j] != end:
            continue
        alive[j] = 0
        stop[i], after[i] = end, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        known = rank.get(piece[i : stop[i]])
        if known is None:
            raise ValueError(f"the vocabulary lacks the byte {piece[i : stop[i]]!r}")
        out.append(known)
        i = after[i]
    return out


class Encoder:
    """Texts to ids, remembering the pre-tokens it has met."""

    def __init__(self, rank: PerfectHash):
        self.rank, self.split, self.known = rank, regex.compile(PATTERN).findall, {}

    def _piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8")
        whole = self.rank.get(raw)
        ids = (whole,) if whole is not None else tuple(merge_bytes(raw, self.rank))
        if len(token) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for token in self.split(text) if text else ():
            out += known.get(token) or self._piece(token)
        return out


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, in any number of repeats; null and empty texts give an empty list.

    No special tokens: their strings in a text are ordinary text. Whole texts are encoded, whatever
    their length. An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = dict(slim.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            flat, offsets = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, t in enumerate(batch["_text"]):
                flat.extend(encoder.encode(t.as_py()))
                offsets[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch["_key"], ids], ["_key", "ids"])

    return slim.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
