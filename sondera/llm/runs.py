"""Runs of identical or nearly identical consecutive events, collapsed by a symbol-string regex.

Rows are range-partitioned by (entity, time), so that a hot entity spans many tasks. Each
partition streams its sorted batches: every distinct event (its numbers) gets a Unicode code point of its own,
the code points of the batch form one string with a mark between entities, and a backreference regex collapses
repetitions of one code point. Over the collapsed string, neighbours that are nearly equal get a mark, and a second
regex joins stretches of such marks. Spans of the string are places of the events, which give ids and times.
The open run is carried from batch to batch. Only what touches a partition's edge leaves as a fragment, two a
partition at most; fragments are stitched in a last, small step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import store

#: First code point of events. Surrogates are no characters, so symbols pass over them.
FIRST_SYMBOL, SURROGATES, SURROGATE_COUNT = 0x100, 0xD800, 0x800
#: Events that are coded together: fewer than there are code points.
CODED = 500_000
#: The code point of an event that belongs to no run, and the mark between entities.
UNREADABLE, BREAK = 0x21, 0x20
REPEAT = re.compile(f"([^{chr(UNREADABLE)}{chr(BREAK)}])\\1*", re.DOTALL)
#: Marks of the collapsed string: joined to the one before, or not.
JOINED = re.compile("xj*")

DECIMAL = "([0-9]+(?:[.][0-9]*)?|[.][0-9]+)"
SIGNATURE = f"^c{DECIMAL}_s{DECIMAL}_e{DECIMAL}$"
NUMBERS = ["a", "b", "c"]
FRAGMENT = "entity string, first_id long, last_id long, n long, start long, end long, a long, b long, c long, a2 long, b2 long, c2 long, readable boolean, head boolean, tail boolean, pid int"
FIELDS = [x.split()[0] for x in FRAGMENT.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]] for x in FRAGMENT.split(", ")]


def signature_numbers(signature: Column) -> list[Column]:
    """The three numbers of a signature as whole millionths, null where it is unreadable.

    Blanks are dropped and case is ignored. Whole numbers compare exactly, where binary fractions would not.
    """
    plain = F.lower(F.regexp_replace(signature, r"[\p{IsWhite_Space}\x1c-\x1f]+", ""))
    numbers = [(F.regexp_extract(plain, SIGNATURE, i).try_cast("decimal(18,6)") * 1000000).cast("long") for i in (1, 2, 3)]
    ok = plain.rlike(SIGNATURE)
    for x in numbers:
        ok = ok & x.isNotNull()
    return [F.when(ok, x) for x in numbers]


def collapse(code: np.ndarray, ok: np.ndarray, v: list[np.ndarray], step: int) -> list[tuple[int, int]]:
    """Spans (from, to) of the maximal chains of neighbours of one entity, readable and within ``step`` of each other, single events included.

    code: a number for each event's entity; ok: readable; v: the numbers of the events.
    """
    if not len(code):
        return []
    _, symbol = np.unique(np.stack(v), axis=1, return_inverse=True)
    symbol = symbol.ravel().astype(np.int64) + FIRST_SYMBOL
    symbol = np.where(symbol >= SURROGATES, symbol + SURROGATE_COUNT, symbol)
    symbol = np.where(ok, symbol, UNREADABLE)
    # The mark stands before the first event of each entity but the first.
    fresh = np.flatnonzero(code[1:] != code[:-1]) + 1
    text = np.insert(symbol, fresh, BREAK).astype("<u4").tobytes().decode("utf-32-le")
    spans = np.array([m.span() for m in REPEAT.finditer(text)], np.int64).reshape(-1, 2)
    # Places in the string back to places of events.
    spans -= np.searchsorted(fresh + np.arange(len(fresh)), spans[:, :1], "right")
    if not len(spans):
        return []
    before, here = spans[:-1, 1] - 1, spans[1:, 0]
    near = (here == before + 1) & (code[here] == code[before])
    for x in v:
        near &= np.abs(x[here] - x[before]) <= step
    marks = "x" + "".join(np.where(near, "j", "x").tolist())
    return [(int(spans[m.start(), 0]), int(spans[m.end() - 1, 1])) for m in JOINED.finditer(marks)]


def _scan(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        open_: dict | None = None
        carried: pa.Table | None = None

        def packed(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], FIELDS)

        def one(r: dict, tail: bool) -> pa.RecordBatch:
            return packed([[x] for x in ({**r, "tail": tail, "pid": pid}[f] for f in FIELDS)])

        for whole in batches:
            for at in range(0, whole.num_rows, CODED):
                t = pa.Table.from_batches([whole.slice(at, CODED)])
                if carried is not None:
                    t = pa.concat_tables([carried, t])
                ids = np.asarray(t["id"])
                fresh = np.ones(len(ids), bool)
                fresh[1:] = ids[1:] != ids[:-1]  # deliveries of one event are neighbours; the first is kept
                if not fresh.all():
                    t, ids = t.filter(pa.array(fresh)), ids[fresh]
                last = len(ids) - 1
                carried = t.slice(last)
                entity = t["entity"].combine_chunks()
                start, end = np.asarray(t["start"]), np.asarray(t["end"])
                ok = np.asarray(t["a"].is_valid())
                v = [np.asarray(t[x].combine_chunks().fill_null(0)) for x in NUMBERS]
                code = np.asarray(entity.dictionary_encode().indices)
                spans = [s for s in collapse(code, ok, v, step) if s[1] - s[0] > 1]
                lead = spans.pop(0)[1] if spans and spans[0][0] == 0 else 1
                if open_ is not None and lead > 1:
                    open_ |= {"last_id": int(ids[lead - 1]), "n": open_["n"] + lead - 1, "end": max(open_["end"], int(end[:lead].max()))} | {f"{x}2": int(y[lead - 1]) for x, y in zip(NUMBERS, v, strict=True)}

                def part(i: int, j: int, head: bool, ids=ids, start=start, end=end, v=v, ok=ok, entity=entity) -> dict:
                    out = {"entity": entity[i].as_py(), "first_id": int(ids[i]), "last_id": int(ids[j - 1]), "n": j - i, "start": int(start[i]), "end": int(end[i:j].max()), "readable": bool(ok[i]), "head": head}
                    return out | {x: int(y[i]) for x, y in zip(NUMBERS, v, strict=True)} | {f"{x}2": int(y[j - 1]) for x, y in zip(NUMBERS, v, strict=True)}

                if open_ is None:
                    open_ = part(0, lead, True)
                if lead > last:
                    continue
                if open_["head"] or (open_["readable"] and open_["n"] > 1):
                    yield one(open_, False)
                open_ = part(*(spans.pop() if spans and spans[-1][1] == last + 1 else (last, last + 1)), False)
                if spans:
                    i, j = np.array(spans).T
                    ends = np.maximum.reduceat(end, np.array(spans).ravel()[: None if j[-1] <= last else -1])[::2]
                    no = np.zeros(len(i), bool)
                    yield packed([entity.take(pa.array(i)), ids[i], ids[j - 1], j - i, start[i], ends, *(x[i] for x in v), *(x[j - 1] for x in v), ~no, no, no, np.full(len(i), pid)])
        if open_ is not None:
            yield one(open_, True)

    return run


def near_runs(events: DataFrame, *, step: int = 10_000, numbers: list[Column] | None = None) -> DataFrame:
    """(entity, first_id, last_id, n, start, end): every maximal run of two or more linked neighbours.

    events: (entity, start, end, id) and either the columns a, b, c or those that ``numbers`` reads, which is
    then evaluated once, after the rows are placed. The numbers are whole, and null together where the event is
    unreadable. Neighbours in the order (start, id) of one entity are linked if all three numbers
    differ by at most ``step``. Rows without entity, start or id are left out; rows of one id beside
    each other are one event; an unreadable event ends a run. A null end counts as the start.
    """
    keys = ("entity", "start", "end", "id")
    rest = [c for c in events.columns if c not in keys] if numbers else NUMBERS
    slim = events.where("entity is not null and start is not null and id is not null").select(F.col("entity").cast("string").alias("entity"), F.col("start").cast("long").alias("start"), F.coalesce("end", "start").cast("long").alias("end"), F.col("id").cast("long").alias("id"), *rest)
    placed = slim.repartitionByRange("entity", "start", "id").sortWithinPartitions("entity", "start", "id")
    if numbers:
        placed = placed.select(*keys, *(x.alias(n) for x, n in zip(numbers, NUMBERS, strict=True)))
    found = store(placed.mapInArrow(_scan(step), FRAGMENT))
    fields = ["entity", "first_id", "last_id", "n", "start", "end"]
    edges = found.where("head or tail")
    order = Window.partitionBy("entity").orderBy("pid", F.desc("head"), "start")
    before = lambda c: F.lag(c).over(order)
    joins = before("tail") & F.col("head") & before("readable") & F.col("readable")
    for x in NUMBERS:
        joins = joins & (F.abs(F.col(x) - before(f"{x}2")) <= step)
    edges = edges.withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(order))
    stitched = edges.groupBy("entity", "island").agg(
        F.min_by("first_id", "pid").alias("first_id"), F.max_by("last_id", "pid").alias("last_id"), F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("readable").alias("readable")
    )
    return found.where("not head and not tail and n > 1").select(*fields).unionByName(stitched.where("readable and n > 1").select(*fields))
