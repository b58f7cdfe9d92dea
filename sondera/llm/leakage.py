"""Evaluation passages in training text, by a distributed positional inverted index.

The index holds a posting (term, document, position) with its two neighbour words on each side for every term
that the evaluation items use; no other term can take part in a match. For each stretch of an item
the rarest term in the corpus is looked up, its postings are shifted by the term's place in the
item, and postings whose neighbours can't belong to the passage are dropped at once. The lists of
the item's other terms are then intersected at the same shift. Runs of consecutive words are phrase
matches.

Proximity matches, the same words with small shifts between them, may miss any word, so no single term
leads to them. A match of ``length`` of an item's words holds j of any choice that leaves out at most length - j of
them; the most frequent ones are left out, the rest is counted by shift inside each document, and
shifts with at least j hits are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.text import lower_words
from sondera.session import meet, store


SIDES = ("prev2", "prev", "next", "next2")
#: Item words that one pass over the documents looks for, and hits or cells that are held at once.
ITEM_WORDS, HITS = 200_000, 2_000_000


def item_words(items: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, off, term, prev2, prev, next, next2) of each word of each distinct item row.

    item is a struct of the key and a hash of the words, as rows of one key may differ in text.
    """
    w = items.select(F.col(key).alias("key"), lower_words(F.col(text)).alias("w")).distinct()
    w = w.select(F.struct("key", F.xxhash64("w").alias("text")).alias("item"), "w")
    return w.select("item", F.inline(_with_neighbours("w"))).withColumnRenamed("pos", "off")


def _with_neighbours(w: str):
    """(pos, term, prev2, prev, next, next2); no neighbour is the empty word."""
    a = F.col(w)
    side = lambda i: F.coalesce(F.get(a, i), F.lit(""))
    return F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("term"), side(i - 2).alias("prev2"), side(i - 1).alias("prev"), side(i + 1).alias("next"), side(i + 2).alias("next2")))


def postings(docs: DataFrame, vocabulary: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: (doc, pos, term, prev2, prev, next, next2) of every word that the vocabulary (term) has."""
    w = docs.select(F.col(key).alias("doc"), lower_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = w.select("doc", F.inline(_with_neighbours("w")))
    return store(meet(rows, vocabulary.select("term").distinct(), ["term"], "left_semi"))


def anchors(item: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """(item, off, term, prev2, prev, next, next2): of each stretch of ``length`` words the term with the fewest postings.

    Stretches with a term that no document has are left out: nothing holds them.
    """
    rarity = store(index.groupBy("term").agg(F.count("pos").alias("df")))
    known = meet(item, rarity, ["term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("off").rowsBetween(0, length - 1)
    best = known.select("item", F.min(F.struct("df", "off", "term", *SIDES)).over(ahead).alias("best"), F.count("off").over(ahead).alias("n"))
    return best.where((F.col("n") == length) & (F.col("best.df") > 0)).select("item", "best.off", "best.term", *(f"best.{c}" for c in SIDES)).distinct()


def _near(items: list[list[str]], length: int, slop: int):
    """Arrow batches of (doc, w) to (at, doc, near, phrase): the most words and the longest run of item number ``at`` in each document."""
    vocabulary = sorted({t for words in items for t in words})
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = [np.array([number[t] for t in words], np.int64) for words in items]
    flat = np.concatenate(terms)
    owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    off = np.concatenate([np.arange(len(t)) for t in terms])
    least = (length + 1) // 2
    span = max(len(t) for t in terms) + 2 * slop + 1

    def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item words but the length - least most frequent of each item here, ordered by term, and where each term's begin."""
        df = np.bincount(words[words >= 0], minlength=len(vocabulary))[flat]
        order = np.lexsort((-df, owner))
        first = np.searchsorted(owner, owner[order])
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.arange(len(flat)) - first
        kept = np.flatnonzero(rank >= length - least)
        kept = kept[np.argsort(flat[kept], kind="stable")]
        return kept, np.searchsorted(flat[kept], np.arange(len(vocabulary) + 1))

    def shifts(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (item, doc, shift) with at least ``least`` hits nearby; shifts count from the first word of all."""
        kept, begins = seeds(words)
        places = np.flatnonzero(words >= 0)
        places = places[begins[words[places] + 1] > begins[words[places]]]
        each = (begins[words[places] + 1] - begins[words[places]]) if len(places) else np.zeros(0, np.int64)
        upto = np.cumsum(each)
        found = [np.zeros((0, 3), np.int64)]
        at = 0
        while at < len(places):
            # The stretch reaches as far beyond its last place as a match does, so each match lies in one whole.
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - each[at] + HITS)))
            to = int(np.searchsorted(places, places[end - 1] + span, "right"))
            here, n = places[at:to], each[at:to]
            hit = kept[np.repeat(begins[words[here]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            pos = np.repeat(here, n)
            # Documents are held apart by more than a match is long.
            size = len(words) + (doc[-1] + 2) * span
            key = owner[hit] * size + (pos + doc[pos] * span - off[hit] + span)
            key, one, count = np.unique(key, return_index=True, return_counts=True)
            total = np.r_[0, np.cumsum(count)]
            enough = total[np.searchsorted(key, key + 2 * slop, "right")] - total[:-1] >= least
            one = one[enough]
            base = np.stack([owner[hit[one]], doc[pos[one]], pos[one] - off[hit[one]]], 1)
            moved = [base + np.array([0, 0, m]) for m in range(-slop, slop + 1)]
            found.append(np.unique(np.concatenate(moved), axis=0))
            at = end
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(vocabulary, pa.string())
        for batch in batches:
            listed = batch["w"]
            words = np.asarray(pc.fill_null(pc.index_in(listed.flatten(), value_set=values), -1)).astype(np.int64)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(listed), 0)).astype(np.int64)
            if not len(words):
                continue
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            found = shifts(words, doc)
            bounds = np.searchsorted(found[:, 0], np.arange(len(terms) + 1))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                n = len(terms[i])
                step = max(1, HITS // n)
                for lo in range(bounds[i], bounds[i + 1], step):
                    part = found[lo : min(lo + step, bounds[i + 1])]
                    d = part[:, 1:2]
                    at = part[:, 2:3] + np.arange(n)
                    held = lambda m: (at + m >= ends[d] - sizes[d]) & (at + m < ends[d]) & (words[np.clip(at + m, 0, len(words) - 1)] == terms[i])  # noqa: B023, E731
                    exact = held(0)
                    near = exact.copy()
                    for m in range(1, slop + 1):
                        near |= held(m) | held(-m)
                    here = np.arange(n)
                    longest = (here - np.maximum.accumulate(np.where(exact, -1, here), axis=1)).max(1)
                    some = near.sum(1)
                    for k in np.flatnonzero(some >= length).tolist():
                        old = best.get((i, int(part[k, 1])), (0, 0))
                        best[i, int(part[k, 1])] = (max(old[0], int(some[k])), max(old[1], int(longest[k])))
            rows = [(i, d, *v) for (i, d), v in best.items()]
            ats, ds, nears, phrases = (pa.array([r[c] for r in rows], pa.int32()) for c in range(4))
            yield pa.RecordBatch.from_arrays([ats, batch["doc"].take(ds), nears, phrases], ["at", "doc", "near", "phrase"])

    return run


def near_leaks(docs: DataFrame, items: DataFrame, length: int, slop: int, doc_key: str, item_key: str) -> DataFrame:
    """The rows of :func:`leaks` with slop > 0. A document never leaves its task; items come in blocks of about ITEM_WORDS words."""
    spark = docs.sparkSession
    kinds = {c: f.dataType.simpleString() for c, f in (("doc", docs.schema[doc_key]), ("item", items.schema[item_key]))}
    words = docs.select(F.col(doc_key).alias("doc"), lower_words(F.col("text")).alias("w")).where("doc is not null and size(w) > 0")
    block: list[tuple] = []
    held = 0
    wanted = items.select(F.col(item_key).alias("key"), lower_words(F.col("text")).alias("w")).distinct().where(F.size("w") >= length)
    parts = []

    def search(block: list[tuple]) -> DataFrame:
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"at int, item {kinds['item']}")
        got = words.mapInArrow(_near([w for _, w in block], length, slop), f"at int, doc {kinds['doc']}, near int, phrase int")
        return got.join(F.broadcast(names), "at").select("item", "doc", "near", "phrase")

    for r in wanted.toLocalIterator():
        if block and held + len(r.w) > ITEM_WORDS:
            parts.append(search(block))
            block, held = [], 0
        block.append((r.key, r.w))
        held += len(r.w)
    if block:
        parts.append(search(block))
    if not parts:
        return spark.createDataFrame([], f"item {kinds['item']}, doc {kinds['doc']}, kind string, n_words long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("item", "doc").agg(F.max("near").cast("long").alias("near"), F.max("phrase").cast("long").alias("phrase"))
    is_phrase = F.col("phrase") >= length
    return best.select("item", "doc", F.when(is_phrase, "phrase").otherwise("near").alias("kind"), F.when(is_phrase, F.col("phrase")).otherwise(F.col("near")).alias("n_words"))


def leaks(docs: DataFrame, items: DataFrame, *, length: int = 10, slop: int = 0, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(item, doc, kind, n_words): the longest passage of each item in each document.

    kind 'phrase': at least ``length`` consecutive words of the item in order. kind 'near' (with
    slop > 0, where there is no phrase): at least ``length`` of the item's words, each within
    ``slop`` places of where the phrase would have it. Words are maximal runs of letters and
    digits in lower case. Null, empty and shorter texts match nothing; repeated rows of a document
    or an item count once, an item's rows of other text apart; a document's id stands for one text;
    empty tables give none.
    """
    if slop:
        return near_leaks(docs, items, length, slop, doc_key, item_key)
    item = store(item_words(items, key=item_key))
    index = postings(docs, item, key=doc_key)
    seeds = store(anchors(item, index, length))
    seeds = seeds.select("item", "term", "off", *(F.col(c).alias(f"i{c}") for c in SIDES))
    same = {c: F.col(c) == F.col(f"i{c}") for c in SIDES}
    # Of a passage of n words its rarest has (n - 1) / 2 of them at least on one side.
    near, far = length >= 2, length >= 4
    before, after = same["prev"] & (same["prev2"] if far else F.lit(True)), same["next"] & (same["next2"] if far else F.lit(True))
    fits = (before | after) if near and not slop else F.lit(True)
    found = meet(index, seeds, ["term"]).where(fits)
    shifts = store(found.select("doc", "item", (F.col("pos") - F.col("off")).alias("shift")).distinct())
    moves = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    wanted = meet(shifts, item.select("item", "off", "term"), ["item"]).select("doc", "item", "shift", "off", "term", moves.alias("move"))
    wanted = wanted.withColumn("pos", F.col("shift") + F.col("off") + F.col("move"))
    held = meet(index.select("doc", "pos", "term"), shifts.select("doc").distinct(), ["doc"], "left_semi")
    hits = held.join(wanted, ["doc", "pos", "term"]).distinct()
    run = Window.partitionBy("doc", "item", "shift").orderBy("off")
    exact = hits.where("move = 0").withColumn("island", F.col("off") - F.row_number().over(run))
    phrase = exact.groupBy("doc", "item", "shift", "island").agg(F.count("off").alias("n")).groupBy(F.col("item.key").alias("item"), "doc").agg(F.max("n").alias("phrase"))
    return phrase.where(F.col("phrase") >= length).select("item", "doc", F.lit("phrase").alias("kind"), F.col("phrase").alias("n_words"))
