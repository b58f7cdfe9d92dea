"""Subject areas of documents, by class-association rules.

Sentences of hand-labelled documents are transactions of their telling words, with their document's
subjects as classes; equal ones are one with a weight. Parallel frequent-pattern growth mines the sets of at most
three words that are frequent together with a class: each task grows the patterns that end in its share of the
words from the prefixes that reach it, classes are counted beside the words instead of being items, and a set is grown
only while a longer one could still make a better rule. Sets become rules "words -> subject" with a confidence. A rule
is dropped where a shorter one says as much. A sentence treats the subject for which its matching rules give the most
evidence, log odds of the rule's confidence against the subject's share, if that passes a threshold that is calibrated on
labelled documents held out of the mining; a document's subjects are those of a given share of its sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.functions.text import collapse_blanks
from sondera.session import cut, store

#: Labelled documents that a fit uses at most, taken by the hash of their id; the share of them held out for the threshold.
MAX_DOCS, HELD_OUT = 20_000, 0.2
#: Words of a rule at most, and by how much its confidence must pass that of a shorter one.
MAX_LENGTH, GAIN = 3, 0.02
#: Sentences whose words and evidence a worker remembers before it starts afresh.
MEMORY = 100_000
#: Shares of the words in mining.
SHARDS = 64

_BREAK = re.compile(r"[\r\n\u2028\u2029\x85]+|(?<=[.!?。！？])(?=[\s\"'”)\]]|$)")
_STOPS = tuple(".!?。！？")
_AFTER = "\"'”)]} \t\x0b\x0c\r\n"
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: For texts with combining marks, which belong to their letter.
_MARK = regex.compile(r"\p{M}")
_MARKED_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:-\p{L}[\p{L}\p{M}]*)*")


def parts_of(text: str | None) -> list[str]:
    """What a text's sentences may be, in lower case: lines and what their stops part, where it ends with a stop."""
    return [p for p in _BREAK.split((text or "").lower()) if p.rstrip(_AFTER).endswith(_STOPS)]


def words_of(part: str) -> list[str]:
    """The words of a lower-case sentence; none where it has fewer than three."""
    found = (_MARKED_WORD if not part.isascii() and _MARK.search(part) else _WORD).findall(part)
    return found if len(found) >= 3 else []


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in lower case.

    A sentence ends with a full stop, question or exclamation mark before a blank, a quote or the
    line's end, and has three words at least; headings, keys and symbol strings are none.
    """
    return [w for w in map(words_of, parts_of(text)) if w]


@dataclass
class Rules:
    """Rules by their words, and what scoring needs."""

    subjects: list[str]
    weights: dict[tuple[str, ...], list[tuple[int, float]]]
    threshold: float = 0.0
    held: dict[str, float] = field(default_factory=dict)
    single: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    index: dict[str, list[tuple[frozenset, tuple[str, ...]]]] = field(default_factory=dict)
    seen: dict[str, tuple[int, float] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.single = {rule[0]: w for rule, w in self.weights.items() if len(rule) == 1}
        uses = Counter(w for rule in self.weights for w in rule)
        self.index = defaultdict(list)
        # A rule of several words is looked up by the one that the fewest rules have.
        for rule in self.weights:
            if len(rule) > 1:
                first = min(rule, key=lambda w: (uses[w], w))
                self.index[first].append((frozenset(rule), rule))
        self.index = dict(self.index)

    def evidence(self, words: set[str]) -> dict[int, float]:
        """Evidence for each subject from the rules that the words match; a longer rule stands for the shorter ones within it."""
        total: dict[int, float] = {}
        covered: set[tuple[tuple[str, ...], int]] = set()
        hits = [rule for w in words if w in self.index for need, rule in self.index[w] if need <= words]
        for rule in sorted(hits, key=lambda r: (-len(r), r)):
            for c, weight in self.weights[rule]:
                if (rule, c) not in covered:
                    total[c] = total.get(c, 0.0) + weight
                for m in range(1, len(rule)):
                    covered.update((shorter, c) for shorter in combinations(rule, m))
        for w in sorted(words):
            for c, weight in self.single.get(w, ()):
                if ((w,), c) not in covered:
                    total[c] = total.get(c, 0.0) + weight
        return total

    def best(self, words: set[str]) -> tuple[int, float] | None:
        """The subject of most evidence, the first of equals; None without any."""
        told = self.evidence(words)
        c = max(told, key=lambda i: (told[i], -i), default=None)
        return None if c is None or told[c] <= 0 else (c, told[c])

    def tally(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of sentences; best subject and its evidence of each that has any."""
        n, found = 0, []
        for part in parts_of(text):
            if part not in self.seen:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                words = words_of(part)
                self.seen[part] = (self.best(set(words)) or (-1, 0.0)) if words else None
            hit = self.seen[part]
            if hit is not None:
                n += 1
                if hit[0] >= 0:
                    found.append(hit)
        return n, found

    def subjects_of(self, text: str | None, share: float) -> list[str]:
        n, best = self.tally(text)
        if not n:
            return []
        count = Counter(c for c, e in best if e >= self.threshold)
        return sorted(self.subjects[c] for c, k in count.items() if k >= share * n)


def agreed_labels(labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, subjects): the subjects that at least half of a document's raters gave, unknown names ignored.

    Spelling is compared in lower case with blanks, hyphens and underscores alike.
    """
    plain = F.regexp_replace(F.lower(collapse_blanks(F.col("subject"))), r"[\s_-]+", "_")
    votes = labels.where("doc_id is not null").select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), plain.alias("subject")).distinct()
    raters = votes.groupBy("doc_id").agg(F.countDistinct("rater").alias("raters"))
    given = votes.where(F.col("subject").isin(names)).groupBy("doc_id", "subject").agg(F.countDistinct("rater").alias("votes"))
    kept = given.join(raters, "doc_id").where("2 * votes >= raters").groupBy("doc_id").agg(F.sort_array(F.collect_list("subject")).alias("subjects"))
    return raters.join(kept, "doc_id", "left").select("doc_id", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        subjects, words = [], []
        for s, t in zip(b["subjects"].to_pylist(), b["text"].to_pylist(), strict=True):
            for w in sentences(t):
                subjects.append(s)
                words.append(sorted(set(w)))
        yield pa.RecordBatch.from_arrays([pa.array(subjects, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string()))], ["subjects", "words"])


class Growth:
    """Pattern growth over conditional transactions: arrays of places of words, weights and classes."""

    def __init__(self, n_classes: int, min_count: int, min_confidence: float, prior: np.ndarray):
        self.n_classes, self.min_count, self.min_confidence, self.prior = n_classes, min_count, min_confidence, prior
        self.found: list[tuple[tuple[int, ...], int, list[int]]] = []

    def sure(self, n: float, classes: np.ndarray) -> np.ndarray:
        return (classes + 2 * self.prior) / (n + 2)

    def grow(self, suffix: tuple[int, ...], rows: list[np.ndarray], weight: np.ndarray, classes: np.ndarray, best: np.ndarray) -> None:
        """Sets of ``suffix`` and one more word of ``rows``, and longer ones.

        rows: the words before the suffix in each transaction; best: the greatest confidence of a shorter rule, by class.
        """
        sizes = np.array([len(r) for r in rows])
        if not sizes.sum():
            return
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), sizes)
        words, at = np.unique(flat, return_inverse=True)
        n = np.bincount(at, weight[owner])
        often = np.flatnonzero(n >= self.min_count)
        if not len(often):
            return
        by_class = np.stack([np.bincount(at, classes[owner, c]) for c in range(self.n_classes)], 1)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(words) + 1))
        for w in often.tolist():
            c = by_class[w]
            if c.max() < self.min_count:
                continue
            rule = (int(words[w]), *suffix)
            self.found.append((rule, int(n[w]), c.astype(int).tolist()))
            if len(rule) < MAX_LENGTH:
                here = np.maximum(best, np.where(c >= self.min_count, self.sure(n[w], c), 0))
                # A longer set holds at most c of a class; its confidence must pass the shorter ones' by GAIN.
                most = (c + 2 * self.prior) / (c + 2)
                if ((c >= self.min_count) & (most > here + GAIN) & (most >= self.min_confidence)).any():
                    own = owner[order[begin[w] : begin[w + 1]]]
                    before = [rows[i][: np.searchsorted(rows[i], words[w])] for i in own.tolist()]
                    self.grow(rule, before, weight[own], classes[own], here)


def _shares(place: dict[str, int], at: dict[str, int]):
    """(shard, words, weight, classes): for each shard the prefix of a transaction up to the last of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for subjects, words, n in zip(b["subjects"].to_pylist(), b["words"].to_pylist(), b["n"].to_pylist(), strict=True):
                known = tuple(sorted(place[w] for w in words if w in place))
                own = total.setdefault(known, np.zeros(len(at) + 1, np.int64))
                own[-1] += n
                for s in subjects:
                    own[at[s]] += n
        shard, rows, counts = [], [], []
        for known, own in total.items():
            last = {w % SHARDS: i for i, w in enumerate(known)}
            for k, i in last.items():
                shard.append(k)
                rows.append(known[: i + 1])
                counts.append(own.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["shard", "words", "counts"])

    return run


def _mine(n_classes: int, min_count: int, min_confidence: float, prior: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        merged: dict[tuple, np.ndarray] = {}
        for words, counts in zip(t["words"].to_pylist(), t["counts"].to_pylist(), strict=True):
            merged[tuple(words)] = merged.get(tuple(words), 0) + np.array(counts, np.int64)
        rows = [np.array(w, np.int64) for w in merged]
        counts = np.stack(list(merged.values()))
        out = []
        # Words of the shard: of each, the transactions that hold it and their words before it.
        holders: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(rows):
            for w in r[r % SHARDS == shard].tolist():
                holders[w].append(i)
        for w, own in holders.items():
            weight, classes = counts[own, -1], counts[own, :-1]
            n, c = weight.sum(), classes.sum(0)
            if n < min_count or c.max() < min_count:
                continue
            g = Growth(n_classes, min_count, min_confidence, prior)
            g.found.append(((w,), int(n), c.tolist()))
            here = np.where(c >= min_count, g.sure(n, c), 0)
            most = (c + 2 * prior) / (c + 2)
            if ((c >= min_count) & (most > here + GAIN) & (most >= min_confidence)).any():
                g.grow((w,), [rows[i][: np.searchsorted(rows[i], w)] for i in own], weight, classes, here)
            out += g.found
        return pa.table({"words": pa.array([list(r) for r, _, _ in out], pa.list_(pa.int32())), "n": pa.array([n for _, n, _ in out], pa.int64()), "classes": pa.array([c for _, _, c in out], pa.list_(pa.int64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, names: list[str], *, share: float = 0.25, min_count: int = 4, min_support: float = 5e-5, min_lift: float = 1.5, min_confidence: float = 0.3, max_docs: int = MAX_DOCS, held_out: float = HELD_OUT) -> Rules:
    """Rules mined from the labelled documents, at most ``max_docs`` of them, but a share ``held_out`` kept for the threshold.

    docs: (doc_id, text); labels: (doc_id, subject, rater). Without labels or texts no rule results. A
    set is frequent in ``min_count`` sentences and a share ``min_support`` of them. Words are telling if they are
    frequent and much more so under some subject than over all.
    """
    names = list(names)
    agreed = cut(agreed_labels(labels, names).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    texts = store(docs.select("doc_id", "text").join(F.broadcast(agreed), "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < int(held_out * 1000)))
    rows = store(texts.where("not held").select("subjects", "text").mapInArrow(_split, "subjects array<string>, words array<string>").groupBy("subjects", "words").agg(F.count(F.lit(1)).alias("n")))
    sums = rows.select("n", F.explode(F.concat("subjects", F.array(F.lit("")))).alias("subject")).groupBy("subject").agg(F.sum("n").alias("n")).collect()
    count = {r.subject: r.n for r in sums}
    total = count.get("", 0)
    if not total or not names:
        return Rules(names, {})
    prior = np.array([(count.get(s, 0) + 1) / (total + len(names)) for s in names])
    min_count = max(min_count, math.ceil(min_support * total))
    words = rows.select("n", F.explode("words").alias("word"), F.concat("subjects", F.array(F.lit(""))).alias("subjects")).select("n", "word", F.explode("subjects").alias("subject"))
    per = words.groupBy("word").pivot("subject", ["", *names]).agg(F.sum("n")).fillna(0).where(F.col("``") >= min_count)
    told = F.lit(False)
    for s, p in zip(names, prior.tolist(), strict=True):
        told = told | ((F.col(f"`{s}`") / F.col("``") >= min_confidence) & (F.col(f"`{s}`") / F.col("``") >= min_lift * p))
    # Words of the bounded sample. The most frequent come first in the order of growth, so suffixes are rare words.
    telling = [r[0] for r in per.where(told).orderBy(F.desc("``"), "word").select("word").toLocalIterator()]
    if not telling:
        return Rules(names, {})
    place, at = {w: i for i, w in enumerate(telling)}, {s: i for i, s in enumerate(names)}
    shared = rows.mapInArrow(_shares(place, at), "shard int, words array<int>, counts array<long>")
    sets = shared.groupBy("shard").applyInArrow(_mine(len(names), min_count, min_confidence, prior), "words array<int>, n long, classes array<long>")
    rules = _pruned([(tuple(sorted(telling[i] for i in r.words)), r.n, r.classes) for r in sets.toLocalIterator()], names, prior, min_count, min_confidence)
    return calibrate(rules, texts.where("held"), share)


def _pruned(sets: list[tuple[tuple[str, ...], int, list[int]]], names: list[str], prior: np.ndarray, min_count: int, min_confidence: float) -> Rules:
    """Rules of frequent sets, without those that a rule of fewer words matches or beats."""
    sure: dict[tuple[str, ...], np.ndarray] = {}
    weights: dict[tuple[str, ...], list[tuple[int, float]]] = defaultdict(list)
    for rule, n, classes in sorted(sets, key=lambda x: (len(x[0]), x[0])):
        k = np.array(classes)
        own = sure[rule] = np.where(k >= min_count, (k + 2 * prior) / (n + 2), -1.0)
        shorter = np.max([sure[s] for m in range(1, len(rule)) for s in combinations(rule, m) if s in sure] or [np.full(len(names), -1.0)], axis=0)
        for c in np.flatnonzero((own >= min_confidence) & (own > prior) & ((shorter < 0) | (own > shorter + GAIN))).tolist():
            p, q = min(float(own[c]), 0.995), float(prior[c])
            weights[rule].append((c, math.log(p * (1 - q) / ((1 - p) * q))))
    return Rules(list(names), dict(weights))


def calibrate(rules: Rules, texts: DataFrame, share: float) -> Rules:
    """The threshold with the best F1 of the documents' subjects against their labels. texts: (text, subjects)."""
    grid = np.round(np.arange(0.2, 6.01, 0.2), 2)
    at = {s: i for i, s in enumerate(rules.subjects)}
    shared = texts.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, given, wanted = (np.zeros(len(grid), np.int64) for _ in range(3))
        for b in batches:
            for text, subjects in zip(b["text"].to_pylist(), b["subjects"].to_pylist(), strict=True):
                n, best = shared.value.tally(text)
                truth = {at[s] for s in subjects}
                wanted += len(truth)
                levels = defaultdict(list)
                for c, e in best:
                    levels[c].append(e)
                # A subject is told up to the evidence of the sentence that completes its share.
                for c, es in levels.items():
                    need = max(1, math.ceil(share * n - 1e-9))
                    if len(es) >= need:
                        told = grid <= sorted(es, reverse=True)[need - 1]
                        given += told
                        right += told & (c in truth)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(right), pa.array(given), pa.array(wanted)], ["g", "r", "t", "w"])

    sums = texts.select("text", "subjects").mapInArrow(run, "g int, r long, t long, w long").groupBy("g").agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.sum("w").alias("w")).collect()
    best = max(sums, key=lambda x: (2 * x.r / max(1, x.t + x.w), -x.g), default=None)
    if best is not None:
        rules.threshold = float(grid[best.g])
        rules.held = {"precision": best.r / max(1, best.t), "recall": best.r / max(1, best.w), "subjects": best.w}
    return rules


def assign(docs: DataFrame, rules: Rules, *, share: float = 0.25) -> DataFrame:
    """(doc_id, subject) of every row: the subjects that ``share`` of its sentences treat, each once.

    Null, blank and sentenceless texts have no row. Whole texts are read. The rules are broadcast; their
    number is bounded by the fit's sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                for s in shared.value.subjects_of(t.as_py(), share):
                    ids.append(i)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "subject"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, subject string")
