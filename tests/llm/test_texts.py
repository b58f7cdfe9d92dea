import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sondera.llm import leakage, subjects, tokenise

TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def rank():
    return tokenise.read_vocabulary(tokenise.DEFAULT_VOCABULARY)


def reference():
    import public_tokenizers

    t = TOKENIZERS.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", " ", "Hello  world\n\n it's 12345 o'clock", "naïve café é́ 漢字 　 x", "<|endoftext|> is text", "\U0001f600" * 9, "a" * 3000, "ab" * 2000, "\x1c\x1d\t\r\n x", "½²३ x_y__z", "'S 'll 'LL", "x" * 40 + " " * 70 + "\n" * 5]


def test_ids_equal_the_public_tokenizer(rank):
    t, e = reference(), tokenise.Encoder(rank)
    r = random.Random(1)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FF), r.randrange(0x400, 0xD7FF)])) for _ in range(80)) for _ in range(200)]
    assert [e.encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_perfect_hash_is_minimal_and_exact(rank):
    assert sorted(rank.values) == list(range(rank.n)) and len(set(rank.keys)) == rank.n
    assert rank.get(b"no such key at all") is None
    small = tokenise.PerfectHash([b"", b"a", b"ab"], [5, 6, 7])
    assert [small.get(k) for k in (b"", b"a", b"ab", b"b")] == [5, 6, 7, None]


def test_corpus_keeps_rows_nulls_and_repeats(spark):
    rows = [(1, "hello", "x"), (2, None, "x"), (2, None, "x"), (3, "", None), (None, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids) for r in tokenise.encode_corpus(df).collect()))
    assert got == [(0, [64, 275]), (1, [31373]), (2, []), (2, []), (3, [])]
    assert tokenise.encode_corpus(df.limit(0)).count() == 0


def grams(text, n):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_match_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    sentence = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(r.choice([5, 10, 12, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "the " * 30), (3, items_text := "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    docs = []
    for i in range(150):
        words = sentence(r.randrange(0, 60))
        if r.random() < 0.5:
            src = (r.choice(items)[1] or "").split()
            cut = src[r.randrange(0, 3) :][: r.choice([9, 10, 11, 40])]
            words = [*words[:5], *(w.upper() for w in cut), *words[5:]]
        docs.append((i, r.choice([" ", "_", ", ", "\n-- "]).join(words)))
    docs += [(500, None), (501, " "), (502, "the_" * 5000), (503, items_text), (503, items_text)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.item, x.doc) for x in leakage.leaks(d, t).collect()}
    want = {(i, k) for i, a in items for k, b in docs if grams(a, 10) & grams(b, 10)}
    assert got == want and (92, 502) in got
    near = {(x.item, x.doc, x.kind) for x in leakage.leaks(d, t, slop=1).collect()}
    assert {(i, k) for i, k, kind in near if kind == "phrase"} == want
    assert leakage.leaks(d.limit(0), t).count() == 0 and leakage.leaks(d, t.limit(0)).count() == 0


def test_near_matches_allow_a_word_between(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    doc = item.replace("six", "six extra")
    d, t = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert leakage.leaks(d, t).count() == 0
    assert [(r.kind, r.n_words) for r in leakage.leaks(d, t, slop=1).collect()] == [("near", 12)]


def brute_near(items, docs, length, slop):
    """{(item, doc): most words of the item within ``slop`` places of one shift}, from every shift of every pair."""
    out = {}
    split = lambda t: [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
    for i, a in items:
        a = split(a)
        for k, b in docs:
            b = split(b)
            for s in range(-len(a) - slop, len(b) + slop):
                n = sum(any(0 <= s + o + m < len(b) and b[s + o + m] == t for m in range(-slop, slop + 1)) for o, t in enumerate(a))
                if n >= length:
                    out[i, k] = max(out.get((i, k), 0), n)
    return out


@pytest.mark.parametrize("slop,hits,words", [(1, 2_000_000, 200_000), (2, 40, 30)])
def test_near_matches_equal_brute_force(spark, monkeypatch, slop, hits, words):
    monkeypatch.setattr(leakage, "HITS", hits)
    monkeypatch.setattr(leakage, "ITEM_WORDS", words)
    r = random.Random(8)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(common) if r.random() < 0.3 else r.choice(rare) for _ in range(r.choice([9, 10, 14, 25])))) for i in range(12)]
    docs = []
    for i in range(60):
        src = r.choice(items)[1].split()
        cut = [f"gone{i}" if r.random() < 0.15 else w for w in src if r.random() > 0.05]
        docs.append((i, " ".join([r.choice(common + rare) for _ in range(r.randrange(8))] + cut + [r.choice(common + rare) for _ in range(r.randrange(8))])))
    docs.append((70, " ".join(a for _, a in items)))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.item, x.doc): (x.kind, x.n_words) for x in leakage.leaks(d, t, slop=slop).collect()}
    want = brute_near(items, docs, 10, slop)
    exact = {(i, k) for i, a in items for k, b in docs if grams(a, 10) & grams(b, 10)}
    assert set(got) == set(want) and {p for p, v in got.items() if v[0] == "phrase"} == exact
    assert all(v[1] == want[p] for p, v in got.items() if v[0] == "near") and len(set(want) - exact) > 10


def test_near_match_with_a_replaced_word(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, item.replace("six", "other"))], "doc_id long, text string")
    t = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.kind, r.n_words) for r in leakage.leaks(d, t, slop=1).collect()] == [("near", 11)]


SUBJECT_WORDS = {"law": ["court", "judge", "statute", "ruling", "treaty"], "sport": ["match", "coach", "goal", "league", "medal"], "music": ["choir", "melody", "violin", "stage", "score"]}


def made_docs(n, seed):
    r = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        own = r.sample(list(SUBJECT_WORDS), r.choice([0, 1, 1, 2]))
        lines = []
        for s in own:
            lines += [f"The {r.choice(SUBJECT_WORDS[s])} and the {r.choice(SUBJECT_WORDS[s])} were seen by name{r.randrange(50)}." for _ in range(4)]
        lines += ["Nothing else was decided in this call."] * 2
        r.shuffle(lines)
        docs.append((i, r.choice([" ", "\n- ", "\n\n"]).join(lines)))
        truth[i] = set(own)
        for s in own or [None]:
            wrong = r.random() < 0.05
            labels.append((i, r.choice(list(SUBJECT_WORDS)) if wrong and s else s and r.choice([s, s.upper()]), "r1"))
    return docs, truth, labels


def test_subjects_of_held_out_documents(spark):
    docs, truth, labels = made_docs(500, 3)
    train = {i for i in truth if i % 2}
    d = spark.createDataFrame([*docs, (900, None), (901, "  "), (902, "no sentence here")], "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] in train], "doc_id long, subject string, rater string")
    rules = subjects.fit(d, lab, sorted(SUBJECT_WORDS))
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, rules).collect()}
    want = {(i, s) for i, own in truth.items() for s in own}
    held = lambda x: {p for p in x if p[0] not in train}
    hit = len(held(got) & held(want))
    assert hit / len(held(got)) > 0.95 and hit / len(held(want)) > 0.95
    assert not {i for i, _ in got} & {900, 901, 902}


def test_subjects_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "The court was seen by a judge.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string, rater string")
    assert subjects.assign(d, subjects.fit(d, none, ["law"])).count() == 0
    assert subjects.assign(d.limit(0), subjects.fit(d.limit(0), none, ["law"])).count() == 0


def test_sentences():
    assert subjects.sentences(None) == [] and subjects.sentences("# Head\n\n---") == []
    got = subjects.sentences('2003-01-01T00:00:00Z INFO The fraction rose to 0.25 again. A second one came!\n{"lines": ["Third one stands here.", "0000"]}')
    assert [len(s) for s in got] == [8, 4, 5]


def test_rules_of_repeated_and_very_long_sentences(spark):
    docs, _, labels = made_docs(120, 5)
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = lambda i: "q" + letters[i % 26] + letters[i // 26 % 26] + letters[i // 676]
    boiler = " ".join(made(i) for i in range(40)) + "."
    # Half of the copies have a subject, the rest another: no single word tells it, so sets are grown.
    for i in range(50):
        docs.append((1000 + i, boiler + " It was seen by all."))
        labels.append((1000 + i, "law" if r.random() < 0.6 else "sport", "r1"))
    docs.append((2000, " ".join(made(i) for i in range(5000)) + "."))
    labels.append((2000, "law", "r1"))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    rules = subjects.fit(d, lab, sorted(SUBJECT_WORDS))
    assert {r.doc_id for r in subjects.assign(d, rules).collect()} >= {2000}
    assert rules.weights and all(len(w) <= 3 for w in rules.weights)


def brute_evidence(rules, words):
    total, covered = {}, set()
    for rule in sorted((r for r in rules.weights if set(r) <= words), key=lambda r: (-len(r), r)):
        for c, w in rules.weights[rule]:
            if (rule, c) not in covered:
                total[c] = total.get(c, 0.0) + w
            for m in range(1, len(rule)):
                covered |= {(x, c) for x in itertools.combinations(rule, m)}
    return total


def test_mined_sets_and_evidence_equal_brute_force():
    r = random.Random(2)
    words = [f"w{i:02d}" for i in range(14)]
    rows = [(sorted(r.sample(range(14), r.randrange(1, 8))), [int(x) for x in (r.random() < 0.4, r.random() < 0.3)], r.randrange(1, 4)) for _ in range(150)]
    place = {w: i for i, w in enumerate(words)}
    prior = subjects.np.array([0.4, 0.3])
    batch = subjects.pa.RecordBatch.from_pydict({"subjects": [[n for n, x in zip("ab", c) if x] for _, c, _ in rows], "words": [[words[i] for i in w] for w, _, _ in rows], "n": [n for _, _, n in rows]})
    shares = subjects.pa.Table.from_batches(list(subjects._shares(place, {"a": 0, "b": 1})([batch])))
    got = {}
    for k in set(shares["shard"].to_pylist()):
        t = shares.filter(subjects.pa.compute.equal(shares["shard"], k))
        for x in subjects._mine(2, 6, 0.3, prior)(t).to_pylist():
            got[tuple(x["words"])] = (x["n"], x["classes"])
    def count(s):
        own = [(c, n) for w, c, n in rows if set(s) <= set(w)]
        return sum(n for _, n in own), [sum(n * c[k] for c, n in own) for k in (0, 1)]
    assert all(count(s) == v for s, v in got.items()) and {len(s) for s in got} == {1, 2, 3}
    every = [s for m in (1, 2, 3) for s in itertools.combinations(range(14), m)]
    sets = [(tuple(words[i] for i in s), n, c) for s in every for n, c in [count(s)] if n >= 6 and max(c) >= 6]
    mined = [(tuple(words[i] for i in s), n, c) for s, (n, c) in got.items()]
    whole, pruned = (subjects._pruned(x, ["a", "b"], prior, 6, 0.3) for x in (sets, mined))
    assert whole.weights == pruned.weights and any(len(w) == 3 for w in whole.weights)
    for _ in range(50):
        some = set(r.sample(words, 9)) | {"none"}
        assert whole.evidence(some) == pytest.approx(brute_evidence(whole, some))
