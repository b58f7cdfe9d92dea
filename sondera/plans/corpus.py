"""Queries over documents: digests, tokens, byte windows and token profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.functions import kernel
from sondera.functions.text import collapse_blanks, lower_words
from sondera.operators import profiles, windows
from sondera.operators.prefix import running_total
from sondera.plans.kernels import kernel_sql
from sondera.plans.registry import query
from sondera.session import store, table

WIDTH, STEP = 64, 32

#: (doc_id, pos, b): every byte of the corpus at its global place, the NUL after each file included.
_BYTES = """
WITH files AS (SELECT doc_id, hex(encode(coalesce(text, ''))) || '00' AS h FROM documents),
placed AS (SELECT doc_id, h, length(h) // 2 AS n, coalesce(sum(length(h) // 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM files),
bytes AS (SELECT off + i - 1 AS pos, ('0x' || substr(h, 2 * i - 1, 2))::INT AS b FROM (SELECT h, off, unnest(range(1, n + 1)) AS i FROM placed)),
seams AS (SELECT pos, b, CASE WHEN pos > 0 AND (lag(b) OVER (ORDER BY pos) & 1) <> (b >> 7) THEN 1 ELSE 0 END AS seam FROM bytes),
pre AS (SELECT pos, b, sum(bit_count(b)) OVER w AS ones, sum(bit_count(xor(b, b >> 1) & 127) + seam) OVER w AS turns FROM seams WINDOW w AS (ORDER BY pos ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT count(*) AS total FROM bytes),
starts AS (
  SELECT i AS window_id, i * 32 AS window_start, least(i * 32 + 64, total) AS window_end FROM tot, unnest(range(0, greatest(0, (total - 64) // 32) + 1)) AS r(i)
  UNION ALL SELECT (total - 64) // 32 + 1, total - 64, total FROM tot WHERE total > 64 AND (total - 64) % 32 <> 0
)"""
_WINDOWS = (
    _BYTES
    + """, win AS (
  SELECT window_id, window_start, window_end, (b.ones - a.ones + bit_count(a.b))::INT AS ones, (b.turns - a.turns + bit_count(xor(a.b, a.b >> 1) & 127))::INT AS transitions, 8 * (window_end - window_start) AS n
  FROM starts JOIN pre a ON a.pos = window_start JOIN pre b ON b.pos = window_end - 1
), met AS (
  SELECT *, CASE WHEN ones IN (0, n) THEN 0.0 ELSE -(ones / n) * log2(ones / n) - (1 - ones / n) * log2(1 - ones / n) END AS entropy, transitions / (n - 1) AS rupture FROM win
), wins AS (SELECT window_id, window_start, window_end, ones, transitions, 1 - entropy AS coherence, 1 - rupture AS stability, entropy, rupture, rupture AS lambda_hazard FROM met)"""
)
_TOKENS = r"""
WITH seg AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS s FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, lower(s) AS token FROM seg)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A table of fewer pieces than there are cores is spread, so that the pass over the texts is too; a larger one stays where it is.
    cores = spark.sparkContext.defaultParallelism
    if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return store(windows.byte_files(docs, key="doc_id"))


def _windows(files: DataFrame) -> DataFrame:
    return windows.byte_windows(files, width=WIDTH, step=STEP)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("token")).withColumn("token", F.lower("token"))


@query(_TOKENS + " SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY token")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every token."""
    per = _tokens(spark, sf_dir).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(_TOKENS + " SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 50")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(
    _TOKENS
    + r""" SELECT token, count(*) AS n FROM tok WHERE length(token) >= 3 AND NOT regexp_full_match(token, '\p{Nd}+')
  AND length(regexp_replace(token, '[^\p{L}]', '', 'g')) / length(token) >= 0.6 GROUP BY token"""
)
def token_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of at least three characters, not all digits, with a share of letters of 0.6 or more."""
    letters = F.length(F.regexp_replace("token", r"[^\p{L}]", "")) / F.length("token")
    keep = (F.length("token") >= 3) & ~F.col("token").rlike(r"^\p{Nd}+$") & (letters >= 0.6)
    return _tokens(spark, sf_dir).where(keep).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS n_bytes, length(coalesce(text, ''))::BIGINT AS n_chars, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 0)::BIGINT AS n_tokens FROM documents)
  SELECT doc_id, n_bytes, n_chars, n_tokens, coalesce(sum(n_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM d"""
)
def doc_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with the separator, characters, tokens and the global byte offset of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).cast("long").alias("n_tokens"))
    return running_total(d, ["doc_id"], "n_bytes", "byte_offset")


@query(_WINDOWS + " SELECT window_id, window_start, window_end, ones, transitions, round(coherence, 6) AS coherence, round(stability, 6) AS stability, round(entropy, 6) AS entropy, round(rupture, 6) AS rupture FROM wins")
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sliding window of 64 bytes, step 32, over the whole corpus with its metrics."""
    w = _windows(_files(spark, sf_dir))
    return w.select("window_id", "window_start", "window_end", "ones", "transitions", *(F.round(m, 6).alias(m) for m in ("coherence", "stability", "entropy", "rupture")))


@query(
    _WINDOWS
    + """, b AS (SELECT round_even(coherence * 100, 0) / 100 AS c, round_even(stability * 100, 0) / 100 AS s, round_even(entropy * 100, 0) / 100 AS e FROM wins)
  SELECT 'c' || c::VARCHAR || '_s' || s::VARCHAR || '_e' || e::VARCHAR AS signature, count(*) AS n FROM b GROUP BY ALL"""
)
def window_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each signature."""
    return windows.with_signature(_windows(_files(spark, sf_dir))).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query(
    _WINDOWS
    + """ SELECT count(*) AS n_windows, round(avg(coherence), 6) AS mean_coherence, round(avg(stability), 6) AS mean_stability, round(avg(entropy), 6) AS mean_entropy, round(avg(rupture), 6) AS mean_rupture,
  (SELECT total FROM tot) AS n_bytes, (SELECT count(*) FROM documents) AS n_files FROM wins"""
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    w = _windows(files).agg(F.count(F.lit(1)).alias("n_windows"), *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in ("coherence", "stability", "entropy", "rupture")))
    return w.join(files.agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_files")))


_PROFILE = (
    _WINDOWS
    + r""", seg0 AS (SELECT doc_id, off, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: x) AS l FROM documents JOIN placed USING (doc_id)),
seg AS (SELECT doc_id, off, l[i] AS s, i FROM (SELECT doc_id, off, l, unnest(range(1, len(l) + 1)) AS i FROM seg0)),
pos AS (SELECT *, off + coalesce(sum(strlen(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bs FROM seg),
occ AS (SELECT lower(s) AS string, bs AS byte_start, bs + strlen(s) AS byte_end FROM pos WHERE regexp_matches(s, '^[\p{L}\p{N}_]')),
cand AS (SELECT string, byte_start, byte_end, unnest(range(greatest(0, (byte_end - 64 + 31) // 32 - 1), byte_start // 32 + 1)) AS window_id FROM occ UNION ALL SELECT string, byte_start, byte_end, (SELECT max(window_id) FROM wins) FROM occ),
cov AS (SELECT DISTINCT c.string, c.byte_start, c.byte_end, w.* FROM cand c JOIN wins w USING (window_id) WHERE w.window_start <= c.byte_start AND w.window_end >= c.byte_end),
means AS (SELECT string, count(DISTINCT window_id) AS n_windows, avg(coherence) AS coherence, avg(stability) AS stability, avg(entropy) AS entropy, avg(rupture) AS rupture, avg(lambda_hazard) AS lambda_hazard FROM cov GROUP BY string),
prof AS (SELECT o.string, o.occurrences, coalesce(n_windows, 0) AS n_windows, coalesce(coherence, 0) AS coherence, coalesce(stability, 0) AS stability, coalesce(entropy, 0) AS entropy, coalesce(rupture, 0) AS rupture, coalesce(lambda_hazard, 0) AS lambda_hazard
  FROM (SELECT string, count(*) AS occurrences FROM occ GROUP BY string) o LEFT JOIN means USING (string)),
scored AS (SELECT *, 1 / (1 + exp(-(0.5 * coherence + 0.3 * stability - 0.2 * entropy - 0.2 * rupture))) AS patternability FROM prof)"""
)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.corpus_profiles(_files(spark, sf_dir), width=WIDTH, step=STEP)


@query(_PROFILE + " SELECT string, occurrences, n_windows, round(coherence, 6) AS coherence, round(stability, 6) AS stability, round(entropy, 6) AS entropy, round(rupture, 6) AS rupture, round(patternability, 6) AS patternability FROM scored")
def string_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each token's mean metrics over the windows that cover its occurrences."""
    p = _profiles(spark, sf_dir)
    return p.select("string", "occurrences", "n_windows", *(F.round(m, 6).alias(m) for m in ("coherence", "stability", "entropy", "rupture", "patternability")))


@query(_PROFILE + " SELECT string, occurrences, round(patternability, 6) AS patternability FROM scored WHERE occurrences >= 5 ORDER BY round(patternability, 6) DESC, string LIMIT 25")
def patternability_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir).where("occurrences >= 5").select("string", "occurrences", F.round("patternability", 6).alias("patternability"))
    return p.orderBy(F.desc("patternability"), "string").limit(25)


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(l)::INT AS n_sentences, list_max(list_transform(l, lambda x: length(x)))::INT AS longest FROM s WHERE len(l) > 0"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences cut at ., ! and ?, blanks collapsed, empty ones dropped."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))
    s = F.filter(F.transform(F.split("text", "[.!?]"), plain), lambda x: x != "")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", s.alias("l")).where(F.size("l") > 0)
    return d.select("doc_id", F.size("l").alias("n_sentences"), F.array_max(F.transform("l", F.length)).alias("longest"))


@query(
    r"""WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]+[A-Za-z0-9_%]*'))) AS entity FROM documents WHERE text IS NOT NULL)
  SELECT entity, count(*) AS n_docs FROM e GROUP BY entity"""
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric entities: digits with what follows them in the word."""
    e = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9]+[A-Za-z0-9_%]*"), F.lit(0))))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", e.alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT unnest([2, 3, 4, 5]) AS size),
  g AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, s WHERE len(w) >= size)),
  p AS (SELECT size, phrase, doc_id, i - lag(i) OVER (PARTITION BY phrase, doc_id ORDER BY i) AS gap FROM g)
  SELECT size, phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(avg(gap), 6) AS mean_gap, round(var_samp(gap), 4) AS gap_variance FROM p GROUP BY size, phrase HAVING count(*) >= 5"""
)
def ngram_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to five words that stand five times or more, with mean and variance of the gap between repeats in a document."""
    w = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lower_words(F.col("text")).alias("w"))
    p = profiles.phrases(w, "doc_id", "w", (2, 3, 4, 5), least=5)
    return p.select("size", "phrase", "n", "n_docs", F.round("mean_gap", 6).alias("mean_gap"), F.round("gap_variance", 4).alias("gap_variance"))


_EVENTS = """, pairs AS (
  SELECT d.doc_id, bit_count(b & (b >> 1) & 127) + CASE WHEN i > 1 AND (pb & 1) = 1 AND (b >> 7) = 1 THEN 1 ELSE 0 END AS rupture,
    bit_count(xor(b, b >> 1) & 127) + CASE WHEN i > 1 AND (pb & 1) <> (b >> 7) THEN 1 ELSE 0 END AS flip, CASE WHEN i > 1 THEN 8 ELSE 7 END AS n
  FROM (SELECT doc_id, i, ('0x' || substr(h, 2 * i - 1, 2))::INT AS b, CASE WHEN i > 1 THEN ('0x' || substr(h, 2 * i - 3, 2))::INT END AS pb FROM (SELECT doc_id, h, unnest(range(1, n + 1)) AS i FROM placed)) d
) SELECT doc_id, sum(n - flip - rupture)::BIGINT AS nulls, sum(flip)::BIGINT AS flips, sum(rupture)::BIGINT AS ruptures FROM pairs GROUP BY doc_id"""


@query(_BYTES + _EVENTS)
def bit_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL, FLIP and RUPTURE events of each document's bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("00"))).alias("data"))
    return windows.event_counts(docs, "doc_id", "data")


@query(
    r"""WITH t AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS span_id FROM documents WHERE text IS NOT NULL)
  SELECT span_id, min(doc_id) AS first_doc, count(*) AS n FROM t GROUP BY span_id"""
)
def span_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the digest of their normalised text."""
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(collapse_blanks(F.lower("text")).cast("binary")).alias("span_id"))
    return t.groupBy("span_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


#: kb(key, i, b): the bits of each document's text, most significant first.
_DOC_BITS = """
WITH files AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
kb AS (SELECT doc_id AS key, 8 * (k - 1) + j AS i, (v >> (7 - j)) & 1 AS b FROM (SELECT doc_id, k, ('0x' || substr(h, 2 * k - 1, 2))::INT AS v FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS k FROM files)), (SELECT unnest(range(0, 8)) AS j))"""


@query(
    _DOC_BITS
    + ", "
    + kernel_sql()
    + """ SELECT doc_id, round(coalesce(coherence, 0), 6) AS coherence, round(coalesce(entropy, 0), 6) AS entropy, round(coalesce(flip, 0), 6) AS flip, round(coalesce(rupture, 0), 6) AS rupture, round(coalesce(lambda_hazard, 0), 6) AS lambda_hazard, coalesce(collapse, 0) AS collapse
  FROM files LEFT JOIN kern ON key = doc_id"""
)
def qfh_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full event kernel over the bits of every document."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return windows.byte_kernel(docs, "doc_id", "data").select("doc_id", *(F.round(f, 6).alias(f) for f in kernel.FIELDS))


@query(
    _DOC_BITS
    + """, ev AS (SELECT key, i, CASE WHEN b = 0 AND nb = 0 THEN 'NULL' WHEN b = 1 AND nb = 1 THEN 'RUPTURE' ELSE 'FLIP' END AS state FROM (SELECT key, i, b, lead(b) OVER (PARTITION BY key ORDER BY i) AS nb FROM kb) WHERE nb IS NOT NULL),
  r AS (SELECT key, state, count(*) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY key, state ORDER BY i) AS g FROM ev) GROUP BY key, state, g)
  SELECT state, length, count(*) AS n FROM r GROUP BY ALL"""
)
def run_length_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal bit events of each document's text, by state and length."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("data"))
    return windows.event_runs(docs, "data").groupBy("state", "length").agg(F.sum("n").alias("n"))
