"""DuckDB statements for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_TERMS = f"""
WITH latest AS (
  SELECT cand_id, file_id, occurrences, lower(trim(regexp_replace(text, '{BLANK}', ' ', 'g'))) AS term
  FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY loaded_at DESC) = 1
), counted AS (
  SELECT term, sum(greatest(coalesce(occurrences, 0), 0))::BIGINT AS total, count(DISTINCT file_id) AS files
  FROM latest WHERE term <> '' GROUP BY term
), marked AS (
  SELECT term, total, files,
    CASE WHEN total < 5 OR files < 2 THEN 'rare' WHEN files > 0.5 * (SELECT count(DISTINCT file_id) FROM latest) THEN 'common' END AS mark
  FROM counted
)"""

_SCORES = f"""
WITH latest AS (
  SELECT window_id, lower(regexp_replace(source, '^{BLANK}|{BLANK}$', '', 'g')) AS source, coherence::DOUBLE AS coherence, stability::DOUBLE AS stability, entropy::DOUBLE AS entropy
  FROM signature_stats WHERE window_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY updated_at DESC) = 1
), vals AS (
  SELECT window_id, source, 'coherence' AS metric, coherence AS v FROM latest UNION ALL
  SELECT window_id, source, 'stability', stability FROM latest UNION ALL
  SELECT window_id, source, 'entropy', entropy FROM latest
), good AS (SELECT * FROM vals WHERE source IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 1)"""

_CUTS = (
    _SCORES
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, metric ORDER BY CASE WHEN metric = 'entropy' THEN v ELSE -v END) AS rn,
    count(*) OVER (PARTITION BY source, metric) AS n
  FROM good
), cuts AS (
  SELECT r.source, r.metric, t.keep_permille, r.n, r.v AS cutoff
  FROM ranked r JOIN cutoff_targets t ON lower(trim(t.source)) = r.source AND t.metric = r.metric
  WHERE t.keep_permille IS NOT NULL AND r.rn = greatest(1, (r.n * t.keep_permille + 999) // 1000)
), kept AS (
  SELECT g.source, g.metric, g.window_id, c.keep_permille, c.n, c.cutoff FROM good g JOIN cuts c USING (source, metric)
  WHERE CASE WHEN g.metric = 'entropy' THEN g.v <= c.cutoff ELSE g.v >= c.cutoff END
)"""
)

_RUNS = r"""
WITH ev AS (
  SELECT DISTINCT instrument, window_start, window_end, id, lower(regexp_replace(signature, '\s', '', 'g')) AS sig FROM signals
  WHERE instrument IS NOT NULL AND window_start IS NOT NULL AND id IS NOT NULL
), num AS (
  SELECT *, regexp_matches(sig, '^c[0-9]*[.]?[0-9]+_s[0-9]*[.]?[0-9]+_e[0-9]*[.]?[0-9]+$') AS ok, string_split(sig, '_') AS p FROM ev
), xyz AS (
  SELECT instrument, window_start, window_end, id, coalesce(ok, false) AS ok,
    CASE WHEN ok THEN p[1][2:]::DECIMAL(18,6) END AS a, CASE WHEN ok THEN p[2][2:]::DECIMAL(18,6) END AS b, CASE WHEN ok THEN p[3][2:]::DECIMAL(18,6) END AS c
  FROM num
), linked AS (
  SELECT *, coalesce(ok AND lag(ok) OVER w AND abs(a - lag(a) OVER w) <= 0.01 AND abs(b - lag(b) OVER w) <= 0.01 AND abs(c - lag(c) OVER w) <= 0.01, false) AS joined
  FROM xyz WINDOW w AS (PARTITION BY instrument ORDER BY window_start, id)
), isl AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY window_start, id ROWS UNBOUNDED PRECEDING) AS k FROM linked
), runs AS (
  SELECT instrument, arg_min(id, (window_start, id)) AS first_id, arg_max(id, (window_start, id)) AS last_id, count(*) AS n_events, min(window_start) AS run_start,
    max(coalesce(window_end, window_start)) - min(window_start) AS duration_ms
  FROM isl WHERE ok GROUP BY instrument, k HAVING count(*) > 1
)"""

_PAIRS = """
WITH latest AS (
  SELECT window_id, coherence::DOUBLE AS c, stability::DOUBLE AS s, entropy::DOUBLE AS e, rupture::DOUBLE AS r, lambda_::DOUBLE AS l
  FROM signature_stats WHERE window_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY updated_at DESC) = 1
), good AS (SELECT * FROM latest WHERE c BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1 AND e BETWEEN 0 AND 1 AND r BETWEEN 0 AND 1 AND l BETWEEN 0 AND 1),
near AS (
  SELECT a.window_id AS id, b.window_id AS other, (a.c-b.c)*(a.c-b.c) + (a.s-b.s)*(a.s-b.s) + (a.e-b.e)*(a.e-b.e) + (a.r-b.r)*(a.r-b.r) + (a.l-b.l)*(a.l-b.l) AS d2
  FROM good a JOIN good b ON a.window_id <> b.window_id
  QUALIFY row_number() OVER (PARTITION BY a.window_id ORDER BY d2, b.window_id) <= 3
)"""

_WORDS = r"""
WITH dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, len(w) - 8)]) AS g FROM dw WHERE len(w) >= 10),
ig AS (SELECT item_id, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, len(w) - 8)]) AS g FROM iw WHERE len(w) >= 10)"""

_SHARED = """
WITH latest AS (SELECT rec_id, text, occurrences, cardinality(sources)::INT AS n_sources FROM spans WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1),
txt AS (SELECT text, min(rec_id) AS rep, count(*) AS copies FROM latest WHERE text IS NOT NULL GROUP BY text),
places AS (SELECT rep, i, text[i:i + 99] AS g FROM (SELECT rep, text, unnest(range(1, length(text) - 98)) AS i FROM txt WHERE length(text) >= 100)),
hits AS (SELECT DISTINCT x.rep, x.i, y.rep AS other FROM places x JOIN places y ON x.g = y.g AND x.rep <> y.rep)"""

ORACLES = {
    "p3_members": """WITH latest AS (SELECT rec_id, text FROM spans WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1)
  SELECT rec_id, min(rec_id) OVER (PARTITION BY text) AS text_id FROM latest WHERE text IS NOT NULL""",
    "p3_coverage": _SHARED
    + """, marked AS (SELECT rep, i - 1 - coalesce(lag(i) OVER (PARTITION BY rep ORDER BY i), -1000000) AS gap, i FROM (SELECT DISTINCT rep, i FROM hits)),
  covered AS (SELECT rep, sum(CASE WHEN gap + 1 >= 100 THEN 100 ELSE gap + 1 END)::INT AS n FROM marked GROUP BY rep), links AS (SELECT rep, count(DISTINCT other) AS n_links FROM hits GROUP BY rep)
  SELECT l.rec_id, length(l.text)::INT AS n_chars, CASE WHEN copies > 1 AND length(l.text) >= 100 THEN length(l.text) ELSE coalesce(c.n, 0) END::INT AS shared_chars, coalesce(n_links, 0) AS n_links, l.occurrences, l.n_sources
  FROM latest l LEFT JOIN txt USING (text) LEFT JOIN covered c USING (rep) LEFT JOIN links USING (rep)""",
    "p6_percentiles": _SCORES
    + """, sig AS (SELECT DISTINCT id, instrument, window_start, metrics.coherence AS coherence, metrics.stability AS stability, metrics.entropy AS entropy, metrics.rupture AS rupture, metrics.lambda_hazard AS lambda_hazard FROM signals WHERE id IS NOT NULL AND instrument IS NOT NULL AND window_start IS NOT NULL),
  m AS (SELECT 'signals' AS tbl, instrument || '|' || strftime(make_timestamp(window_start * 1000), '%Y-%m-%d') AS grp, metric, v FROM (
    SELECT *, unnest(['coherence', 'stability', 'entropy', 'rupture', 'lambda_hazard']) AS metric, unnest([coherence, stability, entropy, rupture, lambda_hazard]) AS v FROM sig)
  UNION ALL SELECT 'signature_stats', source, metric, v FROM good WHERE metric <> 'stability'
  ), ranked AS (SELECT *, row_number() OVER (PARTITION BY tbl, grp, metric ORDER BY v) AS rn, count(*) OVER (PARTITION BY tbl, grp, metric) AS n FROM m WHERE v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 1
  ), hit AS (SELECT tbl, grp, metric, pct, n, v FROM ranked, (SELECT unnest([50, 90]) AS pct) WHERE rn = greatest(1, (pct * n + 99) // 100)
  ), b AS (SELECT *, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.01 / 0.99)) END AS ix FROM hit)
  SELECT tbl, grp, metric, pct, n, round(CASE WHEN v > 0 THEN 2.0 / (1.01 / 0.99 + 1) * pow(1.01 / 0.99, ix) ELSE 0 END, 6) AS estimate FROM b""",
    "p2_found": _PAIRS + " SELECT DISTINCT least(id, other) AS window_a, greatest(id, other) AS window_b FROM near",
    "p2_neighbours": _PAIRS
    + """, told AS (SELECT query_window_id AS q, window_id AS w, min(distance) AS suggested FROM twin_suggestions WHERE distance >= 0 GROUP BY ALL)
  SELECT id AS query_window_id, other AS neighbour_id, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank, round(sqrt(d2), 6) AS distance, suggested FROM near LEFT JOIN told ON q = id AND w = other""",
    "p3_found": """WITH latest AS (SELECT rec_id, text FROM spans WHERE rec_id IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1),
  grams AS (SELECT DISTINCT rec_id, unnest([text[i:i + 99] FOR i IN range(1, length(text) - 98)]) AS g FROM latest WHERE length(text) >= 100)
  SELECT DISTINCT a.rec_id AS rec_a, b.rec_id AS rec_b FROM grams a JOIN grams b ON a.g = b.g AND a.rec_id < b.rec_id""",
    "p8_found": _WORDS + " SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)",
    "p1_found": _TERMS + " SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + " SELECT term, total, files, mark FROM marked",
    "p4_found": _CUTS + " SELECT source, metric, window_id FROM kept",
    "p4_cutoffs": _CUTS + " SELECT source, metric, keep_permille, n, cutoff, count(*) AS kept FROM kept GROUP BY ALL",
    "p5_found": _RUNS + " SELECT instrument, first_id, last_id FROM runs",
    "p5_runs": _RUNS + " SELECT instrument, first_id, last_id, n_events, run_start, duration_ms FROM runs",
    "p6_found": _SCORES
    + """, sig AS (SELECT DISTINCT id, instrument, window_start, metrics.rupture AS rupture, metrics.lambda_hazard AS lambda_hazard, metrics.coherence AS coherence, metrics.stability AS stability, metrics.entropy AS entropy FROM signals WHERE id IS NOT NULL),
  m AS (
  SELECT 'signals' AS tbl, instrument || '|' || strftime(make_timestamp(window_start * 1000), '%Y-%m-%d') AS grp, l.metric, l.pct, l.upper_limit,
    CASE l.metric WHEN 'rupture' THEN rupture WHEN 'lambda_hazard' THEN lambda_hazard WHEN 'coherence' THEN coherence WHEN 'stability' THEN stability WHEN 'entropy' THEN entropy END AS v
  FROM sig JOIN percentile_limits l ON l.tbl = 'signals'
  UNION ALL SELECT 'signature_stats', source, l.metric, l.pct, l.upper_limit, v FROM good JOIN percentile_limits l ON l.tbl = 'signature_stats' AND l.metric = good.metric
  ), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tbl, grp, metric, pct ORDER BY v) AS rn, count(*) OVER (PARTITION BY tbl, grp, metric, pct) AS n
  FROM m WHERE grp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 1
) SELECT tbl, grp, metric FROM ranked WHERE n >= 20 AND rn = (pct * n + 99) // 100 AND v > upper_limit""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
