"""SQL of the full event kernel over rows of bits, shared by several oracles."""

from __future__ import annotations


def _h(flip: str, rupture: str) -> str:
    term = lambda p: f"CASE WHEN {p} > 0 THEN ({p}) * log2({p}) ELSE 0 END"
    return f"greatest(0.05, least(1.0, -({term(f'(1 - {flip} - {rupture})')} + {term(flip)} + {term(rupture)}) / 1.585))"


def kernel_sql() -> str:
    """CTEs that make kern(key, coherence, entropy, flip, rupture, lambda_hazard, collapse) of kb(key, i, b), i from 0."""
    shapes = {"a": "f * exp(-0.1 * i)", "b": "f + i * (l - f) / (n - 1)", "c": "(f + l) / 2 + (l - f) / 2 * sin(2 * pi() * i / n)"}
    sums = ", ".join(f"sum(({x}) * path) AS d{k}, sum(({x}) * ({x})) AS s{k}" for k, x in shapes.items())
    like = ", ".join(f"CASE WHEN s{k} > 0 AND pp > 0 THEN d{k} / (sqrt(s{k}) * sqrt(pp)) ELSE 0 END" for k in shapes)
    return f"""kn AS (SELECT key, i, b, lead(b) OVER w AS nb, first_value(b) OVER w AS b0 FROM kb WINDOW w AS (PARTITION BY key ORDER BY i)),
  kr AS (SELECT key, count(*) AS n, count_if(nb <> b) / (count(*) - 1) AS flip, count_if(nb = 1 AND b = 1) / (count(*) - 1) AS rupture,
    count_if(nb <> b AND i < 19) / (least(count(*), 20) - 1) AS nf, count_if(nb = 1 AND b = 1 AND i < 19) / (least(count(*), 20) - 1) AS nr FROM kn GROUP BY key HAVING count(*) >= 2),
  kd AS (SELECT *, {_h("flip", "rupture")} AS h, greatest(0.01, least(1.0, 0.5 * {_h("nf", "nr")})) AS damp FROM kr),
  kp AS (SELECT kn.key, i, kd.n, CASE WHEN i = 0 THEN b::DOUBLE ELSE sum(CASE WHEN i > 0 THEN (b - b0) * exp(-damp * i) ELSE 0 END) OVER (PARTITION BY kn.key ORDER BY i) END AS path FROM kn JOIN kd USING (key)),
  ke AS (SELECT key, i, n, path, first_value(path) OVER w AS f, last_value(path) OVER w AS l FROM kp WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  ks AS (SELECT key, any_value(abs(l)) AS last, sum(path * path) AS pp, {sums} FROM ke GROUP BY key),
  kc AS (SELECT kd.*, last, CASE WHEN n < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, greatest({like}))) END AS liking, greatest(0.01, least(0.99, 0.6 * (1 - h) + 0.3 * (1 - rupture) + 0.1 * (1 - flip))) AS c0 FROM kd JOIN ks USING (key)),
  kx AS (SELECT key, h AS entropy, flip, rupture, greatest(0.0, least(1.0, CASE WHEN n > 10 THEN (0.7 * c0 + 0.3 * liking) / CASE WHEN last < 2 THEN 1 + 0.1 * last ELSE 1 END ELSE c0 END)) AS coherence FROM kc),
  kern AS (SELECT key, coherence, entropy, flip, rupture, greatest(0.0, least(1.0, 0.3 * entropy + 0.2 * (1 - coherence))) AS lambda_hazard, CASE WHEN rupture >= 0.5 THEN 1.0 ELSE 0.0 END AS collapse FROM kx)"""
