"""SQL equivalents of the named queries, written from the definitions and independent of the DataFrame operators."""

from __future__ import annotations

import math

from lumipair.plans.queries import CURVE, GRID, SEED, THRESHOLDS

PI = repr(math.pi)
SIDE = "CASE WHEN l_linestatus = 'F' THEN 'sample' ELSE 'control' END"

# Pixels of the line-item images. `cells` is the full matrix with NULL in the unused end of the last row.
LINEITEM = f"""
placed AS (
  SELECT {SIDE} AS condition, l_returnflag AS image_id,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx,
         count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n,
         l_quantity AS c1, l_extendedprice AS c2, l_discount AS c3, l_tax AS c4
  FROM lineitem),
wide AS (
  SELECT condition, image_id, CAST(idx // 100 AS INTEGER) AS "row", CAST(idx % 100 AS INTEGER) AS col,
         CAST((n + 99) // 100 AS INTEGER) AS height, 100 AS width, c1, c2, c3, c4
  FROM placed),
px AS (
  SELECT condition, image_id, channel, "row", col, height, width, value
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS channel, unnest([c1, c2, c3, c4]) AS value FROM wide)),
dims AS (SELECT DISTINCT condition, image_id, height, width FROM wide)
"""

EMBEDDINGS = """
px AS (
  SELECT CASE WHEN (vec_id // 2) % 2 = 0 THEN 'sample' ELSE 'control' END AS condition,
         CAST(vec_id // 2 AS VARCHAR) AS image_id, CAST(vec_id % 2 + 1 AS INTEGER) AS channel,
         CAST((pos - 1) // 8 AS INTEGER) AS "row", CAST((pos - 1) % 8 AS INTEGER) AS col, 8 AS height, 8 AS width,
         CAST(embedding[pos] AS DOUBLE) AS value
  FROM embeddings, range(1, 65) AS r(pos)),
dims AS (SELECT DISTINCT condition, image_id, height, width FROM px)
"""

FILES = """
files AS (SELECT concat('img_', vec_id // 2, '_c', vec_id % 2 + 1, '.tif') AS name FROM embeddings),
parsed AS (
  SELECT name, regexp_replace(name, '_[^_]*$', '') AS image_id,
         CAST(regexp_extract(name, '_c([0-9]+)[.]', 1) AS INTEGER) AS channel
  FROM files)
"""

OTSU = """
limits AS (SELECT condition, image_id, channel, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL),
binned AS (
  SELECT condition, image_id, channel, lo, hi,
         CASE WHEN hi > lo THEN CAST(least(floor((value - lo) / (hi - lo) * 256), 255) AS INTEGER) ELSE 0 END AS bin,
         CAST(count(*) AS DOUBLE) AS n
  FROM px JOIN limits USING (condition, image_id, channel) GROUP BY ALL),
sums AS (
  SELECT *, sum(n) OVER upto AS w, sum(n * bin) OVER upto AS m, sum(n) OVER plane AS tw, sum(n * bin) OVER plane AS tm
  FROM binned
  WINDOW plane AS (PARTITION BY condition, image_id, channel),
         upto AS (PARTITION BY condition, image_id, channel ORDER BY bin)),
otsu_order AS (
  SELECT *, row_number() OVER (PARTITION BY condition, image_id, channel
                               ORDER BY (tm * w - tw * m) * (tm * w - tw * m) / (w * (tw - w)) DESC, bin) AS place
  FROM sums WHERE w < tw),
otsu AS (
  SELECT condition, image_id, channel,
         coalesce(lo + (bin + 1) * (hi - lo) / CAST(256 AS DOUBLE), lo) AS otsu_threshold
  FROM limits LEFT JOIN (SELECT condition, image_id, channel, bin FROM otsu_order WHERE place = 1)
       USING (condition, image_id, channel))
"""

MASKED = """
masked AS (
  SELECT px.* EXCLUDE (value), CASE WHEN value <= otsu_threshold THEN CAST(0 AS DOUBLE) ELSE value END AS value
  FROM px JOIN otsu USING (condition, image_id, channel))
"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def signal(pixels: str = "px", nx: int = 1, ny: int | None = None, pairs: str = "a.channel < b.channel") -> str:
    """Pixels with a signal in both channels and their patch, as `sig`, and all patches of all pairs, as `grid`."""
    ny = ny or nx
    return f"""
sig AS (
  SELECT a.condition, a.image_id, a.channel AS ch_x, b.channel AS ch_y,
         CAST(a."row" // (a.height // {nx}) + 1 AS INTEGER) AS patch_i,
         CAST(a.col // (a.width // {ny}) + 1 AS INTEGER) AS patch_j, a.value AS x, b.value AS y
  FROM {pixels} a JOIN {pixels} b
    ON a.condition = b.condition AND a.image_id = b.image_id AND a."row" = b."row" AND a.col = b.col AND {pairs}
  WHERE a.height >= {nx} AND a.width >= {ny}
    AND a."row" < {nx} * (a.height // {nx}) AND a.col < {ny} * (a.width // {ny})
    AND NOT isnan(a.value) AND NOT isnan(b.value) AND a.value <> 0 AND b.value <> 0),
grid AS (
  SELECT condition, image_id, a.channel AS ch_x, b.channel AS ch_y, CAST(i AS INTEGER) AS patch_i,
         CAST(j AS INTEGER) AS patch_j
  FROM (SELECT DISTINCT condition, image_id, height, width FROM {pixels} WHERE height >= {nx} AND width >= {ny}),
       (SELECT DISTINCT channel FROM {pixels}) a, (SELECT DISTINCT channel FROM {pixels}) b,
       range(1, {nx} + 1) AS ri(i), range(1, {ny} + 1) AS rj(j)
  WHERE {pairs})
"""


PATCH = "condition, image_id, ch_x, ch_y, patch_i, patch_j"
CORR = "CASE WHEN count(*) > 15 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END"


def rho(source: str = "sig", name: str = "rho") -> str:
    return f"""
{name} AS (
  SELECT {PATCH}, coalesce(n, 0) AS n, rho
  FROM grid LEFT JOIN (SELECT {PATCH}, count(*) AS n, {CORR} AS rho FROM {source} GROUP BY ALL) USING ({PATCH}))
"""


RANKED = f"""
ranked AS (
  SELECT {PATCH},
         rank() OVER (PARTITION BY {PATCH} ORDER BY x)
           + (count(*) OVER (PARTITION BY {PATCH}, x) - 1) / CAST(2 AS DOUBLE) AS x,
         rank() OVER (PARTITION BY {PATCH} ORDER BY y)
           + (count(*) OVER (PARTITION BY {PATCH}, y) - 1) / CAST(2 AS DOUBLE) AS y
  FROM sig)
"""

KENDALL = f"""
numbered AS (SELECT *, row_number() OVER () AS id FROM sig),
score AS (
  SELECT {', '.join('a.' + c for c in PATCH.split(', '))},
         CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS s,
         CAST(count(*) FILTER (a.x = b.x) AS DOUBLE) AS tx, CAST(count(*) FILTER (a.y = b.y) AS DOUBLE) AS ty,
         CAST(count(*) AS DOUBLE) AS pairs
  FROM numbered a JOIN numbered b
    ON {' AND '.join(f'a.{c} = b.{c}' for c in PATCH.split(', '))} AND a.id < b.id
  GROUP BY ALL),
rho AS (
  SELECT {PATCH}, coalesce(n, 0) AS n,
         CASE WHEN n > 15 AND pairs > tx AND pairs > ty THEN s / sqrt((pairs - tx) * (pairs - ty)) END AS rho
  FROM grid LEFT JOIN (SELECT {PATCH}, count(*) AS n FROM sig GROUP BY ALL) USING ({PATCH})
       LEFT JOIN score USING ({PATCH}))
"""

RHO = f"SELECT {PATCH}, n, round(rho, 6) AS rho FROM rho"
ONE_PAIR = "a.channel = 1 AND b.channel = {}"

SUMMARY = """
summary AS (
  SELECT condition, image_id, ch_x, ch_y, count(*) AS n_patches, avg(rho) AS mean_rho, stddev_samp(rho) AS sd_rho
  FROM rho WHERE rho IS NOT NULL AND NOT isnan(rho) GROUP BY ALL)
"""

# Posterior weights by summing the log likelihood of every image at every grid point.
MODEL = """
sigmas AS (SELECT CAST(j AS INTEGER) AS sigma_idx, pow(CAST(10 AS DOUBLE), -4 + CAST(4 * j AS DOUBLE) / 59) AS sigma FROM range(60) r(j)),
mus AS (SELECT CAST(i AS INTEGER) AS mu_idx, -1 + i * CAST(0.01 AS DOUBLE) AS mu FROM range(201) r(i)),
errors AS (
  SELECT *, greatest(coalesce(sd_rho, CAST(0.3 AS DOUBLE)) / sqrt(n_patches), CAST(0.001 AS DOUBLE)) AS se FROM summary),
scored AS (
  SELECT condition, ch_x, ch_y, mu_idx, sigma_idx, mu, sigma,
         sum(-CAST(0.5 AS DOUBLE) * ln(sigma * sigma + se * se)
             - CAST(0.5 AS DOUBLE) * (mean_rho - mu) * (mean_rho - mu) / (sigma * sigma + se * se)) AS ll
  FROM errors, mus, sigmas GROUP BY ALL),
priced AS (
  SELECT *, ll - ln(1 + pow(mu / CAST(0.3 AS DOUBLE), 2)) + ln(sigma)
    - ln(1 + pow((sigma - CASE WHEN condition = 'sample' THEN CAST(0.1 AS DOUBLE) ELSE 0 END) / CAST(0.3 AS DOUBLE), 2)) AS log_w
  FROM scored)
"""

SHARED = """
taus AS (SELECT sigma AS tau FROM sigmas),
scales AS (
  SELECT condition, ch_x, ch_y, sigma_idx, tau,
         sum(-CAST(0.5 AS DOUBLE) * ln(tau * tau + sd_rho * sd_rho / (2 * (n_patches - 1)))
             - CAST(0.5 AS DOUBLE) * (sd_rho - sigma) * (sd_rho - sigma) / (tau * tau + sd_rho * sd_rho / (2 * (n_patches - 1)))) AS ll
  FROM summary, taus, sigmas WHERE n_patches > 1 GROUP BY ALL),
tau_priced AS (
  SELECT *, ll + ln(tau) - ln(1 + pow((tau - CAST(0.1 AS DOUBLE)) / CAST(0.3 AS DOUBLE), 2)) AS lp FROM scales),
linked AS (
  SELECT condition, ch_x, ch_y, sigma_idx, ln(sum(exp(lp - top))) + max(top) AS extra
  FROM (SELECT *, max(lp) OVER (PARTITION BY condition, ch_x, ch_y, sigma_idx) AS top FROM tau_priced) GROUP BY ALL)
"""


def weights(log_w: str = "log_w", joined: str = "priced") -> str:
    return f"""
weighted AS (
  SELECT *, exp({log_w} - max({log_w}) OVER (PARTITION BY condition, ch_x, ch_y)) AS raw FROM {joined}),
cells AS (SELECT *, raw / sum(raw) OVER (PARTITION BY condition, ch_x, ch_y) AS w FROM weighted),
marginal AS (SELECT condition, ch_x, ch_y, mu_idx, sum(w) AS w FROM cells GROUP BY ALL)
"""


# 40 levels, 24 scales from 0.001 to 1 and 12 degrees of freedom from 0.1 to 100, each in the middle of its cell.
T_LEVELS = f"""
cells AS (
  SELECT -1 + (i + 0.5) / 20 AS mu, pow(10, -3 + 3 * (j + 0.5) / 24) AS s, 0.1 * pow(10, 3 * (k + 0.5) / 12) AS v
  FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(24)) AS j), (SELECT unnest(range(12)) AS k)),
scored AS (
  SELECT condition, image_id, ch_x, ch_y, mu, s, v,
         sum(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * {PI}) / 2 - ln(s)
             - (v + 1) / 2 * ln(1 + (rho - mu) * (rho - mu) / (v * s * s))) AS ll
  FROM rho, cells WHERE rho IS NOT NULL AND NOT isnan(rho)
  GROUP BY condition, image_id, ch_x, ch_y, mu, s, v),
topped AS (SELECT *, max(ll) OVER (PARTITION BY condition, image_id, ch_x, ch_y) AS top FROM scored),
weighed AS (SELECT *, exp(ll - top) AS w FROM topped)
"""

GRID_MODEL = (LINEITEM, signal(nx=GRID), rho(), SUMMARY, MODEL, weights())

DELTA = """
prior_raw AS (SELECT mu_idx, 1 / (1 + pow(mu / CAST(0.3 AS DOUBLE), 2)) AS raw FROM mus),
prior_one AS (SELECT mu_idx, raw / (SELECT sum(raw) FROM prior_raw) AS w FROM prior_raw),
both_kinds AS (
  SELECT 'posterior' AS kind, * FROM marginal
  UNION ALL BY NAME
  SELECT 'prior' AS kind, g.*, mu_idx, w FROM (SELECT DISTINCT condition, ch_x, ch_y FROM marginal) g, prior_one),
spread AS (
  SELECT s.kind, s.ch_x, s.ch_y, s.mu_idx - c.mu_idx AS delta_idx, sum(s.w * c.w) AS p
  FROM both_kinds s JOIN both_kinds c
    ON s.kind = c.kind AND s.ch_x = c.ch_x AND s.ch_y = c.ch_y AND s.condition = 'sample' AND c.condition = 'control'
  GROUP BY ALL)
"""


def thresholds(values) -> str:
    rows = ", ".join(f"(CAST({t!r} AS DOUBLE), {round(t * 100)})" for t in values)
    return f"thresholds(rho_threshold, t_idx) AS (VALUES {rows})"


GRID_TAILS = """
tails AS (
  SELECT kind, ch_x, ch_y, rho_threshold, sum(CASE WHEN delta_idx > t_idx THEN p ELSE 0 END) AS p_above,
         sum(CASE WHEN delta_idx > t_idx THEN 0 ELSE p END) AS p_below
  FROM spread, thresholds GROUP BY ALL)
"""

FACTORS = """
factors AS (
  SELECT o.ch_x, o.ch_y, o.rho_threshold, o.p_above AS p_posterior, r.p_above AS p_prior,
         (o.p_above / o.p_below) / (r.p_above / r.p_below) AS bf
  FROM tails o JOIN tails r USING (ch_x, ch_y, rho_threshold) WHERE o.kind = 'posterior' AND r.kind = 'prior')
"""


def uniform(which: int, *parts: str) -> str:
    key = ", ".join([f"'{SEED}'", *parts])
    return (
        f"((CAST('0x' || substr(md5(concat_ws('|', {key})), {1 + 13 * which}, 13) AS BIGINT) + CAST(0.5 AS DOUBLE))"
        " / CAST(4503599627370496 AS DOUBLE))"
    )


def cauchy(u: str, centre: float, low: float, high: float) -> str:
    f_low = 0.5 + math.atan((low - centre) / 0.3) / math.pi
    f_high = 0.5 + math.atan((high - centre) / 0.3) / math.pi
    d = "CAST({!r} AS DOUBLE)".format
    return f"{d(centre)} + {d(0.3)} * tan({d(math.pi)} * ({d(f_low)} + {u} * {d(f_high - f_low)} - {d(0.5)}))"


def _prior_columns() -> str:
    out = []
    for which, side, centre in ((0, "control", 0.0), (1, "sample", 0.1)):
        out += [
            f"""{cauchy(uniform(which, "'mu'", 'draw'), 0.0, -1.0, 1.0)} AS mu_{side}""",
            f"""-ln(1 - {uniform(which, "'nu'", 'draw')}) AS nu_{side}""",
            f"""{cauchy(uniform(which, "'sigma'", 'draw'), centre, 1e-4, 1.0)} AS sigma_{side}""",
            f"""{cauchy(uniform(which, "'tau'", 'draw'), 0.1, 1e-4, 1.0)} AS tau_{side}""",
        ]
    return ", ".join(out)


PRIOR_DRAWS = f"prior_draws AS (SELECT draw, {_prior_columns()} FROM ids)"
PRIOR = "ids AS (SELECT o_orderkey AS draw FROM orders),\n" + PRIOR_DRAWS

DRAWS = f"""
cdf AS (
  SELECT condition, ch_x, ch_y, mu, sigma,
         sum(w) OVER (PARTITION BY condition, ch_x, ch_y ORDER BY mu_idx, sigma_idx) - w AS lo
  FROM cells WHERE w > 0),
asked AS (
  SELECT draw, ch_x, ch_y, condition,
         CASE WHEN condition = 'control' THEN {uniform(0, "'posterior'", "ch_x", "ch_y", "draw")}
              ELSE {uniform(1, "'posterior'", "ch_x", "ch_y", "draw")} END AS u
  FROM ids, (SELECT DISTINCT condition, ch_x, ch_y FROM cells)),
drawn AS (
  SELECT a.draw, a.ch_x, a.ch_y, a.condition, c.mu, c.sigma
  FROM asked a ASOF JOIN cdf c ON a.condition = c.condition AND a.ch_x = c.ch_x AND a.ch_y = c.ch_y AND a.u >= c.lo),
posterior_draws AS (
  SELECT draw, ch_x, ch_y, max(mu) FILTER (condition = 'control') AS mu_control,
         max(sigma) FILTER (condition = 'control') AS sigma_control,
         max(mu) FILTER (condition = 'sample') AS mu_sample, max(sigma) FILTER (condition = 'sample') AS sigma_sample
  FROM drawn GROUP BY ALL)
"""

SAMPLES = """
samples AS (
  SELECT 'posterior' AS kind, ch_x, ch_y, mu_control, mu_sample FROM posterior_draws
  UNION ALL
  SELECT 'prior', ch_x, ch_y, mu_control, mu_sample
  FROM prior_draws, (SELECT DISTINCT ch_x, ch_y FROM posterior_draws)),
delta AS (SELECT kind, ch_x, ch_y, mu_sample - mu_control AS v FROM samples)
"""


def stats(source: str, keys: str, columns: list[str]) -> str:
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS name, round(avg({c}), 6) AS mean, round(quantile_cont({c}, CAST(0.5 AS DOUBLE)), 6) AS median, "
        f"round(quantile_cont({c}, CAST(0.025 AS DOUBLE)), 6) AS lower, round(quantile_cont({c}, CAST(0.975 AS DOUBLE)), 6) AS upper "
        f"FROM {source}" + (f" GROUP BY {keys}" if keys else "")
        for c in columns
    )


def phi(z: str) -> str:
    """The normal distribution function with Abramowitz and Stegun's formula 7.1.26."""
    d = "CAST({!r} AS DOUBLE)".format
    x = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
    t = f"(1 / (1 + {d(0.3275911)} * {x}))"
    poly = (
        f"{t} * ({d(0.254829592)} + {t} * ({d(-0.284496736)} + {t} * ({d(1.421413741)} + {t} * ({d(-1.453152027)}"
        f" + {t} * {d(1.061405429)}))))"
    )
    upper = f"{d(0.5)} * ({poly}) * exp(-{x} * {x})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


def kde_tails(keys: str) -> str:
    return f"""
widths AS (
  SELECT {keys}, count(*) AS n, min(v) AS low, max(v) AS high,
         CAST(0.9 AS DOUBLE) * least(stddev_samp(v),
           (quantile_cont(v, CAST(0.75 AS DOUBLE)) - quantile_cont(v, CAST(0.25 AS DOUBLE))) / CAST(1.34 AS DOUBLE))
           * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h
  FROM delta GROUP BY {keys}),
distances AS (
  SELECT {keys}, rho_threshold, (v - rho_threshold) / h AS z, v > rho_threshold AS beyond
  FROM delta JOIN widths USING ({keys}), thresholds),
tails AS (
  SELECT {keys}, rho_threshold, avg({phi('z')}) AS p_above, avg({phi('(-z)')}) AS p_below,
         avg(CASE WHEN beyond THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p_empirical
  FROM distances GROUP BY ALL)
"""


DENSITY = f"""
widths AS (
  SELECT kind, ch_x, ch_y, count(*) AS n, min(v) AS low, max(v) AS high,
         CAST(0.9 AS DOUBLE) * least(stddev_samp(v),
           (quantile_cont(v, CAST(0.75 AS DOUBLE)) - quantile_cont(v, CAST(0.25 AS DOUBLE))) / CAST(1.34 AS DOUBLE))
           * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h
  FROM delta GROUP BY ALL),
bins AS (
  SELECT kind, ch_x, ch_y, least(floor((v - low) / (high - low) * 2048), 2047) AS bin, count(*) AS m, low, high, h, n
  FROM delta JOIN widths USING (kind, ch_x, ch_y) GROUP BY ALL),
points AS (
  SELECT kind, ch_x, ch_y, CAST(p AS INTEGER) AS point, low - 3 * h + p * (high - low + 6 * h) / CAST(255 AS DOUBLE) AS x
  FROM widths, range(256) r(p))
SELECT kind, ch_x, ch_y, point, round(x, 5) AS x,
       round(sum(m * exp(-CAST(0.5 AS DOUBLE) * pow((x - (low + (bin + CAST(0.5 AS DOUBLE)) * (high - low) / 2048)) / h, 2)))
             / max(n * h * sqrt(2 * CAST({PI} AS DOUBLE))), 5) AS density
FROM bins JOIN points USING (kind, ch_x, ch_y) GROUP BY kind, ch_x, ch_y, point, x
"""


def keyed(source: str, position: str, *names: str) -> str:
    """Rows of `source` with their pseudo-random sorting key."""
    p = 2147483647
    md = f"md5(concat_ws('|', {', '.join([f"'{SEED}'", *names])}))"
    fifth = f"((z * z % {p}) * (z * z % {p}) % {p} * z % {p})"
    return f"""
  SELECT * EXCLUDE (z, b), {fifth} AS sort_key FROM (
    SELECT * REPLACE (({fifth} + b) % {p} AS z) FROM (
      SELECT *, (CAST({position} AS BIGINT) + CAST('0x' || substr({md}, 1, 13) AS BIGINT) % {p}) % {p} AS z,
             CAST('0x' || substr({md}, 14, 13) AS BIGINT) % {p} AS b
      FROM {source}))
"""


def pixel_shuffle(source: str, name: str) -> str:
    """The channel's values in key order, put back row by row. `source` is a full matrix."""
    rows = keyed(source, '"row" * width + col', "image_id", "channel")
    return f"""
{name} AS (
  SELECT condition, image_id, channel, CAST(k // width AS INTEGER) AS "row", CAST(k % width AS INTEGER) AS col,
         height, width, value
  FROM (SELECT *, row_number() OVER (PARTITION BY condition, image_id, channel ORDER BY sort_key, "row", col) - 1 AS k
        FROM ({rows})))
"""


def block_shuffle(b: int, name: str, source: str = "px") -> str:
    return f"""
shapes AS (
  SELECT DISTINCT condition, image_id, "row" // {b} AS bi, col // {b} AS bj,
         least({b}, height - ("row" // {b}) * {b}) AS bh, least({b}, width - (col // {b}) * {b}) AS bw,
         width // {b} + 1 AS across FROM {source}),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY condition, image_id, bh, bw ORDER BY bi, bj) AS slot,
         row_number() OVER (PARTITION BY condition, image_id, bh, bw
                            ORDER BY sort_key, bi, bj) AS turn
  FROM ({keyed("shapes", "bi * across + bj", "image_id")})),
moves AS (
  SELECT s.condition, s.image_id, s.bi, s.bj, d.bi AS ti, d.bj AS tj
  FROM keyed s JOIN keyed d ON s.condition = d.condition AND s.image_id = d.image_id
    AND s.bh = d.bh AND s.bw = d.bw AND s.turn = d.slot),
{name} AS (
  SELECT p.condition, p.image_id, channel, CAST(ti * {b} + "row" % {b} AS INTEGER) AS "row",
         CAST(tj * {b} + col % {b} AS INTEGER) AS col, height, width, value
  FROM {source} p JOIN moves m
    ON p.condition = m.condition AND p.image_id = m.image_id AND p."row" // {b} = m.bi AND p.col // {b} = m.bj)
"""


def as_control(source: str) -> str:
    return f"""
mixed AS (
  SELECT * FROM px WHERE condition = 'sample'
  UNION ALL BY NAME
  SELECT * REPLACE ('control' AS condition, 'shuffled_control_' || image_id AS image_id) FROM {source} WHERE condition = 'sample')
"""


CELLS = """
full_px AS (
  SELECT condition, image_id, channel, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, height, width, value
  FROM dims, range(0, height) AS rr(r), range(0, 100) AS cc(c), (SELECT unnest([1, 2, 3, 4]) AS channel) ch
       LEFT JOIN (SELECT condition AS pc, image_id AS pid, channel AS pch, "row" AS pr, col AS pcol, value FROM px) p
         ON pc = condition AND pid = image_id AND pch = channel AND pr = r AND pcol = c)
"""

PIXELS = 'SELECT condition, image_id, channel, "row", col, round(value, 6) AS value FROM'

FALLBACK = f"""
tried AS (
  SELECT a.condition, a.image_id, 1 AS ch_x, 2 AS ch_y, CAST(res AS INTEGER) AS resolution,
         CAST(a."row" // (8 // res) + 1 AS INTEGER) AS patch_i, CAST(a.col // (8 // res) + 1 AS INTEGER) AS patch_j,
         count(*) FILTER (a.value <> 0 AND b.value <> 0) AS n, corr(a.value, b.value) FILTER (a.value <> 0 AND b.value <> 0) AS r
  FROM px a JOIN px b ON a.condition = b.condition AND a.image_id = b.image_id AND a."row" = b."row" AND a.col = b.col
         AND a.channel = 1 AND b.channel = 2, range(1, 5) AS q(res)
  WHERE a."row" < res * (8 // res) AND a.col < res * (8 // res) GROUP BY ALL),
best AS (SELECT condition, image_id, max(resolution) FILTER (n > 15) AS resolution FROM tried GROUP BY ALL)
SELECT condition, image_id, ch_x, ch_y, resolution, patch_i, patch_j,
       patch_j * (8 // resolution) AS x, (resolution - patch_i + 1) * (8 // resolution) AS y,
       coalesce(round(CASE WHEN n > 15 THEN r END, 6), CAST(-2 AS DOUBLE)) AS rho
FROM tried JOIN best USING (condition, image_id, resolution)
"""


FALLBACK_SPEARMAN = f"""
cells AS (
  SELECT a.condition, a.image_id, CAST(res AS INTEGER) AS resolution,
         CAST(a."row" // (8 // res) + 1 AS INTEGER) AS patch_i, CAST(a.col // (8 // res) + 1 AS INTEGER) AS patch_j,
         a.value AS x, b.value AS y
  FROM px a JOIN px b ON a.condition = b.condition AND a.image_id = b.image_id AND a."row" = b."row" AND a.col = b.col
         AND a.channel = 1 AND b.channel = 2, range(1, 5) AS q(res)
  WHERE a."row" < res * (8 // res) AND a.col < res * (8 // res) AND a.value <> 0 AND b.value <> 0),
counts AS (SELECT condition, image_id, resolution, patch_i, patch_j, count(*) AS n FROM cells GROUP BY ALL),
best AS (SELECT condition, image_id, max(resolution) AS resolution FROM counts WHERE n > 15 GROUP BY ALL),
ranks AS (
  SELECT condition, image_id, resolution, patch_i, patch_j,
         rank() OVER (patch ORDER BY x) + (count(*) OVER (PARTITION BY condition, image_id, resolution, patch_i, patch_j, x) - 1) / 2 AS rx,
         rank() OVER (patch ORDER BY y) + (count(*) OVER (PARTITION BY condition, image_id, resolution, patch_i, patch_j, y) - 1) / 2 AS ry
  FROM cells JOIN best USING (condition, image_id, resolution)
  WINDOW patch AS (PARTITION BY condition, image_id, resolution, patch_i, patch_j))
SELECT condition, image_id, 1 AS ch_x, 2 AS ch_y, resolution, patch_i, patch_j,
       patch_j * (8 // resolution) AS x, (resolution - patch_i + 1) * (8 // resolution) AS y,
       coalesce(round(CASE WHEN count(*) > 15 THEN corr(rx, ry) END, 6), CAST(-2 AS DOUBLE)) AS rho
FROM ranks GROUP BY condition, image_id, resolution, patch_i, patch_j
"""


def _report_lines(digits: int = 6) -> str:
    columns = []
    for block, kind, column in (
        ("prior", "prior", "mu_sample"), ("posterior", "posterior", "mu_sample"),
        ("control_prior", "prior", "mu_control"), ("control_posterior", "posterior", "mu_control"),
        ("delta_rho", "posterior", "mu_sample - mu_control"),
    ):
        only = f"FILTER (kind = '{kind}')"
        columns.append(f"round(avg({column}) {only}, {digits}) AS mean_{block}")
        for p, label in ((0.5, "median"), (0.025, "lower_credible_interval"), (0.975, "upper_credible_interval")):
            columns.append(f"round(quantile_cont({column}, CAST({p} AS DOUBLE)) {only}, {digits}) AS {label}_{block}")
    return (
        "SELECT ch_x AS channel_1, ch_y AS channel_2, round(max(rho_threshold), 6) AS rho_threshold, "
        f"round(max(bf), {digits}) AS bf, {', '.join(columns)} FROM samples JOIN factors USING (ch_x, ch_y) GROUP BY ALL"
    )


MASKED_AND_CONTROL = """
mixed AS (
  SELECT * FROM masked WHERE condition = 'sample'
  UNION ALL BY NAME
  SELECT * REPLACE ('control' AS condition, 'shuffled_control_' || image_id AS image_id)
  FROM shuffled WHERE condition = 'sample')
"""

FINE_CURVE = [round(-0.8 + 0.01 * k, 10) for k in range(161)]
IDS = "ids AS (SELECT range AS draw FROM range(100000))"
MU_W = "SELECT condition, ch_x, ch_y, mu_idx, round(w, 6) AS w FROM marginal"
KINDS = "kind, ch_x, ch_y"

ORACLES: dict[str, str] = {
    "manifest": with_(FILES) + """
        SELECT image_id, channel, 'channel_' || channel AS channel_name, min(name) AS name, min(name) AS path
        FROM parsed WHERE channel BETWEEN 1 AND 2 GROUP BY image_id, channel""",
    "manifest_errors": with_(FILES) + """
        SELECT image_id, CAST(c AS INTEGER) AS channel FROM (SELECT DISTINCT image_id FROM parsed), range(1, 4) r(c)
        WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE p.image_id = image_id AND p.channel = c)""",
    "aligned_bands": with_(LINEITEM) + """
        SELECT condition, image_id, "row", round(sum(c1 * c2), 2) AS dot_12 FROM wide GROUP BY ALL""",
    "banded_pixels": with_(EMBEDDINGS) + f" {PIXELS} px",
    "image_shapes": with_(LINEITEM) + """
        SELECT condition, image_id, count(DISTINCT "row") AS n_rows, min(height) AS min_height, max(height) AS max_height,
               min(width) AS min_width, max(width) AS max_width FROM wide GROUP BY ALL""",
    "image_dims": with_(LINEITEM) + """
        SELECT condition, image_id, max("row") + 1 AS height, max(col) + 1 AS width FROM px GROUP BY ALL""",
    "image_metadata": with_(LINEITEM, OTSU) + """
        SELECT condition, image_id,
               CAST(dense_rank() OVER (PARTITION BY condition ORDER BY image_id) AS INTEGER) AS image_idx, channel,
               'channel_' || channel AS channel_name, height, width, round(otsu_threshold, 6) AS otsu_threshold
        FROM dims JOIN otsu USING (condition, image_id)""",
    "stack_positions": with_(EMBEDDINGS) + """
        SELECT condition, image_id, CAST(row_number() OVER (PARTITION BY condition ORDER BY image_id) AS INTEGER) AS image_idx
        FROM dims""",
    "stack_lengths": with_(EMBEDDINGS) + " SELECT condition, count(*) AS n_images FROM dims GROUP BY condition",
    "channel_pairs": with_(LINEITEM, "ch AS (SELECT DISTINCT condition, image_id, channel FROM px)") + """
        SELECT condition, image_id, a.channel AS ch_x, b.channel AS ch_y FROM ch a JOIN ch b USING (condition, image_id)
        WHERE a.channel < b.channel""",
    "minmax_norm": with_(LINEITEM, OTSU.split("binned")[0].strip().rstrip(",")) + """
        SELECT condition, image_id, channel, "row", count(*) AS n, round(sum((value - lo) / (hi - lo)), 6) AS total
        FROM px JOIN limits USING (condition, image_id, channel) GROUP BY ALL""",
    "composite": with_(LINEITEM, OTSU.split("binned")[0].strip().rstrip(",")) + """
        SELECT condition, image_id, "row", round(sum((value - lo) / (hi - lo)) FILTER (channel = 3), 6) AS red,
               round(sum((value - lo) / (hi - lo)) FILTER (channel = 2), 6) AS green,
               round(sum((value - lo) / (hi - lo)) FILTER (channel = 1), 6) AS blue
        FROM px JOIN limits USING (condition, image_id, channel) GROUP BY ALL""",
    "composite_two": with_(EMBEDDINGS, OTSU.split("binned")[0].strip().rstrip(",")) + """
        SELECT condition, image_id, "row", col, round(max((value - lo) / (hi - lo)) FILTER (channel = 2), 6) AS red,
               round(max((value - lo) / (hi - lo)) FILTER (channel = 1), 6) AS green, CAST(0 AS DOUBLE) AS blue
        FROM px JOIN limits USING (condition, image_id, channel) GROUP BY ALL""",
    "otsu_threshold": with_(LINEITEM, OTSU) + """
        SELECT condition, image_id, channel, round(otsu_threshold, 6) AS otsu_threshold FROM otsu""",
    "otsu_threshold_embeddings": with_(EMBEDDINGS, OTSU) + """
        SELECT condition, image_id, channel, round(otsu_threshold, 6) AS otsu_threshold FROM otsu""",
    "mask_counts": with_(LINEITEM, OTSU) + """
        SELECT condition, image_id, channel, count(*) FILTER (value > otsu_threshold) AS n_signal
        FROM px JOIN otsu USING (condition, image_id, channel) GROUP BY ALL""",
    "masked_mean": with_(LINEITEM, OTSU, MASKED) + """
        SELECT condition, image_id, channel, round(avg(value), 6) AS mean_value FROM masked GROUP BY ALL""",
    "mask_mosaic": with_(LINEITEM, OTSU) + """
        SELECT condition, image_id, col + (channel - 1) * width AS mosaic_col,
               count(*) FILTER (value > otsu_threshold) AS n_signal
        FROM px JOIN otsu USING (condition, image_id, channel) GROUP BY ALL""",
    **{
        name: with_(LINEITEM) + f"""
        SELECT condition, image_id, channel, CAST("row" // (height // {GRID}) + 1 AS INTEGER) AS patch_i,
               CAST(col // (width // {ny}) + 1 AS INTEGER) AS patch_j,
               max(CAST((height // {GRID}) * (width // {ny}) AS BIGINT)) AS n_pixels, count(value) AS n_values
        FROM px WHERE "row" < {GRID} * (height // {GRID}) AND col < {ny} * (width // {ny}) GROUP BY ALL"""
        for name, ny in (("patch_counts", GRID), ("patch_counts_rect", 5))
    },
    "unpatch_roundtrip": with_(LINEITEM) + """
        SELECT condition, image_id, channel, count(*) AS n, max("row") AS last_row, max(col) AS last_col,
               round(sum(value * (("row" * width + col) % 97)), 2) AS checksum
        FROM px WHERE "row" < 3 * (height // 3) AND col < 3 * (width // 3) GROUP BY ALL""",
    "patch_lines": with_(LINEITEM) + f"""
        SELECT condition, image_id, CAST(k AS INTEGER) AS line, k * (height // {GRID}) AS y, k * (width // {GRID}) AS x
        FROM dims, range({GRID} + 1) r(k)""",
    "patch_overlay": with_(LINEITEM, signal(nx=GRID), rho()) + f"""
        SELECT {PATCH}, (patch_j - 1) * (width // {GRID}) + (width // {GRID}) / CAST(2 AS DOUBLE) AS x,
               (patch_i - 1) * (height // {GRID}) + (height // {GRID}) / CAST(2 AS DOUBLE) AS y, round(rho, 4) AS rho
        FROM rho JOIN dims USING (condition, image_id) WHERE rho IS NOT NULL""",
    "exclude_zero_counts": with_(LINEITEM, signal()) + """
        SELECT condition, image_id, ch_x, ch_y, count(*) AS n, round(sum(x), 2) AS sum_x, round(sum(y), 2) AS sum_y
        FROM sig GROUP BY ALL""",
    "patch_pearson": with_(EMBEDDINGS, signal(nx=2), rho()) + RHO,
    "patch_pearson_all_pairs": with_(LINEITEM, signal(nx=GRID), rho()) + RHO,
    "patch_pearson_rect": with_(LINEITEM, signal(nx=GRID, ny=5), rho()) + RHO,
    "patch_pearson_masked": with_(LINEITEM, OTSU, MASKED, signal("masked", GRID), rho()) + RHO,
    "patch_spearman": with_(EMBEDDINGS, signal(nx=2), RANKED, rho("ranked")) + RHO,
    "patch_spearman_all_pairs": with_(LINEITEM, signal(nx=GRID), RANKED, rho("ranked")) + RHO,
    "patch_spearman_large": with_(LINEITEM, signal(nx=GRID), RANKED, rho("ranked")) + RHO,
    "patch_kendall": with_(EMBEDDINGS, signal(nx=2), KENDALL) + RHO,
    "patch_kendall_all_pairs": with_(LINEITEM, signal(nx=GRID), KENDALL) + RHO,
    "patch_kendall_large": with_(LINEITEM, signal(nx=GRID), KENDALL) + RHO,
    "patch_spearman_mixed": with_(
        LINEITEM.replace("px AS", "line_px AS").replace("dims AS", "line_dims AS"),
        EMBEDDINGS.replace("px AS", "vector_px AS").replace("dims AS", "vector_dims AS").replace("FROM px", "FROM vector_px"),
        "px AS (SELECT * FROM line_px WHERE channel < 3 UNION ALL BY NAME SELECT * FROM vector_px)",
        signal(nx=2), RANKED, rho("ranked")) + RHO,
    "dropped_images": with_(EMBEDDINGS, signal(nx=3), rho()) + """
        SELECT condition, image_id, ch_x, ch_y, 'no_usable_patch' AS reason, 3 AS grid FROM rho GROUP BY ALL HAVING count(rho) = 0
        UNION ALL
        SELECT DISTINCT condition, image_id, 1 AS ch_x, 2 AS ch_y, 'no_patch' AS reason, 9 AS grid FROM dims""",
    "rho_vectors": with_(EMBEDDINGS, signal(nx=2), rho()) + """
        SELECT condition, image_id, ch_x, ch_y, CAST(row_number() OVER (
                 PARTITION BY condition, image_id, ch_x, ch_y ORDER BY patch_i, patch_j) - 1 AS INTEGER) AS position,
               round(rho, 6) AS rho FROM rho WHERE rho IS NOT NULL""",
    "empty_images": with_(EMBEDDINGS, signal(nx=3), rho()) + """
        SELECT condition, image_id, ch_x, ch_y FROM rho GROUP BY ALL HAVING count(rho) = 0""",
    "image_rho_summary": with_(LINEITEM, signal(nx=GRID), rho(), SUMMARY) + """
        SELECT condition, image_id, ch_x, ch_y, n_patches, round(mean_rho, 6) AS mean_rho, round(sd_rho, 6) AS sd_rho,
               round(sd_rho / sqrt(n_patches), 6) AS se_rho FROM summary""",
    "shuffle_pixels": with_(EMBEDDINGS, pixel_shuffle("px", "shuffled")) + f" {PIXELS} shuffled",
    "shuffle_blocks": with_(EMBEDDINGS, block_shuffle(3, "shuffled")) + f" {PIXELS} shuffled",
    "shuffled_control_rho": with_(
        LINEITEM, CELLS, pixel_shuffle("full_px", "shuffled"), as_control("shuffled"),
        signal("mixed", GRID), rho(),
    ) + RHO,
    "shuffle_pixels_sliced": with_(LINEITEM, CELLS, pixel_shuffle("full_px", "shuffled")) + f" {PIXELS} shuffled",
    "block_control_rho": with_(
        EMBEDDINGS, block_shuffle(4, "shuffled"), as_control("shuffled"), signal("mixed", 2), rho()
    ) + RHO,
    "local_map": with_(LINEITEM, signal(nx=20), rho()) + f"""
        SELECT condition, image_id, ch_x, ch_y, 20 AS resolution, patch_i, patch_j, patch_j * (width // 20) AS x,
               (20 - patch_i + 1) * (height // 20) AS y, coalesce(round(rho, 6), CAST(-2 AS DOUBLE)) AS rho
        FROM rho JOIN dims USING (condition, image_id)""",
    "local_map_fallback": with_(EMBEDDINGS, FALLBACK),
    "local_map_fallback_spearman": with_(EMBEDDINGS, FALLBACK_SPEARMAN),
    "prior_draws_summary": with_(PRIOR) + stats("prior_draws", "", [
        f"{p}_{s}" for s in ("control", "sample") for p in ("mu", "nu", "sigma", "tau")]),
    "prior_draws_summary_distributed": with_(PRIOR) + stats("prior_draws", "", [
        f"{p}_{s}" for s in ("control", "sample") for p in ("mu", "nu", "sigma", "tau")]),
    "posterior_mu_marginal": with_(*GRID_MODEL) + MU_W,
    "posterior_shared_scale": with_(
        *GRID_MODEL[:-1], SHARED,
        weights("(log_w + extra)", "(SELECT * FROM priced JOIN linked USING (condition, ch_x, ch_y, sigma_idx))"),
    ) + MU_W,
    "image_t_levels": with_(LINEITEM, signal(nx=GRID), rho(), T_LEVELS) + """
        SELECT condition, image_id, ch_x, ch_y, round(max(top) + ln(sum(w) / 11520), 6) AS log_evidence,
               round(sum(w * mu) / sum(w), 6) AS mean_mu, round(sum(w * s) / sum(w), 6) AS mean_sigma,
               round(sum(w * v) / sum(w), 6) AS mean_nu
        FROM weighed GROUP BY condition, image_id, ch_x, ch_y""",
    "posterior_draws_summary": with_(*GRID_MODEL, PRIOR, DRAWS) + stats(
        "posterior_draws", "ch_x, ch_y", ["mu_control", "sigma_control", "mu_sample", "sigma_sample"]),
    "delta_rho_distribution": with_(*GRID_MODEL, DELTA) + f"SELECT {KINDS}, delta_idx, round(p, 6) AS p FROM spread",
    "delta_rho_tail": with_(*GRID_MODEL, DELTA, thresholds(THRESHOLDS), GRID_TAILS) + f"""
        SELECT {KINDS}, rho_threshold, round(p_above, 6) AS p_above, round(p_below, 6) AS p_below FROM tails""",
    "bayes_factor": with_(*GRID_MODEL, DELTA, thresholds([0.1]), GRID_TAILS, FACTORS) + """
        SELECT ch_x, ch_y, rho_threshold, round(p_posterior, 6) AS p_posterior, round(p_prior, 6) AS p_prior,
               round(bf, 6) AS bf FROM factors""",
    "bayes_factor_curve": with_(*GRID_MODEL, DELTA, thresholds(CURVE), GRID_TAILS, FACTORS) + """
        SELECT ch_x, ch_y, rho_threshold, round(log10(bf), 4) AS log10_bf FROM factors""",
    "bayes_factor_draws": with_(
        *GRID_MODEL, PRIOR, DRAWS, SAMPLES, thresholds(THRESHOLDS), kde_tails(KINDS), FACTORS) + """
        SELECT ch_x, ch_y, rho_threshold, round(p_posterior, 6) AS p_posterior, round(p_prior, 6) AS p_prior,
               round(bf, 6) AS bf FROM factors""",
    "kde_density": with_(*GRID_MODEL, PRIOR, DRAWS, SAMPLES, DENSITY),
    "bayes_factor_curve_draws": with_(
        *GRID_MODEL, PRIOR, DRAWS, SAMPLES, thresholds(FINE_CURVE), kde_tails(KINDS), FACTORS) + """
        SELECT ch_x, ch_y, rho_threshold, round(CASE WHEN bf > 0 THEN log10(bf) ELSE CAST('nan' AS DOUBLE) END, 4) AS log10_bf
        FROM (SELECT *, count(*) FILTER (bf > 0) OVER pair AS n_real, count(*) FILTER (bf <> 'inf'::DOUBLE) OVER pair AS n_finite
              FROM factors WINDOW pair AS (PARTITION BY ch_x, ch_y)) WHERE n_real > 0 AND n_finite > 0""",
    "kde_tail": with_(*GRID_MODEL, PRIOR, DRAWS, SAMPLES, thresholds(CURVE), kde_tails(KINDS)) + f"""
        SELECT {KINDS}, rho_threshold, round(p_above, 6) AS p_above, round(p_below, 6) AS p_below,
               round(p_empirical, 6) AS p_empirical FROM tails""",
    "result_report": with_(
        *GRID_MODEL, PRIOR, DRAWS, SAMPLES, thresholds([0.1]), kde_tails(KINDS), FACTORS) + _report_lines(),
    "analysis_report": with_(
        LINEITEM, CELLS, OTSU, MASKED, block_shuffle(9, "shuffled", "full_px"), MASKED_AND_CONTROL,
        signal("mixed", GRID), rho(), SUMMARY, MODEL, weights(), IDS,
        PRIOR_DRAWS, DRAWS, SAMPLES, thresholds([0.1]), kde_tails(KINDS), FACTORS) + _report_lines(),
    "analysis_given_control": with_(
        LINEITEM, OTSU, MASKED, signal("masked", GRID), rho(), SUMMARY, MODEL, weights(), IDS,
        PRIOR_DRAWS, DRAWS, SAMPLES, thresholds([0.1]), kde_tails(KINDS), FACTORS) + _report_lines(5),
    "analysis_one_pair": with_(
        LINEITEM, OTSU, MASKED, signal("masked", 16, pairs=ONE_PAIR.format(2)), RANKED, rho("ranked"), SUMMARY, MODEL,
        weights(), IDS, PRIOR_DRAWS, DRAWS, SAMPLES, thresholds([0.1]), kde_tails(KINDS), FACTORS) + _report_lines(5),
    "report_round_trip": with_(*GRID_MODEL, DELTA, thresholds([0.1]), GRID_TAILS, FACTORS) + """
        SELECT ch_x, ch_y, rho_threshold, round(p_posterior, 6) AS p_posterior, round(p_prior, 6) AS p_prior
        FROM factors, range(2)""",
    "samples_round_trip": with_(*GRID_MODEL, PRIOR, DRAWS, SAMPLES) + """
        SELECT kind, ch_x, ch_y, count(*) AS n, round(avg(mu_sample), 6) AS mean_sample,
               round(avg(mu_control), 6) AS mean_control FROM samples GROUP BY ALL""",
    "manifest_problems": """
        WITH files AS (SELECT concat('img_', vec_id // 2, '_c', vec_id % 3 + 1, '.tif') AS name FROM embeddings),
        parsed AS (
          SELECT name, regexp_replace(name, '_[^_]*$', '') AS image_id,
                 CAST(regexp_extract(name, '_c([0-9]+)[.]', 1) AS INTEGER) AS channel FROM files),
        wanted AS (SELECT DISTINCT image_id, CAST(c AS INTEGER) AS channel FROM parsed, range(1, 3) AS r(c))
        SELECT image_id, channel, name, 'unknown_channel' AS problem FROM parsed WHERE channel > 2
        UNION ALL
        SELECT image_id, channel, CAST(NULL AS VARCHAR) AS name, 'missing_channel' AS problem
        FROM wanted ANTI JOIN parsed USING (image_id, channel)""",
    "stack_from_manifest": with_(EMBEDDINGS) + """
        SELECT 'img_' || image_id AS image_id, channel, "row", col, round(value, 6) AS value FROM px""",
    "shape_violations": with_(LINEITEM) + """
        SELECT condition, image_id, count(DISTINCT "row") AS n_rows, max(height) AS min_height, max(height) AS max_height,
               CAST(least(100, count(*) - (max(height) - 1) * 100) AS INTEGER) AS min_width, 100 AS max_width
        FROM wide GROUP BY condition, image_id HAVING count(*) < 100 * max(height)""",
}

# The statement separators above put SELECT directly behind a closing parenthesis; a blank keeps them apart.
ORACLES = {name: sql.replace(")SELECT", ") SELECT") for name, sql in ORACLES.items()}
