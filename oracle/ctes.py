"""Shared common table expressions, composed by name into one WITH clause."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def compose(final: str) -> str:
    """Prefix ``final`` with every expression it needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str, stack: tuple[str, ...]) -> None:
        for name in CTES:
            if name in order or name in stack:
                continue
            if re.search(rf"\b{name}\b", sql):
                visit(CTES[name], stack + (name,))
                if name not in order:
                    order.append(name)

    visit(final, ())
    final = final.strip()
    if not order:
        return final
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in order)
    if final.upper().startswith("WITH "):
        return f"WITH {body},\n{final[5:]}"
    return f"WITH {body}\n{final}"


cte(
    "px",
    """
SELECT 'A' || CAST(l_linenumber AS VARCHAR) AS asset, CAST(l_shipdate AS DATE) AS trade_date,
       arg_min(l_extendedprice, row(l_orderkey, l_extendedprice)) AS open,
       max(l_extendedprice) AS high, min(l_extendedprice) AS low,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(l_extendedprice) * 100.0::DOUBLE, 0) AS close,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(l_extendedprice) * 100.0::DOUBLE, 0) AS adj_close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2
""",
)
cte(
    "feed",
    """
SELECT 'A' || CAST(l_linenumber AS VARCHAR) AS asset, CAST(l_shipdate AS DATE) AS trade_date,
       l_extendedprice * (1 - l_discount) AS open, l_extendedprice AS high,
       l_extendedprice * (1 - l_discount) AS low, l_extendedprice AS close, l_extendedprice AS adj_close,
       CAST(l_quantity AS BIGINT) AS volume
FROM lineitem
""",
)
cte(
    "cal",
    """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem
WHERE NOT (month(l_shipdate) = 12 AND day(l_shipdate) = 25 AND year(l_shipdate) % 4 = 0)
""",
)
cte(
    "ast",
    """
SELECT DISTINCT 'A' || CAST(l_linenumber AS VARCHAR) AS asset,
       CASE l_linenumber WHEN 7 THEN 'volatility_index' WHEN 1 THEN 'index' ELSE 'etf' END AS asset_type,
       CASE WHEN l_linenumber IN (2, 3, 4) THEN 'S' || CAST(l_linenumber AS VARCHAR) END AS sector
FROM lineitem
""",
)
cte(
    "dobs",
    """
SELECT 'D_' || o_orderstatus AS series, CAST(o_orderdate AS DATE) AS observation_date,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(o_totalprice) * 100.0::DOUBLE, 0) / 99991 AS value
FROM orders GROUP BY 1, 2
UNION ALL
SELECT 'D_ALL', CAST(o_orderdate AS DATE), CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(o_totalprice) * 100.0::DOUBLE, 0) / 99991 FROM orders GROUP BY 1, 2
""",
)
cte(
    "mbase",
    """
SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date,
       CAST(sum(CAST(round((CASE WHEN day(o_orderdate) <= 15 THEN o_totalprice END) * 100) AS BIGINT)) AS DOUBLE) / nullif(count((CASE WHEN day(o_orderdate) <= 15 THEN o_totalprice END)) * 100.0::DOUBLE, 0) AS v1,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / nullif(count(o_totalprice) * 100.0::DOUBLE, 0) AS v2
FROM orders GROUP BY 1, 2
""",
)
cte(
    "mvint",
    """
SELECT series, observation_date, observation_date + 35 AS valid_from, observation_date + 119 AS valid_to, v1 AS value
FROM mbase WHERE v1 IS NOT NULL
UNION ALL
SELECT series, observation_date, observation_date + 120, DATE '9999-12-31', v2 FROM mbase WHERE v2 IS NOT NULL
""",
)
cte(
    "hol",
    """
WITH y AS (SELECT CAST(y AS INTEGER) AS y FROM range(1995, 2004) t(y)),
fixed AS (
    SELECT make_date(y, m, d) AS h FROM y, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) f(m, d)
    UNION ALL SELECT make_date(y, 6, 19) FROM y WHERE y >= 2021),
days AS (
    SELECT CAST(h AS DATE) AS d, month(h) AS m, day(h) AS dd, isodow(h) AS dow
    FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS h))
SELECT h + CASE isodow(h) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS holiday FROM fixed
UNION
SELECT d FROM days WHERE (m = 1 AND dow = 1 AND dd BETWEEN 15 AND 21) OR (m = 2 AND dow = 1 AND dd BETWEEN 15 AND 21)
   OR (m = 5 AND dow = 1 AND dd >= 25) OR (m = 9 AND dow = 1 AND dd <= 7)
   OR (m = 10 AND dow = 1 AND dd BETWEEN 8 AND 14) OR (m = 11 AND dow = 4 AND dd BETWEEN 22 AND 28)
""",
)
cte(
    "bday",
    """
SELECT CAST(h AS DATE) AS b
FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS h)
WHERE isodow(h) <= 5 AND CAST(h AS DATE) NOT IN (SELECT CAST(holiday AS DATE) FROM hol)
""",
)
cte(
    "dvint",
    """
SELECT series, observation_date,
       (SELECT min(b) FROM bday WHERE b > observation_date) AS valid_from,
       DATE '9999-12-31' AS valid_to, value
FROM dobs
""",
)
cte("days", "SELECT DISTINCT trade_date AS as_of_date FROM px")
# Newest release at or before each date; among releases of one day the latest observation.
cte(
    "dknown",
    """
SELECT r.series, d.as_of_date, r.value
FROM (SELECT s.series, days.as_of_date FROM (SELECT DISTINCT series FROM dvint) s, days) d
ASOF JOIN (SELECT series, valid_from, arg_max(value, observation_date) AS value FROM dvint GROUP BY 1, 2) r
  ON r.series = d.series AND r.valid_from <= d.as_of_date
""",
)
cte(
    "mknown",
    """
SELECT v.series, d.as_of_date, arg_max(v.value, row(v.observation_date, -epoch(v.valid_from))) AS value,
       max(v.observation_date) AS observation_date
FROM days d JOIN mvint v ON v.valid_from <= d.as_of_date AND v.valid_to >= d.as_of_date
GROUP BY 1, 2
""",
)
cte(
    "lr",
    """
SELECT *, ln(close) - lag(ln(close), 1) OVER (PARTITION BY asset ORDER BY trade_date) AS r FROM px
""",
)
cte(
    "pf",
    """
SELECT *,
  ln(close) - lag(ln(close), 5) OVER w AS ret_5d,
  ln(close) - lag(ln(close), 21) OVER w AS ret_21d,
  ln(close) - lag(ln(close), 63) OVER w AS ret_63d,
  CASE WHEN count(r) OVER w5 = 5 THEN sqrt(252 * avg(r * r) OVER w5) END AS rv_5d,
  CASE WHEN count(r) OVER w21 = 21 THEN sqrt(252 * avg(r * r) OVER w21) END AS rv_21d,
  CASE WHEN count(r) OVER w63 = 63 THEN sqrt(252 * avg(r * r) OVER w63) END AS rv_63d,
  CASE WHEN count(r) OVER w21 = 21 THEN sqrt(252 * avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END) OVER w21) END AS semidev_21d,
  CASE WHEN count(close) OVER w252 = 252 THEN close / max(close) OVER w252 - 1 END AS drawdown_252d,
  CASE WHEN count(*) OVER w21 = 21 THEN sqrt(252 / (4 * ln(2)) * avg(ln(high / low) ** 2) OVER w21) END AS parkinson_21d,
  CASE WHEN count(*) OVER w21 = 21 THEN sqrt(252 * greatest(avg(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) OVER w21, 0)) END AS garman_klass_21d
FROM lr
WINDOW w AS (PARTITION BY asset ORDER BY trade_date),
  w5 AS (PARTITION BY asset ORDER BY trade_date ROWS 4 PRECEDING),
  w21 AS (PARTITION BY asset ORDER BY trade_date ROWS 20 PRECEDING),
  w63 AS (PARTITION BY asset ORDER BY trade_date ROWS 62 PRECEDING),
  w252 AS (PARTITION BY asset ORDER BY trade_date ROWS 251 PRECEDING)
""",
)
# Forward volatility, lagged quantile threshold and label.
cte(
    "lab",
    """
WITH f AS (
  SELECT asset, trade_date,
    CASE WHEN count(r) OVER a = 5 THEN sqrt(252.0 / 5 * sum(r * r) OVER a) END AS rv_fwd,
    lead(trade_date, 5) OVER (PARTITION BY asset ORDER BY trade_date) AS known
  FROM lr WINDOW a AS (PARTITION BY asset ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
g AS (SELECT *, lag(rv_fwd, 5) OVER (PARTITION BY asset ORDER BY trade_date) AS seen FROM f),
t AS (
  SELECT *, CASE WHEN count(seen) OVER b = 252 THEN quantile_cont(seen, 0.8) OVER b END AS threshold
  FROM g WINDOW b AS (PARTITION BY asset ORDER BY trade_date ROWS 251 PRECEDING))
SELECT asset, trade_date AS as_of_date, rv_fwd, threshold,
  CASE WHEN rv_fwd IS NOT NULL AND threshold IS NOT NULL THEN CASE WHEN rv_fwd > threshold THEN 1 ELSE 0 END END AS y,
  CASE WHEN rv_fwd IS NOT NULL AND threshold IS NOT NULL THEN known END AS label_known_date
FROM t
""",
)
cte(
    "mem",
    """
SELECT m.asset, s.trade_date, ln(p.adj_close) - lag(ln(p.adj_close)) OVER (PARTITION BY m.asset ORDER BY s.trade_date) AS r
FROM (SELECT trade_date FROM px WHERE asset = 'A1') s
CROSS JOIN (VALUES ('A1'), ('A2'), ('A3')) m(asset)
LEFT JOIN px p ON p.asset = m.asset AND p.trade_date = s.trade_date
""",
)
cte(
    "disp",
    "SELECT trade_date, CASE WHEN count(r) = 3 THEN stddev_samp(r) END AS sector_dispersion_1d FROM mem GROUP BY 1",
)
cte(
    "paircorr",
    """
WITH p AS (
  SELECT a.trade_date, a.asset AS i, b.asset AS j, a.r AS x, b.r AS y
  FROM mem a JOIN mem b ON a.trade_date = b.trade_date AND a.asset < b.asset),
c AS (
  SELECT trade_date, i, j, CASE WHEN count(x) OVER w = 21 AND count(y) OVER w = 21 THEN corr(x, y) OVER w END AS rho
  FROM p WINDOW w AS (PARTITION BY i, j ORDER BY trade_date ROWS 20 PRECEDING))
SELECT trade_date, avg(rho) AS sector_avgcorr_21d FROM c GROUP BY 1 HAVING count(rho) = 3
""",
)
cte(
    "mkt",
    """
SELECT d.as_of_date AS trade_date, v.close / 997 AS vix, CAST(q.volume AS DOUBLE) AS mkt_volume,
       ln(h.adj_close / l.adj_close) AS credit
FROM days d
LEFT JOIN px v ON v.asset = 'A7' AND v.trade_date = d.as_of_date
LEFT JOIN px q ON q.asset = 'A5' AND q.trade_date = d.as_of_date
LEFT JOIN px h ON h.asset = 'A5' AND h.trade_date = d.as_of_date
LEFT JOIN px l ON l.asset = 'A6' AND l.trade_date = d.as_of_date
""",
)
cte(
    "mlag",
    """
SELECT k.series, k.as_of_date, k.value AS latest, k.observation_date, b.lag_months,
  (SELECT arg_min(o.value, o.valid_from) FROM mvint o
    WHERE o.series = k.series AND o.valid_from <= k.as_of_date AND o.valid_to >= k.as_of_date
      AND o.observation_date = CAST(k.observation_date - to_months(CAST(b.lag_months AS INTEGER)) AS DATE)) AS lagged
FROM mknown k, (VALUES (1), (12)) b(lag_months)
""",
)
cte(
    "feats",
    """
WITH shared AS (
  SELECT m.*, f.value AS dff, t.value AS d10, u.value AS d2, s.value AS spread,
    j.latest - j.lagged AS unrate_chg_1m, c.latest / c.lagged - 1 AS cpi_yoy,
    disp.sector_dispersion_1d, paircorr.sector_avgcorr_21d
  FROM mkt m
  LEFT JOIN dknown f ON f.series = 'D_F' AND f.as_of_date = m.trade_date
  LEFT JOIN dknown t ON t.series = 'D_O' AND t.as_of_date = m.trade_date
  LEFT JOIN dknown u ON u.series = 'D_P' AND u.as_of_date = m.trade_date
  LEFT JOIN dknown s ON s.series = 'D_ALL' AND s.as_of_date = m.trade_date
  LEFT JOIN mlag j ON j.series = '1-URGENT' AND j.lag_months = 1 AND j.as_of_date = m.trade_date
  LEFT JOIN mlag c ON c.series = '2-HIGH' AND c.lag_months = 12 AND c.as_of_date = m.trade_date
  LEFT JOIN disp ON disp.trade_date = m.trade_date
  LEFT JOIN paircorr ON paircorr.trade_date = m.trade_date)
SELECT pf.asset, pf.trade_date AS as_of_date, r AS ret_1d, ret_5d, ret_21d, ret_63d, rv_5d, rv_21d, rv_63d,
  semidev_21d, drawdown_252d, parkinson_21d, garman_klass_21d,
  vix AS vix_level, vix - lag(vix, 1) OVER w AS vix_chg_1d, vix - lag(vix, 5) OVER w AS vix_chg_5d,
  vix / 100 - rv_21d AS vrp_proxy,
  CASE WHEN count(mkt_volume) OVER w21 = 21 AND mkt_volume > 0 THEN ln(mkt_volume / avg(mkt_volume) OVER w21) END AS spy_volume_ratio_21d,
  dff - lag(dff, 21) OVER w AS dff_chg_21d, d10 - lag(d10, 5) OVER w AS dgs10_chg_5d,
  d10 - lag(d10, 21) OVER w AS dgs10_chg_21d, d2 - lag(d2, 5) OVER w AS dgs2_chg_5d,
  spread AS t10y2y_level, unrate_chg_1m, cpi_yoy, sector_dispersion_1d, sector_avgcorr_21d,
  credit - lag(credit, 5) OVER w AS hyg_lqd_chg_5d
FROM pf LEFT JOIN shared ON shared.trade_date = pf.trade_date
WINDOW w AS (PARTITION BY pf.asset ORDER BY pf.trade_date),
  w21 AS (PARTITION BY pf.asset ORDER BY pf.trade_date ROWS 20 PRECEDING)
""",
)
