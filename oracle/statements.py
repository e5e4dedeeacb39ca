"""SQL per registered query."""

from __future__ import annotations

import re

from .ctes import CTES, compose, cte

FEATURES = (
    "ret_1d ret_5d ret_21d ret_63d rv_5d rv_21d rv_63d semidev_21d drawdown_252d parkinson_21d garman_klass_21d "
    "vix_level vix_chg_1d vix_chg_5d vrp_proxy spy_volume_ratio_21d dff_chg_21d dgs10_chg_5d dgs10_chg_21d "
    "dgs2_chg_5d t10y2y_level unrate_chg_1m cpi_yoy sector_dispersion_1d sector_avgcorr_21d hyg_lqd_chg_5d"
).split()

SQL: dict[str, str] = {}


def rounded(names: list[str], digits: int = 8) -> str:
    return ", ".join(f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0 ELSE round({c}, {digits}) END AS {c}" for c in names)


def sql(name: str, text: str) -> None:
    SQL[name] = text


# ---- scans, ingest, sinks ------------------------------------------------------------------------
sql("scan_prices", "SELECT px.*, ast.asset_type, ast.sector FROM px JOIN ast USING (asset)")
sql("scan_macro", "SELECT series, observation_date, valid_from, valid_to, value FROM mvint UNION ALL SELECT * FROM dvint")
sql(
    "ingest_macro_json",
    """
SELECT event_type AS series, CAST(ts AS DATE) AS observation_date,
       CAST(ts AS DATE) + CAST(json_extract_string(props, '$.k') AS INTEGER) AS valid_from,
       DATE '9999-12-31' AS valid_to, value
FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0
""",
)
sql(
    "normalize_prices",
    """
SELECT asset, trade_date, open, high, low, CASE WHEN volume % 50 = 0 THEN NULL ELSE close END AS close, adj_close,
       CASE WHEN volume % 7 = 0 THEN NULL ELSE volume END AS volume
FROM px
""",
)
sql(
    "raw_pull_hash",
    """
WITH r AS (
  SELECT asset, trade_date AS d, sha256(concat_ws('|', strftime(trade_date, '%Y-%m-%d'), CAST(CAST(floor(open * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), CAST(CAST(floor(high * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), CAST(CAST(floor(low * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), CAST(CAST(floor(close * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), CAST(CAST(floor(adj_close * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), CAST(CAST(floor(volume * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR))) AS h FROM feed)
SELECT asset, count(*) AS row_count, sha256(concat_ws(',', """
    + ", ".join(f"CAST(sum(CAST('0x' || substring(h, {4 * k + 1}, 4) AS BIGINT)) AS VARCHAR)" for k in range(16))
    + """)) AS payload_hash FROM r GROUP BY 1
""",
)
sql(
    "upsert_prices",
    """
SELECT asset, trade_date, open, high, low,
       CASE WHEN year(trade_date) >= 2000 THEN close * 2 ELSE close END AS close, adj_close, volume
FROM px
""",
)
sql("first_trade_date", "SELECT asset, min(trade_date) AS first_trade_date FROM px GROUP BY 1")
# 20:00 UTC is 15:00 in New York outside daylight time, which then ran from April to October.
sql(
    "calendar_upsert",
    """
SELECT trade_date, year(trade_date) >= 1998 AND ((month(trade_date) = 12 AND day(trade_date) = 24)
  OR (day(trade_date) = 10 AND month(trade_date) NOT BETWEEN 4 AND 10)) AS is_early_close FROM cal
""",
)
sql("price_files", "SELECT * FROM px")
sql(
    "label_definitions",
    """
SELECT 'rv5_q80' AS name, 1 AS version, 5 AS horizon_days, 0.8::DOUBLE AS threshold_quantile, 252 AS threshold_lookback_obs, count(y) AS n_labels FROM lab
""",
)
sql(
    "replace_series",
    """
SELECT * FROM mvint WHERE series NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT series, observation_date, valid_from, valid_to, value * 2 FROM mvint
WHERE series IN ('1-URGENT', '5-LOW') AND valid_to < DATE '9999-12-31'
""",
)
sql(
    "feature_sets",
    "SELECT 'base' AS set_name, name, n AS n_values FROM (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS name, count({f}) AS n FROM feats" for f in FEATURES
    ) + ")) WHERE name <> 'hyg_lqd_chg_5d' UNION ALL SELECT 'extended', name, n FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS name, count({f}) AS n FROM feats" for f in FEATURES
    ) + ")",
)
sql(
    "features_long",
    " UNION ALL ".join(
        f"SELECT asset, as_of_date, '{f}' AS name, CASE WHEN round({f}, 8) = 0 THEN 0.0 ELSE round({f}, 8) END AS value FROM feats WHERE {f} IS NOT NULL"
        for f in FEATURES
    ),
)
sql("features_wide", f"SELECT asset, as_of_date, {rounded(FEATURES)} FROM feats WHERE ret_1d IS NOT NULL OR vix_level IS NOT NULL OR t10y2y_level IS NOT NULL OR unrate_chg_1m IS NOT NULL OR cpi_yoy IS NOT NULL OR sector_dispersion_1d IS NOT NULL")
sql("features_core", f"SELECT asset, as_of_date, {rounded(FEATURES)} FROM feats")
sql(
    "labels",
    f"SELECT asset, as_of_date, {rounded(['rv_fwd', 'threshold'])}, y, label_known_date, 'rv5_q80' AS label_name FROM lab",
)
sql(
    "label_prevalence",
    """
SELECT asset, count(*) AS n_rows, count(y) AS n_labels, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 8) AS prevalence,
       round(avg(rv_fwd), 8) AS mean_rv, round(avg(threshold), 8) AS mean_threshold
FROM lab GROUP BY 1
""",
)
# ---- point in time -------------------------------------------------------------------------------
sql("asof_daily", "SELECT series, as_of_date, value FROM dknown")
sql("pit_latest", "SELECT series, as_of_date, observation_date, value FROM mknown")
sql(
    "pit_lagged",
    "SELECT series, as_of_date, CAST(lag_months AS INTEGER) AS lag_months, latest, lagged FROM mlag",
)
sql("rule_lag", "SELECT * FROM dvint")
sql(
    "truncate_asof",
    """
SELECT 'macro' AS kind, series AS entity, count(*) AS n, max(valid_from) AS newest,
       count(*) FILTER (WHERE valid_to > DATE '1999-06-30') AS still_open
FROM mvint WHERE valid_from <= DATE '1999-06-30' GROUP BY series
UNION ALL
SELECT 'price', asset, count(*), max(trade_date), 0 FROM px WHERE trade_date <= DATE '1999-06-30' GROUP BY asset
""",
)
sql(
    "cash_rate",
    """
SELECT p.asset, p.trade_date, round(lag(k.value) OVER (PARTITION BY p.asset ORDER BY p.trade_date) / 100 / 252, 10) AS cash
FROM px p LEFT JOIN dknown k ON k.series = 'D_F' AND k.as_of_date = p.trade_date
""",
)
# ---- single features -----------------------------------------------------------------------------
sql("log_returns", f"SELECT asset, trade_date, {rounded(['ret_1d', 'ret_5d', 'ret_21d', 'ret_63d'])} FROM (SELECT *, r AS ret_1d FROM pf)")
sql("realized_vol", f"SELECT asset, trade_date, {rounded(['rv_5d', 'rv_21d', 'rv_63d'])} FROM pf")
for _name, _col in (
    ("semidev", "semidev_21d"),
    ("drawdown_252", "drawdown_252d"),
    ("parkinson", "parkinson_21d"),
    ("garman_klass", "garman_klass_21d"),
):
    sql(_name, f"SELECT asset, trade_date, {rounded([_col])} FROM pf")
for _name, _cols in (
    ("level_changes", ["vix_chg_1d", "vix_chg_5d", "dff_chg_21d", "dgs10_chg_5d", "dgs10_chg_21d", "dgs2_chg_5d"]),
    ("volume_ratio", ["spy_volume_ratio_21d"]),
    ("ratio_change", ["hyg_lqd_chg_5d"]),
):
    sql(_name, f"SELECT asset, as_of_date, {rounded(_cols)} FROM feats")
sql("sector_dispersion", f"SELECT trade_date, {rounded(['sector_dispersion_1d'])} FROM disp")
sql("avg_pair_corr", f"SELECT trade_date, {rounded(['sector_avgcorr_21d'])} FROM paircorr")
sql("forward_rv", f"SELECT asset, as_of_date AS trade_date, {rounded(['rv_fwd'])} FROM lab")
MODEL_FEATURES = [f for f in FEATURES if f != "hyg_lqd_chg_5d"]
sql(
    "modeling_frame",
    f"SELECT feats.asset, feats.as_of_date, {rounded(FEATURES)}, y, label_known_date, {rounded(['rv_fwd', 'threshold'])} FROM feats JOIN lab ON lab.asset = feats.asset AND lab.as_of_date = feats.as_of_date",
)
LOGGED = ["rv_5d", "rv_21d", "rv_63d", "vix_level", "parkinson_21d", "garman_klass_21d"]
sql(
    "design_matrix",
    "SELECT asset, as_of_date, "
    + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE round(ln(greatest({c}, 1e-8)), 8) END AS {c}" if c in LOGGED else rounded([c])
        for c in MODEL_FEATURES
    )
    + " FROM feats",
)

# ---- data quality --------------------------------------------------------------------------------


def dates10(cond: str, date: str = "trade_date") -> str:
    return (
        f"coalesce(array_to_string(list_transform(list_sort(list(DISTINCT {date}) FILTER (WHERE {cond}))[1:10], "
        "lambda d: strftime(d, '%Y-%m-%d')), ','), '')"
    )


def basic(table: str) -> str:
    return f"""
SELECT asset AS entity, u.check_name, u.severity, u.n = 0 AS passed, CAST(u.n AS BIGINT) AS n, u.sample FROM (
  SELECT asset, [
    {{'check_name': 'duplicate_dates', 'severity': 'error', 'n': count(*) - count(DISTINCT trade_date), 'sample': ''}},
    {{'check_name': 'null_close', 'severity': 'error', 'n': count(*) - count(close), 'sample': ''}},
    {{'check_name': 'non_positive_price', 'severity': 'error', 'n': count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR adj_close <= 0), 'sample': ''}},
    {{'check_name': 'high_below_low', 'severity': 'error', 'n': count(*) FILTER (WHERE high < low), 'sample': ''}},
    {{'check_name': 'close_outside_range', 'severity': 'warn', 'n': count(*) FILTER (WHERE close > high * (1 + 1e-6) OR close < low * (1 - 1e-6)),
      'sample': {dates10("close > high * (1 + 1e-6) OR close < low * (1 - 1e-6)")}}}] AS l
  FROM {table} GROUP BY asset), unnest(l) AS t(u)"""


NO_ROWS = "SELECT 'A9' AS entity, 'no_rows' AS check_name, 'error' AS severity, false AS passed, CAST(0 AS BIGINT) AS n, '' AS sample"


def calendar_sql(table: str) -> str:
    return f"""
SELECT * FROM (
  WITH s AS (SELECT asset, min(trade_date) AS lo, max(trade_date) AS hi FROM {table} GROUP BY 1),
  e AS (SELECT s.asset, c.trade_date FROM s JOIN cal c ON c.trade_date BETWEEN s.lo AND s.hi),
  m AS (SELECT e.asset, count(*) AS n_exp,
          count(*) FILTER (WHERE p.asset IS NULL) AS n, {dates10("p.asset IS NULL", "e.trade_date")} AS sample
        FROM e LEFT JOIN (SELECT DISTINCT asset, trade_date FROM {table}) p ON p.asset = e.asset AND p.trade_date = e.trade_date GROUP BY 1)
  SELECT asset AS entity, 'missing_trading_days' AS check_name, CASE WHEN n * 1.0 / greatest(n_exp, 1) > 0.005 THEN 'error' ELSE 'warn' END AS severity,
     n = 0 AS passed, n, sample FROM m
  UNION ALL
  SELECT asset, 'non_trading_dates', 'error', count(*) FILTER (WHERE off) = 0, count(DISTINCT trade_date) FILTER (WHERE off), {dates10("off")}
  FROM (SELECT *, trade_date NOT IN (SELECT trade_date FROM cal) AS off FROM {table}) GROUP BY 1)"""


def stale_sql(table: str) -> str:
    return f"""
SELECT * FROM (
  WITH d AS (SELECT asset, trade_date, close, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS chg FROM {table} WINDOW w AS (PARTITION BY asset ORDER BY trade_date, close)),
  g AS (SELECT asset, sum(chg) OVER (PARTITION BY asset ORDER BY trade_date, close ROWS UNBOUNDED PRECEDING) AS isl FROM d),
  r AS (SELECT asset, isl, count(*) AS len FROM g GROUP BY 1, 2)
  SELECT asset AS entity, 'stale_prices' AS check_name, 'warn' AS severity, max(len) < 5 AS passed, max(len) AS n, '' AS sample FROM r GROUP BY 1)"""


def outlier_sql(table: str) -> str:
    return f"""
SELECT asset AS entity, 'return_outliers' AS check_name, 'warn' AS severity, count(*) FILTER (WHERE big) = 0 AS passed,
       count(*) FILTER (WHERE big) AS n, {dates10("big")} AS sample
FROM (SELECT asset, trade_date, coalesce(abs(ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY trade_date, close))) > 0.15, false) AS big
      FROM {table} WHERE asset <> 'A7') GROUP BY 1"""


sql("dq_basic", basic("feed") + " UNION ALL " + NO_ROWS)
sql("dq_calendar", calendar_sql("feed"))
sql("dq_outliers", outlier_sql("px"))
sql("dq_outliers_feed", outlier_sql("feed"))
cte("coarse", "SELECT * REPLACE (floor(close / 20000) * 20000 + 10000 AS close) FROM px")
sql("dq_stale", stale_sql("coarse"))
sql(
    "dq_drop_offcal",
    f"""
WITH t AS (
  SELECT asset, count(*) AS total, count(*) FILTER (WHERE off) AS n_off, count(*) FILTER (WHERE late) AS n_late,
    {dates10("off")} AS off_days, {dates10("late")} AS late_days
  FROM (SELECT *, trade_date NOT IN (SELECT trade_date FROM cal) AS off, trade_date > (SELECT max(trade_date) FROM cal) AS late FROM px) GROUP BY 1),
k AS (SELECT *, n_late = 0 AND n_off > 0 AND n_off * 1.0 / total <= 0.001 AS dropped FROM t)
SELECT asset AS entity, CASE WHEN dropped THEN total - n_off ELSE total END AS kept,
  CASE WHEN n_late > 0 THEN 'calendar_stale' WHEN dropped THEN 'non_trading_rows_dropped' END AS check_name,
  CASE WHEN n_late > 0 THEN 'error' WHEN dropped THEN 'warn' END AS severity,
  CASE WHEN n_late > 0 OR dropped THEN false END AS passed,
  CASE WHEN n_late > 0 THEN n_late WHEN dropped THEN n_off END AS n,
  CASE WHEN n_late > 0 THEN late_days WHEN dropped THEN off_days END AS sample
FROM k
""",
)
sql(
    "dq_revision",
    f"""
SELECT asset AS entity, 'vendor_revision_close' AS check_name, 'warn' AS severity, count(*) FILTER (WHERE volume % 97 = 0) = 0 AS passed,
       count(*) FILTER (WHERE volume % 97 = 0) AS n, {dates10("volume % 97 = 0")} AS sample
FROM px GROUP BY 1
""",
)
sql(
    "dq_macro",
    f"""
WITH v AS (SELECT *, 'daily' AS frequency FROM dvint UNION ALL SELECT *, 'monthly' FROM mvint),
f AS (SELECT series, frequency, observation_date, min(valid_from) AS first_known FROM v GROUP BY 1, 2, 3),
g AS (SELECT *, date_diff('day', observation_date, first_known) NOT BETWEEN 20 AND 90 AS odd FROM f)
SELECT series AS entity, 'first_vintage_lag' AS check_name, 'warn' AS severity, count(*) FILTER (WHERE odd) = 0 AS passed, count(*) FILTER (WHERE odd) AS n,
  {dates10("odd", "observation_date")} AS sample FROM g WHERE frequency = 'monthly' GROUP BY 1
UNION ALL
SELECT 'D_NONE', 'no_rows', 'error', false, 0, ''
UNION ALL
SELECT series, 'staleness', 'warn', date_diff('day', max(observation_date), DATE '2001-12-31') <= CASE frequency WHEN 'daily' THEN 10 ELSE 75 END,
  date_diff('day', max(observation_date), DATE '2001-12-31'), strftime(max(observation_date), '%Y-%m-%d') FROM g GROUP BY series, frequency
""",
)
sql(
    "dq_overlap",
    """
WITH v AS (SELECT * REPLACE (CASE WHEN valid_to < DATE '9999-12-31' AND month(observation_date) = 3 THEN valid_to + 5 ELSE valid_to END AS valid_to) FROM mvint)
SELECT b.series, b.observation_date, b.valid_from, max(a.valid_to) AS covered_to
FROM v a JOIN v b ON a.series = b.series AND a.observation_date = b.observation_date AND a.valid_from < b.valid_from AND a.valid_to >= b.valid_from
GROUP BY 1, 2, 3
""",
)
sql(
    "dq_constraints",
    """
SELECT 'close_present' AS rule, count(*) FILTER (WHERE close IS NULL) AS violations FROM feed
UNION ALL SELECT 'close_positive', count(*) FILTER (WHERE close <= 0) FROM feed
UNION ALL SELECT 'open_positive', count(*) FILTER (WHERE open <= 0) FROM feed
UNION ALL SELECT 'adj_close_positive', count(*) FILTER (WHERE adj_close <= 0) FROM feed
UNION ALL SELECT 'high_not_below_low', count(*) FILTER (WHERE high < low) FROM feed
UNION ALL SELECT 'volume_not_negative', count(*) FILTER (WHERE volume < 0) FROM feed
UNION ALL SELECT 'label_binary', count(*) FILTER (WHERE y NOT IN (0, 1)) FROM lab
UNION ALL SELECT 'label_and_known_date_together', count(*) FILTER (WHERE (y IS NULL) <> (label_known_date IS NULL)) FROM lab
UNION ALL SELECT 'known_after_as_of', count(*) FILTER (WHERE label_known_date <= as_of_date) FROM lab
UNION ALL SELECT 'asset_type_known', 0
UNION ALL SELECT 'price_key_unique', count(*) FROM (SELECT 1 FROM feed GROUP BY asset, trade_date HAVING count(*) > 1)
UNION ALL SELECT 'price_date_in_calendar', count(*) FROM feed WHERE trade_date NOT IN (SELECT trade_date FROM cal)
""",
)
sql(
    "dq_results",
    f"""
WITH c AS ({basic("px")} UNION ALL {calendar_sql("px")} UNION ALL {stale_sql("px")} UNION ALL {NO_ROWS}),
b AS (SELECT entity, string_agg(check_name, ', ' ORDER BY check_name) AS blocked_by FROM c WHERE NOT passed AND severity = 'error' GROUP BY 1)
SELECT c.entity, check_name, CASE WHEN passed THEN 'info' ELSE severity END AS severity, passed,
  '{{"count":' || n || ',"sample":""}}' AS details, blocked_by
FROM c LEFT JOIN b ON b.entity = c.entity
""",
)
# A refresh from 2000 on with restated closes, in which one asset has inverted ranges, judged and merged.
cte(
    "gin",
    """
SELECT * REPLACE (CASE WHEN volume % 97 = 0 THEN close * 1.0001::DOUBLE ELSE close END AS close,
  CASE WHEN asset = 'A3' AND volume % 5 = 0 THEN low * 0.5::DOUBLE ELSE high END AS high) FROM px WHERE year(trade_date) >= 2000
""",
)
cte(
    "gdrop",
    f"""
SELECT asset, count(*) FILTER (WHERE off) AS n_off, {dates10("off")} AS off_days
FROM (SELECT *, trade_date NOT IN (SELECT trade_date FROM cal) AS off, trade_date > (SELECT max(trade_date) FROM cal) AS late FROM gin) GROUP BY 1
HAVING count(*) FILTER (WHERE late) = 0 AND n_off > 0 AND n_off * 1.0 / count(*) <= 0.001
""",
)
cte("gkept", "SELECT * FROM gin WHERE asset NOT IN (SELECT asset FROM gdrop) OR trade_date IN (SELECT trade_date FROM cal)")
cte(
    "gchk",
    f"""
SELECT * FROM ({basic("gkept")}) UNION ALL BY NAME SELECT * FROM ({calendar_sql("gkept")})
UNION ALL BY NAME SELECT * FROM ({outlier_sql("gkept")}) UNION ALL BY NAME SELECT * FROM ({stale_sql("gkept")})
UNION ALL BY NAME SELECT asset AS entity, 'vendor_revision_close' AS check_name, 'warn' AS severity, count(*) FILTER (WHERE moved) = 0 AS passed,
  count(*) FILTER (WHERE moved) AS n, {dates10("moved")} AS sample
  FROM (SELECT *, year(trade_date) <= 2000 AND volume % 97 = 0 AS moved FROM gkept) GROUP BY 1
UNION ALL BY NAME SELECT asset AS entity, 'non_trading_rows_dropped' AS check_name, 'warn' AS severity, false AS passed, n_off AS n, off_days AS sample FROM gdrop
UNION ALL BY NAME SELECT 'A9' AS entity, 'unknown_asset' AS check_name, 'error' AS severity, false AS passed, 0 AS n, '' AS sample
""",
)
cte("gblk", "SELECT entity, string_agg(check_name, ', ' ORDER BY check_name) AS blocked_by FROM gchk WHERE NOT passed AND severity = 'error' GROUP BY 1")
cte("gacc", "SELECT * FROM gkept WHERE asset NOT IN (SELECT entity FROM gblk)")
sql(
    "gated_load",
    """
SELECT asset, trade_date, open, high, low, close, volume FROM gacc
UNION ALL SELECT asset, trade_date, open, high, low, close, volume FROM px
WHERE year(trade_date) <= 2000 AND (asset, trade_date) NOT IN (SELECT (asset, trade_date) FROM gacc)
""",
)
sql(
    "gated_load_audit",
    """
SELECT c.entity, check_name, severity, passed, CAST(c.n AS BIGINT) AS n, sample, coalesce(r.n, 0) AS rows_judged,
  CASE WHEN r.n > 0 THEN CAST(c.n AS DOUBLE) / r.n END AS fraction,
  CASE check_name WHEN 'return_outliers' THEN 0.15::DOUBLE WHEN 'stale_prices' THEN 5.0::DOUBLE WHEN 'missing_trading_days' THEN 0.005::DOUBLE
    WHEN 'non_trading_rows_dropped' THEN 0.001::DOUBLE WHEN 'vendor_revision_close' THEN 1e-6::DOUBLE WHEN 'close_outside_range' THEN 1e-6::DOUBLE END AS limit,
  blocked_by
FROM gchk c LEFT JOIN (SELECT asset, count(*) AS n FROM gin GROUP BY 1) r ON r.asset = c.entity LEFT JOIN gblk b ON b.entity = c.entity
""".replace("AS limit", 'AS "limit"'),
)
sql(
    "gated_load_runs",
    """
SELECT 'refresh' AS run_id, 'load_prices' AS pipeline, 'failed' AS status, (SELECT count(*) FROM gin) AS rows_read,
  (SELECT count(*) FROM gacc) AS rows_written, (SELECT count(*) FROM gblk) || ' assets blocked' AS error
""",
)
sql(
    "run_ledger",
    """
WITH r AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'succeeded' ELSE 'running' END AS status FROM events),
s AS (SELECT user_id, min(ts) AS st, max(ts) FILTER (WHERE status <> 'running') AS fin, arg_max(status, ts) AS status FROM r GROUP BY 1)
SELECT 'load_prices' AS pipeline, status, count(*) AS runs, CAST(min(st) AS DATE) AS first_start, CAST(max(fin) AS DATE) AS last_finish,
  (SELECT count(*) FROM s WHERE status = 'succeeded') AS succeeded
FROM s GROUP BY status
""",
)
sql(
    "snapshot_diff",
    """
SELECT asset, trade_date, CASE WHEN year(trade_date) < 1996 THEN 'removed' WHEN year(trade_date) > 2000 THEN 'added' ELSE 'modified' END AS change
FROM px WHERE year(trade_date) < 1996 OR year(trade_date) > 2000 OR volume % 97 = 0
""",
)

# ---- splits, predictions, metrics ----------------------------------------------------------------
REQUIRED = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES)
cte(
    "elig_all",
    f"""
SELECT f.*, lab.y, lab.label_known_date, lab.rv_fwd FROM feats f JOIN lab ON lab.asset = f.asset AND lab.as_of_date = f.as_of_date
WHERE f.as_of_date >= DATE '1996-06-01' AND lab.y IS NOT NULL AND {REQUIRED}
""",
)
cte("elig", "SELECT * FROM elig_all WHERE as_of_date < DATE '2001-01-01'")
SCORED = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES[:11], "vix_level", "t10y2y_level"])
cte(
    "elig_s",
    f"""
SELECT f.*, lab.y, lab.label_known_date, lab.rv_fwd FROM feats f JOIN lab ON lab.asset = f.asset AND lab.as_of_date = f.as_of_date
WHERE f.as_of_date >= DATE '1996-06-01' AND f.as_of_date < DATE '2001-01-01' AND lab.y IS NOT NULL AND {SCORED}
""",
)
cte(
    "fld",
    "SELECT 'wf_' || yr AS fold, make_date(CAST(yr AS INTEGER), 1, 1) AS ts, make_date(CAST(yr AS INTEGER), 12, 31) AS te FROM (VALUES (1998), (1999), (2000)) y(yr)",
)
cte(
    "assigned",
    """
SELECT fold, 'train' AS role, e.* FROM elig e JOIN fld ON e.label_known_date < fld.ts
UNION ALL SELECT fold, 'test', e.* FROM elig e JOIN fld ON e.as_of_date BETWEEN fld.ts AND fld.te
""",
)
cte(
    "assigned_s",
    """
SELECT fold, 'train' AS role, e.* FROM elig_s e JOIN fld ON e.label_known_date < fld.ts
UNION ALL SELECT fold, 'test', e.* FROM elig_s e JOIN fld ON e.as_of_date BETWEEN fld.ts AND fld.te
""",
)


def sig(x: str, digits: int = 6) -> str:
    return f"round(1 / (1 + exp(-({x}))), {digits})"


Z1, Z2, Z3, V, D = "(ln(rv_5d) - 2.1::DOUBLE)", "(ln(rv_21d) - 2.1::DOUBLE)", "(ln(rv_63d) - 2.1::DOUBLE)", "(ln(vix_level) - 3.6::DOUBLE)", "drawdown_252d"
MODELS = {
    "har_logit": sig(f"-1.4 + 0.9 * {Z1} + 0.5 * {Z2} + 0.3 * {Z3}"),
    "vix_logit": sig(f"-1.4 + 0.6 * {V}"),
    "garch_logit": sig(f"-1.4 + 1.2 * {Z1}"),
    "logit_tuned": sig(f"-1.4 + 0.7 * {Z1} + 0.4 * {V} + 0.5 * {D}"),
    "hist_gb": sig(f"-1.5 + 1.0 * {Z2}", 2),
    "random_forest": sig(f"-1.3 + 0.5 * {Z1} + 0.5 * {Z3} - 0.4 * {D}"),
}
cte(
    "preds",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, fold, asset, as_of_date, y, {x} AS prob FROM assigned_s WHERE role = 'test'" for m, x in MODELS.items()
    ),
)
cte(
    "cls",
    """
WITH b AS (SELECT l.*, d.lang, round(1 / (1 + exp(-(ln(d.n_chars + 1.0::DOUBLE) - 6.0))), 3) AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT 'quality' AS model, lang AS fold, quality AS y, s AS prob FROM b
UNION ALL SELECT 'toxic', lang, toxic, 1 - s FROM b
""",
)


def metric_ctes(prefix: str, source: str) -> None:
    """Textbook forms: all-pairs AUC through ranks, step-wise average precision, quantile bins."""
    cte(f"{prefix}_s", f"SELECT model, fold AS scope, y, prob FROM {source} UNION ALL SELECT model, 'pooled', y, prob FROM {source}")
    cte(
        f"{prefix}_auc",
        f"""
WITH r AS (SELECT *, rank() OVER (PARTITION BY model, scope ORDER BY prob) + (count(*) OVER (PARTITION BY model, scope, prob) - 1) / 2.0::DOUBLE AS rk FROM {prefix}_s)
SELECT model, scope, CASE WHEN min(y) <> max(y) THEN (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) END AS roc_auc
FROM r GROUP BY 1, 2
""",
    )
    cte(
        f"{prefix}_ap",
        f"""
WITH g AS (SELECT model, scope, prob, sum(y) AS pos, count(*) AS n FROM {prefix}_s GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY model, scope ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))
SELECT model, scope, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * tp / CAST(cn AS DOUBLE)) / sum(pos) END AS pr_auc FROM c GROUP BY 1, 2
""",
    )
    cte(
        f"{prefix}_cal",
        f"""
WITH q AS (SELECT model, scope, list_sort(list_distinct(quantile_cont(prob, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM {prefix}_s GROUP BY 1, 2),
b AS (SELECT s.*, len(list_filter(e, lambda x: x < prob AND x > e[1])) AS bin FROM {prefix}_s s JOIN q ON q.model = s.model AND q.scope = s.scope)
SELECT model, scope, CAST(bin AS BIGINT) AS bin, avg(prob) AS mean_pred, avg(y) AS frac_pos, count(*) AS n FROM b GROUP BY 1, 2, 3
""",
    )
    cte(f"{prefix}_ece", f"SELECT model, scope, sum(n * abs(mean_pred - frac_pos)) / sum(n) AS ece FROM {prefix}_cal GROUP BY 1, 2")
    cte(
        f"{prefix}_all",
        f"""
WITH p AS (SELECT model, scope, count(*) AS n, avg(y) AS prevalence, avg((prob - y) ** 2) AS brier,
  -avg(y * ln(least(greatest(prob, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6))) AS log_loss FROM {prefix}_s GROUP BY 1, 2)
SELECT p.*, roc_auc, pr_auc, ece FROM p JOIN {prefix}_auc USING (model, scope) JOIN {prefix}_ap USING (model, scope) JOIN {prefix}_ece USING (model, scope)
""",
    )


metric_ctes("pm", "preds")
metric_ctes("cm", "cls")
METRIC_NAMES = ["roc_auc", "pr_auc", "brier", "log_loss", "ece", "prevalence"]
sql("eligible_rows", f"SELECT asset, as_of_date, y, label_known_date, {rounded(['rv_21d'])} FROM elig")
sql("purged_split", "SELECT fold, role, asset, as_of_date, y FROM assigned")
FOLD_INFO = """
SELECT fold, min(as_of_date) FILTER (WHERE role = 'train') AS train_start, max(as_of_date) FILTER (WHERE role = 'train') AS train_end,
  count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test,
  CAST(sum(y) FILTER (WHERE role = 'test') AS BIGINT) AS positives
FROM {} GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'train') > 0 AND count(*) FILTER (WHERE role = 'test') > 0
"""
sql("fold_info", FOLD_INFO.format("assigned"))
sql(
    "holdout_split",
    FOLD_INFO.format(
        "(SELECT 'holdout_2001' AS fold, 'train' AS role, * FROM elig_all WHERE label_known_date < DATE '2001-01-01' "
        "UNION ALL SELECT 'holdout_2001', 'test', * FROM elig_all WHERE as_of_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31')"
    ),
)
cte(
    "inner_s",
    """
WITH t AS (SELECT * FROM assigned_s WHERE role = 'train'),
y AS (SELECT fold, year(as_of_date) AS yr, count(*) AS n_val, row_number() OVER (PARTITION BY fold ORDER BY year(as_of_date) DESC) AS k FROM t GROUP BY 1, 2)
SELECT y.fold, y.yr, count(*) AS n_train, n_val FROM y JOIN t ON t.fold = y.fold AND t.label_known_date < make_date(CAST(y.yr AS INTEGER), 1, 1)
WHERE k <= 3 GROUP BY 1, 2, n_val HAVING count(*) >= 500 AND count(DISTINCT t.y) = 2
""",
)
sql("inner_splits", "SELECT fold, CAST(yr AS INTEGER) AS year, n_train, n_val FROM inner_s")
sql(
    "prevalence",
    """
SELECT 'prevalence' AS model, t.fold, asset, as_of_date, round(r.p, 8) AS prob, y FROM assigned t
JOIN (SELECT fold, avg(y) AS p FROM assigned WHERE role = 'train' GROUP BY 1) r ON r.fold = t.fold WHERE role = 'test'
""",
)
sql("predictions", "SELECT model, fold, asset, as_of_date, y, prob FROM preds")
sql("metrics", f"SELECT model, scope, n, {rounded(METRIC_NAMES)} FROM pm_all")
sql(
    "metrics_long",
    " UNION ALL ".join(f"SELECT model, scope, n, '{m}' AS metric, round({m}, 8) AS value FROM pm_all WHERE {m} IS NOT NULL" for m in METRIC_NAMES),
)
sql("roc_auc", f"SELECT model, scope, {rounded(['roc_auc'])} FROM cm_auc")
sql("pr_auc", f"SELECT model, scope, {rounded(['pr_auc'])} FROM cm_ap")
sql("calibration", f"SELECT model, scope, bin, n, {rounded(['mean_pred', 'frac_pos'])} FROM pm_cal")
sql("ece", f"SELECT model, scope, {rounded(['ece'])} FROM cm_ece")
sql(
    "fold_mean",
    """
SELECT m.model, round(avg(m.pr_auc), 8) AS pr_auc, round(avg(m.roc_auc), 8) AS roc_auc, round(avg(m.brier), 8) AS brier,
  round(avg(m.log_loss), 8) AS log_loss, round(avg(m.ece), 8) AS ece, count(*) FILTER (WHERE m.pr_auc > r.pr_auc) AS folds_beat_reference
FROM pm_all m LEFT JOIN pm_all r ON r.model = 'har_logit' AND r.scope = m.scope WHERE m.scope <> 'pooled' GROUP BY 1
""",
)
sql(
    "prediction_outcome",
    f"""
SELECT p.model || '/' || p.fold AS version, p.model, p.fold, p.asset, p.as_of_date, prob, l.y, l.label_known_date, {rounded(['rv_fwd'])}
FROM preds p JOIN lab l ON l.asset = p.asset AND l.as_of_date = p.as_of_date WHERE l.y IS NOT NULL
""",
)
cte(
    "pairs",
    """
SELECT * FROM (VALUES ('benchmark', 'logit_tuned', 'har_logit'), ('benchmark', 'hist_gb', 'har_logit'), ('benchmark', 'random_forest', 'har_logit'),
  ('benchmark', 'logit_tuned', 'vix_logit'), ('benchmark', 'hist_gb', 'vix_logit'), ('benchmark', 'random_forest', 'vix_logit'),
  ('garch', 'logit_tuned', 'garch_logit'), ('garch', 'hist_gb', 'garch_logit'), ('garch', 'random_forest', 'garch_logit')) p(family, model, vs)
""",
)
cte(
    "paired",
    """
SELECT family, pairs.model, vs, a.asset, a.fold, a.as_of_date, a.y, a.prob AS p_a, b.prob AS p_b
FROM pairs JOIN preds a ON a.model = pairs.model JOIN preds b ON b.model = vs AND b.asset = a.asset AND b.fold = a.fold AND b.as_of_date = a.as_of_date
""",
)
sql("pairwise_pred", "SELECT * FROM paired")
sql(
    "param_grid",
    f"""
SELECT g.model, CAST(g.pos AS INTEGER) AS grid_pos, CAST(g.a AS DOUBLE) AS a, CAST(g.b AS DOUBLE) AS b, f.fold, f.n_train
FROM (VALUES ('hist_gb', 0, 2, 0.03), ('hist_gb', 1, 2, 0.1), ('hist_gb', 2, 3, 0.03), ('hist_gb', 3, 3, 0.1),
  ('random_forest', 0, 4, 20), ('random_forest', 1, 4, 50), ('random_forest', 2, 8, 20), ('random_forest', 3, 8, 50)) g(model, pos, a, b),
  ({FOLD_INFO.format("assigned")}) f
""",
)
cte(
    "cvs",
    f"""
WITH t AS (SELECT assigned_s.*, year(as_of_date) AS yr, {MODELS['har_logit']} AS prob FROM assigned_s WHERE role = 'train'),
g AS (SELECT * FROM (VALUES (0, 'w=0.25', 0.25::DOUBLE), (1, 'w=0.5', 0.5::DOUBLE), (2, 'w=1.0', 1.0::DOUBLE)) g(grid_pos, params, w)),
v AS (SELECT t.fold, t.yr, grid_pos, params, t.y, 0.2::DOUBLE + w * (prob - 0.2::DOUBLE) AS q FROM t JOIN inner_s i ON i.fold = t.fold AND i.yr = t.yr, g),
l AS (SELECT fold, yr, grid_pos, params, -avg(y * ln(least(greatest(q, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(q, 1e-6), 1 - 1e-6))) AS loss FROM v GROUP BY 1, 2, 3, 4)
SELECT 'har_shrunk' AS model, fold, grid_pos, params, avg(loss) AS score, count(*) AS splits FROM l GROUP BY 2, 3, 4
""",
)
sql("cv_scores", "SELECT model, fold, CAST(grid_pos AS INTEGER) AS grid_pos, params, splits, round(score, 8) AS score FROM cvs")
sql(
    "best_config",
    "SELECT model, fold, arg_min(params, row(score, grid_pos)) AS params, round(min(score), 8) AS score, CAST(arg_min(grid_pos, row(score, grid_pos)) AS INTEGER) AS grid_pos FROM cvs GROUP BY 1, 2",
)
cte("finfo", FOLD_INFO.format("assigned_s"))
sql(
    "walk_forward_store",
    """
WITH u AS (SELECT model, fold, count(*) AS n FROM preds GROUP BY 1, 2),
s AS (SELECT min(train_start) AS a, max(train_end) AS b FROM finfo)
SELECT 'version' AS kind, model, u.fold, train_start || '/' || train_end || '/new' AS name, CAST(n AS DOUBLE) AS value FROM u JOIN finfo f ON f.fold = u.fold
UNION ALL SELECT 'version', model, 'pooled', (SELECT a || '/' || b || '/new' FROM s), CAST(sum(n) AS DOUBLE) FROM u GROUP BY model
UNION ALL SELECT 'prediction', model, fold, asset || '/' || as_of_date, round(prob, 8) FROM preds
UNION ALL SELECT 'trial', model, fold, params, round(score, 8) FROM cvs
"""
    + "".join(f"UNION ALL SELECT 'metric', model, scope, '{m}', round({m}, 8) FROM pm_all WHERE {m} IS NOT NULL\n" for m in METRIC_NAMES),
)
sql(
    "stored_outcomes",
    f"""
SELECT p.model, p.fold, p.asset, p.as_of_date, prob, l.y, l.label_known_date, {rounded(['rv_fwd'])}
FROM preds p JOIN lab l ON l.asset = p.asset AND l.as_of_date = p.as_of_date WHERE l.y IS NOT NULL
""",
)

# ---- risk ----------------------------------------------------------------------------------------
cte("sr", "SELECT asset, trade_date, adj_close / lag(adj_close) OVER (PARTITION BY asset ORDER BY trade_date) - 1 AS r FROM px")
cte(
    "port",
    "SELECT 'portfolio' AS asset, trade_date, sum(CASE asset WHEN 'A1' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * r) AS r FROM sr WHERE asset IN ('A1', 'A2') AND r IS NOT NULL GROUP BY trade_date HAVING count(*) = 2",
)
cte("allr", "SELECT * FROM (SELECT * FROM sr UNION ALL SELECT * FROM port) WHERE r IS NOT NULL")
cte("rn", "SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY trade_date) - 1 AS INTEGER) AS k FROM allr")
# Closed form of the exponential recursion; 0.94^-k stays finite for this panel.
cte(
    "ew",
    """
SELECT asset, trade_date, r, k, pow(0.94, k) * sum(CASE WHEN k = 0 THEN r * r ELSE 0.06::DOUBLE * r * r END * pow(0.94, -k))
  OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM rn
""",
)
def tails_sql(source: str, method: str, scale: str, digits: str) -> str:
    """Rolling quantile and tail mean at both levels from a list column l."""
    parts = []
    for conf, q in ((0.95, 0.05), (0.99, 0.01)):
        cut = f"list_aggregate(l, 'quantile_cont', {q}::DOUBLE)"
        parts.append(
            f"SELECT asset, trade_date, '{method}' AS method, {conf}::DOUBLE AS conf, {digits.format(f'-{scale} * cut')} AS var, "
            f"{digits.format(f'-{scale} * list_avg(list_filter(l, lambda x: x <= cut))')} AS es FROM (SELECT *, {cut} AS cut FROM {source})"
        )
    return " UNION ALL ".join(parts)


cte("hl", "SELECT * FROM (SELECT asset, trade_date, list(r) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS l FROM rn) WHERE len(l) = 500")
cte("hs", tails_sql("hl", "historical", "1.0::DOUBLE", "{}"))
cte("sg", "SELECT asset, trade_date, lag(sqrt(v)) OVER (PARTITION BY asset ORDER BY k) AS sigma FROM ew")


def parametric(method: str, table: dict[float, tuple[float, float]]) -> str:
    return " UNION ALL ".join(
        f"SELECT asset, trade_date, '{method}' AS method, {c}::DOUBLE AS conf, sigma * {v!r}::DOUBLE AS var, sigma * {e!r}::DOUBLE AS es FROM sg WHERE sigma IS NOT NULL"
        for c, (v, e) in table.items()
    )


# Normal multiples of sigma (VaR, ES), and Student-t quantiles with 5 degrees of freedom.
cte("vn", parametric("normal_ewma", {0.95: (1.6448536269514715, 2.062712807507426), 0.99: (2.3263478740408408, 2.6652142203458076)}))
cte(
    "vt",
    """
WITH q AS (SELECT * FROM (VALUES (0.95::DOUBLE, 2.015048373333024::DOUBLE), (0.99, 3.3649299989072216)) q(conf, q)),
m AS (SELECT conf, q / sqrt(5.0 / 3) AS vm, 2 / (1.329340388179137::DOUBLE * sqrt(5 * pi())) * pow(1 + q * q / 5, -3) / (1 - conf) * (5 + q * q) / 4 / sqrt(5.0 / 3) AS em FROM q)
SELECT asset, trade_date, 'student_t_ewma' AS method, conf, sigma * vm AS var, sigma * em AS es FROM sg, m WHERE sigma IS NOT NULL
""",
)
EST = "asset, trade_date, method, conf, round(var, 8) AS var, round(es, 8) AS es"
sql("ewma_vol", "SELECT s.asset, s.trade_date, round(sqrt(252 * v), 8) AS ewma_vol FROM sr s LEFT JOIN ew ON ew.asset = s.asset AND ew.trade_date = s.trade_date")
cte(
    "ewg",
    """
WITH a AS (SELECT asset, trade_date, CASE WHEN day(trade_date) BETWEEN 10 AND 14 THEN NULL ELSE r END AS r, row_number() OVER (PARTITION BY asset ORDER BY trade_date) AS pos FROM sr),
b AS (SELECT *, pow(0.94, pos - lag(pos) OVER (PARTITION BY asset ORDER BY pos)) AS old FROM a WHERE r IS NOT NULL),
c AS (SELECT *, coalesce(0.06 * r * r / (old + 0.06), r * r) AS e, sum(ln(coalesce(old / (old + 0.06), 1))) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM b),
d AS (SELECT asset, trade_date, exp(p) * sum(e * exp(-p)) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM c)
SELECT a.asset, a.trade_date, last_value(v IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY a.trade_date ROWS UNBOUNDED PRECEDING) AS v FROM a LEFT JOIN d ON d.asset = a.asset AND d.trade_date = a.trade_date
""",
)
sql("ewma_vol_gaps", "SELECT asset, trade_date, round(sqrt(252 * v), 8) AS ewma_vol FROM ewg")
sql("var_historical", f"SELECT {EST} FROM hs")
sql("var_normal", f"SELECT {EST} FROM vn")
sql("var_student_t", f"SELECT {EST} FROM vt")
sql("portfolio_returns", "SELECT asset, trade_date, round(r, 8) AS r FROM port")
sql(
    "hist_es",
    """
WITH q AS (SELECT asset, quantile_cont(r, 0.05) AS a, quantile_cont(r, 0.01) AS b FROM sr GROUP BY 1)
SELECT s.asset, round(max(a), 8) AS q_95, round(max(b), 8) AS q_99, round(avg(r) FILTER (WHERE r <= a), 8) AS m_95, round(avg(r) FILTER (WHERE r <= b), 8) AS m_99
FROM sr s JOIN q ON q.asset = s.asset WHERE r IS NOT NULL GROUP BY 1
""",
)
# Closed form of the variance recursion with constant beta.
cte(
    "gpp",
    """
WITH x AS (SELECT asset, trade_date, k, r * 100 AS x, var_pop(r * 100) OVER (PARTITION BY asset) AS h0 FROM rn),
e AS (SELECT *, CASE WHEN k = 0 THEN h0 ELSE lag(50.0::DOUBLE + (0.03::DOUBLE + CASE WHEN x < 0 THEN 0.1::DOUBLE ELSE 0 END) * x * x) OVER (PARTITION BY asset ORDER BY k) END AS e FROM x)
SELECT asset, trade_date, k, x, pow(0.85, k) * sum(e * pow(0.85, -k)) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS h FROM e
""",
)
cte("gp", "SELECT * FROM gpp WHERE asset <> 'portfolio'")
sql("garch_path", "SELECT asset, trade_date, round(h, 4) AS h FROM gp")
sql(
    "garch_forecast",
    """
WITH v AS (SELECT asset, trade_date, 50 + (0.03 + CASE WHEN x < 0 THEN 0.1 ELSE 0 END) * x * x + 0.85 * h AS v1 FROM gp),
w AS (SELECT *, 50 + 0.93 * v1 AS v2 FROM v), y AS (SELECT *, 50 + 0.93 * v2 AS v3 FROM w), z AS (SELECT *, 50 + 0.93 * v3 AS v4 FROM y)
SELECT asset, trade_date, round((v1 + v2 + v3 + v4 + 50 + 0.93 * v4) / 5, 4) AS avg_var FROM z
""",
)
# A year counts once 500 returns lie before it; so does the window of every day in it.
cte("fy", "SELECT asset, year(trade_date) AS y FROM rn GROUP BY 1, 2 HAVING min(k) >= 500")
cte(
    "flp",
    "SELECT l.* FROM (SELECT asset, trade_date, h, list(x / sqrt(h)) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS l FROM gpp) l JOIN fy ON fy.asset = l.asset AND y = year(trade_date)",
)
cte("fhs", tails_sql("flp", "fhs_gjr_garch", "sqrt(h) / 100", "{}"))
sql("fhs_quantiles", "SELECT asset, trade_date, method, conf, round(var, 6) AS var, round(es, 6) AS es FROM fhs WHERE asset <> 'portfolio'")
cte("vall", "SELECT * FROM hs UNION ALL SELECT * FROM vn UNION ALL SELECT * FROM vt UNION ALL SELECT * FROM fhs")
sql("var_estimates", f"SELECT {EST} FROM vall")
M = 2147483647


def mix_sql(*keys: str) -> str:
    """Nested integer mixing with every product below 2^63."""
    x = "1"
    for key in keys:
        x = f"(({x}) * 48271::BIGINT + ({key}) + 1) % {M}"
    return x


def rounds(table: str, columns: str, fold: str) -> str:
    """Subquery adding the mixed state ``u`` to ``columns`` of ``table``."""
    a = f"SELECT {columns}, (({fold}) * 48271::BIGINT) % {M} AS m0 FROM {table}"
    b = f"SELECT * EXCLUDE (m0), ((m0 * m0 + 12345) % {M}) * 48271::BIGINT % {M} AS m1 FROM ({a})"
    return f"SELECT * EXCLUDE (m1), ((m1 * m1 + 67891) % {M}) * 48271::BIGINT % {M} AS u FROM ({b})"


cte(
    "mcs",
    f"""
WITH RECURSIVE st AS (
  SELECT asset, arg_max(50 + (0.03 + CASE WHEN x < 0 THEN 0.1 ELSE 0 END) * x * x + 0.85 * h, k) AS h_next,
    list(x / sqrt(h) ORDER BY k) AS zs FROM gp GROUP BY 1),
p AS ({rounds("range(100000) t(path)", "path", mix_sql("0", "path"))}),
run AS (
  SELECT 0 AS step, asset, path, u, CAST(h_next AS DOUBLE) AS h, 0.0::DOUBLE AS total, zs[-500:] AS zs FROM st, p
  UNION ALL
  SELECT step + 1, asset, path, u * 48271::BIGINT % {M},
    50 + (0.03 + CASE WHEN zs[CAST(floor(u / {M}.0::DOUBLE * 500) AS INTEGER) + 1] < 0 THEN 0.1 ELSE 0 END) * pow(sqrt(h) * zs[CAST(floor(u / {M}.0::DOUBLE * 500) AS INTEGER) + 1], 2) + 0.85 * h,
    total + sqrt(h) * zs[CAST(floor(u / {M}.0::DOUBLE * 500) AS INTEGER) + 1], zs
  FROM run WHERE step < 10)
SELECT asset, total / 100 AS total FROM run WHERE step = 10
""",
)
sql(
    "mc_var",
    """
WITH q AS (SELECT asset, 0.95::DOUBLE AS conf, quantile_cont(total, 0.05) AS cut FROM mcs GROUP BY 1 UNION ALL SELECT asset, 0.99, quantile_cont(total, 0.01) FROM mcs GROUP BY 1)
SELECT q.asset, conf, round(-max(cut), 6) AS var, round(-avg(total), 6) AS es FROM q JOIN mcs ON mcs.asset = q.asset AND total <= cut GROUP BY 1, 2
""",
)
cte("exc", "SELECT v.*, a.r, CASE WHEN a.r < -v.var THEN 1 ELSE 0 END AS hit FROM vall v JOIN allr a ON a.asset = v.asset AND a.trade_date = v.trade_date")


def xl(x: str, y: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END"


cte(
    "kup",
    f"""
WITH c AS (SELECT asset, method, conf, count(*) AS n, CAST(sum(hit) AS BIGINT) AS x FROM exc GROUP BY 1, 2, 3)
SELECT *, greatest(-2 * ({xl("(n - x)", "conf")} + {xl("x", "(1 - conf)")} - {xl("(n - x)", "(1 - x / CAST(n AS DOUBLE))")} - {xl("x", "(x / CAST(n AS DOUBLE))")}), 0) AS lr FROM c
""",
)
sql("kupiec", "SELECT asset, method, conf, n, x, round(lr, 8) AS lr FROM kup")
cte(
    "chr",
    f"""
WITH l AS (SELECT *, lag(hit) OVER (PARTITION BY asset, method, conf ORDER BY trade_date) AS p FROM exc),
c AS (SELECT asset, method, conf, count(*) FILTER (WHERE p = 0 AND hit = 0) AS n00, count(*) FILTER (WHERE p = 0 AND hit = 1) AS n01,
  count(*) FILTER (WHERE p = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE p = 1 AND hit = 1) AS n11 FROM l GROUP BY 1, 2, 3),
d AS (SELECT *, (n01 + n11) / CAST(greatest(n00 + n01 + n10 + n11, 1) AS DOUBLE) AS q, n01 / CAST(greatest(n00 + n01, 1) AS DOUBLE) AS q0, n11 / CAST(greatest(n10 + n11, 1) AS DOUBLE) AS q1 FROM c)
SELECT *, greatest(-2 * ({xl("(n00 + n10)", "(1 - q)")} + {xl("(n01 + n11)", "q")} - {xl("n00", "(1 - q0)")} - {xl("n01", "q0")} - {xl("n10", "(1 - q1)")} - {xl("n11", "q1")}), 0) AS lr FROM d
""",
)
sql("christoffersen", "SELECT asset, method, conf, n00, n01, n10, n11, round(lr, 8) AS lr FROM chr")
cte(
    "bas",
    """
WITH c AS (SELECT asset, method, conf, sum(hit) OVER w AS h, count(*) OVER w AS n FROM exc WHERE conf = 0.99 WINDOW w AS (PARTITION BY asset, method, conf ORDER BY trade_date ROWS 249 PRECEDING))
SELECT asset, method, conf, avg(CASE WHEN h <= 4 THEN 1.0::DOUBLE ELSE 0 END) AS basel_green, avg(CASE WHEN h BETWEEN 5 AND 9 THEN 1.0::DOUBLE ELSE 0 END) AS basel_yellow,
  avg(CASE WHEN h >= 10 THEN 1.0::DOUBLE ELSE 0 END) AS basel_red FROM c WHERE n = 250 GROUP BY 1, 2, 3
""",
)
ZONES = ", ".join(f"round(basel_{z}, 8) AS basel_{z}" for z in ("green", "yellow", "red"))
sql("basel", f"SELECT asset, method, conf, {ZONES} FROM bas")


def erfc(z: str) -> str:
    """1 - erf(z) for z >= 0, by the series of positive terms (below 1e-12 beyond 6)."""
    term = f"exp(2 * n * ln(2) + (2 * n + 1) * ln({z}) + lgamma(n + 1) - lgamma(2 * n + 2) - {z} * {z})"
    return f"CASE WHEN {z} <= 0 THEN 1.0 WHEN {z} > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(200), lambda n: {term})) END"


cte(
    "vbt",
    """
WITH e AS (SELECT asset, method, conf, count(*) AS n, CAST(sum(hit) AS BIGINT) AS exceptions, avg(var) AS avg_var,
  CASE WHEN sum(hit) > 0 THEN avg(CASE WHEN hit = 1 THEN -r END) / avg(CASE WHEN hit = 1 THEN es END) END AS es_ratio FROM exc GROUP BY 1, 2, 3)
SELECT e.*, round(e.n * (1 - e.conf), 1) AS expected, exceptions / CAST(e.n AS DOUBLE) AS rate, kup.lr AS kupiec_lr, chr.lr AS indep_lr, kup.lr + chr.lr AS cc_lr,
  exp(-(kup.lr + chr.lr) / 2) AS cc_p, sqrt(kup.lr / 2) AS zk, sqrt(chr.lr / 2) AS zi, basel_green, basel_yellow, basel_red
FROM e JOIN kup ON kup.asset = e.asset AND kup.method = e.method AND kup.conf = e.conf
JOIN chr ON chr.asset = e.asset AND chr.method = e.method AND chr.conf = e.conf
LEFT JOIN bas ON bas.asset = e.asset AND bas.method = e.method AND bas.conf = e.conf
""",
)
BACKTEST = ("expected", "rate", "kupiec_lr", "kupiec_p", "indep_lr", "indep_p", "cc_lr", "cc_p", "es_ratio", "avg_var", "basel_green", "basel_yellow", "basel_red")
sql(
    "var_backtest",
    f"SELECT asset, method, conf, n, exceptions, {', '.join(f'round({c}, 8) AS {c}' for c in BACKTEST)} FROM (SELECT *, {erfc('zk')} AS kupiec_p, {erfc('zi')} AS indep_p FROM vbt)",
)
cte("allr50", "SELECT asset, trade_date, r / 50 AS r FROM allr")


def drawdown_sql(table: str, keys: str, r: str = "r") -> str:
    """Drawdown by logs of wealth, with starting wealth one."""
    return f"""
SELECT *, wl / greatest(1, max(wl) OVER (PARTITION BY {keys} ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (
  SELECT *, exp(sum(ln(1 + {r})) OVER (PARTITION BY {keys} ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS wl FROM {table})"""


sql("max_drawdown", f"SELECT asset, round(least(min(dd), 0), 8) AS max_drawdown FROM ({drawdown_sql('allr50', 'asset')}) GROUP BY 1")
sql(
    "stress_replay",
    f"""
WITH w AS (SELECT * FROM (VALUES ('asia_1997', DATE '1997-10-01', DATE '1998-01-15'), ('ltcm_1998', DATE '1998-07-17', DATE '1998-10-08'), ('dotcom_2000', DATE '2000-03-10', DATE '2001-04-04')) w(scenario, a, b)),
x AS (SELECT scenario, allr50.* FROM allr50 JOIN w ON trade_date BETWEEN a AND b)
SELECT scenario, asset, count(*) AS days, round(exp(sum(ln(1 + r))) - 1, 8) AS total_return, round(least(min(dd), 0), 8) AS max_drawdown, round(min(r), 8) AS worst_day
FROM ({drawdown_sql("x", "scenario, asset")}) GROUP BY 1, 2
""",
)
cte("wide", "SELECT trade_date, max(r) FILTER (WHERE asset = 'A1') AS a1, max(r) FILTER (WHERE asset = 'A2') AS a2, max(r) FILTER (WHERE asset = 'A3') AS a3, max(r) FILTER (WHERE asset = 'A4') AS a4 FROM sr GROUP BY 1")
cte("beta", "SELECT 'A1' AS asset, covar_samp(a1, a1) / var_samp(a1) AS beta FROM wide WHERE a1 IS NOT NULL AND a2 IS NOT NULL UNION ALL SELECT 'A2', covar_samp(a2, a1) / var_samp(a1) FROM wide WHERE a1 IS NOT NULL AND a2 IS NOT NULL")
sql("betas", "SELECT asset, round(beta, 8) AS beta FROM beta")
sql(
    "cov_matrix",
    " UNION ALL ".join(
        f"SELECT 'A{i}' AS asset_i, 'A{j}' AS asset_j, round(covar_samp(a{i}, a{j}), 8) AS cov FROM wide WHERE a1 + a2 + a3 + a4 IS NOT NULL"
        for i in range(1, 5)
        for j in range(1, 5)
    ),
)
sql(
    "cov_matrix_all",
    """
WITH f AS (SELECT * FROM sr WHERE r IS NOT NULL AND trade_date IN (
  SELECT trade_date FROM sr WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT asset) FROM px)))
SELECT a.asset AS asset_i, b.asset AS asset_j, round(covar_samp(a.r, b.r), 8) AS cov FROM f a JOIN f b ON a.trade_date = b.trade_date GROUP BY 1, 2
""",
)
sql(
    "shock_loss",
    """
WITH v AS (SELECT asset, sum(volume) / CAST((SELECT sum(volume) FROM px) AS DOUBLE) AS w FROM px GROUP BY 1)
SELECT 'equity_shock' AS scenario, round(sum(CASE asset WHEN 'A1' THEN 0.6 ELSE 0.4 END * beta * -0.2), 8) AS loss FROM beta
UNION ALL SELECT 'both_fall', round(sum(w * CASE asset WHEN 'A1' THEN -0.2 WHEN 'A2' THEN -0.1 ELSE 0 END), 8) FROM v
UNION ALL SELECT 'second_rises', round(sum(w * CASE asset WHEN 'A1' THEN -0.2 WHEN 'A2' THEN 0.05 ELSE 0 END), 8) FROM v
""",
)
# The quadratic form written out over the two by two matrix.
sql(
    "stressed_var",
    """
WITH c AS (SELECT stddev_samp(a1) AS s1, stddev_samp(a2) AS s2, corr(a1, a2) AS rho FROM wide WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
s AS (SELECT n.scenario, sqrt(0.36 * m * m * s1 * s1 + 0.16 * m * m * s2 * s2 + 2 * 0.24 * m * m * s1 * s2 * (rho + b * (1 - rho))) AS sigma FROM c, (VALUES ('baseline', 1.0, 0.0), ('stressed', 2.0, 0.5)) n(scenario, m, b))
SELECT scenario, round(sigma, 8) AS sigma, round(sigma * 2.3263478740408408::DOUBLE, 8) AS var, round(sigma * 2.6652142203458076::DOUBLE, 8) AS es FROM s
""",
)
cte("cash_p", "SELECT p.trade_date, lag(k.value) OVER (ORDER BY p.trade_date) / 100 / 252 AS cash FROM port p LEFT JOIN dknown k ON k.series = 'D_F' AND k.as_of_date = p.trade_date")
sql(
    "portfolio_metrics",
    f"""
WITH x AS (SELECT p.asset, p.trade_date, p.r / 50 AS r, m.r / 50 AS m, c.cash FROM port p JOIN sr m ON m.asset = 'A1' AND m.trade_date = p.trade_date JOIN cash_p c ON c.trade_date = p.trade_date WHERE c.cash IS NOT NULL AND m.r IS NOT NULL),
d AS ({drawdown_sql("x", "asset")}),
q AS (SELECT quantile_cont(r, 0.05) AS q95, quantile_cont(r, 0.01) AS q99 FROM x)
SELECT asset, round(exp(sum(ln(1 + r)) * 252 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol,
  round(avg(r - cash) / stddev_samp(r - cash) * sqrt(252), 6) AS sharpe, round(least(min(dd), 0), 6) AS max_drawdown,
  round(covar_samp(r, m) / var_samp(m), 6) AS beta_to_market, round(corr(r, m), 6) AS corr_to_market,
  round(-max(q95), 6) AS hist_var_95, round(-max(q99), 6) AS hist_var_99,
  round(-avg(r) FILTER (WHERE r <= q95), 6) AS hist_es_95, round(-avg(r) FILTER (WHERE r <= q99), 6) AS hist_es_99
FROM d, q GROUP BY asset
""",
)
# ---- overlay -------------------------------------------------------------------------------------
cte(
    "ovi",
    f"""
WITH s AS (SELECT asset, trade_date, r / 50 AS r FROM sr),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY trade_date) - 1 AS INTEGER) AS k FROM s WHERE r IS NOT NULL),
e AS (SELECT asset, trade_date, sqrt(252 * pow(0.94, k) * sum(CASE WHEN k = 0 THEN r * r ELSE 0.06::DOUBLE * r * r END * pow(0.94, -k)) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING)) AS ev FROM n)
SELECT s.asset, s.trade_date, s.r, e.ev, v.close / 997 AS vix, lag(c.value) OVER (PARTITION BY s.asset ORDER BY s.trade_date) / 100 / 252 AS cash, f.prob AS p_rf, t.prob AS p_lt
FROM s LEFT JOIN e ON e.asset = s.asset AND e.trade_date = s.trade_date
LEFT JOIN px v ON v.asset = 'A7' AND v.trade_date = s.trade_date
LEFT JOIN dknown c ON c.series = 'D_F' AND c.as_of_date = s.trade_date
LEFT JOIN preds f ON f.model = 'random_forest' AND f.asset = s.asset AND f.as_of_date = s.trade_date
LEFT JOIN preds t ON t.model = 'logit_tuned' AND t.asset = s.asset AND t.as_of_date = s.trade_date
""",
)


def capped(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 1) END"


def weights_sql(tv: str, source: str = "ovi") -> str:
    return (
        f"SELECT *, 1.0::DOUBLE AS w_buy_hold, {capped(f'{tv} / ev')} AS w_ewma_vol_target, {capped(f'{tv} / (vix / 100)')} AS w_vix_target, "
        f"{capped('(1 - p_rf)')} AS w_model_random_forest, {capped('(1 - p_lt)')} AS w_model_logit_tuned FROM {source}"
    )


OV = ["buy_hold", "ewma_vol_target", "vix_target", "model_random_forest", "model_logit_tuned"]


def backtest_sql(lag: str, cost: str, tv: str, keys: str = "asset", source: str = "ovi") -> str:
    held = ", ".join(f"CASE WHEN {lag} = 1 THEN lag(w_{n}, 1) OVER w ELSE lag(w_{n}, 2) OVER w END AS h_{n}" for n in OV)
    ok = " AND ".join(f"h_{n} IS NOT NULL" for n in OV)
    extra = "" if keys == "asset" else keys.replace("asset", "").strip(", ") + ", "
    rows = " UNION ALL ".join(
        f"SELECT {extra}asset, trade_date, cash, r, {cost} AS cost, '{n}' AS strategy, h_{n} AS held FROM m" for n in [*OV, "static_matched"]
    )
    return f"""
WITH wt AS ({weights_sql(tv, source)}),
h AS (SELECT *, {held} FROM wt WINDOW w AS (PARTITION BY {keys} ORDER BY trade_date)),
c AS (SELECT * FROM h WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND r IS NOT NULL AND cash IS NOT NULL AND {ok}),
m AS (SELECT *, avg(h_model_random_forest) OVER (PARTITION BY {keys}) AS h_static_matched FROM c),
l AS ({rows}),
t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY {keys}, strategy ORDER BY trade_date), 0)) AS turnover FROM l)
SELECT *, held * r + (1 - held) * cash - turnover * cost / 10000 AS net FROM t"""


cte("bt", backtest_sql("2", "5.0::DOUBLE", "0.1::DOUBLE"))
sql("overlay_weights", "SELECT asset, trade_date, " + ", ".join(f"round(w_{n}, 8) AS w_{n}" for n in OV) + f" FROM ({weights_sql('0.1::DOUBLE')})")
sql("overlay_returns", f"SELECT asset, trade_date, strategy, {rounded(['held', 'turnover', 'net'])} FROM bt")
sql(
    "performance",
    f"""
WITH d AS ({drawdown_sql("bt", "asset, strategy", "net")}),
q AS (SELECT asset, strategy, quantile_cont(net, 0.05) AS cut FROM bt GROUP BY 1, 2),
a AS (SELECT d.asset, d.strategy, count(*) AS days, exp(sum(ln(1 + net)) * 252 / count(*)) - 1 AS ann_return, stddev_samp(net) * sqrt(252) AS ann_vol,
  avg(net - cash) / stddev_samp(net - cash) * sqrt(252) AS sharpe, least(min(dd), 0) AS max_drawdown, avg(held) AS avg_exposure,
  sum(turnover) / (count(*) / 252.0) AS turnover_per_year, avg(net) FILTER (WHERE net <= cut) AS cvar95_daily
FROM d JOIN q ON q.asset = d.asset AND q.strategy = d.strategy GROUP BY 1, 2)
SELECT asset, strategy, days, {rounded(['ann_return', 'ann_vol', 'sharpe', 'max_drawdown', 'avg_exposure', 'turnover_per_year', 'cvar95_daily'], 6)},
  CASE WHEN max_drawdown < 0 THEN round(ann_return / abs(max_drawdown), 6) END AS calmar FROM a
""",
)
sql(
    "episode_table",
    f"""
WITH w AS (SELECT * FROM (VALUES ('autumn_1998', DATE '1998-08-01', DATE '1998-11-30'), ('year_2000', DATE '2000-01-01', DATE '2000-12-31')) w(episode, a, b)),
x AS (SELECT episode, bt.* FROM bt JOIN w ON trade_date BETWEEN a AND b),
s AS (SELECT asset, strategy, episode, exp(sum(ln(1 + net))) - 1 AS tr, least(min(dd), 0) AS md FROM ({drawdown_sql("x", "asset, strategy, episode", "net")}) GROUP BY 1, 2, 3)
SELECT asset, strategy, """
    + ", ".join(
        f"round(max({c}) FILTER (WHERE episode = '{e}'), 8) AS {e}_{n}"
        for e in ("autumn_1998", "year_2000")
        for c, n in (("tr", "total_return"), ("md", "max_drawdown"))
    )
    + " FROM s GROUP BY 1, 2",
)
cte("ovs", "SELECT ovi.*, CAST(a.lag AS INTEGER) AS lag, b.cost_bps, c.target_vol FROM ovi, (VALUES (1), (2)) a(lag), (VALUES (0.0::DOUBLE), (2.0), (5.0), (10.0)) b(cost_bps), (VALUES (0.08::DOUBLE), (0.1), (0.12)) c(target_vol)")
cte("bts", backtest_sql("lag", "cost_bps", "target_vol", "lag, cost_bps, target_vol, asset", "ovs"))
sql("overlay_sensitivity", "SELECT lag, cost_bps, target_vol, asset, strategy, round(avg(net - cash) / stddev_samp(net - cash) * sqrt(252), 6) AS sharpe FROM bts GROUP BY 1, 2, 3, 4, 5")
# ---- forecast comparison -------------------------------------------------------------------------


def ll(p: str) -> str:
    c = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"-(y * ln({c}) + (1 - y) * ln(1 - {c}))"


cte("dif", f"SELECT *, {ll('p_a')} - {ll('p_b')} AS d FROM paired")
sql(
    "dm_test",
    """
WITH c AS (SELECT *, d - avg(d) OVER (PARTITION BY asset, family, model, vs) AS c FROM dif),
l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY asset, family, model, vs ORDER BY as_of_date)),
a AS (SELECT asset, family, model, vs, count(*) AS n, avg(d) AS mean_diff, (sum(c * c) + 2 * (0.8 * sum(c * c1) + 0.6 * sum(c * c2) + 0.4 * sum(c * c3) + 0.2 * sum(c * c4))) / count(*) AS v FROM l GROUP BY 1, 2, 3, 4)
SELECT asset, family, model, vs, n, round(mean_diff, 6) AS mean_diff, CASE WHEN v > 0 THEN round(mean_diff / sqrt(v / n) * sqrt((n + 1 - 10 + 20.0 / n) / n), 6) END AS stat FROM a
""",
)
# Upper tail of Student's t by Simpson's rule in the angle atan(x / sqrt(df)), 400 steps.
sql(
    "dm_p_values",
    """
WITH c AS (SELECT *, d - avg(d) OVER (PARTITION BY asset, family, model, vs) AS c FROM dif),
l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY asset, family, model, vs ORDER BY as_of_date)),
a AS (SELECT asset, family, model, vs, count(*) AS n, avg(d) AS mean_diff, (sum(c * c) + 2 * (0.8 * sum(c * c1) + 0.6 * sum(c * c2) + 0.4 * sum(c * c3) + 0.2 * sum(c * c4))) / count(*) AS v FROM l GROUP BY 1, 2, 3, 4),
t AS (SELECT *, CAST(n - 1 AS DOUBLE) AS df, CASE WHEN v > 0 THEN abs(mean_diff / sqrt(v / n) * sqrt((n + 1 - 10 + 20.0 / n) / n)) END AS x FROM a),
g AS (SELECT *, atan(x / sqrt(df)) AS lo, least(pi() / 2, atan(x / sqrt(df)) + 12 / sqrt(df)) AS hi FROM t)
SELECT asset, family, model, vs, round(CASE WHEN v > 0 THEN 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (hi - lo) / 1200
    * list_sum(list_transform(range(401), lambda k: (CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(lo + (hi - lo) * k / 400), 0.0::DOUBLE), df - 1)))
  WHEN mean_diff = 0 THEN 1.0 END, 6) AS p_dm FROM g
""",
)
HOLM = """SELECT *, least(1, max(st) OVER (PARTITION BY asset, family ORDER BY p, model, vs ROWS UNBOUNDED PRECEDING)) AS ph FROM (
  SELECT *, (count(*) OVER (PARTITION BY asset, family) - row_number() OVER (PARTITION BY asset, family ORDER BY p, model, vs) + 1) * p AS st FROM {})"""
sql("holm", f"SELECT asset, family, model, vs, round(p, 8) AS p, round(ph, 8) AS p_holm FROM ({HOLM.format('(SELECT asset, family, model, vs, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) / 20 AS p FROM dif GROUP BY 1, 2, 3, 4)')})")


def draws_sql(sizes: str, draws: int) -> str:
    """(asset, fold, n, draw, pos, idx) of the stationary bootstrap: blocks laid end to end."""
    grid = f"(SELECT s.*, d.draw, b.k FROM {sizes} s, range({draws}) d(draw), LATERAL (SELECT unnest(range(s.n)) AS k) b)"
    sized = rounds(grid, "*", mix_sql("12345", "draw", "0", "k"))
    sized = f"SELECT * EXCLUDE (u), CAST(least(greatest(ceil(ln((u + 0.5::DOUBLE) / {M}) / ln(1 - 1.0::DOUBLE / 20)), 1), n) AS BIGINT) AS size FROM ({sized})"
    ends = f"SELECT *, CAST(sum(size) OVER (PARTITION BY asset, fold, draw ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begin FROM ({sized})"
    used = rounds(f"(SELECT * FROM ({ends}) WHERE begin < n)", "*", mix_sql("12345", "draw", "1", "k"))
    laid = f"SELECT asset, fold, n, draw, begin, CAST(floor(u / {M}.0::DOUBLE * n) AS BIGINT) AS source, unnest(range(begin, least(begin + size, n))) AS pos FROM ({used})"
    return f"SELECT asset, fold, n, draw, pos, (source + pos - begin) % n AS idx FROM ({laid})"


cte("sizes", "SELECT asset, fold, count(*) AS n FROM preds WHERE model = 'har_logit' GROUP BY 1, 2")
cte("bix", draws_sql("sizes", 1000))
sql("bootstrap_index", "SELECT asset, fold, idx, count(*) AS times, CAST(sum(pos) AS BIGINT) AS pos_sum FROM bix GROUP BY 1, 2, 3")
cte("btn", "SELECT asset, 'all' AS fold, count(DISTINCT trade_date) AS n FROM bt GROUP BY 1")
cte("six", draws_sql("btn", 1000))
cte("xs", "SELECT asset, strategy, net - cash AS x, row_number() OVER (PARTITION BY asset, strategy ORDER BY trade_date) - 1 AS idx FROM bt")
cte("scount", "SELECT asset, draw, idx, count(*) AS c FROM six GROUP BY 1, 2, 3")
cte(
    "sdraw",
    """
WITH m AS (SELECT s.asset, draw, strategy, sum(c) AS n, sum(c * x) AS t1, sum(c * x * x) AS t2 FROM scount s JOIN xs ON xs.asset = s.asset AND xs.idx = s.idx GROUP BY 1, 2, 3)
SELECT asset, draw, strategy, (t1 / n) / sqrt((t2 - t1 * t1 / n) / (n - 1)) * sqrt(252) AS sh FROM m
UNION ALL SELECT asset, -1, strategy, avg(x) / stddev_samp(x) * sqrt(252) FROM xs GROUP BY 1, 3
""",
)
cte(
    "sres",
    """
WITH p AS (SELECT * FROM (VALUES ('model_random_forest', 'buy_hold'), ('model_random_forest', 'ewma_vol_target'), ('model_random_forest', 'vix_target'), ('model_logit_tuned', 'buy_hold'), ('model_logit_tuned', 'ewma_vol_target'), ('model_logit_tuned', 'vix_target')) p(model, vs)),
d AS (SELECT a.asset, a.draw, p.model, p.vs, a.sh - b.sh AS diff FROM p JOIN sdraw a ON a.strategy = p.model JOIN sdraw b ON b.strategy = p.vs AND b.asset = a.asset AND b.draw = a.draw)
SELECT asset, model AS family, model, vs, max(diff) FILTER (WHERE draw < 0) AS sharpe_diff, quantile_cont(diff, 0.025) FILTER (WHERE draw >= 0) AS ci_low, quantile_cont(diff, 0.975) FILTER (WHERE draw >= 0) AS ci_high,
  least(greatest(2 * least(avg(CASE WHEN diff <= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE draw >= 0), avg(CASE WHEN diff >= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE draw >= 0)), 1.0 / 1001), 1) AS p
FROM d GROUP BY 1, 3, 4
""",
)
SHARPE = "asset, family, model, vs, round(sharpe_diff, 6) AS sharpe_diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p_boot"
sql("bootstrap_sharpe", f"SELECT {SHARPE} FROM sres")
sql("sharpe_tests", f"SELECT {SHARPE}, round(ph, 6) AS p_boot_holm FROM ({HOLM.format('sres')})")

cte("pix", draws_sql("sizes", 1000))
cte(
    "pobs",
    "SELECT model, asset, fold, prob, y, row_number() OVER (PARTITION BY model, asset, fold ORDER BY as_of_date) - 1 AS idx FROM preds",
)
cte(
    "pap",
    """
WITH c AS (SELECT asset, fold, draw, idx, count(*) AS c FROM pix GROUP BY 1, 2, 3, 4 UNION ALL SELECT asset, fold, -1, unnest(range(n)), 1 FROM sizes),
g AS (SELECT c.asset, c.fold, draw, model, prob, sum(c * y) AS pos, sum(c) AS n FROM c JOIN pobs o ON o.asset = c.asset AND o.fold = c.fold AND o.idx = c.idx GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY asset, fold, draw, model ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))
SELECT asset, fold, draw, model, sum(pos * tp / CAST(cn AS DOUBLE)) / sum(pos) AS ap FROM t GROUP BY 1, 2, 3, 4 HAVING sum(pos) > 0
""",
)
cte(
    "pres",
    """
WITH d AS (SELECT a.asset, pairs.family, pairs.model, vs, a.draw, avg(a.ap - b.ap) AS diff FROM pairs JOIN pap a ON a.model = pairs.model JOIN pap b ON b.model = vs AND b.asset = a.asset AND b.fold = a.fold AND b.draw = a.draw GROUP BY 1, 2, 3, 4, 5)
SELECT asset, family, model, vs, max(diff) FILTER (WHERE draw < 0) AS dif0, quantile_cont(diff, 0.025) FILTER (WHERE draw >= 0) AS ci_low, quantile_cont(diff, 0.975) FILTER (WHERE draw >= 0) AS ci_high,
  least(greatest(2 * least(avg(CASE WHEN diff <= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE draw >= 0), avg(CASE WHEN diff >= 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE draw >= 0)), 1.0 / 1001), 1) AS p
FROM d GROUP BY 1, 2, 3, 4
""",
)
sql("bootstrap_pr_auc", "SELECT asset, family, model, vs, round(dif0, 6) AS pr_auc_diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p_boot FROM pres")

# ---- holdout, counts, declared rules -------------------------------------------------------------


def holdout(*names: str) -> None:
    """Copies of expressions, named with _h, that read each other's copies."""
    for name in names:
        text = CTES[name]
        for other in ("exc", "kup", "chr", "bas", "vbt", "elig_s", "fld", "assigned_s", "preds", "ovi", "bt"):
            text = re.sub(rf"\b{other}\b", f"{other}_h", text)
        cte(f"{name}_h", text)


cte("exc_h", "SELECT * FROM exc WHERE trade_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'")
holdout("kup", "chr", "bas", "vbt")
sql("holdout_risk", re.sub(r"\bvbt\b", "vbt_h", SQL["var_backtest"]))
cte("elig_s_h", CTES["elig_s"].replace(" AND f.as_of_date < DATE '2001-01-01'", ""))
cte("fld_h", "SELECT 'holdout_2001' AS fold, DATE '2001-01-01' AS ts, DATE '2001-12-31' AS te")
holdout("assigned_s", "preds", "ovi")
cte("bt_h", re.sub(r"\bovi\b", "ovi_h", CTES["bt"]).replace("DATE '1998-01-01' AND DATE '2000-12-31'", "DATE '2001-01-01' AND DATE '2001-12-31'"))
sql("holdout_overlay", re.sub(r"\bbt\b", "bt_h", SQL["overlay_returns"]))
sql("trial_counts", "SELECT count(DISTINCT model) AS models, count(DISTINCT (model, params)) AS configurations, count(*) AS trials, CAST(sum(splits) AS BIGINT) AS fits FROM cvs")
NOT_FINITE = " + ".join(f"count(*) FILTER (WHERE NOT isfinite({c}))" for c in FEATURES)
sql(
    "dq_model_rules",
    f"""
WITH l AS (SELECT fold, model, round(avg(pow(prob - y, 2)), 10) AS brier FROM preds GROUP BY 1, 2),
c AS (SELECT *, brier = min(brier) OVER (PARTITION BY fold) AS champion FROM l),
n AS (SELECT fold, count(*) FILTER (WHERE champion) AS n FROM c GROUP BY 1)
SELECT 'probability_in_unit_interval' AS rule, count(*) FILTER (WHERE prob < 0 OR prob > 1) AS violations FROM preds
UNION ALL SELECT 'value_finite', {NOT_FINITE} FROM feats
UNION ALL SELECT 'vintage_interval_ordered', count(*) FILTER (WHERE valid_from > valid_to) FROM mvint
UNION ALL SELECT 'one_champion', count(*) FILTER (WHERE n > 1) FROM n
UNION ALL SELECT 'some_champion', count(*) FILTER (WHERE n = 0) FROM n
""",
)
sql(
    "scan_wanted",
    """
SELECT asset, trade_date, close FROM px WHERE asset IN ('A1', 'A3', 'ZZ', 'A9')
UNION ALL SELECT w.asset, NULL, NULL FROM (VALUES ('A1'), ('A3'), ('ZZ'), ('A9')) w(asset) WHERE w.asset NOT IN (SELECT asset FROM px)
""",
)
sql(
    "dq_dropped_rows",
    """
WITH t AS (SELECT *, trade_date NOT IN (SELECT trade_date FROM cal) AS off, trade_date > (SELECT max(trade_date) FROM cal) AS late FROM px),
k AS (SELECT asset FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE late) = 0 AND count(*) FILTER (WHERE off) * 1.0 / count(*) <= 0.001)
SELECT asset, trade_date, close FROM t WHERE off AND asset IN (SELECT asset FROM k)
""",
)


def oracle() -> dict[str, str]:
    return {name: compose(text) for name, text in SQL.items()}
