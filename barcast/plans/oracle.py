"""SQL counterparts of the registered queries, for an independent engine (DuckDB dialect).

Written from the definitions, with plain whole-table windows and joins, so they
share nothing with the Spark plans.
"""

from __future__ import annotations

from html.entities import html5

HORIZON = 10
CUT = 1_706_222_700  # 2024-01-25 23:45 Europe/Berlin
VAL_CUT = CUT - 7 * 86_400
MEASURES = ["high", "low", "close", "volume"]
LISTED = "(VALUES (0,'view'),(1,'absent-1'),(3,'click'),(4,'purchase'),(6,'absent-2')) l(pos, asset)"

RAW = """raw AS (
  SELECT event_type AS "ID",
         CASE WHEN event_id % 10 = 3 THEN ts ELSE time_bucket(INTERVAL 15 MINUTES, ts) END AS "ExecutionTime",
         event_id AS seq,
         CASE WHEN value < 20 THEN 0.0::DOUBLE ELSE value END AS high,
         CASE WHEN value < 20 THEN 0.0::DOUBLE ELSE value / 2 END AS low,
         CASE WHEN event_id % 7 = 0 THEN NULL WHEN value < 20 THEN 0.0::DOUBLE ELSE value * 0.75::DOUBLE END AS "close",
         CASE WHEN value < 20 THEN 0.0::DOUBLE ELSE (user_id % 5)::DOUBLE END AS volume
  FROM events
  UNION ALL
  SELECT 'dormant', time_bucket(INTERVAL 15 MINUTES, ts), event_id,
         value * 1e-5::DOUBLE, value * 1e-5::DOUBLE, value * 1e-5::DOUBLE, 0.0::DOUBLE
  FROM events WHERE event_id % 1000 = 0)"""

DEDUP = RAW + """,
dedup AS (
  SELECT "ID" AS asset, "ExecutionTime" AS t,
         arg_max(high, seq) FILTER (WHERE high IS NOT NULL) AS high,
         arg_max(low, seq) FILTER (WHERE low IS NOT NULL) AS low,
         arg_max("close", seq) FILTER (WHERE "close" IS NOT NULL) AS "close",
         arg_max(volume, seq) FILTER (WHERE volume IS NOT NULL) AS volume
  FROM raw GROUP BY 1, 2),
bounds AS (
  SELECT (floor(epoch_us(min("ExecutionTime")) / 900000000.0) * 900)::BIGINT AS lo,
         (ceil(epoch_us(max("ExecutionTime")) / 900000000.0) * 900)::BIGINT AS hi
  FROM raw),
grid AS (SELECT unnest(range(lo, hi + 900, 900)) AS s FROM bounds)"""

BARS = DEDUP + """,
bars AS (
  SELECT a.asset, g.s, coalesce(d.high, 0.0) AS high, coalesce(d.low, 0.0) AS low,
         coalesce(d."close", 0.0) AS "close", coalesce(d.volume, 0.0) AS volume
  FROM (SELECT DISTINCT "ID" AS asset FROM raw) a
  CROSS JOIN grid g
  LEFT JOIN dedup d ON d.asset = a.asset AND epoch_us(d.t) = g.s * 1000000)"""

SPLIT = f"CASE WHEN s <= {VAL_CUT} THEN 'train' WHEN s <= {CUT} THEN 'val' ELSE 'test' END"
LAGS = ", ".join(f"lag(volume, {k}) OVER w AS f_lag{k}" for k in (1, 2, 3, 4))
HORIZONS = f"(SELECT unnest(range(1, {HORIZON + 1}))::INTEGER AS horizon)"
UNPIVOT = "SELECT {keep}, unnest(['high','low','close','volume']) AS feature, unnest([high, low, \"close\", volume]) AS v FROM {table}"


def _local(moment: str) -> str:
    return f"timezone('Europe/Berlin', timezone('UTC', {moment}))"


def _hour(moment: str) -> str:
    return f"hour({_local(moment)})::INTEGER"


def _dow(moment: str) -> str:
    return f"(isodow({_local(moment)}) - 1)::INTEGER"


def _smape(truth: str, pred: str) -> str:
    size = f"((abs({truth}) + abs({pred})) / 2.0)"
    return f"(avg(CASE WHEN {size} > 1e-8 THEN abs({pred} - {truth}) / {size} ELSE 0.0 END) * 100.0)"


LONG = BARS + ",\nlong AS (" + UNPIVOT.format(keep="asset, s", table="bars") + ")"

# Evaluation cells: origins in the last 7 days of training with a full horizon.
CELLS = LONG + f""",
last AS (SELECT asset, max(s) AS last_s FROM bars WHERE s <= {CUT} GROUP BY 1),
cells AS (
  SELECT o.asset, o.feature, o.s AS origin_s, h.horizon, o.v AS now, t.v AS truth
  FROM long o JOIN last USING (asset)
  CROSS JOIN {HORIZONS} h
  JOIN long t ON t.asset = o.asset AND t.feature = o.feature AND t.s = o.s + 900 * h.horizon
  WHERE o.s >= last_s - 604800 AND o.s + 900 * {HORIZON} <= last_s)"""

# Test cells with the persistence forecast, clamped.
FORECASTS = LONG + f""",
lagged AS (SELECT asset, s, {LAGS} FROM bars WINDOW w AS (PARTITION BY asset ORDER BY s)),
forecasts AS (
  SELECT o.asset, o.feature, o.s AS origin_s, h.horizon, o.s + 900 * h.horizon AS target_s,
         CASE WHEN abs(o.v) < 1e-3 THEN 0.0 ELSE o.v END AS pred, t.v AS truth
  FROM long o
  JOIN lagged l ON l.asset = o.asset AND l.s = o.s AND l.f_lag4 IS NOT NULL
  CROSS JOIN {HORIZONS} h
  LEFT JOIN long t ON t.asset = o.asset AND t.feature = o.feature AND t.s = o.s + 900 * h.horizon
  WHERE o.s > {CUT})"""

RESULTS = FORECASTS + f""",
results AS (
  SELECT asset, feature, horizon, {_smape('truth', 'pred')} AS "sMAPE", count(*) AS n
  FROM forecasts WHERE truth IS NOT NULL GROUP BY 1, 2, 3)"""

# Supervised long rows inside a split.
SUPERVISED = LONG + f""",
split_long AS (SELECT asset, s, feature, v, {SPLIT} AS split FROM long WHERE s <= {CUT}),
split_lags AS (
  SELECT asset, s, {LAGS} FROM (SELECT *, {SPLIT} AS split FROM bars WHERE s <= {CUT})
  WINDOW w AS (PARTITION BY asset, split ORDER BY s)),
supervised AS (
  SELECT o.asset, o.split, o.feature, h.horizon, o.s, t.v AS y
  FROM split_long o CROSS JOIN {HORIZONS} h
  JOIN split_long t ON t.asset = o.asset AND t.feature = o.feature AND t.split = o.split
                   AND t.s = o.s + 900 * h.horizon)"""

# Pooled rows: lags over bars up to the cutoff, incomplete rows dropped.
POOL = BARS + f""",
pool AS (
  SELECT * FROM (
    SELECT *, {SPLIT} AS split, {LAGS} FROM bars WHERE s <= {CUT}
    WINDOW w AS (PARTITION BY asset ORDER BY s))
  WHERE f_lag4 IS NOT NULL)"""

ZSCORE = POOL + ",\npool_long AS (" + " UNION ALL ".join(
    f"""SELECT asset, split, s, f_lag1, f_lag2, f_lag3, f_lag4, '{f}' AS feature, "{f}" AS v,
         row_number() OVER (PARTITION BY asset, split ORDER BY s) AS n FROM pool"""
    for f in ("high", "low", "close", "volume")
) + f"""),
pstats AS (
  SELECT asset, feature, avg(v) AS m, CASE WHEN stddev_samp(v) >= 1e-6 THEN stddev_samp(v) ELSE 1.0 END AS sd
  FROM pool_long WHERE split = 'train' GROUP BY 1, 2),
target AS (
  SELECT a.*, h.horizon, b.v AS y
  FROM pool_long a CROSS JOIN {HORIZONS} h CROSS JOIN pool_long b
  WHERE b.asset = a.asset AND b.split = a.split AND b.feature = a.feature AND b.n = a.n + h.horizon),
zrows AS (
  SELECT asset, split, s, feature, horizon, (f_lag1 - m) / sd AS f_lag1, (f_lag2 - m) / sd AS f_lag2,
         (f_lag3 - m) / sd AS f_lag3, (f_lag4 - m) / sd AS f_lag4, (y - m) / sd AS y_norm, y, m, sd
  FROM target JOIN pstats USING (asset, feature) WHERE y IS NOT NULL)"""

TRAIN_LONG = LONG + f",\ntrain AS (SELECT * FROM long WHERE s <= {VAL_CUT})"
ACTIVITY = TRAIN_LONG + """,
activity AS (
  SELECT asset, feature, avg(abs(v)) AS mean_abs, stddev_pop(v) AS std,
         avg(CASE WHEN abs(v) > 1e-6 THEN 1.0::DOUBLE ELSE 0.0 END) AS nonzero_frac
  FROM train GROUP BY 1, 2)"""
ACTIVE = "(mean_abs >= 0.01 OR std >= 0.01 OR nonzero_frac >= 0.05)"


def _codes(source: str, label: str) -> str:
    return (
        f"SELECT asset, (row_number() OVER (ORDER BY asset) - 1)::INTEGER AS asset_code "
        f"FROM (SELECT DISTINCT {label} AS asset FROM {source})"
    )


def _pooled_leads(window: str) -> str:
    def leads(column: str) -> str:
        fields = ", ".join(f'lead("{column}", {h}) OVER w' for h in range(1, HORIZON + 1))
        return f'unnest([{fields}]) AS "{column}"'

    return f"""SELECT asset, split, s AS t_s, unnest(range(1, {HORIZON + 1}))::INTEGER AS horizon,
         {", ".join(map(leads, ("high", "low", "close", "volume")))}
  FROM pool WINDOW w AS ({window})"""


def _pooled_target(window: str) -> str:
    return f"""WITH {POOL}
SELECT * FROM (
  {_pooled_leads(window)})
WHERE "close" IS NOT NULL"""


def _texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _older() -> str:
    """Named references that count without a semicolon, longest first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


def _profile(table: str, columns: list[tuple[str, str]]) -> str:
    rows = [
        f"SELECT {i}::INTEGER AS position, '{name}' AS column_name, '{kind}' AS column_type, "
        f"count(*) AS n_rows, count(*) - count({name}) AS n_null FROM {table}"
        for i, (name, kind) in enumerate(columns)
    ]
    return " UNION ALL ".join(rows)


def oracle() -> dict[str, str]:
    plain_lags = {
        "lags_full": ("bars", "PARTITION BY asset ORDER BY s"),
        "lags_by_split": (
            f"(SELECT *, {SPLIT} AS split FROM bars WHERE s <= {CUT})",
            "PARTITION BY asset, split ORDER BY s",
        ),
    }
    out = {
        "raw_scan": f"""WITH {RAW}
SELECT "ID", epoch_us("ExecutionTime") > {CUT}000000 AS is_test, count(*) AS n_rows, count(*) AS n_seq,
       count("close") AS n_close, min(epoch_us("ExecutionTime")) AS first_us, max(epoch_us("ExecutionTime")) AS last_us,
       round(sum(high), 4) AS sum_high
FROM raw GROUP BY 1, 2""",
        "normalize_ts": """SELECT "ID", seq, epoch_us(t) AS t_us, high, TRUE AS low_missing FROM (
  SELECT CASE WHEN event_id % 19 <> 0 THEN event_type END AS "ID", event_id AS seq, value AS high,
         try_cast(CASE WHEN event_id % 13 = 0 THEN 'not a time' WHEN event_id % 17 = 0 THEN NULL
                       ELSE ts::VARCHAR END AS TIMESTAMP) AS t
  FROM events)
WHERE "ID" IS NOT NULL AND t IS NOT NULL""",
        "bars_scan": f"""WITH {BARS}
SELECT asset, count(*) AS n_rows, max(s) AS last_s FROM bars WHERE s <= {CUT} GROUP BY 1""",
        "bars_roundtrip": f'WITH {BARS} SELECT asset, s AS t_s, high, low, "close", volume FROM bars',
        "top_n_assets": f"""WITH {RAW}
SELECT DISTINCT "ID" AS asset FROM raw ORDER BY "ID" || '.parquet' LIMIT 3""",
        "asset_allowlist": f"""WITH {RAW},
kept AS (SELECT pos, asset FROM {LISTED} WHERE asset IN (SELECT "ID" FROM raw) ORDER BY pos LIMIT 2)
SELECT asset, pos::INTEGER AS pos, count(*) AS n_rows FROM raw JOIN kept ON asset = "ID" GROUP BY 1, 2""",
        "asset_missing": f"""WITH {RAW}
SELECT asset, pos::INTEGER AS pos FROM {LISTED} WHERE asset NOT IN (SELECT "ID" FROM raw)""",
        "table_profile": _profile(
            "events",
            [
                ("event_id", "bigint"),
                ("ts", "timestamp_ntz"),
                ("user_id", "bigint"),
                ("event_type", "string"),
                ("value", "double"),
                ("props", "string"),
            ],
        ),
        "head_sample": f"""WITH {RAW}
SELECT "ID", seq, epoch_us("ExecutionTime") AS t_us, high, low, "close", volume FROM raw ORDER BY seq, "ID" LIMIT 5""",
        # A tag is cut at the first ">" outside quotes: by taking quoted runs as units, then by attribute.
        "page_links": r"""WITH plain AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                 '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g') AS html FROM pages),
names AS (SELECT map(NAMED_KEYS, NAMED_VALUES) AS named),
tags AS (
  SELECT page_id, regexp_extract_all(html, '(?i)<a[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags FROM plain),
attrs AS (
  SELECT page_id, list_transform(tags, lambda tag:
           list_filter(regexp_extract_all(tag, '[^\s/>="'']+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'),
                       lambda a: regexp_matches(a, '(?i)^href\s*='))[1]) AS hrefs FROM tags),
links AS (
  SELECT page_id, unnest(range(0, len(hrefs)))::INTEGER AS link_pos, unnest(hrefs) AS attr
  FROM (SELECT page_id, list_filter(hrefs, lambda h: h IS NOT NULL) AS hrefs FROM attrs)),
found AS (
  SELECT page_id, link_pos, list_aggregate(list_transform(
           regexp_extract_all(trim(regexp_replace(attr, '(?i)^href\s*=\s*', ''), '"'''),
                              '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|&|[^&]+'),
           lambda p: CASE WHEN regexp_matches(p, '^&#[0-9]') THEN chr(rtrim(p[3:], ';')::INTEGER)
                          WHEN regexp_matches(p, '^&#[xX]') THEN chr(('0x' || rtrim(p[4:], ';'))::INTEGER)
                          WHEN p[1] = '&' THEN coalesce(named[p[2:]], named[regexp_extract(p[2:], '^(OLDER)')] || regexp_replace(p[2:], '^(OLDER)', ''), p)
                          ELSE p END),
           'string_agg', '') AS href
  FROM links, names)
SELECT page_id, link_pos, href, ends_with(href, '.parquet') AS is_match FROM found WHERE href <> ''""".replace("NAMED_KEYS", _texts(html5)).replace("NAMED_VALUES", _texts(html5.values())).replace("OLDER", _older()),
        "grid_bounds": f"""WITH {DEDUP}
SELECT lo, hi, (SELECT count(DISTINCT "ID") FROM raw) AS n_assets, (hi - lo) // 900 + 1 AS n_slots FROM bounds""",
        "time_grid": f"""WITH {DEDUP}
SELECT asset, s AS t_s FROM (SELECT DISTINCT "ID" AS asset FROM raw) CROSS JOIN grid""",
        "dedupe_last": f'WITH {DEDUP} SELECT asset, epoch_us(t) AS t_us, high, low, "close", volume FROM dedup',
        "regular_bars": f'WITH {BARS} SELECT asset, s AS t_s, high, low, "close", volume FROM bars',
        "offgrid_rows": f"""WITH {DEDUP},
slots AS (SELECT count(*) AS n FROM grid),
marked AS (SELECT "ID" AS asset, epoch_us("ExecutionTime") AS us FROM raw),
counts AS (
  SELECT asset, count(*) AS n_rows, 0::BIGINT AS n_bad_time,
         count(*) FILTER (WHERE us % 900000000 <> 0) AS n_off_grid,
         count(*) - count(DISTINCT us) AS n_repeated,
         count(DISTINCT us) FILTER (WHERE us % 900000000 = 0) AS n_kept_slots
  FROM marked GROUP BY 1)
SELECT counts.*, slots.n - n_kept_slots AS n_filled_slots FROM counts, slots""",
        "asset_summary": f"""WITH {RAW}
SELECT "ID", count(*) AS total_count,
       count(*) FILTER (WHERE NOT (coalesce(high = 0, FALSE) AND coalesce(low = 0, FALSE)
                                   AND coalesce("close" = 0, FALSE) AND coalesce(volume = 0, FALSE))) AS nonzero_count,
       round(1.0 - count(*) FILTER (WHERE NOT (coalesce(high = 0, FALSE) AND coalesce(low = 0, FALSE)
                                   AND coalesce("close" = 0, FALSE) AND coalesce(volume = 0, FALSE)))::DOUBLE
             / count(*), 9) AS fraction_zero,
       epoch_us(min("ExecutionTime")) AS first_us, epoch_us(max("ExecutionTime")) AS last_us
FROM raw GROUP BY 1""",
        "split_counts": f"""WITH {BARS}
SELECT asset, {SPLIT} AS split, count(*) AS n_rows, min(s) AS first_s, max(s) AS last_s FROM bars GROUP BY 1, 2""",
        "eval_origins": f"""WITH {BARS},
last AS (SELECT asset, max(s) AS last_s FROM bars WHERE s <= {CUT} GROUP BY 1)
SELECT asset, s AS origin_s, last_s AS last_train_s, "close" FROM bars JOIN last USING (asset)
WHERE s >= last_s - 604800 AND s + 9000 <= last_s""",
        "eligible_assets": f"""WITH {RAW},
slots AS (SELECT DISTINCT "ID" AS asset, "ExecutionTime" AS t FROM raw),
sizes AS (
  SELECT asset, count(*) FILTER (WHERE epoch_us(t) <= {VAL_CUT}000000) AS n_train,
         count(*) FILTER (WHERE epoch_us(t) > {VAL_CUT}000000 AND epoch_us(t) <= {CUT}000000) AS n_val,
         count(*) FILTER (WHERE epoch_us(t) > {CUT}000000) AS n_test
  FROM slots GROUP BY 1)
SELECT * FROM sizes WHERE n_train + n_val >= 24 AND n_train >= 50 AND n_val >= 10""",
        "eligible_models": f"""WITH {SUPERVISED}
SELECT asset, feature, horizon, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'val') AS n_val
FROM supervised GROUP BY 1, 2, 3
HAVING count(*) FILTER (WHERE split = 'train') >= 50 AND count(*) FILTER (WHERE split = 'val') >= 10""",
        "supervised_rows": f"""WITH {SUPERVISED}
SELECT asset, split, feature, horizon, count(*) AS n_rows, count(f_lag4) AS n_lag4, round(sum(y), 4) AS sum_y,
       round(sum(y * coalesce(f_lag1, 0.0)), 6) AS sum_y_lag1
FROM supervised JOIN split_lags USING (asset, s) GROUP BY 1, 2, 3, 4""",
        "unpivot_features": f"WITH {LONG} SELECT asset, s AS t_s, feature, v AS value FROM long",
        "calendar_features": f"""WITH moments AS (
  SELECT make_timestamp(epoch_us(o_orderdate::TIMESTAMP) + (o_orderkey % 96) * 900000000) AS t FROM orders
  UNION ALL SELECT ts FROM events)
SELECT {_hour('t')} AS hour, {_dow('t')} AS dow, count(*) AS n_rows,
       min(epoch_us(t)) AS first_us, max(epoch_us(t)) AS last_us
FROM moments GROUP BY 1, 2""",
        "lags_pooled": f"WITH {POOL} SELECT asset, s AS t_s, f_lag1, f_lag2, f_lag3, f_lag4 FROM pool",
        "lags_own": f"""WITH {BARS}
SELECT asset, s AS t_s, {', '.join(f'lag("{f}", {k}) OVER w AS {f}_lag{k}' for f in MEASURES for k in (1, 2, 3, 4))}
FROM bars WINDOW w AS (PARTITION BY asset ORDER BY s)""",
        "horizon_truth": f"WITH {CELLS} SELECT * FROM cells",
        "asset_codes": f"WITH {RAW} " + _codes("raw", '"ID"'),
        "part_codes": _codes("part", "p_name"),
        "pooled_target": _pooled_target("PARTITION BY split ORDER BY asset || '.parquet', s"),
        "asset_target": _pooled_target("PARTITION BY asset, split ORDER BY s"),
        "train_stats": f"""WITH {TRAIN_LONG}
SELECT asset, feature, round(avg(v), 6) AS mean,
       round(CASE WHEN stddev_samp(v) >= 1e-6 THEN stddev_samp(v) ELSE 1.0 END, 6) AS std
FROM train GROUP BY 1, 2""",
        "activity_stats": f"""WITH {ACTIVITY}
SELECT asset, feature, round(mean_abs, 8) AS mean_abs, round(std, 8) AS std,
       round(nonzero_frac, 8) AS nonzero_frac FROM activity""",
        "activity_flags": f"WITH {ACTIVITY} SELECT asset, feature, {ACTIVE} AS is_active FROM activity",
        "class_balance": f"""WITH {SUPERVISED},
counts AS (
  SELECT asset, feature, horizon, count(*) AS n, count(*) FILTER (WHERE abs(y) > 1e-6) AS n_nonzero
  FROM supervised WHERE split = 'train' GROUP BY 1, 2, 3)
SELECT *, n_nonzero > 5 AND n_nonzero < n - 5 AS has_gate FROM counts""",
        "describe_features": f"""WITH {POOL},
cal AS (SELECT *, {_hour('make_timestamp(s * 1000000)')} AS hour, {_dow('make_timestamp(s * 1000000)')} AS dow FROM pool)
"""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM cal"
            for c in ("f_lag1", "f_lag2", "f_lag3", "f_lag4", "hour", "dow")
        ),
        "zscore_features": f"""WITH {ZSCORE}
SELECT asset, s AS t_s, feature, horizon, round(f_lag1, 6) AS f_lag1, round(f_lag2, 6) AS f_lag2, round(f_lag3, 6) AS f_lag3,
       round(f_lag4, 6) AS f_lag4, round(y_norm, 6) AS y_norm FROM zrows""",
        "zscore_roundtrip": f"""WITH {ZSCORE}
SELECT asset, split, feature, horizon, count(*) AS n_rows, count(*) FILTER (WHERE abs(y_norm * sd + m - y) > 1e-9) AS n_off,
       round(sum(y_norm * sd + m), 4) AS sum_back FROM zrows GROUP BY 1, 2, 3, 4""",
        "sample_weights": f"""WITH {ZSCORE}
SELECT asset, split, feature, horizon, round(sum(abs(y_norm) + 1e-6), 4) AS sum_weight, round(min(abs(y_norm) + 1e-6), 6) AS min_weight
FROM zrows GROUP BY 1, 2, 3, 4""",
        "nonzero_labels": f"""WITH {ZSCORE}
SELECT asset, split, feature, horizon, count(*) AS n_rows, count(*) FILTER (WHERE abs(y_norm * sd + m) > 1e-8) AS n_nonzero
FROM zrows GROUP BY 1, 2, 3, 4""",
        "pooled_rows": f"""WITH {ZSCORE},
shared AS (
  SELECT asset, split, unnest(['high','low','close','volume']) AS feature, horizon, unnest([high, low, "close", volume]) AS y
  FROM ({_pooled_leads("PARTITION BY split ORDER BY asset || '.parquet', s")}) WHERE "close" IS NOT NULL)
SELECT feature, horizon, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
       count(*) FILTER (WHERE split = 'train' AND abs((y - m) / sd * sd + m) > 1e-8) AS n_nonzero,
       round(sum(abs((y - m) / sd) + 1e-6) FILTER (WHERE split = 'train'), 4) AS sum_weight
FROM shared JOIN pstats USING (asset, feature) GROUP BY 1, 2""",
        "skipped_files": f"""WITH {BARS}
SELECT asset, count(*) AS n_rows, 'no readable footer' AS error, 2::BIGINT AS n_skipped FROM bars GROUP BY 1""",
        "raw_by_id_roundtrip": f"""WITH {RAW}, twice AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE "close" IS NOT NULL)
SELECT "ID", count(*) AS n_rows, count("close") AS n_close, round(sum(high), 4) AS sum_high FROM twice GROUP BY 1""",
        "forecasts_csv": f"""WITH {FORECASTS}
SELECT asset, feature, horizon, count(*) AS n_rows, round(sum(pred), 4) AS sum_pred FROM forecasts GROUP BY 1, 2, 3""",
        "refit_partial": f"""WITH {FORECASTS}
SELECT asset, feature, horizon, count(*) AS n_rows, count(truth) AS n_truth,
       round(sum(CASE WHEN asset = 'view' THEN -1.0::DOUBLE ELSE pred END), 4) AS sum_pred
FROM forecasts WHERE asset <> 'click' GROUP BY 1, 2, 3""",
        "refit_cells": f"WITH {FORECASTS} SELECT asset, feature, origin_s, horizon, target_s, truth FROM forecasts",
        "per_asset_rows": f"""WITH {SUPERVISED},
activity AS (
  SELECT asset, feature, avg(abs(v)) AS mean_abs, stddev_pop(v) AS std,
         avg(CASE WHEN abs(v) > 1e-6 THEN 1.0::DOUBLE ELSE 0.0 END) AS nonzero_frac
  FROM split_long WHERE split = 'train' GROUP BY 1, 2)
SELECT asset, feature, horizon, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val
FROM supervised JOIN activity USING (asset, feature) WHERE {ACTIVE} GROUP BY 1, 2, 3
HAVING count(*) FILTER (WHERE split = 'train') >= 50 AND count(*) FILTER (WHERE split = 'val') >= 10""",
        "lags_gapped": f"""WITH {DEDUP}
SELECT asset, epoch_us(t) AS t_us, {LAGS} FROM dedup WINDOW w AS (PARTITION BY asset ORDER BY t)""",
        "truth_gapped": f"""WITH {DEDUP},
uneven AS (SELECT asset, epoch_us(t) AS us, high, low, "close", volume, {LAGS} FROM dedup WHERE epoch_us(t) % 900000000 = 0 WINDOW w AS (PARTITION BY asset ORDER BY t)),
cells AS (
  SELECT asset, us, f_lag1, f_lag2, f_lag3, f_lag4, unnest(['high','low','close','volume']) AS feature, unnest([high, low, "close", volume]) AS v FROM uneven)
SELECT o.asset, o.feature, o.us AS origin_us, h.horizon,
       CASE WHEN o.v IS NULL OR abs(o.v) < 1e-3 THEN 0.0 ELSE o.v END AS pred, t.v AS truth
FROM cells o CROSS JOIN {HORIZONS} h
LEFT JOIN cells t ON t.asset = o.asset AND t.feature = o.feature AND t.us = o.us + 900000000::BIGINT * h.horizon
WHERE o.us > {CUT}000000 AND o.f_lag1 IS NOT NULL AND o.f_lag2 IS NOT NULL AND o.f_lag3 IS NOT NULL AND o.f_lag4 IS NOT NULL
  AND o.asset IN (SELECT asset FROM uneven WHERE us <= {CUT}000000 GROUP BY 1 HAVING count(*) >= 24)""",
        "pooled_target_gapped": f"""WITH {DEDUP},
part AS (SELECT asset, epoch_us(t) AS us, high, low, "close", volume, {LAGS},
                CASE WHEN epoch_us(t) <= {VAL_CUT}000000 THEN 'train' ELSE 'val' END AS split, count(*) OVER (PARTITION BY asset) AS n
         FROM dedup WHERE epoch_us(t) <= {CUT}000000 WINDOW w AS (PARTITION BY asset ORDER BY t)),
pool AS (SELECT *, us AS s FROM part
         WHERE n >= 24 AND high + low + "close" + volume + f_lag1 + f_lag2 + f_lag3 + f_lag4 IS NOT NULL)
SELECT asset, split, t_s AS t_us, horizon, high, low, "close", volume
FROM ({_pooled_leads("PARTITION BY split ORDER BY asset || '.parquet', s")}) WHERE "close" IS NOT NULL""",
        "median_skewed": """SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
       round(median(CASE WHEN event_id % 2 = 0 THEN 50.0::DOUBLE ELSE value END), 6) AS median_value FROM events GROUP BY 1""",
        "worst_assets_users": f"""WITH rows_ AS (
  SELECT user_id::VARCHAR AS asset, CASE WHEN value >= 20 THEN value ELSE 0.0::DOUBLE END AS truth, ts, event_id FROM events),
led AS (SELECT asset, truth, lag(truth) OVER (PARTITION BY asset ORDER BY ts, event_id) AS pred FROM rows_),
scores AS (SELECT asset, {_smape('truth', 'pred')} AS m FROM led WHERE pred IS NOT NULL GROUP BY 1)
SELECT asset, round(m, 6) AS "mean_sMAPE" FROM scores ORDER BY m DESC, asset LIMIT 20""",
        "asset_summary_users": """SELECT user_id::VARCHAR AS "ID", count(*) AS total_count, count(*) FILTER (WHERE value >= 20) AS nonzero_count,
       round(1.0 - count(*) FILTER (WHERE value >= 20)::DOUBLE / count(*), 9) AS fraction_zero,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1""",
        "gate_and_threshold": f"""WITH {BARS},
cal AS (SELECT *, {_hour('make_timestamp(s * 1000000)')} AS hour, {_dow('make_timestamp(s * 1000000)')} AS dow FROM bars),
gated AS (
  SELECT asset, s, CASE WHEN dow = 2 OR dow <> 6 AND hour / 23.0 < 0.5 THEN 0.0 ELSE "close" / 40000 END AS p FROM cal)
SELECT asset, s AS t_s, round(CASE WHEN abs(p) < 1e-3 THEN 0.0 ELSE p END, 12) AS pred FROM gated""",
        "baseline_zero": f"""WITH {CELLS}
SELECT asset, feature, origin_s, horizon, truth, 0.0::DOUBLE AS pred FROM cells""",
        "baseline_persistence": f"""WITH {CELLS}
SELECT asset, feature, origin_s, horizon, truth, now AS pred FROM cells""",
        "forecast_frame": f"WITH {FORECASTS} SELECT * FROM forecasts",
        "inactive_eval": f"""WITH {SUPERVISED},
activity AS (
  SELECT asset, feature, avg(abs(v)) AS mean_abs, stddev_pop(v) AS std,
         avg(CASE WHEN abs(v) > 1e-6 THEN 1.0::DOUBLE ELSE 0.0 END) AS nonzero_frac
  FROM split_long WHERE split = 'train' GROUP BY 1, 2),
quiet AS (SELECT asset, feature FROM activity WHERE NOT {ACTIVE})
SELECT asset, feature, horizon,
       round(avg(CASE WHEN abs(y) / 2.0 > 1e-8 THEN 2.0::DOUBLE ELSE 0.0 END) FILTER (WHERE split = 'val') * 100.0, 6) AS "sMAPE",
       count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val
FROM supervised JOIN quiet USING (asset, feature) GROUP BY 1, 2, 3""",
        "smape_unit": f"""WITH {RAW}
SELECT "ID", round({_smape('"close"', 'low')}, 6) AS "sMAPE", count(*) AS n_cells FROM raw GROUP BY 1""",
        "baseline_results": f"""WITH {CELLS}
SELECT asset, feature, 'zero' AS baseline, round({_smape('truth', '0.0')}, 6) AS "sMAPE" FROM cells GROUP BY 1, 2
UNION ALL
SELECT asset, feature, 'persistence', round({_smape('truth', 'now')}, 6) FROM cells GROUP BY 1, 2""",
        "forecast_eval": f"""WITH {RESULTS}
SELECT asset, feature, horizon, round("sMAPE", 6) AS "sMAPE", n FROM results""",
        "eval_summary": f"""WITH {RESULTS}
SELECT feature, horizon, round(avg("sMAPE"), 6) AS "mean_sMAPE", round(median("sMAPE"), 6) AS "median_sMAPE",
       count(*) AS n_assets, sum(n)::BIGINT AS n_rows FROM results GROUP BY 1, 2""",
        "worst_assets": f"""WITH {RESULTS}
SELECT asset, round(avg("sMAPE"), 6) AS "mean_sMAPE" FROM results GROUP BY 1 ORDER BY avg("sMAPE") DESC, asset LIMIT 20""",
    }
    for name, (source, window) in plain_lags.items():
        out[name] = f"WITH {BARS} SELECT asset, s AS t_s, {LAGS} FROM {source} WINDOW w AS ({window})"
    out["stream_summary"], out["results_csv"] = out["asset_summary"], out["baseline_results"]
    return out
