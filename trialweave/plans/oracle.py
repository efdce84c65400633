"""SQL for DuckDB of the shared relations; each query's text puts its own select after those it needs."""

from __future__ import annotations

BOUNDARY = "dataset_id, participant_id, task_family, block_raw"

TRIALS = """trials AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, participant_id, task_family, block_raw ORDER BY ts, observation_id) AS trial_raw FROM (
SELECT event_id AS observation_id, user_id % 12 AS dataset_id, (user_id % 12) || ':' || user_id AS participant_id,
  CASE (user_id % 12) % 3 WHEN 0 THEN 'Stroop' WHEN 1 THEN 'Flanker' ELSE 'Simon' END AS task_family,
  CAST(CASE WHEN day(ts) <= 2 THEN -999 ELSE (day(ts) - 1) // 15 END AS BIGINT) AS block_raw, ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'congruent' WHEN event_type IN ('error', 'purchase') THEN 'incongruent' WHEN k < 90 THEN 'neutral' ELSE 'unknown' END AS congruency,
  CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS correct, CASE WHEN k % 25 = 7 THEN NULL ELSE 100 + 10 * value END AS rt_ms
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))"""

FLAGS = """f1 AS (SELECT *, rt_ms IS NULL AS rt_missing, block_raw < 0 AS practice_block, coalesce(rt_ms < 150, false) AS rt_below_min, coalesce(rt_ms > 3000, false) AS rt_above_max,
  median(rt_ms) OVER (PARTITION BY dataset_id, participant_id) AS participant_rt_median_ms FROM trials),
f2 AS (SELECT *, median(abs(rt_ms - participant_rt_median_ms)) OVER (PARTITION BY dataset_id, participant_id) AS participant_rt_mad_ms FROM f1),
f3 AS (SELECT *, coalesce(participant_rt_mad_ms > 0 AND abs(rt_ms - participant_rt_median_ms) > 3 * participant_rt_mad_ms, false) AS rt_robust_outlier FROM f2),
f4 AS (SELECT *, rt_missing OR rt_below_min OR rt_above_max OR rt_robust_outlier AS rt_excluded FROM f3),
f5 AS (SELECT *, NOT rt_excluded AS valid_rt, rt_missing AS lapse_proxy, quantile_cont(CASE WHEN NOT rt_excluded THEN rt_ms END, 0.9) OVER (PARTITION BY dataset_id, participant_id) AS participant_rt_q90_ms FROM f4),
flags AS (SELECT *, coalesce(valid_rt AND rt_ms > participant_rt_q90_ms, false) AS slow_tail_sensitivity, coalesce(valid_rt AND correct = 0 AND rt_ms < 250, false) AS fast_error,
  valid_rt AND correct = 1 AS valid_correct_rt, NOT practice_block AS analysis_eligible_trial FROM f5)"""

MEMBERS = f"""m1 AS (SELECT *, row_number() OVER (PARTITION BY {BOUNDARY} ORDER BY trial_raw ASC NULLS LAST, observation_id ASC NULLS LAST) - 1 AS rn, count(*) OVER (PARTITION BY {BOUNDARY}) AS n
  FROM flags WHERE analysis_eligible_trial),
m2 AS (SELECT m1.*, window_size, rn // window_size AS window_index FROM m1, (VALUES (16), (12), (24)) AS s(window_size)),
m3 AS (SELECT *, window_index < n // window_size AS is_full FROM m2),
m4 AS (SELECT *, CASE WHEN is_full THEN 'full' ELSE 'aggregate_remainder' END AS window_kind, CASE WHEN is_full THEN window_size ELSE n % 16 END AS len
  FROM m3 WHERE is_full OR (window_size = 16 AND n % 16 >= 8)),
members AS (SELECT *, rn % window_size AS position, is_full AS dynamics_eligible, (rn % window_size) / greatest(len - 1, 1) AS fraction,
  concat_ws(':', task_family, dataset_id, participant_id, block_raw, window_size, window_index, window_kind) AS window_id FROM m4)"""

SUMMARY = """s1 AS (SELECT *, lag(correct) OVER w AS before, abs(rt_ms - lag(rt_ms) OVER w) AS step, valid_correct_rt AND rt_ms IS NOT NULL AS v FROM members WINDOW w AS (PARTITION BY window_id ORDER BY position)),
s2 AS (SELECT window_id, dataset_id, participant_id, task_family, block_raw, window_size, window_index, window_kind, dynamics_eligible, count(*) AS n_trials,
  count(*) FILTER (valid_rt) AS n_valid_rt, count(*) FILTER (valid_correct_rt) AS n_valid_correct_rt, avg(correct) AS accuracy,
  median(rt_ms) FILTER (v) AS median_rt_ms, avg(rt_ms) FILTER (v) AS mean_rt_ms, stddev_samp(rt_ms) FILTER (v) AS sd_rt_ms,
  avg(lapse_proxy::INT) AS nonresponse_rate, avg(slow_tail_sensitivity::INT) AS slow_tail_rate, avg(fast_error::INT) AS fast_error_rate, avg(rt_excluded::INT) AS rt_excluded_fraction,
  avg(step) AS rt_volatility, CASE WHEN count(rt_ms) >= 3 THEN regr_slope(rt_ms, position) END AS rt_drift, CASE WHEN count(correct) >= 3 THEN regr_slope(1 - correct, position) END AS error_drift,
  count(*) FILTER (v AND congruency = 'congruent') AS n_con_rt, count(*) FILTER (v AND congruency = 'incongruent') AS n_inc_rt,
  count(correct) FILTER (congruency = 'congruent') AS n_con_acc, count(correct) FILTER (congruency = 'incongruent') AS n_inc_acc,
  avg(rt_ms) FILTER (v AND congruency = 'congruent') AS con_rt, avg(rt_ms) FILTER (v AND congruency = 'incongruent') AS inc_rt,
  avg(correct) FILTER (congruency = 'congruent') AS con_acc, avg(correct) FILTER (congruency = 'incongruent') AS inc_acc,
  count(*) FILTER (v AND before = 0) AS pes_post_error_n, count(*) FILTER (v AND before = 1) AS pes_post_correct_n,
  avg(rt_ms) FILTER (v AND before = 0) AS post_error_rt, avg(rt_ms) FILTER (v AND before = 1) AS post_correct_rt,
  count(*) FILTER (correct = 0) AS n_errors, count(*) FILTER (correct = 0 AND before = 0) AS error_pairs
  FROM s1 GROUP BY ALL),
s3 AS (SELECT *, least(n_con_rt, n_inc_rt, n_con_acc, n_inc_acc) >= 3 AS control_cost_supported, pes_post_error_n >= 1 AND pes_post_correct_n >= 3 AS pes_supported FROM s2),
summary AS (SELECT *, CASE WHEN mean_rt_ms > 0 THEN sd_rt_ms / mean_rt_ms END AS rt_cv, CASE WHEN median_rt_ms > 0 THEN accuracy / (median_rt_ms / 1000) END AS throughput_proxy,
  CASE WHEN control_cost_supported THEN inc_rt - con_rt END AS control_cost_rt_ms, CASE WHEN control_cost_supported THEN con_acc - inc_acc END AS control_cost_acc,
  CASE WHEN pes_supported THEN post_error_rt - post_correct_rt END AS post_error_slowing_ms,
  CASE WHEN n_trials >= 2 THEN CASE WHEN n_errors = 0 THEN 0.0 ELSE error_pairs / ((n_trials - 1) * (n_errors / n_trials) * (n_errors / n_trials)) END END AS error_burstiness FROM s3)"""

_DELTAS = {"delta_throughput": "throughput_proxy", "delta_accuracy": "accuracy", "delta_rt_cv": "rt_cv", "delta_interference_rt_cost": "control_cost_rt_ms"}
_NEXTS = {"next_accuracy": "accuracy", "next_throughput": "throughput_proxy", "next_rt_cv": "rt_cv", "next_error_burstiness": "error_burstiness"}

TRANSITIONS = f"""t1 AS (SELECT *, coalesce(lag(window_index) OVER w = window_index - 1, false) AS has_previous_window, coalesce(lead(window_index) OVER w = window_index + 1, false) AS has_next_window,
  lead(window_id) OVER w AS nid, {", ".join(f"lag({s}) OVER w AS l_{d}" for d, s in _DELTAS.items())}, {", ".join(f"lead({s}) OVER w AS l_{d}" for d, s in _NEXTS.items())}
  FROM summary WINDOW w AS (PARTITION BY {BOUNDARY}, window_size ORDER BY window_index)),
t2 AS (SELECT *, CASE WHEN has_next_window THEN nid END AS next_window_id, {", ".join(f"CASE WHEN has_previous_window THEN {s} - l_{d} END AS {d}" for d, s in _DELTAS.items())},
  {", ".join(f"CASE WHEN has_next_window THEN l_{d} END AS {d}" for d, s in _NEXTS.items())} FROM t1),
t3 AS (SELECT *, {", ".join(f"CASE WHEN NOT has_previous_window THEN 'no_previous_window' WHEN {d} IS NULL THEN 'source_metric_unavailable' END AS missing_reason_{d}" for d in _DELTAS)},
  {", ".join(f"CASE WHEN NOT has_next_window THEN 'no_next_window' WHEN {d} IS NULL THEN 'next_metric_unavailable' END AS missing_reason_{d}" for d in _NEXTS)},
  {", ".join(f"{d} - {s} AS {d.replace('next_', 'change_')}" for d, s in _NEXTS.items())},
  {", ".join(f"quantile_cont({d}, 0.75) OVER g - quantile_cont({d}, 0.25) OVER g AS iqr_{d}, median({d}) OVER g AS med_{d}, stddev_samp({d}) OVER g AS sd_{d}" for d in _DELTAS)}
  FROM t2 WINDOW g AS (PARTITION BY dataset_id, task_family, window_size)),
t4 AS (SELECT *, {", ".join(f"({d} - med_{d}) / CASE WHEN iqr_{d} > 0 THEN iqr_{d} WHEN sd_{d} > 0 THEN sd_{d} END AS {d}_z" for d in _DELTAS)} FROM t3),
t5 AS (SELECT *, {" + ".join(f"({d}_z IS NOT NULL)::INT" for d in _DELTAS)} AS parts, {" + ".join(f"coalesce({d}_z * {d}_z, 0)" for d in _DELTAS)} AS squares FROM t4),
t6 AS (SELECT *, CASE WHEN parts >= 3 THEN sqrt(squares / parts) END AS combined_update_magnitude FROM t5),
transitions AS (SELECT *, CAST(combined_update_magnitude >= quantile_cont(combined_update_magnitude, 0.9) OVER (PARTITION BY dataset_id, task_family, window_size) AS INT) AS large_update_window FROM t6)"""

SESSIONS = """sessions AS (SELECT o_custkey AS participant_id, CAST(year(o_orderdate) AS INT) AS session_year, min(o_orderdate::DATE) AS session_date, count(*) AS n_orders, avg(o_totalprice) AS speed,
  stddev_samp(o_totalprice) AS spread, avg(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS urgent, avg(o_totalprice) FILTER (o_orderpriority LIKE '5%') AS low,
  avg((o_orderstatus = 'F')::INT) AS accuracy, 's' || (year(o_orderdate) % 3) AS session_type FROM orders GROUP BY o_custkey, year(o_orderdate))"""

RR = """rr AS (SELECT l_suppkey AS participant_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
  CASE WHEN l_linenumber = 7 THEN 200 + 4 * l_quantity ELSE 700 + 4 * l_quantity END AS rr_ms FROM lineitem)"""


def rr_windows(seconds: int) -> str:
    ms = 1000.0 * seconds
    return f"""rw1 AS (SELECT *, sum(rr_ms) OVER (PARTITION BY participant_id ORDER BY pos) AS end_ms, sum(rr_ms) OVER (PARTITION BY participant_id) AS total_ms FROM rr),
rrw AS (SELECT *, CAST(ceil(end_ms / {ms}) - 1 AS BIGINT) AS window_index FROM rw1 WHERE CAST(ceil(end_ms / {ms}) - 1 AS BIGINT) < floor(total_ms / {ms}))"""


_ORDER = [("trials", TRIALS), ("flags", FLAGS), ("members", MEMBERS), ("summary", SUMMARY), ("transitions", TRANSITIONS)]


def upto(name: str, select: str, *more: str) -> str:
    """``select`` after the chain of relations up to ``name`` and ``more`` of one's own."""
    parts = []
    for n, text in _ORDER:
        parts.append(text)
        if n == name:
            break
    return f"WITH {', '.join([*parts, *more])}\n{select}"


def matched(key: str, points: str, tolerance: float) -> str:
    """Greedy one-to-one matches of the two sides of ``points`` (key, side, t), a step of two pointers a round."""
    return f"""WITH RECURSIVE lists AS (SELECT {key}, list(t ORDER BY t) FILTER (side = 0) AS a, list(t ORDER BY t) FILTER (side = 1) AS b FROM ({points}) GROUP BY 1),
s AS (SELECT {key}, 1 AS i, 1 AS j, 0 AS m FROM lists UNION ALL SELECT {key}, CASE WHEN hit OR gap < 0 THEN i + 1 ELSE i END, CASE WHEN hit OR gap >= 0 THEN j + 1 ELSE j END, m + hit::INT
  FROM (SELECT *, abs(gap) <= {tolerance} AS hit FROM (SELECT s.*, a[i] - b[j] AS gap FROM s JOIN lists USING ({key}) WHERE i <= len(a) AND j <= len(b))))
SELECT {key}, max(m) AS matched, {r6('max(m) / greatest(len(coalesce(any_value(a), [])), len(coalesce(any_value(b), []))) AS concordance')} FROM s JOIN lists USING ({key}) GROUP BY 1"""


def over(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{select}"


def r6(*columns: str) -> str:
    """Columns rounded to six places, without a negative zero."""
    out = []
    for c in columns:
        e, _, name = c.rpartition(" AS ") if " AS " in c else (c, "", c)
        out.append(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {name}")
    return ", ".join(out)
