"""Queries over the trial table: projections, flags, windows, summaries, transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import clip, mean_where, null_nan, quantile, quantiles, row_mean, row_rms, safe_div, spread_z, with_spreads, zscore
from trialweave.operators import cleaning, statistics as st, summary, windows
from trialweave.plans.oracle import BOUNDARY as B_SQL, over, r6, upto, SESSIONS
from trialweave.plans.staging import staged
from trialweave.sources import tables
from trialweave.sources.tables import BOUNDARY, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ID = ["observation_id"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return add


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return tables.trials(spark, sf)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.flag_trials(trials(spark, sf))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return windows.trial_windows(flagged(spark, sf).filter("analysis_eligible_trial"))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return summary.window_summary(members(spark, sf))


def linked(spark: SparkSession, sf: str) -> DataFrame:
    return windows.transitions(summaries(spark, sf))


# --- flags -----------------------------------------------------------------------------------------------------------------------------------------------------------

_FLAGS = {
    "CLN01": ["rt_missing", "practice_block", "rt_below_min", "rt_above_max"], "CLN02": ["participant_rt_median_ms"], "CLN03": ["participant_rt_mad_ms"], "CLN04": ["rt_robust_outlier"],
    "CLN05": ["rt_excluded", "valid_rt", "valid_correct_rt", "analysis_eligible_trial"], "CLN06": ["lapse_proxy"], "CLN07": ["participant_rt_q90_ms", "slow_tail_sensitivity"], "CLN08": ["fast_error"],
    "WIN01": ["participant_rt_median_ms", "participant_rt_mad_ms", "participant_rt_q90_ms"], "PRJ20": ["rt_excluded", "rt_missing"],
}
for _name, _cols in _FLAGS.items():
    query(_name, upto("flags", f"SELECT observation_id, {', '.join(r6(c) if c.endswith('_ms') else c for c in _cols)} FROM flags"))(lambda spark, sf, _cols=_cols: flagged(spark, sf).select(*ID, *_cols))

# --- projections -----------------------------------------------------------------------------------------------------------------------------------------------------

_TASK = "CASE WHEN lower(p_name) LIKE '%ring%' THEN 'Stroop' WHEN lower(p_name) LIKE '%widget%' THEN 'Flanker' WHEN lower(p_name) LIKE '%bolt%' THEN 'Simon' END"


@query("PRJ01", f"SELECT p_partkey, {_TASK} AS task_family FROM part")
def prj01(spark, sf):
    """Family by substring of a name, the first that matches."""
    return table(spark, sf, "part").select("p_partkey", task_family("p_name", {"ring": "Stroop", "widget": "Flanker", "bolt": "Simon"}).alias("task_family"))


def task_family(column: str, names: dict[str, str]):
    out = None
    for part, family in names.items():
        hit = F.lower(column).contains(part)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def control_cost_type(family):
    return F.when(family.isin("Stroop", "Simon"), "interference").when(family == "Flanker", "conflict")


@query("PRJ02", upto("trials", "SELECT observation_id, CASE WHEN task_family IN ('Stroop', 'Simon') THEN 'interference' WHEN task_family = 'Flanker' THEN 'conflict' END AS control_cost_type FROM trials"))
def prj02(spark, sf):
    return trials(spark, sf).select(*ID, control_cost_type(F.col("task_family")).alias("control_cost_type"))


def congruency(value):
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "congruent"), "congruent").when(v.isin("2", "incongruent"), "incongruent").when(v.isin("3", "neutral"), "neutral").otherwise("unknown")


@query("PRJ03", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'congruent' WHEN l_linenumber = 2 THEN 'incongruent' WHEN l_linenumber = 3 THEN 'neutral' ELSE 'unknown' END AS congruency FROM lineitem")
def prj03(spark, sf):
    raw = F.concat(F.lit(" "), F.when(F.col("l_linenumber") == 1, "Congruent").otherwise(F.col("l_linenumber").cast("string")), F.lit(" "))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", congruency(raw).alias("congruency"))


def accuracy(value):
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "true", "correct"), 1).when(v.isin("0", "false", "incorrect"), 0)


@query("PRJ04", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS correct FROM orders")
def prj04(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", " 0").otherwise("n/a")
    return table(spark, sf, "orders").select("o_orderkey", accuracy(raw).alias("correct"))


@query("PRJ05", f"SELECT event_id, {r6('value AS rt_raw', 'value * 1000.0 AS rt_ms')} FROM events")
def prj05(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("value").alias("rt_raw"), (F.col("value") * 1000.0).alias("rt_ms"))


@query("PRJ06", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE ' ' || event_id || ' ' END AS block_text, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS INT) END AS block_raw FROM events")
def prj06(spark, sf):
    """A blank block is missing, not 0; its text stays."""
    text = F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    return table(spark, sf, "events").select("event_id", text.alias("block_text"), F.nullif(F.trim(text), F.lit("")).try_cast("int").alias("block_raw"))


@query("PRJ07", upto("trials", "SELECT observation_id, dataset_id || ':' || participant_id AS composite_id FROM trials"))
def prj07(spark, sf):
    return trials(spark, sf).select(*ID, F.concat(F.col("dataset_id").cast("string"), F.lit(":"), "participant_id").alias("composite_id"))


@query("PRJ08", "SELECT n_nationkey, 'extract-1' AS release FROM nation")
def prj08(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.lit("extract-1").alias("release"))


@query("PRJ09", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%bolt%'")
def prj09(spark, sf):
    name = F.lower("p_name")
    return table(spark, sf, "part").filter(name.like("%ring%") | name.like("%widget%") | name.like("%bolt%")).select("p_partkey", "p_name")


@query("PRJ10", upto("trials", "SELECT observation_id, CASE WHEN block_raw < 0 THEN 'missing_block' WHEN congruency = 'unknown' THEN 'unknown_congruency' WHEN rt_ms IS NULL THEN 'unknown_accuracy' END AS mapping_issue FROM trials"))
def prj10(spark, sf):
    issue = F.when(F.col("block_raw") < 0, "missing_block").when(F.col("congruency") == "unknown", "unknown_congruency").when(F.col("rt_ms").isNull(), "unknown_accuracy")
    return trials(spark, sf).select(*ID, issue.alias("mapping_issue"))


@query("PRJ11", upto("trials", """SELECT dataset_id, count(DISTINCT participant_id) >= 2 AS enough_participants, avg((rt_ms IS NULL)::INT) <= 0.1 AS rt_complete, bool_or(congruency = 'congruent') AND bool_or(congruency = 'incongruent') AS has_conditions,
  count(DISTINCT block_raw) >= 2 AS has_blocks FROM trials GROUP BY dataset_id"""))
def prj11(spark, sf):
    c = F.col("congruency")
    return trials(spark, sf).groupBy("dataset_id").agg(
        (F.count_distinct("participant_id") >= 2).alias("enough_participants"), (F.avg(F.col("rt_ms").isNull().cast("int")) <= 0.1).alias("rt_complete"),
        (F.bool_or(c == "congruent") & F.bool_or(c == "incongruent")).alias("has_conditions"), (F.count_distinct("block_raw") >= 2).alias("has_blocks"),
    )


@query("PRJ12", f"SELECT p_partkey, {r6('try_cast(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS DOUBLE) AS size')} FROM part")
def prj12(spark, sf):
    """Text that isn't a number is missing."""
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.try_cast("double").alias("size"))


@query("PRJ13", "SELECT event_id, event_type IN ('error') OR event_id % 7 = 0 AS documented_nonresponse FROM events")
def prj13(spark, sf):
    e = table(spark, sf, "events").withColumns({"timeout": F.when(F.col("event_type") == "error", "Timeout").otherwise("no"), "no_response": F.when(F.col("event_id") % 7 == 0, "TRUE")})
    return e.select("event_id", cleaning.documented_nonresponse(e).alias("documented_nonresponse"))


def session_hour(text):
    """Hours with their fraction of a clock time; NULL for what can't be read."""
    t = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), text), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


@query("PRJ14", f"SELECT event_id, {r6('CASE WHEN event_id % 10 <> 0 THEN hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 END AS session_hour')} FROM events")
def prj14(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, "did not participate").otherwise(F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", session_hour(text).alias("session_hour"))


@query("PRJ15", f"SELECT event_id, {r6('sin(2 * pi() * hour(ts) / 24) AS hour_sin', 'cos(2 * pi() * hour(ts) / 24) AS hour_cos')} FROM events")
def prj15(spark, sf):
    angle = 2 * F.pi() * F.hour("ts") / 24
    return table(spark, sf, "events").select("event_id", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"))


@query("PRJ16", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE year(o_orderdate) < 2000")
def prj16(spark, sf):
    """MMDDYY written as a whole number, so without a leading zero; years are of this century, put back by one for the sample."""
    code = F.date_format("o_orderdate", "MMddyy").cast("int")
    day = F.to_date(F.lpad(code.cast("string"), 6, "0"), "MMddyy")
    day = F.add_months(day, F.when(F.year(day) > F.lit(2069), F.lit(-1200)).otherwise(F.lit(0)))
    orders = table(spark, sf, "orders").filter(F.year("o_orderdate") < 2000)
    return orders.select(F.add_months(day, F.when(F.year(day) >= 2000, F.lit(-1200)).otherwise(F.lit(0))).cast("string").alias("day")).distinct()


@query("PRJ17", "SELECT o_orderkey, o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || o_orderkey AS raw_session_id FROM orders")
def prj17(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(":"), F.col("o_orderkey").cast("string")).alias("raw_session_id"))


@query("PRJ18", f"SELECT c_custkey, {r6('greatest(least(c_acctbal / 1000, 5), -5) AS clipped')} FROM customer")
def prj18(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clip(F.col("c_acctbal") / 1000, -5.0, 5.0).alias("clipped"))


@query("PRJ19", over(f"SELECT participant_id, session_year, {r6('list_avg([speed, urgent, low]) AS mean3', 'CASE WHEN (urgent IS NOT NULL)::INT + (low IS NOT NULL)::INT >= 1 THEN sqrt((coalesce(urgent * urgent, 0) + coalesce(low * low, 0)) / ((urgent IS NOT NULL)::INT + (low IS NOT NULL)::INT)) END AS rms2')}, (urgent IS NOT NULL)::INT + (low IS NOT NULL)::INT AS present FROM sessions", SESSIONS))
def prj19(spark, sf):
    s = tables.sessions(spark, sf)
    u, low = F.col("urgent"), F.col("low")
    return s.select("participant_id", "session_year", row_mean([F.col("speed"), u, low]).alias("mean3"), row_rms([u, low]).alias("rms2"), (u.isNotNull().cast("int") + low.isNotNull().cast("int")).alias("present"))


@query("PRJ21", "SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS brand_number, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 END AS difficulty FROM part")
def prj21(spark, sf):
    ordinal = F.create_map(*[F.lit(x) for x in ("ECONOMY", 1, "STANDARD", 2, "PROMO", 3)])
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"([0-9]+)$", 1).try_cast("int").alias("brand_number"), F.try_element_at(ordinal, F.col("p_type")).alias("difficulty"))


@query("PRJ22", over(f"SELECT participant_id, 'session_' || x.k AS session_slot, {r6('x.v AS speed')} FROM (SELECT participant_id, unnest([{{'k': 0, 'v': avg(speed) FILTER (session_type = 's0')}}, {{'k': 1, 'v': avg(speed) FILTER (session_type = 's1')}}, {{'k': 2, 'v': avg(speed) FILTER (session_type = 's2')}}]) AS x FROM sessions GROUP BY participant_id) WHERE x.v IS NOT NULL", SESSIONS))
def prj22(spark, sf):
    """Wide to long: a column a session slot becomes a row; slots without a measure go."""
    wide = tables.sessions(spark, sf).groupBy("participant_id").pivot("session_type", ["s0", "s1", "s2"]).agg(F.avg("speed"))
    wide = wide.withColumnsRenamed({f"s{k}": f"session_{k}" for k in range(3)})
    return wide.unpivot("participant_id", [f"session_{k}" for k in range(3)], "session_slot", "speed").filter("speed is not null")


@query("PRJ23", "SELECT c_custkey, c_name AS raw_c_name, c_mktsegment AS raw_c_mktsegment FROM customer")
def prj23(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.withColumnsRenamed({x: f"raw_{x}" for x in c.columns if x not in {"c_custkey"}})


@query("PRJ24", upto("summary", f"SELECT window_id, {r6('rt_volatility', 'rt_drift', 'rt_excluded_fraction', 'rt_cv')} FROM summary"))
def prj24(spark, sf):
    """Feature columns by prefix, without counts."""
    s = summaries(spark, sf)
    return s.select("window_id", *[c for c in s.columns if c.startswith("rt_") and not c.endswith("_n")])


@query("PRJ25", "SELECT event_id, CASE event_type WHEN 'click' THEN 'PVT' WHEN 'view' THEN 'Flanker' WHEN 'error' THEN 'MATB' ELSE event_type END AS task FROM events")
def prj25(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("click", "PVT", "view", "Flanker", "error", "MATB")])
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("task"))


@query("PRJ26", upto("summary", f"SELECT window_id, n_trials, {r6('accuracy')} FROM summary WHERE window_size = 16 AND window_kind = 'full' AND dynamics_eligible"))
def prj26(spark, sf):
    return summaries(spark, sf).filter("window_size = 16 and window_kind = 'full' and dynamics_eligible").select("window_id", "n_trials", "accuracy")


@query("PRJ28", "SELECT event_id FROM events WHERE epoch(ts) % 86400 >= 3600 AND epoch(ts) % 86400 < 7200")
def prj28(spark, sf):
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").filter((s >= 3600) & (s < 7200)).select("event_id")


@query("PRJ29", upto("summary", "SELECT window_id, CASE WHEN accuracy < 0.8 THEN 'low_accuracy' WHEN coalesce(rt_cv, 0) > 0.9 THEN 'unstable' WHEN coalesce(throughput_proxy, 0) >= 3 THEN 'efficient' WHEN coalesce(nonresponse_rate, 0) > 0.1 THEN 'disengaged' ELSE 'typical' END AS note FROM summary"))
def prj29(spark, sf):
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    note = F.when(F.col("accuracy") < 0.8, "low_accuracy").when(z("rt_cv") > 0.9, "unstable").when(z("throughput_proxy") >= 3, "efficient").when(z("nonresponse_rate") > 0.1, "disengaged").otherwise("typical")
    return summaries(spark, sf).select("window_id", note.alias("note"))


def icc_band(icc):
    return F.when(icc.isNull(), "not_estimable").when(icc >= 0.5, "trait_like").when(icc >= 0.25, "mixed").otherwise("state_like")


# --- windows ---------------------------------------------------------------------------------------------------------------------------------------------------------

_WINDOW_COLUMNS = ["observation_id", "window_id", "window_size", "window_index", "window_kind", "position", "fraction", "dynamics_eligible"]
_windows_sql = lambda where: upto("members", f"SELECT observation_id, window_id, window_size, window_index, window_kind, position, {r6('fraction')}, dynamics_eligible FROM members WHERE {where}")
for _name, _where in {"TW01": "window_kind = 'full'", "TW02": "window_kind = 'aggregate_remainder'", "TW03": "window_size = 16", "TW04": "true"}.items():
    query(_name, _windows_sql(_where))(lambda spark, sf, _where=_where: members(spark, sf).filter(_where).select(*_WINDOW_COLUMNS))


@query("TW05", upto("members", f"""SELECT window_id || ':prefix:' || k AS window_id, count(*) AS n_trials, {r6('avg(correct) AS accuracy')} FROM members, (VALUES (4), (6), (8), (12)) AS p(k)
  WHERE window_kind = 'full' AND position < k AND k <= window_size GROUP BY 1"""))
def tw05(spark, sf):
    return windows.prefix_windows(members(spark, sf), (4, 6, 8, 12)).groupBy("window_id").agg(F.count("*").alias("n_trials"), F.avg("correct").alias("accuracy"))


@query("TW06", f"SELECT p_partkey, i AS window_index, {r6('60.0 * i AS start_s', '60.0 * (i + 1) AS stop_s')} FROM (SELECT p_partkey, unnest(range(CAST(floor(p_retailprice / 60) AS BIGINT))) AS i FROM part)")
def tw06(spark, sf):
    return windows.interval_windows(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 60).drop("p_retailprice")


@query("TW11", upto("members", "SELECT count(*) AS missing_ids FROM (SELECT window_id FROM members WHERE window_size = 16 EXCEPT SELECT window_id FROM members)"))
def tw11(spark, sf):
    """Rebuilt primary windows have the ids that were expected."""
    m = members(spark, sf)
    again = windows.trial_windows(flagged(spark, sf).filter("analysis_eligible_trial"), sensitivity=())
    want = m.filter("window_size = 16").select("window_id").distinct()
    return want.join(again.select("window_id").distinct(), "window_id", "left_anti").agg(F.count("*").alias("missing_ids"))


@query("TW12", "SELECT CAST(floor(120000 / 2700) AS BIGINT) AS trials")
def tw12(spark, sf):
    return spark.range(1).select(F.floor(F.lit(120000) / 2700).alias("trials"))


@query("TW13", upto("trials", f"SELECT {B_SQL}, count(*) AS n, min(trial_raw) AS first_trial, max(trial_raw) AS last_trial, min(trial_raw) = 1 AND max(trial_raw) = count(*) AND count(DISTINCT trial_raw) = count(*) AS whole FROM trials GROUP BY ALL"))
def tw13(spark, sf):
    """Every session holds its trials 1..n once."""
    n, lo, hi = F.count("*"), F.min("trial_raw"), F.max("trial_raw")
    return trials(spark, sf).groupBy(*BOUNDARY).agg(n.alias("n"), lo.alias("first_trial"), hi.alias("last_trial"), ((lo == 1) & (hi == n) & (F.count_distinct("trial_raw") == n)).alias("whole"))


# --- summaries -------------------------------------------------------------------------------------------------------------------------------------------------------

_SUMMARY = {
    "AGG04": ["n_trials", "n_valid_rt", "n_valid_correct_rt", "accuracy", "median_rt_ms", "mean_rt_ms", "sd_rt_ms", "rt_cv", "throughput_proxy", "nonresponse_rate", "slow_tail_rate", "fast_error_rate", "rt_excluded_fraction"],
    "AGG05": ["control_cost_supported", "control_cost_rt_ms", "control_cost_acc", "n_con_rt", "n_inc_rt", "n_con_acc", "n_inc_acc"], "AGG06": ["pes_supported", "pes_post_error_n", "pes_post_correct_n", "post_error_slowing_ms"],
    "AGG07": ["error_burstiness"], "AGG08": ["rt_drift", "error_drift"], "AGG09": ["rt_volatility"],
}
_DOUBLES = {"accuracy", "median_rt_ms", "mean_rt_ms", "sd_rt_ms", "rt_cv", "throughput_proxy", "nonresponse_rate", "slow_tail_rate", "fast_error_rate", "rt_excluded_fraction", "control_cost_rt_ms", "control_cost_acc", "post_error_slowing_ms", "error_burstiness", "rt_drift", "error_drift", "rt_volatility"}
for _name, _cols in _SUMMARY.items():
    query(_name, upto("summary", f"SELECT window_id, {', '.join(r6(c) if c in _DOUBLES else c for c in _cols)} FROM summary"))(lambda spark, sf, _cols=_cols: summaries(spark, sf).select("window_id", *_cols))

_LINKS = {
    "WIN08": ["has_previous_window", "has_next_window", "next_window_id", "delta_throughput", "delta_accuracy", "delta_rt_cv", "delta_interference_rt_cost", "missing_reason_delta_accuracy", "missing_reason_delta_interference_rt_cost", "next_accuracy", "next_throughput", "next_rt_cv", "missing_reason_next_rt_cv", "change_accuracy", "change_throughput"],
    "WIN05": ["delta_throughput_z", "delta_accuracy_z", "delta_rt_cv_z"], "WIN11": ["combined_update_magnitude"], "WIN10": ["large_update_window"],
}
_PLAIN = {"has_previous_window", "has_next_window", "next_window_id", "large_update_window"}
for _name, _cols in _LINKS.items():
    query(_name, upto("transitions", f"SELECT window_id, {', '.join(c if c in _PLAIN or c.startswith('missing') else r6(c) for c in _cols)} FROM transitions"))(lambda spark, sf, _cols=_cols: linked(spark, sf).select("window_id", *_cols))


@query("AGG02", upto("trials", "SELECT dataset_id, count(DISTINCT participant_id) AS participants, CAST(sum(n // 16) AS BIGINT) AS windows FROM (SELECT dataset_id, participant_id, block_raw, count(*) AS n FROM trials WHERE block_raw >= 0 GROUP BY ALL) GROUP BY dataset_id"))
def agg02(spark, sf):
    return dataset_yield(trials(spark, sf)).select("dataset_id", "participants", "windows")


def dataset_yield(t: DataFrame, size: int = windows.PRIMARY) -> DataFrame:
    blocks = t.filter("block_raw >= 0").groupBy(*BOUNDARY).agg(F.floor(F.count("*") / size).alias("w"))
    return blocks.groupBy("dataset_id", "task_family").agg(F.count_distinct("participant_id").alias("participants"), F.sum("w").alias("windows"))


_YIELD = "y AS (SELECT dataset_id, task_family, count(DISTINCT participant_id) AS participants, CAST(sum(n // 16) AS BIGINT) AS windows FROM (SELECT dataset_id, task_family, participant_id, block_raw, count(*) AS n FROM trials WHERE block_raw >= 0 GROUP BY ALL) GROUP BY ALL)"
_TOP = "SELECT *, row_number() OVER (PARTITION BY task_family ORDER BY windows DESC, participants DESC, dataset_id) AS dataset_rank FROM y"


@query("AGG03", upto("trials", _TOP, _YIELD))
def agg03(spark, sf):
    return ranked_datasets(trials(spark, sf))


def ranked_datasets(t: DataFrame) -> DataFrame:
    w = Window.partitionBy("task_family").orderBy(F.desc("windows"), F.desc("participants"), "dataset_id")
    return dataset_yield(t).withColumn("dataset_rank", F.row_number().over(w).cast("long"))


@query("SRT03", upto("trials", f"SELECT * FROM ({_TOP}) WHERE dataset_rank <= 2", _YIELD))
def srt03(spark, sf):
    return ranked_datasets(trials(spark, sf)).filter("dataset_rank <= 2")


_KEY = "sha256('42|' || task_family || '|' || dataset_id || '|' || participant_id)"
_PICK = f"picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_family, dataset_id ORDER BY key) AS k FROM (SELECT DISTINCT task_family, dataset_id, participant_id, {_KEY} AS key FROM trials)) WHERE k <= 3)"


def hash_sample(t: DataFrame, keys: list[str], member: str, n: int, seed: int = 42) -> DataFrame:
    """The first n members of each group by the SHA-256 of seed and keys: the same on every run and at every order."""
    people = t.select(*keys, member).distinct()
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys, member), 256)
    return people.withColumn("key", key).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("key"))).filter(F.col("k") <= n)


@query("SRT04", upto("trials", "SELECT task_family, dataset_id, participant_id, key FROM picked", _PICK))
def srt04(spark, sf):
    return hash_sample(trials(spark, sf), ["task_family", "dataset_id"], "participant_id", 3).drop("k")


@query("SRT05", upto("trials", "SELECT observation_id FROM trials WHERE (dataset_id, participant_id) IN (SELECT (dataset_id, participant_id) FROM picked)", _PICK))
def srt05(spark, sf):
    t = trials(spark, sf)
    return t.join(hash_sample(t, ["task_family", "dataset_id"], "participant_id", 3), ["dataset_id", "participant_id"], "left_semi").select("observation_id")


@query("SRC08", upto("trials", "SELECT observation_id, participant_id FROM trials WHERE (dataset_id = 3 AND block_raw = 0) OR (dataset_id = 5 AND block_raw = 1)"))
def src08(spark, sf):
    """An OR of ANDs, as a filter."""
    return trials(spark, sf).filter("(dataset_id = 3 and block_raw = 0) or (dataset_id = 5 and block_raw = 1)").select("observation_id", "participant_id")


@query("WIN02", upto("flags", f"SELECT observation_id, {r6('CASE WHEN x IS NULL THEN NULL WHEN coalesce(stddev_pop(x) OVER w, 0) > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z')} FROM (SELECT *, CASE WHEN valid_rt THEN rt_ms END AS x FROM flags) WINDOW w AS (PARTITION BY {B_SQL})"))
def win02(spark, sf):
    return flagged(spark, sf).select(*ID, zscore(F.when(F.col("valid_rt"), F.col("rt_ms")), Window.partitionBy(*BOUNDARY)).alias("z"))


@query("WIN03", upto("flags", f"SELECT observation_id, {r6('CASE WHEN x IS NULL OR count(x) OVER w < 2 THEN NULL WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z')} FROM (SELECT *, CASE WHEN valid_rt THEN rt_ms END AS x FROM flags) WINDOW w AS (PARTITION BY participant_id, congruency)"))
def win03(spark, sf):
    w = Window.partitionBy("participant_id", "congruency")
    x = F.when(F.col("valid_rt"), F.col("rt_ms"))
    return flagged(spark, sf).select(*ID, F.when(F.count(x).over(w) >= 2, zscore(x, w)).alias("z"))


@query("WIN04", upto("summary", f"SELECT window_id, {r6('(rt_cv - median(rt_cv) OVER g) / CASE WHEN quantile_cont(rt_cv, 0.75) OVER g - quantile_cont(rt_cv, 0.25) OVER g > 0 THEN quantile_cont(rt_cv, 0.75) OVER g - quantile_cont(rt_cv, 0.25) OVER g ELSE 1 END AS rt_cv__source_adjusted')} FROM summary WINDOW g AS (PARTITION BY dataset_id, task_family)"))
def win04(spark, sf):
    return source_adjusted(summaries(spark, sf), ["rt_cv"], ["dataset_id", "task_family"]).select("window_id", "rt_cv__source_adjusted")


def source_adjusted(df: DataFrame, features: list[str], sources: list[str]) -> DataFrame:
    """(x - median) / IQR of the source; only centred where the IQR isn't positive."""
    w = Window.partitionBy(*sources)
    iqr = lambda c: quantile(F.col(c), 0.75).over(w) - quantile(F.col(c), 0.25).over(w)
    return df.withColumns({f"{c}__source_adjusted": (F.col(c) - F.median(c).over(w)) / F.when(iqr(c) > 0, iqr(c)).otherwise(1.0) for c in features})


@query("WIN06", over(f"SELECT participant_id, session_year, {r6('CASE WHEN speed IS NOT NULL THEN greatest(least((speed - med) / CASE WHEN iqr > 0 THEN iqr WHEN sd > 0 THEN sd ELSE 1 END, 5), -5) END AS speed_z')} FROM (SELECT *, median(speed) OVER g AS med, quantile_cont(speed, 0.75) OVER g - quantile_cont(speed, 0.25) OVER g AS iqr, stddev_pop(speed) OVER g AS sd FROM sessions WINDOW g AS (PARTITION BY session_type))", SESSIONS))
def win06(spark, sf):
    return session_z(tables.sessions(spark, sf), ["speed"]).select("participant_id", "session_year", "speed_z")


def session_z(s: DataFrame, columns: list[str]) -> DataFrame:
    """Robust z within the session type, within -5 and 5."""
    s = staged(s, "sessions")
    spread = {r["session_type"]: r for r in s.groupBy("session_type").agg(*[F.stddev_pop(c).alias(c) for c in columns]).collect()}  # a row a type
    scales = []
    for (kind,), q in quantiles(s, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75], ["session_type"]).items():
        iqr = {c: v[2] - v[0] if v[0] is not None else 0.0 for c, v in q.items()}
        scales.append((kind, *[v for c in columns for v in (q[c][1], iqr[c] if iqr[c] > 0 else spread[kind][c] or 1.0)]))
    kinds = s.sparkSession.createDataFrame(scales, "__kind string, " + ", ".join(f"`__m_{c}` double, `__s_{c}` double" for c in columns))
    rows = s.join(F.broadcast(kinds), F.col("session_type").eqNullSafe(F.col("__kind")))
    return rows.select(*s.columns, *[clip((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"), -5.0, 5.0).alias(f"{c}_z") for c in columns])


@query("WIN07", upto("summary", f"SELECT window_id, {r6('CASE WHEN accuracy IS NOT NULL THEN coalesce((accuracy - median(accuracy) OVER g) / CASE WHEN quantile_cont(accuracy, 0.75) OVER g - quantile_cont(accuracy, 0.25) OVER g > 0 THEN quantile_cont(accuracy, 0.75) OVER g - quantile_cont(accuracy, 0.25) OVER g WHEN stddev_samp(accuracy) OVER g > 0 THEN stddev_samp(accuracy) OVER g END, 0) END AS profile_z')} FROM summary WINDOW g AS (PARTITION BY task_family)"))
def win07(spark, sf):
    s = staged(summaries(spark, sf).select("window_id", "task_family", "accuracy"), "spread")
    return with_spreads(s, ["task_family"], ["accuracy"]).select("window_id", spread_z("accuracy", 0.0).alias("profile_z"))


@query("WIN09", upto("summary", f"SELECT a.window_id, l.next_accuracy FROM summary a LEFT JOIN (SELECT window_id, {r6('lead(accuracy) OVER (PARTITION BY dataset_id, participant_id, task_family, block_raw ORDER BY window_index) AS next_accuracy')} FROM summary WHERE window_size = 12) l USING (window_id)"))
def win09(spark, sf):
    """Leads over one window size, without asking for neighbours, joined back to all windows."""
    s = summaries(spark, sf)
    lead = s.filter("window_size = 12").select("window_id", F.lead("accuracy").over(Window.partitionBy(*BOUNDARY).orderBy("window_index")).alias("next_accuracy"))
    return s.select("window_id").join(lead, "window_id", "left")


@query("WIN12", upto("trials", f"SELECT observation_id, row_number() OVER (PARTITION BY participant_id ORDER BY ts, observation_id) AS trial_order FROM trials"))
def win12(spark, sf):
    return trials(spark, sf).select(*ID, F.row_number().over(Window.partitionBy("participant_id").orderBy("ts", "observation_id")).cast("long").alias("trial_order"))


@query("WIN13", upto("trials", f"SELECT observation_id, {r6('sum(coalesce(rt_ms, 3000) + 400 + 400 * (1 - correct)) OVER (PARTITION BY dataset_id, participant_id, task_family, block_raw ORDER BY trial_raw) AS elapsed_ms')} FROM trials"))
def win13(spark, sf):
    """Time on task so far: response, feedback, and a pause after an error."""
    took = F.coalesce("rt_ms", F.lit(3000.0)) + 400 + 400 * (1 - F.col("correct"))
    return trials(spark, sf).select(*ID, F.sum(took).over(Window.partitionBy(*BOUNDARY).orderBy("trial_raw").rowsBetween(Window.unboundedPreceding, 0)).alias("elapsed_ms"))


@query("WIN15", upto("trials", f"SELECT observation_id, lag(correct) OVER (PARTITION BY {B_SQL} ORDER BY trial_raw) AS previous_correct FROM trials"))
def win15(spark, sf):
    return trials(spark, sf).select(*ID, F.lag("correct").over(Window.partitionBy(*BOUNDARY).orderBy("trial_raw")).alias("previous_correct"))


@query("WIN16", upto("summary", f"SELECT window_id, {r6('avg(throughput_proxy) OVER p AS person_mean', 'throughput_proxy - avg(throughput_proxy) OVER p AS centred')} FROM summary WINDOW p AS (PARTITION BY participant_id)"))
def win16(spark, sf):
    m = F.avg("throughput_proxy").over(Window.partitionBy("participant_id"))
    return summaries(spark, sf).select("window_id", m.alias("person_mean"), (F.col("throughput_proxy") - m).alias("centred"))


@query("WIN17", upto("summary", f"SELECT window_id, {r6('CASE WHEN accuracy IS NOT NULL THEN (rank() OVER (PARTITION BY task_family ORDER BY accuracy ASC NULLS LAST) + (count(*) OVER (PARTITION BY task_family, accuracy) - 1) / 2.0) / count(accuracy) OVER (PARTITION BY task_family) END AS pct')} FROM summary"))
def win17(spark, sf):
    s = staged(summaries(spark, sf).select("window_id", "task_family", "accuracy"), "ranked")
    return s.join(st.ranks(s, "accuracy", ["task_family"]), ["task_family", "accuracy"], "left").select("window_id", (F.col("rank") / F.col("n")).alias("pct"))


@query("WIN18", over("SELECT participant_id, session_year FROM (SELECT *, count(*) OVER (PARTITION BY participant_id) AS n FROM sessions) WHERE n >= 2", SESSIONS))
def win18(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("participant_id"))
    return tables.sessions(spark, sf).withColumn("n", n).filter("n >= 2").select("participant_id", "session_year")


@query("RSD04", upto("flags", f"""SELECT observation_id, {r6('e AS efficiency_t', 'CASE WHEN e IS NULL THEN NULL ELSE CASE WHEN coalesce(stddev_pop(e) OVER w, 0) > 0 THEN (e - avg(e) OVER w) / stddev_pop(e) OVER w ELSE 0 END - CASE WHEN coalesce(stddev_pop(l) OVER w, 0) > 0 THEN (l - avg(l) OVER w) / stddev_pop(l) OVER w ELSE 0 END + CASE WHEN coalesce(stddev_pop(correct) OVER w, 0) > 0 THEN (correct - avg(correct) OVER w) / stddev_pop(correct) OVER w ELSE 0 END END AS u_t')}
  FROM (SELECT *, CASE WHEN valid_rt THEN correct / (rt_ms / 1000) END AS e, CASE WHEN valid_rt THEN ln(rt_ms) END AS l FROM flags) WINDOW w AS (PARTITION BY {B_SQL})"""))
def rsd04(spark, sf):
    """Update series from efficiency, log time and correctness, each standardised in its block."""
    return update_series(flagged(spark, sf).withColumn("log_rt", F.when(F.col("valid_rt"), F.ln("rt_ms"))), "log_rt").select(*ID, "efficiency_t", "u_t")


def update_series(df: DataFrame, residual: str) -> DataFrame:
    w = Window.partitionBy(*BOUNDARY)
    out = df.withColumn("efficiency_t", F.when(F.col("valid_rt"), F.coalesce("correct", F.lit(0)) / (F.col("rt_ms") / 1000)))
    return out.withColumn("u_t", zscore(F.col("efficiency_t"), w) - zscore(F.col(residual), w) + zscore(F.col("correct").cast("double"), w))


# --- sets, sorts -----------------------------------------------------------------------------------------------------------------------------------------------------


@query("SRT01", upto("trials", f"SELECT {B_SQL}, trial_raw, observation_id FROM trials ORDER BY {B_SQL}, trial_raw"))
def srt01(spark, sf):
    return trials(spark, sf).select(*BOUNDARY, "trial_raw", "observation_id").orderBy(*[F.asc_nulls_last(c) for c in (*BOUNDARY, "trial_raw")])


@query("SRT02", upto("trials", f"SELECT observation_id, {r6('rt_ms')} FROM trials ORDER BY rt_ms ASC NULLS LAST, observation_id"))
def srt02(spark, sf):
    return trials(spark, sf).select("observation_id", "rt_ms").orderBy(F.asc_nulls_last("rt_ms"), "observation_id")


@query("SRT06", upto("summary", f"SELECT task_family, arg_min(window_id, (-accuracy, -coalesce(throughput_proxy, 0), window_id)) AS best_window FROM summary WHERE window_size = 16 GROUP BY task_family"))
def srt06(spark, sf):
    order = F.struct(-F.col("accuracy"), -F.coalesce("throughput_proxy", F.lit(0.0)), F.col("window_id"))
    return summaries(spark, sf).filter("window_size = 16").groupBy("task_family").agg(F.min_by("window_id", order).alias("best_window"))


@query("SET01", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def set01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SET02", upto("trials", "SELECT participant_id, max(observation_id) AS last_observation FROM trials GROUP BY participant_id"))
def set02(spark, sf):
    """The last row of each key."""
    w = Window.partitionBy("participant_id").orderBy(F.desc("observation_id"))
    return trials(spark, sf).withColumn("k", F.row_number().over(w)).filter("k = 1").select("participant_id", F.col("observation_id").alias("last_observation"))


@query("SET03", "SELECT 'missing' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set03(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    side = lambda x, y, n: x.distinct().join(y, "k", "left_anti").agg(F.lit(n).alias("side"), F.count("*").alias("n")).select("side", "n")
    return side(a, b, "missing").unionByName(side(b, a, "unexpected"))


@query("SET04", "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def set04(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SET05", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set05(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
