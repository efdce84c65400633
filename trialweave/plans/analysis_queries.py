"""Queries over joins, aggregates, series, intervals, sessions and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import correlation, count_where, mean_where, quantile, quantiles, row_mean, row_rms, safe_div
from trialweave.operators import dynamics, heart, joins, statistics as st, windows
from trialweave.plans.oracle import BOUNDARY as B_SQL, RR, SESSIONS, matched, over, r6, rr_windows, upto
from trialweave.plans.staging import staged
from trialweave.plans.trial_queries import dataset_yield, flagged, icc_band, linked, members, query, session_z, summaries, trials
from trialweave.sources import tables
from trialweave.sources.tables import BOUNDARY, table

# --- joins -----------------------------------------------------------------------------------------------------------------------------------------------------------


@query("JOIN01", f"""SELECT r_name, o_orderstatus, count(*) AS n, {r6('sum(l_extendedprice::DECIMAL(18, 2)) AS price')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join01(spark, sf):
    """Fact to dimensions, a chain of inner joins."""
    t = lambda n: table(spark, sf, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query("JOIN02", upto("trials", "SELECT t.observation_id, w.label FROM trials t LEFT JOIN (SELECT DISTINCT dataset_id, block_raw, dataset_id || '/' || block_raw AS label FROM trials WHERE block_raw >= 0) w ON t.dataset_id = w.dataset_id AND t.block_raw = w.block_raw"))
def join02(spark, sf):
    t = trials(spark, sf)
    w = t.filter("block_raw >= 0").select("dataset_id", "block_raw").distinct().withColumn("label", F.concat(F.col("dataset_id").cast("string"), F.lit("/"), F.col("block_raw").cast("string")))
    return t.join(w, ["dataset_id", "block_raw"], "left").select("observation_id", "label")


@query("JOIN03", f"SELECT c_custkey, count(o_orderkey) AS n, {r6('coalesce(sum(o_totalprice), 0) AS total')} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join03(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"))


@query("JOIN04", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join04(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.validated_join(table(spark, sf, "orders"), c, ["o_custkey"], validate="many_to_one").select("o_orderkey", "c_mktsegment")


@query("JOIN05", "SELECT n_nationkey, n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def join05(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return joins.validated_join(table(spark, sf, "nation").select("n_nationkey", "n_name"), n, ["n_nationkey"], validate="one_to_one")


@query("JOIN06", f"SELECT s_suppkey, n_name, {r6('s_acctbal')} FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join06(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.validated_join(table(spark, sf, "supplier"), n, ["s_nationkey"], "left", "many_to_one").select("s_suppkey", "n_name", "s_acctbal")


@query("JOIN07", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join07(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("JOIN08", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL HAVING count(*) = 1")
def join08(spark, sf):
    """Rows whose key isn't on the other side, and is there once."""
    done = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(done, "l_orderkey", "left_anti")
    return joins.unambiguous(rows, ["l_orderkey", "l_linenumber"])


@query("JOIN09", f"SELECT user_id, CAST(floor(s / 21600) AS BIGINT) AS window_index, count(*) AS n, {r6('avg(value) AS mean_value')} FROM (SELECT *, (epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS s FROM (SELECT *, date_trunc('second', ts) AS ts2 FROM events)) GROUP BY ALL".replace("epoch(ts) -", "epoch(ts2) -"))
def join09(spark, sf):
    seconds = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    e = table(spark, sf, "events").withColumn("s", seconds)
    return joins.window_containment(e, "s", 21600).groupBy("user_id", "window_index").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("JOIN11", """WITH e AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
g AS (SELECT user_id, seg, min(event_id) FILTER (event_type = 'click') AS stimulus, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS r, min((ts, event_id)) FILTER (event_type = 'purchase') AS rt,
  min((ts, event_id)) FILTER (event_type = 'error') AS st FROM e WHERE seg > 0 GROUP BY ALL)
SELECT user_id, stimulus, CASE WHEN st IS NULL OR rt < st THEN r END AS response FROM g""")
def join11(spark, sf):
    kind = lambda x: F.col("event_type") == x
    out = joins.forward_responses(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], kind("click"), kind("purchase"), kind("error"))
    return out.select("user_id", F.col("stimulus.event_id").alias("stimulus"), F.col("response.event_id").alias("response"))


@query("JOIN10", matched("l_suppkey", "SELECT l_suppkey, l_linenumber % 2 AS side, l_extendedprice::DOUBLE AS t FROM lineitem", 40.0))
def join10(spark, sf):
    """One-to-one matches of two lists of times within a tolerance."""
    points = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 2).cast("int").alias("side"), F.col("l_extendedprice").cast("double").alias("t"))
    return joins.band_match(points, ["l_suppkey"], 40.0)


@query("JOIN12")
def join12(spark, sf):
    """Sessions of even and odd years matched within a customer by least cost."""
    s = tables.sessions(spark, sf).withColumns({"a": F.col("session_year").cast("long"), "b": F.col("session_year").cast("long")})
    return joins.match_profiles(s.filter("a % 2 = 0").fillna(0.0), s.filter("b % 2 = 1").fillna(0.0), "participant_id", "a", "b", ["speed", "accuracy", "n_orders"], [1e5, 0.5, 2.0], 1.0)


@query("JOIN13", "WITH k AS (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) = 1) SELECT l_orderkey, l_partkey, p_brand FROM k JOIN part ON l_partkey = p_partkey")
def join13(spark, sf):
    once = joins.unambiguous(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"])
    p = joins.unambiguous(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"])
    return once.join(p, "l_partkey").select("l_orderkey", "l_partkey", "p_brand")


@query("JOIN14", f"SELECT c_custkey, {r6('coalesce(m, (SELECT avg(o_totalprice) FROM orders)) AS intercept')} FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join14(spark, sf):
    """A lookup with a default for keys that were never seen."""
    o = table(spark, sf, "orders")
    default = o.agg(F.avg("o_totalprice")).first()[0]
    m = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    return table(spark, sf, "customer").join(m, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(default)).alias("intercept"))


@query("JOIN17", upto("trials", f"SELECT {B_SQL}, count(DISTINCT participant_id) = 1 AS one_participant, min(ts) < max(ts) AS spans FROM trials GROUP BY ALL"))
def join17(spark, sf):
    return trials(spark, sf).groupBy(*BOUNDARY).agg((F.count_distinct("participant_id") == 1).alias("one_participant"), (F.min("ts") < F.max("ts")).alias("spans"))


@query("JOIN18", upto("members", f"SELECT participant_id, {r6('avg(correct) AS prefix_accuracy')}, any_value(u.n) AS trials_all FROM members JOIN (SELECT participant_id, count(*) AS n FROM trials GROUP BY 1) u USING (participant_id) WHERE window_size = 12 AND window_kind = 'full' AND position < 6 GROUP BY participant_id"))
def join18(spark, sf):
    u = trials(spark, sf).groupBy("participant_id").agg(F.count("*").alias("trials_all"))
    p = members(spark, sf).filter("window_size = 12 and window_kind = 'full' and position < 6").groupBy("participant_id").agg(F.avg("correct").alias("prefix_accuracy"))
    return joins.validated_join(p, u, ["participant_id"], validate="one_to_one")


# --- aggregates ------------------------------------------------------------------------------------------------------------------------------------------------------


@query("AGG01", upto("trials", f"""SELECT dataset_id, task_family, count(*) AS trials, count(DISTINCT nullif(trim(participant_id), '')) AS participants, count(*) FILTER (congruency = 'congruent') AS congruent, count(*) FILTER (congruency = 'unknown') AS unknown,
  count(*) FILTER (block_raw < 0) AS practice, {r6('CASE WHEN count(*) > 0 THEN (count(*) - count(rt_ms)) / count(*) END AS missing_rt', 'avg(correct) AS accuracy')} FROM trials GROUP BY ALL"""))
def agg01(spark, sf):
    c = F.col("congruency")
    return trials(spark, sf).groupBy("dataset_id", "task_family").agg(
        F.count("*").alias("trials"), F.count_distinct(F.nullif(F.trim("participant_id"), F.lit(""))).alias("participants"), count_where(c == "congruent").alias("congruent"), count_where(c == "unknown").alias("unknown"),
        count_where(F.col("block_raw") < 0).alias("practice"), safe_div(F.count("*") - F.count("rt_ms"), F.count("*")).alias("missing_rt"), F.avg("correct").alias("accuracy"),
    )


@query("AGG10", upto("summary", f"SELECT task_family, count(*) AS windows, count(DISTINCT dataset_id) AS datasets, count(DISTINCT participant_id) AS participants, {r6('avg((control_cost_rt_ms IS NULL)::INT) AS missing_cost', 'avg((post_error_slowing_ms IS NULL)::INT) AS missing_pes', 'avg((throughput_proxy IS NULL)::INT) AS missing_throughput')} FROM summary WHERE window_size = 16 GROUP BY 1"))
def agg10(spark, sf):
    miss = lambda c: F.avg(F.col(c).isNull().cast("int"))
    return summaries(spark, sf).filter("window_size = 16").groupBy("task_family").agg(F.count("*").alias("windows"), F.count_distinct("dataset_id").alias("datasets"), F.count_distinct("participant_id").alias("participants"), miss("control_cost_rt_ms").alias("missing_cost"), miss("post_error_slowing_ms").alias("missing_pes"), miss("throughput_proxy").alias("missing_throughput"))


def counts_json(column: str):
    """Sorted value counts as JSON text, from rows that carry value and count."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("k"))))))


@query("AGG11", upto("transitions", """SELECT dataset_id, task_family, '{' || string_agg('"' || r || '":' || k, ',' ORDER BY r) || '}' AS reasons FROM (SELECT dataset_id, task_family, coalesce(missing_reason_delta_accuracy, 'available') AS r, count(*) AS k FROM transitions GROUP BY ALL) GROUP BY ALL"""))
def agg11(spark, sf):
    r = linked(spark, sf).groupBy("dataset_id", "task_family", F.coalesce("missing_reason_delta_accuracy", F.lit("available")).alias("r")).agg(F.count("*").alias("k"))
    return r.groupBy("dataset_id", "task_family").agg(counts_json("r").alias("reasons"))


@query("AGG12", upto("trials", """SELECT dataset_id, '{' || string_agg('"' || congruency || '":' || k, ',' ORDER BY congruency) || '}' AS composition FROM (SELECT dataset_id, congruency, count(*) AS k FROM trials GROUP BY ALL) GROUP BY 1"""))
def agg12(spark, sf):
    k = trials(spark, sf).groupBy("dataset_id", "congruency").agg(F.count("*").alias("k"))
    return k.groupBy("dataset_id").agg(counts_json("congruency").alias("composition"))


_PROFILE = "CASE WHEN accuracy >= 0.95 THEN 'P0' WHEN throughput_proxy > 2 THEN 'P1' ELSE 'P2' END"


def profiled(spark, sf) -> DataFrame:
    """Windows with a label that stands in for a fitted profile."""
    return linked(spark, sf).withColumn("profile", F.expr(_PROFILE))


@query("AGG13", upto("transitions", f"SELECT {_PROFILE} AS profile, count(*) AS windows, {r6('avg(accuracy) AS mean_accuracy', 'median(throughput_proxy) AS median_throughput', 'avg(next_accuracy) AS mean_next_accuracy', 'count(*) / (SELECT count(*) FROM transitions) AS share')} FROM transitions GROUP BY 1"))
def agg13(spark, sf):
    p = profiled(spark, sf).groupBy("profile").agg(F.count("*").alias("windows"), F.avg("accuracy").alias("mean_accuracy"), F.median("throughput_proxy").alias("median_throughput"), F.avg("next_accuracy").alias("mean_next_accuracy"))
    return p.withColumn("share", F.col("windows") / F.sum("windows").over(Window.partitionBy(F.lit(0))))


@query("AGG14", upto("summary", f"SELECT {_PROFILE} AS profile, {r6('avg(accuracy) AS accuracy_mean', 'median(accuracy) AS accuracy_median', 'avg((accuracy IS NOT NULL)::INT) AS accuracy_available', 'avg(rt_cv) AS rt_cv_mean', 'median(rt_cv) AS rt_cv_median', 'avg((rt_cv IS NOT NULL)::INT) AS rt_cv_available')}, list_aggregate(list_sort(list(DISTINCT dataset_id)), 'string_agg', '|') AS datasets FROM summary GROUP BY 1"))
def agg14(spark, sf):
    s = summaries(spark, sf).withColumn("profile", F.expr(_PROFILE))
    aggs = [f.alias(f"{c}_{n}") for c in ("accuracy", "rt_cv") for n, f in (("mean", F.avg(c)), ("median", F.median(c)), ("available", F.avg(F.col(c).isNotNull().cast("int"))))]
    return s.groupBy("profile").agg(*aggs, F.array_join(F.transform(F.array_sort(F.collect_set("dataset_id")), lambda x: x.cast("string")), "|").alias("datasets"))


@query("AGG15", upto("transitions", f"SELECT task_family, count(*) AS windows, count(*) FILTER (has_next_window) AS safe_next, CASE WHEN count(*) FILTER (has_next_window) < 100000 THEN 'too_few_next_windows' END AS reason, {r6('avg(has_next_window::INT) AS next_rate')} FROM transitions WHERE window_size = 16 GROUP BY 1"))
def agg15(spark, sf):
    nxt = count_where(F.col("has_next_window"))
    return linked(spark, sf).filter("window_size = 16").groupBy("task_family").agg(F.count("*").alias("windows"), nxt.alias("safe_next"), F.when(nxt < 100000, "too_few_next_windows").alias("reason"), F.avg(F.col("has_next_window").cast("int")).alias("next_rate"))


@query("AGG16", over(f"SELECT session_type, {r6('avg(speed) AS speed_mean', 'median(speed) AS speed_median', 'avg(accuracy) AS accuracy_mean', 'median(accuracy) AS accuracy_median')} FROM sessions GROUP BY 1", SESSIONS))
def agg16(spark, sf):
    return tables.sessions(spark, sf).groupBy("session_type").agg(*[f(c).alias(f"{c}_{n}") for c in ("speed", "accuracy") for n, f in (("mean", F.avg), ("median", F.median))])


@query("AGG17", over("SELECT count(*) AS sessions, count(DISTINCT participant_id) AS participants, count(spread) AS with_spread, count(urgent) AS with_urgent FROM sessions", SESSIONS))
def agg17(spark, sf):
    return tables.sessions(spark, sf).agg(F.count("*").alias("sessions"), F.count_distinct("participant_id").alias("participants"), F.count("spread").alias("with_spread"), F.count("urgent").alias("with_urgent"))


@query("AGG18", upto("members", f"SELECT participant_id, count(*) AS n, {r6('avg(correct) AS accuracy', 'avg(rt_ms) FILTER (valid_correct_rt) AS mean_rt', 'stddev_samp(rt_ms) FILTER (valid_correct_rt) / nullif(avg(rt_ms) FILTER (valid_correct_rt), 0) AS rt_cv')} FROM members WHERE window_size = 24 AND position < 8 AND congruency IN ('congruent', 'incongruent') GROUP BY 1"))
def agg18(spark, sf):
    """Summaries of the first trials that a selector keeps."""
    rt = F.when(F.col("valid_correct_rt"), F.col("rt_ms"))
    rows = members(spark, sf).filter("window_size = 24 and position < 8").filter(F.col("congruency").isin("congruent", "incongruent"))
    return rows.groupBy("participant_id").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(rt).alias("mean_rt"), safe_div(F.stddev_samp(rt), F.avg(rt)).alias("rt_cv"))


@query("AGG19", upto("flags", f"SELECT participant_id, count(*) FILTER (congruency = 'neutral') AS nogo, {r6('count(*) FILTER (congruency = $$neutral$$ AND correct = 0) / nullif(count(*) FILTER (congruency = $$neutral$$), 0) AS commission', 'count(*) FILTER (congruency <> $$neutral$$ AND rt_missing) / nullif(count(*) FILTER (congruency <> $$neutral$$), 0) AS omission', 'count(*) FILTER (congruency <> $$neutral$$ AND rt_below_min) / nullif(count(*) FILTER (congruency <> $$neutral$$), 0) AS anticipatory', 'avg(rt_ms) FILTER (congruency <> $$neutral$$) AS go_mean', 'stddev_samp(rt_ms) FILTER (congruency <> $$neutral$$) AS go_sd')} FROM flags GROUP BY 1"))
def agg19(spark, sf):
    """Rates of withheld and missed responses."""
    nogo, go = F.col("congruency") == "neutral", F.col("congruency") != "neutral"
    rate = lambda c, of: safe_div(count_where(c & of), count_where(of))
    return flagged(spark, sf).groupBy("participant_id").agg(count_where(nogo).alias("nogo"), rate(F.col("correct") == 0, nogo).alias("commission"), rate(F.col("rt_missing"), go).alias("omission"), rate(F.col("rt_below_min"), go).alias("anticipatory"), mean_where(F.col("rt_ms"), go).alias("go_mean"), F.stddev_samp(F.when(go, F.col("rt_ms"))).alias("go_sd"))


@query("AGG20", upto("summary", f"SELECT task_family, {r6('avg(n_valid_rt) AS mean', 'median(n_valid_rt) AS median', 'quantile_cont(n_valid_rt, 0.1) AS p10', 'quantile_cont(n_valid_rt, 0.9) AS p90', 'avg((n_valid_rt >= 12)::INT) AS at_least_12')} FROM summary WHERE window_size = 16 GROUP BY 1"))
def agg20(spark, sf):
    n = F.col("n_valid_rt")
    return summaries(spark, sf).filter("window_size = 16").groupBy("task_family").agg(F.avg(n).alias("mean"), F.median(n).alias("median"), quantile(n, 0.1).alias("p10"), quantile(n, 0.9).alias("p90"), F.avg((n >= 12).cast("int")).alias("at_least_12"))


@query("AGG21", "SELECT (SELECT count(*) FROM customer) AS raw, (SELECT count(DISTINCT o_custkey) FROM orders) AS candidates, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched")
def agg21(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(c, "raw").join(one(o, "candidates"), F.lit(True)).join(one(c.join(o, "c_custkey", "left_semi"), "matched"), F.lit(True))


@query("AGG22", upto("summary", f"SELECT window_size, window_kind, count(*) AS windows, {r6('avg((rt_excluded_fraction <= 0.2)::INT) AS pass_rate', 'quantile_cont(rt_excluded_fraction, 0.1) AS p10', 'quantile_cont(rt_excluded_fraction, 0.9) AS p90')} FROM summary GROUP BY ALL"))
def agg22(spark, sf):
    x = F.col("rt_excluded_fraction")
    return summaries(spark, sf).groupBy("window_size", "window_kind").agg(F.count("*").alias("windows"), F.avg((x <= 0.2).cast("int")).alias("pass_rate"), quantile(x, 0.1).alias("p10"), quantile(x, 0.9).alias("p90"))


_PV = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("AGG23", f"SELECT o_orderstatus, {', '.join(f'count(*) FILTER (o_orderpriority = $${p}$$) AS p{p[0]}' for p in _PV)}, count(*) AS total FROM orders GROUP BY 1")
def agg23(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", _PV).count().na.fill(0).withColumnsRenamed({x: f"p{x[0]}" for x in _PV})
    return p.withColumn("total", sum((F.col(f"p{x[0]}") for x in _PV), F.lit(0)).cast("long"))


_ASSOC = """c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderstatus, sum(n) AS row_total FROM c GROUP BY 1), k AS (SELECT o_orderpriority, sum(n) AS column_total FROM c GROUP BY 1),
a AS (SELECT o_orderstatus, o_orderpriority, coalesce(n, 0)::BIGINT AS n, row_total::BIGINT AS row_total, column_total::BIGINT AS column_total, row_total * column_total / (SELECT sum(n) FROM c) AS expected FROM r JOIN k ON true LEFT JOIN c USING (o_orderstatus, o_orderpriority))"""


@query("AGG24", over(f"SELECT o_orderstatus, o_orderpriority, n, row_total, column_total, {r6('expected', '(n - expected) * (n - expected) / expected AS chi2_part', 'n / expected AS observed_to_expected')} FROM a", _ASSOC))
def agg24(spark, sf):
    return st.association(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("STA07", over(f"SELECT sum(n)::BIGINT AS total, ((count(DISTINCT o_orderstatus) - 1) * (count(DISTINCT o_orderpriority) - 1))::BIGINT AS dof, {r6('sum((n - expected) * (n - expected) / expected) AS chi2', 'sqrt(sum((n - expected) * (n - expected) / expected) / (sum(n) * (least(count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority)) - 1))) AS cramers_v')} FROM a", _ASSOC))
def sta07(spark, sf):
    return st.chi_square(st.association(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


_ICC = """g AS (SELECT participant_id, count(*) AS n, avg(speed) AS m, var_pop(speed) AS v FROM sessions GROUP BY 1 HAVING count(*) >= 2),
i AS (SELECT count(*) AS groups, sum(n) AS rows, sum(n * n) AS sq, sum(n * m) / sum(n) AS grand, sum(n * v) AS within, sum(n * m * m) AS between_ FROM g),
ms AS (SELECT *, (between_ - rows * grand * grand) / (groups - 1) AS msb, within / (rows - groups) AS msw, (rows - sq / rows) / (groups - 1) AS n0 FROM i), icc AS (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM ms)"""


@query("AGG25", over(f"SELECT 'speed' AS feature, groups, rows::BIGINT AS rows, {r6('icc')} FROM icc", SESSIONS, _ICC))
def agg25(spark, sf):
    return st.one_way_icc(tables.sessions(spark, sf), "participant_id", "speed")


@query("PRJ30", over("SELECT CASE WHEN icc IS NULL THEN 'not_estimable' WHEN icc >= 0.5 THEN 'trait_like' WHEN icc >= 0.25 THEN 'mixed' ELSE 'state_like' END AS band FROM icc", SESSIONS, _ICC))
def prj30(spark, sf):
    return st.one_way_icc(tables.sessions(spark, sf), "participant_id", "speed").select(icc_band(F.col("icc")).alias("band"))


@query("STA09", over(f"SELECT m, {r6('m * icc / (1 + (m - 1) * icc) AS reliability')} FROM icc, (VALUES (1), (3), (5), (7), (10)) AS t(m)", SESSIONS, _ICC))
def sta09(spark, sf):
    icc = st.one_way_icc(tables.sessions(spark, sf), "participant_id", "speed")
    return icc.select(F.explode(F.array(*[F.lit(m) for m in (1, 3, 5, 7, 10)])).alias("m"), "icc").select("m", st.spearman_brown(F.col("icc"), F.col("m")).alias("reliability"))


@query("AGG26", upto("summary", f"""SELECT 'accuracy' AS feature, {r6('b AS between', 'w AS within', 'b / (b + w) AS between_fraction')} FROM (SELECT (SELECT avg((m - g) * (m - g)) FROM (SELECT avg(accuracy) AS m FROM s GROUP BY participant_id), (SELECT avg(accuracy) AS g FROM s)) AS b,
  (SELECT avg((accuracy - m) * (accuracy - m)) FROM (SELECT accuracy, avg(accuracy) OVER (PARTITION BY participant_id) AS m FROM s)) AS w)""".replace("AS between,", 'AS "between",'), "s AS (SELECT * FROM summary WHERE window_size = 16)"))
def agg26(spark, sf):
    return st.trait_state(summaries(spark, sf).filter("window_size = 16"), "participant_id", "accuracy")


_SPEARMAN = lambda src, a, b: f"""SELECT count(*) AS n, {r6('corr(ra, rb) AS rho')} FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("AGG27", upto("summary", _SPEARMAN("j", "a", "b"), "j AS (SELECT avg(accuracy) FILTER (window_size = 12) AS a, avg(accuracy) FILTER (window_size = 24) AS b FROM summary GROUP BY participant_id, block_raw)"))
def agg27(spark, sf):
    """Reliability of short windows against long ones of the same block."""
    pick = lambda n: F.avg(F.when(F.col("window_size") == n, F.col("accuracy")))
    j = summaries(spark, sf).groupBy("participant_id", "block_raw").agg(pick(12).alias("a"), pick(24).alias("b"))
    return st.spearman(j, "a", "b").select("n", "rho")


@query("AGG28", over(f"SELECT count(*) AS groups, {r6('median(slope) AS median_slope', 'avg((sign(round(slope, 9)) = 1)::INT) AS share_expected')} FROM (SELECT participant_id, regr_slope(speed, session_year) AS slope FROM sessions GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT session_year) >= 2)", SESSIONS))
def agg28(spark, sf):
    return st.group_slopes(tables.sessions(spark, sf), "participant_id", "speed", "session_year", 1)


_P = f"p AS (SELECT *, {_PROFILE} AS profile FROM summary WHERE window_size = 16)"


@query("AGG29", upto("summary", f"""SELECT participant_id, any_value(n)::BIGINT AS n, arg_max(profile, (k, profile)) AS modal_label, {r6('max(k / n) AS modal_share', '-sum(k / n * ln(k / n)) / ln((SELECT count(DISTINCT profile) FROM p)) AS entropy')}
  FROM (SELECT *, sum(k) OVER (PARTITION BY participant_id) AS n FROM (SELECT participant_id, profile, count(*) AS k FROM p GROUP BY ALL)) GROUP BY 1""", _P))
def agg29(spark, sf):
    return st.label_occupancy(profiles16(spark, sf), "participant_id", "profile")


def profiles16(spark, sf) -> DataFrame:
    return summaries(spark, sf).filter("window_size = 16").withColumn("profile", F.expr(_PROFILE))


@query("AGG30", upto("summary", f"SELECT {r6('sum(same) / sum(n * (n - 1) / 2) AS pair_agreement')} FROM (SELECT participant_id, sum(k * (k - 1) / 2) AS same, sum(k) AS n FROM (SELECT participant_id, profile, count(*) AS k FROM p GROUP BY ALL) GROUP BY 1)", _P))
def agg30(spark, sf):
    return st.pair_agreement(profiles16(spark, sf), "participant_id", "profile")


_TRANS = lambda adj, keys, order: f"""SELECT f.profile AS from_label, t.profile AS to_label, coalesce(n, 0)::BIGINT AS n, {r6('coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY f.profile), 0) AS share')} FROM (SELECT DISTINCT profile FROM p) f JOIN (SELECT DISTINCT profile FROM p) t ON true
  LEFT JOIN (SELECT profile AS a, np AS b, count(*) AS n FROM (SELECT *, lead(profile) OVER w AS np, lead(window_index) OVER w AS ni FROM p WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) WHERE np IS NOT NULL AND {adj} GROUP BY ALL) ON a = f.profile AND b = t.profile"""  # noqa: E731


@query("AGG31", upto("summary", _TRANS("ni = window_index + 1", B_SQL, "window_index"), _P))
def agg31(spark, sf):
    return st.transition_table(profiles16(spark, sf), BOUNDARY, ["window_index"], "profile", F.col("next_window_index") == F.col("window_index") + 1)


@query("AGG32", upto("summary", _TRANS("true", "participant_id", "block_raw, window_index"), _P))
def agg32(spark, sf):
    return st.transition_table(profiles16(spark, sf), ["participant_id"], ["block_raw", "window_index"], "profile")


@query("AGG33", f"SELECT p_brand, {r6('avg(p_retailprice) AS mean', 'stddev_samp(p_retailprice) AS sd', 'median(p_retailprice) AS median', 'min(p_retailprice) AS min', 'max(p_retailprice) AS max', 'avg((p_size > 10)::INT) AS valid_share')} FROM part GROUP BY 1")
def agg33(spark, sf):
    x = F.col("p_retailprice")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((F.col("p_size") > 10).cast("int")).alias("valid_share")).orderBy(F.desc("mean"))


@query("AGG34", over(f"SELECT participant_id, count(*) AS intervals, {r6('sum(rr_ms) / 3600000 AS hours', 'median(rr_ms) AS median_rr', '60000 / avg(rr_ms) AS heart_rate', 'avg((rr_ms < 300 OR rr_ms > 2000)::INT) AS invalid_share')} FROM rr GROUP BY 1", RR))
def agg34(spark, sf):
    x = F.col("rr_ms")
    return tables.rr_intervals(spark, sf).groupBy("participant_id").agg(F.count("*").alias("intervals"), (F.sum(x) / 3600000).alias("hours"), F.median(x).alias("median_rr"), (60000 / F.avg(x)).alias("heart_rate"), F.avg(((x < 300) | (x > 2000)).cast("int")).alias("invalid_share"))


@query("AGG35", upto("transitions", f"""SELECT dataset_id, task_family, count(*) FILTER (large_update_window = 1 AND next_accuracy IS NOT NULL) AS n_large, count(*) FILTER (large_update_window = 0 AND next_accuracy IS NOT NULL) AS n_small,
  {r6('CASE WHEN count(*) FILTER (large_update_window = 1 AND next_accuracy IS NOT NULL) >= 2 AND count(*) FILTER (large_update_window = 0 AND next_accuracy IS NOT NULL) >= 2 THEN avg(next_accuracy) FILTER (large_update_window = 1) - avg(next_accuracy) FILTER (large_update_window = 0) END AS contrast')} FROM transitions GROUP BY ALL"""))
def agg35(spark, sf):
    large, small, y = F.col("large_update_window") == 1, F.col("large_update_window") == 0, F.col("next_accuracy")
    a, b = count_where(large & y.isNotNull()), count_where(small & y.isNotNull())
    return linked(spark, sf).groupBy("dataset_id", "task_family").agg(a.alias("n_large"), b.alias("n_small"), F.when((a >= 2) & (b >= 2), mean_where(y, large) - mean_where(y, small)).alias("contrast"))


@query("AGG36", upto("trials", "SELECT task_family, count(DISTINCT participant_id) AS participants, count(*) AS trials, count(DISTINCT dataset_id) AS datasets FROM trials GROUP BY 1"))
def agg36(spark, sf):
    return trials(spark, sf).groupBy("task_family").agg(F.count_distinct("participant_id").alias("participants"), F.count("*").alias("trials"), F.count_distinct("dataset_id").alias("datasets"))


# --- series ----------------------------------------------------------------------------------------------------------------------------------------------------------

_SERIES = "ser AS (SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY position) - 1 AS i, rt_ms AS x FROM members WHERE dynamics_eligible AND rt_ms IS NOT NULL)"
_STEPS = "st AS (SELECT *, x - lag(x) OVER (PARTITION BY window_id ORDER BY i) AS d FROM ser)"


def rt_series(spark, sf) -> DataFrame:
    return dynamics.series(members(spark, sf).filter("dynamics_eligible"), "window_id", "position", "rt_ms")


@query("DYN00", upto("members", f"SELECT window_id, i, {r6('x')} FROM ser", _SERIES))
def dyn00(spark, sf):
    return rt_series(spark, sf)


_LAG = lambda k: f"CASE WHEN count(l{k}) >= 3 AND max(x) FILTER (l{k} IS NOT NULL) > min(x) FILTER (l{k} IS NOT NULL) AND max(l{k}) > min(l{k}) THEN corr(x, l{k}) END AS lag{k}"


@query("DYN02", upto("members", f"SELECT window_id, {r6(_LAG(1), _LAG(2))} FROM (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2 FROM ser WINDOW w AS (PARTITION BY window_id ORDER BY i)) GROUP BY 1", _SERIES))
def dyn02(spark, sf):
    return dynamics.lag_correlations(rt_series(spark, sf), "window_id")


_SPREAD = """sp AS (SELECT window_id, count(*) AS n, sqrt(avg(d * d)) AS rmssd, stddev_samp(x) AS sd, CASE WHEN count(*) >= 3 THEN regr_slope(x, i) END AS slope FROM st GROUP BY 1),
tu AS (SELECT window_id, CASE WHEN count(*) >= 2 THEN avg(turn) END AS sign_change FROM (SELECT window_id, CAST(sign(d) <> lag(sign(d)) OVER (PARTITION BY window_id ORDER BY i) AS INT) AS turn FROM st WHERE d <> 0) GROUP BY 1)"""
_SD2 = "(2 * sd * sd - 0.5 * rmssd * rmssd)"
for _name, _cols in {"DYN03": ["CASE WHEN n >= 3 AND sd > 0 THEN rmssd / sd END AS roughness"], "DYN04": ["sign_change"], "DYN05": [f"CASE WHEN n >= 3 AND {_SD2} > 0 THEN rmssd / sqrt(2) / sqrt({_SD2}) END AS sd1_sd2"], "DYN10": ["slope"]}.items():
    query(_name, upto("members", f"SELECT window_id, n, {r6(*_cols)} FROM sp LEFT JOIN tu USING (window_id)", _SERIES, _STEPS, _SPREAD))(
        lambda spark, sf, _c=_cols[0].split(" AS ")[-1]: dynamics.spread_features(rt_series(spark, sf), "window_id").select("window_id", "n", _c)
    )


@query("DYN06", upto("members", f"""SELECT window_id, {r6('-sum(p * ln(p)) / ln(6) AS perm_entropy3')} FROM (SELECT window_id, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS p, sum(count(*)) OVER (PARTITION BY window_id) AS n
  FROM (SELECT window_id, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM ser WINDOW w AS (PARTITION BY window_id ORDER BY i)) WHERE c IS NOT NULL GROUP BY window_id, a <= b, b <= c, a <= c) WHERE n >= 3 GROUP BY 1""", _SERIES))
def dyn06(spark, sf):
    return dynamics.permutation_entropy(rt_series(spark, sf), "window_id")


_DIFF = lambda bins: f"""SELECT window_id, {r6(f'-sum(p * ln(p)) / ln({bins}) AS diff_entropy')} FROM (SELECT window_id, k / sum(k) OVER (PARTITION BY window_id) AS p, sum(k) OVER (PARTITION BY window_id) AS n FROM (
  SELECT window_id, bin, count(*) AS k FROM (SELECT window_id, greatest(least(len(list_filter(range({bins + 1}), lambda e: -c + e * (2 * c / {bins}) <= v)) - 1, {bins - 1}), 0) AS bin
  FROM (SELECT window_id, c, greatest(least(d, c), -c) AS v FROM (SELECT window_id, d, quantile_cont(abs(d), 0.95) OVER (PARTITION BY window_id) AS c FROM st WHERE d IS NOT NULL) WHERE c > 0)) GROUP BY ALL)) WHERE n >= 4 GROUP BY 1"""  # noqa: E731


@query("DYN07", upto("members", _DIFF(16), _SERIES, _STEPS))
def dyn07(spark, sf):
    return dynamics.difference_entropy(rt_series(spark, sf), "window_id")


@query("DYN11", upto("members", f"""SELECT window_id, {r6('CASE WHEN count(DISTINCT congruency) >= 2 AND count(DISTINCT correct) >= 2 THEN sum(p * log2(p / (pl * pr))) END AS mi_bits')} FROM (SELECT window_id, congruency, correct, k / sum(k) OVER (PARTITION BY window_id) AS p,
  sum(k) OVER (PARTITION BY window_id, congruency) / sum(k) OVER (PARTITION BY window_id) AS pl, sum(k) OVER (PARTITION BY window_id, correct) / sum(k) OVER (PARTITION BY window_id) AS pr FROM (SELECT window_id, congruency, correct, count(*) AS k FROM members GROUP BY ALL)) GROUP BY 1"""))
def dyn11(spark, sf):
    return dynamics.mutual_information(members(spark, sf), "window_id", "congruency", "correct")


@query("DYN14", upto("members", f"SELECT window_id, CASE WHEN count(z) < 12 THEN 'insufficient_observations' END AS reason, {r6('CASE WHEN count(z) >= 12 THEN avg((abs(z) >= 2)::INT) FILTER (z IS NOT NULL) END AS upper_tail_rate')} FROM (SELECT window_id, CASE WHEN rt_ms IS NOT NULL AND stddev_pop(rt_ms) OVER w > 0 THEN (rt_ms - avg(rt_ms) OVER w) / stddev_pop(rt_ms) OVER w END AS z FROM members WINDOW w AS (PARTITION BY window_id)) GROUP BY 1"))
def dyn14(spark, sf):
    w = Window.partitionBy("window_id")
    z = F.when(F.stddev_pop("rt_ms").over(w) > 0, (F.col("rt_ms") - F.avg("rt_ms").over(w)) / F.stddev_pop("rt_ms").over(w))
    n = F.count("z")
    return members(spark, sf).select("window_id", z.alias("z")).groupBy("window_id").agg(F.when(n < 12, "insufficient_observations").alias("reason"), F.when(n >= 12, F.avg((F.abs("z") >= 2).cast("int"))).alias("upper_tail_rate"))


_DFA = """c AS (SELECT *, sum(rr_ms - mean) OVER (PARTITION BY participant_id ORDER BY pos) AS y FROM (SELECT *, avg(rr_ms) OVER p AS mean, stddev_pop(rr_ms) OVER p AS sd, count(*) OVER p AS n FROM rr WINDOW p AS (PARTITION BY participant_id))),
g AS (SELECT participant_id, s, pos // s AS part, regr_syy(y, pos) - regr_sxy(y, pos) * regr_sxy(y, pos) / regr_sxx(y, pos) AS sse FROM c, generate_series(4, 16) AS k(s) WHERE n >= 40 AND sd > 0 AND n // s >= 4 AND pos < n // s * s GROUP BY ALL),
f AS (SELECT participant_id, s, sqrt(sum(sse) / (count(*) * s)) AS f FROM g GROUP BY participant_id, s),
a AS (SELECT participant_id, CASE WHEN count(*) >= 4 THEN regr_slope(ln(f), ln(s)) END AS alpha FROM f WHERE f > 0 GROUP BY 1)"""


@query("DYN01", over(f"SELECT participant_id, {r6('alpha AS dfa_alpha')} FROM (SELECT DISTINCT participant_id FROM rr) LEFT JOIN a USING (participant_id)", RR, _DFA))
def dyn01(spark, sf):
    rr = tables.rr_intervals(spark, sf)
    found = dynamics.fluctuation(dynamics.series(rr, "participant_id", "pos", "rr_ms"), "participant_id")
    return rr.select("participant_id").distinct().join(found, "participant_id", "left")


_SAMPEN = """w AS (SELECT participant_id || ':' || (pos // 80) AS window_id, pos AS i, rr_ms AS x FROM rr), s AS (SELECT window_id, count(*) AS n, 0.2 * stddev_samp(x) AS r FROM w GROUP BY 1),
t AS (SELECT *, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM w JOIN s USING (window_id) WINDOW o AS (PARTITION BY window_id ORDER BY i)),
p AS (SELECT a.window_id, count(*) AS b, count(*) FILTER (abs(a.z - b.z) <= a.r) AS a FROM t a JOIN t b ON a.window_id = b.window_id AND a.i < b.i AND abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r WHERE a.n >= 20 AND a.r > 0 GROUP BY 1)"""


@query("DYN09", over(f"SELECT window_id, {r6('CASE WHEN p.a > 0 THEN -ln(p.a / p.b) END AS sample_entropy')} FROM s LEFT JOIN p USING (window_id)", RR, _SAMPEN))
def dyn09(spark, sf):
    w = tables.rr_intervals(spark, sf).withColumn("window_id", F.concat_ws(":", "participant_id", F.floor(F.col("pos") / 80)))
    return dynamics.sample_entropies(dynamics.series(w, "window_id", "pos", "rr_ms"), "window_id")


@query("DYN12")
def dyn12(spark, sf):
    return dynamics.corrected_mi_by(trials(spark, sf), "participant_id", "observation_id", "congruency", "correct")


@query("DYN13")
def dyn13(spark, sf):
    return dynamics.binned_mi(trials(spark, sf), "participant_id", "observation_id", "congruency", "rt_ms")


# --- intervals -------------------------------------------------------------------------------------------------------------------------------------------------------


@query("WIN14", over(f"SELECT participant_id, pos, {r6('sum(rr_ms) OVER (PARTITION BY participant_id ORDER BY pos) AS clock_ms')} FROM rr", RR))
def win14(spark, sf):
    w = Window.partitionBy("participant_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tables.rr_intervals(spark, sf).select("participant_id", "pos", F.sum("rr_ms").over(w).alias("clock_ms"))


_COR = """c1 AS (SELECT *, coalesce(rr_ms BETWEEN 300 AND 2000, false) AS valid, median(CASE WHEN rr_ms BETWEEN 300 AND 2000 THEN rr_ms END) OVER (PARTITION BY participant_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS local_median FROM rr),
c2 AS (SELECT *, NOT valid AS rr_invalid, coalesce(valid AND abs(rr_ms - local_median) > 0.2 * local_median, false) AS rr_isolated FROM c1), cor AS (SELECT *, CASE WHEN rr_invalid OR rr_isolated THEN local_median ELSE rr_ms END AS rr_corrected FROM c2)"""


@query("WIN19", over(f"SELECT participant_id, pos, {r6('local_median')} FROM cor", RR, _COR))
def win19(spark, sf):
    return heart.correct_rr(tables.rr_intervals(spark, sf), ["participant_id"]).select("participant_id", "pos", "local_median")


@query("HRV04", over(f"SELECT participant_id, pos, rr_invalid, rr_isolated, {r6('rr_corrected')} FROM cor", RR, _COR))
def hrv04(spark, sf):
    return heart.correct_rr(tables.rr_intervals(spark, sf), ["participant_id"]).select("participant_id", "pos", "rr_invalid", "rr_isolated", "rr_corrected")


@query("TW07", over(f"SELECT participant_id, window_index, count(*) AS n, {r6('min(end_ms) AS first_end', 'max(end_ms) AS last_end')} FROM rrw GROUP BY ALL", RR, rr_windows(60)))
def tw07(spark, sf):
    return windows.rr_windows(tables.rr_intervals(spark, sf), 60).groupBy("participant_id", "window_index").agg(F.count("*").alias("n"), F.min("end_ms").alias("first_end"), F.max("end_ms").alias("last_end"))


_PICKS = "list_transform(range(4), lambda i: CASE WHEN i = 3 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 3.0)) AS BIGINT) END)"


@query("TW08", over(f"SELECT participant_id, window_index, count(*) AS n_intervals FROM (SELECT *, CAST(floor(total_ms / 60000.0) AS BIGINT) AS n FROM rrw) WHERE n <= 4 OR list_contains({_PICKS}, window_index) GROUP BY ALL", RR, rr_windows(60)))
def tw08(spark, sf):
    return windows.rr_windows(tables.rr_intervals(spark, sf), 60, 4).groupBy("participant_id", "window_index").agg(F.count("*").alias("n_intervals"))


_HRV = f"""h1 AS (SELECT *, rr_corrected - lag(rr_corrected) OVER w AS d, sum(rr_corrected) OVER w / 1000 AS t FROM (SELECT cor.*, rrw.window_index FROM cor JOIN rrw USING (participant_id, pos)) WINDOW w AS (PARTITION BY participant_id, window_index ORDER BY pos)),
h2 AS (SELECT participant_id, window_index, count(rr_corrected) AS n_intervals, avg(rr_corrected) AS mean_nn, stddev_samp(rr_corrected) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg((abs(d) > 20)::INT) AS pnn20, avg((abs(d) > 50)::INT) AS pnn50,
  regr_slope(rr_corrected, t) * 60 AS slope_per_minute, avg((rr_invalid OR rr_isolated)::INT) AS corrected_fraction FROM h1 GROUP BY ALL)"""
_HRV_COLS = ["mean_nn", "sdnn", "rmssd", "pnn20", "pnn50", "slope_per_minute", "corrected_fraction", "60000 / mean_nn AS heart_rate", "sdnn / mean_nn AS cvnn", "rmssd / sqrt(2) AS sd1", "CASE WHEN rmssd > 0 THEN ln(rmssd) END AS log_rmssd"]


def hrv(spark, sf) -> DataFrame:
    rr = windows.rr_windows(heart.correct_rr(tables.rr_intervals(spark, sf), ["participant_id"]), 60)
    return heart.time_domain(rr, ["participant_id", "window_index"])


@query("HRV06", over(f"SELECT participant_id, window_index, n_intervals, {r6(*_HRV_COLS)}, n_intervals >= 30 AND corrected_fraction <= 0.05 AS quality_pass FROM h2", RR, _COR, rr_windows(60), _HRV))
def hrv06(spark, sf):
    return hrv(spark, sf)


@query("HRV07", over(f"SELECT count(*) AS windows, {r6('avg((n_intervals >= 30 AND corrected_fraction <= 0.05)::INT) AS pass_rate', 'median(rmssd) AS median_rmssd')} FROM h2", RR, _COR, rr_windows(60), _HRV))
def hrv07(spark, sf):
    return hrv(spark, sf).agg(F.count("*").alias("windows"), F.avg(F.col("quality_pass").cast("int")).alias("pass_rate"), F.median("rmssd").alias("median_rmssd"))


@query("PRJ27", over("SELECT participant_id, window_index FROM h2 WHERE n_intervals >= 30 AND corrected_fraction <= 0.2 AND 60000 / mean_nn BETWEEN 45 AND 100 AND abs(slope_per_minute) <= 30", RR, _COR, rr_windows(60), _HRV))
def prj27(spark, sf):
    return hrv(spark, sf).filter("n_intervals >= 30 and corrected_fraction <= 0.2 and heart_rate between 45 and 100 and abs(slope_per_minute) <= 30").select("participant_id", "window_index")


# --- behaviour -------------------------------------------------------------------------------------------------------------------------------------------------------


@query("BEH01", upto("trials", f"SELECT participant_id, {r6('avg(1 / (rt_ms / 1000)) FILTER (rt_ms >= 100) AS mean_speed', 'median(rt_ms) AS median_rt', 'stddev_samp(rt_ms) / avg(rt_ms) AS rt_cv', 'avg((rt_ms >= 500)::INT) AS lapse_rate', 'avg((rt_ms < 150)::INT) AS anticipation_rate')} FROM trials GROUP BY 1"))
def beh01(spark, sf):
    """Vigilance: speed, lapses, anticipations."""
    rt = F.col("rt_ms")
    return trials(spark, sf).groupBy("participant_id").agg(mean_where(1 / (rt / 1000), rt >= 100).alias("mean_speed"), F.median(rt).alias("median_rt"), safe_div(F.stddev_samp(rt), F.avg(rt)).alias("rt_cv"), F.avg((rt >= 500).cast("int")).alias("lapse_rate"), F.avg((rt < 150).cast("int")).alias("anticipation_rate"))


@query("BEH02", upto("flags", f"""SELECT participant_id, {r6('avg(correct) AS accuracy', 'median(rt_ms) FILTER (valid_correct_rt) AS median_rt', 'CASE WHEN count(*) FILTER (valid_correct_rt AND congruency = $$incongruent$$) >= 3 AND count(*) FILTER (valid_correct_rt AND congruency = $$congruent$$) >= 3 THEN avg(rt_ms) FILTER (valid_correct_rt AND congruency = $$incongruent$$) - avg(rt_ms) FILTER (valid_correct_rt AND congruency = $$congruent$$) END AS cost',
  'avg((correct = 0 AND rt_ms < CASE WHEN nv >= 10 THEN q20 ELSE 300 END)::INT) FILTER (rt_ms IS NOT NULL) AS fast_error_rate')} FROM (SELECT *, quantile_cont(CASE WHEN valid_rt THEN rt_ms END, 0.2) OVER (PARTITION BY participant_id) AS q20, count(CASE WHEN valid_rt THEN 1 END) OVER (PARTITION BY participant_id) AS nv FROM flags) GROUP BY 1"""))
def beh02(spark, sf):
    """Conflict task: accuracy, cost with support, fast errors below the participant's own fifth."""
    w = Window.partitionBy("participant_id")
    rt, v = F.col("rt_ms"), F.col("valid_correct_rt")
    rows = flagged(spark, sf).withColumns({"q20": quantile(F.when(F.col("valid_rt"), rt), 0.2).over(w), "nv": F.count(F.when(F.col("valid_rt"), 1)).over(w)})
    inc, con = v & (F.col("congruency") == "incongruent"), v & (F.col("congruency") == "congruent")
    limit = F.when(F.col("nv") >= 10, F.col("q20")).otherwise(300.0)
    fast = F.when(rt.isNotNull(), ((F.col("correct") == 0) & (rt < limit)).cast("int"))
    return rows.groupBy("participant_id").agg(F.avg("correct").alias("accuracy"), F.median(F.when(v, rt)).alias("median_rt"), F.when((count_where(inc) >= 3) & (count_where(con) >= 3), mean_where(rt, inc) - mean_where(rt, con)).alias("cost"), F.avg(fast).alias("fast_error_rate"))


@query("BEH03", upto("flags", f"SELECT participant_id, {r6('CASE WHEN count(*) FILTER (p = 0) >= 2 AND count(*) FILTER (p = 1) >= 5 THEN avg(rt_ms) FILTER (p = 0) - avg(rt_ms) FILTER (p = 1) END AS post_error_adjustment')} FROM (SELECT *, lag(correct) OVER (PARTITION BY {B_SQL} ORDER BY trial_raw) AS p FROM flags) WHERE valid_correct_rt GROUP BY 1"))
def beh03(spark, sf):
    rows = flagged(spark, sf).withColumn("p", F.lag("correct").over(Window.partitionBy(*BOUNDARY).orderBy("trial_raw"))).filter("valid_correct_rt")
    a, b = F.col("p") == 0, F.col("p") == 1
    return rows.groupBy("participant_id").agg(F.when((count_where(a) >= 2) & (count_where(b) >= 5), mean_where(F.col("rt_ms"), a) - mean_where(F.col("rt_ms"), b)).alias("post_error_adjustment"))


@query("BEH04", upto("trials", f"SELECT participant_id, {r6('avg(correct) FILTER (congruency = $$congruent$$) AS hit', '1 - avg(correct) FILTER (congruency <> $$congruent$$) AS false_alarm', 'avg(correct) FILTER (congruency = $$congruent$$) - (1 - avg(correct) FILTER (congruency <> $$congruent$$)) AS discrimination', 'avg(correct) / (median(rt_ms) / 1000) AS throughput')} FROM trials GROUP BY 1"))
def beh04(spark, sf):
    """Memory task: hits, false alarms, throughput."""
    c = F.col("correct")
    hit, fa = mean_where(c, F.col("congruency") == "congruent"), 1 - mean_where(c, F.col("congruency") != "congruent")
    return trials(spark, sf).groupBy("participant_id").agg(hit.alias("hit"), fa.alias("false_alarm"), (hit - fa).alias("discrimination"), safe_div(F.avg(c), F.median("rt_ms") / 1000).alias("throughput"))


@query("BEH05", f"SELECT l_suppkey, {r6('avg(sqrt(l_discount * l_discount + l_tax * l_tax)) AS tracking_error', 'avg(abs(l_discount - l_tax)) AS imbalance', '-avg(l_quantity) AS efficacy')} FROM lineitem GROUP BY 1")
def beh05(spark, sf):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(F.sqrt(a * a + b * b)).alias("tracking_error"), F.avg(F.abs(a - b)).alias("imbalance"), (-F.avg("l_quantity")).alias("efficacy"))


# --- sessions --------------------------------------------------------------------------------------------------------------------------------------------------------


@query("SES01", over(f"SELECT participant_id, session_year, {r6('list_avg([urgent, low]) AS task_mean', 'urgent - low AS interference', 'accuracy / nullif(speed / 100000, 0) AS throughput')} FROM sessions", SESSIONS))
def ses01(spark, sf):
    return tables.sessions(spark, sf).select("participant_id", "session_year", row_mean([F.col("urgent"), F.col("low")]).alias("task_mean"), (F.col("urgent") - F.col("low")).alias("interference"), safe_div(F.col("accuracy"), F.col("speed") / 100000).alias("throughput"))


_Z = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(least(({c} - median({c}) OVER g) / CASE WHEN quantile_cont({c}, 0.75) OVER g - quantile_cont({c}, 0.25) OVER g > 0 THEN quantile_cont({c}, 0.75) OVER g - quantile_cont({c}, 0.25) OVER g WHEN stddev_pop({c}) OVER g > 0 THEN stddev_pop({c}) OVER g ELSE 1 END, 5), -5) END"
_SESZ = f"z AS (SELECT participant_id, session_year, {_Z('speed')} AS a, {_Z('accuracy')} AS b, {_Z('spread')} AS c FROM sessions WINDOW g AS (PARTITION BY session_type)), ef AS (SELECT *, list_avg([-a, b, -c]) AS efficacy FROM z)"


@query("SES02", over(f"SELECT participant_id, session_year, {r6('-a AS speed_index', 'b AS accuracy_index', '-c AS resilience_index', 'efficacy')} FROM ef", SESSIONS, _SESZ))
def ses02(spark, sf):
    return session_indices(tables.sessions(spark, sf)).select("participant_id", "session_year", "speed_index", "accuracy_index", "resilience_index", "efficacy")


def session_indices(s: DataFrame) -> DataFrame:
    z = session_z(s, ["speed", "accuracy", "spread"])
    z = z.withColumns({"speed_index": -F.col("speed_z"), "accuracy_index": F.col("accuracy_z"), "resilience_index": -F.col("spread_z")})
    return z.withColumn("efficacy", row_mean([F.col("speed_index"), F.col("accuracy_index"), F.col("resilience_index")]))


_SC = lambda c: f"({c} - (SELECT median({c}) FROM k)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 0 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END FROM k)"


@query("SES03", over(f"SELECT participant_id, session_year, {r6('(' + _SC('speed') + ' - ' + _SC('spread') + ') / 2 AS engagement')} FROM k", SESSIONS, "k AS (SELECT * FROM sessions WHERE speed IS NOT NULL AND spread IS NOT NULL)"))
def ses03(spark, sf):
    """Equal-weight component of oriented indicators over complete rows, scaled by median and IQR."""
    return component_score(tables.sessions(spark, sf).select("participant_id", "session_year", "speed", "spread"), {"speed": 1, "spread": -1}, "engagement").select("participant_id", "session_year", "engagement")


def component_score(df: DataFrame, indicators: dict[str, int], name: str, least: int = 20) -> DataFrame:
    rows = staged(df.dropna(subset=list(indicators)), "complete")
    stats = rows.agg(F.count("*").alias("n"), *[F.stddev_pop(c).alias(c) for c in indicators]).first()
    if stats["n"] < least:
        return rows.withColumn(name, F.lit(None).cast("double"))
    quarters = quantiles(rows, {c: F.col(c) for c in indicators}, [0.25, 0.5, 0.75])[()]
    scaled = [sign * (F.col(c) - quarters[c][1]) / ((quarters[c][2] - quarters[c][0]) or stats[c] or 1.0) for c, sign in indicators.items()]
    return rows.withColumn(name, sum(scaled[1:], scaled[0]) / len(scaled))


@query("SES04", over("SELECT participant_id, session_year, efficacy <= -0.5 AS low_engagement, efficacy >= 0.5 AS high_engagement FROM ef", SESSIONS, _SESZ))
def ses04(spark, sf):
    e = F.col("efficacy")
    return session_indices(tables.sessions(spark, sf)).select("participant_id", "session_year", (e <= -0.5).alias("low_engagement"), (e >= 0.5).alias("high_engagement"))


@query("SES05", over(f"SELECT a.participant_id, {r6('a.speed AS stroop_speed', 'b.speed AS flanker_speed')} FROM sessions a JOIN sessions b ON a.participant_id = b.participant_id AND a.session_year = 1996 AND b.session_year = 1997", SESSIONS))
def ses05(spark, sf):
    s = tables.sessions(spark, sf)
    side = lambda y, n: s.filter(f"session_year = {y}").select("participant_id", F.col("speed").alias(n))
    return joins.validated_join(side(1996, "stroop_speed"), side(1997, "flanker_speed"), ["participant_id"], validate="one_to_one")


_PCT = lambda c: f"(rank() OVER (ORDER BY {c} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER ()"


@query("SES06", over("SELECT participant_id, session_year, CASE WHEN ra >= 0.75 AND rb <= 0.25 THEN 'fast_inaccurate' WHEN ra <= 0.25 AND rb >= 0.75 THEN 'slow_accurate' WHEN ra >= 0.75 AND rb >= 0.75 THEN 'both_high' ELSE 'mixed' END AS profile FROM r", SESSIONS, f"r AS (SELECT *, {_PCT('speed')} AS ra, {_PCT('accuracy')} AS rb FROM sessions)"))
def ses06(spark, sf):
    """Divergence profiles from percentile ranks; a later rule wins, so it stands first."""
    s = staged(tables.sessions(spark, sf).select("participant_id", "session_year", "speed", "accuracy"), "sessions")  # ranked values are joined back: they are computed once
    for c, name in (("speed", "a"), ("accuracy", "b")):
        s = s.join(st.ranks(s, c).select(c, (F.col("rank") / F.col("n")).alias(name)), c, "left")
    hi, lo = lambda c: F.col(c) >= 0.75, lambda c: F.col(c) <= 0.25
    rule = F.when(hi("a") & lo("b"), "fast_inaccurate").when(lo("a") & hi("b"), "slow_accurate").when(hi("a") & hi("b"), "both_high").otherwise("mixed")
    return s.select("participant_id", "session_year", rule.alias("profile"))


# --- inference -------------------------------------------------------------------------------------------------------------------------------------------------------


@query("STA01", over(f"SELECT session_type, count(*) AS n, {r6('CASE WHEN count(*) >= 4 THEN corr(urgent, low) END AS r')} FROM sessions WHERE urgent IS NOT NULL AND low IS NOT NULL GROUP BY 1", SESSIONS))
def sta01(spark, sf):
    return tables.sessions(spark, sf).filter("urgent is not null and low is not null").groupBy("session_type").agg(F.count("*").alias("n"), correlation(F.col("urgent"), F.col("low"), 4).alias("r"))


@query("STA02", over(_SPEARMAN("sessions", "urgent", "low"), SESSIONS))
def sta02(spark, sf):
    return st.spearman(tables.sessions(spark, sf), "urgent", "low").select("n", "rho")


@query("STA03", over(f"""SELECT 'session' AS level, n, rho FROM ({_SPEARMAN('b', 'urgent', 'low')}) UNION ALL SELECT 'between', n, rho FROM ({_SPEARMAN('m', 'urgent', 'low')})
  UNION ALL SELECT 'within', count(*), {r6('corr(u, l) AS rho')} FROM (SELECT urgent - avg(urgent) OVER p AS u, low - avg(low) OVER p AS l, count(*) OVER p AS k FROM b WINDOW p AS (PARTITION BY participant_id)) WHERE k >= 2""",
  SESSIONS, "b AS (SELECT * FROM sessions WHERE urgent IS NOT NULL AND low IS NOT NULL)", "m AS (SELECT participant_id, avg(urgent) AS urgent, avg(low) AS low FROM b GROUP BY 1)"))
def sta03(spark, sf):
    """One association at three levels: sessions and persons by rank, within persons by centred values."""
    b = staged(tables.sessions(spark, sf).filter("urgent is not null and low is not null").select("participant_id", "urgent", "low"), "sessions")
    people = b.groupBy("participant_id").agg(F.avg("urgent").alias("urgent"), F.avg("low").alias("low"))
    both = b.withColumn("level", F.lit("session")).unionByName(people.withColumn("level", F.lit("between")))
    w = Window.partitionBy("participant_id")
    centred = b.withColumns({"u": F.col("urgent") - F.avg("urgent").over(w), "l": F.col("low") - F.avg("low").over(w), "k": F.count(F.lit(1)).over(w)}).filter("k >= 2")
    within = centred.agg(F.count("*").alias("n"), correlation(F.col("u"), F.col("l"), 4).alias("rho"))
    return st.spearman(both, "urgent", "low", keys=["level"]).unionByName(within.select(F.lit("within").alias("level"), "n", "rho"))


_AGREE = ["2 * covar_pop(urgent, low) / (var_pop(urgent) + var_pop(low) + (avg(urgent) - avg(low)) * (avg(urgent) - avg(low))) AS ccc"]


@query("STA04", over(f"SELECT session_type, {r6(*_AGREE)} FROM sessions WHERE urgent IS NOT NULL AND low IS NOT NULL GROUP BY 1", SESSIONS))
def sta04(spark, sf):
    return tables.sessions(spark, sf).groupBy("session_type").agg(st.concordance(F.col("urgent"), F.col("low")).alias("ccc"))


@query("STA05", over(f"SELECT count(*) AS n, {r6('corr(urgent, low) AS pearson', *_AGREE, 'avg(urgent - low) AS bias', 'avg(abs(urgent - low)) AS mae', 'sqrt(avg((urgent - low) * (urgent - low))) AS rmse')} FROM sessions WHERE urgent IS NOT NULL AND low IS NOT NULL", SESSIONS))
def sta05(spark, sf):
    a, b = F.col("urgent"), F.col("low")
    d = a - b
    return tables.sessions(spark, sf).filter("urgent is not null and low is not null").agg(F.count("*").alias("n"), correlation(a, b, 4).alias("pearson"), st.concordance(a, b).alias("ccc"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


@query("STA06", over(f"SELECT tp, tn, fp, fn, {r6('tp / (tp + fn) AS sensitivity', 'tn / (tn + fp) AS specificity', '(tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy', '((tp + tn) / n - ch) / (1 - ch) AS kappa')} FROM (SELECT *, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS ch FROM (SELECT count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND NOT f) AS tn, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*)::DOUBLE AS n FROM (SELECT speed > 250000 AS t, urgent > 250000 AS f FROM sessions WHERE urgent IS NOT NULL)))", SESSIONS))
def sta06(spark, sf):
    return st.binary_agreement(tables.sessions(spark, sf).filter("urgent is not null"), F.col("speed") > 250000, F.col("urgent") > 250000)


#: Directional effects: domain (task) -> outcome -> expected sign over the blocks and windows of a participant.
EFFECTS = {
    "Stroop": {"median_rt_ms": 1, "accuracy": -1, "rt_cv": 1, "throughput_proxy": -1},
    "Flanker": {"accuracy": -1, "throughput_proxy": -1, "median_rt_ms": 1, "rt_cv": 1, "rt_volatility": 1},
    "Simon": {"median_rt_ms": 1, "rt_cv": 1, "accuracy": -1, "throughput_proxy": -1, "rt_volatility": 1},
}
_EFFECTS = f"""fx(domain, outcome, expected) AS (VALUES {', '.join(f"('{d}', '{o}', {s})" for d, e in EFFECTS.items() for o, s in e.items())}),
fl AS (SELECT task_family AS domain, participant_id, 10 * block_raw + window_index AS x, unnest(['median_rt_ms', 'accuracy', 'rt_cv', 'throughput_proxy', 'rt_volatility']) AS outcome,
  unnest([median_rt_ms, accuracy, rt_cv, throughput_proxy, rt_volatility]) AS y FROM summary WHERE window_size = 16),
fs AS (SELECT domain, outcome, expected, CASE WHEN count(y) >= 3 AND count(DISTINCT x) FILTER (y IS NOT NULL) >= 2 THEN round(regr_slope(y, x), 9) END AS s FROM fl JOIN fx USING (domain, outcome) GROUP BY domain, outcome, expected, participant_id),
fe AS (SELECT domain, outcome, expected, count(s) AS groups, median(s) AS median_slope, avg((sign(s) = expected)::INT) AS share_expected FROM fs GROUP BY ALL),
fv AS (SELECT *, CASE WHEN groups < 5 THEN 'not_testable' WHEN sign(median_slope) = expected AND share_expected >= 0.6 THEN 'supported' ELSE 'not_supported' END AS verdict FROM fe),
fd AS (SELECT *, avg((verdict = 'supported')::INT) OVER (PARTITION BY domain) AS domain_share FROM fv)"""


def effects(spark, sf) -> DataFrame:
    s = summaries(spark, sf).filter("window_size = 16").withColumn("x", 10 * F.col("block_raw") + F.col("window_index"))
    return st.directional_effects({d: (s.filter(F.col("task_family") == d), "x", e) for d, e in EFFECTS.items()}, "participant_id")


@query("STA10", upto("summary", f"SELECT domain, outcome, expected, groups, {r6('median_slope', 'share_expected', 'domain_share')}, verdict FROM fd", _EFFECTS))
def sta10(spark, sf):
    """Fourteen directional effects in three domains: enough groups, median in the direction, 60 % of them too."""
    return effects(spark, sf)


@query("STA11", upto("transitions", _SPEARMAN("l", "rt_volatility", "next_accuracy"), "l AS (SELECT * FROM transitions WHERE window_size = 12)"))
def sta11(spark, sf):
    return st.spearman(linked(spark, sf).filter("window_size = 12"), "rt_volatility", "next_accuracy", 20).select("n", "rho")
