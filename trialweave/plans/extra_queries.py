"""Queries over what composes other operators: readers, parsers, windows by share of rows, coverage, alignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import row_rms
from trialweave.operators import dynamics, ecg, heart, joins, models, resampling, windows
from trialweave.plans.analysis_queries import _SERIES, _SPREAD, _STEPS, hrv, profiles16, rt_series
from trialweave.plans.model_queries import FEATURES, scaled, scratch
from trialweave.plans.oracle import BOUNDARY as B_SQL, RR, matched, over, r6, upto
from trialweave.plans.staging import staged
from trialweave.plans.trial_queries import SQL, linked, query, trials
from trialweave.sources import files, tables
from trialweave.sources.tables import BOUNDARY, table

# --- readers ---------------------------------------------------------------------------------------------------------------------------------------------------------


@query("SRC05", SQL["PRJ10"])
def src05(spark, sf):
    """A partitioned scan with the mapping issue of each row; no chunk loop."""
    issue = F.when(F.col("block_raw") < 0, "missing_block").when(F.col("congruency") == "unknown", "unknown_congruency").when(F.col("rt_ms").isNull(), "unknown_accuracy")
    return trials(spark, sf).select("observation_id", issue.alias("mapping_issue"))


@query("SRC10", over(f"SELECT participant_id::VARCHAR AS participant_id, pos, {r6('rr_ms')} FROM rr", RR))
def src10(spark, sf):
    """Recordings written as text, one file each and line by line, and read in order."""
    path = scratch(spark, "")
    rr = tables.rr_intervals(spark, sf).select(F.col("rr_ms").cast("string").alias("value"), F.concat(F.lit("p"), F.col("participant_id").cast("string")).alias("name"), "pos")
    # Tasks move their files in place themselves: else the driver does, one by one.
    write = rr.repartition("name").sortWithinPartitions("name", "pos").drop("pos").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    write.partitionBy("name").text(path)
    return files.read_rr_files(spark, path, r"name=p(\d+)", empty=False).select("participant_id", "pos", "rr_ms")


@query("SRC11", over(f"SELECT participant_id, count(*) AS intervals, {r6('sum(rr_ms) / 3600000 AS hours', 'median(rr_ms) AS median_rr', 'min(rr_ms) AS min_rr', 'max(rr_ms) AS max_rr')} FROM rr GROUP BY 1", RR))
def src11(spark, sf):
    return files.rr_inventory(tables.rr_intervals(spark, sf).withColumn("blank", F.lit(False))).select("participant_id", "intervals", "hours", "median_rr", "min_rr", "max_rr")


@query("SRC14", f"SELECT {r6('l_extendedprice AS onset_seconds', 'l_quantity AS duration_seconds')}, l_linenumber AS event_code FROM lineitem WHERE l_returnflag <> 'A'")
def src14(spark, sf):
    """Annotations whose description isn't a number aren't events."""
    a = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("onset"), F.col("l_quantity").alias("duration"), F.when(F.col("l_returnflag") == "A", "boundary").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).alias("description"))
    return files.annotation_events(a)


@query("SRC15", f"SELECT c_custkey AS participant_id, {r6('c_acctbal AS score')} FROM customer")
def src15(spark, sf):
    """A questionnaire table with its columns renamed."""
    path = files.write_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), scratch(spark, ".csv"))
    return files.read_table(spark, path, schema="c_custkey long, c_acctbal double").withColumnsRenamed({"c_custkey": "participant_id", "c_acctbal": "score"})


@query("SRC20", f"SELECT p_brand AS feature, 'C' || p_size AS component, {r6('sum(p_retailprice) AS loading')} FROM part WHERE p_type = 'ECONOMY' GROUP BY 1, 2")
def src20(spark, sf):
    t = table(spark, sf, "part").groupBy(F.when(F.col("p_type") == "ECONOMY", "within").otherwise("between").alias("mode"), F.concat("p_brand", F.lit("__within")).alias("feature"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("component")).agg(F.sum("p_retailprice").alias("loading"))
    return files.reference_loadings(t)


# --- series ----------------------------------------------------------------------------------------------------------------------------------------------------------

_RANGE12 = f"""SELECT window_id, {r6('-sum(p * ln(p)) / ln(12) AS diff_entropy')} FROM (SELECT window_id, k / sum(k) OVER (PARTITION BY window_id) AS p, sum(k) OVER (PARTITION BY window_id) AS n FROM (SELECT window_id, bin, count(*) AS k FROM (
  SELECT window_id, greatest(least(len(list_filter(range(13), lambda e: lo + e * ((hi - lo) / 12) <= d)) - 1, 11), 0) AS bin FROM (SELECT window_id, d, min(d) OVER (PARTITION BY window_id) AS lo, max(d) OVER (PARTITION BY window_id) AS hi FROM st WHERE d IS NOT NULL) WHERE hi > lo) GROUP BY ALL)) WHERE n >= 10 GROUP BY 1"""


@query("DYN08", upto("members", _RANGE12, _SERIES, _STEPS))
def dyn08(spark, sf):
    """Entropy of steps over twelve equal bins of their range, from ten steps on."""
    return dynamics.range_entropy(rt_series(spark, sf), "window_id")


_TEMPLATES = "te AS (SELECT window_id, i, x, lead(x) OVER w AS y, 0.2 * stddev_samp(x) OVER (PARTITION BY window_id) AS r FROM ser WINDOW w AS (PARTITION BY window_id ORDER BY i))"


@query("JOIN15", upto("members", "SELECT a.window_id, count(b.i) AS pairs FROM te a LEFT JOIN te b ON a.window_id = b.window_id AND a.i < b.i AND abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r WHERE a.y IS NOT NULL GROUP BY 1", _SERIES, _TEMPLATES))
def join15(spark, sf):
    """Template pairs of a window within a tolerance: counted by their sorted first values, long series by several tasks."""
    return dynamics.matched_templates(rt_series(spark, sf), "window_id").select("window_id", F.col("two").alias("pairs"))


# --- behaviour, intervals --------------------------------------------------------------------------------------------------------------------------------------------


@query("BEH06", """WITH e AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
g AS (SELECT user_id, seg, min(event_id) FILTER (event_type = 'view') AS stimulus, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) AS code, min((ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) AS rt,
  min((ts, event_id)) FILTER (event_type = 'error') AS st FROM e WHERE seg > 0 GROUP BY ALL)
SELECT user_id, stimulus, CASE WHEN st IS NULL OR rt < st THEN CASE code WHEN 'purchase' THEN 'left' WHEN 'signup' THEN 'right' END END AS response FROM g""")
def beh06(spark, sf):
    """Trials of an event stream with the name of their response's code."""
    e = table(spark, sf, "events")
    kind = lambda *x: F.col("event_type").isin(*x)
    out = joins.forward_responses(e, ["user_id"], ["ts", "event_id"], kind("view"), kind("purchase", "signup"), kind("error"))
    names = F.create_map(F.lit("purchase"), F.lit("left"), F.lit("signup"), F.lit("right"))
    codes = e.select(F.col("event_id").alias("r"), F.try_element_at(names, F.col("event_type")).alias("response"))
    out = out.select("user_id", F.col("stimulus.event_id").alias("stimulus"), F.col("response.event_id").alias("r"))
    return out.join(codes, "r", "left").select("user_id", "stimulus", "response")


@query("TW10", upto("trials", f"SELECT {B_SQL}, CAST(floor(4 * (trial_raw - 1) / n) AS BIGINT) AS quarter, count(*) AS n_trials, {r6('avg(correct) AS accuracy')} FROM (SELECT *, count(*) OVER (PARTITION BY {B_SQL}) AS n FROM trials) GROUP BY ALL"))
def tw10(spark, sf):
    """Windows by the share of a block's rows."""
    w = Window.partitionBy(*BOUNDARY)
    rows = trials(spark, sf).withColumn("quarter", F.floor(4 * (F.col("trial_raw") - 1) / F.count(F.lit(1)).over(w)))
    return rows.groupBy(*BOUNDARY, "quarter").agg(F.count("*").alias("n_trials"), F.avg("correct").alias("accuracy"))


@query("TW09")
def tw09(spark, sf):
    """Components from at most so many hours a participant (2, 4 and 8; a tenth and a twentieth of one for these short recordings) of evenly spaced windows, against those from all."""
    cols, seconds = ["mean_nn", "sdnn", "rmssd", "pnn50"], 60
    rows = staged(hrv(spark, sf).dropna(subset=cols), "hrv")
    person = Window.partitionBy("participant_id")
    rows = staged(rows.withColumns({"place": F.row_number().over(person.orderBy("window_index")) - 1, "n": F.count(F.lit(1)).over(person)}), "placed")
    loadings = lambda part: models.components(models.moments(models.standard_scale(models.person_centre(part, "participant_id", cols), cols), cols)[2], 3)[0]
    full = loadings(rows)
    out = []
    for hours in (0.05, 0.1, 2.0, 4.0, 8.0):
        part = staged(rows.filter(windows.spaced(F.col("place"), F.col("n"), int(hours * 3600 // seconds))).select("participant_id", *cols), "cap")
        load = loadings(part)
        direct = np.abs(joins.match_components(full, load)[1])
        out.append((hours, part.count(), *[float(v) for v in direct], float(models.subspace_similarity(full[:, 1:3], load[:, 1:3])[0].min()), float(models.subspace_similarity(full, load)[0].min())))
    return spark.createDataFrame(out, "maximum_hours double, n_windows long, c1_congruence double, c2_congruence double, c3_congruence double, secondary_similarity double, all_similarity double")


#: Seconds, role and least beats of a recording's windows.
LENGTHS = ((10, "replication", 5), (60, "extended", 30), (120, "extended", 30), (180, "extended", 30), (None, "benchmark", 30))
#: Samples a second, and seconds of a chunk, of the waveforms made from intervals.
RATE, CHUNK = 100.0, 30


def waveform(r: dict) -> np.ndarray:
    """The samples of a chunk from the lengths of its beats."""
    n = np.asarray(r["beats"], dtype=np.int64)
    place = np.arange(n.sum())
    bump = lambda x, at, width: np.exp(-(((x - at) / width) ** 2))
    t = np.arange(max(n, default=0)) / RATE
    clock = (r["origin"] + place) / RATE
    return (bump(t, 0.15, 0.012) + 0.2 * bump(t, 0.40, 0.05))[place - np.repeat(np.cumsum(n) - n, n)] + 0.4 * np.sin(0.2 * np.pi * clock) + 0.1 * np.sin(2 * np.pi * 49.0 * clock)


def waveforms(spark, sf) -> ecg.Waves:
    """A waveform for each list of intervals: at each beat a narrow wave and a broad one after it, on a slow drift with mains hum; in chunks of whole beats, which are made where they are read."""
    w = Window.partitionBy("participant_id").orderBy("pos")
    good = tables.rr_intervals(spark, sf).filter("rr_ms > 0 and not isnan(rr_ms)").withColumn("n", F.round(F.col("rr_ms") * RATE / 1000).cast("int"))
    beats = good.withColumn("end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("n"))
    parts = beats.groupBy("participant_id", F.floor(F.col("start") / (CHUNK * RATE)).alias("chunk")).agg(
        F.min("start").alias("start"), F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("x")
    )
    return ecg.Waves.compact(parts.select("participant_id", "chunk", "start", "size", F.col("start").alias("origin"), F.col("x.n").alias("beats")), ["participant_id"], waveform)


@query("HRV01")
def hrv01(spark, sf):
    """Spread of each chunk of a waveform before and after the zero-phase band-pass."""
    return ecg.quality(waveforms(spark, sf), ["participant_id"], RATE)


@query("HRV02")
def hrv02(spark, sf):
    """Beats of two detectors on the filtered waveform, and their agreement."""
    beats = staged(ecg.detect(ecg.filtered(waveforms(spark, sf), ["participant_id"], RATE), ["participant_id"], RATE), "beats")
    return ecg.concordance(beats, ["participant_id"], RATE)


def two_detectors(spark, sf) -> DataFrame:
    """Beats of a recording (side 0) and those of a second detector (1), which misses a tenth of them and is late by up to 110 ms."""
    w = Window.partitionBy("participant_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    clock = tables.rr_intervals(spark, sf).withColumn("t", F.sum("rr_ms").over(w).cast("double"))
    # Both lists from one row: they stay where the recording is.
    first = F.struct(F.lit(0).alias("side"), F.col("t"))
    second = F.struct(F.lit(1).alias("side"), (F.col("t") + (F.col("pos") % 12) * 10).alias("t"))
    return clock.select("participant_id", F.inline(F.when(F.col("pos") % 10 != 0, F.array(first, second)).otherwise(F.array(first))))


@query("HRV03", matched("participant_id", f"WITH {RR}, ck AS (SELECT participant_id, pos, sum(rr_ms) OVER (PARTITION BY participant_id ORDER BY pos)::DOUBLE AS t FROM rr) SELECT participant_id, 0 AS side, t FROM ck UNION ALL SELECT participant_id, 1, t + (pos % 12) * 10 FROM ck WHERE pos % 10 <> 0", 80.0))
def hrv03(spark, sf):
    """Concordance of two peak lists of a recording within 80 ms, the second one shifted."""
    n = tables.tasks(table(spark, sf, "lineitem"))
    return joins.band_match(two_detectors(spark, sf), ["participant_id"], 80.0, n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)


_PEAKS = """ck AS (SELECT participant_id, pos, sum(rr_ms) OVER (PARTITION BY participant_id ORDER BY pos) AS c FROM rr),
pk AS (SELECT participant_id, CAST(floor(c / 60000) AS BIGINT) AS window_index, participant_id || ':' || CAST(floor(c / 60000) AS BIGINT) AS w, pos, c - floor(c / 60000) * 60000 AS t FROM ck),
nb AS (SELECT participant_id, window_index, w, count(*) AS n_beats FROM pk GROUP BY ALL),
p1 AS (SELECT *, coalesce(rr BETWEEN 300 AND 2000, false) AS ok, median(CASE WHEN rr BETWEEN 300 AND 2000 THEN rr END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS m
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY w ORDER BY pos) AS rr FROM pk) WHERE rr IS NOT NULL),
p2 AS (SELECT *, CASE WHEN NOT ok OR iso THEN m ELSE rr END AS x FROM (SELECT *, coalesce(m > 0 AND abs(rr - m) > 0.2 * m, false) AS iso FROM p1)),
qu AS (SELECT w, avg((x IS NOT NULL)::INT) AS valid_rr_fraction, avg((NOT ok OR iso)::INT) AS rr_corrected_fraction, avg((NOT ok)::INT) AS rr_physiological_invalid_fraction, avg(iso::INT) AS rr_isolated_outlier_fraction FROM p2 GROUP BY 1),
ser AS (SELECT w AS window_id, row_number() OVER (PARTITION BY w ORDER BY pos) - 1 AS i, x, t / 1000 AS s FROM p2 WHERE x IS NOT NULL),
tf AS (SELECT window_id, count(*) AS n, avg(x) AS mean_nn_ms, sqrt(avg(d * d)) AS rmssd, stddev_samp(x) AS sdnn_ms, avg((abs(d) > 20)::INT) AS pnn20, avg((abs(d) > 50)::INT) AS pnn50,
  CASE WHEN count(*) >= 3 AND max(s) > min(s) THEN regr_slope(60000 / x, s) * 60 END AS hr_slope_bpm_per_min, CASE WHEN count(*) >= 3 AND max(s) > min(s) THEN regr_slope(x, s) * 60 END AS nn_slope_ms_per_min,
  CASE WHEN count(l) >= 3 AND max(x) FILTER (l IS NOT NULL) > min(x) FILTER (l IS NOT NULL) AND max(l) > min(l) THEN corr(x, l) END AS hrv_lag1
  FROM (SELECT *, x - lag(x) OVER o AS d, lag(x) OVER o AS l FROM ser WINDOW o AS (PARTITION BY window_id ORDER BY i)) GROUP BY 1 HAVING count(*) >= 2),
dc AS (SELECT *, sum(x - mean) OVER (PARTITION BY window_id ORDER BY i) AS y FROM (SELECT *, avg(x) OVER p AS mean, stddev_pop(x) OVER p AS sd, count(*) OVER p AS n FROM ser WINDOW p AS (PARTITION BY window_id))),
dg AS (SELECT window_id, k, i // k AS part, regr_syy(y, i) - regr_sxy(y, i) * regr_sxy(y, i) / regr_sxx(y, i) AS sse FROM dc, generate_series(4, 16) AS g(k) WHERE n >= 40 AND sd > 0 AND n // k >= 4 AND i < n // k * k GROUP BY ALL),
da AS (SELECT window_id, CASE WHEN count(*) >= 4 THEN regr_slope(ln(f), ln(k)) END AS hrv_dfa_alpha1 FROM (SELECT window_id, k, sqrt(greatest(sum(sse), 0) / (count(*) * k)) AS f FROM dg GROUP BY window_id, k) WHERE f > 0 GROUP BY 1),
pe AS (SELECT window_id, -sum(p * ln(p)) / ln(6) AS hrv_perm_entropy3 FROM (SELECT window_id, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS p, sum(count(*)) OVER (PARTITION BY window_id) AS n
  FROM (SELECT window_id, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM ser WINDOW o AS (PARTITION BY window_id ORDER BY i)) WHERE c IS NOT NULL GROUP BY window_id, a <= b, b <= c, a <= c) WHERE n >= 3 GROUP BY 1),
te AS (SELECT *, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z, 0.2 * stddev_samp(x) OVER (PARTITION BY window_id) AS r, count(*) OVER (PARTITION BY window_id) AS n FROM ser WINDOW o AS (PARTITION BY window_id ORDER BY i)),
se AS (SELECT a.window_id, count(*) AS two, count(*) FILTER (abs(a.z - b.z) <= a.r) AS three FROM te a JOIN te b ON a.window_id = b.window_id AND a.i < b.i AND abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r WHERE a.n >= 20 AND a.r > 0 GROUP BY 1)"""
_ENTROPY12 = f"re AS ({_RANGE12})"
_WHY = """CASE WHEN n_beats < 2 THEN 'fewer than two detected beats' ELSE coalesce(nullif(concat_ws('|', CASE WHEN n_beats < 30 THEN 'insufficient beats' END, CASE WHEN rr_corrected_fraction > 0.05 THEN 'more than 5% RR intervals corrected' END,
  CASE WHEN valid_rr_fraction < 0.95 THEN 'less than 95% valid RR intervals' END), ''), 'ok') END"""
_SD2 = "(2 * sdnn_ms * sdnn_ms - 0.5 * rmssd * rmssd)"
_BEAT_COLUMNS = [
    "valid_rr_fraction", "rr_corrected_fraction", "rr_physiological_invalid_fraction", "rr_isolated_outlier_fraction", "60000 / mean_nn_ms AS mean_hr_bpm", "mean_nn_ms", "CASE WHEN rmssd > 0 THEN ln(rmssd) END AS log_rmssd", "sdnn_ms",
    "sdnn_ms / mean_nn_ms AS cvnn", "pnn20", "pnn50", "rmssd / sqrt(2) AS sd1_ms", f"CASE WHEN {_SD2} > 0 THEN sqrt({_SD2}) END AS sd2_ms", f"CASE WHEN {_SD2} > 0 THEN rmssd / sqrt(2) / sqrt({_SD2}) END AS sd1_sd2",
    "hr_slope_bpm_per_min", "nn_slope_ms_per_min", "hrv_dfa_alpha1", "hrv_lag1", "CASE WHEN sp.n >= 3 AND sp.sd > 0 THEN sp.rmssd_ / sp.sd END AS hrv_roughness", "sign_change AS hrv_sign_change", "hrv_perm_entropy3",
    "diff_entropy AS hrv_difference_entropy", "CASE WHEN three > 0 THEN -ln(three / two) END AS hrv_sample_entropy",
]


@query("HRV05", over(f"""SELECT participant_id, window_index, n_beats, ({_WHY}) = 'ok' AS ecg_quality_pass, {_WHY} AS ecg_quality_reason, {r6(*_BEAT_COLUMNS)}
  FROM nb LEFT JOIN qu USING (w) LEFT JOIN tf ON tf.window_id = w LEFT JOIN da ON da.window_id = w LEFT JOIN (SELECT window_id, n, sd, rmssd AS rmssd_ FROM sp) AS sp ON sp.window_id = w LEFT JOIN tu ON tu.window_id = w
  LEFT JOIN pe ON pe.window_id = w LEFT JOIN re ON re.window_id = w LEFT JOIN se ON se.window_id = w""", RR, _PEAKS, _STEPS, _SPREAD, _ENTROPY12))
def hrv05(spark, sf):
    """Quality, its reasons and nineteen features of each minute's beats."""
    w = Window.partitionBy("participant_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    clock = tables.rr_intervals(spark, sf).withColumn("c", F.sum("rr_ms").over(w))
    minute = F.floor(F.col("c") / 60000)
    return heart.peak_features(clock.select("participant_id", minute.alias("window_index"), (F.col("c") - minute * 60000).alias("t")), ["participant_id", "window_index"])


@query("HRV08_paths")
def hrv08_paths(spark, sf):
    """Windows of all lengths of recorded waveforms: those of 10 seconds from the waveform at half the rate with a band-pass of its own, the others from the waveform itself."""
    raw = waveforms(spark, sf)
    seconds = raw.rows.groupBy("participant_id").agg((F.sum("size") / RATE).alias("seconds"))
    paths = {
        "extended": (ecg.filtered(raw, ["participant_id"], RATE), RATE),
        "replication": (ecg.filtered(ecg.halved(raw, ["participant_id"]), ["participant_id"], RATE / 2, low=1.0, hum=None), RATE / 2),
    }
    beats = {name: (staged(ecg.detect(clean, ["participant_id"], rate), "beats"), rate) for name, (clean, rate) in paths.items()}
    keys = ["participant_id", "window_label", "role", "least", "window_index"]
    points = []
    for length, role, least in LENGTHS:
        found, rate = beats["replication" if role == "replication" else "extended"]
        at = F.col("sample") / rate
        index = F.floor(at / length) if length else F.lit(0).cast("long")
        inside = found.join(seconds, "participant_id").filter(index < F.floor(F.col("seconds") / length)) if length else found
        points.append(inside.select(
            "participant_id", F.lit(str(length or "full")).alias("window_label"), F.lit(role).alias("role"), F.lit(least).alias("least"), index.alias("window_index"),
            (F.col("detector") != "energy").cast("int").alias("side"), (1000 * (at - index * (length or 0))).alias("t"),
        ))
    rows = staged(reduce(DataFrame.unionByName, points), "points")
    agreement = joins.band_match(rows, keys, 80.0).select(*keys, F.col("concordance").alias("detector_concordance"), (1 - F.col("concordance")).alias("detector_unmatched_rate"))
    out = heart.peak_features(rows.filter("side = 0").select(*keys, "t"), keys, least=F.col("least")).join(agreement, keys)
    return out.withColumn("detector_disagreement_flag", F.col("detector_unmatched_rate") > 0.01).drop("least")


@query("HRV09", over(f"SELECT participant_id, {r6('CASE WHEN short <= 0.2 THEN mean END AS mean_nn')}, CASE WHEN short > 0.2 THEN 'too many short intervals' END AS error FROM (SELECT participant_id, avg(rr_ms) AS mean, avg((rr_ms < 300)::INT) AS short FROM rr GROUP BY 1)", RR))
def hrv09(spark, sf):
    """Recordings by themselves; one that fails is a row with its error."""
    x = F.col("rr_ms")
    out = tables.rr_intervals(spark, sf).groupBy("participant_id").agg(F.avg(x).alias("mean"), F.avg((x < 300).cast("double")).alias("short"))
    failed = F.col("short") > 0.2
    return out.select("participant_id", F.when(~failed, F.col("mean")).alias("mean_nn"), F.when(failed, "too many short intervals").alias("error"))


# --- models ----------------------------------------------------------------------------------------------------------------------------------------------------------


@query("ML09")
def ml09(spark, sf):
    """Two to four components, with the agreement of labels on each dataset with those of a mixture that was fitted without it."""
    rows = staged(scaled(spark, sf).select("dataset_id", *FEATURES), "scaled")
    found = models.mixture_sweep(rows, FEATURES, ks=(2, 3, 4), kinds=("diag",))
    datasets = sorted(r[0] for r in rows.select("dataset_id").distinct().collect())
    rest = models.mixture_sweep(rows, FEATURES, ks=(2, 3, 4), kinds=("diag",), starts=10, replicates=len(datasets), weigh=models.leaving_out("dataset_id", datasets))
    out = []
    for m in found:
        mine = [x for x in rest if x["k"] == m["k"]]
        aris = [v for v in models.agreements(rows, FEATURES, m, mine, ("dataset_id", datasets)) if v is not None]
        out.append((m["k"], float(m["bic"]), m["valid"], len(aris), float(np.mean(aris)), float(np.min(aris))))
    return spark.createDataFrame(out, "k int, bic double, valid boolean, datasets int, mean_left_out_ari double, least_left_out_ari double")


@query("ML15")
def ml15(spark, sf):
    """Outcomes of the next window from behaviour, heart features of the participant's recording and their divergence, each set against behaviour alone; and the same with heart features dealt anew
    within a block."""
    cognitive, heart_columns = ["accuracy", "rt_volatility", "rt_cv"], ["heart_rate", "log_rmssd", "sdnn"]
    beats = hrv(spark, sf).select(F.col("participant_id").alias("who"), F.col("window_index").alias("minute"), *heart_columns)
    w = Window.partitionBy(*BOUNDARY)
    rows = linked(spark, sf).filter("window_size = 12").select(*BOUNDARY, "window_index", "next_accuracy", "next_throughput", *cognitive)
    rows = rows.withColumns({"who": F.split("participant_id", ":")[1].cast("long"), "time_on_task": F.col("window_index") / F.greatest(F.max("window_index").over(w), F.lit(1)), "minute": F.col("window_index").cast("long")})
    aligned = staged(rows.join(beats, ["who", "minute"], "left"), "aligned")
    # Heart features of a block's windows, dealt anew among them: a few rows a block.
    here, there = (F.row_number().over(w.orderBy(*order)).alias("k") for order in (["window_index"], [F.xxhash64(F.lit(42), "window_index", *BOUNDARY), "window_index"]))
    control = staged(aligned.select(*BOUNDARY, "window_index", here).join(aligned.select(*BOUNDARY, *heart_columns, there), [*BOUNDARY, "k"]).select(*BOUNDARY, "window_index", *heart_columns), "dealt")
    shuffled = aligned.drop(*heart_columns).join(control, [*BOUNDARY, "window_index"])
    base, kinds = ["block_raw", "time_on_task"], ["task_family"]
    divergence = ["cognitive_residual_magnitude", "autonomic_activation_residual", "mind_body_divergence_magnitude", "mind_body_coupling_product"]
    sets = {"A": base, "B": [*base, *cognitive], "C": [*base, *heart_columns], "D": [*base, *cognitive, *heart_columns], "E": [*base, *cognitive, *heart_columns, *divergence]}
    out = None
    for name, frame in (("temporally_aligned", aligned), ("within_task_shuffled_ecg", shuffled)):
        size, activation = row_rms([F.col(c) for c in cognitive], 1), F.col("heart_rate") - F.col("log_rmssd")
        full = frame.withColumns(dict(zip(divergence, (size, activation, F.abs(size - F.abs(activation)), size * activation), strict=True)))
        one = models.gains(models.grouped_ridge_models(full, ["next_accuracy", "next_throughput"], {m: (c, kinds) for m, c in sets.items()}, present=0.2), b="B").withColumn("control", F.lit(name))
        out = one if out is None else out.unionByName(one)
    inference = F.when(F.col("n_subjects") >= 8, "eligible_for_participant_permutation").otherwise("pilot_descriptive_only_fewer_than_8_participants")
    return out.withColumn("formal_incremental_inference_status", inference)


@query("STA14")
def sta14(spark, sf):
    """Profiles against prototypes: similarity, its lower bound by bootstrap, and the verdict."""
    cols = ["accuracy", "throughput_proxy", "rt_cv"]
    rows = models.standard_scale(profiles16(spark, sf).dropna(subset=cols).select("participant_id", "profile", *cols), cols)
    sums = staged(rows.groupBy("profile", "participant_id").agg(*[F.sum(c).alias(c) for c in cols]), "sums")
    prototypes = {"steady": np.array([1.0, 0.5, -1.0]), "fast": np.array([0.0, 1.0, 0.0]), "strained": np.array([-1.0, -0.5, 1.0])}
    cos = lambda v, p: float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-300))
    best = {}
    for r in sums.groupBy("profile").agg(*[F.sum(c).alias(c) for c in cols]).collect():  # a row a profile
        v = np.array([r[c] for c in cols])
        best[r["profile"]] = sorted(((cos(v, p), n) for n, p in prototypes.items()), reverse=True)

    @F.pandas_udf("double")
    def similarity(profile: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([cos(np.asarray(x, float), prototypes[best[p][0][1]]) for p, x in zip(profile, v, strict=True)], dtype=float)

    drawn = resampling.replicate_sums(sums, "participant_id", keys=["profile"], repetitions=100)
    lower = {r["profile"]: r["lower"] for r in drawn.select("profile", similarity("profile", "v").alias("s")).groupBy("profile").agg(F.percentile("s", F.lit(0.025)).alias("lower")).collect()}
    out = [(p, s[0][1], s[0][0], lower[p], bool(s[0][0] >= 0.7 and lower[p] >= 0.5 and s[0][0] - s[1][0] >= 0.15)) for p, s in best.items()]
    return spark.createDataFrame(out, "profile string, prototype string, similarity double, lower double, strong boolean")


#: The first eight bytes of the digest, the last one first, as a number.
_DIGITS = " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2))


@query("DYN16", upto("trials", f"SELECT participant_id, CAST(('0x' || {_DIGITS})::UBIGINT % 4294967295 AS BIGINT) AS seed FROM (SELECT DISTINCT participant_id, sha256('42|' || participant_id) AS h FROM trials)"))
def dyn16(spark, sf):
    """A seed for each participant that depends on its name only."""

    @F.pandas_udf("long")
    def seeds(s: pd.Series) -> pd.Series:
        return s.map(lambda v: dynamics.stable_seed(42, v))

    return trials(spark, sf).select("participant_id").distinct().withColumn("seed", seeds("participant_id"))
