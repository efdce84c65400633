"""Queries over models, resampling, gates, sources and sinks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators import cleaning, gates, models, pairs, resampling, residuals, stability, statistics as st
from trialweave.plans.analysis_queries import _EFFECTS, effects, hrv, profiles16
from trialweave.plans.oracle import BOUNDARY as B_SQL, SESSIONS, over, r6, upto
from trialweave.plans.staging import shared_dir, staged
from trialweave.plans.trial_queries import flagged, linked, members, query, summaries, update_series
from trialweave.sources import files, tables
from trialweave.sources.tables import table

FEATURES = ["accuracy", "rt_cv", "throughput_proxy", "rt_volatility", "rt_drift"]


def primary(spark, sf) -> DataFrame:
    return summaries(spark, sf).filter("window_size = 16 and dynamics_eligible").select("window_id", "participant_id", "dataset_id", "task_family", *FEATURES)


# --- residuals -------------------------------------------------------------------------------------------------------------------------------------------------------


def log_residuals(spark, sf) -> DataFrame:
    rows = flagged(spark, sf).withColumn("log_rt", F.when(F.col("valid_rt"), F.ln("rt_ms")))
    return residuals.residuals(rows, y="log_rt", name="log_rt_residual")


_DUMMY = {"x0": "incongruent", "x1": "neutral", "x2": "unknown"}


@query("RSD01", upto("flags", f"""SELECT observation_id, {r6(*(f"coalesce(congruency, 'unknown') = '{c}' AS {x}" for x, c in _DUMMY.items()), "least(k, 3) = 2 AS x3", "least(k, 3) = 3 AS x4", "CASE WHEN coalesce(stddev_pop(t) OVER s, 0) > 0 THEN (t - avg(t) OVER s) / stddev_pop(t) OVER s ELSE 0 END AS x5")}
  FROM (SELECT *, coalesce(trial_raw, median(trial_raw) OVER (PARTITION BY dataset_id)) AS t, dense_rank() OVER (PARTITION BY dataset_id ORDER BY block_raw NULLS FIRST) AS k FROM flags) WINDOW s AS (PARTITION BY dataset_id)"""))
def rsd01(spark, sf):
    rows, xs = residuals.design(flagged(spark, sf))
    return rows.select("observation_id", *xs)


@query("RSD02")
def rsd02(spark, sf):
    """Residuals of log time given condition, block, trend and person."""
    return log_residuals(spark, sf).select("observation_id", "log_rt_residual", "log_rt_residual_status")


@query("RSD03")
def rsd03(spark, sf):
    """The models of time and of log time side by side."""
    raw = residuals.residuals(flagged(spark, sf), y="rt_ms", name="rt_residual").select("observation_id", "rt_residual", "rt_residual_status")
    return raw.join(log_residuals(spark, sf).select("observation_id", "log_rt_residual"), "observation_id")


@query("RSD05")
def rsd05(spark, sf):
    """Residuals of window measures by task, block, order and time on task with a random intercept of the person, centred on the person; with the person's mean and what was fitted."""
    cols = ["throughput_proxy", "rt_cv"]
    rows = summaries(spark, sf).filter("window_size = 16 and dynamics_eligible").select("window_id", "participant_id", "task_family", "block_raw", "window_index", *cols)
    person = Window.partitionBy("participant_id")
    rows = rows.withColumn("place", F.row_number().over(person.orderBy("block_raw", "window_index", "window_id")) - 1)
    rows = staged(rows.withColumn("time_on_task", F.col("place") / F.greatest(F.count(F.lit(1)).over(person) - 1, F.lit(1))), "bridge")
    xs = {"place": F.col("place").cast("double"), "time_on_task": F.col("time_on_task")}
    for c in ("task_family", "block_raw"):
        levels = sorted(r[0] for r in rows.select(c).distinct().collect() if r[0] is not None)  # a few
        xs |= {f"{c}_{i}": (F.col(c) == v).cast("double") for i, v in enumerate(levels[1:])}
    rows = rows.withColumns(xs)
    out = None
    for y in cols:
        m = residuals.random_intercept(rows, y, list(xs), "participant_id")
        raw = F.col(y) - sum((F.lit(float(b or 0.0)) * F.col(x) for b, x in zip(m["beta"], xs, strict=True)), F.lit(0.0)) if m["status"] != "not_testable" else F.lit(None).cast("double")
        part = rows.withColumns({"raw": raw, "person_mean": F.avg(y).over(person)})
        part = part.select("window_id", F.lit(y).alias("feature"), "person_mean", (F.col("raw") - F.avg("raw").over(person)).alias("within_residual"), F.lit(m["status"]).alias("status"), F.lit(m["n_rows"]).alias("n_windows"), F.lit(m["n_participants"]).alias("n_participants"))
        out = part if out is None else out.unionByName(part)
    return out


@query("RSD06", upto("summary", f"SELECT window_id, {r6('(rt_cv - coalesce(m, gm)) / coalesce(nullif(i, 0), nullif(gi, 0), 1) AS adjusted')} FROM s LEFT JOIN t ON t.dataset_id = s.dataset_id, (SELECT median(rt_cv) AS gm, quantile_cont(rt_cv, 0.75) - quantile_cont(rt_cv, 0.25) AS gi FROM s WHERE block_raw = 0) g WHERE s.block_raw = 1",
  "s AS (SELECT * FROM summary WHERE window_size = 12)", "t AS (SELECT dataset_id, median(rt_cv) AS m, quantile_cont(rt_cv, 0.75) - quantile_cont(rt_cv, 0.25) AS i FROM s WHERE block_raw = 0 GROUP BY 1)"))
def rsd06(spark, sf):
    """Rows of the test part scaled by their source's training part, else by all of it."""
    s = summaries(spark, sf).filter("window_size = 12")
    m, i = F.median("rt_cv"), F.percentile("rt_cv", F.lit(0.75)) - F.percentile("rt_cv", F.lit(0.25))
    train = s.filter("block_raw = 0")
    by = train.groupBy("dataset_id").agg(m.alias("m"), i.alias("i"))
    g = train.agg(m.alias("gm"), i.alias("gi")).first()
    out = s.filter("block_raw = 1").join(by, "dataset_id", "left")
    z = F.lit(0.0)
    scale = F.coalesce(F.nullif("i", z), F.nullif(F.lit(g["gi"]).cast("double"), z), F.lit(1.0))
    return out.select("window_id", ((F.col("rt_cv") - F.coalesce("m", F.lit(g["gm"]).cast("double"))) / scale).alias("adjusted"))


# --- preprocessing ---------------------------------------------------------------------------------------------------------------------------------------------------


@query("ML01")
def ml01(spark, sf):
    """Chosen features, in order."""
    chosen = models.select_features(linked(spark, sf).filter("window_size = 16"), [*FEATURES, "control_cost_rt_ms", "post_error_slowing_ms", "next_accuracy"])
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "place int, feature string")


_S16 = "s AS (SELECT * FROM summary WHERE window_size = 16 AND dynamics_eligible)"


@query("ML02", upto("summary", f"SELECT window_id, {r6(*[f'coalesce({c}, (SELECT median({c}) FROM s)) AS {c}' for c in ('rt_cv', 'control_cost_rt_ms')])} FROM s", _S16))
def ml02(spark, sf):
    s = summaries(spark, sf).filter("window_size = 16 and dynamics_eligible")
    return models.median_impute(s, ["rt_cv", "control_cost_rt_ms"]).select("window_id", "rt_cv", "control_cost_rt_ms")


_SCALED = [f"({c} - (SELECT median({c}) FROM s)) / (SELECT coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) FROM s) AS {c}" for c in ("rt_cv", "rt_volatility")]


@query("ML03", upto("summary", f"SELECT window_id, {r6(*_SCALED, '(accuracy - avg(accuracy) OVER ()) / stddev_pop(accuracy) OVER () AS accuracy')} FROM s", _S16))
def ml03(spark, sf):
    s = summaries(spark, sf).filter("window_size = 16 and dynamics_eligible").select("window_id", "rt_cv", "rt_volatility", "accuracy")
    return models.standard_scale(models.robust_scale(s, ["rt_cv", "rt_volatility"]), ["accuracy"])


def scaled(spark, sf) -> DataFrame:
    return models.robust_scale(primary(spark, sf).dropna(subset=FEATURES), FEATURES)


# --- components ------------------------------------------------------------------------------------------------------------------------------------------------------


def loading_rows(spark, load: np.ndarray, share: np.ndarray, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, f"C{j + 1}", float(load[i, j]), float(share[j])) for i, f in enumerate(features) for j in range(load.shape[1])], "feature string, component string, loading double, share double")


@query("ML04")
def ml04(spark, sf):
    """Principal components to 80 % of the variance: loadings."""
    _, _, cov = models.moments(scaled(spark, sf), FEATURES)
    return loading_rows(spark, *models.components(cov), FEATURES)


def component_table(load: np.ndarray, share: np.ndarray, features: list[str], scores: DataFrame | None, key: str, name: str, info: dict) -> list[tuple]:
    """Loadings, and of the scores of each component their mean, spread and largest size."""
    out = [("loading", f, j + 1, float(load[i, j]), float(share[j])) for i, f in enumerate(features) for j in range(load.shape[1])]
    if scores is not None:
        columns = [f"{name}{j + 1}" for j in range(load.shape[1])]
        r = scores.agg(*[f(F.col(c)).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_pop), ("largest", lambda x: F.max(F.abs(x))))]).first()
        out += [("score", k, j + 1, r[f"{c}_{k}"], float(share[j])) for j, c in enumerate(columns) for k in ("mean", "sd", "largest")]
    return out + [("info", k, None, float(v) if v is not None else None, None) for k, v in info.items() if not isinstance(v, str)]


_COMPONENTS = "kind string, name string, component int, value double, explained_variance_ratio double"


@query("ML05")
def ml05(spark, sf):
    """Three components of person-centred, standardised features: loadings, scores and what was fitted."""
    load, share, scores, info = models.fixed_components(primary(spark, sf), "participant_id", FEATURES, 3, "window_id")
    return spark.createDataFrame(component_table(load, share, FEATURES, scores, "window_id", "component_", info), _COMPONENTS)


@query("ML06")
def ml06(spark, sf):
    """Components between persons (of their means) and within, of the features that are there in four fifths of the windows, as many as beat permuted columns."""
    cols = ["mean_nn", "sdnn", "rmssd", "pnn50", "log_rmssd", "slope_per_minute"]
    rows = staged(hrv(spark, sf).withColumn("row_id", F.concat_ws(":", "participant_id", "window_index")), "windows")
    out = []
    for mode in ("between", "within"):
        load, share, used, scores, info = models.autonomic_dimensions(rows, "participant_id", cols, mode, 4, "row_id")
        out += [(mode, info["status"], *r) for r in component_table(load, share, used, scores, "row_id", f"ans_{mode}_component_", info)]
    return spark.createDataFrame(out, f"mode string, status string, {_COMPONENTS}")


@query("RES07")
def res07(spark, sf):
    """How many components beat permuted columns."""
    rows = scaled(spark, sf)
    _, mean, real = models.moments(rows, FEATURES)
    null = models.permuted_covariances(rows, "window_id", FEATURES, mean, real)
    count = models.parallel_count(null.__getitem__, len(FEATURES), real, len(null)) if null else 1
    return spark.createDataFrame([(count,)], "components int")


@query("RES06")
def res06(spark, sf):
    """Congruence of components with those of participants drawn with replacement, and without each participant."""
    from trialweave.operators.joins import match_components

    sums = staged(models.person_scatter(models.standard_scale(primary(spark, sf), FEATURES), "participant_id", FEATURES), "scatter")
    p = len(FEATURES)
    loadings = lambda v: models.components(models.scatter_matrix(np.asarray(v[1:], float), float(v[0]), p), 2)[0]
    total = np.array(sums.agg(*[F.sum(f"`{c}`") for c in sums.columns[1:]]).first(), dtype=float)
    whole = loadings(total)

    def congruence(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.abs(match_components(whole, loadings(np.asarray(x, float)))[1]).tolist())

    drawn = resampling.replicate_sums(sums, "participant_id", repetitions=100).select(F.lit("drawn").alias("how"), "v")
    without = sums.select(F.lit("without").alias("how"), F.array(*[F.lit(float(t)) - F.col(f"`{c}`").cast("double") for t, c in zip(total, sums.columns[1:], strict=True)]).alias("v"))
    phi = drawn.unionByName(without).select("how", F.posexplode(F.pandas_udf("array<double>")(congruence)("v")).alias("j", "phi"))
    at = lambda how: F.when(F.col("how") == how, F.col("phi"))
    return phi.groupBy(F.concat(F.lit("C"), F.col("j") + 1).alias("component")).agg(F.percentile(at("drawn"), F.lit(0.05)).alias("bootstrap_p05"), F.min(at("without")).alias("least_without_one"))


@query("JOIN16")
def join16(spark, sf):
    """Components of two halves of the datasets lined up."""
    from trialweave.operators.joins import match_components

    rows = scaled(spark, sf)
    a, b = (models.components(models.moments(rows.filter(f"dataset_id % 2 = {k}"), FEATURES)[2], 3)[0] for k in (0, 1))
    best, phi = match_components(a, b)
    return spark.createDataFrame([(j + 1, int(best[j]) + 1, float(phi[j])) for j in range(3)], "component int, matched int, congruence double")


@query("STA12")
def sta12(spark, sf):
    rows = scaled(spark, sf)
    a, b = (models.components(models.moments(rows.filter(f"dataset_id % 2 = {k}"), FEATURES)[2], 2)[0] for k in (0, 1))
    s, angle = models.subspace_similarity(a, b)
    return spark.createDataFrame([(float(s.min()), float(s.mean()), angle)], "least double, mean double, largest_angle double")


# --- mixtures --------------------------------------------------------------------------------------------------------------------------------------------------------


def mixtures(spark, sf, **how) -> tuple[DataFrame, list[dict]]:
    rows = scaled(spark, sf)
    return rows, models.mixture_sweep(rows, FEATURES, **how)


def model_rows(spark, found: list[dict]) -> DataFrame:
    return spark.createDataFrame([(m["kind"], m["k"], float(m["bic"]), float(m["aic"]), m["valid"], float(m["posterior_entropy"])) for m in found], "covariance string, k int, bic double, aic double, valid boolean, posterior_entropy double")


@query("ML07")
def ml07(spark, sf):
    """Mixtures of one to eight components, with the silhouette of their labels; all of them share one pass over the pairs of rows."""
    rows, found = mixtures(spark, sf)
    several = [m for m in found if m["k"] > 1]
    spread = pairs.silhouettes(models.labelled(rows.select(*FEATURES), FEATURES, several), FEATURES, [f"m{i}" for i in range(len(several))])
    names = spark.createDataFrame([(f"m{i}", m["kind"], m["k"]) for i, m in enumerate(several)], "labelling string, covariance string, k int")
    return model_rows(spark, found).join(names.join(spread, "labelling").select("covariance", "k", "silhouette"), ["covariance", "k"], "left")


@query("ML11")
def ml11(spark, sf):
    """Session profiles: the best mixture's component of each session."""
    measures = ["speed", "spread", "accuracy"]
    rows = models.robust_scale(tables.sessions(spark, sf).dropna(subset=measures).select("participant_id", "session_year", *measures), measures)
    best = models.mixture_sweep(rows, ["speed", "spread", "accuracy"], ks=(1, 2, 3, 4, 5))[0]
    return models.assign(rows, ["speed", "spread", "accuracy"], best).select("participant_id", "session_year", "component", "posterior")


@query("ML12")
def ml12(spark, sf):
    """One component or two."""
    _, found = mixtures(spark, sf, ks=(1, 2), kinds=("diag",))
    bic = {m["k"]: m["bic"] for m in found}
    two = next(m for m in found if m["k"] == 2)
    return spark.createDataFrame([(float(bic[1] - bic[2]), bool(two["sizes"].min() >= max(20, 0.1 * two["n"])))], "bic_gain double, supported boolean")


@query("ML10")
def ml10(spark, sf):
    """Held-out log-likelihood of factor models (continuous) and of diagonal mixtures, over 20 random splits by participant; all from sums of each split."""
    splits = 20
    rows = staged(scaled(spark, sf).select("participant_id", *FEATURES), "scaled")
    train, test = (models.by_split("participant_id", splits, test=t) for t in (False, True))
    seen, held = (models.weighted_moments(rows, FEATURES, w) for w in (train, test))
    out = []
    usable = [r for r in range(splits) if r in seen and seen[r][0] >= 10 and held[r][0] >= 1]
    for r in usable:
        (_, mean, cov), (_, test_mean, test_cov) = seen[r], held[r]
        out.append(("independent", 0, models.gaussian_log_likelihood(mean, np.diag(np.maximum(np.diag(cov), 1e-9)), test_mean, test_cov)))
        for k in range(1, min(6, len(FEATURES)) + 1):
            load, noise = models.factor_analysis(cov, k)
            out.append(("factors", k, models.gaussian_log_likelihood(mean, load @ load.T + np.diag(noise), test_mean, test_cov)))
    found = [m for m in models.mixture_sweep(rows, FEATURES, ks=(2, 3, 4), kinds=("diag",), starts=5, replicates=splits, weigh=train) if m["replicate"] in usable]
    sums = models.mixture_sums(models.weighed(rows, FEATURES, splits, test), FEATURES, found)
    out += [("mixture", m["k"], float(sums[i][0] / held[m["replicate"]][0])) for i, m in enumerate(found)]
    each = spark.createDataFrame(out, "model string, k int, ll double")
    means = each.groupBy("model", "k").agg(F.avg("ll").alias("held_out_ll"), F.count("*").alias("splits"))
    best = means.agg(F.max(F.when(F.col("model") == "factors", F.col("held_out_ll"))).alias("factors"), F.max(F.when(F.col("model") == "mixture", F.col("held_out_ll"))).alias("mixture"))
    return means.join(best, F.lit(True)).select("model", "k", "held_out_ll", "splits", F.when(F.col("factors") >= F.col("mixture"), "continuous").otherwise("mixture").alias("verdict"))


@query("RES04")
def res04(spark, sf):
    """Stability of the best mixture: agreement of its labels with those of 50 bootstraps of participants, and with those of a mixture that never saw the dataset they are of.  Of density clusters: their overlap with those of 50 bootstraps."""
    rows, found = mixtures(spark, sf)
    rows = staged(rows.select("window_id", "participant_id", "dataset_id", *FEATURES), "scaled")
    base = next((m for m in found if m["k"] > 1 and m["valid"]), next(m for m in found if m["k"] > 1))
    same = {"ks": (base["k"],), "kinds": (base["kind"],)}
    drawn = models.mixture_sweep(rows, FEATURES, starts=5, replicates=50, weigh=models.by_participant("participant_id", 50), **same)
    datasets = sorted(r[0] for r in rows.select("dataset_id").distinct().collect())
    without = models.mixture_sweep(rows, FEATURES, starts=10, replicates=len(datasets), weigh=models.leaving_out("dataset_id", datasets), **same)
    out = [("bootstrap", str(m["replicate"]), v) for m, v in zip(drawn, models.agreements(rows, FEATURES, base, drawn), strict=True)]
    out += [("dataset_left_out", str(datasets[m["replicate"]]), v) for m, v in zip(without, models.agreements(rows, FEATURES, base, without, ("dataset_id", datasets)), strict=True)]
    dense = stability.density_stability(rows, FEATURES, "window_id", "participant_id", repetitions=50)
    mixed = spark.createDataFrame(out, "resample string, name string, ari double").withColumn("jaccard", F.lit(None).cast("double"))
    return mixed.unionByName(dense.select(F.lit("density_bootstrap").alias("resample"), F.col("replicate").cast("string").alias("name"), F.lit(None).cast("double").alias("ari"), "jaccard"))


# --- prediction ------------------------------------------------------------------------------------------------------------------------------------------------------


def next_rows(spark, sf) -> DataFrame:
    return linked(spark, sf).filter("window_size = 12").select("participant_id", "task_family", "next_accuracy", *FEATURES)


@query("ML13")
def ml13(spark, sf):
    return models.grouped_ridge_models(next_rows(spark, sf), ["next_accuracy"], {"all": (FEATURES, ["task_family"])})


@query("ML14")
def ml14(spark, sf):
    """Five nested feature sets on three outcomes of the next window, each against the first and the second."""
    wide = linked(spark, sf).filter("window_size = 12").select("participant_id", "task_family", "dataset_id", "next_accuracy", "next_throughput", "next_rt_cv", *FEATURES)
    rows = staged(wide, "next")
    best = models.mixture_sweep(models.robust_scale(rows.dropna(subset=FEATURES), FEATURES), FEATURES, ks=(3,), kinds=("diag",), starts=3)[0]
    rows = staged(models.assign(models.robust_scale(rows, FEATURES), FEATURES, best, "cluster").withColumn("cluster", F.col("cluster").cast("string")), "clustered")
    source = ["task_family"]
    sets = {
        "Model A": (["accuracy"], source), "Model B": (FEATURES[:2], source), "Model C": (FEATURES[:3], source), "Model D": (FEATURES, source), "Model E": (FEATURES, [*source, "cluster"]),
    }
    return models.gains(models.grouped_ridge_models(rows, ["next_accuracy", "next_throughput", "next_rt_cv"], sets), model_a="Model A", model_b="Model B")


@query("ML16")
def ml16(spark, sf):
    """A session measure from none, one, two and four others."""
    two = ["speed", "spread"]
    sets = {"intercept_only": ([], []), "engagement_only": (two[:1], []), "inhibitory_only": (two[1:], []), "two_dimensions": (two, []), "expanded": ([*two, "urgent", "low"], [])}
    return models.grouped_ridge_models(tables.sessions(spark, sf), ["accuracy"], sets)


@query("ML17")
def ml17(spark, sf):
    rows = profiles16(spark, sf).dropna(subset=FEATURES).select("participant_id", "profile", "rt_volatility", "rt_drift", "rt_cv")
    return models.classification_metrics(models.grouped_classification(rows, "profile", ["rt_volatility", "rt_drift", "rt_cv"]))


@query("ML18")
def ml18(spark, sf):
    """Recovery of profiles out of fold: recall by class, and the metrics of all rows and of the confident ones."""
    rows = profiles16(spark, sf).dropna(subset=FEATURES).select("participant_id", "profile", *FEATURES)
    out = staged(models.grouped_classification(rows, "profile", FEATURES), "recovered")
    right = (F.col("truth") == F.col("predicted")).cast("double")
    sure = F.col("confidence") >= 0.6
    all_rows = out.agg(F.avg("confidence").alias("mean_confidence"), F.avg(F.when(sure, right)).alias("confident_accuracy"), F.count_distinct("participant_id").alias("n_subjects"))
    metrics = models.classification_metrics(out).select("accuracy", "balanced_accuracy", "macro_f1", "log_loss", F.col("confident_share").alias("confident_coverage")).join(all_rows, F.lit(True))
    return out.groupBy("truth").agg(F.count("*").alias("n"), F.avg(right).alias("recall")).join(metrics, F.lit(True))


@query("ML19")
def ml19(spark, sf):
    """Whether labels can be told from the source: balanced accuracy against chance, and its p-value under labels permuted over participants."""
    rows = staged(profiles16(spark, sf).dropna(subset=FEATURES).select("participant_id", "task_family", *FEATURES), "confound")
    m = models.classification_metrics(models.grouped_classification(rows, "task_family", FEATURES)).select("n", F.col("balanced_accuracy").alias("observed"))
    null = models.permuted_accuracy(rows, "task_family", FEATURES, "participant_id", 100)
    k = rows.agg(F.count_distinct("task_family").alias("k"))
    p = null.join(m, F.lit(True)).agg(((1 + F.count(F.when(F.col("balanced_accuracy") >= F.col("observed"), 1))) / (1 + F.count("*"))).alias("p_value"), F.count("*").alias("permutations"))
    gain = (F.col("observed") - 1 / F.col("k")) / (1 - 1 / F.col("k"))
    return m.join(k, F.lit(True)).join(p, F.lit(True)).select("n", F.col("observed").alias("balanced_accuracy"), gain.alias("normalised_improvement"), "p_value", "permutations", ((gain >= 0.25) & (F.col("p_value") < 0.01)).alias("substantial"))


@query("ML20")
def ml20(spark, sf):
    return models.grouped_pls(summaries(spark, sf).filter("window_size = 16"), ["rt_volatility", "rt_cv", "rt_drift"], ["accuracy", "throughput_proxy"], "participant_id")


@query("ML21", upto("trials", "SELECT participant_id, CAST((row_number() OVER (PARTITION BY n ORDER BY participant_id) - 1 + n) % 5 AS INT) AS fold FROM (SELECT participant_id, count(*) AS n FROM trials GROUP BY 1)"))
def ml21(spark, sf):
    return models.group_folds(tables.trials(spark, sf), "participant_id").select("participant_id", "fold").distinct()


_CELLS = """z AS (SELECT o_orderstatus AS a, o_orderpriority AS b, o_totalprice, o_custkey FROM orders), c AS (SELECT a, b, count(*) AS k FROM z GROUP BY ALL), x AS (SELECT sum(k * (k - 1) / 2) AS s, sum(k) AS n FROM c),
p AS (SELECT sum(k * (k - 1) / 2) AS a FROM (SELECT sum(k) AS k FROM c GROUP BY a)), q AS (SELECT sum(k * (k - 1) / 2) AS b FROM (SELECT sum(k) AS k FROM c GROUP BY b)),
j AS (SELECT avg(best) AS jaccard FROM (SELECT a, max(k / (n + m - k)) AS best FROM (SELECT *, sum(k) OVER (PARTITION BY a) AS n, sum(k) OVER (PARTITION BY b) AS m FROM c) GROUP BY a)),
pr AS (SELECT l_suppkey, avg((l_returnflag = 'A')::INT) AS pa, avg((l_returnflag = 'N')::INT) AS pn, avg((l_returnflag = 'R')::INT) AS pr FROM lineitem GROUP BY 1),
en AS (SELECT avg((-greatest(pa, 1e-12) * ln(greatest(pa, 1e-12)) - greatest(pn, 1e-12) * ln(greatest(pn, 1e-12)) - greatest(pr, 1e-12) * ln(greatest(pr, 1e-12))) / ln(3)) AS entropy FROM pr),
r AS (SELECT p_partkey, p_size / 10.0 AS f1, p_retailprice / 100.0 AS f2, p_partkey % 3 AS l FROM part), nl AS (SELECT l, count(*) AS n FROM r GROUP BY 1),
d AS (SELECT u.p_partkey, u.l, v.l AS o, sum(sqrt((u.f1 - v.f1) ** 2 + (u.f2 - v.f2) ** 2)) AS t FROM r u, r v GROUP BY ALL),
si AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT p_partkey, max(t / (n - 1)) FILTER (d.l = o) AS a, min(t / n) FILTER (d.l <> o) AS b FROM d JOIN nl ON nl.l = o GROUP BY 1))"""


@query("ML22", f"""WITH {_CELLS}
SELECT n::BIGINT AS n, {r6('(s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) AS ari', 'silhouette', 'entropy AS posterior_entropy', 'jaccard AS partition_jaccard')} FROM x, p, q, si, en, j""")
def ml22(spark, sf):
    """Agreement of two labellings, their partition overlap, the silhouette of a labelling of parts and the entropy of suppliers' shares."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    flags = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.avg((F.col("l_returnflag") == f).cast("double")).alias(f) for f in "ANR"])
    rows = part.select((F.col("p_size") / 10.0).alias("f1"), (F.col("p_retailprice") / 100.0).alias("f2"), (F.col("p_partkey") % 3).alias("l"))
    out = models.adjusted_rand(orders, "o_orderstatus", "o_orderpriority")
    for one in (pairs.silhouettes(rows, ["f1", "f2"], ["l"]).select("silhouette"), models.posterior_entropy(flags, ["A", "N", "R"]), models.partition_jaccard(orders, "o_orderstatus", "o_orderpriority")):
        out = out.join(one, F.lit(True))
    return out


# --- resampling ------------------------------------------------------------------------------------------------------------------------------------------------------


@query("RES02")
def res02(spark, sf):
    """Interval of the difference of next accuracy after large and small updates."""
    sums = resampling.effect_sums(linked(spark, sf), "participant_id", "large_update_window", "next_accuracy")
    return resampling.interval(resampling.bootstrap(sums, "participant_id", resampling.difference, repetitions=300))


@query("RES03")
def res03(spark, sf):
    """Interval of an odds ratio from counts by participant."""
    hit = lambda a, b: F.count_if(((F.col("congruency") == "incongruent") == a) & ((F.col("correct") == 0) == b))
    sums = tables.trials(spark, sf).groupBy("participant_id").agg(hit(True, True).alias("a"), hit(True, False).alias("b"), hit(False, True).alias("c"), hit(False, False).alias("d"))
    return resampling.interval(resampling.bootstrap(sums, "participant_id", resampling.odds_ratio, repetitions=5000))


@query("STA08")
def sta08(spark, sf):
    """Rate of slow sessions in each profile and its one-vs-rest odds ratio, with intervals by bootstrap of participants."""
    rows = profiles16(spark, sf).select("participant_id", "profile", (F.col("accuracy") < 0.85).alias("low"))
    return resampling.profile_association(rows, "participant_id", "profile", "low", repetitions=5000)


@query("RES05")
def res05(spark, sf):
    """Agreement of a person's profiles, against labels permuted within the dataset."""
    return resampling.permuted_agreement(profiles16(spark, sf), "dataset_id", "participant_id", "profile", repetitions=1000)


@query("STA15")
def sta15(spark, sf):
    """How repeatable profiles are: occupancy of persons, agreement within them against permutation, persistence between neighbours against chance."""
    rows = staged(profiles16(spark, sf).select("dataset_id", "participant_id", "block_raw", "window_index", "profile"), "profiles")
    people = rows.groupBy("participant_id", "profile").agg(F.count("*").alias("k")).groupBy("participant_id").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.count("*").alias("kinds"))
    persons = people.agg(F.sum("n").alias("n_windows"), F.count("*").alias("n_subjects"), F.median("n").alias("median_windows"), F.avg(F.col("top") / F.col("n")).alias("mean_modal_share"), F.median(F.col("top") / F.col("n")).alias("median_modal_share"), F.avg((F.col("kinds") > 1).cast("double")).alias("several_profiles_share"))
    entropy = st.label_occupancy(rows, "participant_id", "profile").agg(F.avg("entropy").alias("mean_entropy"))
    pairs = st.transition_table(rows, ["participant_id", "block_raw"], ["window_index"], "profile", F.col("next_window_index") == F.col("window_index") + 1)
    steps = pairs.agg(F.sum("n").alias("adjacent_pairs"), (F.sum(F.when(F.col("from_label") == F.col("to_label"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("adjacent_same_share"))
    labels = rows.groupBy("profile").agg(F.count("*").alias("k"))
    chance = labels.agg((F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("chance_same_share"))
    out = resampling.permuted_agreement(rows, "dataset_id", "participant_id", "profile", repetitions=1000)
    for one_row in (persons, entropy, steps, chance):
        out = out.join(one_row, F.lit(True))
    return out


@query("RES01")
def res01(spark, sf):
    """Interval of the cosine of a centroid with a prototype."""
    rows = models.standard_scale(primary(spark, sf).dropna(subset=FEATURES), FEATURES).filter("accuracy > 0")
    sums = rows.groupBy("participant_id").agg(*[F.sum(c).alias(c) for c in FEATURES])
    proto = np.array([1.0, -1.0, 1.0, -1.0, 0.0])
    return resampling.interval(resampling.bootstrap(sums, "participant_id", lambda v: float(v @ proto / max(np.linalg.norm(v) * np.linalg.norm(proto), 1e-300))))


_COS = "sum(x * y) / sqrt(sum(x * x) * sum(y * y))"


@query("STA13", upto("summary", f"SELECT profile, {r6(_COS + ' AS similarity')} FROM (SELECT profile, unnest([a, t]) AS x, unnest([1.0, 0.5]) AS y FROM (SELECT profile, avg(accuracy) AS a, avg(throughput_proxy) AS t FROM p GROUP BY 1)) GROUP BY 1",
  "p AS (SELECT *, CASE WHEN accuracy >= 0.95 THEN 'P0' WHEN throughput_proxy > 2 THEN 'P1' ELSE 'P2' END AS profile FROM summary WHERE window_size = 16)"))
def sta13(spark, sf):
    """Cosine of each profile's centroid with a prototype."""
    c = profiles16(spark, sf).groupBy("profile").agg(F.array(F.avg("accuracy"), F.avg("throughput_proxy")).alias("c"))
    return c.select("profile", models.cosine(F.col("c"), F.array(F.lit(1.0), F.lit(0.5))).alias("similarity"))


# --- gates -----------------------------------------------------------------------------------------------------------------------------------------------------------

_GATE = f"""g AS (SELECT task_family, count(*) AS windows, count(DISTINCT dataset_id) AS datasets, {' + '.join(f"(avg(({c} IS NOT NULL)::INT) >= 0.8)::INT" for c in FEATURES)} AS features,
  avg(({' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})::INT) AS complete_fraction FROM s GROUP BY 1),
gate AS (SELECT *, concat_ws('; ', CASE WHEN windows < 300 THEN 'too_few_windows' END, CASE WHEN datasets < 3 THEN 'too_few_datasets' END, CASE WHEN features < 5 THEN 'too_few_features' END, CASE WHEN complete_fraction < 0.8 THEN 'too_incomplete' END) AS reasons FROM g)"""


@query("GTE01", upto("summary", f"SELECT task_family, windows, datasets, features, {r6('complete_fraction')}, reasons, reasons = '' AS passed FROM gate", _S16, _GATE))
def gte01(spark, sf):
    return gates.task_gate(primary(spark, sf), FEATURES)


@query("GTE02", upto("summary", "SELECT task_family, CASE WHEN reasons = '' THEN 'model' ELSE 'skip' END AS action, (SELECT count(*) FROM gate WHERE reasons = '') >= 2 AS pooled_allowed FROM gate", _S16, _GATE))
def gte02(spark, sf):
    return gates.modelling_plan(gates.task_gate(primary(spark, sf), FEATURES))


@query("GTE03", upto("summary", f"SELECT task_family, {r6('sum(k) / sum(n) AS available', 'max(k) / nullif(sum(k), 0) AS largest_source')}, CASE WHEN sum(k) / sum(n) <= 0.2 THEN 'structurally_unavailable' WHEN max(k) / nullif(sum(k), 0) >= 0.8 THEN 'one_source_dominates' ELSE 'ok' END AS verdict FROM (SELECT task_family, dataset_id, count(control_cost_rt_ms) AS k, count(*) AS n FROM summary GROUP BY ALL) GROUP BY 1"))
def gte03(spark, sf):
    return gates.preflight(summaries(spark, sf), "control_cost_rt_ms")


@query("GTE04", upto("summary", "SELECT participants, domains_tested, domains_supported, CASE WHEN participants < 5 THEN 'not_testable' WHEN domains_supported >= 2 AND domains_tested = 3 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT count(DISTINCT participant_id) AS participants FROM summary WHERE window_size = 16), (SELECT sum(t)::BIGINT AS domains_tested, sum(s)::BIGINT AS domains_supported FROM (SELECT domain, (max(groups) >= 5)::INT AS t, (max(domain_share) >= 0.6)::INT AS s FROM fd GROUP BY 1))", _EFFECTS))
def gte04(spark, sf):
    """Models beyond the published effects are open only if enough of those are found."""
    return st.replication_gate(effects(spark, sf), summaries(spark, sf).filter("window_size = 16"), "participant_id")


@query("GTE05", "SELECT user_id, count(*) AS recordings, count(*) FILTER (event_type = 'error') AS errors, count(*) = 66 AND count(*) FILTER (event_type = 'error') = 0 AS complete FROM events GROUP BY 1")
def gte05(spark, sf):
    return gates.completeness(table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", "error")), "user_id", 66)


# --- sources and sinks -----------------------------------------------------------------------------------------------------------------------------------------------


def scratch(spark, suffix: str) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}{suffix}"


@query("SRC02", "SELECT * FROM (VALUES ('Missing table: visits'), ('Table customer is missing columns: c_age, c_zip')) AS t(issue)")
def src02(spark, sf):
    found = files.validate_schema({n: table(spark, sf, n) for n in ("customer", "orders")}, {"customer": ["c_custkey", "c_zip", "c_age"], "orders": ["o_orderkey"], "visits": ["v"]})
    return spark.createDataFrame([(x,) for x in found], "issue string")


@query("SRC04", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def src04(spark, sf):
    """SQL text over a registered view."""
    return spark.sql("SELECT n_regionkey, count(*) AS nations FROM {nation} GROUP BY 1", nation=table(spark, sf, "nation"))


@query("SRC06", "SELECT c_custkey, c_mktsegment FROM customer")
def src06(spark, sf):
    """Of the wanted columns those that are there; the scan reads no others."""
    return files.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "not_there", "c_mktsegment"])


@query("SRC07", f"SELECT s_suppkey, {r6('s_acctbal')} FROM supplier")
def src07(spark, sf):
    path = files.write_table(table(spark, sf, "supplier"), scratch(spark, ".csv.gz"))
    return files.read_table(spark, path, ["s_suppkey", "s_acctbal"], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SNK01", f"SELECT p_partkey, p_name, {r6('p_retailprice')} FROM part")
def snk01(spark, sf):
    return files.read_table(spark, files.write_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), scratch(spark, ".parquet")))


@query("SNK06", "SELECT n_regionkey, count(*) AS nations FROM nation WHERE n_regionkey >= 2 GROUP BY 1")
def snk06(spark, sf):
    """Parts that are written once; what is left after a stop is the rest."""
    path, n = scratch(spark, ".parquet"), table(spark, sf, "nation")
    files.write_parts(n.filter("n_regionkey < 2"), path, ["n_regionkey"])
    rest = files.missing_parts(spark, n.select("n_regionkey").distinct(), path, ["n_regionkey"])
    return n.join(rest, "n_regionkey").groupBy("n_regionkey").agg(F.count("*").alias("nations"))


@query("SNK07", f"SELECT c_custkey, {r6('CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal')} FROM customer")
def snk07(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return files.upsert(c, c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


_MEASURES = ("accuracy", "rt_cv", "throughput_proxy")


@query("SNK09", upto("summary", f"""SELECT plot, x, series, {r6('value')} FROM (
SELECT 'bars' AS plot, task_family AS x, 'windows' AS series, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY 2
UNION ALL SELECT 'heatmap', task_family, series, avg(v) FROM (SELECT task_family, unnest([{', '.join(f"'{c}'" for c in _MEASURES)}]) AS series, unnest([{', '.join(_MEASURES)}]) AS v FROM s) GROUP BY 2, 3
UNION ALL SELECT 'histogram', CAST(CAST(floor(median_rt_ms / 50) * 50 AS BIGINT) AS VARCHAR), task_family, CAST(count(*) AS DOUBLE) FROM s WHERE median_rt_ms IS NOT NULL GROUP BY 2, 3)""", "s AS (SELECT * FROM summary WHERE window_size = 16)"))
def snk09(spark, sf):
    """What figures show, as tables: bars of counts, a heatmap of means, a histogram; a row a mark."""
    s = summaries(spark, sf).filter("window_size = 16")
    bars = s.groupBy(F.col("task_family").alias("x")).agg(F.count("*").cast("double").alias("value")).select(F.lit("bars").alias("plot"), "x", F.lit("windows").alias("series"), "value")
    cells = s.select(F.col("task_family").alias("x"), F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("v")) for c in _MEASURES])).alias("m"))
    heat = cells.groupBy("x", "m.series").agg(F.avg("m.v").alias("value")).select(F.lit("heatmap").alias("plot"), "x", "series", "value")
    edge = (F.floor(F.col("median_rt_ms") / 50) * 50).cast("long").cast("string")
    hist = s.filter("median_rt_ms is not null").groupBy(edge.alias("x"), F.col("task_family").alias("series")).agg(F.count("*").cast("double").alias("value")).select(F.lit("histogram").alias("plot"), "x", "series", "value")
    return bars.unionByName(heat).unionByName(hist)


@query("SNK10", "SELECT n_nationkey, sha256(n_name) AS sha256 FROM nation")
def snk10(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha256"))


@query("RPT01", upto("summary", f"SELECT '| ' || task_family || ' | ' || count(*) || ' |' AS line FROM s GROUP BY task_family", _S16))
def rpt01(spark, sf):
    """Lines of a report's table."""
    text = gates.markdown("Windows", primary(spark, sf).groupBy("task_family").agg(F.count("*").alias("windows")))
    return spark.createDataFrame([(x,) for x in text.splitlines() if x.startswith("| ") and "task_family" not in x], "line string")


@query("DYN15")
def dyn15(spark, sf):
    """Information and tail rates of each window."""
    from trialweave.operators import dynamics

    m = members(spark, sf).filter("window_size = 24 and dynamics_eligible")
    mi = dynamics.corrected_mi_by(m, "window_id", "position", "congruency", "correct", least=20)
    return mi.withColumns({"mi_congruency_response": F.lit(None).cast("double"), "missing_reason_mi_congruency_response": F.lit("response_choice_unavailable")})
