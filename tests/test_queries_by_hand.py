"""Results of registered queries that SQL can't say, against NumPy and pandas on the same rows, and against runs that aren't cut into chunks or blocks."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import density, dynamics, models
from trialweave.plans import extra_queries, model_queries, registry
from trialweave.plans.model_queries import FEATURES
from trialweave.sources import tables

Q = registry.queries()


@pytest.fixture(scope="module")
def scaled(spark, sf):
    return model_queries.scaled(spark, sf).select("window_id", "dataset_id", "participant_id", *FEATURES).toPandas()


def loadings(x, k):
    value, vector = np.linalg.eigh(np.cov(np.asarray(x, float).T, ddof=0))
    vector = vector[:, ::-1][:, :k]
    return vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])]), value[::-1] / value.sum()


def test_components(spark, sf, scaled):
    load, share = loadings(scaled[FEATURES], len(FEATURES))
    got = Q["ML04"](spark, sf).toPandas()
    k = got["component"].nunique()
    assert k == min(int(np.searchsorted(np.cumsum(share), 0.8 - 1e-12)) + 1, 6)
    for r in got.itertuples():
        assert abs(r.loading - load[FEATURES.index(r.feature), int(r.component[1:]) - 1]) < 1e-5
    rows = model_queries.primary(spark, sf).select("participant_id", *FEATURES).toPandas()
    x = (rows[FEATURES] - rows.groupby("participant_id")[FEATURES].transform("mean")).dropna()
    x = (x - x.mean()) / x.std(ddof=0).replace(0, 1)
    load, share = loadings(x, 3)
    got = Q["ML05"](spark, sf).toPandas()
    part = got[got["kind"] == "loading"]
    assert len(part) == 3 * len(FEATURES)
    for r in part.itertuples():
        assert abs(r.value - load[FEATURES.index(r.name), int(r.component) - 1]) < 1e-5 and abs(r.explained_variance_ratio - share[int(r.component) - 1]) < 1e-5
    scores = got[(got["kind"] == "score") & (got["name"] == "largest")].set_index("component")["value"]
    assert np.allclose([scores[j + 1] for j in range(3)], np.abs(x.to_numpy() @ load).max(axis=0), atol=1e-5)
    assert got[got["name"] == "n_windows"]["value"].iloc[0] == len(x)


def test_components_of_halves(spark, sf, scaled):
    a, b = (loadings(scaled[scaled["dataset_id"] % 2 == k][FEATURES], 3)[0] for k in (0, 1))
    phi = a.T @ b
    best = max(itertools.permutations(range(3)), key=lambda p: sum(abs(phi[i, p[i]]) for i in range(3)))
    got = Q["JOIN16"](spark, sf).orderBy("component").collect()
    assert [r["matched"] for r in got] == [j + 1 for j in best] and np.allclose([r["congruence"] for r in got], [phi[i, j] for i, j in enumerate(best)], atol=1e-5)
    s = np.linalg.svd(a[:, :2].T @ b[:, :2])[1]
    got = Q["STA12"](spark, sf).first()
    assert np.allclose([got["least"], got["mean"]], [s.min(), s.mean()], atol=1e-5)


def out_of_fold(df, target, numeric, categorical, group="participant_id"):
    pdf = models.group_folds(df.filter(F.col(target).isNotNull()), group).toPandas()
    e, y = [], []
    for f in range(5):
        train, test = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
        x, z = models._prepared(train, test, numeric, categorical)
        m = x.mean(axis=0)
        beta = np.linalg.solve((x - m).T @ (x - m) + np.eye(x.shape[1]), (x - m).T @ (train[target] - train[target].mean())) if x.shape[1] else np.zeros(0)
        e += (test[target] - train[target].mean() - (z - m) @ beta).tolist()
        y += test[target].tolist()
    e, y = np.array(e), np.array(y)
    return [1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(e).mean(), np.sqrt((e**2).mean())]


def test_predictions(spark, sf):
    r = Q["ML13"](spark, sf).first()
    assert np.allclose([r["r2"], r["mae"], r["rmse"]], out_of_fold(model_queries.next_rows(spark, sf), "next_accuracy", FEATURES, ["task_family"]), atol=1e-5)
    sessions = tables.sessions(spark, sf)
    sets = {"intercept_only": [], "engagement_only": ["speed"], "inhibitory_only": ["spread"], "two_dimensions": ["speed", "spread"], "expanded": ["speed", "spread", "urgent", "low"]}
    got = Q["ML16"](spark, sf).collect()
    assert {r["model"] for r in got} == set(sets)
    for r in got:
        assert np.allclose([r["r2"], r["mae"], r["rmse"]], out_of_fold(sessions, "accuracy", sets[r["model"]], []), atol=1e-5)
    wide = model_queries.linked(spark, sf).filter("window_size = 12")
    got = {(r["target"], r["model"]): r for r in Q["ML14"](spark, sf).collect()}
    assert len(got) == 15
    for target in ("next_accuracy", "next_throughput", "next_rt_cv"):
        # robust scaling before the folds changes no fold's own scaling, but the rows' imputation stays
        base = got[target, "Model A"]
        assert np.allclose([base["r2"]], out_of_fold(wide, target, ["accuracy"], ["task_family"])[:1], atol=1e-4)
        for m in "ABCDE":
            r = got[target, f"Model {m}"]
            assert abs(r["delta_r2_vs_model_a"] - (r["r2"] - base["r2"])) < 2e-5 and abs(r["delta_r2_vs_model_b"] - (r["r2"] - got[target, "Model B"]["r2"])) < 2e-5
    got = Q["ML15"](spark, sf).toPandas()
    assert set(got["control"]) == {"temporally_aligned", "within_task_shuffled_ecg"} and set(got["model"]) == set("ABCDE") and len(got) == 20
    base = got[got["model"].isin(["A", "B"])].pivot(index=["target", "model"], columns="control", values="r2")
    assert np.allclose(base["temporally_aligned"], base["within_task_shuffled_ecg"])  # no heart features in these


def test_silhouettes_of_mixtures(spark, sf):
    rows, found = model_queries.mixtures(spark, sf)
    x = rows.select(*FEATURES).toPandas().to_numpy()
    got = {(r["covariance"], r["k"]): r["silhouette"] for r in Q["ML07"](spark, sf).collect()}
    for m in found:
        labels = (models._log_density(x, m["means"], m["cov"], m["kind"]) + np.log(m["weights"])).argmax(axis=1)
        want = models.silhouette(x, labels) if m["k"] > 1 else None
        assert got[m["kind"], m["k"]] is None if want is None else abs(got[m["kind"], m["k"]] - want) < 2e-5


def test_density_clusters_of_windows(spark):
    sf = "/root/testdata/sf0.01"
    rows = model_queries.scaled(spark, sf)
    x = rows.select("window_id", *FEATURES).toPandas()
    want = density.fit(x[FEATURES].to_numpy(float), max(20, int(np.ceil(0.05 * len(x))))).labels
    got = Q["ML08"](spark, sf).toPandas().set_index("window_id")["cluster"]
    pairs = {(int(a), int(got[w])) for w, a in zip(x["window_id"], want, strict=True)}
    assert len(got) == len(x) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_recordings_in_one_chunk(spark, sf, monkeypatch):
    """Beats, their agreement and the features of all windows don't depend on where a recording is cut."""
    names = ("HRV02", "HRV08_paths")
    cut = {n: Q[n](spark, sf).toPandas() for n in names}
    monkeypatch.setattr(extra_queries, "CHUNK", 10**7)
    for n in names:
        keys = [c for c in ("participant_id", "window_label", "window_index") if c in cut[n]]
        a, b = (df.sort_values(keys).reset_index(drop=True) for df in (cut[n], Q[n](spark, sf).toPandas()))
        assert len(a) and a.columns.tolist() == b.columns.tolist()
        for c in a:
            if a[c].dtype.kind == "f":
                assert np.allclose(a[c], b[c], atol=1e-5, equal_nan=True), c
            else:
                assert a[c].tolist() == b[c].tolist(), c


def test_matched_sessions(spark, sf):
    s = tables.sessions(spark, sf).fillna(0.0).toPandas()
    got = Q["JOIN12"](spark, sf).toPandas().groupby("participant_id")["cost"].agg(["sum", "count"])
    scale = np.array([1e5, 0.5, 2.0])
    checked = 0
    for who, rows in s.groupby("participant_id"):
        a, b = (rows[rows["session_year"] % 2 == k][["speed", "accuracy", "n_orders"]].to_numpy(float) / scale for k in (0, 1))
        if not len(a) or not len(b):
            assert who not in got.index
            continue
        cost = np.abs(a[:, None] - b[None]).mean(axis=2)
        cost = cost if len(a) <= len(b) else cost.T
        ways = [[cost[i, j] for i, j in enumerate(p)] for p in itertools.permutations(range(cost.shape[1]), len(cost))]
        least = min(map(sum, ways))
        kept = [[v for v in w if v <= 1.0] for w in ways if sum(w) < least + 1e-9]  # several may be best
        found = got.loc[who] if who in got.index else pd.Series({"sum": 0.0, "count": 0})
        assert any(found["count"] == len(k) and abs(found["sum"] - sum(k)) < 1e-4 for k in kept)
        checked += 1
    assert checked > 50


def test_residuals_within_persons(spark, sf):
    """RSD03: least squares on the rows of each dataset with an intercept a person."""
    from trialweave.operators import residuals

    rows = residuals.design(model_queries.flagged(spark, sf))
    pdf = rows[0].toPandas()
    got = Q["RSD03"](spark, sf).toPandas().set_index("observation_id")
    for _, d in pdf.groupby("dataset_id"):
        fit = d[d["valid_correct_rt"].fillna(0).astype(bool) & d["rt_ms"].notna()]
        if len(fit) < 10:
            continue
        people = {p: i for i, p in enumerate(sorted(fit["participant_id"].unique()))}
        for y, column in ((lambda v: v, "rt_residual"), (np.log, "log_rt_residual")):
            hot = np.equal.outer(fit["participant_id"].map(people).to_numpy(), np.arange(len(people))).astype(float)
            x = np.column_stack([fit[rows[1]].to_numpy(float), hot])
            target = y(fit["rt_ms"].to_numpy(float))
            want = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
            assert np.allclose(got.loc[fit["observation_id"], column].to_numpy(float), want, atol=2e-4)


def test_sample_entropy_of_long_recordings(spark, sf):
    rr = tables.rr_intervals(spark, sf)
    s = dynamics.series(rr, "participant_id", "pos", "rr_ms")
    whole, dealt = ({r["participant_id"]: r["sample_entropy"] for r in dynamics.sample_entropies(s, "participant_id", long).collect()} for long in (20_000, 100))
    assert whole == dealt and len(whole) == 10
