"""Model comparisons, permutations and pairs that Spark adds up, against NumPy on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import heart, models, pairs, resampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for g in range(23):
        for _ in range(int(rng.integers(4, 12))):
            a, b = rng.normal(size=2).tolist()
            kind = "xyz"[int(rng.integers(0, 3))]
            y = float(2 * a - b + {"x": 0, "y": 1, "z": -1}[kind] + 0.1 * rng.normal() + 0.1 * g)
            out.append((f"p{g:02d}", None if rng.random() < 0.1 else a, b, kind, y if rng.random() > 0.05 else None, "abc"[g % 3]))
    return spark.createDataFrame(out, "g string, a double, b double, kind string, y double, label string").repartition(4).cache()


def test_models_share_one_design(spark, rows):
    sets = {"none": ([], []), "A": (["a"], []), "B": (["a", "b"], []), "C": (["a", "b"], ["kind"])}
    got = {r["model"]: r for r in models.gains(models.grouped_ridge_models(rows, ["y"], sets, "g"), a="A").collect()}
    pdf = models.group_folds(rows.filter("y is not null"), "g").toPandas()
    for name, (num, cat) in sets.items():
        e, y = [], []
        for f in range(5):
            train, test = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
            x, z = models._prepared(train, test, num, cat)
            m = x.mean(axis=0)
            beta = np.linalg.solve((x - m).T @ (x - m) + np.eye(x.shape[1]), (x - m).T @ (train["y"] - train["y"].mean())) if x.shape[1] else np.zeros(0)
            e += (test["y"] - train["y"].mean() - (z - m) @ beta).tolist()
            y += test["y"].tolist()
        e, y = np.array(e), np.array(y)
        r = got[name]
        assert (r["status"], r["n_windows"], r["n_subjects"], r["folds"]) == ("ok", len(y), 23, 5)
        assert np.allclose([r["r2"], r["mae"], r["rmse"]], [1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(e).mean(), np.sqrt((e**2).mean())])
        assert abs(r["delta_r2_vs_a"] - (r["r2"] - got["A"]["r2"])) < 1e-12
    assert got["C"]["r2"] > got["B"]["r2"] > got["A"]["r2"] > got["none"]["r2"] and got["C"]["categorical_features"] == "kind"
    few = models.grouped_ridge_models(rows.limit(15), ["y"], sets, "g").first()
    assert (few["status"], few["reason"], few["r2"]) == ("not_testable", "insufficient rows or participant groups", None)
    one = models.grouped_ridge_models(rows.filter("g = 'p01'"), ["y"], sets, "g").first()
    assert one["status"] == "not_testable" and one["folds"] == 1
    gated = models.grouped_ridge_models(rows.withColumn("a", F.when(F.rand(1) < 0.1, F.col("a"))), ["y"], {"A": (["a", "b"], [])}, "g", present=0.2).first()
    assert gated["numeric_features"] == "b"


def test_labels_are_dealt_whole():
    for counts in ([5, 3, 9], [1, 1], [700, 300, 1], [1]):
        n = sum(counts)
        dealt = models.dealt_labels(np.arange(n), np.array(counts), 40)
        assert all(np.bincount(dealt[:, r], minlength=len(counts)).tolist() == counts for r in range(40))
        part = models.dealt_labels(np.arange(n)[::3], np.array(counts), 40)
        assert np.array_equal(part, dealt[::3])
    first = models.dealt_labels(np.arange(400), np.array([200, 200]), 300)
    assert len({tuple(c) for c in first.T}) == 300 and abs(first.mean() - 0.5) < 1e-12
    assert abs(np.corrcoef(first[0], first[1])[0, 1]) < 0.2 and np.abs(first.mean(axis=1) - 0.5).max() < 0.13


def test_permuted_fits_in_shared_passes(spark, rows):
    got = [r["balanced_accuracy"] for r in models.permuted_accuracy(rows, "label", ["a", "b"], "g", 4).orderBy("replicate").collect()]
    pdf = models.group_folds(rows, "g").toPandas()
    firsts = pdf.groupby("g")["label"].min()
    order = sorted((v, k) for k, v in firsts.items())
    names = sorted(firsts.unique())
    counts = np.array([(firsts == c).sum() for c in names])
    dealt = models.dealt_labels(np.arange(len(order)), counts, 4)
    place = {k: i for i, (_, k) in enumerate(order)}
    for r in range(4):
        y = np.array([dealt[place[g], r] for g in pdf["g"]])
        truth, found = [], []
        for f in range(5):
            train, test = pdf["fold"] != f, pdf["fold"] == f
            x, z = models._prepared(pdf[train], pdf[test], ["a", "b"], [])
            n = np.bincount(y[train], minlength=len(names))
            w = (len(x) / (np.count_nonzero(n) * np.maximum(n, 1)))[y[train]]
            beta = models.logistic_fit(x, y[train], len(names), w, rounds=5000)
            found += (np.column_stack([z, np.ones(len(z))]) @ beta).argmax(axis=1).tolist()
            truth += y[test].tolist()
        truth, found = np.array(truth), np.array(found)
        assert abs(got[r] - np.mean([(found[truth == c] == c).mean() for c in np.unique(truth)])) < 1e-9
    assert models.permuted_accuracy(rows.filter("label = 'a'").withColumn("label", F.lit("a")), "label", ["a"], "g", 3).count() == 0


def test_dealing_down_a_tree(spark):
    rng = np.random.default_rng(2)
    rows = [(d, f"{d}-{p}", "abc"[(p + int(rng.random() < 0.4) + d) % 3]) for d in range(3) for p in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "d int, p string, l string")
    flat, deep = (resampling.permuted_agreement(df, "d", "p", "l", repetitions=1500, fan=fan).first() for fan in (64, 3))
    assert flat["pair_agreement"] == deep["pair_agreement"] and abs(flat["permuted_agreement"] - deep["permuted_agreement"]) < 0.01
    pdf = pd.DataFrame(rows, columns=["d", "p", "l"])

    def share(x):
        k, n = x.groupby(["p", "l"]).size(), x.groupby("p").size()
        return (k * (k - 1)).sum() / (n * (n - 1)).sum()

    null = [share(pdf.assign(l=pdf.groupby("d")["l"].transform(lambda v: rng.permutation(v.to_numpy())))) for _ in range(150)]
    assert abs(deep["permuted_agreement"] - np.mean(null)) < 5 * np.std(null) / np.sqrt(150)
    again = resampling.permuted_agreement(df.repartition(5), "d", "p", "l", repetitions=1500, fan=3).first()
    assert again == deep


def test_silhouettes_by_tiles(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (90, 2)), rng.normal(4, 1, (70, 2)), rng.normal(-5, 1, (1, 2))])
    one, two = np.repeat([0, 1, 2], [90, 70, 1]), rng.integers(0, 2, 161)
    rows = [(float(a), float(b), int(c), "uv"[int(d)], 1) for (a, b), c, d in zip(x, one, two, strict=True)] + [(None, 1.0, 0, "u", 1), (1.0, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, one int, two string, flat int").repartition(3)
    for size in (1024, 20):
        got = {r["labelling"]: (r["n"], r["clusters"], r["silhouette"]) for r in pairs.silhouettes(df, ["a", "b"], ["one", "two", "flat"], size).collect()}
        assert got["one"][:2] == (161, 3) and abs(got["one"][2] - models.silhouette(x, one)) < 1e-12
        assert got["two"][:2] == (161, 2) and abs(got["two"][2] - models.silhouette(x, two)) < 1e-12
        assert got["flat"][1:] == (1, None)
    assert pairs.silhouettes(df.limit(0), ["a", "b"], ["one"]).first()["silhouette"] is None


def test_partitions(spark):
    a, b = [0, 0, 0, 1, 1, -1, 2], [5, 5, 6, 6, 6, 5, -1]
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert abs(models.partition_jaccard(df, "a", "b").first()[0] - np.mean([2 / 4, 2 / 3, 0])) < 1e-12
    assert models.partition_jaccard(df.withColumn("b", F.lit(-1)), "a", "b").first()[0] is None
    p = spark.createDataFrame([(0.5, 0.5), (1.0, 0.0)], "p double, q double")
    assert abs(models.posterior_entropy(p, ["p", "q"]).first()[0] - 0.5) < 1e-9 and models.posterior_entropy(p, ["p"]).first()[0] == 0


def test_component_contracts(spark, rows):
    df = rows.withColumns({"key": F.monotonically_increasing_id(), "c": F.col("b") * 2 + F.rand(3), "d": F.when(F.rand(4) < 0.5, F.col("b"))})
    df = df.cache()
    load, share, scores, info = models.fixed_components(df.dropna(subset=["a"]), "g", ["a", "b", "c"], 2, "key")
    x = df.dropna(subset=["a"]).toPandas()
    x = (x[["a", "b", "c"]] - x.groupby("g")[["a", "b", "c"]].transform("mean")).to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    value, vector = np.linalg.eigh(np.cov(x.T, ddof=0))
    assert np.allclose(np.abs(load), np.abs(vector[:, ::-1][:, :2])) and np.allclose(share, value[::-1][:2] / value.sum())
    got = np.sort(scores.toPandas()["component_1"].abs().to_numpy())
    assert np.allclose(got, np.sort(np.abs(x @ load[:, 0]))) and info["n_windows"] == len(x) and info["n_participants"] == 23 and info["parallel_analysis_components"] >= 1
    with pytest.raises(ValueError, match="participants"):
        models.fixed_components(df.filter("g < 'p04'"), "g", ["a", "b"], 1, "key")
    status = lambda *how: models.autonomic_dimensions(df, "g", *how, "key")[4]
    assert status(["a", "b", "d"], "within", 3)["reason"] == "fewer than three HRV features"
    assert models.autonomic_dimensions(df.limit(3), "g", ["b", "c", "y"], "within", 3, "key")[4]["reason"] in ("insufficient complete observations", "fewer than three HRV features")
    used = models.autonomic_dimensions(df, "g", ["a", "b", "c", "d"], "between", 3, "key")
    assert used[2] == ["a", "b", "c"] and used[4]["status"] == "ok" and used[4]["n_observations"] == 23 and used[0].shape[0] == 3


def test_windows_of_few_beats(spark):
    rows = [("one", 5.0)] + [("three", 800.0 * k) for k in range(3)] + [("bad", 200.0 * k) for k in range(60)] + [("good", 800.0 * k + 10 * (k % 3)) for k in range(40)]
    got = {r["w0"]: r for r in heart.peak_features(spark.createDataFrame(rows, "w0 string, t double"), ["w0"]).collect()}
    assert got["one"]["ecg_quality_reason"] == "fewer than two detected beats" and got["one"]["mean_nn_ms"] is None and not got["one"]["ecg_quality_pass"]
    assert got["three"]["ecg_quality_reason"] == "insufficient beats" and got["three"]["mean_nn_ms"] == 800
    assert got["bad"]["ecg_quality_reason"] == "more than 5% RR intervals corrected|less than 95% valid RR intervals" and got["bad"]["valid_rr_fraction"] == 0
    assert got["good"]["ecg_quality_pass"] and got["good"]["ecg_quality_reason"] == "ok" and got["good"]["n_beats"] == 40


def test_design_of_folds_with_gaps(spark):
    """Medians, quartiles of imputed columns and levels of each fold's training rows, where a column has gaps in some rows, in all, or in none."""
    rng = np.random.default_rng(5)
    n = 200
    pdf = pd.DataFrame({"fold": rng.integers(0, 4, n), "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "c": np.nan, "s": rng.choice(["x", "y", "z"], n)})
    pdf.loc[pdf["fold"] != 2, "s"] = pdf.loc[pdf["fold"] != 2, "s"].replace("z", "x")
    design = models.FoldDesign(spark.createDataFrame(pdf).withColumn("s", F.when(F.col("a") < 1.5, F.col("s"))), ["a", "b", "c"], ["s"], 4)
    for f in range(4):
        train = pdf[pdf["fold"] != f]
        for i, c in enumerate("abc"):
            middle = train[c].median() if train[c].notna().any() else 0.0
            assert abs(design.middle[f][i] - middle) < 1e-12 and design.gaps[f][i] == train[c].isna().any()
            q = np.percentile(train[c].fillna(middle), [25, 50, 75])
            assert np.allclose(design.spread[f][i], (q[1], (q[2] - q[0]) or 1.0))
        assert design.levels[f, "s"] == sorted(set(train.loc[train["a"] < 1.5, "s"]))
