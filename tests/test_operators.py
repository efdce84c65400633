import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import cleaning, dynamics, ecg, heart, joins, models, resampling, residuals, statistics as st, windows
from trialweave.sources import files
from trialweave.streaming.windows import stream_count_windows


def block(spark, n, **more):
    rows = [(i, 1, "1:1", "Stroop", more.get("block", 0), i + 1, ("congruent", "incongruent")[i % 2], 0 if i % 10 == 3 else 1, 400.0 + 10 * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "observation_id long, dataset_id long, participant_id string, task_family string, block_raw long, trial_raw long, congruency string, correct int, rt_ms double")


def test_flags_keep_every_row(spark):
    rows = block(spark, 30).withColumn("rt_ms", F.when(F.col("observation_id") == 4, None).when(F.col("observation_id") == 5, 100.0).when(F.col("observation_id") == 6, 5000.0).otherwise(F.col("rt_ms"))).withColumn("timeout", F.when(F.col("observation_id") == 7, "Yes"))
    out = {r["observation_id"]: r for r in cleaning.flag_trials(rows).collect()}
    assert len(out) == 30
    assert out[4]["rt_missing"] and out[4]["lapse_proxy"] and not out[4]["rt_below_min"]
    assert out[5]["rt_below_min"] and out[6]["rt_above_max"] and not out[6]["lapse_proxy"]
    assert out[7]["lapse_proxy"] and out[7]["valid_rt"]
    with pytest.raises(ValueError, match="rt_ms"):
        cleaning.flag_trials(rows.drop("rt_ms"))


def test_windows_stay_inside_blocks(spark):
    rows = block(spark, 130).unionByName(block(spark, 39, block=1))
    out = windows.trial_windows(rows, primary=80, sensitivity=(60, 120), remainder=40).groupBy("window_id", "block_raw", "window_size", "window_kind").count().collect()
    got = sorted((r["block_raw"], r["window_size"], r["window_kind"], r["count"]) for r in out)
    assert got == [(0, 60, "full", 60), (0, 60, "full", 60), (0, 80, "aggregate_remainder", 50), (0, 80, "full", 80), (0, 120, "full", 120)]
    with_null = rows.withColumn("block_raw", F.lit(None).cast("long"))
    assert windows.trial_windows(with_null, primary=80, sensitivity=()).count() == 169
    assert windows.trial_windows(rows.limit(0)).count() == 0


def test_spaced_windows_equal_linspace(spark):
    for n, m in itertools.product((1, 2, 5, 9, 30), (1, 2, 4, 7)):
        got = [r["id"] for r in spark.range(n).filter(windows.spaced(F.col("id"), F.lit(n), m)).orderBy("id").collect()]
        assert got == sorted(set(np.linspace(0, n - 1, m, dtype=int).tolist())) or (n <= m and got == list(range(n)))


def test_rr_windows_and_correction(spark):
    rr = spark.createDataFrame([("p", i, 1000.0) for i in range(300)], "participant_id string, pos long, rr_ms double")
    out = windows.rr_windows(rr, 120).groupBy("window_index").count().orderBy("window_index").collect()
    assert [(r[0], r[1]) for r in out] == [(0, 120), (1, 120)]
    x = [800.0, 810.0, 250.0, 805.0, 1200.0, 795.0, 800.0]
    rr = spark.createDataFrame([("p", i, v) for i, v in enumerate(x)], "participant_id string, pos long, rr_ms double")
    got = heart.correct_rr(rr, ["participant_id"]).orderBy("pos").collect()
    assert [r["rr_invalid"] or r["rr_isolated"] for r in got] == [False, False, True, False, True, False, False]
    assert got[2]["rr_corrected"] == np.median([800, 810, 805, 1200, 795])
    f = heart.time_domain(heart.correct_rr(spark.createDataFrame([("p", i, 1000.0) for i in range(60)], rr.schema), ["participant_id"]), ["participant_id"]).first()
    assert f["heart_rate"] == 60 and f["rmssd"] == 0 and f["log_rmssd"] is None and f["quality_pass"]


def test_contracts(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, w string")
    assert joins.validated_join(a, b, ["k"]).count() == 2
    for how in ("one_to_one", "one_to_many"):
        with pytest.raises(ValueError):
            joins.validated_join(a, b, ["k"], validate=how)


def test_band_matches_and_assignment():
    assert joins.band_matches(np.array([0, 10, 20]), np.array([1, 9.5, 40]), 1.0) == 2
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (7, 7)]:
        for _ in range(20):
            cost = rng.random((n, m))
            got = joins.assignment(cost)
            assert len({r for r, _ in got}) == len({c for _, c in got}) == min(n, m)
            small = cost if n <= m else cost.T
            best = min(sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert math.isclose(sum(cost[r, c] for r, c in got), best)


def test_components_line_up():
    rng = np.random.default_rng(1)
    a = np.linalg.qr(rng.normal(size=(8, 3)))[0]
    best, phi = joins.match_components(a, a[:, [2, 0, 1]] * [1, -1, 1])
    assert best.tolist() == [1, 2, 0] and np.allclose(np.abs(phi), 1)
    s, angle = models.subspace_similarity(a, a @ np.linalg.qr(rng.normal(size=(3, 3)))[0])
    assert np.allclose(s, 1) and angle < 1e-3


def test_residuals_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(6):
        for i in range(40):
            c = ("congruent", "incongruent", "neutral")[int(rng.integers(3))]
            rows.append((p * 100 + i, 1, f"p{p}", "Stroop", i // 20, i, c, int(rng.random() < 0.9), 500 + 30 * p + 40 * (c == "incongruent") + 2.0 * i + float(rng.normal(0, 20))))
    df = spark.createDataFrame(rows, "observation_id long, dataset_id long, participant_id string, task_family string, block_raw long, trial_raw long, congruency string, correct int, rt_ms double")
    out = residuals.residuals(df.withColumns({"valid_rt": F.lit(True), "valid_correct_rt": F.col("correct") == 1}), y="rt_ms").orderBy("observation_id").toPandas()
    pdf = pd.DataFrame(rows, columns=df.columns).sort_values("observation_id")
    x = np.column_stack([(pdf.congruency == c).astype(float) for c in ("incongruent", "neutral")] + [(pdf.block_raw == 1).astype(float), (pdf.trial_raw - pdf.trial_raw.mean()) / pdf.trial_raw.std(ddof=0)])
    people = np.column_stack([(pdf.participant_id == p).astype(float) for p in sorted(pdf.participant_id.unique())])
    fit = (pdf.correct == 1).to_numpy()
    beta = np.linalg.lstsq(np.column_stack([x, people])[fit], pdf.rt_ms.to_numpy()[fit], rcond=None)[0]
    assert np.allclose(out["residual"], pdf.rt_ms.to_numpy() - np.column_stack([x, people]) @ beta, atol=1e-6)
    few = residuals.residuals(df.limit(3).withColumns({"valid_rt": F.lit(True), "valid_correct_rt": F.lit(True)}), y="rt_ms").collect()
    assert {r["residual_status"] for r in few} == {"insufficient_rows_for_design"}


def test_sequence_features():
    rng = np.random.default_rng(0)
    assert abs(dynamics.dfa_alpha(rng.normal(size=5000)) - 0.5) < 0.15
    assert dynamics.dfa_alpha(np.ones(100)) is None and dynamics.dfa_alpha(np.arange(39)) is None
    x = np.sin(np.arange(200) / 5)
    assert dynamics.sample_entropy(x) < dynamics.sample_entropy(rng.normal(size=200))
    a = np.array([0, 1] * 30)
    assert dynamics.corrected_mi(a, a, 1)[0] > 0.9 and dynamics.corrected_mi(a, rng.permutation(a), 1)[0] < 0.2
    assert dynamics.corrected_mi(a[:10], a[:10], 1) == (None, "insufficient_observations")
    assert dynamics.corrected_mi(np.zeros(50), np.zeros(50), 1)[1] == "invariant_left"
    assert dynamics.stable_seed(1, "a") == dynamics.stable_seed(1, "a") != dynamics.stable_seed(1, "b")


def test_models(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(6, 1, (150, 2))])
    df = spark.createDataFrame([(i, f"g{i % 20}", float(a), float(b), float(2 * a - b + rng.normal(0, 0.1)), "u" if i < 150 else "v") for i, (a, b) in enumerate(x)], "i long, g string, a double, b double, y double, label string").repartition(3)
    n, mean, cov = models.moments(df, ["a", "b"])
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, ddof=0))
    best = models.mixture_sweep(df, ["a", "b"], ks=(1, 2, 3), starts=2, rounds=25)[0]
    assert best["k"] == 2
    assert models.adjusted_rand(models.assign(df, ["a", "b"], best).withColumn("c", F.col("component").cast("string")), "c", "label").first()["ari"] > 0.95
    assert models.grouped_ridge(df, "y", ["a", "b"], group="g").first()["r2"] > 0.98
    assert models.classification_metrics(models.grouped_classification(df, "label", ["a", "b"], "g")).first()["balanced_accuracy"] > 0.95
    assert models.grouped_pls(df, ["a", "b"], ["y"], "g").first()["r2"] > 0.95
    assert models.leakage(models.group_folds(df, "g"), "g").first()[0] == 0
    load, share = models.components(np.diag([4.0, 1.0, 0.1]))
    assert load.shape == (3, 1) or load.shape == (3, 2)
    assert models.silhouette(x, np.repeat([0, 1], 150)) > 0.7
    load, noise = models.factor_analysis(np.cov((rng.normal(size=(2000, 1)) @ np.array([[1.0, 2.0, 3.0]]) + rng.normal(size=(2000, 3))).T, ddof=0), 1)
    assert np.allclose(np.abs(load[:, 0]), [1, 2, 3], atol=0.3) and np.allclose(noise, 1, atol=0.3)


def test_statistics(spark):
    assert abs(st.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(st.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 5.0), ("c", 9.0)], "g string, x double")
    assert st.one_way_icc(df, "g", "x").first()["icc"] == 1.0
    assert st.spearman_brown(F.lit(0.25), F.lit(7)) is not None
    assert resampling.permutation_p(1.0, np.array([0.0, 2.0, 0.5])) == 0.5
    sums = spark.createDataFrame([(f"p{i}", 1, 2.0, 1, 1.0) for i in range(40)], "p string, n1 long, s1 double, n0 long, s0 double")
    r = resampling.interval(resampling.bootstrap(sums, "p", resampling.difference, repetitions=20)).first()
    assert (r["replicates"], r["lower"], r["upper"]) == (20, 1.0, 1.0)
    # a replicate's sums are those of its counts
    got = {r["replicate"]: r["v"] for r in resampling.replicate_sums(sums.repartition(3), "p", repetitions=5).collect()}
    counts = resampling.counts_of([f"p{i}" for i in range(40)], 5, 42).sum(axis=0)
    assert all(v[1] == 2 * counts[k] for k, v in got.items()) and len(got) == 5


@pytest.mark.parametrize("most", [200_000, 5])
def test_ranks_equal_plain_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(st, "SORTED", most)
    rng = np.random.default_rng(1)
    rows = [(int(k), None if rng.random() < 0.1 else float(v)) for k, v in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    want = {(k, v): r for k, v, r in zip(pdf["k"], pdf["v"], pdf.groupby("k")["v"].rank(), strict=True) if v == v}
    assert {(r["k"], r["v"]): r["rank"] for r in st.ranks(df, "v", ["k"]).collect()} == want
    assert {r["v"]: r["rank"] for r in st.ranks(df, "v").collect()} == {v: r for v, r in zip(pdf["v"], pdf["v"].rank(), strict=True) if v == v}


def test_permutations_within_strata(spark):
    """Agreement, its mean under permutation and its p-value against permuting the rows themselves."""
    rng = np.random.default_rng(2)
    rows = [(d, f"{d}-{p}", "abc"[(p + int(rng.random() < 0.4) + d) % 3]) for d in range(3) for p in range(8) for _ in range(5)]
    got = resampling.permuted_agreement(spark.createDataFrame(rows, "d int, p string, l string"), "d", "p", "l", repetitions=2000).first()
    pdf = pd.DataFrame(rows, columns=["d", "p", "l"])

    def share(x):
        k = x.groupby(["p", "l"]).size()
        n = x.groupby("p").size()
        return (k * (k - 1)).sum() / (n * (n - 1)).sum()

    null = []
    for _ in range(300):
        null.append(share(pdf.assign(l=pdf.groupby("d")["l"].transform(lambda v: rng.permutation(v.to_numpy())))))
    assert got["pair_agreement"] == share(pdf)
    assert abs(got["permuted_agreement"] - np.mean(null)) < 4 * np.std(null) / np.sqrt(300)
    assert got["p_value"] < 0.01


def test_profile_association(spark):
    rows = [(f"p{i}", "ab"[i % 2], (i % 2 == 0) == (i % 10 < 8)) for i in range(200)]
    got = {r["profile"]: r for r in resampling.profile_association(spark.createDataFrame(rows, "p string, x string, e boolean"), "p", "x", "e", repetitions=200).collect()}
    low = {x: sum(e for _, y, e in rows if y == x) for x in "ab"}
    for x, y in ("ab", "ba"):
        assert got[x]["n"] == 100 and got[x]["rate"] == low[x] / 100
        assert abs(got[x]["odds_ratio"] - (low[x] + 0.5) * (100 - low[y] + 0.5) / ((100 - low[x] + 0.5) * (low[y] + 0.5))) < 1e-12
        assert got[x]["odds_ratio_lower"] < got[x]["odds_ratio_median"] < got[x]["odds_ratio_upper"]


def test_weighted_mixtures(spark):
    """Replicates of a sweep equal fits to the rows they hold; agreements equal those of the labels."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (90, 2)), rng.normal(5, 1, (90, 2))])
    df = spark.createDataFrame([(i % 3, f"g{i % 20}", float(a), float(b)) for i, (a, b) in enumerate(x)], "d int, g string, a double, b double").repartition(4)
    how = {"ks": (1,), "kinds": ("full",)}
    for m in models.mixture_sweep(df, ["a", "b"], replicates=3, weigh=models.leaving_out("d", [0, 1, 2]), **how):
        rest = x[np.arange(180) % 3 != m["replicate"]]
        assert m["n"] == 120 and np.allclose(m["means"][0], rest.mean(axis=0)) and np.allclose(m["cov"][0], np.cov(rest.T, ddof=0), atol=1e-5)
    base = models.mixture_sweep(df, ["a", "b"], ks=(2,), kinds=("diag",), starts=5)[0]
    drawn = models.mixture_sweep(df, ["a", "b"], ks=(2,), kinds=("diag",), starts=5, replicates=4, weigh=models.by_participant("g", 4))
    assert len(drawn) == 4 and all(v > 0.9 for v in models.agreements(df, ["a", "b"], base, drawn))
    both = models.assign(models.assign(df, ["a", "b"], base, "u").drop("posterior"), ["a", "b"], drawn[0], "v")
    assert np.isclose(models.agreements(df, ["a", "b"], base, drawn[:1])[0], models.adjusted_rand(both, "u", "v").first()["ari"])
    train, test = (models.weighted_moments(df, ["a", "b"], models.by_split("g", 6, test=t)) for t in (False, True))
    assert all(train[r][0] + test[r][0] == 180 for r in range(6)) and len({train[r][0] for r in range(6)}) > 1
    n, mean, cov = test[0]
    part = rng.normal(size=(50, 2))
    c = np.array([[2.0, 0.3], [0.3, 1.0]])
    plain = np.mean([-0.5 * ((p - mean) @ np.linalg.inv(c) @ (p - mean) + np.log(np.linalg.det(c)) + 2 * np.log(2 * np.pi)) for p in part])
    assert np.isclose(models.gaussian_log_likelihood(mean, c, part.mean(axis=0), np.cov(part.T, ddof=0)), plain)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("800\n@\n\n810.5\n")
    (tmp_path / "b.txt").write_text("900\n")
    rr = files.read_rr_files(spark, f"{tmp_path}/*.txt")
    assert [(r["pos"], r["rr_ms"]) for r in rr.filter("participant_id = 'a'").orderBy("pos").collect()] == [(0, 800.0), (1, None), (2, None), (3, 810.5)]
    inv = {r["participant_id"]: r for r in files.rr_inventory(rr).collect()}
    assert (inv["a"]["intervals"], inv["a"]["blank_lines"], inv["a"]["non_numeric_lines"]) == (2, 1, 1)
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert files.read_table(spark, files.write_table(df, f"{tmp_path}/t.parquet"), ["v", "w"]).columns == ["v"]
    assert files.first_readable(spark, f"{tmp_path}/t").count() == 2
    with pytest.raises(ValueError):
        files.write_table(df, f"{tmp_path}/t.xyz")
    assert json.load(open(files.write_json({"a": float("nan"), "b": np.int64(3), "c": (1.5,)}, f"{tmp_path}/x.json"))) == {"a": None, "b": 3, "c": [1.5]}
    assert open(files.write_text("line\n\n", f"{tmp_path}/x.md")).read() == "line\n"
    files.update_manifest(f"{tmp_path}/m.json", "one", {"p": 1})
    assert set(files.update_manifest(f"{tmp_path}/m.json", "two", {"p": 2})["stages"]) == {"one", "two"}
    new = files.upsert(df, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    events = files.annotation_events(spark.createDataFrame([(2.0, 0.0, "12"), (1.0, 0.0, " 7 "), (0.0, 0.0, "boundary")], "onset double, duration double, description string"))
    assert [r["event_code"] for r in events.collect()] == [7, 12]
    assert files.source_hashes(spark, f"{tmp_path}/b.txt").first()["bytes"] == 4
    with pytest.raises(ValueError, match="Missing table"):
        files.require_schema({}, {"t": ["a"]})


def test_stream_of_trials(spark, tmp_path):
    spark.createDataFrame([(i % 2, float(i)) for i in range(23)], "k long, rt_ms double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, rt_ms double").parquet(f"{tmp_path}/in")
    q = stream_count_windows(stream, ["k"], 5).writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("counted").collect())
    assert got == [(0, 0, 5, 4.0), (0, 1, 5, 14.0), (1, 0, 5, 5.0), (1, 1, 5, 15.0)]


def test_density(spark):
    from trialweave.operators import density

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.3, (60, 2)), rng.uniform(-20, 20, (12, 2))])
    h = density.fit(x, 20)
    assert set(h.labels[:60]) - {-1} == {0} and set(h.labels[60:120]) - {-1} == {1} and (h.labels[:120] >= 0).mean() > 0.8
    assert (h.labels[120:] < 0).mean() > 0.8
    assert h.label(x).tolist() == h.labels.tolist()
    assert h.label(np.array([[0.0, 0.0], [5.0, 5.0], [100.0, 0.0]])).tolist() == [0, 1, -1]
    assert density.fit(x[:5], 20).label(x[:3]).tolist() == [-1, -1, -1]
    # the spanning tree is as light as one by Kruskal
    core = np.zeros(len(x))
    d = density.distances(x, x)
    root = list(range(len(x)))

    def find(i):
        return i if root[i] == i else find(root[i])

    total = 0.0
    for i, j in sorted(((i, j) for i in range(len(x)) for j in range(i)), key=lambda e: d[e]):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d[i, j]
    assert abs(sum(w for w, _, _ in density.spanning_tree(x, core)) - total) < 1e-9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0)], "k long, a double, b double").repartition(3)
    got = {r["k"]: r["cluster"] for r in density.density_clusters(df, ["a", "b"], "k").collect()}
    assert got[999] == -1 and len({got[i] for i in range(120)} - {-1}) == 2 and len(got) == len(x) + 1
    assert density.density_clusters(df.limit(0), ["a", "b"], "k").collect() == []


def test_stores(spark, tmp_path):
    where = f"file://{tmp_path}"
    assert json.loads(files.get(files.write_json({"a": 1}, f"{where}/x/y.json"))) == {"a": 1} and files.exists(f"{tmp_path}/x/y.json")
    with pytest.raises(ValueError):
        files.require_schema({}, {"t": ["a"]}, f"{where}/report.txt")
    assert (tmp_path / "report.txt").read_text() == "Missing table: t\n"
    with pytest.raises(Exception, match="no such participant"):
        spark.createDataFrame([(30,)], "n int").select(files.participant_file("n")).collect()
    scaled = models.standard_scale(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"])
    assert sorted(map(tuple, scaled.collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    assert models.enough_rows(np.array([30, 400])) and not models.enough_rows(np.array([30, 4000])) and not models.enough_rows(np.array([5, 9]))
    assert models.well_conditioned(np.eye(2)[None], "full") and not models.well_conditioned(np.diag([1.0, 1e-12])[None], "full")


def test_density_by_tiles_equals_one_matrix(spark):
    """Core distances, the weights of the tree and the clusters, with rows that are repeated, in blocks of some dozens."""
    from trialweave.operators import density

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (90, 2)), rng.normal(9, 1, (90, 2)), rng.uniform(-20, 30, (60, 2)), np.repeat(rng.normal(0, 1, (2, 2)), 8, axis=0)])
    want = density.fit(x, 20)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "r long, a double, b double").repartition(3)
    cores = density.core_distances(rows, ["a", "b"], 20, 64)
    assert {r["r"]: r["core"] for r in cores.collect()} == dict(enumerate(want.core.tolist()))
    tree = sorted(r["w"] for r in density.shared_tree(cores, ["a", "b"], 64).collect())
    assert np.allclose(tree, [w for w, _, _ in density.spanning_tree(x, want.core)]) and len(tree) == len(x) - 1
    close = density.core_distances(rows.withColumns({"a": F.lit(1.0), "b": F.lit(2.0)}), ["a", "b"], 20, 64)
    assert {r["core"] for r in close.collect()} == {0.0}
    got = {r["k"]: r["cluster"] for r in density.density_clusters(rows.withColumnRenamed("r", "k"), ["a", "b"], "k", share=0.0, size=64).collect()}
    pairs = {(int(want.labels[i]), got[i]) for i in range(len(x))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) >= 3  # the same clusters, however numbered


def test_permuted_covariances(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_t(2.2, (6000, 1)) * np.array([1.0, 1.0]) + rng.normal(0, 0.01, (6000, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 1.0)], "k long, a double, b double")
    n, mean, real = models.moments(df, ["a", "b"])
    null = models.permuted_covariances(df, "k", ["a", "b"], mean, real, 3)
    turn = lambda c, r: df.filter("a is not null").orderBy(F.xxhash64("k", F.lit(c), F.lit(r))).toPandas()["ab"[c]].to_numpy()
    for r, cov in enumerate(null):
        assert np.allclose(cov, np.cov(turn(0, r), turn(1, r), ddof=0)) and abs(cov[0, 1]) < 0.2 * real[0, 1]
    assert n == 6000 and len({c[0, 1] for c in null}) == 3


def test_random_intercept_equals_dense_restricted_likelihood(spark):
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(12), rng.integers(3, 9, 12))
    x = np.column_stack([rng.normal(size=len(g)), (rng.random(len(g)) < 0.4).astype(float), (g % 2).astype(float)])
    y = 2 + x @ [0.7, -1.0, 0.5] + rng.normal(size=12)[g] * 1.5 + rng.normal(size=len(g))
    df = spark.createDataFrame([(f"g{i}", float(v), *map(float, r)) for i, v, r in zip(g, y, x, strict=True)], "g string, y double, a double, b double, c double").repartition(3)
    got = residuals.random_intercept(df, "y", ["a", "b", "c"], "g")
    full = np.column_stack([np.ones(len(g)), x])

    def reml(ratio):
        v = np.eye(len(g)) + ratio * (g[:, None] == g[None, :])
        w = np.linalg.inv(v)
        a = full.T @ w @ full
        beta = np.linalg.solve(a, full.T @ w @ y)
        r = y - full @ beta
        s = r @ w @ r / (len(y) - 4)
        return -0.5 * ((len(y) - 4) * np.log(s) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s

    best = max(np.geomspace(got["ratio"] / 2, got["ratio"] * 2, 400), key=lambda r: reml(r)[0])
    assert got["status"] == "mixed" and abs(best / got["ratio"] - 1) < 0.01
    _, beta, s = reml(got["ratio"])
    assert np.allclose(got["beta"], beta[1:], atol=1e-8) and np.isclose(got["variance"], s)
    few = residuals.random_intercept(df.filter("g < 'g2'"), "y", ["a", "b", "c"], "g")  # g0, g1, g10, g11
    keep = np.isin(g, [0, 1, 10, 11])
    if few["status"] == "participant_intercepts":
        dummies = (g[keep][:, None] == np.array([0, 1, 10, 11])).astype(float)
        beta = np.linalg.lstsq(np.column_stack([dummies, x[keep][:, :2]]), y[keep], rcond=None)[0]
        assert np.allclose(few["beta"][:2], beta[4:], atol=1e-8) and abs(few["beta"][2]) < 1e-9
    assert residuals.random_intercept(df.limit(0), "y", ["a"], "g")["status"] == "not_testable"


def test_models_by_sums_equal_fits_to_rows(spark):
    """Ridge, partial least squares and logistic regression, fold by fold, against plain fits to each fold's rows."""
    rng = np.random.default_rng(11)
    n = 240
    a, b, c = rng.normal(size=(3, n))
    kind = np.array(["u", "v", None], dtype=object)[rng.integers(0, 3, n)]
    y = 2 * a - b + (kind == "u") + rng.normal(0, 0.5, n)
    a[rng.random(n) < 0.1] = np.nan
    label = np.where(y > 1, "high", np.where(y < -1, "low", "mid"))
    pdf = pd.DataFrame({"g": [f"g{i % 30}" for i in range(n)], "a": a, "b": b, "c": c, "kind": kind, "y": y, "label": label})
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "g string, a double, b double, c double, kind string, y double, label string").repartition(4)
    fold = {r["g"]: r["fold"] for r in models.group_folds(df, "g").select("g", "fold").distinct().collect()}
    own = pdf["g"].map(fold).to_numpy()
    error, e_pls, t_pls, losses = [], 0.0, 0.0, []
    full = pdf.assign(a=pdf["a"].fillna(0.0))
    for f in range(5):
        train, test = pdf[own != f], pdf[own == f]
        x, z = models._prepared(train, test, ["a", "b"], ["kind"])
        mx, my = x.mean(axis=0), train["y"].mean()
        beta = np.linalg.solve((x - mx).T @ (x - mx) + np.eye(x.shape[1]), (x - mx).T @ (train["y"] - my))
        error += (test["y"] - (my + (z - mx) @ beta)).tolist()
        u, v = full[own != f][["a", "b", "c"]].to_numpy(), full[own != f][["y"]].to_numpy()
        gram = np.column_stack([np.ones(len(u)), u, v])
        coef, cx, cy, sd = models.pls(gram.T @ gram, 3, 3)
        want = np.linalg.lstsq(np.column_stack([np.ones(len(u)), u]), v, rcond=None)[0]
        assert np.allclose(coef, want[1:])  # with all components it is least squares
        t = full[own == f]
        e_pls += (((t[["y"]].to_numpy() - cy - (t[["a", "b", "c"]].to_numpy() - cx) @ coef) / sd) ** 2).sum()
        t_pls += (((t[["y"]].to_numpy() - cy) / sd) ** 2).sum()
        x, z = models._prepared(train, test, ["a", "b"], [])
        names = ["high", "low", "mid"]
        k = np.array([names.index(v) for v in train["label"]])
        w = (len(k) / (3 * np.bincount(k, minlength=3)))[k]
        p = models.softmax(np.column_stack([z, np.ones(len(z))]) @ models.logistic_fit(x, k, 3, w))
        losses += (-np.log(p[np.arange(len(z)), [names.index(v) for v in test["label"]]])).tolist()
    got = models.grouped_ridge(df, "y", ["a", "b"], ["kind"], "g").first()
    assert got["n"] == n and np.isclose(got["rmse"], np.sqrt(np.mean(np.square(error)))) and np.isclose(got["r2"], 1 - np.sum(np.square(error)) / (n * y.var()))
    got = models.grouped_pls(df.fillna({"a": 0.0}), ["a", "b", "c"], ["y"], "g", parts=3).first()
    assert got["n"] == n and np.isclose(got["r2"], 1 - e_pls / t_pls)
    rows = models.grouped_classification(df, "label", ["a", "b"], "g").collect()
    assert np.allclose(sorted(r["log_loss"] for r in rows), sorted(losses), atol=1e-5)


def test_reports_say_what_they_leave_out(spark):
    from trialweave.operators import gates

    text = gates.markdown("T", spark.range(1000))
    assert text.count("\n| ") == 1001 and text.endswith("| 999 |\n")


def test_staged_tables_need_a_shared_folder():
    from trialweave.plans import staging

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(ValueError, match="all executors share"):
        staging.shared_dir(Cluster)


def one_pass(x, sections):
    """Sample by sample, forward and backward, mirrored at the ends."""
    pad = 3 * (2 * len(sections) + 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    settled = ecg.Cascade(sections).settled
    for _ in range(2):
        state = (settled * y[0]).reshape(-1, 2)
        out = np.zeros(len(y))
        for i, v in enumerate(y.tolist()):
            for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
                w = b0 * v + state[k, 0]
                state[k] = b1 * v - a1 * w + state[k, 1], b2 * v - a2 * w
                v = w
            out[i] = v
        y = out[::-1]
    return y[pad : pad + len(x)]


def wave(rate, beats=90, seed=4):
    """A waveform and where its beats are."""
    rng = np.random.default_rng(seed)
    where = np.cumsum(rng.integers(int(0.65 * rate), int(1.1 * rate), beats))
    t = np.arange(where[-1] + int(rate))
    x = sum(np.exp(-(((t - i) / rate) / 0.012) ** 2) + 0.2 * np.exp(-(((t - i) / rate - 0.25) / 0.05) ** 2) for i in where)
    return x + 0.4 * np.sin(0.6 * t / rate) + 0.02 * rng.normal(size=len(t)) + 0.1 * np.sin(2 * np.pi * 49 * t / rate), where


def cut(spark, who, x, cuts):
    edges = [0, *cuts, len(x)]
    rows = [(who, k, a, x[a:b].tolist()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return spark.createDataFrame(rows, "who string, chunk int, start long, samples array<double>").repartition(3)


def joined(df):
    return np.concatenate([r["samples"] for r in df.orderBy("chunk").collect()])


def test_filters():
    gain = lambda sections, f, rate: abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections for z in (np.exp(-2j * np.pi * f / rate),)]))
    for rate in (100.0, 250.0, 500.0):
        s = ecg.band_pass(rate, 0.5, 40.0)
        assert len(s) == 4 and abs(gain(s, 5.0, rate) - 1) < 1e-3 and all(abs(gain(s, f, rate) ** 2 - 0.5) < 1e-6 for f in (0.5, 40.0)) and gain(s, 0.05, rate) < 1e-3
    assert gain(ecg.notch(200.0, 50.0), 50.0, 200.0) < 1e-9 and gain(ecg.notch(200.0, 50.0), 10.0, 200.0) > 0.99
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=777), ecg.Cascade(ecg.band_pass(250.0, 0.5, 40.0))
    whole, end = c.run(x, c.settled * 3.0)
    first, state = c.run(x[:301], c.settled * 3.0)
    second, last = c.run(x[301:], state)
    assert np.abs(np.concatenate([first, second]) - whole).max() < 1e-10 and np.abs(last - end).max() < 1e-8


def test_chunks_equal_whole_recordings(spark):
    """Filter, resampling and beats of a waveform in chunks are those of one pass over all of it; no beat is lost or doubled at a border."""
    rate = 200.0
    x, where = wave(rate)
    cuts = [1100, 3000, 4001, 9000, len(x) - 7]
    parts, whole = cut(spark, "r", x, cuts), cut(spark, "r", x, [])
    clean = ecg.filtered(parts, ["who"], rate).cache()
    want = one_pass(one_pass(x, ecg.band_pass(rate, 0.5, 40.0)), ecg.notch(rate, 50.0))
    assert np.abs(joined(clean) - want).max() < 1e-9
    half = np.convolve(np.pad(x, 20), np.sinc(np.arange(-20, 21) / 2) * np.kaiser(41, 5.0) / (np.sinc(np.arange(-20, 21) / 2) * np.kaiser(41, 5.0)).sum(), "valid")[::2]
    halves = ecg.halved(parts, ["who"])
    assert np.abs(joined(halves) - half).max() < 1e-12
    assert [r["start"] for r in halves.orderBy("chunk").collect()] == [-(-c // 2) for c in (0, *cuts)]
    beats = ecg.detect(clean, ["who"], rate).collect()
    once = ecg.detect(ecg.filtered(whole, ["who"], rate), ["who"], rate).collect()
    assert sorted(map(tuple, beats)) == sorted(map(tuple, once))
    for name in ecg.DETECTORS:
        found = np.array(sorted(r["sample"] for r in beats if r["detector"] == name))
        assert len(set(found)) == len(found)
        assert np.mean([np.abs(found - i).min() <= 4 for i in where]) > 0.97 and abs(len(found) - len(where)) <= 3
    agreement = ecg.concordance(ecg.detect(clean, ["who"], rate), ["who"], rate).first()
    assert agreement["concordance"] > 0.95 and abs(agreement["concordance"] + agreement["unmatched_rate"] - 1) < 1e-12
    lists = [[r["sample"] for r in beats if r["detector"] == d] for d in ecg.DETECTORS]
    assert agreement["matched"] == joins.band_matches(*(np.sort(v) for v in lists), 16)


def test_short_recordings_are_refused(spark):
    rate = 100.0
    x, _ = wave(rate, 30)
    df = cut(spark, "long", x, [900]).unionAll(cut(spark, "short", x[:499], [200]))
    assert {r["who"] for r in ecg.filtered(df, ["who"], rate).collect()} == {"long"}
    got = {(r["who"], r["reason"]) for r in ecg.quality(df, ["who"], rate).collect()}
    assert got == {("long", None), ("short", "recording is too short for stable filtering")}
    q = ecg.quality(df, ["who"], rate).filter("who = 'long' and chunk = 0").first()
    clean = ecg.filtered(df, ["who"], rate).filter("who = 'long' and chunk = 0").first()["samples"]
    assert abs(q["filtered_sd"] - np.std(clean)) < 1e-9 and abs(q["raw_sd"] - np.std(x[:900])) < 1e-9 and q["n"] == 900


def test_matches_over_long_lists(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(6):
        a, b = (np.sort(np.round(rng.uniform(0, 300 if k else 0.5, int(rng.integers(0, 200))), 1)) for _ in range(2))
        rows += [(k, 0, float(v)) for v in a] + [(k, 1, float(v)) for v in b]
        want[k] = joins.band_matches(a, b, 0.75)
    got = joins.band_match(spark.createDataFrame(rows, "k long, side int, t double").repartition(3), ["k"], 0.75).collect()
    assert {r["k"]: r["matched"] for r in got} == {k: v for k, v in want.items() if k in {r[0] for r in rows}}


def test_templates_of_long_series(spark):
    rng = np.random.default_rng(8)
    series = {0: rng.normal(size=300), 1: np.round(rng.normal(size=150), 1), 2: np.ones(40), 3: np.array([1.0]), 4: rng.normal(size=19)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k long, i long, x double").repartition(3)
    for long in (20_000, 37):
        found = {r["k"]: r["sample_entropy"] for r in dynamics.sample_entropies(df, "k", long).collect()}
        assert set(found) == set(series)
        for k, x in series.items():
            want = dynamics.sample_entropy(x)
            # the last two-value template has no third value, so it isn't counted as one of those that could last
            t = np.lib.stride_tricks.sliding_window_view(x, 2) if len(x) > 1 else np.zeros((0, 2))
            r = 0.2 * x.std(ddof=1) if len(x) > 1 else 0
            two = sum(bool((np.abs(t[i] - t[j]) <= r).all()) for i in range(len(t)) for j in range(i))
            three = sum(bool((np.abs(t[i] - t[j]) <= r).all() and abs(x[i + 2] - x[j + 2]) <= r) for i in range(len(t) - 1) for j in range(i))
            assert found[k] == (None if want is None else pytest.approx(-np.log(three / two)))
    big = np.cumsum(rng.normal(size=60_000)) % 500
    two, three = dynamics.template_matches(big, 0.5)
    parts = [dynamics.template_matches(big, 0.5, lo, lo + 25_000) for lo in range(0, 60_000, 25_000)]
    assert (two, three) == tuple(map(sum, zip(*parts, strict=True))) and two > three > 0
    alpha = {r["k"]: r["dfa_alpha"] for r in dynamics.fluctuation(df, "k").collect()}
    assert set(alpha) == {0, 1} and all(abs(alpha[k] - dynamics.dfa_alpha(series[k])) < 1e-9 for k in alpha)
