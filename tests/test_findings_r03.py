"""Faults that showed on large tables only, made small."""

import os
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import of_duckdb, of_spark
from trialweave.functions.columns import quantiles
from tests.test_stability import best_overlaps, frame, one_matrix, sample
from trialweave.operators import density, dynamics, joins, models, pairs, resampling, stability
from trialweave.plans import analysis_queries, extra_queries, registry, staging
from trialweave.sources import files, tables

Q = registry.queries()


def test_profiles_of_sessions_whose_means_vary_in_the_last_place(spark, sf, monkeypatch):
    """A mean that is computed twice may differ in its last bit; a session's rank must not be lost by that."""
    want = {(r[0], r[1]): r[2] for r in Q["SES06"](spark, sf).collect()}
    plain = tables.sessions

    def noisy(spark, sf):
        s = plain(spark, sf)

        def shaken(frames):
            for pdf in frames:
                yield pdf.assign(speed=pdf["speed"] * (1 + 1e-14 * np.random.default_rng().random(len(pdf))))

        return s.mapInPandas(shaken, s.schema)

    monkeypatch.setattr(tables, "sessions", noisy)
    got = {(r[0], r[1]): r[2] for r in Q["SES06"](spark, sf).collect()}
    assert len(set(want.values())) > 2 and sum(got[k] != v for k, v in want.items()) <= 2


def test_sessions_of_the_same_prices_have_the_same_mean(spark, tmp_path):
    prices = [0.1, 0.7, 1234567.89, 0.2, 98765.43, 0.3, 1e-3]
    rows = [(10 * k + i, k, "F", p, datetime(1995, 3, 1), "1-URGENT") for k in range(40) for i, p in enumerate(np.random.default_rng(k).permutation(prices).tolist())]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    assert tables.sessions(spark, str(tmp_path)).select("speed").distinct().count() == 1


@pytest.mark.parametrize("name", ["HRV01", "HRV02"])
def test_waveforms_are_not_written(spark, sf, name):
    """What is staged is small beside the samples, 8 bytes each, which are made where they are read."""
    samples = extra_queries.waveforms(spark, sf).rows.agg(F.sum("size")).first()[0]
    mark = staging.written()
    Q[name](spark, sf).collect()
    held = sum(os.path.getsize(os.path.join(d, f)) for path in staging._WRITTEN[mark:] for d, _, files in os.walk(path.removeprefix("file://")) for f in files if f.endswith(".parquet"))
    assert 0 < held < 8 * samples / 4


def test_silhouettes_of_copies_are_of_the_different_rows(spark, monkeypatch):
    """Copies give the same numbers as their rows one by one, and the pairs are of different rows only."""
    rng = np.random.default_rng(4)
    x = np.repeat(np.round(rng.normal(size=(90, 2)), 2), 7, axis=0)
    a, b = np.repeat(rng.integers(0, 3, 90), 7), np.arange(630) % 2
    df = spark.createDataFrame([(float(p), float(q), int(i), None if k % 50 == 0 else int(j)) for k, ((p, q), i, j) in enumerate(zip(x, a, b, strict=True))], "p double, q double, a long, b long")
    asked = []
    tiles = pairs.tiles
    monkeypatch.setattr(pairs, "tiles", lambda packed: asked.append(packed.agg(F.sum("n"), F.count("*")).first()) or tiles(packed))
    got = {r["labelling"]: r for r in pairs.silhouettes(df, ["p", "q"], ["a", "b"], 8).collect()}
    assert asked[0][0] <= 90 * 3 and asked[0][1] <= pairs.MOST
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for name, label, on in (("a", a, np.ones(630, bool)), ("b", b, np.arange(630) % 50 != 0)):
        d, own = dist[np.ix_(on, on)], label[on]
        mean = np.column_stack([d[:, own == c].sum(axis=1) / (own == c).sum() for c in np.unique(own)])
        n = np.array([(own == c).sum() for c in own])
        inner = mean[np.arange(len(own)), own] * n / (n - 1)
        mean[np.arange(len(own)), own] = np.inf
        near = mean.min(axis=1)
        assert got[name]["n"] == on.sum() and abs(got[name]["silhouette"] - ((near - inner) / np.maximum(near, inner)).mean()) < 1e-9


def test_density_clusters_of_copies_pair_the_different_rows(spark, monkeypatch):
    """Rows with copies get the clusters of the rows one by one, and the tiles hold different rows only."""
    rng = np.random.default_rng(8)
    centres = np.array([[0.0, 0.0], [6.0, 6.0], [0.0, 7.0]])
    x = np.repeat(np.concatenate([c + rng.normal(size=(40, 2)) for c in centres]), 3, axis=0)
    want = density.fit(x, 20).labels
    asked = []
    tiles = density.tiles
    monkeypatch.setattr(density, "tiles", lambda packed: asked.append(packed.agg(F.sum("n")).first()[0]) or tiles(packed))
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "k long, a double, b double")
    got = {r["k"]: r["cluster"] for r in density.density_clusters(df, ["a", "b"], "k", share=0.0).collect()}
    pairs_of = {(got[i], int(want[i])) for i in range(len(x))}
    assert len(pairs_of) == len({a for a, _ in pairs_of}) == len({b for _, b in pairs_of}) and len(pairs_of) > 2
    assert asked and max(asked) <= 120


def test_information_codes_its_values_once(monkeypatch):
    """The permutations of a corrected information permute codes; the values are sorted once a column."""
    rng = np.random.default_rng(2)
    a, b = rng.choice(["x", "y", "z"], 90).astype(object), rng.choice([1.0, 2.0, 3.0], 90).astype(object)
    order = np.random.default_rng(7)
    want = max(0.0, dynamics.mi_bits(a, b) - float(np.mean([dynamics.mi_bits(a, order.permutation(b)) for _ in range(50)])))
    calls, plain = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *x, **y: calls.append(1) or plain(*x, **y))
    assert dynamics.corrected_mi(a, b, 7) == (want, None) and len(calls) <= 2


def test_profiles_are_matched_without_a_frame_a_key(spark):
    """Matches of many small keys, null keys, null features and a side alone, as solved one by one; keys are read in a row, not by a frame of their own each."""
    rng = np.random.default_rng(6)
    make = lambda n: [(None if k == 30 else k, int(i), None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal())) for k in range(31) for i in range(n(k))]
    left, right = make(lambda k: k % 5), make(lambda k: (k * 7) % 4)
    kind = "key long, {} long, p double, q double"
    got = joins.match_profiles(spark.createDataFrame(left, kind.format("a")).repartition(3), spark.createDataFrame(right, kind.format("b")).repartition(2), "key", "a", "b", ["p", "q"], [1.0, 2.0], 1.2)
    want = []
    for k in [*range(30), None]:
        x, y = ([r for r in rows if r[0] == k] for rows in (left, right))
        if x and y:
            u, v = (np.array([r[2:] for r in rows], float) / [1.0, 2.0] for rows in (x, y))
            cost = np.nanmean(np.abs(u[:, None] - v[None]), axis=2)
            want += [(k, x[i][1], y[j][1], cost[i, j]) for i, j in joins.assignment(cost) if cost[i, j] <= 1.2]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(want) > 20 and sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert "CoGroups" not in got._jdf.queryExecution().toString()


def test_profiles_without_rows(spark):
    none = spark.createDataFrame([], "key long, a long, p double")
    assert joins.match_profiles(none, none.withColumnRenamed("a", "b"), "key", "a", "b", ["p"], [1.0], 1.0).collect() == []


_ON_THE_EDGE = (
    [381.90000000000003, 345.1, 460.20000000000005, 544.0, 945.5, 985.9000000000001, 643.9, 308.9, 138.7, 388.29999999999995, 1415.5, 436.3, 1037.4, 120.3],
    [383.8, 741.7, 604.8, 485.09999999999997, 1115.3, 254.4, 329.1, 118.0, 951.4, 850.8, 600.7, 334.3, 159.2, 122.0],
    [488.8, 166.8, 3080.1, 409.8, 423.9, 145.4, 318.4, 209.5, 536.1, 237.3, 426.8, 1112.6, 868.7, 267.0, 260.1, 268.79999999999995],
)


def test_steps_on_the_edge_of_a_bin_fall_as_in_sql(spark):
    """DYN07: the limit of the steps is rounded as DuckDB rounds it; a step on the edge of a bin tells the last bit of it."""
    rows = [(str(k), i, x) for k, s in enumerate((*_ON_THE_EDGE, [5.0, 5.1, 5.0, 5.1, 5.0, 5.1, 5.2])) for i, x in enumerate(s)]
    got = dynamics.difference_entropy(spark.createDataFrame(rows, "window_id string, i long, x double").repartition(3), "window_id")
    con = duckdb.connect()
    con.execute("create table ser (window_id varchar, i bigint, x double)")
    con.executemany("insert into ser values (?, ?, ?)", rows)
    assert of_spark(got) == of_duckdb(con, f"WITH {analysis_queries._STEPS} {analysis_queries._DIFF(16)}")


_AT_TOLERANCE = (
    [796, 828, 868, 756, 784, 860, 744, 844, 764, 704, 860, 892, 896, 800, 780, 712, 704, 888, 844, 836, 772, 796, 848, 900, 804],
    [724, 816, 792, 736, 832, 776, 820, 868, 864, 828, 720, 876, 816, 856, 840, 764, 844, 760, 804, 716, 772, 784, 808, 892, 792],
    [768, 864, 716, 736, 716, 716, 712, 764, 832, 860, 720, 748, 744, 704, 780, 708, 764, 896, 744, 780, 876, 828, 768, 860, 816],
)


def test_values_at_the_tolerance_match_as_in_sql(spark):
    """HRV05: the tolerance of these series is 12 or 10 but for its last bit, and values are apart by as much."""
    rows = [(k, i, float(x)) for k, s in enumerate(_AT_TOLERANCE) for i, x in enumerate(s)]
    got = dynamics.matched_templates(spark.createDataFrame(rows, "window_id long, i long, x double").repartition(3), "window_id").select("window_id", "two")
    con = duckdb.connect()
    con.execute("create table ser (window_id bigint, i bigint, x double)")
    con.executemany("insert into ser values (?, ?, ?)", rows)
    text = "WITH {} SELECT a.window_id, count(b.i) AS two FROM te a LEFT JOIN te b ON a.window_id = b.window_id AND a.i < b.i AND abs(a.x - b.x) <= a.r AND abs(a.y - b.y) <= a.r WHERE a.y IS NOT NULL GROUP BY 1"
    assert of_spark(got) == of_duckdb(con, text.format(extra_queries._TEMPLATES))


def test_straight_profiles_have_no_fluctuation(spark):
    """HRV05: where each part of a profile is a straight line its rest is rounding, not a fluctuation."""
    rows = [("straight", i, 700.1 if i < 48 else 800.3) for i in range(96)] + [("bent", i, 700.1 if i < 47 else 800.3) for i in range(96)]
    got = {r[0]: r[1] for r in dynamics.fluctuation(spark.createDataFrame(rows, "k string, i long, x double").repartition(3), "k").collect()}
    scales = [s for s in range(4, 17) if 48 % s]
    assert len(scales) >= 4
    x = np.array([r[2] for r in rows[:96]])
    y = np.cumsum(x - x.mean())
    logs = []
    for s in scales:
        parts, t = y[: 96 // s * s].reshape(-1, s), np.arange(s) - (s - 1) / 2
        rest = parts - parts.mean(axis=1, keepdims=True) - (parts @ t / (t @ t))[:, None] * t
        logs.append((np.log(s), np.log(np.sqrt((rest**2).mean()))))
    assert got["straight"] == pytest.approx(np.polyfit(*np.array(logs).T, 1)[0], abs=1e-9)
    assert got["bent"] == pytest.approx(dynamics.dfa_alpha(np.array([r[2] for r in rows[96:]])), abs=1e-9)


@pytest.mark.parametrize("name", ["HRV03", "DYN01"])
def test_recordings_are_dealt_by_rows(spark, sf, monkeypatch, name):
    """A task holds so many rows, however many there are, and the rows of the query stay."""
    want = of_spark(Q[name](spark, sf))
    rows = tables.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(tables, "ROWS", rows // 9, raising=False)
    assert tables.rr_intervals(spark, sf).rdd.getNumPartitions() >= 9
    assert of_spark(Q[name](spark, sf)) == want


def test_recordings_are_listed_once(spark, sf, monkeypatch):
    """SRC10: files that were written with lines in them aren't listed again for empty ones; a folder gives what a pattern gives."""
    asked = []
    plain = files.read_rr_files
    monkeypatch.setattr(files, "read_rr_files", lambda spark, path, *a, **k: asked.append(path) or plain(spark, path, *a, **k))
    got = Q["SRC10"](spark, sf)
    assert got.count() == tables.table(spark, sf, "lineitem").count()
    assert "binaryfile" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    by_pattern = plain(spark, f"{asked[0].rstrip('/')}/*/*.txt", r"name=p(\d+)").select("participant_id", "pos", "rr_ms")
    assert of_spark(got) == of_spark(by_pattern)


def test_folder_of_recordings(spark, tmp_path):
    for name, text in (("a", "800\n810\n"), ("b", "")):
        (tmp_path / f"name={name}").mkdir()
        (tmp_path / f"name={name}" / "x.txt").write_text(text)
    got = files.read_rr_files(spark, str(tmp_path), r"name=(\w+)", empty=False).collect()
    assert sorted((r["participant_id"], r["pos"], r["rr_ms"], r["blank"]) for r in got) == [("a", 0, 800.0, False), ("a", 1, 810.0, False)]
    with pytest.raises(ValueError, match="give a pattern"):
        files.read_rr_files(spark, str(tmp_path), r"name=(\w+)")


def test_counts_of_a_bootstrap_are_drawn_in_pieces(spark, monkeypatch):
    """RES03 (F19): a task never holds the counts of a whole batch of participants."""
    sums = spark.createDataFrame([(f"p{i}", i % 3, 1 + i % 7, i % 5) for i in range(900)], "person string, kind int, a long, b long").repartition(2)
    want = {(r["kind"], r["replicate"]): r["v"] for r in resampling.replicate_sums(sums, "person", keys=["kind"], repetitions=50).collect()}
    drawn = resampling.counts_of

    def bounded(people, repetitions, seed):
        assert len(people) * repetitions <= 1000
        return drawn(people, repetitions, seed)

    monkeypatch.setattr(resampling, "HELD", 1000, raising=False)
    monkeypatch.setattr(resampling, "counts_of", bounded)
    got = {(r["kind"], r["replicate"]): r["v"] for r in resampling.replicate_sums(sums, "person", keys=["kind"], repetitions=50).collect()}
    assert len(got) == 150 and got == want


def test_quantiles_of_large_groups(spark, sf, monkeypatch):
    """SES03, SES04 (F20, F21): quantiles of groups of any size are those of Spark's percentile, and no task gathers the values of a group."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 3 == 2 else i % 3, float(rng.normal()) if i % 11 else None, float(i % 4), None) for i in range(40000)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(7)
    at = [0.0, 0.2, 0.25, 0.5, 0.75, 1.0]
    columns = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    for keys in ([], ["g"]):
        want = {tuple(r[k] for k in keys): {c: [r[f"{c}{i}"] for i in range(len(at))] for c in "abc"} for r in df.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}{i}") for c in "abc" for i, q in enumerate(at)]).collect()}
        assert quantiles(df, columns, at, keys) == want
        assert quantiles(df, columns, at, keys, margin=1e-9) == want
    assert quantiles(df.limit(0), columns, at) == {(): {c: [None] * len(at) for c in "abc"}}
    for name in ("SES03", "SES04", "WIN06"):
        plan = Q[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "windowspec" not in plan
    gathered = []
    plain = F.percentile
    monkeypatch.setattr(F, "percentile", lambda *a, **k: gathered.append(a) or plain(*a, **k))
    Q["SES03"](spark, sf)
    assert not gathered


@pytest.mark.parametrize("name", ["SES03", "SES04"])
def test_sessions_are_dealt_by_rows(spark, sf, monkeypatch, name):
    """A task adds up the sessions of so many orders, however many there are, and the rows of the query stay."""
    want = of_spark(Q[name](spark, sf))
    monkeypatch.setattr(tables, "ROWS", tables.table(spark, sf, "orders").count() // 9)
    assert "repartition" in tables.sessions(spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert of_spark(Q[name](spark, sf)) == want


def test_rounds_of_mixtures_read_weighed_rows(spark):
    """ML10, ML11 (F17, F13): counts are drawn once for all rounds, copies are one row, and the sums of a round are those of each density by itself."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 3)) * [1, 5, 0.1] + [100, 0, 3]
    df = spark.createDataFrame([(f"p{i % 40}", *map(float, x[i % 200])) for i in range(600)], "who string, a double, b double, c double").repartition(3)
    drawn = spark.sparkContext.accumulator(0)
    columns, times = models.by_participant("who", 4)

    def counted(held):
        drawn.add(len(held[0]))
        return times(held)

    found = models.mixture_sweep(df, ["a", "b", "c"], ks=(1, 2, 3), starts=2, rounds=6, replicates=4, weigh=(columns, counted))
    assert drawn.value == 600
    rows = models.weighed(df, ["a", "b", "c"], 4, (columns, times))
    assert rows.count() == 200
    sums = models.mixture_sums(rows, ["a", "b", "c"], found, np.array([99.0, 1.0, 2.0]))
    held = df.toPandas()
    v, w = held[["a", "b", "c"]].to_numpy(), resampling.counts_of(held["who"].tolist(), 4, 42)
    for i, m in enumerate(found):
        k, t = m["k"], w[:, m["replicate"]]
        lp = models._log_density(v, m["means"], m["cov"], m["kind"]) + np.log(m["weights"])
        whole = np.logaddexp.reduce(lp, axis=1)
        r = np.exp(lp - whole[:, None])
        assert sums[i][0] == pytest.approx((whole * t).sum(), rel=1e-7)
        assert sums[i][1] == pytest.approx(-(t[:, None] * r * np.log(np.maximum(r, 1e-300))).sum(), rel=1e-6, abs=1e-6)
        assert sums[i][2 : 2 + k] == pytest.approx((r * t[:, None]).sum(axis=0), rel=1e-6, abs=1e-6)
        assert sums[i][2 + k : 2 + 2 * k] == pytest.approx(np.bincount(lp.argmax(axis=1), weights=t, minlength=k))
        y = v - [99.0, 1.0, 2.0]
        assert sums[i][2 + 2 * k : 2 + 5 * k] == pytest.approx(((r * t[:, None]).T @ y).ravel(), rel=1e-6, abs=1e-5)
        assert sums[i][2 + 5 * k :] == pytest.approx(np.einsum("ij,ik,il->jkl", r * t[:, None], y, y).ravel(), rel=1e-6, abs=1e-5)


def test_replicates_pair_different_rows(spark, monkeypatch):
    """RES04 (F8): copies are one row in the bootstraps of density clusters, drawn as often as all of them, and the overlaps count them all."""
    x, people = sample()
    x, people = np.concatenate([x, x[::2]]), np.concatenate([people, [f"copy{p}" for p in people[::2]]])
    paired = []
    plain = stability.predicted
    monkeypatch.setattr(stability, "predicted", lambda rows, *a: paired.append(rows.count()) or plain(rows, *a))
    got = {r["replicate"]: (r["clusters"], r["jaccard"]) for r in stability.density_stability(frame(spark, x, people), ["a", "b"], "k", "p", repetitions=2, size=64).collect()}
    assert paired == [len(np.unique(x, axis=0))]
    base, w = density.fit(x, 20).labels, resampling.counts_of(people.tolist(), 2, 42)
    for j in range(2):
        labels = one_matrix(x, w[:, j].astype(float), max(20, int(np.ceil(0.05 * len(x)))))[2]
        want = best_overlaps(base, labels)
        assert (j in got) == (want is not None)
        if want is not None:
            assert got[j][0] == len(set(labels[labels >= 0])) and abs(got[j][1] - want) < 1e-12
