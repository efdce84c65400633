"""Findings of round 4: one small test each, that the code before the change would fail."""

import numpy as np
import pandas as pd

from trialweave.operators import density, ecg, pairs, stability


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame({"r": np.arange(len(x)), **{f"f{k}": x[:, k] for k in range(x.shape[1])}, **more}))


def first_tree(x, core):
    """The edges of the one tree that is least in the order (w, a, b), by Kruskal's way."""
    mutual = np.maximum(np.maximum(density.distances(x, x), core[:, None]), core)
    a, b = np.triu_indices(len(x), 1)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for k in np.lexsort((b, a, mutual[a, b])).tolist():
        p, q = find(int(a[k])), find(int(b[k]))
        if p != q:
            root[p] = q
            out.append((float(mutual[a[k], b[k]]), int(a[k]), int(b[k])))
    return sorted(out)


def test_cores_take_one_pass(spark, monkeypatch):
    """ML08 (F3): core distances of all replicates come from one pass over the pairs of rows; rows whose range misses get another, and are the same."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 3)) * [1, 2, 30] + 5
    w = rng.integers(0, 4, (700, 2)).astype(float)
    rows = frame(spark, x, w0=w[:, 0], w1=w[:, 1])
    dist = density.distances(x, x)
    order = dist.argsort(axis=1)
    monkeypatch.setattr(stability, "SAMPLE", 128)
    monkeypatch.setattr(stability, "CHUNK", 150)
    passes, strips = [], stability.strips
    monkeypatch.setattr(stability, "strips", lambda *how: passes.append(how) or strips(*how))
    for least in (60, 1):
        passes.clear()
        got = stability.weighted_cores(rows, ["f0", "f1", "f2"], ["w0", "w1"], least, 64).orderBy("r").toPandas()
        for j in range(2):
            run = w[:, j][order].cumsum(axis=1)
            core = np.take_along_axis(dist, order, axis=1)[np.arange(len(x)), (run > least).argmax(axis=1)]
            assert np.array_equal(got[f"core{j}"], np.where(w[:, j] > 0, core, np.inf))
        assert 1 <= len(passes) <= 2


def test_tiles_are_of_different_components(spark, monkeypatch):
    """ML08 (F3): the first round needs no pairs of all rows, the others only rows near the borders; the tree is the first one in order."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1, (150, 2)) for c in (0, 12)] + [rng.normal(6, 0.5, (4, 2))])
    core = np.sort(density.distances(x, x), axis=1)[:, 20]
    asked, tiles = [], density.tiles
    monkeypatch.setattr(density, "tiles", lambda packed: asked.append(packed.agg({"n": "sum"}).first()[0]) or tiles(packed))
    got = density.shared_tree(frame(spark, x, core=core), ["f0", "f1"], 64).collect()
    assert sorted((r["w"], r["a"], r["b"]) for r in got) == first_tree(x, core)
    assert 1 <= len(asked) <= 3
    one = rng.normal(0, 1, (200, 2))
    core = np.sort(density.distances(one, one), axis=1)[:, 120]
    asked.clear()
    got = density.shared_tree(frame(spark, one, core=core), ["f0", "f1"], 64).collect()
    assert sorted((r["w"], r["a"], r["b"]) for r in got) == first_tree(one, core) and len(asked) <= 1


def test_a_filter_makes_each_chunk_once_for_its_states(spark, monkeypatch):
    """HRV02, HRV08_paths (F5, F2): both passes' states come from one making of a chunk, and only the chunks beside the ends are made for their samples."""
    rate, rng = 100.0, np.random.default_rng(6)
    x = rng.normal(size=3000) + np.sin(np.arange(3000) / 50)
    cuts = [0, 400, 1000, 1100, 1900, 2500, 3000]
    rows = spark.createDataFrame([("a", k, lo, x[lo:hi].tolist()) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))], "who string, chunk int, start long, samples array<double>")
    made, each = [], ecg.Waves.each
    monkeypatch.setattr(ecg.Waves, "each", lambda self, of, columns, rows=None: made.append((self.rows if rows is None else rows).count()) or each(self, of, columns, rows))
    sections = ecg.band_pass(rate, 0.5, 40.0)
    got = ecg.zero_phase(ecg.Waves.of(rows, ["who"]), ["who"], rate, sections)
    assert sum(made) <= 2 + 6
    clean = np.concatenate([r["samples"] for r in got.samples().orderBy("chunk").collect()])
    cascade = ecg.Cascade(sections)
    pad = cascade.reach
    whole = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    y = cascade.run(whole, cascade.settled * whole[0])[0][::-1]
    want = cascade.run(y, cascade.settled * y[0])[0][::-1][pad : pad + len(x)]
    assert np.abs(clean - want).max() < 1e-9


def test_sliding_sums_by_doubling():
    """The means and summits of detectors take windows together in powers of two: a flat stretch stays flat."""
    x = np.concatenate([np.zeros(100), np.random.default_rng(7).normal(size=200), np.full(100, 3.0)])
    for n in (1, 2, 15, 20, 75):
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (n // 2, n - 1 - n // 2), mode="edge"), n)
        assert np.allclose(ecg._mean(x, n), windows.mean(axis=1), atol=1e-13) and not ecg._mean(x, n)[:20].any()
        high = np.lib.stride_tricks.sliding_window_view(np.pad(x, n, constant_values=-np.inf), n).max(axis=1)
        assert np.array_equal(ecg._summits(x, n), np.flatnonzero((x > high[: len(x)]) & (x >= high[n + 1 : n + 1 + len(x)])))


def test_silhouettes_add_up_rows_of_the_same_labels(spark, monkeypatch):
    """ML07 (F6): distances are products of matrices, added up once for all labellings; equal and far rows, copies and missing labels too."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, (40, 3)) for c in (0, 4, 1e4)])
    x[50:60] = x[:10]
    x[61] = x[60] + 1e-9
    one, two = np.arange(120) // 40, rng.integers(0, 3, 120)
    there = rng.random(120) < 0.8
    monkeypatch.setattr(pairs, "distances", None)  # which took every column of every pair by itself
    df = frame(spark, np.concatenate([x, x]), one=np.tile(one, 2), two=pd.array(np.tile(np.where(there, two, -5), 2))).selectExpr("f0", "f1", "f2", "one", "nullif(two, -5) as two")
    got = {r["labelling"]: r for r in pairs.silhouettes(df, ["f0", "f1", "f2"], ["one", "two"], 16).collect()}
    monkeypatch.setattr(pairs, "FEW", 0)
    again = {r["labelling"]: r for r in pairs.silhouettes(df, ["f0", "f1", "f2"], ["one", "two"], 16).collect()}
    assert all(got[c]["n"] == again[c]["n"] and abs(got[c]["silhouette"] - again[c]["silhouette"]) < 1e-11 for c in ("one", "two"))
    rows = np.concatenate([x, x])
    dist = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    for name, label in (("one", np.tile(one, 2)), ("two", np.where(np.tile(there, 2), np.tile(two, 2), -1))):
        on = label >= 0
        n = np.bincount(label[on])
        mean = np.stack([dist[:, label == c].sum(axis=1) for c in range(3)], axis=1)
        i = np.arange(len(rows))[on]
        inner = mean[i, label[on]] / (n[label[on]] - 1)
        other = mean[i] / n
        other[np.arange(len(i)), label[on]] = np.inf
        near = other.min(axis=1)
        assert got[name]["n"] == on.sum() and abs(got[name]["silhouette"] - ((near - inner) / np.maximum(near, inner)).mean()) < 1e-11
