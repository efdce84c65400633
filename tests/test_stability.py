"""Bootstraps of density clusters held to one matrix a replicate."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialweave.operators import density, resampling, stability


def one_matrix(x, w, least):
    """Cores, edges and labels of all rows of a replicate, with whole matrices."""
    on = np.flatnonzero(w > 0)
    d = density.distances(x, x[on])
    order = d.argsort(axis=1)
    run = w[on][order].cumsum(axis=1)
    core = np.take_along_axis(d, order, axis=1)[np.arange(len(x)), (run > least).argmax(axis=1)]
    tree = density.spanning_tree(x[on], core[on])
    found, begins = density.condensed(len(on), sorted(tree), least, w[on].astype(np.int64), core[on])
    h = density.Hierarchy(x[on], core[on], found, begins)
    out = h.label(x)
    out[on] = found
    return core, tree, out


def best_overlaps(a, b):
    if not (b >= 0).any():
        return None
    return np.mean([max(((a == i) & (b == j)).sum() / ((a == i) | (b == j)).sum() for j in set(b[b >= 0])) for i in sorted(set(a[a >= 0]))])


def sample(seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.4, (60, 2)) for m in ((0, 0), (4, 0), (0, 5))] + [rng.uniform(-3, 8, (20, 2))])
    x[5] = x[6] = x[7]
    people = np.array([f"p{i % 23}" for i in range(len(x))])
    return x, people


def frame(spark, x, people):
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1], "p": people}))


def test_copies_of_a_row_are_rows():
    """A row with a count gives the clusters of as many rows; one with enough copies is a cluster by itself."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (30, 2)) for m in (0, 5)] + [[[20.0, 20.0]]])
    w = np.concatenate([rng.integers(1, 4, 60), [25]])
    _, _, got = one_matrix(x, w, 10)
    want = density.fit(np.repeat(x, w, axis=0), 10).labels[np.concatenate([[0], w.cumsum()[:-1]])]
    pairs = set(zip(got.tolist(), want.tolist(), strict=True))
    assert len(pairs) == len(set(got)) == len(set(want)) >= 3
    assert got[60] >= 0 and (got == got[60]).sum() == 1


def test_replicates_equal_one_matrix(spark):
    x, people = sample()
    w = resampling.counts_of(people.tolist(), 4, 42).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"r": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1], **{f"w{j}": w[:, j] for j in range(4)}}))
    counts = [f"w{j}" for j in range(4)]
    cores = stability.weighted_cores(rows, ["a", "b"], counts, 20, 64)
    found = cores.orderBy("r").toPandas()
    tree = stability.weighted_trees(cores, ["a", "b"], 4, 64).toPandas()
    labels = stability.predicted(rows, ["a", "b"], counts, 20, 64).toPandas()
    assert len(labels) == 4 * len(x) and not labels.duplicated(["replicate", "r"]).any()
    for j in range(4):
        core, edges, want = one_matrix(x, w[:, j], 20)
        assert np.array_equal(found[f"core{j}"], np.where(w[:, j] > 0, core, np.inf))
        assert np.allclose(sorted(tree[tree["replicate"] == j]["w"]), sorted(e[0] for e in edges))
        got = labels[labels["replicate"] == j].sort_values("r")["label"].to_numpy()
        pairs = set(zip(got.tolist(), want.tolist(), strict=True))
        assert len(pairs) == len(set(got)) == len(set(want)) > 2


def test_stability_of_clusters(spark):
    x, people = sample()
    got = {r["replicate"]: (r["clusters"], r["jaccard"]) for r in stability.density_stability(frame(spark, x, people), ["a", "b"], "k", "p", repetitions=5, size=64).collect()}
    base, w = density.fit(x, 20).labels, resampling.counts_of(people.tolist(), 5, 42)
    assert set(base) > {0, 1}
    for j in range(5):
        labels = one_matrix(x, w[:, j].astype(float), 20)[2]
        want = best_overlaps(base, labels)
        assert (j in got) == (want is not None)
        if want is not None:
            assert got[j][0] == len(set(labels[labels >= 0])) and abs(got[j][1] - want) < 1e-12


def test_stability_without_clusters(spark):
    x, people = sample()
    df = frame(spark, x, people)
    for rows in (df.limit(0), df.limit(15), df.withColumn("a", F.lit(None).cast("double")), df.withColumn("p", F.lit(None).cast("string"))):
        assert stability.density_stability(rows, ["a", "b"], "k", "p", repetitions=3).collect() == []
