"""Reliability, agreement, association and persistence, from aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions.columns import correlation, count_where, safe_div
from trialweave.plans.staging import staged


#: So many distinct values are sorted by one task; the ranks are the same either way.
SORTED = 200_000


def one_way_icc(df: DataFrame, group: str, feature: str) -> DataFrame:
    """Unbalanced one-way ICC(1) over groups of two rows or more."""
    x = F.col(feature).cast("double")
    g = df.filter(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).filter("n >= 2")
    total = g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"))
    k, n = F.col("groups"), F.col("rows")
    msb = (F.col("between") - n * F.col("grand") * F.col("grand")) / F.nullif((k - 1).cast("double"), F.lit(0.0))
    msw = F.col("within") / F.nullif((n - k).cast("double"), F.lit(0.0))
    n0 = (n - F.col("squares") / n) / F.nullif((k - 1).cast("double"), F.lit(0.0))
    return total.select(F.lit(feature).alias("feature"), "groups", "rows", safe_div(msb - msw, msb + (n0 - 1) * msw).alias("icc"))


def trait_state(df: DataFrame, person: str, feature: str) -> DataFrame:
    """Variance between persons (of their means around the mean of all rows) and within (of rows around their person's mean)."""
    x = F.col(feature).cast("double")
    w = Window.partitionBy(person)
    rows = df.filter(x.isNotNull()).select(person, x.alias("x"), F.avg(x).over(w).alias("m"))
    grand = rows.agg(F.avg("x").alias("grand"))
    people = rows.groupBy(person).agg(F.avg("x").alias("m")).join(grand, F.lit(True)).agg(F.avg((F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"))
    within = rows.agg(F.avg((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("within"))
    out = people.join(within, F.lit(True))
    return out.select(F.lit(feature).alias("feature"), "between", "within", safe_div(F.col("between"), F.col("between") + F.col("within")).alias("between_fraction"))


def ranks(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """keys, column, ``rank`` (from 1, ties at their mean) and ``n``, the number of values of the key: a row a distinct value that isn't null.

    Values are counted; up to ``SORTED`` distinct ones are numbered by a window.  More are dealt to tasks by range and numbered there, and a task adds what stands before its range, so no task sorts them all.
    """
    keys = keys or []
    by_key = Window.partitionBy(*keys)  # of many values: a row a key and task
    counts = staged(df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__many")), "values")
    if counts.count() <= SORTED:
        run, all_rows = F.sum("__many").over(by_key.orderBy(column)), F.sum("__many").over(by_key)
        return counts.select(*keys, column, (run - F.col("__many") + (F.col("__many") + 1) / 2.0).alias("rank"), all_rows.alias("n"))
    placed = staged(counts.repartitionByRange(*keys, column).withColumn("__part", F.spark_partition_id()), "values")
    parts = placed.groupBy(*keys, "__part").agg(F.sum("__many").alias("__here"))
    before = parts.select(*keys, "__part", (F.sum("__here").over(by_key.orderBy("__part")) - F.col("__here")).alias("__before"), F.sum("__here").over(by_key).alias("n"))
    run = F.sum("__many").over(Window.partitionBy(*keys, "__part").orderBy(column))
    if not keys:
        out = placed.withColumn("__run", run).join(before, "__part")
    else:
        same = F.col("a.__part") == F.col("b.__part")
        for k in keys:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        out = placed.withColumn("__run", run).alias("a").join(before.alias("b"), same).select("a.*", "b.__before", "b.n")
    return out.select(*keys, column, (F.col("__before") + F.col("__run") - F.col("__many") + (F.col("__many") + 1) / 2.0).alias("rank"), "n")


def spearman(df: DataFrame, left: str, right: str, least: int = 4, keys: list[str] | None = None) -> DataFrame:
    """keys, n, rho: Pearson correlation of average ranks over rows with both.  Both columns are ranked in one pass, as values of one column with a key more."""
    keys = keys or []
    both = staged(df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, F.col(left).cast("double").alias("__x"), F.col(right).cast("double").alias("__y")), "pairs")
    long = both.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("__side"), F.col("__x").alias("__v")), F.struct(F.lit(1).alias("__side"), F.col("__y").alias("__v")))).alias("__s"))
    placed = staged(ranks(long.select(*keys, "__s.*"), "__v", [*keys, "__side"]), "ranks")
    ranked = both
    for side, c, name in ((0, "__x", "__a"), (1, "__y", "__b")):
        found = placed.filter(F.col("__side") == side).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__v").alias("__w"), F.col("rank").alias(name))
        on = F.col(c) == F.col("__w")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        ranked = ranked.join(found, on).drop("__w", *[f"__k_{k}" for k in keys])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col("__a"), F.col("__b"), least).alias("rho"))


def concordance(a: Column, b: Column) -> Column:
    """Lin's coefficient from population moments over rows with both."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    gap = F.avg(x) - F.avg(y)
    return safe_div(2 * F.covar_pop(x, y), F.var_pop(x) + F.var_pop(y) + gap * gap)


def binary_agreement(df: DataFrame, truth: Column, found: Column) -> DataFrame:
    """Counts of a two-way decision, sensitivity, specificity, balanced accuracy and kappa."""
    t, f = truth, found
    out = df.agg(count_where(t & f).alias("tp"), count_where(~t & ~f).alias("tn"), count_where(~t & f).alias("fp"), count_where(t & ~f).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    sens, spec = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    chance = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    return out.withColumns({"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2, "kappa": safe_div((tp + tn) / n - chance, 1 - chance)})


def spearman_brown(icc: Column, m: Column) -> Column:
    return safe_div(m * icc, 1 + (m - 1) * icc)


def association(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Every cell of a two-way table, zeros too, with its expected count and share of chi-square."""
    counts = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.count("*").alias("n"))
    r = counts.groupBy(rows).agg(F.sum("n").alias("row_total"))
    c = counts.groupBy(columns).agg(F.sum("n").alias("column_total"))
    total = counts.agg(F.sum("n").alias("total"))
    grid = r.join(c, F.lit(True)).join(total, F.lit(True))  # labels by labels
    cells = grid.join(counts, [rows, columns], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    gap = F.col("n") - expected
    return cells.select(rows, columns, "n", "row_total", "column_total", expected.alias("expected"), (gap * gap / expected).alias("chi2_part"), (F.col("n") / expected).alias("observed_to_expected"))


def chi_square(cells: DataFrame, rows: str, columns: str) -> DataFrame:
    """chi2, dof and Cramer's V of an association table; Yates' correction where there is one degree of freedom."""
    out = cells.agg(F.count_distinct(rows).alias("r"), F.count_distinct(columns).alias("c"), F.sum("n").alias("total"), F.sum("chi2_part").alias("plain"),
        F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("expected")) - 0.5, F.lit(0.0)), F.lit(2.0)) / F.col("expected")).alias("yates"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    chi = F.when(dof == 1, F.col("yates")).otherwise(F.col("plain"))
    return out.select("total", dof.cast("long").alias("dof"), chi.alias("chi2"), F.sqrt(safe_div(chi, F.col("total") * (F.least("r", "c") - 1))).alias("cramers_v"))


def chi2_sf(x: float, dof: int) -> float:
    """P(chi-square of ``dof`` > x), by the series or continued fraction of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def label_occupancy(df: DataFrame, person: str, label: str) -> DataFrame:
    """Each person's rows, modal label with its share, and entropy of labels in units of the number of labels."""
    labels = df.select(F.count_distinct(label).alias("labels"))
    counts = df.groupBy(person, label).agg(F.count("*").alias("k"))
    w = Window.partitionBy(person)
    p = F.col("k") / F.sum("k").over(w)
    out = counts.withColumn("p", p).groupBy(person).agg(F.sum("k").alias("n"), F.max_by(label, F.struct(F.col("k"), F.col(label))).alias("modal_label"), F.max("p").alias("modal_share"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    return out.join(labels, F.lit(True)).select(person, "n", "modal_label", "modal_share", F.when(F.col("labels") > 1, F.col("h") / F.ln(F.col("labels").cast("double"))).alias("entropy"))


def pair_agreement(df: DataFrame, person: str, label: str) -> DataFrame:
    """Share of pairs of a person's rows that carry one label, over all persons."""
    counts = df.groupBy(person, label).agg(F.count("*").alias("k"))
    people = counts.groupBy(person).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("same"), F.sum("k").alias("n"))
    return people.agg(safe_div(F.sum("same"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("pair_agreement"))


def transition_table(df: DataFrame, keys: list[str], order: list[str], label: str, adjacent: Column | None = None) -> DataFrame:
    """Dense counts and row shares of label pairs of neighbouring rows; ``adjacent`` may ask more of a neighbour (lead columns are named next_*)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in dict.fromkeys([label, *order])})
    rows = rows.filter(F.col(f"next_{label}").isNotNull() & (adjacent if adjacent is not None else F.lit(True)))
    counts = rows.groupBy(F.col(label).alias("from_label"), F.col(f"next_{label}").alias("to_label")).agg(F.count("*").alias("n"))
    labels = df.select(label).distinct()
    grid = labels.toDF("from_label").join(labels.toDF("to_label"), F.lit(True))  # labels by labels
    out = grid.join(counts, ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("share", safe_div(F.col("n"), F.sum("n").over(Window.partitionBy("from_label"))))


def group_slopes(df: DataFrame, group: str, y: str, x: str, expected: int) -> DataFrame:
    """Slopes of each group with 3 rows and 2 values of x: their number, median and the share in the expected direction."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    g = df.filter(both).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(x).alias("d"), F.regr_slope(y, x).alias("slope")).filter("n >= 3 and d >= 2")
    return g.agg(F.count("*").alias("groups"), F.median("slope").alias("median_slope"), F.avg((F.signum(F.round("slope", 9)) == expected).cast("double")).alias("share_expected"))


def directional_effects(domains: dict[str, tuple[DataFrame, str, dict[str, int]]], group: str, *, least: int = 5, share: float = 0.6) -> DataFrame:
    """A row for each domain and outcome: slopes of the outcome on the domain's predictor in each group (3 rows and 2 values of the predictor at least), their number, median and share in
    the expected direction, and the verdict; with the share of supported outcomes of the domain.

    ``domains``: name -> (rows, predictor, outcome -> expected sign).  All outcomes of a domain share one pass.
    """
    long = None
    for name, (rows, predictor, outcomes) in domains.items():
        each = F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(sign).alias("expected"), F.col(o).cast("double").alias("y")) for o, sign in outcomes.items()])
        part = rows.select(F.lit(name).alias("domain"), F.col(group).alias("g"), F.col(predictor).cast("double").alias("x"), F.explode(each).alias("e")).select("domain", "g", "x", "e.*")
        long = part if long is None else long.unionByName(part)
    by = ["domain", "outcome", "expected"]
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    fits = long.groupBy(*by, "g").agg(F.count(F.when(both, 1)).alias("n"), F.count_distinct(F.when(both, F.col("x"))).alias("d"), F.regr_slope("y", "x").alias("s"))
    slope = F.when((F.col("n") >= 3) & (F.col("d") >= 2), F.round("s", 9))
    hit = F.when(slope.isNotNull(), (F.signum(slope) == F.col("expected")).cast("double"))
    found = fits.groupBy(*by).agg(F.count(slope).alias("groups"), F.median(slope).alias("median_slope"), F.avg(hit).alias("share_expected"))
    enough = F.col("groups") >= least
    supported = enough & (F.signum("median_slope") == F.col("expected")) & (F.col("share_expected") >= share)
    rows = found.withColumn("verdict", F.when(~enough, "not_testable").when(supported, "supported").otherwise("not_supported"))
    sums = rows.groupBy("domain").agg(F.avg((F.col("verdict") == "supported").cast("double")).alias("domain_share"))
    return rows.join(sums, "domain")


def replication_gate(effects: DataFrame, participants: DataFrame, group: str, *, least: int = 5, share: float = 0.6, domains: int = 3) -> DataFrame:
    """One row: domains tested and supported, and whether models beyond the published effects are open."""
    per = effects.groupBy("domain").agg((F.max("groups") >= least).cast("int").alias("t"), (F.max("domain_share") >= share).cast("int").alias("s"))
    sums = per.agg(F.sum("t").alias("domains_tested"), F.sum("s").alias("domains_supported"))
    people = participants.agg(F.count_distinct(group).alias("participants"))
    status = F.when(F.col("participants") < 5, "not_testable").when((F.col("domains_supported") >= 2) & (F.col("domains_tested") == domains), "passed").otherwise("failed")
    return people.join(sums, F.lit(True)).select("participants", "domains_tested", "domains_supported", status.alias("status"))
