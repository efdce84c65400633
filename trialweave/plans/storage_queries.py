"""Queries over contracts, settings, reports, archives and written tables; density clusters; windows of several lengths."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.operators import density, heart, models, windows
from trialweave.plans.analysis_queries import _COR, _HRV
from trialweave.plans.model_queries import FEATURES, scaled, scratch
from trialweave.plans.oracle import RR, over, r6, rr_windows, upto
from trialweave.plans.staging import staged
from trialweave.plans.trial_queries import query
from trialweave.sources import files, tables
from trialweave.sources.tables import table

# --- contracts and settings ------------------------------------------------------------------------------------------------------------------------------------------

CONTRACT = {"customer": ["c_custkey", "c_nationkey"], "lineitem": ["l_orderkey", "l_partkey"], "visits": ["v"]}
_AUDIT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, true AS present, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t}" for t in ("customer", "lineitem") for c in CONTRACT[t])


@query("SRC01", f"{_AUDIT} UNION ALL SELECT 'visits', 'v', false, NULL, NULL, NULL")
def src01(spark, sf):
    """A contract loaded from JSON, and what the tables hold of it."""
    found = files.load_contract(files.write_json({"tables": CONTRACT}, scratch(spark, ".json")))
    return files.contract_audit({n: table(spark, sf, n) for n in ("customer", "lineitem")}, found)


@query("SRC03", upto("trials", "SELECT 'Missing table: visits' AS value UNION ALL SELECT format('Table trials: {} of {} rows have no rt_ms', count(*) - count(rt_ms), count(*)) FROM trials HAVING count(rt_ms) < count(*)"))
def src03(spark, sf):
    """A database that breaks its contract, in its tables or in its rows, stops the run and leaves a report."""
    path = scratch(spark, ".txt")
    try:
        files.require_complete({"trials": tables.trials(spark, sf)}, {"trials": ["observation_id", "rt_ms"], "visits": ["v"]}, path)
    except ValueError:
        return spark.read.text(path)
    raise AssertionError("the contract is broken")


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...]
    floor: float = 150.0


_SIZED = "SELECT s AS size, 150.0::DOUBLE AS floor, sum(n)::BIGINT AS n_trials, sum(n // s)::BIGINT AS n_windows FROM (SELECT participant_id, block_raw, count(*) AS n FROM trials WHERE rt_ms >= 150 GROUP BY ALL), (VALUES (12), (16), (24)) AS t(s) GROUP BY ALL"


@query("SRC21", upto("trials", _SIZED))
def src21(spark, sf):
    """Settings from JSON, and the windows that they cut from the trials."""
    s = files.load_config(files.write_json({"sizes": [12, 16, 24]}, scratch(spark, ".json")), Settings)
    blocks = tables.trials(spark, sf).filter(F.col("rt_ms") >= s.floor).groupBy("participant_id", "block_raw").agg(F.count("*").alias("n"))
    sized = blocks.withColumn("size", F.explode(F.array(*[F.lit(x) for x in s.sizes])))
    return sized.groupBy("size").agg(F.lit(s.floor).alias("floor"), F.sum("n").alias("n_trials"), F.sum(F.floor(F.col("n") / F.col("size"))).alias("n_windows"))


# --- readers ---------------------------------------------------------------------------------------------------------------------------------------------------------


@query("SRC09", f"SELECT c_custkey, {r6('c_acctbal')} FROM customer")
def src09(spark, sf):
    """A worksheet that a former run has kept as Parquet."""
    cache = files.write_table(table(spark, sf, "customer"), scratch(spark, ".parquet"))
    return files.read_excel(spark, "sessions.xlsx", cache, columns=["c_custkey", "c_acctbal"])


@query("SRC13", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'sampling_rate' WHEN s_suppkey % 10 = 1 THEN 'missing_channel' END AS issue FROM supplier")
def src13(spark, sf):
    k = F.col("s_suppkey") % 10
    meta = table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, 250.0).otherwise(500.0).alias("sampling_rate"), F.when(k == 1, F.array(F.lit("Fz"))).otherwise(F.array(F.lit("Fz"), F.lit("ECG1"))).alias("channels"))
    return files.recording_issues(meta).select("s_suppkey", "issue")


@query("SRC16", "SELECT c_custkey, format('sub-{:02d}.zip', c_custkey % 29 + 1) AS file FROM customer")
def src16(spark, sf):
    return table(spark, sf, "customer").withColumn("number", F.col("c_custkey") % 29 + 1).select("c_custkey", files.participant_file("number").alias("file"))


@query("SRC17", "SELECT c_name AS file, CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size_differs' WHEN 2 THEN 'digest_differs' ELSE 'verified' END AS status FROM customer")
def src17(spark, sf):
    """Files held against the sizes and digests of a manifest."""
    content = table(spark, sf, "customer").select("c_name", (F.col("c_custkey") % 5).alias("kind"), F.encode("c_name", "UTF-8").alias("c"))
    manifest = content.select(F.col("c_name").alias("file"), F.length("c").alias("bytes"), F.md5("c").alias("md5"))
    kind, size = F.col("kind"), F.length("c")
    digest = F.when(kind == 2, F.md5(F.concat(F.lit("x"), "c_name").cast("binary"))).otherwise(F.md5("c"))
    found = content.filter(kind != 0).select(F.col("c_name").alias("file"), F.when(kind == 1, size - 1).otherwise(size).alias("bytes"), digest.alias("md5"))
    return files.verify_files(found, manifest)


@query("SRC19", "SELECT 'c' || (c_custkey // 100) || '.zip' AS path, c_custkey || '.txt' AS archive_member, length(c_name) AS uncompressed_bytes FROM customer")
def src19(spark, sf):
    """Archives of a hundred customers each, and what is in them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows in b.column(1).to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("customers/", "")
                    for r in rows:
                        z.writestr(f"{r['c_custkey']}.txt", r["c_name"])
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    path = F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 100).cast("string"), F.lit(".zip")).alias("path")
    groups = table(spark, sf, "customer").groupBy(path).agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows"))
    return files.archive_members(groups.mapInArrow(packed, "path string, content binary")).drop("compressed_bytes")


# --- writers ---------------------------------------------------------------------------------------------------------------------------------------------------------


@query("SNK02", upto("trials", f"SELECT dataset_id, congruency, count(*) AS n, {r6('avg(rt_ms) FILTER (rt_ms > 2500) AS slow_mean')} FROM trials GROUP BY ALL"))
def snk02(spark, sf):
    """Figures of each dataset and condition as JSON: what isn't finite is null."""
    slow = F.coalesce(F.avg(F.when(F.col("rt_ms") > 2500, F.col("rt_ms"))), F.lit(float("nan")))
    found = tables.trials(spark, sf).groupBy("dataset_id", "congruency").agg(F.count("*").alias("n"), slow.alias("slow_mean")).collect()  # four a dataset
    path = files.write_json([{**r.asDict(), "n": np.int64(r["n"])} for r in found], scratch(spark, ".json"))
    return spark.read.schema("dataset_id long, congruency string, n long, slow_mean double").json(path, multiLine=True)


@query("SNK03", upto("trials", "SELECT string_agg(task_family || ': ' || n || ' trials', chr(10) ORDER BY task_family) || chr(10) AS value FROM (SELECT task_family, count(*) AS n FROM trials GROUP BY 1)"))
def snk03(spark, sf):
    """A report with one newline at its end, however many the text had."""
    counts = tables.trials(spark, sf).groupBy("task_family").count().orderBy("task_family")
    text = "\n".join(f"{r['task_family']}: {r['count']} trials" for r in counts.toLocalIterator())
    return spark.read.text(files.write_text(text + "\n\n\n", scratch(spark, ".md")), wholetext=True)


@query("SNK04", f"SELECT o_orderkey, {r6('o_totalprice')} FROM orders")
def snk04(spark, sf):
    """Batches appended to gzipped CSV, then one Parquet table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = files.append_csv((orders.filter(part).drop("o_orderstatus") for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F' or o_orderstatus is null")), scratch(spark, ".csv.gz"))
    return files.read_table(spark, files.write_table(files.read_table(spark, path, schema="o_orderkey long, o_totalprice double"), scratch(spark, ".parquet")))


@query("SNK05", "SELECT 5 AS seed, 16 AS size, count(*) AS trials, count(DISTINCT user_id) AS participants, true AS versioned FROM events")
def snk05(spark, sf):
    """Stages that add their settings and the size of their input to one manifest."""
    path = scratch(spark, ".json")
    rows = tables.trials(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("participant_id").alias("p")).first()
    files.update_manifest(path, "windows", {"size": 16, "trials": rows["n"]})
    files.update_manifest(path, "models", {"seed": 5, "participants": rows["p"]})
    at = lambda name, kind: F.col(f"stages.{name}").cast(kind)
    return spark.read.json(path, multiLine=True).select(
        at("models.seed", "int").alias("seed"), at("windows.size", "int").alias("size"), at("windows.trials", "long").alias("trials"), at("models.participants", "long").alias("participants"), F.col("versions.pyspark").isNotNull().alias("versioned")
    )


@query("SNK08", "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1")
def snk08(spark, sf):
    """The second run reads what the first one has built."""
    path = scratch(spark, ".parquet")
    files.reused(spark, path, lambda: table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")))

    def never() -> DataFrame:
        raise AssertionError("built twice")

    return files.reused(spark, path, never)


# --- windows of several lengths --------------------------------------------------------------------------------------------------------------------------------------

#: Seconds, role and least intervals.
LENGTHS = ((10, "replication", 5), (60, "extended", 30), (120, "extended", 30), (180, "extended", 30), (None, "benchmark", 30))
_WHOLE = "rrw AS (SELECT participant_id, pos, 0 AS window_index FROM rr WHERE rr_ms > 0)"
_SQL08 = " UNION ALL ".join(
    "SELECT * FROM (" + over(f"SELECT participant_id, '{s or 'full'}' AS window_label, '{role}' AS role, window_index, n_intervals, {r6('mean_nn', 'sdnn', 'rmssd')}, n_intervals >= {least} AND corrected_fraction <= 0.05 AS quality_pass FROM h2", RR, _COR, rr_windows(s) if s else _WHOLE, _HRV) + ")"
    for s, role, least in LENGTHS
)


@query("HRV08", _SQL08)
def hrv08(spark, sf):
    """Features of a recording's windows of all lengths; the intervals are corrected once."""
    rr = staged(heart.correct_rr(tables.rr_intervals(spark, sf), ["participant_id"]), "corrected")
    kept = [*rr.columns, "window_index"]

    def cut(seconds, role, least) -> DataFrame:
        rows = windows.rr_windows(rr, seconds) if seconds else rr.filter("rr_ms > 0 and not isnan(rr_ms)").withColumn("window_index", F.lit(0).cast("long"))
        return rows.select(*kept, F.lit(str(seconds or "full")).alias("window_label"), F.lit(role).alias("role"), F.lit(least).alias("least"))

    rows = reduce(DataFrame.unionByName, (cut(*x) for x in LENGTHS))
    out = heart.time_domain(rows, ["participant_id", "window_label", "role", "least", "window_index"])
    good = (F.col("n_intervals") >= F.col("least")) & (F.col("corrected_fraction") <= 0.05)
    return out.select("participant_id", "window_label", "role", "window_index", "n_intervals", "mean_nn", "sdnn", "rmssd", good.alias("quality_pass"))


# --- models ----------------------------------------------------------------------------------------------------------------------------------------------------------


@query("ML00", """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT o_orderstatus, count(*) AS k, min(n) AS least, sum(n) AS rows FROM c GROUP BY 1)
SELECT o_orderstatus, kind, k, CASE kind WHEN 'diag' THEN k * 10 + k - 1 ELSE k * 20 + k - 1 END AS parameters, least >= 20 AND least / rows >= 0.05 AS enough_rows FROM g, (VALUES ('diag'), ('full')) AS t(kind)""")
def ml00(spark, sf):
    """Free parameters of a mixture with a component for each priority of a status, over five features, and whether each component has rows enough."""
    sizes = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").count().groupBy("o_orderstatus").agg(F.collect_list("count").alias("n")).collect()  # labels by labels
    out = [(r["o_orderstatus"], kind, len(r["n"]), models.parameter_count(len(r["n"]), 5, kind), bool(models.enough_rows(np.array(r["n"])))) for r in sizes for kind in ("diag", "full")]
    return spark.createDataFrame(out, "o_orderstatus string, kind string, k long, parameters long, enough_rows boolean")


@query("ML08")
def ml08(spark, sf):
    """Density clusters of windows, with noise."""
    return density.density_clusters(scaled(spark, sf), FEATURES, "window_id").select("window_id", "cluster")
