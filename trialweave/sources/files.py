"""Readers and writers: contracts, projections, interval text files, tables by suffix, upserts, manifests."""

from __future__ import annotations

import io
import json
import math
import os
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import fields
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- small files: plain paths are the driver's own, those with a scheme are in a store that Spark reads ----------------------------------------------------------------


def _hadoop(path: str):
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    p, fs = _hadoop(path)
    return fs.exists(p)


def get(path: str) -> str:
    """A small file's text."""
    if "://" in path:
        return SparkSession.active().read.text(path, wholetext=True).first()[0]
    with open(path) as f:
        return f.read()


def put(text: str, path: str) -> str:
    """Write a small file."""
    if "://" in path:
        p, fs = _hadoop(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


# --- contracts -------------------------------------------------------------------------------------------------------------------------------------------------------


def load_contract(path: str) -> dict[str, list[str]]:
    """Table names with their required columns."""
    data = json.loads(get(path))
    return data.get("tables", data)


def validate_schema(tables: dict[str, DataFrame], contract: dict[str, list[str]]) -> list[str]:
    """What is missing, as sentences; empty if nothing is."""
    out = []
    for name in sorted(contract):
        if name not in tables:
            out.append(f"Missing table: {name}")
        elif lost := sorted(set(contract[name]) - set(tables[name].columns)):
            out.append(f"Table {name} is missing columns: {', '.join(lost)}")
    return out


def require_schema(tables: dict[str, DataFrame], contract: dict[str, list[str]], report: str | None = None) -> dict[str, DataFrame]:
    """The same tables; an error that lists every discrepancy, which ``report`` keeps as text."""
    if issues := validate_schema(tables, contract):
        if report:
            write_text("\n".join(issues), report)
        raise ValueError("; ".join(issues))
    return tables


def contract_audit(tables: dict[str, DataFrame], contract: dict[str, list[str]]) -> DataFrame:
    """table_name, column_name, present, n_rows, n_values, n_distinct of each column of a contract, from one aggregate a table."""
    spark = next(iter(tables.values())).sparkSession
    kind = "table_name string, column_name string, present boolean, n_rows long, n_values long, n_distinct long"
    lost = [(t, c, False, None, None, None) for t, cols in contract.items() for c in cols if t not in tables or c not in tables[t].columns]
    out = spark.createDataFrame(lost, kind)
    for name, df in tables.items():
        if held := [c for c in contract.get(name, []) if c in df.columns]:
            one = df.agg(F.count("*").alias("n"), *[f for i, c in enumerate(held) for f in (F.count(c).alias(f"v{i}"), F.count_distinct(c).alias(f"d{i}"))])
            rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("n_values"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(held)]))
            out = out.unionByName(one.select("n", rows.alias("x")).select(F.lit(name).alias("table_name"), "x.column_name", F.lit(True).alias("present"), F.col("n").alias("n_rows"), "x.n_values", "x.n_distinct"))
    return out


def require_complete(tables: dict[str, DataFrame], contract: dict[str, list[str]], report: str | None = None) -> dict[str, DataFrame]:
    """The same tables; an error that lists what is missing: tables, columns and, of columns that are there, how many rows have no value.  ``report`` keeps the list as text."""
    issues = validate_schema(tables, contract)
    gaps = contract_audit(tables, contract).filter("n_values < n_rows").orderBy("table_name", "column_name").collect()  # a row a column of the contract
    issues += [f"Table {r['table_name']}: {r['n_rows'] - r['n_values']} of {r['n_rows']} rows have no {r['column_name']}" for r in gaps]
    if issues:
        if report:
            write_text("\n".join(issues), report)
        raise ValueError("; ".join(issues))
    return tables


def load_config(path: str, kind: type):
    """A dataclass from JSON: lists become tuples, unknown names are errors."""
    data = json.loads(get(path))
    if unknown := sorted(set(data) - {x.name for x in fields(kind)}):
        raise TypeError(f"unknown settings: {unknown}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def run_sql(spark: SparkSession, path: str) -> DataFrame:
    """The query of an SQL file over the session's views."""
    return spark.sql(get(path).strip().rstrip(";"))


# --- readers ---------------------------------------------------------------------------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or gzipped CSV by suffix, with those of the wanted columns that are there."""
    if path.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def first_readable(spark: SparkSession, stem: str, columns: list[str] | None = None) -> DataFrame:
    """stem.parquet, else stem.csv, else stem.csv.gz."""
    for suffix in (".parquet", ".csv", ".csv.gz"):
        if exists(stem + suffix):
            return read_table(spark, stem + suffix, columns)
    raise FileNotFoundError(stem)


def read_excel(spark: SparkSession, path: str, cache: str, sheet: str | int = 0, columns: list[str] | None = None) -> DataFrame:
    """A worksheet, kept as Parquet after the first reading; needs an Excel engine only then."""
    if not exists(cache):
        import pandas as pd

        spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, usecols=columns)).write.parquet(cache)
    return read_table(spark, cache, columns)


def read_rr_files(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[^.]*)?$", *, empty: bool = True) -> DataFrame:
    """Interval text files, one number a line: participant_id (the file's stem, or what ``name`` finds in its path), pos, rr_ms (NULL where a line isn't a number), blank.  A file of any size is read by blocks; one without a byte is a blank line.

    A folder is read with all below it, and listed by tasks; a pattern is resolved on the driver.  Files without a byte take a second listing, by a pattern: ``empty=False`` where there can be none.
    """
    folder = not re.search(r"[*?\[{]", path)
    if folder and empty:
        raise ValueError("the listing of a folder leaves out files without a byte: give a pattern, or empty=False")
    stem = lambda path: F.regexp_extract(path, name, 1)
    lines = spark.read.option("recursiveFileLookup", folder).text(path).select(stem(F.col("_metadata.file_path")).alias("participant_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "line")) - 1
    numbered = lines.select("participant_id", place.cast("long").alias("pos"), F.trim("value").alias("value"))
    if empty:
        blank = spark.read.format("binaryFile").load(path).filter("length = 0")
        numbered = numbered.unionAll(blank.select(stem(F.col("path")).alias("participant_id"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("value")))
    return numbered.select("participant_id", "pos", F.col("value").try_cast("double").alias("rr_ms"), (F.col("value") == "").alias("blank"))


def rr_inventory(rr: DataFrame) -> DataFrame:
    """Lines, blanks, non-numeric lines and simple figures of each file; an error where a file has no number."""
    x = F.col("rr_ms")
    bad = F.count_if(x.isNull() & ~F.col("blank"))
    n = F.when(F.count(x) == 0, F.raise_error(F.lit("no numeric intervals")).cast("long")).otherwise(F.count(x))
    return rr.groupBy("participant_id").agg(F.count("*").alias("lines"), n.alias("intervals"), F.count_if("blank").alias("blank_lines"), bad.alias("non_numeric_lines"), (F.sum(x) / 3600000).alias("hours"), F.median(x).alias("median_rr"), F.min(x).alias("min_rr"), F.max(x).alias("max_rr"))


def annotation_events(annotations: DataFrame) -> DataFrame:
    """onset_seconds, duration_seconds, event_code of annotations whose description is a number, by onset."""
    rows = annotations.select(F.col("onset").cast("double").alias("onset_seconds"), F.col("duration").cast("double").alias("duration_seconds"), F.trim("description").try_cast("int").alias("event_code"))
    return rows.filter("event_code is not null").orderBy("onset_seconds", "duration_seconds", "event_code")


def reference_loadings(table: DataFrame) -> DataFrame:
    """Loadings within persons, with plain feature and component names."""
    return table.filter("mode = 'within'").select(F.regexp_replace("feature", r"(__within|_within|__centered)$", "").alias("feature"), F.regexp_replace("component", r"(__within|_within)$", "").alias("component"), F.col("loading").cast("double").alias("loading"))


# --- writers ---------------------------------------------------------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str) -> str:
    """Parquet, CSV or gzipped CSV by suffix."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith((".csv", ".csv.gz")):
        df.write.mode("overwrite").option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")
    return path


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(payload, path: str) -> str:
    """JSON without NaN: what isn't finite is null."""
    return put(json.dumps(_plain(payload), indent=2, sort_keys=True, allow_nan=False, default=str) + "\n", path)


def write_text(text: str, path: str) -> str:
    """Text with one newline at its end."""
    return put(text.rstrip("\n") + "\n", path)


def update_manifest(path: str, stage: str, parameters: dict, root: str = ".") -> dict:
    """Merge a stage's parameters, the commit and package versions into a manifest."""
    import numpy
    import pandas
    import pyspark

    data = json.loads(get(path)) if exists(path) else {}
    commit = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip() or None
    data.setdefault("stages", {})[stage] = {**parameters, "at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    data |= {"git_commit": commit, "versions": {m.__name__: m.__version__ for m in (numpy, pandas, pyspark)}}
    write_json(data, path)
    return data


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and a batch, the batch's row where both have a key; within a side the last in order of all columns."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc(c) for c in sorted(set(rows.columns) - {"__new", *keys})])
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__new", "__k")


def missing_parts(spark: SparkSession, wanted: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The wanted keys that a partitioned table doesn't hold yet, for resuming."""
    if not exists(path):
        return wanted
    return wanted.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def write_parts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write by key; only the partitions of these rows are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def source_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256, md5 of each file."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row for each file of the manifest (file, bytes, md5): whether it is there, and whole."""
    f = found.select("file", F.col("bytes").alias("__bytes"), F.col("md5").alias("__md5"))
    status = F.when(F.col("__bytes").isNull(), "missing").when(F.col("__bytes") != F.col("bytes"), "size_differs").when(F.col("__md5") != F.col("md5"), "digest_differs").otherwise("verified")
    return manifest.join(f, "file", "left").select("file", status.alias("status"))


def archive_members(archives: DataFrame) -> DataFrame:
    """path, archive_member, uncompressed_bytes, compressed_bytes of the files in zip archives (path, content), by the task that reads them."""
    schema = "path string, archive_member string, uncompressed_bytes long, compressed_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    held = [m for m in z.infolist() if not m.is_dir()]
                sizes = [pa.array([getattr(m, k) for m in held], pa.int64()) for k in ("file_size", "compress_size")]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(held), pa.string()), pa.array([m.filename for m in held], pa.string()), *sizes], names=[c.split()[0] for c in schema.split(", ")])

    return archives.select("path", "content").mapInArrow(run, schema)


def participant_file(number, most: int = 29):
    """The archive's name of a participant number; an error outside 1 to ``most``."""
    n = F.col(number).cast("int")
    return F.when(n.between(1, most), F.format_string("sub-%02d.zip", n)).otherwise(F.raise_error(F.concat(F.lit("no such participant: "), F.coalesce(n.cast("string"), F.lit("null")))).cast("string"))


def recording_issues(recordings: DataFrame, rate: float = 500.0, channel: str = "ECG1") -> DataFrame:
    """What keeps a recording (sampling_rate, channels) from being read; NULL if nothing does."""
    return recordings.withColumn("issue", F.when(F.col("sampling_rate").isNull() | (F.col("sampling_rate") != rate), "sampling_rate").when(~F.coalesce(F.array_contains("channels", channel), F.lit(False)), "missing_channel"))


def append_csv(batches: Iterator[DataFrame], path: str) -> str:
    """Batches one after the other into a gzipped CSV table."""
    for k, df in enumerate(batches):
        df.write.mode("append" if k else "overwrite").option("header", True).option("compression", "gzip").csv(path)
    return path


def reused(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that a former run has written whole; built and written if there is none."""
    if not exists(f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
