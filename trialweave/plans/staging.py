"""Written intermediate tables in the folder that every executor shares.

A plan that is read more than once is cut here: the rows are written once as Parquet under
``spark.checkpoint.dir`` and read back.  A lost executor then costs only its running tasks, and no
second evaluation of the plan above the cut.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset one of our own, in local mode only: executors elsewhere wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir isn't set: on {master} intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="trialweave-")
    return _LOCAL[app]


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables written after the first ``since``, without the last ``but`` of them; their DataFrames can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = max(since, len(_WRITTEN) - but)
    for path in _WRITTEN[since:end]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _WRITTEN[since:end]


def written() -> int:
    """How many staged tables are there; a mark for :func:`release`."""
    return len(_WRITTEN)
