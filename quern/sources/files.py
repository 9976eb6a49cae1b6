"""Readers of stored queues, checkpoints and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.schema import JOB, PAGE

#: Parts of a saved run, each a table of its own.
CHECKPOINT_PARTS = ("job", "state", "pending", "processing", "completed", "failed")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm)
    return found is not None and len(found) > 0


def read_queue(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    """A queue stored as one JSON array a file. A missing file is an empty queue; rows that do not parse are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord",
        "_corrupt",
    ).json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def completed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Finished pages for export: ``completed`` counts as extracted, ``analyzed`` stays, anything else is fetched."""
    status = F.when(F.col("status") == "analyzed", "analyzed").when(F.col("status") == "completed", "extracted").otherwise("fetched")
    return read_queue(spark, path).withColumn("status", status)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A pages CSV with its counts as numbers."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    counts = [
        c for c in (
            "status_code",
            "content_length",
            "retry_count",
            "internal_links_count",
            "external_links_count",
            "emails_count",
            "social_profiles_count",
            "funding_references",
            "collaboration_indicators",
            "technology_transfer",
            "industry_connections",
        ) if c in rows.columns
    ]
    return rows.withColumns({c: F.col(c).try_cast("int") for c in counts})


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, path, job): one row for each ``*_checkpoint.json``, in order of job; unreadable files are left out."""
    if not exists(spark, f"{folder}/*_checkpoint.json"):
        return spark.createDataFrame(
            [],
            T.StructType([T.StructField("job_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("job", JOB)]),
        )
    schema = T.StructType([T.StructField("job", JOB), T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option(
        "columnNameOfCorruptRecord",
        "_corrupt",
    ).json(f"{folder}/*_checkpoint.json").withColumn("path", F.col("_metadata.file_path"))
    return rows.where(F.col("job.job_id").isNotNull()).select(F.col("job.job_id").alias("job_id"), "path", "job").orderBy("job_id")


def save_checkpoint(folder: str, job_id: str, parts: dict[str, DataFrame]) -> None:
    """Write the parts of a run under ``folder/job_id``; a part not given keeps its last version."""
    for name, df in parts.items():
        if name not in CHECKPOINT_PARTS:
            raise ValueError(name)
        df.write.mode("overwrite").parquet(f"{folder}/{job_id}/{name}")


def load_checkpoint(spark: SparkSession, folder: str, job_id: str) -> dict[str, DataFrame]:
    """The parts that were saved; an unknown job has none."""
    return {
        name: spark.read.parquet(f"{folder}/{job_id}/{name}") for name in CHECKPOINT_PARTS if exists(spark, f"{folder}/{job_id}/{name}")
    }


def delete_checkpoint(spark: SparkSession, folder: str, job_id: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{job_id}")
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def saved_jobs(spark: SparkSession, folder: str) -> list[str]:
    """Ids of the jobs saved under ``folder``, sorted."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().getName() for f in (found or []))


def files_by_kind(names: list[str]) -> dict[str, list[str]]:
    """Output files by kind (pages, contacts, summary, ...), of either naming; unknown names are left out."""
    out: dict[str, list[str]] = {}
    for name in sorted(names):
        m = re.match(r"^.*?[-_](pages|contacts|summary|metrics|analytics)(?:-[^-]*)?\.\w+$", name)
        if m:
            out.setdefault(m.group(1), []).append(name)
    return out
