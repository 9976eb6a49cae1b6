"""Jobs and crawl runs as tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import vocab
from quern.schema import JOB


@dataclass(frozen=True)
class Settings:
    """Settings of a crawl."""

    base_delay: float = 1.0
    max_delay: float = 30.0
    max_pages: int = 200_000
    timeout_hours: int = 24
    max_retries: int = 3
    request_timeout: int = 30
    max_subdomains: int = 50
    browser_pool_size: int = 1
    browser_timeout: int = 45
    timezone_hours: int = 2
    allowed_subdomains: tuple[str, ...] = field(default_factory=lambda: tuple(vocab.ALLOWED_SUBDOMAINS))


# ---- Fixed values: presets by domain, first match wins. ----
PRESETS: list[tuple[tuple[str, ...], dict]] = [
    (("harvard.edu", "stanford.edu"), {"base_delay": 2.0, "max_pages": 300_000, "max_subdomains": 100}),
    ((".cc.", "community"), {"base_delay": 0.5, "max_pages": 50_000, "max_subdomains": 20}),
    (("ue.edu.pe",), {"base_delay": 3.0, "max_pages": 10_000, "browser_pool_size": 2, "browser_timeout": 60}),
]
# ---- End of fixed values. ----


def settings_for(domain: str) -> Settings:
    return next((replace(Settings(), **values) for parts, values in PRESETS if any(p in domain for p in parts)), Settings())


def preset_delay(domain: Column) -> Column:
    """The base delay of a domain as a column."""
    chain = F.when(F.lit(False), F.lit(0.0))
    for parts, values in PRESETS:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(domain, F.lit(p))
        chain = chain.when(test, values["base_delay"])
    return chain.otherwise(Settings().base_delay)


def new_job(spark: SparkSession, domain: str, now: datetime | None = None) -> DataFrame:
    at = now or datetime.now(timezone(timedelta(hours=Settings().timezone_hours)))
    bare = domain.replace("https://", "").replace("http://", "").replace("www.", "").translate(str.maketrans(".:/", "___"))
    row = (f"job_{bare}_{at.strftime('%y%m%d%H')}", domain, "running", at, at, None, None, 0, 0, 0, 0)
    return spark.createDataFrame([row], JOB)


def finished(jobs: DataFrame, job_id: str, status: str, at: datetime) -> DataFrame:
    mine = F.col("job_id") == job_id
    return jobs.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn(
        "completed_at",
        F.when(mine & F.lit(status in ("completed", "failed")), F.lit(at)).otherwise(F.col("completed_at")),
    )


def job_status(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, domain, status, n_pages, n_failed, pct_done): stored jobs beside what their pages say, in order of job."""
    per = pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status").isin("extracted", "analyzed", "failed")).alias("n_done"),
    )
    joined = jobs.select("job_id", "domain", "status").join(per, "job_id", "left").fillna(0, ["n_pages", "n_failed", "n_done"])
    return joined.select(
        "job_id",
        "domain",
        "status",
        "n_pages",
        "n_failed",
        F.when(F.col("n_pages") > 0, F.col("n_done") * 100.0 / F.col("n_pages")).otherwise(0.0).alias("pct_done"),
    )


def progress(counts: DataFrame, now: Column) -> DataFrame:
    """Progress columns from completed, failed, pending, processing and start_time; no ETA where nothing moves or remains."""
    done, left = F.col("completed") + F.col("failed"), F.col("pending") + F.col("processing")
    seconds = (F.unix_micros(now) - F.unix_micros("start_time")) / 1e6
    speed = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return counts.withColumns(
        {
            "processed": done,
            "remaining": left,
            "completion_pct": F.when(done + left > 0, done * 100.0 / (done + left)).otherwise(0.0),
            "speed": speed,
            "eta_seconds": F.when((speed > 0) & (left > 0), left / speed),
        }
    )


def add_error(message: Column, error: Column) -> Column:
    """Messages joined by ``; ``."""
    return F.nullif(F.concat_ws("; ", message, error), F.lit(""))


def error_action(kind: Column, stage: Column | None = None) -> Column:
    """``retry``, ``skip`` or ``fail`` by the kind of error; extraction and analysis leave out what they cannot read."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    soft = stage.isin("extract", "analyze") & ~F.contains(low, F.lit("memory")) if stage is not None else F.lit(False)
    return F.when(F.coalesce(soft, F.lit(False)), "skip").when(
        F.contains(low, F.lit("connection")) | F.contains(low, F.lit("timeout")),
        "retry",
    ).when(F.contains(low, F.lit("value")), "skip").otherwise("fail")


def may_retry(retries: Column, most: Column) -> Column:
    return retries < most


# ---- Fixed values: stages of a job, in order. ----
STAGES = ["discovery", "fetch", "extract", "analyze", "store", "export"]
# ---- End of fixed values. ----


def zone_now(hours: int = Settings().timezone_hours) -> datetime:
    """The clock in the configured zone."""
    return datetime.now(timezone(timedelta(hours=hours)))


def advanced(state: DataFrame, job_id: str, progress: float = 1.0) -> DataFrame:
    """``state`` (job_id, current_stage, stage_progress map) with the job's stage done and the next one current; the last stays."""
    mine, names = F.col("job_id") == job_id, F.array(*[F.lit(x) for x in STAGES])
    at = F.array_position(names, F.col("current_stage"))
    done = F.map_zip_with(
        F.coalesce("stage_progress", F.create_map().cast("map<string,double>")), F.create_map(F.col("current_stage"), F.lit(progress)), lambda k, a, b: F.coalesce(b, a)
    )
    return state.withColumn("stage_progress", F.when(mine, done).otherwise(F.col("stage_progress"))).withColumn(
        "current_stage",
        F.when(mine & (at > 0), F.element_at(names, F.least(at + 1, F.lit(len(STAGES))).cast("int"))).otherwise(F.col("current_stage")),
    )
