"""Structured Streaming over crawl and event logs: windows, sessions, deduplication and the stateful limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators import limiter


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"),
        *by,
        "n",
    )


def session_counts(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by session: a session ends after ``gap`` without events."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("session_start"),
        F.col("w.end").alias("session_end"),
        *by,
        "n",
    )


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def limiter_stream(
    events: DataFrame,
    host: str,
    at: str,
    code: str,
    seconds: str,
    base: float = limiter.BASE_DELAY,
    most: float = limiter.MAX_DELAY,
    points: Column | None = None,
) -> DataFrame:
    """(host, n, delay, errors, severity) after each micro-batch: the limiter's state lives in the stream's state store. The rules
    are those of ``limiter.replay``, with its values; ``points`` are those of the headers."""
    schema = "host string, n long, delay double, errors int, severity string"
    state_schema = "n long, delay double, errors int, successes int, violations int, server_errors int, indicators int, times string, limited_at double"
    v = limiter

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, delay, errors, wins, violations, server, held_points, held, limited = state.get if state.exists else (0, base, 0, 0, 0, 0, 0, "", -1e18)
        times = [float(x) for x in held.split(",") if x]
        now = limited
        for pdf in sorted_batches(batches, "at"):
            for t, c, s, more in zip(pdf["at"], pdf["code"], pdf["seconds"], pdf["points"]):
                now, n = t.timestamp(), n + 1
                c = 0 if pd.isna(c) else int(c)
                if 0 < c < 400:
                    errors, wins, server = 0, wins + 1, 0
                    times = [*times, float(s)][-v.HISTORY :] if s > 0 else times
                    recent = times[-v.RECENT :]
                    mean = sum(recent) / len(recent) if recent else 0.0
                    if len(times) >= v.LEAST_SAMPLES and mean < v.FAST and s < v.FAST:
                        delay = max(base, delay * v.FAST_EASE) if delay > base else delay
                    elif len(times) >= v.LEAST_SAMPLES and mean > v.SLOW:
                        delay = min(most, delay * v.SLOW_PUSH)
                    if wins > v.STEADY and delay > base:
                        delay, wins = max(base, delay * v.EASE), 0
                    continue
                errors, wins = errors + 1, 0
                server += c >= 500
                kind = 500 if c >= 500 else c if c in v.ANSWERS else 0
                delay = min(most, delay * v.ANSWERS[kind][0])
                held_points += int(more) + (0 if kind == 500 and server <= v.SERVER_ERRORS else v.ANSWERS[kind][1])
                if c == 429:
                    violations, limited = violations + 1, now
        state.update((n, delay, errors, wins, violations, server, held_points, ",".join(map(repr, times)), limited))
        late = now - limited < v.BLOCK_SECONDS and errors > v.BLOCK_RECENT
        blocked = errors > v.BLOCK_ERRORS or violations > v.BLOCK_VIOLATIONS or held_points > v.BLOCK_POINTS or late
        throttled = held_points > v.THROTTLE_POINTS or errors > v.THROTTLE_ERRORS
        level = "blocked" if blocked else "throttled" if throttled else "limited" if delay > v.LIMITED * base else "normal"
        yield pd.DataFrame({"host": [key[0]], "n": [n], "delay": [delay], "errors": [errors], "severity": [level]})

    picked = events.select(
        F.col(host).alias("host"),
        F.col(at).cast("timestamp").alias("at"),
        F.col(code).cast("int").alias("code"),
        F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)).alias("seconds"),
        F.coalesce(points if points is not None else F.lit(0), F.lit(0)).cast("int").alias("points"),
    ).where("host IS NOT NULL AND at IS NOT NULL")
    return picked.groupBy("host").applyInPandasWithState(step, schema, state_schema, "update", GroupStateTimeout.NoTimeout)


def sorted_batches(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """The micro-batch's rows of one host, in order; a micro-batch is bounded by the trigger's file limit."""
    held = [b for b in batches]
    if held:
        yield pd.concat(held).sort_values(by, kind="stable")


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is available and return its result table (small results only: the sink is in memory)."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    writer.start().awaitTermination()
    return spark.table(name)


def drain_to(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available into parquet files, and read them."""
    stream.writeStream.format("parquet").option(
        "checkpointLocation",
        checkpoint,
    ).outputMode("append").trigger(availableNow=True).start(folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
