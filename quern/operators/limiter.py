"""Replay of an adaptive per-host rate limiter over a fetch log: a state machine folded over each host's events in time order.

The fold is one pure expression (``aggregate``), so it stays in the JVM and spreads over hosts. Time is taken from the rows.
A host's events are cut into chunks of ``CHUNK`` that are folded one after another in rounds, so no task holds more than a
chunk of any host, however busy the host is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import vocab
from quern.operators.skew import chunk_of, number_rows
from quern.session import cut

# ---- Fixed values of the state machine. ----
BASE_DELAY, MAX_DELAY = 1.0, 30.0
FAST, SLOW = 0.5, 3.0
HISTORY, RECENT, LEAST_SAMPLES = 50, 10, 5
#: By status code (500: it and above; 0: none or another): factor of the delay, and points.
ANSWERS = {429: (2.5, 2), 403: (2.0, 3), 500: (1.5, 1), 404: (1.1, 0), 0: (1.2, 1)}
#: Server errors beyond which one gives its points; successes beyond which the delay eases; factors of easing and pushing.
SERVER_ERRORS, STEADY, EASE, FAST_EASE, SLOW_PUSH = 3, 10, 0.9, 0.95, 1.1
#: Blocked beyond so many errors, violations or points, or with a 429 within so many seconds and more errors than the last.
BLOCK_ERRORS, BLOCK_VIOLATIONS, BLOCK_POINTS, BLOCK_SECONDS, BLOCK_RECENT = 5, 2, 8, 600, 2
#: Throttled beyond so many points or errors; limited beyond so many base delays.
THROTTLE_POINTS, THROTTLE_ERRORS, LIMITED = 4, 3, 2
# ---- End of fixed values. ----
CHUNK = 20_000
STATE = "delay double, errors int, successes int, violations int, server_errors int, indicators int, times array<double>, limited_at timestamp"


def initial(base: float = BASE_DELAY) -> Column:
    return F.struct(
        F.lit(base).alias("delay"),
        *[F.lit(0).alias(c) for c in ("errors", "successes", "violations", "server_errors", "indicators")],
        F.array().cast("array<double>").alias("times"),
        F.lit(None).cast("timestamp").alias("limited_at"),
    )


def header_indicators(headers: Column, code: Column) -> Column:
    """Points for exhausted rate headers (2 each), retry-after (2), and protection headers beside 403, 429 or 503 (1 each).

    ``headers`` is a map; null counts as empty. Names match in any case, values only under the exact name."""
    h = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    names = F.transform(F.map_keys(h), F.lower)
    zero = sum((F.when(F.try_element_at(h, F.lit(n)).try_cast("int") == 0, 2).otherwise(0) for n in vocab.RATE_HEADERS), F.lit(0))
    retry = F.when(F.array_contains(names, "retry-after"), 2).otherwise(0)
    shield = sum(
        (F.when(F.array_contains(names, n) & code.isin(403, 429, 503), 1).otherwise(0) for n in vocab.PROTECTION_HEADERS),
        F.lit(0),
    )
    return zero + retry + shield


def blocked(s: Column, now: Column) -> Column:
    since = F.unix_micros(now) - F.unix_micros(s["limited_at"])
    recent = s["limited_at"].isNotNull() & (since < BLOCK_SECONDS * 1_000_000) & (s["errors"] > BLOCK_RECENT)
    return (s["errors"] > BLOCK_ERRORS) | (s["violations"] > BLOCK_VIOLATIONS) | (s["indicators"] > BLOCK_POINTS) | recent


def severity(s: Column, now: Column, base: float = BASE_DELAY) -> Column:
    return F.when(blocked(s, now), "blocked").when(
        (s["indicators"] > THROTTLE_POINTS) | (s["errors"] > THROTTLE_ERRORS),
        "throttled",
    ).when(s["delay"] > base * LIMITED, "limited").otherwise("normal")


def on_success(s: Column, seconds: Column, base: float = BASE_DELAY, most: float = MAX_DELAY) -> Column:
    times = F.when(
        seconds > 0,
        F.slice(F.concat(s["times"], F.array(seconds)), F.greatest(F.lit(1), F.size(s["times"]) + 2 - HISTORY), F.lit(HISTORY)),
    ).otherwise(s["times"])
    last = F.slice(times, F.greatest(F.lit(1), F.size(times) - RECENT + 1), F.lit(RECENT))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(last), F.lit(1))
    enough = F.size(times) >= LEAST_SAMPLES
    delay = F.when(
        enough & (mean < FAST) & (seconds < FAST),
        F.when(s["delay"] > base, F.greatest(F.lit(base), s["delay"] * FAST_EASE)).otherwise(s["delay"]),
    ).when(enough & (mean > SLOW), F.least(F.lit(most), s["delay"] * SLOW_PUSH)).otherwise(s["delay"])
    steady = (s["successes"] + 1 > STEADY) & (delay > base)
    return F.struct(
        F.when(steady, F.greatest(F.lit(base), delay * EASE)).otherwise(delay).alias("delay"),
        F.lit(0).alias("errors"),
        F.when(steady, 0).otherwise(s["successes"] + 1).alias("successes"),
        s["violations"].alias("violations"),
        F.lit(0).alias("server_errors"),
        s["indicators"].alias("indicators"),
        times.alias("times"),
        s["limited_at"].alias("limited_at"),
    )


def on_error(s: Column, code: Column, points: Column, now: Column, most: float = MAX_DELAY) -> Column:
    c = F.coalesce(code, F.lit(0))
    server = s["server_errors"] + F.when(c >= 500, 1).otherwise(0)
    by_code = lambda i: F.when(c == 429, ANSWERS[429][i]).when(c == 403, ANSWERS[403][i]).when(c >= 500, ANSWERS[500][i]).when(c == 404, ANSWERS[404][i]).otherwise(ANSWERS[0][i])
    factor, more = by_code(0), F.when((c >= 500) & (server <= SERVER_ERRORS), 0).otherwise(by_code(1))
    return F.struct(
        F.least(F.lit(most), s["delay"] * factor).alias("delay"),
        (s["errors"] + 1).alias("errors"),
        F.lit(0).alias("successes"),
        (s["violations"] + F.when(c == 429, 1).otherwise(0)).alias("violations"),
        server.alias("server_errors"),
        (s["indicators"] + points + more).alias("indicators"),
        s["times"].alias("times"),
        F.when(c == 429, now).otherwise(s["limited_at"]).alias("limited_at"),
    )


def degrade(s: Column, level: Column, most: float = MAX_DELAY) -> Column:
    """The state after the measures for a severity: longer delays, and for a block fewer points and errors."""
    factor = F.when(level == "blocked", 3.0).when(level == "throttled", 1.8).when(level == "limited", 1.3).otherwise(1.0)
    cut_by = lambda field, by: F.when(level == "blocked", F.greatest(F.lit(0), s[field] - by)).otherwise(s[field]).alias(field)
    return F.struct(
        F.least(F.lit(most), s["delay"] * factor).alias("delay"),
        cut_by("errors", 3),
        *[s[f].alias(f) for f in ("successes", "violations", "server_errors")],
        cut_by("indicators", 5),
        s["times"].alias("times"),
        s["limited_at"].alias("limited_at"),
    )


def timeout_factor(level: Column) -> Column:
    return F.when(level == "blocked", 3.0).when(level == "throttled", 2.0).when(level == "limited", 1.5).otherwise(1.0)


def adaptive_timeout(level: Column, base: int = 30) -> Column:
    return F.floor(timeout_factor(level) * base).cast("int")


def skip_request(s: Column, now: Column) -> Column:
    recent = s["limited_at"].isNotNull() & (F.unix_micros(now) - F.unix_micros(s["limited_at"]) < 300_000_000) & (s["violations"] > 3)
    return blocked(s, now) | recent


def pacing(delay: Column, elapsed: Column) -> Column:
    """Seconds to wait before the next request."""
    return F.greatest(F.lit(0.0), delay - elapsed)


def replay(
    events: DataFrame,
    host: str,
    at: str,
    key: str,
    code: Column,
    seconds: Column,
    points: Column | None = None,
    base: float = BASE_DELAY,
    most: float = MAX_DELAY,
    chunk: int = CHUNK,
    before: DataFrame | None = None,
) -> DataFrame:
    """(host, n, state, severity): the state after all events of each host, in order of ``at`` and ``key``. A code below 400 is a
    success. ``before`` has the (host, state) that hosts start from."""
    rows = events.select(
        F.col(host).alias("host"),
        F.col(at).cast("timestamp").alias("at"),
        F.col(key).alias("key"),
        code.cast("int").alias("code"),
        F.coalesce(seconds.cast("double"), F.lit(0.0)).alias("seconds"),
        (points if points is not None else F.lit(0)).cast("int").alias("points"),
    )
    numbered = number_rows(rows.where("host IS NOT NULL AND at IS NOT NULL"), ["host"], ["at", "key"])
    parts = cut(
        numbered.withColumn("chunk", chunk_of(F.col("row_no"), chunk)).groupBy("host", "chunk").agg(
            F.array_sort(F.collect_list(F.struct("row_no", "at", "code", "seconds", "points"))).alias("events"),
            F.max("at").alias("until"),
            F.count(F.lit(1)).alias("n"),
        ),
        "limiter",
    )
    last = parts.agg(F.max("chunk").alias("m")).first()["m"]
    step = lambda s, e: F.when(
        F.coalesce(e["code"], F.lit(0)).between(1, 399),
        on_success(s, e["seconds"], base, most),
    ).otherwise(on_error(s, e["code"], e["points"], e["at"], most))
    fold = lambda start: F.aggregate("events", start, step)
    first = parts.where("chunk = 0")
    first = first.join(before.select("host", F.col("state").alias("_before")), "host", "left") if before is not None else first.withColumn("_before", initial(base))
    state = first.withColumn("_start", F.coalesce("_before", initial(base))).select("host", "n", "until", fold(F.col("_start")).alias("state"))
    for i in range(1, (last or 0) + 1):
        state = cut(state, "limiter")
        more = parts.where(F.col("chunk") == i).select("host", "events", F.col("n").alias("_n"), F.col("until").alias("_until"))
        went = state.join(more, "host").select(
            "host",
            (F.col("n") + F.col("_n")).alias("n"),
            F.col("_until").alias("until"),
            fold(F.col("state")).alias("state"),
        )
        state = went.unionByName(state.join(more.select("host"), "host", "left_anti"))
    return state.select("host", "n", "state", severity(F.col("state"), F.col("until"), base).alias("severity"))
