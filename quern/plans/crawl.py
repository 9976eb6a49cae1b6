"""A whole crawl in rounds: discovery, robots, paced fetching, cool-downs, retries, browser fall-back, and a saved state to resume from.

A round takes the addresses that are ready, fetches them (one host in one partition, at its limiter's delay), folds the fetches
into the limiter's states, queues what failed in passing again, and adds the new links that pass the filters. Its fetches, states
and remaining queue are written under the state folder before the next round begins, the queue last: a round without it never
happened. So a stopped or lost crawl resumes after its last whole round, with the same pages as an unbroken one."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import html, links, text, urls
from quern.operators import filters, limiter
from quern.plans.jobs import Settings, settings_for
from quern.session import shared_folder
from quern.sources.web import Fetcher, discover_sitemaps, fetch_pages, robots_rules, seeds

COOL_DOWN = 3600.0
AGENT = "quern"
#: Answers that are asked for again.
PASSING = (429, 500, 502, 503, 504)
QUEUE = "url string, attempt int, not_before double"


class State:
    """The saved rounds of a crawl under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rounds = 0
        while self.has(f"round-{self.rounds:06d}/queue/_SUCCESS"):
            self.rounds += 1

    def has(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def path(self, no: int, name: str) -> str:
        return f"{self.folder}/round-{no:06d}/{name}"

    def write(self, df: DataFrame, no: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(no, name))
        return self.read(no, name)

    def read(self, no: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(no, name))

    def every(self, name: str) -> DataFrame | None:
        """The table of all saved rounds."""
        paths = [self.path(i, name) for i in range(self.rounds) if self.has(f"round-{i:06d}/{name}/_SUCCESS")]
        return self.spark.read.parquet(*paths) if paths else None


def _host(url: str = "url"):
    return urls.host_lower(F.col(url))


def start_addresses(domain: str, fetch: Fetcher) -> list[str]:
    """What the sitemaps name, else the home page."""
    return discover_sitemaps(domain, fetch) or [f"https://{domain}"]


def crawl(
    spark: SparkSession,
    domain: str,
    make: Callable[[], Fetcher],
    start: list[str] | None = None,
    settings: Settings | None = None,
    state: str | None = None,
    most_rounds: int | None = None,
    browser: Callable[[], Fetcher] | None = None,
    clock: Callable[[], float] = time.time,
    wait: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """(pages, fetches) of a crawl, from its saved rounds on. It ends when the queue is empty, at the page limit or at the deadline;
    ``most_rounds`` pauses it after so many rounds of this call, its queue kept. Pages are those that were not asked for again."""
    own = settings or settings_for(domain)
    saved = State(spark, state or f"{shared_folder(spark)}/crawl-{domain}-{time.time_ns()}")
    site, fetch = urls.bare_domain(F.lit(domain)), make()
    rules: dict[str, list[tuple[str, bool]]] = {}
    began = clock()

    def admitted(found: DataFrame, seen: DataFrame | None, room: int) -> DataFrame:
        """New addresses of the site that the filters and robots rules admit, at most ``room``."""
        nonlocal rules
        kept = filters.link_filter(found.select(urls.clean(F.col("url")).alias("url")).distinct().withColumn("domain", site), "url", "domain", seen)
        hosts = [r["h"] for r in kept.select(_host().alias("h")).distinct().orderBy("h").limit(own.max_subdomains + 1).collect()]  # bounded by the setting
        rules = robots_rules(hosts[: own.max_subdomains], fetch, AGENT, rules)
        kept = kept.where(_host().isin(*rules.keys()) & filters.robots_allows(F.col("url"), rules)) if rules else kept
        return kept.select("url").orderBy("url").limit(room)

    if saved.rounds:
        queue = saved.read(saved.rounds - 1, "queue")
    else:
        first = seeds(spark, domain, list(dict.fromkeys(start if start is not None else start_addresses(domain, fetch))))
        queue = admitted(first, None, own.max_pages).select("url", F.lit(0).alias("attempt"), F.lit(0.0).alias("not_before"))
        saved.write(queue.withColumn("added", F.lit(True)), 0, "found")
    done = 0
    while most_rounds is None or done < most_rounds:
        no, now = saved.rounds, clock()
        if now - began > own.timeout_hours * 3600:
            break
        if no == 0:
            queue = saved.read(0, "found").drop("added")
        soonest = queue.agg(F.min("not_before").alias("m")).first()["m"]
        if soonest is None:
            break
        if soonest > now:
            wait(soonest - now)
            now = max(clock(), soonest)
        states = saved.read(no - 1, "limits") if no else None
        ready = queue.where(F.col("not_before") <= now)
        paced = ready.select("url", "attempt", _host().alias("host"))
        paced = paced.join(states.select("host", F.col("state.delay").alias("delay")), "host", "left") if states is not None else paced.withColumn("delay", F.lit(own.base_delay))
        paced = paced.withColumn("delay", F.coalesce("delay", F.lit(own.base_delay)))
        got = fetch_pages(paced, make).join(ready.select("url", "attempt"), "url")
        fetched = saved.write(got, no, "plain")
        challenge = links.is_challenge(F.col("final_url"), F.col("body"), F.col("status_code"), F.try_element_at("headers", F.lit("server")))
        if browser is not None:
            hard = fetched.where(challenge)
            more = saved.write(fetch_pages(hard.select("url"), browser, browser=True).join(hard.select("url", "attempt"), "url"), no, "browser")
            fetched = fetched.join(more.select("url"), "url", "left_anti").unionByName(more)
        failed = F.col("error").isNotNull() | F.col("status_code").isin(*PASSING)
        again = failed & (F.col("attempt") < own.max_retries)
        fetched = saved.write(fetched.withColumn("again", F.coalesce(again, F.lit(False))), no, "fetched")
        # The limiter's states after this round; a blocked host cools down.
        log = fetched.withColumn("host", _host())
        points = limiter.header_indicators(F.col("headers"), F.col("status_code"))
        after = limiter.replay(log, "host", "fetched_at", "url", F.col("status_code"), F.col("seconds"), points, own.base_delay, own.max_delay, before=states)
        level = F.col("severity")
        after = after.select(
            "host",
            F.when(level.isin("blocked", "throttled", "limited"), limiter.degrade(F.col("state"), level, own.max_delay)).otherwise(F.col("state")).alias("state"),
            F.when(level == "blocked", now + COOL_DOWN).otherwise(0.0).alias("until"),
        )
        if states is not None:
            after = after.unionByName(states.join(after.select("host"), "host", "left_anti"))
        limits = saved.write(after, no, "limits")
        # What is left: the rest of the queue, what is asked for again, and new links.
        seen = spark.read.parquet(*[saved.path(i, "found") for i in range(no + 1)]).select("url")
        ok = fetched.where((F.col("status_code") == 200) & F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("html")))
        hrefs = html.with_links(ok.select(F.col("final_url").alias("base"), "body"), "body")
        targets = hrefs.select(urls.resolve_udf(F.col("base"), F.col("href")).alias("url")).where("url IS NOT NULL")
        room = own.max_pages - seen.count()
        found = saved.write(
            admitted(targets, seen, max(room, 0)).select("url", F.lit(0).alias("attempt"), F.lit(0.0).alias("not_before"), F.lit(True).alias("added")), no + 1, "found"
        )
        left = queue.where(F.col("not_before") > now).unionByName(
            fetched.where("again").select("url", (F.col("attempt") + 1).alias("attempt"), F.lit(0.0).alias("not_before"))
        ).unionByName(found.drop("added"))
        cooled = left.withColumn("host", _host()).join(limits.select("host", "until"), "host", "left")
        queue = saved.write(cooled.select("url", "attempt", F.greatest("not_before", F.coalesce("until", F.lit(0.0))).alias("not_before")), no, "queue")
        saved.rounds += 1
        done += 1
    fetches = saved.every("fetched")
    if fetches is None:
        from quern.schema import FETCH

        fetches = spark.createDataFrame([], FETCH).withColumn("attempt", F.lit(0)).withColumn("again", F.lit(False))
    last = fetches.where(~F.col("again"))
    read = html.with_extraction(last, "body", "")
    rendered = F.col("browser_fetched") & (F.coalesce("rendered_markdown", F.lit("")) != "")
    plain = read.withColumn("clean_text", F.when(rendered, text.markdown_to_text(F.col("rendered_markdown"))).otherwise(F.col("clean_text")))
    return plain.withColumn("markdown", html.rendered_text(F.col("markdown"), F.col("rendered_markdown"), F.col("browser_fetched"))), fetches


def browser_usage(fetches: DataFrame) -> DataFrame:
    """(n_fetches, n_browser, pct_browser) of a fetch log."""
    n, b = F.count(F.lit(1)), F.count_if("browser_fetched")
    return fetches.agg(n.alias("n_fetches"), b.alias("n_browser"), F.when(n > 0, b * 100.0 / n).otherwise(0.0).alias("pct_browser"))
