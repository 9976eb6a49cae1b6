"""Numbering, runs, frontier, limiter, joins, sinks, sources and crawls on small tables."""

import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from quern.functions import html
from quern.operators import filters, frontier, joins, limiter, rollup, skew
from quern.plans import crawl, jobs
from quern.session import cut, join_small, small_enough
from quern.sinks import exports
from quern.sources import files, web


def test_numbering_is_exact_for_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = {(r.k, r.id): r.row_no for r in skew.number_rows(df, ["k"], ["o", "id"], 6).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[k, r[2]] = n
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flags=st.lists(st.tuples(st.sampled_from("ab"), st.booleans()), max_size=40), chunk=st.integers(1, 7))
def test_runs_over_chunks_equal_plain_runs(spark, flags, chunk):
    df = spark.createDataFrame([(k, i, f) for i, (k, f) in enumerate(flags)], "k string, i int, f boolean")
    got = {r.k: (r.n, r.n_flagged, r.longest_run) for r in skew.longest_runs(df, ["k"], ["i"], F.col("f"), chunk).collect()}
    want = {}
    for key in {k for k, _ in flags}:
        mine, best, run = [f for k, f in flags if k == key], 0, 0
        for f in mine:
            run = run + 1 if f else 0
            best = max(best, run)
        want[key] = (len(mine), sum(mine), best)
    assert got == want


def test_heavy_keys_and_edges(spark):
    rows = [("A.x", "", i, "failed" if i % 2 else "ok", 1) for i in range(97)] + [
        ("b", None, 200, None, 2),
        (None, "w", None, "ok", 3),
        (None, None, 5, "ok", 4),
    ]
    df = spark.createDataFrame(rows, "domain string, subdomain string, at int, status string, key_value int")
    got = {
        (r.key_field, r.key_value, r.n) for r in skew.heavy_keys(
            df,
            ["domain", "subdomain"],
            ["at"],
            F.col("status") == "failed",
            0.05,
            10,
        ).collect()
    }
    assert got == {("domain", "A.x", 97)}
    assert skew.heavy_keys(df.limit(0), ["domain"], ["at"], F.col("status") == "failed").collect() == []
    hot = skew.join_hot(df.select("domain", "at"), df.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), ["domain"], "n", 100).count()
    assert hot == 98


def test_cut_and_sizes(spark):
    df = cut(spark.range(10))
    assert df.count() == 10 and small_enough(df, 8) and not small_enough(df, 8, 40)
    assert join_small(df, spark.range(3).withColumnRenamed("id", "id"), ["id"], limit=8).count() == 3


def test_frontier(spark):
    pages = spark.createDataFrame(
        [("a", "fetched", 1), ("a", "analyzed", 2), ("a", "analyzed", 3), ("b", "failed", 4), ("b", "weird", 5)],
        "url string, status string, seq int",
    )
    assert sorted((r.url, r.seq) for r in frontier.keep_latest_stage(pages, order=["seq"]).collect()) == [("a", 2), ("b", 5)]
    old = spark.createDataFrame([("a", "x", 0)], pages.schema)
    assert frontier.append_distinct(old, pages).count() == 3
    head, rest = frontier.dequeue(pages, ["seq"], 2)
    assert [r.seq for r in head.orderBy("seq").collect()] == [1, 2] and rest.count() == 3
    left, done = frontier.move(pages, old, pages.where("url = 'b'"), order=["seq"])
    assert left.count() == 3 and done.count() == 2
    links = spark.createDataFrame([("s", "t"), ("t", "u"), ("u", "s"), ("x", "y"), (None, "z")], "s string, t string")
    got = {(r.url, r.depth) for r in frontier.breadth_first(links, spark.createDataFrame([("s",)], "url string"), "s", "t", 5).collect()}
    assert got == {("s", 0), ("t", 1), ("u", 2)}


def test_expansion_has_no_depth_bound(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(frontier.FOLD + 4)]
    links = spark.createDataFrame([*chain, ("n9", "n2"), (chain[-1][1], "n0")], "s string, t string")
    got = {r.url: r.depth for r in frontier.breadth_first(links, spark.createDataFrame([("n0",)], "url string"), "s", "t").collect()}
    assert got == {f"n{i}": i for i in range(frontier.FOLD + 5)}


def _replay(spark, codes, seconds=None, chunk=limiter.CHUNK, gap=1):
    start = datetime(2024, 1, 1)
    rows = [("h", start + timedelta(seconds=gap * i), i, c, (seconds or [0.0] * len(codes))[i]) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, id int, code int, sec double")
    return limiter.replay(df, "host", "ts", "id", F.col("code"), F.col("sec"), chunk=chunk).first()


def test_limiter_golden(spark):
    for codes, delay, errors, violations, points, level in [
        ([429], 2.5, 1, 1, 2, "limited"),
        ([429, 403], 5.0, 2, 1, 5, "throttled"),
        ([429, 403, 500], 7.5, 3, 1, 5, "blocked"),
    ]:
        r = _replay(spark, codes)
        assert (
            r.state.delay,
            r.state.errors,
            r.state.violations,
            r.state.indicators,
            r.severity,
        ) == (delay, errors, violations, points, level)
    assert _replay(spark, [429, 403, 500], gap=400).severity == "throttled"


def test_limiter_chunks_do_not_matter(spark):
    rng = random.Random(5)
    codes = [rng.choice([200, 200, 200, 404, 429, 500, 403, None]) for _ in range(60)]
    seconds = [rng.random() * 5 for _ in codes]
    assert _replay(spark, codes, seconds).state == _replay(spark, codes, seconds, chunk=7).state
    headers = spark.createDataFrame([({"Retry-After": "1", "x-ratelimit-remaining": "0", "CF-Ray": "x"},)], "h map<string,string>")
    assert headers.select(limiter.header_indicators(F.col("h"), F.lit(429)).alias("x")).first().x == 5


def test_as_of_and_range(spark):
    l = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    r = spark.createDataFrame([("a", 3, 10.0, 1), ("a", 5, 20.0, 2), ("b", 10, 30.0, 3)], "k string, t int, v double, id int")
    assert {(x.id, x.asof_v) for x in joins.as_of(l, r, ["k"], "t", ["v"], "id").collect()} == {(1, 20.0), (2, None), (3, None)}
    spans = spark.createDataFrame([("x", 0, 7), ("y", 5, 6), ("z", 4, 4)], "s string, lo int, hi int")
    assert {(x.id, x.s) for x in joins.range_join(l, spans, "t", "lo", "hi", 3).collect()} == {(1, "x"), (1, "y"), (2, "x")}


def test_sinks_round_trip(spark, tmp_path, data):
    from quern.sources.tables import table

    pages = table(spark, data, "pages")
    report = exports.page_report(pages, extra=True)
    assert report.columns == exports.PAGE_COLUMNS + exports.EXTRA_COLUMNS
    exports.write(report, f"{tmp_path}/r.csv", "csv")
    back = files.read_report(spark, f"{tmp_path}/r.csv")
    assert back.count() == pages.count() and dict(back.dtypes)["emails_count"] == "int"
    exports.write(exports.page_documents(pages.limit(3)), f"{tmp_path}/p.parquet", "parquet")
    assert exports.contact_rows(pages).columns[:3] == ["source_url", "contact_type", "contact_value"]
    assert exports.file_name(
        "job_a_b_24010100",
        "pages",
        "csv",
    ) == "a_b-pages-24010100.csv" and exports.file_name("x", "pages", "csv") == "x_pages.csv"
    assert exports.contact_document(pages, "none").first().total == 0
    assert exports.page_report(pages, empty=True).where("error_message IS NULL").count() == 0


def test_stored_queues(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(
        '[{"url": "a", "status": "completed", "retry_count": 1}, {"url": "b", "status": "analyzed"}, {"url": "c", "status": "new"}]'
    )
    assert sorted(
        (r.url, r.status) for r in files.completed_pages(spark, str(q)).collect()
    ) == [("a", "extracted"), ("b", "analyzed"), ("c", "fetched")]
    assert files.read_queue(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "j_checkpoint.json").write_text('{"job": {"job_id": "j", "domain": "d", "status": "running"}}')
    assert [r.job_id for r in files.checkpoints(spark, str(tmp_path)).collect()] == ["j"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    leaf = f"<urlset {ns}><url><loc> https://u.edu/a </loc></url><url><loc>https://u.edu/b</loc></url></urlset>"
    index = f"<sitemapindex {ns}><sitemap><loc>https://u.edu/s1.xml</loc></sitemap></sitemapindex>"
    fetch = web.table_fetcher({"https://u.edu/sitemap_index.xml": ("", 200, {}, index), "https://u.edu/s1.xml": ("", 200, {}, leaf)})
    assert web.discover_sitemaps("u.edu", fetch) == ["https://u.edu/a", "https://u.edu/b"]
    assert web.discover_sitemaps("v.edu", fetch) == [] and web.sitemap_urls("<broken") == ([], [])
    docs = spark.createDataFrame([(leaf, 200), (leaf, 404), (None, 200)], "body string, status_code int")
    assert {r.url for r in web.parse_sitemaps(docs).collect()} == {"https://u.edu/a", "https://u.edu/b"}


SITE = {
    "https://u.edu/": (
        "https://u.edu/",
        200,
        {"Content-Type": "text/html"},
        '<title>Home</title><a href="/a">a</a><a href="/b.zip">b</a><a href="https://x.org/">x</a>',
    ),
    "https://u.edu/a": ("https://u.edu/a", 200, {"Content-Type": "text/html"}, '<a href="../c?utm_source=q#z">c</a><a href="/">home</a>'),
    "https://u.edu/c": ("https://u.edu/c", 200, {"Content-Type": "text/html"}, "end"),
}


FAST = jobs.Settings(base_delay=0.0)


def crawled(spark, site, start=None, settings=FAST, **options):
    return crawl.crawl(spark, "u.edu", lambda: web.table_fetcher(site), start, settings, **options)


def test_crawl_over_a_table(spark):
    pages, log = crawled(spark, SITE, ["https://u.edu/"])
    assert {r.url for r in log.collect()} == set(SITE)
    assert pages.where("url = 'https://u.edu/'").first().title == "Home"
    few, _ = crawled(spark, SITE, ["https://u.edu/"], jobs.Settings(max_pages=2, base_delay=0.0))
    assert few.count() == 2
    bad = web.fetch_pages(spark.createDataFrame([("https://u.edu/none",), (None,)], "url string"), lambda: web.table_fetcher({}))
    assert [r.status_code for r in bad.collect()] == [404]
    assert [r.url for r in crawled(spark, SITE, [])[1].collect()] == ["https://u.edu"]


def chain(n):
    kind = {"Content-Type": "text/html"}
    return {f"https://u.edu/{i}": (f"https://u.edu/{i}", 200, kind, f'<a href="/{i + 1}">next</a>' if i < n - 1 else "end") for i in range(n)}


def test_crawl_of_a_deep_site(spark):
    _, log = crawled(spark, chain(9), ["https://u.edu/0"])
    assert {r.url for r in log.select("url").collect()} == set(chain(9))


def test_stopped_and_resumed_crawl_equals_an_unbroken_one(spark, tmp_path):
    site, state = chain(4), f"file://{tmp_path}/state"
    whole = sorted((r.url, r.status_code) for r in crawled(spark, site, ["https://u.edu/0"])[0].collect())
    for rounds in (2, None):
        crawled(spark, site, ["https://u.edu/0"], state=state, most_rounds=rounds)
    # A round whose queue was not written never happened.
    last = crawl.State(spark, state).rounds - 1
    import shutil

    shutil.rmtree(tmp_path / "state" / f"round-{last:06d}" / "queue")
    pages, log = crawled(spark, site, ["https://u.edu/0"], state=state)
    assert sorted((r.url, r.status_code) for r in pages.collect()) == whole and log.count() == 4


def test_crawl_starts_from_sitemaps_and_obeys_robots(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    names = "".join(f"<url><loc>https://u.edu/{x}</loc></url>" for x in ("a", "private/b"))
    site = SITE | {
        "https://u.edu/sitemap.xml": ("", 200, {}, f"<urlset {ns}>{names}</urlset>"),
        "https://u.edu/robots.txt": ("", 200, {}, "User-agent: *\nDisallow: /private/\nDisallow: /c"),
        "https://u.edu/private/b": ("https://u.edu/private/b", 200, {"Content-Type": "text/html"}, "b"),
    }
    _, log = crawled(spark, site)
    assert {r.url for r in log.collect()} == {"https://u.edu/a", "https://u.edu/"}


class Flaky:
    """Answers 503 twice for one address, then its page; a file counts, as each round has its own processes."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, url):
        from pathlib import Path

        asked = Path(self.folder) / ("x" if url.endswith("/x") else "other")
        n = len(asked.read_text()) if asked.exists() else 0
        asked.write_text("." * (n + 1))
        if url.endswith("/x") and n < 2:
            return url, 503, {}, ""
        if url.endswith("/gone"):
            raise ConnectionError("refused")
        return url, 200, {"Content-Type": "text/html"}, "page"


def test_crawl_asks_again(spark, tmp_path):
    folder = str(tmp_path)
    pages, log = crawl.crawl(spark, "u.edu", lambda: Flaky(folder), ["https://u.edu/x", "https://u.edu/gone"], FAST)
    counts = {(r.url, r.status_code): r["count"] for r in log.groupBy("url", "status_code").count().collect()}
    assert counts == {("https://u.edu/x", 503): 2, ("https://u.edu/x", 200): 1, ("https://u.edu/gone", None): 4}
    assert {(r.url, r.status_code) for r in pages.collect()} == {("https://u.edu/x", 200), ("https://u.edu/gone", None)}


def test_blocked_host_cools_down(spark):
    site = {f"https://u.edu/{i}": (f"https://u.edu/{i}", 429, {}, "") for i in range(4)}
    now, waited = [1000.0], []

    def wait(seconds):
        waited.append(seconds)
        now[0] += seconds

    crawled(spark, site, list(site), jobs.Settings(base_delay=0.0, max_delay=0.0, max_retries=1), clock=lambda: now[0], wait=wait)
    assert waited == [crawl.COOL_DOWN]
    waited.clear()
    late = jobs.Settings(base_delay=0.0, max_delay=0.0, max_retries=5, timeout_hours=2)
    _, log = crawled(spark, site, list(site), late, clock=lambda: now[0], wait=wait)
    assert len(waited) <= 3 and log.count() == 4 * (len(waited) + 1) or log.count() == 4 * len(waited)


def test_browser_takes_challenges(spark):
    site = SITE | {"https://u.edu/a": ("https://u.edu/a", 403, {"server": "cloudflare"}, "no")}
    made = {"https://u.edu/a": ("https://u.edu/a", 200, {"Content-Type": "text/html"}, "<a href='/c'>c</a>", "<p>clean</p>", "# Rendered\n\n**Text** of the page")}
    pages, log = crawled(spark, site, ["https://u.edu/"], browser=lambda: web.table_fetcher(made))
    a = pages.where("url = 'https://u.edu/a'").first()
    assert a.browser_fetched and a.markdown.startswith("# Rendered") and "**" not in a.clean_text
    assert {r.url for r in log.collect()} == set(SITE) and crawl.browser_usage(log).first().n_browser == 1


def test_stages(spark):
    rows = spark.createDataFrame([("j", "fetch", None), ("k", "export", {"store": 1.0})], "job_id string, current_stage string, stage_progress map<string,double>")
    by = {r.job_id: r for r in jobs.advanced(jobs.advanced(rows, "j"), "k", 0.5).collect()}
    assert (by["j"].current_stage, by["j"].stage_progress) == ("extract", {"fetch": 1.0})
    assert (by["k"].current_stage, by["k"].stage_progress) == ("export", {"store": 1.0, "export": 0.5})
    assert jobs.zone_now(2).utcoffset().total_seconds() == 7200


def test_links_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "<a href=' /x '>x</a><A HREF='y'/><script>'<a href=z>'</script>"), (2, None), (3, "<a>")], "page_id long, html_content string")
    found = html.with_links(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.page_id, r.href) for r in found.collect()] == [(1, "/x"), (1, "y")]


def test_jobs(spark):
    assert jobs.settings_for(
        "x.harvard.edu"
    ).base_delay == 2.0 and jobs.settings_for("a.cc.il.us").max_pages == 50_000 and jobs.settings_for("u.edu").base_delay == 1.0
    job = jobs.new_job(spark, "https://www.u.edu", datetime(2024, 1, 2, 3)).first()
    assert job.job_id == "job_u_edu_24010203"
    done = jobs.finished(
        jobs.new_job(spark, "u.edu", datetime(2024, 1, 2, 3)),
        "job_u_edu_24010203",
        "completed",
        datetime(2024, 1, 3),
    ).first()
    assert (done.status, done.completed_at) == ("completed", datetime(2024, 1, 3))
    counts = spark.createDataFrame(
        [(3, 1, 4, 0, datetime(2024, 1, 1)), (0, 0, 0, 0, datetime(2024, 1, 1))],
        "completed int, failed int, pending int, processing int, start_time timestamp",
    )
    first, second = jobs.progress(counts, F.lit(datetime(2024, 1, 1, 0, 0, 8))).collect()
    assert (first.completion_pct, first.speed, first.eta_seconds) == (50.0, 0.5, 8.0) and second.eta_seconds is None
    row = spark.createDataFrame([(None, "b"), ("a", "b")], "m string, e string").select(
        jobs.add_error(F.col("m"), F.col("e")).alias("x"),
        jobs.error_action(F.lit("ReadTimeout")).alias("y"),
    ).collect()
    assert [r.x for r in row] == ["b", "a; b"] and row[0].y == "retry"


def test_rollups_on_nothing(spark):
    empty = spark.createDataFrame(
        [],
        "job_id string, status string, browser_fetched boolean, markdown_quality_score double, extraction_method string, status_code int",
    )
    r = rollup.extraction_quality(empty).first()
    assert (r.total_pages, r.average_quality_score, r.high_quality_percentage) == (0, 0.0, 0.0)
    assert rollup.breakdown(empty, "status").count() == 0
    assert filters.page_limit(
        spark.createDataFrame([("b", 1), ("a", 1), ("a", 0)], "url string, t int"),
        "url",
        1,
        ["t"],
    ).collect()[0].url == "a"


def test_limiter_stream(spark, tmp_path):
    from quern.streaming import streams

    start = datetime(2024, 1, 1)
    for part, codes in enumerate(([429, 403], [500, 200])):
        rows = [("h", start + timedelta(seconds=10 * part + i), c, 0.1) for i, c in enumerate(codes)]
        spark.createDataFrame(
            rows,
            "host string, at timestamp, code int, sec double",
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    source = streams.read_stream(spark, f"{tmp_path}/in", schema, 8)
    out = streams.drain(streams.limiter_stream(source, "host", "at", "code", "sec"), "limiter_out", "update", f"{tmp_path}/cp").collect()
    assert (out[-1].n, out[-1].delay, out[-1].errors) == (4, 7.5, 0)


def test_stream_and_replay_share_their_rules(spark, tmp_path):
    from quern.streaming import streams

    rng, start = random.Random(9), datetime(2024, 1, 1)
    rows = []
    for h in "abcdef":
        for i in range(60):
            rows.append((h, start + timedelta(seconds=7 * i), rng.choice([200] * 6 + [404, 429, 403, 500, 503, None, 418]), rng.choice([0.0, 0.1, 0.4, 2.0, 5.0]), rng.choice([0, 0, 0, 2])))
    schema = "host string, at timestamp, code int, sec double, pts int"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = streams.read_stream(spark, f"{tmp_path}/in", df.schema, 8)
    out = streams.drain(streams.limiter_stream(source, "host", "at", "code", "sec", points=F.col("pts")), "shared_rules", "update", f"{tmp_path}/cp")
    want = limiter.replay(df, "host", "at", "at", F.col("code"), F.col("sec"), F.col("pts"))
    got = {(r.host, r.n, round(r.delay, 9), r.errors, r.severity) for r in out.collect()}
    assert got == {(r.host, r.n, round(r.state.delay, 9), r.state.errors, r.severity) for r in want.collect()}


def test_cuts_are_dropped(spark):
    from pathlib import Path

    from quern import session

    with session.cuts(spark):
        outer = session.cut(spark.range(3), "kept")
        with session.cuts(spark):
            assert session.cut(spark.range(2), "inner").count() == 2
            place = Path(session._CUTS[-1].removeprefix("file://"))
            assert place.exists()
        assert not place.exists() and outer.count() == 3


def test_redirects_and_documents(spark):
    log = spark.createDataFrame([("j", "a", "b", 200, None), ("j", "c", "c", 200, None)], "job_id string, url string, final_url string, status_code int, fetched_at timestamp")
    assert [(r.url, r.final_url) for r in rollup.redirect_log(log).collect()] == [("a", "b")]
    pages = spark.createDataFrame(
        [("j", "u", "t", ["a@b.c"], {"x": ["h"]}), ("j", "v", None, [], None), ("j", "w", "t", ["d@e.f"], None)],
        "job_id string, url string, title string, emails array<string>, social_media map<string,array<string>>",
    )
    doc = exports.contact_document(pages, "j", datetime(2024, 1, 1)).first()
    assert (doc.total, [c.url for c in doc.contacts], doc.exported_at) == (2, ["u", "w"], datetime(2024, 1, 1))
    with pytest.raises(ValueError, match="too many"):
        exports.contact_document(pages, "j", most=1)


def test_saved_runs(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "url string")
    files.save_checkpoint(str(tmp_path), "j1", {"pending": df, "failed": df.limit(0)})
    held = files.load_checkpoint(spark, str(tmp_path), "j1")
    assert {k: v.count() for k, v in held.items()} == {"pending": 1, "failed": 0}
    assert files.saved_jobs(spark, str(tmp_path)) == ["j1"] and files.load_checkpoint(spark, str(tmp_path), "none") == {}
    assert files.delete_checkpoint(spark, str(tmp_path), "j1") and files.saved_jobs(spark, str(tmp_path)) == []
    assert files.files_by_kind(["a_b-pages-1.csv", "x_contacts.json", "odd.txt"]) == {
        "pages": ["a_b-pages-1.csv"],
        "contacts": ["x_contacts.json"],
    }


def test_stages(spark):
    from quern.plans.stages import Stage, keep, run

    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "n int, error_message string")
    twice = Stage("twice", lambda d: d.withColumn("n", F.col("n") * 2), gate=lambda: F.col("n") > 1, failed=lambda: F.col("n") > 3)
    out = run(df, [twice, keep(lambda: F.col("n").isNotNull())], cut_every=2)
    assert {(r.n, r.error_message) for r in out.collect()} == {(1, None), (4, "x; twice failed")}


def test_fetch_statistics(spark):
    start = datetime(2024, 1, 1)
    rows = [("h", f"u{i}", start + timedelta(seconds=i), 200 if i else None, float(i)) for i in range(12)]
    log = spark.createDataFrame(rows, "host string, url string, fetched_at timestamp, status_code int, seconds double")
    limits = limiter.replay(log, "host", "fetched_at", "url", F.col("status_code"), F.col("seconds"))
    r = rollup.fetch_statistics(log, limits).first()
    assert (r.n_fetches, r.n_failed, r.recent_mean) == (12, 1, 6.5) and r.severity is not None
    assert exports.documents(log.select("host").limit(1), job="j").first().value == '{"job":"j","host":"h"}'
