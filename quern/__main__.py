"""python -m quern COMMAND: list, status, report, export, query over a folder of tables; crawl and resume into a state folder."""

from __future__ import annotations

import argparse
import importlib
import logging
from dataclasses import replace

from pyspark.sql import functions as F

from quern.operators import report, rollup
from quern.plans import analysis, crawl, jobs
from quern.session import build_session
from quern.sinks import exports
from quern.sources import web
from quern.sources.tables import table


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    parser.add_argument("--data", help="folder of parquet tables")
    parser.add_argument("-v", "--verbose", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("status").add_argument("job", nargs="?")
    sub.add_parser("report")
    export = sub.add_parser("export")
    export.add_argument("job")
    export.add_argument("--out", required=True)
    export.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "orc"])
    sub.add_parser("query").add_argument("name")
    for name in ("crawl", "resume"):
        c = sub.add_parser(name)
        c.add_argument("domain")
        c.add_argument("--state", required=True, help="folder of the crawl's saved rounds")
        c.add_argument("--delay", type=float)
        c.add_argument("--max-pages", type=int)
        c.add_argument("--timeout", type=int, help="hours")
        c.add_argument("--rounds", type=int, help="pause after so many rounds")
        c.add_argument("--stored", help="folder of a parquet table (url, status_code, content_type, body) to crawl instead of the web")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = build_session()
    if a.command in ("crawl", "resume"):
        return run_crawl(spark, a)
    if not a.data:
        parser.error("--data is required")
    pages, known = (lambda: table(spark, a.data, "pages")), (lambda: table(spark, a.data, "jobs"))
    if a.command == "list":
        jobs.job_status(known(), pages()).orderBy("job_id").show(1000, False)
    elif a.command == "status":
        rows = jobs.job_status(known(), pages())
        (rows.where(F.col("job_id") == a.job) if a.job else rows).orderBy("job_id").show(1000, False)
    elif a.command == "report":
        done = analysis.analysed(pages().where(F.col("clean_content").isNotNull()), known())
        rollup.breakdown(pages(), "status").orderBy(F.desc("n")).show()
        rollup.breakdown(done, "page_type").orderBy(F.desc("n")).show()
        rollup.extraction_quality(pages()).show()
        report.contact_rich(done).select("url", "n_emails", "page_type").show(truncate=80)
        report.indicator_rich(done, analysis.INDICATORS).select("url", "score", "page_type").show(truncate=80)
    elif a.command == "export":
        mine = pages().where(F.col("job_id") == a.job)
        exports.write(
            exports.page_report(mine) if a.format == "csv" else mine,
            f"{a.out}/{exports.file_name(a.job, 'pages', a.format)}",
            a.format,
        )
        exports.write(exports.contact_rows(mine), f"{a.out}/{exports.file_name(a.job, 'contacts', a.format)}", a.format)
    else:
        from quern.queries import core

        try:  # the repository's registry holds more than the core
            known = importlib.import_module("__spark_entry__").queries()
        except ImportError:
            known = core.QUERIES
        known[a.name](spark, a.data).show(50, False)
    return 0


def run_crawl(spark, a) -> int:
    given = {"base_delay": a.delay, "max_pages": a.max_pages, "timeout_hours": a.timeout}
    settings = replace(jobs.settings_for(a.domain), **{k: v for k, v in given.items() if v is not None})
    rounds = crawl.State(spark, a.state).rounds
    if a.command == "resume" and not rounds or a.command == "crawl" and rounds:
        raise SystemExit("no saved rounds there" if a.command == "resume" else "saved rounds there: resume them, or name another folder")
    make = lambda: web.http_fetcher(timeout=settings.request_timeout, retries=settings.max_retries)
    if a.stored:
        folder = a.stored

        def make():
            return web.stored_fetcher(folder)

    pages, fetches = crawl.crawl(spark, a.domain, make, None, settings, a.state, a.rounds)
    logging.getLogger("quern").info("%d fetches, %d pages", fetches.count(), pages.where("status_code = 200").count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
