"""The command line over the smallest tables."""

import pytest

from quern.__main__ import main


def test_commands(spark, data, tmp_path, capsys):
    assert main(["--data", data, "list"]) == 0
    assert main(["--data", data, "status"]) == 0
    assert main(["--data", data, "query", "status_codes"]) == 0
    assert "status_code" in capsys.readouterr().out
    job = spark.read.parquet(f"{data}/jobs.parquet").orderBy("job_id").first().job_id
    for kind in ("csv", "json"):
        assert main(["--data", data, "export", job, "--out", str(tmp_path), "--format", kind]) == 0
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == 4 and all("-pages-" in n or "-contacts-" in n for n in names)


def test_report(data, capsys, spark):
    assert main(["--data", data, "report"]) == 0
    out = capsys.readouterr().out
    assert "page_type" in out and "browser_fetch_count" in out


def test_crawl_and_resume(spark, tmp_path):
    kind = "text/html"
    rows = [(f"https://u.edu/{i}", 200, kind, f'<a href="/{i + 1}">n</a>') for i in range(4)] + [("https://u.edu", 200, kind, '<a href="/0">n</a>')]
    spark.createDataFrame(rows, "url string, status_code int, content_type string, body string").write.parquet(f"{tmp_path}/web")
    common = ["u.edu", "--state", f"file://{tmp_path}/state", "--stored", f"{tmp_path}/web", "--delay", "0"]
    assert main(["crawl", *common, "--rounds", "2"]) == 0
    with pytest.raises(SystemExit):
        main(["crawl", *common])
    assert main(["resume", *common]) == 0
    from quern.plans.crawl import State

    assert State(spark, f"file://{tmp_path}/state").every("fetched").where("status_code = 200").count() == 5
    with pytest.raises(SystemExit):
        main(["resume", "v.edu", "--state", f"file://{tmp_path}/none"])
