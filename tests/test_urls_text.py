"""URL and text columns against hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from quern.functions import classify, html, links, text, urls
from quern.operators import filters


def one(spark, column, **values):
    schema = ", ".join(
        f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()
    )
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "depth", "pattern", "year", "ext", "query"),
    [
        ("https://cs.u.edu/people/john-doe", 2, "faculty_profile", None, None, False),
        ("https://u.edu/departments/cs", 2, "department_page", None, None, False),
        ("https://u.edu/courses/cs101", 2, "course_page", None, None, False),
        ("https://u.edu/research/ai-lab", 2, "research_project", None, None, False),
        ("https://u.edu/news/2024/article", 3, "news_article", "2024", None, False),
        ("https://u.edu/a.b/c", 2, "general", None, ".b/c", False),
        ("https://u.edu/x/2023-2024/", 2, "academic_year", "2023-2024", None, False),
        ("https://u.edu/1776/", 1, "academic_year", None, None, False),
        ("https://u.edu/f/report.pdf", 2, "file_download", None, ".pdf", False),
        ("https://u.edu/f/report.pdf?v=1", 2, "general", None, ".pdf", True),
        ("https://u.edu", 0, "general", None, None, False),
    ],
)
def test_structure(spark, url, depth, pattern, year, ext, query):
    s = one(spark, urls.url_structure(F.col("u")), u=url)
    assert (s.path_depth, s.url_pattern, s.academic_year, s.file_extension, s.has_parameters) == (depth, pattern, year, ext, query)


@pytest.mark.parametrize(
    ("url", "clean"),
    [
        ("https://u.edu/p?utm_source=a&x=1#top", "https://u.edu/p?x=1"),
        ("https://u.edu/p?UTM_Source=a", "https://u.edu/p"),
        ("https://u.edu/p?b=2&gclid=z&a=1", "https://u.edu/p?b=2&a=1"),
        ("", ""),
    ],
)
def test_clean(spark, url, clean):
    assert one(spark, urls.clean(F.col("u")), u=url) == clean


@pytest.mark.parametrize("href", ["/a/b", "c", "//h.org/x", "?q=1", "#f", "HTTP://x.org/", "mailto:a@b.c", "https://x.org/a?b#c"])
def test_resolve_agrees_with_standard_library(spark, href):
    from urllib.parse import urljoin

    base = "https://u.edu/d/e?z=1"
    assert one(spark, urls.resolve(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)
    assert one(
        spark,
        urls.resolve_udf(F.col("b"), F.col("h")),
        b=base,
        h="../" + href if href == "c" else href,
    ) == urljoin(base, "../" + href if href == "c" else href)


@pytest.mark.parametrize("href", ["../x.pdf", "../../../x", "./y?q=../z", "a/./b/../c", "/a/../b/./c#../f", "..", "/..", "x/.", "../"])
def test_dot_segments(spark, href):
    from urllib.parse import urljoin

    base = "https://u.edu/d/e/f.html?z=1"
    assert one(spark, urls.resolve(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)


def test_subdomains_and_names(spark):
    assert one(spark, urls.subdomain_relative(F.col("u"), F.lit("u.edu")), u="https://U.edu/x") == "www"
    assert one(spark, urls.subdomain_relative(F.col("u"), F.lit("u.edu")), u="https://a.b.u.edu/x") == "a.b"
    assert one(spark, urls.subdomain_relative(F.col("u"), F.lit("u.edu")), u="https://notu.edu/x") == "external"
    assert one(spark, urls.subdomain_label(F.col("u")), u="https://cs.u.edu:80/") == "cs"
    assert one(spark, urls.subdomain_label(F.col("u")), u="https://u.edu/") == ""
    assert one(spark, urls.safe_filename(F.col("u")), u='a<b>:"c') == "a_b___c"
    assert one(spark, urls.content_class(F.col("t"), F.col("u")), t=None, u="https://u.edu/A.PDF") == "pdf"
    assert one(spark, urls.normalise(F.col("u")), u="HTTPS://U.Edu/A#x") == "https://u.edu/A"
    assert one(spark, urls.url_structure(F.col("u")), u=None).path_depth in (None, 0)


def test_filters(spark):
    assert one(spark, filters.excluded_extension(F.col("u")), u="https://u.edu/A.ZIP")
    assert not one(spark, filters.excluded_extension(F.col("u")), u="https://u.edu/a.pdf")
    assert one(spark, filters.excluded_pattern(F.col("u")), u="https://u.edu/Search?q=1")
    assert one(spark, filters.allowed_domain(F.col("h"), F.lit("u.edu")), h="news.u.edu")
    assert not one(spark, filters.allowed_domain(F.col("h"), F.lit("u.edu")), h="cs.u.edu")
    assert one(spark, filters.allowed_domain(F.col("h"), F.lit("u.edu"), []), h="cs.u.edu")
    assert one(spark, filters.same_site(F.col("h"), F.lit("cs.u.edu")), h="u.edu")
    rules = filters.parse_robots(
        "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.cgi$\n\nUser-agent: other\nDisallow: /"
    )
    ask = lambda u: one(spark, filters.robots_allows(F.col("u"), {"u.edu": rules}), u=u)
    assert [
        ask("https://u.edu/private/x"),
        ask("https://u.edu/private/open/x"),
        ask("https://u.edu/a.cgi"),
        ask("https://u.edu/"),
        ask("https://v.edu/private"),
    ] == [False, True, False, True, True]


SAMPLE_TEXT = """Dr. Jane Smith is a professor in the department of computing. Her lab studies data systems; publications and papers are listed below.
A federal grant and foundation funding support the project. A patent was filed with an industry partner and a corporate sponsor.
Contact: jane.smith@university.edu, twitter.com/DrJaneSmith, linkedin.com/in/jane-smith-cs"""


def test_text_features(spark):
    assert one(spark, text.emails(F.col("t")), t=SAMPLE_TEXT) == ["jane.smith@university.edu"]
    assert one(spark, text.social_handles(F.col("t")), t=SAMPLE_TEXT) == {
        "twitter": ["DrJaneSmith", "university"],
        "linkedin": ["jane-smith-cs"],
    }
    found = one(spark, text.content_indicators(F.col("t")), t=SAMPLE_TEXT)
    assert (found.funding_references, found.collaboration_indicators, found.technology_transfer, found.industry_connections) == (3, 0, 1, 2)
    assert one(spark, text.content_indicators(F.col("t")), t=None).funding_references == 0
    assert one(spark, text.markdown_to_text(F.col("t")), t="# T\n\n---\n[a](b) ![c](d) **e**  f ") == "T\na !c e f"
    assert one(spark, text.squeeze(F.col("t")), t="  a \n b ") == "a b"
    assert one(spark, text.format_bytes(F.col("n")), n=1536) == "1.5KB"
    assert one(spark, text.format_duration(F.col("n")), n=3725.0) == "1h 2m"


def test_classification_first_best_wins(spark):
    url, words = F.col("u"), classify.full_text(F.col("t"), F.lit("T"), F.col("u"))
    scores = classify.type_scores(url, words)
    kind = lambda u, t: one(spark, classify.page_type(scores), u=u, t=t)
    assert kind("https://u.edu/x", "nothing here") == "general"
    assert kind("https://u.edu/news/2024/x", "press event") == "news"
    assert kind("https://u.edu/x", "degree") == "admissions"  # as many points for academics, which is declared later
    sub = lambda k, u, t: one(spark, classify.page_subtype(F.lit(k), url, words), u=u, t=t)
    assert sub("research", "https://u.edu/x", "publications and papers") == "publications"
    assert sub("about", "https://u.edu/x", "nothing") is None


PAGE = """<html><head><title> Sample | Site </title><style>.x{}</style></head><body><header><a href="/h">Head</a></header><nav>Menu</nav>
<main><h1>Degrees</h1><p>Your <b>career</b> starts here, at a place with many words to read.</p><ul><li>One<li>Two</ul><a href="/a.pdf">Syllabus</a> <a href=" b?x=1&amp;y=2 ">B</a></main><script>no()</script></body></html>"""


def test_html(spark):
    p = one(spark, html.parsed(F.col("h")), h=PAGE)
    assert p.title == "Sample | Site"
    assert p.clean_text == "Degrees Your career starts here, at a place with many words to read. One Two Syllabus B"
    assert p.markdown.startswith("# Degrees\n\nYour **career** starts") and "* One" in p.markdown and "[Syllabus](/a.pdf)" in p.markdown
    assert p.links == ["/h", "/a.pdf", "b?x=1&y=2"]
    for broken in (None, "", "<", "<p>" * 3000, "<div class='a", "<!-- open"):
        assert one(spark, html.parsed(F.col("h")), h=broken).clean_text is None


def test_link_counts_and_assets(spark):
    refs = ["/a", "#x", "mailto:a@u.edu", "https://cs.u.edu/", "https://notu.edu/", "https://x.org/", "HTTP://x.org/"]
    page = "".join(f'<a href="{h}">t</a>' for h in refs)
    c = one(spark, links.link_counts(F.col("h"), F.lit("u.edu")), h=page)
    assert (c.internal, c.external, c.external_hosts) == (5, 1, ["x.org"])
    assert one(spark, links.asset_category(F.col("u"), F.lit("x")), u="https://u.edu/a.HTML") == "code"
    assert one(spark, links.asset_category(F.col("u"), F.lit("the Handbook")), u="https://u.edu/a") == "documents"
    assert one(spark, links.asset_category(F.col("u"), F.lit("x")), u="https://u.edu/a") == "webpage"
    assert one(spark, links.is_challenge(F.lit("https://u.edu"), F.col("h"), F.lit(200), F.lit(None)), h="please verify: security check")
    assert one(spark, links.is_challenge(F.lit("https://u.edu"), F.col("h"), F.lit(403), F.lit("Cloudflare")), h=None)


def test_deep_nesting_keeps_the_page(spark):
    for tag in ("div", "span"):
        p = one(spark, html.parsed(F.col("h")), h=f"<title>T</title>{f'<{tag}>' * 3000}{'words ' * 20}<a href='/x'>x</a>")
        assert p.title == "T" and p.links == ["/x"] and p.clean_text.endswith("words x") and p.markdown.endswith("words [x](/x)")
