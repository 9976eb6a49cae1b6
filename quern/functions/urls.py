"""URL columns: parts, cleaning, classification. All stay in the JVM but ``resolve`` with dot segments."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import vocab

_RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _RFC, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host with port and user, case kept."""
    return _part(url, 2)


def host_lower(url: Column) -> Column:
    return F.lower(authority(url))


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def subdomain_label(url: Column) -> Column:
    """First label of a host with more than two labels, else empty."""
    labels = F.split(authority(url), r"\.")
    return F.when(F.size(labels) > 2, F.get(labels, F.lit(0))).otherwise("")


def subdomain_relative(url: Column, domain: Column) -> Column:
    """``www`` for the domain itself, the whole prefix below it, ``external`` elsewhere."""
    host = host_lower(url)
    return F.when(host == domain, "www").when(
        F.endswith(host, F.concat(F.lit("."), domain)),
        F.substring(host, F.lit(1), F.length(host) - F.length(domain) - 1),
    ).otherwise("external")


def assemble(sch: Column, auth: Column, rest: Column, params: Column, frag: Column) -> Column:
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(auth != "", F.concat(F.lit("//"), auth)).otherwise(""),
        rest,
        F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""),
    )


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, no fragment."""
    return assemble(scheme(url), host_lower(url), _part(url, 3), query(url), F.lit(""))


def clean(url: Column) -> Column:
    """No fragment and no tracking parameters; other parameters keep their order."""
    kept = F.filter(F.split(query(url), "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(vocab.TRACKING_PARAMETERS))
    return assemble(scheme(url), authority(url), _part(url, 3), F.array_join(kept, "&"), F.lit(""))


def is_valid(url: Column) -> Column:
    return (scheme(url) != "") & (authority(url) != "")


def _tail(href: Column) -> Column:
    """The query and fragment as written."""
    return F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))),
    )
    whole = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    rooted = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))
    return F.when(path.rlike(r"/\.\.?(/|$)"), rooted).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, dot segments included. All of it are plain columns; ``resolve_udf`` adds what the standard
    library does with malformed addresses."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    simple = F.when((scheme(href) != "") & (scheme(href) != scheme(base)), href).when(
        scheme(href) != "",
        F.concat(scheme(href), F.substring(href, F.length(_part(href, 1)) + 1, F.length(href))),
    ).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, without_dots(_part(href, 3)), _tail(href)))
    whole = assemble(scheme(base), authority(base), _part(base, 3), query(base), F.lit(""))
    return simple.when(href.startswith("#"), F.concat(whole, href)).when(
        href.startswith("?"),
        F.concat(root, _part(base, 3), href),
    ).otherwise(
        F.concat(root, without_dots(F.concat(F.regexp_replace(_part(base, 3), r"[^/]*$", ""), _part(href, 3))), _tail(href))
    )


@F.pandas_udf(T.StringType())
def resolve_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    """Standard resolution, dot segments included; null where either side is null or cannot be parsed."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def has_parameters(url: Column) -> Column:
    return query(url) != ""


def extension(url: Column) -> Column:
    """Text after the last dot of the whole path, if at most five characters; with its dot, in lower case."""
    last = F.lower(F.element_at(F.split(path(url), r"\."), -1))
    return F.when(F.contains(path(url), F.lit(".")) & (F.length(last) <= 5), F.concat(F.lit("."), last))


def pattern_class(url: Column) -> Column:
    """First matching class of the ordered patterns, then of the fallbacks, else ``general``."""
    low = F.lower(url)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, p in vocab.URL_PATTERNS:
        chain = chain.when(low.rlike(p), name)
    for name, parts in vocab.URL_FALLBACKS:
        chain = chain.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in parts]), name)
    return chain.otherwise("general")


def academic_year(url: Column) -> Column:
    """First year, or pair of years, from 1990 to 2030."""
    found = F.regexp_extract_all(url, F.lit(r"(\d{4}(?:[-/]\d{4})?)"), F.lit(1))
    return F.get(F.filter(found, lambda y: F.substring(y, 1, 4).cast("int").between(1990, 2030)), F.lit(0))


def job_id(domain: Column, at: Column) -> Column:
    bare = F.replace(F.replace(F.replace(domain, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("www."), F.lit(""))
    return F.concat(F.lit("job_"), F.coalesce(F.translate(bare, ".:/", "___"), F.lit("unknown")), F.lit("_"), F.date_format(at, "yyMMddHH"))


def safe_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(255))


def content_class(content_type: Column, url: Column) -> Column:
    """html, pdf, image, css, javascript or other, from the MIME type, else from the address."""
    mime, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(url)
    by_type = F.when(F.contains(mime, F.lit("html")), "html").when(F.contains(mime, F.lit("pdf")), "pdf").when(
        F.contains(mime, F.lit("image/")),
        "image",
    ).when(F.contains(mime, F.lit("css")), "css").when(
        F.contains(mime, F.lit("javascript")),
        "javascript",
    )
    return by_type.when(low.rlike(r"\.pdf$"), "pdf").when(
        low.rlike(r"\.(?:jpg|jpeg|png|gif|webp)$"),
        "image",
    ).when(low.rlike(r"\.css$"), "css").when(low.rlike(r"\.js$"), "javascript").otherwise("other")


def bare_domain(domain: Column) -> Column:
    """A job's domain in lower case without scheme, ``www.`` and path."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z]+://", ""), r"^www\.|/.*$", "")


def url_structure(url: Column) -> Column:
    return F.struct(
        depth(url).alias("path_depth"),
        segments(url).alias("path_segments"),
        has_parameters(url).alias("has_parameters"),
        extension(url).alias("file_extension"),
        pattern_class(url).alias("url_pattern"),
        academic_year(url).alias("academic_year"),
    )
