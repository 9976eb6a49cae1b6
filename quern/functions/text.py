"""Text columns: contacts, indicators, scores, markdown clean-up, formats. All in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import vocab


def _flagged(pattern: str) -> str:
    """Case-insensitive, and ``.`` stops only at line feeds."""
    return f"(?id){pattern}"


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of white space (no-break spaces included) as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def distinct_sorted(found: Column) -> Column:
    return F.array_sort(F.array_distinct(found))


def emails(text: Column) -> Column:
    return distinct_sorted(F.regexp_extract_all(text, F.lit(_flagged(vocab.EMAIL_PATTERN)), F.lit(0)))


def social_handles(text: Column) -> Column:
    """Map of platform to sorted distinct handles; platforms without handles are absent."""
    pairs = [
        x for platform, p in vocab.SOCIAL_PATTERNS.items() for x in (
            F.lit(platform),
            distinct_sorted(F.regexp_extract_all(text, F.lit(_flagged(p)), F.lit(1))),
        )
    ]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def _occurrences(low: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in lower-case text. Plain words (a plural ``s?`` at the end changes no count) are counted by the bytes
    that removing them saves, which is far faster than a regular expression; other patterns by one without case folding."""
    word = re.sub(r"s\?$", "", pattern)
    if re.fullmatch(r"[a-z]+", word):
        return ((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")
    return F.regexp_count(low, F.lit(f"(?d){pattern}"))


def count_matches(text: Column, patterns: list[str], lowered: bool = False) -> Column:
    """Sum of the match counts of all patterns, in any case; null text counts 0. ``lowered`` says that ``text`` is in lower case already."""
    safe = F.coalesce(text, F.lit(""))
    low = safe if lowered else F.lower(safe)
    return reduce(lambda a, b: a + b, [_occurrences(low, p) for p in patterns])


def content_indicators(text: Column) -> Column:
    return F.struct(*[count_matches(text, ps).alias(name) for name, ps in vocab.CONTENT_INDICATORS.items()])


def semantic_terms(text: Column, category: str) -> Column:
    """Sorted distinct matches in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    parts = [
        F.when(
            F.contains(low, F.lit(p)),
            F.array(F.lit(p)),
        ).otherwise(none) if p.isalpha() else F.regexp_extract_all(
            low,
            F.lit(f"(?d){p}"),
            F.lit(0),
        ) for p in vocab.SEMANTIC_PATTERNS[category]
    ]
    return distinct_sorted(F.flatten(F.array(*parts)))


def semantic_indicators(text: Column, most: int = 10) -> Column:
    return F.struct(*[F.least(F.lit(most), F.size(semantic_terms(text, c))).alias(c) for c in vocab.SEMANTIC_PATTERNS])


def markdown_to_text(md: Column) -> Column:
    steps = [
        (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
        (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
        (r"[#*`_~]", ""),
        (r"(?md)^-{3,}$", ""),
        (r"\n+", "\n"),
        (r" +", " "),
        (r"(?U)^\s+|\s+$", ""),
    ]
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, md)


def tidy_markdown(md: Column) -> Column:
    """At most one blank line between paragraphs, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(md, r"\n\s*\n\s*\n+", "\n\n"), r"^(?:[ \t]*\n)+", ""), r"\s+$", "")


def quality_score(title: Column, clean: Column, md: Column) -> Column:
    """Extraction quality from 0 to 1: title, length, structure, and the ratio of the two texts."""
    t, c, m = (F.coalesce(x, F.lit("")) for x in (title, clean, md))
    lc, lm = F.length(c), F.length(m)
    ratio = lm / F.greatest(lc, F.lit(1))
    length = F.when(lc > 1000, 0.3).when(lc > 500, 0.2).when(lc > 100, 0.1).otherwise(0.0)
    lists = F.contains(m, F.lit("- ")) | F.contains(m, F.lit("* ")) | m.rlike(r"(?m)^\d+\.")
    shape = F.when(F.contains(m, F.lit("##")), 0.1).otherwise(0.0) + F.when(lists, 0.1).otherwise(0.0) + F.when(
        F.contains(m, F.lit("[")) & F.contains(m, F.lit("](")),
        0.05,
    ).otherwise(0.0)
    balance = F.when((lc == 0) | (lm == 0), 0.0).when(ratio.between(1.0, 2.0), 0.25).when(
        ((ratio >= 0.8) & (ratio < 1.0)) | ((ratio > 2.0) & (ratio <= 3.0)),
        0.15,
    ).otherwise(0.05)
    return F.least(F.lit(1.0), F.when(t != "", 0.2).otherwise(0.0) + length + F.when(lm > 0, shape).otherwise(0.0) + balance)


def extraction_method(known: Column, browser: Column) -> Column:
    return F.coalesce(known, F.when(browser, "browser").otherwise("beautifulsoup"))


def format_bytes(n: Column) -> Column:
    chain = F.when(n < 1024, F.format_string("%.1fB", n.cast("double")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        chain = chain.when(n < 1024 ** (i + 1), F.format_string(f"%.1f{unit}", F.bround(n / F.lit(float(1024**i)), 1)))
    return chain.otherwise(F.format_string("%.1fTB", F.bround(n / F.lit(float(1024**4)), 1)))


def format_duration(seconds: Column) -> Column:
    whole = lambda c: F.floor(c).cast("long").cast("string")
    short = F.format_string("%.1fs", seconds.cast("double"))
    minutes = F.concat(whole(seconds / 60), F.lit("m "), F.round(seconds % 60).cast("long").cast("string"), F.lit("s"))
    return F.when(seconds < 60, short).when(seconds < 3600, minutes).otherwise(
        F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m"))
    )


def format_speed(per_second: Column) -> Column:
    return F.when(
        per_second >= 1,
        F.format_string("%.1f URLs/sec", per_second.cast("double")),
    ).otherwise(F.format_string("%.1f URLs/min", per_second * 60.0))
