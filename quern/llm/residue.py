"""Problem 7: unfilled template fields, filler, error messages and demands for scripts in place of content.

Method: placeholder detectors look for unfilled fields, program messages, filler words, standard status lines and demands for
scripts. What they do not know is found by comparing each page's address slug, title and body: where a body has no prose, its
lines, and the page's title, are low-information responses if they share no term with the slug or the host. A response that
answers many different slugs on several hosts, and is not found on pages with prose (as menus and notices are), is flagged by
that combined evidence, in whatever words and language it is written. Prose about errors, templates or scripts is kept: a
message counts only where prose is missing, and a field not in a sentence that speaks of templates.

Cost: one pass over title and text in Arrow batches makes flags and 64-bit keys, which are written; evidence is folded by
(key, slug, host) and then by key with partial aggregation, so a response on a third of all pages is no hot spot; only keys
with enough evidence come back, through a size-checked join.

Defined results: a page without text is judged by its title; null title and text are never a case; a text of only white
space counts as no text; of repeated rows each is judged alike and the id comes out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut, join_small

_NOUN = r"(?:name|title|text|date|field|department|photo|image|phone|address|email|e-mail|program(?:me)?|course|author|link|heading|content|description|quote|campus|city|nombre|t[ií]tulo|texto|fecha|vorname|nachname|titel|datum)"
#: Unfilled template fields, by syntax.
_FIELD = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{0,80}%\}|<%[^<>\n]{0,80}%>|\[%[^\[\]\n]{0,80}%\]|[$#]\{[^{}\n]{1,60}\}|(?<![\w{$#])\{(?:\d{1,2}|[a-z_]+(?:\.[a-z_]+)*)\}(?!\})" r"|@@\w+@@|\[\[[\w .:|-]{1,60}\]\]|%%\w+%%|%[A-Z][A-Z_]{2,}%|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|\$[A-Z][A-Z_]{2,}\$|\*\|[A-Z_:]+\|\*|<!--.{0,80}?-->" r"|(?<![\w.@+-])[A-Z]{2,}(?:_[A-Z]{2,})+(?![\w.+-]*\s?(?:@|&#64;|\[at\]|\(at\)|at\b|\[AT\]|\(AT\)|AT\b))(?!\w)" r"|\[(?i:insert|your|add|enter|page title|title|name|placeholder|todo|tbd|put)\b[^\[\]\n]{0,60}\]|<(?i:[a-z]+ )?(?i:" + _NOUN + r")>|\(\((?i:" + _NOUN + r")\)\)" r"|\bX{3,}(?:-[A-Z]+)*-?X{2,}\b|\bTBD\b|\bTODO:|\bFIXME\b|\bundefined[ ,]+undefined\b|\bnull[ ,]+null\b|\[object Object\]|\bNaN[ ,]+NaN\b"
)
#: A sentence that speaks of templates: a field in it is an example.
_ABOUT_FIELDS = re.compile(
    r"\b(?:templates?|placeholders?|slots?|syntax|variables?|markup|brac(?:es|kets)|plantillas?|marcador(?:es)?|hueco|llaves|Vorlagen?|Platzhalter|Klammern|Variablen?)\b",
    re.I,
)
#: Program messages, at the start of a line.
_PROGRAM = re.compile(
    r"^\W{0,3}(?:(?:PHP )?(?:fatal|parse|catchable fatal) error\b.*:|(?:PHP )?(?:warning|notice|deprecated): .*(?:undefined|line \d|\(\)|array|variable|index)|traceback \(most recent call|\w*(?:exception|error) (?:at|in) \S+|(?:uncaught|unhandled) \w*(?:exception|error)|\w+(?:Exception|Error)(?::| at\b| in\b)|SQLSTATE\b|ORA-\d+|stack ?trace:?|segmentation fault|exception in thread|error establishing a database connection|syntax error near)",
    re.I | re.M,
)
#: Reason phrases of the HTTP standard.
_REASON = r"(?:bad request|unauthori[sz]ed|forbidden|(?:page |file )?not found|method not allowed|request time-?out|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out)"
#: A status line, in place of content: a status code, a reason, or both, and nothing else.
_STATUS = re.compile(rf"^\W{{0,3}}(?:(?:error\s+|http\s+(?:error\s+)?)?[45]\d\d\b\W{{0,4}}(?:{_REASON})?|{_REASON})\W*\d*\W*$", re.I)
#: Demands for scripts.
_SCRIPTS = re.compile(
    r"\b(?:enable|turn on|allow|activate|requires?|needs?|activ[ea]|habilite|necesita|requiere|aktivieren|ben[öo]tigt|erfordert)\b.{0,30}\b(?:javascript|scripts?|skripte?)\b|\b(?:javascript|scripts?|skripte?)\b.{0,30}\b(?:enabled|allowed|required|disabled|aktivieren|einschalten)\b",
    re.I,
)
#: Stubs that no author wrote.
_STUB = re.compile(r"^\W{0,3}(?:untitled(?: (?:document|page))?|(?:sample|test|blank|default) page|(?:insert )?(?:page )?title(?: goes)? here|loading\W*|placeholder|coming soon|under construction)\W*\d*\W*$", re.I)
_LATIN = re.compile(r"\b(?:lorem|ipsum)\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…](?=\s|$)")
_SPECIAL = re.compile(r"[{\[<$%@*(]|__|[A-Z]_[A-Z]|XXX|TBD|TODO|FIXME|undefined|null|NaN")
FLAGS = "page_id long, host string, slug string, has_field boolean, has_program boolean, prose boolean, body_message boolean, title_message boolean, line_keys array<long>, title_key long, title_low boolean"
#: A response is low-information evidence on at least this many slugs and hosts, if at most this share of its pages have prose.
MIN_SLUGS, MIN_HOSTS, MOST_PROSE = 4, 3, 0.02
LONG_LINE = 140


def unfilled_field(text: str) -> bool:
    """Whether ``text`` has a template field left unfilled, other than as an example in a sentence about templates."""
    if not _SPECIAL.search(text):
        return False
    for m in _FIELD.finditer(text):
        a = max(text.rfind("\n", 0, m.start()) + 1, *(text.rfind(e, 0, m.start()) + 1 for e in (". ", "? ", "! ")))
        ends = [e for e in (text.find(x, m.end()) for x in ("\n", ". ", "? ", "! ")) if e >= 0]
        around = text[a : m.start()] + " " + text[m.end() : min(ends, default=len(text))]
        if not _ABOUT_FIELDS.search(around):
            return True
    return False


def is_message(line: str) -> bool:
    return bool(_STATUS.search(line) or _SCRIPTS.search(line) or _STUB.search(line))


def title_parts(title: str) -> list[str]:
    """The whole title, and its part before the site's name."""
    return list(dict.fromkeys(x.strip() for x in [title, *re.split(r"\s[|·»–—-]\s", title)[:1]]))


def title_is_message(title: str) -> bool:
    return any(_STATUS.search(p) or _STUB.search(p) or (len(p) < 90 and _SCRIPTS.search(p)) for p in title_parts(title)) or bool(_LATIN.search(title))


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(_LETTERS.findall(text.lower()))) - (1 << 63)


def judge(url: str | None, title: str | None, text: str | None) -> tuple:
    """The flags of one page, from ``has_field`` on, after host and slug."""
    url, title, text = url or "", title or "", text or ""
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#:]*)", url)
    host = m.group(1).lower() if m else ""
    path = re.sub(r"[?#].*$", "", url[m.end() :] if m else url).rstrip("/")
    slug = re.sub(r"\.\w{2,5}$", "", path.rpartition("/")[2]).lower()
    terms = set(_LETTERS.findall(slug)) | set(_LETTERS.findall(host))
    field = unfilled_field(title) or unfilled_field(text)
    program = bool(_PROGRAM.search(text) or _PROGRAM.search(title))
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    latin = sum(len(_LATIN.findall(x)) for x in lines) if "orem" in text or "psum" in text or "OREM" in text or "PSUM" in text else 0
    prose = any(len(x) >= LONG_LINE and len(_SENTENCE.findall(x)) >= 2 and not _LATIN.search(x) for x in lines)
    if latin >= 2 and prose:
        # Filler words carry no function words; count the long lines that read as language.
        prose = sum(len(x) for x in lines if len(x) >= LONG_LINE and _reads(x)) > sum(
            len(x) for x in lines if len(x) >= LONG_LINE and not _reads(x)
        )
    own = [x for x in lines if x.lower() != title.strip().lower()]
    message = not prose and any(is_message(x) for x in own) or latin >= 2 and not prose
    keys = {}
    for x in lines:
        if len(x) < LONG_LINE or not prose:
            ws = _LETTERS.findall(x.lower())
            if ws and not terms.intersection(ws):
                keys[_key(x)] = None
    part = title_parts(title)[-1] if title else ""
    ws = set(_LETTERS.findall(part.lower()))
    return host, slug, field, program, prose, message, title_is_message(title), list(keys), _key(part) if ws else None, bool(ws) and not ws & terms


_READS = frozenset(
    "the a of to in and for on at with is are was by el la de los las y en que con un una se por der die das und in zu den von mit im für ist wird".split()
)


def _reads(line: str) -> bool:
    ws = _LETTERS.findall(line.lower())
    return sum(w in _READS for w in ws) > 0.12 * len(ws)


def page_flags(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    title: str = "title",
    text: str = "clean_content",
) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FLAGS.split(", ")]
        for pdf in batches:
            rows = [(i, *judge(u, t, x)) for i, u, t, x in zip(pdf["page_id"], pdf["url"], pdf["title"], pdf["text"])]
            out = pd.DataFrame(rows, columns=names)
            out["title_key"] = out["title_key"].astype("Int64")
            yield out

    picked = pages.where(F.col(page_id).isNotNull() & (F.col(title).isNotNull() | F.col(text).isNotNull()))
    return picked.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.col(title).alias("title"),
        F.col(text).alias("text"),
    ).mapInPandas(run, FLAGS)


def responses(flags: DataFrame, min_slugs: int, min_hosts: int, most_prose: float) -> DataFrame:
    """(kind, key): lines ("line") and titles ("title") that answer many slugs on several hosts, and none with prose."""
    lines = flags.select("slug", "host", "prose", F.lit(True).alias("low"), F.lit("line").alias("kind"), F.explode("line_keys").alias("key"))
    titles = flags.where(F.col("title_key").isNotNull()).select("slug", "host", "prose", F.col("title_low").alias("low"), F.lit("title").alias("kind"), F.col("title_key").alias("key"))
    # The first fold leaves one row for each slug and host, so that the second never meets a key's pages.
    once = lines.unionByName(titles).groupBy("kind", "key", "host", "slug").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("prose").alias("n_prose"), F.count_if(~F.col("low")).alias("n_matched")
    )
    per_host = once.groupBy("kind", "key", "host").agg(F.count_distinct("slug").alias("slugs"), *[F.sum(c).alias(c) for c in ("n", "n_prose", "n_matched")])
    return per_host.groupBy("kind", "key").agg(
        F.sum("slugs").alias("slugs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(c).alias(c) for c in ("n", "n_prose", "n_matched")]
    ).where(
        (F.col("slugs") >= min_slugs) & (F.col("hosts") >= min_hosts) & (F.col("n_prose") <= most_prose * F.col("n")) & (F.col("n_matched") <= most_prose * F.col("n"))
    ).select("kind", "key")


def residue_pages(
    pages: DataFrame,
    min_slugs: int = MIN_SLUGS,
    min_hosts: int = MIN_HOSTS,
    most_prose: float = MOST_PROSE,
    **columns: str,
) -> DataFrame:
    """(page_id, reason): the pages to exclude, with the first reason that holds."""
    flags = cut(page_flags(pages, **columns), "p7")
    found = cut(responses(flags, min_slugs, min_hosts, most_prose), "p7-responses")
    bare = flags.where(~F.col("prose"))
    kinds = {k: found.where(F.col("kind") == k).select("key") for k in ("line", "title")}
    by_line = join_small(bare.select("page_id", F.explode("line_keys").alias("key")), kinds["line"], ["key"], "left_semi", row_bytes=16)
    by_title = join_small(
        bare.where("title_low").select("page_id", F.col("title_key").alias("key")), kinds["title"], ["key"], "left_semi", row_bytes=16
    )
    certain = flags.select(
        "page_id",
        F.when(F.col("has_field"), 0).when(F.col("has_program"), 1).when(F.col("title_message"), 2).when(F.col("body_message"), 3).alias("no"),
    ).where(F.col("no").isNotNull())
    every = certain.unionByName(by_line.select("page_id", F.lit(4).alias("no"))).unionByName(by_title.select("page_id", F.lit(5).alias("no")))
    names = F.array(*[F.lit(x) for x in ("unfilled field", "program message", "title", "message or filler", "duplicated response", "duplicated title")])
    return every.groupBy("page_id").agg(F.min("no").alias("no")).select("page_id", F.element_at(names, F.col("no") + 1).alias("reason"))


def exclude_residue(pages: DataFrame, page_id: str = "page_id", **columns: str) -> DataFrame:
    """``pages`` without those of ``residue_pages``."""
    found = residue_pages(pages, page_id=page_id, **columns).select(F.col("page_id").alias("_quern_id"))
    return pages.join(found, F.col(page_id) == F.col("_quern_id"), "left_anti")
