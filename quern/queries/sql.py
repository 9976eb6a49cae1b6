"""Pieces of the DuckDB statements that queries are compared with."""

from __future__ import annotations

from quern import vocab

_RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def PART(i: int, url: str = "url") -> str:  # noqa: N802
    return f"regexp_extract({url}, '{_RFC}', {i})"


DEPTH = f"CAST(len(list_filter(string_split(regexp_replace({PART(3)}, ';[^/]*$', ''), '/'), lambda s: s <> '')) AS BIGINT)"
BARE = r"regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z]+://', ''), '^www\.|/.*$', '', 'g')"


def COUNT(text: str, pattern: str) -> str:  # noqa: N802
    return f"len(regexp_extract_all({text}, '(?i){pattern}'))"


def indicator_sum(column: str, patterns: list[str]) -> str:
    return " + ".join(COUNT(f"coalesce({column}, '')", p) for p in patterns)


PATTERN_CLASS = (
    "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in vocab.URL_PATTERNS) + " " + " ".join(
        f"WHEN {' OR '.join(f"contains(lower(url), '{x}')" for x in xs)} THEN '{n}'" for n, xs in vocab.URL_FALLBACKS
    ) + " WHEN url IS NOT NULL THEN 'general' ELSE 'general' END"
)
FULL_TEXT = "coalesce(clean_content, '') || ' ' || lower(coalesce(title, '')) || ' ' || lower(url)"
_Q = "coalesce(title, '')", "coalesce(clean_content, '')", "coalesce(markdown_content, '')"
QUALITY = f"""least(1.0, CASE WHEN {_Q[0]} <> '' THEN 0.2e0 ELSE 0e0 END + CASE WHEN length({_Q[1]}) > 1000 THEN 0.3e0 WHEN length({_Q[1]}) > 500 THEN 0.2e0 WHEN length({_Q[1]}) > 100 THEN 0.1e0 ELSE 0e0 END
 + CASE WHEN contains({_Q[2]}, '##') THEN 0.1e0 ELSE 0e0 END + CASE WHEN contains({_Q[2]}, '- ') OR contains({_Q[2]}, '* ') OR regexp_matches({_Q[2]}, '(?m)^[0-9]+\\.') THEN 0.1e0 ELSE 0e0 END + CASE WHEN contains({_Q[2]}, '[') AND contains({_Q[2]}, '](') THEN 0.05e0 ELSE 0e0 END
 + CASE WHEN {_Q[1]} = '' OR {_Q[2]} = '' THEN 0e0 WHEN length({_Q[2]}) / greatest(length({_Q[1]}), 1) BETWEEN 1.0 AND 2.0 THEN 0.25e0 WHEN length({_Q[2]}) / greatest(length({_Q[1]}), 1) BETWEEN 0.8 AND 3.0 THEN 0.15e0 ELSE 0.05e0 END)"""

ASSET = (
    "CASE " + " ".join(
        f"WHEN {' OR '.join(f"ends_with(lower(asset_url), '{e}')" for e in es)} THEN '{n}'" for n, es in vocab.ASSET_EXTENSIONS.items()
    ) + " " + " ".join(
        f"WHEN {' OR '.join(f"regexp_matches(lower(coalesce(w, '')), '{p}') OR regexp_matches(lower(asset_url), '{p}')" for p in ps)} THEN '{n}'" for n, ps in vocab.ASSET_PATTERNS.items()
    ) + " ELSE 'webpage' END"
)


def page_type_sql(last: str) -> str:
    """``typed`` has page_id, u (address), t (text), page_type and top, the first highest score in declaration order."""
    sums = ", ".join(
        f"3 * ({' + '.join(COUNT('u', p) for p in ps)}) + {' + '.join(COUNT('t', p) for p in ps)} AS s_{k}" for k, ps in vocab.PAGE_TYPES.items()
    )
    top = "greatest(" + ", ".join(f"s_{k}" for k in vocab.PAGE_TYPES) + ")"
    case = "CASE WHEN top = 0 OR top IS NULL THEN 'general' " + " ".join(f"WHEN s_{k} = top THEN '{k}'" for k in vocab.PAGE_TYPES) + " END"
    return f"WITH b AS (SELECT page_id, lower(url) AS u, {FULL_TEXT} AS t FROM pages), s AS (SELECT *, {sums} FROM b), m AS (SELECT *, CAST({top} AS BIGINT) AS top FROM s), typed AS (SELECT *, {case} AS page_type FROM m) {last}"


def subtype_sql() -> str:
    parts = []
    for kind, subtypes in vocab.PAGE_SUBTYPES.items():
        scores = [f"(2 * ({' + '.join(COUNT('u', p) for p in ps)}) + {' + '.join(COUNT('t', p) for p in ps)})" for ps in subtypes.values()]
        best = f"greatest({', '.join(scores)})"
        inner = " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in zip(subtypes, scores))
        parts.append(f"WHEN page_type = '{kind}' THEN CASE WHEN {best} = 0 THEN NULL {inner} END")
    return page_type_sql(f"SELECT page_id, page_type, CASE {' '.join(parts)} END AS page_subtype FROM typed")
