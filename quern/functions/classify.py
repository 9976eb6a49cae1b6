"""Rule-scored page types: 61 ordered patterns over address and text, first best wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import vocab
from quern.functions.text import count_matches


def full_text(clean: Column, title: Column, url: Column) -> Column:
    """Text, title and address in lower case. Make it a column of its own before scoring, so that it is computed once."""
    return F.lower(F.concat_ws(" ", F.coalesce(clean, F.lit("")), F.coalesce(title, F.lit("")), url))


def _score(patterns: list[str], url: Column, text: Column, weight: int) -> Column:
    return count_matches(url, patterns) * weight + count_matches(text, patterns, lowered=True)


def _apart(scores: list[Column]) -> Column:
    """Array of ``scores``, each evaluated inside a lambda: dozens of patterns in one generated method would exceed its size limit."""

    def pick(i: Column) -> Column:
        chain = F.when(i == 0, scores[0])
        for n, score in enumerate(scores[1:], 1):
            chain = chain.when(i == n, score)
        return chain

    return F.transform(F.array(*[F.lit(i) for i in range(len(scores))]), lambda i: pick(i))


def type_scores(url: Column, text: Column) -> Column:
    """Array of the scores in declaration order: three times the matches in the address plus those in the text."""
    return _apart([_score(ps, url, text, 3).cast("int") for ps in vocab.PAGE_TYPES.values()])


def best(scores: Column, names: list[str], otherwise: Column) -> Column:
    """Name of the first highest score, or ``otherwise`` where all are zero."""
    top = F.array_max(scores)
    return F.when(top > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, top).cast("int"))).otherwise(otherwise)


def page_type(scores: Column) -> Column:
    return best(scores, list(vocab.PAGE_TYPES), F.lit("general"))


def page_subtype(kind: Column, url: Column, text: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, subtypes in vocab.PAGE_SUBTYPES.items():
        scores = _apart([_score(ps, url, text, 2).cast("int") for ps in subtypes.values()])
        chain = chain.when(kind == name, best(scores, list(subtypes), F.lit(None).cast("string")))
    return chain


def any_contains(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
