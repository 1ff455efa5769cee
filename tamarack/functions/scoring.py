"""Scores of texts: keywords, vectors, pages, units, and the terms of queries."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def _first_seen(items: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(items))


def query_terms(query: str, max_terms: int = 8) -> list[str]:
    """Distinct words of three characters or more; a query without any is its own term."""
    lowered = query.strip().lower()
    return _first_seen(re.findall(r"[a-z0-9_]{3,}", lowered))[:max_terms] or ([lowered] if lowered else [])


def query_terms_column(query: Column, max_terms: int = 8) -> Column:
    lowered = F.lower(F.btrim(query, F.lit(" \t\n\r\u000c\u000b")))
    terms = F.slice(F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]{3,}"), 0)), 1, max_terms)
    return F.when(F.size(terms) > 0, terms).when(lowered != "", F.array(lowered)).otherwise(F.array().cast("array<string>"))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def keyword_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains, whatever their case."""
    lowered = F.lower(text)
    return _sum([F.contains(lowered, F.lit(t)).cast("int") for t in terms])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if one is null, empty, zero, or of another length."""
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norm > 0), total(a, b) / norm).otherwise(F.lit(0.0))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def page_terms(query: str) -> list[str]:
    """The whole query, then its words of two characters or more; eight at most."""
    whole = " ".join(query.split()).lower()
    return _first_seen([whole, *re.findall(r"[\w一-鿿]{2,}", whole)])[:8] if whole else []


def page_score(body: Column, heading: Column, query: str) -> tuple[Column, Column, Column]:
    """(score, matches, start of the first term's first match or null) of a page.

    A hit of the whole query weighs 12, of a word 3, and 2 more in the heading.
    """
    body, heading = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(heading, F.lit("")))
    terms = page_terms(query)
    score, matches = [F.lit(0.0)], [F.lit(0)]
    for i, t in enumerate(terms):
        weight = 12.0 if i == 0 else 3.0
        in_body, in_heading = occurrences(body, t), occurrences(heading, t)
        score.append(in_body * weight + in_heading * (weight + 2.0))
        matches.append(in_body + in_heading)
    places = [F.when(F.instr(body, t) > 0, F.instr(body, t) - 1) for t in terms]
    return _sum(score), _sum(matches), F.coalesce(*places) if places else F.lit(None).cast("int")


def unit_terms(query: str) -> list[str]:
    return _first_seen(re.findall(r"[一-鿿]{2,}|[a-z0-9_]{3,}", query.strip().lower()))


def unit_score(text: Column, query: str) -> Column:
    """100 for the whole query, and for each term its length between 1 and 8."""
    lowered, whole = F.lower(text), query.strip().lower()
    if not whole:
        return F.lit(0)
    return _sum([F.contains(lowered, F.lit(whole)).cast("int") * 100] + [F.contains(lowered, F.lit(t)).cast("int") * max(1, min(len(t), 8)) for t in unit_terms(query)])


def excerpt_score(text: Column, excerpt: str) -> Column:
    """100 if the page contains the excerpt, and 1 for each of its words of four characters or more, repeated ones too."""
    squash = lambda s: " ".join(re.findall(r"[^\s]+", s.lower()))
    whole = squash(excerpt)
    page = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    terms = [t for t in re.findall(r"[a-z0-9]{4,}", whole) if t not in {"with", "from", "that", "this"}]
    return _sum([F.contains(page, F.lit(whole)).cast("int") * 100] + [F.contains(page, F.lit(t)).cast("int") for t in terms]) if whole else F.lit(0)
