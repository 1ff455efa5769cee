r"""Text expressions: markdown and HTML, headings, excerpts, file names, detectors.

White space is ASCII throughout (space, \t, \n, \r, \f, \v), on purpose: it is what
the patterns of both Spark and SQL engines mean by \s.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

SPACE = " \t\n\r\u000c\u000b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), F.lit(" "))


def normalize_markdown(text: Column) -> Column:
    """Line feeds only, no trailing space on a line, at most one blank line, none at the ends."""
    t = F.regexp_replace(text, "\r\n", "\n")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+(\n|\z)", "$1")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def derive_heading(text: Column) -> Column:
    """The first line that starts with #, without them; else the first line if it has 1 to 90 characters; else null."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), strip)
    marked = F.filter(lines, lambda x: x.startswith("#"))
    first = F.get(lines, F.lit(0))
    return F.when(F.size(marked) > 0, F.nullif(strip(F.ltrim(F.get(marked, F.lit(0)), F.lit("#"))), F.lit(""))).when(F.length(first).between(1, 90), first)


def unescape_entities(text: Column) -> Column:
    """HTML's named and numbered entities as characters; there is no built-in for all of them."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)


#: Tags without attributes that end a line.
BLOCK_TAGS = "h[1-6]|p|div|li|br|tr|td|th|table|ul|ol|section|article"
#: What of a page is dropped with its content, and what is a tag.
SCRIPTS, TAGS = r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", r"(?s)<[^>]+>"
#: Entities that common pages have; texts with others go through ``unescape_entities``.
COMMON_ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def html_to_markdown(page: Column, all_entities: bool = True) -> Column:
    """Tags gone, block tags as line ends, scripts and styles dropped, entities as characters.

    ``all_entities=False`` knows the common entities only and stays free of Python.
    """
    t = F.regexp_replace(page, SCRIPTS, "")
    t = F.regexp_replace(t, rf"(?i)</?({BLOCK_TAGS})>", "\n")
    t = F.regexp_replace(t, TAGS, "")
    if all_entities:
        return unescape_entities(t)
    for name, char in COMMON_ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def excerpt(text: Column, limit: int = 320) -> Column:
    """Squashed, and cut with an ellipsis behind."""
    t = squash(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def snippet(text: Column, limit: int = 220) -> Column:
    """Squashed, and cut so that the ellipsis fits the limit."""
    t = squash(text)
    return F.when(F.length(t) > limit, F.concat(rstrip(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def match_snippet(text: Column, match_start: Column, window: int = 180) -> Column:
    """What stands around a match (0-based, null for none), with ellipses where text is left out.

    The place counts in the unstripped text though the stripped one is cut, as callers expect.
    """
    body = strip(F.coalesce(text, F.lit("")))
    start = F.greatest(match_start - window, F.lit(0))
    end = F.least(match_start + window, F.length(body))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(body, start + 1, F.greatest(end - start, F.lit(0))), F.when(end < F.length(body), "...").otherwise(""))
    return F.when(body == "", "").otherwise(squash(F.when(match_start.isNull(), F.substring(body, 1, 2 * window)).otherwise(cut)))


def preview(text: Column, limit: int = 3000) -> Column:
    """The first characters, with a note of the whole length if there are more."""
    # fixed format of the note
    note = F.concat(F.lit("\n\n[... PREVIEW TRUNCATED. Full document has "), F.format_number(F.length(text), 0), F.lit(" characters. Use parse_file() to read the complete document ...]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


#: Amounts with a dollar sign; ISO dates and English month-name dates.
CURRENCY = r"\$\s?\d[\d,]*(?:\.\d+)?"
DATE = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s+\d{4})\b"


def mentions_currency(text: Column) -> Column:
    return text.rlike(CURRENCY)


def mentions_dates(text: Column) -> Column:
    return text.rlike(DATE)


#: Words of file names that don't say what a document is.
STOP_WORDS = ("the", "and", "for", "with", "from", "copy", "draft", "final", "version", "v1", "v2", "v3", "new", "old", "tmp", "temp")


def document_type(relative_path: Column) -> Column:
    """The last word of the file's stem that is not a number, longer than 2 and no stop word; else its last word; else 'document'."""
    stem = F.regexp_replace(F.regexp_replace(relative_path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    words = F.regexp_extract_all(F.lower(stem), F.lit("[a-z0-9]+"), 0)
    telling = F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.coalesce(F.try_element_at(telling, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit("document"))


def sanitize_filename(name: Column) -> Column:
    # nothing is left of a name without these; asking the cleaned name would clean it twice
    return F.when(~name.rlike("[A-Za-z0-9_]"), "document").otherwise(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), F.lit("-.")))


def valid_storage_name(name: Column) -> Column:
    return (strip(name) != "") & ~name.rlike(r'[\\/:*?"<>|]')


def front_matter(text: Column) -> Column:
    """map of ``key: value`` lines between --- lines at the start; empty without them."""
    body = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)), F.btrim(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), F.lit('"'))))
    # a key that comes twice has its last value
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.greatest(F.size(entry), F.lit(1))), lambda o: o["col1"] == e["col1"]))
    return F.map_from_entries(last)


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n+", "")


def page_key(filename: Column, page_no: Column) -> Column:
    return F.format_string("documents/%s/pages/page-%04d.md", filename, page_no)


def page_body(text: Column) -> Column:
    """Stripped, with a line feed behind unless empty."""
    t = strip(text)
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def cited_sources(answer: Column) -> Column:
    """The distinct labels of [Source: ...] in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"\[Source:\s*([^,\]]+)"), 1), strip), lambda s: s != ""))
