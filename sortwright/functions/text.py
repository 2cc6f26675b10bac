"""Text clean-up, HTML and notebook text, RTF, and the strings inside binaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = r"^\s+|\s+$"
# What is cut out of markup and rich text, and what counts as text within a binary.
HIDDEN = r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>"
TAGS = r"(?s)<[^>]+>"
RTF_BYTE = r"\\'[0-9a-f]{2}"
RTF_WORD = r"\\[a-z]+-?\d* ?|[{}]"
PRINTABLE = "[ -~]{6,}"
WORDLIKE = "[A-Za-z]{4,}"
#: Entities of the built-in decoder, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def squash(text: Column) -> Column:
    """Runs of blanks become one, runs of blank lines one line break, ends are trimmed; null is empty."""
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\u00a0]+", " ")
    return trim(F.regexp_replace(blanks, r"\n\s*\n+", "\n"))


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(raw: Column) -> Column:
    """Scripts, styles and drawings go with what they hold; other tags become blanks."""
    return unescape(F.regexp_replace(F.regexp_replace(raw, HIDDEN, " "), TAGS, " "))


def html_title(raw: Column) -> Column:
    """The text of the first title element; empty if there is none."""
    inner = F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return trim(unescape(F.regexp_replace(inner, "<[^>]+>", "")))


def html_text(raw: Column, limit: int = 200_000) -> Column:
    head = F.substring(raw, 1, limit)
    title = html_title(head)
    return F.concat(F.when(title != "", F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise(""), strip_tags(head))


def human_size(size: Column) -> Column:
    return (
        F.when(size > 1e9, F.format_string("%.1f GB", size / 1e9)).when(size > 1e6, F.format_string("%.1f MB", size / 1e6))
        .otherwise(F.format_string("%.0f KB", F.bround(F.greatest(size, F.lit(1)) / 1e3, 0)))
    )


def described(kind: Column, size: Column, modified: Column, body: Column, limit: int = 2000) -> Column:
    """The description line, then the squashed body; the whole is cut at limit. A null size leaves out size and date."""
    known = F.when(size.isNotNull(), F.concat(F.lit(". Size: "), human_size(size), F.lit(". Modified: "), F.coalesce(F.date_format(modified, "yyyy-MM-dd"), F.lit("unknown")))).otherwise("")
    text = squash(body)
    return F.substring(F.concat(F.lit("Type: "), kind, known, F.lit("."), F.when(text != "", F.concat(F.lit("\n"), text)).otherwise("")), 1, limit)


def clip(text: Column, n: int) -> Column:
    flat = trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 1), F.lit("…")))


def first_line(text: Column) -> Column:
    """The first line that says something beyond type and size."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trim)
    return F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("Type:") & ~x.startswith("Size:")), F.lit(0)), F.lit(""))


def meter(confidence: Column, width: int = 5) -> Column:
    full = F.bround(confidence * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("●"), full), F.repeat(F.lit("○"), F.lit(width) - full))
