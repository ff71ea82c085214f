"""Page features read from HTML, without a parser: patterns in the JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.keys import BLANK, text_or_empty, trimmed

_ENTITIES = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"))
_QUOTE, _NOT_QUOTE = "[\"']", "[^\"']"
_META = (
    ("property", "article:modified_time"),
    ("property", "og:updated_time"),
    ("property", "article:published_time"),
    ("name", "(?:date|last-modified|dcterms\\.modified)"),
)


#: Two blanks and more, or one that is no space: the single spaces, which are most blanks, are left as they are. A range that is tested first passes over letters.
_RUN = f"[\\s\\u00a0-\\uffff&&{BLANK}]{{2,}}|[\\t-\\r\\u00a0-\\uffff&&{BLANK}]"


def collapsed(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(text, _RUN, " ")


def to_text(html: Column) -> Column:
    """Visible text: no scripts and styles, tags as blanks, six entities decoded one after another."""
    s = text_or_empty(html)
    for tag in ("script", "style", "noscript"):
        s = F.regexp_replace(s, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for name, char in _ENTITIES:
        s = F.regexp_replace(s, f"(?i)&{name};", char)
    return F.trim(collapsed(s))


def has_schema_markup(html: Column) -> Column:
    s = text_or_empty(html)
    linked = s.rlike(f"(?i)<script\\b[^>]*\\btype\\s*=\\s*{_QUOTE}application/ld\\+json\\b{_NOT_QUOTE}*{_QUOTE}[^>]*>")
    items = s.rlike("(?i)\\bitemscope\\b") & s.rlike(f"(?i)\\bitemtype\\s*=\\s*{_QUOTE}{_NOT_QUOTE}*schema\\.org")
    return linked | items


def has_comparison_table(html: Column) -> Column:
    """A table whose first heading row has three heading cells, with two rows of data cells."""
    tables = F.regexp_extract_all(text_or_empty(html), F.lit("(?is)<table\\b.*?</table>"), 0)

    def compares(t: Column) -> Column:
        rows = F.regexp_extract_all(t, F.lit("(?is)<tr\\b.*?</tr>"), 0)
        headed = F.get(F.filter(rows, lambda r: r.rlike("(?i)<th\\b")), 0)
        return (F.coalesce(F.regexp_count(headed, F.lit("(?i)<th\\b")), F.lit(0)) >= 3) & (F.size(F.filter(rows, lambda r: r.rlike("(?i)<td\\b"))) >= 2)

    return F.exists(tables, compares)


def word_count(text: Column) -> Column:
    s = text_or_empty(text)
    seen = F.when(s.rlike("<[^>]+>"), to_text(s)).otherwise(s)
    return F.size(F.array_remove(F.split(collapsed(seen), " "), ""))  # a lambda here would read the text anew for each mention


def headings(html: Column) -> Column:
    """(h1, h2, h3): opening tags of each."""
    s = text_or_empty(html)
    return F.struct(*[F.regexp_count(s, F.lit(f"(?i)<h{i}\\b")).alias(f"h{i}") for i in (1, 2, 3)])


def heading_count(html: Column) -> Column:
    return F.regexp_count(text_or_empty(html), F.lit("(?i)<h[123]\\b"))


def last_modified(html: Column) -> Column:
    """The first of the known marks that holds anything, by rank of the mark; else null."""
    s = text_or_empty(html)
    content = f"\\bcontent\\s*=\\s*{_QUOTE}({_NOT_QUOTE}+){_QUOTE}"
    marks = [f"(?i)<meta\\b[^>]*\\b{a}\\s*=\\s*{_QUOTE}{v}{_QUOTE}[^>]*{content}" for a, v in _META]
    marks.append(f"(?i)<time\\b[^>]*\\bdatetime\\s*=\\s*{_QUOTE}({_NOT_QUOTE}+){_QUOTE}")
    return F.coalesce(*[F.nullif(trimmed(F.regexp_extract(s, m, 1)), F.lit("")) for m in marks])


#: Written dates, tried in turn after ISO ones; a weekday before them is passed over.
DATES = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyy/M/d", "M/d/yyyy")


def read_date(text: Column) -> Column:
    """A timestamp from ISO text, a mail or HTTP date, or a date written in English; else null."""
    bare = F.regexp_replace(trimmed(text), "^[A-Za-z]{3,9},\\s*", "")
    return F.coalesce(F.try_to_timestamp(trimmed(text)), *[F.try_to_timestamp(bare, F.lit(f)) for f in DATES])


def freshness_days(modified: Column, now: Column) -> Column:
    """Whole days from a date text to now; 0 if unreadable or in the future."""
    then = read_date(modified)
    days = F.floor((F.unix_millis(F.try_to_timestamp(now)) - F.unix_millis(then)) / F.lit(86_400_000))
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0)).cast("long")


def term_coverage(text: Column, terms: Column) -> Column:
    """Share of the distinct terms that the text holds: phrases anywhere, single words between non-letters."""
    low = F.lower(text_or_empty(text))
    own = F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(trimmed(t))), lambda t: t != ""))

    def within(t: Column) -> Column:
        safe = F.regexp_replace(t, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
        word = F.concat(F.lit("(^|[^a-z0-9])"), safe, F.lit("([^a-z0-9]|$)"))
        return F.when(t.rlike(BLANK), F.contains(low, t)).otherwise(F.regexp_like(low, word))

    return F.coalesce(F.try_divide(F.size(F.filter(own, within)), F.size(own)), F.lit(0.0))


def features(html: Column, now: Column, terms: Column, modified: Column | None = None, text: Column | None = None) -> Column:
    """A struct of the six features; an explicit date wins over the page's own, an explicit text over the one in the HTML."""
    text = to_text(html) if text is None else F.coalesce(text, to_text(html))
    date = last_modified(html) if modified is None else F.coalesce(modified, last_modified(html))
    return F.struct(
        has_schema_markup(html).alias("schema_markup"),
        has_comparison_table(html).alias("comparison_table"),
        word_count(text).cast("double").alias("word_count"),
        heading_count(html).cast("double").alias("heading_structure"),
        freshness_days(date, now).cast("double").alias("freshness_days"),
        term_coverage(text, terms).alias("query_term_coverage"),
    )
