"""Boilerplate lines by their frequency relative to the site.

A line is boilerplate on a host if more than a given share of the host's pages contain it, and at least two do: what
stands on one page repeats nothing. At most (mean distinct lines of a page) / share lines of a host can be
boilerplate, however many pages it has, so the list of a host stays small and travels to its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.plans.checkpoint import durable
from recall.plans.grouping import grouped

RATIO = 0.05
#: Pages that a line must be on, whatever its share.
MIN_PAGES = 2
#: Boilerplate of all hosts up to this many characters is broadcast, more is joined by a shuffle.
BROADCAST_CHARS = 4_000_000
RESULT = ("host", "n_lines", "n_dropped", "text")

UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|title|head|body|html|nav|header|footer|article|section|aside|main|table|tr|td|th|blockquote|pre|form)\b[^>]*>"
TAGS = r"<[^>]*>"
# Named characters of HTML; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def host(url: Column) -> Column:
    """Lower-case host name of a URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def html_lines(html: Column) -> Column:
    """Visible lines of a page, white space collapsed, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text_lines(text)


def text_lines(text: Column) -> Column:
    """Lines of a plain text, white space collapsed, without empty ones."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\f]+", " "), "\n")
    # Not F.trim itself: a function of two arguments would get the line's place as the characters to trim.
    return F.filter(F.transform(lines, lambda line: F.trim(line)), lambda line: line != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(``host``, ``line``, ``n_with``, ``n_pages``) of the lines on over ``ratio`` of a host's pages.

    ``pages`` has ``host`` and ``lines``; each row is a page. The lines must be on ``min_pages`` pages as well.
    The empty host has no boilerplate: it stands for pages whose host is not known.
    """
    pages = pages.where("host != ''")
    totals = grouped(pages, ["host"], F.count(F.lit(1)).alias("n_pages"))
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = grouped(lines, ["host", "line"], F.count(F.lit(1)).alias("n_with")).where(F.col("n_with") >= min_pages)
    return counts.join(totals, "host").where(F.col("n_with") > ratio * F.col("n_pages"))


def drop_boilerplate(
    pages: DataFrame, lines: Column, host_name: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """Per row of ``pages``: the columns ``keep``, ``host``, ``n_lines``, ``n_dropped`` and the ``text`` of the other lines.

    Null pages are empty ones and give an empty text. Rows repeated in the input are pages of their own,
    a line repeated within a page counts once for its host and is dropped at every place. Pages may be of any
    length; their lines are looked at one by one. Columns of ``keep`` that have the name of a result
    give way to it; other columns are ignored. An empty table gives an empty result.
    """
    keep = tuple(c for c in keep if c.lower() not in RESULT)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    cut = durable(pages.select(kept.alias("kept"), host_name.alias("host"), lines.alias("lines")))
    found = durable(boilerplate(cut, ratio, min_pages).select("host", "line"))
    chars = found.agg(F.sum(F.length("line") + F.length("host"))).first()[0] or 0
    by_host = found.groupBy("host").agg(F.collect_list("line").alias("_dropped"))
    if chars <= BROADCAST_CHARS:
        by_host = F.broadcast(by_host)
    joined = cut.join(by_host, "host", "left")
    left = F.filter("lines", lambda line: ~F.coalesce(F.array_contains("_dropped", line), F.lit(False)))
    return joined.withColumn("_left", left).select(
        *(F.col("kept")[c].alias(c) for c in keep),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_left")).cast("long").alias("n_dropped"),
        F.array_join("_left", "\n").alias("text"),
    )
