"""Records from HTML cards of search results, by expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the parts of a card.
_PARTS = {
    "post_id": r'mid="(\d+)"',
    "author_name": r'nick-name="([^"]*)"',
    "text": r'(?s)<p[^>]*class="txt"[^>]*>(.*?)</p>',
    "reposts": r"转发\s*(\d*)",
    "comments": r"评论\s*(\d*)",
    "likes": r'(?s)class="woo-like-count"[^>]*>\s*(\d*)',
}


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def resolved(c: Column) -> Column:
    """The common entities resolved, each once."""
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column) -> Column:
    """Text as it stands in a page; the inverse of `resolved`."""
    for a, b in reversed(_ENTITIES[1:]):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def plain(c: Column) -> Column:
    """Text without tags and with the common entities resolved."""
    return F.trim(resolved(F.regexp_replace(c, r"(?s)<[^>]*>", "")))


def cards(df: DataFrame, html: str) -> DataFrame:
    """One row for each card of a page: id, author, text, counts (null where there is no number)."""
    card = df.select(F.explode(F.filter(F.split(html, r'(?=<div class="card-wrap")'), lambda s: s.contains("mid="))).alias("card_"))
    cols = {k: F.regexp_extract("card_", p, 1) for k, p in _PARTS.items()}
    cols["text"], cols["author_name"] = plain(cols["text"]), resolved(cols["author_name"])
    return card.select(*((c.try_cast("bigint") if k in ("reposts", "comments", "likes") else F.nullif(c, F.lit(""))).alias(k) for k, c in cols.items()))
