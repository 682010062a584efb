"""Rows extracted from pages: texts, links, link–text pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html, text, urls
from linkloom.session import written
from linkloom.sources.tables import with_once


def link_text(pages: DataFrame, body_only: bool = False) -> DataFrame:
    """``(seq, link, text)`` for every page."""
    shown = html.page_body_text(F.col("html")) if body_only else html.page_text(F.col("html"))
    return with_once(pages, "text", shown).select(F.col("page_id").alias("seq"), F.col("url").alias("link"), "text")


def nonempty(pairs: DataFrame) -> DataFrame:
    """Pairs that have text."""
    return pairs.where(F.length("text") > 0)


class Readable(NamedTuple):
    texts: DataFrame
    links: DataFrame


def readable(pages: DataFrame) -> Readable:
    """Texts ``(seq, link, text)`` and links of the pages that have text; those of other pages are not followed.

    The texts are written, so that the pages are read for them once.
    """
    texts = written(nonempty(link_text(pages)), "texts")
    followed = pages.join(texts.select(F.col("seq").alias("page_id")).distinct(), "page_id", "left_semi")
    return Readable(texts, page_links(followed))


def page_links(pages: DataFrame, on_page: bool = False) -> DataFrame:
    """``(page_id, src_url, pos, href, url)`` per anchor, duplicates kept.

    Relative links are resolved on the site root, or like a browser on the
    page itself, or on the ``<base>`` that it names, with ``on_page``.
    """
    if on_page:
        pages = with_once(pages, "_base", urls.base_of_page(F.col("url"), html.page_base(F.col("html"))))
    base = [F.col("_base")] if on_page else []
    # The outer form keeps the optimizer from adding a size() filter that
    # would run the extraction a second time.
    anchors = pages.select(
        "page_id", F.col("url").alias("src_url"), *base, F.posexplode_outer(html.page_hrefs(F.col("html"))).alias("pos", "href")
    ).where(F.col("href").isNotNull())
    resolved = urls.resolve_on_page(F.col("_base"), F.col("href")) if on_page else urls.resolve_on_origin(F.col("src_url"), F.col("href"))
    return with_once(anchors, "url", resolved).drop("_base")


def valid_links(links: DataFrame) -> DataFrame:
    """Links that are neither null nor blank; what is kept is not trimmed."""
    return links.where(~text.is_blank(F.col("url")))
