"""Inverted index, link and tag tables, their junction, and searches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.dedup import first_seen
from linkloom.operators.ordering import numbered
from linkloom.session import written


class Star(NamedTuple):
    """links ``(id, link)``, tags ``(id, tag)``, junction ``(link_id, tag_id)``."""

    links: DataFrame
    tags: DataFrame
    junction: DataFrame


def tag_index(link_tags: DataFrame) -> DataFrame:
    """``(tag, link, popularity)``: how often the link was given the tag."""
    return link_tags.groupBy("tag", "link").agg(F.count("*").alias("popularity"))


def by_tag(index: DataFrame) -> DataFrame:
    """Sorted by tag, so a lookup in the written table prunes files and row groups by their ranges.

    The range also splits on the link: a common tag spans several files.
    """
    return index.repartitionByRange("tag", "link").sortWithinPartitions("tag", "link")


def write_tag_index(index: DataFrame, path: str) -> None:
    """Written as ``by_tag`` sorts it."""
    by_tag(index).write.mode("overwrite").parquet(path)


def links_by_tag(index: DataFrame, tag: str) -> DataFrame:
    """``(link, popularity)`` of one tag; none for an unknown tag."""
    return index.where(F.col("tag") == tag).select("link", "popularity")


def first_values(link_tags: DataFrame, column: str) -> DataFrame:
    """Distinct links or tags with where they came first."""
    return first_seen(link_tags, column, ["seq", "rank"])


def with_ids(values: DataFrame, column: str, last_id: int = 0) -> DataFrame:
    """``(id, column)`` numbered in order of first arrival after ``last_id``."""
    # A link arrives once per tag and several tags arrive with one link; the
    # value itself settles what seq and rank leave open.
    return numbered(values, ["seq", "rank", column], "id", last_id + 1).select("id", column)


def junction_rows(link_tags: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct ``(link_id, tag_id)``.

    Pairs are made distinct before the id lookups; a common tag is left to
    adaptive skew splitting, one match per row either way.
    """
    pairs = link_tags.select("link", "tag").distinct()
    link_ids = links.select(F.col("id").alias("link_id"), "link")
    tag_ids = tags.select(F.col("id").alias("tag_id"), "tag")
    return pairs.join(link_ids, "link").join(tag_ids, "tag").select("link_id", "tag_id")


def build_star(link_tags: DataFrame) -> Star:
    """The three tables of a batch, from nothing.

    The tags are written once, as all three tables derive from them.
    """
    rows = written(link_tags, "link_tags")
    links = with_ids(first_values(rows, "link"), "link")
    tags = with_ids(first_values(rows, "tag"), "tag")
    return Star(links, tags, junction_rows(rows, links, tags))


def delete_links(star: Star, doomed: DataFrame) -> Star:
    """Without the links of ``doomed(link)`` and their junction rows."""
    gone = star.links.join(doomed.select("link"), "link", "left_semi")
    return Star(
        star.links.join(doomed.select("link"), "link", "left_anti").select("id", "link"),
        star.tags,
        star.junction.join(gone.select(F.col("id").alias("link_id")), "link_id", "left_anti"),
    )


def delete_tags(star: Star, doomed: DataFrame) -> Star:
    """Without the tags of ``doomed(tag)`` and their junction rows."""
    gone = star.tags.join(doomed.select("tag"), "tag", "left_semi")
    return Star(
        star.links,
        star.tags.join(doomed.select("tag"), "tag", "left_anti").select("id", "tag"),
        star.junction.join(gone.select(F.col("id").alias("tag_id")), "tag_id", "left_anti").select("link_id", "tag_id"),
    )


def search_all(star: Star) -> DataFrame:
    """``(tag, link)`` of every junction row."""
    tags = star.tags.select(F.col("id").alias("tag_id"), "tag")
    links = star.links.select(F.col("id").alias("link_id"), "link")
    return tags.join(star.junction, "tag_id").join(links, "link_id").select("tag", "link")


def search(star: Star, wanted: list[str]) -> DataFrame:
    """``(tag, link)`` for the wanted tags, over the junction."""
    return search_all(star._replace(tags=star.tags.where(F.col("tag").isin(wanted))))
