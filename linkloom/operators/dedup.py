"""First-seen deduplication of links and texts.

A first occurrence is a minimum, so it is found by a partial aggregation: a
link that holds a third of all rows leaves each map task as one row. Rows are
flagged by joining on their own unique order, never on the hot value.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import text_hash
from linkloom.operators.ordering import numbered
from linkloom.session import written


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``(key, *order)`` of the first row of every key."""
    if len(order) == 1:
        return rows.groupBy(key).agg(F.min(order[0]).alias(order[0]))  # a plain hash aggregation
    first = F.min(F.struct(*order)).alias("_first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"_first.{name}") for name in order])


def new_links(links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First occurrence ``(url, seq, pos)`` of each link that is not in ``seen``."""
    firsts = first_seen(links, "url", ["seq", "pos"])
    return firsts if seen is None else firsts.join(seen.select("url"), "url", "left_anti")


def enqueue(links: DataFrame, start: int = 1) -> DataFrame:
    """Surviving links in arrival order as ``(seq, url)``, ``seq`` dense."""
    ordered = numbered(links.select("url", F.col("seq").alias("_at"), "pos"), ["_at", "pos"], "seq", start)
    return ordered.select("seq", "url")


def new_texts(texts: DataFrame, seen_hashes: DataFrame | None = None) -> DataFrame:
    """``(text_hash, seq)`` of the first row with each text not seen before."""
    hashed = texts.select("seq", text_hash(F.col("text")).alias("text_hash"))
    firsts = first_seen(hashed, "text_hash", ["seq"])
    return firsts if seen_hashes is None else firsts.join(seen_hashes.select("text_hash"), "text_hash", "left_anti")


class Stages(NamedTuple):
    """What is left after each stage, as ``(seq, url, text_hash)``."""

    new_link: DataFrame
    new_text: DataFrame
    passed: DataFrame


def validate(
    rows: DataFrame,
    seen_links: DataFrame | None = None,
    seen_hashes: DataFrame | None = None,
    stored_links: DataFrame | None = None,
) -> Stages:
    """Run rows ``(seq, url, text_hash)`` through the stages in order.

    A row that fails one stage does not count as seen in the next: session
    links, then text hashes, then stored links. What passes a stage is written,
    so that each is run once whatever is read of the result.
    """
    new_link = first_seen(rows, "url", ["seq", "text_hash"])
    if seen_links is not None:
        new_link = new_link.join(seen_links.select("url"), "url", "left_anti")
    new_link = written(new_link.select("seq", "url", "text_hash"), "new-link")
    new_text = first_seen(new_link, "text_hash", ["seq", "url"])
    if seen_hashes is not None:
        new_text = new_text.join(seen_hashes.select("text_hash"), "text_hash", "left_anti")
    passed = new_text = written(new_text.select("seq", "url", "text_hash"), "new-text")
    if stored_links is not None:
        passed = passed.join(stored_links.select("url"), "url", "left_anti")
    return Stages(new_link, new_text, passed.select("seq", "url", "text_hash"))


def validation_report(
    rows: DataFrame,
    seen_links: DataFrame | None = None,
    seen_hashes: DataFrame | None = None,
    stored_links: DataFrame | None = None,
) -> DataFrame:
    """Which stage each row ``(seq, url, text_hash)`` fails, null when it passes."""
    stages = validate(rows, seen_links, seen_hashes, stored_links)
    reached = (
        stages.new_link.select("seq", F.lit(1).alias("stage"))
        .unionByName(stages.new_text.select("seq", F.lit(2).alias("stage")))
        .unionByName(stages.passed.select("seq", F.lit(3).alias("stage")))
        .groupBy("seq")
        .agg(F.max("stage").alias("stage"))
    )
    failed = (
        F.when(F.col("stage").isNull(), "seen_link")
        .when(F.col("stage") == 1, "seen_text")
        .when(F.col("stage") == 2, "stored_link")
    )
    return rows.select("seq", "url").join(reached, "seq", "left").select("seq", "url", failed.alias("failed_stage"))
