"""Pipelines from stored pages or documents to tags and the link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkloom.operators import index, tags


def tagged(docs: DataFrame, count: int = 5, placed: bool = False) -> DataFrame:
    """``(seq, link, rank, tag)``: every document tagged as it arrives; ``placed`` as in ``block_table``."""
    blocks = tags.block_table(docs, placed)
    return tags.link_tags(blocks, tags.top_terms(tags.best_scores(blocks, count), count))


def indexed(docs: DataFrame, count: int = 5, placed: bool = False) -> DataFrame:
    """Inverted index of the documents' tags."""
    return index.tag_index(tagged(docs, count, placed))


def star(docs: DataFrame, count: int = 5, placed: bool = False) -> index.Star:
    """Link, tag and junction tables of the documents' tags."""
    return index.build_star(tagged(docs, count, placed))
