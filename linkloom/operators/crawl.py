"""Breadth-first crawl over stored pages, round by round; a crawl with a state folder can be taken up again."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.dedup import first_seen, new_links
from linkloom.operators.extract import link_text, page_links, valid_links
from linkloom.operators.ordering import numbered
from linkloom.session import bucketed, bucketed_versions, scratch_path, shuffle_partitions, written
from linkloom.sources.tables import discard_above, store, stored

# From pulled sources (src, _at) to their links (src, url, pos, _at).
Outgoing = Callable[[DataFrame], DataFrame]

_VISITED = T.StructType([T.StructField("url", T.StringType())])
_ROUND = T.StructType([T.StructField("buckets", T.IntegerType())])
_QUEUED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("url", T.StringType())])
_TURN = T.StructType([T.StructField("done", T.LongType()), T.StructField("last", T.LongType())])
_BUDGET = {"queue": _QUEUED, "pulls": _QUEUED, "turns": _TURN}


class Round(NamedTuple):
    texts: DataFrame
    found: DataFrame


def seed(spark: SparkSession, *links: str) -> DataFrame:
    """A frontier ``(seq, url)`` of the given start links."""
    return spark.createDataFrame(list(enumerate(links, 1)), "seq bigint, url string")


def expand(frontier: DataFrame, pages: DataFrame, seen: DataFrame) -> Round:
    """One round: fetch the frontier's pages, take their texts and new links.

    The join comes before the extraction, so only fetched pages are parsed. A
    link is fetched once: of several stored copies the first is taken, picked
    on the narrow key columns before any HTML is read, and before the join, so
    that the copies of a link leave each map task as one row.
    """
    firsts = first_seen(pages.select("page_id", "url"), "url", ["page_id"])
    chosen = firsts.join(frontier.select("url").distinct(), "url", "left_semi").select("page_id")
    fetched = pages.select("page_id", "url", "html").join(chosen, "page_id", "left_semi")
    links = valid_links(page_links(fetched)).select(F.col("page_id").alias("seq"), "pos", "url")
    return Round(link_text(fetched), new_links(links, seen))


def link_graph(pages: DataFrame) -> DataFrame:
    """Written table ``(src, pos, url)`` of distinct links per page.

    One pass over the pages; the rounds of a crawl then read only this. Copies
    of a page collapse in the partial aggregation.
    """
    links = valid_links(page_links(pages)).select(F.col("src_url").alias("src"), "url", "pos")
    return written(links.groupBy("src", "url").agg(F.min("pos").alias("pos")), "graph")


def _deadline(seconds: float | None) -> float:
    return math.inf if seconds is None else time.monotonic() + seconds


def reached(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Distinct ``(url)`` that edges ``(src, url)`` lead to from the frontier ``(src)``."""
    return edges.join(frontier, "src").select("url").distinct()


def from_graph(graph: DataFrame) -> Outgoing:
    """Links of pulled sources from a link graph."""
    return lambda sources: graph.join(sources, "src").select("src", "url", "pos", "_at")


def from_pages(pages: DataFrame) -> Outgoing:
    """Links of pulled sources from stored pages: only the pages pulled are read and parsed.

    The first copy of every page is found once and stored by link; the rounds leave it where it is.
    """
    spark = pages.sparkSession
    firsts = first_seen(pages.select("page_id", "url"), "url", ["page_id"])
    firsts = bucketed(firsts, "url", shuffle_partitions(spark), "first-pages")

    def outgoing(sources: DataFrame) -> DataFrame:
        chosen = written(firsts.join(sources, firsts["url"] == sources["src"]).select("page_id", "_at"), "pulled")
        fetched = pages.join(chosen.select("page_id"), "page_id", "left_semi")
        links = valid_links(page_links(fetched)).join(chosen, "page_id")
        return links.select(F.col("src_url").alias("src"), "url", "pos", "_at")

    return outgoing


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """The ``found(url)`` that are not visited yet."""
    return found.join(visited.select("url"), "url", "left_anti")


def _newest(marks: DataFrame, version: str):
    """The newest mark, or None. A crawl has few rounds, and a mark is one row."""
    rows = marks.orderBy(F.desc(version)).limit(1).collect()
    return rows[0] if rows else None


def reach(
    graph: DataFrame,
    seeds: DataFrame,
    max_rounds: int | None = None,
    seconds: float | None = None,
    state: str | None = None,
) -> DataFrame:
    """``(url, depth)`` of everything reachable, at its smallest depth.

    Seeds count as seen. No round starts after ``max_rounds`` rounds or when
    ``seconds`` have passed; what was reached until then is whole. Each round is stored as one version and read back, so
    plans stay small and a lost executor costs one round at most. Edges and visited links are stored in buckets:
    a round shuffles what it finds, nothing else.

    With a ``state`` folder the crawl goes on after the last whole round found there; then
    ``max_rounds`` counts the rounds before, too, and the seeds are those it began with.
    """
    spark = graph.sparkSession
    kept, state = state is not None, state or scratch_path(spark, "reach")
    path, marks = f"{state}/visited", f"{state}/rounds"
    edges = bucketed(graph.select("src", "url"), "src", shuffle_partitions(spark), "edges")
    newest = _newest(stored(spark, marks, _ROUND, "depth"), "depth") if kept else None
    depth, buckets = (newest["depth"], newest["buckets"]) if newest else (-1, shuffle_partitions(spark))
    discard_above(spark, path, depth)  # a round that was cut short
    deadline = _deadline(seconds)

    def add(links: DataFrame) -> None:
        links.select("url", F.lit(depth + 1).cast("bigint").alias("depth")).write.insertInto(name)
        if kept:  # a folder of this call's own is never taken up again
            store(spark.createDataFrame([(buckets,)], _ROUND), marks, depth + 1, "depth")

    with bucketed_versions(spark, path, "url", "depth", buckets) as name:
        if depth < 0:
            add(seeds.select("url").distinct())
            depth = 0
        while (max_rounds is None or depth < max_rounds) and time.monotonic() < deadline:
            visited = spark.table(name)
            frontier = visited.where(F.col("depth") == depth).select(F.col("url").alias("src"))
            if frontier.isEmpty():
                break
            add(unvisited(reached(edges, frontier), visited))
            depth += 1
    return stored(spark, path, _VISITED, "depth").select("url", F.col("depth").cast("int").alias("depth"))


#: What a snapshot keeps of ``reach``.
REACHED = T.StructType([*_VISITED.fields, T.StructField("depth", T.LongType())])


def reached_links(spark: SparkSession, state: str) -> DataFrame:
    """``(url, depth)`` of the whole rounds in a state folder of ``reach``: what a snapshot keeps."""
    newest = _newest(stored(spark, f"{state}/rounds", _ROUND, "depth"), "depth")
    visited = stored(spark, f"{state}/visited", _VISITED, "depth")
    return visited.where(F.col("depth") <= (newest["depth"] if newest else -1))


def restore_reached(spark: SparkSession, state: str, visited: DataFrame) -> None:
    """Set up a fresh state folder of ``reach`` from ``(url, depth)`` that a snapshot kept."""
    buckets = shuffle_partitions(spark)
    last = visited.agg(F.max("depth")).first()[0]
    if last is None:
        return
    with bucketed_versions(spark, f"{state}/visited", "url", "depth", buckets) as name:
        rows = visited.select("url", F.col("depth").cast("bigint").alias("depth"))
        rows.repartition(buckets, "url").write.insertInto(name)
    store(spark.createDataFrame([(buckets,)], _ROUND), f"{state}/rounds", last, "depth")


def budgeted(
    outgoing: Outgoing,
    seeds: DataFrame,
    limit: int,
    rounds: int,
    seconds: float | None = None,
    seed_is_seen: bool = True,
    state: str | None = None,
) -> DataFrame:
    """``(round, seq, url)``: links pulled when each round takes at most ``limit``.

    The queue is first in, first out: what a round finds is appended behind
    what waits, ordered by the page that found it and the place on it. A link
    without a stored page uses its turn and yields nothing. The queue is
    numbered from 1 without gaps, so a round's pull is a range of ``seq``.
    Without ``seed_is_seen`` a page that links to a seed enqueues it once more.

    With a ``state`` folder the crawl goes on after the last whole round found there; then
    ``rounds`` counts the rounds before, too, and the seeds are those it began with.
    """
    spark = seeds.sparkSession
    kept, state = state is not None, state or scratch_path(spark, "budget")
    queue_path, pulls_path, turns_path = f"{state}/queue", f"{state}/pulls", f"{state}/turns"
    deadline = _deadline(seconds)

    def end(turn: int, done: int, last: int) -> int:
        """Mark a round as whole, in a folder that is kept; returns the last number in the queue."""
        added = stored(spark, queue_path, _QUEUED, "round").where(F.col("round") == turn)
        last = added.agg(F.max("seq")).first()[0] or last
        if kept:
            store(spark.createDataFrame([(done, last)], _TURN), turns_path, turn, "round")
        return last

    newest = _newest(stored(spark, turns_path, _TURN, "round"), "round") if kept else None
    if newest:
        turn, done, last = newest["round"], newest["done"], newest["last"]
    else:
        first = first_seen(seeds, "url", ["seq"]).withColumnRenamed("seq", "_at")
        store(numbered(first, ["_at"], "seq").select("seq", "url"), queue_path, 0, "round")
        turn, done, last = 0, 0, end(0, 0, 0)
    while turn < rounds and time.monotonic() < deadline:
        upto = min(done + limit, last)
        if upto == done:
            break
        queue = stored(spark, queue_path, _QUEUED, "round").where(F.col("round") <= turn)
        seen = queue if seed_is_seen else queue.where(F.col("round") > 0)
        pulled = queue.where(F.col("seq").between(done + 1, upto))
        turn += 1
        store(pulled.select("seq", "url"), pulls_path, turn, "round")
        sources = pulled.select(F.col("url").alias("src"), F.col("seq").alias("_at"))
        links = outgoing(sources).select("url", F.col("_at").alias("seq"), "pos")
        fresh = new_links(links, seen).withColumnRenamed("seq", "_at")
        store(numbered(fresh, ["_at", "pos"], "seq", last + 1).select("seq", "url"), queue_path, turn, "round")
        done, last = upto, end(turn, upto, last)
    pulls = stored(spark, pulls_path, _QUEUED, "round").where(F.col("round") <= turn)
    return pulls.select(F.col("round").cast("int").alias("round"), "seq", "url")


#: Parts of a budgeted crawl's state, as a snapshot keeps them.
BUDGET_PARTS = {name: T.StructType([*schema.fields, T.StructField("round", T.LongType())]) for name, schema in _BUDGET.items()}


def budget_parts(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    """Queue, pulls and marks of the whole rounds in a state folder of ``budgeted``: what a snapshot keeps."""
    newest = _newest(stored(spark, f"{state}/turns", _TURN, "round"), "round")
    whole = F.col("round") <= (newest["round"] if newest else -1)
    return {name: stored(spark, f"{state}/{name}", schema, "round").where(whole) for name, schema in _BUDGET.items()}


def restore_budget(state: str, **parts: DataFrame) -> None:
    """Set up a fresh state folder of ``budgeted`` from the parts that a snapshot kept."""
    for name in BUDGET_PARTS:  # the marks come last
        parts[name].write.partitionBy("round").mode("overwrite").parquet(f"{state}/{name}")
