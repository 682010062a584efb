"""Micro-batch handlers whose state is versioned tables.

A batch reads only versions below its own and replaces its own, so running it
again after a failure changes nothing. One writer per state folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import schemas
from linkloom.operators import dedup, index, membership, tags
from linkloom.operators.dedup import first_seen
from linkloom.session import written
from linkloom.sources.tables import (
    all_versions, create_if_absent, discard_below, exclude_stored, fold, newest_fold, store, stored, versions_below,
)
from linkloom.streaming.drivers import BatchHandler

PRELOAD = -1

_LAST = T.StructType([T.StructField("last", T.LongType())])


def _last_id(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("last").alias("last"))


# ---- stored keys -------------------------------------------------------------

#: Tables that batches look their keys up in: each fold has a membership filter and is stored in slices of the key.
KEYS = {"seen_links": "url", "urls": "url", "hashes": "text_hash"}


def _guarded_fold(spark: SparkSession, path: str, schema: T.StructType, upto: int, key: str) -> None:
    """Fold a table of distinct keys, the filter first: the mark of the fold makes readers use both."""
    if newest_fold(spark, path, upto + 1) != upto:
        rows = versions_below(spark, path, schema, upto + 1)
        count = rows.count()
        store(membership.build(rows, key, count), f"{path}_members", upto, "upto")
        slices = membership.sizes(count)[1]
    else:
        slices = 1  # that fold is there, only its remains go

    def sliced(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slice", membership.slice_of(key, slices)).hint("rebalance", F.col("slice"))

    fold(spark, path, schema, upto, sliced, ["slice"])
    discard_below(spark, f"{path}_members", upto)


def known_keys(candidates: DataFrame, path: str, schema: T.StructType, key: str, below: int) -> DataFrame:
    """Keys of versions below ``below`` that ``candidates`` may have, all that they do have among them.

    The filter of the newest fold is asked first. Of the fold only the slices of keys that it may hold
    are read, none if it surely holds no candidate; versions since are read whole.
    """
    spark = candidates.sparkSession
    base = newest_fold(spark, path, below)
    members = None if base is None else stored(spark, f"{path}_members", membership.FILTER, "upto").where(F.col("upto") == base)
    found = None if members is None else members.select("blocks", "slices").first()
    if found is None:
        return versions_below(spark, path, schema, below).select(key)
    maybe = membership.may_hold(candidates.select(key), members, key, found.blocks)
    # At most membership.SLICES numbers.
    slices = [row[0] for row in maybe.select(membership.slice_of(key, found.slices)).distinct().collect()]
    since = stored(spark, path, schema).where((F.col("batch_id") > base) & (F.col("batch_id") < below))
    if not slices:
        return since.select(key)
    sliced = T.StructType([*schema.fields, T.StructField("slice", T.IntegerType())])
    folded = stored(spark, f"{path}_folded", sliced, "upto").where((F.col("upto") == base) & F.col("slice").isin(slices))
    return since.select(key).unionByName(folded.select(key))


# ---- links seen so far -------------------------------------------------------


def seen_links(spark: SparkSession, state: str) -> DataFrame:
    return all_versions(spark, f"{state}/seen_links", schemas.SEEN_LINKS)


def remember_links(state: str, links: DataFrame, batch_id: int) -> None:
    """Store the links ``(seq, pos, url)`` of a batch that no earlier batch had."""
    firsts = written(first_seen(links, "url", ["seq", "pos"]).select("seq", "pos", "url"), "links")
    known = known_keys(firsts, f"{state}/seen_links", schemas.SEEN_LINKS, "url", batch_id)
    store(exclude_stored(firsts, known, "url"), f"{state}/seen_links", batch_id)


def preload_links(state: str, links: DataFrame) -> None:
    """Let stored links count as seen from the start: a batch before the first."""
    remember_links(state, links, PRELOAD)


def keyed_links(links: DataFrame) -> DataFrame:
    """First place of every link of a stream ``(seq, pos, url)``, kept by Spark as state of the link: ``(url, seq, pos, upto)``.

    To be run in update mode, with ``remember_keyed``. A batch reads the state of its own links, never the stored
    links; copies of a link collapse before the shuffle. ``upto`` is the last ``seq`` that had it.
    """
    first, upto = F.min(F.struct("seq", "pos")).alias("_first"), F.max("seq").alias("upto")
    return links.groupBy("url").agg(first, upto).select("url", "_first.seq", "_first.pos", "upto")


def remember_keyed(state: str, links: DataFrame, batch_id: int) -> None:
    """Store what ``keyed_links`` saw first in this batch, as ``remember_links`` does.

    An update holds every link of the batch; a known one still has its first place, which is at most
    the last ``seq`` of the batches before.
    """
    spark = links.sparkSession
    rows = written(links, "links")
    before = _last_id(versions_below(spark, f"{state}/seen_links_last", _LAST, batch_id)).first()[0]
    fresh = rows if before is None else rows.where(F.col("seq") > before)
    store(fresh.select("seq", "pos", "url"), f"{state}/seen_links", batch_id)
    store(_last_id(rows.withColumnRenamed("upto", "last")), f"{state}/seen_links_last", batch_id)


# ---- validation --------------------------------------------------------------

_URL = T.StructType([T.StructField("url", T.StringType())])
_HASH = T.StructType([T.StructField("text_hash", T.StringType())])
_PASSED = T.StructType([T.StructField("seq", T.LongType()), *_URL.fields, *_HASH.fields])


def preload_validation(state: str, links: DataFrame, hashes: DataFrame) -> None:
    """Start with stored ``links(url)`` and ``hashes(text_hash)`` as seen, behind a membership filter from the first batch on."""
    store(links.select("url").distinct(), f"{state}/urls", PRELOAD)
    store(hashes.select("text_hash").distinct(), f"{state}/hashes", PRELOAD)
    fold_state(links.sparkSession, state, PRELOAD, "urls", "hashes")


def validate_rows(state: str, rows: DataFrame, batch_id: int) -> None:
    """Keep the rows ``(seq, url, text_hash)`` of a batch that pass every stage.

    What an earlier batch let through a stage is seen in that stage.
    """
    batch = written(rows.select("seq", "url", "text_hash"), "rows")

    def before(name: str, schema: T.StructType, key: str) -> DataFrame:
        known = known_keys(batch, f"{state}/{name}", schema, key, batch_id)
        return known.join(batch.select(key), key, "left_semi")

    stages = dedup.validate(batch, before("urls", _URL, "url"), before("hashes", _HASH, "text_hash"))
    store(stages.new_link.select("url"), f"{state}/urls", batch_id)
    store(stages.new_text.select("text_hash"), f"{state}/hashes", batch_id)
    store(stages.passed, f"{state}/passed", batch_id)


def validated(spark: SparkSession, state: str) -> DataFrame:
    return stored(spark, f"{state}/passed", _PASSED)


# ---- tags in arrival order ---------------------------------------------------


def _sum_terms(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("cf").alias("cf"))


def _sum_docs(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("doc_count").alias("doc_count"))


def corpus_before(spark: SparkSession, state: str, batch_id: int) -> tuple[DataFrame, int]:
    """Term counts and document count of all batches below ``batch_id``."""
    terms = versions_below(spark, f"{state}/term_stats", schemas.TERM_STATS, batch_id)
    docs = versions_below(spark, f"{state}/corpus_stats", schemas.CORPUS_STATS, batch_id)
    return _sum_terms(terms), _sum_docs(docs).first()[0] or 0


def link_tags(spark: SparkSession, state: str) -> DataFrame:
    return stored(spark, f"{state}/link_tags", schemas.LINK_TAGS)


def tag_documents(state: str, docs: DataFrame, batch_id: int, count: int = 5) -> None:
    """Tag the documents ``(seq, link, text)`` of a batch as they arrive.

    Every ``seq`` must be above those of earlier batches.
    """
    spark = docs.sparkSession
    terms = tags.term_table(docs, arrival=True)
    store(tags.table_stats(terms), f"{state}/term_stats", batch_id)
    store(terms.agg(F.count("*").alias("doc_count")), f"{state}/corpus_stats", batch_id)
    stats, total = corpus_before(spark, state, batch_id)
    own = stored(spark, f"{state}/term_stats", schemas.TERM_STATS).where(F.col("batch_id") == batch_id)
    # The filter reaches the scans of the stored counts, below their sum.
    known = stats.join(own.select("term"), "term", "left_semi")
    scores = tags.arrival_scores(terms, stored_stats=known, stored_docs=total)
    store(tags.link_tags(terms, tags.top_terms(scores, count)), f"{state}/link_tags", batch_id)


# ---- inverted index ----------------------------------------------------------


def _sum_popularity(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tag", "link").agg(F.sum("popularity").alias("popularity"))


def _sorted_index(counts: DataFrame) -> DataFrame:
    return index.by_tag(_sum_popularity(counts))


def index_tags(state: str, tagged: DataFrame, batch_id: int) -> None:
    """Add what a batch ``(…, link, tag)`` brings to each pair's popularity: a delta, sorted for lookups like the index."""
    store(index.by_tag(index.tag_index(tagged)), f"{state}/tag_index", batch_id)


def tag_index(spark: SparkSession, state: str, tag: str | None = None) -> DataFrame:
    """``(tag, link, popularity)`` over all batches; of one ``tag``, only its ranges of every delta are read."""
    counts = all_versions(spark, f"{state}/tag_index", schemas.TAG_INDEX)
    return _sum_popularity(counts if tag is None else counts.where(F.col("tag") == tag))


# ---- link, tag and junction tables -------------------------------------------

_ID = T.StructType([T.StructField("id", T.LongType())])
_EVER = 1 << 62


def _deleted(spark: SparkSession, state: str, table: str, below: int) -> DataFrame:
    return versions_below(spark, f"{state}/deleted_{table}", _ID, below)


def _living(spark: SparkSession, state: str, table: str, schema: T.StructType, below: int, deletes_below: int) -> DataFrame:
    """Rows of versions below ``below`` without what deletes below ``deletes_below`` removed. Ids are never given twice."""
    rows = versions_below(spark, f"{state}/{table}", schema, below)
    for side, key in {"links": {"links": "id"}, "tags": {"tags": "id"}, "junction": {"links": "link_id", "tags": "tag_id"}}[table].items():
        gone = _deleted(spark, state, side, deletes_below).select(F.col("id").alias(key))
        rows = rows.join(gone, key, "left_anti")
    return rows.select(*schema.names)


def star(spark: SparkSession, state: str) -> index.Star:
    tables = (("links", schemas.LINKS), ("tags", schemas.TAGS), ("junction", schemas.JUNCTION))
    return index.Star(*(_living(spark, state, name, schema, _EVER, _EVER) for name, schema in tables))


def delete_values(state: str, doomed: DataFrame, column: str, batch_id: int) -> None:
    """Delete the ``doomed(link)`` or ``doomed(tag)`` of all batches below ``batch_id``, and their pairs with them.

    Stored as a version of deleted ids, which readers subtract and folds apply. Batches from
    ``batch_id`` on add the value anew, under a new id. Deletes of one ``batch_id`` and column replace each other.
    """
    table, schema = {"link": ("links", schemas.LINKS), "tag": ("tags", schemas.TAGS)}[column]
    spark = doomed.sparkSession
    rows = _living(spark, state, table, schema, batch_id, batch_id)
    store(rows.join(doomed.select(column).distinct(), column, "left_semi").select("id"), f"{state}/deleted_{table}", batch_id)


def create_star(spark: SparkSession, state: str) -> None:
    """Set up the three tables, empty, where they are not there yet."""
    for name, schema in (("links", schemas.LINKS), ("tags", schemas.TAGS), ("junction", schemas.JUNCTION)):
        create_if_absent(spark, f"{state}/{name}", schema)


def upsert_link_tags(state: str, tagged: DataFrame, batch_id: int) -> None:
    """Add the links, tags and pairs of ``(seq, link, rank, tag)`` that are new."""
    spark = tagged.sparkSession
    rows = written(tagged, "link_tags")

    def add(table: str, column: str, schema) -> DataFrame:
        """Insert new values; return the ids of all values in the batch."""
        path = f"{state}/{table}"
        values = written(index.first_values(rows, column), column)
        known = _living(spark, state, table, schema, batch_id, batch_id + 1)
        # The last id is kept as one row a version, so the store isn't scanned for it.
        last = _last_id(versions_below(spark, f"{path}_last", _LAST, batch_id)).first()[0] or 0
        store(index.with_ids(exclude_stored(values, known, column), column, last), path, batch_id)
        fresh = stored(spark, path, schema).where(F.col("batch_id") == batch_id)
        store(_last_id(fresh.withColumnRenamed("id", "last")), f"{path}_last", batch_id)
        ids = _living(spark, state, table, schema, batch_id + 1, batch_id + 1)
        return ids.join(values.select(column), column, "left_semi")

    links = add("links", "link", schemas.LINKS)
    tag_ids = add("tags", "tag", schemas.TAGS)
    pairs = written(index.junction_rows(rows, links, tag_ids), "junction")
    known = _living(spark, state, "junction", schemas.JUNCTION, batch_id, batch_id + 1)
    store(exclude_stored(pairs, known, ["link_id", "tag_id"]), f"{state}/junction", batch_id)


# ---- upkeep ------------------------------------------------------------------


def fold_state(spark: SparkSession, state: str, upto: int, *names: str) -> None:
    """Fold the named state tables up to a committed batch and remove what that replaces."""
    tables = {
        "seen_links": (schemas.SEEN_LINKS, None),
        "seen_links_last": (_LAST, _last_id),
        "urls": (_URL, None),
        "hashes": (_HASH, None),
        "term_stats": (schemas.TERM_STATS, _sum_terms),
        "corpus_stats": (schemas.CORPUS_STATS, _sum_docs),
        "tag_index": (schemas.TAG_INDEX, _sorted_index),
        "links": (schemas.LINKS, lambda rows: without(rows, "links", "id")),
        "links_last": (_LAST, _last_id),
        "tags": (schemas.TAGS, lambda rows: without(rows, "tags", "id")),
        "tags_last": (_LAST, _last_id),
        "junction": (schemas.JUNCTION, lambda rows: without(without(rows, "links", "link_id"), "tags", "tag_id")),
        "deleted_links": (_ID, lambda rows: rows.distinct()),
        "deleted_tags": (_ID, lambda rows: rows.distinct()),
    }

    def without(rows: DataFrame, side: str, key: str) -> DataFrame:
        gone = _deleted(spark, state, side, upto + 1).select(F.col("id").alias(key))
        return rows.join(gone, key, "left_anti").select(*rows.columns)

    for name in names:
        schema, combine = tables[name]
        if name in KEYS:
            _guarded_fold(spark, f"{state}/{name}", schema, upto, KEYS[name])
        else:
            fold(spark, f"{state}/{name}", schema, upto, combine)


#: State that each handler grows, and that a long stream folds.
STATE = {
    remember_links: ("seen_links",),
    remember_keyed: ("seen_links", "seen_links_last"),
    validate_rows: ("urls", "hashes"),
    tag_documents: ("term_stats", "corpus_stats"),
    index_tags: ("tag_index",),
    upsert_link_tags: ("links", "links_last", "tags", "tags_last", "junction", "deleted_links", "deleted_tags"),
}


def on(handler, state: str, prepare=lambda batch: batch, fold_every: int = 0) -> BatchHandler:
    """A ``foreachBatch`` function that applies ``handler`` to a prepared batch.

    Every ``fold_every`` batches (0: never) the state of all batches before is
    folded first: they are committed once another one starts.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if fold_every and batch_id and batch_id % fold_every == 0:
            fold_state(batch.sparkSession, state, batch_id - 1, *STATE[handler])
        handler(state, prepare(batch), batch_id)

    return handle
