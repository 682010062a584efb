"""The registered queries: ``name -> f(spark, folder)``, each over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import schemas
from linkloom.functions import text, urls
from linkloom.operators import crawl, dedup, extract, index, metrics, ordering, tags
from linkloom.plans import inputs, pipelines
from linkloom.session import scratch_path, written
from linkloom.sources import exchange, snapshot
from linkloom.sources.tables import dealt, page_source as page_source_of, table
from linkloom.streaming import drivers, handlers

LOOKUP_TAG = "die"
SEARCH_TAGS = ["die", "the,"]
DELETED_TAGS = ["die"]
QUEUE_LIMIT = 100
BUDGET, ROUNDS = 8, 3

# ---- pages -------------------------------------------------------------------


def page_source(spark, folder):
    return inputs.pages(spark, folder).select("page_id", "url", "html")


def pages_surveyed(spark, folder):
    return metrics.pages_surveyed(inputs.pages(spark, folder))


def page_text(spark, folder):
    return inputs.page_docs(spark, folder).select(F.col("seq").alias("page_id"), "text")


def page_body_text(spark, folder):
    docs = extract.link_text(inputs.pages(spark, folder), body_only=True)
    return docs.select(F.col("seq").alias("page_id"), "text")


def link_text(spark, folder):
    return inputs.page_docs(spark, folder)


def nonempty_pages(spark, folder):
    return extract.nonempty(extract.link_text(inputs.pages(spark, folder), body_only=True)).select("seq", "link")


def page_origin(spark, folder):
    return inputs.pages(spark, folder).select("page_id", urls.page_origin(F.col("url")).alias("origin"))


def fetched_pages(spark, folder):
    """Pages with a status by a rule: every fourth was not found."""
    found = F.when(F.col("page_id") % 4 == 3, 404).otherwise(200)
    return page_source_of(inputs.pages(spark, folder).withColumn("status", found)).select("page_id", "status")


def readable_pages(spark, folder):
    """Texts and links of the pages that have text; every fifth page is stripped of it."""
    stripped = F.regexp_replace("html", ">[^<]*<", "><")
    pages = inputs.pages(spark, folder)
    pages = pages.withColumn("html", F.when(F.col("page_id") % 5 == 0, stripped).otherwise(F.col("html")))
    texts, links = extract.readable(pages)
    texts = texts.select("seq", F.lit(None).cast("int").alias("pos"), F.col("text").alias("value"))
    return texts.unionByName(links.select(F.col("page_id").alias("seq"), "pos", F.col("url").alias("value")))


def page_links(spark, folder):
    return extract.page_links(inputs.pages(spark, folder)).select("page_id", "pos", "href")


def resolve_links(spark, folder):
    return extract.page_links(inputs.pages(spark, folder)).select("page_id", "pos", "url")


def resolve_links_page(spark, folder):
    """Links without their leading slash, so that the page's own folder counts."""
    links = extract.page_links(inputs.pages(spark, folder))
    relative = F.regexp_replace("href", "^/", "")
    return links.select("page_id", "pos", urls.resolve_on_page(F.col("src_url"), relative).alias("url"))


def valid_links(spark, folder):
    return inputs.found_links(spark, folder)


# ---- terms and tags ----------------------------------------------------------


def tokens(spark, folder):
    docs = inputs.documents(spark, folder)
    return docs.select("seq", F.array_join(text.tokens(F.col("text")), " ").alias("words"))


def clean_tokens(spark, folder):
    docs = inputs.documents(spark, folder)
    return docs.select("seq", F.array_join(text.clean_tokens(F.col("text")), " ").alias("words"))


def term_freq(spark, folder):
    return tags.term_freq(inputs.documents(spark, folder)).select("seq", "term", "tf")


def doc_length(spark, folder):
    return tags.doc_length(inputs.documents(spark, folder))


def running_doc_count(spark, folder):
    counted = tags.indexed(inputs.documents(spark, folder)).select("seq")
    return ordering.numbered(counted, ["seq"], "doc_count")


def running_term_freq(spark, folder):
    counts = tags.arrival_counts(tags.term_table(inputs.documents(spark, folder), arrival=True))
    return counts.select("seq", "term", "cf")


def corpus_stats(spark, folder):
    docs = inputs.documents(spark, folder)
    return tags.term_stats(docs).select("term", "cf", tags.doc_count(docs).scalar().alias("doc_count"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("seq", "term", F.round("score", 6).alias("score"))


def tfidf_scores(spark, folder):
    return _rounded(tags.arrival_scores(tags.term_table(inputs.documents(spark, folder), arrival=True)))


def corpus_tfidf(spark, folder):
    return _rounded(tags.corpus_scores(tags.term_table(inputs.documents(spark, folder))))


def query_scores(spark, folder):
    docs = inputs.documents(spark, folder)
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("seq"), "text")
    asked = tags.term_table(questions)
    return _rounded(tags.query_scores(asked, tags.term_stats(docs), tags.doc_count(docs).scalar()))


def top3_tags(spark, folder):
    scores = tags.best_scores(tags.block_table(inputs.documents(spark, folder)), 3)
    return tags.top_terms(scores).select("seq", "rank", F.col("term").alias("tag"))


def doc_tags(spark, folder):
    docs = inputs.documents(spark, folder)
    lists = tags.tag_lists(docs, pipelines.tagged(docs))
    return lists.select("seq", "link", F.array_join("tags", " ").alias("tags"))


def page_tags(spark, folder):
    return pipelines.tagged(inputs.placed_page_docs(spark, folder), placed=True)


# ---- links: dedup, validation, crawl -----------------------------------------


def text_hash(spark, folder):
    return inputs.documents(spark, folder).select("seq", text.text_hash(F.col("text")).alias("text_hash"))


def text_dedup(spark, folder):
    return dedup.new_texts(inputs.documents(spark, folder))


def seen_link_dedup(spark, folder):
    return dedup.new_links(inputs.found_links(spark, folder))


def frontier_queue(spark, folder):
    return dedup.enqueue(dedup.new_links(inputs.found_links(spark, folder)))


def stored_link_check(spark, folder):
    return dedup.new_links(inputs.found_links(spark, folder), inputs.stored_links(spark, folder))


def validation_report(spark, folder):
    rows = inputs.document_links(spark, folder)
    rows = rows.select("seq", "url", text.text_hash(F.col("text")).alias("text_hash"))
    return dedup.validation_report(rows, stored_links=inputs.labelled_links(spark, folder))


def crawl_frontier(spark, folder):
    pages = inputs.pages(spark, folder)
    step = crawl.expand(pages.select("url"), pages, seen=pages.select("url").distinct())
    texts = step.texts.select("seq", F.lit(None).cast("int").alias("pos"), F.col("link").alias("url"), "text")
    return step.found.select("seq", "pos", "url", F.lit(None).cast("string").alias("text")).unionByName(texts)


def crawl_reach(spark, folder):
    return crawl.reach(inputs.entity_graph(spark, folder), crawl.seed(spark, "http://shop.example/region/0"))


def crawl_budget(spark, folder):
    pages = inputs.pages(spark, folder)
    seeds = pages.select(F.col("page_id").alias("seq"), "url")
    return crawl.budgeted(crawl.from_pages(pages), seeds, BUDGET, ROUNDS)


def crawl_resume(spark, folder):
    """Stopped after one round, saved as a snapshot, and taken up again from it."""
    graph, seeds = inputs.entity_graph(spark, folder), crawl.seed(spark, "http://shop.example/region/0")
    state, saved, fresh = (scratch_path(spark, name) for name in ("crawl", "snapshot", "crawl"))
    crawl.reach(graph, seeds, max_rounds=1, state=state)
    snapshot.save(spark, saved, visited=crawl.reached_links(spark, state))
    crawl.restore_reached(spark, fresh, snapshot.load(spark, saved, visited=crawl.REACHED)["visited"])
    return crawl.reach(graph, seeds, state=fresh)


def crawl_budget_resume(spark, folder):
    """Stopped after one round, saved as a snapshot, and taken up again from it."""
    pages = inputs.pages(spark, folder)
    seeds = pages.select(F.col("page_id").alias("seq"), "url")
    state, saved, fresh = (scratch_path(spark, name) for name in ("crawl", "snapshot", "crawl"))
    outgoing = crawl.from_pages(pages)
    crawl.budgeted(outgoing, seeds, BUDGET, 1, state=state)
    snapshot.save(spark, saved, **crawl.budget_parts(spark, state))
    crawl.restore_budget(fresh, **snapshot.load(spark, saved, **crawl.BUDGET_PARTS))
    return crawl.budgeted(outgoing, seeds, BUDGET, ROUNDS, state=fresh)


# ---- index, tables, search ---------------------------------------------------


def tag_index(spark, folder):
    return pipelines.indexed(inputs.documents(spark, folder))


def tag_lookup(spark, folder):
    path = scratch_path(spark, "tag_index")
    index.write_tag_index(pipelines.indexed(inputs.documents(spark, folder)), path)
    return index.links_by_tag(spark.read.schema(schemas.TAG_INDEX).parquet(path), LOOKUP_TAG)


def _page_star(spark, folder) -> index.Star:
    return pipelines.star(inputs.placed_page_docs(spark, folder), placed=True)


def links_dim(spark, folder):
    return _page_star(spark, folder).links


def tags_dim(spark, folder):
    return _page_star(spark, folder).tags


def link_tag_junction(spark, folder):
    return _page_star(spark, folder).junction


def _star_rows(star: index.Star) -> DataFrame:
    """The three tables as rows ``(part, id, value)``; a junction row's value is its tag's id."""
    parts = (("links", star.links, "id", "link"), ("tags", star.tags, "id", "tag"), ("junction", star.junction, "link_id", "tag_id"))
    rows = [
        df.select(F.lit(part).alias("part"), F.col(key).alias("id"), F.col(value).cast("string").alias("value"))
        for part, df, key, value in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def cascade_delete(spark, folder):
    doomed = spark.createDataFrame([(tag,) for tag in DELETED_TAGS], "tag string")
    plain = inputs.pages(spark, folder).where(F.startswith("url", F.lit("http://"))).select(F.col("url").alias("link"))
    left = index.delete_links(index.delete_tags(_page_star(spark, folder), doomed), plain)
    return _star_rows(left)


def tag_search(spark, folder):
    return index.search(_page_star(spark, folder), SEARCH_TAGS)


# ---- queues, snapshots, rates ------------------------------------------------


def _turns(spark, folder) -> DataFrame:
    """Conversation turns with a dense ``seq``; only their keys are sorted."""
    messages = inputs.messages(spark, folder)
    numbers = ordering.numbered(messages.select("conv_id", "turn"), ["conv_id", "turn"], "seq")
    return messages.join(numbers, ["conv_id", "turn"])


def _queue(spark, folder) -> DataFrame:
    """All conversation turns as a queue; before each opening turn comes its bare text, which is no JSON."""
    turns = _turns(spark, folder).withColumn("seq", F.col("seq") * 2)
    records = exchange.encode(turns, ["conv_id", "turn", "role", "text"])
    return records.unionByName(turns.where(F.col("turn") == 0).select((F.col("seq") - 1).alias("seq"), F.col("text").alias("value")))


_URL = T.StructType([T.StructField("url", T.StringType())])
_MESSAGE = "conv_id bigint, turn bigint, role string, text string"


def queue_pull(spark, folder):
    pulled = exchange.pull(_queue(spark, folder), _MESSAGE, QUEUE_LIMIT)
    taken = pulled.taken.select("seq", F.lit("taken").alias("state"))
    return taken.unionByName(pulled.rest.select("seq", F.lit("rest").alias("state")))


def queue_peek(spark, folder):
    return exchange.peek(_queue(spark, folder), _MESSAGE, QUEUE_LIMIT)


def queue_take(spark, folder):
    """Three lasting pulls of a stored queue: two limited ones, the second run twice, and one of all that is left."""
    path = scratch_path(spark, "lasting")
    exchange.push_list(_queue(spark, folder), path, 0)
    pulls = [(0, QUEUE_LIMIT), (1, QUEUE_LIMIT), (1, QUEUE_LIMIT), (2, -1)]
    taken = [exchange.take(spark, path, _MESSAGE, limit, i).select(F.lit(i).alias("pull"), "seq", "conv_id", "turn") for i, limit in pulls]
    return taken[0].unionByName(taken[2]).unionByName(taken[3])


def queue_push_json(spark, folder):
    path = scratch_path(spark, "queue")
    exchange.push_list(exchange.encode(_turns(spark, folder), ["conv_id", "turn", "role", "text"]), path, 0)
    pushed = exchange.read_list(spark, path)
    return pushed.select("seq", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("conv_id", "turn", "role", "text")])


def set_push(spark, folder):
    path = scratch_path(spark, "set")
    stored = inputs.stored_links(spark, folder).select(F.col("url").alias("value"))
    exchange.push_set(stored, path, 0)
    exchange.push_set(inputs.found_links(spark, folder).select(F.col("url").alias("value")), path, 1)
    return exchange.read_set(spark, path)


def snapshot_roundtrip(spark, folder):
    path = scratch_path(spark, "snapshot")
    links = written(seen_link_dedup(spark, folder), "links")
    tagged = pipelines.indexed(inputs.placed_page_docs(spark, folder), placed=True)
    snapshot.save(spark, path, queue=links, processed=inputs.pages(spark, folder).select("url"), index=tagged)
    parts = snapshot.load(spark, path, queue=schemas.SEEN_LINKS, processed=_URL, index=schemas.TAG_INDEX)
    row = lambda part, key, value: parts[part].select(F.lit(part).alias("part"), F.col(key).alias("key"), value.alias("value"))
    queue = row("queue", "url", F.concat_ws(":", "seq", "pos"))
    return queue.unionByName(row("processed", "url", F.lit(""))).unionByName(
        row("index", "tag", F.concat_ws(" ", "popularity", "link"))
    )


def push_both(spark, folder):
    """Two pushes of all turns' roles, the second limited; what was pushed, what is in the set, what the sender keeps."""
    path = scratch_path(spark, "both")
    roles = _turns(spark, folder).select("seq", F.col("role").alias("value"))
    exchange.push_both(roles, path, 0, copy=True)
    rest = exchange.push_both(roles, path, 1, limit=QUEUE_LIMIT)
    row = lambda df, place, seq: df.select(F.lit(place).alias("place"), seq.alias("seq"), "value")
    listed = row(exchange.read_list(spark, path), "list", F.col("seq"))
    return listed.unionByName(row(exchange.read_set(spark, path), "set", F.lit(None).cast("bigint"))).unionByName(
        row(rest, "kept", F.col("seq"))
    )


def table_setup(spark, folder):
    """The three tables are set up empty, twice, and then filled."""
    state = scratch_path(spark, "setup")
    for _ in range(2):
        handlers.create_star(spark, state)
    empty = _star_rows(handlers.star(spark, state)).where("id is not null")
    handlers.upsert_link_tags(state, pipelines.tagged(inputs.placed_page_docs(spark, folder), placed=True), 0)
    return empty.unionByName(_star_rows(handlers.star(spark, state)))


def crawl_rates(spark, folder):
    events = table(spark, folder, "events")
    opened = events.where(F.col("event_type") == "view").select("ts")
    gathered = events.select("ts", F.col("user_id").alias("url"))
    return metrics.crawl_rates(opened, gathered)


# ---- streams -----------------------------------------------------------------


BATCHES, FOLD_EVERY = 4, 2


def _arrivals(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """A whole table in ``BATCHES`` parts, in the order of its key."""
    least, most = df.agg(F.min(key), F.max(key)).first()
    if least is None:
        yield df
        return
    part = F.floor((F.col(key) - least) * BATCHES / (most - least + 1))
    for i in range(BATCHES):
        yield df.where(part == i)


def _stream(spark, folder: str, name: str, key: str, handler, prepare, state: str | None = None, then=None) -> str:
    """Drain one input table, as it arrives in several batches, through a handler; returns the state folder.

    ``then`` runs after each batch, that is once what it stored is committed.
    """
    state, source = state or scratch_path(spark, "stream"), scratch_path(spark, "arrivals")
    for part in _arrivals(table(spark, folder, name), key):
        part.write.mode("append").parquet(source)
        stream = drivers.file_stream(spark, source, part.schema)
        drivers.drain(stream, handlers.on(handler, state, prepare, FOLD_EVERY), f"{state}/progress")
        if then is not None:
            then(state)
    return state


def _link_rows(batch: DataFrame) -> DataFrame:
    links = extract.valid_links(extract.page_links(batch))
    return links.select(F.col("page_id").alias("seq"), "pos", "url")


def stream_seen_links(spark, folder):
    state = _stream(spark, folder, "pages", "page_id", handlers.remember_links, lambda b: _link_rows(dealt(b, "page_id")))
    return handlers.seen_links(spark, state).select("url", "seq", "pos")


def stream_seen_links_keyed(spark, folder):
    """As ``stream_seen_links``, with the links seen as keyed state of the stream."""
    state, source = scratch_path(spark, "stream"), scratch_path(spark, "arrivals")
    for part in _arrivals(table(spark, folder, "pages"), "page_id"):
        part.write.mode("append").parquet(source)
        links = handlers.keyed_links(_link_rows(dealt(drivers.file_stream(spark, source, part.schema), "page_id")))
        handler = handlers.on(handlers.remember_keyed, state, fold_every=FOLD_EVERY)
        with drivers.keyed_state(spark):
            drivers.drain(links, handler, f"{state}/progress", mode="update")
    return handlers.seen_links(spark, state).select("url", "seq", "pos")


def _documents_of(batch: DataFrame) -> DataFrame:
    return dealt(batch, "doc_id").select(F.col("doc_id").alias("seq"), F.col("source").alias("link"), "text")


def stream_validation(spark, folder):
    """The labelled documents' links are preloaded; the stream of all documents is validated."""
    state = scratch_path(spark, "validation")
    none = spark.createDataFrame([], "text_hash string")
    handlers.preload_validation(state, inputs.labelled_links(spark, folder), none)
    _stream(spark, folder, "documents", "doc_id", handlers.validate_rows, _validation_rows, state)
    return handlers.validated(spark, state).select("seq", "url")


def _validation_rows(batch: DataFrame) -> DataFrame:
    docs = inputs.with_document_link(dealt(batch, "doc_id"))
    return docs.select("seq", "url", text.text_hash(F.col("text")).alias("text_hash"))


def stream_doc_tags(spark, folder):
    state = _stream(spark, folder, "documents", "doc_id", handlers.tag_documents, _documents_of)
    return handlers.link_tags(spark, state).select("seq", "link", "rank", "tag")


def stream_tag_index(spark, folder):
    """Documents are tagged by one stream; a second adds the tags to the inverted index, batch by batch."""
    state = scratch_path(spark, "live-index")

    def hand_over(tagging: str) -> None:
        source = drivers.file_stream(spark, f"{tagging}/link_tags", schemas.LINK_TAGS)
        drivers.drain(source, handlers.on(handlers.index_tags, state, fold_every=FOLD_EVERY), f"{state}/progress")

    _stream(spark, folder, "documents", "doc_id", handlers.tag_documents, _documents_of, then=hand_over)
    return handlers.tag_index(spark, state)


def stored_cascade_delete(spark, folder):
    """Tags of half the pages are stored, some links and tags deleted, and then those of all pages are."""
    state = scratch_path(spark, "deletes")
    tagged = written(pipelines.tagged(inputs.placed_page_docs(spark, folder), placed=True), "link_tags")
    handlers.upsert_link_tags(state, tagged.where(F.col("seq") % 2 == 0), 0)
    handlers.delete_values(state, spark.createDataFrame([(t,) for t in DELETED_TAGS], "tag string"), "tag", 1)
    handlers.delete_values(state, tagged.where(F.col("seq") % 4 == 0).select("link"), "link", 1)
    handlers.upsert_link_tags(state, tagged.where(F.col("seq") % 2 == 1), 1)
    return index.search_all(handlers.star(spark, state))


def stream_link_tags(spark, folder):
    """Pages are tagged by one stream; a second turns the tags into tables."""
    state = scratch_path(spark, "star")

    def hand_over(tagging: str) -> None:
        source = drivers.file_stream(spark, f"{tagging}/link_tags", schemas.LINK_TAGS)
        drivers.drain(source, handlers.on(handlers.upsert_link_tags, state, fold_every=FOLD_EVERY), f"{state}/progress")

    _stream(
        spark, folder, "pages", "page_id", handlers.tag_documents, lambda b: extract.link_text(dealt(b, "page_id")), then=hand_over
    )
    return index.search_all(handlers.star(spark, state))


QUERIES = {
    f.__name__: f
    for f in (
        page_source, fetched_pages, readable_pages, pages_surveyed, page_text, page_body_text, link_text, nonempty_pages, page_origin,
        page_links, resolve_links, resolve_links_page, valid_links,
        tokens, clean_tokens, term_freq, doc_length, running_doc_count, running_term_freq, corpus_stats,
        tfidf_scores, corpus_tfidf, query_scores, top3_tags, doc_tags, page_tags,
        text_hash, text_dedup, seen_link_dedup, frontier_queue, stored_link_check, validation_report,
        crawl_frontier, crawl_reach, crawl_budget, crawl_resume, crawl_budget_resume,
        tag_index, tag_lookup, links_dim, tags_dim, link_tag_junction, cascade_delete, tag_search,
        queue_pull, queue_peek, queue_take, queue_push_json, set_push, push_both, table_setup, snapshot_roundtrip, crawl_rates,
        stream_seen_links, stream_seen_links_keyed, stream_validation, stream_doc_tags, stream_link_tags, stream_tag_index, stored_cascade_delete,
    )
}
