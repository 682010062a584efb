"""Inverted index, star tables, queues, snapshots, rates."""

import datetime as dt
import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import index, metrics
from linkloom.session import scratch_path
from linkloom.sources import exchange, snapshot
from linkloom.sources.tables import create_if_absent, stored
from linkloom.streaming import drivers, handlers
from linkloom.streaming.progress import Rates

ROWS = [
    (1, "http://a/", 1, "x"), (1, "http://a/", 2, "y"), (1, "http://a/", 3, "z"),
    (2, "http://b/", 1, "y"), (2, "http://b/", 2, "w"),
    (3, "http://a/", 1, "y"), (3, "http://a/", 2, "v"),
    # Equal for longer than any column of a database might hold, and yet different.
    (4, "http://long/" + "p" * 3000, 1, "t" * 100), (5, "http://long/" + "p" * 2500, 1, "t" * 64),
]


def tagged(spark, rows=ROWS):
    return spark.createDataFrame(rows, schemas.LINK_TAGS)


def dump(star):
    return (
        {r.id: r.link for r in star.links.collect()},
        {r.id: r.tag for r in star.tags.collect()},
        sorted((r.link_id, r.tag_id) for r in star.junction.collect()),
    )


def model(rows):
    links, tags, pairs = [], [], set()
    for _, link, _, tag in sorted(rows):
        links += [link] * (link not in links)
        tags += [tag] * (tag not in tags)
        pairs.add((links.index(link) + 1, tags.index(tag) + 1))
    return dict(enumerate(links, 1)), dict(enumerate(tags, 1)), sorted(pairs)


def test_star_of_one_batch(spark):
    assert dump(index.build_star(tagged(spark))) == model(ROWS)


def test_star_by_micro_batches(spark):
    state = scratch_path(spark, "star")
    parts = [ROWS[:2], ROWS[2:5], ROWS[5:]]
    for batch_id, part in enumerate(parts):
        handlers.upsert_link_tags(state, tagged(spark, part), batch_id)
    assert dump(handlers.star(spark, state)) == model(ROWS)
    handlers.fold_state(spark, state, 1, "links", "tags", "junction")
    handlers.upsert_link_tags(state, tagged(spark, parts[2]), 2)
    handlers.upsert_link_tags(state, tagged(spark, ROWS[:5]), 3)
    assert dump(handlers.star(spark, state)) == model(ROWS)


def test_long_streams_keep_few_versions(spark):
    state, source = scratch_path(spark, "star"), scratch_path(spark, "in")
    for i, row in enumerate(ROWS):
        tagged(spark, [row]).coalesce(1).write.mode("append").parquet(source)
        stream = drivers.file_stream(spark, source, schemas.LINK_TAGS)
        drivers.drain(stream, handlers.on(handlers.upsert_link_tags, state, fold_every=2), f"{state}/progress")
        for name in handlers.STATE[handlers.upsert_link_tags]:
            assert stored(spark, f"{state}/{name}", schemas.TAGS.__class__([])).select("batch_id").distinct().count() <= 2
    assert dump(handlers.star(spark, state)) == model(ROWS)


def test_cascade_delete(spark):
    star = index.build_star(tagged(spark))
    links = index.delete_links(star, spark.createDataFrame([("http://a/",)], "link string"))
    assert links.links.where("link = 'http://a/'").isEmpty()
    assert 1 not in {r.link_id for r in links.junction.collect()} and links.tags.count() == star.tags.count()
    tags = index.delete_tags(star, spark.createDataFrame([("y",)], "tag string"))
    gone = star.tags.where("tag = 'y'").first().id
    assert gone not in {r.tag_id for r in tags.junction.collect()} and tags.links.count() == star.links.count()


def test_index_lookup_and_search(spark):
    built = index.tag_index(tagged(spark).unionByName(tagged(spark, ROWS[3:4])))
    path = scratch_path(spark, "index")
    index.write_tag_index(built, path)
    back = spark.read.schema(schemas.TAG_INDEX).parquet(path)
    assert sorted(tuple(r) for r in index.links_by_tag(back, "y").collect()) == [("http://a/", 2), ("http://b/", 2)]
    assert index.links_by_tag(back, "unknown").isEmpty()
    star = index.build_star(tagged(spark))
    found = sorted(tuple(r) for r in index.search(star, ["y", "w", "nope"]).collect())
    assert found == [("w", "http://b/"), ("y", "http://a/"), ("y", "http://b/")]


def test_create_if_absent(spark):
    path = scratch_path(spark, "tables") + "/links"
    create_if_absent(spark, path, schemas.LINKS)
    create_if_absent(spark, path, schemas.LINKS)
    assert stored(spark, path, schemas.LINKS).columns == ["id", "link", "batch_id"]


def queue(spark):
    values = ['{"k": 1}', "not json", '{"k": 2}', "", '{"k": 3', '{"k": 4}', None]
    return spark.createDataFrame(list(enumerate(values)), schemas.QUEUE)


def test_pull_skips_undecodable_and_leaves_the_rest(spark):
    pulled = exchange.pull(queue(spark), "k int", 2)
    assert [r.k for r in pulled.taken.orderBy("seq").collect()] == [1, 2]
    assert sorted(r.seq for r in pulled.rest.collect()) == [3, 4, 5, 6]
    everything = exchange.pull(queue(spark), "k int")
    assert sorted(r.k for r in everything.taken.collect()) == [1, 2, 4] and everything.rest.isEmpty()
    assert [r.k for r in exchange.peek(queue(spark), "k int", 1).collect()] == [1]
    short = exchange.pull(queue(spark), "k int", 9)
    assert short.taken.count() == 3 and short.rest.isEmpty()
    none = exchange.pull(queue(spark), "k int", 0)
    assert none.taken.isEmpty() and none.rest.count() == 7
    nothing = exchange.pull(queue(spark).where("seq in (1, 3)"), "k int", 5)
    assert nothing.taken.isEmpty() and nothing.rest.isEmpty()


def test_no_valid_record_is_lost(spark):
    rows = [
        '{"k": 1, "k": 2}', '{"k": 3, "x": NaN}', ' {"k": 4} ', '[5, "s"]', '{"k": "6"}', '{"k": {"a": 1}, "x": 0.5}',
        '{"k": 7} tail', '{"k": 7}{"k": 7}', '{"k": 7}, {"k": 7}', "{'k': 7}", '"text"', "7", "null", "[7",
    ]
    queued = spark.createDataFrame(list(enumerate(rows)), schemas.QUEUE)
    got = {r.seq: r.k for r in exchange.decode(queued, "k int, x double").collect()}
    assert got == {0: 2, 1: 3, 2: 4, 3: 5, 4: 6, 5: None}
    long = spark.range(1).select(
        F.col("id").alias("seq"), F.concat(F.lit('{"k": 9, "s": "'), F.repeat(F.lit("0123456789"), 13_000_000), F.lit('"}')).alias("value")
    )
    assert tuple(exchange.decode(long, "k int, s string").select("k", F.length("s")).first()) == (9, 130_000_000)


def test_pushing_leaves_a_remainder(spark):
    path = scratch_path(spark, "queue")
    rows = spark.createDataFrame([(i, f"v{i % 4}") for i in range(10)], schemas.QUEUE)
    left = lambda df: sorted(r.seq for r in df.collect())
    assert left(exchange.push_list(rows, path, 0, limit=3)) == [3, 4, 5, 6, 7, 8, 9]
    assert left(exchange.push_list(rows, path, 1)) == [] and left(exchange.push_list(rows, path, 2, limit=3, copy=True)) == list(range(10))
    assert left(exchange.push_set(rows, path, 0, limit=2)) == list(range(2, 10))
    assert {r.value for r in exchange.read_set(spark, path).collect()} == {"v0", "v1"}
    assert left(exchange.push_both(rows, path, 3, limit=0)) == list(range(10)) and left(exchange.push_both(rows, path, 4, limit=99)) == []
    assert exchange.read_list(spark, path).count() == 3 + 10 + 3 + 0 + 10


def test_push_list_set_and_both(spark):
    path = scratch_path(spark, "queue")
    pairs = spark.createDataFrame([(1, "http://é/", ["a", "b"]), (2, "u", []), (3, "u", [])], "seq long, link string, tags array<string>")
    encoded = exchange.encode(pairs, ["link", "tags"])
    assert json.loads(encoded.orderBy("seq").first().value) == {"link": "http://é/", "tags": ["a", "b"]}
    exchange.push_both(encoded, path, 0)
    exchange.push_both(encoded, path, 0)
    exchange.push_both(encoded, path, 1, limit=2)
    assert exchange.read_list(spark, path).count() == 5 and exchange.read_set(spark, path).count() == 2
    back = exchange.decode(exchange.read_list(spark, path).where("batch_id = 0"), "link string, tags array<string>")
    assert sorted((r.link, r.tags) for r in back.select("link", "tags").collect()) == [("http://é/", ["a", "b"]), ("u", []), ("u", [])]


def test_tuples_and_objects_decode_alike(spark):
    rows = [(1, 'http://é/"q"', ["a", "b\n"]), (2, "u", []), (3, None, None)]
    pairs = spark.createDataFrame(rows, "seq long, link string, tags array<string>")
    encoded = exchange.encode_tuple(pairs, ["link", "tags"])
    assert {r.seq: json.loads(r.value) for r in encoded.collect()} == {s: [l, t] for s, l, t in rows}
    for queued in (encoded, exchange.encode(pairs, ["link", "tags"])):
        got = exchange.decode(queued, "link string, tags array<string>").collect()
        assert sorted((r.seq, r.link, r.tags) for r in got) == rows


def test_snapshots(spark):
    path = scratch_path(spark, "snapshot")
    assert snapshot.load(spark, path, tags=schemas.TAGS)["tags"].isEmpty()
    first = spark.createDataFrame([(1, "x")], schemas.TAGS)
    assert snapshot.save(spark, path, tags=first) == 1
    assert snapshot.save(spark, path, tags=first.unionByName(first)) == 2
    assert snapshot.load(spark, path, tags=schemas.TAGS)["tags"].count() == 2


def test_rates_over_days(spark):
    start = dt.datetime(2024, 1, 1, 10, 30)
    views = [start + dt.timedelta(hours=h) for h in (0, 0.25, 1, 20, 30, 30.1)]
    sights = [(start + dt.timedelta(hours=h), u) for h, u in ((0, "a"), (0.1, "a"), (2, "b"), (30, "a"), (31, "c"))]
    opened = spark.createDataFrame([(v,) for v in views], "ts timestamp_ntz")
    gathered = spark.createDataFrame(sights, "ts timestamp_ntz, url string")
    got = {r.period: tuple(r)[1:] for r in metrics.crawl_rates(opened, gathered).collect()}
    firsts = {}
    for ts, url in sights:
        firsts.setdefault(url, ts)
    assert set(got) == {t.replace(minute=0, second=0) for t in [*views, *firsts.values()]}
    for period, (viewed, found, view_rate, gather_rate) in got.items():
        end = period + dt.timedelta(hours=1)
        elapsed = (end - start).total_seconds()
        assert viewed == sum(v < end for v in views) and found == sum(t < end for t in firsts.values())
        assert view_rate == round(viewed / elapsed * 100) / 100 and gather_rate == round(found / elapsed * 100) / 100


def test_streams_drain_files_in_batches(spark):
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    for batch_id in range(3):
        spark.createDataFrame([(batch_id, "l", 1, "t")], schemas.LINK_TAGS).coalesce(1).write.mode("append").parquet(source)
    sizes = []

    def handler(_, batch, batch_id):
        sizes.append(batch.count())

    stream = drivers.file_stream(spark, source, schemas.LINK_TAGS, files_per_batch=2)
    assert drivers.drain(stream, handlers.on(handler, state), f"{state}/progress", timeout=60)
    assert sum(sizes) == 3 and len(sizes) >= 2
    assert drivers.drain(stream, handlers.on(handler, state), f"{state}/progress", timeout=60)
    assert sum(sizes) == 3  # nothing new, nothing again


def test_a_soft_stop_ends_after_a_whole_batch(spark):
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    for batch_id in range(4):
        spark.createDataFrame([(batch_id, "l", 1, "t")], schemas.LINK_TAGS).coalesce(1).write.mode("append").parquet(source)
    begun, ended = [], []

    def handler(batch, batch_id):
        begun.append(batch_id)
        time.sleep(2)
        ended.append((batch_id, batch.count()))

    stream, progress = drivers.file_stream(spark, source, schemas.LINK_TAGS, files_per_batch=1), f"{state}/progress"
    assert not drivers.drain(stream, handler, progress, timeout=0) and not begun
    assert not drivers.drain(stream, handler, progress, stop=lambda: len(begun) == 2)
    assert begun == [0, 1] and ended == [(0, 1), (1, 1)]
    query = drivers.follow(stream, handler, progress, "1 second", stop=lambda: len(begun) == 3)
    assert not drivers.ended(query, 60) and begun == [0, 1, 2]
    assert drivers.drain(stream, handler, progress, timeout=600)
    assert begun == [0, 1, 2, 3] and sum(size for _, size in ended) == 4

    def broken(batch, batch_id):
        raise ValueError("broken")

    with pytest.raises(StreamingQueryException, match="broken"):
        drivers.drain(stream, broken, f"{state}/other")


def test_follow_picks_up_files(spark):
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    rates = Rates()
    spark.streams.addListener(rates)
    tagged(spark).write.parquet(source)
    stream = drivers.file_stream(spark, source, schemas.LINK_TAGS)
    query = drivers.follow(stream, handlers.on(handlers.upsert_link_tags, state), f"{state}/progress", "1 second")
    try:
        query.processAllAvailable()
        deadline = time.time() + 20
        while not any(rates.rates().values()) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.streams.removeListener(rates)
    assert list(rates.rates().values())[0] > 0
    assert handlers.star(spark, state).junction.agg(F.count("*")).first()[0] == len(model(ROWS)[2])


# ---- lasting pulls, live index, stored deletes ------------------------------------


def test_numbers_and_nesting_of_any_size_are_decoded(spark):
    values = [(1, '{"k": ' + "7" * 1500 + "}"), (2, '{"k": ' + "[" * 900 + "]" * 900 + "}"), (3, "{"), (4, '{"k": 5}')]
    queued = spark.createDataFrame(values, "seq bigint, value string")
    assert sorted((r.seq, r.k) for r in exchange.decode(queued, "k int").collect()) == [(1, None), (2, None), (4, 5)]


def test_lasting_pulls_are_gapless_and_replayed_alike(spark):
    path = scratch_path(spark, "queue")
    push = lambda rows, i: exchange.push_list(spark.createDataFrame(rows, "seq bigint, value string"), path, i)
    take = lambda limit, i, **how: [(r.push, r.seq, r.k) for r in exchange.take(spark, path, "k int", limit, i, **how).orderBy("push", "seq").collect()]
    assert take(2, 0) == []
    push([(1, '{"k": 1}'), (2, "no record"), (3, '{"k": 3}'), (4, '{"k": 4}'), (5, "tail")], 0)
    first = take(2, 1)
    assert first == [(0, 1, 1), (0, 3, 3)] and take(0, 2) == []
    push([(1, '{"k": 11}'), (2, '{"k": 12}')], 1)  # a later push comes behind, whatever its numbers
    assert take(2, 1) == first  # run again
    assert take(2, 3) == [(0, 4, 4), (1, 1, 11)]
    short = take(5, 4)
    assert short == [(1, 2, 12)]
    push([(9, '{"k": 99}')], 2)
    assert take(5, 4) == short and take(-1, 5) == [(2, 9, 99)] and take(-1, 6) == []
    assert len(take(-1, 1, name="other")) == 6  # another reader has its own place


def test_live_index_equals_one_batch_over_splits_and_replays(spark):
    state = scratch_path(spark, "live")
    rows = [(i, f"l{i % 4}", r, f"t{(i * r) % 5}") for i in range(1, 30) for r in (1, 2, 3)]
    whole = spark.createDataFrame(rows, "seq bigint, link string, rank int, tag string")
    for i, (low, high) in enumerate([(0, 3), (3, 4), (4, 17), (17, 40)]):
        for _ in range(1 + i % 2):
            handlers.index_tags(state, whole.where((F.col("seq") >= low) & (F.col("seq") < high)), i)
        if i == 2:
            handlers.fold_state(spark, state, 1, "tag_index")
    want = sorted(tuple(r) for r in index.tag_index(whole).collect())
    assert sorted(tuple(r) for r in handlers.tag_index(spark, state).collect()) == want
    one = handlers.tag_index(spark, state, "t2")
    assert sorted(tuple(r) for r in one.collect()) == [r for r in want if r[0] == "t2"]
    assert "PushedFilters: [IsNotNull(tag), EqualTo(tag,t2)" in one._jdf.queryExecution().toString()


def test_stored_deletes_between_upserts(spark):
    rows = lambda *pairs: spark.createDataFrame([(i, link, 1, tag) for i, (link, tag) in enumerate(pairs)], "seq bigint, link string, rank int, tag string")
    state = scratch_path(spark, "deletes")
    handlers.upsert_link_tags(state, rows(("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")), 0)
    for _ in range(2):  # run again
        handlers.delete_values(state, spark.createDataFrame([("x",), ("none",)], "tag string"), "tag", 1)
        handlers.delete_values(state, spark.createDataFrame([("c",)], "link string"), "link", 1)
    pairs = lambda: sorted(tuple(r) for r in index.search_all(handlers.star(spark, state)).collect())
    assert pairs() == [("y", "a")]
    for _ in range(2):
        handlers.upsert_link_tags(state, rows(("b", "x"), ("c", "y")), 1)
    after = [("x", "b"), ("y", "a"), ("y", "c")]
    assert pairs() == after
    handlers.delete_values(state, spark.createDataFrame([("c",)], "link string"), "link", 1)  # again: takes nothing of batch 1
    assert pairs() == after
    ids = {r.tag: r.id for r in handlers.star(spark, state).tags.collect()}
    assert ids == {"y": 2, "z": 3, "x": 4}  # ids are never given twice
    handlers.fold_state(spark, state, 1, *handlers.STATE[handlers.upsert_link_tags])
    assert pairs() == after and {r.tag: r.id for r in handlers.star(spark, state).tags.collect()} == ids
    handlers.upsert_link_tags(state, rows(("d", "z")), 2)
    assert pairs() == sorted([*after, ("z", "d")])
