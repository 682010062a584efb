"""Deduplication, validation, crawl, numbering."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import crawl, dedup, extract, membership, ordering
from linkloom.session import scratch_path
from linkloom.sources import snapshot
from linkloom.sources.tables import page_source, store
from linkloom.streaming import drivers, handlers


def link_rows(size=400, seed=5):
    rng = random.Random(seed)
    # one link holds a third of all rows
    return [
        (i, p, "http://hot/" if rng.random() < 1 / 3 else f"http://h/{rng.randint(0, 60)}")
        for i in range(size // 4)
        for p in range(4)
    ]


LINKS = "seq bigint, pos int, url string"


def firsts_of(rows):
    seen = {}
    for seq, pos, url in sorted(rows):
        seen.setdefault(url, (seq, pos))
    return seen


def test_first_seen_and_enqueue(spark):
    rows = link_rows()
    links = spark.createDataFrame(rows, LINKS).repartition(5)
    want = firsts_of(rows)
    got = dedup.new_links(links)
    assert {r.url: (r.seq, r.pos) for r in got.collect()} == want
    queue = dedup.enqueue(got, start=10).orderBy("seq").collect()
    assert [r.seq for r in queue] == list(range(10, 10 + len(want)))
    assert [r.url for r in queue] == sorted(want, key=want.get)
    seen = spark.createDataFrame([("http://hot/",)], "url string")
    assert "http://hot/" not in {r.url for r in dedup.new_links(links, seen).collect()}


def test_stream_of_links_matches_batch(spark):
    rows = link_rows()
    state = scratch_path(spark, "seen")
    cuts = [0, 12, 13, 200, len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    for batch_id, batch in enumerate(batches):
        handlers.remember_links(state, spark.createDataFrame(batch, LINKS), batch_id)
        if batch_id == 1:
            handlers.fold_state(spark, state, 1, "seen_links")
            handlers.fold_state(spark, state, 1, "seen_links")  # cut short and done again
    handlers.remember_links(state, spark.createDataFrame(batches[-1], LINKS), len(batches) - 1)
    got = handlers.seen_links(spark, state).collect()
    assert {r.url: (r.seq, r.pos) for r in got} == firsts_of(rows) and len(got) == len(firsts_of(rows))


def test_numbering_is_dense_over_many_partitions(spark):
    keys = random.Random(2).sample(range(10**12), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "seq bigint").repartition(13)
    got = {r.seq: r.n for r in ordering.numbered(df, ["seq"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}
    assert ordering.numbered(df.limit(0), ["seq"]).count() == 0


def test_ordered_limit(spark):
    df = spark.range(1000).withColumnRenamed("id", "seq").repartition(7)
    assert sorted(r.seq for r in ordering.first_in_order(df, "seq", 9).collect()) == list(range(9))
    assert sorted(r.seq for r in ordering.first_in_order(df, "seq", 500).collect()) == list(range(500))
    assert ordering.first_in_order(df, "seq", 0).isEmpty() and ordering.first_in_order(df, "seq", 5000).count() == 1000


def report_model(rows, links, hashes, stored):
    links, hashes, out = set(links), set(hashes), {}
    for seq, url, text_hash in sorted(rows):
        if url in links:
            out[seq] = "seen_link"
            continue
        links.add(url)
        if text_hash in hashes:
            out[seq] = "seen_text"
            continue
        hashes.add(text_hash)
        out[seq] = "stored_link" if url in stored else None
    return out


def test_validation_report(spark):
    rng = random.Random(9)
    rows = [(i, f"u{rng.randint(0, 60)}", f"h{rng.randint(0, 40)}") for i in range(200)]
    links, hashes, stored = ["u1", "u2"], ["h3"], ["u4", "u5", "u6", "u7"]

    def column(name, values):
        return spark.createDataFrame([(v,) for v in values], f"{name} string")

    df = spark.createDataFrame(rows, "seq bigint, url string, text_hash string")
    got = dedup.validation_report(df, column("url", links), column("text_hash", hashes), column("url", stored))
    assert {r.seq: r.failed_stage for r in got.collect()} == report_model(rows, links, hashes, stored)
    alone = dedup.validation_report(df)
    assert {r.seq: r.failed_stage for r in alone.collect()} == report_model(rows, [], [], [])


def test_validation_by_micro_batches(spark):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randint(0, 60)}", f"h{rng.randint(0, 40)}") for i in range(200)]
    state = scratch_path(spark, "validation")
    links = spark.createDataFrame([("u1",), ("u2",)], "url string")
    hashes = spark.createDataFrame([("h3",)], "text_hash string")
    handlers.preload_validation(state, links, hashes)
    cuts = [0, 50, 51, 200]
    for batch_id, (a, b) in [*enumerate(zip(cuts, cuts[1:])), (1, (50, 51))]:
        batch = spark.createDataFrame(rows[a:b], "seq bigint, url string, text_hash string")
        handlers.validate_rows(state, batch, batch_id)
    model = report_model(rows, ["u1", "u2"], ["h3"], [])
    assert {r.seq for r in handlers.validated(spark, state).collect()} == {s for s, f in model.items() if f is None}


def test_preloaded_links_are_seen(spark):
    state = scratch_path(spark, "preload")
    handlers.preload_links(state, spark.createDataFrame([(0, 0, "http://old/")], LINKS))
    handlers.remember_links(state, spark.createDataFrame([(1, 0, "http://old/"), (1, 1, "http://new/")], LINKS), 0)
    assert {r.url for r in handlers.seen_links(spark, state).where("seq > 0").collect()} == {"http://new/"}


def test_text_dedup(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "seq bigint, text string")
    assert sorted(r.seq for r in dedup.new_texts(df).collect()) == [1, 2]
    seen = dedup.new_texts(df.where("seq = 2")).select("text_hash")
    assert [r.seq for r in dedup.new_texts(df, seen).collect()] == [1]


def page(*hrefs):
    return "<body>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body>"


SITE = {
    "http://s/": page("/a", "/b", "/", " ", "mailto:x@y", "/a"),
    "http://s/a": page("/c", "/b"),
    "http://s/b": page("/c", "/gone"),
    "http://s/c": page("/a", "http://t/"),
    "http://t/": page("/self", "http://s/"),
    "http://t/self": page("/self"),
    "http://island/": page("/x"),
}


def site(spark, copies=1):
    rows = [(i + 100 * c, url, html) for c in range(copies) for i, (url, html) in enumerate(SITE.items())]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_crawl_reaches_everything_linked(spark):
    graph = crawl.link_graph(site(spark, copies=3))
    got = {r.url: r.depth for r in crawl.reach(graph, crawl.seed(spark, "http://s/")).collect()}
    assert got == {
        "http://s/": 0, "http://s/a": 1, "http://s/b": 1, "mailto:x@y": 1, "http://s": 1,
        "http://s/c": 2, "http://s/gone": 2, "http://t/": 3, "http://t/self": 4,
    }
    near = crawl.reach(graph, crawl.seed(spark, "http://s/"), max_rounds=1)
    assert {r.depth for r in near.collect()} == {0, 1}
    timed = crawl.reach(graph, crawl.seed(spark, "http://s/"), seconds=0)
    assert [(r.url, r.depth) for r in timed.collect()] == [("http://s/", 0)]


def test_one_round(spark):
    pages = site(spark, copies=2)
    seeds = crawl.seed(spark, "http://s/", "http://s/b", "http://nowhere/")
    step = crawl.expand(seeds, pages, seen=seeds)
    assert sorted(r.link for r in step.texts.collect()) == ["http://s/", "http://s/b"]
    found = {r.url for r in step.found.collect()}
    assert found == {"http://s/a", "mailto:x@y", "http://s", "http://s/c", "http://s/gone"}


def budget_model(seeds, limit, rounds, seed_is_seen=True):
    from linkloom_model import links_of

    queue, seen, out, at = list(seeds), set(seeds if seed_is_seen else []), [], 0
    for turn in range(1, rounds + 1):
        for url in queue[at : at + limit]:
            out.append((turn, at + 1, url))
            at += 1
            for found in links_of(SITE.get(url, ""), url):
                if found not in seen:
                    seen.add(found)
                    queue.append(found)
    return out


def test_budgeted_crawl_is_first_in_first_out(spark):
    graph = crawl.link_graph(site(spark))
    seeds = crawl.seed(spark, "http://s/", "http://island/")
    for limit, rounds, seen in ((1, 5, True), (2, 3, True), (3, 5, False)):
        got = crawl.budgeted(crawl.from_graph(graph), seeds, limit, rounds, seed_is_seen=seen).collect()
        assert sorted((r["round"], r.seq, r.url) for r in got) == budget_model(
            ["http://s/", "http://island/"], limit, rounds, seen
        )
        parsed = crawl.budgeted(crawl.from_pages(site(spark, copies=2)), seeds, limit, rounds, seed_is_seen=seen)
        assert sorted(map(tuple, parsed.collect())) == sorted(map(tuple, got))
    assert crawl.budgeted(crawl.from_graph(graph), seeds, 2, 3, seconds=0).isEmpty()


def test_a_crawl_taken_up_again_equals_one_in_a_piece(spark):
    graph, seeds = crawl.link_graph(site(spark)), crawl.seed(spark, "http://s/")
    want = sorted(map(tuple, crawl.reach(graph, seeds).collect()))
    for stopped in (0, 2):
        state, saved, fresh = (scratch_path(spark, "resume") for _ in range(3))
        part = crawl.reach(graph, seeds, max_rounds=stopped, state=state)
        assert sorted(map(tuple, part.collect())) == [row for row in want if row[1] <= stopped]
        # a round that was cut short left a version without a mark
        store(spark.createDataFrame([("http://s/half",)], "url string"), f"{state}/visited", stopped + 1, "depth")
        snapshot.save(spark, saved, visited=crawl.reached_links(spark, state))
        crawl.restore_reached(spark, fresh, snapshot.load(spark, saved, visited=crawl.REACHED)["visited"])
        for folder in (state, fresh):
            again = crawl.reach(graph, crawl.seed(spark, "http://other/"), state=folder)
            assert sorted(map(tuple, again.collect())) == want
    assert crawl.reached_links(spark, scratch_path(spark, "none")).isEmpty()


def test_a_budgeted_crawl_taken_up_again_equals_one_in_a_piece(spark):
    outgoing, seeds = crawl.from_graph(crawl.link_graph(site(spark))), crawl.seed(spark, "http://s/", "http://island/")
    want = budget_model(["http://s/", "http://island/"], 2, 4)
    state, saved, fresh = (scratch_path(spark, "resume") for _ in range(3))
    for rounds in (0, 1, 2):
        part = crawl.budgeted(outgoing, seeds, 2, rounds, state=state)
        assert sorted(map(tuple, part.collect())) == [row for row in want if row[0] <= rounds]
    store(spark.createDataFrame([(99, "http://s/half")], "seq bigint, url string"), f"{state}/queue", 3, "round")
    snapshot.save(spark, saved, **crawl.budget_parts(spark, state))
    crawl.restore_budget(fresh, **snapshot.load(spark, saved, **crawl.BUDGET_PARTS))
    for folder in (state, fresh):
        got = crawl.budgeted(outgoing, crawl.seed(spark, "http://other/"), 2, 4, state=folder)
        assert sorted(map(tuple, got.collect())) == want


def test_keyed_links_match_first_seen_over_splits_replays_and_a_restart(spark):
    rows = link_rows()
    source, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    handler, failed = handlers.on(handlers.remember_keyed, state, fold_every=2), []

    def fails_once(batch, batch_id):
        handler(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise ValueError("lost after it was stored")

    for lower, upper in ((0, 30), (30, 31), (31, 80), (80, 100)):
        part = [r for r in rows if lower <= r[0] < upper]
        spark.createDataFrame(part, LINKS).coalesce(1).write.mode("append").parquet(source)

        def run():
            stream = drivers.file_stream(spark, source, spark.read.parquet(source).schema)
            with drivers.keyed_state(spark):
                return drivers.drain(handlers.keyed_links(stream), fails_once, f"{state}/progress", mode="update")

        if lower == 30:
            with pytest.raises(StreamingQueryException, match="lost after it was stored"):
                run()
        assert run()
    got = {r.url: (r.seq, r.pos) for r in handlers.seen_links(spark, state).collect()}
    assert got == firsts_of(rows) and handlers.seen_links(spark, state).count() == len(got)


def test_blank_links_and_status(spark):
    links = spark.createDataFrame([(None,), ("",), ("  \t",), (" a ",)], "url string")
    assert [r.url for r in extract.valid_links(links).collect()] == [" a "]
    pages = site(spark).withColumn("status", F.when(F.col("page_id") == 0, 404).otherwise(200))
    assert page_source(pages).count() == len(SITE) - 1
    assert page_source(site(spark)).count() == len(SITE)


def test_pages_without_text_are_dropped_with_their_links(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<body><a href="/x"></a></body>'), (2, "http://b/", "<p>t")],
                                  "page_id bigint, url string, html string")
    assert [r.seq for r in extract.nonempty(extract.link_text(pages)).collect()] == [2]
    both = extract.readable(pages.unionByName(pages.selectExpr("page_id + 2 AS page_id", "url", "html || '<a href=y>more</a>' AS html")))
    assert sorted(r.seq for r in both.texts.collect()) == [2, 3, 4]
    assert sorted((r.page_id, r.href) for r in both.links.collect()) == [(3, "/x"), (3, "y"), (4, "y")]


def test_a_membership_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("http://s/"), "id").alias("url")).unionByName(
        spark.createDataFrame([(None,), ("",), ("ü" * 5000,)], "url string")
    )
    members = membership.build(keys, "url", 60_003).cache()
    blocks, slices = membership.sizes(60_003)
    assert {(r.blocks, r.slices) for r in members.collect()} == {(blocks, slices)} and members.count() == blocks == 19
    assert membership.may_hold(keys, members, "url", blocks).count() == 60_003
    others = spark.range(60_000).select(F.concat(F.lit("http://t/"), "id").alias("url"))
    assert membership.may_hold(others, members, "url", blocks).count() < 1_200
    none = membership.build(keys.limit(0), "url", 0)
    assert none.count() == 0 and membership.may_hold(others, none, "url", 1).count() == 0


def test_a_batch_reads_only_the_slices_of_keys_that_may_be_stored(spark, monkeypatch):
    monkeypatch.setattr(membership, "SLICE_KEYS", 100)
    state = scratch_path(spark, "sliced")
    old = spark.range(2_000).select(F.col("id").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("http://s/"), "id").alias("url"))
    handlers.remember_links(state, old, 0)
    handlers.fold_state(spark, state, 0, "seen_links")
    handlers.remember_links(state, spark.createDataFrame([(2_000, 0, "http://since/")], LINKS), 1)

    def known(*found):
        rows = spark.createDataFrame([(url,) for url in found], "url string")
        return handlers.known_keys(rows, f"{state}/seen_links", schemas.SEEN_LINKS, "url", 2)

    new = [f"http://new/{i}" for i in range(20)]
    assert {r.url for r in known(*new[:1]).collect()} == {"http://since/"}
    some = {r.url for r in known(*new[:1], "http://s/7").collect()}
    assert {"http://s/7", "http://since/"} <= some and len(some) < 300
    assert known(*new, *(f"http://s/{i}" for i in range(2_000))).count() == 2_001

    batch = [(3_000 + i, 0, url) for i, url in enumerate([*new, "http://s/7", "http://s/8", "http://since/", None])]
    for _ in range(2):  # replayed alike
        handlers.remember_links(state, spark.createDataFrame(batch, LINKS), 2)
        rows = handlers.seen_links(spark, state).where("seq >= 3000").collect()
        assert sorted(r.url for r in rows if r.url is not None) == sorted(new)
    handlers.fold_state(spark, state, 2, "seen_links")
    handlers.remember_links(state, spark.createDataFrame([(9_000, 0, "http://new/3"), (9_000, 1, "http://newer/")], LINKS), 3)
    assert [r.url for r in handlers.seen_links(spark, state).where("seq >= 9000").collect()] == ["http://newer/"]
    assert handlers.seen_links(spark, state).where("url IS NOT NULL").count() == 2_000 + 1 + 20 + 1
