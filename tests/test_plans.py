"""What the plans must and must not contain."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom import schemas, session
from linkloom.operators import crawl, extract, index, ordering, tags
from linkloom.plans import inputs, pipelines
from linkloom.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_tags", "validation_report", "crawl_frontier", "query_scores", "tag_search", "queue_pull"])
def test_no_cross_join_and_no_python_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


def test_lookup_is_pushed_to_the_scan(spark):
    path = scratch_path(spark, "index")
    index.write_tag_index(pipelines.indexed(inputs.documents(spark, FOLDER)), path)
    plan = plan_of(index.links_by_tag(spark.read.schema(schemas.TAG_INDEX).parquet(path), "die"))
    assert "EqualTo(tag,die)" in plan and "Exchange" not in plan


def test_extraction_happens_once(spark):
    docs = extract.nonempty(extract.link_text(inputs.pages(spark, FOLDER)))
    assert plan_of(docs.select("seq", "text")).count("array_join(filter(transform(CASE WHEN RLIKE(html") == 1


def test_scan_reads_only_what_is_used(spark):
    plan = plan_of(inputs.pages(spark, FOLDER).select("url"))
    assert "html" not in plan.split("ReadSchema")[1]


def test_query_terms_filter_the_statistics_before_they_are_summed(spark):
    asked = tags.term_table(spark.createDataFrame([(1, "de la nicht")], "seq bigint, text string"))
    docs = inputs.documents(spark, FOLDER)
    plan = plan_of(tags.used_stats(tags.term_stats(docs), asked))
    lines = plan.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    partial = next(i for i, line in enumerate(lines) if "partial_count" in line and "keys=[term" in line)
    assert partial < semi  # the join is below, that is before, the aggregation


def test_top_tags_are_limited_before_the_shuffle(spark):
    plan = plan_of(pipelines.tagged(inputs.documents(spark, FOLDER)))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_one_block_of_documents_takes_no_second_pass(spark):
    terms = tags.term_table(inputs.documents(spark, FOLDER), arrival=True)
    one, many = (plan_of(tags.arrival_counts(terms, block_docs=size)) for size in (1 << 20, 50))
    assert "prior" in many and "prior" not in one
    assert one.count("Generate inline") < many.count("Generate inline")


def test_numbering_the_term_table_needs_no_join(spark):
    terms = tags.term_table(inputs.documents(spark, FOLDER))
    plan = plan_of(tags.arrival_counts(terms))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("term" in line or "_part" in line or "shiftright" in line for line in joins), joins


@pytest.fixture
def skewed(spark):
    """Settings under which small skewed joins are split like large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


def test_a_common_term_is_split(spark, skewed):
    docs = spark.range(60000).selectExpr("id AS seq", "concat('hot w', id % 5000) AS text").repartition(16)
    assert "skew=true" in final_plan(tags.corpus_scores(tags.term_table(docs)))


def test_a_common_url_leaves_each_task_once(spark, skewed):
    pages = spark.range(60000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot/', concat('http://h/', id)) AS url", "'<p>x' AS html")
    texts = crawl.expand(pages.select("url"), pages, seen=pages.select("url").distinct()).texts
    plan = final_plan(texts)
    assert texts.count() == 40001 and plan.index("LeftSemi") < plan.index("functions=[partial_min(page_id")


def test_a_crawl_round_leaves_the_edges_where_they_are(spark, skewed):
    graph = inputs.entity_graph(spark, FOLDER)
    edges = session.bucketed(graph, "src", session.shuffle_partitions(spark), "edges")
    plan = final_plan(crawl.reached(edges, graph.select("src").distinct()))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(src" in line]
    assert "Bucketed: true" in plan and len(exchanges) <= 2  # plan and initial plan: the frontier's alone


def test_a_crawl_round_leaves_the_visited_links_where_they_are(spark, skewed):
    graph = inputs.entity_graph(spark, FOLDER)
    buckets, path = session.shuffle_partitions(spark), session.scratch_path(spark, "visited")
    edges = session.bucketed(graph, "src", buckets, "edges")
    with session.bucketed_versions(spark, path, "url", "depth", buckets) as name:
        graph.select(F.col("src").alias("url"), F.lit(0).cast("bigint")).distinct().write.insertInto(name)
        visited = spark.table(name)
        frontier = visited.where("depth = 0").select(F.col("url").alias("src"))
        plan = final_plan(crawl.unvisited(crawl.reached(edges, frontier), visited))
    # Neither side of the round's join is shuffled, and only what it finds is, for the distinct.
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(exchanges) <= 2 and all("(url" in line for line in exchanges) and plan.count("LeftAnti") >= 1


def test_scratch_is_removed(spark):
    with session.scratch(spark):
        path = scratch_path(spark, "kept")
        spark.range(5).write.parquet(path)
        with session.scratch(spark):
            inner = session.written(spark.range(3), "inner")
            files = inner.inputFiles()
            assert inner.count() == 3
        with pytest.raises(Exception, match="NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(files[0]).count()
        assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def fake_session(root, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: root),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{root}-{master}"),
    )


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_root(fake_session("hdfs://x/scratch/", "yarn")) == "hdfs://x/scratch"
    with pytest.raises(ValueError):
        session.scratch_root(fake_session(None, "yarn"))
    local = fake_session(None, "local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)


def test_arrival_order_takes_one_write_of_the_terms(spark, monkeypatch):
    written = []
    for module in (tags, ordering):
        monkeypatch.setattr(module, "written", lambda df, label, write=module.written: written.append(label) or write(df, label))
    scores = tags.arrival_scores(tags.term_table(inputs.documents(spark, FOLDER), arrival=True))
    assert written == ["terms"] and "_slot" not in scores.columns
    again = tags.arrival_scores(tags.term_table(inputs.documents(spark, FOLDER)))
    assert written == ["terms", "terms", "order"]
    assert scores.exceptAll(again).isEmpty() and again.exceptAll(scores).isEmpty()


def test_best_tags_are_found_without_dealing_words_out_by_term(spark):
    plan = plan_of(pipelines.tagged(inputs.documents(spark, FOLDER)))
    assert "FlatMapCoGroupsInArrow" in plan
    assert plan.count("Generate inline") == 1 and "inline(words" in plan and "hashpartitioning(term" not in plan


def test_pages_are_dealt_out_before_their_text_is_extracted(spark):
    plan = plan_of(inputs.placed_page_docs(spark, FOLDER))
    assert plan.index("array_join(filter(transform(CASE WHEN RLIKE(html") < plan.index("rangepartitioning(page_id")
