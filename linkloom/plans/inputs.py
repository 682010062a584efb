"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.extract import link_text, page_links, valid_links
from linkloom.operators.tags import in_arrival_order
from linkloom.sources.tables import dealt, page_source, table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_source(dealt(table(spark, folder, "pages"), "page_id"))


def page_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``(seq, link, text)`` of the pages."""
    return link_text(pages(spark, folder))


def placed_page_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``page_docs`` in arrival order: the pages are dealt out before their text is extracted, so that it is once."""
    return link_text(in_arrival_order(pages(spark, folder), "page_id"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(seq, link, text)`` of the documents, the source standing for the link."""
    docs = dealt(table(spark, folder, "documents"), "doc_id")
    return docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("link"), "text")


def with_document_link(docs: DataFrame) -> DataFrame:
    """``(seq, url, text)``: documents under a link made of source, language and size."""
    url = F.concat(F.lit("http://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.col("n_chars").cast("string"))
    return docs.select(F.col("doc_id").alias("seq"), url.alias("url"), "text")


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    return with_document_link(dealt(table(spark, folder, "documents"), "doc_id"))


def labelled_links(spark: SparkSession, folder: str) -> DataFrame:
    """``(url)`` of the documents that have a label: what an earlier run stored."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("seq"))
    return document_links(spark, folder).join(labels, "seq", "left_semi").select("url").distinct()


def found_links(spark: SparkSession, folder: str) -> DataFrame:
    """``(seq, pos, url)`` of every link on the pages."""
    links = valid_links(page_links(pages(spark, folder)))
    return links.select(F.col("page_id").alias("seq"), "pos", "url")


def stored_links(spark: SparkSession, folder: str) -> DataFrame:
    """``(url)`` of the links on pages served over plain http: an earlier crawl."""
    plain = pages(spark, folder).where(F.startswith("url", F.lit("http://")))
    return valid_links(page_links(plain)).select("url").distinct()


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with a key that sorts like ``(conv_id, turn)``."""
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")


def entity_graph(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, url)``: links between regions, nations, customers, orders and suppliers.

    Regions link to the next region and nations back to their region, so the
    graph has cycles.
    """

    def link(kind: str, key: str):
        return F.concat(F.lit(f"http://shop.example/{kind}/"), F.col(key).cast("string"))

    def edges(name: str, src, dst) -> DataFrame:
        return table(spark, folder, name).select(src.alias("src"), dst.alias("url"))

    region = table(spark, folder, "region").withColumn("next", (F.col("r_regionkey") + 1) % 5)
    parts = [
        region.select(link("region", "r_regionkey").alias("src"), link("region", "next").alias("url")),
        edges("nation", link("region", "n_regionkey"), link("nation", "n_nationkey")),
        edges("nation", link("nation", "n_nationkey"), link("region", "n_regionkey")),
        edges("customer", link("nation", "c_nationkey"), link("customer", "c_custkey")),
        edges("supplier", link("nation", "s_nationkey"), link("supplier", "s_suppkey")),
        edges("orders", link("customer", "o_custkey"), link("order", "o_orderkey")),
    ]
    graph = parts[0]
    for part in parts[1:]:
        graph = graph.unionByName(part)
    return graph
