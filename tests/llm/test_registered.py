"""The registered queries of the subpackage on given tables, and the pipeline on planted cases."""

import random
import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from linkloom.llm import bpe, decontam, queries  # noqa: E402
from oracle import connect, difference  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {}


def result(spark, results, name):
    if name not in results:
        results[name] = queries.QUERIES[name](spark, FOLDER).collect()
    return results[name]


def test_every_query_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= entry.queries().keys()
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_top_k_equals_sql(spark):
    assert difference(queries.op9_top_k(spark, FOLDER), connect(FOLDER), entry.oracle_sql()["op9_top_k"]) is None


def test_a_row_for_each_document(spark, results, documents):
    for name in sorted(set(queries.QUERIES) - {"op9_top_k"}):
        assert sorted(r.doc_id for r in result(spark, results, name)) == sorted(documents), name


def test_held_out_rows(spark, results):
    for name, parts, rest in (("op2_toxicity", 4, 2), ("op6_language_id", 5, 0), ("op8_lm_scores", 10, 0), ("op11_quality", 3, 1)):
        for r in result(spark, results, name):
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)


def test_language_accuracy(spark, results, documents):
    rows = [r for r in result(spark, results, "op6_language_id") if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in rows) >= 0.95 * len(rows)


def test_decontamination_finds_whole_items(spark, results, documents):
    items = {r.item_id: b" ".join(decontam.plain_words(r.text.encode())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    for r in result(spark, results, "op5_decontamination"):
        text = b" ".join(decontam.plain_words(documents[r.doc_id].text.encode()))
        assert {i for i, item in items.items() if item in text} <= set(r.item_ids)


def test_spans_list_base_spans_too(spark, results):
    for r in result(spark, results, "op4_secret_scan"):
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (kinds.count("assign"), kinds.count("access"), kinds.count("hex")) == (r.n_assign, r.n_access, r.n_hex)


# ---- the pipeline -------------------------------------------------------------


def planted(seed=21):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    text = lambda n=60: [word() for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(4)]
    rows, labels, gone = [], [], set()
    for i in range(240):
        words = text()
        if i % 6 == 0:
            words[5::9] = ["moron"] * len(words[5::9])
            gone.add(i)
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append([i, " ".join(words)])
    base = text(80)
    for i in range(300, 306):
        copy = list(base)
        copy[i % 80] = "changed"
        rows.append([i, " ".join(copy)])
        gone |= {i} - {300}
    for i in range(310, 314):
        rows.append([i, " ".join([*text(20), items[i % 4][1], *text(20)])])
        gone.add(i)
    rows.append([320, " ".join([*text(30), "password=0123456789abcdef01", *text(30)])])
    rows += [[321, None], [322, ""], [None, " ".join(text())], [323, "short"]]
    rows += [[324, " ".join(same := text())], [324, " ".join(same)]]
    return rows, labels, items, gone


def write(spark, folder, rows, labels, items):
    docs = [(k, t, "en", "src", None if t is None else len(t), "extra", 0.5) for k, t in rows]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, score double"
    spark.createDataFrame(docs, kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    rows, labels, items, gone = planted()
    folder = write(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = docs.collect()
    left = [k for k, _ in rows if k not in gone]
    left.remove(324)  # one of two equal rows
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, left))
    by_id = {r.doc_id: r for r in kept}
    assert "[assign]" in by_id[320].text and by_id[320].n_chars == len(by_id[320].text) and by_id[321].text is None
    assert all(by_id[k].text == t for k, t in rows if k in by_id and k not in (320,))

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.run(spark, folder).collect():
        want = library.encode_ordinary(by_id[r.doc_id].text or "")
        assert list(r.ids) == want and r.n_tokens == len(want) and r.text == (by_id[r.doc_id].text or "")


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    out = corpus_pipeline.run(spark, folder)
    assert out.isEmpty() and out.columns == ["doc_id", "n_tokens", "ids", "text"]
    for name, query in queries.QUERIES.items():
        if name != "op9_top_k":
            assert query(spark, folder).isEmpty(), name


def test_given_tables_may_hold_nulls(spark, tmp_path):
    rows, labels, items, _ = planted(5)
    odd = [(None, None, None), (5, None, None), (6, 1, None), (None, 1, 1)]
    folder = write(spark, tmp_path, rows[:40] + rows[-6:], labels + odd, items + [(None, None), (50, None)])
    for name, query in queries.QUERIES.items():
        if name != "op9_top_k":
            assert query(spark, folder).select(F.count("*")).first()[0] == 46, name
