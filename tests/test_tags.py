"""Tagging against a sequential model, blocks, skew and micro-batches."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import PUNCTUATION, STOP_WORDS
from linkloom.operators import tags
from linkloom.session import scratch_path
from linkloom.streaming import handlers

DROP = {*STOP_WORDS, *PUNCTUATION}


class Model:
    """One document after the other, with the counts kept in between."""

    def __init__(self):
        self.docs, self.cf = 0, Counter()

    def counts(self, text):
        return Counter(w for w in text.lower().split() if w not in DROP)

    def score(self, text, update=True):
        counts = self.counts(text)
        if update:
            self.docs += 1
            self.cf.update(counts)
        length = sum(counts.values())
        return {
            w: (c / length) * (math.log((1 + self.docs) / (1 + self.cf.get(w, 0))) + 1) for w, c in counts.items()
        }

    def tag(self, text, count=5):
        if not text:
            return []
        scores = self.score(text)
        return sorted(scores, key=scores.get, reverse=True)[:count]


def corpus(seed=3, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.expovariate(0.15))}" for _ in range(400)] + ["the", "I", "and", ".", "the,", "Ünï"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(size)]
    texts[4], texts[9], texts[10], texts[11] = "", None, "the and of", ". , ..."
    texts[12] = "hot " * 300 + "tie-b tie-a"
    texts[13:40] = ["copy copy copy"] * 27
    return [(i * 7, f"http://x/{i % 11}", t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, link string, text string")


def lists(df):
    return {r.seq: r.tags for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def expected(rows):
    model = Model()
    return {seq: model.tag(text) for seq, _, text in rows}, model


@pytest.mark.parametrize("block_docs", [1 << 20, 7, 1])
def test_arrival_tags_match_model(spark, rows, expected, block_docs):
    docs = frame(spark, rows)
    scores = tags.arrival_scores(tags.term_table(docs), block_docs=block_docs)
    tagged = tags.link_tags(docs, tags.top_terms(scores, 5))
    assert lists(tags.tag_lists(docs, tagged)) == expected[0]


def test_arrival_scores_match_model(spark, rows):
    model, want = Model(), {}
    for seq, _, text in rows:
        for term, score in (model.score(text) if text else {}).items():
            want[seq, term] = score
    got = tags.arrival_scores(tags.term_table(frame(spark, rows)), block_docs=5)
    got = {(r.seq, r.term): r.score for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)
    assert any(score < 0 for score in want.values())


def test_counts_and_lengths(spark, rows):
    docs = frame(spark, rows)
    model = Model()
    kept = {seq: model.counts(text) for seq, _, text in rows if text}
    assert {r.seq: r.len for r in tags.doc_length(docs).collect()} == {s: sum(c.values()) for s, c in kept.items()}
    assert {(r.seq, r.term): r.tf for r in tags.term_freq(docs).collect()} == {
        (s, t): n for s, c in kept.items() for t, n in c.items()
    }
    total = sum(kept.values(), Counter())
    assert {r.term: r.cf for r in tags.term_stats(docs).collect()} == total
    assert {r.term: r.cf for r in tags.table_stats(tags.term_table(docs)).collect()} == total
    assert tags.doc_count(docs).first()[0] == len(kept)


def test_corpus_scores_are_queries_on_final_stats(spark, rows, expected):
    model = expected[1]
    docs = frame(spark, rows)
    want = {(s, t): v for s, _, text in rows if text for t, v in model.score(text, update=False).items()}
    by_corpus = tags.corpus_scores(tags.term_table(docs))
    by_query = tags.query_scores(tags.term_table(docs), tags.term_stats(docs), tags.doc_count(docs).scalar())
    for df in (by_corpus, by_query):
        got = {(r.seq, r.term): r.score for r in df.collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in want)


def test_unseen_query_term_counts_zero(spark):
    docs = frame(spark, [(1, "a", "apple apple"), (2, "b", "pear")])
    asked = frame(spark, [(9, "q", "plum apple")])
    got = tags.query_scores(tags.term_table(asked), tags.term_stats(docs), tags.doc_count(docs).scalar())
    got = {r.term: r.score for r in got.collect()}
    assert got["plum"] == pytest.approx(0.5 * (math.log(3 / 1) + 1))
    assert got["apple"] == pytest.approx(0.5 * (math.log(3 / 3) + 1))


def run_batches(spark, state, rows, cuts):
    bounds = [0, *cuts, len(rows)]
    for batch_id, (low, high) in enumerate(zip(bounds, bounds[1:])):
        handlers.tag_documents(state, frame(spark, rows[low:high]), batch_id)


def stream_lists(spark, state, rows):
    return lists(tags.tag_lists(frame(spark, rows), handlers.link_tags(spark, state)))


def test_any_split_gives_the_same_tags(spark, rows, expected):
    want, model = expected
    state = scratch_path(spark, "split")
    run_batches(spark, state, rows, [3, 4, 31, 58])
    assert stream_lists(spark, state, rows) == want
    terms, total = handlers.corpus_before(spark, state, 5)
    assert total == model.docs and {r.term: r.cf for r in terms.collect()} == model.cf

    handlers.tag_documents(state, frame(spark, rows[4:31]), 2)  # a replay changes nothing
    assert stream_lists(spark, state, rows) == want
    assert handlers.corpus_before(spark, state, 5)[1] == model.docs


def test_folded_statistics_replace_deltas(spark, rows, expected):
    want, model = expected
    state = scratch_path(spark, "fold")
    handlers.tag_documents(state, frame(spark, rows[:20]), 0)
    handlers.tag_documents(state, frame(spark, rows[20:30]), 1)
    handlers.fold_state(spark, state, 1, "term_stats", "corpus_stats")
    handlers.tag_documents(state, frame(spark, rows[30:]), 2)
    handlers.tag_documents(state, frame(spark, rows[20:30]), 1)  # replay below the fold
    handlers.fold_state(spark, state, 2, "term_stats", "corpus_stats")
    assert stream_lists(spark, state, rows) == want
    terms, total = handlers.corpus_before(spark, state, 3)
    assert total == model.docs and {r.term: r.cf for r in terms.collect()} == model.cf


def test_top_terms_break_ties_by_position(spark):
    docs = frame(spark, [(1, "x", "b d c"), (2, "y", "z y")])
    top = tags.top_terms(tags.arrival_scores(tags.term_table(docs)), 2).where(F.col("seq") == 1)
    assert [r.term for r in top.orderBy("rank").collect()] == ["b", "d"]


def test_words_are_counted_by_row_across_batches(spark, monkeypatch):
    monkeypatch.setattr(tags, "COUNTED_ROWS", 3)
    rows = [(i, words) for i, words in enumerate([["b", "a", "b"], [], None, ["a"], [""], ["é", "e", "é", "é"], ["b"]] * 5)]
    lists = spark.createDataFrame(rows, "seq int, words array<string>").coalesce(1)
    terms = lists.select("seq", tags.counted_words(F.col("words")).alias("terms"))
    assert "ArrowEvalPython" in terms._jdf.queryExecution().toString()
    got = {r.seq: sorted(map(tuple, r.terms)) for r in terms.collect()}
    assert got == {i: sorted((w, words.index(w), words.count(w)) for w in set(words or [])) for i, words in rows}


@pytest.mark.parametrize("block_words", [1 << 20, 40, 1])
def test_best_terms_match_model_at_any_block(spark, rows, expected, block_words):
    docs = frame(spark, rows).repartition(3)
    blocks = tags.block_table(docs, block_words=block_words)
    best = tags.best_scores(blocks, 5)
    assert lists(tags.tag_lists(docs, tags.link_tags(blocks, tags.top_terms(best, 5)))) == expected[0]
    # Every row is one of arrival_scores, bit for bit, and what is left out is not among the best.
    every = {(r.seq, r.term, r.pos): r.score for r in tags.arrival_scores(tags.term_table(docs)).collect()}
    kept = {(r.seq, r.term, r.pos): r.score for r in best.collect()}
    assert kept.items() <= every.items() and len(kept) < len(every)


def test_best_terms_of_copied_and_null_keys_are_those_of_all(spark):
    rng = random.Random(5)
    text = " ".join(rng.choices([f"w{j}" for j in range(40)], k=30))
    rows = [(rng.choice([None, i // 2]), "x", text) for i in range(80)]
    docs = frame(spark, rows)
    best, every = tags.best_scores(tags.block_table(docs, block_words=100), 5), tags.arrival_scores(tags.term_table(docs, arrival=True))
    ranked = lambda scores: sorted(map(repr, tags.top_terms(scores, 5).select("seq", "rank", "score").collect()))
    assert ranked(best) == ranked(every)
    empty = tags.block_table(frame(spark, [(1, "x", ""), (2, "x", None)]))
    assert tags.best_scores(empty, 5).isEmpty()
