"""Operators that compare rows: components, near-duplicates, benchmark copies, top-k, repeated passages."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import decontam, neardup, suffix, topk
from linkloom.llm.graph import components

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def invented(rng, n):
    return ["".join(rng.choices(LETTERS, k=rng.randint(2, 7))) for _ in range(n)]


def edited(rng, words, share):
    return [rng.choice(LETTERS) * 3 if rng.random() < share else w for w in words]


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


# ---- components ---------------------------------------------------------------


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(shape)
    links = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(77, i) for i in range(150)] + [(1000, 1000)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(5, 6), (6, 5), (None, 4)],
        "empty": [],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    whole = [(a, b) for a, b in links if a is not None]
    assert got == united({n for link in whole for n in link}, whole)


# ---- near-duplicates ----------------------------------------------------------


def near_model(rows, size, similarity=80):
    sets = defaultdict(list)
    for key, text in rows:
        words = (text or "").encode().lower().split()
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
        if key is not None:
            sets[key].append(frozenset(runs))
    flat = [(k, s) for k, own in sets.items() for s in own if s]
    links = [
        (a, b) for i, (a, s) in enumerate(flat) for b, t in flat[i + 1 :] if 100 * len(s & t) >= similarity * len(s | t)
    ] + [(k, k2) for (k, _), (k2, _) in zip(flat, flat) if k == k2]
    return united(set(sets), links), sets


def near_rows():
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = invented(rng, rng.choice([6, 30, 90, 200]))
        for _ in range(rng.randint(2, 9)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
    hot = invented(rng, 60)
    rows += [" ".join(edited(rng, hot, 0.05)) for _ in range(70)]  # one large group, many pairs of it too far apart
    passage = invented(rng, 40)
    rows += [" ".join(invented(rng, 30) + passage + invented(rng, 30)) for _ in range(40)]
    rows += ["two words", "TWO words", "two  words ", "", None, " \n", "one", "a b c d e f"] + ["copy " * 50] * 5
    rows += [" ".join(invented(rng, 5000))] * 2
    keyed = list(enumerate(rows))
    rng.shuffle(keyed)
    return keyed + [(3, "another text of the same key"), (None, "no key"), (None, None), keyed[0], keyed[0]]


@pytest.mark.parametrize("size, blocks", [(4, 256), (5, 8)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, size, blocks):
    monkeypatch.setattr(neardup, "BLOCK_SETS", blocks)
    rows = near_rows()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, n int")
    out = neardup.near_duplicates(spark, docs, shingle=size).collect()
    want, sets = near_model(rows, size)
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    kept = neardup.one_of_each(spark, docs, shingle=size).collect()
    # Each key and text is a document of its own there.
    told = sorted({(k, t or "") for k, t in rows if k is not None})
    groups, _ = near_model([(i, t) for i, (_, t) in enumerate(told)], size)
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter(told[i][0] for i, c in groups.items() if i == c)
    assert sum(r.doc_id is None for r in kept) == 2 and all(r.n == 1 for r in kept)


def test_a_texts_last_copy_never_goes(spark):
    rng = random.Random(17)
    a, b = (" ".join(invented(rng, 40)) for _ in range(2))
    near = " ".join([*a.split()[:-1], "changed"])
    for rows in ([(1, a), (1, b), (2, b)], [(2, b), (1, b), (1, a)], [(1, a), (2, near), (1, b), (2, b), (1, a)], [(3, a)] * 5):
        docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, extra int")
        kept = neardup.one_of_each(spark, docs).collect()
        assert sorted(r.text for r in kept) == sorted({t for _, t in rows} - {near})
        assert all(r.doc_id == min(k for k, t in rows if t == r.text) for r in kept)
        assert all(r.extra == min(i for i, row in enumerate(rows) if row == (r.doc_id, r.text)) for r in kept)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(spark, docs).isEmpty() and neardup.one_of_each(spark, docs).isEmpty()


def test_incidence_product_counts_shared_shingles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 9000))) for _ in range(12)]
    want = [[100 * len(set(a) & set(b)) >= 60 * len(set(a) | set(b)) for b in sets] for a in sets]
    assert (neardup._links_in(sets, sets, 60) == np.array(want)).all()


# ---- benchmark copies ---------------------------------------------------------


def plain_alignment(item, text):
    """Smith-Waterman, cell by cell."""
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            step = decontam.MATCH if a == b else decontam.MISMATCH
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] + decontam.GAP, table[i][j - 1] + decontam.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_cell_by_cell():
    rng = random.Random(6)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        score, start, end = decontam.best_alignment(np.array(item, np.uint64), np.array(text, np.uint64))
        assert score == plain_alignment(item, text)
        if score:
            assert plain_alignment(item, text[start:end]) == score


def test_contamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(invented(rng, 30))) for i in range(12)]
    around = lambda: " ".join(invented(rng, 40))
    rows, want = [], {}
    for i in range(60):
        rows.append((i, around(), "x"))
        want[i] = []
    for i in range(60, 90):
        item, words = items[i % 12][0], items[i % 12][1].split()
        words[rng.randrange(30)] = "edited"
        del words[rng.randrange(30)]
        words.insert(rng.randrange(29), "added")
        rows.append((i, f"{around()} {', '.join(words).upper()}! {around()}", "x"))
        want[i] = [item]
    rows += [(90 + i, f"{items[3][1]} {around()} {items[7][1]}", "x") for i in range(3)]
    want |= {90 + i: [3, 7] for i in range(3)}
    rows += [(100, f"{around()} {' '.join(items[5][1].split()[:9])} {around()}", "x"), (101, None, "x"), (102, "", "x"), (103, items[1][1], "x")]
    rows += [(103, items[1][1], "x"), (104, " ".join(invented(rng, 60000)) + " " + items[2][1], "x"), (None, items[4][1], "x")]
    rows += [(200 + i, items[6][1] + " hot", "x") for i in range(150)]
    want |= {100: [], 101: [], 102: [], 103: [1], 104: [2], None: [4]} | {200 + i: [6] for i in range(150)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    odd = [(99, None), (None, "no id at all in this one item"), (98, "too short"), (97, ""), (1, items[1][1])]
    benchmark = spark.createDataFrame(items + odd, "item_id bigint, text string")
    found = decontam.findings(spark, docs, benchmark)
    out = decontam.mark(docs, found).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _, _ in rows)
    assert all(r.item_ids == want[r.doc_id] and r.contaminated == bool(want[r.doc_id]) and r.item_id == "x" for r in out)
    left = decontam.remove(docs, found)
    assert Counter(r.doc_id for r in left.collect()) == Counter(k for k, _, _ in rows if not want[k]) and left.columns == docs.columns


def contaminated(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.findings(spark, docs, benchmark)
    return [r.item_ids for r in decontam.mark(docs, found).orderBy("doc_id").collect()]


def test_contamination_of_an_edited_copy_beside_many_exact_ones(spark):
    rng = random.Random(11)
    words = invented(rng, 30)
    around = lambda: " ".join(invented(rng, 30))
    copy = [f"x{i}" if i % 6 == 5 else w for i, w in enumerate(words)]
    texts = [f"{around()} {' '.join(words)} {around()}" for _ in range(100)] + [f"{around()} {' '.join(copy)} {around()}", around()]
    assert contaminated(spark, texts, [(1, " ".join(words))]) == [[1]] * 101 + [[]]


def test_contamination_equals_aligning_everything(spark):
    rng = random.Random(12)
    common = invented(rng, 25)
    fresh = lambda: rng.choice(common) if rng.random() < 0.5 else invented(rng, 1)[0]
    items = [[fresh() for _ in range(n)] for n in (5, 6, 7, 9, 12, 16, 16, 24, 30)]
    texts = []
    for item in items * 12:
        share, copy = rng.choice([0.1, 0.2, 0.3, 0.4]), []
        for word in item[rng.choice([0, 0, len(item) // 3]) :]:
            kind = rng.randrange(3) if rng.random() < share else 3
            copy += [[fresh()], [], [word, fresh()], [word]][kind]
        texts.append([fresh() for _ in range(rng.randrange(30))] + copy + [fresh() for _ in range(rng.randrange(30))])
    texts.append([w for word in items[-1] for w in (word, "between")])  # no two words are neighbours
    texts.append([f"y{i}" if i % 5 == 4 else w for i, w in enumerate(items[5])])  # no five are
    want = [[i for i, item in enumerate(items) if plain_alignment(item, text) >= len(item)] for text in texts]
    assert want[-2:] == [[8], [5]] and [] in want
    assert contaminated(spark, map(" ".join, texts), list(enumerate(map(" ".join, items)))) == want


def test_pairs_are_counted_on_all_texts(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(decontam, "written", lambda df, label, write=decontam.written: tables.setdefault(label, write(df, label)))
    texts = [f"filler{i} one two three four filler{i}" for i in range(90)] + ["two", None, "", "one", "two three one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    decontam.findings(spark, docs, items)
    # one-two and two-three stand in 91 texts and three-four in 90; one-three and two-four with a word between, in 90 each; three-two is no pair.
    assert sorted(r.n for r in tables["gram-counts"].collect()) == [90, 90, 90, 91, 91]


def test_the_pipeline_counts_pairs_on_all_texts(spark, monkeypatch, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tables = {}
    monkeypatch.setattr(decontam, "written", lambda df, label, write=decontam.written: tables.setdefault(label, write(df, label)))
    docs = spark.createDataFrame([(i, f"filler{i} one two filler{i}") for i in range(40)], "doc_id bigint, text string")
    spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == 40
    assert [r.n for r in tables["gram-counts"].collect()] == [40]


def test_contamination_by_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Sesame!"), (2, "open the door"), (3, "水は何度で凍りますか"), (4, "สวัสดีชาวโลก"), (5, "..."), (6, "one two three four")]
    texts = [
        "say sesame now", "please OPEN, the door", "open the big door", "次の問題:水は何度で凍りますか。答え", "水は百度で凍りますか", "水と火",
        "กล่าวสวัสดีชาวโลกวันนี้", "one two three", "... one two three four", "",
    ]
    assert contaminated(spark, texts, items) == [[1], [2], [], [3], [3], [], [4], [], [6], []]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")
    assert decontam.findings(spark, none, items).isEmpty()
    assert decontam.findings(spark, docs, items.limit(0)).isEmpty()
    assert [r.item for r in decontam.findings(spark, docs, items).collect()] == [1]


# ---- top-k --------------------------------------------------------------------


def test_top_k_equals_sorting_everything(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    rng = random.Random(12)
    rows = [(i, [round(rng.uniform(-0.5, 0.5), 3) for _ in range(rng.choice([0, 4, 6]))]) for i in range(0, 120)]
    rows += [(i, [0.25, -0.25, 0.5, 0.0]) for i in range(200, 260)]  # ties
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf"), 0.1]), (None, [0.1])]
    rows += [(50, rows[50][1]), (7, rows[7][1])]
    spark_rows = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<float>, score int")
    out = topk.top_k(spark_rows, F.col("id") % 50 == 0, 5).collect()

    good = [(k, np.floor(np.float32(v).astype(float) * 256).astype(int)) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for k, v in good:
        if k % 50 == 0:
            scored = [(-int(sum(a * b for a, b in zip(v, w))), other) for other, w in good if other != k]
            want.update((k, rank, other, -s) for rank, (s, other) in enumerate(sorted(scored)[:5], 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want


def test_scores_that_no_long_holds_are_an_error(spark):
    kind = "vec_id bigint, embedding array<double>"
    large = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1e5]), (2, [1e6, 2e5])], kind)
    found = topk.top_k(large, F.col("id") % 50 == 0, 1).collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 65536 * 12 * 10**11)]  # above 2**52 the order is still right
    for x in (1e8, 1e17, 1e300):
        with pytest.raises(Exception, match="64 bits|62 bits"):
            topk.top_k(spark.createDataFrame([(0, [x] * 64), (1, [x] * 64)], kind), F.col("id") % 50 == 0, 1).collect()


def test_top_k_of_few(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("id") % 50 == 0, 5).isEmpty()
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], kind)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(two, F.col("id") % 50 == 0, 5).collect()] == [(0, 1, 1, 32768)]


# ---- repeated passages --------------------------------------------------------


def covered(rows, size):
    """Words that lie in a run of ``size`` words that another key has too."""
    words = defaultdict(list)
    for key, text in rows:
        if key is not None:
            words[key].append((text or "").lower().split())
    seen = defaultdict(set)
    for key, texts in words.items():
        for w in texts:
            for i in range(len(w) - size + 1):
                seen[tuple(w[i : i + size])].add(key)
    return {
        key: {j for w in texts for i in range(len(w) - size + 1) if len(seen[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)}
        for key, texts in words.items()
    }


def test_repeated_passages(spark):
    rng = random.Random(13)
    passage, other = invented(rng, 70), invented(rng, 55)
    rows = [(i, " ".join(invented(rng, 60))) for i in range(40)]
    rows += [(100 + i, " ".join(invented(rng, rng.randint(0, 50)) + passage + invented(rng, 20))) for i in range(90)]
    rows += [(300 + i, " ".join(invented(rng, 15) + other + invented(rng, rng.randint(0, 30)))) for i in range(2)]
    rows += [(400, "again and " * 100), (401, "again and " * 80), (402, None), (403, ""), (404, "short")]
    rows += [(405, " ".join(invented(rng, 20000) + other)), (406, " ".join(passage + passage)), (None, " ".join(passage))]
    rows += [(407, " ".join(own := invented(rng, 60))), (407, " ".join(own))]  # repeats only itself
    rows += [(500 + i, " ".join(invented(rng, 20) + passage[5:40] + invented(rng, 20))) for i in range(2)]  # too short
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, doc int").repartition(5)
    found = suffix.repeated_passages(spark, docs).collect()
    assert len({r.doc for r in found}) == len(found)
    got = {r.doc: {j for s in r.spans for j in range(s.start, s.end)} for r in found}
    must, may = covered(rows, suffix.PASSAGE), covered(rows, suffix.LEADING)
    for key, words in must.items():
        missing = words - got.get(key, set())
        assert len(missing) < 2 * suffix.WINDOW and (not words or got.get(key)), key
        assert got.get(key, set()) <= may[key], key
    assert not got.keys() & {407, 402, 403, 404, *range(40), 500}


def test_repeated_passages_of_two_are_exact(spark):
    rng = random.Random(14)
    rows = []
    for i in range(0, 40, 2):
        passage = invented(rng, rng.randint(45, 90))
        rows += [(k, " ".join(invented(rng, rng.randint(0, 40)) + passage + invented(rng, rng.randint(0, 40)))) for k in (i, i + 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: {j for s in r.spans for j in range(s.start, s.end)} for r in suffix.repeated_passages(spark, docs).collect()}
    assert got == {k: w for k, w in covered(rows, suffix.PASSAGE).items() if w}


def test_neighbours_across_partitions(spark):
    """However the sorted suffixes are cut, the same ones have a neighbour in another document."""
    rng = random.Random(15)
    rows = sorted((rng.choice([1, 2, 3, 3, 3, 4, 5, 6]), rng.randrange(5), i, 0) for i in range(60))
    want = Counter(r[:3] for r in rows if len({d for l, d, *_ in rows if l == r[0]}) > 1)
    import pyarrow as pa

    for cuts in range(12):
        edges = sorted(rng.sample(range(61), cuts))
        out = []
        for a, b in zip([0, *edges], [*edges, 60]):
            step = rng.randint(1, 7)
            columns = list(zip(*rows[a:b])) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            table = pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["leading", "doc", "place", "further"])
            for batch in suffix._neighbours(iter(table.to_batches(max_chunksize=step))):
                out += batch.to_pylist()
        ends = [(r["leading"], r["doc"]) for r in out if r["state"] == suffix.WITNESS]
        got = Counter(
            (r["leading"], r["doc"], r["place"])
            for r in out
            if r["state"] == suffix.REPEATED or r["state"] == suffix.UNDECIDED and any(l == r["leading"] and d != r["doc"] for l, d in ends)
        )
        assert got == want
        assert all(r["other"] != r["doc"] for r in out if r["state"] == suffix.REPEATED)


def test_repeated_passages_of_nothing(spark):
    assert suffix.repeated_passages(spark, spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()
