"""Fill-in-the-middle, quality by compression, alignment of two tokenizers."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linkloom.llm import align, compress, fim
from linkloom.llm.common import remainder

EDGES = [
    (1, "The cat's 12 hats,  two\n\n spaces\t."), (2, ""), (3, None), (None, "no key"), (4, "été 東京 🙂 ſecret x 🙂🙂"),
    (1, "The cat's 12 hats,  two\n\n spaces\t."), (5, " \n "), (6, "ab " * 4000), (7, "x" * 30000), (8, "a <P> marker"),
    (9, "<S"), (10, "S> <"), (11, "\\1 $2 {3} (x"), (12, "<s>end</s> <|endoftext|> <unk> <0x41>"), (13, "a▁b ▁▁ c"), (14, "nul\x00 byte"),
    (15, " leading and trailing "), (16, "é" * 5000), (17, "東京" * 3000),
]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty, blank, repeated and long rows, and columns that operators might clash with."""
    return spark.createDataFrame([(k, t, "kept", 7) for k, t in EDGES], "doc_id bigint, text string, form string, n int")


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


def keys(rows):
    return Counter(r.doc_id for r in rows)


# ---- fill in the middle ---------------------------------------------------------


def plain_cut(key, text, seed=1, rate=90, spm_rate=20):
    """The contract, unit by unit."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_fim(rows, source, **how):
    assert keys(rows) == Counter(k for k, *_ in source)
    want = Counter((k, *plain_cut(k, t or "", **how)) for k, t in source)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want


@pytest.mark.parametrize("piece", [5, 1 << 16])
def test_fill_in_middle_equals_cutting_by_units(spark, edges, monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    short = edges.where("length(text) < 3000 or text is null") if piece < 100 else edges
    source = [(k, t) for k, t in EDGES if piece > 100 or len(t or "") < 3000]
    out = fim.fill_in_middle(short).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert set(out.columns) == {"doc_id", "text", "form", "n", "prefix_chars", "middle_chars", "output", "back"}
    rows = out.collect()
    check_fim(rows, source)
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((k, t or "") for k, t in source)


def test_fill_in_middle_of_random_texts_and_rates(spark):
    rng = random.Random(3)
    source = [(i, "".join(rng.choices("abcXYZ  \n.<>PSM/$\\é🙂", k=rng.randint(0, 60)))) for i in range(600)]
    docs = spark.createDataFrame(source, "doc_id bigint, text string")
    for how in ({}, {"seed": 9, "rate": 50, "spm_rate": 60}, {"rate": 0}):
        check_fim(fim.fill_in_middle(docs, **how).collect(), source, **how)


def test_a_very_long_text_is_cut_without_recursion(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('word, ', 700000)").alias("text"))
    row = fim.fill_in_middle(docs, rate=100).withColumn("same", fim.restore(F.col("output"), F.col("form")) == F.col("text")).first()
    assert row.n == 2_100_000 and row.same and row.form != "plain"


def test_fill_in_middle_of_nothing(nothing):
    assert fim.fill_in_middle(nothing).isEmpty()


def test_fill_in_middle_needs_no_python(spark, edges):
    plan = fim.fill_in_middle(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- quality by compression -----------------------------------------------------


def quality_rows(n=500, seed=5):
    rng = random.Random(seed)
    good = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(good, k=rng.randint(5, 300))
        if bad:
            words = [f"{w.upper()}!!" for w in words] if i % 2 else [f"{w}$$$" for w in words]
        rows.append((i, " ".join(words), 0 if bad else 1))
    return rows


def learned(spark, rows, held_out=None, labels=None):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id bigint, text string")
    labels = labels if labels is not None else [(k, q) for k, _, q in rows]
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int")
    return docs, compress.learn(spark, docs, marked, held_out if held_out is not None else F.lit(False))


def test_quality_held_out(spark):
    rows = quality_rows()
    held_out = remainder("doc_id", 3) == 1
    docs, model = learned(spark, rows, held_out)
    want = {k: q for k, _, q in rows}
    got = compress.score(spark, docs, model).withColumn("out", held_out).collect()
    tested = [r for r in got if r.out]
    assert len(tested) > 100 and all((r.score >= compress.THRESHOLD) == want[r.doc_id] for r in tested)
    assert all(0 <= r.score <= 1 for r in got)
    # Held-out rows, and what has no label, change nothing.
    changed = [(k, "JUNK!! " * 50 if zlib.crc32(str(k).encode()) % 3 == 1 else t, q) for k, t, q in rows]
    assert learned(spark, changed, held_out)[1] == model


def test_quality_equals_compressing_each_piece(spark):
    rows = quality_rows(200)
    docs, model = learned(spark, rows)
    sides = [compress.Quality(model.bad, model.good, 0, 0).compressors()][0]

    def size(text, compressor):
        data = text.encode()
        return sum(len(compressor.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))

    texts = dict((k, t) for k, t, _ in rows) | {-1: "é" * 3000, -2: "word " * 20000, -3: "", -4: None}
    more = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in compress.score(spark, more, model).collect():
        text = texts[r.doc_id] or ""
        want = (size(text, sides[0]) - size(text, sides[1])) / len(text.encode()) if text else 0.0
        assert r.difference == pytest.approx(want, abs=1e-12)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * want + model.offset))), abs=1e-9)


def test_quality_of_copies_and_of_one_document_a_label(spark):
    rows = quality_rows(120)
    hot = [(1000, "hot copy " * 30, 1)] * 4000
    _, model = learned(spark, rows + hot, labels=[(k, q) for k, _, q in rows] + [(1000, 1)])
    _, once = learned(spark, rows + hot[:1], labels=[(k, q) for k, _, q in rows] + [(1000, 1)])
    assert (model.bad, model.good) == (once.bad, once.good)  # the copies weigh in the calibration only
    docs, tiny = learned(spark, [(1, "ok", 1), (2, "!!!!", 0)])
    assert all(0 <= r.score <= 1 for r in compress.score(spark, docs, tiny).collect())


def test_quality_learns_from_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(compress, "LEARN_CHARS", 1000)
    rng = random.Random(1)
    kinds = ["BUY!! NOW!! CHEAP!! OFFER!!".split(), "rivers carry stones through quiet valleys".split()]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=900)), i % 2) for i in range(12)]
    docs, model = learned(spark, rows)
    # 5,000 characters and more: one text of each label is in a dictionary, five calibrate.
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in compress.score(spark, docs, model).collect())


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, None)], 1.0), ([(1, 0)], 0.0), ([(None, 0)], 0.5)])
def test_quality_without_both_labels(spark, edges, nothing, labels, want):
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = compress.learn(spark, edges, marked, F.lit(False))
    out = compress.score(spark, edges, model).collect()
    assert keys(out) == Counter(k for k, _ in EDGES) and all(r.score == pytest.approx(want, abs=1e-6) for r in out)
    assert compress.score(spark, nothing, model).isEmpty()


def test_quality_edges(spark, edges):
    _, model = learned(spark, quality_rows(60) + [(900, None, 0), (901, "", 1), (None, "no key", 1)], labels=[(k, q) for k, _, q in quality_rows(60)] + [(900, 0), (901, 1), (901, 0), (5, 0), (5, 1)])
    out = compress.score(spark, edges.withColumn("score", F.lit("mine")), model).collect()
    assert keys(out) == Counter(k for k, _ in EDGES)
    blank = {r.score for r in out if not r.text}
    assert len(blank) == 1 and all(r.form == "kept" for r in out)


# ---- alignment of two tokenizers ------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return align.load_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def whole_tokens(pair, text):
    """Ids and bytes of either side, each text encoded whole; None where the bytes differ."""
    from tokenizers import Tokenizer

    import sentencepiece

    if not hasattr(whole_tokens, "sides"):
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        whole_tokens.sides = a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a, b = whole_tokens.sides
    alphabet = align.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    names = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
    want = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else None


def plain_groups(pair, text):
    found = whole_tokens(pair, text) if text else None
    if not found:
        return []
    ids_a, bytes_a, ids_b, bytes_b = found
    ends = [list(np.cumsum([len(t) for t in side])) for side in (bytes_a, bytes_b)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return groups


def plain_alignment(pair, rows):
    all_groups = [plain_groups(pair, t) for _, t in rows]
    count = Counter()
    for groups in all_groups:
        count.update({(a, b) for x, y in groups for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (key, _), groups in zip(rows, all_groups):
        links = [(a, b) for x, y in groups for a in x for b in y]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "",
        ))
    return Counter(out)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(spark, docs, pair, **how):
    return Counter(tuple(r[c] for c in COLUMNS) for r in align.align(spark, docs, pair, **how).collect())


def test_byte_alphabet_is_that_of_the_vocabulary(pair):
    vocabulary = json.loads(pair[0])["model"]["vocab"]
    assert len(align.byte_alphabet()) == 256 and set("".join(vocabulary)) <= set(align.byte_alphabet())


@pytest.mark.parametrize("chars, stretch, wide", [(1 << 22, 256, 64), (300, 2, 1)])
def test_alignment_equals_brute_force(spark, edges, pair, monkeypatch, chars, stretch, wide):
    for name, value in (("BLOCK_CHARS", chars), ("STRETCH", stretch), ("WIDE", wide), ("UNITS", 50)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(8)
    words = "the of tokenizer alignment naïve Ångström don't 12345 3.14 foo_bar  🙂 東京 \t it's x<s> http://a.b/c?d=e".split(" ")
    more = [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(60)]
    rows = EDGES + more + more[:5]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, n_a int").repartition(3)
    assert aligned(spark, docs, pair) == plain_alignment(pair, rows)


def test_alignment_of_documents_equals_brute_force(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert aligned(spark, docs, pair, buckets=3) == plain_alignment(pair, [tuple(r) for r in docs.collect()])


def test_alignment_of_nothing(spark, nothing, pair):
    assert align.align(spark, nothing, pair).isEmpty() and align.token_links(spark, nothing, pair).isEmpty()


def test_token_links_say_where_groups_stand(spark, edges, pair):
    for r in align.token_links(spark, edges.where("length(text) < 3000 or text is null"), pair).collect():
        text = next(t for k, t in EDGES if k == r.doc_id)
        assert [(g.a, g.b) for g in r.groups] == plain_groups(pair, text)
        if r.groups:
            assert r.groups[0].start == 0 and r.groups[-1].end == len((" " + text).encode())
            assert all(x.end == y.start for x, y in zip(r.groups, r.groups[1:]))


def test_units_are_cut_at_ascii_spaces_and_encoded_once_a_batch(pair, monkeypatch):
    tokenizers, encoded = align.Pair(*pair), []
    encode = tokenizers.encode
    monkeypatch.setattr(tokenizers, "encode", lambda units: encoded.extend(units) or encode(units))
    texts = ["The sum, 12 of 3.14 isn't x", None, "le été !a 12 of", "a  b \tc 's 12", "", "a ▁ b of", "don't 's d'été <s> x<s> 12"]
    found = align.Aligner(tokenizers).align(texts)
    assert len(encoded) == len(set(encoded)) and {"The", "sum,", "12", "of", "3.14", "isn't", "x", "x<s>", "a ▁ b"} <= set(encoded)
    groups = [plain_groups(pair, text) if text else [] for text in texts]
    assert found.n_groups.tolist() == list(map(len, groups)) and not groups[5]
    assert found.ids_a.tolist() == [i for own in groups for a, _ in own for i in a]
    assert found.ids_b.tolist() == [i for own in groups for _, b in own for i in b]


def test_merge_moves_all_stretches_at_once():
    rng = np.random.default_rng(2)
    ends, at, want = [[], []], [[], []], []
    total = 0
    for _ in range(50):
        length = int(rng.integers(1, 60))
        own = [sorted({length, *rng.integers(1, length + 1, rng.integers(1, 30)).tolist()}) for _ in range(2)]
        for side, marks, start in zip(ends, own, at):
            start.append(len(side))
            side += [total + m for m in marks]
        want += [(ends[0].index(total + c), ends[1].index(total + c)) for c in sorted(set(own[0]) & set(own[1]))]
        total += length
    until = np.array([*at[0][1:], len(ends[0])])
    got = align.merge(*map(np.array, ends), *map(np.array, at), until)
    assert list(zip(*(g.tolist() for g in got))) == want
