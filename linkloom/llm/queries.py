"""The registered queries of this subpackage: ``name -> f(spark, folder)``, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from linkloom.llm import align, bpe, compress, decontam, fim, langid, lattice, neardup, secrets, suffix, topk, toxicity, wordpiece
from linkloom.llm.common import documents, remainder
from linkloom.sources.tables import table


def op1_bpe(spark, folder):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(spark, documents(spark, folder, "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(spark, ids, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    lexicon = toxicity.learn(spark, docs, table(spark, folder, "labels"), held_out)
    scored = toxicity.score(spark, docs, lexicon)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op3_near_dedup(spark, folder):
    return neardup.near_duplicates(spark, documents(spark, folder, "doc_id", "text"), shingle=4)


def op4_secret_scan(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    scanned = secrets.find_secrets(spark, docs, secrets.learn(docs))

    def listed(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    rank = F.create_map(*[F.lit(x) for i, kind in enumerate([*secrets.KINDS, "format"]) for x in (kind, i)])
    ordered = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return scanned.select(
        "doc_id",
        *[count(kind) for kind in secrets.KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(ordered).alias("spans"),
    )


def op5_decontamination(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    found = decontam.findings(spark, docs, table(spark, folder, "benchmark"))
    return decontam.mark(docs, found).select("doc_id", "contaminated", "item_ids", "score")


def op6_language_id(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    models = langid.learn(spark, docs, held_out)
    found = langid.identify(spark, docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_token_counts(spark, folder):
    pieces = wordpiece.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.token_counts(spark, documents(spark, folder, "doc_id", "text"), pieces).drop("text")


def op8_lm_scores(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    scores = lattice.load_scores(public_tokenizers.path("piece_bpe_32k.model"))
    scored = lattice.score(spark, docs, remainder("doc_id", 10) != 0, scores)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5)


def op10_suffix_dedup(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    found = suffix.repeated_passages(spark, docs)
    by_doc = found.select(F.col("doc").alias("doc_id"), "spans")
    joined = docs.select("doc_id").join(by_doc, "doc_id", "left")
    length = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return joined.select(
        "doc_id",
        F.coalesce(length, F.lit(0)).cast("bigint").alias("repeated_words"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
    )


def op11_quality(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = compress.learn(spark, docs, table(spark, folder, "labels"), held_out)
    scored = compress.score(spark, docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= compress.THRESHOLD).cast("int").alias("predicted"), "difference"
    )


def op12_token_alignment(spark, folder):
    pair = align.load_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(spark, documents(spark, folder, "doc_id", "text"), pair)


def op13_fill_in_middle(spark, folder):
    made = fim.fill_in_middle(documents(spark, folder, "doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_ALL = (
    op1_bpe, op2_toxicity, op3_near_dedup, op4_secret_scan, op5_decontamination, op6_language_id, op7_token_counts, op8_lm_scores,
    op9_top_k, op10_suffix_dedup, op11_quality, op12_token_alignment, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}
