"""Exact top-k search: exhaustive term-at-a-time scoring in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import tidy
from linkloom.session import written

#: Rows of a packed block. A task holds one score array of ``QUERY_ROWS x CANDIDATE_ROWS``.
QUERY_ROWS, CANDIDATE_ROWS = 512, 2048

_BLOCK = "block bigint, ids binary, rows binary, terms binary, weights binary"


def integer_rows(vectors: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``(id, terms, weights)``: the non-zero components as floor(scale * x).

    Rows whose key or vector is null, or whose vector holds a null or non-finite
    component, are left out.
    """
    components = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(components, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(components, lambda x: F.floor(x * scale).cast("bigint"))
    # Beyond 64 bits floor() would stop at the greatest integer: no weight may be that large.
    whole = F.transform(whole, lambda w: F.when(F.abs(w / 2) < F.lit(float(1 << 61)), w).otherwise(F.raise_error(F.lit("a component times the scale leaves 62 bits"))))
    kept = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
    pairs = F.filter(
        F.transform(whole, lambda w, i: F.struct(i.cast("int").alias("term"), w.alias("weight"))),
        lambda p: p["weight"] != 0,
    )
    return kept.select(F.col(key).cast("bigint").alias("id"), pairs.alias("p")).select(
        "id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")
    )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Postings of up to ``size`` rows as one row: the entries of a block by term, then by place.

    A row's place in its block follows its id, so that ties go to the smaller place.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("id").to_numpy()
                terms, weights = part.column("terms"), part.column("weights")
                by_id = np.argsort(ids, kind="stable")
                place = np.empty_like(by_id)
                place[by_id] = np.arange(len(ids))
                row = np.repeat(place, np.diff(terms.offsets.to_numpy())).astype(np.int32)
                term = terms.flatten().to_numpy()
                order = np.lexsort((row, term))
                columns = [ids[by_id], row[order], term[order], weights.flatten().to_numpy()[order]]
                yield pa.record_batch(
                    [pa.array([block]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                    names=["block", "ids", "rows", "terms", "weights"],
                )
                block += 1

    return rows.mapInArrow(tidy(pack), _BLOCK)


def _postings(row: dict, side: str) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    rows, terms = np.frombuffer(row[f"{side}rows"], np.int32), np.frombuffer(row[f"{side}terms"], np.int32)
    weights = np.frombuffer(row[f"{side}weights"], np.int64)
    seen, starts = np.unique(terms, return_index=True)
    cuts = [*starts.tolist(), len(terms)]
    lists = {int(t): (rows[a:b], weights[a:b]) for t, a, b in zip(seen, cuts, cuts[1:])}
    return np.frombuffer(row[f"{side}ids"], np.int64), lists


def _scores(queries: dict, candidates: dict, n_queries: int, n_candidates: int) -> np.ndarray:
    """Dense scores: term by term, a query's weight times the term's postings is added at their places."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    for term, (rows, weights) in queries.items():
        if term not in candidates:
            continue
        columns, values = candidates[term]
        products = np.multiply.outer(weights, values)
        if len(columns) < n_candidates:
            scores[np.ix_(rows, columns)] += products
        elif len(rows) < n_queries:
            scores[rows] += products
        else:
            scores += products
    return scores


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate place) of each query's k best; among ties the smaller places."""
    n = scores.shape[1]
    open_ = np.where(own, np.iinfo(np.int64).min, scores)
    if n > k:
        # All above the k-th best score, and of those that equal it the first ones.
        bar = np.partition(open_, n - k, axis=1)[:, n - k, None]
        above, ties = open_ > bar, open_ == bar
        taken = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        taken = np.ones(scores.shape, bool)
    return np.nonzero(taken & ~own)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best integer inner products of each query row.

    Queries are the rows of ``vectors`` for which ``is_query`` (over the id, as
    column ``id``) holds; candidates are all rows with another id. Ties go to the
    smaller id; a query with fewer candidates gets all of them. Null and
    non-finite vectors and null ids take no part; vectors of any length meet on
    their common components, an empty one scores 0. A repeated row is a candidate
    each time, and a repeated query gets its result each time. An empty table
    gives an empty result. Products and sums are 64-bit integers; where weights
    are so large that a sum could leave 64 bits it is an error, never a wrong score.

    Both sides are packed into blocks of bounded size. Every block of queries
    meets every block of candidates in a cell of its own, by an equi-join on
    the cell, so work is even and nothing is broadcast or collected. A cell
    keeps its k best for each query; those are merged by a windowed rank, which
    Spark limits before the shuffle.
    """
    rows = written(integer_rows(vectors, key, vector), "vectors")
    largest = F.aggregate("weights", F.lit(0).cast("bigint"), lambda m, w: F.greatest(m, F.abs(w)))
    bounds = rows.agg(F.max(largest).alias("weight"), F.max(F.size("weights")).alias("terms")).first()
    if (bounds["weight"] or 0) ** 2 * (bounds["terms"] or 0) >= 1 << 63:
        raise OverflowError(f"weights of up to {bounds['weight']} on {bounds['terms']} components may leave 64 bits")
    asked = rows.where(is_query)
    n_rows = asked.count()
    candidates = written(_packed(rows, CANDIDATE_ROWS), "candidates")
    queries = written(_packed(asked.repartition(n_rows // QUERY_ROWS + 1), QUERY_ROWS), "queries")
    n_candidates, n_queries = max(1, candidates.count()), max(1, queries.count())

    def group(n: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def named(blocks: DataFrame, side: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "rows", "terms", "weights")], "cq", "cc")

    left = named(queries.select("*", group(n_queries).alias("cq"), every(n_candidates).alias("cc")), "q")
    right = named(candidates.select("*", group(n_candidates).alias("cc"), every(n_queries).alias("cq")), "c")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, q_lists = _postings(row, "q_")
                c_ids, c_lists = _postings(row, "c_")
                scores = _scores(q_lists, c_lists, len(q_ids), len(c_ids))
                q, c = _best(scores, q_ids[:, None] == c_ids[None, :], k)
                number = np.int64(row["q_block"])
                yield pa.record_batch(
                    [np.full(len(q), number), q.astype(np.int64), q_ids[q], c_ids[c], scores[q, c]],
                    names=["block", "row", "query_id", "vec_id", "score"],
                )

    cells = left.join(right.hint("merge"), ["cq", "cc"]).drop("cq", "cc", "c_block")
    found = cells.mapInArrow(tidy(search), "block bigint, row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
