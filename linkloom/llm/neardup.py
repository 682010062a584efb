"""MinHash near-dedup on bottom-k sketches of one hash function, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Memo, each, per_row, ragged, small_batches, utf8, words
from linkloom.llm.graph import components
from linkloom.operators.ordering import numbered
from linkloom.session import written

SHINGLE, SIMILARITY = 5, 80
#: Retained hash values of a set.
SKETCH = 48
#: Two sets go on to verification when so many percent of their union sketch lie in both. At a
#: similarity of 80 % that fails for fewer than one pair in 100,000.
LEAST_ESTIMATE = 50
#: A block of sets compared at once: sets, and shingles in all, on average.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18
#: Up to so many document ids are broadcast to pick out texts (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(sequence: list[bytes], size: int, memo: Memo) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, ascending; a shorter text is one run."""
    if not sequence:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, sequence), np.uint64, len(sequence))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def _word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def _sketches(size: int):
    def start():
        memo = _word_memo()

        def sketch(texts: pa.Array) -> pa.Array:
            sets = [shingle_hashes(words(data), size, memo) for data in each(texts)]
            least = [s[:SKETCH] for s in sets]
            flat = np.concatenate([*least, np.zeros(0, np.int64)])
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                ragged(np.array([len(s) for s in least], np.int64), pa.array(flat)),
            ]
            return pa.StructArray.from_arrays(columns, names=["n", "set_id", "sketch"])

        return sketch

    return per_row(start, "n bigint, set_id binary, sketch array<bigint>")


def _full_sets(size: int):
    def start():
        memo = _word_memo()

        def full(texts: pa.Array) -> pa.Array:
            sets = [shingle_hashes(words(data), size, memo) for data in each(texts)]
            return ragged(np.array([len(s) for s in sets], np.int64), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))

        return full

    return per_row(start, "array<bigint>")


def _alike(a: str, b: str) -> Column:
    """Whether the union sketch of two sketches says that the sets may be similar enough."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            union = np.union1d(x, y)[:SKETCH]
            shared = np.intersect1d(x, y, assume_unique=True)
            out.append(bool(100 * (shared <= union[-1]).sum() >= LEAST_ESTIMATE * len(union)))
        return pa.array(out, pa.bool_())

    return alike(a, b)


def lists(nodes: DataFrame) -> DataFrame:
    """Inverted lists ``(value, node)``, in which any two sketches that share enough values meet.

    Sketches of s values that share t = s * LEAST_ESTIMATE % or more meet among
    the s - t + 1 rarest values of each. The rest, common passages above all,
    is not listed. A value of one set only meets nothing but takes its place.
    """
    values = nodes.select("node", F.explode("sketch").alias("value"))
    common = written(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "values")
    counted = written(values.join(common, "value"), "listed")
    ranked = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    size = nodes.select("node", F.size("sketch").alias("s"))
    needed = F.ceil(F.col("s") * LEAST_ESTIMATE / 100)
    kept = ranked.join(size, "node").withColumn("keep", F.size("values") - needed + 1).where("keep > 0")
    return kept.select("node", F.explode(F.slice("values", F.lit(1), F.col("keep").cast("int"))["value"]).alias("value"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` ``(id, text)`` of the given ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.where(100 * shared >= similarity * union).select("a", "b")


def _links_in(sets_a: list[np.ndarray], sets_b: list[np.ndarray], similarity: int) -> np.ndarray:
    """Matrix of the pairs similar enough: shared shingles are counted by a product of incidence matrices."""
    flat = [np.concatenate(side) for side in (sets_a, sets_b)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (sets_a, sets_b)]
    shared = np.zeros((len(sets_a), len(sets_b)), np.float64)
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    for at in range(0, len(common), 4096):
        some = common[at : at + 4096]
        sides = []
        for values, row, count in zip(flat, rows, shared.shape):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            matrix = np.zeros((count, len(some)), np.float32)
            matrix[row[hit], place[hit]] = 1
            sides.append(matrix)
        shared += sides[0] @ sides[1].T
    sizes = [np.array([len(s) for s in side], float) for side in (sets_a, sets_b)]
    return 100 * shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: fewer of them than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _residual_links(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between sets of one list that the leaders have left in different components.

    ``rest`` is ``(value, node, component)``. Lists that share nodes make a
    cluster. Its sets are dealt out to blocks, components apart, and each pair
    of blocks with different components meets in a cell; a cell's task counts all
    shared shingles at once and hands on no more links than it has sets.
    """
    link = rest.select(F.col("node").alias("b"), F.concat(F.lit("v"), F.col("value").cast("string")).alias("a"))
    link = link.select("a", F.concat(F.lit("n"), F.col("b").cast("string")).alias("b"))
    cluster = components(link).where(F.col("node").startswith("n"))
    cluster = cluster.select(F.substring("node", 2, 30).cast("bigint").alias("node"), F.xxhash64("component").alias("cluster"))
    own = rest.select("node", "component").distinct()
    with_size = cluster.join(own, "node").join(sets.groupBy("node").agg(F.sum(F.size("set")).alias("n")), "node")
    members = written(with_size, "members")
    largest = members.groupBy("cluster", "component").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    whole = largest.groupBy("cluster").agg(
        F.max(F.struct("m", "component"))["component"].alias("main"), F.sum("m").alias("sets"), F.sum("t").alias("shingles")
    )
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    whole = written(whole.withColumn("blocks", blocks), "clusters")
    # Blocks 0..n-1 hold the largest component, n..2n-1 all others; the former needn't meet each other.
    number = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(whole, "cluster").withColumn("block", F.when(F.col("component") == F.col("main"), number).otherwise(number + F.col("blocks")))
    others = F.sequence(F.col("blocks"), 2 * F.col("blocks") - 1)
    every = F.sequence(F.lit(0), 2 * F.col("blocks") - 1)
    met = dealt.withColumn("other", F.explode(F.when(F.col("block") < F.col("blocks"), others).otherwise(every)))
    cells = met.select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("first"), (F.col("block") >= F.col("other")).alias("second"), "node", "component",
    )
    filled = cells.join(sets, "node").select("cluster", "i", "j", "first", "second", "node", "component", "set")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        values = [v.values.to_numpy() for v in table.column("set")]
        sides = [np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second")]
        found: list[tuple[int, int]] = []
        if all(map(len, sides)):
            a, b = sides
            linked = _links_in([values[i] for i in a], [values[i] for i in b], similarity)
            linked &= component[a][:, None] != component[b][None, :]
            found = _forest((int(node[a[i]]), int(node[b[j]])) for i, j in zip(*np.nonzero(linked)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return filled.groupBy("cluster", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, a row for every row of ``docs``.

    A document is its set of distinct runs of ``shingle`` words (lower-cased A-Z,
    between ASCII white space); a shorter text is one run, a text without words
    or null is empty and linked with nothing. Sets of a Jaccard similarity of
    ``similarity`` percent or more are linked; ``component_id`` is the smallest
    key reachable and ``kept`` tells whether it is the row's own. Rows with the
    same key are one document with several texts. Rows without a key are kept,
    linked with nothing, and have no component. Keys are integers.

    Equal sets are one class, whatever their number. Sketches of classes meet in
    inverted lists; each list's first class is its leader. Leaders' pairs are
    filtered by union-sketch estimation and verified on full sets. A list is done
    when all of it is one component; the rest is compared in blocks, exactly.
    """
    small_batches(spark)
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    marked = source.select("id", _sketches(shingle)(utf8("text")).alias("s")).select("id", "s.n", "s.set_id", "s.sketch")
    rows = written(marked, "sketches")
    usable = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = written(usable.groupBy("set_id").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch")), "classes")
    listed = written(lists(classes), "lists")
    leaders = written(listed.groupBy("value").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1"), "leaders")
    pairs = listed.join(leaders, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    sketch = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    likely = pairs.join(sketch("b"), "b").join(sketch("a"), "a").where(_alike("sketch_a", "sketch_b")).select("a", "b")
    likely = written(likely, "pairs")

    # Full sets of the classes that any list holds; the text of any copy will do, that of the node is taken.
    held = listed.join(leaders.select("value"), "value", "left_semi").select(F.col("node").alias("id")).distinct()
    held = written(held, "held")
    full = _texts_of(source, held).select(F.col("id").alias("node"), _full_sets(shingle)(utf8("text")).alias("set"))
    sets = written(full.where(F.size("set") > 0), "sets")
    links = written(_verified(likely, sets, similarity), "links")
    first = written(components(links), "first-components")
    both = listed.join(leaders.select("value"), "value").join(first, "node", "left")
    both = written(both.select("value", "node", F.coalesce("component", "node").alias("component")), "list-components")
    split = both.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
    rest = written(both.join(written(split, "split-lists"), "value"), "rest")
    more = _residual_links(rest, sets, similarity)
    edges = links.unionByName(more)
    # A key with several texts ties their classes together, through the key itself. Its copies meet first.
    several = usable.groupBy("id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("id")
    several = written(several, "several")
    if not several.isEmpty():
        texts = usable.select("id", "set_id").distinct().join(several, "id").join(classes.select("set_id", "node"), "set_id")
        edges = edges.unionByName(texts.select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    final = written(components(edges), "final-components")
    of_class = classes.select("set_id", "node").join(final, "node", "left")
    of_class = written(of_class.select("set_id", F.coalesce("component", "node").alias("component")).groupBy("set_id").agg(F.min("component").alias("component")), "class-components")
    out = rows.select("id", "n", "set_id").join(of_class, "set_id", "left")
    component = F.when(F.col("n") > 0, F.least("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _told_apart(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with a number ``_id`` that is the key, or where keys have several texts one for each key and text, in that order."""
    hashed = F.xxhash64(text)
    several = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(hashed).alias("x"), F.max(hashed).alias("y")).where("x <> y")
    if several.isEmpty():
        return docs.withColumn("_id", F.col(key).cast("bigint"))
    named = docs.withColumn("_text", F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(1), text), F.coalesce(F.length(text), F.lit(-1))))
    each_text = named.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("_text").alias("_named")).distinct()
    numbers = numbered(each_text, ["_key", "_named"], "_id")
    return named.join(numbers, (F.col(key) == F.col("_key")) & (F.col("_text") == F.col("_named")), "left").drop("_key", "_text", "_named")


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which one a group of near-duplicates stays: that of the smallest key.

    Rows that agree in key and text are one, and the least of them by its columns stays.
    Rows with one key and different texts are different documents here: a row goes only
    if a near-duplicate of its own text stays. Rows without a key stay.
    """
    told = _told_apart(docs, key, text)
    found = near_duplicates(spark, told.select("_id", text), "_id", text, shingle, similarity).where(F.col("_id").isNotNull())
    marks = found.groupBy("_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 or not kept")
    changed = written(marks.select(F.col("_id").alias("_key"), F.when(F.col("kept"), True).alias("_repeated")), "changed")
    few = changed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast(changed) if few else changed
    rest = told.join(side.select("_key"), F.col("_id") == F.col("_key"), "left_anti").drop("_id")
    repeated = changed.where("_repeated")
    if repeated.isEmpty():
        return rest
    rows = told.join(repeated.select("_key"), F.col("_id") == F.col("_key"), "left_semi")
    least = rows.groupBy("_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rest.unionByName(least.select("row.*"))
