"""FIFO queues as tables: JSON records in an explicit order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.ordering import first_in_order
from linkloom.session import written
from linkloom.sources.tables import exclude_stored, store, stored, versions_below, with_once


class Pulled(NamedTuple):
    taken: DataFrame
    rest: DataFrame


def encode(df: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """Queue rows ``(seq, value)`` with the columns as one JSON object."""
    return df.select(F.col(order).alias("seq"), F.to_json(F.struct(*columns)).alias("value"))


def encode_tuple(df: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """Like ``encode``, as a JSON array of the values in column order."""

    def element(name: str):
        listed = F.to_json(F.array(name), {"ignoreNullFields": "false"})
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    body = F.concat_ws(",", *[element(name) for name in columns])
    return df.select(F.col(order).alias("seq"), F.concat(F.lit("["), body, F.lit("]")).alias("value"))


#: Strings, numbers and nesting of any size that the session can hold.
_MOST = str(2**31 - 1)
_JSON = {"maxStringLen": _MOST, "maxNumLen": _MOST, "maxNestingDepth": _MOST, "allowSingleQuotes": "false"}
#: Up to so many keys are cut off by a plain ordered limit, which one task ends; more are numbered.
_LIMIT = 1 << 20


def _typed(raw: Column, kind: T.DataType) -> Column:
    """A field's JSON text as its type; null where it has another one."""
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(raw, kind, _JSON)
    return raw.try_cast(kind)


def decode(queue: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Typed records of the rows that hold a JSON object or array; the others are skipped.

    A field is taken by name from an object (of a repeated name the last one) and
    by place from an array. A field of another type, or none, is null.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # As the only element of an array: text behind a record makes the row invalid.
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(T.StringType()), _JSON)
    found = with_once(queue.select("seq", "value"), "_records", alone).where(F.size("_records") == 1)
    whole = found.select("seq", F.regexp_replace(F.col("_records")[0], r"^\s+", "").alias("_json"))
    whole = whole.where(F.col("_json").rlike(r"^[\[{]"))
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    is_list = F.startswith("_json", F.lit("["))
    parsed = F.struct(
        F.when(~is_list, F.from_json("_json", names, _JSON)).alias("named"),
        F.when(is_list, F.from_json("_json", T.ArrayType(T.StringType()), _JSON)).alias("listed"),
    )
    both = with_once(whole, "_parsed", parsed)

    def field(place: int, name: str, kind: T.DataType) -> Column:
        by_name, by_place = F.col("_parsed.named")[name], F.get(F.col("_parsed.listed"), place)
        return _typed(F.coalesce(by_name, by_place), kind).alias(name)

    return both.select("seq", *[field(i, f.name, f.dataType) for i, f in enumerate(schema.fields)])


def _last_of(records: DataFrame, limit: int) -> DataFrame:
    """One row: the order key of the last of the first ``limit`` written records, null if there are fewer."""
    keys = records.select("seq")
    keys = keys.orderBy("seq").limit(limit) if limit <= _LIMIT else first_in_order(keys, "seq", limit)
    return keys.agg(F.when(F.count("*") >= limit, F.max("seq")).alias("last"))


def _first(queue: DataFrame, schema: T.StructType | str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` records and the key of the last: every value is decoded once."""
    records = written(decode(queue, schema), "records")
    last = written(_last_of(records, limit), "last")
    return records.where((F.col("seq") <= last.scalar()) | last.scalar().isNull()), last


def peek(queue: DataFrame, schema: T.StructType | str, limit: int = -1) -> DataFrame:
    """The first ``limit`` decodable records (-1: all), leaving the queue as it is."""
    if limit <= 0:
        return decode(queue, schema) if limit else decode(queue, schema).limit(0)
    return _first(queue, schema, limit)[0]


def pull(queue: DataFrame, schema: T.StructType | str, limit: int = -1) -> Pulled:
    """Like ``peek``, and what remains.

    Undecodable rows before the cut are gone too, and a pull that finds fewer
    than ``limit`` records has used up the queue.
    """
    if limit <= 0:
        return Pulled(peek(queue, schema, limit), queue if limit == 0 else queue.limit(0))
    taken, last = _first(queue, schema, limit)
    return Pulled(taken, queue.where(F.col("seq") > last.scalar()))


_PLACE = T.StructType([T.StructField("push", T.LongType()), T.StructField("seq", T.LongType())])


def take(spark, path: str, schema: T.StructType | str, limit: int, batch_id: int, name: str = "taken") -> DataFrame:
    """The next ``limit`` decodable records (-1: all) of a stored list, which then are gone for later pulls.

    The queue that ``push_list`` stored is read in the order of pushes, then of
    ``seq``, behind the place where the pulls below ``batch_id`` ended; where this one ends is stored as
    its version. Running a pull again takes the same rows, even if more were pushed
    since. Rows that can't be decoded go with the records behind them. Readers of their own ``name`` don't
    take from each other. ``(push, seq, ...)`` is returned, a written table.
    """
    places = f"{path}/{name}"
    known = stored(spark, places, _PLACE)
    at = F.struct(F.col("batch_id").alias("push"), "seq")
    begin = known.where(F.col("batch_id") < batch_id).agg(F.max(F.struct("push", "seq"))).first()[0]
    end = known.where(F.col("batch_id") == batch_id).select(F.struct("push", "seq")).first()
    rows = read_list(spark, path).select(at.alias("seq"), "value")
    place = lambda p: F.struct(F.lit(p["push"]).cast("bigint").alias("push"), F.lit(p["seq"]).cast("bigint").alias("seq"))
    rows = rows.where(F.col("seq") > place(begin)) if begin else rows
    if end:
        taken = written(decode(rows.where(F.col("seq") <= place(end[0])), schema), "taken")
    elif limit == 0:
        taken = decode(rows.limit(0), schema)
    else:
        records = written(decode(rows, schema), "records")
        last = None if limit < 0 else _last_of(records, limit).first()["last"]
        # A pull that finds fewer records has seen, and used up, all that is there.
        last = last or rows.agg(F.max("seq")).first()[0]
        taken = records.where(F.col("seq") <= place(last)) if last else records
        if last:
            mark = spark.range(1).select(F.lit(last["push"]).cast("bigint").alias("push"), F.lit(last["seq"]).cast("bigint").alias("seq"))
            store(mark, places, batch_id)
    others = [c for c in taken.columns if c != "seq"]
    return taken.select(F.col("seq.push").alias("push"), F.col("seq.seq").alias("seq"), *others)


def _limited(df: DataFrame, limit: int, copy: bool) -> Pulled:
    """The first ``limit`` rows (-1: all) to push, and what the sender keeps."""
    taken = df if limit == -1 else first_in_order(df, "seq", limit)
    if copy:
        return Pulled(taken, df)
    if limit == -1:
        return Pulled(taken, df.limit(0))
    if limit == 0:
        return Pulled(taken, df)
    last = taken.agg(F.when(F.count("*") >= limit, F.max("seq"))).scalar()
    return Pulled(taken, df.where(F.col("seq") > last))


def push_list(df: DataFrame, path: str, batch_id: int, limit: int = -1, copy: bool = False) -> DataFrame:
    """Append the first ``limit`` queue rows as one version; pushing a batch again replaces it.

    Returns what the sender keeps: the rest, or with ``copy`` everything.
    """
    sent = _limited(df, limit, copy)
    store(sent.taken, f"{path}/list", batch_id)
    return sent.rest


def push_set(df: DataFrame, path: str, batch_id: int, limit: int = -1, copy: bool = False) -> DataFrame:
    """Add the values of the first ``limit`` rows that are not in the stored set; returns what the sender keeps."""
    sent = _limited(df, limit, copy)
    schema = T.StructType([T.StructField("value", T.StringType())])
    values = written(sent.taken.select("value").distinct(), "values")
    known = versions_below(df.sparkSession, f"{path}/set", schema, batch_id)
    store(exclude_stored(values, known, "value"), f"{path}/set", batch_id)
    return sent.rest


def push_both(df: DataFrame, path: str, batch_id: int, limit: int = -1, copy: bool = False) -> DataFrame:
    """Append the first ``limit`` rows to the list, and add their new values to the set; returns what the sender keeps."""
    sent = _limited(df, limit, copy)
    push_list(sent.taken, path, batch_id)
    push_set(sent.taken, path, batch_id)
    return sent.rest


def read_list(spark, path: str) -> DataFrame:
    """The pushed queue; order by ``(batch_id, seq)``."""
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])
    return stored(spark, f"{path}/list", schema)


def read_set(spark, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("value", T.StringType())])
    return stored(spark, f"{path}/set", schema).select("value")
