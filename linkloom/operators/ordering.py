"""Dense numbering and ordered limits without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import written

_SLOT_BITS = 33  # monotonically_increasing_id: partition above, row below


def numbered(df: DataFrame, order: list[str], name: str = "n", start: Column | int = 1) -> DataFrame:
    """Number rows ``start, start+1, …`` in the given total order.

    The rows are range-sorted and written with their (partition, row) slot, so
    that both readers below see one layout. The offsets have one row per sort
    partition; that bounds both their unpartitioned window and the broadcast.
    Pass only the columns that must travel with the number.
    """
    slots = written(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "order")
    return from_slots(slots, name, start)


def from_slots(slots: DataFrame, name: str = "n", start: Column | int = 1) -> DataFrame:
    """Number the rows of a range-sorted, written table by their (partition, row) ``_slot``, which goes."""
    part = F.shiftright("_slot", _SLOT_BITS)
    sizes = slots.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part").alias("_offset_part"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    row = F.col("_slot").bitwiseAND((1 << _SLOT_BITS) - 1)
    start = start if isinstance(start, Column) else F.lit(start)
    return slots.join(F.broadcast(offsets), part == F.col("_offset_part")).select(
        *[c for c in slots.columns if c != "_slot"], (F.col("_offset") + row + start).cast("bigint").alias(name)
    )


def first_in_order(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The ``limit`` first rows by a unique order column.

    The cut is found on the order column alone, which is range-sorted and
    counted by partition; the rows are then filtered where they are.
    """
    keys = numbered(df.select(order), [order], "_n").where(F.col("_n") <= limit)
    return df.where(F.col(order) <= keys.agg(F.max(order)).scalar())
