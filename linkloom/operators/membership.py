"""Membership filters: which keys a large stored set surely does not hold.

A Bloom filter cut into blocks. A key's hash names one block of 32,768 bits and
seven bits in it; a block is one row of 4 KB, so the filter is a table that
grows, is shuffled and is read like any other, and never passes the driver. A
set bit proves nothing: whoever asks joins what may be there with the set itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a block (what ``bitmap_construct_agg`` builds), bits per key and bits set per key: about 1 % false positives.
BLOCK = 32768
BITS = 10
PROBES = 7

FILTER = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType()),
    T.StructField("blocks", T.LongType()), T.StructField("slices", T.LongType()),
])

#: Keys of a slice of the stored set, and the most slices it is cut into.
SLICE_KEYS = 1 << 20
SLICES = 4096


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _probes(hashed: Column) -> list[Column]:
    """The bits of a key in its block, from a second hash."""
    start, step = hashed.bitwiseAND(BLOCK - 1), F.shiftright(hashed, 15).bitwiseAND(BLOCK - 1).bitwiseOR(F.lit(1))
    return [(start + i * step).bitwiseAND(BLOCK - 1) for i in range(PROBES)]


def _second(key: str) -> Column:
    return F.xxhash64(F.lit(1), F.xxhash64(key))


def slice_of(key: str, slices: int) -> Column:
    """The slice of the stored set that a key is in."""
    return F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(slices)).cast("int")


def sizes(count: int) -> tuple[int, int]:
    """Blocks and slices for that many keys."""
    return max(1, -(-count * BITS // BLOCK)), max(1, min(SLICES, -(-count // SLICE_KEYS)))


def build(keys: DataFrame, key: str, count: int) -> DataFrame:
    """The filter ``(block, bits, blocks, slices)`` over ``count`` keys, as one row for every block in use.

    Two hashes of a key are shuffled, not the key; a block is built by one task. Nulls are held like any key.
    """
    blocks, slices = sizes(count)
    hashed = keys.select(_block(key, blocks).alias("block"), _second(key).alias("_second")).repartition("block")
    bits = hashed.select("block", F.explode(F.array(*_probes(F.col("_second")))).alias("_bit"))
    built = bits.groupBy("block").agg(F.bitmap_construct_agg("_bit").alias("bits"))
    return built.select("block", "bits", F.lit(blocks).cast("bigint").alias("blocks"), F.lit(slices).cast("bigint").alias("slices"))


def may_hold(candidates: DataFrame, members: DataFrame, key: str, blocks: int) -> DataFrame:
    """The candidates that the set behind a filter of ``blocks`` blocks may hold; all others it surely does not."""
    probed = candidates.withColumns({"_block": _block(key, blocks), "_second": _second(key)})
    joined = probed.join(members.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")), "_block")

    def is_set(bit: Column) -> Column:
        byte = F.substring(F.col("_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        return F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(7).cast("int")) == 1

    held = F.lit(True)
    for bit in _probes(F.col("_second")):
        held &= is_set(bit)
    return joined.where(held).select(*candidates.columns)
