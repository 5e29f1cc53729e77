"""Blocked Bloom filter as DataFrame operators (O-B1..O-B5, O-B7).

A key belongs to one block of 32,768 bits and sets all its bits there.  A filter is a
table of blocks (block number, bitmap), made by Spark's bitmap aggregates with a
partial step before the shuffle, and a probe is one equi-join row.  Stored generations
use the Parquet bloom filter instead, which the reader consults by itself (O-B6).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of the bitmaps that Spark's aggregates make.
BLOCK_BITS = 32_768


@dataclass(frozen=True)
class BloomShape:
    bits: int
    hashes: int

    @classmethod
    def for_keys(cls, keys: int, fpr: float = 0.01) -> "BloomShape":
        """Size for an expected number of keys: at least 8 bits and one hash; a rate
        outside (0, 1) counts as 0.01 and fewer than one key as one."""
        keys = max(1, keys)
        fpr = fpr if 0 < fpr < 1 else 0.01
        bits = max(8, math.ceil(-keys * math.log(fpr) / math.log(2) ** 2))
        return cls(bits, max(1, round(bits / keys * math.log(2))))

    @property
    def blocks(self) -> int:
        return -(-self.bits // BLOCK_BITS)

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(self.blocks).cast("long"))

    def positions(self, key: Column) -> Column:
        """Array of the key's bit positions in its block, by double hashing."""
        m = F.lit(min(BLOCK_BITS, -(-self.bits // self.blocks))).cast("long")
        first, second = F.pmod(F.xxhash64(key), m), F.pmod(F.xxhash64(F.lit("second"), key), m)
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(first + i.cast("long") * second, m))


def build(keys: DataFrame, shape: BloomShape) -> DataFrame:
    """(block, bitmap) of all blocks that have a set bit."""
    set_bits = keys.select(shape.block(F.col("key")).alias("block"), F.explode(shape.positions(F.col("key"))).alias("position"))
    return set_bits.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bitmap"))


def might_contain(probes: DataFrame, bits: DataFrame, shape: BloomShape) -> DataFrame:
    """key and might_contain of each distinct probe; False means surely absent."""
    asked = probes.select("key").distinct().select("key", shape.block(F.col("key")).alias("block"), shape.positions(F.col("key")).alias("positions"))
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    there = F.forall("positions", lambda p: F.getbit(byte(p), F.pmod(p, F.lit(8)).cast("int")) == 1)
    return asked.join(bits, "block", "left").select("key", (F.col("bitmap").isNotNull() & there).alias("might_contain"))


def skipped(probes: DataFrame, bits: DataFrame, shape: BloomShape) -> DataFrame:
    """How many probes there are, and how many the filter rules out (O-B7)."""
    found = might_contain(probes, bits, shape)
    return found.agg(F.count("*").alias("probes"), F.count_if(~F.col("might_contain")).alias("skipped"))


def to_bytes(bits: DataFrame, shape: BloomShape) -> bytes:
    """Serialised blocks one after another (fixed size: the filter's own)."""
    size = BLOCK_BITS // 8
    out = bytearray(shape.blocks * size)
    for row in bits.toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = row["bitmap"]
    return bytes(out)


def from_bytes(spark, data: bytes, shape: BloomShape) -> DataFrame:
    size = BLOCK_BITS // 8
    return spark.createDataFrame([(i, data[i * size : (i + 1) * size]) for i in range(shape.blocks)], "block long, bitmap binary")
