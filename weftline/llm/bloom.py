"""A blocked Bloom filter of keys, built and asked with DataFrame functions.

It spares a join: rows that surely have no match need not take part. A filter is a table of blocks of 4 KiB;
one of MAX_BLOCKS at most (64 MiB) is broadcast. A filter sized freely grows with its keys and is then
joined by block, which moves keys but never more than 2 bytes for each member; with ``most`` blocks it
stays within them, and beyond that more rows are likely ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
BITS_PER_KEY = 16
MAX_BLOCKS = 16384


def blocks_for(n_members: int, most: int | None = None) -> int:
    n = max(1, -(-n_members * BITS_PER_KEY // BLOCK_BITS))
    return n if most is None else min(n, most)


def _places(key: list[str], n_blocks: int) -> dict[str, Column]:
    return {"bloom_block": F.pmod(F.xxhash64(F.lit(1), *key), F.lit(n_blocks)), "bloom_bit": F.pmod(F.xxhash64(F.lit(2), *key), F.lit(BLOCK_BITS))}


def filter_of(members: DataFrame, n_blocks: int, key: list[str]) -> DataFrame:
    """(bloom_block, bloom_bits) of the members' keys."""
    marked = members.select(*[c.alias(name) for name, c in _places(key, n_blocks).items()])
    return marked.groupBy("bloom_block").agg(F.expr("bitmap_construct_agg(bloom_bit)").alias("bloom_bits"))


def asked(rows: DataFrame, blocks: DataFrame, n_blocks: int, key: list[str], name: str = "likely") -> DataFrame:
    """rows with a column that is false only where no member of the filter has the row's key."""
    rows = rows.withColumns(_places(key, n_blocks))
    byte = F.conv(F.hex(F.substring("bloom_bits", (F.col("bloom_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bloom_bit % 8 as int))")) != 0
    blocks = F.broadcast(blocks) if n_blocks <= MAX_BLOCKS else blocks
    return rows.join(blocks, "bloom_block", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("bloom_block", "bloom_bit", "bloom_bits")


def with_likely(rows: DataFrame, members: DataFrame, n_members: int, key: list[str]) -> DataFrame:
    """rows, which are not shuffled, with a column ``likely``: false only where no member has the row's key."""
    n_blocks = blocks_for(n_members, MAX_BLOCKS)
    return asked(rows, filter_of(members, n_blocks, key), n_blocks, key)
