"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in ascending order of (doc_id, size, checksum of the text), nulls
first. A keyed Feistel network permutes the least even number of bits that holds n; numbers that
land at n or beyond are walked along their cycle until they come back below n. The result is a
bijection of 0 .. n-1 that needs no state: shard = permuted mod shards, slot = permuted div shards,
and either can be computed, or inverted, for one row alone.

Numbering never gathers rows in one task: they are range partitioned, counted by partition, and a
row's number is its partition's offset plus its place there. Only a count a partition reaches the
driver.

Defined results: a null text has size 1 and checksum 0; rows alike in id and text get different
numbers, in any order; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SHARDS = 16
SEED = 20240229
ROUNDS = 6


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """Below 2^31, by a linear congruential step a round."""
    keys, x = [], seed % 2147483648
    for _ in range(rounds):
        x = (x * 1103515245 + 12345) % 2147483648
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    # every product stays below 2^63, so that SQL's integers can follow
    t = (x * 1103515245 + key) % 2147483648
    t = ((t ^ (t >> 15)) * 1540483477) % 2147483648
    return (t >> 5) & mask


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The bijection of 0 .. n-1. n may be up to 2^52."""
    bits = half_bits(n)
    if bits > 26:
        raise ValueError("more than 2^52 rows")
    mask, keys = (1 << bits) - 1, round_keys(seed)
    out = np.array(numbers, dtype=np.int64)
    if ((out < 0) | (out >= n)).any():
        raise ValueError("a number outside 0 .. n-1")
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> bits, out[walking] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ _scramble(left, key, mask), left
            else:
                left, right = right, left ^ _scramble(right, key, mask)
        out[walking] = (left << bits) | right
        walking = walking[out[walking] >= n]
    return out


def number_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, number) for every row, and how many rows there are."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "doc_id", "size", "text_crc32").sortWithinPartitions("doc_id", "size", "text_crc32")
    # monotonically_increasing_id is the partition in the upper 31 bits, the place below
    placed = materialise(ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, offset long"))  # a row a partition
    numbered = placed.withColumn("part", part).join(offsets, "part")
    number = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select("doc_id", "size", "text_crc32", number.alias("number")), total


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot. Shards differ by one row at most."""
    numbered, n = number_rows(docs, id_col, text)

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    at = numbered.withColumn("at", permuted("number"))
    return at.select(
        "doc_id", "size", "text_crc32", "number",
        F.pmod("at", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"at div {int(shards)}").alias("slot"),
    )
