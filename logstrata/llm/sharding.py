"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_within, text_or_empty

#: Rows that one numbering block holds on average.
BLOCK_ROWS = 1000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard) for each shard; the least score wins.

    A shard's score depends on the key, the shard and its weight alone, so a shard that is added can only
    take rows to itself, and one that goes gives its rows to all others in proportion to their weights.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    unit = lambda s: (
        F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), s.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5
    ) / F.lit(float(2**52))
    even = len(set(weights)) == 1
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    if even:
        return F.transform(shards, lambda s: F.struct((-F.log(unit(s))).alias("score"), s.alias("shard")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(shards, lambda s: F.struct((-F.log(unit(s)) / F.get(table, s)).alias("score"), s.alias("shard")))


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, key: str = "doc_id"
) -> DataFrame:
    """Assign every row of docs to a shard by its key, with its slot there and where it would go if shards were added.

    Returns doc_id, size, text_crc32, shard, slot, grown_shard. grown_weights must begin with weights.
    A null key counts as the empty key; a null text has size 16 and the checksum of no bytes; rows that share a key
    share a shard and have slots of their own; an empty table gives an empty result. Columns other than
    key and text are not read, so they may have any names.
    """
    grown_weights = list(grown_weights or weights)
    if list(weights) != grown_weights[: len(weights)]:
        raise ValueError("grown_weights must begin with weights")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        rendezvous(name, grown_weights).alias("_scores"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.array_min(F.slice("_scores", 1, len(weights)))["shard"].alias("shard"),
        F.array_min("_scores")["shard"].alias("grown_shard"),
    )
    placed = materialize(placed, "shards")
    blocks = max(1, math.ceil(placed.count() / (len(weights) * BLOCK_ROWS)))
    return number_within(placed, "shard", numbering_block(blocks), ["doc_id", "text_crc32", "size"], "slot")


def numbering_block(blocks: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(blocks))
