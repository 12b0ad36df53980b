"""The four builders that every read is made of.

A log has kvs, key, seqno, ord, vtype (V, T or PT), value and txn_id. Versions are ordered by (seqno, ord), because plain
mutations share a seqno and the later one replaces the earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGE = F.struct  # (seqno, ord)


def keyed(log: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    return [*(["kvs"] if "kvs" in log.columns else []), *extra]


def committed(log: DataFrame, txns: DataFrame) -> DataFrame:
    """Rows without a transaction, and those of committed ones at their commit's seqno."""
    state = txns.select(F.col("txn_id").alias("_txn"), "state", "commit_seqno")
    joined = log.join(state, F.col("txn_id") == F.col("_txn"), "left")
    kept = joined.where(F.col("txn_id").isNull() | (F.col("state") == "committed"))
    return kept.withColumn("seqno", F.coalesce("commit_seqno", "seqno")).select(*log.columns)


def newest(rows: DataFrame, by: Sequence[str], columns: Sequence[str], when: Column | None = None, name: str = "_v") -> Column:
    """The columns of the newest row of a group, as a struct; combined before the shuffle."""
    value, age = F.struct(*columns), F.struct("seqno", "ord")
    if when is not None:
        value, age = F.when(when, value), F.when(when, age)
    return F.max_by(value, age).alias(name)


def versions(log: DataFrame, view: int | None = None) -> DataFrame:
    """The visible version of each key, values and tombstones alike, prefix tombstones left out."""
    rows = log.where(F.col("vtype") != "PT")
    if view is not None:
        rows = rows.where(F.col("seqno") <= view)
    by = keyed(log, ["key"])
    return rows.groupBy(*by).agg(newest(rows, by, ["vtype", "value", "seqno"])).select(*by, "_v.*")


def prefix_tombstones(log: DataFrame, view: int | None = None) -> DataFrame:
    """The newest seqno of each prefix tombstone."""
    rows = log.where(F.col("vtype") == "PT")
    if view is not None:
        rows = rows.where(F.col("seqno") <= view)
    return rows.groupBy(*keyed(log), F.col("key").alias("prefix")).agg(F.max("seqno").alias("pt_seq"))


def mask(rows: DataFrame, tombstones: DataFrame, pfx_len: int) -> DataFrame:
    """Drop what a newer prefix tombstone hides: strictly newer, so that equal seqnos survive, and only keys of
    pfx_len or more bytes. Masking the newest version is enough, as what hides it hides all older ones.

    One row for each prefix joins; the optimizer broadcasts it by its measured size or else splits hot prefixes.
    """
    by = keyed(rows)
    pts = tombstones.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("prefix").alias("_prefix"), "pt_seq")
    same = (F.substring("key", 1, pfx_len) == F.col("_prefix")) & (F.length("key") >= pfx_len)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    hidden = F.col("pt_seq").isNotNull() & (F.col("pt_seq") > F.col("seqno"))
    return rows.join(pts, same, "left").where(~hidden).select(*rows.columns)


def visible(log: DataFrame, view: int | None = None, pfx_len: int = 0, where: Column | None = None) -> DataFrame:
    """Live pairs at a view. `where` is on keys and comes before versions are picked, as key filters commute with that; filters
    on values have to come after."""
    # Prefix tombstones are read from the whole log below, so that the filter on keys reaches the scan by itself.
    found = versions(log if where is None else log.where(where), view)
    if pfx_len:
        found = mask(found, prefix_tombstones(log, view), pfx_len)
    return found.where(F.col("vtype") == "V").drop("vtype")
