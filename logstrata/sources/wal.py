"""Replay of write-ahead and catalog logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, txns: DataFrame, persisted: int, usable: int) -> DataFrame:
    """Operations to apply after a crash, with the generation and record order (dgen, ord) to apply them in.

    An operation of a transaction counts only if its commit is there and usable, and takes the commit's seqno and generation; what is
    already persisted is skipped.
    """
    state = txns.where((F.col("state") == "committed") & (F.col("commit_seqno") <= usable))
    state = state.select(F.col("txn_id").alias("_txn"), "commit_seqno", F.col("dgen").alias("_dgen"))
    joined = log.join(state, F.col("txn_id") == F.col("_txn"), "left").where(F.col("txn_id").isNull() | F.col("_txn").isNotNull())
    dgen = F.col("dgen") if "dgen" in log.columns else F.lit(0)
    found = joined.withColumn("seqno", F.coalesce("commit_seqno", "seqno")).withColumn("dgen", F.coalesce("_dgen", dgen))
    return found.where(F.col("seqno") > persisted).select(*log.columns, *([] if "dgen" in log.columns else ["dgen"]))


def compact_catalog(records: DataFrame, key: str, order: str) -> DataFrame:
    """The newest record of each id."""
    whole = F.struct(*records.columns)
    return records.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("_r")).select("_r.*")


def recover_catalog(records: DataFrame) -> DataFrame:
    """Live runs of a catalog log of transactions.

    records: seq, txn, op (start, add, delete, ack, nak), kvset_id, adds. A transaction whose adds are all recorded is rolled forward
    even without its ack; one that lacks some, or has a nak, is rolled back. Deletes count once it is forward.
    """
    by_txn = records.groupBy("txn").agg(
        F.max("adds").alias("want"), F.count_if(F.col("op") == "add").alias("have"), F.count_if(F.col("op") == "nak").alias("naks")
    )
    forward = by_txn.where((F.col("naks") == 0) & (F.col("have") >= F.coalesce("want", F.lit(0)))).select("txn")
    kept = records.join(forward, "txn", "left_semi").where(F.col("op").isin("add", "delete"))
    last = kept.groupBy("kvset_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return last.where("op = 'add'").select("kvset_id", "seq")
