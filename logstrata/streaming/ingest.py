"""Streaming ingest: committed rows go to the store's log, open ones wait, aborted ones are dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_root


def resolve(waiting: DataFrame, txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to ingest, rows that wait). A transaction is ingested as a whole, once its outcome is known."""
    state = txns.select(F.col("txn_id").alias("_txn"), "state", "commit_seqno")
    joined = waiting.join(state, F.col("txn_id") == F.col("_txn"), "left")
    done = joined.where(F.col("txn_id").isNull() | (F.col("state") == "committed"))
    done = done.withColumn("seqno", F.coalesce("commit_seqno", "seqno")).select(*waiting.columns)
    open_ = joined.where(F.col("txn_id").isNotNull() & (F.coalesce("state", F.lit("active")) == "active")).select(*waiting.columns)
    return done, open_


def start_ingest(stream: DataFrame, txns, home: str, checkpoint: str):
    """Ingest a stream of log rows into home/log, keeping open rows in home/open by batch.

    txns() gives the transactions known by now. Output folders carry the batch's number and are overwritten, so a batch that is
    run again after a failure leaves the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{home}/open/batch={number - 1}"))
        done, open_ = resolve(rows, txns())
        done.write.mode("overwrite").parquet(f"{home}/log/batch={number}")
        open_.write.mode("overwrite").parquet(f"{home}/open/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(log: DataFrame, txns: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """Write a log as files, stream them through an ingest, and return the log that comes out."""
    spark = log.sparkSession
    home = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    log.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/in")
    start_ingest(stream, lambda: txns, home, f"{home}/checkpoint").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{home}/log")
