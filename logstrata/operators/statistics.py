"""Statistics of runs, nodes and trees, and of operations over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(log: DataFrame, by: str = "run_id") -> DataFrame:
    value = F.col("vtype") == "V"
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("nkeys"),
        F.count_if(F.col("vtype") == "T").alias("ntombs"),
        F.count_if(F.col("vtype") == "PT").alias("nptombs"),
        F.sum(F.length("key")).alias("klen"),
        F.coalesce(F.sum(F.when(value, F.length(F.col("value").cast("string")))), F.lit(0)).alias("vlen"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seqno").alias("min_seqno"),
        F.max("seqno").alias("max_seqno"),
    )


def rollup(log: DataFrame, node: str = "node_id", run: str = "run_id") -> DataFrame:
    """Keys, tombstones and bytes by run, by node, and in total (nulls)."""
    return log.rollup(node, run).agg(
        F.count(F.lit(1)).alias("nkeys"), F.count_if(F.col("vtype") == "T").alias("ntombs"), F.sum(F.length("key")).alias("klen")
    )


def space_amplification(nodes: DataFrame) -> DataFrame:
    """(leaf + root bytes) / good leaf bytes, where all of the root counts as garbage; null without good bytes.

    nodes: is_root, bytes, keys, uniq. A leaf's good share is its unique keys over all.
    """
    leaf, root = F.col("bytes").cast("double"), F.col("is_root")
    good = F.when(~root & (F.col("keys") > 0), leaf * F.col("uniq") / F.col("keys")).otherwise(0.0)
    return nodes.agg(
        F.sum(F.when(root, leaf).otherwise(0.0)).alias("root_bytes"), F.sum(F.when(~root, leaf).otherwise(0.0)).alias("leaf_bytes"), F.sum(good).alias("good_bytes")
    ).withColumn("samp", F.try_divide(F.col("root_bytes") + F.col("leaf_bytes"), F.col("good_bytes")))


def distinct_keys(log: DataFrame, by: str, precision: int = 14) -> DataFrame:
    """Mergeable HyperLogLog sketches of keys, and their estimates."""
    return log.groupBy(by).agg(F.hll_sketch_agg("key", precision).alias("hll")).withColumn("estimate", F.hll_sketch_estimate("hll"))


def merge_distinct(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate"))


def histogram(rows: DataFrame, value: Column, width: float, by: str) -> DataFrame:
    return rows.groupBy(by, F.floor(value / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rate(rows: DataFrame, ts: str, by: str, every: str = "hour") -> DataFrame:
    return rows.groupBy(F.date_trunc(every, ts).alias("period"), by).agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, deviation and a load class by their ratio."""
    ratio = F.try_divide(F.stddev_pop(value), F.avg(value))
    load = F.when(ratio < 0.5, "light").when(ratio < 1.0, "medium").otherwise("heavy")
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("deviation"), load.alias("load"))
