"""Operation scripts: lines of "p key value", "d key" and "D prefix" as log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of scripts, numbered by line; other lines are left out. Lines keep their order within a file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split("value", " ", 3).alias("w"))
    op = F.get("w", F.lit(0))
    vtype = F.when(op == "p", "V").when(op == "d", "T").when(op == "D", "PT")
    key, value = F.get("w", F.lit(1)).cast("binary"), F.coalesce(F.get("w", F.lit(2)), F.lit("")).cast("binary")
    rows = lines.select(key.alias("key"), F.col("ord").alias("seqno"), "ord", vtype.alias("vtype"), F.when(op == "p", value).alias("value"))
    return rows.where("vtype IS NOT NULL AND length(key) > 0")
