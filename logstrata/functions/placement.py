"""Where a tree's keys and values go, by named policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Media classes of root keys, root values, leaf keys and leaf values under each policy.
POLICIES = {
    "capacity_only": ("capacity", "capacity", "capacity", "capacity"),
    "staging_only": ("staging", "staging", "staging", "staging"),
    "staging_max_capacity": ("staging", "staging", "staging", "capacity"),
    "staging_min_capacity": ("staging", "staging", "capacity", "capacity"),
    "pmem_only": ("pmem", "pmem", "pmem", "pmem"),
    "pmem_max_capacity": ("pmem", "pmem", "pmem", "capacity"),
}
PLACES = (("root", "key"), ("root", "value"), ("leaf", "key"), ("leaf", "value"))


def policies(spark: SparkSession) -> DataFrame:
    rows = [(name, *place, media) for name, kinds in POLICIES.items() for place, media in zip(PLACES, kinds, strict=True)]
    return spark.createDataFrame(rows, "policy string, age string, dtype string, media string")
