"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
#: Edges whose components one task finds, 16 bytes each.
EDGES_A_TASK = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/logstrata-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="logstrata-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage.

    Unlike a local checkpoint, the files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only if df, which must be cheap to read, has at most max_rows narrow rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def number_within(df: DataFrame, key: str, block: Column, order: list[str], out: str) -> DataFrame:
    """Add `out`, a gapless long from 0 within each `key`, without gathering a key in one task.

    Rows are numbered inside (key, block); block totals are summed up ahead of them. A block has to
    hold a bounded number of rows, and df has to be cheap to read twice.
    """
    rows = df.withColumn("_block", block)
    totals = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")
    )
    inner = Window.partitionBy(key, "_block").orderBy(*order)
    numbered = rows.withColumn("_rank", F.row_number().over(inner) - 1)
    return numbered.join(
        starts, numbered[key].eqNullSafe(starts["_key"]) & (numbered["_block"] == starts["_at"])
    ).select(*df.columns, (F.col("_start") + F.col("_rank")).cast("long").alias(out))


def component_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        # Each root hangs from the least root next to it, and all nodes from the end of their chain.
        x, y = label[p], label[q]
        new, low = label.copy(), np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _components_of_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(x["u"].to_numpy(), x["v"].to_numpy()) for x in batches]
    if parts:
        nodes, roots = component_roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pd.DataFrame({"node": nodes, "root": roots})


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of edges, which are longs; root is the least node of its component.

    Up to EDGES_A_TASK edges are joined in one task, as steps over small tables cost more than they do. Otherwise it alternates
    large-star and small-star steps until so few edges or only stars are left; each step writes its edges to the shared folder. Minima are grouped with partial aggregation. A step joins few of them by a broadcast; otherwise both
    sides of its join come from tables, so that a hub with most of the edges can be split.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialize(links, "links")
    while True:
        if links.count() <= EDGES_A_TASK:
            return links.coalesce(1).mapInPandas(_components_of_all, "node long, root long")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(broadcast_if_small(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(broadcast_if_small(least), "u")
        small = near.select("u", F.col("m").alias("v")).unionByName(
            near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        after = materialize(small.distinct(), "links")
        # Stars: every node hangs from one root, and no root hangs from another node.
        hanging = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if after.join(hanging.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and hanging.where("n > 1").isEmpty():
            roots = after.select(F.col("v").alias("u"), "v").distinct()
            return after.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = after
