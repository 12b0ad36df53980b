"""Log maintenance: compaction under a horizon, spills, splits, joins and retirement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.builders import keyed


def compact(log: DataFrame, horizon: int, drop_tombs: bool = False, pfx_len: int = 0) -> DataFrame:
    """Keep all versions above the horizon, and of those at or below it the newest; that one goes too if it is a
    tombstone and drop_tombs is set. A prefix tombstone at or below the horizon counts among the versions of the keys it hides.
    """
    old = F.col("seqno") <= horizon
    by = keyed(log, ["key", "vtype_group"])
    rows = log.withColumn("vtype_group", F.col("vtype") == "PT")
    newest = Window.partitionBy(*by, "_old").orderBy(F.desc("seqno"), F.desc("ord"))
    ranked = rows.withColumn("_old", old).withColumn("_rank", F.row_number().over(newest))
    kept = ranked.where(~F.col("_old") | (F.col("_rank") == 1))
    if drop_tombs:
        kept = kept.where(~(F.col("_old") & F.col("vtype").isin("T", "PT")))
    if pfx_len:
        own = keyed(log)
        pts = log.where((F.col("vtype") == "PT") & old).groupBy(*own, F.col("key").alias("_prefix")).agg(F.max("seqno").alias("_pt"))
        pts = pts.select(*[F.col(c).alias(f"_{c}") for c in own], "_prefix", "_pt")
        same = (F.substring("key", 1, pfx_len) == F.col("_prefix")) & (F.length("key") >= pfx_len) & (F.col("vtype") != "PT")
        for c in own:
            same = same & (F.col(c) == F.col(f"_{c}"))
        kept = kept.join(pts, same, "left").where(F.col("_pt").isNull() | (F.col("seqno") >= F.col("_pt")))
    return kept.select(*log.columns)


def value_garbage(log: DataFrame, horizon: int) -> DataFrame:
    """By key, the bytes of values that a compaction which leaves values in place would orphan."""
    newest = Window.partitionBy(*keyed(log, ["key"])).orderBy(F.desc("seqno"), F.desc("ord"))
    old = log.where((F.col("seqno") <= horizon) & (F.col("vtype") != "PT")).withColumn("_rank", F.row_number().over(newest))
    size = F.length(F.col("value").cast("string"))
    return old.where("_rank > 1 AND vtype = 'V'").groupBy(*keyed(log, ["key"])).agg(F.count(F.lit(1)).alias("dropped"), F.sum(size).alias("vgarb"))


def route(key: Column, edges: Sequence) -> Column:
    """Index of the leaf whose inclusive upper edge is the first at or above key; the last leaf has none.

    Edges are a bounded list (a node's fan-out is at most 1024), so no join is needed.
    """
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < key)).cast("int")


def spill(log: DataFrame, edges: Sequence) -> DataFrame:
    """Deal a root's rows to leaves; a prefix tombstone goes to each leaf that its prefix overlaps."""
    low = route(F.col("key"), edges)
    table = F.array(*[F.lit(e) for e in edges])
    # Leaves from the prefix's own to the last whose lower edge still begins with it.
    more = F.size(F.filter(table, lambda e: (e >= F.col("key")) & e.startswith(F.col("key"))))
    leaves = F.when(F.col("vtype") == "PT", F.sequence(low, low + more)).otherwise(F.array(low))
    return log.withColumn("node_id", F.explode(leaves))


def zero_spill(runs: DataFrame, edges: Sequence) -> DataFrame:
    """Whether a run (min_key, max_key) can move to one leaf as a whole."""
    low, high = route(F.col("min_key"), edges), route(F.col("max_key"), edges)
    return runs.select("*", low.alias("first_leaf"), high.alias("last_leaf"), (low == high).alias("can_move"))


def split_keys(rows: DataFrame, bucket: int = 8) -> DataFrame:
    """By node, the first key at which the running sum of key and value bytes passes half of the node's total.

    rows: node_id, key, size. Sums run over buckets of keys first, and over keys only in the bucket that is crossed, so that no
    task sees a whole node.
    """
    each = rows.groupBy("node_id", "key").agg(F.sum("size").alias("size"))
    cells = each.groupBy("node_id", F.substring("key", 1, bucket).alias("_b")).agg(F.sum("size").alias("_s"))
    run = Window.partitionBy("node_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    node = Window.partitionBy("node_id")
    cells = cells.withColumn("_upto", F.sum("_s").over(run)).withColumn("total", F.sum("_s").over(node))
    crossed = cells.where((F.col("_upto") * 2 > F.col("total")) & ((F.col("_upto") - F.col("_s")) * 2 <= F.col("total")))
    crossed = crossed.select(F.col("node_id").alias("_n"), "_b", (F.col("_upto") - F.col("_s")).alias("_before"), "total")
    inside = each.join(crossed, (F.col("node_id") == F.col("_n")) & (F.substring("key", 1, bucket) == F.col("_b")))
    at = Window.partitionBy("node_id").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    passed = inside.withColumn("_run", F.col("_before") + F.sum("size").over(at)).where(F.col("_run") * 2 > F.col("total"))
    return passed.groupBy("node_id").agg(F.min("key").alias("split_key"), F.max("total").alias("total"))


def join_candidates(nodes: DataFrame, max_bytes: int, max_keys: int, percent: int = 50) -> DataFrame:
    """Left neighbours that can be merged into the right one: empty, or together within a share of the limits."""
    right = Window.orderBy("node_id")
    pair = nodes.select(
        "node_id", "bytes", "keys", "runs",
        F.lead("node_id").over(right).alias("into"), F.lead("bytes").over(right).alias("_b"), F.lead("keys").over(right).alias("_k"),
    )
    fits = ((F.col("bytes") + F.col("_b")) * 100 <= max_bytes * percent) & ((F.col("keys") + F.col("_k")) * 100 <= max_keys * percent)
    return pair.where(F.col("into").isNotNull() & ((F.col("keys") == 0) | fits)).select("node_id", "into", "runs")


def capped_retire(runs: DataFrame, last_prefix, pt_seq: int, horizon: int) -> DataFrame:
    """Runs of a capped store that go: from the oldest on, those whose max key does not sort after the newest prefix tombstone's
    prefix and whose max seqno is below both bounds, until the first that stays; the newest run always stays.

    runs: dgen, max_key, max_seqno, nkeys.
    """
    bound = min(horizon, pt_seq)
    beyond = (F.col("max_key") > F.lit(last_prefix)) & ~F.substring("max_key", 1, len(last_prefix)).eqNullSafe(F.lit(last_prefix))
    goes = (F.col("nkeys") == 0) | (~beyond & (F.col("max_seqno") < bound))
    order = Window.orderBy("dgen")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("_goes", F.min(goes.cast("int")).over(upto)).withColumn("_newest", F.lead("dgen").over(order).isNull())
    return marked.where((F.col("_goes") == 1) & ~F.col("_newest")).drop("_goes", "_newest")


def choose_work(nodes: DataFrame, split_bytes: int, split_keys_: int, length: int = 4, gc_percent: int = 67) -> DataFrame:
    """The maintenance a leaf needs first, and its rank: split, length, garbage, or none.

    nodes: node_id, keys, uniq, tombs, bytes, runs.
    """
    garbage = F.when((F.col("tombs") * 100 > F.col("uniq") * 95) | (F.col("keys") == 0), 100).otherwise(
        F.floor((F.col("keys") - F.col("uniq")) * 100 / F.col("keys"))
    )
    work = (
        F.when((F.col("bytes") >= split_bytes) | (F.col("uniq") >= split_keys_), "split")
        .when((garbage >= gc_percent) & (F.col("runs") > 1), "garbage")
        .when(F.col("runs") >= length, "length")
        .otherwise("none")
    )
    return nodes.select("node_id", work.alias("work"), garbage.cast("long").alias("garbage"), F.col("runs").alias("runs"))
