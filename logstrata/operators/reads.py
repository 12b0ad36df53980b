"""Reads: scans, gets, seeks, probes and comparisons of views. All are lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import key_range, prefix_range
from ..plans.builders import keyed, mask, newest, prefix_tombstones, versions, visible


def scan(log: DataFrame, view: int | None = None, pfx_len: int = 0, reverse: bool = False, ordered: bool = True) -> DataFrame:
    found = visible(log, view, pfx_len)
    if not ordered:
        return found
    order = keyed(log, ["key"])
    return found.orderBy(*[F.desc(c) if reverse and c == "key" else F.asc(c) for c in order])


def multi_view(log: DataFrame, views: Sequence[int], pfx_len: int = 0) -> DataFrame:
    """Live pairs at several views, from one pass over the log and one shuffle."""
    rows, by = log.where(F.col("vtype") != "PT"), keyed(log, ["key"])
    picked = rows.groupBy(*by).agg(*[newest(rows, by, ["vtype", "value", "seqno"], F.col("seqno") <= v, f"v{v}") for v in views])
    each = F.array(*[F.struct(F.lit(v).cast("long").alias("view"), F.col(f"v{v}").alias("v")) for v in views])
    found = picked.select(*by, F.explode(each).alias("x")).select(*by, "x.view", "x.v.*").where(F.col("vtype").isNotNull())
    if pfx_len:
        # A view's tombstones are those up to it; each joins at its own view.
        parts = [mask(found.where(F.col("view") == v), prefix_tombstones(log, v), pfx_len) for v in views]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    return found.where(F.col("vtype") == "V").drop("vtype")


def deleted_keys(log: DataFrame, view: int | None = None) -> DataFrame:
    """Keys whose visible version is a tombstone."""
    return versions(log, view).where(F.col("vtype") == "T").select(*keyed(log, ["key"]), "seqno")


def batch_get(log: DataFrame, keys: DataFrame, view: int | None = None, pfx_len: int = 0) -> DataFrame:
    """found, value and value_len of each row of keys (key); an absent key is found = false. The log is cut to the keys
    before versions are picked."""
    wanted = keys.select("key").distinct()
    cut = log.where(F.col("vtype") != "PT").join(wanted, "key", "left_semi")
    if pfx_len:
        cut = cut.unionByName(log.where(F.col("vtype") == "PT"))
    found = visible(cut, view, pfx_len).select("key", "value", F.lit(True).alias("_found"))
    joined = keys.join(found, "key", "left")
    return joined.select(
        *keys.columns, F.coalesce("_found", F.lit(False)).alias("found"), "value", F.length(F.col("value").cast("string")).alias("value_len")
    )


def point_get(log: DataFrame, key, view: int | None = None, pfx_len: int = 0) -> DataFrame:
    """At most one row; the key filter reaches the scan."""
    where = F.col("key") == F.lit(key)
    return visible(log, view, pfx_len, where)


def prefix_scan(log: DataFrame, prefix, view: int | None = None, pfx_len: int = 0) -> DataFrame:
    return visible(log, view, pfx_len, prefix_range(F.col("key"), prefix))


def range_scan(log: DataFrame, low=None, high=None, view: int | None = None, pfx_len: int = 0, closed: bool = True) -> DataFrame:
    return visible(log, view, pfx_len, key_range(F.col("key"), low, high, closed))


def resume(log: DataFrame, after, n: int, view: int | None = None, pfx_len: int = 0) -> DataFrame:
    """The next n pairs beyond the key that was read last, whether or not that one is still there."""
    return visible(log, view, pfx_len, F.col("key") > F.lit(after)).orderBy("key").limit(n)


def seek(pairs: DataFrame, probes: DataFrame, forward: bool = True, bucket: int = 7) -> DataFrame:
    """For each probe the first key at or above it, or with forward false the last at or below it; null at the end.

    Keys and probes meet in buckets of the first `bucket` characters. A probe that finds nothing in its bucket takes the
    end of the nearest other one, from a table with a row for each bucket.
    """
    cut = lambda c: F.substring(c, 1, bucket)
    marks = pairs.select("key", F.lit(0).alias("is_probe")).unionByName(probes.select("key", F.lit(1).alias("is_probe")).distinct())
    marks = marks.withColumn("_b", cut("key"))
    order = [F.desc("key"), F.asc("is_probe")] if forward else [F.asc("key"), F.asc("is_probe")]
    run = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min if forward else F.max
    near = marks.withColumn("near", pick(F.when(F.col("is_probe") == 0, F.col("key"))).over(run)).where("is_probe = 1")
    ends = marks.groupBy("_b").agg(pick(F.when(F.col("is_probe") == 0, F.col("key"))).alias("end"))
    beyond = Window.orderBy(F.desc("_b") if forward else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_b", pick("end").over(beyond).alias("far"))
    return near.join(ends, "_b").select("key", F.coalesce("near", "far").alias("found_key"))


def prefix_probe(log: DataFrame, pfx_len: int, view: int | None = None, masked: bool = False) -> DataFrame:
    """For each prefix: 0, 1 or many (2) live keys, and the newest pair, by seqno and then key."""
    found = visible(log, view, pfx_len if masked else 0)
    first = F.max_by(F.struct("key", "value"), F.struct("seqno", "key"))
    return (
        found.groupBy(F.substring("key", 1, pfx_len).alias("prefix"))
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("cnt"), first.alias("p"))
        .select("prefix", "cnt", F.col("p.key").alias("key"), F.col("p.value").alias("value"))
    )


def view_diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """Keys that were added, changed or removed between two views, from one pass over the log."""
    rows, by = log.where(F.col("vtype") != "PT"), keyed(log, ["key"])
    both = rows.groupBy(*by).agg(
        newest(rows, by, ["vtype", "value", "seqno"], F.col("seqno") <= before, "a"),
        newest(rows, by, ["vtype", "value", "seqno"], F.col("seqno") <= after, "b"),
    )
    live = lambda c: F.coalesce(F.col(f"{c}.vtype") == "V", F.lit(False))
    change = (
        F.when(~live("a") & live("b"), "added")
        .when(live("a") & ~live("b"), "removed")
        .when(live("a") & live("b") & (F.col("a.seqno") != F.col("b.seqno")), "changed")
    )
    old, new = F.when(live("a"), F.col("a.value")), F.when(live("b"), F.col("b.value"))
    return both.select(*by, change.alias("change"), old.alias("old_value"), new.alias("new_value")).where("change IS NOT NULL")


def debug_get(log: DataFrame, keys: DataFrame, view: int | None = None, pfx_len: int = 0) -> DataFrame:
    """How each key is answered: a value, a tombstone, a prefix tombstone, or nothing."""
    newest_ = versions(log, view).select("key", "vtype", "seqno")
    pts = prefix_tombstones(log, view).select("prefix", "pt_seq")
    joined = keys.join(newest_, "key", "left").join(pts, F.substring("key", 1, pfx_len) == F.col("prefix"), "left")
    hidden = F.col("pt_seq").isNotNull() & (F.col("seqno").isNull() | (F.col("pt_seq") > F.col("seqno")))
    status = F.when(hidden, "FOUND_PTMB").when(F.col("vtype") == "T", "FOUND_TMB").when(F.col("vtype") == "V", "FOUND_VAL")
    return joined.select(*keys.columns, F.coalesce(status, F.lit("NOT_FOUND")).alias("status"))
