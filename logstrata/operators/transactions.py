"""Snapshot-isolation transactions over a log: overlays, conflicts and horizons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.builders import committed, mask, prefix_tombstones, versions


def overlay(log: DataFrame, txns: DataFrame, txn_id: int, view: int, pfx_len: int = 0) -> DataFrame:
    """What a transaction reads: its own writes over the snapshot at its view.

    Its own prefix deletes stand above the snapshot and below its own values, whatever the order of the calls.
    """
    own = log.where(F.col("txn_id") == txn_id)
    base = committed(log.where(F.col("txn_id").isNull() | (F.col("txn_id") != txn_id)), txns).where(F.col("seqno") <= view)
    above = F.when(F.col("vtype") == "PT", view + 1).otherwise(view + 2).cast("long")
    both = base.unionByName(own.withColumn("seqno", above))
    found = versions(both)
    if pfx_len:
        found = mask(found, prefix_tombstones(both), pfx_len)
    return found.where(F.col("vtype") == "V").withColumn("own", F.col("seqno") > view).drop("vtype", "seqno")


def overlaps(writes: DataFrame) -> DataFrame:
    """Writes whose key a transaction that began earlier had written and committed at or after their own view.

    writes: txn_id, key, view_seqno, commit_seqno (null: not committed), op (order of begin). One pass by key: a running
    maximum takes the place of a self-join.
    """
    before = Window.partitionBy("key").orderBy("txn_id").rangeBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("prior_commit", F.max("commit_seqno").over(before)).where(F.col("prior_commit") >= F.col("view_seqno"))


def replay_conflicts(ops: DataFrame) -> DataFrame:
    """Outcome of every operation of a script, where outcomes depend on earlier ones.

    ops: component, step, txn, op (begin, put, del, commit, abort), key. A key's lock is free, or its holder's; another takes it
    over only if its view is above the end of the holder, and the end of an active holder is infinite. A write that fails leaves
    its transaction active; a commit stamps the transaction's locks, an abort frees those it took itself and stamps
    inherited ones anew. Components (transactions that share no key) are replayed side by side.
    """

    def replay(x: pd.DataFrame) -> pd.DataFrame:
        seqno, views, state, locks, held, out = 0, {}, {}, {}, {}, []
        for r in x.sort_values("step").itertuples():
            t, result = r.txn, "ok"
            if r.op == "begin":
                views[t], state[t], held[t] = seqno, "active", {}
                seqno += 1
            elif state.get(t) != "active":
                result = "invalid"
            elif r.op in ("put", "del"):
                owner, end = locks.get(r.key, (None, -1))
                if owner != t:
                    if owner is not None and views[t] <= end:
                        result = "canceled"
                    else:
                        held[t][r.key] = owner is not None
                        locks[r.key] = (t, float("inf"))
            elif r.op == "commit":
                if held[t]:
                    seqno += 1
                    for k in held[t]:
                        locks[k] = (t, seqno)
                    seqno += 1
                state[t] = "committed"
            else:
                inherited = [k for k, v in held[t].items() if v]
                for k in held[t]:
                    locks.pop(k, None)
                if inherited:
                    seqno += 1
                    locks.update({k: (t, seqno) for k in inherited})
                state[t] = "aborted"
            out.append((r.component, r.step, t, r.op, result))
        return pd.DataFrame(out, columns=["component", "step", "txn", "op", "result"])

    return ops.groupBy("component").applyInPandas(replay, "component string, step long, txn string, op string, result string")


def expired(txns: DataFrame, now: int, timeout: int) -> DataFrame:
    """Active transactions that began longer ago than the timeout."""
    return txns.where((F.col("state") == "active") & (F.lit(now) - F.col("begin_ts") > timeout))


def horizon(txns: DataFrame, current: int) -> DataFrame:
    """The oldest view that is still read, or the current counter if there is none."""
    return txns.where(F.col("state") == "active").agg(F.coalesce(F.min("view_seqno"), F.lit(current)).cast("long").alias("horizon"))


#: Whether (transactional store, inside a transaction) may write and read.
PERMISSIONS = {(True, True): (True, True), (True, False): (False, True), (False, True): (False, False), (False, False): (True, True)}

