"""Registered queries of the key-value engine over the driver's tables, and the SQL that checks them.

`events` is the mutation log. Mapping E1: an error is a key tombstone on its user, any other event a value. E2: a signup is a
prefix tombstone on the first nine characters of the user's key. E3: ten events in a row are a transaction; every seventh
is aborted, every eleventh of the others open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import decimal_key, u64_key
from .functions.placement import PLACES, POLICIES, policies
from .operators import maintenance, reads, statistics, transactions
from .plans.builders import committed, prefix_tombstones, visible

PFX = 9
EDGES = ["0000000029", "0000000059", "0000000099"]
RUN = 1000
TOP = 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log1(spark: SparkSession, d: str, prefixes: bool = False) -> DataFrame:
    """E1, or with prefixes E2."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    key = decimal_key(F.col("user_id"))
    vtype = F.when(kind == "error", "T")
    if prefixes:
        key = F.when(kind == "signup", F.substring(key, 1, PFX)).otherwise(key)
        vtype = vtype.when(kind == "signup", "PT")
    vtype = vtype.otherwise("V")
    return e.select(
        key.alias("key"), F.col("event_id").alias("seqno"), F.col("event_id").alias("ord"), vtype.alias("vtype"),
        F.when(vtype == "V", F.col("value")).alias("value"), F.lit(None).cast("long").alias("txn_id"),
        F.floor(F.col("event_id") / RUN).cast("long").alias("run_id"),
    )


def log2(spark: SparkSession, d: str) -> DataFrame:
    return log1(spark, d, True)


def log3(spark: SparkSession, d: str) -> DataFrame:
    return log1(spark, d).withColumn("txn_id", F.floor(F.col("seqno") / 10).cast("long"))


def txns3(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.floor(F.col("event_id") / 10).cast("long").alias("txn_id")).distinct()
    state = F.when(F.col("txn_id") % 7 == 0, "aborted").when(F.col("txn_id") % 11 == 0, "active").otherwise("committed")
    return ids.select(
        "txn_id", state.alias("state"), (F.col("txn_id") * 10).alias("view_seqno"),
        F.when(state == "committed", F.col("txn_id") * 10 + 9).alias("commit_seqno"),
    )


def top_seqno(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max("event_id")).first()[0] or 0


def half(spark: SparkSession, d: str) -> int:
    return top_seqno(spark, d) // 2


_K = "lpad(user_id::VARCHAR, 10, '0')"
E1 = f"""l AS (SELECT {_K} AS key, event_id AS seqno, CASE event_type WHEN 'error' THEN 'T' ELSE 'V' END AS vtype,
  CASE event_type WHEN 'error' THEN NULL ELSE value END AS value, event_id // {RUN} AS run_id, event_id // 10 AS txn_id FROM events)"""
E2 = f"""l AS (SELECT CASE event_type WHEN 'signup' THEN left({_K}, {PFX}) ELSE {_K} END AS key, event_id AS seqno,
  CASE event_type WHEN 'error' THEN 'T' WHEN 'signup' THEN 'PT' ELSE 'V' END AS vtype,
  CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value, event_id // {RUN} AS run_id FROM events)"""
TX = """t AS (SELECT DISTINCT event_id // 10 AS txn_id, CASE WHEN (event_id // 10) % 7 = 0 THEN 'aborted' WHEN (event_id // 10) % 11 = 0 THEN 'active'
  ELSE 'committed' END AS state FROM events)"""
HALF = "(SELECT max(event_id) // 2 FROM events)"


def newest_sql(source: str = "l", where: str = "true") -> str:
    return f"n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM {source} WHERE vtype <> 'PT' AND ({where})) WHERE rn = 1)"


def masked_sql(where: str = "true") -> str:
    return f"""{newest_sql(where=where)}, p AS (SELECT key AS prefix, max(seqno) AS pt FROM l WHERE vtype = 'PT' AND ({where}) GROUP BY 1),
v AS (SELECT n.key, n.seqno, n.value FROM n LEFT JOIN p ON left(n.key, {PFX}) = p.prefix WHERE vtype = 'V' AND (pt IS NULL OR seqno >= pt))"""


LIVE = f"WITH {E1}, {newest_sql()}, v AS (SELECT key, seqno, value FROM n WHERE vtype = 'V') "
LIVE2 = f"WITH {E2}, {masked_sql()} "
KVS = ["key", "seqno", "value"]
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


@query(LIVE + "SELECT * FROM v")
def kv_snapshot_scan(s, d):
    return reads.scan(log1(s, d)).select(*KVS)


@query(f"WITH {E1}, {newest_sql(where=f'seqno <= {HALF}')} SELECT key, seqno, value FROM n WHERE vtype = 'V'")
def kv_asof_scan(s, d):
    return reads.scan(log1(s, d), half(s, d)).select(*KVS)


@query(f"""WITH {E1}, w AS (SELECT unnest([1, 2, 3, 4]) * max(event_id) // 4 AS view FROM events),
x AS (SELECT view, key, seqno, value, vtype, row_number() OVER (PARTITION BY view, key ORDER BY seqno DESC) AS rn FROM l, w WHERE seqno <= view)
SELECT view, key, seqno, value FROM x WHERE rn = 1 AND vtype = 'V'""")
def kv_multi_view(s, d):
    top = top_seqno(s, d)
    return reads.multi_view(log1(s, d), [top * i // 4 for i in (1, 2, 3, 4)]).select("view", *KVS)


@query(f"WITH {E1}, {newest_sql()} SELECT key, seqno FROM n WHERE vtype = 'T'")
def kv_deleted_keys(s, d):
    return reads.deleted_keys(log1(s, d)).select("key", "seqno")


@query(f"WITH {E2} SELECT key AS prefix, max(seqno) AS pt_seq FROM l WHERE vtype = 'PT' GROUP BY 1")
def kv_prefix_tombstones(s, d):
    return prefix_tombstones(log2(s, d))


@query(LIVE2 + "SELECT * FROM v")
def kv_prefix_delete_scan(s, d):
    return reads.scan(log2(s, d), pfx_len=PFX).select(*KVS)


@query(f"WITH {E2}, {masked_sql(f'seqno <= {HALF}')} SELECT * FROM v")
def kv_prefix_delete_asof(s, d):
    return reads.scan(log2(s, d), half(s, d), PFX).select(*KVS)


@query(LIVE + "SELECT * FROM v WHERE key = '0000000042'")
def kv_point_get(s, d):
    return reads.point_get(log1(s, d), "0000000042").select(*KVS)


_PROBE_KEYS = "k AS (SELECT DISTINCT lpad(c_custkey::VARCHAR, 10, '0') AS key FROM customer)"


def probe_keys(s, d):
    return table(s, d, "customer").select(decimal_key(F.col("c_custkey")).alias("key")).distinct()


@query(LIVE + f", {_PROBE_KEYS} SELECT k.key, v.key IS NOT NULL AS found, v.value FROM k LEFT JOIN v USING (key)")
def kv_batch_get(s, d):
    return reads.batch_get(log1(s, d), probe_keys(s, d)).select("key", "found", "value")


@query(LIVE2 + f", {_PROBE_KEYS} SELECT k.key, v.key IS NOT NULL AS found FROM k LEFT JOIN v USING (key)")
def kv_exists(s, d):
    return reads.batch_get(log2(s, d), probe_keys(s, d), pfx_len=PFX).select("key", "found")


@query(LIVE + "SELECT * FROM v WHERE starts_with(key, '000000001')")
def kv_prefix_scan(s, d):
    return reads.prefix_scan(log1(s, d), "000000001").select(*KVS)


@query(LIVE2 + "SELECT * FROM v WHERE key BETWEEN '0000000010' AND '0000000099'")
def kv_range_scan(s, d):
    return reads.range_scan(log2(s, d), "0000000010", "0000000099", pfx_len=PFX).select(*KVS)


@query(LIVE + "SELECT * FROM v WHERE key >= '0000000050'")
def kv_range_open(s, d):
    return reads.range_scan(log1(s, d), "0000000050").select(*KVS)


@query(LIVE + "SELECT key FROM v")
def kv_key_only_scan(s, d):
    return reads.scan(log1(s, d)).select("key")


@query(LIVE + f"SELECT * FROM v ORDER BY key DESC LIMIT {TOP}")
def kv_reverse_limit(s, d):
    return reads.scan(log1(s, d), reverse=True).limit(TOP).select(*KVS)


@query(LIVE + "SELECT * FROM v ORDER BY value DESC, key LIMIT 10")
def kv_topk(s, d):
    return visible(log1(s, d)).orderBy(F.desc("value"), "key").limit(10).select(*KVS)


@query(LIVE + f", {_PROBE_KEYS} SELECT k.key, (SELECT min(v.key) FROM v WHERE v.key >= k.key) AS found_key FROM k")
def kv_seek_ge(s, d):
    return reads.seek(visible(log1(s, d)).select("key"), probe_keys(s, d))


@query(LIVE + f", {_PROBE_KEYS} SELECT k.key, (SELECT max(v.key) FROM v WHERE v.key <= k.key) AS found_key FROM k")
def kv_seek_le(s, d):
    return reads.seek(visible(log1(s, d)).select("key"), probe_keys(s, d), forward=False)


@query(LIVE + f"""SELECT left(key, {PFX}) AS prefix, least(count(*), 2)::BIGINT AS cnt, arg_max(key, seqno) AS key, arg_max(value, seqno) AS value
FROM v GROUP BY 1""")
def kv_prefix_probe(s, d):
    return reads.prefix_probe(log1(s, d), PFX)


@query(LIVE + f"SELECT * FROM v WHERE key > '0000000042' ORDER BY key LIMIT {TOP}")
def kv_scan_resume(s, d):
    return reads.resume(log1(s, d), "0000000042", TOP).select(*KVS)


@query(f"""WITH {E1}, a AS (SELECT key, arg_max(vtype, seqno) AS vt, arg_max(coalesce(value, -1), seqno) AS value, max(seqno) AS seqno FROM l WHERE seqno <= {HALF} GROUP BY 1),
b AS (SELECT key, arg_max(vtype, seqno) AS vt, arg_max(coalesce(value, -1), seqno) AS value, max(seqno) AS seqno FROM l GROUP BY 1),
x AS (SELECT * FROM a WHERE vt = 'V'), y AS (SELECT * FROM b WHERE vt = 'V')
SELECT coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'added' WHEN y.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
  x.value AS old_value, y.value AS new_value FROM x FULL JOIN y USING (key) WHERE x.seqno IS DISTINCT FROM y.seqno""")
def kv_view_diff(s, d):
    return reads.view_diff(log1(s, d), half(s, d), top_seqno(s, d))


_COMMITTED = f"WITH {E1}, {TX}, c AS (SELECT l.key, t.txn_id * 10 + 9 AS seqno, l.seqno AS ord, vtype, value FROM l JOIN t USING (txn_id) WHERE state = 'committed')"
_PICK = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC, ord DESC) AS rn FROM {0})"


@query(f"{_COMMITTED} SELECT key, seqno, value FROM {_PICK.format('c')} WHERE rn = 1 AND vtype = 'V'")
def kv_txn_committed_scan(s, d):
    return visible(committed(log3(s, d), txns3(s, d))).select(*KVS)


@query(f"WITH {E1}, {TX} SELECT state, count(*) AS n, count(DISTINCT key) AS keys FROM l JOIN t USING (txn_id) WHERE state <> 'committed' GROUP BY 1")
def kv_txn_dropped(s, d):
    joined = log3(s, d).join(txns3(s, d), "txn_id").where("state <> 'committed'")
    return joined.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query(f"""{_COMMITTED}, u AS (SELECT key, seqno, ord, vtype, value, false AS own FROM c WHERE seqno <= 110
  UNION ALL SELECT key, 1000000000, seqno, vtype, value, true FROM l WHERE txn_id = 11)
SELECT key, value, own FROM {_PICK.format('u')} WHERE rn = 1 AND vtype = 'V'""")
def kv_txn_overlay(s, d):
    return transactions.overlay(log3(s, d), txns3(s, d), 11, 110).select("key", "value", "own")


@query(f"""WITH {E1}, {TX}, w AS (SELECT DISTINCT l.txn_id, key, l.txn_id * 10 - 25 AS view_seqno, CASE state WHEN 'committed' THEN l.txn_id * 10 + 9 END AS commit_seqno
  FROM l JOIN t USING (txn_id))
SELECT a.txn_id, a.key, max(b.commit_seqno) AS prior_commit FROM w a JOIN w b ON a.key = b.key AND b.txn_id < a.txn_id AND b.commit_seqno >= a.view_seqno GROUP BY 1, 2""")
def kv_txn_conflicts(s, d):
    w = log3(s, d).select("txn_id", "key").distinct().join(txns3(s, d).select("txn_id", "commit_seqno"), "txn_id")
    w = w.withColumn("view_seqno", F.col("txn_id") * 10 - 25)
    return transactions.overlaps(w).select("txn_id", "key", "prior_commit")


@query(f"WITH {TX} SELECT coalesce(min(txn_id * 10) FILTER (state = 'active'), (SELECT max(event_id) FROM events))::BIGINT AS horizon FROM t")
def kv_horizon(s, d):
    return transactions.horizon(txns3(s, d), top_seqno(s, d))


_RANKED = f"""WITH {E1}, r AS (SELECT *, seqno <= {HALF} AS old, row_number() OVER (PARTITION BY key, seqno <= {HALF} ORDER BY seqno DESC) AS rn FROM l)"""


@query(_RANKED + " SELECT key, seqno, vtype, value FROM r WHERE NOT old OR rn = 1")
def kv_compact(s, d):
    return maintenance.compact(log1(s, d), half(s, d)).select("key", "seqno", "vtype", "value")


@query(_RANKED + " SELECT key, seqno, vtype, value FROM r WHERE NOT old OR (rn = 1 AND vtype = 'V')")
def kv_compact_drop_tombs(s, d):
    return maintenance.compact(log1(s, d), half(s, d), True).select("key", "seqno", "vtype", "value")


@query(f"""WITH {E2}, r AS (SELECT *, seqno <= {HALF} AS old, row_number() OVER (PARTITION BY key, vtype = 'PT', seqno <= {HALF} ORDER BY seqno DESC) AS rn FROM l),
p AS (SELECT key AS prefix, max(seqno) AS pt FROM l WHERE vtype = 'PT' AND seqno <= {HALF} GROUP BY 1)
SELECT key, seqno, vtype, value FROM r LEFT JOIN p ON vtype <> 'PT' AND left(key, {PFX}) = prefix WHERE (NOT old OR rn = 1) AND (pt IS NULL OR seqno >= pt)""")
def kv_compact_prefix_tombs(s, d):
    return maintenance.compact(log2(s, d), half(s, d), pfx_len=PFX).select("key", "seqno", "vtype", "value")


@query(f"""WITH {E1}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM l WHERE seqno <= {HALF})
SELECT key, count(*) AS dropped, sum(seqno * 0 + 8)::BIGINT AS vgarb FROM r WHERE rn > 1 AND vtype = 'V' GROUP BY 1""")
def kv_kcompact_garbage(s, d):
    fixed = log1(s, d).withColumn("value", F.when(F.col("vtype") == "V", F.lpad(F.hex("seqno"), 8, "0")))
    return maintenance.value_garbage(fixed, half(s, d))


_LEAF = f"len(list_filter({EDGES}, lambda e: e < {{0}}))"


@query(f"""WITH {E2}, x AS (SELECT *, unnest(CASE WHEN vtype = 'PT' THEN range({_LEAF.format('key')}, {_LEAF.format('key')} +
  len(list_filter({EDGES}, lambda e: e >= key AND starts_with(e, key))) + 1) ELSE [{_LEAF.format('key')}] END) AS node_id FROM l)
SELECT node_id::INT AS node_id, vtype, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM x GROUP BY 1, 2""")
def kv_spill_routes(s, d):
    dealt = maintenance.spill(log2(s, d), EDGES).groupBy("node_id", "vtype")
    return dealt.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query(f"""WITH {E1}, r AS (SELECT run_id, min(key) AS min_key, max(key) AS max_key FROM l GROUP BY 1)
SELECT run_id, {_LEAF.format('min_key')}::INT AS first_leaf, {_LEAF.format('max_key')}::INT AS last_leaf, first_leaf = last_leaf AS can_move FROM r""")
def kv_zspill(s, d):
    runs = log1(s, d).groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return maintenance.zero_spill(runs, EDGES).select("run_id", "first_leaf", "last_leaf", "can_move")


@query(f"""WITH {E1}, n AS (SELECT {_LEAF.format('key')}::INT AS node_id, key, sum(length(key) + 8) AS size FROM l GROUP BY 1, 2),
r AS (SELECT *, sum(size) OVER (PARTITION BY node_id ORDER BY key) AS run, sum(size) OVER (PARTITION BY node_id) AS total FROM n)
SELECT node_id, min(key) AS split_key, max(total)::BIGINT AS total FROM r WHERE run * 2 > total GROUP BY 1""")
def kv_split_key(s, d):
    rows = log1(s, d).select(maintenance.route(F.col("key"), EDGES).alias("node_id"), "key", (F.length("key") + 8).alias("size"))
    return maintenance.split_keys(rows)


_NODES = f"""WITH {E1}, n AS (SELECT {_LEAF.format('key')}::INT AS node_id, count(*) AS keys, count(DISTINCT key) AS uniq, count(*) FILTER (vtype = 'T') AS tombs,
  sum(length(key) + 8)::BIGINT AS bytes, count(DISTINCT run_id) AS runs FROM l GROUP BY 1)"""


def nodes(s, d):
    return log1(s, d).groupBy(maintenance.route(F.col("key"), EDGES).alias("node_id")).agg(
        F.count(F.lit(1)).alias("keys"), F.countDistinct("key").alias("uniq"), F.count_if(F.col("vtype") == "T").alias("tombs"),
        F.sum(F.length("key") + 8).alias("bytes"), F.countDistinct("run_id").alias("runs"),
    )


@query(_NODES + """, p AS (SELECT *, lead(node_id) OVER w AS into_, lead(bytes) OVER w AS b, lead(keys) OVER w AS k FROM n WINDOW w AS (ORDER BY node_id))
SELECT node_id, into_ AS "into", runs FROM p WHERE into_ IS NOT NULL AND (keys = 0 OR ((bytes + b) * 100 <= 200000 * 50 AND (keys + k) * 100 <= 10000 * 50))""")
def kv_join_candidates(s, d):
    return maintenance.join_candidates(nodes(s, d), 200_000, 10_000)


@query(_NODES + """, g AS (SELECT *, CASE WHEN tombs * 100 > uniq * 95 OR keys = 0 THEN 100 ELSE floor((keys - uniq) * 100 / keys) END::BIGINT AS garbage FROM n)
SELECT node_id, CASE WHEN bytes >= 1000000 OR uniq >= 5000 THEN 'split' WHEN garbage >= 67 AND runs > 1 THEN 'garbage' WHEN runs >= 4 THEN 'length' ELSE 'none' END AS work, garbage, runs FROM g""")
def kv_work_rank(s, d):
    return maintenance.choose_work(nodes(s, d), 1_000_000, 5000)


@query(f"""WITH {E1}, r AS (SELECT run_id AS dgen, max(key) AS max_key, max(seqno) AS max_seqno, count(*) AS nkeys FROM l GROUP BY 1),
m AS (SELECT *, NOT (max_key > '000000014' AND left(max_key, 9) <> '000000014') AND max_seqno < {HALF} AS goes, lead(dgen) OVER (ORDER BY dgen) AS nxt FROM r),
z AS (SELECT *, bool_and(goes) OVER (ORDER BY dgen) AS upto FROM m) SELECT dgen, max_seqno FROM z WHERE upto AND nxt IS NOT NULL""")
def kv_capped_retire(s, d):
    runs = log1(s, d).groupBy(F.col("run_id").alias("dgen")).agg(
        F.max("key").alias("max_key"), F.max("seqno").alias("max_seqno"), F.count(F.lit(1)).alias("nkeys")
    )
    return maintenance.capped_retire(runs, "000000014", half(s, d), half(s, d)).select("dgen", "max_seqno")


@query(f"""WITH {E2} SELECT run_id, count(*) AS nkeys, count(*) FILTER (vtype = 'T') AS ntombs, count(*) FILTER (vtype = 'PT') AS nptombs,
  sum(length(key))::BIGINT AS klen, min(key) AS min_key, max(key) AS max_key, min(seqno) AS min_seqno, max(seqno) AS max_seqno FROM l GROUP BY 1""")
def kv_run_stats(s, d):
    return statistics.run_stats(log2(s, d)).drop("vlen")


@query(f"""WITH {E1}, x AS (SELECT *, {_LEAF.format('key')}::INT AS node_id FROM l)
SELECT node_id, run_id, count(*) AS nkeys, count(*) FILTER (vtype = 'T') AS ntombs, sum(length(key))::BIGINT AS klen FROM x GROUP BY ROLLUP (node_id, run_id)""")
def kv_node_rollup(s, d):
    return statistics.rollup(log1(s, d).withColumn("node_id", maintenance.route(F.col("key"), EDGES)))


@query(_NODES + """ SELECT round(coalesce(sum(bytes) FILTER (node_id = 0), 0), 3) AS root_bytes, round(coalesce(sum(bytes) FILTER (node_id <> 0), 0), 3) AS leaf_bytes,
  round(sum(bytes) / nullif(sum(CASE WHEN node_id <> 0 THEN bytes * uniq / keys ELSE 0 END), 0), 6) AS samp FROM n""")
def kv_space_amp(s, d):
    found = statistics.space_amplification(nodes(s, d).withColumn("is_root", F.col("node_id") == 0))
    return found.select(F.round("root_bytes", 3).alias("root_bytes"), F.round("leaf_bytes", 3).alias("leaf_bytes"), F.round("samp", 6).alias("samp"))


@query(f"""WITH {E1} SELECT run_id, count(DISTINCT key) AS n, true AS close FROM l GROUP BY run_id
UNION ALL SELECT -1, count(DISTINCT key), true FROM l""")
def kv_hll_cardinality(s, d):
    """Estimated keys of each run, and of all runs (-1) by merged sketches, against the exact numbers."""
    rows = log1(s, d)
    sketches = statistics.distinct_keys(rows, "run_id")
    whole = F.lit(-1).cast("long").alias("run_id")
    estimates = sketches.select("run_id", "estimate").unionByName(statistics.merge_distinct(sketches).select(whole, "estimate"))
    exact = F.countDistinct("key").alias("n")
    counts = rows.groupBy("run_id").agg(exact).unionByName(rows.agg(exact).select(whole, "n"))
    close = F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")
    return counts.join(estimates, "run_id").select("run_id", "n", close.alias("close"))


@query("SELECT event_type, floor(value / 10)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def kv_latency_histogram(s, d):
    return statistics.histogram(table(s, d, "events"), F.col("value"), 10, "event_type")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def kv_op_rate(s, d):
    return statistics.rate(table(s, d, "events"), "ts", "event_type")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, CASE WHEN stddev_pop(value) / avg(value) < 0.5 THEN 'light'
  WHEN stddev_pop(value) / avg(value) < 1.0 THEN 'medium' ELSE 'heavy' END AS load FROM events GROUP BY 1""")
def kv_storage_profile(s, d):
    return statistics.profile(table(s, d, "events"), "value", "event_type")


@query("SELECT (user_id % 32)::BIGINT AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS tombs, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def kv_ingest_partition(s, d):
    e = table(s, d, "events").groupBy((F.col("user_id") % 32).cast("long").alias("bucket"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("tombs"), F.countDistinct("user_id").alias("keys"))


@query(LIVE + f""", {_PROBE_KEYS}, u AS (SELECT key, value FROM v UNION ALL SELECT key, NULL FROM k WHERE key NOT IN (SELECT key FROM v))
SELECT u.key, CASE WHEN u.key IN (SELECT key FROM k) THEN coalesce(value, 0) + 1 ELSE value END AS value FROM u""")
def kv_upsert_merge(s, d):
    old, new = visible(log1(s, d)).select("key", "value"), probe_keys(s, d).withColumn("_new", F.lit(True))
    joined = old.join(new, "key", "full")
    return joined.select("key", F.when(F.col("_new"), F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")).alias("value"))


@query(LIVE + "SELECT key, round(value * 2, 6) AS value FROM v WHERE value > 50")
def kv_rmw(s, d):
    return visible(log1(s, d)).where("value > 50").select("key", F.round(F.col("value") * 2, 6).alias("value"))


@query("""WITH e AS (SELECT DISTINCT event_id FROM events)
SELECT lpad(a.event_id::VARCHAR, 10, '0') AS key, coalesce(b.event_id, a.event_id) AS once, a.event_id AS twice
FROM e a LEFT JOIN e b ON b.event_id = xor(a.event_id, 1)""")
def kv_swap_verify(s, d):
    """Swap the records of neighbouring ids through the log, twice: once each has its neighbour's, then its own again."""
    row = lambda id_, seqno, value: [
        decimal_key(id_).alias("key"), F.lit(seqno).cast("long").alias("seqno"), F.lit(0).alias("ord"), F.lit("V").alias("vtype"), value.alias("value")
    ]
    log = table(s, d, "events").select("event_id").distinct().select(*row(F.col("event_id"), 1, F.col("event_id")))
    for seqno in (2, 3):
        held = reads.scan(log, seqno - 1, ordered=False).select(F.col("key").cast("long").alias("id"), "value")
        other = held.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("value").alias("theirs"))
        log = log.unionByName(held.join(other, "id").select(*row(F.col("id"), seqno, F.col("theirs"))))
    seen = reads.multi_view(log, [2, 3])
    value = lambda v: F.max(F.when(F.col("view") == v, F.col("value")))
    return seen.groupBy("key").agg(value(2).alias("once"), value(3).alias("twice"))


@query("""SELECT c_custkey % 4 AS grp, count(*) AS n, count(*) FILTER (c_custkey % 4 IN (1, 2)) AS live, round(coalesce(sum(CASE c_custkey % 4 WHEN 1 THEN c_acctbal + 1
  WHEN 2 THEN c_acctbal END), 0), 2) AS total FROM customer GROUP BY 1""")
def kv_lifecycle_quartiles(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("grp"), "c_acctbal")
    key = decimal_key(F.col("c_custkey"))

    def step(seqno, vtype, value, where):
        return c.where(where).select(key.alias("key"), F.lit(seqno).cast("long").alias("seqno"), F.lit(0).alias("ord"), F.lit(vtype).alias("vtype"), value.alias("value"))

    none = F.lit(None).cast("double")
    log = step(1, "V", F.col("c_acctbal"), F.lit(True)).unionByName(step(2, "V", F.col("c_acctbal") + 1, F.col("grp").isin(0, 1)))
    log = log.unionByName(step(3, "T", none, F.col("grp").isin(0, 3)))
    left = c.select("grp", key.alias("key")).join(visible(log).select("key", "value"), "key", "left")
    return left.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("live"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total")
    )


@query("SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS key, o_totalprice AS value FROM orders")
def kv_orders_store(s, d):
    o = table(s, d, "orders").select(
        decimal_key(F.col("o_orderkey")).alias("key"), F.lit(1).cast("long").alias("seqno"), F.lit(0).alias("ord"), F.lit("V").alias("vtype"), F.col("o_totalprice").alias("value")
    )
    return reads.scan(o).select("key", "value")


@query("""SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS prefix, lpad(l_orderkey::VARCHAR, 10, '0') || lpad(l_linenumber::VARCHAR, 2, '0') AS key,
  max(l_quantity) AS value FROM lineitem GROUP BY ALL""")
def kv_lineitem_composite(s, d):
    """All lines of every order, by the prefix of the segmented key that names it."""
    key = F.concat(decimal_key(F.col("l_orderkey")), decimal_key(F.col("l_linenumber"), 2))
    li = table(s, d, "lineitem").select(
        key.alias("key"), F.lit(1).cast("long").alias("seqno"), F.col("l_quantity").alias("ord"), F.lit("V").alias("vtype"), F.col("l_quantity").alias("value")
    )
    return reads.scan(li, ordered=False).select(F.substring("key", 1, 10).alias("prefix"), "key", "value")


@query(f"""{_COMMITTED}, g AS (SELECT * FROM c WHERE seqno > {HALF} AND seqno <= (SELECT max(event_id) - 500 FROM events))
SELECT key, seqno, ord, vtype, value FROM g""")
def kv_wal_replay(s, d):
    from .sources.wal import replay

    top = top_seqno(s, d)
    txns = txns3(s, d).withColumn("dgen", F.floor(F.col("txn_id") / 100))
    return replay(log3(s, d), txns, persisted=top // 2, usable=top - 500).select("key", "seqno", "ord", "vtype", "value")


@query(f"{_COMMITTED} SELECT key, seqno, value FROM {_PICK.format('c')} WHERE rn = 1 AND vtype = 'V'")
def kv_stream_equals_batch(s, d):
    """The committed scan again, from a log that a stream has ingested."""
    from .streaming.ingest import ingest_once

    return visible(ingest_once(log3(s, d), txns3(s, d))).select(*KVS)


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def kv_catalog_compaction(s, d):
    """A catalog log cut down to the newest record of each id."""
    from .sources.wal import compact_catalog

    return compact_catalog(table(s, d, "events"), "event_type", "event_id").select("event_type", "event_id", "value")


@query(f"""WITH {E2}, {newest_sql()}, p AS (SELECT key AS prefix, max(seqno) AS pt FROM l WHERE vtype = 'PT' GROUP BY 1), {_PROBE_KEYS}
SELECT k.key, CASE WHEN pt IS NOT NULL AND (n.seqno IS NULL OR pt > n.seqno) THEN 'FOUND_PTMB' WHEN vtype = 'T' THEN 'FOUND_TMB' WHEN vtype = 'V' THEN 'FOUND_VAL'
  ELSE 'NOT_FOUND' END AS status FROM k LEFT JOIN n ON n.key = k.key LEFT JOIN p ON prefix = left(k.key, {PFX})""")
def kv_debug_get(s, d):
    return reads.debug_get(log2(s, d), probe_keys(s, d), pfx_len=PFX)


@query(LIVE + "SELECT * FROM v WHERE key >= '0000000020' ORDER BY key LIMIT 42")
def kv_range_read(s, d):
    """A range of 42 keys from a start, as a cursor reads it."""
    return reads.range_scan(log1(s, d), "0000000020").orderBy("key").limit(42).select(*KVS)


@query(LIVE + "SELECT * FROM v")
def kv_multicursor(s, d):
    """Several range cursors that together cover all keys."""
    log, bounds = log1(s, d), ["0000000030", "0000000060", None]
    out, low = None, None
    for high in bounds:
        part = reads.range_scan(log, low, high, closed=False).select(*KVS)
        out, low = part if out is None else out.unionByName(part), high
    return out


@query("""SELECT hex(l_orderkey % 97) AS pfx, least(count(DISTINCT (l_orderkey, l_linenumber)), 2)::BIGINT AS cnt FROM lineitem GROUP BY 1""")
def kv_pfx_probe_triples(s, d):
    """Probes over keys of three big-endian 64-bit segments."""
    key = u64_key(F.col("l_orderkey") % 97, F.col("l_orderkey"), F.col("l_linenumber"))
    li = table(s, d, "lineitem").select(
        key.alias("key"), F.lit(1).cast("long").alias("seqno"), F.col("l_linenumber").alias("ord"), F.lit("V").alias("vtype"), F.col("l_quantity").alias("value")
    )
    found = reads.prefix_probe(li, 8)
    return found.select(F.expr("hex(conv(hex(prefix), 16, 10)::bigint)").alias("pfx"), "cnt")


_CUT = "(SELECT max(event_id) // 10 * 10 - 200 FROM events)"


@query(f"""SELECT lpad(event_id::VARCHAR, 10, '0') AS key, value FROM events WHERE event_id >= {_CUT} ORDER BY key LIMIT {TOP}""")
def kv_capped_tail(s, d):
    """A capped store: append, delete the prefixes at its head, and read on from a place that is gone by then."""
    e, cut = table(s, d, "events"), top_seqno(s, d) // 10 * 10 - 200
    key, last = decimal_key(F.col("event_id")), F.lit(top_seqno(s, d))
    log = e.select(key.alias("key"), F.col("event_id").alias("seqno"), F.col("event_id").alias("ord"), F.lit("V").alias("vtype"), "value")
    head = e.where(F.col("event_id") < cut).select(F.substring(key, 1, PFX).alias("key")).distinct()
    head = head.select("key", (last + 1).alias("seqno"), (last + 1).alias("ord"), F.lit("PT").alias("vtype"), F.lit(None).cast("double").alias("value"))
    return reads.resume(log.unionByName(head), f"{cut - 100:010d}", TOP, pfx_len=PFX).select("key", "value")


@query("SELECT age, dtype, media, count(*) AS n FROM (VALUES " + ", ".join(
    f"('{a}', '{t}', '{m}')" for kinds in POLICIES.values() for (a, t), m in zip(PLACES, kinds, strict=True)
) + ") AS p(age, dtype, media) GROUP BY 1, 2, 3")
def kv_placement(s, d):
    return policies(s).groupBy("age", "dtype", "media").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _FOUND.items() if q}
