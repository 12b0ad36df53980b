"""Every query of the key-value engine against its SQL on DuckDB, and reads against a model."""

import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from logstrata import catalog_queries
from logstrata.operators import maintenance, reads, transactions
from logstrata.plans.builders import visible

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "is_integer"):
        return repr(round(float(v), 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog_queries.queries()[name](spark, SF)
    found = df.collect()
    want = duck.sql(catalog_queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in found) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def random_log(rng, n, pfx):
    rows = []
    for seq in range(n):
        key = rng.choice("ab") + rng.choice("xyz") + rng.choice("01")
        kind = rng.choice("VVVVTP")
        if kind == "P":
            rows.append((key[:pfx], seq, seq, "PT", None))
        else:
            rows.append((key, seq, seq, kind, float(seq) if kind == "V" else None))
    return rows


def model(rows, view, pfx):
    live = {}
    for key, seq, _, kind, value in rows:
        if seq > view:
            break
        if kind == "V":
            live[key] = value
        elif kind == "T":
            live.pop(key, None)
        else:
            live = {k: v for k, v in live.items() if k[:pfx] != key}
    return live


SCHEMA = "key string, seqno long, ord long, vtype string, value double"


@pytest.mark.parametrize("seed", range(3))
def test_views_match_a_model_before_and_after_compaction(spark, seed):
    rng = random.Random(seed)
    rows = random_log(rng, 60, 2)
    log = spark.createDataFrame(rows, SCHEMA).cache()
    for view in (10, 35, 59):
        found = {r["key"]: r["value"] for r in visible(log, view, 2).collect()}
        assert found == model(rows, view, 2)
    for drop in (False, True):
        kept = maintenance.compact(log, 35, drop, 2).cache()
        for view in (35, 47, 59):
            assert {r["key"]: r["value"] for r in visible(kept, view, 2).collect()} == model(rows, view, 2)
    both = reads.multi_view(log, [10, 59], 2).collect()
    for view in (10, 59):
        assert {r["key"]: r["value"] for r in both if r["view"] == view} == model(rows, view, 2)


def test_compaction_keeps_the_newest_at_the_horizon(spark):
    rows = [("k", s, s, "V" if s != 10 else "T", 1.0 if s != 10 else None) for s in (13, 12, 11, 10, 9, 8)]
    log = spark.createDataFrame(rows, SCHEMA)
    kept = lambda drop: sorted(r["seqno"] for r in maintenance.compact(log, 10, drop).collect())
    assert kept(False) == [10, 11, 12, 13] and kept(True) == [11, 12, 13]
    same = spark.createDataFrame([("ab", 1, 1, "PT", None), ("ab", 2, 2, "V", 1.0), ("abc", 1, 0, "V", 2.0)], SCHEMA)
    assert {r["key"] for r in visible(same, None, 2).collect()} == {"ab", "abc"}  # an equal seqno survives
    assert {(r["key"], r["vtype"]) for r in maintenance.compact(same, 2, True, 2).collect()} == {("ab", "V"), ("abc", "V")}


def test_seek_in_and_beyond_buckets(spark):
    rng = random.Random(3)
    keys = sorted({f"{rng.randrange(10**4):010d}" for _ in range(60)})
    probes = [f"{rng.randrange(10**4):010d}" for _ in range(60)] + keys[:5] + ["9999999999", "0"]
    k, p = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in probes], "key string")
    for bucket in (1, 7, 8, 10):
        up = {r["key"]: r["found_key"] for r in reads.seek(k, p, True, bucket).collect()}
        down = {r["key"]: r["found_key"] for r in reads.seek(k, p, False, bucket).collect()}
        for x in probes:
            assert up[x] == min((y for y in keys if y >= x), default=None)
            assert down[x] == max((y for y in keys if y <= x), default=None)


def test_conflict_outcomes_cascade(spark):
    steps = [
        ("a", "begin", None), ("b", "begin", None), ("a", "put", "k"), ("b", "put", "k"), ("a", "abort", None), ("b", "put", "k"),
        ("b", "commit", None), ("c", "begin", None), ("c", "put", "k"), ("c", "commit", None), ("c", "put", "k"),
    ]
    ops = spark.createDataFrame([("x", i, t, o, k) for i, (t, o, k) in enumerate(steps)], "component string, step long, txn string, op string, key string")
    found = [r["result"] for r in transactions.replay_conflicts(ops).orderBy("step").collect()]
    assert found == ["ok", "ok", "ok", "canceled", "ok", "ok", "ok", "ok", "ok", "ok", "invalid"]


def test_scan_pushes_key_ranges_down(spark, tmp_path):
    from pyspark.sql import functions as F

    from logstrata.functions.keys import parse_size, prefix_range, successor

    spark.range(10).select(F.col("id").cast("string").cast("binary").alias("key")).write.parquet(f"{tmp_path}/k")
    df = spark.read.parquet(f"{tmp_path}/k").where(prefix_range(F.col("key"), b"1\xff"))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert successor(b"\xff\xff") is None and successor(b"a\xff") == b"b"
    sizes = {
        "64": 64, "0": 0, "1k": 1024, " 3 M ": 3 << 20, "1g": 1 << 30, "2T": 2 << 40, "1p": 1 << 50, "1e": 1 << 60, "0x10": 16, "0x10k": 16384, "010": 8,
        "10kb": None, "1GiB": None, "x": None, "": None, "1 k b": None, "089": None, "8e": None, "10000p": None, "99999999999999999999": None,
        "0xffffffffffffffff": None, "0777777777777777777777": 2**63 - 1, None: None,
    }
    found = spark.createDataFrame([(s,) for s in sizes], "s string").select("s", parse_size(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in found} == sizes


def test_catalog_recovery(spark):
    from logstrata.sources.wal import recover_catalog

    rows = [
        (1, 1, "start", None, 2), (2, 1, "add", 10, None), (3, 1, "add", 11, None), (4, 2, "start", None, 2), (5, 2, "add", 12, None),
        (6, 3, "start", None, 1), (7, 3, "add", 13, None), (8, 3, "delete", 10, None), (9, 3, "ack", None, None), (10, 4, "add", 14, None), (11, 4, "nak", None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, txn long, op string, kvset_id long, adds long")
    assert sorted(r["kvset_id"] for r in recover_catalog(df).collect()) == [11, 13]


def test_script_source(spark, tmp_path):
    from logstrata.sources.script import read_script

    (tmp_path / "ops.txt").write_text("p a 1\np b 2 3\nd a\n# note\nD \n")
    found = {bytes(r["key"]): bytes(r["value"]) for r in visible(read_script(spark, f"file://{tmp_path}/ops.txt")).collect()}
    assert found == {b"b": b"2 3"}


def test_key_filters_reach_the_scan(spark, tmp_path):
    rows = [("a", 1, 0, "V", "x", None), ("a", 3, 1, "PT", None, None), ("ab", 2, 2, "V", "y", None), ("ab", 4, 3, "V", "z", None), ("b", 5, 4, "V", "w", None)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, "key string, seqno long, ord long, vtype string, value string, txn_id long").write.parquet(path)
    log = spark.read.parquet(path)
    got = reads.point_get(log, "ab")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,ab)" in plan and "Or(" not in plan
    assert [r["value"] for r in reads.point_get(log, "ab", pfx_len=1).collect()] == ["z"]
    assert reads.point_get(log, "ab", view=3, pfx_len=1).collect() == []
    assert reads.point_get(log, "ab", view=2, pfx_len=1).count() == 1
