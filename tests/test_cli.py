import errno

import pytest

from logstrata.cli import run
from logstrata.sources.store import Database, StoreError


def test_commands(spark, tmp_path):
    home = f"file://{tmp_path}/db"
    run(spark, ["kvdb", "create", home, "txn_timeout=1000"])
    run(spark, ["kvs", "create", home, "a", "prefix.length=2"])
    with Database(spark, home) as db:
        store = db.kvs_open("a")
        store.put(b"ab", b"1")
        store.put(b"ab", b"2")
        assert store.param_get("prefix.length") == "2"
        assert db.params_table().where("scope = 'a'").count() == 4
    info = run(spark, ["kvdb", "info", home])
    assert info["kvs"] == ["a"] and info["params"]["txn_timeout"] == 1000
    assert run(spark, ["kvdb", "compact", home])["samp_curr"] == 100
    with Database(spark, home) as db:
        assert [tuple(r)[:2] for r in db.metrics().collect()] == [("a", 1)]
        assert db.kvs_open("a").get(b"ab") == (True, b"2")
    run(spark, ["storage", "add", home, "staging", f"{tmp_path}/s"])
    assert set(run(spark, ["storage", "info", home])) == {"capacity", "staging"}
    assert "load" in run(spark, ["storage", "profile", str(tmp_path)])
    run(spark, ["kvs", "drop", home, "a"])
    assert "ENOENT" in run(spark, ["utils", "strerror", str(errno.ENOENT)])
    run(spark, ["kvdb", "drop", home])
    with pytest.raises(StoreError):
        run(spark, ["kvdb", "info", home])
