"""Command line: python -m logstrata.cli kvdb|kvs|storage|utils ..."""

from __future__ import annotations

import argparse
import errno
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.statistics import profile
from .sources.store import Database, StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logstrata")
    areas = top.add_subparsers(dest="area", required=True)

    def area(name: str, verbs: dict[str, list[str]]) -> None:
        sub = areas.add_parser(name).add_subparsers(dest="verb", required=True)
        for verb, args in verbs.items():
            p = sub.add_parser(verb)
            for a in args:
                p.add_argument(a, **({"nargs": "*"} if a == "params" else {}))

    area("kvdb", {"create": ["home", "params"], "drop": ["home"], "info": ["home"], "compact": ["home"]})
    area("kvs", {"create": ["home", "name", "params"], "drop": ["home", "name"]})
    area("storage", {"add": ["home", "media", "path"], "info": ["home"], "profile": ["path"]})
    area("utils", {"strerror": ["number"]})
    return top


def _params(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        name, _, value = pair.partition("=")
        out[name] = json.loads(value) if value[:1].isdigit() or value in ("true", "false") else value
    return out


def write_latencies(spark: SparkSession, path: str, n: int = 64, size: int = 4096):
    """Seconds of n small writes to a folder that this machine sees, as rows."""
    rows = []
    for i in range(n):
        name = os.path.join(path, f".profile-{os.getpid()}-{i}")
        began = time.perf_counter()
        with open(name, "wb") as f:
            f.write(bytes(size))
            f.flush()
            os.fsync(f.fileno())
        rows.append((path, time.perf_counter() - began))
        os.remove(name)
    return spark.createDataFrame(rows, "path string, seconds double")


def run(spark: SparkSession, argv: list[str]) -> object:
    a = parser().parse_args(argv)
    match a.area, a.verb:
        case "kvdb", "create":
            Database.create(spark, a.home, **_params(a.params))
        case "kvdb", "drop":
            Database.drop(spark, a.home)
        case "kvdb", "info":
            db = Database(spark, a.home, mode="rdonly")
            return {"home": db.home, "kvs": db.names(), "params": db.params, "seqno": db.seqno}
        case "kvdb", "compact":
            with Database(spark, a.home) as db:
                db.compact()
                return db.compact_status()
        case "kvs", verb:
            with Database(spark, a.home) as db:
                if verb == "create":
                    db.kvs_create(a.name, **_params(a.params))
                else:
                    db.kvs_drop(a.name)
        case "storage", "add":
            with Database(spark, a.home) as db:
                db.storage_add(a.media, a.path)
        case "storage", "info":
            db = Database(spark, a.home, mode="rdonly")
            return {m: db.media_info(m) for m in db.catalog["media"]}
        case "storage", "profile":
            return profile(write_latencies(spark, a.path), "seconds", "path").select(F.to_json(F.struct("*"))).first()[0]
        case "utils", "strerror":
            number = int(a.number)
            return f"{errno.errorcode.get(number, 'unknown')}: {os.strerror(number)}"
    return None


def main() -> int:
    spark = SparkSession.builder.appName("logstrata").getOrCreate()
    try:
        out = run(spark, sys.argv[1:])
    except StoreError as e:
        print(e, file=sys.stderr)
        return e.errno
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
