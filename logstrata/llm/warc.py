"""WARC archives: a writer and a reader that verifies the chain of record boundaries.

A page may hold the text that begins a record. The reader therefore lists every place where a record could
begin with the place where its successor would, and keeps only the places that pointer jumping reaches from
the file's start.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch_path

VERSION = "WARC/1.0"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GAP = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of a SHA-1: five hex digits make four characters."""
    digits = F.sha1(data)
    chars = []
    for i in range(8):
        v = F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload an equal one with a larger page_id holds.

    Digests are grouped with partial aggregation; only digests that occur more than once are joined back.
    """
    dig = materialize(
        pages.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes).drop("payload_bytes"),
        "digests",
    )
    shared = (
        dig.groupBy("payload_digest")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    later = dig.join(shared, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives under path.

    Of records with equal payloads of min_bytes or more the one with the largest page_id is a response, the others
    are revisits without a payload. Rows that repeat both page_id and html get a record each, of one type. A null html
    is an empty payload; a null url or page_id leaves its header out, and line ends in a url become blanks. Other columns
    are not read. An archive is as large as an input split, so a reader's task has a bounded file.
    """
    payload = F.coalesce("html", F.lit(""))
    full = pages.select(
        "page_id",
        F.regexp_replace("url", "[\r\n]", " ").alias("url"),
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        sha1_base32(payload.cast("binary")).alias("payload_digest"),
    )
    later = broadcast_if_small(materialize(revisits(full, min_bytes), "revisits")).withColumnsRenamed(
        {"page_id": "_page", "payload_digest": "_digest"}
    )
    rows = full.join(
        later, full["page_id"].eqNullSafe(later["_page"]) & (full["payload_digest"] == later["_digest"]), "left"
    )
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP)
    )
    body = F.when(again, "").otherwise(F.col("html"))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(again, f"WARC-Profile: {_PROFILE}\r\n").otherwise(""),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(GAP),
        http,
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets where a record could begin, where its block would, and where its successor would begin."""
    at, block, after = [], [], []
    for m in _MAGIC.finditer(data):
        end = data.find(b"\r\n\r\n", m.start())
        if end < 0:
            continue
        length = _LENGTH.search(data, m.end(), end + 2)
        if length and len(length[1]) <= 18:
            at.append(m.start())
            block.append(end + 4)
            after.append(end + 4 + int(length[1]) + 4)
    return np.array(at, np.int64), np.array(block, np.int64), np.array(after, np.int64)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mask of the candidates that are reached from offset 0 by following successors, by pointer jumping."""
    n = len(at)
    jump = np.searchsorted(at, after)
    jump = np.where((jump < n) & (at[np.minimum(jump, n - 1)] == after), jump, n) if n else jump
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and at[0] == 0
    hops = 1
    while hops <= n:
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        hops *= 2
    return seen[:n]


def _parse(name: str, data: bytes) -> Iterator[tuple]:
    at, block, after = candidates(data)
    mask = reachable(at, after)
    reached = after[mask]
    if len(data) and (not len(reached) or reached[-1] != len(data)):
        raise ValueError(f"{name}: the chain of records breaks off at byte {reached[-1] if len(reached) else 0}")
    for a, b, c in zip(at[mask].tolist(), block[mask].tolist(), after[mask].tolist(), strict=True):
        head = {}
        for x in data[a : b - 4].split(b"\r\n")[1:]:
            key, _, value = x.partition(b":")
            head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
        number = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?[0-9]+)>", head.get(k, ""))) else None  # noqa: E731, B023
        digest, size = head.get(b"warc-payload-digest", "").removeprefix("sha1:"), int(head.get(b"x-payload-length", -1))
        if head.get(b"warc-type") == "response":
            payload = memoryview(data)[data.index(b"\r\n\r\n", b) + 4 : c - 4]
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest and found != digest:
                raise ValueError(f"{name}: the record at byte {a} does not match its digest")
            digest, size = found, len(payload)
        yield number(b"warc-record-id"), size, digest, head.get(b"warc-type"), number(b"warc-refers-to"), head.get(b"warc-target-uri")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    for batch in batches:
        for name, data in zip(batch["path"], batch["content"], strict=True):
            rows = pd.DataFrame(list(_parse(name, data)), columns=names, dtype=object)
            yield rows.astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to")})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Read archives; payload sizes and digests of responses come from the payloads themselves.

    A file is one task's row, so archives must be under 2 GB, which is what Spark reads as one value. A chain that does
    not end at the file's end, and a payload that differs from its digest, raise an error. An empty archive has no records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_read, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(pages.sparkSession, path)
