"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document has a code, a hash of its id, and its source is cut into equal blocks of codes. How much each source gives is
settled exactly from sums over all documents; how the blocks are dealt to the output shards is drawn by recursive splits:
a node that covers several shards and a count of blocks from each source draws how many of each go to its left half, which
is a multivariate hypergeometric draw. A leaf takes the next blocks of each source's permuted sequence, so shards are
disjoint, and shuffles them by itself. Counts alone are drawn, so the driver works on sources and shards, never on documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
CODE_BITS = 48
#: Each pass over a source's undecided codes parts them into so many; a cell with no more ids than CELL is decided id by id.
DIGIT_BITS = 2
CELL = 256
BLOCK_DOCS = 64
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Share sum(sizes) by weight; a source stops at most * size, and its excess is shared anew until none is above."""
    out, open_ = [0.0] * len(sizes), {i for i, w in enumerate(weights) if w > 0}
    rest = float(sum(sizes))
    while open_:
        scale = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * scale > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        open_ -= full
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal counts of blocks by source to shards, whose totals differ by one at most; (shards, sources)."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    share = total * left // shards
    part = rng.multivariate_hypergeometric(quotas, share, method="marginals") if total else np.zeros_like(quotas)
    return np.concatenate([split_tree(part, left, rng), split_tree(quotas - part, shards - left, rng)])


@dataclass
class Source:
    """What a source gives: `epochs` copies of all, and one more of codes under `below` and of the ids in `chosen`."""

    name: str | None
    docs: int
    size: int
    target: float
    epochs: int = 0
    below: int = 0
    chosen: list[int] = field(default_factory=list)
    blocks: int = 1
    over: int = 0
    stride: int = 1
    starts: list[int] = field(default_factory=list)


def _code(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - CODE_BITS)


def _settle(rows: DataFrame, sources: list[Source]) -> None:
    """Find for each source how far up its codes one more copy goes, so that its words come nearest to its target."""
    spark = rows.sparkSession
    # By source: start of the undecided cell, its width in bits, words still to take there.
    open_ = {s.name: [0, CODE_BITS, s.target - s.epochs * s.size, s.docs] for s in sources if s.target > s.epochs * s.size}
    by_name = {s.name: s for s in sources}
    while wide := {k: v for k, v in open_.items() if v[3] > CELL and v[1] > 0}:
        cells = spark.createDataFrame([(k, v[0], v[1]) for k, v in wide.items()], "s string, start long, bits int")
        inside = rows.join(F.broadcast(cells), F.col("source").eqNullSafe(F.col("s"))).where(
            F.expr("shiftright(code, bits) = shiftright(start, bits)")
        )
        digit = F.expr(f"shiftright(code, bits - {DIGIT_BITS}) & {2**DIGIT_BITS - 1}").cast("int")
        found = inside.groupBy("s", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        sums = {(r["s"], r["digit"]): (r["size"], r["n"]) for r in found}
        for k, v in wide.items():
            v[1] -= DIGIT_BITS
            for d in range(2**DIGIT_BITS):
                size, n = sums.get((k, d), (0, 0))
                if size > v[2]:
                    v[0], v[3] = v[0] + (d << v[1]), n
                    break
                v[2] -= size
            else:
                v[0], v[3] = v[0] + (1 << v[1] + DIGIT_BITS), 0
    for k, v in open_.items():
        by_name[k].below = v[0]
    cells = [(k, v[0], v[1]) for k, v in open_.items() if v[3]]
    if not cells:
        return
    last = spark.createDataFrame(cells, "s string, start long, bits int")
    inside = rows.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("s"))).where(
        F.expr("shiftright(code, bits) = shiftright(start, bits)")
    )
    ids = inside.groupBy("s", "doc_id").agg(F.sum("size").alias("size")).collect()  # at most CELL ids of each source
    for r in sorted(ids, key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"])):
        v = open_[r["s"]]
        if r["size"] <= v[2] and r["doc_id"] is not None:
            v[2] -= r["size"]
            by_name[r["s"]].chosen.append(r["doc_id"])


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    shards: int = 16,
    seed: int = 20240607,
) -> DataFrame:
    """Plan a mix of whole documents in which each source's words come near its share by weight.

    Sources are in code point order, null last, and take the weights in turn. A source whose share is above `most` times its
    words stops there. Adds to the columns of docs: size (words), source_size, target (words, of the source), copies
    (how often the mix takes the document) and shards (which shard takes each copy); columns of docs with these names are
    replaced. Equal ids of a source share their copies; a null id or text counts like others, a text without words has size 0; an
    empty table gives an empty result. The same rows and seed always give the same mix. There may be 100,000 sources.
    """
    spark = docs.sparkSession
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = materialize(docs.select("doc_id", "source", count.alias("size"), _code(seed).alias("code")), "sizes")
    stats = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["size"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], most)
    sources = [Source(r["source"], r["docs"], r["size"], t) for r, t in zip(stats, goals, strict=True)]
    for s in sources:
        s.epochs = min(math.floor(most), int(s.target / s.size + 1e-12)) if s.size else 0
    _settle(rows, sources)
    rng = np.random.default_rng(seed)
    quotas = []
    for s in sources:
        s.blocks = math.ceil(s.docs / BLOCK_DOCS)
        s.over = min(s.blocks, (s.below * s.blocks >> CODE_BITS) + 1) if s.below or s.chosen else 0
        both = s.blocks * max(1, s.over)
        s.stride = next(k for k in iter(lambda: int(rng.integers(1, both + 1)), None) if math.gcd(k, both) == 1)
        quotas.append(s.epochs * s.blocks + s.over)
    dealt = split_tree(np.array(quotas, np.int64), shards, rng) if sources else np.zeros((shards, 0), np.int64)
    for i, s in enumerate(sources):
        s.starts = np.cumsum(dealt[:, i]).tolist()
    table = spark.createDataFrame(
        [(s.name, s.size, s.target, s.epochs, s.below, s.chosen, s.blocks, s.over, s.stride, s.starts) for s in sources],
        "_s string, source_size long, target double, _epochs int, _below long, _chosen array<long>, _blocks long, _over long, _stride long, _starts array<long>",
    )
    added = ("size", "source_size", "target", "copies", "shards")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    joined = docs.select(*rest, count.alias("size"), _code(seed).alias("_code")).join(
        F.broadcast(table), F.col("source").eqNullSafe(F.col("_s"))
    )
    more = (F.col("_code") < F.col("_below")) | F.coalesce(F.array_contains("_chosen", F.col("doc_id").cast("long")), F.lit(False))
    # A stride permutes the blocks of an epoch; the last epoch has only the first blocks of the codes.
    block = F.floor(F.col("_code").cast("double") / float(2**CODE_BITS) * F.col("_blocks")).cast("long")
    within = lambda e: F.when(e < F.col("_epochs"), F.col("_blocks")).otherwise(F.greatest(F.lit(1), F.col("_over")))
    place = lambda e: e * F.col("_blocks") + F.pmod(block * F.pmod(F.col("_stride"), within(e)) + e, within(e))
    shard = lambda at: F.least(F.size(F.filter("_starts", lambda x: x <= at)), F.lit(shards - 1))
    planned = joined.withColumn("copies", F.col("_epochs") + more.cast("int"))
    dealt_to = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: shard(place(e.cast("long")))))
    return planned.withColumn("shards", F.coalesce(dealt_to, F.array().cast("array<int>"))).select(
        *rest, "size", "source_size", "target", "copies", "shards"
    )


def draw(plan: DataFrame, shards: int = 16, seed: int = 20240607) -> DataFrame:
    """The mix itself: a row for each copy with its shard, each shard in one partition range and shuffled within."""
    copies = plan.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards", "copies")
    copies = copies.withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return copies.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
