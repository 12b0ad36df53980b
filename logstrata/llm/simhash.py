"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a nonzero vector m(i) of r + 1 bits. Table v, for each nonzero v of r + 1 bits, keys
a fingerprint by those of its bits whose m(i) has an odd product with v. The bits in which two fingerprints within
radius r differ span at most r dimensions, so some v is orthogonal to all of them, and the pair meets in that table: every
pair within the radius is found, not only most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, materialize, text_or_empty

SEED = 42
#: Fingerprints of one key that meet in one task, 8 bytes each; a larger group is covered again over the bits it has left.
HELD = 1 << 16
#: Groups up to this size are compared as matrices, larger ones by breadth-first search.
MATRIX = 64
#: Rows of keys that one task makes.
KEYS_A_TASK = 1_000_000
#: Texts that are compared as a matrix. One task compares all blocks of a group, up to so many blocks and shingles; only vast groups, with
#: more, are first cut down by hubs, then told apart by further bands.
CHECKED = 512
BLOCKS = 8
SHINGLES_A_TASK = 4_000_000
HUB_ROUNDS = 4
#: Edges that one hub's set of shingles is sent along with, on average.
EDGES_A_HUB = 1024
#: Min-hashes of a set of shingles: so many bands of so many each. Sets of similarity 0.8 agree in some band in 99.99 % of cases.
BANDS, IN_BAND = 32, 6
_STEP = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the lower-cased text's word shingles; 0 without words, one shingle if there are few."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = start + size
    width = min(shingle, len(words))
    n = len(words) - width + 1
    starts, ends = start[:n].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        hashes = np.array(
            [digest(data[a:b], SEED) for a, b in zip(starts[i : i + _STEP], ends[i : i + _STEP], strict=True)], np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of whole texts; fp holds the 64 bits as a signed long. A null text has no words."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((_signed(fingerprint(t, shingle)) for t in texts), np.int64, len(texts)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), each(text_or_empty()).alias("fp"))


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over some of the 64 bits, all by default.

    With more vectors than bits, all m(i) share their highest bit and differ in the others, which for radius 6 is the
    first-order Reed-Muller code: each mask has 32 bits or all. Otherwise m(i) takes all vectors in turn. Either way masks
    are about half as wide as the bits, so that keys part fingerprints well.
    """
    bits = list(range(64)) if bits is None else bits
    n, top = (1 << (radius + 1)) - 1, 1 << radius
    vector = (lambda i: 1 + i % n) if n < 64 else (lambda i: top | i * 37 % top)
    return [sum(1 << x for i, x in enumerate(bits) if (vector(i) & v).bit_count() % 2) for v in range(1, n + 1)]


def _keys(classes: DataFrame, radius: int) -> DataFrame:
    # A few bytes become a row for each table, so the fingerprints are dealt out by what they become.
    rows = classes.count() << (radius + 1)
    classes = classes.repartition(math.ceil(rows / KEYS_A_TASK) or 1, "fp")
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)]))
    return classes.select("fp", masks.alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def _covered_again(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Keys of fingerprints that agree in a mask's bits, by a covering of the others: what two of them differ in lies there."""
    for x in batches:
        for mask, rows in x.groupby("mask"):
            free = [i for i in range(64) if not mask >> i & 1]
            fps = rows["fp"].to_numpy()
            for m in covering_masks(radius, free):
                wider = _signed((m | mask) & (1 << 64) - 1)
                yield pd.DataFrame({"mask": wider, "key": fps & np.int64(wider), "fp": fps})


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """fps: groups by members. Edges that join each member to the least of those it is linked to, directly or not."""
    near = np.bitwise_count(fps[:, :, None] ^ fps[:, None, :]) <= radius
    n = fps.shape[1]
    label = np.broadcast_to(np.arange(n), fps.shape).copy()
    while True:
        new = np.where(near, label[:, None, :], n).min(axis=2)
        new = np.take_along_axis(new, new, axis=1)
        if (new == label).all():
            break
        label = new
    g, i = np.nonzero(label != np.arange(n))
    return fps[g, i], fps[g, label[g, i]]


def _search(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one group. Each fingerprint is held against those that are not reached yet, which in a dense group are soon none."""
    left, a, b = fps, [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                queue.extend(reached)
                a.append(reached)
                b.append(np.full(len(reached), root))
    none = [np.empty(0, fps.dtype)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _link_sorted(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by mask, key and fp; a group may go on in the next batch."""
    rest = None

    def linked(x: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
        new = np.ones(len(x), bool)
        new[1:] = np.logical_or.reduce([x[c].to_numpy()[1:] != x[c].to_numpy()[:-1] for c in ("mask", "key")])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(x)))
        keep = None
        if not last:
            keep = x.iloc[first[-1] :]
            first, size = first[:-1], size[:-1]
        fps, out = x["fp"].to_numpy().view(np.uint64), []

        def add(a: np.ndarray, b: np.ndarray) -> None:
            out.append(pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}))

        for s in np.unique(size):
            if s < 2:
                continue
            at = first[size == s]
            if s > MATRIX:
                for i in at:
                    add(*_search(fps[i : i + s], radius))
                continue
            step = max(1, (1 << 22) // int(s * s))
            for i in range(0, len(at), step):
                add(*_stars(fps[at[i : i + step, None] + np.arange(s)], radius))
        return out, keep

    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if len(x):
            out, rest = linked(x, False)
            yield from out
    if rest is not None and len(rest):
        yield from linked(rest, True)[0]


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, no more than one per fingerprint and group, whose components are
    those of all pairs within the radius. classes: distinct fp, cheap to read twice.

    A group of more than HELD fingerprints is covered again over the bits that its mask leaves out, until none is larger: the
    rows this makes grow with the group, not with its square.
    """
    rows, found = _keys(classes, radius), None
    while True:
        groups = materialize(
            rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
            "groups",
        )
        distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        pairs = groups.where("n = 2").where(distance <= radius).select("a", "b")
        # The groups of three or more are few, two numbers each; beyond the bound the join is a shuffled one.
        held = materialize(groups.where((F.col("n") > 2) & (F.col("n") <= HELD)).select("mask", "key"), "held")
        met = rows.join(broadcast_if_small(held, 400_000), ["mask", "key"])
        met = met.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        linked = met.mapInPandas(lambda it: _link_sorted(it, radius), "a long, b long")
        found = pairs.unionByName(linked) if found is None else found.unionByName(pairs).unionByName(linked)
        larger = groups.where(F.col("n") > HELD).select("mask", "key")
        if larger.isEmpty():
            return found
        again = rows.join(broadcast_if_small(larger, 400_000), ["mask", "key"]).select("mask", "fp")
        again = again.mapInPandas(lambda it: _covered_again(it, radius), "mask long, key long, fp long")
        rows = materialize(again.distinct(), "again")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """Fingerprint and component of every document.

    Returns doc_id, fp (signed long), component_id: the smallest doc_id that links of at most `radius` differing bits
    reach. Equal fingerprints are one class from the start, so copies cost nothing further. A null text and a text without
    words have fingerprint zero and are linked like any other; a null doc_id gets the component of its fingerprint, but
    names none; repeated rows stay; an empty table gives an empty result. Other columns are not read.
    """
    return _components(materialize(fingerprints(docs, shingle), "fingerprints"), radius)


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """fps: doc_id, fp and any other columns, cheap to read. Adds component_id."""
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(near_links(classes, radius), "a", "b")
    rooted = materialize(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "root"), "rooted")
    # A fingerprint that is linked with none names itself; of the others there are few.
    linked = rooted.where(F.col("root").isNotNull())
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = linked.join(broadcast_if_small(least, 400_000), "root").select("fp", "component_id")
    alone = rooted.where(F.col("root").isNull()).select("fp", F.col("first").alias("component_id"))
    named = materialize(named.unionByName(alone), "named")
    return fps.join(named, "fp").select(*fps.columns, "component_id")


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Ascending distinct hashes of the lower-cased text's word shingles; one shingle if there are few words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)], np.uint64))


def similar_pairs(sets: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of which sets have at least this Jaccard similarity to which others."""
    rows, columns = (np.array([len(x) for x in y], np.int64) for y in (sets, others))
    p, q = (np.concatenate(y) if y else np.empty(0, np.uint64) for y in (sets, others))
    # What only one side has is shared by no pair.
    both = np.intersect1d(p, q)
    shared = np.zeros((len(sets), len(others)))
    at, owner = [], []
    for x, size in ((p, rows), (q, columns)):
        i = np.searchsorted(both, x)
        found = np.append(both, 0)[i] == x if len(both) else np.zeros(len(x), bool)
        found &= i < len(both)
        i, own = i[found], np.repeat(np.arange(len(size)), size)[found]
        order = np.argsort(i, kind="stable")
        at.append(i[order])
        owner.append(own[order])
    step = 4096
    for a in range(0, len(both), step):
        sides = []
        for i, own, n in zip(at, owner, (len(sets), len(others)), strict=True):
            j, k = np.searchsorted(i, (a, a + step))
            part = np.zeros((n, min(step, len(both) - a)), np.float32)
            part[own[j:k], i[j:k] - a] = 1
            sides.append(part)
        shared += sides[0] @ sides[1].T
    union = rows[:, None] + columns[None, :] - shared
    return (union > 0) & (shared >= similarity * union - 1e-9)


def _cross_links(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join what is similar across labels. sets come by label; blocks of one label alone are not compared."""
    parent, a, b = label.copy(), [], []
    for i in range(0, len(sets), CHECKED):
        for j in range(i, len(sets), CHECKED):
            rows, columns = np.arange(i, min(i + CHECKED, len(sets))), np.arange(j, min(j + CHECKED, len(sets)))
            x, y = parent[rows], parent[columns]
            # Rows that are one with all columns, and columns that are one with all rows, have nothing to find.
            rows, columns = (rows[x != y[0]] if (y == y[0]).all() else rows), (columns[y != x[0]] if (x == x[0]).all() else columns)
            if not len(rows) or not len(columns):
                continue
            near = similar_pairs([sets[x] for x in rows], [sets[x] for x in columns], similarity)
            near &= parent[rows][:, None] != parent[columns][None, :]
            for x, y in zip(*np.nonzero(near), strict=True):
                p, q = parent[rows[x]], parent[columns[y]]
                if p != q:
                    parent[parent == q] = p
                    a.append(columns[y])
                    b.append(rows[x])
    return np.array(a, np.int64), np.array(b, np.int64)


def _cross_sorted(batches: Iterator[pd.DataFrame], columns: list[str], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by their group's columns and label; a group may go on in the next batch."""
    rest: list[pd.DataFrame] = []

    def linked(x: pd.DataFrame) -> pd.DataFrame:
        ids = x["node"].to_numpy()
        a, b = _cross_links([np.frombuffer(d, np.uint64) for d in x["shingles"]], x["label"].to_numpy(), similarity)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    for x in batches:
        if not len(x):
            continue
        part = x[columns].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]).any(axis=1))))
        if rest and (rest[-1][columns].to_numpy()[-1] == part[0]).all():
            rest.append(x.iloc[: first[1]] if len(first) > 1 else x)
            first = first[1:]
        if len(first):
            if rest:
                yield linked(pd.concat(rest, ignore_index=True))
            for a, b in zip(first, first[1:], strict=False):
                yield linked(x.iloc[a:b])
            rest = [x.iloc[first[-1] :]]
    if rest:
        yield linked(pd.concat(rest, ignore_index=True))


@cache
def _factors(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, BANDS * IN_BAND, np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A hash for each band of the set's min-hashes; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max, np.uint64)
    factors = _factors(seed)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * factors).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, IN_BAND))], np.uint64).view(np.int64)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets of shingles have this Jaccard similarity. sets: node, shingles.

    A hub, b of many edges, is sent along with shares of them, so that no task holds all edges of one.
    """

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            both = len(p) + len(q) - shared
            out.append(both > 0 and shared >= similarity * both - 1e-9)
        return pd.Series(out, dtype=bool)

    shares = max(1, math.ceil(edges.count() / EDGES_A_HUB))
    salted = edges.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(shares)).alias("salt"))
    hubs = salted.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    ends = salted.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(hubs, ["b", "salt"])
    p, q = F.octet_length("x"), F.octet_length("y")
    possible = F.least(p, q) >= (similarity - 1e-9) * F.greatest(p, q)
    return ends.where(possible).where(near("x", "y")).select("a", "b")


def text_hashes() -> tuple[Column, Column]:
    """Two hashes that tell texts apart; a null text is an empty one."""
    return F.xxhash64(text_or_empty()).alias("h"), F.xxhash64(F.lit(1), text_or_empty()).alias("k")


def similar_texts(docs: DataFrame, radius: int = 6, shingle: int = 2, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Components of distinct texts whose sets of `width`-word shingles have at least this Jaccard similarity.

    Texts meet in groups from two sources: components of covering tables over fingerprints of short shingles, which a changed word
    disturbs least, and bands of min-hashes of the `width`-word shingles, in one of which a pair at 0.8 meets in 99.99 % of cases.
    Sets of shingles decide, exactly: first each text is held against its group's hub, and what that joins is one from there on; then
    what a group still has in several parts is compared across them. A band inside a component whose texts are all compared adds nothing
    and is left out. Returns h and k (see text_hashes), first (smallest doc_id of the text, null if it has none) and component (a number).
    """

    @F.pandas_udf("fp long, size long, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        fps = np.fromiter((_signed(fingerprint(t, shingle)) for t in texts), np.int64, len(texts))
        sets = [shingle_hashes(t, width) for t in texts]
        return pd.DataFrame({"fp": fps, "size": [len(x) for x in sets], "bands": [band_keys(x) for x in sets]})

    @F.pandas_udf("binary")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, width).tobytes() for t in texts])

    @F.pandas_udf("array<long>")
    def further(sets: pd.Series) -> pd.Series:
        return pd.Series([band_keys(np.frombuffer(b, np.uint64), SEED + 1) for b in sets])

    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()
    sketches = docs.select(doc_id, *text_hashes(), sketched(text).alias("s"))
    texts = sketches.groupBy("h", "k").agg(F.min("doc_id").alias("first"), F.any_value("s").alias("s"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("node"), "h", "k", "first", "s.*"), "texts")
    proposed = _components(texts.select(F.col("node").alias("doc_id"), "fp", "size", "bands"), radius).withColumnRenamed("doc_id", "node")
    group = ["band", "key"]
    own = F.array(F.struct(F.lit(-1).alias("band"), F.col("component_id").alias("key")))
    banded = F.transform("bands", lambda x, i: F.struct(i.alias("band"), x.alias("key")))
    keys = proposed.select("node", "size", "component_id", F.inline(F.concat(own, banded)))
    keys = materialize(keys, "keys")
    n, size = F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    vast = (F.col("n") > CHECKED) & ((F.col("n") > CHECKED * BLOCKS) | (F.col("size") > SHINGLES_A_TASK))
    component = F.min("component_id").alias("c"), (F.min("component_id") < F.max("component_id")).alias("across")
    shared = keys.groupBy(*group).agg(n, size, F.min("node").alias("b"), F.max("node").alias("a"), *component)
    shared = materialize(shared.where("n > 1"), "shared")
    open_to = shared.where("band < 0").where(vast).select("c", F.lit(True).alias("vast"))
    needed = shared.join(broadcast_if_small(open_to), "c", "left").where("band < 0 or across or vast")
    needed = materialize(needed.select(*group, "n", "a", "b"), "needed")
    larger = needed.where("n > 2").select(*group, "b")
    members = materialize(keys.drop("component_id").join(broadcast_if_small(larger, 400_000), group), "members")
    edges = members.where("node <> b").select(F.col("node").alias("a"), "b").unionByName(needed.where("n = 2").select("a", "b"))
    edges = materialize(edges.distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    named = texts.join(ends, "node", "left_semi").select("node", "h", "k", "first")
    rows = docs.select(doc_id, *text_hashes(), text.alias("text")).alias("d")
    same = (F.col("d.h") == F.col("m.h")) & (F.col("d.k") == F.col("m.k")) & F.col("doc_id").eqNullSafe(F.col("first"))
    sets = rows.join(named.alias("m"), same).select("node", "text").dropDuplicates(["node"])
    sets = materialize(sets.select("node", shingled("text").alias("shingles")), "sets")

    links = materialize(verified(edges, sets, similarity), "links")
    told = members.select(*group, "node", "size")
    for t in range(HUB_ROUNDS + 1):
        roots = connected_components(links, "a", "b")
        told = told.join(roots, "node", "left").select(*group, "node", "size", F.coalesce("root", "node").alias("label"))
        told = materialize(told, "told")
        h = F.xxhash64("node")
        parts = told.groupBy(*group).agg(
            n, size, F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(h).alias("x"),
            F.sum(F.shiftright(h, 24)).alias("y"), F.min_by(F.struct("node", "label"), F.xxhash64(F.lit(t), "node")).alias("hub"),
        )
        # Groups with the same members, as bands of copies have them, are looked at once; those in one part are done with.
        parts = parts.where("low < high").groupBy("n", "x", "y").agg(F.min(F.struct(*group, "size", "hub")).alias("g"))
        parts = materialize(parts.select("n", "g.*").withColumn("vast", vast), "parts")
        open_ = told.join(broadcast_if_small(parts.select(*group, "hub", "vast"), 400_000), group)
        wide = not parts.where("vast").isEmpty()
        if t == HUB_ROUNDS or not wide:
            break
        met = open_.where("vast and label <> hub.label")
        more = materialize(met.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct(), "edges")
        links = materialize(links.unionByName(verified(more, sets, similarity)), "links")
        told = open_.select(*group, "node", "size")
    columns = [*group, "sub", "at"]
    compared = open_.where("not vast").select(*group, F.lit(0).alias("sub"), F.lit(0).cast("long").alias("at"), "node", "label")
    if wide:
        banded = open_.where("vast").join(sets, "node").select(*group, "node", "label", F.posexplode(further("shingles")).alias("sub", "at"))
        banded = materialize(banded, "further")
        several = banded.groupBy(*columns).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        compared = compared.unionByName(banded.join(broadcast_if_small(materialize(several.select(*columns), "several"), 400_000), columns))
    compared = compared.join(sets, "node").select(*columns, "label", "node", "shingles")
    compared = compared.repartition(*columns).sortWithinPartitions(*columns, "label", "node")
    found = compared.mapInPandas(lambda it: _cross_sorted(it, columns, similarity), "a long, b long")
    roots = connected_components(links.unionByName(found), "a", "b").withColumnRenamed("node", "linked")
    named = texts.join(roots, F.col("node") == F.col("linked"), "left")
    return materialize(named.select("h", "k", "first", F.coalesce("root", "node").alias("component")), "told")


def similar_documents(docs: DataFrame, radius: int = 6, shingle: int = 2, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Components of documents by similar_texts. Returns doc_id, component_id (smallest doc_id reachable).

    Equal texts are one class. Nulls, repeats and empty tables are as in near_duplicates; a null doc_id is its own.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    texts = similar_texts(named, radius, shingle, width, similarity)
    least = texts.groupBy("component").agg(F.min("first").alias("component_id"))
    told = materialize(texts.join(least, "component").select("h", "k", "component_id"), "least")
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes())
    return rows.join(told, ["h", "k"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
