"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by the ordered pivots, reference points drawn from the data, that it is nearest to. Inverted lists are kept
for pairs of pivots: two vectors meet in a list if their descriptions share both of its pivots, so meeting at all
means a shared-pivot count of two or more. A pair counts in the list of the two least pivots it shares, and only
after its cosine has been computed from the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, materialize

#: The bounded sample that the index is fitted on, the pivots drawn from it at most, and the length of a description. In 64
#: dimensions random pairs of cosine 0.93 share two of six pivots in 99.1 % of cases, of cosine 0.98 in practically all.
SAMPLE = 4096
PIVOTS = 256
DESCRIBED = 6
#: Beyond the first DESCRIBED, no two pivots are as near as this, or the members of a dense group would be told apart by pivots inside it.
APART = 0.9
#: The share of the sample's linked pairs that have to meet; fewer pivots are taken until they do. So many pairs are looked at.
MET = 0.98
TRIED = 200_000
#: Members of a list that meet in one task; a larger list is split into blocks, and each two blocks meet.
BLOCK = 512


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` unit vectors of a sample, each the farthest from those before it; at least DESCRIBED if there are so many."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    near[0] = np.inf
    while len(chosen) < min(most, len(sample)):
        i = int(near.argmin())
        if near[i] >= APART and len(chosen) >= DESCRIBED:
            break
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
        near[chosen] = np.inf
    return sample[chosen]


def describe(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Indices of the nearest pivots by angle, nearest first; the lower index in a tie."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :length]


def list_keys(described: np.ndarray, pivots: int) -> np.ndarray:
    """Keys of the inverted lists, one for each two pivots of a description."""
    near = np.sort(described, axis=1)
    pairs = list(combinations(range(near.shape[1]), 2))
    if not pairs:
        return np.zeros((len(near), 0), np.int64)
    return np.stack([near[:, a].astype(np.int64) * pivots + near[:, b] for a, b in pairs], axis=1)


def fitted(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The pivots of a sample of unit vectors: as many as let its pairs at the threshold meet.

    Where all vectors lie near each other, as embeddings that are not centred do, the nearest of many pivots tell linked vectors apart.
    Descriptions by 2 * DESCRIBED - 2 pivots or fewer always share two.
    """
    points = spread_out(sample, PIVOTS)
    found, step = [], max(1, (1 << 22) // max(1, len(sample)))
    for s in range(0, len(sample), step):
        i, j = np.nonzero(sample[s : s + step] @ sample.T >= threshold)
        i += s
        found.append(np.stack([i[i < j], j[i < j]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[:: max(1, math.ceil(len(pairs) / TRIED))]
    while len(points) > 2 * DESCRIBED - 2:
        a, b = (describe(sample, points, DESCRIBED)[pairs[:, k]] for k in (0, 1))
        met = sum((a == b[:, k, None]).any(axis=1).astype(int) for k in range(DESCRIBED)) >= 2
        if met.sum() >= MET * len(pairs):
            break
        points = points[: max(len(points) // 2, 2 * DESCRIBED - 2)]
    return points


def _met(size: int, key: np.ndarray, own: np.ndarray, across: np.ndarray, x: dict, threshold: float, pivots: int) -> list[pd.DataFrame]:
    """Links inside groups of one size. x: arrays by group and member."""
    v, norm = x["vec"], x["norm"]
    cosine = np.einsum("gid,gjd->gij", v, v, optimize=True) if size < 64 else v @ v.transpose(0, 2, 1)
    cosine /= norm[:, :, None] * norm[:, None, :]
    near = cosine >= threshold
    near &= ~np.eye(size, dtype=bool)
    g, i, j = np.nonzero(near)
    if not len(g):
        return []
    label = np.broadcast_to(np.arange(size), near.shape[:2]).copy()
    while True:
        new = np.minimum(label, np.where(near, label[:, None, :], size).min(axis=2))
        new = np.take_along_axis(new, new, axis=1)
        if (new == label).all():
            break
        label = new
    a, b = np.nonzero(label != np.arange(size))
    edges = pd.DataFrame({"a": x["rep"][a, b], "b": x["rep"][a, label[a, b]], "n": 0})
    counted = np.where(across[g], own[g, i] != own[g, j], True)
    g, i, j = g[counted], i[counted], j[counted]
    tells = np.zeros(len(g), bool)
    for s in range(0, len(g), 1 << 18):
        at = slice(s, s + (1 << 18))
        p, q = x["perm"][g[at], i[at]], x["perm"][g[at], j[at]]
        shared = np.sort(np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, pivots).astype(np.int64), axis=1)
        tells[at] = shared[:, 0] * pivots + shared[:, 1] == key[g[at]]
    counts = pd.DataFrame({"a": x["rep"][g[tells], i[tells]], "n": x["copies"][g[tells], j[tells]]}).groupby("a", as_index=False)["n"].sum()
    counts.insert(1, "b", -1)
    return [edges, counts]


def _lists(batches: Iterator[pd.DataFrame], dtype: str, threshold: float, pivots: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by space, key, i and j; a list may go on in the next batch."""
    columns, rest = ["space", "key", "i", "j"], None

    def done(x: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
        new = np.ones(len(x), bool)
        new[1:] = np.logical_or.reduce([x[c].to_numpy()[1:] != x[c].to_numpy()[:-1] for c in columns])
        first = np.flatnonzero(new)
        size, keep = np.diff(np.append(first, len(x))), None
        if not last:
            keep, first, size = x.iloc[first[-1] :], first[:-1], size[:-1]
        out = []
        many = np.flatnonzero(size > 1)
        take = {c: x[c].to_numpy() for c in ("key", "i", "j", "own", "rep", "copies")}
        raw, perm = x["vec"].to_numpy(), x["perm"].to_numpy()
        for s in np.unique(size[many]).tolist():
            at = first[size == s]
            width = len(np.frombuffer(raw[at[0]], dtype))
            step = max(1, (1 << 20) // (s * max(s, width)))
            for k in range(0, len(at), step):
                # Lists of one space have vectors of one length; those of several spaces are parted by it.
                rows = at[k : k + step, None] + np.arange(s)
                widths = np.array([len(raw[r]) for r in rows[:, 0]])
                for w in np.unique(widths):
                    r = rows[widths == w]
                    vec = np.frombuffer(b"".join(raw[r.ravel()]), dtype).reshape(*r.shape, -1).astype(np.float64)
                    each = {
                        "vec": vec, "norm": np.linalg.norm(vec, axis=2), "rep": take["rep"][r], "copies": take["copies"][r],
                        "perm": np.frombuffer(b"".join(perm[r.ravel()]), "<i2").reshape(*r.shape, -1),
                    }
                    h = r[:, 0]
                    out += _met(s, take["key"][h], take["own"][r], take["i"][h] != take["j"][h], each, threshold, pivots)
        return out, keep

    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if len(x):
            found, rest = done(x, False)
            yield from found
    if rest is not None and len(rest):
        yield from done(rest.reset_index(drop=True), True)[0]


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Link vectors of equal labels by cosine, in double precision.

    vectors: vec_id, label, embedding. Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    that links reach) and kept (vec_id is component_id), one row for each row. A vector that is null, of length zero, or
    has null or non-finite components, or whose label is null, links with nothing; so do vectors of different lengths. Equal
    vectors are one class from the start and count as linked to each other; rows that repeat a vec_id count one by one; an empty
    table gives an empty result. Other columns are not read. Pairs are found with a recall near 1, see DESCRIBED; none
    below the threshold is linked.
    """
    spark = vectors.sparkSession
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if item == "float" else "<f8"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    space = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, space).alias("space"), "embedding",
        F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("k"),
    )
    sound = rows.where(F.col("space").isNotNull())
    name = ["space", "h", "k"]
    classes = sound.groupBy(*name).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = materialize(classes, "vectors")
    sample = classes.orderBy(F.xxhash64(F.lit(2), "h"), "rep").limit(SAMPLE).select("embedding").collect()
    width = max((len(r[0]) for r in sample), default=0)
    points = _padded([np.array(r[0], np.float64) for r in sample], width)
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    points = fitted(points / np.where(norms > 0, norms, 1), threshold)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            raw = [np.asarray(v, dtype) for v in x["embedding"]]
            # Only directions matter here; scaling keeps huge values finite and lets a vector that is cut to zeros pass.
            v = _padded([r / np.abs(r).max() for r in raw], width)
            v[~v.any(axis=1)] = 1
            perm = describe(v, points, DESCRIBED)
            yield pd.DataFrame(
                {
                    "space": x["space"], "rep": x["rep"], "copies": x["copies"], "vec": [r.tobytes() for r in raw],
                    "perm": [p.tobytes() for p in perm.astype("<i2")], "keys": list(list_keys(perm, PIVOTS)),
                }
            )

    indexed = classes.select("space", "rep", "copies", "embedding").mapInPandas(
        index, "space string, rep long, copies long, vec binary, perm binary, keys array<long>"
    )
    indexed = materialize(indexed, "index")
    posted = indexed.withColumn("key", F.explode("keys")).drop("keys")
    large = posted.groupBy("space", "key").count().where(F.col("count") > BLOCK)
    large = materialize(large.select("space", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    spread = (
        posted.join(broadcast_if_small(large), ["space", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("at", F.explode(meets))
        .select("space", "key", "at.i", "at.j", "own", "rep", "copies", "perm", "vec")
    )
    columns = ["space", "key", "i", "j"]
    found = (
        spread.repartition(*columns)
        .sortWithinPartitions(*columns)
        .mapInPandas(lambda it: _lists(it, dtype, threshold, PIVOTS), "a long, b long, n long")
    )
    found = materialize(found, "links")
    counts = materialize(found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")), "counts")
    roots = connected_components(found.where("n = 0"), "a", "b")
    told = (
        classes.select(*name, "rep", "copies")
        .join(counts, F.col("rep") == counts["a"], "left")
        .join(roots, F.col("rep") == roots["node"], "left")
        .select(*name, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    told = materialize(told, "told")
    component = F.when(F.col("space").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        rows.drop("embedding")
        .join(told, name, "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )
