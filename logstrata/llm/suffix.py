"""Exact substring deduplication on Burrows-Wheeler transforms.

A window is a string of `width` bytes of one document. A byte goes if a window that covers it also starts in a
document with a smaller id.

1. Winnowing. Of the grams in a window the one with the least hash, leftmost in a tie, is its anchor. Equal
   windows have equal anchors at equal places, so only windows whose anchors' grams are equal have to be compared.
   The windows of one anchor are neighbours and span at most 2 * width - gram bytes, its context.
2. Chunks of documents send the distinct hashes of their anchors to buckets of hashes, which answer with those that two
   chunks hold. Only contexts of repeated anchors go on, each distinct one once from each chunk with its smallest id.
3. A bucket builds the Burrows-Wheeler transform of the contexts that share an anchor but differ, and derives the
   longest common prefixes of neighbouring suffixes by increasing value: a boundary between suffixes that is found at
   length l gives, by backward extension, the boundaries at length l + 1. It stops at `width`; suffixes with no boundary
   between them begin with equal windows. Contexts that are alone in their group need no transform.
4. Chunks get back the smallest id of each window of their contexts and cut their documents.

What a bucket gets grows with the chunks that hold a passage, not with its occurrences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WIDTH = 50
GRAM = 25
CHUNK_BYTES = 8_000_000
#: Suffixes that one transform takes at most, unless one group of contexts has more.
TRANSFORM = 1 << 20
_SLICE = 1 << 19
_NO_ID = np.iinfo(np.int64).max
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


# Packed arrays: a list of arrays goes over the wire as one compressed value.
def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    # Numbers go byte by byte, so that their high bytes compress; texts go as they are.
    planes = [a.tobytes() if a.dtype.itemsize > 8 else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join([sizes.tobytes(), *planes]), 1)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (count + 1), []
    for n, t in zip(np.frombuffer(raw, np.int64, count, 8).tolist(), types, strict=True):
        item, part = np.dtype(t).itemsize, np.frombuffer(raw, np.uint8, n, at)
        out.append((part if item > 8 else np.ascontiguousarray(part.reshape(item, -1).T).reshape(-1)).view(t))
        at += n
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at each position, by doubling."""
    parts, have, level = _BYTE[data], 1, 0
    whole, done = None, 0
    while True:
        if gram & have:
            if whole is None:
                whole = parts
            else:
                n = len(parts) - done
                whole = whole[:n] * _MUL[level] + parts[done:]
            done += have
        if done == gram:
            return _mix(whole[: len(data) - gram + 1])
        parts = parts[:-have] * _MUL[level] + parts[have:]
        have, level = 2 * have, level + 1


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchored_runs(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: its hash, the first window's start and the last one's.

    ends: where each document ends in data; no window crosses one.
    """
    low = np.uint64(_SLICE * 2 - 1)
    hashes, firsts, lasts = [], [], []
    for a in range(0, len(data) - width + 1, _SLICE):
        piece = data[a : a + _SLICE + width - 1]
        if len(piece) < width:
            break
        h = gram_hashes(piece, gram)
        tagged = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (_window_least(tagged, width - gram + 1) & low).astype(np.int64)
        valid = np.ones(len(at), bool)
        crossed = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(at) + width)] - a
        for end in crossed.tolist():
            valid[max(0, end - width + 1) : end] = False
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        good = valid[first]
        first, last = first[good], last[good]
        # A document's end can lie between two windows only if an invalid one lies there too.
        hashes.append(h[at[first]])
        firsts.append(first + a)
        lasts.append(last + a)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def row_width(width: int, gram: int) -> int:
    """Bytes for a context and its size, a multiple of 8."""
    return (2 * width - gram + 8) // 8 * 8


def distinct_rows(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct (key, row), by key, and which of them each row is. rows: bytes, a multiple of 8 wide."""
    words = rows.view(np.uint64).reshape(len(rows), rows.shape[1] // 8)
    h = key.copy()
    for j in range(words.shape[1]):
        h = h * _MUL[0] + words[:, j]
    h = _mix(h)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    again = np.flatnonzero(~new)
    a, b = order[again], order[again - 1]
    if len(again) and not ((words[a] == words[b]).all() and (key[a] == key[b]).all()):  # two rows share a hash
        whole = np.ascontiguousarray(np.concatenate([key.astype(">u8")[:, None].view(np.uint8), rows], axis=1))
        void = whole.view(np.dtype((np.void, whole.shape[1]))).reshape(-1)
        _, where, which = np.unique(void, return_index=True, return_inverse=True)
        return where, which
    where = order[new]
    by_key = np.argsort(key[where], kind="stable")
    place = np.empty(len(where), np.int64)
    place[by_key] = np.arange(len(where))
    which = np.empty(len(h), np.int64)
    which[order] = place[np.cumsum(new) - 1]
    return where[by_key], which


class Chunk:
    """Documents of one chunk in one buffer, ordered by id and text."""

    def __init__(self, blobs: list[bytes], width: int, gram: int):
        docs: list[tuple[int, bytes]] = []
        for blob in blobs:
            ids, sizes, data = unpack(blob, np.int64, np.int64, np.uint8)
            raw, at = data.tobytes(), 0
            for i, n in zip(ids.tolist(), sizes.tolist(), strict=True):
                docs.append((i, raw[at : at + n]))
                at += n
        docs.sort()
        self.width, self.wide = width, row_width(width, gram)
        self.ids = np.array([i for i, _ in docs], np.int64)
        self.data = np.frombuffer(b"".join(d for _, d in docs), np.uint8)
        self.ends = np.cumsum([len(d) for _, d in docs], dtype=np.int64)
        self.hash, self.first, self.last = (
            anchored_runs(self.data, self.ends, width, gram) if len(docs) else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        )

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """The runs whose anchors another chunk or two documents of this one hold."""
        order = np.argsort(self.hash)
        h = self.hash[order]
        d = self.doc(self.first)[order]
        known = np.sort(np.concatenate([elsewhere, h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])]]))
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.searchsorted(h, known), 1)
        np.add.at(edge, np.searchsorted(h, known, "right"), -1)
        return np.sort(order[np.cumsum(edge)[:-1] > 0])

    def contexts(self, elsewhere: np.ndarray) -> None:
        """Distinct contexts of the runs whose anchors are repeated: hash, text, smallest id, and the runs of each."""
        self.run = self.repeated(elsewhere)
        first, size = self.first[self.run], self.last[self.run] - self.first[self.run] + self.width
        # A row is a context, padded, with its size as the last byte.
        wide = self.wide
        column = np.arange(wide - 1)
        padded = np.concatenate([self.data, np.zeros(wide, np.uint8)])
        rows = np.zeros((len(first), wide), np.uint8)
        rows[:, :-1] = padded[first[:, None] + column]
        rows[:, :-1] *= column < size[:, None]
        rows[:, -1] = size
        where, self.context = distinct_rows(rows, self.hash[self.run])
        self.rows, self.size, self.key = rows[where], size[where], self.hash[self.run][where]
        ids = self.ids[self.doc(first)]
        self.least = np.full(len(where), _NO_ID)
        np.minimum.at(self.least, self.context, ids)
        self.times = np.bincount(self.context, minlength=len(where))

    def covered(self, context: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Mask of the bytes to remove, from answers: windows a to b of a context also start in a document `least`."""
        order = np.argsort(self.context)
        begin = np.searchsorted(self.context[order], context)
        many = self.times[context]
        answer = np.repeat(np.arange(len(context)), many)
        inner = np.arange(len(answer)) - np.repeat(np.cumsum(many) - many, many)
        start = self.first[self.run[order[begin[answer] + inner]]]
        hit = least[answer] < self.ids[self.doc(start)]
        start, answer = start[hit], answer[hit]
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, start + a[answer], 1)
        np.add.at(edge, start + b[answer] + self.width, -1)
        return np.cumsum(edge)[:-1] > 0

    def digest(self, removed: np.ndarray) -> pd.DataFrame:
        out, begin, raw = [], 0, self.data.tobytes()
        for i, end in zip(self.ids.tolist(), self.ends.tolist(), strict=True):
            gone = removed[begin:end]
            n = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
            kept = raw[begin:end] if not n else self.data[begin:end][~gone].tobytes()
            out.append((None if i == _NO_ID else i, end - begin, n, spans, kept, hashlib.sha256(kept).hexdigest()))
            begin = end
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of text (symbols under 512), whose zeros end its strings; of equal strings the earlier comes first."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    longest = int(room.max(initial=0))
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.where(room > i, padded[i : n + i], 0)
    have = 7
    while True:
        order = np.argsort(key, kind="stable")
        if have > longest:
            return order
        new = np.zeros(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        after = np.where(room > have, rank[np.minimum(np.arange(n) + have, n - 1)] + 1, 0)
        key = rank * (n + 1) + after
        have *= 2


def equal_prefix_groups(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, the group of each suffix in its order, and common prefixes with the one before (width: or longer).

    Two neighbours are in one group if their first `width` symbols are equal. text is as in suffix_order.
    """
    order = suffix_order(text)
    n, strings = len(text), int((text == 0).sum())
    before = text[order - 1]  # the transform; what stands before a string's start is the end of another one
    before[order == 0] = 0
    # Where a suffix stands when its transform's symbol is put before it: ends first, then by symbol and old order.
    source = np.argsort(before, kind="stable")[strings:]
    fresh = np.diff(before[source], prepend=0) != 0
    boundary = np.zeros(n, bool)
    boundary[:1] = True
    common = np.full(n, width, np.uint16)
    common[:1] = 0
    for length in range(width):
        group = np.cumsum(boundary, dtype=np.int32)[source]
        new = np.ones(n, bool)
        new[strings + 1 :] = fresh[1:] | (group[1:] != group[:-1])
        found = new & ~boundary
        if not found.any():
            break
        common[found] = length
        boundary = new
    return order, np.cumsum(boundary) - 1, common


def window_ids(texts: list[np.ndarray], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of some texts, the smallest of `least` over the texts that hold it."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
    for t, s in zip(texts, starts.tolist(), strict=True):
        text[s : s + len(t)] = t
        text[s : s + len(t)] += 1
    order, group, _ = equal_prefix_groups(text, width)
    owner = np.searchsorted(starts, order, "right") - 1
    smallest = np.minimum.reduceat(least[owner], np.flatnonzero(np.diff(group, prepend=-1)))
    out = np.empty(len(text), np.int64)
    out[order] = smallest[group]
    return [out[s : s + n - width + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(hashes) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, chunk: int, buckets: int, rows: list[np.ndarray]) -> pd.DataFrame:
    """One packed value for each bucket, of arrays whose rows belong to buckets."""
    bucket = bucket.astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    data = [pack(*(r[order[cut[b] : cut[b + 1]]] for r in rows)) for b in some]
    return pd.DataFrame({"bucket": some, "chunk": chunk, "data": data})


_DEALT = "bucket long, chunk long, data binary"


def _packed_documents(docs: DataFrame, chunks: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids = x["doc_id"].to_numpy(dtype=np.int64)
            data = [t.encode("utf-8", "surrogatepass") for t in x["_text"]]
            size, chunk = np.array([len(d) for d in data], np.int64), x["chunk"].to_numpy()
            for c in np.unique(chunk):
                at = np.flatnonzero(chunk == c)
                text = np.frombuffer(b"".join(data[i] for i in at), np.uint8)
                yield pd.DataFrame({"chunk": [c], "kind": [0], "data": [pack(ids[at], size[at], text)]})

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID)))
    rows = docs.select(ids.alias("doc_id"), text_or_empty().alias("_text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(chunks)).cast("long"))
    return rows.mapInPandas(each, "chunk long, kind int, data binary")


def repeated_anchors(texts: DataFrame, chunks: int, width: int, gram: int) -> DataFrame:
    """(chunk, kind 1, data): hashes of the chunk's anchors that other chunks hold too."""

    def send(x: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(list(x["data"]), width, gram)
        h = np.sort(c.hash)
        h = h[np.diff(h, prepend=~h[:1]) != 0]
        return _dealt(_bucket(h, chunks), x["chunk"].iat[0], chunks, [h])

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d, np.uint64)[0] for d in x["data"]]
        every = np.sort(np.concatenate(parts))
        shared = every[1:][every[1:] == every[:-1]]
        # Each part is ascending, so that it is looked up at its own length's cost.
        data = [pack(p[np.searchsorted(shared, p, "right") > np.searchsorted(shared, p)]) for p in parts]
        return pd.DataFrame({"chunk": x["chunk"].to_numpy(), "kind": 1, "data": data})

    sent = texts.groupBy("chunk").applyInPandas(send, _DEALT)
    return sent.groupBy("bucket").applyInPandas(meet, "chunk long, kind int, data binary")


def _with_contexts(x: pd.DataFrame, replies: pd.DataFrame, width: int, gram: int) -> Chunk:
    c = Chunk(list(x["data"]), width, gram)
    known = [unpack(d, np.uint64)[0] for d in replies.loc[replies["kind"] == 1, "data"]]
    c.contexts(np.concatenate([np.empty(0, np.uint64), *known]))
    return c


def window_answers(texts: DataFrame, anchors: DataFrame, chunks: int, width: int, gram: int) -> DataFrame:
    """(chunk, kind 2, data): for runs of windows of the chunk's contexts, the smallest id over all documents."""

    def send(x: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        c = _with_contexts(x, replies, width, gram)
        n = len(c.key)
        void = c.rows.reshape(-1).view(np.dtype((np.void, c.wide)))
        return _dealt(
            _bucket(c.key, chunks), x["chunk"].iat[0], chunks,
            [c.key, np.arange(n), c.size, c.least, c.times, void],
        )

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        wide = row_width(width, gram)
        parts = [unpack(d, np.uint64, np.int64, np.int64, np.int64, np.int64, np.dtype((np.void, wide))) for d in x["data"]]
        chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        key, index, size, least, times = (np.concatenate([p[i] for p in parts]) for i in range(5))
        rows = np.concatenate([p[5].view(np.uint8) for p in parts]).reshape(len(key), wide)
        where, same = distinct_rows(rows, key)
        smallest = np.full(len(where), _NO_ID)
        np.minimum.at(smallest, same, least)
        # Distinct contexts stand by key, so those of one anchor are neighbours.
        keys, sizes = key[where], size[where]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        many = np.diff(np.append(begin, len(keys)))
        alone = begin[many == 1]
        found = [(alone, np.zeros(len(alone), np.int64), sizes[alone] - width, smallest[alone])]
        batch: list[int] = []
        load = 0
        for b, m in zip(begin[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            batch += range(b, b + m)
            load += int(sizes[b : b + m].sum()) + m
            if load >= TRANSFORM:
                found.append(_runs(batch, rows[where], sizes, smallest, width))
                batch, load = [], 0
        if batch:
            found.append(_runs(batch, rows[where], sizes, smallest, width))
        g, a, b, low = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(g, kind="stable")
        g, a, b, low = g[order], a[order], b[order], low[order]
        start, stop = np.searchsorted(g, same), np.searchsorted(g, same, "right")
        row = np.repeat(np.arange(len(same)), stop - start)
        at = np.repeat(start, stop - start) + np.arange(len(row)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
        tells = (times[row] > 1) | (low[at] < least[row])
        row, at = row[tells], at[tells]
        cut = np.searchsorted(chunk[row], np.arange(len(parts) + 1))
        data = [
            pack(index[row[i:j]], a[at[i:j]].astype(np.uint8), b[at[i:j]].astype(np.uint8), low[at[i:j]])
            for i, j in zip(cut[:-1], cut[1:], strict=True)
        ]
        return pd.DataFrame({"chunk": x["chunk"].to_numpy(), "kind": 2, "data": data})

    sent = texts.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInPandas(send, _DEALT)
    return sent.groupBy("bucket").applyInPandas(meet, "chunk long, kind int, data binary")


def _runs(batch: list[int], rows: np.ndarray, sizes: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    ids = window_ids([rows[i, : sizes[i]] for i in batch], least[batch], width)
    count = np.array([len(x) for x in ids])
    flat, owner = np.concatenate(ids), np.repeat(np.array(batch), count)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero((np.diff(flat, prepend=0) != 0) | (place == 0))
    last = np.append(first[1:], len(flat)) - 1
    return owner[first], place[first], place[last], flat[first]


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Remove every byte that a `width`-byte string covers which also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary: a cut may part a character).
    Texts are whole, as UTF-8; a null text is empty; texts under width bytes stay as they are; strings are judged on the
    input. A null doc_id counts as larger than any other; rows that repeat a doc_id do not cut each other; an empty table gives
    an empty result. Other columns are not read.
    """
    if not width // 2 <= gram < width <= 120:
        raise ValueError("gram must be between half of width and width, width at most 120")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    texts = _packed_documents(docs, chunks)
    anchors = materialize(repeated_anchors(texts, chunks, width, gram), "anchors")
    answers = materialize(window_answers(texts, anchors, chunks, width, gram), "answers")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def cut(x: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({c: [] for c in columns})
        c = _with_contexts(x, replies, width, gram)
        got = [unpack(d, np.int64, np.uint8, np.uint8, np.int64) for d in replies.loc[replies["kind"] == 2, "data"]]
        context, a, b, least = (
            np.concatenate([np.empty(0, np.int64), *(g[i] for g in got)]).astype(np.int64) for i in range(4)
        )
        return c.digest(c.covered(context, a, b, least))[columns]

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("chunk").cogroup(anchors.unionByName(answers).groupBy("chunk")).applyInPandas(cut, schema)
