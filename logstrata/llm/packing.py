"""Packing of token sequences by large-item matching and best fit.

A plan is made from the histogram of lengths alone, which has no more entries than the capacity: pieces above a third of it
are matched at most two to a bin, greedily, and the others best-fit the gaps that remain, longest first. A plan has groups of
equal bins, so its size is bounded by the capacity too, however many documents there are. Pieces then get numbers within
their length, and a number tells a piece's place in the plan.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_within, text_or_empty

EOS = 0
#: Words that a task's tokenizer remembers.
CACHE_WORDS = 400_000
BLOCK_ROWS = 1000


class _Words(dict):
    """Ids of words in two generations; None for a word that cannot be encoded by itself."""

    def __init__(self, encode, special: list[str]):
        super().__init__()
        self.encode, self.special, self.old = encode, special, {}

    def __missing__(self, word: str) -> bytes | None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if word in self.old:
            ids = self.old[word]
        else:
            # White space at a word's end would stand beside the character that parts it from the next one.
            core = word[1:] if word[:1] == "\n" else word
            alone = core and core == core.strip() and not any(x in word for x in self.special)
            ids = self.encode(word if word[:1] == "\n" else " " + word) if alone else None
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of a text as little-endian 32-bit words, remembering the ids of words.

    The byte-level pattern never joins what a single space or line end between two other characters parts, so a text
    without two white-space characters in a row is the chain of its words; any other text is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)
        self.words = _Words(self._encode, self.special) if self.fast and not any(x.split() != [x] for x in self.special) else None

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as ranks, which encodes faster; None if the file is not byte-level BPE in rank order."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout"):
            return None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in visible)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # Merges have to be in the order of the ids they make; then ranks alone give the same ids.
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.words is None:
            return self._encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first != first.strip():
            return self._encode(text)
        try:
            return b"".join([self._encode(first), *map(self.words.__getitem__, rest)])
        except TypeError:  # a word that has no ids by itself
            return self._encode(text)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the one that ends it.

    Only documents longer than capacity are cut; the first piece takes what is over, all others are full.
    """

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def each(texts: pd.Series) -> pd.Series:
        encode = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordTokenizer(tokenizer))
        end = np.array([EOS], "<u4").tobytes()
        out = []
        for text in texts:
            data = memoryview(encode(text) + end)
            n = len(data) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out.append(
                [
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(data[4 * a : 4 * b])}
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                ]
            )
        return pd.Series(out)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(each(text_or_empty())).alias("p"))
    return cut.select("doc_id", "p.*")


@dataclass
class Bins:
    """`count` equal bins: (length, how many) of what each holds, in order."""

    count: int
    holds: list[tuple[int, int]]


def plan_bins(lengths: dict[int, int], capacity: int) -> list[Bins]:
    """Pack counts of lengths into few bins of `capacity`."""
    if any(not 0 < n <= capacity for n in lengths):
        raise ValueError("a length must be from 1 to the capacity")
    left = {n: c for n, c in lengths.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[Bins] = []
    # Greedy matching: the longest piece takes the longest partner that fits beside it.
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            bins.append(Bins(left.pop(a), [(a, 1)]))
            large.pop()
            continue
        b = large[i]
        if a == b:
            both, odd = divmod(left.pop(a), 2)
            large.pop()
            if both:
                bins.append(Bins(both, [(a, 2)]))
            if odd:  # the one that is left takes the next shorter partner, or none
                if large:
                    b = large[-1]
                    bins.append(Bins(1, [(a, 1), (b, 1)]))
                    left[b] -= 1
                    if not left[b]:
                        left.pop(large.pop())
                else:
                    bins.append(Bins(1, [(a, 1)]))
            continue
        n = min(left[a], left[b])
        bins.append(Bins(n, [(a, 1), (b, 1)]))
        for x in (a, b):
            left[x] -= n
            if not left[x]:
                left.pop(x)
                large.remove(x)
    # Best fit of the others, longest first: equal pieces fill the tightest gap one after another.
    gaps: dict[int, list[Bins]] = {}
    for b in bins:
        gaps.setdefault(capacity - sum(n * k for n, k in b.holds), []).append(b)
    order = sorted(gaps)

    def put(gap: int, b: Bins) -> None:
        if gap not in gaps:
            insort(order, gap)
            gaps[gap] = []
        gaps[gap].append(b)

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            i = bisect_left(order, n)
            if i == len(order):
                each = capacity // n
                whole, rest = divmod(count, each)
                if whole:
                    put(capacity - each * n, Bins(whole, [(n, each)]))
                if rest:
                    put(capacity - rest * n, Bins(1, [(n, rest)]))
                break
            gap = order[i]
            b = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            each = gap // n
            take = min(b.count, count // each)
            if take:
                put(gap - each * n, Bins(take, [*b.holds, (n, each)]))
                count -= take * each
            over = b.count - take
            if over and 0 < count < each:
                put(gap - count * n, Bins(1, [*b.holds, (n, count)]))
                over, count = over - 1, 0
            if over:
                put(gap, Bins(over, b.holds))
    return [b for gap in order for b in gaps[gap]]


def _places(plan: list[Bins]) -> dict[str, np.ndarray]:
    """For each group and length: the numbers it takes of that length, and where they go."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for b in plan:
        offset = 0
        for n, each in b.holds:
            rows.append((n, taken.get(n, 0), each, base, offset))
            taken[n] = taken.get(n, 0) + b.count * each
            offset += n * each
        base += b.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), table.T, strict=True))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every row of docs has at least one piece: a null
    or empty text has its end token alone; rows that repeat are packed each; a null doc_id stays null; an empty table
    gives an empty result. Other columns are not read. tokenizer: a byte-level BPE file, readable on all executors.
    """
    rows = materialize(pieces(docs, tokenizer, capacity), "pieces")
    counts = rows.groupBy("length").count().collect()  # at most `capacity` rows
    lengths = {r["length"]: r["count"] for r in counts}
    places = _places(plan_bins(lengths, capacity))
    blocks = max(1, math.ceil(sum(lengths.values()) / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))
    numbered = number_within(rows, "length", block, ["doc_id", "piece", "ids_crc32"], "nth")
    shared = docs.sparkSession.sparkContext.broadcast(places)  # bounded by the capacity, not by the documents

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        p = shared.value
        wide = np.int64(1 << 44)
        n, i = length.to_numpy(), nth.to_numpy()
        at = np.searchsorted(p["length"] * wide + p["first"], n * wide + i, "right") - 1
        bin_, slot = np.divmod(i - p["first"][at], p["each"][at])
        return pd.DataFrame({"sequence_id": p["base"][at] + bin_, "offset": p["offset"][at] + slot * n})

    placed = numbered.withColumn("_place", place("length", "nth"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
