"""Quality rules on a document's repetition, from suffix arrays over its words.

Neighbours in a suffix array share the longest common prefixes, so the larger of a position's two is the length of the
longest repeat that begins there, and the union of these spans is that of all maximal repeated substrings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: A repeat counts from so many words on; the share that repeats may cover, and the words that the longest may have.
LEAST_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 200
#: Words of documents that share one suffix array.
BATCH_WORDS = 300_000


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat within its document that begins there.

    words: ids; doc: ascending number of each word's document.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, "right")
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, have = [rank], 1
    count = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(count[rank] > 1)
    while len(open_):
        after = open_ + have
        inside = after < end[open_]
        key = rank[open_] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        sub, key = open_[order], key[order]
        old = rank[sub]
        index = np.arange(len(sub))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, index, 0))
        part = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, index, 0))
        rank = rank.copy()
        rank[sub] = old + part - group
        levels.append(rank)
        have *= 2
        fresh = np.diff(key, prepend=-1) != 0
        single = fresh & np.append(fresh[1:], True)
        open_ = sub[~single]
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    length = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        alike = (i < end[a]) & (j < end[b])
        alike &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        length += np.where(alike, 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def covered(length: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document that spans of these lengths cover."""
    edge = np.zeros(len(length) + 1, np.int64)
    edge[:-1] = length > 0
    at = np.flatnonzero(length)
    np.subtract.at(edge, at + length[at], 1)
    return np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=docs).astype(np.int64)


def _measure(texts: list[str], words: list[list[bytes]], least_repeat: int) -> pd.DataFrame:
    count = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(count.sum()), object)
    flat[:] = [x for w in words for x in w]
    doc = np.repeat(np.arange(len(texts)), count)
    length = repeat_lengths(pd.factorize(flat)[0].astype(np.int64), doc)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, length)
    lines = [[x for x in t.split("\n") if x.strip(WHITE)] for t in texts]
    return pd.DataFrame(
        {
            "n_words": count,
            "word_chars": [len(t) - sum(map(t.count, WHITE)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": covered(np.where(length >= WINDOW, WINDOW, 0), doc, len(texts)),
            "repeat_covered": covered(np.where(length >= least_repeat, length, 0), doc, len(texts)),
            "longest_repeat": longest,
        }
    )


def quality_rules(
    docs: DataFrame,
    least_repeat: int = LEAST_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Measure and judge every whole text of docs, one row for each row, without a shuffle.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_covered, longest_repeat, base_failed and kept to
    the columns of docs; columns of docs with these names are replaced. A document fails if it has under 50 words, if
    over half of its words are in 3-word windows that it repeats, if repeats of least_repeat words or more cover more than
    max_covered of its words, or if its longest repeat has more than max_longest words. A null text has no words; an
    empty table gives an empty result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (*added, "base_failed", "kept")]

    @F.pandas_udf(", ".join(f"{c} long" for c in added))
    def measure(column: pd.Series) -> pd.DataFrame:
        found, texts, words, load = [], [], [], 0
        for t in column:
            texts.append(t)
            words.append(t.encode("utf-8", "surrogatepass").split())
            load += len(words[-1])
            if load >= BATCH_WORDS:
                found.append(_measure(texts, words, least_repeat))
                texts, words, load = [], [], 0
        found.append(_measure(texts, words, least_repeat))
        return pd.concat(found, ignore_index=True)[added]

    measured = docs.select(*rest, measure(text_or_empty()).alias("_m")).select(*rest, "_m.*")
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
    fine = (F.col("repeat_covered") <= max_covered * words) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
