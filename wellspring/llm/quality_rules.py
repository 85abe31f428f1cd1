"""Quality rules: base counts, and repetition measured with a suffix array over the words of each text.

The suffixes of many texts are sorted together: words get numbers that no two texts share, so equal prefixes lie in one
text. Prefix doubling sorts only the suffixes that are still tied; the ranks of each doubling give the longest common
prefixes of neighbours (LCP). The longest repeat that starts at a word is the larger LCP with its two neighbours, which
is the LCP interval of a maximal repeated substring; the union of these spans is the repeated part of a text.

A text is kept if it passes the base rules, its repeats of `min_words` words or more cover at most `max_fraction` of its
words, and its longest repeat is at most `max_longest` words or `max_longest_fraction` of its words, whichever is more.

Defined cases: null counts as no words, which fails the base rule on words; long texts are measured whole; rows that
share an id are measured one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def suffix_order(ids: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ids, and the ranks after each doubling. stop: where the text of each word ends."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, h = [rank], 1
    tied = ~(first & np.r_[first[1:], True])
    while tied.any():
        at = np.flatnonzero(tied)
        who = order[at]
        ahead = who + h
        follow = np.where(ahead < stop[who], rank[np.minimum(ahead, n - 1)], -1)
        group = rank[who]
        inner = np.lexsort((follow, group))
        who, follow, group = who[inner], follow[inner], group[inner]
        order[at] = who
        new = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
        tied[at] = ~(new & np.r_[new[1:], True])
        h *= 2
    return order, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP in words of each suffix in order with the next one."""
    n = len(order)
    lcp = np.zeros(max(0, n - 1), dtype=np.int64)
    live = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b, got = order[live].copy(), order[live + 1].copy(), np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a, b, got = a + step, b + step, got + step
    lcp[live] = got
    return lcp


def longest_repeats(ids: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs elsewhere in its text."""
    if len(ids) < 2:
        return np.zeros(len(ids), dtype=np.int64)
    order, levels = suffix_order(ids, stop)
    lcp = neighbour_lcp(order, levels)
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return out


def measure(texts: list[str], min_words: int = 5) -> list[tuple[int, int, int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeated words, longest repeat of each text."""
    number, parts, sizes = count(), [], []
    for t in texts:
        ids: dict[bytes, int] = defaultdict(number.__next__)
        words = t.encode("utf-8", "surrogatepass").split()
        parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        sizes.append(len(words))
    ids, doc = np.concatenate([np.zeros(0, dtype=np.int64), *parts]), np.repeat(np.arange(len(texts)), sizes)
    n, v = len(ids), next(number) + 1
    ends = np.cumsum(sizes)
    triple = np.zeros(n + 1, dtype=np.int64)
    if n > 2:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, back, times = np.unique(key[inside], return_inverse=True, return_counts=True)
        at = inside[times[back] > 1]
        np.add.at(triple, at, 1)
        np.add.at(triple, at + 3, -1)
    in_triple = np.cumsum(triple[:n]) > 0
    longest = longest_repeats(ids, ends[doc] if n else ids)
    at = np.flatnonzero(longest >= min_words)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[at] += 1
    np.add.at(edge, at + longest[at], -1)
    covered = np.cumsum(edge[:n]) > 0
    in_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64).tolist()
    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, doc, longest)
    lines = []
    for t in texts:
        seen: set[str] = set()
        again = 0
        for x in t.split("\n"):
            if x in seen:
                again += 1
            elif x.strip(BLANKS):
                seen.add(x)
        lines.append(again)
    chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    return list(zip(sizes, chars, symbols, lines, in_doc(in_triple), in_doc(covered), top.tolist()))


def blocks(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about so many characters: what one sort holds."""
    out, size = [], 0
    for t in texts:
        if out and (size + len(t) > chars):
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def repetition(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with all counts."""

    def rows(batch):
        texts = [t or "" for _, t in batch]
        got = [m for b in blocks(texts) for m in measure(b, min_words)]
        return [(i, *m) for (i, _), m in zip(batch, got)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(id_col, text_col),
        rows,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long",
    )


def judged(
    counts: DataFrame, max_fraction: float = 0.35, max_longest: int = 60, max_longest_fraction: float = 0.1
) -> DataFrame:
    """The limit on the longest repeat decides by itself: given twice it covers twice its fraction, which is well below max_fraction."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats = (F.col("n_covered_words") > max_fraction * F.col("n_words")) | (
        F.col("longest_repeat") > F.greatest(F.lit(float(max_longest)), max_longest_fraction * F.col("n_words"))
    )
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(repetition(documents(spark, sf_dir)))
