"""Evaluation texts leaking into a corpus: q-gram lemma filtering with banded verification.

Every corpus text is normalised to words joined by single spaces. Its character q-grams are looked up among the q-grams
of the evaluation items; hits are counted in overlapping bands of diagonals (position in text minus position in item). A
passage of L characters with at most k edits shares at least L - q + 1 - k*q of its q-grams with the item inside one band,
so bands below that count cannot hold one. The rest is verified by a banded alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 16
#: Normalised characters of items held by one task and by the driver at a time; more items are searched block by block.
BLOCK_CHARS = 8_000_000
_SLICE_CHARS = 4_000_000
_ALIGNED = 4_000_000  # item characters of regions aligned at a time, padded to the longest
_HITS = 4_000_000  # shared q-grams expanded at a time
_TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
FOUND = "doc_id long, item_id long, doc_start int, doc_end int, n_words int, n_edits int"


def words_joined(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with one space before, between and behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram (q a power of two) at every position, by doubling."""
    h, power, width = codes.astype(np.uint64) + np.uint64(1), _BASE, 1
    while width < q:
        h = h[:-width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
        power, width = power * power % 2**64, width * 2
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shortest_passage(codes: np.ndarray, min_words: int) -> int:
    """Characters of the shortest passage of ``min_words`` words, with the spaces around it; 0 where the item has fewer words."""
    gaps = np.flatnonzero(codes == 32)
    return int((gaps[min_words:] - gaps[:-min_words]).min()) + 1 if len(gaps) > min_words else 0


def least_count(shortest: int, q: int, edits: int) -> int:
    """The lemma: q-grams that any passage of so many characters must share at least, an edit away from the item included."""
    return shortest - edits - q + 1 - edits * q


def gram_length(shortest: int, edits: int) -> int:
    """The longest q-gram, a power of two up to ``Q``, for which the lemma asks for one shared q-gram at least."""
    q = Q
    while q > 1 and least_count(shortest, q, edits) < 1:
        q //= 2
    return q


class ItemIndex:
    """Sorted q-grams of a bounded block of items, with a bit table in front. Items of one text are one entry."""

    def __init__(self, items: list[tuple[int, str]], q: int, min_words: int, edits: int):
        self.q = q
        texts: dict[str, list[int]] = {}
        for item_id, text in items:
            texts.setdefault(text, []).append(item_id)
        self.ids = list(texts.values())
        self.codes = [_codes(t) for t in texts]
        grams = [rolling(c, q) for c in self.codes]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.least = np.array([least_count(shortest_passage(c, min_words), q, edits) for c in self.codes])
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in text, item, position in item) of every shared q-gram, a bounded number at a time."""
        h = rolling(codes, self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total, first = np.cumsum(n), 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _HITS, "right")))
            m, l = n[first:last], lo[first:last]
            entry = np.repeat(l - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(at[first:last], m), self.item[entry], self.place[entry]
            first = last


def indexes(items: list[tuple[int, str]], min_words: int, edits: int) -> list[ItemIndex]:
    """One index for each q-gram length that the items' shortest passages call for; items with fewer words are in none."""
    by_length: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        shortest = shortest_passage(_codes(item[1]), min_words)
        if shortest:
            by_length.setdefault(gram_length(shortest, edits), []).append(item)
    return [ItemIndex(part, q, min_words, edits) for q, part in sorted(by_length.items())]


def banded_stretches(codes: np.ndarray, regions: list[tuple[int, int, np.ndarray, int]], edits: int) -> list[tuple[int, int, int, int]]:
    """Per region (text start, text end, item, lowest diagonal) the stretch with most words of the item and at most ``edits`` edits.

    One alignment over all regions at a time. state[r, e, d] is the least item position at which a stretch starts that
    ends here, on diagonal d, with at most e edits.
    """
    count, width, none = len(regions), 2 * edits + 2, 1 << 30
    longest = max(len(item) for _, _, item, _ in regions)
    items = np.zeros((count, longest), np.uint32)
    texts = np.zeros((count, longest + width), np.uint32)
    for r, (start, end, item, low) in enumerate(regions):
        items[r, : len(item)] = item
        a, b = max(start, start + low), min(end, start + low + longest + width)
        if b > a:
            texts[r, a - start - low : b - start - low] = codes[a:b]
    gaps = np.concatenate([np.zeros((count, 1), np.int64), np.cumsum(items == 32, axis=1)], axis=1)
    state = np.full((count, edits + 1, width), none, np.int64)
    best = np.zeros((count, 4), np.int64)
    each = np.arange(count)
    for i in range(longest):
        here, there = items[:, i, None], texts[:, i : i + width]
        same = (here == there) & (there != 0)
        old, state = state, np.full_like(state, none)
        for e in range(edits + 1):
            now = np.where(same, old[:, e], none)
            if e == 0:
                now = np.where(same & (here == 32) & (now == none), i, now)
            else:
                now = np.minimum(now, old[:, e - 1])  # another character
                now[:, :-1] = np.minimum(now[:, :-1], old[:, e - 1, 1:])  # a character of the item is missing
                now[:, 1:] = np.minimum(now[:, 1:], state[:, e - 1, :-1])  # the text has one more
                now = np.minimum(now, state[:, e - 1])
            state[:, e] = now
        ends = np.where(same & (here == 32), state[:, edits], none)
        d = ends.argmin(axis=1)
        start = ends[each, d]
        words = np.where(start < i, gaps[:, i + 1] - gaps[each, np.minimum(start, longest)] - 1, 0)
        better = words > best[:, 0]
        if better.any():
            least = (state[each, :, d] == start[:, None]).argmax(axis=1)
            best[better] = np.stack([words, least, start + d, np.full(count, i + 1) + d], axis=1)[better]
    return [(int(n), int(e), int(s) + low, int(t) + low) for (n, e, s, t), (_, _, _, low) in zip(best, regions)]


def _distinct(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes, sums of their counts); codes are numbers, or rows of numbers."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable") if codes.ndim == 1 else np.lexsort(codes.T[::-1])
    codes = codes[order]
    changed = codes[1:] != codes[:-1]
    first = np.flatnonzero(np.r_[True, changed if codes.ndim == 1 else changed.any(axis=1)])
    return codes[first], np.add.reduceat(counts[order], first)


def bands(groups: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(row, item, band) of the bands with enough hits, from sorted distinct (row, item, half) and their hits.

    A half holds ``edits + 1`` neighbouring diagonals and a band two neighbouring halves, so bands overlap and any
    ``edits + 1`` neighbouring diagonals lie in one band.
    """
    if not len(groups):
        return groups
    after = np.zeros(len(groups), bool)  # whether the next half follows at once, in the same row and item
    after[:-1] = (groups[1:, :2] == groups[:-1, :2]).all(axis=1) & (groups[1:, 2] == groups[:-1, 2] + 1)
    own = counts + np.where(after, np.r_[counts[1:], 0], 0)
    alone = ~np.r_[False, after[:-1]]  # no hits in the half before: that band has this half's hits only
    need = least[groups[:, 1]]
    return np.concatenate([groups[own >= need], groups[alone & (counts >= need)] - np.array([0, 0, 1])])


def _search(index: ItemIndex, texts: list[str], min_words: int, edits: int) -> Iterator[tuple]:
    """(row, item id, start, end, words, edits) of every match in the texts."""
    codes = _codes("".join(texts))
    starts = np.cumsum([0, *map(len, texts)])
    n_items, low = len(index.ids), max(map(len, index.codes), default=0) // (edits + 1) + 1
    n_halves = low + int(starts[-1]) // (edits + 1) + 1
    single = len(texts) * n_items * n_halves < 2**63  # (row, item, half) as one number, which sorts faster
    seen, counts = np.zeros(0 if single else (0, 3), np.int64), np.zeros(0, np.int64)
    for at, item, place in index.hits(codes):
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + index.q <= starts[row + 1]
        at, item, place, row = at[inside], item[inside], place[inside], row[inside]
        half = (at - place - starts[row]) // (edits + 1) + low
        new = (row * n_items + item) * n_halves + half if single else np.stack([row, item, half], axis=1)
        more = _distinct(new, np.ones(len(new), np.int64))
        seen, counts = more if not len(seen) else _distinct(np.concatenate([seen, more[0]]), np.concatenate([counts, more[1]]))
    if single:
        group, half = np.divmod(seen, n_halves)
        seen = np.stack([*np.divmod(group, n_items), half], axis=1)
    groups = bands(seen - np.array([0, 0, low]), counts, index.least)
    kept = sorted(groups.tolist(), key=lambda x: -len(index.codes[x[1]]))
    found: dict[tuple[int, int], tuple] = {}
    first = 0
    while first < len(kept):  # the longest come first, so regions aligned together are of like length
        part = kept[first : first + max(1, _ALIGNED // len(index.codes[kept[first][1]]))]
        regions = [(int(starts[r]), int(starts[r + 1]), index.codes[i], b * (edits + 1)) for r, i, b in part]
        for (r, i, _), got in zip(part, banded_stretches(codes, regions, edits)):
            if got[0] >= min_words and (got[0], -got[1]) > found.get((r, i), ((0, 0),))[0]:
                found[r, i] = ((got[0], -got[1]), got)
        first += len(part)
    for (r, i), (_, (n, e, s, t)) in found.items():
        for item_id in index.ids[i]:
            yield r, item_id, s, t, n, e


def leaks(documents: DataFrame, items: DataFrame, stage: Callable[[DataFrame, str], DataFrame], min_words: int = 12, edits: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that share a passage of at least ``min_words`` consecutive words with an item.

    documents: doc_id, text. items: item_id, text. ``edits`` is the budget of character edits by which the passage may
    differ; 0 runs through the same bands and alignment as any other. Items whose passages are too short for the lemma at
    16 characters are searched by shorter q-grams, so the result is exact for every budget below half a passage. Result: one
    row per (document row, item) with the longest passage: place in the normalised text, words of the item in it, edits.

    Map-only over the corpus, so hot sources and repeated texts cost nothing extra; each repeated row counts. NULL ids, NULL
    and empty texts match nothing; texts of any length are searched whole. Items are shipped in blocks of at most
    ``block_chars`` characters on average (their sum is measured first). Each block is one pass over the corpus, written by
    ``stage`` before the next block is gathered, so that neither driver nor tasks ever hold more than one.
    """
    if min_words < 1 or edits < 0 or least_count(2 * min_words + 1, 1, edits) < 1:
        raise ValueError(f"{edits} edits may hide every character of a passage of {min_words} words")
    normal_items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), words_joined(F.col("text")).alias("t")
    )
    total = normal_items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    corpus = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words_joined(F.col("text")).alias("t"))

    def one_block(b: int) -> DataFrame:
        mine = normal_items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else normal_items
        shipped = documents.sparkSession.sparkContext.broadcast([(r.item_id, r.t) for r in mine.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            built = indexes(shipped.value, min_words, edits)
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["t"].tolist()
                size = np.cumsum([len(t) for t in texts])
                rows, first = [], 0
                while first < len(texts):
                    done = size[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(size, done + _SLICE_CHARS)))
                    for index in built:
                        rows += [(ids[first + r], item, *rest) for r, item, *rest in _search(index, texts[first:last], min_words, edits)]
                    first = last
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_start", "doc_end", "n_words", "n_edits"])

        found = corpus.mapInPandas(search, FOUND)
        if blocks > 1:
            found = stage(found, f"leaks-{b}")
            shipped.destroy()
        return found

    return reduce(DataFrame.unionByName, map(one_block, range(blocks)))
