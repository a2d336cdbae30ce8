"""Benchmark decontamination: windows of an item's size whose weighted shingles are the item's to 0.8 or more.

Every window of an item's size gets a SimHash fingerprint of its words and word pairs, by running sums. The items' fingerprints are in a
multi-index: 64 bits in five blocks, each block's table holding every value within three bits of an item's, so that every fingerprint
within 19 bits is met in one of them. Windows that meet an item there within that radius are verified: similarity is the weighted Jaccard
of two word runs, in which five-word shingles count as often as they occur (a run of fewer words is one shingle).

A window is passed over without a fingerprint only where it can't be similar to any item of its size: each word that no such item has
leaves at least one more of the window's shingles without a partner.

A fingerprint of few different words tells little: rotated refrains of two to four words have fingerprints far apart. Items of fewer than
ten different words are therefore met by all windows that can be similar to them, whatever their fingerprints. Of others the radius leaves
out few of the windows just above the limit: none of the thousands in the tests.
"""

from __future__ import annotations

import itertools
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, read

SHINGLE, SIMILAR, BLOCKS, FLIPS, FEW = 5, 0.8, (13, 13, 13, 13, 12), 3, 10
#: Bits within which the multi-index meets every fingerprint: any more in all blocks would be one more than flips in each.
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Characters of items that one pass over the documents uses, in some 20 MB of index; a larger benchmark takes several passes.
CHARS_AT_ONCE = 4_000_000
_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COLUMNS = "item_id bigint, first_word int, n_words int, similarity double, distance int"


def split_words(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in lower case."""
    text = (text or "").lower()
    for mark in "\n\t\r\x0b\x0c":
        text = text.replace(mark, " ")
    return [w for w in text.split(" ") if w]


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def window_prints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` words from each start: bits set in over half of the words and word pairs."""
    def sums(h: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])

    one, two = sums(hashes), sums((hashes[:-1] * _MIX + hashes[1:]) * _PAIR)
    ones = one[starts + n] - one[starts] + two[starts + n - 1] - two[starts]
    return np.packbits(2 * ones > 2 * n - 1, axis=1, bitorder="little").view("<u8").ravel()


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    at, out = 0, []
    for width in BLOCKS:
        out.append(((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


@cache
def spare_words(n: int, size: int) -> int:
    """How many words of a window of ``n`` words may be in no item of ``size`` words, if it is to be similar to one; below 0: it can't be."""
    width = min(SHINGLE, size)
    own, all_ = n - width + 1, n + size - 2 * width + 2
    return -1 if own < 1 else int(np.floor(own - SIMILAR / (1 + SIMILAR) * all_ + 1e-6))


class Index:
    """Items by fingerprint among those of one size."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := split_words(t))]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.hashes = np.concatenate(([np.uint64(0)], word_hashes(list(self.vocabulary))))
        self.shingles, self.grams, self.sizes = [], [], [len(w) for _, w in self.items]
        self.prints, self.own = np.zeros(len(self.items), np.uint64), []
        strong: dict[int, list[int]] = defaultdict(list)
        self.weak: list[int] = []
        for k, (_, words) in enumerate(self.items):
            ids = np.array([self.vocabulary[w] for w in words], np.uint64)
            self.shingles.append(Counter(rolled(ids, min(SHINGLE, len(words))).tolist()))
            self.grams.append(np.array(sorted(self.shingles[k]), np.uint64))
            self.prints[k] = window_prints(word_hashes(words), np.array([0]), len(words))[0]
            self.own.append(np.unique(ids))
            if len(self.own[k]) < FEW:
                self.weak.append(k)
            else:
                strong[len(words)].append(k)
        #: Items with enough different words, by size, smallest first.
        self.strong = {n: np.array(ks) for n, ks in sorted(strong.items())}
        #: For each size whether its items have a word, by the word's number.
        self.known = {n: np.isin(np.arange(len(self.hashes)), np.concatenate([self.own[k] for k in ks])) for n, ks in self.strong.items()}
        #: Of a large window that can be similar, one of its parts as small as the smallest item has no more foreign words than this.
        self.most_foreign = max((spare_words(n, n) // (n // min(self.strong)) for n in self.strong), default=-1)

    @cached_property
    def tables(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """By size of item and block: values, sorted, and the items whose fingerprint has them or one within three bits of them."""
        flips = [np.array([sum(1 << f for f in fs) for n in range(FLIPS + 1) for fs in itertools.combinations(range(bits), n)], np.int64) for bits in BLOCKS]
        out: dict[int, list] = {}
        for size, items in self.strong.items():
            out[size] = []
            for values, masks in zip(block_values(self.prints[items]), flips):
                each = (values[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(each, kind="stable")
                out[size].append((each[order], np.repeat(items, len(masks))[order]))
        return out

    def met(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of fingerprints and items of a size that the multi-index leads to within ``RADIUS`` bits: all there are."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for values, (known, held) in zip(block_values(prints), self.tables[size]):
            low, high = np.searchsorted(known, values), np.searchsorted(known, values, "right")
            n = high - low
            places.append(np.repeat(np.arange(len(prints)), n))
            items.append(held[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        at, item = np.concatenate(places), np.concatenate(items)
        near = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
        both = np.unique(at[near] * len(self.items) + item[near])
        return both // len(self.items), both % len(self.items)

    def search(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """``item_id, first word, words, similarity, distance`` of the best window for each item that the text holds."""
        words = split_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.uint64, len(words))
        if not ids.any():
            return []
        prints = Prints(ids, words, self.hashes)
        found: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)

        def verify(k: int, starts: np.ndarray, n: int, own: np.ndarray) -> None:
            """Windows with enough shingles that the item has, by running sums, are compared in full."""
            grams, low = rolled(ids[starts[0]:starts[-1] + n], min(SHINGLE, self.sizes[k])), int(starts[0])
            sums = np.concatenate(([0], np.cumsum(np.isin(grams, self.grams[k]))))
            places = n - min(SHINGLE, self.sizes[k]) + 1
            shared = sums[starts - low + places] - sums[starts - low]
            likely = np.flatnonzero(shared >= SIMILAR * (places + self.shingles[k].total() - shared) - 1e-6)
            for a, p in zip(starts[likely].tolist(), own[likely]):
                near = self.similarity(k, ids[a:a + n])
                if near >= SIMILAR:
                    found[k].append((-near, int(np.bitwise_count(p ^ self.prints[k])), a, n))

        foreign = np.concatenate(([0], np.cumsum(ids == 0, dtype=np.int32)))
        for low, high in self._parts(foreign):
            for size in self.strong:
                n, inner = min(size, len(ids)), foreign[low:high + 1]
                spare, there = spare_words(n, size), inner[n:] - inner[:-n]
                if there.min() > spare:
                    continue
                starts = np.flatnonzero(there <= spare)
                other = np.concatenate(([0], np.cumsum(~self.known[size][ids[low:high]])))
                starts = low + starts[other[starts + n] - other[starts] <= spare]
                if len(starts):
                    own = prints.of(starts, n)
                    at, ks = self.met(own, size)
                    for k in np.unique(ks).tolist():
                        verify(k, starts[at[ks == k]], n, own[at[ks == k]])
        for k in self.weak:
            n = min(self.sizes[k], len(ids))
            other = np.concatenate(([0], np.cumsum(~np.isin(ids, self.own[k]))))
            starts = np.flatnonzero(other[n:] - other[:-n] <= spare_words(n, self.sizes[k]))
            if len(starts):
                verify(k, starts, n, prints.of(starts, n))
        best = {k: min(hits) for k, hits in found.items()}
        return [(self.items[k][0], a, n, -s, d) for k, (s, d, a, n) in sorted(best.items())]

    def _parts(self, foreign: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a text that hold all windows that can be similar, by the windows of the smallest size."""
        n, sizes = len(foreign) - 1, list(self.strong)
        if not sizes or n < sizes[-1]:
            return [(0, n)] * bool(sizes)
        at = np.flatnonzero(foreign[sizes[0]:] - foreign[:-sizes[0]] <= self.most_foreign)
        ends = np.flatnonzero(np.diff(at, append=2 * n + 4 * sizes[-1]) > 2 * sizes[-1])
        return [(max(0, int(at[a]) - sizes[-1]), min(n, int(at[z]) + sizes[0] + sizes[-1])) for a, z in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())] if len(at) else []

    def similarity(self, item: int, ids: np.ndarray) -> float:
        own, width = self.shingles[item], min(SHINGLE, self.sizes[item])
        if len(ids) < width:
            return 0.0
        grams = Counter(g for g, whole in zip(rolled(ids, width).tolist(), np.convolve(ids == 0, np.ones(width, np.int8), "valid") == 0) if whole)
        shared = sum(min(c, own[g]) for g, c in grams.items() if g in own)
        return shared / (len(ids) - width + 1 + own.total() - shared)


class Prints:
    """Fingerprints of windows of a text, whose running sums are made once, when the first window is asked for."""

    def __init__(self, ids: np.ndarray, words: list[str], known: np.ndarray):
        self.ids, self.words, self.known = ids, words, known

    @cached_property
    def hashes(self) -> np.ndarray:
        """The words' hashes: those of items' words are known."""
        h = self.known[self.ids.astype(np.int64)]
        other = np.flatnonzero(self.ids == 0)
        h[other] = word_hashes([self.words[k] for k in other.tolist()])
        return h

    def of(self, starts: np.ndarray, n: int, together: int = 4096) -> np.ndarray:
        """Those of the ``n`` words from each of the ascending starts; starts that are near each other share running sums."""
        out, cut = [], np.flatnonzero(np.diff(starts, prepend=starts[0]) > 2 * n)
        for part in np.split(starts, cut):
            for at in range(0, len(part), together):
                some = part[at:at + together]
                low, high = int(some[0]), int(some[-1]) + n
                out.append(window_prints(self.hashes[low:high], some - low, n))
        return np.concatenate(out)


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """One number for each run of ``width`` words."""
    n, out = len(ids) - width + 1, np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ ids[k:k + n]) * _MIX + (out >> np.uint64(29))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, chars_at_once: int = CHARS_AT_ONCE) -> DataFrame:
    """A row for each document and item it holds: ``doc_id, item_id, first_word, n_words, similarity, distance``.

    Defined results: null, empty and blank texts hold nothing, such items are held by nothing; items alike are all reported; rows
    that repeat a doc_id are searched each; a text shorter than an item is one window; an empty table gives none; further columns
    are ignored. Only items reach the driver, about ``chars_at_once`` characters of them at a time: a larger benchmark is cut by a
    hash, and what one part finds is written before the next one is read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-n // chars_at_once))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, kept = None, Kept(spark, "leaks")
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])
        found = rows.mapInArrow(_searcher(shared), f"doc_id bigint, {_COLUMNS}")
        if passes > 1:
            found = kept.keep(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _index_of(shared) -> Index:
    """The index of the items, built once in each Python worker; a worker keeps the last one."""
    held = sys.__dict__.setdefault("_recon_leak_index", [])
    if not held or held[0] != shared.value:
        held[:] = [shared.value, Index(shared.value)]
    return held[1]


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(shared)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1)):
                out += [(doc.as_py(), *hit) for hit in index.search(text.as_py())]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

    return search


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, whole and with all their columns; a document without a doc_id is judged by its text."""
    kept = Kept(docs.sparkSession, "leaks")
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    marked = docs.select(mark.alias("doc_id"), "text")
    gone = kept.keep(leaks(marked, benchmark).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, mark == gone["_gone"], "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the whole table ``documents`` with every item of ``benchmark`` that it holds."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
