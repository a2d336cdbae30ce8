"""Language identification by character models with interpolated Kneser-Ney smoothing, one for each language.

Texts are lower-cased and every run of other characters than letters is one blank. The models' n-grams are 64-bit hashes in sorted
arrays. A text gets the language whose cross-entropy per character is lowest; whether that is low enough for the language is
calibrated on documents that were not counted.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, read, slices

ORDER = 5
#: Most n-grams of each order that a language's model stores, the most frequent first, and that all languages store together; what is
#: estimated (discounts, sums of contexts, continuation counts) comes of all n-grams. Documents of a language used to calibrate.
MAX_GRAMS, MAX_ALL, MAX_CALIBRATE = 250_000, 4_000_000, 1500
#: Characters of texts that are scored at once, and places of one text.
SLICE = 400_000
#: Characters from which each band of lengths begins. Texts are rejected above the usual excess of their band by so many robust standard
#: deviations, and so many nats a character. A language with fewer texts in a band shares the limit of all languages there.
BANDS, SPREADS, SLACK, FEW = (1, 16, 64, 256, 1024), 8, 0.5, 50
_P, _BLANK = np.uint64(0x9E3779B97F4A7C15), 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter or a mark that belongs to one, else a blank."""
    if not _letters:
        table = np.full(0x110000, _BLANK, np.uint32)
        kinds = np.array([0 if chr(c).isalpha() else 1 if unicodedata.category(chr(c))[0] == "M" else 2 for c in range(0x110000)], np.uint8)
        table[kinds < 2] = np.flatnonzero(kinds < 2)
        _letters.extend([table, kinds == 1])
    return _letters[0]


def normalised(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in one array, each after ``order - 1`` blanks and before one; the places that are predicted; and the
    first of those places for each text, as an index into them, with their number at the end. A text without letters has none."""
    table, pad = letter_table(), " " * (order - 1)
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer("".join(f"{pad}{t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + order
    ends = np.cumsum(size)
    starts = ends - size
    c = table[raw]
    blank = c == _BLANK
    keep = np.empty(len(c), bool)
    if len(c):
        keep[0] = True
        np.logical_not(blank[1:] & blank[:-1], out=keep[1:])
    for k in range(order - 1):
        keep[starts + k] = True
    first = starts + order - 1
    lead = first[blank[first]] if len(first) else first
    keep[lead] = False  # the pad stands for leading blanks
    body = keep.copy()
    for k in range(order - 1):
        body[starts + k] = False
    letters = ~blank
    if len(c) and c.max() >= 0x300:
        letters &= ~_letters[1][c]  # a mark alone is no letter
    letters = np.add.reduceat(letters, starts) if len(starts) else np.zeros(0, np.int64)
    if (letters == 0).any():
        body &= np.repeat(letters > 0, size)
    at = (np.cumsum(keep) - 1)[body]
    count = np.concatenate([[0], np.cumsum(np.add.reduceat(body, starts))]) if len(starts) else np.zeros(1, np.int64)
    return c[keep], at, count


def gram_hashes(chars: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` characters that end at each place."""
    if 4 * len(at) < len(chars):  # few places: only what is before them is looked at
        out = np.full(len(at), m, np.uint64)
        for n in range(m - 1, -1, -1):
            out = (out ^ chars[at - n].astype(np.uint64)) * _P
            out ^= out >> np.uint64(31)
        return out
    c = chars.astype(np.uint64)
    out = np.full(len(c), m, np.uint64)
    for k in range(m):
        n = m - 1 - k
        shifted = c if n == 0 else np.concatenate([np.zeros(n, np.uint64), c[:-n]])
        out = (out ^ shifted) * _P
        out ^= out >> np.uint64(31)
    return out[at]


class Sorted:
    """Rows of values by 64-bit hash: a sorted array with the first place of each run of high bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        n = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << int(64 - self.shift))
        self.start, self.most = np.concatenate([[0], np.cumsum(n)]).astype(np.int32), int(n.max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        bucket = (hashes >> self.shift).astype(np.int32)
        at, out = self.start[bucket], np.full(len(hashes), -1, np.int32)
        last = len(self.keys) - 1
        hit = self.keys[np.minimum(at, last)] == hashes
        out[hit] = at[hit]
        open_ = np.flatnonzero(~hit)
        for step in range(1, self.most):
            i = at[open_] + step
            open_, i = open_[inside := i < self.start[bucket[open_] + 1]], i[inside]
            hit = self.keys[i] == hashes[open_]
            out[open_[hit]] = i[hit]
            open_ = open_[~hit]
        return out


@dataclass
class Level:
    """What one language's model stores of one order: n-grams, their discounted share of their context, and what each one's context
    leaves to the lower order."""

    grams: list[str]
    shares: np.ndarray
    rests: np.ndarray


class Models:
    """Kneser-Ney models of several languages over one set of hash arrays."""

    def __init__(self, langs: list[str], levels: list[list[Level]], alphabets: list[int], order: int = ORDER):
        """``levels[k][m - 1]``: what language k stores of order m; ``alphabets[k]``: its number of single characters."""
        self.langs, self.order, n_langs = langs, order, len(langs)
        self.base = np.array([1 / (n + 1) for n in alphabets])
        found: list[dict] = [{} for _ in range(order + 1)]
        backs: list[dict] = [{} for _ in range(order + 1)]
        for k, own in enumerate(levels):
            for m, level in enumerate(own, 1):
                c = _code_points(level.grams)
                at = np.arange(m - 1, m * len(level.grams), m)
                found[m][k] = gram_hashes(c, at, m), level.shares
                which, first = np.unique(gram_hashes(c, at - 1, m - 1) if m > 1 else np.zeros(len(at), np.uint64), return_index=True)
                backs[m][k] = which, level.rests[first]
        self.found = [_table(x, n_langs, 0.0) for x in found]
        self.backs = [_table(x, n_langs, 1.0) for x in backs]
        rows = sorted({g for own in levels for g in own[-1].grams})
        c, at = _code_points(rows), np.arange(order - 1, order * len(rows), order)
        self.seen = Sorted(gram_hashes(c, at, order), self.logs(c, at).astype(np.float32)) if langs else None
        self.calibrated: dict = {}

    def logs(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place, a column for each language, from the lowest order up."""
        p = np.tile(self.base, (len(at), 1))
        for m in range(1, self.order + 1):
            back = self.backs[m].find(gram_hashes(chars, at - 1, m - 1) if m > 1 else np.zeros(len(at), np.uint64))
            p[back >= 0] *= self.backs[m].values[back[back >= 0]]
            own = self.found[m].find(gram_hashes(chars, at, m))
            p[own >= 0] += self.found[m].values[own[own >= 0]]
        return np.log(p)

    def _stored(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As :meth:`logs`, from the table of known n-grams where it has them."""
        place = self.seen.find(gram_hashes(chars, at, self.order))
        logs, new = self.seen.values[place] if len(self.seen.keys) else np.zeros((len(at), len(self.langs)), np.float32), np.flatnonzero(place < 0)
        if len(new):
            logs[new] = self.logs(chars, at[new])
        return logs

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its number of characters; 0 characters: no letter."""
        out, sizes, at = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), 0
        lengths = np.cumsum([len(t or "") for t in texts]) if texts else np.zeros(0, int)
        while at < len(texts):  # texts that are together no longer than a slice; at least one
            end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + SLICE)))
            chars, places, count = normalised(texts[at:end], self.order)
            n = np.diff(count)
            sizes[at:end] = n
            if end - at == 1:
                sums = sum((self._stored(chars, places[k:k + SLICE]).sum(axis=0, dtype=np.float64) for k in range(0, len(places), SLICE)), np.zeros(len(self.langs)))
                out[at] = -sums / max(1, n[0])
            elif len(places):
                some = np.flatnonzero(n)
                out[at + some] = -np.add.reduceat(self._stored(chars, places), count[:-1][some], axis=0, dtype=np.float64) / n[some, None]
            at = end
        return out, sizes

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Per language the usual cross-entropy and how far above it texts go, by length; and the temperature of the scores. Texts of a
        language that no text calibrates are not rejected."""
        e, n = self.entropies(texts)
        own = np.array([self.langs.index(x) for x in langs], int)
        ok = n > 0
        e, n, own = e[ok], n[ok], own[ok]
        # A text that another language's model prefers is mislabelled or foreign and tells nothing about its own language.
        true = e.argmin(axis=1) == own if len(own) else np.zeros(0, bool)
        usual = np.full(len(self.langs), np.inf)
        for k in set(own[true].tolist()):
            usual[k] = _median(e[true & (own == k), k], np.minimum(n[true & (own == k)], 256))  # no long text outweighs the others
        excess, band, whose = (e[true, own[true]] - usual[own[true]]) * np.sqrt(n[true]), _band(n[true]), own[true]
        above = np.full((len(self.langs), len(BANDS)), np.inf)
        for k in set(whose.tolist()):
            for j in range(len(BANDS)):
                for some in ((whose == k) & (band == j), band == j, band >= 0):
                    if some.sum() >= FEW or some.all():
                        above[k, j] = _limit(excess[some])
                        break
        heats = 2.0 ** -np.arange(0, 9)
        loss = [-np.log(np.clip(_posterior(e, n, t)[np.arange(len(own)), own], 1e-9, 1)).mean() if len(own) else 0 for t in heats]
        self.calibrated = {"usual": usual, "above": above, "heat": heats[int(np.argmin(loss))]}

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is rejected; ``und`` with score 0, rejected, if it has no letter."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        e, n = self.entropies(texts)
        best, rows = e.argmin(axis=1), np.arange(len(texts))
        score = np.where(n > 0, _posterior(e, n, self.calibrated["heat"])[rows, best], 0.0)
        low = e[rows, best]
        with np.errstate(invalid="ignore"):
            far = (low - self.calibrated["usual"][best]) * np.sqrt(n) > self.calibrated["above"][best, _band(n)] + SLACK * np.sqrt(n)
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], score, low, far | (n == 0)


def _band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS[1:], n, side="right")


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def _limit(excess: np.ndarray) -> float:
    """The median and some robust standard deviations: up to half of the texts may be anything."""
    middle = np.median(excess)
    return float(middle + SPREADS * max(0.5, 1.4826 * np.median(np.abs(excess - middle))))


def _posterior(e: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    z = -(e - e.min(axis=1, keepdims=True)) * (n * heat)[:, None]
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _table(by: dict, n_langs: int, default: float) -> Sorted:
    keys = np.unique(np.concatenate([h for h, _ in by.values()] or [np.zeros(0, np.uint64)]))
    values = np.full((len(keys), n_langs), default)
    for k, (h, v) in by.items():
        values[np.searchsorted(keys, h), k] = v
    return Sorted(keys, values)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all ``docs(lang, text)``: each task counts its own n-grams, then the counts are summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for b in batches:
            for part in slices(b, 4 * SLICE, 1):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in set(langs):
                    chars, places, _ = normalised([t for x, t in zip(langs, texts) if x == lang], order)
                    h = gram_hashes(chars, places, order)
                    h, first, n = np.unique(h, return_index=True, return_counts=True)
                    grams = chars[places[first][:, None] + np.arange(1 - order, 1)]
                    if lang in held:
                        h, grams, n = (np.concatenate(x) for x in zip(held[lang], (h, grams, n)))
                        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                        grams, n = grams[first], np.bincount(inverse, n).astype(np.int64)
                    held[lang] = (h, grams, n)
        for lang, (_, grams, n) in held.items():
            text = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([text[i:i + order] for i in range(0, len(text), order)]), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    each = docs.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _code_points(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bucket(n: Column) -> Column:
    """Counts as they are up to 4096, larger ones cut to their twelve highest bits, so that few kinds of counts are told apart."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(4096)).cast("double"))) - 12).cast("bigint")
    return F.floor(n / unit).cast("bigint") * unit


def stored_levels(counts: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, max_all: int = MAX_ALL) -> tuple[list[str], list[list[Level]], list[int]]:
    """Languages, what their models store, and the sizes of their alphabets, from all ``counts(lang, gram, n)``.

    In each order the counts (in lower orders: of how many characters an n-gram follows) of all n-grams give the discount and the sums
    of contexts. Then the most frequent are stored; the share of those that aren't is left to the lower order with the discounts, so
    probabilities still add up to one. The driver gets ``max_grams`` n-grams a language and order at most, and ``max_all`` in all.
    """
    kept, spark = Kept(counts.sparkSession, "levels"), counts.sparkSession
    langs: list[str] = []
    levels: dict[str, list[Level]] = {}
    alphabets: dict[str, int] = {}
    level = counts
    for m in range(order, 0, -1):
        if m < order:
            level = kept.keep(level.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        kinds: dict[str, list[tuple[int, int]]] = {}
        for r in level.groupBy("lang", _bucket(F.col("n")).alias("n")).agg(F.count(F.lit(1)).alias("kinds")).collect():
            kinds.setdefault(r.lang, []).append((r.n, r.kinds))
        if m == order:
            langs = sorted(kinds)
            levels = {lang: [] for lang in langs}
        if not langs:
            return [], [], []
        rules, most = [], min(max_grams, max_all // (order * len(langs)))
        for lang in langs:
            own = dict(kinds[lang])
            once, twice = own.get(1, 0), own.get(2, 0)
            sizes = sorted(own, reverse=True)
            total = np.cumsum([own[n] for n in sizes])
            # What is stored has at least the count of the last bucket that fits whole; the first fits in any case.
            least = sizes[max(0, int(np.searchsorted(total, most, side="right")) - 1)]
            rules.append((lang, min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5, int(least)))
            alphabets[lang] = int(total[-1])
        # One row a language.
        rule = F.broadcast(spark.createDataFrame(rules, "lang string, discount double, least bigint"))
        share = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0))
        stays = F.col("n") >= F.col("least")
        # A context is followed by as many kinds of characters as there are, at most.
        w = Window.partitionBy("lang", F.substring("gram", 1, m - 1))
        ruled = level.join(rule, "lang").select("lang", "gram", stays.alias("stays"), share.alias("share"), F.sum("n").over(w).alias("total"), F.sum(F.when(stays, share)).over(w).alias("stored"))
        got = ruled.where("stays").select("lang", "gram", (F.col("share") / F.col("total")).alias("share"), (1 - F.col("stored") / F.col("total")).alias("rest")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
        for lang in langs:
            own = got.filter(pc.equal(got["lang"], lang))
            levels[lang].insert(0, Level(own["gram"].to_pylist(), own["share"].to_numpy(), own["rest"].to_numpy()))
    return langs, [levels[x] for x in langs], [alphabets[x] for x in langs]


def fit(docs: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, max_calibrate: int = MAX_CALIBRATE) -> Models:
    """Models of the languages of ``docs(doc_id, text, lang)``, learned where crc32(doc_id as text) mod 4 is not 2.

    Remainders 0 and 1 are counted, all of them; of remainder 3 about ``max_calibrate`` documents of each language, the first by a hash
    of their doc_id, calibrate; of rows that repeat a doc_id the first text by order. The driver gets what is stored of the counts,
    and these documents.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = docs.where("lang is not null and text is not null")
    counts = Kept(docs.sparkSession, "grams").keep(gram_counts(rows.where(part < 2), order))
    langs, levels, alphabets = stored_levels(counts, order, max_grams)
    models = Models(langs, levels, alphabets, order)
    if not langs:
        return models
    sample = rows.where((part == 3) & F.col("lang").isin(langs))
    sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, max_calibrate / n))))
    once = sample.where(chosen).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    picked = once.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(2 * max_calibrate * len(langs)).select("lang", "text").toArrow()
    models.calibrate(picked["text"].to_pylist(), picked["lang"].to_pylist())
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` without its text, and ``lang_pred, score, entropy, rejected``, from each whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rest = [c for c in docs.columns if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 4 * SLICE, b.schema.get_field_index("text")):
                lang, score, entropy, rejected = shared.value.judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(lang), pa.array(score), pa.array(entropy), pa.array(rejected)], [*rest, "lang_pred", "score", "entropy", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*rest, "text").mapInArrow(judge, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def identify(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` of every row of ``docs``, with models learned from it.

    Defined results: a null text or one without a letter is ``und`` with score 0; so is every text where no language could be
    learned; a null doc_id is not held out and teaches nothing; repeated rows are judged each; an empty table gives none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), fit(docs, **options))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, whole and with all their columns, whose language is identified; those rejected go."""
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    judged = predict(docs.select(mark.alias("_mark"), "text"), fit(docs.select("doc_id", "text", "lang")))
    gone = judged.where("rejected").select(F.col("_mark").alias("_gone")).distinct()
    return docs.join(gone, mark == F.col("_gone"), "left_anti")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and more over the whole table ``documents``."""
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
