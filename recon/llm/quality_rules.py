"""Quality rules: a decision list learned from labelled statistics. DataFrame functions only.

Sequential covering grows one rule after the other, a conjunction of thresholds that covers documents labelled bad and as few others
as it can, prunes it on labelled documents that it was not grown on, and goes on with what it doesn't cover. The list becomes an
ordered conditional expression over the statistics' columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, let, read, words
from .simhash_dedup import LOWER, UPPER

BLANKS, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 8
#: Labelled documents that the rules are learned from, at most; the driver holds their statistics, a few numbers each.
MAX_FIT = 6000
#: Share of bad documents among those a rule covers that it must reach on the pruning part; rules; conditions of a rule.
PRECISION, MAX_RULES, MAX_CONDITIONS, MIN_COVERED = 0.9, 12, 4, 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "bar_share")


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of eight words that the text holds twice or more."""
    def marked(hs: Column) -> Column:
        def covered(rows: Column) -> Column:
            same = lambda r, j: F.coalesce(F.get(rows, j)["h"] == r["h"], F.lit(False))
            twice = F.filter(rows, lambda r, j: ((j > 0) & same(r, j - 1)) | same(r, j + 1))
            places = F.array_sort(F.transform(twice, lambda r: r["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(places, start, lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]

        rows = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(rows, covered))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))

    return F.when(F.size(ws) < WINDOW, 0).otherwise(let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), marked))


def statistics(text: Column) -> Column:
    """A struct of counts of a whole text; zeros for null."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n_words"), F.size(F.array_distinct(ws)).cast("bigint").alias("n_distinct"), repeated_words(ws).cast("bigint").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: without(x, BLANKS) > 0)
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("bigint").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines")))
    n = lambda chars: (F.length(text) - without(text, chars)).cast("bigint")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), without(text, BLANKS).cast("bigint").alias("word_chars"), n(SYMBOLS).alias("n_symbols"), n(UPPER).alias("n_upper"), n("0123456789").alias("n_digits"), n("|").alias("n_bars"))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and the statistics of its text, with the shares that rules are about."""
    s = docs.select(*keep, statistics(F.col("text")).alias("_s")).select(*keep, "_s.w.*", "_s.l.*", "_s.word_chars", "_s.n_symbols", "_s.n_upper", "_s.n_digits", "_s.n_bars")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    shares = {"mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
              "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "distinct_share": share("n_distinct", "n_words"), "bar_share": share("n_bars", "n_words")}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumns(shares | {"base_failed": failed})


@dataclass(frozen=True)
class Condition:
    """``feature >= limit``, or ``feature <= limit`` if not ``above``."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.limit if self.above else F.col(self.feature) <= self.limit

    def covers(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.limit if self.above else v <= self.limit


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.covers(x) for c in rule]) if rule else np.ones(len(x), bool)


def grow(x: np.ndarray, bad: np.ndarray, limits: list[np.ndarray]) -> Rule:
    """Adds the condition of most information gain until no good document is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, chosen = 1e-9, None
        for k, values in enumerate(limits):
            v = x[inside, k]
            for above in (True, False):
                hit = v[None, :] >= values[:, None] if above else v[None, :] <= values[:, None]
                p, n = (hit & bad[inside]).sum(axis=1), (hit & ~bad[inside]).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, chosen = gain[i], Condition(FEATURES[k], above, float(values[i]))
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.covers(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is worth most on other documents, with its precision there and how many it covers."""
    best: tuple = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0, p + n)
    return best[1:]


def learn(x: np.ndarray, bad: np.ndarray, growing: np.ndarray) -> list[Rule]:
    """The ordered rules of documents to drop; none if nothing precise enough is found."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & growing & bad).sum() >= MIN_COVERED:
        g, p = left & growing, left & ~growing
        limits = [np.unique(np.quantile(x[g, k], np.linspace(0, 1, 129))) for k in range(x.shape[1])]
        rule, precision, n = prune(grow(x[g], bad[g], limits), x[p], bad[p])
        if not rule or n < MIN_COVERED or precision < PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as a column: false by the first rule that covers, else true."""
    out = None
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> list[Rule]:
    """Rules from at most ``max_fit`` labelled documents, the first by a hash of their doc_id; labels that contradict each other
    teach nothing, and of rows that repeat a doc_id the first text by order teaches. A third of the documents, by the hash too,
    prunes. Statistics are made of the labelled texts alone, which are written down before.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    sample = one.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    # The sample's size is bounded by its limit.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    texts = Kept(docs.sparkSession, "labelled").keep(texts.repartition(64, "doc_id"))
    rows = with_statistics(texts, "doc_id", "quality").where(~F.col("base_failed")).select("quality", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("growing"), *FEATURES).collect()
    if not rows:
        return []
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    order = np.lexsort(x.T)
    x, bad, growing = x[order], np.array([r.quality == 0 for r in rows])[order], np.array([r.growing for r in rows])[order]
    return learn(x, bad, growing)


def judged(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """``keep`` columns, all statistics, ``base_failed`` and ``kept`` of every row of ``docs``.

    Defined results: a null or empty text has no words and fails the base; repeated rows are judged each; an empty table gives none.
    """
    return with_statistics(docs, *keep).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` over the whole table ``documents``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return judged(docs, rules, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
