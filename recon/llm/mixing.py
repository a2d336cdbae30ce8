"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks. DataFrame functions only.

Each source's documents are laid on a line in a shuffled order, one pass after the other, and cut into blocks of ``block`` words.
Slot ``i`` of the mix takes the point ``frac(i * golden ratio)``, which the sources' cumulative targets map to a source; the k-th
slot of a source takes its k-th block. Any stretch of the mix therefore holds the sources near their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, read, words

#: Weights of the sources in their order, repeating; share of all words that the mix has; times a source may be taken.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words of a block; documents (slots) whose order is worked out together; sources up to which their table is broadcast.
BLOCK, CHUNK, FEW = 4096, 128, 50_000
GOLDEN, CELLS = (math.sqrt(5) - 1) / 2, 4096


def before(df: DataFrame, group: str, chunk: str, order: list[Column], amount: Column, kept: Kept) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over the rows of the group that come earlier, and ``place``, the row's number
    in its chunk. Chunks of a group are numbered in order; their sums, and the sums of 1024 chunks, are added up first, so that no
    task sees a whole group."""
    df = df.withColumn("_amount", amount)
    sums = kept.keep(df.groupBy(group, chunk).agg(F.sum("_amount").alias("_n")))
    coarse = sums.groupBy(group, F.floor(F.col(chunk) / 1024).alias("_coarse")).agg(F.sum("_n").alias("_m"))
    coarse = coarse.withColumn("_far", F.sum("_m").over(Window.partitionBy(group).orderBy("_coarse")) - F.col("_m"))
    fine = sums.withColumn("_coarse", F.floor(F.col(chunk) / 1024))
    fine = fine.withColumn("_near", F.sum("_n").over(Window.partitionBy(group, "_coarse").orderBy(chunk)) - F.col("_n"))
    # Joins that merge need no table in the driver's memory, and one side of each is dealt and sorted by its keys already.
    base = kept.keep(fine.join(coarse.hint("merge"), [group, "_coarse"]).select(group, chunk, (F.col("_near") + F.col("_far")).alias("_base")))
    w = Window.partitionBy(group, chunk).orderBy(*order)
    own = df.withColumn("_own", F.sum("_amount").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_amount")).withColumn("place", F.row_number().over(w))
    return own.join(base.hint("merge"), [group, chunk]).withColumn("before", F.col("_base") + F.col("_own")).drop("_amount", "_own", "_base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``sid, source, source_size, n_docs, target`` of each source of ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. A source whose share by weight is over ``passes`` times its size
    gets just that; what is left goes to the others by weight. In ascending order of size over weight, a source is full if what is
    left for it and all after it would fill it, so one pass over the sources finds the level of those that aren't.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    one = one.withColumn("sid", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    cap = F.col("source_size") * float(passes)
    rise = Window.orderBy(F.col("full_at"), F.col("sid"))
    one = one.withColumn("full_at", cap / F.col("weight")).withColumn("cap", cap)
    left = F.sum("source_size").over(Window.partitionBy()) * float(share) - (F.sum("cap").over(rise) - F.col("cap"))
    rest = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    one = one.withColumn("level", left / rest)
    level = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "sid", "level"))).over(Window.partitionBy())["level"]
    one = one.withColumn("final", level)
    return one.select("sid", "source", "source_size", "n_docs", F.when(F.col("full_at") > F.col("level"), F.col("final") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def slots(sources: DataFrame, kept: Kept, block: int = BLOCK) -> DataFrame:
    """``slot, sid, rank``: the rank-th slot of a source takes its rank-th block, counted from 0.

    A source needs its target in blocks, the last one cut. Slots beyond that are left out; what the sequence has not yet given a
    source when it ends (a few blocks at most) follows it.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n = math.ceil(total / block)
    line = sources.where("target > 0").withColumn("high", F.sum("target").over(Window.orderBy("sid")) / F.lit(total or 1.0))
    line = line.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
    line = line.select("sid", "low", "high", F.ceil(F.round("target") / block).alias("need"), F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS).cast("bigint")))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(line, "cell").where("u >= low and u < high").select("slot", "sid", "need", F.floor(F.col("slot") / (CHUNK * 8)).alias("chunk"))
    hit = kept.keep(hit)
    ranked = before(hit, "sid", "chunk", [F.col("slot")], F.lit(1).cast("bigint"), kept).select("slot", "sid", "need", F.col("before").alias("rank"))
    need = sources.where("target > 0").select("sid", F.ceil(F.round("target") / block).alias("need"))
    met = hit.groupBy("sid").agg(F.count(F.lit(1)).alias("met"))
    short = need.join(met.hint("merge"), "sid", "left").where("coalesce(met, 0) < need")
    added = short.select("sid", F.explode(F.sequence(F.coalesce("met", F.lit(0)), F.col("need") - 1)).alias("rank"))
    added = added.select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    return ranked.where("rank < need").select("slot", "sid", "rank").unionByName(added)


def _few(sources: DataFrame) -> bool:
    return sources.count() <= FEW


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in the slots of the mix, and a row without a slot for each document that the mix does not take.

    Columns: ``doc_id, text_hash, source, size, source_size, target``, the row's key ``sid, chunk, place``, and ``slot, first_word,
    n_words``: the words of the piece, counted from 0. The text is read once, for its number of words and its hash.
    """
    spark: SparkSession = docs.sparkSession
    kept = Kept(spark, "mix")
    text = F.col("text")
    narrow = docs.select("doc_id", "source", F.size(words(text)).cast("bigint").alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    narrow = kept.keep(narrow)
    sources = kept.keep(targets(narrow, weights, share, passes))
    known = sources.withColumnRenamed("source", "s")
    side = F.broadcast(known) if _few(sources) else known
    key = F.xxhash64("doc_id", "text_hash", F.lit(11))
    placed = narrow.join(side, narrow.source.eqNullSafe(F.col("s"))).drop("s").withColumn("key", key)
    # The part of a source's chunks by the key's 53 high bits: chunks follow each other as keys do.
    part = F.shiftrightunsigned("key", 11) / float(1 << 53)
    placed = placed.withColumn("chunk", F.floor(part * F.ceil(F.col("n_docs") / CHUNK)))
    laid = before(placed, "sid", "chunk", [F.shiftrightunsigned("key", 11), F.col("key"), F.col("doc_id"), F.col("text_hash")], F.col("size"), kept)
    end = F.round("target").cast("bigint")
    runs = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.struct((F.col("before") + p * F.col("source_size")).alias("a"), F.least(F.col("before") + p * F.col("source_size") + F.col("size"), end).alias("z"), (F.col("before") + p * F.col("source_size")).alias("from")))
    runs = F.filter(runs, lambda r: r["a"] < r["z"])
    blocks = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.floor(r["a"] / block), F.floor((r["z"] - 1) / block)), lambda b: F.struct(b.alias("rank"), (F.greatest(r["a"], b * block) - r["from"]).alias("first_word"), (F.least(r["z"], (b + 1) * block) - F.greatest(r["a"], b * block)).alias("n_words")))))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target", "sid", "chunk", "place"]
    pieces = laid.select(*columns, F.explode_outer(blocks).alias("b")).select(*columns, "b.rank", "b.first_word", "b.n_words")
    # A table of its own: the plan of both, looked through anew after each of its stages, is the driver's largest.
    dealt = kept.keep(slots(sources, kept, block))
    return pieces.join(dealt.hint("merge"), ["sid", "rank"], "left").select(*columns, "slot", "first_word", F.when(F.col("slot").isNotNull(), F.col("n_words")).alias("n_words"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, taken`` for every row of ``docs``.

    Defined results: a null text has no words; null sources are one source, the last; a document or source without words is taken
    0 times; repeated rows keep a row each; an empty table gives none; further columns are ignored.
    """
    rows = schedule(docs, **options).groupBy("sid", "chunk", "place")
    first = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "source", "size", "source_size", "target")]
    return rows.agg(*first, F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns: whole ones as often as the mix takes them whole, and of the one at the end
    of a source's line the words that are taken. Rows alike in doc_id and text share what they got."""
    kept = Kept(docs.sparkSession, "mixed")
    got = taken(docs.select("doc_id", "text", "source"), **options).where("taken > 0")
    got = kept.keep(got.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("source").alias("s")).agg(F.max("size").alias("words"), F.max("taken").alias("taken")))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    met = docs.join(got.hint("merge"), docs.doc_id.eqNullSafe(F.col("d")) & (mark == F.col("h")) & docs.source.eqNullSafe(F.col("s")))
    parts = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), F.floor(F.col("taken") / F.col("words")).cast("int")), F.when(F.col("taken") % F.col("words") > 0, F.array(F.col("taken") % F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    rows = met.withColumn("_part", F.explode(parts))
    cut = F.when(F.col("_part") < 0, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("_part").cast("int")), " "))
    rows = rows.withColumn("text", cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    return rows.select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` over the whole table ``documents``."""
    return taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
