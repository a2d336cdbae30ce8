"""Shared pieces: tables, intermediate results in the shared folder, words as columns, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root

#: Whether Spark deletes shuffle files at the end of a query.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space that ends a word, as a character class for regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Kept:
    """Intermediate tables of one job, written as Parquet to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """``df`` as a table. What was shuffled for it is deleted once it is written, not when the driver happens to collect garbage."""
        self.n += 1
        path, conf = f"{self.root}/{self.n}", self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            conf.set(CLEAN_UP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.kept_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.kept_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, room: int, *texts: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts in whose text columns there are about ``room`` characters; a longer row is a part of its own."""
    sizes = sum((pc.fill_null(pc.utf8_length(batch.column(k)), 0).to_numpy().astype(np.int64) for k in texts), np.full(batch.num_rows, 16))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // room, prepend=-1)).tolist()
    for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(at, end - at)


class Places:
    """Where a 64-bit number is in an array of distinct ones: a table of places, open to the next free one, looked up for many at once."""

    def __init__(self, values: np.ndarray):
        self.mask = np.uint64(max(2, 1 << (2 * len(values)).bit_length()) - 1)
        self.keys, self.at = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, -1, np.int32)
        left, values = np.arange(len(values)), values.astype(np.uint64)
        slot = self._slot(values)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            self.keys[slot[free]] = values[left[free]]
            missed = self.at[slot] != left
            left = left[missed]
            slot = (slot[missed] + np.uint64(1)) & self.mask
        # Of two that met at a free place the last one written holds it, and its key has to be its own.
        held = self.at >= 0
        self.keys[held] = values[self.at[held]]

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & self.mask

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are not there."""
        out, left, values = np.full(len(values), -1, np.int64), np.arange(len(values)), values.astype(np.uint64, copy=False)
        slot = self._slot(values)
        while len(left):
            at = self.at[slot]
            hit = (at >= 0) & (self.keys[slot] == values[left])
            out[left[hit]] = at[hit]
            on = (at >= 0) & ~hit
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def components(edges: DataFrame, kept: Kept) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Large-star and small-star steps in turn: each step links the neighbours of a node to the smallest of them, until nothing
    changes. Minima are aggregated before they meet the edges, so no group is gathered anywhere, and the joins are plain ones
    that adaptive execution splits when a node has very many neighbours. Nodes are of any type that sorts.
    """
    now = kept.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = kept.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        below = kept.keep(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(below, "u")
        small = kept.keep(down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(below.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        kept.drop(now, least, large, below)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component")))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
