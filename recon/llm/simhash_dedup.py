"""SimHash near-duplicates of documents: every pair of fingerprints within a radius, found by tiled exact comparison.

Fingerprints are put into cells by the population counts of their four 16-bit words. Two fingerprints cannot differ in fewer bits
than their population counts do, word by word, so pairs of cells beyond the radius are skipped and every other pair is compared
with exclusive-or and bit counts. A cell of any size is cut into tiles of bounded size; a pair of tiles returns links that join
what its hits join, at most one for each fingerprint, never all hits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, components, let, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: Column, n: int = 3) -> Column:
    """XXH64 (seed 42) of each ``n``-word shingle of the text with A-Z in lower case; one of all words if they are fewer, none for no words."""
    def of(ws: Column) -> Column:
        one = F.array(F.xxhash64(F.array_join(ws, " ")))
        each = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(ws, i + k) for k in range(n)])))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) < n, one).otherwise(each)

    return let(words(F.translate(text, UPPER, LOWER)), of)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit value whose bits are set in over half of them; zero for an empty run.

    Bits are counted eight at a time: the bytes of a 64-bit sum count one bit of each byte, over at most 255 hashes.
    """
    n, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(offsets[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _BYTES, at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the SimHash of every whole text as a signed 64-bit integer; null and empty texts have 0.

    Hashes are made in the JVM, whose ``xxhash64`` is the hash wanted; Python workers only count bits.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                h = part.column(1)
                offsets = h.offsets.to_numpy().astype(np.int64)
                values = h.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority_bits(values, offsets - offsets[0]).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), shingle_hashes(F.col(text), n).alias("h"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links_between(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 18) -> list[tuple[int, int]]:
    """Index pairs (of ``a``, of ``b``) within ``radius``: a forest that joins everything all such pairs join."""
    label, out = np.arange(len(a) + len(b)), []
    step = max(1, block // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[i])
            others = label[len(a) + hits]
            fresh = others != label[at + i]
            for old, j in zip(*np.unique(others[fresh], return_index=True)):
                out.append((at + int(i), int(hits[fresh][j])))
                label[label == old] = label[at + i]
    return out


def near_links(fps: DataFrame, kept: Kept, radius: int = 3, tile: int = 4096) -> DataFrame:
    """``(a, b)`` fingerprints that link the distinct values of ``fps(fp)``, connected exactly as all pairs within ``radius``."""
    spark = fps.sparkSession
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    celled = kept.keep(fps.select("fp", F.array(*counts).alias("cell")))
    # At most 17^4 cells, whatever the input.
    tiles = F.ceil(F.col("n") / tile).cast("int")
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", tiles.alias("tiles"))
    dealt = celled.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("tiles")).cast("int"))
    packed = kept.keep(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")))

    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
    offsets = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    ids = packed.select("cell", "tile")
    near = ids.select("cell", "tile", F.explode(offsets).alias("o")).select("cell", "tile", F.zip_with("cell", "o", lambda x, y: x + y).alias("cell_b"))
    same = F.col("cell") == F.col("cell_b")
    pairs = near.join(ids.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b")), "cell_b").where(~same | (F.col("tile") <= F.col("tile_b")))
    held = pairs.join(packed, ["cell", "tile"]).withColumnRenamed("fps", "fps_a")
    held = held.join(packed.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b")), ["cell_b", "tile_b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            flat = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in batch.columns]
            for r in range(batch.num_rows):
                a, b = (v[o[r]:o[r + 1]] for o, v in flat)
                for i, j in links_between(a, b, radius):
                    if a[i] != b[j]:
                        left.append(a[i]), right.append(b[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])

    links = kept.keep(held.select("fps_a", "fps_b").mapInArrow(compare, "a bigint, b bigint"))
    kept.drop(celled, packed)
    return links


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``: documents whose fingerprints link, directly or over others, share
    the smallest doc_id among them.

    Defined results: a null or empty text has fingerprint 0 and links like any other; repeated rows are returned as often as given;
    a null doc_id keeps its row and is no representative (``component_id`` is null only where all of a group have none); an empty
    table gives none; further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    kept = Kept(spark, "simhash")
    each = kept.keep(fingerprints(docs, n))
    firsts = kept.keep(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(firsts.select("fp"), kept, radius, tile)
    parts = kept.keep(components(links, kept))
    # The fingerprint that stands for a component is its smallest; its documents have the smallest id below.
    root = firsts.join(parts, firsts.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    root = kept.keep(root)
    least = kept.keep(root.groupBy("root").agg(F.min("first").alias("component_id")))
    named = kept.keep(root.join(least, "root").select(F.col("fp").alias("k"), "component_id"))
    return each.join(named, each.fp == named.k).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """The documents of ``docs``, whole and with all their columns, without those that near-duplicate one of a smaller doc_id.

    Of rows that repeat a doc_id one stays, the first by text; rows without a doc_id stay, since none can stand for another.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "simhash-keep")
    found = near_duplicates(docs.select("doc_id", "text"), n, radius)
    gone = kept.keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    left = docs.join(gone, docs.doc_id == gone.gone, "left_anti")
    twice = kept.keep(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("twice")))
    once = left.join(twice, left.doc_id == twice.twice, "left_anti")
    more = left.join(twice, left.doc_id == twice.twice, "left_semi")
    names = [c for c in docs.columns if c != "doc_id"]
    first = more.groupBy("doc_id").agg(F.min(F.struct(F.col("text").alias("_text"), *[F.col(c) for c in names])).alias("r"))
    return once.unionByName(first.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in names]).select(*docs.columns))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint`` (16 lower-case hex digits), ``component_id`` over the whole table ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
