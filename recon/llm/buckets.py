"""Buckets of any size, cut into tiles: which tiles have to meet so that every pair of members of different components does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept


def tile_pairs(members: DataFrame, kept: Kept, tile: int, room: int) -> tuple[DataFrame, DataFrame]:
    """``(key, tile, id, component)`` and ``(key, tile, other)`` of ``members(key, id, component, weight)``.

    A tile has about ``tile`` members of ``room`` weight in all. Buckets of one component are left out. A component that fills tiles has
    its own ones, which need not meet each other; smaller ones share tiles. Pairs are of tiles' numbers; nothing heavy is with them.
    """
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    per = kept.keep(per.withColumn("own", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("w") / room)).cast("int")))
    mixed = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("own") == 1, F.col("n"))).alias("n_"), F.sum(F.when(F.col("own") == 1, F.col("w"))).alias("w_")).where("parts > 1")
    mixed = mixed.select("key", F.coalesce(F.greatest(F.ceil(F.col("n_") / tile), F.ceil(F.col("w_") / room)), F.lit(1)).cast("int").alias("shared"))
    numbered = kept.keep(members.select("key", "id", "component").join(per.select("key", "component", "own").join(mixed, "key"), ["key", "component"]).select(
        "key", F.when(F.col("own") > 1, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("own")))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared"))).alias("tile"), "id", "component"))
    tiles = kept.keep(numbered.groupBy("key", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    one, two = tiles, tiles.select("key", F.col("tile").alias("other"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    apart = (F.col("lo") != F.col("hi")) | (F.col("lo_") != F.col("hi_")) | (F.col("lo") != F.col("lo_"))
    return numbered, kept.keep(one.join(two, "key").where((F.col("tile") <= F.col("other")) & apart).select("key", "tile", "other"))
