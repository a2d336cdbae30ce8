"""Incremental jobs over files as they arrive: dictionaries that only ever add, and scans that a bad file doesn't end."""

from __future__ import annotations

import uuid
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all machines share."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def learn_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, key: str, code: str) -> DataFrame:
    """``key, code, n`` over all files of a folder whose name matches, read as a stream once through.

    Every batch appends its own counts under its number, so a batch that is run again replaces what it wrote; the dictionary is their sum.
    """
    out = shared_folder(spark)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(f"{folder}/{pattern}" if pattern.endswith("*") else f"{folder}/*")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(key).alias("key"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema("key string, code string, n bigint, batch int").parquet(f"{out}/counts")
    return counts.groupBy("key", "code").agg(F.sum("n").alias("n"))


def scan_stream(spark: SparkSession, folder: str, schema: StructType, scan: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Applies a scan to new files of a folder and appends what it finds to ``out/found``.

    A batch that fails is scanned again file by file: what the good files hold is found, and each bad file leaves a row in
    ``out/failed``. ``out/files`` lists the files that are done, so no file is scanned twice. An empty folder gives nothing.
    """
    def plain(path: str) -> Column:
        """A path as all readers write it."""
        return F.regexp_replace(path, "^file:/+", "file:/")

    def listed(path: str) -> DataFrame:
        try:
            return spark.read.schema("file string").parquet(path)
        except Exception:  # nothing is written yet
            return spark.createDataFrame([], "file string")

    def done(batch: DataFrame, to: str) -> None:
        scan(batch.drop("_file")).write.mode("overwrite").parquet(f"{out}/found/part={to}")

    def one(batch: DataFrame, number: int) -> None:
        seen = listed(f"{out}/files")
        fresh = batch.join(seen, F.col("_file") == F.col("file"), "left_anti") if seen.take(1) else batch
        try:
            done(fresh, str(number))
            fresh.select(F.col("_file").alias("file")).distinct().write.mode("append").parquet(f"{out}/files")
        except Exception:
            # Which files the batch has can't be asked of files that can't be read: all those of the folder that aren't done are tried.
            there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain("path").alias("file"))
            for r in there.join(seen, "file", "left_anti").orderBy("file").toLocalIterator():
                try:
                    done(spark.read.schema(schema).parquet(r.file).withColumn("_file", F.lit(r.file)), f"{number}-{hashlib.sha256(r.file.encode()).hexdigest()[:32]}")
                except Exception as e:  # the next files are still scanned; the failure is on record
                    spark.createDataFrame([(r.file, f"{type(e).__name__}: {e}"[:2000])], "file string, error string").write.mode("append").parquet(f"{out}/failed")
                spark.createDataFrame([(r.file,)], "file string").write.mode("append").parquet(f"{out}/files")

    stream = spark.readStream.schema(schema).parquet(folder).select("*", plain("_metadata.file_path").alias("_file"))
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
