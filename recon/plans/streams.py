"""Queries that read the driver's tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.learn import learn_stream
from .common import Book, read

BOOK = Book()


@BOOK.add("SELECT l_returnflag AS key, l_linestatus AS code, count(*) AS n FROM lineitem GROUP BY ALL")
def stream_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of codes by key, learned from a stream of files."""
    schema = read(spark, sf_dir, "lineitem").schema
    return learn_stream(spark, sf_dir, "lineitem.parquet", schema, "l_returnflag", "l_linestatus")
