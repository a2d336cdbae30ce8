"""Token files: ids of whole texts in blocks of a static range asymmetric numeral system, in ascending order of doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import Kept, read
from .wordids import word_ids

#: Ids from which a block is closed, at the end of a document; ids that a task writes, about.
BLOCK_IDS, TASK_IDS = 1 << 20, 4_000_000


def tokens(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """``(doc_id, n, ids)``: the ids of each whole text and the end id, as little-endian unsigned 16-bit integers."""
    last = int(end).to_bytes(2, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [words.encode(t) + last for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, "doc_id bigint, n bigint, ids binary")


def frequencies(encoded: DataFrame, bits: int = 20) -> rans.Table:
    """The table of all ids of ``encoded``: at most 65,536 counts reach the driver, however many rows there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            raw, at = b.column(0).buffers()[2], np.frombuffer(b.column(0).buffers()[1], np.int32)[b.column(0).offset:][:b.num_rows + 1]
            n += np.bincount(np.frombuffer(raw, "<u2", (at[-1] - at[0]) // 2, int(at[0])), minlength=1 << 16) if b.num_rows and raw else 0
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return rans.Table.fit({r.id: r.n for r in rows}, bits)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, bits: int = 20, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``folder/blocks`` (``part, seq, n_ids, block``) and ``folder/table`` (``id, freq, bits``).

    Documents are in ascending order of (part, seq, place in the block): by doc_id, null first, rows that repeat one by their ids.
    The text is tokenized once; what is shuffled are two bytes an id.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "tokens")
    encoded = kept.keep(tokens(docs, tokenizer, end), compression="zstd")
    table = frequencies(encoded, bits)
    freq = table.freq.astype(np.int64)
    spark.createDataFrame([(int(i), int(freq[i]), bits) for i in np.flatnonzero(freq)], "id bigint, freq bigint, bits int").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)
    n = encoded.agg(F.sum("n")).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seq = rans.Table(shared.value, bits), TaskContext.get().partitionId(), 0
        ids, names, size = [], [], 0

        def closed() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u2")
            block = rans.encode(flat, np.array(names, np.int64), np.array([len(x) // 2 for x in ids]), t)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([block], pa.binary())], ["part", "seq", "n_ids", "block"])

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(x.as_py())
                names.append(rans.NULL if name is None else name)
                size += len(ids[-1]) // 2
                if size >= block_ids:
                    yield closed()
                    ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield closed()

    ordered = encoded.select("doc_id", "ids").repartitionByRange(max(1, -(-n // TASK_IDS)), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(pack, "part int, seq int, n_ids bigint, block binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    kept.drop(encoded)
    shared.unpersist()


def read_table(spark: SparkSession, folder: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{folder}/table").collect()
    freq = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return freq, rows[0].bits if rows else 20


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``; blocks are decoded in parallel.

    ``start`` counts the ids of all documents before it: the sizes of parts are summed first, then those of a part's blocks.
    """
    freq, bits = read_table(spark, folder)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema("part int, seq int, n_ids bigint, block binary").parquet(f"{folder}/blocks")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = rans.Table(shared.value, bits)
        for b in batches:
            for part, seq, block in zip(*(c.to_pylist() for c in b.columns)):
                docs, lengths, ids = rans.decode(block, t)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                cols = [
                    pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), seq, np.int32)), pa.array(docs, mask=docs == rans.NULL), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    columns = "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    each = blocks.select("part", "seq", "block").mapInArrow(unpack, columns)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    sizes = blocks.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inner"))
    place = sizes.join(before, "p").select("p", "s", (F.col("base") + F.col("inner")).alias("before"))
    found = each.join(place, (each.part == place.p) & (each.seq == place.s))
    return found.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def word_bpe() -> str:
    """The path of the public tokenizer that the query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of ``docs(doc_id, text)``, from the files written.

    Defined results: a null or empty text has the end id alone; a null doc_id comes first; rows that repeat a doc_id keep a row
    each; an empty table gives none; further columns are ignored.
    """
    spark = docs.sparkSession
    folder = Kept(spark, "token-files").root
    write_files(docs, folder, tokenizer or word_bpe())
    return read_files(spark, folder, with_ids=False)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` over the whole table ``documents``, read back from the token files."""
    return encoded_digest(read(spark, sf_dir, "documents"))
