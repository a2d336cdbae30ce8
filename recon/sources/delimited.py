"""CSV files of any size and encoding: pieces of one file are read in parallel, line breaks in quotes included.

Whether a line begins inside a quoted field depends on all lines before it. Each piece of a file is therefore read once for both cases: what
it makes of a beginning outside, and inside, a field. These answers, two bits a piece, are chained along the file; then each piece is cut
into records from its true beginning, and only records that reach over a border between pieces are put together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "cp949")
#: What is taken where no encoding fits.
LOSSY = "utf-8 with replacements"
_COMMA, _RETURN = b",\r"


def quoted_after(line: bytes, inside: bool) -> bool:
    """Whether the next line begins inside a quoted field, by the rules of Python's ``csv``: a quote opens a field at its beginning alone,
    two quotes in a field are one, and what follows a closing quote is plain."""
    if b'"' not in line:
        return inside
    # What stands between two quotes matters by its last byte alone.
    state = "quoted" if inside else "begin"
    for k, part in enumerate(line.split(b'"')):
        if k:
            state = "closing" if state == "quoted" else "quoted" if state != "plain" else state
        if part and state != "quoted":
            state = "begin" if part[-1] in (_COMMA, _RETURN) else "plain"
    return state == "quoted"


def lines_of(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``path, block, line`` of all files of a folder: bytes up to each line feed, and the place in the file where the piece begins that
    they were read with. Within a task lines come in their order."""
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _pieces(batches: Iterator[pa.RecordBatch], begin, add, end) -> Iterator[pa.RecordBatch]:
    """Walks over the lines of a task, piece by piece."""
    at = None
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:2] != at:
                out += end(at) if at else []
                at = row[:2]
                begin(row)
            out += add(row)
        yield out
    yield end(at) if at else []


def pieces(lines: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """``path, block, inside, owner, encoding`` of each piece: whether it begins inside a quoted field, in which piece the record began
    that is open there, and the first of ``encodings`` that takes the whole file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def begin(row: tuple) -> None:
            # For both beginnings: inside a field now, and whether a record began in this piece.
            state.update(now=[False, True], began=[False, False], fits=[True] * len(encodings))

        def add(row: tuple) -> list:
            for k in (0, 1):
                state["began"][k] |= not state["now"][k]
                state["now"][k] = quoted_after(row[2], state["now"][k])
            for k, e in enumerate(encodings):
                state["fits"][k] = state["fits"][k] and _fits(row[2], e)
            return []

        def end(at: tuple) -> list:
            return [(*at, state["now"], state["began"], state["fits"])]

        for out in _pieces(batches, begin, add, end):
            kinds = (pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "block", "now", "began", "fits"])

    each = lines.mapInArrow(read, "path string, block bigint, now array<boolean>, began array<boolean>, fits array<boolean>")
    # A file has a piece in 128 MB, so its pieces are one small group.
    chain = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "now", "began", "fits"))).alias("ps"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("bigint").alias("owner"), F.array().cast("array<struct<block:bigint,inside:boolean,owner:bigint>>").alias("out"))

    def step(s, p):
        k = F.when(s["inside"], 1).otherwise(0)
        return F.struct(F.get(p["now"], k).alias("inside"), F.when(F.get(p["began"], k), p["block"]).otherwise(s["owner"]).alias("owner"), F.concat(s["out"], F.array(F.struct(p["block"].alias("block"), s["inside"].alias("inside"), s["owner"].alias("owner")))).alias("out"))

    def all_fit(k: int):
        return F.forall("ps", lambda p: F.get(p["fits"], F.lit(k)))

    fits = [all_fit(k) for k in range(len(encodings))]
    encoding = F.coalesce(*[F.when(f, F.lit(e)) for f, e in zip(fits, encodings)], F.lit(LOSSY))
    return chain.select("path", encoding.alias("encoding"), F.explode(F.aggregate("ps", start, step, lambda s: s["out"])).alias("p")).select("path", "p.block", "p.inside", "p.owner", "encoding")


def _fits(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def records(spark: SparkSession, folder: str, pattern: str = "*.csv", encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """``path, block, seq, sub, values, encoding``: the records of all CSV files of a folder, as Python's ``csv`` reads the whole files; in a
    file they are in the order of (block, seq, sub)."""
    lines = lines_of(spark, folder, pattern)
    known = pieces(lines, encodings)
    # A row for each 128 MB of files.
    begun = lines.join(F.broadcast(known), ["path", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def begin(row: tuple) -> None:
            state.update(inside=row[3], open=[], seq=0, owner=row[4] if row[3] else row[1], encoding=row[5], first=row[3])

        def add(row: tuple) -> list:
            state["open"].append(row[2])
            state["inside"] = quoted_after(row[2], state["inside"])
            return [] if state["inside"] else flush(row)

        def flush(row: tuple) -> list:
            # The rest of a record of an earlier piece bears the name that its beginning has there.
            text, head = b"\n".join(state["open"]), state["first"]
            out = [(row[0], state["owner"] if head else row[1], None if head else state["seq"], row[1], text, state["encoding"])]
            state.update(open=[], seq=state["seq"] + (not head), first=False)
            return out

        def end(at: tuple) -> list:
            if not state["open"]:
                return []
            return [(at[0], state["owner"] if state["first"] else at[1], None, at[1], b"\n".join(state["open"]), state["encoding"])]

        for out in _pieces(batches, begin, add, end):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "block", "seq", "piece", "text", "encoding"])

    schema = "path string, block bigint, seq bigint, piece bigint, text binary, encoding string"
    every = begun.select("path", "block", "line", "inside", "owner", "encoding").mapInArrow(cut, schema)
    # Of records over a border, one a piece: the last of the piece that it began in.
    whole = every.where("seq is not null").select("path", "block", "seq", "text", "encoding")
    over = every.where("seq is null").groupBy("path", "block", "encoding").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("t"))
    joined = F.aggregate("t", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["text"]).otherwise(F.concat(a, F.lit(b"\n"), x["text"])))
    rows = whole.unionByName(over.select("path", "block", F.lit((1 << 62)).cast("bigint").alias("seq"), joined.alias("text"), "encoding"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for b in batches:
            out: list[tuple] = []
            for path, block, seq, text, encoding in zip(*(c.to_pylist() for c in b.columns)):
                string = text.decode("utf-8", "replace") if encoding == LOSSY else text.decode(encoding if block == 0 and seq == 0 else encoding.removesuffix("-sig"))
                out += [(path, block, seq, k, values, encoding) for k, values in enumerate(csv.reader(io.StringIO(string, newline="")))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "block", "seq", "sub", "values", "encoding"])

    return rows.mapInArrow(parse, "path string, block bigint, seq bigint, sub int, `values` array<string>, encoding string")


def csv_tables(spark: SparkSession, folder: str, pattern: str = "*.csv", encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """``path, block, seq, sub, header, values, encoding``: the rows of CSV files below their first record, which names the columns.

    Columns without a name are left out, as are rows of blank cells; cells that a row lacks are null. Defined results: an empty file, or one
    with a header alone, has no rows; rows that repeat are returned as often as given; a file that no encoding takes is read with marks of
    replacement and says so.
    """
    every = records(spark, folder, pattern, encodings)
    named = F.filter(F.transform("values", lambda v, i: F.struct(F.trim(v).alias("name"), i.alias("at"))), lambda x: x["name"] != "")
    head = every.groupBy("path").agg(F.min_by("values", F.struct("block", "seq", "sub")).alias("values"), F.min(F.struct("block", "seq", "sub")).alias("first"))
    head = head.select("path", "first", named.alias("columns"))
    below = every.join(head, "path").where(F.struct("block", "seq", "sub") > F.col("first"))
    some = below.where(F.exists("values", lambda v: v.rlike(r"\S")))
    return some.select("path", "block", "seq", "sub", F.transform("columns", lambda c: c["name"]).alias("header"), F.transform("columns", lambda c: F.get("values", c["at"])).alias("values"), "encoding")
