"""Documents in bulk: a folder of files becomes tables of chunks and cells, keyed by document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "doc_id string, section_no int, chunk_no int, kind string, text string, error string"


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, modificationTime, length, suffix, supported`` of every file below a folder, lock files left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(~name.startswith("~$")).withColumn("suffix", suffix).withColumn("supported", suffix.isin(*suffixes))


def chunks(spark: SparkSession, folder: str, pattern: str = "*.hwpx") -> DataFrame:
    """Paragraphs and tables of all zipped XML documents of a folder, in the order of sections by number; an outer table stands before
    those in its cells, and its cells are without their text. A file that can't be read gives one row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(_sections(content))
                except Exception as e:  # one file doesn't end the run
                    rows = [(None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame([(path, *r) for r in rows], columns=["doc_id", "section_no", "chunk_no", "kind", "text", "error"])

    return files.mapInPandas(parse, CHUNKS)


def _sections(content: bytes) -> Iterator[tuple]:
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def text(e, within: bool = False) -> str:
        if local(e) == "tbl" and within:
            return ""
        return (e.text or "" if local(e) == "t" else "") + "".join(text(c, True) for c in e)

    def table(e) -> Iterator[tuple[str, str]]:
        rows = [[text(cell) for cell in row if local(cell) == "tc"] for row in e if local(row) == "tr"]
        escaped = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        yield "table", "<table>" + "".join("<tr>" + "".join(f"<td>{escaped(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        yield from tables(e)

    def walk(e) -> Iterator[tuple[str, str]]:
        for c in e:
            if local(c) == "tbl":
                yield from table(c)
            elif local(c) == "p":
                if t := text(c).strip():
                    yield "text", t
                yield from tables(c)
            else:
                yield from walk(c)

    def tables(e) -> Iterator[tuple[str, str]]:
        for c in e:
            yield from table(c) if local(c) == "tbl" else tables(c)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.search(r"section(\d+)\.xml$", n)))
        for no, name in found:
            for k, (kind, t) in enumerate(walk(ElementTree.fromstring(z.read(name)))):
                yield no, k, kind, t, None


def unescaped(x: Column) -> Column:
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(c))
    return x


def table_cells(tables: DataFrame, markup: str, row_tag: str = "tr", cell_tags: str = "td|th") -> DataFrame:
    """``tables`` without their markup, exploded to ``row_no, col_no, value``: tags stripped, entities resolved, white space trimmed."""
    rest = [c for c in tables.columns if c != markup]
    rows = tables.select(*rest, F.posexplode(F.regexp_extract_all(markup, F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))).alias("row_no", "_row"))
    cells = rows.select(*rest, "row_no", F.posexplode(F.regexp_extract_all("_row", F.lit(rf"(?is)<(?:{cell_tags})\b[^>]*>(.*?)</(?:{cell_tags})>"), F.lit(1))).alias("col_no", "_cell"))
    return cells.select(*rest, "row_no", "col_no", F.trim(unescaped(F.regexp_replace("_cell", "(?s)<[^>]*>", ""))).alias("value"))


def csv_lines(spark: SparkSession, folder: str, encodings: tuple[str, ...] = ("utf-8-sig", "cp949")) -> DataFrame:
    """``path, line_no, line, encoding`` of all CSV files of a folder, decoded by the first encoding that takes the whole file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for encoding in encodings:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text, encoding = content.decode("utf-8", "replace"), "utf-8 with replacements"
                lines = [x for x in text.splitlines() if x.strip(" ,")]
                yield pd.DataFrame({"path": path, "line_no": range(len(lines)), "line": lines, "encoding": encoding})

    return files.mapInPandas(decode, "path string, line_no long, line string, encoding string")


def layout(heads: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """``doc_id, layout``: the first layout all of whose words the first rows of a document hold. ``heads(doc_id, text)``."""
    joined = heads.groupBy("doc_id").agg(*[F.bool_or(F.contains(F.regexp_replace("text", " ", ""), F.lit(w))).alias(f"_{k}_{i}") for k, ws in keywords.items() for i, w in enumerate(ws)])
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        ok = F.lit(True)
        for i in range(len(keywords[k])):
            ok = ok & F.col(f"_{k}_{i}")
        out = F.when(ok, k).otherwise(out)
    return joined.select("doc_id", out.alias("layout"))
