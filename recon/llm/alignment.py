"""Alignment of two tokenizers' tokens over the same bytes.

Byte-level BPE (A) sees a space and the text, piece BPE (B) adds that space itself. Both are cut into the bytes of their tokens. Per
batch of texts, an as-of merge by document gives each token of A the token of B that covers its start, and each token of B that of A;
together these are all pairs of tokens that overlap. Where tokens of both end, a group ends.

How often two ids are linked is counted over all texts; the counts go back to the texts in parts of bounded size: a part is broadcast
and all links are looked up in it. There are at most as many pairs as the vocabularies' product, whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, Places, read, slices
from .wordids import _byte_alphabet

#: Characters of texts that are aligned at once; pairs of ids of a part that is broadcast; links that are sorted at once.
ROOM, PART, HELD = 1_000_000, 2_000_000, 4_000_000
#: The split of a text before byte-level BPE: fixed values of the vocabulary's file format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"


class Sides:
    """Both tokenizers in one Python worker, with the ids of the words met so far, ``room`` of them at most.

    Neither joins tokens over a border between a word and the single space before the next one: the split of A begins a piece there, and
    no piece of B has a space behind another character. So the ids of a text are those of its words, each with the space before it;
    texts with other runs of spaces are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str, room: int = 300_000):
        import sentencepiece
        import tiktoken

        bytes_of = {c: b for b, c in _byte_alphabet().items()}
        with open(a_path, encoding="utf-8") as f:
            held = json.load(f)
        special = {x["content"] for x in held["added_tokens"]}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding(base64.b32encode(a_path.encode()).decode(), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = {i: x for x, i in ranks.items()}
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()
        self.a_len, self.b_len = self._lengths(self.a_bytes), self._lengths(self.b_bytes)
        self.names = [*(f"{i}{end}".encode() for end in ",|" for i in range(len(self.a_len))), *(f"{i}{end}".encode() for end in ",;" for i in range(len(self.b_len)))]
        self.words: dict[str, tuple[bytes, bytes | None]] = {}
        self.room, self.in_vain = room, 0

    @staticmethod
    def _lengths(of: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(of) + 1, np.int64)
        out[list(of)] = [len(x) for x in of.values()]
        return out

    def _both(self, text: str) -> tuple[bytes, bytes | None]:
        """The ids of one text on both sides as 16-bit numbers; None for B where the bytes are others."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        want = (" " + text).encode()
        same = b"".join(map(self.b_bytes.__getitem__, b)) == want and b"".join(map(self.a_bytes.__getitem__, a)) == want
        return np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes() if same else None

    def _missing(self, word: str) -> tuple[bytes, bytes | None]:
        both = self._both(word)
        if len(self.words) < self.room:
            if len(word) <= 64:
                self.words[word] = both
        else:
            self.in_vain += 1
            if self.in_vain > 4 * self.room:
                self.words.clear()
                self.in_vain = 0
        return both

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids of a text on both sides; none where it is null, empty, or the sides' bytes differ from the text's."""
        if not text:
            return b"", b""
        if "  " in text or text[0] == " " or text[-1] == " " or _SPACE in text:
            a, b = self._both(text)
            return (b"", b"") if b is None else (a, b)
        get, missing = self.words.get, self._missing
        parts = [get(w) or missing(w) for w in text.split(" ")]
        try:
            return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        except TypeError:
            return b"", b""


def sides(a_path: str, b_path: str) -> Sides:
    """The tokenizers of this Python worker, which outlive a task."""
    held = sys.__dict__.setdefault("_recon_sides", {})
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Sides(a_path, b_path)
    return held[a_path, b_path]


def overlaps(a_at: np.ndarray, a_doc: np.ndarray, b_at: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all tokens that overlap, by where they start: each start meets the token of the other side that covers it. Where
    both start at one byte, both directions give one pair, which counts once."""
    a = pd.DataFrame({"at": a_at, "doc": a_doc, "i": np.arange(len(a_at))})
    b = pd.DataFrame({"at": b_at, "doc": b_doc, "j": np.arange(len(b_at))})
    covering_b = pd.merge_asof(a, b, on="at", by="doc")["j"].to_numpy().astype(np.int64)
    covering_a = pd.merge_asof(b, a, on="at", by="doc")["i"].to_numpy().astype(np.int64)
    new = np.flatnonzero(a_at[covering_a] != b_at)
    return np.concatenate((a["i"].to_numpy(), covering_a[new])), np.concatenate((covering_b, new))


class Aligned:
    """The tokens of some texts on both sides, their links and their groups."""

    def __init__(self, both: list[tuple[bytes, bytes]], s: Sides):
        self.s = s
        self.a, self.b = (np.frombuffer(b"".join([x[k] for x in both]), "<u2").astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) // 2 for x in both], np.int64) for k in (0, 1))
        a_doc, b_doc = np.repeat(np.arange(len(both)), self.n_a), np.repeat(np.arange(len(both)), self.n_b)
        # Both sides of a text have the same bytes, so places in all texts together are comparable.
        a_end, b_end = np.cumsum(s.a_len[self.a]), np.cumsum(s.b_len[self.b])
        self.i, self.j = overlaps(a_end - s.a_len[self.a], a_doc, b_end - s.b_len[self.b], b_doc)
        order = np.argsort(np.maximum((a_end - s.a_len[self.a])[self.i], (b_end - s.b_len[self.b])[self.j]), kind="stable")
        self.i, self.j = self.i[order], self.j[order]
        self.n_links = np.bincount(a_doc[self.i], minlength=len(both))
        self.a_last, self.b_last = (np.flatnonzero(_among(x, y)) for x, y in ((a_end, b_end), (b_end, a_end)))  # last tokens of groups
        self.n_groups = np.bincount(a_doc[self.a_last], minlength=len(both))

    def pairs(self) -> np.ndarray:
        """The two ids of each link as one number, the links of each text together and in order."""
        return (self.a[self.i] << 16 | self.b[self.j]).astype("<u4")

    def digests(self) -> list[str]:
        """The SHA-256 of each text's groups, written out; nothing for a text without tokens."""
        group_a, group_b = (np.searchsorted(last, np.arange(len(x))) for last, x in ((self.a_last, self.a), (self.b_last, self.b)))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        width = len(self.s.a_len)
        ends = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends[0][self.a_last], ends[1][self.b_last] = 1, 1
        out[np.arange(len(self.a)) + np.concatenate(([0], self.b_last + 1))[group_a]] = self.a + width * ends[0]
        out[np.arange(len(self.b)) + (self.a_last + 1)[group_b]] = 2 * width + self.b + len(self.s.b_len) * ends[1]
        cuts, codes, name = np.cumsum(self.n_a + self.n_b).tolist(), out.tolist(), self.s.names.__getitem__
        return [hashlib.sha256(b"".join(map(name, codes[a:z]))[:-1]).hexdigest() if z > a else "" for a, z in zip([0, *cuts], cuts)]


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = np.searchsorted(y, x)
    return (at < len(y)) & (y[np.minimum(at, len(y) - 1)] == x) if len(y) else np.zeros(len(x), bool)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends, links_a, links_b`` of each text of ``docs(doc_id, text)``: its ids on both sides; after
    how many tokens of each side its groups end; and its links, as numbers of tokens from 0."""
    def listed(values: np.ndarray, n: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values.astype(np.int32)))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sides(a_path, b_path)
        for batch in batches:
            for part in slices(batch, ROOM, 1):
                x = Aligned([s.encode(t) for t in part.column(1).to_pylist()], s)
                first_a, first_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                yield pa.RecordBatch.from_arrays([
                    part.column(0), listed(x.a, x.n_a), listed(x.b, x.n_b), listed(x.a_last + 1 - np.repeat(first_a, x.n_groups), x.n_groups), listed(x.b_last + 1 - np.repeat(first_b, x.n_groups), x.n_groups),
                    listed(x.i - np.repeat(first_a, x.n_links), x.n_links), listed(x.j - np.repeat(first_b, x.n_links), x.n_links),
                ], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "links_a", "links_b"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(align, "doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, links_a array<int>, links_b array<int>")


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs`` of each text: figures of its alignment, and the id pairs of its
    links as little-endian 32-bit numbers."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, row = sides(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, ROOM, 1):
                x = Aligned([s.encode(t) for t in part.column(1).to_pylist()], s)
                raw, cuts = x.pairs().tobytes(), (4 * np.cumsum(x.n_links)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + part.num_rows)), part.column(0), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.digests(), pa.string()), pa.array([raw[a:z] for a, z in zip([0, *cuts], cuts)], pa.binary()),
                ], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
                row += part.num_rows

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(align, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary")


def _pairs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4")


def pair_counts(each: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links of ``each(pairs)`` hold a pair of ids, and whether no pair of its id of B is held by more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sums() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            held.append(_pairs_of(batch.column(0)))
            size += len(held[-1])
            if size >= HELD:
                yield sums()
                held, size = [], 0
        if size:
            yield sums()

    counted = each.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFF)))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    # At most as many rows as B has ids.
    return counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def looked_up(each: DataFrame, counted: DataFrame, kept: Kept, part: int = PART) -> DataFrame:
    """``row, n_best, count_sum`` of each row of ``each(row, pairs)``: its links of best pairs, and the sum of its links' counts."""
    spark, n = each.sparkSession, counted.count()
    parts, found = max(1, -(-n // part)), None
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(parts)).cast("int"))
    for k in range(parts):
        own = dealt.where(F.col("part") == k).select("pair", "n", "best").toArrow()
        place = Places(own.column(0).to_numpy())
        shared = spark.sparkContext.broadcast((place.mask, place.keys, place.at, np.append(own.column(1).to_numpy(), 0), np.append(own.column(2).to_numpy(), False)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place = object.__new__(Places)
            place.mask, place.keys, place.at, n, best = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    size = np.array([len(x.as_buffer()) // 4 for x in some.column(1)])
                    got = place.find(_pairs_of(some.column(1)))  # -1, of other parts, counts nothing
                    ends = np.cumsum(size)
                    sums = [np.diff(np.concatenate(([0], np.cumsum(x[got].astype(np.int64))))[np.concatenate(([0], ends))]) for x in (best, n)]
                    yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

        got = kept.keep(each.select("row", "pairs").mapInArrow(look, "row bigint, n_best bigint, count_sum bigint"))
        found = got if found is None else found.union(got)
        shared.unpersist()
    return found if parts == 1 else found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def byte_bpe() -> str:
    """The path of the public tokenizer A that the query names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    """The path of the public tokenizer B that the query names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def alignment_figures(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, part: int = PART) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs(doc_id, text)``.

    Defined results: a text that is null or empty, or whose tokens' bytes are not a space and the text, has zeros and no digest, and
    counts for no pair; rows that repeat are returned as often as given and count as often; a null doc_id keeps its row; an empty table
    gives none; further columns are ignored.
    """
    kept = Kept(docs.sparkSession, "alignment")
    each = kept.keep(linked(docs, a_path or byte_bpe(), b_path or piece_bpe()), **{"compression": "zstd", "parquet.enable.dictionary": "false"})
    counted = kept.keep(pair_counts(each))
    sums = looked_up(each, counted, kept, part)
    return each.drop("pairs").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the alignment of two public tokenizers over the whole table ``documents``."""
    return alignment_figures(read(spark, sf_dir, "documents"))
