"""Edit-aware token counts: a segment tree of pre-token counts for each document, of which an edit renews the touched leaves alone.

A text is cut before white space that follows other characters; the tokenizer never joins anything across such a place. A leaf is
some consecutive pieces. An edit changes the leaves it touches; if a border beside them is no such place any more, the leaf beyond
is their context and is encoded with them. Then the sums above the leaf are updated; all other leaves keep their counts. Places are
found by the sums of characters, so an edit looks at as many nodes as the tree is high.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices
from .wordids import _LETTERS_MARKS, _byte_alphabet

#: Characters from which a leaf is closed, at the end of a piece.
LEAF_CHARS = 512
_PIECES = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+").findall
_GLUE = re.compile(r"[\s\x1c-\x1f\x85]").match
TREE = "struct<chars:array<bigint>,tokens:array<bigint>>"
#: Characters of texts whose trees are made at once.
SLICE = 1_000_000
EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"


class PieceCounts:
    """Numbers of tokens of pieces with a byte-level tokenizer; one Python worker keeps ``room`` pieces and ``room`` runs at most."""

    def __init__(self, path: str, room: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.alphabet = Tokenizer.from_file(path), room, _byte_alphabet()
        self.pieces: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def _run(self, letters: str) -> int:
        n = len(self.tokenizer.model.tokenize("".join(map(self.alphabet.__getitem__, letters.encode()))))
        if len(self.runs) >= self.room:
            self.runs.clear()
        self.runs[letters] = n
        return n

    def _missing(self, piece: str) -> int:
        if m := _LETTERS_MARKS(piece, piece[:1] == " "):  # a blank goes with the letters behind it
            n = self.runs.get(letters := piece[:m.end(1)]) or self._run(letters)
            if m[2]:
                n += self.runs.get(m[2]) or self._run(m[2])
        else:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self.pieces) >= self.room:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get, missing = self.pieces.get, self._missing
        return [get(p) or missing(p) for p in pieces]


def piece_counts(path: str) -> PieceCounts:
    """The counter of this Python worker, which outlives a task."""
    held = sys.__dict__.setdefault("_recon_piece_counts", {})
    if path not in held:
        held[path] = PieceCounts(path)
    return held[path]


def pieces(text: str) -> list[str]:
    """The text cut where white space follows a character that no tokenizer takes for white space."""
    found, out = _PIECES(text), []
    for p in found:
        if out and _GLUE(out[-1][-1]):
            out[-1] += p
        else:
            out.append(p)
    return out


class Tree:
    """Two segment trees over the leaves of a text, in arrays: characters and tokens. Node ``i`` has ``2i`` and ``2i + 1`` below it; the
    second half of an array are the leaves, of which those without characters are free."""

    def __init__(self, chars: list[int], tokens: list[int], leaf_chars: int = LEAF_CHARS):
        self.chars, self.tokens, self.leaf_chars = list(chars), list(tokens), leaf_chars
        self.first = len(self.chars) // 2

    @classmethod
    def of(cls, text: str, counter: PieceCounts, leaf_chars: int = LEAF_CHARS) -> Tree:
        return cls([0, 0], [0, 0], leaf_chars)._built(cut(text, counter, leaf_chars))

    def _built(self, leaves: list[tuple[int, int]]) -> Tree:
        """Room for as many leaves again as there are in the lowest level at most; no text is encoded."""
        self.first = 1 << max(0, len(leaves) - 1).bit_length()
        for name, k in (("chars", 0), ("tokens", 1)):
            sums = [0] * self.first + [leaf[k] for leaf in leaves] + [0] * (self.first - len(leaves))
            for i in range(self.first - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
            setattr(self, name, sums)
        return self

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in zip(self.chars[self.first:], self.tokens[self.first:]) if x[0]]

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        for sums, value in ((self.chars, chars), (self.tokens, tokens)):
            i, change = self.first + leaf, value - sums[self.first + leaf]
            while i and change:
                sums[i] += change
                i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The first leaf that ends at a place or behind it, and where it begins: a border belongs to the leaf before it."""
        i, rest = 1, place
        while i < self.first:
            i *= 2
            if rest > self.chars[i]:
                rest -= self.chars[i]
                i += 1
        return i - self.first, place - rest

    def edit(self, text: str, start: int, removed: int, inserted: str, counter: PieceCounts) -> tuple[str, int, int]:
        """The text after the edit, and how many leaves and characters were encoded for it. Places beyond the text are its end.

        What the touched leaves hold then is cut into leaves anew, so none grows beyond a piece more than its size; if they are more
        than there were, the arrays are laid out again.
        """
        start = min(max(start, 0), len(text))
        end = min(start + max(removed, 0), len(text))
        new = text[:start] + inserted + text[end:]
        size = lambda leaf: self.chars[self.first + leaf]
        a, low = self.find(start)
        z, high = self.find(end)
        high += size(z) + len(new) - len(text)
        while a > 0 and not _safe(new, low):
            a -= 1
            low -= size(a)
        while z < self.first - 1 and not _safe(new, high):
            z += 1
            high += size(z)
        while high - low < self.leaf_chars // 2 and z < self.first - 1:  # what is left of leaves goes with the next one
            z += 1
            high += size(z)
        leaves = cut(new[low:high], counter, self.leaf_chars)
        touched = max(1, sum(size(leaf) > 0 for leaf in range(a, z + 1)))
        if len(leaves) <= z - a + 1:
            for k in range(a, z + 1):
                self.set(k, *(leaves[k - a] if k - a < len(leaves) else (0, 0)))
        else:
            known = list(zip(self.chars[self.first:], self.tokens[self.first:]))
            self._built([x for x in known[:a] if x[0]] + leaves + [x for x in known[z + 1:] if x[0]])
        return new, touched, high - low


def cut(text: str, counter: PieceCounts, leaf_chars: int) -> list[tuple[int, int]]:
    """Characters and tokens of the leaves of a text: consecutive pieces of about ``leaf_chars`` characters together."""
    ps = pieces(text)
    sizes = np.cumsum(np.fromiter(map(len, ps), np.int64, len(ps)))
    counts, out, before = counter.counts(ps), [], 0
    each = len(text) / max(1, round(len(text) / leaf_chars))  # leaves of about one size, none a small rest
    while before < len(ps):
        start = int(sizes[before - 1]) if before else 0
        end = min(len(ps), int(np.searchsorted(sizes, len(text) if len(text) - start < 1.5 * each else start + each)) + 1)
        out.append((int(sizes[end - 1]) - start, sum(counts[before:end])))
        before = end
    return out


def _safe(text: str, at: int) -> bool:
    """Whether the text may be cut at a place."""
    return at <= 0 or at >= len(text) or (text[at] in " \t\n\r\x0b\x0c" and not _GLUE(text[at - 1]))


def with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` with a column ``tree`` for its text; null for null."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(tokenizer)
        for b in batches:
            for part in slices(b, SLICE, b.schema.get_field_index("text")):
                trees = [None if t is None else Tree.of(t, counter) for t in part.column("text").to_pylist()]
                column = pa.array([t and {"chars": t.chars, "tokens": t.tokens} for t in trees], pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "tree"])

    rest = docs.drop("tree")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(build, f"{schema}, tree {TREE}")


def with_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs(doc_id, text, tree, edits)`` after its edits, in order: ``doc_id, text, tree, before, after, leaves, encoded_leaves,
    encoded_chars``. ``before`` and ``after`` are tokens of the whole text. A null text with edits counts as empty."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(tokenizer)
        for b in batches:
            for part in slices(b, SLICE, 1):
                rows = []
                for doc, text, tree, edits in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "tree", "edits"))):
                    t = Tree(tree["chars"], tree["tokens"]) if tree else Tree.of(text or "", counter)
                    before, leaves, chars = t.total, 0, 0
                    for e in edits or []:
                        text, n, c = t.edit(text or "", e["start"] or 0, e["removed"] or 0, e["inserted"] or "", counter)
                        leaves, chars = leaves + n, chars + c
                    rows.append((doc, text, {"chars": t.chars, "tokens": t.tokens}, before, t.total, len(t.leaves), leaves, chars))
                kinds = [part.schema.field("doc_id").type, part.schema.field("text").type, part.schema.field("tree").type, *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    names = ["doc_id", "text", "tree", "before", "after", "leaves", "encoded_leaves", "encoded_chars"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "tree", "edits").mapInArrow(apply, f"doc_id {kind}, text string, tree {TREE}, " + ", ".join(f"{c} bigint" for c in names[3:]))


def byte_bpe() -> str:
    """The path of a public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def derived_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with four edits each that its own id and length give: words put in, a cut, a replacement, and a joint of two words."""
    n = F.coalesce(F.length("text"), F.lit(0)) + 1
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n).cast("bigint")
    edit = lambda k, removed, inserted: F.struct(at(k).alias("start"), F.lit(removed).cast("bigint").alias("removed"), F.lit(inserted).alias("inserted"))
    return docs.withColumn("edits", F.array(edit(1, 0, " two words"), edit(2, 40, ""), edit(3, 3, "x, y"), edit(4, 1, "")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, n_after, n_leaves, encoded_leaves, encoded_chars, chars_after`` over the whole table ``documents``: tokens
    of the text, and of the text after the edits of ``derived_edits``, by re-encoding the touched leaves.

    Defined results: a null or empty text has no tokens and no leaf, and is edited as an empty one; repeated rows are counted each; an
    empty table gives none; further columns are ignored.
    """
    path = byte_bpe()
    docs = derived_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
    done = with_edits(with_trees(docs, path), path)
    return done.select("doc_id", F.col("before").alias("n_tokens"), F.col("after").alias("n_after"), F.col("leaves").alias("n_leaves"), "encoded_leaves", "encoded_chars", F.length("text").cast("bigint").alias("chars_after"))
