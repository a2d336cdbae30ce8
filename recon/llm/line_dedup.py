"""Fuzzy line dedup by MinHash: one line of each group of near-equal lines stays.

Lines are compared by their sets of character shingles. MinHash signatures are cut into bands; lines that agree in a band are
candidates. A pair of candidates goes on if its signatures agree in enough minima, and is then verified exactly, once: every line
of a bucket against the bucket's first one, joined by union-find; then, where the other lines of a bucket are still in several
components, pairs across components, tile against tile, each in the first band that it shares. So no link that the signatures let
through is lost, and no bucket's pairs are listed.

Lines with one 64-bit hash (XXH64) count as equal; half a clash is expected among 2^32 distinct lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import tile_pairs
from .common import Kept, components, read, slices

#: Characters of a shingle; Jaccard similarity from which lines are near-equal; bands and their rows: at 0.8, 99.4 % share a band.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 13, 5
#: Minima that are compared before a pair is verified, and how many must agree: at 0.8 fewer do in one pair of ten thousand.
MARKED, AGREE = 64, 39
#: Lines and characters of a tile; characters that are signed at once; lines up to which their hashes are broadcast.
TILE, TILE_CHARS, SLICE, FEW = 512, 4_000_000, 65_536, 1_000_000
BLANKS = " \t\n\x0b\x0c\r"
_P = np.uint32(0x9E3779B1)
_SALTS = [(np.uint32(a), np.uint32(b)) for a, b in zip(np.random.default_rng(11).integers(1, 2**31, BANDS * ROWS) * 2 + 1, np.random.default_rng(12).integers(0, 2**32, BANDS * ROWS))]


def shingle_codes(lines: list[str]) -> list[np.ndarray]:
    """The set of shingles of each line as a sorted array of numbers, which are equal between these lines where the shingles are. A
    line shorter than a shingle has itself as its only one."""
    if not lines:
        return []
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(c) < 20_000:
        letters, ids = np.unique(c, return_inverse=True)
        n_letters = len(letters)
    else:
        present = np.zeros(0x110000, bool)
        present[c] = True
        n_letters, ids = int(present.sum()), (np.cumsum(present) - 1)[c]
    # Each line gets as many marks of its end as the longest shingle could need; they are no letter.
    length = np.maximum(size, SHINGLE)
    ends = np.cumsum(length)
    starts = ends - length
    x = np.zeros(int(ends[-1]), np.uint64)
    x[np.arange(len(c)) + np.repeat(starts - (np.cumsum(size) - size), size)] = ids.astype(np.uint64) + np.uint64(1)
    n, bits = len(x) - SHINGLE + 1, n_letters.bit_length()

    def joined(begin: int, end: int, width: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for k in range(begin, end):
            out = (out << np.uint64(width)) | x[k:k + n]
        return out

    if bits * SHINGLE <= 64:
        codes = joined(0, SHINGLE, bits)
    else:  # many letters: two halves, each numbered, make a number of their own
        half = SHINGLE // 2
        one, two = (np.unique(joined(a, z, 64 // (SHINGLE - half)), return_inverse=True)[1].astype(np.uint64) for a, z in ((0, half), (half, SHINGLE)))
        codes = (one << np.uint64(32)) | two
    out = []
    for a, z in zip(starts.tolist(), (ends - SHINGLE + 1).tolist()):
        own = np.sort(codes[a:z])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if z - a > 1 else own)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILAR`` or more."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared) >= SIMILAR


def _minima(pieces: list[str]) -> np.ndarray:
    """For each piece of a line the least of its shingles' hashes under each salt."""
    c = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    starts = ends - size
    n = len(c) - SHINGLE + 1
    h = np.zeros(n, np.uint32)
    for k in range(SHINGLE):
        h ^= c[k:k + n]
        h *= _P
        h ^= h >> np.uint32(15)
    # A shingle that would reach into the next piece counts as the first one of its own piece.
    h[(ends[:-1, None] - 1) - np.arange(SHINGLE - 1)] = h[starts[:-1], None]
    out, salted = np.empty((len(pieces), BANDS * ROWS), np.uint32), np.empty_like(h)
    for j, (a, s) in enumerate(_SALTS):
        np.bitwise_xor(h, s, out=salted)
        np.multiply(salted, a, out=salted)
        out[:, j] = np.minimum.reduceat(salted, starts)
    return out


def minima(lines: list[str]) -> np.ndarray:
    """The minima of each line. Lines are taken in slices of bounded size; a longer line is cut, and the least of its pieces holds."""
    out, pieces, first, n, room = [np.zeros((0, BANDS * ROWS), np.uint32)], [], [], 0, 0
    for line in lines:
        first.append(n)
        padded = line if len(line) >= SHINGLE else line + "\0" * (SHINGLE - len(line))
        for at in range(0, len(padded) - SHINGLE + 1, SLICE):
            pieces.append(padded[at:at + SLICE + SHINGLE - 1])
            n, room = n + 1, room + len(pieces[-1])
            if room >= SLICE:
                out.append(_minima(pieces))
                pieces, room = [], 0
    if pieces:
        out.append(_minima(pieces))
    return np.minimum.reduceat(np.concatenate(out), first, axis=0) if lines else out[0]


def bands(least: np.ndarray) -> np.ndarray:
    """A positive key for each band of each line: the band's number, which sorts first, and a 59-bit hash of its minima."""
    out = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ least[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = np.uint64(b << 59) | key >> np.uint64(5)
    return out


def marks(least: np.ndarray) -> np.ndarray:
    """The eight lowest bits of each of the first minima (the highest are zero: minima are small), eight minima to a number."""
    return np.ascontiguousarray(least[:, :MARKED]).astype(np.uint8).view(np.int64)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, line, line_id``: each line with a character that isn't blank, without blanks around it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "_raw"))
    rows = rows.select("doc_id", "text_hash", "line_no", F.btrim("_raw", F.lit(BLANKS)).alias("line"))
    return rows.where("line <> ''").withColumn("line_id", F.xxhash64("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """``lines`` with ``keys``, one for each band, and ``marks`` of the minima in the place of their text. Of lines that are equal in
    a batch of rows the first one is signed, the others have null."""
    rest = [c for c in lines.columns if c != "line"]

    def listed(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
        ends = np.zeros(n + 1, np.int32)
        ends[rows + 1] = values.shape[1]
        ends, none = np.cumsum(ends, dtype=np.int32), np.ones(n, bool)
        none[rows] = False
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()), mask=pa.array(none))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, rows = np.unique(b.column("line_id").to_numpy(), return_index=True)
            rows = np.sort(rows)
            least = minima(b.column("line").take(pa.array(rows)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), listed(bands(least), rows, b.num_rows), listed(marks(least), rows, b.num_rows)], [*rest, "keys", "marks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != "line")
    return lines.select(*rest, "line").mapInArrow(sign, f"{schema}, keys array<bigint>, marks array<bigint>")


def agreeing(a: Column, b: Column) -> Column:
    """How many of the minima behind two lines' ``marks`` agree: equal bytes of the numbers."""
    def differing(x: Column) -> Column:
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return F.lit(MARKED) - sum((differing(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(MARKED // 8)), F.lit(0))


def _side(table: DataFrame) -> DataFrame:
    """A table of some numbers a row, to be broadcast if a count finds it small."""
    return F.broadcast(table) if table.count() <= FEW else table


def verified(pairs: DataFrame) -> DataFrame:
    """``a, b`` of the rows of ``pairs(a, b, text_a, text_b)`` whose texts are similar."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for part in slices(batch, 4 * SLICE, 2, 3):
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                place = {t: k for k, t in enumerate(dict.fromkeys([*left, *right]))}
                sets = shingle_codes(list(place))
                keep += [similar(sets[place[t]], sets[place[u]]) for t, u in zip(left, right)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _agree(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of lines agree in enough of their marks."""
    mine, theirs = np.ascontiguousarray(one).view(np.uint8), np.ascontiguousarray(two).view(np.uint8)
    step = max(1, 4096 // max(1, len(theirs)))
    return np.concatenate([(mine[at:at + step, None] == theirs[None, :]).sum(axis=2) >= AGREE for at in range(0, len(mine), step)])


def _open_pairs(one: dict, two: dict, key: int, same: bool) -> np.ndarray:
    """Which pairs of two tiles are in different components, share this bucket first and agree enough in their marks."""
    pairs = one["component"][:, None] != two["component"][None, :]
    if same:
        pairs = np.triu(pairs, 1)
    for band in range(key >> 59):
        pairs &= one["keys"][:, band, None] != two["keys"][None, :, band]
    if not pairs.any():
        return pairs
    return pairs & _agree(one["marks"], two["marks"])


def tile_links(one: dict, two: dict, key: int, same: bool = False) -> list[tuple[int, int]]:
    """Index pairs of similar lines of two tiles of a bucket in different components, joining all that such pairs join; ``same``: the
    two are one tile. A tile is arrays of its lines' ``component``, ``keys`` and ``marks``, and a function ``line`` of places.

    Where many pairs of a tile have to be verified, shared shingles are counted for a line and the whole other tile at once, over the
    lines that each shingle is in.
    """
    pairs = _open_pairs(one, two, key, same)
    rows, columns, out = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0)), []
    if not len(rows):
        return []
    sets = shingle_codes(one["line"](rows) + two["line"](columns))
    label = np.concatenate([one["component"], two["component"]])
    ours, others, mine, theirs = sets[:len(rows)], sets[len(rows):], label[:len(pairs)], label[len(pairs):]
    many = pairs.sum() > 32 * len(columns)
    if many:
        flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), list(map(len, others)))
        order = np.argsort(flat, kind="stable")
        flat, owner, sizes = flat[order], owner[order], np.fromiter(map(len, others), np.int64, len(others))
    for own, i in zip(ours, rows.tolist()):
        left = np.flatnonzero(pairs[i, columns] & (theirs[columns] != mine[i]))
        if many and len(left) > 32:
            low = np.searchsorted(flat, own)
            n = np.searchsorted(flat, own, "right") - low
            met = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[met], minlength=len(sizes))
            left = left[(shared / (len(own) + sizes - shared))[left] >= SIMILAR]
        for k in left.tolist():
            j = int(columns[k])
            if theirs[j] != mine[i] and similar(own, others[k]):
                out.append((i, j))
                label[label == theirs[j]] = mine[i]
    return out


def _tiles(column: pa.ListArray) -> list[dict | None]:
    """The tiles of a column as arrays, by the fields that they have; None for null."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends, known = np.cumsum(size), column.is_valid().to_numpy(zero_copy_only=False)
    values = dict(zip([f.name for f in column.type.value_type], column.flatten().flatten()))
    wide = {c: values[c].flatten().to_numpy().reshape(len(values[c]), n) for c, n in (("keys", BANDS), ("marks", MARKED // 8)) if c in values}
    flat = {c: values[c].to_numpy() for c in ("line_id", "component") if c in values}

    def tile(a: int, z: int) -> dict:
        return {c: v[a:z] for c, v in (flat | wide).items()} | {"line": lambda at: values["line"].take(pa.array(a + at)).to_pylist()}

    return [tile(z - n, z) if ok else None for n, z, ok in zip(size.tolist(), ends.tolist(), known)]


def with_partners(buckets: DataFrame) -> DataFrame:
    """``key, line_id`` of the lines of ``buckets(key, m array<struct<line_id, marks>>)`` that agree enough with another of their bucket."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = [], []
            for key, tile in zip(batch.column(0).to_pylist(), _tiles(batch.column(1))):
                agree = _agree(tile["marks"], tile["marks"])
                np.fill_diagonal(agree, False)
                lines.append(tile["line_id"][agree.any(axis=1)])
                keys.append(np.full(len(lines[-1]), key, np.int64))
            flat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([flat(keys), flat(lines)], ["key", "line_id"])

    return buckets.select("key", "m").mapInArrow(look, "key bigint, line_id bigint")


def across(tiles: DataFrame) -> DataFrame:
    """``a, b``: links between lines of two tiles that are in different components, joining all that such similar pairs join."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for key, one, two in zip(batch.column(0).to_pylist(), _tiles(batch.column(1)), _tiles(batch.column(2))):
                for i, j in tile_links(one, two or one, key, same=two is None):
                    left.append(one["line_id"][i]), right.append((two or one)["line_id"][j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return tiles.select("key", "one", F.when(F.col("tile") != F.col("other"), F.col("two")).alias("two")).mapInArrow(compare, "a bigint, b bigint")


def line_classes(lines: DataFrame, signed: DataFrame, kept: Kept) -> DataFrame:
    """``node, component`` of the lines that are near-equal to another: the smallest line_id of their component. ``signed``: the kept
    table of the lines' ids, keys and marks, which is dropped when it is no longer read."""
    once = signed.where("keys is not null").select("line_id", "keys", "marks")
    keyed = once.select("line_id", F.explode("keys").alias("key"))
    shared = kept.keep(keyed.groupBy("key").agg(F.min("line_id").alias("first"), F.max("line_id").alias("last")).where("first <> last").select("key", "first"))
    members = kept.keep(keyed.join(_side(shared), "key").groupBy("key", "line_id").agg(F.first("first").alias("first")))
    wanted = members.select(F.col("line_id").alias("w")).distinct()
    marked = kept.keep(once.join(_side(kept.keep(wanted)), F.col("line_id") == F.col("w")).groupBy("line_id").agg(F.first("keys").alias("keys"), F.first("marks").alias("marks")))
    kept.drop(signed)

    pairs = members.where("line_id <> first").select(F.col("first").alias("a"), F.col("line_id").alias("b")).distinct()
    own = marked.select("line_id", "marks")
    pairs = pairs.join(own.toDF("a", "marks_a"), "a").join(own.toDF("b", "marks_b"), "b").where(agreeing(F.col("marks_a"), F.col("marks_b")) >= AGREE)
    pairs = kept.keep(pairs.select("a", "b"))
    # Beside the pairs, the other lines of a bucket may be similar to each other: those that agree with one of them. That is looked up
    # bucket by bucket up to a tile's size; of larger ones all lines are taken, and compared in tiles below.
    others = members.where("line_id <> first").select("key", "line_id")
    sizes = kept.keep(others.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small = others.join(sizes.where(F.col("n") <= TILE), "key").join(own, "line_id").groupBy("key").agg(F.collect_list(F.struct("line_id", "marks")).alias("m"))
    rest = kept.keep(with_partners(small).union(others.join(sizes.where(F.col("n") > TILE), "key").select("key", "line_id")))
    needed = kept.keep(pairs.select(F.col("a").alias("w")).union(pairs.select("b")).union(rest.select("line_id")).distinct())
    near = lines.select("line_id", "line").join(_side(needed), F.col("line_id") == F.col("w"), "left_semi")
    texts = kept.keep(near.groupBy("line_id").agg(F.min("line").alias("line")))

    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    links = kept.keep(verified(pairs.join(one, "a").join(two, "b").sortWithinPartitions("a")))
    parts = kept.keep(components(links, kept))

    placed = rest.join(parts, rest.line_id == parts.node, "left").select("key", "line_id", F.coalesce("component", "line_id").alias("component"))
    placed = placed.join(texts.select("line_id", F.length("line").alias("weight")), "line_id").withColumnRenamed("line_id", "id")
    numbered, met = tile_pairs(kept.keep(placed), kept, TILE, TILE_CHARS)
    body = texts.join(marked, "line_id")
    packed = numbered.join(body, F.col("id") == F.col("line_id")).groupBy("key", "tile").agg(F.collect_list(F.struct("line_id", "component", "keys", "marks", "line")).alias("m"))
    tiles = kept.keep(packed)
    both = met.join(tiles.withColumnRenamed("m", "one"), ["key", "tile"]).join(tiles.select("key", F.col("tile").alias("other"), F.col("m").alias("two")), ["key", "other"])
    found = kept.keep(across(both))
    # What was found joins components: their smallest lines are linked, and lines follow their component.
    part = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(side[0]))
    known = parts.select("node", "component")
    joints = found.join(known.select("node", F.struct("component").alias("a_")), F.col("a") == F.col("node"), "left").drop("node").join(known.select("node", F.struct("component").alias("b_")), F.col("b") == F.col("node"), "left").drop("node")
    joints = kept.keep(joints.select(F.col("a").alias("line_a"), F.col("b").alias("line_b"), part("a_").alias("a"), part("b_").alias("b")))
    over = kept.keep(components(joints.select("a", "b"), kept).toDF("c", "least"))
    loose = joints.select(F.explode(F.array(F.struct(F.col("line_a").alias("node"), F.col("a").alias("component")), F.struct(F.col("line_b").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.node", "x.component")
    nodes = known.union(loose).distinct()
    return kept.keep(nodes.join(over, F.col("component") == F.col("c"), "left").select("node", F.coalesce("least", "component").alias("component")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, copy, n_lines, n_kept, removed``: of each component of near-equal lines, and of equal ones, the first line
    by (doc_id, text, line number) stays, null doc_ids last. ``removed`` lists the others in order: ``line_no`` (from 0) and
    ``kept_doc``, the document whose line stays for it.

    Defined results: a null or blank text has no lines; blank lines are no lines and always stay; rows that repeat doc_id and text
    are returned each, numbered by ``copy``, and only the first keeps lines; an empty table gives none.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "lines")
    lines = lines_of(docs.select("doc_id", "text"))
    # Keys and marks are random numbers: dictionaries of them would be built in vain.
    each = kept.keep(signatures(lines), **{"parquet.enable.dictionary": "false", "compression": "lz4"})
    places = kept.keep(each.select("doc_id", "text_hash", "line_no", "line_id"))
    found = _side(line_classes(lines, each, kept))
    named = places.join(found, F.col("line_id") == F.col("node"), "left").select("doc_id", "text_hash", "line_no", F.coalesce("component", "line_id").alias("class"))
    named = kept.keep(named)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")
    first = kept.keep(named.groupBy("class").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "at"))
    judged = named.join(_side(first), "class", "left")
    # Copies of a row give a line twice at one place; they are one line here, and the copies are told apart below.
    gone = judged.where(F.col("at").isNotNull() & ~place.eqNullSafe(F.col("at"))).select("doc_id", "text_hash", F.struct("line_no", F.col("at.doc_id").alias("kept_doc")).alias("r"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("r")).alias("removed"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    counted = named.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_lines")).toDF("_d", "_h", "_lines")
    rows = rows.join(counted, rows.doc_id.eqNullSafe(counted["_d"]) & (rows.text_hash == counted["_h"]), "left")
    rows = rows.withColumn("n_lines", F.floor(F.coalesce("_lines", F.lit(0)) / F.col("copies")))
    g = gone.toDF("d", "h", "removed")
    rows = rows.join(g, rows.doc_id.eqNullSafe(g.d) & (rows.text_hash == g.h), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    none = F.array().cast("array<struct<line_no:int,kept_doc:bigint>>")
    removed = F.coalesce("removed", none)
    return rows.select("doc_id", "text_hash", "copy", "n_lines", F.when(F.col("copy") > 1, 0).otherwise(F.col("n_lines") - F.size(removed)).cast("bigint").alias("n_kept"), removed.alias("removed"))


def without_lines(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``judged`` removes taken out of its text; rows that repeat doc_id and text share the first's."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    j = judged.where("copy = 1").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.transform("removed", lambda r: r["line_no"]).alias("_gone"))
    rows = docs.join(j, docs.doc_id.eqNullSafe(j["_d"]) & (mark == j["_h"]), "left")
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return rows.withColumn("text", F.when(F.size("_gone") > 0, F.array_join(stay, "\n")).otherwise(F.col("text"))).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_kept, removed_lines, kept_docs`` over the whole table ``documents``: the numbers of the lines that go and,
    for each of them, the document whose line stays."""
    rows = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_kept", F.transform("removed", lambda r: r["line_no"]).alias("removed_lines"), F.transform("removed", lambda r: r["kept_doc"]).alias("kept_docs"))
