"""MinHash near-duplicates of documents by HyperMinHash: registers of leading zeros and some further bits stand for minima.

A shingle falls into one bucket of a document's sketch, by its hash; a bucket keeps its least hash. A bucket that no shingle fell into
keeps the least hash of all shingles under a hash function of its own instead, and a mark of that. So each bucket of two documents is
equal with the probability of their Jaccard similarity, however few shingles they have. Of a minimum, a register of 16 bits keeps the
mark, the number of leading zeros (5 bits) and the ten bits behind the first one.

Bands of four registers make candidates. The share of equal registers, less the share that is equal by chance, estimates the
similarity of a pair; what is near enough is verified on the full sets of shingles. Documents of one set are one class from the start.
Each class is verified against its nearest among the first ones of its buckets. Buckets that then still hold several components are
compared tile against tile: sketches first, full sets of those that have a partner by their sketches. No link between classes that share
a band is lost by that but for two of ten million; two sets at 0.85 share no band in four of ten million cases.

Shingles are 64-bit hashes (XXH64), sets are 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import tile_pairs
from .collocations import mixed
from .common import Kept, components, read
from .simhash_dedup import shingle_hashes

#: Links from this many hundredths of similarity; bands and registers of a band; leading zeros and further bits of a register.
HUNDREDTHS, BANDS, ROWS, ZEROS, FURTHER = 85, 20, 4, 5, 10
REGISTERS = BANDS * ROWS
#: A pair goes on from this estimate: at 0.85, two pairs of ten million are estimated lower.
ESTIMATED = 0.62
#: Members of a tile, and shingles of a tile of full sets; hashes that are sketched at once.
TILE, ROOM, AT_ONCE = 512, 2_000_000, 1 << 20
_MASK = np.uint64((1 << FURTHER) - 1)
_SALTS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Minima of 64 bits as registers; ``filled``: the mark of those whose bucket was empty."""
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    zeros = np.minimum(53 - np.frexp(top)[1], (1 << ZEROS) - 1).astype(np.uint64)
    further = (least << zeros << np.uint64(1)) >> np.uint64(64 - FURTHER)
    return (filled.astype(np.uint16) << np.uint16(ZEROS + FURTHER)) | (zeros << np.uint64(FURTHER) | further & _MASK).astype(np.uint16)


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each run of hashes, in runs ``offsets[i]:offsets[i + 1]``; no run is empty."""
    n = len(offsets) - 1
    z = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    bucket = ((z >> np.uint64(40)) * np.uint64(REGISTERS)) >> np.uint64(24)
    least = np.full(n * REGISTERS, np.uint64(2**64 - 1))
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    np.minimum.at(least, row * REGISTERS + bucket.astype(np.int64), mixed(z))
    least = least.reshape(n, REGISTERS)
    filled = least == np.uint64(2**64 - 1)
    for i in np.flatnonzero(filled.any(axis=1)).tolist():
        own, empty = z[offsets[i]:offsets[i + 1]], np.flatnonzero(filled[i])
        least[i, empty] = mixed(own[:, None] ^ _SALTS[None, empty]).min(axis=0)
    return registers(least, filled)


def by_chance() -> np.ndarray:
    """``[i, j]``: the share of registers that are equal by chance in sketches of ``2 ** (i / 2)`` and ``2 ** (j / 2)`` shingles."""
    zeros, further = np.meshgrid(np.arange(1 << ZEROS), np.arange(1 << FURTHER), indexing="ij")
    low = np.ldexp((1 << FURTHER) + further, -(zeros + 1 + FURTHER)).ravel()
    high = np.ldexp((1 << FURTHER) + further + 1, -(zeros + 1 + FURTHER)).ravel()
    shares = []
    for i in range(72):
        n = 2.0 ** (i / 2)
        each = n / REGISTERS  # of a bucket, if shingles fall evenly
        fell = np.exp(-each * low) - np.exp(-each * high)
        none = np.exp(-each) * (np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-12))))
        shares.append(np.concatenate((fell, none)))
    shares = np.array(shares)
    return shares @ shares.T


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches, row by row: equal registers, less those by chance."""
    kind = lambda n: np.rint(2 * np.log2(n)).astype(np.int64)
    e = chance[kind(n_a), kind(n_b)]
    return ((a == b).mean(axis=-1) - e) / (1 - e)


def similar(a: np.ndarray, b: np.ndarray, hundredths: int = HUNDREDTHS) -> bool:
    """Whether two sorted sets have that similarity, in whole numbers."""
    if 100 * min(len(a), len(b)) < hundredths * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= hundredths * (len(a) + len(b) - shared)


def _sets(column: pa.ListArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sorted distinct hashes of the rows of a column, some rows at once; the first row of each."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        end, out = min(end, len(column)), []
        for a, z in zip(offsets[at:end].tolist(), offsets[at + 1:end + 1].tolist()):
            own = np.sort(values[a:z])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        yield at, out
        at = end


def digest(own: np.ndarray) -> bytes:
    """128 bits of a set; none of an empty one."""
    return b"".join(int(mixed(own ^ np.uint64(s)).sum(dtype=np.uint64)).to_bytes(8, "big") for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)) if len(own) else b""


def signed(docs: DataFrame, n: int = 3) -> DataFrame:
    """``(doc_id, text_hash, id, n, sketch)`` of each text: the digest of its set of shingles, how many they are, and their registers."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b.column(2)):
                full = [x for x in sets if len(x)]
                drawn = iter(sketches(np.concatenate(full), np.cumsum([0, *map(len, full)])) if full else ())
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(sets)), b.column(1).slice(at, len(sets)), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([next(drawn).astype("<u2").tobytes() if len(x) else b"" for x in sets], pa.binary()),
                ], ["doc_id", "text_hash", "id", "n", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), shingle_hashes(F.col("text"), n).alias("h"))
    return rows.mapInArrow(sign, "doc_id bigint, text_hash bigint, id binary, n bigint, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int = 3) -> DataFrame:
    """``(id, hashes)`` of the texts of ``docs`` that ``wanted(id, doc_id, text_hash)`` names: sorted little-endian 64-bit numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["id", "hashes"])

    w = wanted.select("id", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = rows.join(w, (F.col("text_hash") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return rows.select("id", shingle_hashes(F.col("text"), n).alias("h")).mapInArrow(cut, "id binary, hashes binary").groupBy("id").agg(F.first("hashes").alias("hashes"))


def keyed(classes: DataFrame) -> DataFrame:
    """``(key, id)`` of each band of each class; a key's lowest five bits are the band's number."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = _flat(b.column(1), "<u8", BANDS)
            key = mixed(bands ^ mixed(np.arange(1, BANDS + 1, dtype=np.uint64))) & ~np.uint64(31) | np.arange(BANDS, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], ["key", "id"])

    return classes.select("id", "sketch").mapInArrow(cut, "key bigint, id binary")


def _flat(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of binaries of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def estimated(pairs: DataFrame, chance: np.ndarray) -> DataFrame:
    """``(a, b, near)`` of ``pairs(a, b, n_a, n_b, sketch_a, sketch_b)`` that may be similar, with their estimates."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, n_b = b.column(2).to_numpy(), b.column(3).to_numpy()
            near = estimates(*(_flat(b.column(k), "<u2", REGISTERS) for k in (4, 5)), n_a, n_b, chance)
            on = pa.array((near >= ESTIMATED) & (100 * np.minimum(n_a, n_b) >= HUNDREDTHS * np.maximum(n_a, n_b)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], ["a", "b", "near"]).filter(on)

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(look, "a binary, b binary, near double")


def verified(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of ``pairs(a, b, hashes_a, hashes_b)`` whose sets are similar."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "hashes_a", "hashes_b").mapInArrow(check, "a binary, b binary")


def _open_pairs(one: dict, two: dict, key: int, same: bool, chance: np.ndarray) -> np.ndarray:
    """Which pairs of two tiles are of different components, share this band first and may be similar by their sketches."""
    pairs = one["component"][:, None] != two["component"][None, :]
    if same:
        pairs &= np.tri(len(pairs), k=-1, dtype=bool).T
    pairs &= 100 * np.minimum(one["n"][:, None], two["n"][None, :]) >= HUNDREDTHS * np.maximum(one["n"][:, None], two["n"][None, :])
    for band in range(key & 31):
        if not pairs.any():
            return pairs
        pairs &= one["sketch"].view("<u8")[:, band, None] != two["sketch"].view("<u8")[None, :, band]
    i, j = np.nonzero(pairs)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        pairs[x, y] = estimates(one["sketch"][x], two["sketch"][y], one["n"][x], two["n"][y], chance) >= ESTIMATED
    return pairs


def _tiles(column: pa.ListArray) -> Iterator[dict]:
    """The tiles of a column, with their members' fields as arrays or lists; components as numbers that are equal where they are."""
    values, offsets = column.values, column.offsets.to_numpy().tolist()
    fields = {f.name: values.field(f.name) for f in values.type}
    for a, z in zip(offsets[:-1], offsets[1:]):
        own = {c: v.slice(a, z - a) for c, v in fields.items()}
        yield {
            "id": own["id"].to_pylist(), "component": np.array([int.from_bytes(x[:8], "big") for x in own["component"].to_pylist()], np.uint64), "n": own["n"].to_numpy(), "sketch": _flat(own["sketch"], "<u2", REGISTERS),
        } | ({"sets": [np.frombuffer(x.as_buffer(), "<u8") for x in own["hashes"]]} if "hashes" in own else {})


def with_partners(met: DataFrame, chance: np.ndarray) -> DataFrame:
    """``(key, id)`` of the members of two tiles that may be similar to one of another component."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for key, one, two, same in zip(b.column(0).to_pylist(), _tiles(b.column(1)), _tiles(b.column(2)), b.column(3).to_pylist()):
                pairs = _open_pairs(one, two, key, same, chance)
                own = {one["id"][i] for i in np.flatnonzero(pairs.any(axis=1))} | {two["id"][j] for j in np.flatnonzero(pairs.any(axis=0))}
                ids += own
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["key", "id"])

    return met.mapInArrow(look, "key bigint, id binary").distinct()


def across(met: DataFrame, chance: np.ndarray) -> DataFrame:
    """``(a, b)``: links between members of two tiles of different components, joining all that such similar pairs join."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for key, one, two, same in zip(b.column(0).to_pylist(), _tiles(b.column(1)), _tiles(b.column(2)), b.column(3).to_pylist()):
                label = np.concatenate((one["component"], two["component"]))
                n = len(one["id"])
                pairs = _open_pairs(one, two, key, same, chance)
                for i in np.flatnonzero(pairs.any(axis=1)).tolist():
                    for j in np.flatnonzero(pairs[i]).tolist():
                        if label[i] != label[n + j] and similar(one["sets"][i], two["sets"][j]):
                            left.append(one["id"][i]), right.append(two["id"][j])
                            label[label == label[n + j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return met.mapInArrow(compare, "a binary, b binary")


def _packed(numbered: DataFrame, pairs: DataFrame, bodies: DataFrame, kept: Kept) -> DataFrame:
    """``(key, one, two, same)``: the pairs of tiles with their members' ``bodies(id, ...)``."""
    names = [c for c in bodies.columns if c != "id"]
    tiles = kept.keep(numbered.join(bodies, "id").groupBy("key", "tile").agg(F.collect_list(F.struct("id", "component", *names)).alias("m")))
    met = pairs.join(tiles.withColumnRenamed("m", "one"), ["key", "tile"]).join(tiles.select("key", F.col("tile").alias("other"), F.col("m").alias("two")), ["key", "other"])
    return met.select("key", "one", "two", (F.col("tile") == F.col("other")).alias("same"))


def links(docs: DataFrame, classes: DataFrame, kept: Kept, tile: int = TILE, room: int = ROOM) -> DataFrame:
    """``(a, b)``: similar pairs of ``classes(id, n, sketch, doc_id, text_hash)`` that join all that the similar ones that share a band join."""
    chance = by_chance()
    keys = keyed(classes)
    shared = kept.keep(keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first"))
    members = kept.keep(keys.join(shared, "key"))
    body = classes.select("id", "n", "sketch")
    pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(body.toDF("a", "n_a", "sketch_a"), "a").join(body.toDF("b", "n_b", "sketch_b"), "b")
    nearest = kept.keep(estimated(pairs, chance).groupBy("b").agg(F.max(F.struct("near", "a")).alias("x")).select("x.a", "b"))
    needed = members.select("id").distinct()
    sets = kept.keep(full_sets(docs, classes.join(needed, "id", "left_semi")), **{"parquet.enable.dictionary": "false"})
    one, two = sets.toDF("a", "hashes_a"), sets.toDF("b", "hashes_b")
    star = kept.keep(verified(nearest.join(one, "a").join(two, "b")))
    parts = kept.keep(components(star, kept))

    placed = members.select("key", "id").join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = kept.keep(placed)
    numbered, met = tile_pairs(placed.withColumn("weight", F.lit(1)), kept, tile, room)
    some = kept.keep(with_partners(_packed(numbered, met, body, kept), chance))
    rest = kept.keep(placed.join(some, ["key", "id"], "left_semi").join(body.select("id", F.col("n").alias("weight")), "id"))
    numbered, met = tile_pairs(rest, kept, tile, room)
    found = kept.keep(across(_packed(numbered, met, body.join(sets, "id"), kept), chance))
    kept.drop(sets, members, placed)
    return star.union(found)


def near_duplicates(docs: DataFrame, n: int = 3, tile: int = TILE, room: int = ROOM) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``: documents whose sets of shingles link,
    directly or over others, share the smallest doc_id among them; ``kept`` where that is the row's own.

    Defined results: a null text, an empty one and one without words has no shingles and is linked with nothing; fewer than ``n`` words
    are one shingle, which equals no longer one; rows that repeat are returned as often as given; a null doc_id represents nothing, so
    its row is kept only where nothing of its component has an id; an empty table gives none; further columns are ignored.
    """
    kept = Kept(docs.sparkSession, "minhash")
    docs = docs.select("doc_id", "text")
    each = kept.keep(signed(docs, n))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = each.where("n > 0").groupBy("id").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = kept.keep(classes.select("id", "n", "sketch", "at.doc_id", "at.text_hash"))
    parts = kept.keep(components(links(docs, classes, kept, tile, room), kept))
    named = classes.select("id", "doc_id").join(parts, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("component", "id").alias("root"))
    named = kept.keep(named)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    lone = kept.keep(named.join(least, "root").select("id", "component_id").where("component_id is not null"))
    rows = each.select("doc_id", "n", "id").join(lone, "id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` over the whole table ``documents``."""
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE ws AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM ws),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
"""
