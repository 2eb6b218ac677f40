"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets its Hamming distances to many reference fingerprints (pivots)
once: its row of the pivot table. By the triangle inequality, two fingerprints within
r bits differ by at most r in each coordinate.

The table is used twice. First coordinates, cut into cells, are part of the key by
which pairs meet: a fingerprint looks for others in its own cell and, where its
distance is near the border, in the neighbouring one, so no pair within r is lost.
The other part of the key is a block of bits: with at most r differing bits, one of
r + 1 blocks agrees. Then pairs whose largest coordinate difference over all pivots
is more than r are discarded by a few operations on packed rows of the table, and
only survivors are verified bit by bit. ``funnel`` counts what each step leaves.

A crowded cell is not paired off at all: two fingerprints within 2 bits have a
common neighbour within 1 bit of each, so members are linked through shared
neighbours, exactly and in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import released, renamed, sent_if_small, written

SEED = 42
RADIUS = 2
PIVOTS = 24
#: Pivots whose cells are part of the key by which pairs meet.
KEYED = 2
#: Coordinates packed into one long, a byte each, so that none carries into the sign.
PACKED = 6
#: Pairs of a cell up to which it is paired off.
CROWD = 256
#: Fingerprints beyond which blocks are cut in two, of which all but ``RADIUS`` agree (longer keys, more of them).
MANY = 1 << 24
#: Members up to which a bucket of similar documents is paired off.
FEW = 16
#: Sampled fingerprints for similarity on shingle sets.
BINS, SAMPLE = 64, 3
SKETCH = 256
#: How far the share told by sketches may be below the similarity: six standard errors at 0.8. The whole sets decide.
SLACK = 0.15
WIDE_RADIUS = 26
#: Members of a crowded bucket that are compared with as many others by one call: most rows of a group are twice that.
BLOCK = 512
#: Pairs of a block from which shared shingles are counted by products of matrices, of so many columns at a time.
DENSE, COLUMNS = 200, 8192

_LANES = np.array([sum(((byte >> (7 - bit)) & 1) << (8 * bit) for bit in range(8)) for byte in range(256)], dtype="<u8")


def _pivots() -> list[int]:
    """Pseudo-random reference fingerprints: XXH64 of their numbers."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included, as rows of 8 bytes from the high one.

    A-Z are lower-cased; words end at the six separators. With fewer words than
    ``width`` the whole sequence is the only shingle; with none there is none.
    """
    found = text.encode().lower().split()
    digest = xxhash.xxh64_digest
    if len(found) <= width:
        raw = digest(b" ".join(found), SEED) if found else b""
    else:
        flat = b" ".join(found)
        starts = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        ends = (starts[width - 1 :] - 1).tolist()
        raw = b"".join([digest(flat[a:b], SEED) for a, b in zip([0, *starts[:-width].tolist()], ends, strict=True)])
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)


def fingerprints(parts: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each part: bits set in more than half its shingles; zero where there are none."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    out = np.zeros(len(parts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([parts[i] for i in full])
    sizes = sizes[full]
    # eight counters in the bytes of a word overflow after 255 rows: runs of that length first, then their totals
    runs = -(-sizes // 255)
    firsts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    of = np.cumsum(runs) - runs
    bits = np.empty((len(full), 64), dtype=np.uint8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, byte]], firsts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        bits[:, 8 * byte : 8 * byte + 8] = 2 * counts > sizes[:, None]
    out[full] = np.packbits(bits, axis=1).view(">u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long. A null text has no words."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                fps = fingerprints([shingles(x or "", width) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["k", "fp"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(released(run), schema).withColumnRenamed("k", key)


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long")


def pivot_rows(fp: Column) -> list[Column]:
    """A fingerprint's row of the pivot table, packed: ``PACKED`` distances in each long, the first in the lowest byte."""
    found = [_distance(fp, p) for p in _pivots()]
    return [sum((F.shiftleft(d, 8 * k) for k, d in enumerate(found[low : low + PACKED])), F.lit(0).cast("long")) for low in range(0, PIVOTS, PACKED)]


def coordinates_near(a: list[Column], b: list[Column], radius: int) -> Column:
    """Whether no coordinate of two packed rows differs by more than ``radius`` (below 32)."""
    each = lambda byte: F.lit(sum(byte << (8 * k) for k in range(PACKED)))
    near = F.lit(True)
    for x, y in zip(a, b, strict=True):
        # bytes of t are 128 + radius + x - y; in range, that is 128 to 128 + 2 radius
        t = (x.bitwiseOR(each(128)) + each(radius) - y).bitwiseXOR(each(128))
        near = near & (t.bitwiseOR(t.bitwiseAND(each(127)) + each(127 - 2 * radius)).bitwiseAND(each(128)) == 0)
    return near


def _probes(fp: Column) -> tuple[Column, Column]:
    """The cells of the first ``KEYED`` coordinates: a fingerprint's own, as one number, and all in which others within ``RADIUS`` may be."""
    width, own, every = 2 * RADIUS + 1, F.lit(0), F.array(F.lit(0))
    for p in _pivots()[:KEYED]:
        d = _distance(fp, p).cast("int")
        cell, rest = F.floor(d / width).cast("int") + 1, F.pmod(d, F.lit(width))
        # width 2r + 1: the cell and at most one neighbour
        here = F.when(rest < RADIUS, F.array(cell, cell - 1)).when(rest > RADIUS, F.array(cell, cell + 1)).otherwise(F.array(cell))
        own = own * 32 + cell
        every = _products(every, here)
    return own, every


def _products(every: Column, here: Column) -> Column:
    """All x * 32 + c of two arrays."""
    return F.flatten(F.transform(every, lambda x: F.transform(here, lambda c: x * 32 + c)))


def _met(nodes: DataFrame, many: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (way, key, cell, fp, packed row): every fingerprint in its own cells, and in all cells that it looks into."""
    blocks = (RADIUS + 1) * (2 if many else 1)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = [sum(mask[i] for i in kept) for kept in combinations(range(blocks), blocks - RADIUS)]
    fp = F.col("fp")
    own, every = _probes(fp)
    names = [f"r{i}" for i in range(PIVOTS // PACKED)]
    table = nodes.select("fp", own.alias("own"), every.alias("looks"), *[r.alias(n) for r, n in zip(pivot_rows(fp), names, strict=True)])
    ways = F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(k))) for k in keys])).alias("way", "key")
    rows = table.select("fp", "own", "looks", *names, ways)
    return rows.select("way", "key", F.col("own").alias("cell"), "fp", *names), rows.select("way", "key", F.explode("looks").alias("cell"), "fp", *names)


def _pairs(nodes: DataFrame, many: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, packed rows) of fingerprints that meet in a cell that is not crowded, and the fingerprints of crowded ones."""
    at = ["way", "key", "cell"]
    here, looking = _met(nodes, many)
    sizes = here.groupBy(*at).agg(F.count("*").alias("n"))
    seen = looking.groupBy(*at).agg(F.count("*").alias("m")).join(sizes, at).where(F.col("n") * F.col("m") > F.greatest("n", F.lit(1)))
    cells = written(seen.withColumn("crowded", F.col("n") * F.col("m") > CROWD).select(*at, "crowded"), "cells")
    few, many_ = cells.where("not crowded").drop("crowded"), cells.where("crowded").drop("crowded")
    side = lambda rows, s: rows.join(few, at).select(*at, F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c[0] == "r"])
    pairs = side(here, "u").join(side(looking, "v"), at).where(F.col("u") < F.col("v"))
    crowd = here.unionByName(looking).select(*at, "fp").join(many_, at).select("fp").distinct()
    return pairs, crowd


def _discarded(pairs: DataFrame) -> DataFrame:
    packed = range(PIVOTS // PACKED)
    return pairs.where(coordinates_near([F.col(f"r{i}_u") for i in packed], [F.col(f"r{i}_v") for i in packed], RADIUS))


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``nodes`` (fp) as all pairs within ``RADIUS`` bits do.

    Every pair in an uncrowded cell is decided by the pivot table and verified; a
    crowded cell gives a star for each shared neighbour instead. All links told are
    within the radius.
    """
    nodes = written(nodes, "nodes")
    pairs, crowd = _pairs(nodes, nodes.count() > MANY)
    found = _discarded(pairs).select("u", "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    around = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("near"))
    lowest = around.groupBy("near").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v < w").select("near", "v")
    stars = around.join(lowest, "near").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return found.unionByName(stars).distinct()


def funnel(nodes: DataFrame) -> dict[str, int]:
    """How many pairs of distinct fingerprints meet by blocks alone, by blocks and cells of pivots, are left by the pivot table, and are within the radius."""
    nodes = written(nodes, "nodes")
    here, _ = _met(nodes, nodes.count() > MANY)
    blocks = here.groupBy("way", "key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    pairs, _ = _pairs(nodes, nodes.count() > MANY)
    left = _discarded(pairs)
    close = left.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    return {"blocks": int(blocks), "cells": pairs.count(), "pivots": left.count(), "links": close.select("u", "v").distinct().count()}


def classes(keyed: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, node, component_id) given (key, node) rows and (u, root) of the nodes that have links: the smallest key of each class."""
    named = keyed.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("_class", F.coalesce("root", "node")).drop("root")
    # written, so that the rows of a large class can be split in the join
    lowest = written(named.groupBy("_class").agg(F.min(key).alias("component_id")), "classes")
    return named.join(lowest, "_class").select(key, "node", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row for each row: key, fingerprint (16 hex digits) and component_id, the smallest key reachable by links of at most ``RADIUS`` bits.

    Null and blank texts have fingerprint zero and are linked like any other. Null
    keys never become component_id unless a class has no other. Repeated rows are
    one class. An empty table gives an empty result; other columns are ignored.
    """
    table = written(fingerprint_table(docs, key, text, width).withColumnRenamed("fp", "node"), "fingerprints")
    found = links(table.select(F.col("node").alias("fp")).distinct())
    done = classes(table, key, components(found))
    return done.select(key, F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets: fingerprints of samples find the pairs.


def _sketch(h: np.ndarray) -> tuple[list[int], bytes]:
    """Keys by which similar sets meet, and the smallest hashes of a set (all of a small one), given its hashes in order.

    The hashes are dealt to bins and the smallest of each is kept (an empty bin
    takes the next one's); the SimHash of ``SAMPLE`` neighbouring minima is a key.
    """
    where = (h >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    # the next filled bin, round the end
    slot = np.searchsorted(where[first], np.arange(BINS))
    m = h[first[np.where(slot < len(first), slot, 0)]]
    mixed = m * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    a, b, c = mixed[: BINS - BINS % SAMPLE].reshape(-1, SAMPLE).T
    keys = (a & b) | (b & c) | (a & c)
    return keys.view(np.int64).tolist(), np.unique((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32))[:SKETCH].astype(np.uint32).tobytes()


def _node(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED))


def _set_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, node, fp, keys, sketch) of every row; node is XXH64 of the lower-cased words.

    The fingerprint is that of the distinct shingles, as the similarity is.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                texts = [x or "" for x in part.column(1).to_pylist()]
                sets = [np.unique(shingles(x, width).view(">u8")[:, 0].astype(np.uint64)) for x in texts]
                made = [_sketch(s) if len(s) else ([], b"") for s in sets]
                node = [_node(x) for x in texts]
                fps = fingerprints([s.astype(">u8").view(np.uint8).reshape(-1, 8) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(node, pa.int64()), pa.array(fps.view(np.int64)), pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([s for _, s in made], pa.binary())],
                    names=["k", "node", "fp", "keys", "sketch"],
                )

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(released(run), schema).withColumnRenamed("k", key)


@dataclass(frozen=True)
class Sets:
    """The rows of ``_set_table`` with key ``k``, and the texts (k, t) and the width that they were made of."""

    docs: DataFrame
    width: int
    rows: DataFrame


def _hashes(table: Sets, ends: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes ``ends``, written: all shingle hashes of their texts in order, made again, because the sets of all texts are larger than the texts."""
    width = table.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            sets = [np.unique(shingles(x, width).view(">u8")[:, 0].astype(np.uint64)) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in texts], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    # any row of a node will do; where others have its key, they are left out after
    keys = written(table.rows.join(sent_if_small(ends), "node", "left_semi").groupBy("node").agg(F.min("k").alias("_k")).select("_k").distinct(), "wanted")
    texts = table.docs.join(sent_if_small(keys), F.col("k").eqNullSafe(F.col("_k")), "left_semi").select("t")
    made = texts.mapInArrow(released(run), "node long, hashes binary")
    return written(made.join(sent_if_small(ends), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "hashes")


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "ends")


def _beside(pairs: DataFrame, info: DataFrame, name: str) -> DataFrame:
    """Pairs with a long column of both nodes."""
    side = lambda x: info.select(F.col("node").alias(x), F.col(name).alias(f"{name}_{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v")


def _told_alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, sketch_u, sketch_v) whose sets may be similar by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                union = np.union1d(a, b)
                if len(a) == SKETCH or len(b) == SKETCH:
                    union = union[:SKETCH]
                both = np.intersect1d(a, b, assume_unique=True)
                keep.append(len(both) and np.count_nonzero(both <= union[-1]) >= (similarity - SLACK) * len(union))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array([bool(k) for k in keep], pa.bool_()))

    return pairs.select("u", "v", "sketch_u", "sketch_v").mapInArrow(released(run), "u long, v long")


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, hashes_u, hashes_v) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "hashes_u", "hashes_v").mapInArrow(released(run), "u long, v long")


def _decided(table: Sets, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes that are similar: fingerprints and sketches discard, the whole sets decide."""
    met = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "met")
    packed = range(PIVOTS // PACKED)
    placed = table.rows.groupBy("node").agg(F.first("fp").alias("fp"))
    placed = placed.select("node", "fp", *[r.alias(f"r{i}") for i, r in enumerate(pivot_rows(F.col("fp")))])
    side = lambda x: placed.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), *[F.col(f"r{i}").alias(f"r{i}_{x}") for i in packed])
    near = coordinates_near([F.col(f"r{i}_u") for i in packed], [F.col(f"r{i}_v") for i in packed], WIDE_RADIUS) & (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= WIDE_RADIUS)
    near_pairs = written(met.join(side("u"), "u").join(side("v"), "v").where(near).select("u", "v"), "near")
    # long columns: only the nodes that are left send theirs
    sketches = written(table.rows.join(sent_if_small(_ends(near_pairs)), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")), "sketch")
    told = written(_told_alike(_beside(near_pairs, sketches, "sketch"), similarity), "told")
    return written(_alike(_beside(told, _hashes(table, _ends(told)), "hashes"), similarity), "alike")


def _open(crowded: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, node, root) of crowded buckets, and the buckets with more than one class: members, those of the largest root, and that root."""
    named = crowded.select(F.xxhash64("way", "key").alias("bucket"), "node").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "open")
    size = named.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    size = size.where("most.n < n").select("bucket", (F.col("n") - F.col("most.n")).alias("others"), F.col("most.n").alias("mains"), F.col("most.root").alias("main"))
    return named, written(size, "crowds")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (bucket, node, root) with the blocks (bucket, lo, hi) in which parts ``lo`` and ``hi`` of a bucket are compared, and their own ``part``.

    Members of the largest root, which are not compared with each other, have parts
    of their own: a member is given once for each part of the others.
    """
    parts = lambda n: f"cast(ceil({n} / {BLOCK}) AS int)"
    rows = members.selectExpr("bucket", "node", "root", "root = main AS _main", f"{parts('others')} AS _o", f"{parts('mains')} AS _m")
    rows = rows.selectExpr("*", "cast(if(_main, _o + pmod(xxhash64(node), _m), pmod(xxhash64(node), _o)) AS int) AS part")
    rows = rows.selectExpr("bucket", "node", "root", "part", "explode(sequence(0, if(_main, _o, _o + _m) - 1)) AS _with")
    return rows.selectExpr("bucket", "least(part, _with) AS lo", "greatest(part, _with) AS hi", "part", "node", "root")


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items the sets of each pair (i, j) have in common."""
    if len(i) < DENSE:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    left, right = (np.unique(x, return_inverse=True) for x in (at[: len(i)], at[len(i) :]))
    of = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, item, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    often = times > 1  # others are in no two sets
    column = np.cumsum(often) - 1
    of, item = of[often[item]], column[item[often[item]]]
    order = np.argsort(item, kind="stable")
    of, item = of[order], item[order]
    both = np.zeros((len(left[0]), len(right[0])), dtype=np.float32)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(item, [low, low + COLUMNS])
        has = np.zeros((len(used), COLUMNS), dtype=np.float32)
        has[of[a:b], item[a:b] - low] = 1
        both += has[left[0]] @ has[right[0]].T
    return both[left[1], right[1]].astype(np.int64)


def _compared(similarity: float):
    """Of a block (lo, hi, part, node, root, fp, halves): the pairs (u, v) of different roots that may be similar, by the upper halves of all their hashes."""

    def run(block: pa.Table) -> pa.Table:
        lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
        part, node, root, fp = (block.column(c).to_numpy() for c in ("part", "node", "root", "fp"))
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in block.column("halves")]
        size = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        one, two = a[:, None], b[None, :]
        ok = (root[one] != root[two]) & (np.minimum(size[one], size[two]) >= similarity * np.maximum(size[one], size[two]))
        ok &= np.bitwise_count(fp.view(np.uint64)[one] ^ fp.view(np.uint64)[two]) <= WIDE_RADIUS
        i, j = np.nonzero(np.triu(ok, 1) if lo == hi else ok)
        i, j = a[i], b[j]
        both = shared(sets, i, j) if len(i) else np.zeros(0, dtype=np.int64)
        # two hashes with equal halves may count as one
        keep = both + 1 >= similarity * (size[i] + size[j] - both - 1)
        u, v = np.maximum(node[i], node[j])[keep], np.minimum(node[i], node[j])[keep]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _halves(hashes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper = [(np.frombuffer(x.as_buffer(), dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upper, pa.binary())], names=["node", "halves"])

    return hashes.select("node", "hashes").mapInArrow(released(run), "node long, halves binary")


def _told_in_blocks(table: Sets, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of members of a bucket with different roots that may be similar.

    Pairs are made and discarded within a task, from the sets themselves: rows are
    exchanged for members, and come out for the pairs that may be similar.
    """
    hashes = _hashes(table, written(members.select("node").distinct(), "ends"))
    info = _halves(hashes).join(table.rows.groupBy("node").agg(F.first("fp").alias("fp")), "node")
    blocks = _blocks(members).join(written(info, "halves"), "node")
    return blocks.groupBy("bucket", "lo", "hi").applyInArrow(_compared(similarity), "u long, v long")


def _paired(members: DataFrame) -> DataFrame:
    """All pairs (u, v) of members of a bucket with different roots; members of its largest root (``main``) are not paired among themselves."""
    u = members.where("root <> main").select("bucket", F.col("node").alias("u"), F.col("root").alias("root_u"))
    v = members.select("bucket", F.col("node").alias("v"), F.col("root").alias("root_v"), "main")
    # where both are outside the main root, the pair is told once
    return u.join(v, "bucket").where("root_u <> root_v AND (root_v = main OR u > v)").select("u", "v")


def _rest(table: Sets, crowded: DataFrame, links: DataFrame, similarity: float, told: Callable[[DataFrame], DataFrame] = _paired) -> DataFrame:
    """The links with those of crowded buckets: all pairs of members that are in different classes by then are decided.

    ``told`` gives the pairs of members (bucket, node, root, main) that may be similar; by default all of them, each a row.
    """
    named, size = _open(crowded, components(links))
    return links if size.isEmpty() else links.unionByName(_decided(table, told(named.join(size, "bucket")), similarity))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, node, component_id) for every row: classes linked by similarity of their shingle sets.

    Rows with equal words share a node. Nodes meet where one of their sampled
    fingerprints is equal. Small buckets are paired off. Each member of a crowded
    one is first compared with two representatives, one chosen anew for every key and
    one that shares the most keys with others; members that are then still in
    different classes are all compared with each other, in blocks. The pivot table of
    the fingerprints discards first, then the Hamming distance, then sketches (in
    blocks, the Hamming distance and the sizes); the whole sets decide. A null or
    blank text is alike only to the others.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    table = Sets(docs, width, written(_set_table(docs, "k", "t", width), "sets"))
    nodes = table.rows.groupBy("node").agg(F.first("keys").alias("keys"))
    rows = written(nodes.select("node", F.posexplode("keys").alias("way", "key")), "keys")
    order = F.struct(F.xxhash64("node", "way"), F.col("node"))
    heads = rows.groupBy("way", "key").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1").select("way", "key", "n", F.col("head.node").alias("v"))
    met = written(rows.join(heads, ["way", "key"]), "buckets")
    few, crowded = met.where(F.col("n") <= FEW), met.where(F.col("n") > FEW)
    pairs = few.select("way", "key", F.col("node").alias("u")).join(few.select("way", "key", F.col("node").alias("v")), ["way", "key"]).where("u > v").select("u", "v")
    # the copy that the others were made from shares more keys than any of them: it is the second representative
    weight = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    middle = crowded.select("way", "key", "node").join(weight, "node").groupBy("way", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("v"))
    headed = crowded.select("node", "v").unionByName(crowded.select("way", "key", "node").join(middle, ["way", "key"]).select("node", "v"))
    first = _decided(table, pairs.unionByName(headed.where("node <> v").select(F.col("node").alias("u"), "v")), similarity)
    links = first if crowded.isEmpty() else _rest(table, crowded, first, similarity, lambda members: _told_in_blocks(table, members, similarity))
    return classes(table.rows.select(F.col("k").alias(key), "node"), key, components(links))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its class, with their columns, of whatever names, as they were.

    Rows with a null key stay, unless another row of their class has a key. Null and
    blank texts are one class. Repeated rows of a kept key stay one row. An empty
    table gives an empty one.
    """
    columns, (docs, names) = docs.columns, renamed(docs)
    key, text = names[columns.index(key)], names[columns.index(text)]
    found = similar_documents(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t", width, similarity)
    kept = F.col("k").eqNullSafe(F.col("component_id"))
    gone = written(found.where(~kept).select(F.col("k").alias("_gone")).distinct(), "gone")
    twice = written(found.where(kept).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("_gone")), "twice")
    same = F.col(key).eqNullSafe(F.col("_gone"))
    left = docs.join(sent_if_small(gone), same, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([key]))
    return left.toDF(*columns)
