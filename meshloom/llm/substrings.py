"""Exact substring deduplication by recompression.

Words are named by 64-bit hashes. Rounds of recompression then give one name to
each short run of a word and to each pair whose left name is of the lower class
and whose right name is of the upper one. Names and classes depend on content
alone, so they are the same everywhere without any exchange, and where a round
puts its boundaries depends on a few neighbouring words only: inside two equal
word sequences the symbols are the same but for ``MARGIN`` words at each end. The
rounds stop where every window is still sure to hold a whole interior symbol.

For every window the interior symbol of least priority is its anchor, named
together with the ``MARGIN`` words on both sides, which every window that it
anchors holds. First Spark round: anchors that are named more than once reveal
where repeats may be. Second round: only windows on such anchors are named
whole, and for each name all but the earliest are covered. Between rounds
numbers travel in packed arrays; texts are dealt out once, by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes

WINDOW = 20
#: Words at each end of a window in which symbols may depend on what stands outside; symbols have at most MARGIN words.
MARGIN = 4
#: Text handled at once, in bytes, and entries aimed at for a bucket of a round.
PART_BYTES = 4_000_000
BUCKET_ENTRIES = 1_000_000
#: Bytes of words longer than this are hashed one word at a time.
LONG_WORD = 256

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_BYTE_NAMES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_BASE = 0x2545F4914F6CDD1D
_POWERS = np.multiply.accumulate(np.r_[_U(1), np.full(LONG_WORD, _BASE, dtype=np.uint64)])


class Words:
    """The words of some texts in one sequence: names, and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = _SPACE[flat]
        solid = np.flatnonzero(~space)
        starts = solid[np.r_[True, solid[1:] != solid[:-1] + 1]] if len(solid) else solid
        if len(starts):
            first = np.searchsorted(solid, starts)
            lengths = np.diff(np.r_[first, len(solid)])
            place = np.minimum(np.arange(len(solid)) - np.repeat(first, lengths), LONG_WORD)
            names = np.add.reduceat(_BYTE_NAMES[flat[solid]] * _POWERS[place], first) + lengths.astype(np.uint64) * _U(0x5851F42D4C957F2D)
            for i in np.flatnonzero(lengths > LONG_WORD):
                names[i] = xxhash.xxh64_intdigest(flat[starts[i] : starts[i] + lengths[i]].tobytes())
            self.names = _mix(names)
        else:
            self.names = np.zeros(0, dtype=np.uint64)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, begins)  # and the end of the last
        self.n = np.diff(self.first)
        # polynomial prefix sums: the name of any range of words in a few operations
        n = len(self.names)
        self._up = np.multiply.accumulate(np.r_[_U(1), np.full(n, _BASE, dtype=np.uint64)])
        self._down = np.multiply.accumulate(np.r_[_U(1), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
        self._sums = np.r_[_U(0), np.cumsum(self.names * self._up[:n])]

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names of the word ranges [a, b)."""
        return _mix((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(np.uint64) * _U(0x5851F42D4C957F2D))

    def windows(self) -> np.ndarray:
        """Starts of all windows."""
        counts = np.maximum(self.n - WINDOW + 1, 0)
        return np.repeat(self.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text of each word position."""
        return np.searchsorted(self.first, at, side="right") - 1

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and starts (with the end of the last) of the symbols after the rounds."""
        n = len(self.names)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.first] = True
        # round of runs: a word that stands twice, and not more often, becomes one symbol
        same = np.zeros(n + 1, dtype=bool)  # same[i]: word i equals word i - 1 of the same text
        if n:
            same[1:n] = (self.names[1:] == self.names[:-1]) & ~edge[1:n]
        twice = same.copy()
        twice[1:] &= ~same[:-1]
        twice[:-1] &= ~same[1:]
        starts = np.flatnonzero(~twice[:n])
        names = np.where(twice[np.minimum(starts + 1, n)], _mix(self.names[starts] + _U(2)), self.names[starts])
        # round of pairs: lower class before upper class
        upper = (_mix(names) >> _U(63)).astype(bool)
        joined = np.zeros(len(starts) + 1, dtype=bool)  # joined[i]: symbol i is the right part of a pair
        joined[1:-1] = ~upper[:-1] & upper[1:] & ~edge[starts[1:]]
        left = np.flatnonzero(~joined[:-1])
        pair = joined[np.minimum(left + 1, len(starts))]
        right = names[np.minimum(left + 1, max(len(names) - 1, 0))] if len(names) else names
        named = np.where(pair, _mix(names[left] * _U(3) + _mix(right + _U(1))), names[left])
        return named, np.r_[starts[left], n]

    def anchors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window start, the number of its anchor symbol; and the symbols' bounds."""
        names, bounds = self.symbols()
        if not len(at):
            return np.zeros(0, dtype=np.int64), bounds
        low = np.searchsorted(bounds, at + MARGIN)
        high = np.searchsorted(bounds, at + WINDOW - MARGIN, side="right") - 1  # symbols low..high-1 lie inside
        order = (_mix(names ^ _U(0x94D049BB133111EB)) & ~_U((1 << 26) - 1)) | np.arange(len(names), dtype=np.uint64)
        width = high - low
        best = np.empty(len(at), dtype=np.uint64)
        level, step = order, 1
        while True:  # least of every 1, 2, 4, 8 symbols; two such ranges cover any
            mine = (width >= step) & (width < 2 * step)
            best[mine] = np.minimum(level[low[mine]], level[high[mine] - step])
            if not (width >= 2 * step).any():
                break
            level = np.minimum(level[:-step], level[step:])
            step *= 2
        return (best & _U((1 << 26) - 1)).astype(np.int64), bounds


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a batch, as (from, to, texts), of about ``PART_BYTES`` each; column 2 has the text."""
    texts, low, size = [], 0, 0
    for i, value in enumerate(batch.column(2)):
        texts.append((value.as_py() or "").encode())
        size += len(texts[-1])
        if size >= PART_BYTES:
            yield low, i + 1, texts
            texts, low, size = [], i + 1, 0
    if texts:
        yield low, low + len(texts), texts


_PACKED = "bucket int, kind byte, docs binary, ids binary, counts binary, names binary, places binary"


def _packed(buckets: int, names: np.ndarray, text: np.ndarray, place: np.ndarray, docs: np.ndarray, ids: np.ndarray, kind: int) -> Iterator[dict]:
    """Entries (name, text, place), dealt to buckets by name (or by text, for kind 1, whose names say nothing)."""
    dealt = ((names if kind == 0 else _mix(docs[text].view(np.uint64))) % _U(buckets)).astype(np.int64)
    for bucket in np.unique(dealt):
        mine = dealt == bucket
        t = text[mine]
        order = np.argsort(t, kind="stable")
        there, counts = np.unique(t, return_counts=True)
        yield {
            "bucket": int(bucket), "kind": kind, "docs": docs[there].tobytes(), "ids": ids[there].tobytes(), "counts": counts.astype(np.int32).tobytes(),
            "names": names[mine][order].tobytes() if kind == 0 else b"", "places": place[mine][order].astype(np.int32).tobytes(),
        }


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "kind": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.binary())) for c in rows[0]], names=list(rows[0]))


def _unpack(table: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """Documents, ids, names and places of all entries of a kind."""
    rows = [r for r in table.select(["kind", "docs", "ids", "counts", "names", "places"]).to_pylist() if r["kind"] == kind]
    join = lambda c, kind: np.concatenate([np.frombuffer(r[c], dtype=kind) for r in rows]) if rows else np.zeros(0, dtype=kind)
    counts = join("counts", np.int32)
    return np.repeat(join("docs", np.int64), counts), np.repeat(join("ids", np.int64), counts), join("names", np.uint64), join("places", np.int32)


_FOUND = "doc long, found binary"


def _told(docs: np.ndarray, places: np.ndarray) -> pa.Table:
    """One row for each document: its places in order, as runs (first, how many)."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    fresh = np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1] + 1)] if len(docs) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(fresh)
    runs = np.stack([places[at], np.diff(np.r_[at, len(docs)])], axis=1).astype(np.int32)
    who, first = np.unique(docs[at], return_index=True)
    blobs = [r.tobytes() for r in np.split(runs, first[1:])] if len(who) else []
    return pa.table({"doc": pa.array(who, pa.int64()), "found": pa.array(blobs, pa.binary())})


def _marks(blobs: list[bytes], n: int, width: int = 1) -> np.ndarray:
    """Which of ``n`` places the runs name; each place stands for ``width`` from it on."""
    step = np.zeros(n + 1, dtype=np.int32)
    for blob in blobs:
        runs = np.frombuffer(blob, dtype=np.int32).reshape(-1, 2)
        np.add.at(step, runs[:, 0], 1)
        np.add.at(step, np.minimum(runs[:, 0] + runs[:, 1] + width - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def _ids(column: pa.Array) -> np.ndarray:
    """Keys as longs; null comes before all others."""
    return np.array([-(1 << 63) if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _repeats(names: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their name, and which of them come first for it (by rank, else any one)."""
    order = np.argsort(names, kind="stable") if rank is None else np.lexsort((rank, names))
    s = names[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, dtype=bool)
    alone = new & np.r_[new[1:], True] if len(s) else new
    shared, first = np.zeros(len(s), dtype=bool), np.zeros(len(s), dtype=bool)
    shared[order], first[order] = ~alone, new
    return shared, first


def _candidates(buckets: int):
    """First round, over texts: the anchors of each part, told once by name; those that repeat within the part are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for low, high, texts in _parts(batch):
                words = Words(texts)
                which, bounds = words.anchors(words.windows())
                symbol = np.unique(which)
                names, owner = words.ranges(bounds[symbol] - MARGIN, bounds[symbol + 1] + MARGIN), words.owner(bounds[symbol])
                place, own = bounds[symbol] - words.first[owner], docs[low:high]
                shared, first = _repeats(names)
                none = np.zeros(len(own), dtype=np.int64)
                rows = list(_packed(buckets, names[first], owner[first], place[first], own, none, 0)) + list(_packed(buckets, names[shared], owner[shared], place[shared], own, none, 1))
                if rows:
                    yield _record_batch(rows)

    return run


def _revealed(table: pa.Table) -> pa.Table:
    """First round, by name: the documents and places of anchors that are named twice or more."""
    docs, _, names, places = _unpack(table, 0)
    shared, _ = _repeats(names)
    known, _, _, at = _unpack(table, 1)
    return _told(np.r_[docs[shared], known], np.r_[places[shared], at])


def _suspects(buckets: int):
    """Second round, over texts with revealed anchors: windows on them, the earliest of the part by name; the others are covered for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids, found = batch.column(0).to_numpy(), _ids(batch.column(1)), batch.column(3)
            for low, high, texts in _parts(batch):
                words = Words(texts)
                at = words.windows()
                which, bounds = words.anchors(at)
                marked = np.zeros(len(words.names) + 1, dtype=bool)
                for i in range(low, high):
                    marked[words.first[i - low] : words.first[i - low + 1]] = _marks(found[i].as_py(), words.n[i - low])
                at = at[marked[bounds[which]]]
                names, owner = words.ranges(at, at + WINDOW), words.owner(at)
                own, key = docs[low:high], ids[low:high]
                place = at - words.first[owner]
                # the order of (id, start), with equal ranks for repeated rows
                _, rank = np.unique(np.stack([key[owner], place], axis=1), axis=0, return_inverse=True) if len(at) else (None, place)
                rank = rank.reshape(-1)
                _, first = _repeats(names, rank)
                order = np.lexsort((rank, names))
                least = rank[order][np.flatnonzero(first[order])][np.cumsum(first[order]) - 1] if len(at) else rank
                late = np.zeros(len(at), dtype=bool)
                late[order] = rank[order] > least
                rows = list(_packed(buckets, names[~late], owner[~late], place[~late], own, key, 0)) + list(_packed(buckets, names[late], owner[late], place[late], own, key, 1))
                if rows:
                    yield _record_batch(rows)

    return run


def _covered(table: pa.Table) -> pa.Table:
    """Second round, by name: windows that start later than the earliest of their name."""
    docs, ids, names, places = _unpack(table, 0)
    order = np.lexsort((places, ids, names))
    n, i, p = names[order], ids[order], places[order]
    new = np.r_[True, n[1:] != n[:-1]] if len(n) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(n) else order
    late = (i != i[head]) | (p != p[head])
    known, _, _, at = _unpack(table, 1)
    return _told(np.r_[docs[order][late], known], np.r_[p[late], at])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for value, found in zip(batch.column(2), batch.column(3), strict=True):
                words = (value.as_py() or "").encode().split()
                n_words.append(len(words))
                if blobs := found.as_py():
                    keep = ~_marks(blobs, len(words), WINDOW)
                    words = list(compress(words, keep.tolist()))
                n_removed.append(n_words[-1] - len(words))
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            columns = [batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if with_text else [])], names=["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row: key, n_words, n_removed, kept_sha256 (and kept_text, if asked for).

    A word goes if a window of ``WINDOW`` words that covers it also starts earlier:
    in a row with a smaller key, or earlier in the same one. Windows are judged on
    the input. Null texts have no words; a null key comes before all others; rows
    with equal keys are one document to the order, so neither's windows are earlier
    at equal starts. An empty table gives an empty result; other columns are
    ignored. The key must be an integer.

    Names are 64-bit hashes of words and of word sequences.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.xxhash64(F.col(key), body).alias("doc"), F.col(key).cast("long").alias("id"), body.alias("text"))
    # one exchange of the texts, which all three uses below share
    dealt = slim.repartition("doc")
    size = max(1, input_bytes(docs, text))
    buckets = max(8, size // 25_000_000)  # of files: some 25 anchors or windows on repeats a KB
    found = lambda rows, f: rows.groupBy("bucket").applyInArrow(f, _FOUND).groupBy("doc").agg(F.collect_list("found").alias("found"))
    anchors = found(dealt.mapInArrow(_candidates(buckets), _PACKED), _revealed)
    windows = found(dealt.join(anchors, "doc").select("doc", "id", "text", "found").mapInArrow(_suspects(buckets), _PACKED), _covered)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    done = dealt.join(windows, "doc", "left").select("doc", "id", "text", "found").mapInArrow(_kept(with_text), schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[key].dataType)).withColumnRenamed("id", key)
