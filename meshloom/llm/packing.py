"""Best-fit packing of token sequences by minimum bin slack.

What fits together depends on lengths alone, so only the histogram of lengths
(one count for each length up to the capacity) ever reaches the driver. There,
each step takes the longest remaining length, finds by a bitset subset-sum over
the available lengths the fullest sequence that holds it, and removes as many
copies of that combination as the counts allow. The plan names lengths; pieces
are then numbered within their length and looked up in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, written

CAPACITY = 2048
END_ID = 0
#: Buckets in which pieces of one length are numbered; hot lengths (whole sequences above all) spread over them.
RANK_BUCKETS = 1024
#: Distinct words whose ids a task keeps; then it starts afresh.
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^ \n]+")
#: Characters that str.split() takes for white space and the vocabulary's rules do not.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f]")
#: A plain word is of letters whose lower case is one letter of the same alphabet, then ASCII marks other than the apostrophe.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_NOT_PLAIN = re.compile(rf"[^ {_LETTERS}{_MARKS}]|(?<=[{_MARKS}])[{_LETTERS}]")
#: By byte of Latin-1: 1 for letters, 2 for marks.
_KINDS = np.array([1 if re.match(f"[{_LETTERS}]", chr(b)) else 2 if re.match(f"[{_MARKS}]", chr(b)) else 0 for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple:
    """The tokenizer, its merges alone, which ids end a word, the byte alphabet and the characters it replaces; loaded once by each worker."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    merges = Tokenizer(whole.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ids = whole.get_vocab(with_added_tokens=True)
    # printable bytes stand for themselves, the others for characters from 256 on
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    alphabet = {b: chr(256 + n) for n, b in enumerate(odd) if b not in (10, 32)}
    ends = np.zeros(max(ids.values()) + 1, dtype=bool)
    ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True
    return whole, merges, ends, alphabet, re.compile("[" + "".join(map(re.escape, map(chr, alphabet))) + "]")


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, for the vocabulary that drops white space and marks word ends.

    The ids of a text are those of its words in turn, so the ids of each distinct
    word are kept. A new word of letters, or of letters and then ASCII marks, is
    split as the vocabulary's own rules do and only merged here, many in one call;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self._whole, self._merges, self._ends, self._alphabet, self._odd = _loaded(path)
        self._memo: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        ends = np.cumsum(np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) + 1)
        odd = {int(i) for i in np.searchsorted(ends, [m.start() for m in _NOT_PLAIN.finditer(" ".join(fresh))], side="right")}
        if odd:
            for i in odd:
                self._memo[fresh[i]] = np.array(self._whole.encode(fresh[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
            fresh = [word for i, word in enumerate(fresh) if i not in odd]
        if not fresh:
            return
        flat = np.frombuffer("\n".join(fresh).lower().encode("latin-1"), dtype=np.uint8)
        kind = _KINDS[flat]
        cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1  # where marks follow letters
        lines = np.flatnonzero(flat == 10)
        parts = np.searchsorted(cut, np.append(lines, len(flat))) + np.arange(1, len(fresh) + 1)  # parts up to each word's end
        spaced = np.insert(flat, cut, 32).tobytes().decode("latin-1").encode().decode("latin-1")
        mapped = self._odd.sub(lambda m: self._alphabet[ord(m[0])], spaced)
        ids = np.array(self._merges.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != parts[-1]:
            raise ValueError("the vocabulary does not keep words apart")
        raw, stops = ids.tobytes(), (ends[parts - 1] * 4).tolist()
        self._memo.update(zip(fresh, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Works through the batch in parts of a few million characters."""
        part: list[list[str]] = []
        size = 0
        for text in texts:
            part.append(_WORD.findall(text) if _OTHER_SPACE.search(text) else text.split())
            size += len(text)
            if size > 1_000_000:
                yield from self._encoded(part)
                part, size = [], 0
        yield from self._encoded(part)

    def _encoded(self, part: list[list[str]]) -> Iterator[bytes]:
        if len(self._memo) > MEMO_WORDS:
            self._memo = {}
        fresh = set().union(*part) - self._memo.keys()
        if fresh:
            self._learn(list(fresh))
        get = self._memo.__getitem__
        for found in part:
            yield b"".join(map(get, found))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each row: key, piece, start, length, ids_crc32 (and ids, if asked for).

    A document is the ids of its text and then id 0; only longer ones than
    ``capacity`` are cut. A null text is empty: one piece of one id.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = WordEncoder(vocabulary(vocab))
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, raw in enumerate(mine.encode([x or "" for x in part.column(1).to_pylist()])):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), step)):
                        cut = raw[at : at + step]
                        of.append(row)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["k", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(released(run), schema).withColumnRenamed("k", key)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination (length, times) of available lengths with the largest sum up to ``room``; longer lengths are tried first.

    ``counts`` bounds the times. Reachable sums are the bits of one integer, and
    each length is added in binary portions of its count.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, portion = min(counts[length], room // length), 1
        while left:
            times = min(portion, left)
            grown = reach | (reach << (length * times)) & mask
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left -= times
            portion *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Steps (first sequence, sequences, [(length, times in each)]) that use up the histogram.

    Each step uses one combination as often as the counts allow; steps are bounded
    by the distinct lengths and the logarithm of their counts, not by the pieces.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    done, first = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        chosen = dict(fullest(rest, capacity - longest)) if longest < capacity else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        many = min(left[length] // times for length, times in chosen.items())
        done.append((first, many, sorted(chosen.items(), reverse=True)))
        first += many
        for length, times in chosen.items():
            left[length] -= many * times
            if not left[length]:
                del left[length]
    return done


def _lookup(steps: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, (first rank, times in a sequence, first sequence, offset) in the order of ranks."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for first, many, chosen in steps:
        offset = 0
        for length, times in chosen:
            table.setdefault(length, []).append((used.get(length, 0), times, first, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * times
    return table


def _plan_table(spark: SparkSession, steps) -> DataFrame:
    """One row for each length: arrays in the order of ranks. At most ``capacity`` rows; their arrays hold an entry for each step and length in it."""
    rows = [(length, [list(x) for x in entries]) for length, entries in sorted(_lookup(steps).items())]
    return spark.createDataFrame(rows, "length long, entries array<array<long>>")


def assigned(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` needs key, piece, start, length and ids_crc32, and is read several times."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    steps = plan(histogram, capacity)
    bucket = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    cut = cut.withColumn("_bucket", bucket)
    counts = cut.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    starts = starts.join(F.broadcast(_plan_table(spark, steps)), "length")  # capacity rows, whatever the input
    within = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"])
    rank = F.col("_start") + F.col("_rank")
    entry = F.element_at(F.filter("entries", lambda e: e[0] <= rank), -1)
    placed = ranked.select(key, "piece", "start", "length", "ids_crc32", rank.alias("_r"), entry.alias("_e"))
    nth = F.col("_r") - F.col("_e")[0]
    return placed.select(key, "piece", "start", "length", "ids_crc32", (F.col("_e")[2] + F.floor(nth / F.col("_e")[1])).cast("long").alias("sequence_id"), (F.col("_e")[3] + F.pmod(nth, F.col("_e")[1]) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` ids: key, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets are gapless from 0 in each sequence. Null texts are empty, null keys
    and repeated rows are packed like any other, an empty table gives an empty
    result, and other columns are ignored. Pieces (without their ids) are written
    to the shared folder once, as several steps read them.
    """
    return assigned(written(pieces(docs, key, text, vocab, capacity), "pieces"), key, capacity)
