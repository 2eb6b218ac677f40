"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into overlapping word n-grams. A first pass over the corpus
counts the documents that have each; n-grams that are rare are seeds. A second
pass joins passages to items by seeds, and aligns word by word every passage that
has a seed and enough of the item's words. Texts are never shuffled. Items are sent
in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import released, renamed
from .substrings import Words

GRAM = 3
SIMILARITY = 0.8
#: Shorter items are too short to be aligned: they are looked for whole and unchanged.
LEAST_ITEM_WORDS = 8
#: Items under so many words are told, but are no reason for a document to go: anyone may have written them.
LEAST_EVIDENCE_WORDS = 4
#: An n-gram is rare if at most so many documents have it, or this share of all, or so many times what half of its item's n-grams have.
RARE_DOCS, RARE_SHARE, RARE_TIMES = 8, 0.0005, 4
#: Words of test items that one pass looks for.
BLOCK_WORDS = 2_000_000
#: Costs of the alignment, low enough that a few matches beyond an edit are worth it; a match is 1.
MISMATCH, GAP = 0.2, 0.2
PART_BYTES = 1_000_000
#: Marks that are dropped before words are compared.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(text: str | None) -> bytes:
    """A text as it is compared: A-Z lower-cased, ASCII marks dropped."""
    return (text or "").encode().lower().translate(None, MARKS)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of two sequences of names: words matched, and the passage's part (from, to).

    One row of the table at a time: with its score, every cell carries the words
    matched on its best path and where that began, so that memory grows with the
    passage alone, not with item times passage.
    """
    n = len(passage)
    slope, place = GAP * np.arange(n + 1), np.arange(n + 1)
    score, matched, start = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64), place.copy()
    best, found = 0.0, (0, 0, 0)
    for word in item:
        same = passage == word
        slanted = score[:-1] + np.where(same, 1.0, -MISMATCH)
        new, hits, begun = np.maximum(score - GAP, 0), matched.copy(), start.copy()
        empty = new <= 0
        hits[empty], begun[empty] = 0, place[empty]
        # of equal scores, words that stand opposite each other go first
        take = np.r_[False, (slanted >= new[1:]) & (slanted > 0)]
        new[take], hits[take], begun[take] = slanted[take[1:]], matched[:-1][take[1:]] + same[take[1:]], start[:-1][take[1:]]
        # words left out of the passage: the best cell before, at a price for each step
        run = np.maximum.accumulate(new + slope)
        source = np.maximum.accumulate(np.where(new + slope >= run, place, 0))
        far = (run - slope > new + 1e-12) & (run - slope > 0)
        source = np.where(far, source, place)
        score, matched, start = np.where(far, run - slope, new), hits[source], begun[source]
        at = int(score.argmax())
        if score[at] > best + 1e-9:
            best, found = float(score[at]), (int(matched[at]), int(start[at]), at)
    return found


class Block:
    """Some test items, their n-grams, and which of these are rare (none until they are told)."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        words = Words([plain(text) for _, text in rows])
        # by length, the whole items of fewer words: names, and which items
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({int(x) for x in words.n if 0 < x < LEAST_ITEM_WORDS}):
            mine = np.flatnonzero(words.n == n)
            names, which = np.unique(words.ranges(words.first[mine], words.first[mine] + n), return_inverse=True)
            self.short[n] = names, [[rows[mine[k]][0] for k in np.flatnonzero(which.reshape(-1) == i)] for i in range(len(names))]
        long = np.flatnonzero(words.n >= LEAST_ITEM_WORDS)
        self.ids = [rows[i][0] for i in long]
        self.items = [words.names[words.first[i] : words.first[i + 1]] for i in long]
        counts = words.n[long] - GRAM + 1
        at = np.repeat(words.first[long] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        names, of = words.ranges(at, at + GRAM), np.repeat(np.arange(len(long)), counts)
        both = np.unique(np.stack([names, of.astype(np.uint64)]), axis=1) if len(at) else np.zeros((2, 0), dtype=np.uint64)
        self.grams, self.start = np.unique(both[0], return_index=True)
        self.start = np.r_[self.start, both.shape[1]]
        self.of = both[1].astype(np.int64)
        self.rare = np.zeros(len(self.grams), dtype=bool)

    def tell(self, counts: np.ndarray, documents: int) -> None:
        """Mark the rare n-grams, given the documents that have each."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.start))
        half = np.zeros(len(self.items))
        order = np.argsort(self.of, kind="stable")
        for item, mine in enumerate(np.split(counts[gram[order]], np.cumsum(np.bincount(self.of, minlength=len(self.items)))[:-1])):
            half[item] = np.median(mine)
        usual = np.zeros(len(self.grams))
        np.maximum.at(usual, gram, half[self.of])
        self.rare = counts <= np.maximum(max(RARE_DOCS, RARE_SHARE * documents), RARE_TIMES * usual)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which an n-gram of an item starts, and which one."""
        counts = np.maximum(words.n - GRAM + 1, 0)
        at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        if not len(at) or not len(self.grams):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        names = words.ranges(at, at + GRAM)
        # a small table of low bits first: few names pass it
        bits = np.uint64(self._sieve_bits())
        may = np.flatnonzero(self._sieve()[(names >> (np.uint64(64) - bits)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.grams, names[may]), len(self.grams) - 1)
        found = self.grams[where] == names[may]
        return at[may[found]], where[found]

    def _sieve_bits(self) -> int:
        return max(10, int(np.ceil(np.log2(len(self.grams) + 1))) + 5)

    def _sieve(self) -> np.ndarray:
        if not hasattr(self, "_marks"):
            self._marks = np.zeros(1 << self._sieve_bits(), dtype=bool)
            self._marks[(self.grams >> np.uint64(64 - self._sieve_bits())).astype(np.int64)] = True
        return self._marks

    def whole(self, words: Words, least: int = 1) -> Iterator[tuple[int, int, int, int]]:
        """(text, place in the list of that length's items, from, words) of every short item of ``least`` words or more that a text holds unchanged: its first place."""
        for n, (names, _) in self.short.items():
            if n < least:
                continue
            counts = np.maximum(words.n - n + 1, 0)
            at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            here = words.ranges(at, at + n)
            where = np.minimum(np.searchsorted(names, here), len(names) - 1)
            hit = np.flatnonzero(names[where] == here)
            text = words.owner(at[hit])
            _, first = np.unique(np.stack([text, where[hit]]), axis=1, return_index=True) if len(hit) else (None, np.zeros(0, dtype=np.int64))
            for k in first:
                yield int(text[k]), int(where[hit[k]]), int(at[hit[k]] - words.first[text[k]]), n

    def told(self, words: Words, similarity: float) -> list[tuple]:
        """(text, item id, similarity, from, words) of all items in all texts."""
        found = [(t, self.ids[i], share, start, n) for t, i, share, start, n in self.matches(words, similarity)]
        for t, i, start, n in self.whole(words):
            found += [(t, of, 1.0, start, n) for of in self.short[n][1][i]]
        return sorted(found, key=lambda r: (r[0], r[1] is None, str(type(r[1])), r[1] if r[1] is not None else 0))

    def touched(self, words: Words, similarity: float) -> set[int]:
        """Texts that hold an item of ``LEAST_EVIDENCE_WORDS`` or more."""
        return {t for t, *_ in self.matches(words, similarity)} | {t for t, *_ in self.whole(words, LEAST_EVIDENCE_WORDS)}

    def matches(self, words: Words, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, from, words) of every item in every text: its best passage, if similar enough."""
        at, gram = self.hits(words)
        if not len(at):
            return
        many = np.diff(self.start)[gram]
        pick = np.repeat(self.start[gram] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pos, item, rare = np.repeat(at, many), self.of[pick], np.repeat(self.rare[gram], many)
        text = words.owner(pos)
        size = np.array([len(x) for x in self.items])
        order = np.lexsort((pos, item, text))
        pos, item, text, rare = pos[order], item[order], text[order], rare[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > size[item[1:]])]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(pos)]
        keep = np.add.reduceat(rare.astype(np.int64), heads).astype(bool)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(heads[keep].tolist(), tails[keep].tolist(), strict=True):
            t, i = int(text[a]), int(item[a])
            mine = self.items[i]
            low, high = max(int(words.first[t]), int(pos[a]) - len(mine)), min(int(words.first[t + 1]), int(pos[b - 1]) + GRAM + len(mine))
            passage = words.names[low:high]
            # no alignment matches more words than occur in the passage at all
            if np.count_nonzero(np.isin(mine, passage)) < similarity * len(mine):
                continue
            matched, start, end = align(mine, passage)
            found = (matched / len(mine), low + start - int(words.first[t]), end - start)
            if found[0] >= similarity and found[0] > best.get((t, i), (0.0,))[0]:
                best[t, i] = found
        for (t, i), (share, start, length) in best.items():
            yield t, i, share, start, length


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(from, texts) of about ``PART_BYTES`` each: what is held at once is a part, not a batch."""
    part, low, size = [], 0, 0
    for i, text in enumerate(texts):
        part.append(plain(text.as_py()))
        size += len(part[-1])
        if size >= PART_BYTES:
            yield low, part
            part, low, size = [], i + 1, 0
    if part:
        yield low, part


def _counted(docs: DataFrame, text: str, block: Block) -> tuple[np.ndarray, int]:
    """Documents that have each n-gram, and all documents. A task tells its own counts once; the driver gets a sum for each n-gram."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, total, n = sent.value, np.zeros(len(sent.value.grams), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, part in _parts(batch.column(0)):
                words = Words(part)
                at, gram = mine.hits(words)
                once = np.unique(words.owner(at) * len(total) + gram)
                total += np.bincount(once % max(1, len(total)), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen], pa.int64()), pa.array(np.r_[n, total[seen]], pa.int64())], names=["gram", "n"])

    sums = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(released(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = sums.column("gram").to_numpy(), sums.column("n").to_numpy()  # a row for each n-gram of a block
    counts = np.zeros(len(block.grams), dtype=np.int64)
    counts[gram[gram >= 0]] = n[gram >= 0]
    return counts, int(n[gram < 0].sum())


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in blocks of about ``BLOCK_WORDS`` words, each small enough for the driver."""
    total = benchmark.agg(F.sum(F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")))).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    for i in range(n):
        mine = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == i)
        yield sorted(((r["i"], r["t"]) for r in mine.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))


def _told(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> Iterator[Block]:
    for rows in _blocks(benchmark, item, item_text):
        block = Block(rows)
        if block.items:
            block.tell(*_counted(docs, text, block))
        if block.items or block.short:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and test item that it holds: key, item, similarity, start, words.

    ``similarity`` is the share of the item's words that the best local alignment
    matches; start and words place the passage among the words that are left when
    marks are dropped. Items under ``LEAST_ITEM_WORDS`` words are told where they
    stand whole (similarity 1, their first place). Null texts hold nothing; null
    items and those without words are not looked for. Equal items are each told,
    repeated rows too, null keys like others. Keys and item ids may be of any type.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("item", benchmark.schema[item].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
    kind = to_arrow_type(benchmark.schema[item].dataType)
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    result = spark.createDataFrame([], schema)
    for block in _told(docs, benchmark, text, item, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, part in _parts(batch.column(1)):
                    found = sent.value.told(Words(part), similarity)
                    if found:
                        t, i, s, a, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([low + x for x in t], pa.int64())), pa.array(i, kind), pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(n, pa.int64())], names=["k", "item", "similarity", "start", "words"])

        result = result.unionByName(slim.mapInArrow(released(run), schema))
    return result.withColumnRenamed("k", key).withColumnRenamed("item", item)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no test item of ``LEAST_EVIDENCE_WORDS`` words or more, with their columns, of whatever names, as they were.

    Rows with null or empty texts stay; repeated rows stay or go together, also where
    texts tie; an empty table gives an empty one.
    """
    columns, (docs, names) = docs.columns, renamed(docs)
    at = columns.index(text)
    for block in _told(docs, benchmark, names[at], item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for low, part in _parts(batch.column(at)):
                    for t in sent.value.touched(Words(part), similarity):
                        keep[low + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs.toDF(*columns)
