"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and of itself, each hashed to a row of
an embedding table; a text is the average of the rows of its different words, and
a softmax over two classes follows. Table and softmax are trained together, so a
misspelling never seen shares most of its rows with the word it stands for.

After training, a row adds a fixed amount to the difference of the two logits.
Scoring a text is then a sum over its words, which workers keep by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, written

#: Embedding rows, their width, and the n-gram lengths.
ROWS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Labelled rows of each class that training takes at most (in expectation: the choice is by hash).
MOST_OF_CLASS = 1600
#: Bytes of their bags that reach the driver at most (in expectation): beyond, fewer rows are taken, by hash.
MOST_BYTES = 300_000_000
STEPS, BATCH, RATE, SCALE = 600, 64, 0.02, 120.0
#: Empty rows that every average holds beside a text's own: a few words alone then say little.
PRIOR_ROWS = 2500
#: Rows in fewer samples than this, or than this share of them, are left at zero: they would learn single texts by heart.
LEAST_SAMPLES, LEAST_SHARE = 4, 0.003
#: Words that a worker keeps amounts for.
MEMO_WORDS = 1_000_000
THRESHOLD = 0.7


def held_out(key: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def rows_of(word: str) -> list[int]:
    """The embedding rows of a word."""
    word = f"<{word.lower()}>"
    raw, crc = word.encode(), zlib.crc32
    found = [crc(raw)]
    if len(raw) == len(word):
        for n in GRAMS:
            found += [crc(raw[i : i + n]) for i in range(len(raw) - n + 1)]
    else:
        for n in GRAMS:
            found += [crc(word[i : i + n].encode()) for i in range(len(word) - n + 1)]
    return [(x ^ x >> 15) % ROWS for x in found]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct embedding rows of a text and their shares in its average."""
    rows = [rows_of(w) for w in dict.fromkeys(text.split())]
    if not rows:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    flat = np.fromiter((r for found in rows for r in found), dtype=np.int64)
    sums = np.bincount(flat, minlength=ROWS)
    at = np.flatnonzero(sums)
    return at.astype(np.int32), (sums[at] / (len(flat) + PRIOR_ROWS)).astype(np.float32)


class Model:
    """Embeddings and softmax. ``fit`` is deterministic in the order of the samples."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((ROWS, WIDTH), dtype=np.float32)  # rows that training does not see add nothing
        self.weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adam on the cross entropy, over the table and the softmax at once."""
        rng = np.random.default_rng(seed)
        often = np.bincount(np.concatenate([at for at, _ in bags]), minlength=ROWS) >= max(LEAST_SAMPLES, LEAST_SHARE * len(bags))
        bags = [(at[often[at]], share[often[at]]) for at, share in bags]
        params = [self.table, self.weights, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.concatenate([rng.permutation(len(bags)) for _ in range(-(-steps * BATCH // len(bags)))])
        for step in range(1, steps + 1):
            mine = order[(step - 1) * BATCH : step * BATCH]
            at = np.concatenate([bags[i][0] for i in mine])
            share = np.concatenate([bags[i][1] for i in mine])
            of = np.repeat(np.arange(len(mine)), [len(bags[i][0]) for i in mine])
            part = self.table[at] * share[:, None]
            hidden = np.stack([np.bincount(of, part[:, k], len(mine)) for k in range(WIDTH)], axis=1).astype(np.float32)
            logits = SCALE * hidden @ self.weights + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), labels[mine]] -= 1
            p /= len(mine)
            back = SCALE * p @ self.weights.T
            pull = back[of] * share[:, None]
            touched, where = np.unique(at, return_inverse=True)
            grads = [np.stack([np.bincount(where, pull[:, k], len(touched)) for k in range(WIDTH)], axis=1), SCALE * hidden.T @ p, p.sum(axis=0)]
            for k, (param, grad) in enumerate(zip(params, grads, strict=True)):
                rows = touched if k == 0 else slice(None)
                m, v = first[k], second[k]
                m[rows] = 0.9 * m[rows] + 0.1 * grad
                v[rows] = 0.98 * v[rows] + 0.02 * grad**2
                param[rows] -= (RATE * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.98**step)) + 1e-9)).astype(np.float32)

    def amounts(self) -> tuple[np.ndarray, float]:
        """What each row adds to the difference of the logits, and their difference without any."""
        return (SCALE * self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(key, label, rows, shares) of at most about ``most`` labelled rows of each class, none of them held out.

    A key with several labels has the largest; null labels and keys are left out.
    Which rows are taken depends on a hash of the key alone.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # a row for each class
    taken = F.lit(False)
    for y, n in counts.items():
        taken = taken | ((F.col("y") == y) & (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / n)))))
    chosen = F.broadcast(known.where(taken))  # 2 x most rows
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("shares", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in bags], pa.binary()), pa.array([b.tobytes() for _, b in bags], pa.binary())], names=["k", "y", "rows", "shares"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(chosen, "k").select(F.col("k").cast("string").alias("k"), "y", "t").mapInArrow(released(run), schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_OF_CLASS) -> tuple[np.ndarray, float]:
    """Fit a model on a bounded sample; returns its amounts.

    Both classes weigh the same, so a score tells the odds as if they were equally
    common. Without labels of both classes nothing is
    learnt: all amounts are zero and the bias tells the one share (half, if none).
    """
    sample = training_rows(docs, labels, key, text, label, most)
    sample = written(sample, "sample")
    size = sample.agg(F.sum(F.octet_length("rows") + F.octet_length("shares"))).first()[0] or 0
    if size > MOST_BYTES:
        sample = sample.where(F.pmod(F.xxhash64("k", F.lit("thin")), F.lit(1 << 30)) < F.lit(int((1 << 30) * MOST_BYTES / size)))
    rows = sorted(sample.toArrow().to_pylist(), key=lambda r: (r["k"], r["y"], r["shares"], r["rows"]))
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return np.zeros(ROWS), 4.0 * (1 if len(y) and y[0] else -1 if len(y) else 0)
    bags = [(np.frombuffer(r["rows"], dtype=np.int32), np.frombuffer(r["shares"], dtype=np.float32)) for r in rows]
    del rows
    # as many of the smaller class as of the larger, by repetition
    many = int(y.sum() * 2 > len(y))
    again = np.r_[np.arange(len(y)), np.resize(np.flatnonzero(y != many), abs(int(len(y) - 2 * y.sum())))]
    model = Model()
    model.fit([bags[i] for i in again], y[again])
    return model.amounts()


def score(docs: DataFrame, amounts: np.ndarray, bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, held_out, score, predicted. Whole texts; an empty or null one has the score of the bias."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(amounts)  # ROWS doubles
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.tolist()

        class Kept(dict):
            """Of each word: what its rows add, and how many they are, as the parts of one number."""

            def __missing__(self, word: str) -> complex:
                rows = rows_of(word)
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[word] = both = complex(sum([table[r] for r in rows]), len(rows))
                return both

        kept = Kept()
        for batch in batches:
            out = []
            for value in batch.column(1):
                total = sum(map(kept.__getitem__, dict.fromkeys((value.as_py() or "").split())), 0j)
                x = bias + total.real / (total.imag + PRIOR_ROWS)
                out.append(1 / (1 + np.exp(-min(50.0, max(-50.0, x)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["k", "score"])

    scored = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(released(run), schema)
    return scored.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Train on ``labels`` outside the held-out rows, and score every row of ``docs``.

    Null keys count as not held out; repeated rows score alike; an empty table
    gives an empty result; only the text makes the score.
    """
    return score(docs, *train(docs, labels, key, text, label), key, text)
