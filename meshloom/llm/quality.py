"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line that many different documents of one host carry is that host's
boilerplate. Normalised lines are hashed, distinct documents are counted per host
and line, lines above the limits are removed, and a document that keeps too
little of itself is rejected. Rules on one text alone are checked beside this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, renamed, sent_if_small, words, written

#: Fixed thresholds of the rules on one text.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate of its host if at least this many different texts of the host, and this share of them, have it.
MIN_LINE_DOCS = 10
MIN_LINE_SHARE = 0.02
#: A document is depleted if less than this share of its words is left.
MIN_KEPT_SHARE = 0.4

SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and give it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, given the hashes of all windows in order."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda at, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(starts, k + 1), at + REPEAT_WINDOW) - at))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(pairs: Column) -> Column:
        found = F.filter(pairs, lambda x, k: F.get(pairs, k - 1)["h"].eqNullSafe(x["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(x["h"]))
        return _let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, repeated)).cast("long")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct column ``_q`` with the counts of each text and ``base_failed``.

    A null text counts as empty; an empty text has no words and so fails.
    Windows are compared by 64-bit hashes of their words, within one text only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(n < REPEAT_WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(REPEAT_WINDOW)) - (REPEAT_WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, REPEAT_WINDOW)))
        )

    def counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_words"), F.length(F.concat_ws("", found)).cast("long").alias("word_chars"), _let(F.transform(found, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), _repeat_words)).alias("n_repeat_words"))

    # one expression, in which nothing is evaluated twice wherever the optimizer moves it
    counted = F.struct(
        _let(words(F.col(text)), counts).alias("w"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )

    def told(c: Column) -> Column:
        n, repeated = c["w"]["n_words"], c["w"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (F.lit(100) * repeated > F.lit(MAX_REPEAT_PERCENT) * n)
        return F.struct(n.alias("n_words"), c["w"]["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"))

    return docs.withColumn("_q", _let(counted, told))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00"))


def line_table(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """Every line with a word, written once: (_key, _host, _text, _n, _pos, _line, _w), names and numbers only; a document without such lines has one row with a null line.

    A line's name are two 64-bit hashes of the normalised line; _n is the document's
    number of words and _w the line's.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    who = docs.select(F.col(key).alias("_key"), _host(host).alias("_host"), F.xxhash64(body).alias("_text"), body.alias("_body"))
    plain = F.transform(F.split("_body", "\n"), lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(SPACES))), SPACE_CLASS + "+", " "))
    named = F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), F.when(x == "", F.lit(0)).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))
    split = who.select("_key", "_host", "_text", _let(named, lambda lines: F.struct(F.filter(lines, lambda x: x["w"] > 0).alias("lines"), F.aggregate(lines, F.lit(0), lambda s, x: s + x["w"]).alias("n"))).alias("_l"))
    rows = split.select("_key", "_host", "_text", F.col("_l.n").alias("_n"), F.posexplode_outer("_l.lines").alias("_pos", "_x"))
    return written(rows.select("_key", "_host", "_text", "_n", "_pos", F.when(F.col("_x").isNotNull(), F.struct("_x.a", "_x.b")).alias("_line"), F.col("_x.w").alias("_w")), "lines")


def boilerplate(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The boilerplate lines (host, line, documents) and, for each document that has some, its words and those they take.

    Documents with equal texts are one document, told once: a page that a host has
    under ten addresses does not turn its own lines into boilerplate. A null host is
    a host of its own. Lines of any length count.
    """
    lines = line_table(docs, key, host, text)
    sizes = lines.groupBy("_host", "_text").count().groupBy("_host").agg(F.count("*").alias("_texts"))
    there = lines.where(F.col("_line").isNotNull())
    counted = there.groupBy("_host", "_line", "_text").count().groupBy("_host", "_line").agg(F.count("*").alias("_docs"))
    common = counted.where(F.col("_docs") >= MIN_LINE_DOCS).join(sizes, "_host").where(F.col("_docs") >= F.lit(MIN_LINE_SHARE) * F.col("_texts")).select("_host", "_line", "_docs")
    taken = there.join(common.select("_host", "_line"), ["_host", "_line"]).groupBy("_key", "_host", "_text", "_pos").agg(F.max("_w").alias("_w"), F.max("_n").alias("_n")).groupBy("_key", "_host", "_text").agg(F.sum("_w").alias("_taken"), F.max("_n").alias("_n"))
    return common, taken


def _depleted(n_words: Column, taken: Column) -> Column:
    return (n_words - taken) < F.lit(MIN_KEPT_SHARE) * n_words


def quality_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, the base counts, base_failed, removed_words and kept.

    ``kept`` is false if a base rule failed or the document is depleted by the
    removal of its host's boilerplate lines. Null texts are empty (and rejected);
    null keys and repeated rows are kept apart by nothing but their text and host,
    which decide everything here. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), _host(host).alias("_host"), F.xxhash64(body).alias("_text"), F.col(text).alias("text"))
    base = base_rules(slim).drop("text")
    _, taken = boilerplate(docs, key, host, text)
    taken = taken.select(F.col("_key").alias("_k"), F.col("_host").alias("_h"), F.col("_text").alias("_t"), "_taken")
    joined = base.join(taken, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_host") == F.col("_h")) & (F.col("_text") == F.col("_t")), "left")
    removed = F.coalesce(F.col("_taken"), F.lit(0)).cast("long")
    return joined.select(
        F.col("_key").alias(key), "_q.*", removed.alias("removed_words"), (~F.col("_q.base_failed") & ~_depleted(F.col("_q.n_words"), removed)).alias("kept")
    )


def kept_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns, of whatever names, as they were.

    Null and empty texts go; repeated rows stay or go together; an empty table gives an empty one.
    """
    mine, names = renamed(docs)
    key, host, text = (names[docs.columns.index(c)] for c in (key, host, text))
    body = F.coalesce(F.col(text), F.lit(""))
    base = base_rules(mine, text).where(~F.col("_q.base_failed"))
    _, taken = boilerplate(mine, key, host, text)
    gone = written(taken.where(_depleted(F.col("_n"), F.col("_taken"))).select(F.col("_key").alias("_k"), F.col("_host").alias("_h"), F.col("_text").alias("_t")), "depleted")
    same = F.col(key).eqNullSafe(F.col("_k")) & (_host(host) == F.col("_h")) & (F.xxhash64(body) == F.col("_t"))
    return base.join(sent_if_small(gone), same, "left_anti").select(*names).toDF(*docs.columns)
