"""Every operator on null, empty, long, tied, repeated and oddly named input."""

import pytest

from meshloom.llm import decontamination, packing, quality, secrets, sharding, simhash, substrings, toxicity, urls, warc
from tests.llm.helpers import awkward, clashing, documents, empty


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 10)] + [(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "packing": lambda s, d: packing.pack(d),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "sharding": lambda s, d: sharding.shard_records(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "similar": lambda s, d: simhash.similar_documents(d),
    "decontamination": lambda s, d: decontamination.contaminated(d, bench(s)),
    "quality": lambda s, d: quality.quality_rules(d),
    "secrets": lambda s, d: secrets.scan(d),
    "urls": lambda s, d: urls.judge(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("source", "url")),
    "warc": lambda s, d: warc.archive_pages(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")),
}
#: Operators that tell a row for each row.
WHOLE = set(OPERATORS) - {"packing", "decontamination"}
FILTERS = {
    "quality": lambda s, d: quality.kept_documents(d),
    "simhash": lambda s, d: simhash.deduplicated(d),
    "decontamination": lambda s, d: decontamination.clean_documents(d, bench(s)),
    "secrets": lambda s, d: secrets.redact(d),
}


def told(df):
    frame = df.toPandas()
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    n = OPERATORS[name](spark, docs).count()
    assert n == docs.count() if name in WHOLE else n >= 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    docs = documents(spark, [(i, f"row {i} of some words that are all here to be read", "h://a.net/x") for i in range(12)])
    columns = sorted(set(OPERATORS[name](spark, docs).columns) - {"archive"})  # archives have fresh names
    got, want = OPERATORS[name](spark, clashing(docs)).select(columns), OPERATORS[name](spark, docs).select(columns)
    assert told(got) == told(want)


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(spark, name):
    """Columns of clashing names keep their values: what is kept is the same as without them."""
    docs = awkward(spark)
    plain = FILTERS[name](spark, docs)
    assert FILTERS[name](spark, empty(spark)).count() == 0
    kept = FILTERS[name](spark, clashing(docs))
    assert plain.columns == docs.columns and kept.columns == clashing(docs).columns
    assert told(kept.select(docs.columns)) == told(plain)
    other = [c for c in kept.columns if c not in docs.columns]
    assert all(r[c] == r["doc_id"] for r in kept.collect() for c in other)


def test_session_stays_as_it_was(spark):
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    for run in (OPERATORS["simhash"], FILTERS["secrets"]):
        run(spark, documents(spark, [(1, "a few words", "a")])).count()
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")} == before
