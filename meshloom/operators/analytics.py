"""Analytics over benchmark logs: phases, runs, breakdowns, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of phases and the names under which logs have them.
GROUPS = (
    ("Selectivity estimation", ("selectivity estimation",)),
    ("Edge raytrace Mesh1->Mesh2", ("raytrace_hash_mesh1tomesh2", "raytrace_overlap_hash_mesh1tomesh2")),
    ("Edge raytrace Mesh2->Mesh1", ("raytrace_hash_mesh2tomesh1", "raytrace_overlap_hash_mesh2tomesh1")),
    ("Containment raytrace Mesh1->Mesh2", ("raytrace_containment_hash_mesh1tomesh2",)),
    ("Containment raytrace Mesh2->Mesh1", ("raytrace_containment_hash_mesh2tomesh1",)),
    ("Download results", ("download results",)),
    ("Hash compaction", ("compact_hash_table_pairs", "compact_hash_table_pairs (containment)", "compact_hash_table_pairs (overlap)", "deduplication", "gpu deduplication")),
)
#: Phases that make up the query time.
QUERY_PHASES = ("selectivity estimation", "raytrace_hash_mesh1tomesh2", "raytrace_hash_mesh2tomesh1", "raytrace_overlap_hash_mesh1tomesh2", "raytrace_overlap_hash_mesh2tomesh1", "compact_hash_table_pairs", "download results")


def phase_rollup(phases: DataFrame) -> DataFrame:
    """(run, phase, ms) summed over repeats: names in lower case, without their trailing number."""
    name = F.regexp_replace(F.lower("phase"), r"_\d+$", "")
    return phases.groupBy("run", name.alias("phase")).agg(F.sum("ms").alias("ms"))


def query_time(rolled: DataFrame, named: tuple[str, ...] = QUERY_PHASES, fallback: tuple[str, ...] = ("execute hash query", "query")) -> DataFrame:
    """Per run: the sum of the named phases, or the first fallback phase that has time."""
    of = lambda names: F.sum(F.when(F.col("phase").isin(*names), F.col("ms")).otherwise(F.lit(0.0)))
    sums = rolled.groupBy("run").agg(of(named).alias("q"), *[of((f,)).alias(f"f{i}") for i, f in enumerate(fallback)])
    value = F.when(F.col("q") > 0, F.col("q"))
    return sums.select("run", F.coalesce(value, *[F.when(F.col(f"f{i}") > 0, F.col(f"f{i}")) for i in range(len(fallback))], F.lit(0.0)).alias("query_ms"))


def run_stats(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.count("*").alias("runs"))


def breakdown_groups(rolled: DataFrame) -> DataFrame:
    """Per run: time of each group of phases that has any."""
    group = F.coalesce(*[F.when(F.col("phase").isin(*names), F.lit(g)) for g, names in GROUPS])
    return rolled.withColumn("group", group).where("group is not null").groupBy("run", "group").agg(F.sum("ms").alias("ms")).where("ms > 0")


def _metric(text: Column, label: str) -> Column:
    pattern = label + r":\s*([\d.]+)\s*(s|ms)?"
    number = F.regexp_extract(text, pattern, 1)
    value = F.when(number != "", number.cast("double"))
    return value * F.when(F.regexp_extract(text, pattern, 2) == "s", F.lit(1000.0)).otherwise(F.lit(1.0))


def store_metrics(reports: DataFrame) -> DataFrame:
    """(run, text) reports of the compressed store, as milliseconds, with the sums that count as query, preparation and loading."""
    t = F.col("text")
    rows = reports.select(
        "run", _metric(t, "total").alias("total_ms"), _metric(t, "index").alias("index_ms"), _metric(t, "decode").alias("decode_ms"), F.coalesce(_metric(t, "prepare"), _metric(t, "packing")).alias("prepare_ms"),
        F.coalesce(_metric(t, "compute"), _metric(t, "computation")).alias("compute_ms"), F.coalesce(_metric(t, "evaluate"), _metric(t, "updatelist")).alias("evaluate_ms"), _metric(t, "other").alias("other_ms"),
    )
    return rows.withColumn("query_ms", F.col("index_ms") + F.col("compute_ms") + F.col("evaluate_ms")).withColumn("preprocessing_ms", F.col("index_ms") + F.col("decode_ms") + F.col("prepare_ms"))


def latest_complete_run(values: DataFrame, required: list[str]) -> DataFrame:
    """(series, run, metric, value) of the latest run of each series that has every required metric."""
    complete = values.where(F.col("metric").isin(*required) & F.col("value").isNotNull()).groupBy("series", "run").agg(F.count_distinct("metric").alias("n")).where(F.col("n") == len(required))
    latest = complete.groupBy("series").agg(F.max("run").alias("run"))
    return values.join(latest, ["series", "run"], "left_semi")


def dataset_table(triangles: DataFrame, by: str = "dataset") -> DataFrame:
    """Objects, triangles and bytes (36 a triangle) of each dataset, and a label."""
    rows = triangles.groupBy(by).agg(F.count_distinct("object_id").alias("objects"), F.count("*").alias("triangles"))
    return rows.withColumn("bytes", F.col("triangles") * 36).withColumn("label", F.format_string("%s & %d & %d", F.col(by), F.col("objects"), F.col("triangles")))


def speedup(times: DataFrame, base: str, other: str) -> DataFrame:
    """(key, mode, ms): ratio of one mode to another for each key."""
    side = lambda m, n: times.where(F.col("mode") == m).select("key", F.col("ms").alias(n))
    return side(base, "b").join(side(other, "o"), "key").select("key", (F.col("b") / F.nullif(F.col("o"), F.lit(0.0))).alias("speedup"))


def timing_phases(events: DataFrame) -> DataFrame:
    """(run, seq, name, us): names in lower case, numbered by their repeats within a run, as a timing report has them."""
    n = F.row_number().over(Window.partitionBy("run", F.lower("name")).orderBy("seq"))
    return events.select("run", F.concat_ws("_", F.lower("name"), n.cast("string")).alias("phase"), F.col("us").alias("duration_us"), (F.col("us") / F.lit(1000.0)).alias("duration_ms"))
