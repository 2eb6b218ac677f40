"""URL filters by rules and by a tree of path templates.

Every host's paths form a tree of segments. Segments that vary (numbers, codes,
or one of many siblings) are generalised into wildcards, level by level from the
host down; literal branches of one place whose labels are statistically alike are
merged into one wildcard as well. A template is then judged by the smoothed share
of its labelled URLs that rules block.

Levels are aggregated tables: no host's paths ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule). A rule is a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A place with more different literal segments than this, or whose commonest has less than this share, is variable.
MOST_SIBLINGS, LEAST_TOP_SHARE = 24, 0.02
#: A branch of a variable place is small with less than ``LEAST_TOP_SHARE`` of its rows and fewer labels than this.
LEAST_LABELS = 4
#: Branches are alike if no share of theirs differs by more than this many standard errors, and can be told alike from so many rows on.
ALIKE, LEAST_ROWS = 2.0, 4
#: Prior labels added to each template (with its host's share), and to each host (with the share below); the share at which a template is rejected.
PRIOR_LABELS, PRIOR_SHARE, REJECT = 4.0, 0.2, 0.8
#: Levels at which branches are compared with their siblings; what is deeper is generalised by its looks alone, each segment for itself.
LEVELS = 16
#: What may follow a segment, by looks: the end, a wildcard, or a word.
NEXT = ("end", "{n}", "{d}", "{x}", "{c}", "word")


def host_of(url: Column) -> Column:
    """The host: after the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` or a host."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """The path: after the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. A rule fits its host and all subdomains where the path starts with its own."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried first: it ends up outermost
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def _kind(segment: Column) -> Column:
    """The wildcard of a segment that varies by its looks, else null: a number, a date, a code of letters and digits; endings are kept."""
    stem, ending = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    mark = F.when(stem.rlike(r"^[0-9]+$"), "{n}").when(stem.rlike(r"^[0-9]{2,4}([-_.][0-9]{1,2}){1,2}$"), "{d}").when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{x}").when(stem.rlike(r"[0-9]{3,}"), "{c}")
    return F.when(mark.isNotNull(), F.concat(mark, ending))


def _share(blocked: Column, labelled: Column, prior: Column | float = PRIOR_SHARE) -> Column:
    return (blocked + PRIOR_LABELS * prior) / (labelled + PRIOR_LABELS)


def _differs(x: Column, n: Column, y: Column, m: Column, prior: float) -> Column:
    """Whether two shares, x of n and y of m, differ by more than chance, each with prior counts."""
    pooled = _share(x + y, n + m, prior)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (n + PRIOR_LABELS) + 1 / (m + PRIOR_LABELS)))
    return F.abs(_share(x, n, prior) - _share(y, m, prior)) > ALIKE * error


def _follows(segments: Column, level: int) -> Column:
    """What follows the segment of a level, one of ``NEXT``."""
    following = F.get(segments, F.lit(level + 1))
    return F.when(following.isNull(), F.lit("end")).otherwise(F.coalesce(F.regexp_extract(_kind(following), r"^(\{.\})", 1), F.lit("word")))


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of ``pages`` (host, path, labelled, blocked; counts): paths with their templates, and templates with their counts.

    Level by level, each (host, template so far) is a place and the next segments
    its branches. Looks decide first; then a place with too many branches, or none
    common, takes one wildcard for all that are small; then branches that are
    statistically alike to their siblings (those that are mostly followed by the same
    kind of segment, taken together) are merged into it too: what follows them must
    have the same shares, and their blocked shares must agree where both sides have
    labels. So labels reach unlabelled branches that are
    built in the same way, and a branch that is labelled differently stays apart.
    Each level joins aggregated counts only; a path leaves when it has no more
    segments.
    """
    paths = pages.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    open_ = written(paths.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("at", F.lit("")), "paths")
    depth = min(LEVELS, open_.agg(F.max(F.size("segments"))).first()[0] or 0)
    done = None
    for level in range(depth):
        segment = F.get("segments", F.lit(level))
        rows = open_.withColumn("looks", _kind(segment)).withColumn("step", F.coalesce("looks", segment)).withColumn("after", _follows(F.col("segments"), level))
        # branches that looks have not settled
        kinds = [F.sum(F.when(F.col("after") == k, F.col("n")).otherwise(0)).alias(f"f{i}") for i, k in enumerate(NEXT)]
        branches = rows.where(F.col("looks").isNull()).groupBy("host", "at", "step").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), *kinds)
        every = [F.sum(c).alias(f"all_{c}") for c in ("n", "l", "b", *[f"f{i}" for i in range(len(NEXT))])]
        most = F.greatest(*[F.col(f"f{i}") for i in range(len(NEXT))])
        branches = branches.withColumn("mostly", F.coalesce(*[F.when(F.col(f"f{i}") == most, F.lit(i)) for i in range(len(NEXT))]))
        places = branches.groupBy("host", "at").agg(F.count("*").alias("k"), F.max("n").alias("top"), F.sum("n").alias("place_n"))
        siblings = branches.groupBy("host", "at", "mostly").agg(*every)
        seen = branches.join(places, ["host", "at"]).join(siblings, ["host", "at", "mostly"])
        other = lambda c: F.col(f"all_{c}") - F.col(c)
        apart = F.lit(False)
        for i in range(len(NEXT)):
            apart = apart | _differs(F.col(f"f{i}"), F.col("n"), other(f"f{i}"), other("n"), 1 / len(NEXT))
        labelled = (F.col("l") > 0) & (other("l") > 0) & _differs(F.col("b"), F.col("l"), other("b"), other("l"), PRIOR_SHARE)
        alike = (F.col("n") >= LEAST_ROWS) & (other("n") >= LEAST_ROWS) & ~apart & ~labelled
        variable = (F.col("k") > MOST_SIBLINGS) | (F.col("top") < LEAST_TOP_SHARE * F.col("place_n"))
        small = (F.col("n") < LEAST_TOP_SHARE * F.col("place_n")) & (F.col("l") < LEAST_LABELS)
        merged = seen.where((F.col("k") > 1) & (variable & small | alike)).select("host", "at", "step", F.lit(True).alias("merged"))
        rows = rows.join(merged, ["host", "at", "step"], "left")
        wild = F.when(F.coalesce("merged", F.lit(False)), F.lit("*")).otherwise(F.col("step"))
        moved = written(rows.withColumn("at", F.concat("at", F.lit("/"), wild)).drop("looks", "step", "merged", "after"), f"level{level}")
        ended = moved.where(F.size("segments") <= level + 1)
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.where(F.size("segments") > level + 1)
    rest = F.transform(F.slice("segments", LEVELS + 1, F.greatest(F.size("segments") - LEVELS, F.lit(1))), lambda s: F.coalesce(_kind(s), s))
    deep = open_.withColumn("at", F.concat("at", F.lit("/"), F.array_join(rest, "/")))
    paths = (deep if done is None else done.unionByName(deep)).withColumnRenamed("at", "template")
    counts = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    hosts = counts.groupBy("host").agg(_share(F.sum("blocked"), F.sum("labelled")).alias("prior"))
    judged = counts.join(hosts, "host").withColumn("purity", _share(F.col("blocked"), F.col("labelled"), F.col("prior"))).withColumn("verdict", F.when((F.col("labelled") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow"))
    return paths.select("host", "path", "template"), judged


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row for each row: key, host, path, rule, verdict (and template).

    A URL that a rule fits has the rule's verdict, and labels its template with
    it; any other has the verdict of its template: block, if the smoothed share of
    blocked ones among its labels is at least ``REJECT``. A null URL, or one without
    ``://``, has an empty host and path, which no rule fits and no label reaches:
    allow. Repeated rows and null keys are judged alike; an empty table gives an
    empty result; other columns are ignored.
    """
    slim = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    parts = slim.select("_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    parts = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = parts.select("_key", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_by_rule"))
    counted = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("_by_rule").alias("labelled"), F.count(F.when(F.col("_by_rule") == "block", 1)).alias("blocked"))
    named, judged = templates(counted)
    # written, so that the paths of a large template can be split in the join
    judged = written(judged.select("host", "template", F.col("verdict").alias("_by_tree")), "templates")
    verdicts = named.join(judged, ["host", "template"])
    return rows.join(verdicts, ["host", "path"], "left").select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_by_rule", "_by_tree", F.lit("allow")).alias("verdict"), "template")
