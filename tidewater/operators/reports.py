"""Reports: digest, changelog, dashboard, summary, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.archive import status_order
from tidewater.schemas import FINDING_ORDER


def in_order(value: str, *order: str):
    """The values of a group as a list, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])


def digest(pages: DataFrame, limit: int = 600) -> DataFrame:
    """folder, lines, and in the row without a folder how many pages were left out beyond the limit (path, title)."""
    kept = pages.orderBy("path").limit(limit).withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)).withColumn("line", F.concat(F.lit("- "), F.coalesce("title", "path")))
    left = pages.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("folder"), F.concat(F.col("n").cast("string"), F.lit(" more")).alias("lines")).where("lines <> '0 more'")
    return kept.groupBy("folder").agg(F.array_join(in_order("line", "path"), "\n").alias("lines")).unionByName(left)


def changelog(entries: DataFrame) -> DataFrame:
    """month, text: a section for each day (date, ord, line)."""
    days = entries.groupBy(F.substring("date", 1, 7).alias("month"), "date").agg(F.array_join(in_order("line", "ord"), "\n").alias("t"))
    days = days.withColumn("section", F.concat(F.lit("## "), "date", F.lit("\n"), "t"))
    return days.groupBy("month").agg(F.array_join(in_order("section", "date"), "\n\n").alias("text"))


def dashboard(topics: DataFrame) -> DataFrame:
    """status, n, lines: sections in reading order, entries by title."""
    line = F.concat(F.lit("- [["), "stem", F.lit("]] — "), F.coalesce(F.nullif("headline", F.lit("")), F.lit("no headline")), F.lit(" ("), F.coalesce(F.nullif("last_verified", F.lit("")), F.lit("never verified")), F.lit(")"))
    rows = topics.withColumn("line", line)
    return rows.groupBy("research_status").agg(F.count(F.lit(1)).alias("n"), F.array_join(in_order("line", "title", "stem"), "\n").alias("lines")).orderBy(status_order(F.col("research_status")), "research_status")


def summary(records: DataFrame, most: int = 6) -> DataFrame:
    """finding, lines: the first titles of each finding and how many more, in a fixed order; no rows without records."""
    place = F.coalesce(*(F.when(F.col("finding") == f, F.lit(i)) for i, f in enumerate(FINDING_ORDER)), F.lit(len(FINDING_ORDER)))
    r = records.withColumn("__r", F.row_number().over(Window.partitionBy("finding").orderBy("seq")))
    n = records.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))
    top = r.where(F.col("__r") <= most).groupBy("finding").agg(in_order("title", "__r").alias("t")).join(n, "finding")
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return top.select("finding", F.array_join(F.concat(F.transform("t", lambda x: F.concat(F.lit("• "), x)), more), "\n").alias("lines"), place.alias("ord")).orderBy("ord", "finding")


def last_runs(runs: DataFrame, n: int, attempted: str = "cheap_attempted", resolved: str = "cheap_resolved", order: str = "ts") -> DataFrame:
    """Sums and the resolve rate (three places, null without attempts) of the last n runs."""
    last = runs.orderBy(F.desc(order)).limit(n)
    sums = last.agg(F.count(F.lit(1)).alias("runs"), F.sum(attempted).alias("attempted"), F.sum(resolved).alias("resolved"))
    return sums.withColumn("rate", F.round(F.try_divide("resolved", "attempted"), 3))


def findings_histogram(records: DataFrame, by: str = "finding") -> DataFrame:
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def roster_coverage(roster: DataFrame) -> DataFrame:
    """How much a roster covers; what it lacks counts as none."""
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).alias(c)
    return roster.select(*(n(c) for c in ("names", "handles", "phones", "opted_out")), F.when(F.coalesce("group_name", F.lit("")) != "", 1).otherwise(0).alias("group_name"))


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%"))


def disposition_counts(rows: DataFrame, *by: str, disposition: str = "disposition") -> DataFrame:
    return rows.groupBy(*by, disposition).agg(F.count(F.lit(1)).alias("n"))
