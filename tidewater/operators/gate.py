"""The gate: filters, two-quota top-k, escalation, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ingest import first_match


def dispositions(tasks: DataFrame, least: float = 0.6, by: tuple[str, ...] = ("window_id",), most_tasks: int = 4, most_updates: int = 2) -> DataFrame:
    """tasks with disposition: out_of_scope, duplicate, low_worth, accepted, accepted_update or deferred.

    Candidates are taken by worth, new topics before updates, then question and order of arrival; at most most_tasks in
    all and most_updates updates for each window, which is a closed form of the greedy choice.
    """
    known = F.coalesce(F.trim("duplicate_of"), F.lit("")) != ""
    update = known & (F.coalesce(F.trim("new_information"), F.lit("")) != "")
    first = first_match([(~F.coalesce("in_scope", F.lit(True)), "out_of_scope"), (known & ~update, "duplicate"), (F.coalesce("worth", F.lit(0.0)) < least, "low_worth")], "candidate")
    t = tasks.withColumn("disposition", first).withColumn("is_update", update)
    order = [F.col("worth").desc(), F.col("is_update"), F.col("question"), F.col("seq")]
    own = Window.partitionBy(*by, "disposition", "is_update").orderBy(*order)
    t = t.withColumn("__may", (F.col("disposition") == "candidate") & (~F.col("is_update") | (F.row_number().over(own) <= most_updates)))
    taken = F.col("__may") & (F.row_number().over(Window.partitionBy(*by, "__may").orderBy(*order)) <= most_tasks)
    final = F.when(F.col("disposition") != "candidate", F.col("disposition")).when(taken & F.col("is_update"), "accepted_update").when(taken, "accepted").otherwise("deferred")
    return t.withColumn("disposition", final).drop("__may")


def escalation(difficulty: Column, answered: Column, resolved: Column, reason: Column, confidence: Column, n_sources: Column) -> Column:
    """Why a task goes to the costly stage, or null. The reasons are fixed values."""
    return (
        F.when(~F.coalesce(answered, F.lit(False)), "cheap pass failed or returned nothing").when(difficulty == "high", "triage marked difficulty high")
        .when(~F.coalesce(resolved, F.lit(False)), F.coalesce(F.nullif(reason, F.lit("")), F.lit("cheap pass did not resolve")))
        .when(confidence.isin("single-source", "unverified"), F.concat(F.lit("cheap answer only reached "), confidence))
        .when((F.coalesce(n_sources, F.lit(0)) < 2) & ~confidence.eqNullSafe(F.lit("primary")), "fewer than two sources and not primary")
    )


def grounded(records: DataFrame, retrieved: DataFrame, key: str = "task_id") -> DataFrame:
    """records with only the evidence whose url was retrieved for their key, n_dropped, and grounded (any left).

    The retrieved urls are joined as one set for each key.
    """
    urls = retrieved.groupBy(key).agg(F.collect_set(F.trim("url")).alias("__urls"))
    allowed = F.coalesce("__urls", F.array().cast("array<string>"))
    out = records.join(urls, key, "left").withColumn("__n", F.size("evidence")).withColumn("evidence", F.filter("evidence", lambda e: F.array_contains(allowed, F.trim(e["url"]))))
    return out.withColumn("n_dropped", F.col("__n") - F.size("evidence")).withColumn("grounded", F.size("evidence") > 0).drop("__n", "__urls")


def kept_task_urls(urls: Column, kept: Column) -> Column:
    """Task urls that are verbatim among the kept ones and hold no placeholder."""
    return F.filter(F.array_intersect(urls, kept), lambda u: ~F.contains(u, F.lit("[")))


def counts(tasks: DataFrame, *by: str) -> DataFrame:
    """How many tasks of gate.dispositions went where; accepted holds the updates among them."""
    n = lambda *d: F.coalesce(F.count_if(F.col("disposition").isin(*d)), F.lit(0))
    return tasks.groupBy(*by).agg(
        n("accepted", "accepted_update").alias("accepted"), n("accepted_update").alias("accepted_updates"), n("out_of_scope").alias("rejected_out_of_scope"),
        n("low_worth").alias("rejected_low_worth"), n("duplicate").alias("rejected_duplicate"), n("deferred").alias("deferred_over_cap"),
    )
