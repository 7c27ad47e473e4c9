"""Windows of pending messages: one run from messages to merged topics, and which messages it takes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import archive, firewall, gate, store


@dataclass(frozen=True)
class Steps:
    """What a window asks of models, as functions of tables.

    request: the messages taken -> window_id, payload. triage: requests that passed -> the tasks of gate.dispositions with
    task_id, window_id and refused (a window without an answer has a row with refused). research: accepted tasks ->
    records of archive.merge_topics with task_id. retrieved: accepted tasks -> task_id, url.
    """

    request: Callable[[DataFrame], DataFrame]
    triage: Callable[[DataFrame], DataFrame]
    research: Callable[[DataFrame], DataFrame]
    retrieved: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    """The tables after a window."""

    store: DataFrame
    topics: DataFrame
    tasks: DataFrame
    quarantine: DataFrame
    outcomes: DataFrame


def outcome(blocked: Column, refused: Column, candidates: Column) -> Column:
    """What a window came to: blocked, refused, idle (nothing to look into) or done; nulls are no, and none."""
    no = F.lit(False)
    return F.when(F.coalesce(blocked, no), "blocked").when(F.coalesce(refused, no), "refused").when(F.coalesce(candidates, F.lit(0)) == 0, "idle").otherwise("done")


def is_consumed(outcome: Column) -> Column:
    """A refused window stays pending, as an answer may come another time; a blocked one would be blocked again."""
    return outcome != "refused"


def settle(messages: DataFrame, taken: DataFrame, outcomes: DataFrame) -> DataFrame:
    """messages with processed_window set for what consumed windows took.

    taken: source, raw_ts, window_id; outcomes: window_id, outcome. Windows without an outcome stay pending, messages taken
    before keep their window, and of several windows the least counts.
    """
    done = taken.join(outcomes.where(is_consumed(F.col("outcome"))).select("window_id").distinct(), "window_id", "left_semi")
    per = done.groupBy(*store.KEY).agg(F.min("window_id").alias("__w"))
    return messages.join(per, list(store.KEY), "left").withColumn("processed_window", F.coalesce("processed_window", "__w")).drop("__w")


def run_window(messages: DataFrame, topics: DataFrame, window: str, steps: Steps, today: str, most: int = 5000, **policy) -> Run:
    """One window over the oldest pending messages, at least once: nothing is marked before all is merged.

    The caller writes the tables of the result, the store last; as topics merge by key, a window that runs again after a
    crash changes nothing. The steps' answers are read more than once, so they should be tables that are written.
    """
    taken = store.pending(messages, most).withColumn("window_id", F.lit(window))
    passed, blocked = firewall.guard(steps.request(taken), "payload", **policy)
    answers = steps.triage(passed)
    tasks = gate.dispositions(answers.where("not coalesce(refused, false)").drop("refused"))
    accepted = tasks.where("disposition in ('accepted', 'accepted_update')")
    records = gate.grounded(steps.research(accepted), steps.retrieved(accepted)).where("grounded").drop("n_dropped", "grounded", "task_id")
    merged = archive.merge_topics(topics, records, today)
    per = answers.groupBy("window_id").agg(F.bool_or(F.coalesce("refused", F.lit(False))).alias("refused"), F.count_if(~F.coalesce("refused", F.lit(False))).alias("candidates"))
    seen = taken.select("window_id").distinct().join(blocked.select("window_id", F.lit(True).alias("blocked")).distinct(), "window_id", "left").join(per, "window_id", "left")
    outcomes = seen.select("window_id", outcome(F.col("blocked"), F.col("refused"), F.col("candidates")).alias("outcome"))
    return Run(settle(messages, taken, outcomes), merged, tasks, blocked, outcomes)
