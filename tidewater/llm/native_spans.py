"""Spans of regular expressions with their places, by DataFrame functions alone.

`split` and `regexp_extract_all` with the same pattern give the texts between and of all matches in order; the place of
a match is the sum of the lengths before it, taken by a window over the document's matches. Lengths are code points.
All patterns below repeat groups possessively or not at all, so that none backtracks at length on any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

#: Characters kept on either side of a span, for what looks at its context.
CONTEXT = 32


def found_spans(docs: DataFrame, kinds: list[tuple[str, str, object]], keep: list[str]) -> tuple[DataFrame, str]:
    """The docs' rows (rid, the `keep` columns, no text) with a list of raw matches for each kind, as a written table.

    kinds: name, Java pattern, and a function that gives a condition that must hold where there is a match that matters (it spares the work).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = []
    for name, pattern, when in kinds:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")))
        got = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
        got = F.when(when(), got)
        cols.append(F.when(F.size(got["hits"]) > 0, got).alias(f"k_{name}"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *keep, *cols)
    return written(rows, "spans")


def has_hits(kinds: list[tuple[str, str, object]]):
    """Whether a found row has a raw match of any kind."""
    return F.coalesce(*(F.col(f"k_{n}.hits") for n, _, _ in kinds)).isNotNull()


def span_rows(found: DataFrame, kinds: list[tuple[str, str, object]], keep: list[str]) -> DataFrame:
    """A row for each raw match: rid, keep, kind, ord (the kind's place in the list), start, end, value, before, after."""
    row = "array<struct<ord:int,i:int,gap:int,before:string,after:string,value:string>>"

    def raw(k: int, name: str):
        gap = lambda i: F.get(F.col(f"k_{name}.gaps"), i)
        own = F.transform(
            F.col(f"k_{name}.hits"),
            lambda v, i: F.struct(F.lit(k).alias("ord"), i.alias("i"), gap(i)["n"].alias("gap"), gap(i)["tail"].alias("before"), gap(i + 1)["head"].alias("after"), v.alias("value")),
        )
        return F.coalesce(own.cast(row), F.array().cast(row))

    some = found.where(has_hits(kinds))
    flat = F.explode(F.concat(*(raw(k, name) for k, (name, _, _) in enumerate(kinds))))
    rows = some.select("rid", *keep, flat.alias("s")).select("rid", *keep, "s.*")
    w = Window.partitionBy("rid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.length("value")).over(w)
    names = F.array(*(F.lit(n) for n, _, _ in kinds))
    return rows.select("rid", *keep, F.element_at(names, F.col("ord") + 1).alias("kind"), "ord", (end - F.length("value")).alias("start"), end.alias("end"), "value", "before", "after")


def unheld(spans: DataFrame, base) -> DataFrame:
    """The spans (rid, ord, start, end) without those that overlap one for which `base` holds; these stay themselves."""
    each, upto = Window.partitionBy("rid"), (Window.unboundedPreceding, -1)
    before = F.max(F.when(base, F.col("end"))).over(each.orderBy("start", "ord").rowsBetween(*upto))
    # a frame that only grows, from the end: one that reaches to the end would be summed up again for each row
    after = F.min(F.when(base, F.col("start"))).over(each.orderBy(F.desc("start"), F.desc("ord")).rowsBetween(*upto))
    held = ~base & (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    return spans.withColumn("__held", held).where(~F.col("__held")).drop("__held")


def listed(spans, *, where=None):
    """kind:start:end of an array of spans (start, ord, kind, end), by start, then kind, comma-joined."""
    a = F.array_sort(spans if where is None else F.filter(spans, where))
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
