"""Line scans: rules by name, pragmas that suppress, exempt phrases; at most one finding for each line and rule."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as T

# Shapes that identify, with their names.
STRUCTURAL_RULES = (
    ("absolute-windows-path", r"(?i)(?<![A-Za-z0-9])[A-Za-z]:[\\/]"),
    ("user-profile-expansion", r"(?i)%USERPROFILE%|\$env:USERPROFILE|~[\\/]\.claude"),
    ("e164-phone", r"(?U)(?<![\w+])\+[1-9]\d{7,14}(?!\w)"),
    ("uuid", r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"),
    ("email", r"(?U)(?<![\w.+-])[\w.+-]+@(?!users\.noreply\.github\.com)[\w-]+\.[\w.-]+(?![\w.-])"),
    ("privacy-word-overclaim", r"(?i)\banonymi[sz](?:e|ed|es|ing|ation)\b"),
)
# Fixed value: a pragma names the rules that it suppresses; without a name it does nothing.
PRAGMA = r"(?i)scrub-ok:\s*([a-z0-9,\s-]+)"
#: Ends of lines.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"


def token_rules(tokens: list[str]) -> list[tuple[str, str]]:
    """A rule for each token that must not appear: bounded by words where it starts or ends with a letter or digit."""
    rules = []
    for t in tokens:
        a, z = (r"(?<!\w)" if t[:1].isalnum() else ""), (r"(?!\w)" if t[-1:].isalnum() else "")
        rules.append((f"token-{len(rules)}", f"(?iU){a}{re.escape(t)}{z}"))
    return rules


def _unexempt(rules: tuple[tuple[str, str], ...], exempt: tuple[str, ...]):
    """The names of the rules that have a match in a line which no exempt phrase holds whole."""
    import re as R

    own = [(n, R.compile(p.replace("(?U)", "").replace("(?iU)", "(?i)"))) for n, p in rules]
    phrases = [R.compile(R.escape(e), R.I) for e in exempt]

    def found(line: str) -> list[str]:
        spans = [m.span() for p in phrases for m in p.finditer(line)]
        return [n for n, p in own if any(not any(a <= m.start() and m.end() <= z for a, z in spans) for m in p.finditer(line))]

    @F.pandas_udf("array<string>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(found, na_action="ignore")

    return udf


def scan_lines(files: DataFrame, path: str = "path", text: str = "text", pragma: str = PRAGMA) -> DataFrame:
    """path, i (from 0), s (the normalised line), before (the last line before it that isn't blank)."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(T.scrub_normalise(F.coalesce(F.col(text), F.lit(""))), LINE_END, -1)).alias("i", "s"))
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("before", F.last(F.when(F.trim("s") != "", F.col("s")), ignorenulls=True).over(w))


def pragma_count(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """How many lines carry a pragma: n."""
    return scan_lines(files, path, text).agg(F.count_if(F.col("s").rlike(PRAGMA)).alias("n"))


def scan(files: DataFrame, rules: tuple[tuple[str, str], ...] = STRUCTURAL_RULES, exempt: tuple[str, ...] = (), path: str = "path", text: str = "text", pragma: str = PRAGMA) -> DataFrame:
    """path, line, rule of each finding, one at most for each line and rule.

    Lines are normalised, and a line's rules evaluated in one projection. A match counts unless an exempt phrase holds it
    whole, so that a second match beside the phrase is still found; only lines with a phrase and a match go to Python. A
    pragma on the line, or on the last line before it that isn't blank, suppresses the rules it names, in any case.
    """
    lines = scan_lines(files, path, text)
    hits = F.array_compact(F.array(*(F.when(F.col("s").rlike(p), F.lit(n)) for n, p in rules)))
    marked = lines.withColumn("rules", hits).where(F.size("rules") > 0)
    if exempt:
        spoken = reduce(lambda a, e: a | F.contains(F.lower("s"), F.lit(e.lower())), exempt, F.lit(False))
        marked = marked.withColumn("rules", F.when(spoken, _unexempt(tuple(rules), tuple(exempt))(F.when(spoken, F.col("s")))).otherwise(F.col("rules")))

    def named(c: Column) -> Column:
        return F.split(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), pragma, 1)), r"[,\s]+")

    off = F.concat(named(F.col("s")), named(F.col("before")))
    kept = marked.withColumn("off", off).withColumn("rule", F.explode("rules"))
    return kept.where(~F.array_contains(F.col("off"), F.lower("rule"))).select("path", (F.col("i") + 1).alias("line"), "rule")


def publishable(tracked: DataFrame, others: DataFrame, ignored: DataFrame) -> DataFrame:
    """path: what would be published - tracked files, and others that no rule ignores; once each."""
    return tracked.select("path").unionByName(others.select("path").join(ignored.select("path").distinct(), "path", "left_anti")).distinct()


def targets(files: DataFrame, mode: str = "all", staged: DataFrame | None = None, explicit: Sequence[str] = ()) -> DataFrame:
    """path: the files that a scan looks at - those named, else the staged ones, else all."""
    if explicit:
        return files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(explicit)], "path string")
    if mode == "staged":
        if staged is None:
            raise ValueError("no table of staged files")
        return staged.select("path").distinct()
    return files.select("path").distinct()
