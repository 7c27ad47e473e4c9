"""The archive: merges with a policy for each column, unique names, related topics, indexes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.schemas import CONFIDENCE_ORDER, DISPLAY_ORDER, STATUS_ORDER


def strongest(a: Column, b: Column, order: tuple[str, ...]) -> Column:
    """The one that stands first in the order; where neither does, b, or a where b is empty."""
    first = F.coalesce(*(F.when((a == x) | (b == x), F.lit(x)) for x in order))
    return F.coalesce(first, F.nullif(b, F.lit("")), a)


def union_lists(old: Column, new: Column) -> Column:
    """The old list as it is, then what is new, once each."""
    return F.concat(old, F.array_except(new, old))


def union_evidence(old: Column, new: Column) -> Column:
    """As union_lists, by url and quote: the first stays."""
    same = lambda a, b: a["url"].eqNullSafe(b["url"]) & a["quote"].eqNullSafe(b["quote"])
    return F.aggregate(new, old, lambda acc, e: F.when(F.exists(acc, lambda x: same(x, e)), acc).otherwise(F.concat(acc, F.array(e))))


def merge_topics(topics: DataFrame, records: DataFrame, today: str) -> DataFrame:
    """topics with the records (one for each key) merged in, and new topics for keys that aren't there.

    Kept: stem, title, first_raised, question. Replaced: last_verified, answer, headline, finding. United: evidence,
    tags, contradictions, open questions. The stronger: confidence, research_status. One update entry is appended.
    """
    t, r = topics.alias("t"), records.alias("r")
    both = t.join(r, F.col("t.topic_key") == F.col("r.topic_key"), "full_outer")
    there, came = F.col("t.topic_key").isNotNull(), F.col("r.topic_key").isNotNull()
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"r.{c}"))
    none = lambda c: F.array().cast(topics.schema[c].dataType)
    lists = lambda c: (F.coalesce(old(c), none(c)), F.coalesce(new(c), none(c)))
    conf, status = strongest(old("confidence"), new("confidence"), CONFIDENCE_ORDER), strongest(old("research_status"), new("research_status"), STATUS_ORDER)
    say = lambda label, a, b: F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{label}: "), a, F.lit(" → "), b, F.lit(".")))
    contradictions = union_lists(*lists("contradictions"))
    more = F.size(contradictions) - F.size(lists("contradictions")[0])
    changes = F.array_compact(F.array(
        say("Finding changed", old("finding"), new("finding")), say("Confidence", old("confidence"), conf), say("Status", old("research_status"), status),
        F.when(more > 0, F.concat(more.cast("string"), F.lit(" new contradiction(s) recorded."))),
    ))
    known = F.transform(lists("evidence")[0], lambda e: e["url"])
    sources = F.filter(F.transform(lists("evidence")[1], lambda e: e["url"]), lambda u: (F.coalesce(u, F.lit("")) != "") & ~F.array_contains(known, u))
    update = F.struct(F.lit(today).alias("date"), F.trim(F.coalesce(new("headline"), F.lit(""))).alias("headline"), changes.alias("changes"), F.array_distinct(sources).alias("sources"))
    merged = {
        "topic_key": F.coalesce(old("topic_key"), new("topic_key")), "stem": F.coalesce(old("stem"), T.slug(T.research_title(new("title")))), "title": F.coalesce(old("title"), new("title")),
        "first_raised": F.coalesce(old("first_raised"), F.lit(today)), "question": F.coalesce(old("question"), new("question")),
        "last_verified": F.when(came, F.lit(today)).otherwise(old("last_verified")), **{c: F.when(came, new(c)).otherwise(old(c)) for c in ("answer", "headline", "finding")},
        "confidence": F.when(there & came, conf).otherwise(F.coalesce(old("confidence"), new("confidence"))), "research_status": F.when(there & came, status).otherwise(F.coalesce(old("research_status"), new("research_status"))),
        "evidence": union_evidence(*lists("evidence")), "contradictions": contradictions, "tags": union_lists(*lists("tags")), "open_questions": union_lists(*lists("open_questions")),
        "updates": F.concat(F.coalesce(old("updates"), none("updates")), F.when(there & came, F.array(update)).otherwise(none("updates"))),
        "content_sha": old("content_sha"), "managed": F.coalesce(old("managed"), F.lit(True)),
    }
    return both.select(*(merged[c].alias(c) for c in topics.columns))


CUT = 8


def merge_records_in_order(topics: DataFrame, records: DataFrame, today: str, seq: str = "seq") -> DataFrame:
    """merge_topics for records of which some share a key: one round for each place in a key's order. The plan is cut by
    a checkpoint every CUT rounds, for which spark.checkpoint.dir has to be set where there are more."""
    ranked = records.withColumn("__n", F.row_number().over(Window.partitionBy("topic_key").orderBy(seq)))
    rounds = ranked.agg(F.max("__n")).first()[0] or 0
    for n in range(1, rounds + 1):
        topics = merge_topics(topics, ranked.where(F.col("__n") == n).drop("__n"), today)
        if n % CUT == 0 and n < rounds:
            topics = topics.checkpoint()
    return topics


def related(topics: DataFrame, least: int = 2, most: int = 5, boilerplate: tuple[str, ...] = (), key: str = "stem", tags: str = "tags") -> DataFrame:
    """key, other, overlap, rank: topics that share at least `least` tags, the closest first, then by key.

    Topics with the same tags are as close to any other, so tag sets are paired and not topics: each set brings its
    first most + 1 topics, which is all that a top list can need. Popular tags cost pairs of sets that have them.
    """
    own = F.array_sort(F.array_distinct(F.array_except(F.col(tags), F.array(*(F.lit(b) for b in boilerplate)).cast("array<string>"))))
    t = topics.select(F.col(key), own.alias("set")).where(F.size("set") >= least)
    heads = t.withColumn("__n", F.row_number().over(Window.partitionBy("set").orderBy(key))).where(F.col("__n") <= most + 1).select(F.col("set").alias("b"), F.col(key).alias("other"))
    each = t.select("set").distinct().select("set", F.explode("set").alias("tag"))
    pairs = each.select(F.col("set").alias("a"), "tag").join(each.select(F.col("set").alias("b"), "tag"), "tag").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    near = pairs.join(heads, "b").withColumn("__n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("overlap"), "other"))).where(F.col("__n") <= most + 1)
    out = t.join(near.select(F.col("a").alias("set"), "other", "overlap"), "set").where(F.col(key) != F.col("other"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("overlap"), "other"))
    return out.select(key, "other", "overlap", rank.alias("rank")).where(F.col("rank") <= most)


def tag_index(topics: DataFrame, least: int = 2, key: str = "stem", tags: str = "tags") -> DataFrame:
    """tag, stems, n: tags on two pages or more."""
    t = topics.select(key, F.explode(F.array_distinct(tags)).alias("tag"))
    return t.groupBy("tag").agg(F.array_sort(F.collect_set(key)).alias("stems"), F.countDistinct(key).alias("n")).where(F.col("n") >= least)


def status_order(status: Column) -> Column:
    """Where a status comes in the dashboard: the known ones in order, then the others by name."""
    return F.coalesce(*(F.when(status == s, F.lit(i)) for i, s in enumerate(DISPLAY_ORDER)), F.lit(len(DISPLAY_ORDER)))


def status_counts(topics: DataFrame, status: str = "research_status") -> DataFrame:
    """Counts by status with the grand total (a null status)."""
    return topics.rollup(status).agg(F.count(F.lit(1)).alias("n"), F.grouping(status).alias("is_total"))


def unique_names(wanted: DataFrame, taken: DataFrame, form: str = " ({})", name: str = "name", order: str = "ord") -> DataFrame:
    """wanted with `given`: the name itself where it is free, else the next free number after those taken.

    Rows that want one name are numbered in order; a number is added past the largest that is taken already, so a
    reserved name is never handed out twice.
    """
    pre, post = form.split("{}")
    pattern = r"^(.*)" + T.literal(pre) + r"(\d{1,4})" + T.literal(post) + "$"
    base = F.coalesce(F.nullif(F.regexp_extract("taken", pattern, 1), F.lit("")), F.col("taken"))
    number = F.coalesce(F.nullif(F.regexp_extract("taken", pattern, 2), F.lit("")).try_cast("int"), F.lit(1))
    used = taken.select(F.col(name).alias("taken")).select(base.alias(name), number.alias("k")).unionByName(taken.select(F.col(name), F.lit(1).alias("k"))).groupBy(name).agg(F.max("k").alias("__top"), F.max(F.col("k") == 1).alias("__plain"))
    i = F.row_number().over(Window.partitionBy(name).orderBy(order))
    out = wanted.join(used, name, "left").withColumn("__k", F.coalesce("__top", F.lit(0)) + i)
    return out.withColumn("given", F.when(F.col("__k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(pre), F.col("__k").cast("string"), F.lit(post)))).drop("__k", "__top", "__plain")


def file_decision(in_index: Column, page_there: Column, managed: Column, hash_matches: Column) -> Column:
    """What is done with a record's page: create, update, append to a legacy page, refuse a hand-edited one, collide."""
    return (
        F.when(~in_index & page_there, "collide").when(~in_index, "create").when(~managed, "append-legacy").when(page_there & ~hash_matches, "refuse-hand-edited").otherwise("update")
    )


def content_ours(page: Column, content_sha: Column) -> Column:
    """Whether a page is as it was written; a missing one counts as ours."""
    return page.isNull() | F.sha2(page, 256).eqNullSafe(content_sha)


# Confidences that a page's front block states as such; weaker ones become a tag.
STATED_CONFIDENCE = ("primary", "corroborated")


def frontmatter(t: dict[str, Column]) -> Column:
    """The page's front block from title, topic_key, research_status, finding, confidence, first_raised, last_verified,
    tags, sources and related: eleven keys in a fixed order, without confidence where that is weak (then it is a tag)."""
    stated = t["confidence"].isin(*STATED_CONFIDENCE)
    weak = F.when(stated, F.array().cast("array<string>")).otherwise(F.array(t["confidence"]))
    tags = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("signal-derived"), F.lit("research")), T.clean_tags(t["tags"]), weak)))
    line = lambda key, v: F.concat(F.lit(f"{key}: "), v)
    scalar = lambda key, name: line(key, T.yaml_scalar(t[name]))
    return F.concat_ws(
        "\n", F.lit("---"), scalar("title", "title"), F.lit("entity_type: research_task"), scalar("topic_key", "topic_key"), scalar("research_status", "research_status"),
        line("finding", T.yaml_scalar(F.coalesce(t["finding"], F.lit("unestablished")))), F.when(stated, scalar("confidence", "confidence")),
        scalar("first_raised", "first_raised"), scalar("last_verified", "last_verified"), line("tags", T.yaml_list(tags)), line("sources", T.yaml_list(t["sources"])), line("related", T.yaml_list(t["related"])), F.lit("---"),
    )


def frontmatter_span(lines: Column) -> Column:
    """How many lines the front block takes with its fences; null where there is none."""
    trimmed = F.transform(lines, lambda x: F.rtrim(x))
    end = F.array_position(F.slice(trimmed, F.lit(2), F.greatest(F.size(trimmed) - 1, F.lit(0))), F.lit("---"))
    return F.when((F.get(trimmed, F.lit(0)) == "---") & (end > 0), (end + 1).cast("int"))


def bump_last_verified(page: Column, day: str) -> Column:
    """The page with its one last_verified date set to the day; null unless there is exactly one in the front block."""
    lines = F.split(page, "\n", -1)
    span = frontmatter_span(lines)
    shape = r"^last_verified: \d{4}-\d{2}-\d{2}\s*$"
    n = F.size(F.filter(lines, lambda x, i: (i < span) & x.rlike(shape)))
    return F.when(span.isNotNull() & (n == 1), F.array_join(F.transform(lines, lambda x, i: F.when((i < span) & x.rlike(shape), F.lit(f"last_verified: {day}")).otherwise(x)), "\n"))


def patch_page(page: Column, key: Column, links: Column) -> Column:
    """The page with topic_key after its title line and the related links united into one line of the front block."""
    lines = F.split(page, "\n", -1)
    span = frontmatter_span(lines)
    has_key = F.exists(lines, lambda x: x.startswith("topic_key: "))
    each = F.transform(lines, lambda x, i: F.when((i < span) & x.startswith("title: ") & ~has_key, F.array(x, F.concat(F.lit("topic_key: "), key)))
        .when((i < span) & x.startswith("related: "), F.array(F.concat(F.lit("related: "), T.yaml_list(union_lists(parse_list(F.regexp_replace(x, "^related: ", "")), links))))).otherwise(F.array(x)))
    return F.when(span.isNotNull(), F.array_join(F.flatten(each), "\n"))


def parse_list(text: Column) -> Column:
    """A flow list of bare or quoted scalars; null where it isn't one, empty for []."""
    t = F.trim(text)
    item = r'(?:[A-Za-z0-9][A-Za-z0-9._-]*|"(?:[^"\\]|\\.)*+")'
    ok = t.rlike(rf"^\[\s*(?:{item}(?:\s*,\s*{item})*+)?\s*\]$")
    items = F.transform(F.regexp_extract_all(t, F.lit(item), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r'\\(["\\])', "$1"))
    return F.when(ok, items)
