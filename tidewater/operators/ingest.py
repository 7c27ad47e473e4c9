"""From raw frames and exports to messages: variant paths, dispositions, chained semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.schemas import BUCKET_MS


def floor_bucket(ts: Column, width: int = BUCKET_MS) -> Column:
    """The start of the bucket, for times before 1970 too."""
    return ts - F.pmod(ts, F.lit(width))


def path(v: Column, p: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, p, kind)


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit(0).cast("long")) for c in cols))


def resolve_column(df: DataFrame, *candidates: str) -> str:
    """The first of the candidate names that df has, in any case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of {', '.join(candidates)} among {', '.join(df.columns)}")


#: Where a frame may hold its payload, in order of precedence: path, and whether it is one's own synced message.
PAYLOADS = (
    ("$.dataMessage", False), ("$.editMessage.dataMessage", False), ("$.syncMessage.sentMessage.editMessage.dataMessage", True), ("$.syncMessage.sentMessage", True),
    ("$.syncMessage.editMessage.dataMessage", True), ("$.syncMessage.editMessage.sentMessage.dataMessage", True),
)
EDITED = ("$.editMessage", "$.syncMessage.sentMessage.editMessage", "$.syncMessage.editMessage")


def parse_frames(frames: DataFrame, group: str, marker: str = "", opted_out: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line of `value`, with a disposition and the message's fields.

    Dispositions, first match: corrupt, no_envelope, other_group (no payload of the group), expiring,
    expiration_update, bot, opted_out, delete, message. Lines that don't parse count; none stops the rest.
    """
    v = F.try_parse_json(F.col("value"))
    e = F.when(path(v, "$.method") == "receive", F.try_variant_get(v, "$.params.envelope", "variant"))
    df = frames.withColumn("__v", v).withColumn("__e", e)
    e = F.col("__e")
    hits = [F.try_variant_get(e, p, "variant") for p, _ in PAYLOADS]
    df = df.withColumn("__p", F.coalesce(*hits))
    own = F.coalesce(*(F.when(h.isNotNull(), F.lit(s)) for h, (_, s) in zip(hits, PAYLOADS, strict=True)))
    p = F.col("__p")
    df = df.withColumn("source", F.when(own, "self").otherwise(F.coalesce(F.nullif(path(e, "$.sourceUuid"), F.lit("")), path(e, "$.source"))))
    df = df.withColumn("raw_ts", F.coalesce(path(p, "$.timestamp", "long"), path(e, "$.timestamp", "long")))
    targets = [path(e, f"{h}.{k}", "long") for h in EDITED for k in ("targetSentTimestamp", "editTargetTimestamp")] + [path(p, "$.editTargetTimestamp", "long"), path(p, "$.targetSentTimestamp", "long")]
    deleted = path(p, "$.remoteDelete.timestamp", "long")
    body = F.coalesce(path(p, "$.message"), F.lit(""))
    disposition = (
        F.when(F.col("__v").isNull(), "corrupt").when(e.isNull(), "no_envelope").when(p.isNull() | ~path(p, "$.groupInfo.groupId").eqNullSafe(F.lit(group)), "other_group")
        .when(F.coalesce(path(p, "$.expiresInSeconds", "int"), F.lit(0)) != 0, "expiring").when(F.coalesce(path(p, "$.isExpirationUpdate", "boolean"), F.lit(False)), "expiration_update")
        .when(F.contains(F.lower(body), F.lit(marker.lower())) if marker else F.lit(False), "bot").when(F.lower("source").isin(*(x.lower() for x in opted_out)) if opted_out else F.lit(False), "opted_out")
        .when(deleted.isNotNull(), "delete").otherwise("message")
    )
    mentions = F.filter(
        F.transform(F.coalesce(F.try_variant_get(p, "$.mentions", "array<variant>"), F.array().cast("array<variant>")),
            lambda m: F.struct(path(m, "$.start", "int").alias("start"), path(m, "$.length", "int").alias("length"), F.coalesce(path(m, "$.uuid"), path(m, "$.author")).alias("uuid"))),
        lambda m: m["start"].isNotNull() & m["length"].isNotNull() & m["uuid"].isNotNull(),
    )
    return df.select(
        disposition.alias("disposition"), "source", "raw_ts", floor_bucket(F.col("raw_ts")).alias("coarse_ts"), body.alias("body"), mentions.alias("mentions"),
        F.coalesce(path(p, "$.quote.authorUuid"), path(p, "$.quote.author")).alias("quote_author"), path(p, "$.quote.text").alias("quote_text"),
        F.coalesce(F.size(F.try_variant_get(p, "$.attachments", "array<variant>")), F.lit(0)).alias("attachment_count"), F.coalesce(first_truthy(*targets), deleted).alias("target_ts"),
    )


def inspect_shapes(lines: DataFrame) -> DataFrame:
    """kind, n, keys: for each top-level key of JSON object lines, how often it comes and what keys lie below; no values."""
    obj = lines.where(F.expr("try_parse_json(value) is not null and left(ltrim(value), 1) = '{'"))
    kinds = obj.select(F.explode(F.json_object_keys("value")).alias("kind"), "value")
    below = kinds.withColumn("keys", F.coalesce(F.expr("json_object_keys(get_json_object(value, concat('$.', kind)))"), F.array().cast("array<string>")))
    return below.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys"))


def semi_chain(rows: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """rows kept by a chain of semi-joins from the last step's frame up: (frame, key to the one before, own key)."""
    out = None
    for frame, up, own in reversed(steps):
        kept = frame if out is None else frame.join(out.select(F.col("__k").alias(own)).distinct(), own, "left_semi")
        out = kept.select(F.col(up).alias("__k"))
    return rows.join(out.distinct(), rows[steps[0][1]] == F.col("__k"), "left_semi") if out is not None else rows


def is_outgoing(kind: Column) -> Column:
    """Whether the low five bits of a message type are one of the sent kinds; a type that is no number is not."""
    return F.coalesce(kind.try_cast("int").bitwiseAND(31).between(21, 27), F.lit(False))


def first_match(cases: list[tuple[Column, str]], rest: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(rest))
    for c, name in cases:
        out = out.when(c, name)
    return out.otherwise(rest)


def import_dispositions(messages: DataFrame, threads: DataFrame, people: DataFrame, since_ms: int = 0) -> DataFrame:
    """Export rows (thread_id, sender_id, raw_ts, body, type, deleted) with source and disposition, first match:
    other_group, deleted, empty, too_old, no_sender, kept. Threads and people are dimensions; AQE picks their join."""
    m = messages.join(threads.select("thread_id", F.lit(True).alias("__in")), "thread_id", "left").join(people.select(F.col("id").alias("sender_id"), F.lower("aci").alias("__aci")), "sender_id", "left")
    source = F.when(is_outgoing(F.col("type")), "self").otherwise(F.col("__aci"))
    cases = [
        (F.col("__in").isNull(), "other_group"), (F.coalesce(F.lower("deleted").isin("1", "true"), F.lit(False)), "deleted"), (F.coalesce(F.trim("body"), F.lit("")) == "", "empty"),
        (F.coalesce(F.col("raw_ts") <= 0, F.lit(True)) | (F.col("raw_ts") < since_ms), "too_old"), (F.coalesce(source, F.lit("")) == "", "no_sender"),
    ]
    return m.select(*messages.columns, source.alias("source"), first_match(cases, "kept").alias("disposition"))


def date_ms(day: Column) -> Column:
    """YYYY-MM-DD as milliseconds UTC; null for anything else."""
    return F.unix_millis(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
