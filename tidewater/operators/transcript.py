"""Transcripts: opt-outs, mentions, redaction, labels, bucket headers, and what was counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import defang_known, only_placeholders, splice_mentions


def format_line(label: Column, quote: Column, text: Column, attachments: Column) -> Column:
    """label: (replying to: quote) text [+n attachment(s)]"""
    reply = F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit("(replying to: "), quote, F.lit(") "))).otherwise("")
    more = F.when(attachments > 0, F.concat(F.lit(" [+"), attachments.cast("string"), F.lit(" attachment(s)]"))).otherwise("")
    return F.concat(label, F.lit(": "), reply, text, more)


UNKNOWN = "[participant]"


def with_mentions(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """messages with the mentions in body replaced by their labels; as they are where there is no such column."""
    if "mentions" not in messages.columns:
        return messages
    has = F.size(F.coalesce("mentions", F.array().cast(messages.schema["mentions"].dataType))) > 0
    some = messages.where(has).withColumn("__id", F.monotonically_increasing_id())
    each = some.select("__id", F.posexplode("mentions").alias("__i", "__m")).join(labels.select(F.col("iid").alias("__iid"), F.col("label").alias("__label")), F.col("__m.uuid") == F.col("__iid"), "left")
    named = F.struct(F.col("__i"), F.col("__m.start").alias("start"), F.col("__m.length").alias("length"), F.coalesce("__label", F.lit(UNKNOWN)).alias("uuid"))
    per = each.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(named)), lambda x: F.struct(x["start"], x["length"], x["uuid"])).alias("__named"))
    spliced = some.join(per, "__id").withColumn("body", splice_mentions(F.coalesce("body", F.lit("")), F.col("__named"), lambda u: u))
    return spliced.select(*messages.columns).unionByName(messages.where(~has))


def transcript_lines(messages: DataFrame, labels: DataFrame, opted_out: tuple[str, ...] = (), redact=None) -> DataFrame:
    """source, raw_ts, coarse_ts, disposition, rules, line, header.

    labels: iid (the source) and label. Mentions (where messages have that column) become their labels before anything
    is redacted; labels that stand in the text and aren't allocated become `member X`. redact: text to a struct of text, rules, dropped. Dispositions, first match:
    opted_out, retracted, dropped, empty (whatever is attached), only_placeholders, included; a quote that redaction drops is left out; headers look at included lines only.
    """
    out_of = lambda c: F.coalesce(F.lower(c).isin(*(x.lower() for x in opted_out)), F.lit(False)) if opted_out else F.lit(False)
    plain = lambda c: F.struct(c.alias("text"), F.array().cast("array<string>").alias("rules"), F.lit(False).alias("dropped"))
    redact = redact or plain
    known = labels.where(F.col("label").rlike("^Participant [A-Za-z]{1,3}$")).agg(F.collect_set("label").alias("__known"))  # 18,278 spellings at most
    messages = with_mentions(messages, labels).crossJoin(F.broadcast(known))
    m = messages.withColumn("__r", redact(F.coalesce("body", F.lit("")))).withColumn("__q", redact(F.when(~out_of(F.col("quote_author")), F.col("quote_text"))))
    disposition = (
        F.when(out_of(F.col("source")), "opted_out").when(F.coalesce("retracted", F.lit(False)), "retracted").when(F.col("__r.dropped"), "dropped")
        .when(F.trim("__r.text") == "", "empty").when(only_placeholders(F.col("__r.text")), "only_placeholders").otherwise("included")
    )
    line = format_line(F.coalesce("label", F.lit(UNKNOWN)), F.when(~F.col("__q.dropped"), defang_known(F.substring(F.trim("__q.text"), 1, 120), F.col("__known"))), defang_known(F.trim("__r.text"), F.col("__known")), F.coalesce("attachment_count", F.lit(0)))
    rows = m.join(labels.select(F.col("iid").alias("source"), "label"), "source", "left").withColumn("disposition", disposition)
    rows = rows.select("source", "raw_ts", "coarse_ts", "disposition", F.concat("__r.rules", F.coalesce("__q.rules", F.array().cast("array<string>"))).alias("rules"), F.when(F.col("disposition") == "included", line).alias("line"))
    # buckets grow with time, so a line opens one where it is the first of it
    w = Window.partitionBy("disposition", "coarse_ts").orderBy("raw_ts", "source")
    return rows.withColumn("header", F.when(F.col("disposition") == "included", F.row_number().over(w) == 1))


def rule_histogram(lines: DataFrame, *by: str) -> DataFrame:
    """How often each rule fired."""
    return lines.select(*by, F.explode("rules").alias("rule")).groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n"))


def bucket_label(coarse_ts: Column) -> Column:
    return F.date_format(F.timestamp_millis(coarse_ts), "yyyy-MM-dd HH:mm")


def labels_in_use(labels: DataFrame) -> DataFrame:
    """label: those allocated and the one of unknown people, which is all that may leave."""
    return labels.select("label").where("label is not null").unionByName(labels.sparkSession.createDataFrame([(UNKNOWN,)], "label string")).distinct()
