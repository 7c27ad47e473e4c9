"""Readers: exports, frames, archives, rosters. Paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.schemas import TOPICS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quoted line breaks kept; a missing file is an error."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """`value` of each line that is a JSON object; blank, broken and other lines are left out."""
    lines = spark.read.text(path)
    return lines.where(F.expr("left(ltrim(value), 1) = '{' and try_parse_json(value) is not null"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Raw frame lines as a file stream, blank ones left out; broken ones stay for the parser to count."""
    return spark.readStream.text(path).where("trim(value) <> ''")


def read_export(spark: SparkSession, folder: str) -> tuple[str, dict[str, DataFrame]]:
    """What kind of export a folder holds, and its tables: lines of main.jsonl before the four CSV files."""
    if exists(spark, f"{folder}/main.jsonl"):
        return "jsonl", {"lines": read_jsonl(spark, f"{folder}/main.jsonl")}
    if exists(spark, f"{folder}/message.csv"):
        return "csv", {n: read_csv(spark, f"{folder}/{n}.csv") for n in ("groups", "recipient", "thread", "message")}
    raise FileNotFoundError(f"{folder} holds neither main.jsonl nor message.csv; an encrypted backup has to be exported first")


def split_jsonl(lines: DataFrame) -> dict[str, DataFrame]:
    """recipient (id, aci, group_key, is_self), chat (id, recipient_id) and item (chat_id, author_id, raw_ts, body) of
    an export's lines, in whatever order they stand."""
    v = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    there = lambda p: F.try_variant_get("v", p, "variant").isNotNull()
    return {
        "recipient": v.where(there("$.recipient")).select(get("$.recipient.id").alias("id"), F.lower(get("$.recipient.contact.aci")).alias("aci"), get("$.recipient.group.masterKey").alias("group_key"), there("$.recipient.self").alias("is_self")),
        "chat": v.where(there("$.chat")).select(get("$.chat.id").alias("id"), get("$.chat.recipientId").alias("recipient_id")),
        "item": v.where(there("$.chatItem")).select(get("$.chatItem.chatId").alias("chat_id"), get("$.chatItem.authorId").alias("author_id"), get("$.chatItem.dateSent", "long").alias("raw_ts"), get("$.chatItem.standardMessage.text.body").alias("body")),
    }


def join_jsonl(parts: dict[str, DataFrame], group_key: str) -> DataFrame:
    """Messages of one group: items of its chats, with their author's id or `self`."""
    r = parts["recipient"]
    chats = parts["chat"].join(r.where(F.col("group_key") == group_key).select(F.col("id").alias("recipient_id")), "recipient_id", "left_semi")
    items = parts["item"].join(chats.select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    people = r.select(F.col("id").alias("author_id"), F.when(F.col("is_self"), "self").otherwise(F.col("aci")).alias("source"))
    return items.join(people, "author_id", "left").select("source", "raw_ts", "body")


def read_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of a folder of JSON files, one each; broken files and those without a key are left out."""
    return spark.read.schema(TOPICS).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).where("topic_key is not null and topic_key <> ''")


def read_pages(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("Templates", "Attachments")) -> DataFrame:
    """path, stem, text of the Markdown pages below a folder, without dot folders and bookkeeping ones."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    inner = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    out = df.withColumn("inner", inner).where(~F.col("inner").rlike(r"(?:^|/)\." + (f"|^(?:{'|'.join(skip)})/" if skip else "")))
    return out.select(F.col("inner").alias("path"), F.regexp_extract("inner", r"([^/]*)\.md$", 1).alias("stem"), F.col("value").alias("text"))


def front_keys(pages: DataFrame, keys: tuple[str, ...] = ("title", "topic_key", "status"), lines: int = 20) -> DataFrame:
    """The pages with keys of their first lines; a key's last line counts."""
    head = F.slice(F.split("text", "\n"), F.lit(1), F.lit(lines))

    def last(k: str):
        hits = F.filter(head, lambda x: x.startswith(f"{k}: "))
        return F.trim(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), f"^{k}: ", ""))

    return pages.select("*", *(last(k).alias(k) for k in keys))


def read_roster(spark: SparkSession, path: str, marker: str = "REPLACE_ME") -> DataFrame:
    """The roster's one row; a template marker left in names, phones or the group's name is an error."""
    r = spark.read.schema("names array<string>, handles array<string>, phones array<string>, opted_out array<string>, group_name string").option("multiLine", True).json(path)
    bad = F.exists(F.concat(F.coalesce("names", F.array()), F.coalesce("phones", F.array()), F.array(F.coalesce("group_name", F.lit("")))), lambda x: F.contains(x, F.lit(marker)))
    return r.withColumn("group_name", F.when(bad, F.raise_error(F.lit("the roster is a template still"))).otherwise(F.col("group_name")))


def looks_encrypted(spark: SparkSession, path: str) -> bool:
    """Whether a database file does not start as a plain one does."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 15).alias("h")).first()
    return head is not None and bytes(head["h"]) != b"SQLite format 3"
