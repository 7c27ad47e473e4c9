"""Model stages as tables: requests are built, checked and matched with responses; nothing is ever called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.firewall import violation

#: Stages, and the shape of what each gives back.
RESPONSES = {
    "extract": "tasks array<struct<question:string,raised_by:string,context:string,kind:string,urls:array<string>>>",
    "triage": "tasks array<struct<question:string,in_scope:boolean,worth:double,difficulty:string,duplicate_of:string,topic_key:string,new_information:string,urls:array<string>,rationale:string>>",
    "cheap": "resolved boolean, answer string, confidence string, sources array<struct<url:string,quote:string>>, escalation_reason string",
    "record": "title string, topic_key string, question string, answer string, confidence string, research_status string, finding string, headline string, evidence array<struct<url:string,quote:string,confidence:string>>, contradictions array<string>, open_questions array<string>, tags array<string>",
}
CACHED_DIGEST = 4000


def request(model: Column, system: Column, content: Column, max_tokens: int, digest: Column | None = None) -> Column:
    """A request row as JSON; a digest goes in front, marked for the prefix cache where it is long."""
    parts = [F.struct(F.lit("user").alias("role"), content.alias("content"), F.lit(False).alias("cached"))]
    if digest is not None:
        parts.insert(0, F.struct(F.lit("user").alias("role"), digest.alias("content"), (F.length(digest) > CACHED_DIGEST).alias("cached")))
    return F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), system.alias("system"), F.array(*parts).alias("messages")))


def exchange(requests: DataFrame, responses: DataFrame, stage: str, key: str = "task_id", **policy) -> DataFrame:
    """requests (key, payload) with status and the parsed response: blocked_out, missing, refused, blocked_in or ok.

    responses: key, body (JSON), refused. Both ways pass the firewall; only the request's shape is looked at on the way out.
    """
    out = requests.withColumn("__out", violation(F.col("payload"), **policy))
    both = out.join(responses.select(key, "body", "refused"), key, "left").withColumn("__in", violation(F.col("body"), **(policy | {"shape": False})))
    status = F.when(F.col("__out").isNotNull(), "blocked_out").when(F.col("body").isNull() & ~F.coalesce("refused", F.lit(False)), "missing").when(F.col("refused"), "refused").when(F.col("__in").isNotNull(), "blocked_in").otherwise("ok")
    return both.withColumn("status", status).withColumn("rule", F.coalesce("__out", "__in")).withColumn("response", F.when(F.col("status") == "ok", F.from_json("body", RESPONSES[stage]))).drop("__out", "__in", "body", "refused")


def retrieved_urls(blocks: DataFrame, key: str = "task_id") -> DataFrame:
    """key, url of what was truly retrieved: rows (key, block as JSON) that are search results with a list of hits, or
    fetches that succeeded. What a model writes about its sources doesn't count."""
    v = blocks.withColumn("v", F.try_parse_json("block"))
    kind = F.try_variant_get("v", "$.type", "string")
    hits = F.transform(F.try_variant_get("v", "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.url", "string"))
    fetched = F.when(F.try_variant_get("v", "$.content.type", "string") == "web_fetch_result", F.array(F.try_variant_get("v", "$.content.url", "string")))
    urls = F.when(kind == "web_search_tool_result", hits).when(kind == "web_fetch_tool_result", fetched)
    return v.select(key, F.explode(urls).alias("url")).where("url is not null").distinct()


def resolve_topic(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """tasks (triage_key, model_key, title_key) with topic_key: a triage key that is known, else the model's, else the title's, else `topic`."""
    k = known.select(F.col("topic_key").alias("triage_key"), F.lit(True).alias("__known")).distinct()
    out = tasks.join(k, "triage_key", "left")
    return out.withColumn("topic_key", F.coalesce(F.when(F.col("__known"), F.col("triage_key")), F.nullif("model_key", F.lit("")), F.nullif("title_key", F.lit("")), F.lit("topic"))).drop("__known")


def token_usage(responses: DataFrame, by: str = "window_id") -> DataFrame:
    return responses.groupBy(by).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")))


def citation_urls(results: DataFrame, key: str = "task_id") -> DataFrame:
    """key, url: what the sources of a task's search results name, trimmed, once each; empty ones don't count."""
    each = results.select(key, F.explode("sources").alias("s")).select(key, F.trim(F.col("s.url")).alias("url"))
    return each.where("url <> ''").distinct()
