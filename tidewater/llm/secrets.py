"""Secret scans judged by corpus-wide ownership, by DataFrame functions alone.

Every candidate's value is hashed, and the hash counted over distinct owners and distinct repositories of the whole
corpus: a value that many owners hold, or that stands in many repositories, is a copied example, one that few hold and
that looks random is live. Known formats beyond the base kinds, and random runs in no format at all, are added where
they are live, that is where ownership says so.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bit_flag, hot_split_join, row_key, table, written
from tidewater.llm.native_spans import found_spans, has_hits, listed, span_rows, unheld

_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"


_PEM = "(?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----"
#: Between the runs of a body: line ends, escapes, quotes, comment signs.
_GAP = r"[^A-Za-z0-9+/=]{0,64}+"
#: A private key from its header to its END line, which comes before any other header. Where that is missing: to the end
#: of what can be its body, that is fields, long runs, lines of one run, and one shorter run after them. A header that
#: no body follows is a mention, and what prose follows is no part of a key.
_PRIVATE_KEY = (
    rf"-----BEGIN {_PEM}(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END {_PEM}"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+|[\x20\t]*+[\r\n]\s*+[A-Za-z0-9+/=]++(?=\s*+\z|[\x20\t]*+[\r\n]))++"
    r"(?:(?:\s|\\[nr]|[\"'])++[A-Za-z0-9+/]{1,15}+={0,2}+)?+)"
)


#: A run that no format explains: capitals, small letters and digits, or capital hexadecimal digits.
_RANDOM = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[A-Z0-9+/_-]{0,40}[a-z])(?=[a-z0-9+/_-]{0,40}[A-Z])[A-Za-z0-9+/_-]{32,256}+={0,2}(?![A-Za-z0-9+/_=-])|(?<![A-Za-z0-9+/_=.-])[0-9A-F]{32,128}+(?![A-Za-z0-9+/_=-])"


def _has(*parts: str):
    return lambda: reduce(and_, (F.col("text").contains(x) for x in parts))


def _like(pattern: str):
    return lambda: F.col("text").rlike(pattern)


#: name, pattern, and what a text must hold for a match that counts. The base kinds come first, in the order that
#: breaks ties. A run that starts earlier than 16 (access) or 32 (hex) characters before its end starts a longer match,
#: so the least lengths can stand in the pattern; assign's can't, as a short value still takes its text.
KINDS = [
    ("assign", _ASSIGN, _like(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}")),
    ("access", r"AKIA[A-Z0-9]{12,}+", _has("AKIA")),
    ("hex", r"[0-9a-f]{32,}+", _like(r"[0-9a-f]{32}")),
    ("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _like(r"gh[pousr]_[A-Za-z0-9]{36}")),
    ("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{20,}+", _has("xox")),
    ("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", _has("AIza")),
    ("stripe", r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{16,}+", _has("k_live_")),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", _has("eyJ")),
    ("private_key", _PRIVATE_KEY, _has("-----BEGIN ", "PRIVATE KEY-----")),
    ("random", _RANDOM, _like(_RANDOM)),
]
BASE = 3
#: Distinct owners up to which a value counts as specific to them.
MOST_OWNERS = 2
#: Distinct repositories up to which it does.
MOST_REPOSITORIES = 6
#: Words that mark a placeholder.
_EXAMPLE = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|0123456789|123456789|abcdefgh"


def repository_of(docs: DataFrame, owner: str) -> Column:
    """The part of an owner's documents that counts as a repository: those in one language, where that is known."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner, "lang") if c in docs.columns]
    return F.concat_ws("/", *parts)


def scan(docs: DataFrame, repository: str | None = None, owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> tuple[DataFrame, DataFrame, str]:
    """The scanned rows (rid, doc_id, key), the spans with ownership, and the path both are read from.

    repository and owner name columns; without a repository column it is the owner's documents of one `lang`.
    spans: rid, doc_id, key, kind, ord, start, end (of the whole match), secret (the part to hide starts at
    secret_start), repositories, owners, verdict: example (held by more than most_owners owners, or in more than
    most_repositories repositories, or a placeholder), weak (few kinds of characters) or live. All null repositories or
    owners are one. A random run that overlaps a span of another kind is none. key is a hash of doc_id and text, the same
    for repeated rows. Null and empty texts have no spans, and an empty table none.
    """
    repo = F.col(repository) if repository else repository_of(docs, owner)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("__repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("__owner"),
    )
    keep = ["doc_id", "key", "__repo", "__owner"]
    found, path = found_spans(rows.withColumn("key", row_key()), KINDS, keep)
    spans = unheld(span_rows(found, KINDS, keep), F.col("kind") != "random")
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("value", _ASSIGN, 2)).otherwise(F.col("value"))
    spans = spans.withColumn("secret", secret).where((F.col("kind") != "assign") | (F.length("secret") >= 8))
    # a private key is known by its body, however its lines are broken
    is_key = F.col("kind") == "private_key"
    body = F.when(is_key, F.regexp_replace(F.regexp_replace("secret", rf"-----(?:BEGIN|END) {_PEM}|\\[nr]", ""), "[^A-Za-z0-9+/=]", "")).otherwise(F.col("secret"))
    spans = spans.withColumn("secret_start", F.col("end") - F.length("secret")).withColumn("body", body).withColumn("hash", F.xxhash64("body", F.length("body")))
    spans, _ = written(spans, "candidates")  # few rows, which the counts and the join read
    # one row for each holder first, so that a value in a third of all documents comes to few rows
    holders = spans.groupBy("hash", "__repo", "__owner").agg(F.count(F.lit(1)).alias("n"))
    by_owner = holders.groupBy("hash", "__owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    repos = holders.groupBy("hash", "__repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("uses"))
    total = found.where(has_hits(KINDS)).count()
    spans = hot_split_join(spans, owners.join(repos, "hash"), ["hash"], "uses", total)
    kinds = F.size(F.array_distinct(F.split("body", "")))
    # in a key's long runs such words stand by chance
    words = F.when(is_key, F.regexp_replace("secret", "[A-Za-z0-9+/=]{16,}", "")).otherwise(F.col("secret"))
    verdict = F.when((F.col("owners") > most_owners) | (F.col("repositories") > most_repositories) | words.rlike(_EXAMPLE), "example").when(kinds < 6, "weak").otherwise("live")
    return found, spans.withColumn("verdict", verdict).drop("__repo", "__owner", "uses", "hash", "body"), path


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live, one row for each of docs.

    Base spans always count; those of the other formats are added where they are live, and live lists what is. Null and
    empty texts have none, an empty table gives an empty one, and spans that start at one place come in the order of
    kinds. Repeated rows stay, null doc_ids too; columns other than doc_id, text, source and lang are not read.
    """
    found, spans, _ = scan(docs)
    kept = spans.where((F.col("ord") < BASE) | (F.col("verdict") == "live"))
    each = kept.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("start", "ord", "kind", "end", "verdict")).alias("s"))
    has = has_hits(KINDS)
    empty = F.array().cast(each.schema["s"].dataType).alias("s")
    dropped = found.where(has).select("rid", "doc_id").join(each.select("rid"), "rid", "left_anti")
    rows = each.unionByName(found.where(~has).select("rid", "doc_id", empty)).unionByName(dropped.select("rid", "doc_id", empty))

    def count(field: str, value: str):
        return F.size(F.filter("s", lambda x: x[field] == value)).cast("long")

    return rows.select(
        "doc_id", *(count("kind", n).alias(f"n_{n}") for n, _, _ in KINDS[:BASE]),
        F.sha2(F.encode(listed(F.col("s"), where=lambda x: x["ord"] < BASE), "UTF-8"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"),
        count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"),
        listed(F.col("s"), where=lambda x: x["verdict"] == "live").alias("live"),
    )


def hide_live_secrets(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """docs with the live secrets in text replaced by the mask, and n_chars, where it is there, brought up to date.

    All rows and columns stay; examples and weak values stay as they are. Only the rows that a fixed-size bitmap lets
    through are joined with their spans, the others pass as they are.
    """
    _, spans, _ = scan(docs)
    live = spans.where("verdict = 'live'").groupBy(F.col("key").alias("__row_key")).agg(F.array_sort(F.collect_set(F.struct(F.col("secret_start").alias("a"), F.col("end").alias("z")))).alias("__spans"))
    keyed = docs.withColumn("__row_key", row_key())
    flagged = bit_flag(keyed, live.select("__row_key"), "__row_key", "__may")
    hit = flagged.where("__may").join(live, "__row_key", "left")
    # spans of one text: sorted; what overlaps an earlier one adds only what lies past it
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(
        s["a"] >= acc["at"], F.struct(F.concat(acc["t"], F.substring("text", acc["at"].cast("int") + 1, (s["a"] - acc["at"]).cast("int")), F.lit(mask)).alias("t"), s["z"].alias("at"))
    ).otherwise(F.struct(acc["t"].alias("t"), F.greatest(acc["at"], s["z"]).alias("at")))
    masked = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["t"], F.substring("text", acc["at"].cast("int") + 1, F.length("text"))))
    hit = hit.withColumn("text", F.when(F.col("__spans").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return hit.select(*docs.columns).unionByName(flagged.where(~F.col("__may")).select(*docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secret_report(table(spark, sf_dir, "documents"))
