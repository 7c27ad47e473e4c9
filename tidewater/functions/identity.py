"""Pseudonyms, hashes and identifier spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a name or a handle may end in.
NAME_SUFFIXES = ("", "'s", "s'", "’s")
HANDLE_SUFFIXES = ("", "'s", "’s")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The HMAC in hex, of built-in hashes only. The key comes from configuration and is at most a block long."""
    if len(key) > 64:
        raise ValueError("a key of more than 64 bytes")
    padded = key + bytes(64 - len(key))
    outer, inner = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x5C, 0x36))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def internal_id(key: bytes, identity: Column) -> Column:
    """12 hex digits of the HMAC of the trimmed lower-case identity; an empty one is an error."""
    clean = F.lower(F.trim(identity))
    return F.when(clean == "", F.raise_error(F.lit("an empty identity"))).otherwise(F.substring(hmac_sha256(key, clean), 1, 12))


def letters(ordinal: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA: bijective base 26 up to three letters and on."""
    digits = F.sequence(F.lit(0), F.lit(6))

    def step(acc: Column, _: Column) -> Column:
        n = acc["n"]
        return F.when(
            n >= 0, F.struct((F.floor(n / 26) - 1).cast("long").alias("n"), F.concat(F.chr((65 + n % 26).cast("long")), acc["s"]).alias("s"))
        ).otherwise(acc)

    return F.aggregate(digits, F.struct(ordinal.cast("long").alias("n"), F.lit("").alias("s")), step, lambda a: a["s"])


def allocate_labels(events: DataFrame, known: DataFrame | None = None, order: tuple[str, ...] = ("raw_ts",)) -> DataFrame:
    """iid, ordinal, label: dense ordinals by first appearance (events: iid and the order columns), after those known.

    Known labels never change; identities are few beside events, so their ranking is one small window.
    """
    first = events.groupBy("iid").agg(F.min(F.struct(*order)).alias("first"))
    base = F.lit(0).cast("long")
    if known is not None:
        first = first.join(known.select("iid"), "iid", "left_anti")
        top = known.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).cast("long").alias("base"))
        first, base = first.crossJoin(F.broadcast(top)), F.col("base")  # a single row
    new = first.select("iid", (F.row_number().over(Window.orderBy("first", "iid")) - 1 + base).cast("long").alias("ordinal"))
    new = new.withColumn("label", F.concat(F.lit("Participant "), letters(F.col("ordinal"))))
    return new if known is None else known.select("iid", "ordinal", "label").unionByName(new)


def name_variants(name: Column) -> Column:
    """The name and its parts of two letters or more, with each suffix."""
    parts = F.array_union(F.array(F.trim(name)), F.filter(F.split(F.trim(name), r"\s+"), lambda p: F.length(p) >= 2))
    return F.flatten(F.transform(parts, lambda p: F.array(*(F.concat(p, F.lit(s)) for s in NAME_SUFFIXES))))


def handle_variants(handle: Column) -> Column:
    """The handle without @, never split, of three letters or more, with each suffix."""
    h = F.regexp_replace(F.trim(handle), "^@+", "")
    return F.when(F.length(h) >= 3, F.array(*(F.concat(h, F.lit(s)) for s in HANDLE_SUFFIXES))).otherwise(F.array().cast("array<string>"))


def deny_list(names: DataFrame, handles: DataFrame) -> DataFrame:
    """variant, is_handle, ord: longest first, then by text."""
    a = names.select(F.explode(name_variants(F.col("name"))).alias("variant"), F.lit(False).alias("is_handle"))
    b = handles.select(F.explode(handle_variants(F.col("handle"))).alias("variant"), F.lit(True).alias("is_handle"))
    each = a.unionByName(b).groupBy("variant").agg(F.min("is_handle").alias("is_handle"))
    return each.withColumn("ord", F.row_number().over(Window.orderBy(F.length("variant").desc(), "variant")))


def vet_handles(handles: DataFrame, bodies: DataFrame, least_length: int = 4, least_bodies: int = 12, most_rate: float = 0.25) -> DataFrame:
    """handle, n, hits, rate, kept: handles that stand in over a quarter of at least 12 bodies are ordinary words.

    The handles are a configured list (broadcast as such). Those of one word are looked up among each body's words;
    only handles of several parts are searched for as patterns, in every body.
    """
    n = bodies.agg(F.count(F.lit(1)).alias("n"))
    word = F.expr(r"body rlike concat('(?iU)(?<!\\w)\\Q', handle, '\\E(?!\\w)')")
    one = F.col("handle").rlike(r"(?U)^\w+$")
    words = bodies.select(F.explode(F.array_distinct(F.split(F.lower("body"), r"(?U)\W+"))).alias("__word"))
    found = words.join(F.broadcast(handles.where(one).select("handle", F.lower("handle").alias("__word"))), "__word").select("handle")
    found = found.unionByName(bodies.join(F.broadcast(handles.where(~one)), word).select("handle"))
    hits = found.groupBy("handle").agg(F.count(F.lit(1)).alias("hits"))
    out = handles.crossJoin(F.broadcast(n)).join(hits, "handle", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    rate = F.coalesce(F.try_divide(F.col("hits"), F.col("n")), F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("kept", (F.length("handle") >= least_length) & ~((F.col("n") >= least_bodies) & (rate > most_rate)))


def group_id(text: Column) -> Column:
    """The bytes of a group id in any spelling - prefixed hex, hex, base64 with or without padding; null if none fits."""
    t = F.regexp_replace(F.trim(text), r"^__[a-z_]+__v\d+__!", "")
    padded = F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4))))
    return F.when(t.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(t)).otherwise(F.try_to_binary(padded, F.lit("base64")))


def phone_forms(phone: Column) -> Column:
    """All digits of a phone number and its last seven, where there are seven."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(d) >= 7, F.array_distinct(F.array(d, F.right(d, F.lit(7))))).otherwise(F.array().cast("array<string>"))
