"""The policy firewall: whole serialised rows against known and shaped identity, first failure wins; quarantine."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidewater.functions import text as T

# Keys that would route data past the check.
FORBIDDEN_KEYS = ("mcp_servers", "file_id", "container", "container_upload", "requests")


@F.pandas_udf(StructType([StructField("separated", BooleanType()), StructField("bare", BooleanType())]))
def _phones(s: pd.Series) -> pd.DataFrame:
    import re

    texts = s.fillna("")
    return pd.DataFrame({
        "separated": [any(T.looks_like_phone(m[0]) for m in re.finditer(T.SEPARATED_PHONE, t)) for t in texts],
        "bare": [any(T.is_dialable(m[1]) for m in re.finditer(T.BARE_DIGITS, t)) for t in texts],
    })


def has_forbidden_key(payload: Column, keys: Sequence[str] = FORBIDDEN_KEYS) -> Column:
    """Whether a JSON text has one of the keys at any depth, however it is spelt. What isn't JSON counts as if it had."""
    names = "|".join(keys)
    # strings' contents that could look like a key are escaped in JSON, so an unescaped quote before the name is one of its own
    plain = payload.rlike(rf'(?<!\\)"(?:{names})"\s*:')
    coded = F.contains(payload, F.lit("\\u"))  # only these can spell a key otherwise
    return F.when(payload.isNull(), False).otherwise(F.try_parse_json(payload).isNull() | plain | F.when(coded, _keys_among(keys)(F.when(coded, payload))).otherwise(False))


def _keys_among(keys: Sequence[str]):
    wanted = frozenset(keys)

    def has(value) -> bool:
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if wanted & x.keys():
                    return True
                todo += x.values()
            elif isinstance(x, list):
                todo += x
        return False

    def of(text: str | None) -> bool:
        try:
            return text is not None and has(json.loads(text))
        except (ValueError, RecursionError):
            return True

    @F.pandas_udf(BooleanType())
    def found(s: pd.Series) -> pd.Series:
        return s.map(of).astype(bool)

    return found


def violation(payload: Column, names: Sequence[str] = (), phones: Sequence[str] = (), group: str | None = None, group_id: str | None = None, labels: Sequence[str] | None = None, shape: bool = True, phone_rules: bool = True, allow_subset: bool = False) -> Column:
    """The first rule that a serialised payload breaks, or null.

    The phone rules know a subset of numbering plans only, which has to be asked for; a payload that isn't JSON breaks
    the request's shape.
    """
    if phone_rules and not allow_subset:
        raise RuntimeError("the phone rules know a subset of numbering plans only: pass allow_subset=True")
    t = F.replace(T.fold_confusables(payload), F.lit("\\"), F.lit("/"))
    digits = F.regexp_replace(t, "[^0-9]", "")
    hit = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    shaped = lambda rule, p: F.when(T.NEEDS[rule](t), t.rlike(p)).otherwise(False)
    forms = [d for p in phones if len(d0 := "".join(c for c in p if c.isdigit())) >= 7 for d in dict.fromkeys((d0, d0[-7:]))]
    cases: list[tuple[str, Column]] = [("request-shape", has_forbidden_key(payload))] if shape else []
    cases += [
        ("roster-name", hit(T.has_word(t, n) for n in names)), ("roster-phone", hit(F.contains(digits, F.lit(d)) for d in forms)),
        ("group-name", T.has_word(t, group) if group else F.lit(False)), ("group-id", F.contains(t, F.lit(group_id)) if group_id else F.lit(False)),
        ("uuid", shaped("uuid", T.UUID_RE)), ("uuid-compact", shaped("uuid-compact", T.UUID_COMPACT_RE)), ("email", shaped("email", T.EMAIL_RE)), ("e164-phone", F.when(F.contains(t, F.lit("+")), t.rlike(T.E164_RE)).otherwise(False)),
    ]
    if phone_rules:
        may = t.rlike(T.SEVEN_DIGITS)
        found = _phones(F.when(may, t))
        cases += [("separated-phone", may & found["separated"]), ("bare-phone", may & found["bare"])]
    if labels is not None:
        said = F.transform(F.regexp_extract_all(t, F.lit(T.SPEAKER_RE), F.lit(1)), lambda x: F.concat(F.lit("Participant "), x))
        cases.append(("unknown-label", F.size(F.array_except(said, F.array(*(F.lit(x) for x in labels)).cast("array<string>"))) > 0))
    out = F.when(F.lit(False), F.lit(""))
    for name, c in cases:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def payload_id(payload: Column) -> Column:
    return F.substring(F.sha2(payload, 256), 1, 12)


def guard(rows: DataFrame, payload: str, **policy) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those in quarantine with their payload id and rule."""
    marked = rows.withColumn("violation", violation(F.col(payload), **policy)).withColumn("payload_id", payload_id(F.col(payload)))
    return marked.where("violation is null").drop("violation"), marked.where("violation is not null")


def safe_digest(lines: DataFrame, names: Sequence[str], group: str | None = None) -> DataFrame:
    """line, withheld: index lines (`- …`) that name someone or the group are withheld."""
    bad = reduce(lambda a, b: a | b, (F.col("line").rlike(T.whole_word(n)) for n in [*names, *([group] if group else [])]), F.lit(False))
    return lines.withColumn("withheld", F.col("line").startswith("- ") & bad)


def canonical(payload: Column) -> Column:
    """JSON with sorted keys and characters as they are, as it is hashed; null for what isn't JSON."""

    def of(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def written(s: pd.Series) -> pd.Series:
        return s.map(of)

    return written(payload)
