"""Personal data by weak supervision, with DataFrame functions alone on the main path.

Candidate spans come from patterns. Labelers vote on each: its shape, a gazetteer, its checksum or ranges, and the words
around it. Votes are counted by pattern over the whole corpus - at most some hundred rows, whatever its size - and
expectation-maximisation on those counts estimates how far each labeler can be relied on and how likely each pattern
is personal data. Those likelihoods train a logistic span classifier on the span's kind, votes and form, which is
applied as a column expression. It alone decides on the candidates that the base kinds leave out: numbers inside of
runs that the base drops whole, phones without a plus sign, spelt-out addresses, and kinds of their own. Base spans stay
whatever it says, but those that it doubts are told.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.native_spans import found_spans, has_hits, listed, span_rows, unheld


def _like(pattern: str):
    return lambda: F.col("text").rlike(pattern)


_HONORIFICS = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
#: A phone number in groups, with a country code or a North American one without.
_PHONE_RUN = r"(?:(?<![0-9.-])\+[0-9]{1,3}(?:[\x20().-]{1,2}[0-9]{2,4}){2,4}|(?<![0-9.+-])(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4})(?![0-9]|-[0-9])"
#: name, pattern, and what a text must hold for a match that counts. The base kinds come first, in the order that
#: breaks ties. Card runs are whole runs, so the least number of digits can stand in the pattern; an address starts
#: where a run of its characters does, or where the match before it ended.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda: F.col("text").contains("@")),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _like(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", _like(r"[0-9](?:[\x20-]?[0-9]){11}")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _like(r"\+[0-9][\x20().0-9-]+[0-9]")),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _like(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", _like(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    ("card_run", r"(?<![0-9])(?:[0-9]{12,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", _like(r"[0-9]{12}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}")),
    ("phone_run", _PHONE_RUN, _like(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\+[0-9]{1,3}[\x20().-]{1,2}[0-9]{2,4}[\x20().-]")),
    ("email_spelt", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,4}+", _like(r"[\[(](?i:at)[\])]")),
    ("name", rf"(?<![\p{{L}}])(?:{_HONORIFICS})\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?:\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+)?+", _like(rf"(?<![\p{{L}}])(?:{_HONORIFICS})\.?\x20\p{{Lu}}")),
]
BASE = 4
#: What the other kinds that find a base kind's data are called in the lists.
CALLED = {"card_run": "card", "phone_run": "phone", "email_spelt": "email"}
LABELERS = ("shape", "gazetteer", "context", "check")
ROUNDS = 60

#: Words that speak for a kind before a span, and against any kind.
_FOR = {
    "email": r"e-?mails?|contact|write|reach|mailto|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|client|server|from|login",
    "card": r"card|visa|mastercard|amex|payment|credit|debit|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|fax|cell|whatsapp|teléfono|téléphone|telefon",
    "ssn": r"ssn|social security|tax id",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "name": r"name|dear|contact|patient|client|sincerely|regards|signed",
}
_AGAINST = r"version|release|isbn|doi|order|invoice|serial|part no|build|figure|table|section|example|sample"
#: First and last names, top-level domains and country codes that the gazetteer labeler knows.
_NAMES = r"\b(?:James|Mary|John|Anna|Robert|Linda|Michael|Maria|David|Sarah|Thomas|Laura|Peter|Julia|Paul|Sophie|Carlos|Lucia|Pierre|Claire|Hans|Petra|Smith|Jones|Brown|Müller|Schmidt|Martin|Garcia|Lopez|Dubois)\b"
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|us|info|co)$"
_IBAN_LANDS = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
#: Area or exchange codes that no number has.
_NO_AREA = r"^\+?1?[\x20.-]?\(?(?:[2-9]11|[2-9][0-9]{2}\)?[\x20.-]?[2-9]11)"
_OCTETS = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.coalesce(F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def iban_ok(value: Column) -> Column:
    """Whether an IBAN's check digits hold: the number modulo 97, taken digit by digit."""
    v = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.coalesce(F.aggregate(codes, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x).cast("int") % 97) == 1, F.lit(False))


def _valid(kind: Column, value: Column) -> Column:
    """Whether a span's digits can be what its kind says: what keeps a base kind's raw match, and a vote for the others."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", value.rlike(_OCTETS)).when(kind.isin("card", "card_run"), F.length(digits).between(12, 19) & luhn(digits)).when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "phone_run", F.length(digits).between(9, 15) & ~value.rlike(_NO_AREA))
        .when(kind == "ssn", ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")).when(kind == "iban", iban_ok(value)).otherwise(F.lit(True))
    )


def _votes(rows: DataFrame) -> DataFrame:
    """The rows with a vote of each labeler: 1 for personal data, -1 against, 0 for none."""
    kind, value, before, after = (F.col(c) for c in ("kind", "value", "before", "after"))
    speaks = reduce(lambda c, k: c.when(kind.isin(k, f"{k}_run", f"{k}_spelt"), F.lower("before").rlike(f"(?i)(?:{_FOR[k]})")), _FOR, F.when(F.lit(False), F.lit(False)))
    context = F.when(F.lower(before).rlike(_AGAINST), -1).when(speaks, 1).otherwise(0)
    edge = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    shape = F.when(edge, -1).when(kind == "email", F.when(value.rlike(r"^[^@]{1,64}@.{3,253}$") & ~value.rlike(r"^\.|\.\.|\.@"), 1).otherwise(-1)).otherwise(1)
    gazetteer = (
        F.when(kind.isin("email", "email_spelt"), F.when(value.rlike(_DOMAINS), 1).otherwise(0)).when(kind == "ip", F.when(value.rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
        .when(kind == "phone", F.when(value.rlike(r"^\+(?:1|3[0-9]|4[0-9])"), 1).otherwise(0)).when(kind == "phone_run", F.when(value.rlike(r"^(?:\+(?:1|3[0-9]|4[0-9])|\(?[2-9][0-8][0-9])"), 1).otherwise(0))
        .when(kind == "iban", F.when(value.rlike(_IBAN_LANDS), 1).otherwise(-1)).when(kind == "name", F.when(value.rlike(_NAMES), 1).otherwise(0))
        .when(kind.isin("card", "card_run"), F.when(value.rlike("^[3-6]"), 1).otherwise(-1)).otherwise(0)
    )
    check = F.when(kind.isin("email", "email_spelt", "name"), 0).when(F.col("valid"), 1).otherwise(-1)
    return rows.withColumns({"v_shape": shape, "v_gazetteer": gazetteer, "v_context": context, "v_check": check})


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], groups: list[str] | None = None, rounds: int = ROUNDS) -> tuple[list[float], dict[str, list[list[float]]]]:
    """The likelihood that each pattern of votes (-1, 0 or 1 each) marks personal data, and each labeler's chances of
    voting -1 and 1 given either class (at 0 and 2; not to vote, at 1, tells nothing), from the patterns' counts. Labelers are taken as independent given the class
    and as reliable in one group of patterns as in another, while each group has a share of personal data of its own;
    counts are smoothed, and the start is the majority. No patterns give none."""
    if not patterns:
        return [], {}
    votes, n = np.array([p for p, _ in patterns]) + 1, np.array([c for _, c in patterns], float)
    of = np.unique(groups if groups is not None else [""] * len(patterns), return_inverse=True)[1]
    post = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float) - 0.5))
    rel = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        prior = ((np.bincount(of, n * post) + 1) / (np.bincount(of, n) + 2))[of]
        for y, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(votes.shape[1]):
                c = np.bincount(votes[:, j], w, 3) + 0.5
                c[2 if y else 0] += 1.0  # a labeler is held to be better than chance until counts say otherwise
                rel[y, j] = c[0] / (c[0] + c[2]), 1.0, c[2] / (c[0] + c[2])
        logs = [np.log(p) + sum(np.log(rel[y, j, votes[:, j]]) for j in range(votes.shape[1])) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return [float(p) for p in post], {name: [[float(x) for x in rel[y, j]] for y in (0, 1)] for j, name in enumerate(LABELERS)}


class SpanModel:
    """Labelers' reliabilities and the span classifier's weights, by feature."""

    def __init__(self, rows: list[tuple[str, tuple[int, ...], int, float]]):
        """rows: kind, votes, form and count."""
        merged: dict[tuple[str, tuple[int, ...]], float] = {}
        for k, v, _, n in rows:
            merged[k, v] = merged.get((k, v), 0.0) + n
        likely, self.reliability = expectation_maximisation([(v, n) for (_, v), n in merged.items()], [k for k, _ in merged])
        post = dict(zip(merged, likely, strict=True))
        self.features = sorted({f for k, v, form, _ in rows for f in self._of(k, v, form)})
        at = {f: i for i, f in enumerate(self.features)}
        x = np.zeros((len(rows), len(at) + 1))
        x[:, -1] = 1
        for i, (k, v, form, _) in enumerate(rows):
            for f in self._of(k, v, form):
                x[i, at[f]] = 1
        y, n = np.array([post[k, v] for k, v, _, _ in rows]), np.array([c for *_, c in rows], float)
        w = np.zeros(x.shape[1])
        pull = np.full(x.shape[1], 1.0)
        for _ in range(40 if len(rows) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - y)) + pull * w
            h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            d = np.linalg.solve(h, g)
            w -= d
            if np.abs(d).max() < 1e-8:
                break
        self.weights, self.bias = {f: float(w[i]) for f, i in at.items()}, float(w[-1])

    @staticmethod
    def _of(kind: str, votes: tuple[int, ...], form: int) -> list[str]:
        return [f"kind={kind}", f"form={form}", *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True))]

    def probability(self) -> Column:
        """The classifier as an expression over kind, form and the votes."""
        terms = [F.lit(self.bias)]
        for f, w in self.weights.items():
            name, value = f.split("=")
            is_it = F.col("kind") == value if name == "kind" else F.col("form" if name == "form" else f"v_{name}") == int(value)
            terms.append(F.when(is_it, F.lit(w)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(add, terms)))


def personal_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, SpanModel]:
    """The scanned rows (rid, doc_id), the spans of every candidate with its votes and probability, and the model.

    spans: rid, doc_id, kind, ord, start, end, value, valid, votes, probability, kept (a base span, or another one at
    probability 0.5 or more; an IBAN or SSN has to be valid, too). Raw matches that a base kind drops are no candidates, nor is what overlaps a base span.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, _ = found_spans(rows, KINDS, ["doc_id"])
    spans = span_rows(found, KINDS, ["doc_id"]).withColumn("valid", _valid(F.col("kind"), F.col("value"))).where(F.col("valid") | (F.col("ord") >= BASE))
    spans = _votes(unheld(spans, F.col("ord") < BASE)).withColumn("form", F.least(F.floor(F.length("value") / 6), F.lit(6)).cast("int"))
    votes = [f"v_{x}" for x in LABELERS]
    # kinds x votes x forms: at most a few thousand rows
    counts = spans.groupBy("kind", *votes, "form").agg(F.count(F.lit(1)).alias("n")).collect()
    model = SpanModel(sorted((r["kind"], tuple(r[v] for v in votes), r["form"], float(r["n"])) for r in counts))
    spans = spans.withColumn("probability", model.probability())
    return found, spans.withColumn("kept", (F.col("ord") < BASE) | (F.col("probability") >= 0.5) & (F.col("valid") | F.col("kind").isin(*CALLED))), model


def personal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, doubtful, one row for each of docs.

    spans lists base and added ones; n_added counts the latter, and doubtful lists the base spans that the classifier
    puts below 0.5. Null and empty texts have none, an empty table gives an empty one, and spans that start at one place
    come in the order of kinds. Repeated rows stay, null doc_ids too; other columns are not read.
    """
    found, spans, _ = personal_spans(docs)
    called = F.col("kind")
    for k, name in CALLED.items():
        called = F.when(F.col("kind") == k, name).otherwise(called)
    each = spans.where("kept").groupBy("rid", "doc_id").agg(F.collect_list(F.struct("start", "ord", called.alias("kind"), "end", (F.col("probability") < 0.5).alias("doubt"))).alias("s"))
    has = has_hits(KINDS)
    empty = F.array().cast(each.schema["s"].dataType).alias("s")
    dropped = found.where(has).select("rid", "doc_id").join(each.select("rid"), "rid", "left_anti")
    rows = each.unionByName(found.where(~has).select("rid", "doc_id", empty)).unionByName(dropped.select("rid", "doc_id", empty))

    def count(k: int):
        return F.size(F.filter("s", lambda x: x["ord"] == k)).cast("long")

    return rows.select(
        "doc_id", *(count(k).alias(f"n_{n}") for k, (n, _, _) in enumerate(KINDS[:BASE])),
        F.sha2(F.encode(listed(F.col("s"), where=lambda x: x["ord"] < BASE), "UTF-8"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["ord"] >= BASE)).cast("long").alias("n_added"), listed(F.col("s"), where=lambda x: (x["ord"] < BASE) & x["doubt"]).alias("doubtful"),
    )


def op6_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return personal_report(table(spark, sf_dir, "documents"))
