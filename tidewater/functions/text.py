"""Text functions: redaction layers, mention splicing, defanging, slugs. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Hosts whose links point at a person, and the placeholders of the layers.
PERSONAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "snapchat.com", "venmo.com", "cash.app", "paypal.me", "t.me", "wa.me", "signal.me", "strava.com", "untappd.com")
NAME, PHONE, EMAIL, UUID, IBAN, LINK, GROUP = "[participant]", "[phone]", "[email]", "[uuid]", "[iban]", "[personal-link]", "[group]"
PLACEHOLDERS = (NAME, PHONE, EMAIL, UUID, IBAN, LINK, GROUP)

# Shapes of identifiers, in Java's dialect with Unicode classes.
EMAIL_RE = r"(?U)(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.-]+(?![\w.-])"
UUID_RE = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
UUID_COMPACT_RE = r"(?i)(?<![0-9a-zA-Z])[0-9a-f]{32}(?![0-9a-zA-Z])"
IBAN_RE = r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b"
URL_RE = r"(?i)https?://[^\s<>\"')]+"
BTC_RE = r"\b(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
ETH_RE = r"\b0x[a-fA-F0-9]{40}\b"
_HOSTS = "|".join(re.escape(h) for h in sorted(PERSONAL_HOSTS, key=len, reverse=True))
PERSONAL_URL_RE = rf"(?i)https?://(?:www\.)?(?:[^\s/<>\"')]+\.)?(?:{_HOSTS})(?=[/\s<>\"')]|$)[^\s<>\"')]*"
BARE_PERSONAL_RE = rf"(?iU)(?<![\w@/.])(?:[\w-]+\.)*(?:{_HOSTS})/[^\s<>\"')]+"
LOOSE_PHONE = r"(?<![\w+])(?:\+\d[\d\s().-]{6,17}\d|0\d[\d\s().-]{6,15}\d|\d{2,4}[\s().-]\d{2,4}[\s().-]\d{2,6})(?![\w])"
SEPARATED_PHONE = r"(?<![\w])(?:\+\d[\d\s().-]{6,17}\d|0\d[\d\s().-]{6,15}\d|\d{2,4}[\s().-]\d{2,4}[\s().-]\d{2,6})(?![\w])"
BARE_DIGITS = r"(?<![\w+])(\d{10,15})(?![\w])"
E164_RE = r"(?U)(?<![\w+])\+[1-9]\d{7,14}(?!\w)"
#: Seven digits anywhere, the least that a phone number has.
SEVEN_DIGITS = r"(?:[0-9][^0-9]*+){7}"
SPEAKER_RE = r"\bParticipant\s+([A-Z]{1,3})\b"

# Characters that render as nothing or reorder what is rendered.
INVISIBLE = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x180E, *range(0x200E, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0xFFF9, 0xFFFC)]
_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
_FOREIGN_DIGIT = re.compile(r"(?![0-9])\d")

SIMPLE_LAYERS = (("email", EMAIL_RE, EMAIL), ("uuid", UUID_RE, UUID), ("uuid-compact", UUID_COMPACT_RE, UUID), ("iban", IBAN_RE, IBAN))


#: What a text holds where a layer can fire: looked at first, as most texts don't.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "uuid": lambda t: t.rlike("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), "uuid-compact": lambda t: t.rlike("[0-9a-fA-F]{32}"), "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
}


def _fold(text: str) -> str:
    if text.isascii():
        return text
    s = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _FOREIGN_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), s)


@F.pandas_udf(StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


def fold_confusables(text: Column) -> Column:
    """Compatibility forms, invisible characters and foreign decimal digits folded; ASCII texts never leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _fold_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(_nfkc, na_action="ignore")


def scrub_normalise(text: Column) -> Column:
    """Compatibility forms folded and backslashes turned, invisible characters kept; ASCII texts never leave the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.translate(F.when(odd, _nfkc_udf(F.when(odd, text))).otherwise(text), "\\", "/")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


class Layers:
    """A text as it goes through layers, and the rules that fired: each layer sees what the one before left.

    With rows, each layer is a projection of its own, worked out once; without, all layers are one expression, in which a
    later layer repeats the earlier ones.
    """

    def __init__(self, text: Column, rows: DataFrame | None = None):
        self.rows, self.fired, self.made = rows, [], 0
        self.raw = self.text = self.apart(text)

    def apart(self, column: Column) -> Column:
        """settled, behind an explode of one value: beside Python functions, Spark would write projections into each other."""
        return self.settled(F.explode(F.array(self.settled(column)))) if self.rows is not None else column

    def settled(self, *columns: Column):
        """The columns as columns of the rows, where there are rows."""
        if self.rows is not None:
            names = [f"__layer_{self.made + i}" for i in range(len(columns))]
            self.rows, self.made = self.rows.withColumns(dict(zip(names, columns, strict=True))), self.made + len(names)
            columns = [F.col(n) for n in names]
        return columns[0] if len(columns) == 1 else columns

    def replace(self, rule: str, pattern: str, by: str, needs=None) -> "Layers":
        """needs: a cheap condition on the raw text without which the pattern can't match (no placeholder meets one).

        Without rows, only the first layer replaces under its condition: a later one names the text once, or the
        expression would double with each layer.
        """
        hit, new = self.text.rlike(pattern), F.regexp_replace(self.text, pattern, by)
        if needs is not None:
            hit = needs(self.raw) & hit
            if not self.fired or self.rows is not None:
                new = F.when(needs(self.text), new).otherwise(self.text)
        fired, self.text = self.settled(F.when(hit, F.lit(rule)), new)
        self.fired.append(fired)
        return self

    def rules(self) -> Column:
        return F.array_compact(F.array(*self.fired)) if self.fired else F.array().cast("array<string>")


def redact_simple(text: Column | Layers) -> Layers:
    """E-mail, dashed and compact UUIDs, IBANs."""
    out = text if isinstance(text, Layers) else Layers(text)
    for rule, pattern, by in SIMPLE_LAYERS:
        out.replace(rule, pattern, by, NEEDS.get(rule))
    return out


def host(url: Column) -> Column:
    """The host with port and user info, in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[^/]*//)?([^/]*)", 1)), r"^www\.", "")


def is_personal_host(h: Column) -> Column:
    return h.rlike(rf"^(?:.*\.)?(?:{_HOSTS})$")


def kept_urls(text: Column) -> Column:
    """Links to anything but a person's page, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(URL_RE), F.lit(0)), lambda u: ~is_personal_host(host(u)))


def redact_links(layers: Layers) -> Layers:
    return layers.replace("personal-url", PERSONAL_URL_RE, LINK, lambda t: F.contains(t, F.lit("://"))).replace("personal-url-bare", BARE_PERSONAL_RE, LINK, lambda t: F.contains(t, F.lit("/")))


def addresses(text: Column) -> Column:
    """Bitcoin and Ethereum addresses: counted, kept."""
    return F.regexp_count(text, F.lit(BTC_RE)) + F.regexp_count(text, F.lit(ETH_RE))


def literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def whole_word(text: str) -> str:
    return rf"(?iU)(?<!\w){literal(text)}(?!\w)"


def may_hold(name: str):
    """A cheap condition for whole_word on folded texts; none for a name beyond ASCII, whose cases are many."""
    return (lambda t: F.contains(F.lower(t), F.lit(name.lower()))) if name.isascii() else None


def has_word(text: Column, word: str) -> Column:
    needs = may_hold(word)
    return text.rlike(whole_word(word)) if needs is None else F.when(needs(text), text.rlike(whole_word(word))).otherwise(False)


def redact_names(layers: Layers, group: str | None, names: Sequence[str]) -> Layers:
    """The group's name, then names longest first; a fired name is told by its place only."""
    if group:
        layers.replace("group-name", whole_word(group), GROUP, may_hold(group))
    for i, n in enumerate(sorted(names, key=lambda n: (-len(n), n))):
        layers.replace(f"name-{i}", whole_word(n), NAME, may_hold(n))
    return layers


def looks_like_phone(text: str) -> bool:
    """The documented subset of numbering plans: 7 to 15 digits and a leading +, a NANP number or a UK one."""
    d = re.sub(r"\D", "", text)
    return 7 <= len(d) <= 15 and (text.strip().startswith("+") or is_dialable(d) or bool(re.fullmatch(r"[2-9]\d\d[2-9]\d{6}|0[1237]\d{8,9}", d)))


def is_dialable(digits: str) -> bool:
    """10 to 15 digits that start with a country code and go on as its plan does, of NANP and the UK."""
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"1[2-9]\d\d[2-9]\d{6}|44[1237]\d{8,9}", digits))


def phone_spans(text: str) -> list[tuple[int, int]]:
    """Spans of phone numbers, overlapping ones merged."""
    spans = [m.span() for m in re.finditer(LOOSE_PHONE, text) if looks_like_phone(m[0])]
    spans += [m.span() for m in re.finditer(BARE_DIGITS, text) if is_dialable(m[1])]
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _without_phones(text: str) -> str:
    for a, z in reversed(phone_spans(text)):
        text = text[:a] + PHONE + text[z:]
    return text


@F.pandas_udf(StringType())
def _phones_udf(s: pd.Series) -> pd.Series:
    return s.map(_without_phones, na_action="ignore")


def redact_phones(layers: Layers, allow_subset: bool = False) -> Layers:
    """Phone numbers by the documented subset of plans; only texts with 7 digits or more go to Python.

    The full plans need a library that isn't here, so the subset has to be asked for.
    """
    if not allow_subset:
        raise RuntimeError("phone redaction knows a subset of numbering plans only: pass allow_subset=True")
    before = layers.apart(layers.text)
    may = layers.settled(before.rlike(SEVEN_DIGITS))
    layers.text = layers.apart(F.when(may, _phones_udf(F.when(may, before))).otherwise(before))
    layers.fired.append(layers.settled(F.when(layers.text != before, F.lit("phone"))))
    return layers


def redact(text: Column, names: Sequence[str] = (), group: str | None = None, sensitive: Sequence[str] = (), fold: bool = True, phones: bool = True, allow_subset: bool = False) -> Column:
    """All layers in order - fold, sensitive terms, simple, phones, links, group, names - as a struct of text, rules,
    dropped, kept_urls, kept_addresses and kept_url_list (what of the kept links is in the text still).

    A text that holds a sensitive term once folded is dropped: empty text. Null stays null.
    """
    return _redacted(text, Layers(fold_confusables(text) if fold else text), names, group, sensitive, phones, allow_subset)


def redact_rows(rows: DataFrame, text: str, into: str, names: Sequence[str] = (), group: str | None = None, sensitive: Sequence[str] = (), fold: bool = True, phones: bool = True, allow_subset: bool = False) -> DataFrame:
    """rows with what redact gives for a column of theirs, in projections that work each layer out once."""
    layers = Layers(fold_confusables(F.col(text)) if fold else F.col(text), rows)
    out = _redacted(F.col(text), layers, names, group, sensitive, phones, allow_subset)
    return layers.rows.select(*(c for c in rows.columns if c != into), out.alias(into))


def _redacted(text: Column, layers: Layers, names: Sequence[str], group: str | None, sensitive: Sequence[str], phones: bool, allow_subset: bool) -> Column:
    folded = layers.raw
    redact_simple(layers)
    if phones:
        redact_phones(layers, allow_subset)
    kept = layers.settled(kept_urls(layers.text))
    redact_links(layers)
    n_addresses = layers.settled(addresses(layers.text))
    redact_names(layers, group, names)
    dropped = F.lit(False)
    for t in sensitive:
        dropped = dropped | F.contains(F.lower(folded), F.lit(t.lower()))
    out = layers.text
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(dropped, "").otherwise(out).alias("text"), F.when(dropped, F.array(F.lit("sensitive"))).otherwise(layers.rules()).alias("rules"), dropped.alias("dropped"),
            F.size(kept).alias("kept_urls"), n_addresses.alias("kept_addresses"), F.array_compact(F.zip_with(kept, F.array_repeat(out, F.size(kept)), lambda u, t: F.when(F.contains(t, u), u))).alias("kept_url_list"),
        ),
    )


def only_placeholders(text: Column) -> Column:
    """Whether nothing alphanumeric is left but placeholders."""
    return ~F.regexp_replace(text, "|".join(literal(p) for p in PLACEHOLDERS), " ").rlike(r"[\p{L}\p{N}]")


def splice_mentions(body: Column, mentions: Column, label) -> Column:
    """The body with mention spans (start and length in UTF-16 units) replaced by label(uuid).

    Spans go in descending order of start, first come first at ties; negative, empty-handed, overlapping and
    out-of-range ones and those that would split a surrogate pair are left out.
    """
    units = F.encode(body, "UTF-16LE")
    total = (F.octet_length(units) / 2).cast("int")
    indexed = F.transform(F.coalesce(mentions, F.array().cast("array<struct<start:int,length:int,uuid:string>>")), lambda m, i: F.struct((-m["start"]).alias("s"), i.alias("i"), m["length"].alias("n"), m["uuid"].alias("u")))

    def low(at: Column) -> Column:
        """Whether the unit at a place is the second of a pair (its high byte is DC to DF)."""
        return F.hex(F.substring(units, at * 2 + 2, F.lit(1))).rlike("^D[C-F]$")

    def step(acc: Column, m: Column) -> Column:
        a, z = -m["s"], -m["s"] + m["n"]
        ok = (a >= 0) & (m["n"] >= 0) & (z <= total) & (z <= acc["upto"]) & ~low(a) & ~low(z)
        new = F.concat(F.substring(acc["buf"], F.lit(1), a * 2), F.encode(label(m["u"]), "UTF-16LE"), F.substring(acc["buf"], z * 2 + 1, F.octet_length(acc["buf"])))
        return F.struct(F.when(ok, new).otherwise(acc["buf"]).alias("buf"), F.when(ok, a).otherwise(acc["upto"]).alias("upto"))

    return F.aggregate(F.array_sort(indexed), F.struct(units.alias("buf"), total.alias("upto")), step, lambda acc: F.decode(acc["buf"], "UTF-16LE"))


def defang(text: Column, labels: Sequence[str] = ()) -> Column:
    """Angle brackets to round ones, line breaks to two spaces, labels that weren't allocated to `member X`."""
    out = F.regexp_replace(F.translate(text, "<>", "()"), r"[\r\n  ]+", "  ")
    allowed = "|".join(re.escape(x) for x in labels)
    ahead = rf"(?!(?:{allowed})(?!\w))" if allowed else ""
    return F.regexp_replace(out, rf"(?U)(?<!\w)Participant(\s+){ahead}([A-Za-z]{{1,3}})(?!\w)", "member$1$2")


def defang_known(text: Column, known: Column) -> Column:
    """defang with the allocated labels as an array column (`Participant X`), which may differ by row."""
    out = F.regexp_replace(F.translate(text, "<>", "()"), r"[\r\n\u2028\u2029]+", "  ")
    said = r"(?U)(?<!\w)Participant(\s+)([A-Za-z]{1,3})(?!\w)"
    between, found = F.split(out, said, -1), F.regexp_extract_all(out, F.lit(said), F.lit(0))

    def kept(m: Column) -> Column:
        label = F.concat(F.lit("Participant "), F.regexp_extract(m, said, 2))
        return F.when(F.array_contains(known, label), m).otherwise(F.regexp_replace(m, "^Participant", "member"))

    return F.when(F.size(found) == 0, out).otherwise(F.array_join(F.zip_with(between, F.transform(found, kept), lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), ""))


MEMBER = "a group member"


def depersonalise(text: Column) -> Column:
    """Speaker labels and handles to `a group member`; links stay as they are."""
    url = r"(?i)https?://\S+"

    def scrub(c: Column) -> Column:
        c = F.regexp_replace(c, r"(?U)(?<!\w)Participants?\s+[A-Z]{1,3}(?!\w)", MEMBER)
        return F.regexp_replace(c, r"(?U)(?<![\w@/])@[A-Za-z0-9._-]{2,}", MEMBER)

    between, links = F.split(text, url, -1), F.regexp_extract_all(text, F.lit(url), F.lit(0))
    return F.array_join(F.zip_with(between, links, lambda b, u: F.concat(scrub(b), F.coalesce(u, F.lit("")))), "")


def slug(title: Column, most: int = 120) -> Column:
    """A file name: separators to hyphens, unsafe characters out, white space collapsed; `Untitled` where none is left."""
    s = F.regexp_replace(title, r"[/\\]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r'[<>:"|?*\[\]#^\x00-\x1f]', ""), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"^[ .-]+|[ .-]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(s, 1, most), r"[ .-]+$", ""), F.lit("")), F.lit("Untitled"))


# File names that an operating system keeps for devices.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def topic_key(text: Column, most: int = 64) -> Column:
    """A topical slug: lower-case ASCII words joined by hyphens, from a letter, cut at a hyphen; null where none is left."""
    s = F.regexp_replace(F.lower(fold_confusables(depersonalise(text))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<![a-z0-9])participants?-[a-z]{1,3}(?![a-z0-9])", ""), "-+", "-")
    s = F.regexp_replace(s, "^[^a-z]+|-+$", "")
    cut = F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(F.regexp_replace(F.substring(s, 1, most + 1), "-[^-]*$", ""), f"^(.{{{most}}}).+$", "$1"))
    return F.when((cut != "") & ~cut.isin(*RESERVED), cut)


def research_title(title: Column, prefix: str = "Research - ") -> Column:
    """The title with its prefix, once."""
    return F.when(F.startswith(F.lower(title), F.lit(prefix.lower())), title).otherwise(F.concat(F.lit(prefix), title))


def yaml_scalar(v: Column) -> Column:
    """Bare where that is safe, else quoted with its backslashes, quotes and control characters escaped or out."""
    inner = F.replace(F.replace(F.regexp_replace(v, r"[\x00-\x1f\x7f]", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), v).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def yaml_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, yaml_scalar), ", "), F.lit("]"))


def cell(v: Column) -> Column:
    """A table cell: pipes escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(v, F.lit("|"), F.lit("\\|")), r"\s+", " "))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def shortened(text: Column, most: int) -> Column:
    """The text, or its first most - 3 characters and dots."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def evidence_table(evidence: Column, most: int = 300) -> Column:
    rows = F.transform(evidence, lambda e: F.concat(F.lit("| "), cell(e["url"]), F.lit(" | "), F.when(F.length(cell(e["quote"])) > most, F.concat(F.substring(cell(e["quote"]), 1, most - 3), F.lit("..."))).otherwise(cell(e["quote"])), F.lit(" | "), cell(e["confidence"]), F.lit(" |")))
    return F.concat_ws("\n", F.lit("| Source | Quote | Confidence |"), F.lit("| --- | --- | --- |"), F.array_join(rows, "\n"))


# Spellings of tags that would split one index page, and the one that stays.
TAG_CANONICAL = {
    "stablecoins": "stablecoin",
    "bitcoin-mining": "mining",
    "crypto-custody": "custody",
    "conflicts-of-interest": "conflict-of-interest",
    "related-party-transactions": "related-party",
    "institutional-finance": "institutional",
    "corporate-ownership": "ownership",
}


def clean_tags(tags: Column) -> Column:
    """Tags of the topical shape in their one spelling, sorted, once each."""
    spelt = F.create_map(*(F.lit(x) for kv in TAG_CANONICAL.items() for x in kv))
    shaped = F.filter(tags, lambda t: t.rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"))
    return F.array_sort(F.array_distinct(F.transform(shaped, lambda t: F.coalesce(spelt[t], t))))
