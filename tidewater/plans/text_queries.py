"""Redaction, links, identity, slugs, scans and firewall over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import identity as I
from tidewater.functions import text as T
from tidewater.operators import firewall, scan
from tidewater.plans.common import Book, table

_b = Book()
QUERIES, ORACLE = _b.queries, _b.oracle

_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"


@_b.query(rf"""
with t0 as (select source, text from documents where text is not null),
t1 as (select source, regexp_matches(text, '{_EMAIL}') as e, regexp_replace(text, '{_EMAIL}', '[email]', 'g') as t from t0),
t2 as (select source, e, regexp_matches(t, '(?i)(^|[^0-9a-f])[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}($|[^0-9a-f])') as u, t from t1),
t3 as (select source, e, u, regexp_matches(t, '(^|[^0-9a-zA-Z])[0-9a-fA-F]{{32}}($|[^0-9a-zA-Z])') as c, regexp_matches(t, '\b[A-Z]{{2}}\d{{2}}(?:\s?[A-Z0-9]){{11,30}}\b') as i from t2)
select source, rule, cast(count(*) as bigint) as n from (
select source, 'email' as rule from t3 where e union all select source, 'uuid' from t3 where u union all select source, 'uuid-compact' from t3 where c union all select source, 'iban' from t3 where i) group by all
""")
def redact_simple_by_source(spark, sf_dir):
    """How often each simple redaction rule fires, by source."""
    rules = T.redact_simple(F.col("text")).rules()
    return table(spark, sf_dir, "documents").select("source", F.explode(rules).alias("rule")).groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))


@_b.query(rf"select doc_id, regexp_replace(text, '{_EMAIL}', '[email]', 'g') as redacted from documents")
def redact_email_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains("text", F.lit("@")), F.regexp_replace("text", T.EMAIL_RE, T.EMAIL)).otherwise(F.col("text")).alias("redacted"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), '^www\.', '')"


@_b.query(f"""select host, bool_or(personal) as personal, cast(count(*) as bigint) as n from (select {_HOST} as host, regexp_matches({_HOST}, '^(.*\\.)?({"|".join(h.replace(".", chr(92) + ".") for h in T.PERSONAL_HOSTS)})$') as personal from pages) group by host""")
def url_host_policy(spark, sf_dir):
    """Pages by host, and whether the host is a personal one."""
    h = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.bool_or(T.is_personal_host(F.col("host"))).alias("personal"), F.count(F.lit(1)).alias("n"))


_LINKS = [
    ("see https://www.sec.gov/a/filing.htm now", 1, "see https://www.sec.gov/a/filing.htm now"), ("https://t.me/someone", 0, "[personal-link]"), ("at linkedin.com/in/x ok", 0, "at [personal-link] ok"),
    ("I left facebook.com", 0, "I left facebook.com"), ("https://archive.invalid/t.me/thread", 1, "https://archive.invalid/t.me/thread"), ("https://notfacebook.com/x", 1, "https://notfacebook.com/x"),
]


@_b.query("select * from (values " + ", ".join(f"('{a}', {n}, '{b}')" for a, n, b in _LINKS) + ") v(body, kept, redacted)")
def link_policy_vectors(spark, sf_dir):
    """Kept and redacted links of fixed texts."""
    df = spark.createDataFrame([(a,) for a, _, _ in _LINKS], "body string")
    return df.select("body", F.size(T.kept_urls(F.col("body"))).alias("kept"), T.redact_links(T.Layers(F.col("body"))).text.alias("redacted"))


_FULL = [
    ("Anna Smith wrote from the Ravenhill group", "[participant] wrote from the [group] group", "group-name,name-0"), ("call +1 415 555 0123 please", "call [phone] please", "phone"),
    ("reserves hit 3200000000 usd", "reserves hit 3200000000 usd", ""), ("filed in 2024 under rule 10b5-1", "filed in 2024 under rule 10b5-1", ""), ("Bo's note", "[participant]'s note", "name-1"),
    ("whatsapp 447700900123", "whatsapp [phone]", "phone"), ("127000000000 in assets", "127000000000 in assets", ""), ("got my diagnosis back", "", "sensitive"),
]


@_b.query("select * from (values " + ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in _FULL) + ") v(body, redacted, rules)")
def redact_full_vectors(spark, sf_dir):
    """All redaction layers on fixed texts."""
    df = spark.createDataFrame([(a,) for a, _, _ in _FULL], "body string")
    r = T.redact(F.col("body"), names=["Anna Smith", "Bo"], group="Ravenhill", sensitive=["diagnosis"], allow_subset=True)
    return df.select("body", r["text"].alias("redacted"), F.array_join(r["rules"], ",").alias("rules"))


@_b.query()
def redact_documents(spark, sf_dir):
    """All redaction layers on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.redact_rows(docs, "text", "r", names=["Anna Smith"], group="Ravenhill", allow_subset=True).select("doc_id", "r.text", F.array_join("r.rules", ",").alias("rules"), "r.kept_urls", "r.kept_addresses")


_NAMES, _HANDLES = ["Anna Smith", "Bo"], ["@annas", "xy", "thor"]


@_b.query("""with n(name) as (values ('Anna Smith'), ('Bo')), p as (select name as v from n union select unnest(string_split(name, ' ')) from n),
h(v) as (values ('annas'), ('thor')), e as (select v || s as variant, false as is_handle from p, (values (''), ('''s'), ('s'''), ('’s')) x(s) where length(v) >= 2 union all select v || s, true from h, (values (''), ('''s'), ('’s')) x(s)),
d as (select variant, bool_and(is_handle) as is_handle from e group by variant) select variant, is_handle, cast(row_number() over (order by length(variant) desc, variant) as integer) as ord from d""")
def deny_variants(spark, sf_dir):
    """The deny-list of names and handles, longest first."""
    return I.deny_list(spark.createDataFrame([(x,) for x in _NAMES], "name string"), spark.createDataFrame([(x,) for x in _HANDLES], "handle string"))


@_b.query(r"""with h(handle) as (values ('the'), ('thor'), ('zzzz')), n as (select count(*) as n from conversations),
k as (select handle, count(*) as hits from h, conversations where regexp_matches(' ' || text || ' ', '(?i)[^\pL\pN_]' || handle || '[^\pL\pN_]') group by handle)
select h.handle, cast(n.n as bigint) as n, cast(coalesce(hits, 0) as bigint) as hits, round(coalesce(hits, 0) / n.n, 9) as rate, length(h.handle) >= 4 and not (n.n >= 12 and coalesce(hits, 0) / n.n > 0.25) as kept from h cross join n left join k on k.handle = h.handle""")
def deny_hit_rate(spark, sf_dir):
    """Handles vetted against all bodies."""
    handles = spark.createDataFrame([("the",), ("thor",), ("zzzz",)], "handle string")
    return I.vet_handles(handles, table(spark, sf_dir, "conversations").select(F.col("text").alias("body"))).withColumn("rate", F.round("rate", 9)).select("handle", "n", "hits", "rate", "kept")


_KEY = bytes(range(32))
_PADS = ["".join(f"{b ^ x:02x}" for b in _KEY + bytes(32)) for x in (0x5C, 0x36)]


@_b.query(f"""select user_id, substr(sha256(unhex('{_PADS[0]}' || sha256(unhex('{_PADS[1]}' || hex(encode(cast(user_id as varchar))))))), 1, 12) as iid from (select distinct user_id from events)""")
def pseudonym_ids(spark, sf_dir):
    """Keyed ids of users."""
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", I.internal_id(_KEY, F.col("user_id").cast("string")).alias("iid"))


_LETTERS = "case when o < 26 then chr(cast(65 + o as integer)) when o < 702 then chr(cast(64 + o // 26 as integer)) || chr(cast(65 + o % 26 as integer)) else chr(cast(64 + (o // 26 - 1) // 26 as integer)) || chr(cast(65 + (o // 26 - 1) % 26 as integer)) || chr(cast(65 + o % 26 as integer)) end"


@_b.query(f"""with f as (select user_id, min(event_id) as first from events group by 1), r as (select user_id, row_number() over (order by first, user_id) - 1 as o from f)
select cast(user_id as varchar) as iid, cast(o as bigint) as ordinal, 'Participant ' || {_LETTERS} as label from r""")
def first_seen_labels(spark, sf_dir):
    """Labels by first appearance."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("iid"), "event_id", "user_id")
    return I.allocate_labels(e, order=("event_id", "user_id"))


@_b.query(r"""with s as (select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^[^a-z]+|-+$', '', 'g')) as k, p_name || ' / ' || p_type as t from part)
select p_partkey, case when k = '' then null when length(k) <= 64 then k else regexp_replace(substr(k, 1, 65), '-[^-]*$', '') end as topic_key, regexp_replace(replace(t, '/', '-'), '\s+', ' ', 'g') as slug from s""")
def topic_key_slug(spark, sf_dir):
    """Topic keys and file names of parts."""
    t = F.concat("p_name", F.lit(" / "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.topic_key(t).alias("topic_key"), T.slug(t).alias("slug"))


_SPLICES = [("hi @x yo", [(3, 2, "A")], "hi <A> yo"), ("\U0001f600 @x yo", [(3, 2, "A")], "\U0001f600 <A> yo"), ("@alice and @bob.", [(0, 6, "A"), (11, 4, "B")], "<A> and <B>."), ("short", [(99, 5, "A")], "short"),
            ("\U0001f600x", [(1, 1, "A")], "\U0001f600x"), ("x\U0001f600", [(0, 2, "A")], "x\U0001f600"), ("abc", [(0, -1, "A")], "abc"), ("abcdef", [(0, 4, "A"), (2, 3, "B")], "ab<B>f")]


@_b.query("select * from (values " + ", ".join(f"('{a}', '{c}')" for a, _, c in _SPLICES) + ") v(body, spliced)")
def mention_splice(spark, sf_dir):
    """Mentions spliced into fixed texts by UTF-16 units."""
    df = spark.createDataFrame([(a, m) for a, m, _ in _SPLICES], "body string, mentions array<struct<start:int,length:int,uuid:string>>")
    return df.select("body", T.splice_mentions(F.col("body"), F.col("mentions"), lambda u: F.concat(F.lit("<"), u, F.lit(">"))).alias("spliced"))


@_b.query(r"""select conv_id, turn, regexp_replace(translate(text, '<>', '()'), '[\r\n]+', '  ', 'g') as line from conversations""")
def defang_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.defang(F.col("text")).alias("line"))


@_b.query(rf"""select rule, cast(count(*) as bigint) as n from (select case when regexp_matches(lower(text), '(^|[^\pL\pN_])idiot($|[^\pL\pN_])') then 'roster-name' when contains(regexp_replace(text, '[^0-9]', '', 'g'), '5552830') then 'roster-phone'
when regexp_matches(text, '(^|[^0-9a-zA-Z])[0-9a-fA-F]{{32}}($|[^0-9a-zA-Z])') then 'uuid-compact' when regexp_matches(text, '{_EMAIL}') then 'email' else 'pass' end as rule from documents) group by rule""")
def firewall_violation(spark, sf_dir):
    """How many documents each firewall rule would stop, first rule only."""
    v = firewall.violation(F.col("text"), names=["idiot"], phones=["555-2830"], shape=False, phone_rules=False)
    return table(spark, sf_dir, "documents").select(F.coalesce(v, F.lit("pass")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@_b.query(r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) as s from documents where text is not null)
select cast(doc_id as varchar) as path, cast(line as integer) as line, 'email' as rule from l where regexp_matches(s, '[\w.+-]+@[\w-]+\.[\w.-]+') union all
select cast(doc_id as varchar), cast(line as integer), 'token-0' from l where regexp_matches(lower(s), '(^|[^\pL\pN_])scum($|[^\pL\pN_])')""")
def line_scan(spark, sf_dir):
    """Findings of the line scanner over documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    rules = [r for r in scan.STRUCTURAL_RULES if r[0] == "email"] + scan.token_rules(["scum"])
    return scan.scan(docs, tuple(rules))


@_b.query("select conv_id, turn, turn % 3 = 0 as blocked from conversations")
def request_shape(spark, sf_dir):
    """Requests of which every third has a forbidden key, spelt with an escape in every sixth."""
    c = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.lit("requests").alias("a"), F.col("text").alias("b")))
    nested = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("requests"))).alias("x")))
    key = F.when(F.col("turn") % 6 == 0, F.replace(nested, F.lit('"requests"'), F.lit('"\\u0072equests"'))).when(F.col("turn") % 3 == 0, nested).otherwise(plain)
    return c.select("conv_id", "turn", firewall.has_forbidden_key(key).alias("blocked"))


@_b.query("select doc_id, contains(lower(text), 'licen') as dropped from documents")
def sensitive_drop(spark, sf_dir):
    """Documents that hold a sensitive term are dropped, however it is spelt: here in full-width letters."""
    wide = F.regexp_replace("text", "(?i)licen", "\uff4ci\uff43en")
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(wide, sensitive=["licen"], phones=False)["dropped"].alias("dropped"))


@_b.query(f"""select doc_id, substr(sha256(text), 1, 12) as payload_id, case when regexp_matches(text, '(^|[^0-9a-zA-Z])[0-9a-fA-F]{{32}}($|[^0-9a-zA-Z])') then 'uuid-compact' when regexp_matches(text, '{_EMAIL}') then 'email' end as violation from documents where text is not null""")
def guard_split(spark, sf_dir):
    """Documents that pass the guard, and those in quarantine with their rule."""
    ok, blocked = firewall.guard(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "text", shape=False, phone_rules=False)
    return ok.select("doc_id", "payload_id", F.lit(None).cast("string").alias("violation")).unionByName(blocked.select("doc_id", "payload_id", "violation"))


@_b.query(r"""with l as (select doc_id, '- ' || split_part(text, chr(10), 1) as line from documents where text is not null)
select doc_id, line, regexp_matches(lower(' ' || line || ' '), '[^\pL\pN_](the|license)[^\pL\pN_]') as withheld from l""")
def safe_digest_lines(spark, sf_dir):
    """Index lines withheld for a name in them."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("- "), F.substring_index("text", "\n", 1)).alias("line"))
    return firewall.safe_digest(d, ["the"], "license").select("doc_id", "line", "withheld")
