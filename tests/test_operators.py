"""Operators on small fixtures: ordering, late mutations, quotas, merges, pages, geometry."""

import hashlib
import hmac
import random

import pytest

from pyspark.sql import functions as F

from tidewater.functions import identity, text
from tidewater.operators import archive, firewall, gate, graph, ingest, pages, scan, store, transcript
from tidewater.schemas import TOPICS


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def test_fold(spark):
    assert one(spark, text.fold_confusables(F.col("t")), t="a​b ４１５ ٣") == "ab 415 3"
    assert one(spark, text.fold_confusables(F.col("t")), t="plain") == "plain"


def test_names_respect_unicode_words(spark):
    out = text.redact_names(text.Layers(F.col("t")), None, ["Anna"]).text
    assert one(spark, out, t="éAnna Anna") == "éAnna [participant]"


def test_uuid_in_both_forms(spark):
    u = "-".join(["0" * 7 + "a", "1" * 4, "2" * 4, "3" * 4, "4" * 12])
    r = text.redact_simple(F.col("t"))
    assert one(spark, r.text, t=f"x {u} {u.replace('-', '')}") == "x [uuid] [uuid]"


def test_depersonalise_keeps_links(spark):
    assert one(spark, text.depersonalise(F.col("t")), t="Participant B and @bob at https://x.com/@c/1") == "a group member and a group member at https://x.com/@c/1"


def test_defang(spark):
    assert one(spark, text.defang(F.col("t"), ["A"]), t="<x>\n\nParticipant A, Participant ZZ") == "(x)  Participant A, member ZZ"


def test_redact_rows(spark):
    """The same as the column, in a plan that names each pattern a few times only."""
    texts = [None, "", "Anna Smith wrote to a@b.example from the Ravenhill", "call +1 415 555 0123 at https://t.me/x or https://sec.gov/a", "\u0661\u0662 \uff21nna\u200b Smith linkedin.com/in/x 1" + "a" * 26, "x" * 3000]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, text string, r string")
    args = dict(names=["Anna Smith"], group="Ravenhill", allow_subset=True)
    out = text.redact_rows(rows, "text", "redacted", **args)
    assert sorted(out.collect()) == sorted(rows.withColumn("redacted", text.redact(F.col("text"), **args)).collect())
    assert out._jdf.queryExecution().executedPlan().toString().count("RLIKE") < 40


def test_letters_beyond_three(spark):
    """Labels go on in base 26, as the reference's rule does."""
    got = [r["x"] for r in spark.createDataFrame([(18277,), (18278,), (90000,), (475253,), (475254,)], "n long").select(identity.letters(F.col("n")).alias("x")).collect()]
    assert got == ["ZZZ", "AAAA", "ECCO", "ZZZZ", "AAAAA"]


def test_hmac_and_letters(spark):
    key = bytes(range(32))
    assert one(spark, identity.internal_id(key, F.col("t")), t=" AbC ") == hmac.new(key, b"abc", hashlib.sha256).hexdigest()[:12]
    got = [r["x"] for r in spark.range(0, 800).select(identity.letters(F.col("id")).alias("x")).collect()]
    assert got[:3] + [got[25], got[26], got[701], got[702]] == ["A", "B", "C", "Z", "AA", "ZZ", "AAA"] and len(set(got)) == 800


def test_labels_are_stable(spark):
    known = spark.createDataFrame([("b", 0, "Participant A")], "iid string, ordinal long, label string")
    events = spark.createDataFrame([("a", 5), ("b", 1), ("c", 4)], "iid string, raw_ts long")
    assert {r["iid"]: r["label"] for r in identity.allocate_labels(events, known).collect()} == {"b": "Participant A", "c": "Participant B", "a": "Participant C"}


def test_group_id_spellings(spark):
    raw = bytes(range(32))
    import base64

    for s in (base64.b64encode(raw).decode(), base64.b64encode(raw).decode().rstrip("="), raw.hex(), "__chat_group__v2__!" + raw.hex(), raw.hex().upper()):
        assert bytes(one(spark, identity.group_id(F.col("t")), t=s)) == raw


def test_bucket_floors_negative_times(spark):
    assert spark.range(1).select(ingest.floor_bucket(F.lit(-1).cast("long"))).first()[0] == -900000


def test_inspect_shapes(spark):
    df = spark.createDataFrame([('{"chat":{"id":1}}',), ('{"chat":{"b":2}}',), ("broken",), ("[1]",)], "value string")
    assert [tuple(r) for r in ingest.inspect_shapes(df).collect()] == [("chat", 2, ["b", "id"])]


def test_mutations_in_any_order(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "source string, raw_ts long, body string")
    mu = spark.createDataFrame([("a", 1, "delete", 9, 0), ("a", 2, "edit", 5, 1), ("a", 2, "edit", 7, 2), ("q", 1, "delete", 1, 3)], "source string, target_ts long, kind string, by_ts long, arrival long")
    got = {(r["source"], r["raw_ts"]): (r["body"], r["retracted"], r["superseded_by"]) for r in store.apply_mutations(m, mu).collect()}
    assert got == {("a", 1): ("", True, None), ("a", 2): ("y", False, 7), ("b", 1): ("z", False, None)}


def test_insert_or_ignore(spark):
    s = spark.createDataFrame([("a", 1)], "source string, raw_ts long")
    n = spark.createDataFrame([("a", 1, 0, "p"), ("a", 2, 2, "later"), ("a", 2, 1, "first")], "source string, raw_ts long, arrival int, body string")
    assert [(r["raw_ts"], r["body"]) for r in store.insert_or_ignore(s, n).collect()] == [(2, "first")]


def test_transcript(spark):
    rows = [("a", 1, 0, "hi", None, None, 0, False), ("b", 2, 0, "[phone]", None, None, 0, False), ("c", 3, 900000, "yo", "a", "hi", 2, False), ("d", 4, 900000, "no", None, None, 0, False)]
    m = spark.createDataFrame(rows, "source string, raw_ts long, coarse_ts long, body string, quote_author string, quote_text string, attachment_count int, retracted boolean")
    labels = spark.createDataFrame([("a", "Participant A"), ("c", "Participant B")], "iid string, label string")
    got = {r["source"]: (r["disposition"], r["line"], r["header"]) for r in transcript.transcript_lines(m, labels, opted_out=("D",)).collect()}
    assert got["a"] == ("included", "Participant A: hi", True) and got["b"][0] == "only_placeholders" and got["d"][0] == "opted_out"
    assert got["c"] == ("included", "Participant B: (replying to: hi) yo [+2 attachment(s)]", True)


def test_transcript_without_text_or_with_a_dropped_quote(spark):
    rows = [("a", 1, 0, " ", None, None, 3, False), ("b", 2, 0, "yes", "a", "gone", 0, False)]
    m = spark.createDataFrame(rows, "source string, raw_ts long, coarse_ts long, body string, quote_author string, quote_text string, attachment_count int, retracted boolean")
    labels = spark.createDataFrame([("a", "Participant A"), ("b", "Participant B")], "iid string, label string")
    redact = lambda c: F.struct(c.alias("text"), F.array().cast("array<string>").alias("rules"), F.contains(c, F.lit("gone")).alias("dropped"))
    got = {r["source"]: (r["disposition"], r["line"]) for r in transcript.transcript_lines(m, labels, redact=redact).collect()}
    assert got == {"a": ("empty", None), "b": ("included", "Participant B: yes")}
    assert sorted(r["label"] for r in transcript.labels_in_use(labels).collect()) == ["Participant A", "Participant B", "[participant]"]


def test_transcript_mentions_and_labels(spark):
    rows = [("a", 1, 0, "hi @x, Participant B and Participant  Q", [(3, 2, "c")], "c", "Participant Z\nsaid " + "y" * 200), ("c", 2, 0, "no mention", None, None, None), ("b", 3, 900000, "\U0001f600 @x! ok", [(3, 2, "zz")], None, None), ("d", 4, 900000, "\U0001f600 @x!", [(3, 2, "zz")], None, None)]
    m = spark.createDataFrame([(*r, 0, False) for r in rows], "source string, raw_ts long, coarse_ts long, body string, mentions array<struct<start:int,length:int,uuid:string>>, quote_author string, quote_text string, attachment_count int, retracted boolean")
    labels = spark.createDataFrame([("a", "Participant A"), ("c", "Participant B")], "iid string, label string")
    got = {r["source"]: (r["line"], r["header"]) for r in transcript.transcript_lines(m, labels).collect()}
    quote = "member Z  said " + "y" * 200
    assert got["a"] == (f"Participant A: (replying to: {quote[: 120 - 11 + 6 + 1]}) hi Participant B, Participant B and member  Q", True)
    assert got["c"] == ("Participant B: no mention", False) and got["b"] == ("[participant]: \U0001f600 [participant]! ok", True) and got["d"] == (None, None)


def test_sensitive_terms_are_folded(spark):
    r = one(spark, text.redact(F.col("t"), sensitive=["diagnosis"], allow_subset=True), t="my \uff44iagno\u200bsis is")
    assert r["dropped"] and r["text"] == ""
    url = "https://x.example/a"
    r = one(spark, text.redact(F.col("t"), allow_subset=True), t=f"{url} and {url}")
    assert r["kept_url_list"] == [url, url]


def test_rendered_page(spark):
    base = dict(title="Participant B on\nreserves", topic_key="k", question="Who  is it?", answer="An answer.", confidence="unverified", research_status="contested", finding=None, headline=" It is so ", evidence=[("https://x.example/1", "q|" + "w" * 400, "c")],
                contradictions=["one"], open_questions=[], tags=["stablecoins", "Bad Tag", "x"], stem=None, first_raised="2026-01-01", last_verified="2026-02-02", updates=[("2026-02-02", "News of @someone", ["Finding changed."], [])], content_sha=None, managed=True)
    t = spark.createDataFrame([tuple(base.values())], TOPICS)
    r = pages.render(t.withColumn("rel", F.array(F.lit("[[A]]"))), "rel", ("A", "Hub")).first()
    title = "Research - a group member on reserves"
    want = f"""---
title: "{title}"
entity_type: research_task
topic_key: k
research_status: contested
finding: unestablished
first_raised: 2026-01-01
last_verified: 2026-02-02
tags: [research, signal-derived, stablecoin, unverified, x]
sources: ["https://x.example/1"]
related: ["[[A]]", "[[Hub]]"]
---

# {title}

> [!warning] Contested
> Sources disagree on this. See Contradictions below before citing it.

**It is so**

*Revised 2026-02-02 — see Updates below.*

## Question

Who  is it?

## Answer

An answer.

## Evidence

| Source | Quote | Confidence |
| --- | --- | --- |
| https://x.example/1 | q\\|{"w" * 294}... | c |

## Contradictions

- one

## Open questions

_None recorded._

## Updates

### 2026-02-02

News of a group member

- Finding changed.


## Provenance

{pages.PROVENANCE}

## Related Pages

- [[A]]
- [[Hub]]
"""
    assert r["page"] == want
    import hashlib

    assert r["stem"] == f"{title} ({hashlib.sha256(b'Who  is it?').hexdigest()[:6]})"
    assert one(spark, pages.question_title(F.col("t"), F.lit("2026-07")), t="What  is\nthis ?") == "Research - What is this  - 2026-07"
    assert one(spark, pages.question_title(F.col("t"), F.lit("2026-07")), t="a" * 90) == f"Research - {'a' * 77}... - 2026-07"


def test_adopt_and_repair(spark):
    known = spark.createDataFrame([("s0", "gold-price")], "stem string, topic_key string")
    got = {r["stem"]: r["topic_key"] for r in pages.adopt(spark.createDataFrame([("s0",), ("Research - Gold price",), ("Gold Price!",), ("123",)], "stem string"), known).collect()}
    assert got == {"Gold Price!": "gold-price-2", "Research - Gold price": "gold-price-3"}
    import hashlib

    page = "---\ntitle: x\nrelated: []\n---\nbody"
    sha = hashlib.sha256(page.encode()).hexdigest()
    state = spark.createDataFrame([("a", "ka", sha, True, ["x", "y"]), ("b", "kb", "other", True, ["x", "y"]), ("c", "kc", hashlib.sha256(b"bare").hexdigest(), True, ["z"])], "stem string, topic_key string, content_sha string, managed boolean, tags array<string>")
    rows = {r["stem"]: r for r in pages.repair(spark.createDataFrame([("a", page), ("b", page), ("c", "bare"), ("d", page)], "stem string, page string"), state).collect()}
    assert rows["a"]["patched"] == '---\ntitle: x\ntopic_key: ka\nrelated: ["[[b]]"]\n---\nbody' and rows["a"]["refusal"] is None
    assert [rows[x]["refusal"] for x in "bcd"] == ["hand-edited", "no-front-block", "no-state"] and all(rows[x]["patched"] is None for x in "bcd")
    assert one(spark, pages.recoverable(F.col("t")), t="2026-02-30") is False and one(spark, pages.recoverable(F.col("t")), t="2026-02-28") is True and one(spark, pages.recoverable(F.col("t"), ["open"]), t="open") is True
    assert one(spark, pages.span_days(F.lit("2026-01-30"), F.col("t")), t="2026-02-02") == 3


def test_gate_equals_greedy(spark):
    rng = random.Random(1)
    rows = [(w, i, rng.choice("abc"), True, rng.choice([0.5, 0.6, 0.7, 0.9]), rng.choice([None, "k"]), rng.choice([None, "new"])) for w in range(40) for i in range(9)]
    df = spark.createDataFrame(rows, "window_id int, seq int, question string, in_scope boolean, worth double, duplicate_of string, new_information string")
    got = {(r["window_id"], r["seq"]): r["disposition"] for r in gate.dispositions(df).collect()}
    for w in range(40):
        taken = updates = 0
        cands = [r for r in rows if r[0] == w and r[4] >= 0.6 and not (r[5] and not r[6])]
        for r in sorted(cands, key=lambda r: (-r[4], bool(r[5]), r[2], r[1])):
            up = bool(r[5])
            ok = taken < 4 and not (up and updates >= 2)
            taken, updates = taken + ok, updates + (ok and up)
            assert got[w, r[1]] == (("accepted_update" if up else "accepted") if ok else "deferred")


def test_firewall_order_and_evasion(spark):
    v = lambda t, shape=False, **k: one(spark, firewall.violation(F.col("t"), shape=shape, allow_subset=True, **k), t=t)
    assert v('{"mcp_servers": 1, "a": "b@c.de"}', True) == "request-shape" and v('{"\\u0072equests": 1}', True) == "request-shape" and v('{"a": [{"x": {"file_i\\u0064": 0}}]}', True) == "request-shape"
    assert v("no json", True) == "request-shape" and v('{"a": "say \\"requests\\": no", "b": "\\u0072equests"}', True) is None and v('{"requests2": 1}', True) is None
    with pytest.raises(RuntimeError):
        firewall.violation(F.lit("x"))
    assert v("Ａｎｎａ said", names=["Anna"]) == "roster-name" and v("b@" + "c.de") == "email" and v("Participant C", labels=["Participant A"]) == "unknown-label"
    assert v("accession 0001193125-24-206789 CIK 0000320193 assets 127000000000") is None and v("ring 44" + "7700900123") == "bare-phone"


def test_merge_never_weakens(spark):
    cols = TOPICS
    base = ("t", "k", "q", "a", "primary", "contested", "mixed", "h", [("u1", "q1", "c")], [], ["o1"], ["x", "x"], "s", "2026-01-01", "2026-01-01", [], "", True)
    topics = spark.createDataFrame([base], cols)
    rec = spark.createDataFrame([("other", "k", "q2", "", "unverified", "open", "refuted", "", [("u1", "q1", "z"), ("u2", "q", "c")], ["c1"], [], ["y", "x"])], ", ".join(cols.split(", stem string")[0:1]))
    r = archive.merge_topics(topics, rec, "2026-02-02").first()
    assert (r["title"], r["confidence"], r["research_status"], r["answer"], r["finding"], r["tags"]) == ("t", "primary", "contested", "", "refuted", ["x", "x", "y"])
    assert [e["url"] for e in r["evidence"]] == ["u1", "u2"] and r["updates"][0]["sources"] == ["u2"] and r["last_verified"] == "2026-02-02"
    assert r["updates"][0]["changes"] == ["Finding changed: mixed → refuted.", "1 new contradiction(s) recorded."]


def test_pages(spark):
    page = "---\ntitle: x\nrelated: [a]\nlast_verified: 2026-01-01\n---\nbody last_verified: 2026-01-01"
    assert one(spark, archive.bump_last_verified(F.col("t"), "2026-03-03"), t=page) == page.replace("2026-01-01\n---", "2026-03-03\n---")
    assert one(spark, archive.bump_last_verified(F.col("t"), "2026-03-03"), t="no front") is None
    got = one(spark, archive.patch_page(F.col("t"), F.lit("key"), F.array(F.lit("a"), F.lit("b"))), t=page)
    assert "title: x\ntopic_key: key" in got and "related: [a, b]" in got
    assert one(spark, archive.parse_list(F.col("t")), t='[a, "b c"]') == ["a", "b c"] and one(spark, archive.parse_list(F.col("t")), t="[a,") is None


def test_unique_names(spark):
    wanted = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0)], "name string, ord int")
    taken = spark.createDataFrame([("x",), ("x (2)",)], "name string")
    assert sorted(r["given"] for r in archive.unique_names(wanted, taken).collect()) == ["x (3)", "x (4)", "y"]


def test_scan_pragmas_and_exemptions(spark):
    word = "anony" + "mise"
    files = spark.createDataFrame([("f", f"{word}\n# scrub-ok\n\n{word}\nsay {word} # Scrub-OK: uuid, Privacy-Word-Overclaim -->\nplain\n{word} ok\n{word} ok, {word}")], "path string, text string")
    rule = "privacy-word-overclaim"
    # a bare pragma does nothing; a phrase exempts only the match that it holds
    assert [(r["line"], r["rule"]) for r in scan.scan(files, exempt=(f"{word} ok",)).orderBy("line").collect()] == [(1, rule), (4, rule), (8, rule)]
    assert scan.pragma_count(files).first()["n"] == 1
    mail = spark.createDataFrame([("g", "a.b@corp" + ".example.com\nsee corp.example\n\uff0b4915123456789\u2028x")], "path string, text string")
    assert [(r["line"], r["rule"]) for r in scan.scan(mail, exempt=("corp.example",)).orderBy("line").collect()] == [(1, "email"), (3, "e164-phone")]


def test_graph(spark):
    pts = spark.createDataFrame([(1, 0.0, 1.0), (2, 50.0, 50.0)], "id int, px double, py double")
    edges = spark.createDataFrame([("e", -5.0, 0.0, 5.0, 0.0), ("f", 0.0, 3.0, 5.0, 3.0)], "edge string, ax double, ay double, bx double, by double")
    assert [tuple(r) for r in graph.nearest_edge(pts, edges, 5.0).collect()] == [(1, "e", 1.0)]
    assert one(spark, graph.parse_color(F.col("t")), t="#f00") == 0xFF0000 and one(spark, graph.parse_color(F.col("t")), t="rgb(1, 2, 3)") == 0x010203
