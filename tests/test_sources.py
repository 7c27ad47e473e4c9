"""Readers, sinks, reports and stages on files and fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import reports, stages
from tidewater.sources import readers, sinks


def test_jsonl_export(spark, tmp_path):
    lines = [
        {"chat": {"id": 1, "recipientId": 10}}, {"recipient": {"id": 10, "group": {"masterKey": "G"}}}, {"recipient": {"id": 11, "contact": {"aci": "ABC"}}}, {"recipient": {"id": 12, "self": {}}},
        {"chatItem": {"chatId": 1, "authorId": 11, "dateSent": 5, "standardMessage": {"text": {"body": "hi"}}}}, {"chatItem": {"chatId": 1, "authorId": 12, "dateSent": 6, "standardMessage": {"text": {"body": "me"}}}},
        {"chatItem": {"chatId": 2, "authorId": 11, "dateSent": 7, "standardMessage": {"text": {"body": "no"}}}},
    ]
    (tmp_path / "main.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n[1]\n{"trunc')
    kind, tables = readers.read_export(spark, str(tmp_path))
    got = readers.join_jsonl(readers.split_jsonl(tables["lines"]), "G").orderBy("raw_ts").collect()
    assert kind == "jsonl" and [tuple(r) for r in got] == [("abc", 5, "hi"), ("self", 6, "me")]
    with pytest.raises(FileNotFoundError):
        readers.read_export(spark, str(tmp_path / "none"))


def test_csv_export(spark, tmp_path):
    for n, t in {"message": 'thread_id,body\n1,"a\nb ""c"""\n', "groups": "group_id\nx\n", "thread": "_id\n1\n", "recipient": "_id,aci\n1,2\n"}.items():
        (tmp_path / f"{n}.csv").write_text(t)
    kind, tables = readers.read_export(spark, str(tmp_path))
    assert kind == "csv" and tables["message"].first()["body"] == 'a\nb "c"'


def test_pages_and_topics(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "a").mkdir(parents=True)
    (vault / ".hidden").mkdir()
    (vault / "a" / "x.md").write_text("---\ntitle: one\ntitle: two\n---\n")
    (vault / ".hidden" / "y.md").write_text("no")
    got = readers.front_keys(readers.read_pages(spark, str(vault))).collect()
    assert [(r["path"], r["stem"], r["title"]) for r in got] == [("a/x.md", "x", "two")]
    state = tmp_path / "state"
    state.mkdir()
    (state / "k.json").write_text('{"topic_key": "k", "tags": ["a"]}')
    (state / "bad.json").write_text("{")
    assert [r["topic_key"] for r in readers.read_topics(spark, str(state)).collect()] == ["k"]


def test_roster_template_is_refused(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"names": ["REPLACE_ME"], "handles": [], "phones": [], "opted_out": [], "group_name": "g"}')
    with pytest.raises(Exception, match="template"):
        readers.read_roster(spark, str(tmp_path / "r.json")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "a"), (None, "b"), ("x", "y")], "old string, new string")
    assert [r[0] for r in df.select(sinks.page_outcome(F.col("old"), F.col("new"))).collect()] == ["unchanged", "created", "collided"]
    sinks.record_run(spark.range(1), str(tmp_path / "m"), "2026-01-01T00:00:00")
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    assert spark.range(1).select(sinks.safe_log(F.create_map(*(F.lit(x) for kv in {"body": "x", "n": "1", "message_text": "x", "Transcript": "x"}.items() for x in kv))).alias("m")).first()["m"] == {"body": "<redacted>", "n": "1", "message_text": "<redacted>", "Transcript": "<redacted>"}


def test_reports(spark):
    r = spark.createDataFrame([("refuted", i, f"t{i}") for i in range(8)] + [("supported", 0, "s")], "finding string, seq int, title string")
    got = reports.summary(r).collect()
    assert got[0]["lines"].splitlines()[-1] == "and 2 more" and got[1]["lines"] == "• s"
    log = spark.createDataFrame([("2026-01-02", 1, "b"), ("2026-01-01", 1, "a")], "date string, ord int, line string")
    assert reports.changelog(log).first()["text"] == "## 2026-01-01\na\n\n## 2026-01-02\nb"
    runs = spark.createDataFrame([("1", 0, 0), ("2", 3, 1), ("3", 1, 1)], "ts string, cheap_attempted int, cheap_resolved int")
    assert reports.last_runs(runs, 2).first()["rate"] == 0.5 and reports.last_runs(runs.limit(1), 1).first()["rate"] is None
    pages = spark.createDataFrame([(f"d/p{i}", None) for i in range(5)], "path string, title string")
    assert {r["folder"]: r["lines"] for r in reports.digest(pages, 3).collect()} == {"d": "- d/p0\n- d/p1\n- d/p2", None: "2 more"}


def test_stages(spark):
    req = spark.createDataFrame([(1, '{"a": "plain"}'), (2, '{"a": "mail b@' + 'c.de"}'), (3, "{}"), (4, "{}"), (5, "no JSON")], "task_id int, payload string")
    res = spark.createDataFrame([(1, '{"resolved": true, "answer": "a"}', False), (3, None, True)], "task_id int, body string, refused boolean")
    got = {r["task_id"]: r for r in stages.exchange(req, res, "cheap", allow_subset=True).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "blocked_out", 3: "refused", 4: "missing", 5: "blocked_out"} and got[1]["response"]["resolved"]
    blocks = [(1, '{"type":"web_search_tool_result","content":[{"url":"u1"}]}'), (1, '{"type":"web_search_tool_result","content":{"error":1}}'), (1, '{"type":"web_fetch_tool_result","content":{"type":"web_fetch_result","url":"u2"}}'), (1, '{"type":"text","url":"u3"}')]
    assert sorted(r["url"] for r in stages.retrieved_urls(spark.createDataFrame(blocks, "task_id int, block string")).collect()) == ["u1", "u2"]
