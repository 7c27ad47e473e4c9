"""Windows, settings, files of an archive, colours and counts."""

import colorsys
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import firewall, gate, graph, reports, scan, stages, windows
from tidewater.schemas import TOPICS
from tidewater.sources import settings, sinks
from tidewater.streaming import stream

STORE = "source string, raw_ts long, kind string, body string, retracted boolean, superseded_by long, processed_window string"


def _store(spark, n=4):
    return spark.createDataFrame([(f"s{i}", i, "message", f"m{i}", False, None, None) for i in range(n)], STORE)


def _steps(spark, payload="{}", rows=()):
    tasks = "task_id string, window_id string, in_scope boolean, duplicate_of string, new_information string, worth double, question string, seq int, refused boolean"
    answers = spark.createDataFrame(list(rows), tasks)
    evidence = F.array(F.struct(F.lit("https://x.example/1").alias("url"), F.lit("q").alias("quote"), F.lit("c").alias("confidence")), F.struct(F.lit("https://made.up/").alias("url"), F.lit("q").alias("quote"), F.lit("c").alias("confidence")))
    record = dict(topic_key=F.col("question"), question=F.col("question"), answer=F.lit("a"), research_status=F.lit("open"), finding=F.lit("mixed"), title=F.col("question"), confidence=F.lit("primary"), headline=F.lit("h"),
                  evidence=evidence, contradictions=F.array().cast("array<string>"), open_questions=F.array().cast("array<string>"), tags=F.array(F.lit("t")))
    return windows.Steps(
        request=lambda m: m.groupBy("window_id").agg(F.lit(payload).alias("payload")),
        triage=lambda passed: answers.join(passed.select("window_id"), "window_id"),
        research=lambda t: t.select("task_id", *(v.alias(k) for k, v in record.items())),
        retrieved=lambda t: t.where("question <> 'bare'").select("task_id", F.lit("https://x.example/1").alias("url")),
    )


@pytest.mark.parametrize(
    "payload, rows, outcome, taken, topics",
    [
        ('{"a": 1}', [("t1", "w1", True, "", "", 0.9, "good", 1, False), ("t2", "w1", True, "", "", 0.9, "bare", 2, False), ("t3", "w1", True, "", "", 0.1, "low", 3, False)], "done", 3, ["good"]),
        ('{"a": "x@y.example"}', [("t1", "w1", True, "", "", 0.9, "good", 1, False)], "blocked", 3, []),
        ('{"a": 1}', [(None, "w1", None, None, None, None, None, None, True)], "refused", 0, []),
        ('{"a": 1}', [], "idle", 3, []),
    ],
)
def test_window(spark, payload, rows, outcome, taken, topics):
    run = windows.run_window(_store(spark), spark.createDataFrame([], TOPICS), "w1", _steps(spark, payload, rows), "2026-01-02", most=3, allow_subset=True)
    assert [tuple(r) for r in run.outcomes.collect()] == [("w1", outcome)]
    assert run.store.count() == 4 and run.store.where("processed_window = 'w1'").count() == taken
    assert [r["topic_key"] for r in run.topics.orderBy("topic_key").collect()] == topics
    assert run.quarantine.count() == (outcome == "blocked")
    if topics:
        assert [e["url"] for e in run.topics.first()["evidence"]] == ["https://x.example/1"]


def test_window_without_messages(spark):
    run = windows.run_window(_store(spark, 0), spark.createDataFrame([], TOPICS), "w1", _steps(spark), "2026-01-02", allow_subset=True)
    assert not run.outcomes.collect() and not run.store.collect() and not run.topics.collect()


def test_settle_keeps_what_was_taken(spark):
    messages = _store(spark, 3).withColumn("processed_window", F.when(F.col("raw_ts") == 0, "w0"))
    taken = spark.createDataFrame([("s0", 0, "w2"), ("s1", 1, "w2"), ("s1", 1, "w1"), ("s2", 2, "w3")], "source string, raw_ts long, window_id string")
    outcomes = spark.createDataFrame([("w1", "idle"), ("w2", "blocked"), ("w3", "refused")], "window_id string, outcome string")
    got = windows.settle(messages, taken, outcomes).orderBy("raw_ts").collect()
    assert [r["processed_window"] for r in got] == ["w0", "w1", None]


def test_refused_micro_batch_comes_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _store(spark).write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen, refuse = [], True

    def each(rows, window):
        seen.append((window, rows.count()))
        if refuse:
            raise ValueError("refused")

    read = lambda: spark.readStream.schema(STORE).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):
        stream.windows(read(), str(tmp_path / "mark"), each)
    refuse = False
    stream.windows(read(), str(tmp_path / "mark"), each)
    stream.windows(read(), str(tmp_path / "mark"), each)
    assert seen == [("w0", 4), ("w0", 4)]


def test_folder(spark, tmp_path):
    folder = sinks.Folder(spark, str(tmp_path), "Notes", ("Notes", "Log"))
    assert [folder.write("a", "é\n"), folder.write("a", "é\n"), folder.write("a", "other"), folder.read("a"), folder.write("a", "b", overwrite=True)] == ["created", "unchanged", "collided", "é\n", "replaced"]
    assert folder.append("log", "x", "# log\n") == "created" and folder.append("log", "y", "# log\n") == "replaced" and folder.read("log") == "# log\nxy"
    assert folder.write_changed("d", "1") and not folder.write_changed("d", "1") and folder.write_changed("d", "2")
    assert sorted(os.listdir(tmp_path / "Notes")) == ["a.md", "d.md", "log.md"]
    (tmp_path / "out").mkdir()
    os.symlink(tmp_path / "out", tmp_path / "Notes" / "link")
    for bad in ("../x", "/etc/x", "..", "", "link/x", "a/../../x"):
        with pytest.raises(sinks.Refused):
            folder.write(bad, "x")
    assert folder.read("none") is None and not os.listdir(tmp_path / "out")


def test_folder_is_owned(spark, tmp_path):
    for root, name, foreign in ((tmp_path, "Other", None), (tmp_path / "no", "Notes", None), (tmp_path, "Notes", tmp_path), (tmp_path, "Notes", tmp_path.parent), (tmp_path, "..", None)):
        with pytest.raises(sinks.Refused):
            sinks.Folder(spark, str(root), name, ("Notes", ".."), str(foreign) if foreign else None)


def test_settings():
    s = settings.Settings.from_env({"TIDEWATER_GROUP_ID": "g" * 16, "TIDEWATER_PORT": "9", "TIDEWATER_HUBS": " a, ,b", "TIDEWATER_AUTO_HANDLES": "no", "TIDEWATER_NOTIFY": "Yes", "TIDEWATER_ARCHIVE_DIR": " "})
    assert (s.port, s.hubs, s.auto_handles, s.notify, s.archive_dir, s.worth_threshold, s.under_var("m.jsonl")) == (9, ("a", "b"), False, True, None, 0.6, "var/m.jsonl")
    for env in ({}, {"TIDEWATER_GROUP_ID": "short"}, {"TIDEWATER_GROUP_ID": "g" * 16, "TIDEWATER_PORT": "x"}):
        with pytest.raises(settings.SettingsError):
            settings.Settings.from_env(env)


def test_key(tmp_path):
    path = tmp_path / "k" / "key"
    env = {"TIDEWATER_KEY_FILE": str(path)}
    with pytest.raises(settings.SettingsError):
        settings.load_key(env, create=False)
    key = settings.load_key(env)
    assert len(key) == 32 and settings.load_key(env, create=False) == key and path.stat().st_mode & 0o777 == 0o600
    assert settings.load_key(env | {"TIDEWATER_KEY": "ab" * 32}) == b"\xab" * 32
    for bad in ({}, {"TIDEWATER_KEY": "ab" * 31}, {"TIDEWATER_KEY": "zz" * 32}):
        with pytest.raises(settings.SettingsError):
            settings.load_key(bad)


def test_tokens(tmp_path):
    f = tmp_path / "tokens"
    f.write_text("# c\n\n Ａlpha\n- Alpha Ltd\nC:\\x\n-\n")
    assert settings.load_tokens(str(f), {}) == (["Alpha", "C:/x", "-"], ["Alpha Ltd"])
    assert settings.load_tokens(str(f), {"TIDEWATER_TOKENS": "b"}) == (["b"], [])
    for env in ({}, {"TIDEWATER_TOKENS": "# a\n- only"}):
        with pytest.raises(settings.SettingsError):
            settings.load_tokens(None, env)


def test_colours(spark):
    rnd = random.Random(5)
    colours = [0, 0xFFFFFF, 0x808080, 0xFF0000, 0x00FF00, 0x0000FF] + [rnd.randrange(1 << 24) for _ in range(200)]
    c = F.col("c")
    got = spark.createDataFrame([(x,) for x in colours], "c int").select("c", graph.from_hsl(*graph.hsl(c)).alias("same"), graph.lighten(c, 0.3).alias("light"), graph.weak_variant(c).alias("weak")).collect()

    def plain(x, sat, by):
        h, l, s = colorsys.rgb_to_hls(*((x >> k & 255) / 255 for k in (16, 8, 0)))
        return [v * 255 for v in colorsys.hls_to_rgb(h, l + (1 - l) * by, s * sat)]

    near = lambda a, want: all(abs((a >> k & 255) - w) <= 0.5 + 1e-6 for k, w in zip((16, 8, 0), want))
    for r in got:
        assert r["same"] == r["c"] and near(r["light"], plain(r["c"], 1, 0.3)) and near(r["weak"], plain(r["c"], 0.4, 0.55))
    said = spark.createDataFrame([(x,) for x in ("rgb(12.6 300 1)", "#abc", "rgba(1, 2, 3, .5)", "red")], "c string").select(graph.parse_color(c).alias("x")).collect()
    assert [r["x"] for r in said] == [0x0DFF01, 0xAABBCC, 0x010203, None]


def test_isolation_query(spark):
    nodes = spark.createDataFrame([("b.md", None, 1), ("a.md", "", 2), ("#t", "tag", 0), ("u", "unresolved", 3)], "id string, type string, ord int")
    of = lambda df, **k: graph.isolation_query(df, **k).first()["query"]
    assert of(nodes) == 'path:"b.md" OR path:"a.md"' and of(nodes, most=26) and of(nodes, most=25) is None
    assert of(nodes.where("false")) is None and of(spark.range(5000).selectExpr("cast(id as string) as id", "cast(null as string) as type", "id as ord")) is None


def test_listing(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = lambda df: sorted(r["path"] for r in df.collect())
    files = scan.publishable(paths("a", "b"), paths("b", "c", "d"), paths("a", "d"))
    assert got(files) == ["a", "b", "c"]
    assert got(scan.targets(files)) == ["a", "b", "c"] and got(scan.targets(files, "staged", paths("b"))) == ["b"] and got(scan.targets(files, explicit=["z", "z"])) == ["z"]
    with pytest.raises(ValueError):
        scan.targets(files, "staged")


def test_counts(spark):
    tasks = spark.createDataFrame([("w", d) for d in ("accepted", "accepted_update", "low_worth", "deferred", "duplicate", "out_of_scope", "accepted")], "window_id string, disposition string")
    assert tuple(gate.counts(tasks, "window_id").first()) == ("w", 3, 1, 1, 1, 1, 1) and tuple(gate.counts(tasks.where("false")).first()) == (0,) * 6
    roster = spark.createDataFrame([(["a", "b"], None, [], ["x"], "")], "names array<string>, handles array<string>, phones array<string>, opted_out array<string>, group_name string")
    assert tuple(reports.roster_coverage(roster).first()) == (2, 0, 0, 1, 0)
    got = spark.createDataFrame([(x,) for x in (0.125, 0.135, 0.256, 1.0, None)], "x double").select(reports.percent(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == [f"{0.125:.0%}", f"{0.135:.0%}", "26%", "100%", None]
    results = spark.createDataFrame([("t", [(" u ",), ("u",), ("",), (None,)]), ("v", None)], "task_id string, sources array<struct<url:string>>")
    assert [tuple(r) for r in stages.citation_urls(results).collect()] == [("t", "u")]
    said = spark.createDataFrame([('{"b": "é", "a": {"d": 1.0, "c": null}}',), ("{",), (None,)], "p string").select(firewall.canonical(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in said] == ['{"a": {"c": null, "d": 1.0}, "b": "é"}', None, None]
