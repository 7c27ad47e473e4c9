"""Ingest, store, transcript and gate over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import gate, ingest, store, transcript
from tidewater.plans.common import Book, millis, table

_b = Book()
QUERIES, ORACLE = _b.queries, _b.oracle

_MS = "cast(epoch_us(ts) // 1000 as bigint)"


def _messages(spark, sf_dir):
    """events as messages."""
    e = table(spark, sf_dir, "events")
    ts = millis(e, "ts")
    return e.select(
        F.col("user_id").cast("string").alias("source"), ts.alias("raw_ts"), ingest.floor_bucket(ts).alias("coarse_ts"), F.lit("message").alias("kind"), F.col("props").alias("body"), F.col("event_type"), "event_id",
        F.lit(None).cast("string").alias("quote_author"), F.lit(None).cast("string").alias("quote_text"), F.lit(0).alias("attachment_count"),
    )


@_b.query(f"""with m as (select user_id, event_id, {_MS} as ts from events) select cast(user_id as varchar) as source, ts as raw_ts, ts // 900000 * 900000 as coarse_ts,
coalesce(lag(ts // 900000) over (order by ts, cast(user_id as varchar), event_id) <> ts // 900000, true) as header from m""")
def bucket_headers(spark, sf_dir):
    """Lines that open a time bucket."""
    m = store.bucket_headers(_messages(spark, sf_dir), order=("raw_ts", "source", "event_id"))
    return m.select("source", "raw_ts", "coarse_ts", "header")


@_b.query(f"""with m as (select cast(user_id as varchar) as source, {_MS} as raw_ts, props as body, event_id as arrival from events union all select cast(user_id as varchar), {_MS}, 'again', event_id + 1000000000 from events)
select source, raw_ts, arrival, body from (select *, row_number() over (partition by source, raw_ts order by arrival) as r from m) where r = 1""")
def dedupe_first(spark, sf_dir):
    """First arrivals of doubled messages."""
    m = _messages(spark, sf_dir).select("source", "raw_ts", F.col("event_id").alias("arrival"), "body")
    return store.first_arrivals(m.unionByName(m.select("source", "raw_ts", (F.col("arrival") + 1000000000).alias("arrival"), F.lit("again").alias("body"))))


_MUT = f"""m as (select cast(user_id as varchar) as source, {_MS} as raw_ts, event_id, event_type, props from events),
x as (select source, lag(raw_ts) over (partition by source order by raw_ts, event_id) as target, event_type, raw_ts as by_ts, event_id as arrival from m),
p as (select source, target, bool_or(event_type = 'error') as gone, arg_max(by_ts, arrival) filter (event_type = 'signup') as by_ts from x where event_type in ('error', 'signup') and target is not null group by all)"""


def _mutated(spark, sf_dir):
    from pyspark.sql import Window

    m = _messages(spark, sf_dir)
    target = F.lag("raw_ts").over(Window.partitionBy("source").orderBy("raw_ts", "event_id"))
    x = m.select("source", target.alias("target_ts"), F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "edit").alias("kind"), F.col("raw_ts").alias("by_ts"), F.col("event_id").alias("arrival"))
    return store.apply_mutations(m, x.where("kind is not null and target_ts is not null"))


@_b.query(f"""with {_MUT} select m.source, m.raw_ts, event_id, coalesce(gone, false) as retracted, case when gone then '' else props end as body, p.by_ts as superseded_by from m left join p on m.source = p.source and m.raw_ts = p.target""")
def mutation_apply(spark, sf_dir):
    """Deletes and edits applied to their targets."""
    return _mutated(spark, sf_dir).select("source", "raw_ts", "event_id", "retracted", "body", "superseded_by")


@_b.query(f"""with {_MUT}, s as (select m.source, m.raw_ts, event_id, coalesce(gone, false) as retracted, p.by_ts from m left join p on m.source = p.source and m.raw_ts = p.target)
select source, raw_ts from s where not retracted and by_ts is null and event_id % 7 <> 0 order by raw_ts, source limit 500""")
def pending_window(spark, sf_dir):
    """The oldest live messages that no window has taken."""
    s = _mutated(spark, sf_dir).withColumn("processed_window", F.when(F.col("event_id") % 7 == 0, "w1"))
    return store.pending(s, 500).select("source", "raw_ts")


@_b.query(f"""with {_MUT}, s as (select event_id, coalesce(gone, false) as retracted, p.by_ts from m left join p on m.source = p.source and m.raw_ts = p.target)
select count(*) as total, count(*) filter (event_id % 7 <> 0) as pending, count(*) filter (retracted) as retracted, count(*) filter (by_ts is not null) as superseded from s""")
def store_counts(spark, sf_dir):
    s = _mutated(spark, sf_dir).withColumn("processed_window", F.when(F.col("event_id") % 7 == 0, "w1"))
    return store.store_counts(s)


@_b.query("""select event_type as key, arg_max(event_id, event_id) as value from events group by 1""")
def latest_state(spark, sf_dir):
    """The last value of each key."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("arrival"))
    return store.latest_by_key(e)


@_b.query("""select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name = 'EUROPE')))""")
def semi_join_chain(spark, sf_dir):
    """Orders of one region by chained semi-joins."""
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@_b.query("""select disposition, cast(count(*) as bigint) as n from (select case when n_nationkey is null then 'other_group' when o_orderstatus = 'F' then 'deleted' when o_totalprice < 1000 then 'empty' when epoch_ms(o_orderdate) < 800000000000 then 'too_old' else 'kept' end as disposition
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey and n_regionkey < 3) group by 1""")
def dim_lookup_disposition(spark, sf_dir):
    """Import dispositions of orders, dealt as export rows."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").select("c_custkey", "c_nationkey")
    m = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_nationkey").alias("thread_id"), F.col("o_custkey").alias("sender_id"), millis(t("orders"), "o_orderdate").alias("raw_ts"), F.when(F.col("o_totalprice") < 1000, "").otherwise("x").alias("body"),
        F.lit("20").alias("type"), (F.col("o_orderstatus") == "F").cast("string").alias("deleted"))
    threads = t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("thread_id"))
    people = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("aci"))
    return ingest.import_dispositions(m, threads, people, 800000000000).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@_b.query("select o_orderkey from orders where (o_orderkey & 31) between 21 and 27")
def bitmask_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(ingest.is_outgoing(F.col("o_orderkey").cast("string"))).select("o_orderkey")


_FRAME = '{"method":"receive","params":{"envelope":{"sourceUuid":"%s","timestamp":%d,%s}}}'
_FRAMES = [
    (_FRAME % ("u1", 1784000000000, '"dataMessage":{"groupInfo":{"groupId":"G"},"message":"hi","timestamp":1784000000000}'), "message", "u1"),
    (_FRAME % ("u1", 5, '"dataMessage":{"groupInfo":{"groupId":"H"},"message":"hi"}'), "other_group", "u1"),
    (_FRAME % ("u1", 5, '"dataMessage":{"groupInfo":{"groupId":"G"},"message":"hi","expiresInSeconds":60}'), "expiring", "u1"),
    (_FRAME % ("u1", 5, '"dataMessage":{"groupInfo":{"groupId":"G"},"message":"hi","expiresInSeconds":0}'), "message", "u1"),
    (_FRAME % ("u1", 5, '"dataMessage":{"groupInfo":{"groupId":"G"},"remoteDelete":{"timestamp":4}}'), "delete", "u1"),
    (_FRAME % ("u1", 5, '"syncMessage":{"sentMessage":{"groupInfo":{"groupId":"G"},"message":"me","timestamp":5}}'), "message", "self"),
    (_FRAME % ("u2", 5, '"dataMessage":{"groupInfo":{"groupId":"G"},"message":"x [BOT] y"}'), "bot", "u2"), ("{broken", "corrupt", None), ('{"method":"other"}', "no_envelope", None),
]


@_b.query("select * from (values " + ", ".join(f"({i}, '{d}', {'null' if s is None else repr(s)})" for i, (_, d, s) in enumerate(_FRAMES)) + ") v(i, disposition, source)")
def frame_dispositions(spark, sf_dir):
    """What becomes of fixed raw frames."""
    df = spark.createDataFrame([(i, f) for i, (f, _, _) in enumerate(_FRAMES)], "i int, value string")
    one = [ingest.parse_frames(df.where(F.col("i") == i), "G", marker="[bot]").select(F.lit(i).alias("i"), "disposition", "source") for i in range(len(_FRAMES))]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


@_b.query(rf"""select cast(user_id as varchar) as source, {_MS} as raw_ts, 'Participant ' || user_id || ': ' || regexp_replace(translate(trim(props), '<>', '()'), '[\r\n]+', '  ', 'g') as line
from events where props is not null and regexp_matches(props, '[\pL\pN]')""")
def transcript_included(spark, sf_dir):
    """Transcript lines that are included."""
    m = _messages(spark, sf_dir).withColumn("retracted", F.lit(False))
    labels = m.select(F.col("source").alias("iid")).distinct().withColumn("label", F.concat(F.lit("Participant "), "iid"))
    return transcript.transcript_lines(m, labels).where("disposition = 'included'").select("source", "raw_ts", "line")


@_b.query(r"""with c as (select conv_id, turn, case turn % 2 when 0 then 'Participant A' else 'Participant B' end as me, case turn % 2 when 0 then 'Participant B' else 'Participant A' end as other,
regexp_replace(translate(trim(text), '<>', '()'), '[\r\n]+', '  ', 'g') as t from conversations where text is not null)
select conv_id, turn, me || ': (replying to: Participant A and member QQ) ' || other || ' says ' || t as line from c""")
def transcript_mentions(spark, sf_dir):
    """Lines with a mention, and a quote that forges a label."""
    c = table(spark, sf_dir, "conversations")
    who = lambda k: F.when(F.col("turn") % 2 == k, "a").otherwise("b")
    mention = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("length"), who(1).alias("uuid")))
    m = c.select(
        "conv_id", "turn", who(0).alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("raw_ts"), F.lit(0).cast("long").alias("coarse_ts"), F.concat(F.lit("@x says "), F.trim("text")).alias("body"), mention.alias("mentions"),
        F.lit(None).cast("string").alias("quote_author"), F.lit("Participant A and Participant QQ").alias("quote_text"), F.lit(0).alias("attachment_count"), F.lit(False).alias("retracted"),
    )
    labels = spark.createDataFrame([("a", "Participant A"), ("b", "Participant B")], "iid string, label string")
    lines = transcript.transcript_lines(m, labels).where("disposition = 'included'")
    return lines.select(F.floor(F.col("raw_ts") / 1000).alias("conv_id"), (F.col("raw_ts") % 1000).alias("turn"), "line")


@_b.query(f"""select cast(user_id as varchar) as source, {_MS} as raw_ts, props as body, event_id as arrival from events e where event_id % 3 = 0 and not exists (select 1 from events s where s.event_id % 2 = 0 and s.user_id = e.user_id and s.ts = e.ts)""")
def insert_or_ignore(spark, sf_dir):
    """Every third message put into a store that has every second."""
    m = _messages(spark, sf_dir).select("source", "raw_ts", F.col("event_id").alias("arrival"), "body")
    return store.insert_or_ignore(m.where("arrival % 2 = 0"), m.where("arrival % 3 = 0"))


@_b.query(f"""select cast(user_id as varchar) as source, {_MS} as raw_ts, case when event_id % 5 = 0 then 'w0' when event_type = 'purchase' then 'w1' end as processed_window from events""")
def mark_processed(spark, sf_dir):
    """A window's messages marked; those of an earlier window stay as they are."""
    m = _messages(spark, sf_dir).withColumn("processed_window", F.when(F.col("event_id") % 5 == 0, "w0"))
    return store.mark_processed(m, m.where("event_type = 'purchase'"), "w1").select("source", "raw_ts", "processed_window")


_TASKS = """select o_orderkey % 50 as window_id, o_orderkey as seq, o_orderpriority as question, o_orderstatus <> 'P' as in_scope, round(least(1.0, o_totalprice / 200000.0), 6) as worth,
case when o_orderkey % 5 = 0 then 'k' end as duplicate_of, case when o_orderkey % 10 = 0 then 'new' end as new_information from orders"""


_GATE = f"""with t as ({_TASKS}), c as (select *, duplicate_of is not null as known, duplicate_of is not null and new_information is not null as is_update from t),
d as (select *, case when not in_scope then 'out_of_scope' when known and not is_update then 'duplicate' when worth < 0.6 then 'low_worth' else 'candidate' end as disp from c),
e as (select *, disp = 'candidate' and (not is_update or row_number() over (partition by window_id, disp, is_update order by worth desc, question, seq) <= 2) as may from d),
f as (select *, may and row_number() over (partition by window_id, may order by worth desc, is_update, question, seq) <= 4 as taken from e),
g as (select seq, window_id, case when disp <> 'candidate' then disp when taken and is_update then 'accepted_update' when taken then 'accepted' else 'deferred' end as disposition from f)"""


def _gated(spark, sf_dir):
    """Orders as tasks, through the gate."""
    o = table(spark, sf_dir, "orders")
    t = o.select(
        (F.col("o_orderkey") % 50).alias("window_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("question"), (F.col("o_orderstatus") != "P").alias("in_scope"),
        F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 200000.0), 6).alias("worth"), F.when(F.col("o_orderkey") % 5 == 0, "k").alias("duplicate_of"), F.when(F.col("o_orderkey") % 10 == 0, "new").alias("new_information"),
    )
    return gate.dispositions(t)


@_b.query(f"{_GATE} select seq, disposition from g")
def gate_topk(spark, sf_dir):
    """The gate's choice among orders as tasks."""
    return _gated(spark, sf_dir).select("seq", "disposition")


@_b.query(f"""{_GATE} select window_id, count(*) filter (disposition in ('accepted', 'accepted_update')) as accepted, count(*) filter (disposition = 'accepted_update') as accepted_updates,
count(*) filter (disposition = 'out_of_scope') as rejected_out_of_scope, count(*) filter (disposition = 'low_worth') as rejected_low_worth, count(*) filter (disposition = 'duplicate') as rejected_duplicate, count(*) filter (disposition = 'deferred') as deferred_over_cap from g group by 1""")
def gate_counts(spark, sf_dir):
    """How many tasks of each window went where."""
    return gate.counts(_gated(spark, sf_dir), "window_id")


@_b.query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'cheap pass failed or returned nothing' when o_orderpriority like '1%' then 'triage marked difficulty high' when o_orderkey % 3 = 0 then 'cheap pass did not resolve'
when o_orderstatus = 'F' then 'cheap answer only reached unverified' when o_orderkey % 4 < 2 and o_orderstatus <> 'O' then 'fewer than two sources and not primary' end as why from orders""")
def escalation_reason(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    conf = F.when(F.col("o_orderstatus") == "F", "unverified").when(F.col("o_orderstatus") == "O", "primary").otherwise("corroborated")
    why = gate.escalation(F.when(F.col("o_orderpriority").startswith("1"), "high"), k % 11 != 0, k % 3 != 0, F.lit(""), conf, (k % 4).cast("int"))
    return o.select("o_orderkey", why.alias("why"))


@_b.query("""select source, cast(count(*) filter (l.doc_id is not null) as bigint) as kept, cast(count(*) filter (l.doc_id is null) as bigint) as n_dropped from documents d left join labels l on d.doc_id = l.doc_id group by source""")
def grounding_anti(spark, sf_dir):
    """Evidence (documents, by source) that was retrieved (has a label)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("task_id"))
    e = F.struct(F.col("doc_id").cast("string").alias("url"), F.lit("").alias("quote"), F.lit("").alias("confidence"))
    records = d.groupBy("task_id").agg(F.collect_list(e).alias("evidence"))
    retrieved = table(spark, sf_dir, "labels").join(d, "doc_id").select("task_id", F.col("doc_id").cast("string").alias("url"))
    return gate.grounded(records, retrieved).select(F.col("task_id").alias("source"), F.size("evidence").cast("long").alias("kept"), F.col("n_dropped").cast("long").alias("n_dropped"))


@_b.query("""with d as (select cast(cast(ts as date) as varchar) as day, count(*) as attempted, count(*) filter (event_type = 'purchase') as resolved from events group by 1 order by 1 desc limit 10)
select cast(count(*) as bigint) as runs, cast(sum(attempted) as bigint) as attempted, cast(sum(resolved) as bigint) as resolved, round(sum(resolved) / sum(attempted), 3) as rate from d""")
def last_n_runs(spark, sf_dir):
    """Sums and the resolve rate of the last ten runs (days)."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("event_type") == "purchase").alias("resolved"))
    last = e.orderBy(F.desc("day")).limit(10)
    return last.agg(F.count(F.lit(1)).alias("runs"), F.sum("attempted").alias("attempted"), F.sum("resolved").alias("resolved")).withColumn("rate", F.round(F.try_divide("resolved", "attempted"), 3))
