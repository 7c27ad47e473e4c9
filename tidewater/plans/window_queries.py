"""Windows, listings, citations and colours over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import graph, scan, stages, store, windows
from tidewater.plans.common import Book, millis, table

_b = Book()
QUERIES, ORACLE = _b.queries, _b.oracle


@_b.query("""with m as (select *, strftime(ts, '%Y-%m-%d') as day from events), d as (select day, count(*) filter (event_type = 'signup') > count(*) filter (event_type = 'view') + 9 as blocked, count(*) filter (event_type = 'error') > count(*) filter (event_type = 'click') as refused, count(*) filter (event_type = 'purchase') as candidates from m group by 1),
o as (select day, case when blocked then 'blocked' when refused then 'refused' when candidates = 0 then 'idle' else 'done' end as outcome from d) select outcome, count(*) as n, count(distinct day) as windows from m join o using (day) group by 1""")
def window_outcomes(spark, sf_dir):
    """Days as windows, by what their events make of them."""
    m = _days(spark, sf_dir)
    return m.join(_outcomes(m), "window_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("windows"))


def _days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = millis(e, "ts")
    return e.select(F.col("event_id").cast("string").alias("source"), ts.alias("raw_ts"), F.date_format("ts", "yyyy-MM-dd").alias("window_id"), "event_type", F.lit(None).cast("string").alias("processed_window"))


def _outcomes(m):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    d = m.groupBy("window_id").agg((n("signup") > n("view") + 9).alias("blocked"), (n("error") > n("click")).alias("refused"), n("purchase").alias("candidates"))
    return d.select("window_id", windows.outcome(F.col("blocked"), F.col("refused"), F.col("candidates")).alias("outcome"))


@_b.query("""with m as (select *, strftime(ts, '%Y-%m-%d') as day from events), d as (select day from m group by 1 having not count(*) filter (event_type = 'signup') > count(*) filter (event_type = 'view') + 9 and count(*) filter (event_type = 'error') > count(*) filter (event_type = 'click'))
select event_id, case when day not in (select day from d) then day end as processed_window from m""")
def window_settlement(spark, sf_dir):
    """Which window took each event: those of refused windows stay pending."""
    m = _days(spark, sf_dir)
    return windows.settle(m, m.select(*store.KEY, "window_id"), _outcomes(m)).select(F.col("source").cast("long").alias("event_id"), "processed_window")


@_b.query("""with f as (select distinct p_brand as path, 't' as kind from part where p_size < 20 union all select distinct p_brand || '/' || p_type, 'o' from part), i as (select distinct p_brand || '/' || p_type as path from part where p_size > 40)
select distinct path from f where kind = 't' or path not in (select path from i)""")
def publishable_files(spark, sf_dir):
    """Brands as tracked files, brands and types as others, large parts as what is ignored."""
    p = table(spark, sf_dir, "part").withColumn("both", F.concat_ws("/", "p_brand", "p_type"))
    return scan.publishable(p.where("p_size < 20").select(F.col("p_brand").alias("path")), p.select(F.col("both").alias("path")), p.where("p_size > 40").select(F.col("both").alias("path")))


@_b.query("select distinct o_custkey as task_id, trim(u) as url from (select o_custkey, unnest([' ' || o_orderpriority, o_orderstatus, '']) as u from orders) where trim(u) <> ''")
def citation_urls(spark, sf_dir):
    """What the orders of a customer name, as sources of a task."""
    source = lambda c: F.struct(c.alias("url"))
    o = table(spark, sf_dir, "orders")
    return stages.citation_urls(o.select(F.col("o_custkey").alias("task_id"), F.array(source(F.concat(F.lit(" "), "o_orderpriority")), source(F.col("o_orderstatus")), source(F.lit(""))).alias("sources")))


@_b.query("""select string_agg('path:"' || n_name || '"', ' OR ' order by n_nationkey, n_name) as query from nation where n_regionkey not in (1, 2)""")
def isolation_query(spark, sf_dir):
    """Nations as nodes; those of two regions are tags or unresolved."""
    kind = F.when(F.col("n_regionkey") == 1, "tag").when(F.col("n_regionkey") == 2, "unresolved")
    return graph.isolation_query(table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), kind.alias("type"), F.col("n_nationkey").alias("ord")))


_SHADE = "cast(floor(round((case when t < 1.0/6 then p + (q - p) * 6 * t when t < 0.5 then q when t < 2.0/3 then p + (q - p) * (2.0/3 - t) * 6 else p end) * 255, 9) + 0.5) as integer)"


@_b.query(f"""with c as (select p_partkey, p_partkey * 7919 % 16777216 as c from part), x as (select *, c // 65536 / 255.0::double as r, c // 256 % 256 / 255.0::double as g, c % 256 / 255.0::double as b from c), m as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from x),
h as (select *, (hi + lo) / 2 as l0, case when hi = lo then 0 when hi = r then (g - b) / (hi - lo) + case when g < b then 6 else 0 end when hi = g then (b - r) / (hi - lo) + 2 else (r - g) / (hi - lo) + 4 end / 6 as h,
case when hi = lo then 0 when (hi + lo) / 2 > 0.5 then (hi - lo) / (2 - hi - lo) else (hi - lo) / (hi + lo) end * 0.4 as s from m), w as (select *, l0 + (1 - l0) * 0.55 as l from h), z as (select *, case when l < 0.5 then l * (1 + s) else l + s - l * s end as q from w), y as (select *, 2 * l - q as p from z),
k as (select p_partkey, i, p, q, (h + [1.0/3, 0, -1.0/3][i] + 1) % 1 as t from y, (values (1), (2), (3)) v(i)) select p_partkey, cast(sum({_SHADE} * [65536, 256, 1][i]) as integer) as weak from k group by 1""")
def weak_colours(spark, sf_dir):
    """The pale variant of a colour for each part."""
    return table(spark, sf_dir, "part").select("p_partkey", graph.weak_variant((F.col("p_partkey") * 7919 % 16777216).cast("int")).alias("weak"))
