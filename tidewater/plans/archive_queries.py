"""Archive, reports and graph over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators import archive, graph, pages, reports
from tidewater.plans.common import Book, table

_b = Book()
QUERIES, ORACLE = _b.queries, _b.oracle


@_b.query("""with o as (select p_partkey, string_split(p_name, ' ') as tags, case p_size % 4 when 0 then 'primary' when 1 then 'corroborated' when 2 then 'single-source' else 'unverified' end as conf, p_type as headline from part where p_partkey % 3 <> 0),
n as (select p_partkey, [p_brand, string_split(p_name, ' ')[1]] as tags, case p_size % 3 when 0 then 'unverified' when 1 then 'primary' else 'single-source' end as conf, p_brand as headline from part where p_partkey % 2 = 0),
r(c, i) as (values ('primary', 0), ('corroborated', 1), ('single-source', 2), ('unverified', 3))
select 'k' || coalesce(o.p_partkey, n.p_partkey) as topic_key, case when o.conf is null then n.conf when n.conf is null then o.conf when (select i from r where c = o.conf) <= (select i from r where c = n.conf) then o.conf else n.conf end as confidence,
coalesce(n.headline, o.headline) as headline, array_to_string(list_concat(coalesce(o.tags, []), list_filter(case when n.tags[1] = n.tags[2] then n.tags[1:1] else coalesce(n.tags, []) end, lambda x: not list_contains(coalesce(o.tags, []), x))), ' ') as tags,
cast(case when o.p_partkey is not null and n.p_partkey is not null then 1 else 0 end as integer) as n_updates from o full join n on o.p_partkey = n.p_partkey""")
def topic_merge(spark, sf_dir):
    """Part records merged into part topics."""
    p = table(spark, sf_dir, "part")
    names = ("primary", "corroborated", "single-source", "unverified")
    size = F.col("p_size")
    conf = F.element_at(F.array(*(F.lit(x) for x in names)), size % 4 + 1)
    none = lambda t: F.array().cast(t)
    base = dict(topic_key=F.concat(F.lit("k"), F.col("p_partkey").cast("string")), question=F.lit("q"), answer=F.lit("a"), research_status=F.lit("open"), finding=F.lit("mixed"), title=F.col("p_name"),
                evidence=none(schemas.EVIDENCE), contradictions=none("array<string>"), open_questions=none("array<string>"))
    topic_cols = [x.split(" ")[0] for x in schemas.TOPICS.replace("array<struct<url:string,quote:string,confidence:string>>", "e").replace("array<struct<date:string,headline:string,changes:array<string>,sources:array<string>>>", "u").split(", ")]
    old = base | dict(confidence=conf, headline=F.col("p_type"), tags=F.split("p_name", " "), stem=F.col("p_name"), first_raised=F.lit("2026-01-01"), last_verified=F.lit("2026-01-01"),
                      updates=none("array<struct<date:string,headline:string,changes:array<string>,sources:array<string>>>"), content_sha=F.lit(""), managed=F.lit(True))
    new = base | dict(confidence=F.when(size % 3 == 0, "unverified").when(size % 3 == 1, "primary").otherwise("single-source"), headline=F.col("p_brand"), tags=F.array("p_brand", F.element_at(F.split("p_name", " "), 1)))
    topics = p.where("p_partkey % 3 <> 0").select(*(old[c].alias(c) for c in topic_cols))
    records = p.where("p_partkey % 2 = 0").select(*(v.alias(k) for k, v in new.items()))
    m = archive.merge_topics(topics, records, "2026-02-02")
    return m.select("topic_key", "confidence", "headline", F.array_join("tags", " ").alias("tags"), F.size("updates").alias("n_updates"))


@_b.query("""with t as (select p_partkey as stem, unnest(list_distinct(string_split(p_name, ' '))) as tag from part), p as (select a.stem, b.stem as other, count(*) as overlap from t a join t b on a.tag = b.tag and a.stem <> b.stem group by 1, 2 having count(*) >= 2),
r as (select *, row_number() over (partition by stem order by overlap desc, other) as rank from p) select stem, other, overlap, cast(rank as integer) as rank from r where rank <= 5""")
def related_by_tag(spark, sf_dir):
    """Parts that share words of their names."""
    return archive.related(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), F.split("p_name", " ").alias("tags")))


@_b.query("""with t as (select p_partkey as stem, unnest(list_distinct(string_split(p_name, ' '))) as tag from part) select tag, array_to_string(list_sort(list(distinct stem)), ',') as stems, count(distinct stem) as n from t group by tag having count(distinct stem) >= 2""")
def tag_inverted_index(spark, sf_dir):
    i = archive.tag_index(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), F.split("p_name", " ").alias("tags")))
    return i.select("tag", F.array_join(F.transform("stems", lambda s: s.cast("string")), ",").alias("stems"), "n")


@_b.query("select o_orderstatus as status, count(*) as n, cast(grouping(o_orderstatus) as integer) as is_total from orders group by rollup (o_orderstatus)")
def status_rollup(spark, sf_dir):
    s = archive.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
    return s.select(F.col("o_orderstatus").alias("status"), "n", F.col("is_total").cast("int").alias("is_total"))


@_b.query("""with r as (select o_orderstatus as finding, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from orders)
select finding, string_agg('• order ' || o_orderkey, chr(10) order by r) filter (r <= 6) || case when max(n) > 6 then chr(10) || 'and ' || (max(n) - 6) || ' more' else '' end as lines, cast(4 as integer) as ord from r group by finding""")
def findings_top6(spark, sf_dir):
    """The summary: the first six of each finding, and how many more there are."""
    o = table(spark, sf_dir, "orders")
    return reports.summary(o.select(F.col("o_orderstatus").alias("finding"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title")))


@_b.query("select o_orderpriority as finding, count(*) as n from orders group by 1")
def findings_histogram(spark, sf_dir):
    return reports.findings_histogram(table(spark, sf_dir, "orders").withColumn("finding", F.col("o_orderpriority")))


@_b.query("""with p as (select source || '/' || lpad(cast(doc_id as varchar), 9, '0') as path, 'Doc ' || doc_id as title, source from documents), k as (select * from p order by path limit 600), n as (select greatest(count(*) - 600, 0) as n from p)
select source as folder, string_agg('- ' || title, chr(10) order by path) as lines from k group by source union all select null, n || ' more' from n where n > 0""")
def digest_by_folder(spark, sf_dir):
    """The index of pages by folder; the limit of 600 is the feature."""
    d = table(spark, sf_dir, "documents")
    return reports.digest(d.select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title")))


@_b.query(r"""with q as (select o_orderkey, rtrim(regexp_replace(trim(o_orderpriority || '  ' || o_orderstatus || repeat(' why', cast(o_orderkey % 30 as integer)) || '??'), '\s+', ' ', 'g'), '?') as q from orders)
select o_orderkey, 'Research - ' || case when length(q) > 80 then rtrim(substr(q, 1, 77)) || '...' else q end || ' - 2026-07' as title from q""")
def question_titles(spark, sf_dir):
    """Titles from questions."""
    q = F.concat("o_orderpriority", F.lit("  "), "o_orderstatus", F.repeat(F.lit(" why"), (F.col("o_orderkey") % 30).cast("int")), F.lit("??"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.question_title(q, F.lit("2026-07")).alias("title"))


_CONF, _STATUS = ("primary", "corroborated", "single-source", "unverified"), ("contested", "open", "answered")
_SCALAR = "case when regexp_matches({0}, '^[A-Za-z0-9][A-Za-z0-9._-]*$') then {0} else '\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"' end"


def _topics(spark, sf_dir):
    """Parts as topics."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    of = lambda names, k: F.element_at(F.array(*(F.lit(x) for x in names)), k)
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    evidence = F.array(F.struct(F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("url"), F.concat("p_type", F.lit(" | "), "p_brand").alias("quote"), F.lit("c").alias("confidence")))
    values = dict(title=F.col("p_name"), topic_key=key, question=F.col("p_type"), answer=F.col("p_brand"), confidence=of(_CONF, size % 4 + 1), research_status=of(_STATUS, size % 3 + 1), finding=F.when(size % 2 == 0, "mixed"), headline=F.when(size % 5 == 0, F.col("p_type")),
                  evidence=F.when(size % 7 != 0, evidence), contradictions=F.when(size % 3 == 0, F.array("p_type")), open_questions=F.lit(None).cast("array<string>"), tags=F.split("p_name", " "), stem=key, first_raised=F.lit("2026-01-01"), last_verified=F.lit("2026-02-02"),
                  updates=F.lit(None).cast("array<struct<date:string,headline:string,changes:array<string>,sources:array<string>>>"), content_sha=F.lit(None).cast("string"), managed=F.lit(True))
    return p.select(*(v.alias(k) for k, v in values.items()))


def _block(title: str, related: str) -> str:
    """SQL of the front block of a part as a topic."""
    return f"""'---' || chr(10) || 'title: ' || {_SCALAR.format(title)} || chr(10) || 'entity_type: research_task' || chr(10) || 'topic_key: k' || p_partkey || chr(10) || 'research_status: ' || ['contested', 'open', 'answered'][p_size % 3 + 1] || chr(10)
|| 'finding: ' || case when p_size % 2 = 0 then 'mixed' else 'unestablished' end || chr(10) || case p_size % 4 when 0 then 'confidence: primary' || chr(10) when 1 then 'confidence: corroborated' || chr(10) else '' end || 'first_raised: 2026-01-01' || chr(10)
|| 'last_verified: 2026-02-02' || chr(10) || 'tags: [' || array_to_string(list_sort(list_distinct(list_concat(['signal-derived', 'research'], list_filter(string_split(p_name, ' '), lambda x: regexp_matches(x, '^[a-z][a-z0-9]*(-[a-z0-9]+)*$')),
case p_size % 4 when 2 then ['single-source'] when 3 then ['unverified'] else [] end))), ', ') || ']' || chr(10) || 'sources: [' || case when p_size % 7 <> 0 then '"https://x.example/' || p_partkey || '"' else '' end || ']' || chr(10) || 'related: [{related}]' || chr(10) || '---'"""


@_b.query(f"select p_partkey, {_block('p_name', '')} as block from part")
def yaml_frontmatter(spark, sf_dir):
    """Front blocks of parts as topics."""
    t = _topics(spark, sf_dir).withColumn("sources", F.transform(F.coalesce("evidence", F.array().cast("array<struct<url:string,quote:string,confidence:string>>")), lambda e: e["url"])).withColumn("related", F.array().cast("array<string>"))
    names = ("title", "topic_key", "research_status", "finding", "confidence", "first_raised", "last_verified", "tags", "sources", "related")
    return t.select(F.substring("topic_key", 2, 20).cast("long").alias("p_partkey"), archive.frontmatter({n: F.col(n) for n in names}).alias("block"))


@_b.query(f"""with t as (select *, 'Research - ' || trim(p_name) as title from part) select 'k' || p_partkey as topic_key, 'k' || p_partkey as stem, {_block('title', '"[[Hub]]"')} || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
|| case when p_size % 3 = 0 then '> [!warning] Contested' || chr(10) || '> Sources disagree on this. See Contradictions below before citing it.' || chr(10) || chr(10) else '' end || case when p_size % 5 = 0 then '**' || p_type || '**' || chr(10) || chr(10) else '' end
|| '## Question' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10)
|| case when p_size % 7 <> 0 then '| Source | Quote | Confidence |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| https://x.example/' || p_partkey || ' | ' || p_type || ' \\| ' || p_brand || ' | c |' else '_No sources were retrieved for this entry._' end || chr(10) || chr(10)
|| '## Contradictions' || chr(10) || chr(10) || case when p_size % 3 = 0 then '- ' || p_type else '_None found._' end || chr(10) || chr(10) || '## Open questions' || chr(10) || chr(10) || '_None recorded._' || chr(10) || chr(10)
|| '## Provenance' || chr(10) || chr(10) || '{pages.PROVENANCE}' || chr(10) || chr(10) || '## Related Pages' || chr(10) || chr(10) || '- [[Hub]]' || chr(10) as page from t""")
def rendered_pages(spark, sf_dir):
    """Parts as pages of the archive."""
    return pages.render(_topics(spark, sf_dir), hubs=("Hub",))


@_b.query("""select l_orderkey, l_linenumber, round(least(greatest(3 * sqrt(l_quantity + 1), 8), 30) * 1.5, 9) as radius from lineitem""")
def node_radius(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(graph.node_radius(F.col("l_quantity"), 1.5), 9).alias("radius"))


@_b.query("""select p_partkey, p_brand || case when r = 1 then '' else ' (' || r || ')' end as given from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) + case when p_brand like '%1' then 1 else 0 end as r from part)""")
def unique_names(spark, sf_dir):
    """File names given to parts of one brand, some of which are taken."""
    p = table(spark, sf_dir, "part")
    taken = p.select(F.col("p_brand").alias("name")).where("name like '%1'").distinct()
    return archive.unique_names(p.select("p_partkey", F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord")), taken).select("p_partkey", "given")


@_b.query("""select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'collide' when o_orderkey % 2 = 0 then 'create' when o_orderkey % 5 = 0 then 'append-legacy' when o_orderkey % 3 = 0 and o_orderkey % 7 = 0 then 'refuse-hand-edited' else 'update' end as decision from orders""")
def file_decisions(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", archive.file_decision(k % 2 != 0, k % 3 == 0, k % 5 != 0, k % 7 != 0).alias("decision"))


@_b.query("""select l_orderkey, l_linenumber, round(power(least(greatest(l_discount * 12 - 0.1, 0), 1), 0.8), 9) as t, round(0.25 + 0.75 * power(least(greatest(l_discount * 12 - 0.1, 0), 1), 0.8), 9) as alpha, round(1.6 + 3.4 * power(least(greatest(l_discount * 12 - 0.1, 0), 1), 0.8), 9) as width from lineitem""")
def edge_style(spark, sf_dir):
    s = graph.edge_style(F.col("l_discount") * 12 - 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(k) for k, c in s.items()))


@_b.query("""with l as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_returnflag = 'R') select l_orderkey, l_linenumber, a is not null as native from lineitem left join l on least(l_partkey, l_suppkey) = a and greatest(l_partkey, l_suppkey) = b""")
def edge_nativity(spark, sf_dir):
    """Whether a line's part and supplier are linked by a returned line."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return graph.nativity(e, e.where("l_returnflag = 'R'").select("src", "dst")).select("l_orderkey", "l_linenumber", "native")


@_b.query("""select * from (values ('Alpha', 'notes/Alpha.md'), ('notes/Alpha', 'notes/Alpha.md'), ('notes/Alpha.md', 'notes/Alpha.md'), ('BETA', 'x/beta.md'), ('nope', null)) v(name, node)""")
def name_resolution(spark, sf_dir):
    nodes = spark.createDataFrame([("notes/Alpha.md", 0), ("x/beta.md", 1), ("y/beta.md", 2)], "id string, ord int")
    return graph.resolve_names(spark.createDataFrame([(x,) for x in ("Alpha", "notes/Alpha", "notes/Alpha.md", "BETA", "nope")], "name string"), nodes)
