"""Pages of the archive: titles, update blocks, whole pages, what may be repaired, and keys for pages without one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import archive

# The parts of a page.
NO_SOURCES = "_No sources were retrieved for this entry._"
NO_CONTRADICTIONS, NO_QUESTIONS = "_None found._", "_None recorded._"
CONTESTED = "> [!warning] Contested\n> Sources disagree on this. See Contradictions below before citing it."
PROVENANCE = "Raised in the group chat and researched automatically. Participants are pseudonymised; see PRIVACY.md in the source repository."


def collapsed(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def question_title(question: Column, month: Column, most: int = 80) -> Column:
    """A title from the question, 80 characters at most, and the month."""
    q = F.regexp_replace(collapsed(question), r"\?+$", "")
    return F.concat(F.lit("Research - "), T.shortened(q, most), F.lit(" - "), month)


def _listed(items: Column, empty: str) -> Column:
    said = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.size(said) == 0, F.lit(empty)).otherwise(T.bullets(said))


def _paragraphs(*parts: Column) -> Column:
    """The parts with a blank line after each; null parts are left out."""
    return F.concat_ws("\n\n", *parts)


def update_block(update: Column) -> Column:
    """One dated entry of a page's updates (date, headline, changes, sources), without anybody's label or handle."""
    said = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(T.depersonalise(x))), lambda x: x != "")
    notes, sources = said(update["changes"]), said(update["sources"])
    headline = F.nullif(F.trim(T.depersonalise(F.coalesce(update["headline"], F.lit("")))), F.lit(""))
    body = _paragraphs(F.concat(F.lit("### "), T.cell(update["date"])), headline, F.when(F.size(notes) > 0, T.bullets(notes)), F.when(F.size(sources) > 0, F.concat(F.lit("Sources added:\n\n"), T.bullets(sources))))
    return F.concat(body, F.lit("\n"))


def backlinks(related: Column, hubs: Sequence[str] = ()) -> Column:
    """The related links, then those to the hubs that aren't among them."""
    own = F.coalesce(related, F.array().cast("array<string>"))
    return F.concat(own, F.array_except(F.array(*(F.lit(f"[[{h}]]") for h in hubs)).cast("array<string>"), own))


def page_stem(title: Column, question: Column) -> Column:
    """The file name of a title; where labels were taken out of it, six digits of the question's hash keep it apart."""
    digest = F.substring(F.sha2(F.coalesce(question, F.lit("")), 256), 1, 6)
    return F.when(F.contains(title, F.lit(T.MEMBER)), T.slug(F.concat(title, F.lit(" ("), digest, F.lit(")")))).otherwise(T.slug(title))


def render(topics: DataFrame, related: str | None = None, hubs: Sequence[str] = ()) -> DataFrame:
    """topic_key, stem, page: each topic as a page, without anybody's label or handle in any part of it.

    topics have the columns of schemas.TOPICS; related names a column of links. A stem that is there stays. Null lists
    count as empty, null texts as empty ones.
    """
    own = lambda c: T.depersonalise(F.coalesce(F.col(c), F.lit("")))
    each = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), T.depersonalise)
    evidence = F.transform(F.coalesce("evidence", F.array().cast(topics.schema["evidence"].dataType)), lambda e: F.struct(e["url"].alias("url"), T.depersonalise(F.coalesce(e["quote"], F.lit(""))).alias("quote"), e["confidence"].alias("confidence")))
    links = F.transform(F.col(related), T.depersonalise) if related else F.array().cast("array<string>")
    t = topics.withColumns({
        "__title": T.research_title(F.coalesce(F.nullif(collapsed(T.depersonalise(F.coalesce("title", F.lit("")))), F.lit("")), F.lit("Untitled"))), "__evidence": evidence, "__links": backlinks(links, hubs),
        "__updates": F.coalesce("updates", F.array().cast(topics.schema["updates"].dataType)), "__headline": F.nullif(F.trim(own("headline")), F.lit("")), "__question": own("question"),
    })
    front = archive.frontmatter({
        "title": F.col("__title"), "topic_key": own("topic_key"), "research_status": F.col("research_status"), "finding": F.col("finding"), "confidence": F.col("confidence"), "first_raised": F.col("first_raised"),
        "last_verified": F.col("last_verified"), "tags": each("tags"), "sources": F.transform("__evidence", lambda e: e["url"]), "related": F.col("__links"),
    })
    some = F.size("__updates") > 0
    section = lambda name, text: F.concat(F.lit(f"## {name}\n\n"), text)
    page = _paragraphs(
        front, F.concat(F.lit("# "), F.col("__title")), F.when(F.col("research_status") == "contested", F.lit(CONTESTED)), F.concat(F.lit("**"), F.col("__headline"), F.lit("**")),
        F.when(some, F.concat(F.lit("*Revised "), F.coalesce(F.element_at("__updates", -1)["date"], F.lit("")), F.lit(" — see Updates below.*"))),
        section("Question", F.col("__question")), section("Answer", own("answer")), section("Evidence", F.when(F.size("__evidence") == 0, F.lit(NO_SOURCES)).otherwise(T.evidence_table(F.col("__evidence")))),
        section("Contradictions", _listed(each("contradictions"), NO_CONTRADICTIONS)), section("Open questions", _listed(each("open_questions"), NO_QUESTIONS)),
        F.when(some, section("Updates", F.array_join(F.transform("__updates", update_block), "\n"))), section("Provenance", F.lit(PROVENANCE)),
        F.when(F.size("__links") > 0, section("Related Pages", T.bullets(F.col("__links")))),
    )
    stem = F.coalesce("stem", page_stem(F.col("__title"), F.col("__question")))
    return t.select("topic_key", stem.alias("stem"), F.concat(page, F.lit("\n")).alias("page"))


def latest_update(updates: Column) -> Column:
    """The date of the last update; null where there is none."""
    return F.when(F.size(updates) > 0, F.element_at(updates, -1)["date"])


def span_days(first: Column, last: Column) -> Column:
    """Days between two dates."""
    return F.datediff(last.cast("date"), first.cast("date"))


def with_state(pages: DataFrame, state: DataFrame) -> DataFrame:
    """pages (stem, page) with their topics (stem, topic_key, content_sha, managed, ...) and why a page is refused:
    no-state, hand-edited, no-front-block, or null."""
    t = state.withColumn("__there", F.lit(True))
    both = pages.join(t, "stem", "left")
    span = archive.frontmatter_span(F.split("page", "\n", -1))
    why = F.when(F.col("__there").isNull(), "no-state").when(~archive.content_ours(F.col("page"), F.col("content_sha")), "hand-edited").when(span.isNull(), "no-front-block")
    return both.withColumn("refusal", why).drop("__there")


def recoverable(value: Column, allowed: Sequence[str] | None = None) -> Column:
    """Whether a front-block value can be taken over: one of the allowed words, or a whole ISO date that exists."""
    if allowed is not None:
        return F.coalesce(value.isin(*allowed), F.lit(False))
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}\z") & value.try_cast("date").isNotNull(), F.lit(False))


def adopt(pages: DataFrame, known: DataFrame) -> DataFrame:
    """stem, topic_key of pages that no topic knows: a key from the stem, the next free one of its form where it is taken.

    pages: stem; known: stem, topic_key. A page whose stem gives no key is left out. Nothing is written.
    """
    new = pages.select("stem").distinct().join(known.select("stem"), "stem", "left_anti")
    keyed = new.withColumn("name", T.topic_key(F.regexp_replace("stem", r"(?i)^research - ", ""))).where("name is not null").withColumn("ord", F.col("stem"))
    given = archive.unique_names(keyed, known.select(F.col("topic_key").alias("name")).where("name is not null"), form="-{}")
    return given.select("stem", F.col("given").alias("topic_key"))


def repair(pages: DataFrame, state: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """stem, page, patched, refusal: pages that may be, with their key and the topics that share tags with them.

    state: stem, topic_key, content_sha, managed, tags. patched is null where nothing changes or the page is refused.
    """
    near = archive.related(state, least, most).groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: F.concat(F.lit("[["), x["other"], F.lit("]]"))).alias("__near"))
    rows = with_state(pages, state).join(near, "stem", "left")
    patched = archive.patch_page(F.col("page"), T.yaml_scalar(F.col("topic_key")), F.coalesce("__near", F.array().cast("array<string>")))
    return rows.select("stem", "page", F.when(F.col("refusal").isNull() & (patched != F.col("page")), patched).alias("patched"), "refusal")

