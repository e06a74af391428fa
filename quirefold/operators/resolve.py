"""From candidates (hits) to one resolution for each item: admission, venue choice, confidence, overrides.

Hits have item_key, hit_ord (their order: stage, provider, position) and the columns of HIT. All
first-wins rules follow hit_ord, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import blank, is_arxiv_doi, is_nonvenue, item_year
from ..functions.labels import build_tags, source_family, source_weight
from ..functions.text import norm_people, norm_title
from ..plans.tools import first_rows, settled, small
from .catalogue import Index
from .identity import verify_identity
from .lookup import lookup_slug, rank

HIT = (
    "source string, title string, authors array<string>, title_score double, venue_raw string, venue_candidates array<string>, year int, venue_type string, "
    "venue_evidence string, venue_match_quality string, citation_count int, influential_citations int, external_doi string, dblp_key string, evidence_url string, "
    "issn string, abbrev string, publisher string, publication_date string, volume string, issue string, pages string, related_dois array<string>, track string, note string"
)

#: Sources whose evidence ends the search.
STRONG_SOURCES = ("crossref_doi", "crossref_title", "doi_csl", "dblp", "openreview", "official_web", "usenix_official", "arxiv_journal_ref")

#: Sources trusted without a second family.
TRUSTED_SOURCES = ("usenix_official", "official_web", "doi_csl", "crossref_doi", "datacite_doi", "opencitations_doi", "arxiv_journal_ref", "openreview", "dblp")

#: Sources that alone make a conference certain.
STRONG_CONFERENCE_SOURCES = ("usenix_official", "official_web", "openreview", "dblp", "crossref_doi", "datacite_doi", "opencitations_doi", "openalex_doi", "arxiv_journal_ref")

FILLED = ("external_doi", "volume", "issue", "pages", "publication_date")

VENUE = "struct<canonical:string,kind:string,core:string,tier:string,domain:string,full_name:string,publisher:string,url:string,dblp_slug:string,write_as:string,aliases:array<string>>"


def with_venue(hits: DataFrame, index: Index) -> DataFrame:
    """hits with venue: by bibliography slug, else the first candidate string with a tier, else the first known one."""
    slugs = lookup_slug(hits.select(F.col("dblp_key").alias("url")).union(hits.select("evidence_url")).where("url IS NOT NULL"), index).where("NOT match.ambiguous")
    m = lambda c: F.col(f"match.{c}").alias(c)
    none, empty = F.array().cast("array<string>"), F.lit("")
    by_slug = slugs.select("url", F.struct(m("canonical"), m("kind"), empty.alias("core"), m("tier"), m("domain"), m("full_name"), m("publisher"), m("url"), m("dblp_slug"), F.col("match.full_name").alias("write_as"), none.alias("aliases")).alias("v"))
    keyed = hits.join(by_slug.toDF("_u1", "_v1"), F.col("dblp_key") == F.col("_u1"), "left").join(by_slug.toDF("_u2", "_v2"), F.col("evidence_url") == F.col("_u2"), "left")
    strings = F.filter(F.concat(F.coalesce("venue_candidates", none), F.array("venue_raw", "abbrev")), lambda v: v.isNotNull() & (v != ""))
    tries = hits.select("item_key", "hit_ord", F.col("venue_type").alias("kind"), F.posexplode(strings).alias("pos", "value"))
    known = rank(tries.select("value", "kind"), index).where("venue IS NOT NULL").select(F.col("value").alias("_v"), F.col("kind").alias("_k"), "venue")
    found = tries.join(known, (F.col("value") == F.col("_v")) & F.col("kind").eqNullSafe(F.col("_k")))
    best = found.groupBy("item_key", "hit_ord").agg(F.min_by("venue", F.struct(F.when(F.col("venue.tier") != "", 0).otherwise(1), "pos")).alias("_by_name"))
    joined = keyed.join(best, ["item_key", "hit_ord"], "left")
    return joined.withColumn("venue", F.coalesce("_v1", "_v2", "_by_name").cast(VENUE)).drop("_u1", "_v1", "_u2", "_v2", "_by_name")


def admit(items: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted hits, rejected (item_key, hit_ord, source, reason)): hits that are the item's work, first of their kind.

    items: item_key, title, creators. Hits without a title and the item's own metadata are not compared.
    """
    people = F.filter("creators", lambda c: (blank(c["creatorType"]) == "") | (c["creatorType"] == "author"))
    family = norm_people(F.transform(people, lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"], F.lit(""))))
    given = norm_people(F.transform(people, lambda c: blank(c["firstName"])))
    query = items.select("item_key", norm_title(F.col("title")).alias("_title"), family.alias("_f"), given.alias("_g"))
    query = query.select("item_key", "_title", F.zip_with("_f", "_g", lambda f, g: F.struct(f.alias("family"), g.alias("given"))).alias("_creators"))
    found = hits.select("item_key", "hit_ord", norm_title(F.col("title")).alias("_found"), norm_people(F.col("authors")).alias("_authors"))
    joined = hits.join(found, ["item_key", "hit_ord"]).join(query, "item_key", "left")
    exempt = (blank(F.col("title")) == "") | blank(F.col("source")).rlike("^arxiv_|zotero_metadata|user_override")
    verdict = verify_identity(blank(F.col("_title")), F.col("_found"), F.col("_creators"), F.col("_authors"))
    judged = joined.withColumn("_v", F.when(~exempt, verdict)).drop("_title", "_creators", "_found", "_authors")
    rejected = judged.where("NOT _v.ok").select("item_key", "hit_ord", "source", F.col("_v.reason").alias("reason"))
    passed = judged.where(F.coalesce(F.col("_v.ok"), F.lit(True))).drop("_v").withColumn("external_doi", F.when(~is_arxiv_doi(F.col("external_doi")), F.col("external_doi")))
    kept = first_rows(passed, ["item_key", "source", "venue_raw", "year", "external_doi", "evidence_url"], F.col("hit_ord"))
    return kept, rejected


def hit_score(hit_venue: str = "venue") -> Column:
    """A hit's own score: its source, what is known of its venue, its title, DOI and kind of evidence."""
    v = lambda c: F.col(f"{hit_venue}.{c}")
    known = F.col(hit_venue).isNotNull()
    bonus = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(F.lit(0.0))
    title = F.when(F.col("title_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("title_score") * 3))).otherwise(0.0)  # greatest() skips nulls
    formal = (blank(F.col("external_doi")) != "") & ~is_arxiv_doi(F.col("external_doi"))
    return (
        source_weight(F.col("source")).cast("double") + bonus(known, 7) + bonus(known & (v("tier") != ""), 22) + bonus(known & (v("core") != ""), 3)
        + bonus(known & (v("kind") == "conference"), 7) + title + bonus(formal, 1)
        + bonus(F.col("venue_evidence") == "page_text", -30) + bonus(F.col("venue_evidence") == "snippet", -20) + bonus(F.col("venue_match_quality") == "case_insensitive", -10)
    )


def score_groups(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group (keys, group_key) of scored (family, score, ord): max_score, best_ord, first_ord, families, total.

    total: the best score, ten for each further family, and 0.08 of the second to fourth best families.
    """
    family = scored.groupBy(*keys, "group_key", "family").agg(F.max("score").alias("score"), F.max_by("ord", F.struct("score", -F.col("ord"))).alias("best_ord"), F.min("ord").alias("first_ord"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("first_ord"))))
    grouped = family.groupBy(*keys, "group_key").agg(
        F.max("score").alias("max_score"), F.max_by("best_ord", F.struct("score", -F.col("best_ord"))).alias("best_ord"), F.min("first_ord").alias("first_ord"),
        F.count(F.lit(1)).alias("families"), ranked.alias("_f"))
    support = F.aggregate(F.slice("_f", 2, 3), F.lit(0.0), lambda a, x: a + (-x["neg"]) * F.lit(0.08))
    agreement = F.greatest(F.lit(0), F.col("families") - 1) * F.lit(10.0)
    return grouped.withColumn("total", F.col("max_score") + agreement + support).drop("_f")


def best_groups(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The first group of each key by total, best score and first appearance."""
    return first_rows(groups, keys, F.desc("total"), F.desc("max_score"), F.col("first_ord"))


def choose_venue(hits: DataFrame) -> DataFrame:
    """(item_key, chosen_ord): the hit whose venue group wins; hits have venue. Items without a venue are absent."""
    named = hits.where(F.col("venue_raw").isNotNull() & ~is_nonvenue(F.col("venue_raw")))
    own = F.concat_ws("|", F.coalesce(F.nullif(F.col("venue_type"), F.lit("")), F.lit("unknown")), norm_title(F.col("venue_raw")))
    key = F.when(F.col("venue").isNotNull(), F.concat_ws("|", "venue.kind", "venue.canonical")).otherwise(own)
    scored = named.select("item_key", key.alias("group_key"), source_family(F.col("source")).alias("family"), hit_score().alias("score"), F.col("hit_ord").alias("ord"))
    return best_groups(score_groups(scored, ["item_key"]), ["item_key"]).select("item_key", F.col("best_ord").alias("chosen_ord"))


def fill_down(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen hits, with missing DOI, volume, issue, pages and date from hits of the same venue and year, in their order."""
    named = hits.withColumn("_name", F.when(F.col("venue_raw").isNotNull(), F.coalesce("venue.canonical", "venue_raw")))
    own = named.join(chosen.select("item_key", F.col("chosen_ord").alias("hit_ord")), ["item_key", "hit_ord"], "left_semi")
    offers = []
    for c in FILLED:
        has = blank(F.col(c).cast("string")) != ""
        offers.append(F.min_by(F.when(has, F.col(c)), F.when(has, F.col("hit_ord"))).alias(f"_{c}"))
    groups = named.groupBy(F.col("item_key").alias("_item"), F.col("_name").alias("_venue"), F.col("year").alias("_year")).agg(*offers)
    same = (F.col("item_key") == F.col("_item")) & F.col("_name").eqNullSafe(F.col("_venue")) & F.col("year").eqNullSafe(F.col("_year"))
    filled = {c: F.coalesce(F.when(blank(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")) for c in FILLED}
    return own.join(groups, same, "left").withColumns(filled).select(*hits.columns)


def confidence(chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_key, confidence) of chosen hits, by their kind of evidence and the families that agree with them."""
    v = chosen.select("item_key", F.col("venue.canonical").alias("_c"), F.col("venue.kind").alias("_k"))
    fit = hits.where("venue IS NOT NULL AND (venue_evidence IS NULL OR venue_evidence NOT IN ('page_text', 'snippet'))").join(v, "item_key")
    fit = fit.where((F.col("venue.canonical") == F.col("_c")) & (F.col("_k").isNull() | (F.col("venue.kind") == F.col("_k"))))
    families = fit.groupBy("item_key").agg(F.count_distinct(source_family(F.col("source"))).alias("_n"))
    folded = F.col("venue_match_quality") == "case_insensitive"
    level = (
        F.when(F.col("source").endswith("snippet"), F.when(folded, 0.55).otherwise(0.65)).when(F.col("venue").isNull(), 0.6)
        .when(F.col("venue_evidence") == "page_text", F.when(folded, 0.55).otherwise(0.70)).when(F.col("_n") >= 3, 0.99).when(F.col("_n") >= 2, 0.95)
        .when(F.col("source").isin(*TRUSTED_SOURCES), F.when(F.col("venue.tier") != "", 0.92).otherwise(0.89)).when(F.col("venue.tier") != "", 0.87).otherwise(0.85)
    )
    return chosen.join(families, "item_key", "left").select("item_key", level.alias("confidence"))


def is_strong() -> Column:
    """Whether a hit with venue is evidence enough to stop."""
    return (
        F.col("venue_raw").isNotNull() & ~is_nonvenue(F.col("venue_raw")) & (F.coalesce("year", F.lit(0)) != 0) & ~(F.coalesce("venue_evidence", F.lit("")) == "page_text")
        & F.col("source").isin(*STRONG_SOURCES) & F.col("venue").isNotNull() & (F.coalesce("title_score", F.lit(1.0)) >= 0.94)
    )


def strong_items(hits: DataFrame) -> DataFrame:
    return hits.where(is_strong()).select("item_key").distinct()


def has_evidence(hits: DataFrame) -> DataFrame:
    """(item_key, recognized, conference, tiered, tiered_conference, strong_conference): what an item's hits show."""
    conf = (F.col("venue.kind") == "conference") & (F.col("venue.tier") != "")
    each = hits.where("venue IS NOT NULL")
    families = each.where(conf).groupBy("item_key", "venue.canonical").agg(F.count_distinct(source_family(F.col("source"))).alias("n"), F.bool_or(F.col("source").isin(*STRONG_CONFERENCE_SOURCES)).alias("s"))
    strong = families.groupBy("item_key").agg(F.bool_or((F.col("n") >= 2) | F.col("s")).alias("strong_conference"))
    base = hits.groupBy("item_key").agg(
        F.bool_or(F.col("venue").isNotNull()).alias("recognized"), F.bool_or(F.coalesce(F.col("venue.kind") == "conference", F.lit(False))).alias("conference"),
        F.bool_or(F.coalesce(F.col("venue.tier") != "", F.lit(False))).alias("tiered"), F.bool_or(F.coalesce(conf, F.lit(False))).alias("tiered_conference"))
    return base.join(strong, "item_key", "left").withColumn("strong_conference", F.coalesce("strong_conference", F.lit(False)))


def citations(hits: DataFrame) -> DataFrame:
    """(item_key, citation_count, influential_citations): counts of one measurement system are not mixed with others'."""
    own = blank(F.col("source")).startswith("semantic_scholar")
    return hits.groupBy("item_key").agg(F.max(F.when(own, F.col("citation_count"))).alias("citation_count"), F.max("influential_citations").alias("influential_citations"))


def user_overrides(items: DataFrame, prefix: str = "quirefold") -> DataFrame:
    """(item_key, ov_venue, ov_year) from lines of extra, the last of each kind: "venue override: X", "venue year: 2024"."""
    lines = F.split(blank(F.col("extra")), r"\r\n|\r|\n")
    venue, year = rf"(?i)^\s*(?:{prefix}-venue|venue override)\s*:\s*(.+?)\s*$", rf"(?i)^\s*(?:{prefix}-year|venue year)\s*:\s*((?:19|20)\d{{2}})\s*$"
    last = lambda p: F.regexp_extract(F.try_element_at(F.filter(lines, lambda x: x.rlike(p)), F.lit(-1)), p, 1)
    return items.select("item_key", last(venue).alias("ov_venue"), F.nullif(last(year), F.lit("")).cast("int").alias("ov_year")).where("ov_venue <> ''")


def duplicate_groups(resolutions: DataFrame) -> DataFrame:
    """(arxiv_id, item_keys) for ids that several items share."""
    groups = resolutions.where("arxiv_id IS NOT NULL").groupBy("arxiv_id").agg(F.array_sort(F.collect_list("item_key")).alias("item_keys"))
    return groups.where("size(item_keys) > 1")


def compose(items: DataFrame, hits: DataFrame, index: Index, overrides: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One resolution for each item from its admitted hits with venue.

    items: item_key, version, title, arxiv_id, date, extra, tags, collections, itemType; overrides: arxiv_id, canonical, year;
    metadata: arxiv_id, published_year. Precedence: hits, then curated overrides, then the user's.
    """
    chosen = settled(fill_down(hits, choose_venue(hits)))
    conf = confidence(chosen, hits)
    strong = strong_items(hits).withColumn("_strong", F.lit(True))
    known = hits.where("source = 'zotero_metadata'").select("item_key").distinct().withColumn("_known", F.lit(True))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("hit_ord", c.alias("x")))), lambda s: s["x"])
    line = F.concat(F.col("source"), F.lit(": "), F.coalesce(F.nullif(F.col("venue_raw"), F.lit("")), F.lit("-")), F.lit(" ("), blank(F.col("evidence_url")), F.lit(")"))
    listed = hits.groupBy("item_key").agg(F.array_distinct(ordered(F.col("source"))).alias("sources"), ordered(line).alias("evidence"))
    batch = first_rows(hits.where("source = 'semantic_scholar'"), ["item_key"], F.col("hit_ord")).select("item_key", F.col("year").alias("_batch_year"))
    own = chosen.select("item_key", F.struct(*[F.col(c) for c in ("source", "venue_raw", "year", "venue_type", "external_doi", "issn", "abbrev", "publisher", "publication_date", "volume", "issue", "pages")], "venue").alias("hit"))
    base = items
    for side in (own, conf, citations(hits), listed, strong, known, batch):
        base = base.join(side, "item_key", "left")
    if metadata is not None:
        base = base.join(metadata.select("arxiv_id", F.col("published_year").alias("_published")), "arxiv_id", "left")
    else:
        base = base.withColumn("_published", F.lit(None).cast("int"))
    user = user_overrides(items)
    asked = overrides.select(F.col("canonical").alias("value")).union(user.select("ov_venue")).select("value", F.lit(None).cast("string").alias("kind"))
    ranked = rank(asked, index).select("value", "venue")
    curated = small(overrides.join(ranked.toDF("canonical", "c_venue"), "canonical", "left").select("arxiv_id", F.col("canonical").alias("c_name"), F.col("year").alias("c_year"), "c_venue"))
    user = user.join(ranked.where("venue IS NOT NULL").toDF("ov_venue", "u_venue"), "ov_venue")
    base = base.join(curated, "arxiv_id", "left").join(user, "item_key", "left")

    has, by_list, by_user, none = F.col("hit").isNotNull(), F.col("c_name").isNotNull(), F.col("u_venue").isNotNull(), F.lit(None).cast("string")
    some = lambda v: F.nullif(v, F.lit(""))
    v = F.col("hit.venue")

    def pick(u: Column, c: Column, h: Column) -> Column:
        return F.when(by_user, u).when(by_list, c).otherwise(h)

    nonzero = lambda y: F.when(y != 0, y)
    year = F.coalesce(nonzero(F.col("hit.year")), F.col("_published"), nonzero(F.col("_batch_year")), item_year(F.col("date")))
    listed_year = F.when(by_list, F.coalesce("c_year", year)).otherwise(year)
    capped = F.when(has & ~F.coalesce("_strong", F.lit(False)) & ~F.coalesce("_known", F.lit(False)), F.least("confidence", F.lit(0.75))).otherwise(F.coalesce("confidence", F.lit(0.0)))
    none_list = F.array().cast("array<string>")
    sources, evidence = F.coalesce("sources", none_list), F.coalesce("evidence", none_list)
    listed_sources = F.when(by_list, F.concat(F.array(F.lit("override")), sources)).otherwise(sources)
    listed_evidence = F.when(by_list, F.concat(F.array(F.concat(F.lit("override: "), F.col("c_name"))), evidence)).otherwise(evidence)
    out = base.withColumns({
        "venue_raw": pick(F.col("ov_venue"), F.col("c_name"), F.col("hit.venue_raw")),
        "canonical": pick(F.col("u_venue.canonical"), F.coalesce("c_venue.canonical", "c_name"), F.coalesce(v["canonical"], F.col("hit.venue_raw"))),
        "kind": pick(F.col("u_venue.kind"), F.coalesce(F.col("c_venue.kind"), v["kind"], F.col("hit.venue_type")), F.coalesce(v["kind"], F.col("hit.venue_type"))),
        "year": F.when(by_user, F.coalesce("ov_year", listed_year, item_year(F.col("date")))).otherwise(listed_year),
        "ccf_tier": pick(some(F.col("u_venue.tier")), some(F.col("c_venue.tier")), some(v["tier"])),
        "ccf_domain": pick(some(F.col("u_venue.domain")), some(F.col("c_venue.domain")), some(v["domain"])),
        "core_tier": pick(some(F.col("u_venue.core")), some(F.col("c_venue.core")), some(v["core"])),
        "acceptance": F.when(by_user | by_list | has, "accepted").otherwise("unknown"),
        "confidence": F.when(by_user | by_list, 1.0).otherwise(capped),
        "sources": F.when(by_user, F.concat(F.array(F.lit("user_override")), F.array_remove(listed_sources, "user_override"))).otherwise(listed_sources),
        "evidence": F.when(by_user, F.concat(F.array(F.concat(F.lit("user_override: "), F.col("ov_venue"))), listed_evidence)).otherwise(listed_evidence),
        "status": F.when(by_user | by_list | has, "resolved").otherwise("no-verified-result"),
    })
    own_name = F.when(F.col("hit.venue_raw").isNotNull(), F.coalesce(v["canonical"], F.col("hit.venue_raw")))
    same = F.when(~by_user & (own_name == F.col("canonical")), F.col("hit"))
    out = out.withColumn("proposal_hit", same).withColumn("user_abbrev", F.when(by_user, F.col("u_venue.canonical")))
    out = out.withColumn("suggested_tags", build_tags(*[F.col(c) for c in ("canonical", "year", "ccf_tier", "core_tier", "acceptance", "citation_count")]))
    return out.drop("hit", "_strong", "_known", "_batch_year", "_published", "c_name", "c_year", "c_venue", "u_venue", "ov_venue", "ov_year")
