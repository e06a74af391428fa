"""Captured source records as hits.

A bronze table has item_key, route_ord, pos and rec (the record as JSON text), or xml or html. Each provider is a
function (items, bronze, index) -> hits: parse, gate against the item, choose the venue string, score, and
keep the best record of each item. items: item_key, title, creators, date, DOI. Nothing here fetches anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions import markup as M
from ..functions.text import author_matches, first_author_lastname, norm_people, norm_person, norm_title, paper_context, similarity_of, title_jaccard, title_similarity
from ..operators.catalogue import Index
from ..operators.lookup import find_in_text, lookup_slug, rank
from ..operators.resolve import HIT, hit_score, with_venue
from ..plans.tools import first_rows, settled, small

Provider = Callable[[DataFrame, DataFrame, Index], DataFrame]

#: Similarity from which a wrong author or year is forgiven.
FORGIVEN = 0.96

_STRINGS = "array<string>"
_DATES = "struct<`date-parts`:array<array<int>>>"
S2 = "paperId string, title string, venue string, year int, url string, publicationTypes array<string>, citationCount int, influentialCitationCount int, externalIds struct<DOI:string,DBLP:string>, authors array<struct<name:string>>, publicationVenue struct<name:string,type:string,issn:string,alternate_names:array<string>>"
CROSSREF = f"DOI string, URL string, type string, title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, `short-container-title` array<string>, event struct<name:string>, ISSN array<string>, publisher string, volume string, issue string, page string, `is-referenced-by-count` int, relation map<string,array<struct<`id-type`:string,id:string>>>, `published-print` {_DATES}, `published-online` {_DATES}, published {_DATES}, issued {_DATES}, created {_DATES}"
DATACITE = "id string, attributes struct<doi:string,url:string,publisher:string,publicationYear:int,citationCount:int,titles:array<struct<title:string>>,creators:array<struct<name:string,givenName:string,familyName:string>>,container:struct<title:string,type:string>,types:struct<resourceType:string,resourceTypeGeneral:string>,relatedItems:array<struct<titles:array<struct<title:string>>>>>"
OPENCITATIONS = "id string, title string, author string, pub_date string, venue string, type string, publisher string"
_SOURCE = "struct<display_name:string,type:string,issn_l:string,abbreviated_title:string,host_organization_name:string>"
OPENALEX = f"id string, display_name string, title string, publication_year int, doi string, type string, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:{_SOURCE}>, locations array<struct<source:{_SOURCE}>>"

#: Phrases that mark a review-site venue as not accepted there.
REVIEW_REJECTS = (
    "withdrawn", "withdrawal", "rejected", "rejection", "desk rejected", "desk_rejected", "submission", "submitted to", "under review", "under_review",
    "pending decision", "pending_decision", "workshop", "workshops", "findings", "tutorial", "tutorials", "abstract", "abstracts", "demonstration",
    "demonstrations", "doctoral consortium", "companion",
)

#: Words of acceptance and of its lack in preprint comments.
ACCEPTED = r"(?i)(?<![A-Za-z0-9_])(?:accepted|published|to\s+appear|forthcoming|in\s+proceedings|camera[- ]ready|presented)(?![A-Za-z0-9_])"
NOT_ACCEPTED = r"(?i)(?<![A-Za-z0-9_])(?:submitted|submission|under\s+review|withdrawn|rejected|workshop|findings|tutorial|demo|companion)(?![A-Za-z0-9_])"

#: Words of acceptance and of its lack on web pages and in search results.
WEB_ACCEPTED = (
    r"(?i)(?:(?<![A-Za-z0-9_])(?:accepted(?:\s+(?:at|to|by|for))?|to\s+appear|forthcoming|published(?:\s+(?:at|in))?|presented(?:\s+at)?|conference\s+paper|technical\s+sessions?|accepted\s+papers?|"
    r"prepublication|proceedings)(?![A-Za-z0-9_])|(?:被|已被|获得|获)\s*[^。；;]{0,80}(?:录用|接收)|(?:录用|接收)(?:于|至|到|为)?|正式发表(?:于)?|发表于|入选(?:了)?)"
)
WEB_NOT_ACCEPTED = (
    r"(?i)(?:(?<![A-Za-z0-9_])(?:submitted(?:\s+to)?|under\s+review|rejected|withdrawn|call\s+for\s+papers?|cfp|workshop|findings|tutorial|demo|companion|short\s+paper|poster\s+abstract)(?![A-Za-z0-9_])|"
    r"投稿(?:至|于)?|审稿中|评审中|拒稿|撤稿|征稿|研讨会|工作坊|短文|海报|演示论文)"
)

#: Hosts that a web search leaves out.
SKIPPED_HOSTS = (
    "arxiv.org", "export.arxiv.org", "semanticscholar.org", "www.semanticscholar.org", "dblp.org", "www.dblp.org", "api.crossref.org", "api.datacite.org",
    "openalex.org", "api.openalex.org", "opencitations.net", "api.opencitations.net",
)


def queries(items: DataFrame) -> DataFrame:
    """items as (item_key, q_title, q_norm, q_last, q_year): what records are compared with."""
    last = norm_person(first_author_lastname(F.col("creators")))
    return items.select("item_key", F.col("title").alias("q_title"), norm_title(F.col("title")).alias("q_norm"), F.coalesce(last, F.lit("")).alias("q_last"), K.item_year(F.col("date")).alias("q_year"))


def gated(records: DataFrame, items: DataFrame, least: float, gap: int) -> DataFrame:
    """records (item_key, title, authors, year, ...) with q_*, sim and author_ok: similar enough, right author and year, or nearly the same title."""
    joined = records.join(queries(items), "item_key").withColumn("sim", similarity_of(F.col("q_norm"), norm_title(F.col("title"))))
    joined = joined.withColumn("author_ok", author_matches(F.col("q_last"), norm_people(F.col("authors"))))
    close = F.col("sim") >= FORGIVEN
    wrong = (F.col("q_last") != "") & (F.size(F.coalesce("authors", F.array().cast(_STRINGS))) > 0) & ~F.col("author_ok")
    far = F.coalesce(F.abs(F.col("year") - F.col("q_year")) > gap, F.lit(False))
    return joined.where((F.col("sim") >= least) & (close | ~wrong) & (close | ~far))


def candidate_score(tiered: float = 8.0) -> Column:
    """The order of an item's records: similarity, venue, author and year."""
    known = F.when(F.col("venue.tier") != "", tiered).when(F.col("venue").isNotNull(), 3.0).otherwise(0.0)
    near = F.when(F.abs(F.col("year") - F.col("q_year")) <= 1, 1.0).otherwise(0.0)
    return F.col("sim") * 10 + known + F.when(F.col("author_ok") & (F.col("q_last") != ""), 2.0).otherwise(0.0) + near


def best(scored: DataFrame) -> DataFrame:
    return first_rows(scored, ["item_key"], F.desc("score"), F.col("route_ord"), F.col("pos"))


def choose(records: DataFrame, candidates: Column, hint: Column, index: Index, keys: tuple[str, ...] = ("item_key", "route_ord", "pos")) -> DataFrame:
    """records with selected and venue: the first candidate with a tier, else the last that is known, else the first."""
    records = settled(records)
    tries = records.select(*keys, F.posexplode(candidates).alias("_at", "value"), hint.alias("kind"))
    known = rank(tries, index).where("venue IS NOT NULL").select(F.col("value").alias("_v"), F.col("kind").alias("_k"), "venue")
    found = tries.join(known, (F.col("value") == F.col("_v")) & F.col("kind").eqNullSafe(F.col("_k")))
    tiered = F.col("venue.tier") != ""
    order = F.struct(F.when(tiered, 0).otherwise(1), F.when(tiered, F.col("_at")).otherwise(-F.col("_at")))
    picked = found.groupBy(*keys).agg(F.min_by(F.struct("value", "venue"), order).alias("_b"))
    joined = records.join(picked, list(keys), "left")
    return joined.withColumn("selected", F.coalesce("_b.value", F.get(candidates, F.lit(0)), F.lit(""))).withColumn("venue", F.col("_b.venue")).drop("_b")


def to_hits(df: DataFrame, source: Column | str, **columns: Column) -> DataFrame:
    """df as hits: item_key, route_ord, pos and the columns of HIT; those not given are null."""
    fields = T.StructType.fromDDL(HIT).fields
    values = {"source": F.lit(source) if isinstance(source, str) else source} | columns
    made = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return df.select("item_key", "route_ord", "pos", *made)


def _parsed(bronze: DataFrame, schema: str) -> DataFrame:
    return bronze.select("item_key", "route_ord", "pos", F.from_json("rec", schema).alias("r"))


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))


# ---------------------------------------------------------------- scholarly indexes


def _s2_kind() -> Column:
    pv, types = F.col("r.publicationVenue"), F.coalesce("r.publicationTypes", F.array().cast(_STRINGS))
    return F.coalesce(F.nullif(pv["type"], F.lit("")), F.when(F.array_contains(types, "JournalArticle"), "journal").when(F.array_contains(types, "Conference"), "conference").when(K.blank(pv["issn"]) != "", "journal"))


def _s2_hits(df: DataFrame, source: str, url: Column, score: Column, index: Index) -> DataFrame:
    """Records (r, ...) as hits; the abbreviation is the first alternate name with a tier, else the first in capitals."""
    names = F.coalesce("r.publicationVenue.alternate_names", F.array().cast(_STRINGS))
    kind = _s2_kind()
    tries = df.select("item_key", "route_ord", "pos", F.posexplode(names).alias("_at", "value"), kind.alias("kind"))
    known = rank(tries, index).where("venue.tier <> ''").select(F.col("value").alias("_v"), F.col("kind").alias("_k"))
    short = tries.join(known, (F.col("value") == F.col("_v")) & F.col("kind").eqNullSafe(F.col("_k"))).groupBy("item_key", "route_ord", "pos").agg(F.min_by("value", "_at").alias("_short"))
    capital = F.get(F.filter(names, lambda a: a.rlike("[A-Z]") & (a == F.upper(a)) & F.length(a).between(2, 16)), F.lit(0))
    name = F.coalesce(F.nullif(F.col("r.publicationVenue.name"), F.lit("")), F.col("r.venue"))
    return to_hits(
        df.join(short, ["item_key", "route_ord", "pos"], "left"), source, title=F.nullif(F.col("r.title"), F.lit("")), authors=F.transform("r.authors", lambda a: a["name"]), title_score=score,
        venue_raw=F.when(~K.is_nonvenue(name), name), year=F.col("r.year"), venue_type=kind, citation_count=F.col("r.citationCount"), influential_citations=F.col("r.influentialCitationCount"),
        external_doi=F.col("r.externalIds.DOI"), dblp_key=F.col("r.externalIds.DBLP"), evidence_url=url, issn=F.col("r.publicationVenue.issn"), abbrev=F.coalesce("_short", capital),
    )


def s2_batch(ids: DataFrame, bronze: DataFrame, index: Index) -> DataFrame:
    """Hits of a batch answer, matched by position: ids (item_key, arxiv_id, chunk, pos), bronze (chunk, pos, rec)."""
    parsed = ids.join(bronze.select("chunk", "pos", F.from_json("rec", S2).alias("r")), ["chunk", "pos"]).where("r.title IS NOT NULL OR r.venue IS NOT NULL")
    url = F.concat(F.lit("https://www.semanticscholar.org/arxiv/"), F.col("arxiv_id"))
    return _s2_hits(parsed.withColumn("route_ord", F.lit(0)), "semantic_scholar", url, F.lit(None).cast("double"), index)


def s2_title(items: DataFrame, bronze: DataFrame, index: Index) -> DataFrame:
    """The best title match; records of a later route count only if no earlier one has a tiered venue."""
    parsed = _parsed(bronze, S2).withColumns({"title": F.col("r.title"), "year": F.col("r.year"), "authors": F.transform("r.authors", lambda a: a["name"])})
    kept = gated(parsed, items, 0.78, 4)
    name = F.coalesce(F.nullif(F.col("r.publicationVenue.name"), F.lit("")), F.col("r.venue"))
    kept = choose(kept.where(~K.is_nonvenue(name)), F.array(name), _s2_kind(), index)
    done = kept.where("venue.tier <> ''").groupBy("item_key").agg(F.min("route_ord").alias("_done"))
    kept = kept.join(done, "item_key", "left").where("_done IS NULL OR route_ord <= _done")
    top = best(kept.withColumn("score", candidate_score()))
    url = F.when(K.blank(F.col("r.paperId")) != "", F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("r.paperId")))
    return _s2_hits(top, "semantic_scholar_title", F.coalesce(url, F.col("r.url")), F.col("sim"), index)


def crossref(items: DataFrame, bronze: DataFrame, index: Index, source: str = "crossref_title") -> DataFrame:
    """The best work; a preprint gives a hit without a venue that carries the DOIs of its versions."""
    authors = F.transform("r.author", lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    parsed = _parsed(bronze, CROSSREF).withColumns({"title": F.coalesce(M.first_text(F.col("r.title")), F.lit("")), "authors": authors, "year": K.parts_year("r"), "type": F.lower(K.blank(F.col("r.type")))})
    if source == "crossref_title":
        kept = gated(parsed, items, 0.80, 5)
    else:
        kept = parsed.join(queries(items), "item_key").withColumns({"sim": F.when(F.col("q_norm") == "", 1.0).otherwise(title_similarity(F.col("q_title"), F.col("title"))) if source == "doi_csl" else F.lit(1.0), "author_ok": F.lit(True)})
    versions = F.flatten(F.map_values(F.map_filter("r.relation", lambda k, v: k.isin("is-preprint-of", "is-version-of", "is-identical-to"))))
    related = F.coalesce(F.transform(F.filter(versions, lambda v: v["id-type"] == "doi"), lambda v: v["id"]), F.array().cast(_STRINGS))
    kept = kept.withColumn("related", related).withColumn("preprint", F.col("type").isin("posted-content", "preprint", "report"))
    none = F.array().cast(_STRINGS)
    names = _distinct(F.concat(F.array(F.col("r.event.name")), F.coalesce("r.short-container-title", none), F.coalesce("r.container-title", none)))
    kept = settled(kept.withColumn("names", names))
    tries = kept.where("NOT preprint").select("item_key", "route_ord", "pos", "type", F.col("r.DOI").alias("doi"), F.posexplode("names").alias("_at", "value"))
    free = rank(tries.select("value", F.lit(None).cast("string").alias("kind")), index).select("value", F.col("venue").alias("_free"))
    journal = rank(tries.where("type = 'journal-article'").select("value", F.lit("journal").alias("kind")), index).select("value", F.col("venue").alias("_journal"))
    series = (F.col("_free.kind") == "conference") & (F.col("value").rlike(r"(?i)(?<![A-Za-z0-9_])(?:conference|symposium|proceedings|congress)(?![A-Za-z0-9_])") | K.blank(F.col("doi")).rlike(r"(?i)^10\.1609/aaai\."))
    ranked = tries.join(free, "value", "left").join(journal, "value", "left")
    ranked = ranked.withColumn("venue", F.when(F.coalesce(series, F.lit(False)) | (F.col("type") != "journal-article"), F.col("_free")).otherwise(F.col("_journal"))).where("venue IS NOT NULL")
    tiered = F.col("venue.tier") != ""
    order = F.struct(F.when(tiered, 0).otherwise(1), F.when(tiered, F.col("_at")).otherwise(-F.col("_at")))
    picked = ranked.groupBy("item_key", "route_ord", "pos").agg(F.min_by(F.struct("value", "venue"), order).alias("_b"))
    kept = kept.join(picked, ["item_key", "route_ord", "pos"], "left").withColumn("selected", F.coalesce("_b.value", F.get("names", F.lit(0)), F.lit(""))).withColumn("venue", F.col("_b.venue"))
    kind = F.coalesce("venue.kind", F.when(F.col("type") == "journal-article", "journal").when(F.col("type").isin("proceedings-article", "book-chapter"), "conference"))
    kept = kept.withColumn("kind", kind).where((F.col("preprint") & (F.size("related") > 0)) | (~F.col("preprint") & ~K.is_nonvenue(F.col("selected")) & F.col("kind").isNotNull()))
    top = best(kept.withColumn("score", candidate_score()))
    published = lambda c: F.when(~F.col("preprint"), c)
    doi_url = F.when(K.blank(F.col("r.DOI")) != "", F.concat(F.lit("https://doi.org/"), F.col("r.DOI")))
    return to_hits(
        top, source, title=F.col("title"), authors=F.col("authors"), title_score=F.col("sim"), venue_raw=published(F.col("selected")), venue_candidates=published(F.col("names")), year=F.col("year"), venue_type=published(F.col("kind")),
        citation_count=published(F.col("r.is-referenced-by-count")), external_doi=published(F.nullif(F.col("r.DOI"), F.lit(""))), evidence_url=F.coalesce(F.col("r.URL"), doi_url), issn=published(M.first_text(F.col("r.ISSN"))),
        abbrev=published(M.first_text(F.col("r.short-container-title"))), publisher=published(F.col("r.publisher")), publication_date=published(K.parts_date("r")), volume=published(F.col("r.volume")), issue=published(F.col("r.issue")),
        pages=published(F.col("r.page")), related_dois=F.col("related"),
    )


def datacite(items: DataFrame, bronze: DataFrame, index: Index, source: str = "datacite_title") -> DataFrame:
    a = "r.attributes"
    names = F.transform(f"{a}.creators", lambda c: F.coalesce(F.nullif(c["name"], F.lit("")), F.concat_ws(" ", c["givenName"], c["familyName"])))
    parsed = _parsed(bronze, DATACITE).where(F.col(a).isNotNull()).withColumns({
        "title": F.coalesce(M.first_text(F.transform(f"{a}.titles", lambda t: t["title"])), F.lit("")), "authors": F.filter(names, lambda n: n != ""), "year": F.when(F.col(f"{a}.publicationYear") != 0, F.col(f"{a}.publicationYear"))})
    kept = gated(parsed, items, 0.80, 5) if source == "datacite_title" else parsed.join(queries(items), "item_key").withColumns({"sim": F.lit(1.0), "author_ok": F.lit(True)})
    related = F.flatten(F.transform(f"{a}.relatedItems", lambda i: F.transform(i["titles"], lambda t: t["title"])))
    venues = _distinct(F.concat(F.array(F.col(f"{a}.container.title")), F.coalesce(related, F.array().cast(_STRINGS))))
    kinds = F.concat_ws(" ", f"{a}.types.resourceType", f"{a}.types.resourceTypeGeneral", f"{a}.container.type")
    kept = kept.withColumn("names", venues).withColumn("hint", F.when(kinds.rlike("(?i)journal"), "journal").when(kinds.rlike("(?i)conference|proceedings"), "conference"))
    kept = choose(kept, F.col("names"), F.col("hint"), index).withColumn("kind", F.coalesce("venue.kind", "hint")).where(~K.is_nonvenue(F.col("selected")) & F.col("kind").isNotNull())
    top, doi = best(kept.withColumn("score", candidate_score())), F.coalesce(F.nullif(F.col(f"{a}.doi"), F.lit("")), F.col("r.id"))
    return to_hits(top, source, title=F.col("title"), authors=F.col("authors"), title_score=F.col("sim"), venue_raw=F.col("selected"), venue_candidates=F.col("names"), year=F.col("year"), venue_type=F.col("kind"),
                   citation_count=F.col(f"{a}.citationCount"), external_doi=doi, evidence_url=F.coalesce(F.nullif(F.col(f"{a}.url"), F.lit("")), F.concat(F.lit("https://doi.org/"), doi)), abbrev=F.col("venue.canonical"), publisher=F.col(f"{a}.publisher"))


def opencitations(items: DataFrame, bronze: DataFrame, index: Index) -> DataFrame:
    """The first record of each item that names a venue of a known kind; identifiers in brackets are cut off."""
    bare = lambda c: F.trim(F.regexp_replace(K.blank(c), r"\s+\[[^\]]*\]\s*$", ""))
    kinds = F.lower(K.blank(F.col("r.type")))
    parsed = _parsed(bronze, OPENCITATIONS).withColumns({"name": bare(F.col("r.venue")), "hint": F.when(kinds.contains("journal"), "journal").when(kinds.rlike("proceedings|conference"), "conference")})
    kept = choose(parsed.where(~K.is_nonvenue(F.col("name"))), F.array("name"), F.col("hint"), index).withColumn("kind", F.coalesce("venue.kind", "hint")).where("kind IS NOT NULL")
    top, doi = first_rows(kept, ["item_key"], F.col("route_ord"), F.col("pos")), K.found(K.blank(F.col("r.id")), r"(?i)(?:^|\s)doi:(\S+)")
    authors = F.filter(F.transform(F.split(K.blank(F.col("r.author")), r"\s*;\s*"), bare), lambda n: n != "")
    return to_hits(top, "opencitations_doi", title=K.blank(F.col("r.title")), authors=authors, title_score=F.lit(1.0), venue_raw=F.col("name"), venue_candidates=F.array("name"), year=K.year_from_text(F.col("r.pub_date")),
                   venue_type=F.col("kind"), external_doi=doi, evidence_url=F.concat(F.lit("https://doi.org/"), doi), abbrev=F.col("venue.canonical"), publisher=F.nullif(bare(F.col("r.publisher")), F.lit("")))


def openalex(items: DataFrame, bronze: DataFrame, index: Index, source: str = "openalex") -> DataFrame:
    """The best work; its sources are tried in order, and repositories are turned down after the choice."""
    listed = F.filter(F.concat(F.array(F.col("r.primary_location.source")), F.coalesce(F.transform("r.locations", lambda x: x["source"]), F.expr(f"cast(array() as array<{_SOURCE}>)"))), lambda s: K.blank(s["display_name"]) != "")
    first = F.filter(listed, lambda s, i: ~F.exists(F.slice(listed, F.lit(1), i), lambda o: o["display_name"] == s["display_name"]))
    parsed = _parsed(bronze, OPENALEX).withColumns({"title": F.coalesce(F.nullif(F.col("r.display_name"), F.lit("")), F.col("r.title"), F.lit("")), "year": F.col("r.publication_year"),
                                                     "authors": F.filter(F.transform("r.authorships", lambda x: x["author"]["display_name"]), lambda n: K.blank(n) != ""), "sources": first})
    kept = gated(parsed, items, 0.80, 5) if source == "openalex" else parsed.join(queries(items), "item_key").withColumns({"sim": F.lit(1.0), "author_ok": F.lit(True)})
    keys = ["item_key", "route_ord", "pos"]
    tries = kept.select(*keys, F.posexplode("sources").alias("_at", "s")).withColumns({"value": F.col("s.display_name"), "kind": F.when(F.col("s.type") == "journal", "journal")})
    known = rank(tries, index).where("venue IS NOT NULL").select(F.col("value").alias("_v"), F.col("kind").alias("_k"), "venue")
    found = tries.join(known, (F.col("value") == F.col("_v")) & F.col("kind").eqNullSafe(F.col("_k")))
    tiered = F.col("venue.tier") != ""
    picked = found.groupBy(*keys).agg(F.min_by(F.struct("s", "venue"), F.struct(F.when(tiered, 0).otherwise(1), F.when(tiered, F.col("_at")).otherwise(-F.col("_at")))).alias("_b"))
    kept = kept.join(picked, keys, "left").withColumn("s", F.coalesce("_b.s", F.get("sources", F.lit(0)))).withColumn("venue", F.col("_b.venue"))
    kind = F.coalesce("venue.kind", F.when(F.col("s.type").isin("journal", "conference"), F.col("s.type")).when(F.col("r.type") == "article", "journal"))
    kept = kept.withColumn("kind", kind).where(~K.is_nonvenue(F.col("s.display_name")) & F.col("kind").isNotNull() & ~(K.blank(F.col("s.type")) == "repository") & ~(K.blank(F.col("r.type")) == "preprint"))
    top = best(kept.withColumn("score", candidate_score()))
    return to_hits(top, source, title=F.col("title"), authors=F.col("authors"), title_score=F.col("sim"), venue_raw=F.col("s.display_name"), year=F.col("year"), venue_type=F.col("kind"), citation_count=F.col("r.cited_by_count"),
                   external_doi=K.strip_doi_url(F.col("r.doi")), evidence_url=F.col("r.id"), issn=F.col("s.issn_l"), abbrev=F.col("s.abbreviated_title"), publisher=F.col("s.host_organization_name"))


def dblp(items: DataFrame, bronze: DataFrame, index: Index) -> DataFrame:
    """The best bibliography record; venue and authors may be one or many. Preprint venues are rescued by their key's slug."""
    rec = F.col("rec")
    at = lambda k: F.get_json_object(rec, f"$.{k}")
    venue = F.coalesce(F.get_json_object(rec, "$.venue[0]"), F.when(~K.blank(at("venue")).startswith("["), at("venue")))
    one, many = F.get_json_object(rec, "$.authors.author.text"), F.from_json(F.get_json_object(rec, "$.authors.author"), "array<struct<text:string>>")
    authors = F.when(K.blank(F.get_json_object(rec, "$.authors.author")).startswith("["), F.transform(many, lambda a: K.blank(a["text"]))).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(_STRINGS))
    parsed = bronze.select("item_key", "route_ord", "pos", K.blank(at("title")).alias("title"), F.when(at("year").rlike(r"^\d+$"), at("year").cast("int")).alias("year"), authors.alias("authors"), venue.alias("name"), K.blank(at("type")).alias("type"),
                           at("key").alias("key"), at("url").alias("url"), at("doi").alias("doi"), at("publisher").alias("publisher"))
    parsed = first_rows(parsed, ["item_key", "key", "url", "title", "year", "name"], F.col("route_ord"), F.col("pos"))
    joined = parsed.join(queries(items), "item_key").withColumn("sim", similarity_of(F.col("q_norm"), norm_title(F.col("title")))).withColumn("author_ok", author_matches(F.col("q_last"), norm_people(F.col("authors"))))
    near = F.coalesce(F.abs(F.col("year") - F.col("q_year")) <= 1, F.lit(False))
    close, wrong = F.col("sim") >= FORGIVEN, (F.col("q_last") != "") & (F.size("authors") > 0) & ~F.col("author_ok")
    far = F.coalesce(F.abs(F.col("year") - F.col("q_year")) > 5, F.lit(False))
    kept = joined.where(((F.col("sim") >= 0.82) | ((F.col("sim") >= 0.60) & F.col("author_ok") & near)) & (close | ~wrong) & (close | ~far))
    hint = F.when(F.col("type").rlike("(?i)conference|workshop"), "conference").when(F.col("type").rlike("(?i)journal"), "journal")
    kept = kept.withColumn("hint", hint).withColumn("names", F.when(~K.is_nonvenue(F.col("name")), F.array("name")).otherwise(F.array().cast(_STRINGS)))
    kept = choose(kept, F.col("names"), F.col("hint"), index).withColumn("_slug", F.coalesce("key", "url"))
    slugs = lookup_slug(kept.select(F.col("_slug").alias("url")), index).where("NOT match.ambiguous").select(F.col("url").alias("_slug"), F.col("match").alias("_m"))
    kept = kept.join(slugs, "_slug", "left").withColumn("_rescued", K.is_nonvenue(F.col("name")) & F.col("_m").isNotNull())
    kept = kept.withColumn("name", F.when(F.col("_rescued"), F.col("_m.canonical")).otherwise(F.col("name"))).where(~K.is_nonvenue(F.col("name")))
    kind = F.coalesce(F.when(F.col("_rescued"), F.col("_m.kind")), F.col("venue.kind"), F.col("hint"))
    own = F.when(F.col("_rescued"), F.col("_m.kind")).otherwise(F.col("hint"))
    tier = F.when(F.col("_rescued") | (F.col("venue.tier") != ""), 10.0).when(F.col("venue").isNotNull(), 3.0).otherwise(0.0)
    score = F.col("sim") * 10 + F.when(F.col("author_ok") & (F.col("q_last") != ""), 2.0).otherwise(0.0) + F.when(near, 1.0).otherwise(0.0) + tier + F.when(own == "conference", 1.0).otherwise(0.0)
    top = best(kept.withColumn("kind", kind).withColumn("score", score))
    short = F.coalesce(F.when(F.col("_rescued"), F.col("_m.canonical")), F.col("venue.canonical"), F.col("name"))
    return to_hits(top, "dblp", title=F.col("title"), authors=F.col("authors"), title_score=F.col("sim"), venue_raw=F.col("name"), year=F.col("year"), venue_type=F.col("kind"), external_doi=F.col("doi"), dblp_key=F.col("key"),
                   evidence_url=F.col("url"), abbrev=short, publisher=F.col("publisher"))


def openreview(items: DataFrame, bronze: DataFrame, index: Index) -> DataFrame:
    """The best root note of the first route that has one: nearly the same title, the first author, an accepted venue that is known."""
    rec = F.col("rec")
    at = lambda k: F.get_json_object(rec, f"$.{k}")
    content = lambda k: F.coalesce(at(f"content.{k}.value"), F.when(~K.blank(at(f"content.{k}")).startswith("{"), at(f"content.{k}")))
    people = content("authors")
    authors = F.when(people.startswith("["), F.from_json(people, _STRINGS)).when(K.blank(people) != "", F.array(people)).otherwise(F.array().cast(_STRINGS))
    notes = bronze.where((K.blank(at("replyto")) == "") & ((K.blank(at("forum")) == "") | (at("id") == at("forum"))))
    parsed = notes.select("item_key", "route_ord", "pos", K.blank(content("title")).alias("title"), authors.alias("authors"), F.trim(K.blank(F.coalesce(content("venueid"), content("venue_id")))).alias("venue_id"), F.trim(K.blank(content("venue"))).alias("venue_text"),
                          at("pdate").cast("double").alias("pdate"), F.coalesce(F.nullif(F.trim(content("doi")), F.lit("")), F.nullif(F.trim(content("DOI")), F.lit(""))).alias("doi"), F.coalesce(at("forum"), at("id")).alias("forum"))
    status = F.lower(F.coalesce(F.try_url_decode(F.concat_ws(" ", "venue_id", "venue_text")), F.concat_ws(" ", "venue_id", "venue_text")))
    turned = F.exists(F.array(*[F.lit(p) for p in REVIEW_REJECTS]), lambda p: F.contains(status, p))
    kept = parsed.where((F.col("venue_id") != "") & ~turned).join(queries(items), "item_key").withColumn("sim", title_jaccard(F.col("q_title"), F.col("title"))).where("sim >= 0.88")
    first = F.coalesce(F.get(norm_people(F.col("authors")), F.lit(0)), F.lit(""))
    kept = kept.withColumn("_first", first).withColumn("author_ok", (F.col("q_last") == "") | F.contains(F.concat(F.lit(" "), F.col("_first"), F.lit(" ")), F.concat(F.lit(" "), F.col("q_last"), F.lit(" "))))
    kept = kept.where((F.col("q_last") == "") | F.when(F.size("authors") > 0, F.col("author_ok")).otherwise(F.col("sim") >= 0.98))
    parts = F.filter(F.split("venue_id", "/"), lambda p: p != "")
    host = F.regexp_replace(F.get(parts, F.lit(0)), r"(?i)\.(?:cc|org|net|com|edu)$", "")
    tries = _distinct(F.concat(F.array(host), parts, F.array("venue_text", F.translate("venue_id", "/_", "  "))))
    kept = kept.withColumn("names", tries)
    exploded = kept.select("item_key", "route_ord", "pos", F.posexplode("names").alias("_at", "value")).withColumn("kind", F.lit(None).cast("string"))
    known = rank(exploded, index).where("venue IS NOT NULL").select("value", "venue")
    picked = exploded.join(known, "value").groupBy("item_key", "route_ord", "pos").agg(F.min_by("venue", "_at").alias("venue"))  # the first that is known, tier or not
    kept = kept.join(picked, ["item_key", "route_ord", "pos"]).withColumn("score", F.col("sim") + F.when(F.col("author_ok") & (F.col("q_last") != ""), 0.1).otherwise(0.0))
    top = first_rows(kept, ["item_key"], F.col("route_ord"), F.desc("score"), F.col("pos"))
    url = F.concat(F.lit("https://openreview.net/forum?id="), F.url_encode("forum"))
    return to_hits(top, "openreview", title=F.col("title"), authors=F.col("authors"), title_score=F.col("sim"), venue_raw=F.col("venue.canonical"), year=K.review_year(F.col("venue_id"), F.col("venue_text"), F.col("pdate")), venue_type=F.col("venue.kind"),
                   external_doi=F.col("doi"), evidence_url=F.coalesce(url, F.lit("https://openreview.net")), abbrev=F.col("venue.canonical"))


# ---------------------------------------------------------------- preprint metadata


def arxiv_entries(bronze: DataFrame) -> DataFrame:
    """(arxiv_id, title, comment, journal_ref, doi, published_year) of Atom feeds (xml)."""
    entries = bronze.select(F.explode(M.xml_blocks(F.col("xml"), "entry")).alias("e"))
    aid = K.found(M.xml_tag(F.col("e"), "id"), r"(?i)(?:abs/|arxiv[:.])?(\d{4}\.\d{4,5})(?:v\d+)?")
    tag = lambda n: M.xml_tag(F.col("e"), n)
    return entries.select(aid.alias("arxiv_id"), tag("title").alias("title"), tag("arxiv:comment").alias("comment"), tag("arxiv:journal_ref").alias("journal_ref"),
                          F.nullif(tag("arxiv:doi"), F.lit("")).alias("doi"), K.year_from_text(tag("published")).alias("published_year")).where("arxiv_id IS NOT NULL")


def arxiv_pages(bronze: DataFrame) -> DataFrame:
    """The same of abstract pages (arxiv_id, html), which must be of the id asked for and have a title."""
    h = F.col("html")
    meta = lambda *n: K.blank(M.first_text(M.meta_values(h, *n)))
    heading = F.regexp_replace(M.html_to_text(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), r"(?i)^Title:\s*", "")
    none = F.lit(None).cast("string")
    own = meta("citation_arxiv_id")
    ok = (own == "") | (K.arxiv_id(own, none, none, none) == F.col("arxiv_id"))
    doi = F.coalesce(K.formal_doi(meta("citation_doi")), K.formal_doi(M.table_cell(h, "DOI", "doi")))
    return bronze.where(ok).select("arxiv_id", F.coalesce(F.nullif(M.decode_html(meta("citation_title")), F.lit("")), heading).alias("title"), M.table_cell(h, "Comments?", "comments").alias("comment"),
                                   M.table_cell(h, "Journal reference", "jref").alias("journal_ref"), doi.alias("doi"), K.item_year(meta("citation_date", "citation_publication_date")).alias("published_year")).where("title <> ''")


def preprint_hits(ids: DataFrame, metadata: DataFrame, index: Index) -> DataFrame:
    """Hits of journal references, and of comments that speak of acceptance; ids: item_key, arxiv_id."""
    accepted = F.col("comment").rlike(ACCEPTED) & ~F.col("comment").rlike(NOT_ACCEPTED)
    both = F.array(F.struct(F.lit("arxiv_journal_ref").alias("source"), F.col("journal_ref").alias("text")), F.struct(F.lit("arxiv_comment").alias("source"), F.when(accepted, F.col("comment")).alias("text")))
    each = ids.join(metadata, "arxiv_id").select("item_key", "arxiv_id", "doi", "published_year", F.posexplode(both).alias("pos", "t")).where("t.text <> ''").withColumn("route_ord", F.lit(0))
    asked = each.withColumns({"value": F.col("t.text"), "kind": F.when(F.col("t.text").rlike("(?i)journal|transactions|letters|review"), "journal")})
    known = rank(asked, index).where("venue IS NOT NULL").select(F.col("value").alias("_v"), F.col("kind").alias("_k"), "venue")
    found = asked.join(known, (F.col("value") == F.col("_v")) & F.col("kind").eqNullSafe(F.col("_k")))
    return to_hits(found, F.col("t.source"), title_score=F.lit(1.0), authors=F.array().cast(_STRINGS), venue_raw=F.col("venue.canonical"), year=F.coalesce(K.year_from_text(F.col("value")), F.col("published_year")), venue_type=F.col("venue.kind"),
                   external_doi=F.col("doi"), evidence_url=F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")), abbrev=F.col("venue.canonical"), note=F.col("value"))


def existing(items: DataFrame, index: Index) -> DataFrame:
    """The item's own venue as a hit, if it is known; items with their bibliographic fields."""
    some = lambda *cs: F.filter(F.array(*[F.nullif(F.col(c), F.lit("")) for c in cs]), lambda v: v.isNotNull())
    conference, journal = some("conferenceName", "proceedingsTitle"), some("journalAbbreviation", "publicationTitle")
    hint = F.when((F.col("itemType") == "conferencePaper") | (F.size(conference) > 0), "conference").when((F.col("itemType") == "journalArticle") | (F.size(journal) > 0), "journal")
    names = F.when(hint == "conference", conference).when(hint == "journal", journal).otherwise(F.array().cast(_STRINGS))
    asked = items.withColumns({"hint": hint, "names": names, "route_ord": F.lit(0), "pos": F.lit(0)})
    kept = choose(asked, F.col("names"), F.col("hint"), index).where("venue IS NOT NULL")
    short = F.coalesce(F.when(F.col("hint") == "conference", F.nullif(F.col("conferenceName"), F.lit(""))).otherwise(F.nullif(F.col("journalAbbreviation"), F.lit(""))), F.col("venue.canonical"))
    return to_hits(kept, "zotero_metadata", title=K.blank(F.col("title")), authors=F.array().cast(_STRINGS), title_score=F.lit(1.0), venue_raw=F.col("selected"), venue_candidates=F.col("names"), year=K.item_year(F.col("date")), venue_type=F.col("venue.kind"),
                   external_doi=F.nullif(F.col("DOI"), F.lit("")), evidence_url=F.nullif(F.col("url"), F.lit("")), issn=F.nullif(F.col("ISSN"), F.lit("")), abbrev=short, publisher=F.nullif(F.col("publisher"), F.lit("")))


# ---------------------------------------------------------------- the web


def web_results_json(bronze: DataFrame) -> DataFrame:
    """(item_key, pos, url, title, snippet, provider) of a search answer (rec) with web.results."""
    results = F.from_json(F.get_json_object("rec", "$.web.results"), "array<struct<url:string,title:string,description:string,extra_snippets:array<string>>>")
    each = bronze.select("item_key", F.posexplode(results).alias("pos", "x")).where("x.url <> ''")
    snippet = F.concat_ws(" ", F.filter(F.concat(F.array("x.description"), F.coalesce("x.extra_snippets", F.array().cast(_STRINGS))), lambda s: K.blank(s) != ""))
    return each.select("item_key", "pos", "x.url", K.blank(F.col("x.title")).alias("title"), snippet.alias("snippet"), F.lit("brave").alias("provider"))


def web_results_html(bronze: DataFrame, limit: int = 30) -> DataFrame:
    """The same of a result page (item_key, url, html): its links, unwrapped, without skipped hosts, the first of each url."""
    links = M.anchors(bronze)
    wrapped = K.host_of(F.col("link")).rlike(r"(?:^|\.)duckduckgo\.com$")
    inner = F.try_url_decode(F.try_parse_url(F.col("link"), F.lit("QUERY"), F.lit("uddg")))
    found = links.withColumn("to", F.when(wrapped, F.coalesce(inner, "link")).otherwise(F.col("link"))).withColumn("host", K.host_of(F.col("to")))
    kept = found.where((F.col("host") != "") & ~F.col("host").endswith("duckduckgo.com") & ~F.col("host").isin(*SKIPPED_HOSTS) & F.col("to").rlike("(?i)^https?:"))
    first = first_rows(kept, ["item_key", "to"], F.col("pos"))
    top = first_rows(first, ["item_key"], F.col("pos"), n=limit)
    return top.select("item_key", "pos", F.col("to").alias("url"), F.col("link_text").alias("title"), F.lit("").alias("snippet"), F.lit("duckduckgo").alias("provider"))


def with_plausibility(results: DataFrame, items: DataFrame) -> DataFrame:
    """results with combined, plausibility, official and total, the order in which they are worth a page."""
    joined = results.join(queries(items), "item_key").withColumn("combined", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    score = F.greatest(title_similarity(F.col("q_title"), F.col("title")), title_similarity(F.col("q_title"), F.col("combined")))
    joined = joined.withColumns({"plausibility": score, "official": K.is_official_host(K.host_of(F.col("url"))), "_person": norm_person(F.col("combined"))})
    author = F.when((F.col("q_last") != "") & F.contains("_person", F.col("q_last")), 1.0).otherwise(0.0)
    total = F.col("plausibility") * 10 + F.when(F.col("official"), 6.0).otherwise(0.0) + author + F.when(F.col("combined").rlike(WEB_ACCEPTED), 2.0).otherwise(0.0)
    return joined.withColumn("total", total).drop("_person")


def plausible(results: DataFrame, items: DataFrame, pages: int = 5) -> DataFrame:
    """The results worth a page, with their place among them: similar enough or official, the first of each url, the best few of each item."""
    first = first_rows(with_plausibility(results, items), ["item_key", "url"], F.col("pos"))
    ranked = first.where((F.col("plausibility") >= 0.55) | F.col("official")).withColumn("place", F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc("total"), F.col("pos"))))
    return ranked.where(F.col("place") <= pages)


def asked_until_official(answers: DataFrame, queries_most: int = 3) -> DataFrame:
    """answers (item_key, query_ord, pos, url, title, snippet, provider) of the first queries of each item: up to the first with a result on an official host, queries_most at most; pos runs over them."""
    found = K.is_official_host(K.host_of(F.col("url")))
    stop = F.min(F.when(found, F.col("query_ord"))).over(Window.partitionBy("item_key"))
    kept = answers.where(F.col("query_ord") < queries_most).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("query_ord") <= F.col("_stop")))
    order = Window.partitionBy("item_key").orderBy("query_ord", "provider", "pos", "url")
    return kept.withColumn("pos", F.row_number().over(order) - 1).drop("_stop", "query_ord")


def web_search(items: DataFrame, answers: DataFrame, pages: DataFrame, index: Index, deep: bool = False) -> DataFrame:
    """The best hit of each item from captured search answers (item_key, query_ord, pos, url, title, snippet, provider) and captured pages (url, html).

    Results are visited in the order of plausible(). A page of an official host counts as official_web and ends the
    visit; other pages count as <provider>_web; a result of which no page counts can count by its snippet. Of several hits the best by score stays.
    """
    ranked = settled(plausible(asked_until_official(answers, 4 if deep else 3), items, 10 if deep else 5).drop("q_title", "q_norm", "q_last", "q_year"))
    visited = ranked.where((F.col("plausibility") >= 0.65) | F.col("official"))
    first = first_rows(pages.where("url IS NOT NULL"), ["url"], F.xxhash64("html"))
    seen = settled(visited.join(first, "url").select("item_key", F.lit(0).alias("route_ord"), F.col("place").alias("pos"), "url", "html", "title", "snippet", "provider", "official"))
    own = page_hits(items, seen.where("official"), index)
    others = page_hits(items, seen.where("NOT official"), index, source=F.concat("provider", F.lit("_web")), known=False)
    formal = settled(own.unionByName(others))
    rest = visited.join(formal.select("item_key", F.col("pos").alias("place")), ["item_key", "place"], "left_anti")
    texts = snippet_hits(rest.withColumn("pos", F.col("place")), items, index)
    hits = formal.unionByName(texts).withColumn("hit_ord", F.col("pos").cast("long"))
    scored = with_venue(settled(hits), index).withColumn("_own", hit_score())
    official = F.min(F.when(F.col("source") == "official_web", F.col("pos"))).over(Window.partitionBy("item_key"))
    kept = scored.withColumn("_stop", official).where(F.col("_stop").isNull() | (F.col("pos") == F.col("_stop")))
    return first_rows(kept, ["item_key"], F.desc("_own"), F.col("pos")).select(*formal.columns)


def program_hits(items: DataFrame, pages: DataFrame, index: Index) -> DataFrame:
    """Hits of captured program pages of a publisher's events (item_key, route_ord, pos, url, html): the url tells venue and year, the page must hold title and author."""
    joined = pages.withColumn("from_url", K.official_venue(F.col("url"))).where("from_url IS NOT NULL").join(queries(items), "item_key").withColumn("text", M.html_to_text(F.col("html")))
    context = paper_context(F.col("text"), F.col("q_title"), 1800)
    held = joined.where(M.page_contains(norm_title(F.col("text")), F.col("q_title"), F.col("q_last"), context)).select(*pages.columns)
    return best(page_hits(items, held, index, source="usenix_official").withColumn("score", F.col("title_score")))


def snippet_hits(results: DataFrame, items: DataFrame, index: Index) -> DataFrame:
    """Hits of search snippets alone: nearly the whole title, the author, words of acceptance, one venue."""
    joined = results.join(queries(items), "item_key").withColumn("combined", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    joined = joined.withColumns({"sim": title_similarity(F.col("q_title"), F.col("combined")), "_person": norm_person(F.col("combined"))})
    kept = joined.where((F.col("sim") >= 0.94) & F.col("combined").rlike(WEB_ACCEPTED) & ~F.col("combined").rlike(WEB_NOT_ACCEPTED) & ((F.col("q_last") == "") | F.contains("_person", F.col("q_last"))))
    found = find_in_text(kept.select(F.col("combined").alias("text")), index)
    rows = small(index.rows.select("row_ord", "canonical", F.col("kind").alias("row_kind"), F.col("publisher").alias("row_publisher")))
    named = kept.join(found.withColumnRenamed("text", "combined"), "combined").join(rows, "row_ord").withColumn("route_ord", F.lit(0))
    year = F.coalesce(K.year_from_text(F.col("combined")), F.col("q_year"))
    return to_hits(named, F.concat("provider", F.lit("_snippet")), title=F.col("q_title"), authors=F.array().cast(_STRINGS), title_score=F.col("sim"), venue_raw=F.col("canonical"), venue_candidates=F.array("canonical"), venue_evidence=F.lit("snippet"),
                   venue_match_quality=F.col("quality"), year=year, venue_type=F.col("row_kind"), evidence_url=F.col("url"), abbrev=F.col("canonical"), publisher=F.nullif(F.col("row_publisher"), F.lit("")))


def page_hits(items: DataFrame, pages: DataFrame, index: Index, source: Column | str = "official_web", known: bool = True) -> DataFrame:
    """Hits of paper pages (item_key, route_ord, pos, url, html, and the title and snippet of the search result if there are any): the page must hold the title and author and name a venue that is known.

    Title, author and, if the page names no venue, the venue are sought in a wide context of the title. Pages that are not formal need
    words of acceptance; words of its lack turn a page down; both are sought close to the title and in the search result. Scholarly JSON-LD
    records of official pages add their title, the names of what they are part of, and their date. known: whether only official hosts count.
    """
    h = F.col("html")
    meta = lambda *n: M.meta_values(h, *n)
    one = lambda *n: M.first_text(meta(*n))
    base = pages.where(K.is_official_host(K.host_of(F.col("url")))) if known else pages
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<nav\b[^>]*>.*?</nav>", " "), r"(?is)<footer\b[^>]*>.*?</footer>", " "), r"(?is)<aside\b[^>]*>.*?</aside>", " ")
    joined = base.withColumn("html", clean).join(queries(items), "item_key").withColumn("text", M.html_to_text(h))
    context = paper_context(F.col("text"), F.col("q_title"))
    own = F.transform(M.json_ld(F.col("html")), lambda r: F.struct(F.coalesce(F.nullif(F.get_json_object(r, "$.headline"), F.lit("")), F.get_json_object(r, "$.name"), F.lit("")).alias("name"), r.alias("r")))
    joined = joined.withColumn("ld", own if known else F.array().cast("array<struct<name:string,r:string>>")).withColumn("context", context)
    part = F.filter("ld", lambda x: (x["name"] != "") & (M._plain_similarity(F.col("q_title"), x["name"]) >= 0.90))
    chain = F.flatten(F.transform(part, lambda x: F.array(*[F.get_json_object(x["r"], "$" + ".isPartOf" * n + ".name") for n in range(1, 5)])))
    joined = joined.withColumns({"part_of": F.array_compact(chain), "ld_dates": F.array_compact(F.transform(part, lambda x: F.get_json_object(x["r"], "$.datePublished")))})
    joined = joined.withColumns({
        "titles": F.concat(meta("citation_title", "dc.title", "dcterms.title"), F.filter(F.transform("ld", lambda x: x["name"]), lambda v: v != "")), "authors": meta("citation_author", "dc.creator", "dcterms.creator", "author"), "from_url": K.official_venue(F.col("url")),
        "declared": meta("citation_conference_title", "citation_journal_title", "citation_book_title", "dc.source", "dcterms.ispartof", "prism.publicationname"), "_norm_text": norm_title(F.col("text"))})
    near_title = F.greatest(M.best_title_score(h, F.col("q_title")), title_similarity(F.col("q_title"), F.col("context")))
    joined = joined.withColumn("title_score", F.when((F.col("q_norm") != "") & F.contains("_norm_text", F.col("q_norm")), 1.0).otherwise(near_title))
    declared_ok = (F.size("titles") == 0) | F.exists("titles", lambda t: M._plain_similarity(F.col("q_title"), t) >= 0.90)
    person = author_matches(F.col("q_last"), norm_people(F.col("authors"))) | F.contains(norm_person(F.col("context")), F.col("q_last"))
    kept = joined.where(declared_ok & (F.col("title_score") >= 0.88) & ((F.col("q_last") == "") | person | (F.col("title_score") >= 0.98)))
    names = _distinct(F.concat(F.array(F.col("from_url.venue")), F.col("declared"), F.col("part_of")))
    kept = choose(kept.withColumn("names", names), F.col("names"), F.lit(None).cast("string"), index)
    kept = kept.withColumn("about", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "snippet") if c in pages.columns], "context"))
    body = kept.where((F.size("names") == 0) & F.col("venue").isNull()).select(F.col("about").alias("text")).distinct()
    rows = small(index.rows.select("row_ord", F.col("canonical").alias("row_name"), F.col("kind").alias("row_kind"), F.col("publisher").alias("row_publisher")))
    in_text = find_in_text(body, index).join(rows, "row_ord").select(F.col("text").alias("about"), "row_name", "row_kind", "row_publisher", "quality")
    kept = kept.join(in_text, "about", "left").withColumn("structured", F.size("names") > 0)
    kept = kept.where(F.col("venue").isNotNull() | (~F.col("structured") & F.col("row_name").isNotNull()))
    formal = K.is_official_host(K.host_of(F.col("url"))) | F.col("url").rlike("(?i)/presentation/|accepted-papers|technical-sessions|proceedings")
    proof = F.when((F.size("titles") > 0) & formal, F.concat_ws(" ", meta("citation_conference_title", "citation_journal_title", "citation_section"))).otherwise(F.concat_ws(" ", *[c for c in ("title", "snippet") if c in pages.columns], paper_context(F.col("text"), F.col("q_title"), 900)))
    kept = kept.where(~proof.rlike(WEB_NOT_ACCEPTED) & (formal | proof.rlike(WEB_ACCEPTED)))
    dates = F.array_compact(F.transform(F.concat(F.col("ld_dates"), meta("citation_publication_date", "citation_date", "dc.date", "dcterms.date", "article:published_time", "date"), F.array("url")), lambda v: F.nullif(F.regexp_extract(v, "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")))
    near = F.get(F.filter(dates, lambda y: F.col("q_year").isNull() | (F.abs(y - F.col("q_year")) <= 3)), F.lit(0))
    doi = one("citation_doi", "dc.identifier", "dcterms.identifier")
    first, last, day = one("citation_firstpage"), one("citation_lastpage"), one("citation_publication_date", "citation_date", "dc.date.issued")
    return to_hits(
        kept, source, title=F.coalesce(F.get("titles", F.lit(0)), F.col("q_title")), authors=F.col("authors"), title_score=F.col("title_score"), venue_raw=F.when(F.col("venue").isNotNull(), F.col("selected")).otherwise(F.col("row_name")), venue_candidates=F.col("names"),
        year=F.coalesce("from_url.year", near, "q_year"), venue_type=F.coalesce("venue.kind", "row_kind"), venue_evidence=F.when(F.col("structured"), "structured").otherwise("page_text"), venue_match_quality=F.when(~F.col("structured"), F.col("quality")),
        external_doi=F.when(~K.is_arxiv_doi(doi), K.strip_doi_url(doi)), evidence_url=F.col("url"), issn=one("citation_issn"), abbrev=F.coalesce("venue.canonical", "row_name"), publisher=F.nullif(F.coalesce("venue.publisher", "row_publisher"), F.lit("")),
        publication_date=F.when(day.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.translate(day, "/", "-")), volume=one("citation_volume"), issue=one("citation_issue"), pages=F.when(first.isNotNull(), F.concat_ws("-", first, last)), track=one("citation_section"),
    )


#: Providers by name; a caller may replace one or pass None to leave it out. Stages run in order.
PROVIDERS: dict[str, Provider] = {
    "crossref_title": crossref, "dblp": dblp, "official_web": page_hits, "usenix_official": program_hits, "openreview": openreview, "s2_title": s2_title, "datacite_title": datacite, "openalex": openalex, "opencitations": opencitations,
}
STAGES = (("crossref_title", "dblp", "official_web", "usenix_official"), ("openreview",), ("s2_title", "datacite_title", "openalex", "opencitations"))
