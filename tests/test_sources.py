"""Source records to hits, and catalogue listings to rows."""

import json

import pytest
from pyspark.sql import functions as F

from quirefold.operators import catalogue as C
from quirefold.plans import fixture
from quirefold.sources import providers as P
from tests.test_engine import ITEM, item

TITLE = "Deep Zeta Learning of Things"
BRONZE = "item_key string, route_ord int, pos int, rec string"


@pytest.fixture(scope="module")
def index(spark):
    return fixture.index(spark)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([item("a", TITLE, date="2023")], ITEM).cache()


def bronze(spark, *records):
    return spark.createDataFrame([("a", 0, i, json.dumps(r)) for i, r in enumerate(records)], BRONZE)


def one(df):
    rows = df.collect()
    assert len(rows) <= 1
    return rows[0] if rows else None


def test_datacite(spark, index, items):
    good = {"id": "10.5/a", "attributes": {"titles": [{"title": TITLE}], "creators": [{"name": "Ann Smith"}], "publicationYear": 2023, "container": {"title": "Transactions on Winning", "type": "Journal"}, "citationCount": 3}}
    other = {"id": "x", "attributes": {"titles": [{"title": "Quite another work"}], "container": {"title": "ZLearn"}}}
    hit = one(P.datacite(items, bronze(spark, other, good), index))
    assert (hit["venue_raw"], hit["venue_type"], hit["external_doi"], hit["title_score"]) == ("Transactions on Winning", "journal", "10.5/a", 1.0)


def test_openalex_turns_repositories_down(spark, index, items):
    work = {"display_name": TITLE, "publication_year": 2023, "doi": "https://doi.org/10.1/z", "type": "article", "authorships": [{"author": {"display_name": "Ann Smith"}}], "primary_location": {"source": {"display_name": "Some Archive", "type": "repository"}}}
    assert one(P.openalex(items, bronze(spark, work), index)) is None
    work["locations"] = [{"source": {"display_name": "International Conference on Zeta Learning", "type": "conference", "issn_l": "1-2"}}]
    hit = one(P.openalex(items, bronze(spark, work), index))
    assert (hit["venue_raw"], hit["venue_type"], hit["external_doi"], hit["issn"]) == ("International Conference on Zeta Learning", "conference", "10.1/z", "1-2")


def test_opencitations(spark, index, items):
    hit = one(P.opencitations(items, bronze(spark, {"id": "doi:10.9/q meta:br/1", "title": TITLE, "author": "Smith, Ann [orcid:1]; Doe, J", "pub_date": "2023-05", "venue": "ZLearn [issn:1]", "type": "proceedings article"}), index))
    assert (hit["external_doi"], hit["authors"], hit["year"], hit["venue_raw"]) == ("10.9/q", ["Smith, Ann", "Doe, J"], 2023, "ZLearn")


def test_openreview(spark, index, items):
    note = lambda **c: {"id": "n", "forum": "n", "pdate": 1_690_000_000, "content": {k: {"value": v} for k, v in c.items()}}
    bad = note(title=TITLE, authors=["Ann Smith"], venueid="ZLearn.org/2023/Conference", venue="Submitted to ZLearn 2023")
    good = note(title=TITLE, authors=["Ann Smith"], venueid="ZLearn.org/2023/Conference", venue="ZLearn 2023 poster")
    assert one(P.openreview(items, bronze(spark, bad), index)) is None
    assert one(P.openreview(items, bronze(spark, note(title=TITLE, authors=["Bob Jones"], venueid="ZLearn.org/2023/Conference")), index)) is None
    hit = one(P.openreview(items, bronze(spark, bad, good), index))
    assert (hit["venue_raw"], hit["year"], hit["evidence_url"]) == ("ZLearn", 2023, "https://openreview.net/forum?id=n")


def test_s2_title_and_batch(spark, index, items):
    rec = {"paperId": "p", "title": TITLE, "venue": "arXiv.org", "year": 2023, "publicationTypes": ["Conference"], "citationCount": 7, "authors": [{"name": "Ann Smith"}], "publicationVenue": {"name": "International Conference on Zeta Learning", "alternate_names": ["other", "ZLearn"]}}
    hit = one(P.s2_title(items, bronze(spark, rec), index))
    assert (hit["abbrev"], hit["venue_type"], hit["citation_count"], hit["evidence_url"]) == ("ZLearn", "conference", 7, "https://www.semanticscholar.org/paper/p")
    ids = spark.createDataFrame([("a", "2301.00002", 0, 1)], "item_key string, arxiv_id string, chunk int, pos int")
    answers = spark.createDataFrame([(0, 0, "null"), (0, 1, json.dumps(rec))], "chunk int, pos int, rec string")
    assert one(P.s2_batch(ids, answers, index))["title_score"] is None


def test_dblp_rescues_by_slug(spark, index, items):
    rec = {"title": TITLE, "venue": "CoRR", "year": "2023", "type": "Informal", "key": "conf/sndx/S23", "authors": {"author": [{"text": "Ann Smith"}, {"text": "Bo Li"}]}}
    hit = one(P.dblp(items, bronze(spark, rec), index))
    assert (hit["venue_raw"], hit["venue_type"], hit["authors"]) == ("SNDX", "conference", ["Ann Smith", "Bo Li"])
    assert one(P.dblp(items, bronze(spark, rec | {"key": "journals/corr/x"}), index)) is None


def test_preprint_pages(spark, index):
    page = f'<meta name="citation_title" content="{TITLE}"><meta name="citation_arxiv_id" content="2301.00002"><meta name="citation_date" content="2023/01/05"><table><tr><td>Comments:</td><td>Accepted at ZLearn 2024</td></tr><tr><td>Journal reference:</td><td>Submitted</td></tr></table>'
    pages = spark.createDataFrame([("2301.00002", page), ("2301.00003", page)], "arxiv_id string, html string")
    meta = P.arxiv_pages(pages)
    row = one(meta)
    assert (row["arxiv_id"], row["title"], row["comment"], row["published_year"]) == ("2301.00002", TITLE, "Accepted at ZLearn 2024", 2023)
    hit = one(P.preprint_hits(spark.createDataFrame([("a", "2301.00002")], "item_key string, arxiv_id string"), meta, index))
    assert (hit["source"], hit["venue_raw"], hit["year"]) == ("arxiv_comment", "ZLearn", 2024)


def test_web_results(spark, index, items):
    page = '<a href="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fp%3Fa%3D1">one</a><a href="https://x.org/p?a=1">again</a><a href="https://arxiv.org/abs/1">skip</a><a href="mailto:x">m</a>'
    rows = P.web_results_html(spark.createDataFrame([("a", "https://html.duckduckgo.com/html/", page)], "item_key string, url string, html string")).collect()
    assert [(r["url"], r["title"]) for r in rows] == [("https://x.org/p?a=1", "one")]
    answer = {"web": {"results": [{"url": "https://x.org/q", "title": TITLE, "description": "by Smith, accepted at ZLearn 2023", "extra_snippets": ["more"]}, {"title": "no url"}]}}
    results = P.web_results_json(bronze(spark, answer))
    assert one(results)["snippet"] == "by Smith, accepted at ZLearn 2023 more"
    assert P.plausible(results, items).count() == 1
    near = results.withColumn("snippet", F.lit("accepted at ZLearn Smith 2023"))
    found = P.snippet_hits(near.withColumn("title", F.lit(TITLE)), items, index).collect()
    assert all(h["venue_raw"] == "ZLearn" and h["venue_evidence"] == "snippet" for h in found)


def test_official_page(spark, index, items):
    page = f'<html><nav>Workshops</nav><head><meta name="citation_title" content="{TITLE}"><meta name="citation_author" content="Ann Smith"><meta name="citation_conference_title" content="International Conference on Zeta Learning"><meta name="citation_publication_date" content="2023/06/01"><meta name="citation_firstpage" content="1"><meta name="citation_lastpage" content="9"><meta name="citation_doi" content="https://doi.org/10.1/x"></head><h1>{TITLE}</h1></html>'
    schema = "item_key string, route_ord int, pos int, url string, html string"
    pages = spark.createDataFrame([("a", 0, 0, "https://dl.acm.org/doi/10.1/x", page), ("a", 0, 1, "https://elsewhere.example/x", page)], schema)
    hit = one(P.page_hits(items, pages, index))
    assert (hit["venue_raw"], hit["year"], hit["pages"], hit["external_doi"], hit["publication_date"], hit["venue_evidence"]) == ("International Conference on Zeta Learning", 2023, "1-9", "10.1/x", "2023-06-01", "structured")


def test_status_words_near_the_title(spark, index, items):
    far, schema = "<p>" + "filler words " * 500 + "</p>", "item_key string, route_ord int, pos int, url string, html string, title string, snippet string"
    entry = f"<p>{TITLE}, Ann Smith. %s International Conference on Zeta Learning 2023</p>"
    hits = lambda html, title="", snippet="": P.page_hits(items, spark.createDataFrame([("a", 0, 0, "https://elsewhere.example/x", html, title, snippet)], schema), index, known=False).count()
    assert hits("<p>Workshop program</p>" + far + entry % "Accepted at the") == 1
    assert hits("<p>accepted</p>" + far + entry % "At the") == 0
    assert hits(far + entry % "Accepted at the" + " submitted") == 0
    assert hits(far + entry % "At the", "Accepted papers") == 1 and hits(far + entry % "Accepted at the", "", "under review") == 0


def test_web_status_words(spark, index, items):
    schema = "item_key string, route_ord int, pos int, url string, html string, title string, snippet string"
    entry = f"<p>{TITLE}, Ann Smith. %s International Conference on Zeta Learning 2023</p>"
    words = ["Conference paper,", "Technical sessions of the", "Proceedings of the", "被录用于", "Call for papers,", "short paper,", "accepted poster abstract,", "submission, accepted at the"]
    pages = spark.createDataFrame([("a", 0, i, "https://elsewhere.example/x", entry % w, "", "") for i, w in enumerate(words)], schema)
    assert sorted(r["pos"] for r in P.page_hits(items, pages, index, known=False).collect()) == [0, 1, 2, 3, 7]


def test_json_ld_names_the_venue(spark, index, items):
    record = {"@type": "ScholarlyArticle", "headline": TITLE, "datePublished": "2023-05-01", "isPartOf": {"name": "Volume 3", "isPartOf": {"name": "International Conference on Zeta Learning"}}}
    page = f'<script type="application/ld+json">{json.dumps(record)}</script><h1>{TITLE}</h1><p>Ann Smith</p>'
    pages = spark.createDataFrame([("a", 0, 0, "https://dl.acm.org/doi/10.1/x", page)], "item_key string, route_ord int, pos int, url string, html string")
    hit = one(P.page_hits(items, pages, index))
    assert (hit["venue_raw"], hit["venue_evidence"], hit["year"]) == ("International Conference on Zeta Learning", "structured", 2023)


def test_web_search_stops_at_the_first_official_page(spark, index, items):
    official, other = "https://dl.acm.org/doi/10.1/x", "https://elsewhere.example/x"
    page = f'<meta name="citation_title" content="{TITLE}"><meta name="citation_author" content="Ann Smith"><meta name="citation_conference_title" content="International Conference on Zeta Learning">'
    rows = [("a", 0, 0, other, TITLE, "by Smith"), ("a", 0, 1, other, TITLE, "again"), ("a", 1, 0, official, TITLE, ""), ("a", 2, 0, "https://late.example/", TITLE, "accepted")]
    answers = spark.createDataFrame([(*r, "brave") for r in rows], "item_key string, query_ord int, pos int, url string, title string, snippet string, provider string")
    kept = P.asked_until_official(answers, 3)
    assert sorted((r["pos"], r["url"]) for r in kept.collect()) == [(0, other), (1, other), (2, official)]
    announced = f"<p>{TITLE}, Ann Smith. Accepted at the International Conference on Zeta Learning 2023</p>"
    pages = spark.createDataFrame([(official, page), (other, announced)], "url string, html string")
    assert one(P.web_search(items, answers, pages, index))["source"] == "official_web"
    assert one(P.web_search(items, answers, pages.where(F.col("url") == other), index))["source"] == "brave_web"
    assert P.web_search(items, answers, pages.limit(0), index).count() == 0


def test_listings(spark):
    text = "# t\n## Domain One\n- A类期刊：AJ, Designs, Codes and Cryptography\n- B类会议：New Name（原 OLD、OLDER/OLDEST）, ZZ\nnoise\n## Two\n- C类会议：QQ"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")
    rows = [(r["domain"], r["kind"], r["tier"], r["canonical"], r["former"]) for r in C.parse_listing(lines).orderBy("line_no", "ord").collect()]
    assert rows == [("Domain One", "journal", "A", "AJ", []), ("Domain One", "journal", "A", "Designs, Codes and Cryptography", []), ("Domain One", "conference", "B", "New Name", ["OLD", "OLDER", "OLDEST"]), ("Domain One", "conference", "B", "ZZ", []), ("Two", "conference", "C", "QQ", [])]
    table = "## D\n### A\n| AA | Full A | P | https://dblp.org/db/conf/aa/ |\n| x | y |\n## E\n| lost | no | tier | u |\n### B\n| BB | Full B | | |"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(table.split("\n"))], "file string, line_no int, line string")
    rows = [tuple(r)[1:3] + (r["canonical"], r["full_name"]) for r in C.parse_table(lines).orderBy("line_no").collect()]
    assert rows == [("D", "A", "AA", "Full A"), ("E", "B", "BB", "Full B")]


def test_enrichment(spark):
    entries = spark.createDataFrame([(0, "ZZ", "conference", "A", "D", ["ZZ", "zed of zeds and so on", "Zed Of Zeds Meeting"], "", []), (1, "YY", "journal", "B", "D", ["YY"], "", [])], "row_ord int, canonical string, kind string, tier string, domain string, aliases array<string>, full_name string, former array<string>")
    named = {r["canonical"]: r["full_name"] for r in C.derived_full_name(entries).collect()}
    assert named == {"ZZ": "Zed Of Zeds Meeting", "YY": ""}
    with pytest.raises(ValueError, match="ZZ"):
        C.with_metadata(entries.drop("full_name"), spark.createDataFrame([("D", "A", "other", "f", "p", "u")], "domain string, tier string, canonical string, full_name string, publisher string, url string"))
    rankings = spark.createDataFrame([(0, "conference", ["ZZ", "Zed"]), (1, "conference", ["zed", "Zeddy"]), (2, "journal", ["ZZ", "no"])], "ord int, kind string, names array<string>")
    taken = {(r["row_ord"], r["alias"]) for r in C.shared_aliases(entries.withColumn("names", F.col("aliases")), rankings).collect()}
    assert taken == {(0, "Zed"), (0, "Zeddy")}
    aliases = C.read_aliases(spark.createDataFrame([('{"D|conference|ZZ": ["z1"], "*|conference|ZZ": ["z2"]}',)], "value string"))
    assert {tuple(r) for r in C.manual_aliases(entries, aliases).select("canonical", F.array_join("manual", ",")).collect()} == {("ZZ", "z1,z2"), ("YY", "")}
    assert C.statistics(fixture.catalogue(spark)).first()["n_rows"] == 10
