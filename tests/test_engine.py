"""Lookup, resolution and proposals on a small invented catalogue."""

import json

import pytest
from pyspark.sql import functions as F

from quirefold.operators.lookup import lookup
from quirefold.operators.proposal import apply_proposals, auto_select, preimage, propose, review, undo
from quirefold.operators.resolve import HIT, compose, duplicate_groups, with_venue
from quirefold.plans import fixture
from quirefold.plans.resolve import ITEM, collection_paths, resolve, with_ids
from quirefold.streaming import requests as S

ITEM_KEYS = [f.split()[0] for f in ITEM.split(", ") if ":" not in f.split()[0]]


def item(key, title, **fields):
    base = {"item_key": key, "version": 1, "title": title, "creators": [("author", "Ann", "Smith", None)], "tags": [], "collections": [], "itemType": "preprint"}
    names = ["item_key", "version", "title", "archiveID", "DOI", "url", "extra", "date", "creators", "tags", "collections", "itemType", "proceedingsTitle", "conferenceName", "publicationTitle", "journalAbbreviation", "ISSN", "publisher", "volume", "issue", "pages"]
    row = base | fields
    return tuple(row.get(n) for n in names)


def hits(spark, *rows):
    names = [f.split()[0] for f in HIT.split(", ")]
    made = [(r["item_key"], r["hit_ord"], *[r.get(n) for n in names]) for r in rows]
    return spark.createDataFrame(made, f"item_key string, hit_ord long, {HIT}")


@pytest.fixture(scope="module")
def index(spark):
    return fixture.index(spark)


@pytest.fixture(scope="module")
def overrides(spark):
    return spark.createDataFrame([("2101.00001", "ZLearn", 2021)], "arxiv_id string, canonical string, year int")


def found(spark, index, value, kind=None):
    row = lookup(spark.createDataFrame([(value, kind)], "value string, kind string"), index).first()
    return row["match"] if row else None


def test_unsafe_suffix_is_no_match(spark, index):
    assert found(spark, index, "International Conference on Zeta Learning and Applications") is None
    assert found(spark, index, "", None) is None


def test_track_bars_all_but_exact(spark, index):
    assert found(spark, index, "ZLearn democracy", "conference") is None


def test_confidence_and_choice(spark, index, overrides):
    items = with_ids(spark.createDataFrame([item("a", "T one two"), item("b", "T"), item("c", "U", archiveID="arXiv:2101.00001"), item("d", "V", extra="venue override: TWIN\nvenue year: 2019")], ITEM))
    both = [{"item_key": "a", "hit_ord": 1, "source": "dblp", "venue_raw": "ZLearn", "title_score": 1.0, "year": 2020}, {"item_key": "a", "hit_ord": 2, "source": "crossref_title", "venue_raw": "ZLearn", "title_score": 1.0, "year": 2020, "volume": "7"}]
    own = hits(spark, *both, {"item_key": "b", "hit_ord": 1, "source": "semantic_scholar", "venue_raw": "SNDX", "year": 2021, "citation_count": 12})
    rows = {r["item_key"]: r for r in compose(items, with_venue(own, index), index, overrides).collect()}
    assert rows["a"]["canonical"] == "ZLearn" and rows["a"]["confidence"] == 0.95 and rows["a"]["proposal_hit"]["volume"] == "7"
    assert rows["b"]["confidence"] == 0.75 and rows["b"]["citation_count"] == 12
    assert rows["c"]["canonical"] == "ZLearn" and rows["c"]["sources"][0] == "override" and rows["c"]["year"] == 2021
    assert rows["d"]["kind"] == "journal" and rows["d"]["confidence"] == 1.0 and rows["d"]["year"] == 2019


def test_resolve_end_to_end_and_idempotent(spark, index, overrides):
    items = spark.createDataFrame([item("a", "Deep Zeta Learning of Things", date="2023", archiveID="arXiv:2301.00002"), item("b", "Nothing Known At All")], ITEM)
    work = {"DOI": "10.1/x", "type": "proceedings-article", "title": ["Deep zeta learning of things"], "author": [{"given": "Ann", "family": "Smith"}], "container-title": ["International Conference on Zeta Learning"], "published": {"date-parts": [[2023, 5, 6]]}, "page": "1-9"}
    preprint = {"type": "posted-content", "title": ["Deep zeta learning of things"], "relation": {"is-preprint-of": [{"id-type": "doi", "id": "10.1/x"}]}}
    record = {"title": "Deep Zeta Learning of Things.", "venue": ["ZLearn"], "year": "2023", "type": "Conference and Workshop Papers", "key": "conf/zlearn/S23", "url": "https://dblp.org/rec/conf/zlearn/S23", "authors": {"author": {"text": "Ann Smith"}}}
    schema = "item_key string, route_ord int, pos int, rec string"
    sources = {"crossref_title": spark.createDataFrame([("a", 0, 0, json.dumps(preprint)), ("a", 0, 1, json.dumps(work))], schema), "dblp": spark.createDataFrame([("a", 0, 0, json.dumps(record))], schema)}
    feed = "<entry><id>http://arxiv.org/abs/2301.00002v1</id><title>Deep Zeta Learning of Things</title><published>2023-01-01</published><arxiv:comment>Accepted at ZLearn 2023</arxiv:comment></entry>"
    sources["arxiv"] = spark.createDataFrame([(feed,)], "xml string")
    out = resolve(items, sources, index, overrides, "2026-01-02").cache()
    rows = {r["item_key"]: r for r in out.collect()}
    a, b = rows["a"], rows["b"]
    assert a["canonical"] == "ZLearn" and a["target_item_type"] == "conferencePaper" and a["confidence"] == 0.99
    assert a["fields"]["DOI"] == "10.1/x" and a["fields"]["pages"] == "1-9" and a["fields"]["conferenceName"] == "ZLearn"
    assert a["fields"]["extra"].split("\n") == ["arXiv:2301.00002", "quirefold: resolved 2026-01-02"]
    assert b["acceptance"] == "unknown" and b["target_item_type"] is None and b["fields"] == {}
    applied = apply_proposals(items, out).cache()
    again = propose(out.drop("target_item_type", "fields", "current_item_type").withColumn("proposal_hit", F.lit(None).cast("struct<external_doi:string,issn:string,abbrev:string,publisher:string,publication_date:string,volume:string,issue:string,pages:string>")).withColumn("user_abbrev", F.lit(None).cast("string")), applied, index, "2026-01-02")
    assert again.where("target_item_type IS NOT NULL").count() == 0
    assert undo(applied, preimage(items, out)).exceptAll(items).count() == 0
    assert auto_select(out).count() == 1 and review(out).count() == 2


def test_duplicates_and_paths(spark):
    rows = spark.createDataFrame([("A", "k1"), ("A", "k2"), ("B", "k3"), (None, "k4")], "arxiv_id string, item_key string")
    assert [(r[0], r[1]) for r in duplicate_groups(rows).collect()] == [("A", ["k1", "k2"])]
    tree = spark.createDataFrame([("1", "root", None), ("2", "mid", "1"), ("3", "leaf", "2")], "collection_id string, name string, parent_id string")
    assert dict(collection_paths(tree).collect())["3"] == "root / mid / leaf"


def test_breaker_and_snapshot(spark):
    log = spark.createDataFrame([("h", 0, 500, None, "a"), ("h", 1, 500, None, "b"), ("h", 2, 200, None, "c"), ("h", 45_001, 200, None, "d"), ("h", 45_002, 429, 10_000, "e"), ("h", 50_000, 200, None, "f")], "host string, ts_ms long, status int, retry_after_ms long, key string")
    assert {r["key"]: r["allowed"] for r in S.breaker(log).collect()} == {"a": True, "b": True, "c": False, "d": True, "e": True, "f": False}
    cache = spark.createDataFrame([("new", 3, 99, 5), ("big", 2, 99, 50), ("old", 1, 99, 5), ("dead", 4, 1, 1)], "key string, ts_ms long, expires_ms long, bytes long")
    assert {r["key"] for r in S.snapshot(cache, 10, entry_bytes=60, total_bytes=20).collect()} == {"new", "old"}


def test_containment_is_no_nested_loop(spark, index):
    plan = lookup(spark.createDataFrame([("x y", None)], "value string, kind string"), index)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
