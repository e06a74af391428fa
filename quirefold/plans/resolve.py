"""The engine's main plan: items and captured source records to resolutions and proposals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.catalogue import Index
from ..operators.proposal import propose
from ..operators.resolve import admit, compose, strong_items, user_overrides, with_venue
from ..sources import providers as P
from .tools import settled

#: Columns of items, all strings but version, creators, tags and collections.
ITEM = (
    "item_key string, version bigint, title string, archiveID string, DOI string, url string, extra string, date string, "
    "creators array<struct<creatorType:string,firstName:string,lastName:string,name:string>>, tags array<struct<tag:string>>, collections array<string>, itemType string, "
    "proceedingsTitle string, conferenceName string, publicationTitle string, journalAbbreviation string, ISSN string, publisher string, volume string, issue string, pages string"
)


def regular_items(items: DataFrame, order: str = "item_ord") -> DataFrame:
    """items with a type other than attachment, note and annotation, the first of each key."""
    from .tools import first_rows

    return first_rows(items.where(~F.coalesce("itemType", F.lit("")).isin("attachment", "note", "annotation")), ["item_key"], F.col(order))


def in_scope(items: DataFrame, selected: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """The selected items (item_key), or, where none are, those of a collection."""
    if selected is not None and not selected.isEmpty():
        return items.join(selected.select("item_key").distinct(), "item_key", "left_semi")
    return items.where(F.array_contains("collections", collection)) if collection else items


def collection_paths(collections: DataFrame, depth: int = 20) -> DataFrame:
    """(collection_id, path) from collections (collection_id, name, parent_id): names from the root, joined by " / "; cycles end at depth."""
    now = collections.select("collection_id", F.col("name").alias("path"), F.col("parent_id").alias("_up"))
    names = collections.select(F.col("collection_id").alias("_up"), F.col("name").alias("_n"), F.col("parent_id").alias("_next"))
    for _ in range(depth - 1):
        if now.where("_up IS NOT NULL").isEmpty():
            break
        joined = now.join(names, "_up", "left")
        now = joined.select("collection_id", F.when(F.col("_n").isNotNull(), F.concat("_n", F.lit(" / "), "path")).otherwise(F.col("path")).alias("path"), F.col("_next").alias("_up"))
    return now.select("collection_id", "path")


def with_ids(items: DataFrame) -> DataFrame:
    return items.withColumn("arxiv_id", K.arxiv_id(F.col("archiveID"), F.col("DOI"), F.col("url"), F.col("extra")))


def ordered(hits: DataFrame, stage: int, provider: int) -> DataFrame:
    """hits with hit_ord: stage, provider, route and position, as one sortable number."""
    place = F.lit(stage) * 10**14 + F.lit(provider) * 10**12 + F.col("route_ord").cast("long") * 10**6 + F.col("pos")
    return hits.withColumn("hit_ord", place.cast("long")).drop("route_ord", "pos")


def resolve(items: DataFrame, sources: Mapping[str, DataFrame | None], index: Index, overrides: DataFrame, today: str, deep: bool = False,
            providers: Mapping[str, P.Provider | None] | None = None) -> DataFrame:
    """One resolution with a proposal for each item.

    sources: bronze tables by provider name, and "arxiv" (Atom feeds), "arxiv_html", "s2_batch" (chunk, pos, rec), "web_answers"
    and "web_pages" (search answers and captured pages, the last stage). A stage runs only for items without strong evidence from the ones before, unless deep; items with an override or a
    known venue of their own stay local. Whole stages count: no timing decides.
    """
    chosen = {**P.PROVIDERS, **(providers or {})}
    items = settled(with_ids(items))
    own = settled(ordered(P.existing(items, index), 0, 0))
    fixed = overrides.select("arxiv_id").distinct().withColumn("_listed", F.lit(True))
    local = items.join(fixed, "arxiv_id", "left").join(user_overrides(items).select("item_key", F.lit(True).alias("_user")), "item_key", "left")
    local = local.join(own.select("item_key").distinct().withColumn("_own", F.lit(True)), "item_key", "left")
    asked = (F.coalesce(F.trim("title"), F.lit("")) != "") | (F.coalesce("DOI", F.lit("")) != "")
    known = F.lit(False) if deep else F.col("_own").isNotNull()
    todo = settled(items.join(local.where(F.col("_listed").isNull() & F.col("_user").isNull() & ~known & asked).select("item_key"), "item_key", "left_semi"))

    hits, meta = own, None
    ids = todo.where("arxiv_id IS NOT NULL").select("item_key", "arxiv_id")
    if sources.get("arxiv") is not None:
        meta = P.arxiv_entries(sources["arxiv"])
    if sources.get("arxiv_html") is not None:
        pages = P.arxiv_pages(sources["arxiv_html"])
        meta = pages if meta is None else meta.unionByName(pages.join(meta.select("arxiv_id"), "arxiv_id", "left_anti"))
    if meta is not None:
        meta = settled(meta)
        hits = hits.unionByName(ordered(P.preprint_hits(ids, meta, index), 1, 1))
    if sources.get("s2_batch") is not None:
        from .tools import chunks

        numbered = chunks(ids, "arxiv_id", F.col("arxiv_id"), 100).join(ids, "arxiv_id")
        hits = hits.unionByName(ordered(P.s2_batch(numbered, sources["s2_batch"], index), 1, 2))
    admitted = settled(with_venue(settled(admit(items, hits)[0]), index))
    for stage, names in enumerate(P.STAGES, 1):
        open_items = todo if deep or stage == 1 else settled(todo.join(strong_items(admitted), "item_key", "left_anti"))
        found = None
        for number, name in enumerate(names, 3):
            if chosen.get(name) is None or sources.get(name) is None:
                continue
            bronze = sources[name].join(open_items.select("item_key"), "item_key", "left_semi")
            more = settled(ordered(chosen[name](open_items, bronze, index), stage, number))
            found = more if found is None else found.unionByName(more)
        if found is not None:
            admitted = settled(admitted.unionByName(with_venue(settled(admit(items, found)[0]), index)))
    if sources.get("web_answers") is not None and sources.get("web_pages") is not None:
        open_items = todo if deep else settled(todo.join(strong_items(admitted), "item_key", "left_anti"))
        answers = sources["web_answers"].join(open_items.select("item_key"), "item_key", "left_semi")
        found = settled(ordered(P.web_search(open_items, answers, sources["web_pages"], index, deep), len(P.STAGES) + 1, 1))
        admitted = settled(admitted.unionByName(with_venue(settled(admit(items, found)[0]), index)))
    latest = Window.partitionBy("item_key", "source", "venue_raw", "year", "external_doi", "evidence_url").orderBy("hit_ord")
    admitted = settled(admitted.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"))
    resolutions = compose(items, admitted, index, overrides, meta)
    return propose(settled(resolutions), items, index, today)
