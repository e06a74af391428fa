"""Update proposals from resolutions, their review, and writing them with an undo table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import blank, is_arxiv_doi, item_year
from ..functions.labels import default_publisher
from ..functions.text import norm_title, smart_title, word_list, collapse
from .catalogue import Index
from .lookup import rank

#: Lines of extra that this tool, or one like it, has written; {prefix} names the tool.
TOOL_LINE = r"(?i)^\s*(?:\d+\s+citations\s*\(semantic\s*scholar\)|citations:\s*\d+\s*\(semanticscholar\)|[a-z]+-marker:|{prefix}:)"

#: Item fields that a proposal may set.
FIELDS = ("publicationTitle", "journalAbbreviation", "ISSN", "proceedingsTitle", "conferenceName", "publisher", "DOI", "volume", "issue", "pages", "date", "extra")

_LINES = r"\r\n|\r|\n"


def full_name(resolutions: DataFrame, index: Index) -> DataFrame:
    """resolutions (canonical, venue_raw) with venue_name: the name to write for the venue."""
    value = F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.col("venue_raw"))
    known = rank(resolutions.select(value.alias("value"), F.lit(None).cast("string").alias("kind")).where("value IS NOT NULL"), index).select(F.col("value").alias("_v"), F.col("venue").alias("_row"))
    joined = resolutions.join(known, value == F.col("_v"), "left").drop("_v").withColumn("_raw_norm", norm_title(F.col("venue_raw"))).withColumn("_row_norm", norm_title(F.col("_row.canonical")))
    row, raw = F.col("_row"), F.col("venue_raw")
    several = lambda c: F.size(word_list(collapse(c))) >= 2
    names = F.concat(F.array(row["canonical"]), row["aliases"])
    longest = F.get(F.array_sort(F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("i"), n.alias("n")))), F.lit(0))["n"]
    name = F.coalesce(
        F.nullif(row["write_as"], F.lit("")), F.when((blank(raw) != "") & (F.col("_raw_norm") == F.col("_row_norm")), F.nullif(row["full_name"], F.lit(""))),
        F.when(several(blank(raw)), raw), F.when(several(longest), smart_title(longest)), F.nullif(raw, F.lit("")), F.col("canonical"), F.lit(""),
    )
    return joined.withColumn("venue_name", name).drop("_row", "_raw_norm", "_row_norm")


def fields_match(item: str, fields: Column, year: Column) -> Column:
    """Whether an item (struct column) already has the proposed fields; extra does not count, dates by year unless complete."""
    checks = []
    for name in FIELDS:
        if name == "extra":
            continue
        have, want = blank(F.col(f"{item}.{name}")), F.try_element_at(fields, F.lit(name))
        if name == "date":
            other_year = year.isNotNull() & ~item_year(have).eqNullSafe(year)
            complete = want.rlike(r"^\d{4}-\d{2}-\d{2}$") & (have != want)
            checks.append(want.isNull() | ~(other_year | complete))
        else:
            checks.append(want.isNull() | (have == want))
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def propose(resolutions: DataFrame, items: DataFrame, index: Index, today: str, prefix: str = "quirefold") -> DataFrame:
    """resolutions (as compose() returns them) with target_item_type and fields map<string,string>; both empty where nothing is to change.

    items: item_key and the item's fields. Proposing again on the result of applying gives no change.
    """
    named = full_name(resolutions, index)
    catalogued = rank(resolutions.where("canonical IS NOT NULL").select(F.col("canonical").alias("value"), F.lit("conference").alias("kind")), index)
    named = named.join(catalogued.select(F.col("value").alias("canonical"), F.col("venue.publisher").alias("_publisher")), "canonical", "left")
    have = items.select("item_key", F.struct("itemType", *FIELDS).alias("_item"))
    base = named.join(have, "item_key", "left")
    hit, some = F.col("proposal_hit"), lambda v: F.nullif(v, F.lit(""))
    journal = F.col("kind") == "journal"
    only = lambda cond, v: F.when(cond, some(v))
    journal, conference = F.coalesce(journal, F.lit(False)), ~F.coalesce(journal, F.lit(False))
    doi = F.when(~is_arxiv_doi(hit["external_doi"]), some(hit["external_doi"]))
    year, date = F.col("year"), blank(F.col("_item.date"))
    formal = hit["publication_date"]
    replace = (F.col("_item.itemType") == "preprint") | (date == "") | date.rlike(r"^\d{4}$") | ~item_year(date).eqNullSafe(year)
    dated = F.when(formal.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.substring(formal, 1, 4).cast("int") == year) & replace, formal).when(year.isNotNull() & ~item_year(date).eqNullSafe(year), year.cast("string"))
    tool = TOOL_LINE.format(prefix=prefix)
    kept = F.filter(F.when(blank(F.col("_item.extra")) == "", F.array().cast("array<string>")).otherwise(F.split("_item.extra", _LINES)), lambda x: ~x.rlike(tool))
    marked = F.exists(kept, lambda x: F.contains(F.lower(x), F.lit("arxiv")))
    extra = F.concat(
        kept, F.when(F.col("arxiv_id").isNotNull() & ~marked, F.array(F.concat(F.lit("arXiv:"), F.col("arxiv_id")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("citation_count").isNotNull(), F.array(F.concat(F.lit("Citations: "), F.col("citation_count").cast("string"), F.lit(f" (SemanticScholar) [{today}]")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(f"{prefix}: resolved {today}")),
    )
    values = {
        "publicationTitle": only(journal, F.col("venue_name")), "journalAbbreviation": only(journal, F.coalesce(some(hit["abbrev"]), some(F.col("user_abbrev")), F.col("canonical"))), "ISSN": only(journal, hit["issn"]),
        "proceedingsTitle": only(conference, F.col("venue_name")), "conferenceName": only(conference, F.col("canonical")),
        "publisher": only(conference, F.coalesce(some(hit["publisher"]), some(F.col("_publisher")), default_publisher(F.col("canonical")))), "DOI": doi,
        "volume": some(hit["volume"]), "issue": only(journal, hit["issue"]), "pages": some(hit["pages"]), "date": dated, "extra": F.trim(F.array_join(extra, "\n")),
    }
    made = F.map_filter(F.create_map(*[x for k in FIELDS for x in (F.lit(k), values[k].cast("string"))]), lambda k, v: v.isNotNull())
    kind = F.when(journal, "journalArticle").otherwise("conferencePaper")
    base = base.withColumns({"_fields": made, "_type": kind})
    nothing = (F.col("acceptance") != "accepted") | (blank(F.col("canonical")) == "") | ((blank(F.col("_item.itemType")) == F.col("_type")) & fields_match("_item", F.col("_fields"), year))
    empty = F.expr("cast(map() as map<string,string>)")
    out = base.withColumn("target_item_type", F.when(~nothing, F.col("_type"))).withColumn("fields", F.when(~nothing, F.col("_fields")).otherwise(empty))
    return out.withColumn("current_item_type", F.coalesce(F.nullif(F.col("_item.itemType"), F.lit("")), F.lit("preprint"))).drop("_fields", "_type", "_item", "_publisher", "venue_name", "proposal_hit", "user_abbrev")


def eligible(proposals: DataFrame) -> DataFrame:
    return proposals.where("target_item_type IS NOT NULL")


def auto_select(proposals: DataFrame, least: float = 0.8) -> DataFrame:
    """The proposals that are selected without a review: eligible, with at least this confidence."""
    return eligible(proposals).where(F.col("confidence") >= least)


def review(proposals: DataFrame) -> DataFrame:
    """The columns that a reviewer reads, as text."""
    pairs = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return proposals.select(
        "item_key", "title", "canonical", "year", F.concat_ws(" / ", "ccf_tier", "core_tier").alias("tier"), F.format_string("%.2f", "confidence").alias("confidence"),
        F.concat_ws(" -> ", "current_item_type", "target_item_type").alias("change"), pairs.alias("fields"), F.col("target_item_type").isNotNull().alias("eligible"),
    )


def apply_proposals(items: DataFrame, proposals: DataFrame, valid: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """items with the type and fields of the selected proposals; valid: the fields that each item type has (default: all)."""
    side = eligible(proposals).select("item_key", "target_item_type", F.col("fields").alias("_fields"))
    joined = items.join(side, "item_key", "left")
    kind = F.coalesce("target_item_type", "itemType")
    columns = {}
    for name in FIELDS:
        if name in items.columns:
            allowed = F.lit(True) if valid is None else F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in valid.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind), F.lit(name)), F.lit(False))
            columns[name] = F.when(allowed, F.coalesce(F.try_element_at("_fields", F.lit(name)), F.col(name))).otherwise(F.col(name))
    return joined.withColumns(columns | {"itemType": kind}).select(*items.columns)


def preimage(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """The whole rows of the items that the proposals would change: the undo table, to be written before."""
    return items.join(eligible(proposals).select("item_key").distinct(), "item_key", "left_semi")


def undo(items: DataFrame, before: DataFrame, keep: tuple[str, ...] = ("version",)) -> DataFrame:
    """items with the rows of before restored, but for the columns in keep; rows that are gone stay gone."""
    old = before.select("item_key", F.struct(*[c for c in items.columns if c != "item_key"]).alias("_old"))
    joined = items.join(old, "item_key", "left")
    columns = {c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in items.columns if c != "item_key" and c not in keep}
    return joined.withColumns(columns).select(*items.columns)
