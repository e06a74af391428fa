"""The venue catalogue: reading its listings, enriching its rows, and the lookup tables built from it.

A catalogue is an input; none is shipped. Its rows are
(row_ord, canonical, kind, tier, domain, aliases array, full_name, publisher, url, dblp_slug).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import blank
from ..functions.labels import looks_like_acronym
from ..functions.text import ascii_tokens, norm_listing, norm_venue, smart_title
from ..plans.tools import BROADCAST_ROWS

CATALOGUE = "row_ord int, canonical string, kind string, tier string, domain string, aliases array<string>, full_name string, publisher string, url string, dblp_slug string"

#: A listed title that holds a literal comma (fixed value).
COMMA_TITLES = ("Designs, Codes and Cryptography",)

#: Words that stay lower-case in a listed title.
LISTING_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A header-driven CSV without quoting: all strings, trimmed, missing cells empty."""
    raw = spark.read.csv(path, header=True, quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select([F.trim(blank(F.col(f"`{c}`"))).alias(c.strip()) for c in raw.columns])


def read_aliases(text: DataFrame) -> DataFrame:
    """(domain, kind, canonical, alias) of JSON texts {"domain|kind|canonical": [alias, ...]} in column value; domain * is any."""
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "v"))
    part = F.split("k", r"\|", 3)
    return pairs.select(part[0].alias("domain"), part[1].alias("kind"), part[2].alias("canonical"), F.explode("v").alias("alias"))


def forward_fill(lines: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """lines (line_no, ...) with name: the last value that was not null, up to this line, within keys."""
    window = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(window))


def split_names(names: Column, whole: tuple[str, ...] = COMMA_TITLES) -> Column:
    """A comma-separated list as an array; listed titles with a comma stay whole."""
    mark = "\u0001"
    out = names
    for t in whole:
        out = F.replace(out, F.lit(t), F.lit(t.replace(",", mark)))
    return F.filter(F.transform(F.split(out, r",\s*"), lambda n: F.trim(F.replace(n, F.lit(mark), F.lit(",")))), lambda n: n != "")


def renamed(name: Column) -> Column:
    """A struct (canonical, former array) of "X（原 A、B/C）"; no former names without the bracket."""
    pattern = r"^(.+?)（原\s*(.+?)）$"
    hit = name.rlike(pattern)
    former = F.filter(F.transform(F.split(F.regexp_extract(name, pattern, 2), "[、/]"), lambda v: F.trim(v)), lambda n: n != "")
    return F.struct(F.trim(F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(name)).alias("canonical"), F.when(hit, former).otherwise(F.array().cast("array<string>")).alias("former"))


def parse_listing(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, domain, kind, tier, ord, canonical, former) of listing lines (file, line_no, line).

    "## domain" opens a domain; "- [ABC]类(期刊|会议)：name, name" lists names. Files are read apart, so
    that each is one ordered run.
    """
    keyed = forward_fill(lines, F.nullif(F.regexp_extract("line", r"^##\s+(?!#)(.*?)\s*$", 1), F.lit("")), "domain", (file,))
    entry = r"^-\s*([ABC])类(期刊|会议)[：:]\s*(.*)$"
    hits = keyed.where(F.col("line").rlike(entry) & F.col("domain").isNotNull())
    each = hits.select(file, "domain", "line_no", F.regexp_extract("line", entry, 1).alias("tier"), F.when(F.regexp_extract("line", entry, 2) == "期刊", "journal").otherwise("conference").alias("kind"),
                       F.posexplode(split_names(F.regexp_extract("line", entry, 3))).alias("ord", "name"))
    return each.withColumn("r", renamed(F.col("name"))).select(file, "domain", "kind", "tier", "line_no", "ord", "r.canonical", "r.former")


def parse_table(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, domain, tier, line_no, canonical, full_name, publisher, url) of Markdown tables; a new domain resets the tier."""
    domain = F.nullif(F.regexp_extract("line", r"^##\s+(?!#)(.*?)\s*$", 1), F.lit(""))
    run = F.sum(F.when(domain.isNotNull(), 1).otherwise(0)).over(Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    keyed = forward_fill(lines.withColumn("_run", run), domain, "domain", (file,))
    keyed = forward_fill(keyed, F.nullif(F.regexp_extract("line", r"^###\s*([ABC])", 1), F.lit("")), "tier", (file, "_run"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda v: F.trim(v))
    rows = keyed.where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+$") & F.col("tier").isNotNull()).withColumn("c", cells)
    return rows.where("size(c) >= 4").select(file, "domain", "tier", "line_no", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("canonical", "full_name", "publisher", "url"))])


def with_metadata(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """entries (domain, kind, tier, canonical, ...) with full_name, publisher and url of the conference's metadata row.

    Fails if a conference has none: the anti join must be empty.
    """
    name = norm_listing(F.col("canonical"))
    side = metadata.select(F.col("domain"), F.col("tier"), name.alias("_name"), "full_name", "publisher", "url")
    keyed = entries.withColumn("_name", name)
    joined = keyed.join(side, ["domain", "tier", "_name"], "left")
    missing = joined.where("kind = 'conference' AND full_name IS NULL").select("canonical").limit(5).collect()
    if missing:
        raise ValueError(f"conferences without metadata: {[r[0] for r in missing]}")
    return joined.withColumns({c: blank(F.col(c)) for c in ("full_name", "publisher", "url")}).drop("_name")


def manual_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries with manual array<string>: aliases of its exact key, then those whose domain is *."""
    keys = ["domain", "kind", "canonical"]
    exact = aliases.where("domain <> '*'").groupBy(*keys).agg(F.collect_list("alias").alias("_exact"))
    wild = aliases.where("domain = '*'").groupBy("kind", "canonical").agg(F.collect_list("alias").alias("_wild"))
    none = F.array().cast("array<string>")
    joined = entries.join(exact, keys, "left").join(wild, ["kind", "canonical"], "left")
    return joined.withColumn("manual", F.concat(F.coalesce("_exact", none), F.coalesce("_wild", none))).drop("_exact", "_wild")


def shared_aliases(entries: DataFrame, rankings: DataFrame) -> DataFrame:
    """(row_ord, alias) that each entry takes over from rankings (ord, kind, names array) of its kind that share a name with it.

    Sharing is transitive in the order of rankings: a ranking may match by a name taken over from an
    earlier one. It is iterated to the fixpoint, in as many steps as a chain is long; both are small tables.
    """
    names = entries.select("row_ord", "kind", F.explode("names").alias("name")).withColumn("norm", norm_listing(F.col("name"))).withColumn("since", F.lit(-1))
    each = rankings.select("ord", F.col("kind").alias("rkind"), F.explode("names").alias("rname")).withColumn("rnorm", norm_listing(F.col("rname")))
    known, size = names.select("row_ord", "kind", "norm", "since").distinct().cache(), -1
    while (now := known.count()) != size:
        size = now
        hit = known.join(each, (F.col("kind") == F.col("rkind")) & (F.col("norm") == F.col("rnorm")) & (F.col("ord") > F.col("since"))).select("row_ord", "kind", "ord").distinct()
        more = hit.join(each.select("ord", "rnorm"), "ord").select("row_ord", "kind", F.col("rnorm").alias("norm"), F.col("ord").alias("since"))
        known = known.union(more).groupBy("row_ord", "kind", "norm").agg(F.min("since").alias("since")).cache()
    taken = known.where("since >= 0").join(each.select("ord", F.col("rnorm").alias("norm"), "rname"), "norm").where("ord = since")
    return taken.groupBy("row_ord", "norm").agg(F.min("rname").alias("alias")).select("row_ord", "alias")


def listed_title(text: Column) -> Column:
    """A listed title with capitals if it has none; others stay."""
    return F.when(text.rlike("[A-Z]"), text).otherwise(smart_title(text, LISTING_STOPWORDS))


def derived_full_name(entries: DataFrame) -> DataFrame:
    """entries (canonical, former, aliases, full_name) with full_name, where it is empty, from the names at hand.

    A renamed entry with a name of several words keeps it; else the alias of three words or more without
    a renaming note, one with capitals first, then the longest, then the first; else a name of several words.
    """
    words = lambda a: F.size(F.split(F.trim(F.regexp_replace(F.replace(a, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")), " "))
    fits = F.filter("aliases", lambda a: (words(a) >= 3) & ~a.rlike(r"[（(]原\s*"))
    ranked = F.transform(fits, lambda a, i: F.struct(F.when(a.rlike("[A-Z]"), 0).otherwise(1).alias("c"), (-F.length(a)).alias("l"), i.alias("i"), a.alias("a")))
    several = F.when(F.contains("canonical", F.lit(" ")), F.col("canonical"))
    best = F.coalesce(F.when(F.size("former") > 0, several), F.get(F.array_sort(ranked), F.lit(0))["a"], several, F.lit(""))
    return entries.withColumn("full_name", F.coalesce(F.nullif(F.col("full_name"), F.lit("")), listed_title(best)))


def statistics(catalogue: DataFrame) -> DataFrame:
    """One row: rows by kind, filled columns, domains."""
    filled = lambda c: F.count_if(blank(F.col(c)) != "").alias(f"n_{c}")
    return catalogue.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("kind") == "conference").alias("n_conferences"), F.count_if(F.col("kind") == "journal").alias("n_journals"),
        F.count_distinct("domain").alias("n_domains"), *[filled(c) for c in ("full_name", "publisher", "url", "dblp_slug")],
    )


@dataclass(frozen=True)
class Index:
    """Lookup tables of a catalogue and of a core ranking; all are as small as these."""

    rows: DataFrame  # the catalogue
    entries: DataFrame  # what a match reports of each row, with its identity
    exact: DataFrame  # kind, norm, row_ord
    acronym: DataFrame  # norm, row_ord
    short: DataFrame  # compact, row_ord
    derived: DataFrame  # compact, row_ord
    long: DataFrame  # norm, n_tokens, row_ord
    slug: DataFrame  # slug, row_ord
    core: DataFrame  # ord, alias_ord, alias, tokens, canonical, kind, core_tier, write_as, aliases
    long_sizes: tuple[int, ...]  # token counts of long names
    core_sizes: tuple[int, ...]  # token counts of core aliases
    bounded: bool  # whether every table was counted to be small enough to broadcast

    def hint(self, table: DataFrame) -> DataFrame:
        """A table of this index, or rows of one, with a broadcast hint if it is bounded."""
        return F.broadcast(table) if self.bounded else table


def build_index(catalogue: DataFrame, rankings: DataFrame) -> Index:
    """The lookup tables of a catalogue and of rankings (ord, canonical, kind, core_tier, aliases 'a|b', write_as)."""
    names = F.concat(F.array(F.col("canonical"), F.col("full_name")), F.coalesce("aliases", F.array().cast("array<string>")))
    each = catalogue.select("row_ord", "kind", F.explode(names).alias("name")).withColumn("norm", norm_venue(F.col("name"))).where("norm <> ''")
    exact = each.select("kind", "norm", "row_ord").distinct()
    long = exact.withColumn("n_tokens", F.size(F.split("norm", " "))).where("length(norm) >= 12 AND n_tokens >= 3")
    compact = F.regexp_replace(F.trim(blank(F.col("canonical"))), "[^A-Za-z0-9]", "")
    named = catalogue.select("row_ord", "canonical", compact.alias("compact"), looks_like_acronym(F.col("canonical")).alias("acronym"))
    acronym = named.where("acronym").withColumn("norm", norm_venue(F.col("canonical"))).select("norm", "row_ord")
    derived = named.where("acronym AND length(compact) BETWEEN 4 AND 16").select(F.upper("compact").alias("compact"), "row_ord")
    short = named.where("NOT acronym AND length(compact) BETWEEN 2 AND 3 AND compact = upper(compact) AND compact RLIKE '[A-Z]'").select("compact", "row_ord")
    slug = catalogue.where("kind = 'conference'").select(F.lower(F.trim(blank(F.col("dblp_slug")))).alias("slug"), "row_ord").where("slug <> ''")
    aliases = F.concat(F.filter(F.transform(F.split(F.lower(blank(F.col("aliases"))), r"\|"), lambda v: F.trim(v)), lambda a: a != ""), F.array(F.lower("canonical")))
    core = rankings.select("ord", "canonical", F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("conference")).alias("kind"), F.trim(blank(F.col("core_tier"))).alias("core_tier"),
                           F.trim(blank(F.col("write_as"))).alias("write_as"), aliases.alias("aliases"))
    core = core.select("*", F.posexplode("aliases").alias("alias_ord", "alias")).withColumn("tokens", F.array_join(ascii_tokens(F.col("alias")), " "))
    identity = F.concat_ws("|", "kind", norm_venue(F.coalesce(F.nullif(F.col("full_name"), F.lit("")), F.col("canonical"))))
    entries = catalogue.select("row_ord", "canonical", "kind", "tier", "domain", "full_name", "publisher", "url", "dblp_slug", identity.alias("_identity"))
    tables = [t.cache() for t in (catalogue, entries, exact, acronym, short, derived, long, slug, core)]  # read many times, small
    sizes = lambda t, c: tuple(sorted(r[0] for r in t.select(c).distinct().collect()))
    bounded = all(t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS for t in tables)
    return Index(*tables, sizes(tables[6], "n_tokens"), sizes(tables[8].where("tokens <> ''"), F.size(F.split("tokens", " "))), bounded)
