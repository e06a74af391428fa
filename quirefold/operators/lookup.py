"""Venue lookup: raw strings against a ranked catalogue, in stages, abstaining on ambiguity.

Every stage runs on the distinct (value, kind) pairs and is an equi-join with a small table; containment of
long names joins token n-grams instead of comparing all pairs. Ties and first-wins rules follow explicit
ordinals. The result depends on the raw value alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import blank
from ..functions.labels import has_track_phrase, initialism_variants, venue_variants
from ..functions.text import ascii_tokens, norm_venue
from ..plans.tools import settled
from .catalogue import Index

#: Words that may stand around a long name without making it another venue.
WRAPPER_WORDS = (
    "proceedings", "of", "the", "annual", "joint", "international", "ieee", "acm", "usenix", "springer", "conference", "symposium", "meeting", "congress",
    "series", "volume", "vol", "edition", "on", "for", "and",
)

#: Words that bar a core match, and words that may follow one.
CORE_BARRED = (
    "workshop", "workshops", "findings", "doctoral", "companion", "tutorial", "tutorials", "demonstration", "demonstrations", "poster", "abstracts", "satellite",
)
CORE_SUFFIXES = ("symposium", "conference", "conferences", "proceedings", "meeting", "congress")

KEY = ["value", "kind"]


def _lits(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def aggregate(candidates: DataFrame, index: Index, matched_by: str, keys: list[str]) -> DataFrame:
    """One match for each key of candidates (keys, row_ord, ord): the merged entries, or ambiguous if they differ.

    Entries count once for each domain, kind, name and tier, in order of encounter. They are ambiguous if
    they have more than one tier or more than one identity (kind and normalised full name).
    """
    fields = ["canonical", "kind", "tier", "domain", "full_name", "publisher", "url", "dblp_slug", "_identity"]
    joined = candidates.join(index.hint(index.entries), "row_ord")
    first = joined.groupBy(*keys, "domain", "kind", "canonical", "tier").agg(F.min(F.struct("ord", "row_ord", *fields)).alias("e")).select(*keys, "e")
    grouped = first.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    listed = lambda c: F.array_distinct(F.transform("es", lambda e: e[c]))
    filled = lambda c: F.coalesce(F.get(F.filter(listed(c), lambda v: blank(v) != ""), F.lit(0)), F.lit(""))
    unclear = (F.size(listed("tier")) > 1) | (F.size(listed("_identity")) > 1)
    only = lambda c: F.when(~unclear, c)
    match = F.struct(
        unclear.alias("ambiguous"), only(F.element_at(listed("tier"), 1)).alias("tier"), only(F.array_join(listed("canonical"), " / ")).alias("canonical"),
        only(F.element_at("es", 1)["kind"]).alias("kind"), only(F.array_join(listed("domain"), " / ")).alias("domain"), only(listed("domain")).alias("domains"),
        *[only(filled(c)).alias(c) for c in ("full_name", "publisher", "url", "dblp_slug")],
        F.lit(matched_by).alias("matched_by"), F.transform("es", lambda e: e["row_ord"]).alias("entries"),
    )
    return grouped.select(*keys, match.alias("match"))


def _ngrams(tokens: str, sizes: tuple[int, ...] | list[int]) -> Column:
    """array<struct<n, at, gram>>: the runs of an array column of tokens whose length is one of sizes."""
    parts = [F.expr(f"IF(size({tokens}) >= {n}, transform(sequence(1, greatest(size({tokens}) - {n - 1}, 1)), i -> struct({n} AS n, i AS at, array_join(slice({tokens}, i, {n}), ' ') AS gram)), array())") for n in sizes]
    return F.flatten(F.array(*parts)) if parts else F.expr("cast(array() as array<struct<n:int,at:int,gram:string>>)")


def lookup(values: DataFrame, index: Index) -> DataFrame:
    """(value, kind, match) for the distinct pairs of values (value, kind or null); match is null where nothing fits."""
    asked = values.select(*KEY).distinct().withColumn("_kind", F.coalesce("kind", F.lit("")))
    kinds = F.when(F.col("_kind").isin("journal", "conference"), F.array("_kind")).otherwise(_lits(("conference", "journal")))
    base = asked.select("value", "_kind", kinds.alias("kinds"), venue_variants(F.col("value")).alias("variants"), norm_venue(F.col("value")).alias("norm"))
    base = base.withColumn("tokens", F.filter(F.split(F.coalesce(F.get("variants", F.lit(0)), F.lit("")), " "), lambda t: t != ""))
    base = settled(base.withColumn("_i", initialism_variants(F.col("value"))))
    key = ["value", "_kind"]
    allowed = index.rows.select("row_ord", F.col("kind").alias("row_kind"))

    def staged(hits: DataFrame, name: str) -> DataFrame:
        fit = hits.join(index.hint(allowed), "row_ord").where(F.array_contains("kinds", F.col("row_kind"))).select(*key, "row_ord", "ord")
        return aggregate(fit, index, name, key).withColumnRenamed("match", name.replace("-", "_"))

    tries = base.select(*key, F.posexplode("variants").alias("v", "norm"), "kinds").select(*key, "v", "norm", F.posexplode("kinds").alias("k", "kind"))
    hits = tries.join(index.hint(index.exact), ["kind", "norm"])
    least = F.min(F.struct("v", "k")).over(Window.partitionBy(*key))
    hits = hits.withColumn("_best", least).where((F.col("v") == F.col("_best.v")) & (F.col("k") == F.col("_best.k")))
    exact = aggregate(hits.select(*key, "row_ord", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), "row_ord").alias("ord")), index, "exact", key).withColumnRenamed("match", "exact")

    raw = F.regexp_extract_all(blank(F.col("value")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    shorts = base.select(*key, "kinds", F.posexplode(raw).alias("b", "compact")).where(F.col("compact") == F.upper("compact")).join(index.hint(index.short), "compact")
    named = base.select(*key, "kinds", F.posexplode("tokens").alias("b", "norm")).join(index.hint(index.acronym), "norm")
    order = lambda a: F.struct(F.lit(a).alias("a"), "b", "row_ord").alias("ord")
    both = shorts.select(*key, "kinds", "row_ord", order(0)).union(named.select(*key, "kinds", "row_ord", order(1)))
    acronym = staged(both, "acronym-token")

    made = base.select(*key, "kinds", F.posexplode("_i").alias("b", "compact"))
    derived = staged(made.join(index.hint(index.derived), "compact").select(*key, "kinds", "row_ord", order(0)), "derived-initialism")

    grams = base.select(*key, "kinds", "tokens", F.explode(_ngrams("tokens", index.long_sizes)).alias("g"))
    grams = grams.select(*key, "kinds", "tokens", "g.n", "g.at", F.col("g.gram").alias("norm"))
    runs = grams.join(index.hint(index.long.drop("kind", "n_tokens")), "norm").groupBy(*key, "kinds", "tokens", "norm", "n", "row_ord").agg(F.min("at").alias("at"))
    around = F.concat(F.slice("tokens", F.lit(1), F.col("at") - 1), F.slice("tokens", F.col("at") + F.col("n"), F.greatest(F.size("tokens"), F.lit(1))))
    safe = F.forall(around, lambda t: t.rlike("^[0-9]+$") | F.array_contains(_lits(WRAPPER_WORDS), t))
    contained = runs.where(safe).select(*key, "kinds", "row_ord", F.struct((-F.col("n")).alias("a"), (-F.length("norm")).alias("b"), "row_ord").alias("ord"))
    long = staged(contained, "long-name")

    out = base.select(*key, "kinds", "norm", (F.size("variants") > 0).alias("any"))
    for stage in (exact, acronym, derived, long):
        out = out.join(stage, key, "left")
    barred = F.array_contains("kinds", "conference") & has_track_phrase(F.col("norm"))
    clear = lambda c: F.when(~F.col(c)["ambiguous"], F.col(c))
    match = F.when(F.col("exact").isNotNull(), F.col("exact")).when(barred, F.lit(None)).otherwise(F.coalesce(clear("acronym_token"), clear("derived_initialism"), F.col("long_name")))
    return out.select("value", F.nullif(F.col("_kind"), F.lit("")).alias("kind"), F.when(F.col("any"), match).alias("match"))


def lookup_slug(urls: DataFrame, index: Index) -> DataFrame:
    """(url, match) for bibliography keys and urls of conferences; absent where the slug is unknown."""
    slug = F.lower(F.regexp_extract(blank(F.col("url")), r"(?i)(?:^|/)conf/([^/?#]+)", 1))
    hits = urls.select("url").distinct().withColumn("slug", slug).where("slug <> ''").join(index.hint(index.slug), "slug")
    found = aggregate(hits.select(F.col("url").alias("_url"), "row_ord", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), "row_ord").alias("ord")), index, "dblp-slug", ["_url"])
    return found.withColumnRenamed("_url", "url")


def lookup_core(values: DataFrame, index: Index) -> DataFrame:
    """(value, core struct) of the curated ranking: an alias that equals the value, else the first ranking with an
    alias in it that is followed only by numbers and generic words, unless a barred word occurs."""
    fields = F.struct("canonical", F.col("kind").alias("kind"), "core_tier", "write_as", "aliases").alias("core")
    dim = index.core.select("ord", "alias_ord", "alias", "tokens", fields)
    base = values.select("value").distinct().withColumn("v", F.lower(F.trim(blank(F.col("value"))))).withColumn("t", ascii_tokens(F.col("v"))).where("size(t) > 0")
    exact = base.join(index.hint(dim), F.col("v") == F.col("alias")).groupBy("value").agg(F.min_by("core", "ord").alias("core"))
    sized = dim.where("tokens <> ''").withColumn("n", F.size(F.split("tokens", " ")))
    grams = base.where(~F.arrays_overlap("t", _lits(CORE_BARRED))).select("value", "t", F.explode(_ngrams("t", index.core_sizes)).alias("g")).select("value", "t", "g.*")
    runs = grams.join(index.hint(sized.drop("n")), F.col("gram") == F.col("tokens")).groupBy("value", "t", "n", "ord", "alias_ord").agg(F.min("at").alias("at"), F.first("core").alias("core"))
    after = F.slice("t", F.col("at") + F.col("n"), F.greatest(F.size("t"), F.lit(1)))
    fits = runs.where(F.forall(after, lambda x: x.rlike("^[0-9]+$") | F.array_contains(_lits(CORE_SUFFIXES), x)))
    inside = fits.groupBy("value").agg(F.min_by("core", F.struct("ord", "alias_ord")).alias("core"))
    both = base.select("value").join(exact.select("value", F.col("core").alias("a")), "value", "left").join(inside.select("value", F.col("core").alias("b")), "value", "left")
    return both.select("value", F.coalesce("a", "b").alias("core")).where("core IS NOT NULL")


def rank(values: DataFrame, index: Index) -> DataFrame:
    """(value, kind, venue struct) for the distinct pairs of values: core ranking and catalogue in one row, or null.

    venue: canonical, kind, core, tier, domain, full_name, publisher, url, dblp_slug, write_as, aliases. A core row keeps
    its kind; the catalogue gives the name and tier, looked up by the value or, failing that, by the core name.
    """
    asked = values.select(*KEY).distinct()
    cored = asked.join(lookup_core(asked, index), "value", "left").withColumn("_hint", F.coalesce("kind", "core.kind"))
    cored = settled(cored)
    own = settled(lookup(cored.select("value", F.col("_hint").alias("kind")), index)).select(F.col("value").alias("_v"), F.col("kind").alias("_k"), F.col("match").alias("own"))
    joined = cored.join(own, (F.col("value") == F.col("_v")) & F.col("_hint").eqNullSafe(F.col("_k")), "left").drop("_v", "_k")
    again = joined.where("core IS NOT NULL AND (own IS NULL OR own.ambiguous)").select(F.col("core.canonical").alias("value"), F.col("core.kind").alias("kind"))
    again = settled(again.distinct())
    if again.isEmpty():
        again = None
    other = (lookup(again, index) if again is not None else own.limit(0).select(F.col("_v").alias("value"), F.col("_k").alias("kind"), F.col("own").alias("match"))).select(F.col("value").alias("_v"), F.col("kind").alias("_k"), F.col("match").alias("other"))
    joined = joined.join(other, (F.col("core.canonical") == F.col("_v")) & (F.col("core.kind") == F.col("_k")), "left")
    unclear = F.col("own").isNull() | F.col("own.ambiguous")
    match = F.when(unclear & F.col("core").isNotNull(), F.col("other")).otherwise(F.col("own"))
    joined = joined.withColumn("m", match).withColumn("m", F.when(~F.col("m.ambiguous"), F.col("m")))
    has, none = F.col("core").isNotNull(), F.array().cast("array<string>")
    pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(""))
    venue = F.struct(
        F.coalesce(F.nullif(F.col("m.canonical"), F.lit("")), F.col("core.canonical")).alias("canonical"), F.coalesce(F.when(has, F.col("core.kind")), F.col("m.kind")).alias("kind"),
        F.coalesce(F.col("core.core_tier"), F.lit("")).alias("core"), pick("tier").alias("tier"), pick("domain").alias("domain"),
        F.coalesce(F.nullif(F.col("m.full_name"), F.lit("")), F.col("core.write_as"), F.lit("")).alias("full_name"), pick("publisher").alias("publisher"),
        pick("url").alias("url"), pick("dblp_slug").alias("dblp_slug"), F.when(has, F.col("core.write_as")).otherwise(pick("full_name")).alias("write_as"),
        F.when(has, F.col("core.aliases")).otherwise(none).alias("aliases"),
    )
    return settled(joined.select("value", "kind", F.when(has | F.col("m").isNotNull(), venue).alias("venue")))


def find_in_text(texts: DataFrame, index: Index, kind: str | None = "conference") -> DataFrame:
    """(text, row_ord, score, quality) of the one catalogue venue that a free text names best; none if several tie.

    Phrases score 12 (full name), 11 (canonical) or 9; whole tokens in their case 8 or 6; mixed-case names
    in another case 3 or 2. Names are matched by joining the text's n-grams and tokens.
    """
    rows = index.rows.where(F.col("kind") == kind) if kind else index.rows
    named = rows.select("row_ord", "canonical", "full_name", F.explode(F.concat(F.array("full_name", "canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias <> ''").distinct()
    named = named.withColumn("norm", norm_venue(F.col("alias"))).where("norm <> ''").withColumn("n", F.size(F.split("norm", " "))).withColumn("compact", F.regexp_replace("alias", "[^A-Za-z0-9]", ""))
    phrase = ((F.col("n") >= 3) & (F.length("norm") >= 12)) | ((F.col("n") == 2) & (F.length("norm") >= 10) & F.col("alias").rlike("[A-Z]{3,}"))
    named = named.withColumns({"phrase": phrase, "mixed": F.col("alias").rlike("[A-Z].*[A-Z]") & F.col("alias").rlike("[a-z]"), "own": F.col("alias") == F.col("canonical"), "whole": F.col("alias") == F.col("full_name")})
    base = texts.select("text").distinct().withColumn("norm_text", norm_venue(F.col("text"))).withColumn("t", F.split("norm_text", " "))
    raw = F.regexp_extract_all(blank(F.col("text")), F.lit("[A-Za-z0-9&+.-]+"), F.lit(0))
    plain = lambda v: F.regexp_replace(v, "[^A-Za-z0-9]", "")
    named = settled(named)
    sizes = sorted(r[0] for r in named.where("phrase").select("n").distinct().collect())  # lengths of names, a few
    grams = base.select("text", F.explode(_ngrams("t", sizes)).alias("g")).select("text", F.col("g.gram").alias("norm")).distinct()
    by_phrase = grams.join(index.hint(named.where("phrase")), "norm").select("text", "row_ord", "alias", F.when(F.col("whole"), 12).when(F.col("own"), 11).otherwise(9).alias("score"), F.lit("phrase").alias("quality"))
    tokens = base.select("text", F.explode(raw).alias("r")).select("text", plain(F.col("r")).alias("token"), (F.col("r") == F.upper("r")).alias("caps")).where("token <> ''").distinct()
    whole = named.where("NOT mixed AND length(compact) BETWEEN 4 AND 24").withColumn("token", F.upper("compact"))
    by_caps = tokens.where("caps").select("text", "token").distinct().join(index.hint(whole), "token").select("text", "row_ord", "alias", F.when(F.col("own"), 8).otherwise(6).alias("score"), F.lit("exact_case").alias("quality"))
    brand = named.where("mixed AND length(compact) >= 5").withColumn("folded", F.lower("compact"))
    met = tokens.select("text", "token", F.lower("token").alias("folded")).distinct().join(index.hint(brand), "folded")
    met = met.groupBy("text", "row_ord", "alias", "own").agg(F.bool_or(F.col("token") == F.col("compact")).alias("same"))
    by_brand = met.select("text", "row_ord", "alias", F.when(F.col("same"), F.when(F.col("own"), 8).otherwise(6)).otherwise(F.when(F.col("own"), 3).otherwise(2)).alias("score"), F.when(F.col("same"), "exact_case").otherwise("case_insensitive").alias("quality"))
    others = by_caps.union(by_brand).join(by_phrase.select("text", "row_ord", "alias"), ["text", "row_ord", "alias"], "left_anti")  # a phrase settles its alias
    best = by_phrase.union(others).groupBy("text", "row_ord").agg(F.max(F.struct("score", "quality")).alias("b")).select("text", "row_ord", "b.*")
    top = best.withColumn("_top", F.max("score").over(Window.partitionBy("text"))).where("score = _top").drop("_top")
    ids = top.join(index.hint(index.rows.select("row_ord", F.concat_ws("|", "kind", "canonical", "tier").alias("_id"))), "row_ord")
    return ids.groupBy("text").agg(F.min("row_ord").alias("row_ord"), F.max("score").alias("score"), F.min_by("quality", "row_ord").alias("quality"), F.count_distinct("_id").alias("_n")).where("_n = 1").drop("_n")
