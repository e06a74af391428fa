"""Labels, buckets, tags and venue spellings, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import blank
from .text import norm_venue

CITE_BUCKETS = (10000, 5000, 1000, 500, 100, 50, 10)

#: How much each source counts; any other source has DEFAULT_WEIGHT.
SOURCE_WEIGHTS = (
    ("override", 100), ("usenix_official", 40), ("official_web", 36), ("doi_csl", 34), ("crossref_doi", 34), ("datacite_doi", 33), ("arxiv_journal_ref", 32),
    ("opencitations_doi", 30), ("openalex_doi", 30), ("openreview", 31), ("dblp", 29), ("crossref_title", 26), ("datacite_title", 25), ("openalex", 24),
    ("semantic_scholar", 22), ("semantic_scholar_title", 21), ("brave_web", 20), ("duckduckgo_web", 19), ("arxiv_comment", 20), ("zotero_metadata", 19),
    ("brave_snippet", 16), ("duckduckgo_snippet", 15),
)
DEFAULT_WEIGHT = 12

#: Sources of one family do not confirm each other.
FAMILIES = (
    ("^semantic_scholar", "semantic_scholar"), ("^(?:crossref|doi_csl)", "crossref_or_doi"), ("^datacite", "datacite"), ("^openalex", "openalex"),
    ("^arxiv_", "arxiv"), ("^(?:official_web|usenix_official|brave_|duckduckgo_)", "web_evidence"),
)

#: Phrases that set a track apart from the main event.
TRACK_PHRASES = (
    "workshop", "workshops", "findings", "tutorial", "tutorials", "demo", "demonstration", "doctoral consortium", "industry track", "short paper",
    "companion", "challenge", "shared task",
)

#: Default publishers of well-known venues.
PUBLISHERS = (
    ("CVPR", "IEEE"), ("ICCV", "IEEE"), ("WACV", "IEEE"), ("ICRA", "IEEE"), ("IROS", "IEEE"), ("ECCV", "Springer"), ("ICML", "PMLR"), ("AISTATS", "PMLR"),
    ("COLT", "PMLR"), ("UAI", "PMLR"), ("ACL", "ACL"), ("EMNLP", "ACL"), ("NAACL", "ACL"), ("KDD", "ACM"), ("WWW", "ACM"), ("SIGIR", "ACM"),
    ("SIGGRAPH", "ACM"), ("ACM MM", "ACM"), ("AAAI", "AAAI Press"), ("IJCAI", "IJCAI"), ("USENIX Security", "USENIX"),
)

#: The separator of an encoded tier column.
UNIT = "\u001f"

#: ASCII word boundaries; Java's own treat accented letters as word characters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

_STOP = frozenset("a an and as at by for from in of on or the to with".split())
_PUBLISHER_WORDS = frozenset("acm ieee usenix ifip springer siam aaai cvf sigact sigchi sigda sigplan sigsoft".split())
_EDGE_WORDS = frozenset("annual international joint conference symposium workshop meeting congress proceedings forum".split())


def cite_bucket(n: Column) -> Column:
    out = F.when(n.isNull(), F.lit(None).cast("string"))
    for b in CITE_BUCKETS:
        out = out.when(n >= b, f"{b}+")
    return out.otherwise("<10")


def source_weight(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(DEFAULT_WEIGHT))


def source_family(source: Column) -> Column:
    s = F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in FAMILIES:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise(s)


def default_publisher(canonical: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PUBLISHERS for x in pair]), canonical)


def build_tags(canonical: Column, year: Column, tier: Column, core: Column, acceptance: Column, citations: Column) -> Column:
    """The tags of a resolution, in this order; absent parts give none."""
    part = lambda label, v: F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{label}:"), v.cast("string")))
    dated = F.when(year != 0, year)
    made = [part("venue", canonical), part("year", dated), part("CCF2026", tier), part("CORE", core), F.concat(F.lit("acceptance:"), acceptance), part("cite", cite_bucket(citations))]
    return F.array_compact(F.array(*made))


def has_track_phrase(normal: Column) -> Column:
    """Whether a norm_venue text holds a track phrase, anywhere, inside words too."""
    return F.exists(F.array(*[F.lit(p) for p in TRACK_PHRASES]), lambda p: F.contains(normal, p))


def looks_like_acronym(name: Column) -> Column:
    raw = F.trim(blank(name))
    compact = F.regexp_replace(raw, "[^A-Za-z0-9]", "")
    capitals = F.length(F.regexp_replace(raw, "[^A-Z]", ""))
    return (F.length(compact) >= 4) & ((capitals >= 2) | ((compact == F.upper(compact)) & (capitals >= 1)))


def venue_variants(value: Column) -> Column:
    """The norm_venue form and, if different, the same without wrappers, years, ordinals and volumes."""
    whole = norm_venue(value)
    cut = whole
    for pattern in ("proceedings of the", "proceedings of", r"(?:19|20)\d{2}", r"\d+(?:st|nd|rd|th)", r"vol(?:ume)?\s*\d+"):
        cut = F.regexp_replace(cut, f"{LEFT}{pattern}{RIGHT}", " ")
    cut = F.trim(F.regexp_replace(cut, " +", " "))
    return F.array_distinct(F.filter(F.array(whole, cut), lambda v: v != ""))


def initialisms(name: str | None) -> list[str]:
    """The initialisms that a long venue name may go by, of 4 to 16 letters, in order of trust."""
    import re

    text = re.sub(r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])", " ", re.sub(r"\[[^\]]*\]", " ", unicodedata.normalize("NFKC", name or "")))
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if not w.isdigit() and w not in _STOP]
    if len(words) < 2:
        return []

    def trims(base: list[str]):
        start = next((i for i, w in enumerate(base) if w not in _PUBLISHER_WORDS and w not in _EDGE_WORDS), len(base))
        start = min(start, len(base) - 1)  # a sequence of two is trimmed to one at most
        yield from (base[i:] for i in range(1, start + 1))
        for part in (base, base[start:]):
            end = len(part)
            while end >= 2 and part[end - 1] in _EDGE_WORDS:
                end -= 1
                yield part[:end]

    bare = [w for w in words if w not in _PUBLISHER_WORDS]
    bases = [words] + ([bare] if len(bare) >= 2 else [])
    made = bases + [t for b in bases for t in trims(b) if len(t) >= 2]
    short = ["".join(w[0] for w in m).upper() for m in made]
    return list(dict.fromkeys(s for s in short if 4 <= len(s) <= 16))


@F.pandas_udf(T.ArrayType(T.StringType()))
def initialism_variants(names: pd.Series) -> pd.Series:
    return names.map(initialisms)


def item_kind(item_type: Column, conference: Column, proceedings: Column, abbreviation: Column, publication: Column) -> Column:
    """conference, journal or null: by the item's type, else by the fields it fills."""
    filled = lambda *cs: F.concat(*[blank(c) for c in cs]) != ""
    return (
        F.when(item_type == "conferencePaper", "conference").when(item_type == "journalArticle", "journal")
        .when(filled(conference, proceedings), "conference").when(filled(abbreviation, publication), "journal")
    )


def venue_label(item_type: Column, kind: Column, matched: Column, conference: Column, proceedings: Column, abbreviation: Column, publication: Column, publisher: Column) -> Column:
    """The text that an item shows as its venue."""
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    return (
        F.when(item_type == "preprint", "Preprint").when(kind == "conference", first(conference, matched, proceedings))
        .when(kind == "journal", first(abbreviation, matched, publication)).otherwise(first(publication, proceedings, publisher))
    )


def encode_tier(tier: Column, canonical: Column, domain: Column, full_name: Column) -> Column:
    """A sortable text of a match; empty without a tier."""
    order = F.when(tier == "A", "1").when(tier == "B", "2").when(tier == "C", "3").otherwise("9")
    return F.when(blank(tier) == "", "").otherwise(F.concat_ws(UNIT, order, tier, blank(canonical), blank(domain), blank(full_name)))


def decode_tier(value: Column) -> Column:
    """A struct (order, tier, canonical, domain, full_name) of such a text, else null."""
    parts = F.split(blank(value), UNIT)
    at = lambda i: F.get(parts, F.lit(i))
    made = F.struct(at(0).alias("order"), at(1).alias("tier"), at(2).alias("canonical"), at(3).alias("domain"), blank(at(4)).alias("full_name"))
    return F.when((F.size(parts) >= 4) & at(1).rlike("^[ABC]$"), made)


def dblp_slug(url: Column) -> Column:
    """The path segment after /db/conf/ of a bibliography url; empty if absent."""
    return F.regexp_extract(blank(url), r"(?i)/db/conf/([^/?#]+)", 1)
