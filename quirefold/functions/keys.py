"""Identifiers, years, DOIs and hosts out of semi-structured text, as column expressions."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: New-style preprint ids, alone and after their scheme.
_ID = r"(\d{4}\.\d{4,5})"
_TAGGED = rf"(?i)arxiv[:.\s/]*?{_ID}"

#: Hosts of official proceedings and publishers.
OFFICIAL_HOSTS = (
    "proceedings.mlr.press", "proceedings.mlsys.org", "proceedings.ijcai.org", "www.ijcai.org", "drops.dagstuhl.de", "usenix.org", "ndss-symposium.org",
    "openaccess.thecvf.com", "cv-foundation.org", "aclanthology.org", "aclweb.org", "jmlr.org", "proceedings.neurips.cc", "dl.acm.org", "acm.org",
    "ieeexplore.ieee.org", "computer.org", "ieee.org", "link.springer.com", "dagstuhl.de", "ojs.aaai.org", "proceedings.aaai.org", "aaai.org",
    "openreview.net", "iacr.org", "eprint.iacr.org", "ieee-security.org", "sigsac.org",
)


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it does not match or is empty."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def arxiv_id(archive_id: Column, doi: Column, url: Column, extra: Column) -> Column:
    """The preprint id, from archive id, DOI, url and extra in this order; all but the DOI's must be marked as such."""

    def either(v: Column) -> Column:
        return F.coalesce(found(v, _TAGGED), found(v, rf"{_ID}(?:v\d+)?"))

    marked = lambda v: F.contains(F.lower(v), F.lit("arxiv"))
    a = blank(archive_id)
    first = F.when(marked(a) | F.trim(a).rlike(rf"(?i)^{_ID}(v\d+)?$"), either(a))
    rest = [F.when(marked(blank(v)), either(blank(v))) for v in (url, extra)]
    return F.coalesce(first, found(blank(doi), _TAGGED), *rest)


def item_year(date: Column) -> Column:
    """The first four digits anywhere that begin with 19 or 20; digits around them do not matter."""
    return found(F.trim(blank(date)), "((?:19|20)[0-9]{2})").cast("int")


def year_from_text(text: Column) -> Column:
    """The first 19xx or 20xx that stands apart from other digits."""
    return found(blank(text), "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)").cast("int")


def full_year(number: Column) -> Column:
    """A year of two or four digits in full: 70 to 99 are 19xx, less are 20xx."""
    return F.when(number >= 1900, number).when(number >= 70, number + 1900).otherwise(number + 2000)


def review_year(venue_id: Column, venue: Column, stamp: Column) -> Column:
    """The year in a venue id, else in the venue, else of a time stamp in seconds or milliseconds (UTC)."""
    millis = F.when(stamp < 10_000_000_000, stamp * 1000).otherwise(stamp)
    dated = F.when(stamp > 0, F.year(F.timestamp_millis(millis.cast("long"))))
    return F.coalesce(year_from_text(venue_id), year_from_text(venue), dated)


#: Where a work's date is looked up, most formal first; the last gives a year only.
DATE_KEYS = ("published-print", "published-online", "published", "issued", "created")


def parts_year(record: str, keys: tuple[str, ...] = DATE_KEYS) -> Column:
    """The year of the first key of a struct column whose date-parts hold one in 1801 to 2199."""
    years = [F.get(F.get(F.col(f"{record}.`{k}`.`date-parts`"), F.lit(0)), F.lit(0)) for k in keys]
    return F.coalesce(*[F.when((y > 1800) & (y < 2200), y) for y in years]).cast("int")


def parts_date(record: str, keys: tuple[str, ...] = DATE_KEYS[:-1]) -> Column:
    """The first complete date among the keys of a struct column as YYYY-MM-DD."""
    dates = []
    for k in keys:
        y, m, d = (F.get(F.get(F.col(f"{record}.`{k}`.`date-parts`"), F.lit(0)), F.lit(i)) for i in range(3))
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        dates.append(F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", y.cast("string"), two(m), two(d))))
    return F.coalesce(*dates)


def is_arxiv_doi(doi: Column) -> Column:
    return F.contains(F.lower(blank(doi)), F.lit("arxiv"))


def strip_doi_url(doi: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(blank(doi), r"(?i)^https?://(?:dx\.)?doi\.org/", "")), F.lit(""))


def formal_doi(doi: Column) -> Column:
    """A well-formed DOI that is no preprint's, else null."""
    bare = strip_doi_url(doi)
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$") & ~is_arxiv_doi(bare), bare)


def doi_path(doi: Column) -> Column:
    """A DOI for a url path: each segment percent-encoded."""
    parts = F.transform(F.split(blank(strip_doi_url(doi)), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.array_join(parts, "/")


def formal_dois(*texts: Column) -> Column:
    """The DOIs in texts, in order, without trailing punctuation, preprints' and repeats (ignoring case)."""
    each = [F.regexp_extract_all(blank(t), F.lit(r"(?i)10\.\d{4,9}/[A-Z0-9._;()/:+-]+"), F.lit(0)) for t in texts]
    bare = F.transform(F.flatten(F.array(*each)), lambda d: F.regexp_replace(d, r"[\],.;:)}]+$", ""))
    kept = F.filter(bare, lambda d: (d != "") & ~F.contains(F.lower(d), F.lit("arxiv")))
    return F.filter(kept, lambda d, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda e: F.lower(e) == F.lower(d)))


def is_nonvenue(venue: Column) -> Column:
    """Whether a venue string names no venue: empty, or a preprint server."""
    v = F.lower(F.trim(blank(venue)))
    return v.isin("", "corr", "preprint") | F.contains(v, F.lit("arxiv"))


def host_of(url: Column) -> Column:
    """The host, lower-cased, without www.; empty if there is none."""
    return blank(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""))


def is_official_host(host: Column, hosts: tuple[str, ...] = OFFICIAL_HOSTS) -> Column:
    """Whether a host is one of hosts or a subdomain of one: its suffixes are looked up, so the list may be long."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(suffixes, F.array(*[F.lit(h) for h in hosts]))


def official_venue(url: Column) -> Column:
    """A struct (venue, year) that a proceedings url names, else null."""
    u = blank(url)

    def at(pattern: str, venue: Column | str, year: int) -> Column:
        name = F.lit(venue) if isinstance(venue, str) else venue
        return F.when(u.rlike(pattern), F.struct(name.alias("venue"), full_year(F.try_to_number(found(u, pattern, year), F.lit("9999")).cast("int")).alias("year")))

    usenix = r"(?i)usenix\.org/conference/"
    group = rf"{usenix}(nsdi|osdi|fast|soups|lisa|hotstorage|hotsec)(\d{{2,4}})(?:/|$)"
    cvf = r"(?i)openaccess\.thecvf\.com/(CVPR|ICCV|WACV)(\d{4})"
    acl = r"(?i)aclanthology\.org/((?:19|20)\d{2})\.(acl|emnlp|naacl|coling|conll)(?:[-./]|$)"
    short = F.upper(F.regexp_extract(u, acl, 2))
    ndss = F.struct(F.lit("NDSS").alias("venue"), found(u, r"(?i)(?:ndss|symposium)[^0-9]{0,8}((?:19|20)\d{2})").cast("int").alias("year"))
    return F.coalesce(
        at(rf"{usenix}usenixsecurity(\d{{2,4}})(?:/|$)", "USENIX Security", 1),
        at(group, F.regexp_extract(u, group, 1), 2),
        at(rf"{usenix}(?:usenix)?atc(\d{{2,4}})(?:/|$)", "USENIX ATC", 1),
        at(cvf, F.upper(F.regexp_extract(u, cvf, 1)), 2),
        at(r"(?i)proceedings\.neurips\.cc/(?:paper_files/paper/)?((?:19|20)\d{2})(?:/|$)", "NeurIPS", 1),
        at(acl, F.when(short == "CONLL", F.lit("CoNLL")).otherwise(short), 1),
        F.when(u.rlike(r"(?i)ndss-symposium\.org"), ndss),
    )


def http_url(url: Column) -> Column:
    """An https url with a public, dotted host (lower-cased) and no fragment, else null."""
    pattern = r"(?i)^https://([^/?#]+)([^#]*)"
    host, rest = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    public = host.rlike(r"(?i)^(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,}$") & ~host.rlike(r"(?i)(?:^|\.)(?:localhost|local|internal|invalid|test)$")
    return F.when(public, F.concat(F.lit("https://"), F.lower(host), F.coalesce(F.nullif(rest, F.lit("")), F.lit("/"))))


def host_family(host: Column) -> Column:
    """The pacing group of a host: mirrors of one service are one."""
    h = blank(host)
    return (
        F.when(h.rlike(r"(?i)^(?:www\.)?dblp\.(?:org|uni-trier\.de)$"), "dblp")
        .when(h.isin("arxiv.org", "export.arxiv.org"), "arxiv")
        .when(h.rlike(r"(?i)(?:^|\.)duckduckgo\.com$"), "duckduckgo")
        .otherwise(h)
    )


def safe_url(url: Column) -> Column:
    """The url with secret query parameters redacted."""
    return F.regexp_replace(blank(url), r"(?i)([?&](?:api_key|apikey|secretkey|token|key)=)[^&#]*", "$1[REDACTED]")


def request_key(*parts: Column) -> Column:
    """A compact key of a request; only equality matters."""
    return F.xxhash64(*parts)


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds to wait by a Retry-After header: seconds or a date, a minute by default, a second at least."""
    seconds = F.when(value.rlike(r"^\s*\d+(?:\.\d+)?\s*$"), F.trim(value).try_cast("double") * 1000)
    date = F.try_to_timestamp(F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, F.unix_millis(date) - now_ms, F.lit(60000))
    return F.greatest(wait, F.lit(1000)).cast("long")


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href against base; null for scripts, mail addresses, fragments and what is no url."""

    def join(b: str | None, h: str | None) -> str | None:
        h = (h or "").strip()
        if not h or h.lower().startswith(("javascript:", "mailto:", "#")):
            return None
        try:
            made = urllib.parse.urljoin(b or "", h)
            parts = urllib.parse.urlsplit(made)
        except ValueError:
            return None
        return urllib.parse.urlunsplit(parts._replace(path=parts.path or "/")) if parts.scheme and parts.netloc else None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)
