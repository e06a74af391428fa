"""Extraction from HTML, XML and JSON, as column expressions over whole pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import absolute_url, blank
from .text import collapse, title_similarity

MAX_ANCHORS = 5000
MAX_HEADINGS = 20
MAX_RECORDS = 50


@F.pandas_udf(T.StringType())
def _numeric_entities(values: pd.Series) -> pd.Series:
    def char(m) -> str:
        n = int(m[1], 16) if m[1] else int(m[2])
        return "" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    return values.str.replace(r"(?i)&#(?:x([0-9a-f]+)|([0-9]+));", char, regex=True)


def decode_html(text: Column) -> Column:
    """Numeric and the basic named entities; & is decoded before < and >, so twice-encoded ones resolve."""
    t = blank(text)
    numeric = _numeric_entities(F.when(t.rlike("(?i)&#(?:x[0-9a-f]+|[0-9]+);"), t))
    out = F.coalesce(numeric, t)
    for pattern, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.regexp_replace(out, f"(?i){pattern}", char)
    return out


def decode_xml(text: Column) -> Column:
    """The XML entities, & last, with white space collapsed."""
    out = blank(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def without_tags(html: Column) -> Column:
    """The html with scripts, styles and tags as spaces; entities stay."""
    out = blank(html)
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(out, "<[^>]+>", " ")


def html_to_text(html: Column) -> Column:
    return collapse(decode_html(without_tags(html)))


def html_attr(attributes: Column, name: str) -> Column:
    """An attribute's raw value, quoted or bare; empty if absent. Entities stay."""
    quoted = [F.regexp_extract(attributes, rf"(?is)(?:^|\s){name}\s*=\s*{q}([^{q}]*){q}", 1) for q in ("\"", "'")]
    bare = F.regexp_extract(attributes, rf"(?i)(?:^|\s){name}\s*=\s*([^\s>\"']+)", 1)
    return F.trim(F.coalesce(*[F.nullif(v, F.lit("")) for v in (*quoted, bare)], F.lit("")))


def meta_values(html: Column, *names: str) -> Column:
    """The contents of the meta tags whose name, property or itemprop is one of names, in document order; raw."""
    tags = F.regexp_extract_all(blank(html), F.lit(r"(?i)<meta\b([^>]*)>"), F.lit(1))

    def key(a: Column) -> Column:
        return F.lower(F.coalesce(*[F.nullif(html_attr(a, n), F.lit("")) for n in ("name", "property", "itemprop")], F.lit("")))

    kept = F.filter(tags, lambda a: key(a).isin(*[n.lower() for n in names]))
    return F.filter(F.transform(kept, lambda a: html_attr(a, "content")), lambda v: v != "")


def headings(html: Column) -> Column:
    """The texts of the first h1 to h3 that have any, then the page's title; entities stay."""
    plain = lambda v: collapse(without_tags(v))
    found = F.transform(F.regexp_extract_all(blank(html), F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"), F.lit(1)), plain)
    title = F.regexp_extract_all(blank(html), F.lit(r"(?is)<title\b[^>]*>(.*?)</title>"), F.lit(1))
    return F.concat(F.slice(F.filter(found, lambda v: v != ""), 1, MAX_HEADINGS), F.transform(F.slice(title, 1, 1), plain))


_ANCHOR = r"(?is)<a\b([^>]*\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*)>(.*?)</a>"


def anchor_parts(html: Column) -> Column:
    """array<struct<href, text>> of the first anchors, as written."""
    attributes = F.regexp_extract_all(blank(html), F.lit(_ANCHOR), F.lit(1))
    texts = F.regexp_extract_all(blank(html), F.lit(_ANCHOR), F.lit(2))
    pairs = F.zip_with(attributes, texts, lambda a, t: F.struct(html_attr(a, "href").alias("href"), collapse(without_tags(t)).alias("text")))
    return F.slice(pairs, 1, MAX_ANCHORS)


def anchors(pages, url: str = "url", html: str = "html"):
    """pages exploded to (all columns, pos, link, link_text): absolute links in document order; others are skipped."""
    each = pages.select("*", F.posexplode(anchor_parts(F.col(html))).alias("pos", "_a"))
    linked = each.withColumn("link", absolute_url(F.col(url), decode_html(F.col("_a.href")))).withColumn("link_text", decode_html(F.col("_a.text")))
    return linked.drop("_a").where("link IS NOT NULL")


def best_title_score(html: Column, title: Column, other: Column | None = None) -> Column:
    """The best similarity of title to the page's title tags, headings and another candidate."""
    names = ("citation_title", "dc.title", "dcterms.title", "og:title", "twitter:title")
    made = F.concat(F.array(blank(other) if other is not None else F.lit("")), meta_values(html, *names), headings(html))
    return F.coalesce(F.array_max(F.transform(F.filter(made, lambda v: v != ""), lambda v: _plain_similarity(title, v))), F.lit(0.0))


def _plain_similarity(a: Column, b: Column) -> Column:
    """title_similarity without the Unicode step, which cannot run inside an array function."""
    from .text import similarity_of

    plain = lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.lower(v), "&(?:amp|lt|gt|quot|apos);", " "), r"[^\p{L}\p{N}]+", " "))
    return similarity_of(plain(a), plain(b))


def xml_tag(block: Column, tag: str) -> Column:
    """The text of the first element of that name; empty if absent."""
    return decode_xml(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def xml_blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(blank(xml), F.lit(rf"(?is)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)"), F.lit(1))


def table_cell(html: Column, label: str, cls: str) -> Column:
    """The last cell of the first table row that is labelled so, else the cell of that class; raw text."""
    row = F.regexp_extract(html, rf"(?is)<tr\b[^>]*>((?:(?!</tr>).)*?{label}\s*:(?:(?!</tr>).)*)</tr>", 1)
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    named = F.regexp_extract(html, rf"(?is)<td\b[^>]*class=[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*>(.*?)</td>", 1)
    return html_to_text(F.when(F.size(cells) > 1, F.element_at(cells, -1)).otherwise(named))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_ld(html: pd.Series) -> pd.Series:
    """The scholarly records of a page's JSON-LD scripts, each as JSON; graphs are flattened, broken scripts skipped."""
    import re

    script = re.compile(r"""<script\b[^>]*type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", re.I)

    def records(page: str | None) -> list[str]:
        out: list[str] = []
        for body in script.findall(page or ""):
            try:
                parsed = json.loads(body)
            except ValueError:
                continue
            queue = list(parsed) if isinstance(parsed, list) else [parsed]
            while queue and len(out) < MAX_RECORDS:
                one = queue.pop(0)
                if not isinstance(one, dict):
                    continue
                if isinstance(one.get("@graph"), list):
                    queue += one["@graph"]
                kind = one.get("@type") or ""
                if re.search("ScholarlyArticle|Article|CreativeWork", ",".join(map(str, kind)) if isinstance(kind, list) else str(kind), re.I):
                    out.append(json.dumps(one))
        return out

    return html.map(records)


def wrapped(record: Column, key: str) -> Column:
    """$.key of a JSON text, or $.key.value where it is wrapped so."""
    return F.coalesce(F.get_json_object(record, f"$.{key}.value"), F.get_json_object(record, f"$.{key}"))


def first_text(values: Column) -> Column:
    """The first element that is not blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))


def page_contains(text: Column, title: Column, lastname: Column, context: Column) -> Column:
    """Whether a page's text holds a paper: its title, nearly or exactly, and near it the author's name; all but context and title normalised."""
    from .text import norm_person, norm_title

    normal = norm_title(title)
    titled = (title_similarity(title, context) >= 0.93) | ((normal != "") & F.contains(text, normal))
    return titled & ((lastname == "") | F.contains(norm_person(context), lastname))
