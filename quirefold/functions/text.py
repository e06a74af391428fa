"""Text normalisation and title similarity as column expressions.

Unicode normal forms are the only Python here: they go through an Arrow UDF that sees a value only if it
holds a character beyond ASCII. All else is built from JVM functions. Null counts as empty.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the sense of Unicode-aware trimming, as a Java character class.
SPACE = r"[\s ﻿  \p{Zs}]"

#: Words that stay lower-case inside a title.
TITLE_STOPWORDS = ("a", "an", "the", "of", "for", "and", "in", "on", "to", "at", "via")


def _form(name: str):
    @F.pandas_udf(T.StringType())
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(name, v), na_action="ignore")

    return form


def _normal(text: Column, name: str) -> Column:
    beyond = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_form(name)(beyond), text, F.lit(""))


def nfkd(text: Column) -> Column:
    return _normal(text, "NFKD")


def nfkc(text: Column) -> Column:
    return _normal(text, "NFKC")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def norm_title(text: Column) -> Column:
    """Compatibility-decomposed, lower-cased, without marks, entities and punctuation."""
    plain = F.regexp_replace(F.lower(nfkd(text)), r"\p{M}", "")
    return _letters(F.regexp_replace(plain, "&(?:amp|lt|gt|quot|apos);", " "))


def norm_person(text: Column) -> Column:
    """As norm_title, but entities are ordinary text."""
    return _letters(F.regexp_replace(F.lower(nfkd(text)), r"\p{M}", ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def norm_people(names: pd.Series) -> pd.Series:
    """norm_person of each name of an array, in place; null names are empty, a null array has none."""

    def one(name: str | None) -> str:
        plain = unicodedata.normalize("NFKD", name or "").lower()
        return re.sub(r"[\W_]+", " ", "".join(c for c in plain if unicodedata.category(c)[0] != "M")).strip()

    return names.map(lambda v: [one(n) for n in v] if v is not None else [])


def norm_venue(text: Column) -> Column:
    """Composed, lower-cased; accents stay, apostrophes vanish and & reads and."""
    return _letters(F.replace(F.regexp_replace(F.lower(nfkc(text)), "[’']", ""), F.lit("&"), F.lit(" and ")))


def norm_listing(text: Column) -> Column:
    """The normal form of catalogue listings: like norm_venue, but an apostrophe separates."""
    return _letters(F.replace(F.lower(nfkc(text)), F.lit("&"), F.lit(" and ")))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_list(normal: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def jaccard_of(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two normalised texts; 0 if one is empty."""
    wa, wb = word_list(a), word_list(b)
    score = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(score)


def similarity_of(a: Column, b: Column) -> Column:
    """Jaccard similarity, or containment of the smaller word set if it has three words or more, whichever is larger."""
    wa, wb = F.array_distinct(word_list(a)), F.array_distinct(word_list(b))
    both = F.size(F.array_intersect(wa, wb))
    small, large = F.least(F.size(wa), F.size(wb)), F.greatest(F.size(wa), F.size(wb))
    jaccard = both / F.size(F.array_union(wa, wb))
    contained = (both / small) * (F.lit(0.82) + F.lit(0.18) * (small / large))
    score = F.when(both == 0, F.lit(0.0)).when(small < 3, jaccard).otherwise(F.greatest(jaccard, contained))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(score)


def title_jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(norm_title(a), norm_title(b))


def title_similarity(a: Column, b: Column) -> Column:
    return similarity_of(norm_title(a), norm_title(b))


def title_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    return title_similarity(a, b) >= threshold


def first_author_lastname(creators: Column) -> Column:
    """The last name of the first creator who is an author and has one; else empty."""
    named = F.filter(creators, lambda c: (c["creatorType"] == "author") & (c["lastName"] != ""))
    return F.coalesce(F.get(named, F.lit(0))["lastName"], F.lit(""))


def has_phrase(words: Column, phrase: Column) -> Column:
    """Whether phrase stands in words on word boundaries; both normalised."""
    return F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def author_matches(lastname: Column, authors: Column) -> Column:
    """Whether a normalised last name is a word or phrase of any normalised author; an empty one always matches."""
    return (lastname == "") | F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: (a != "") & has_phrase(a, lastname))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def smart_title(text: Column, stopwords: tuple[str, ...] = TITLE_STOPWORDS) -> Column:
    """Each word with a capital, but for stop-words after the first; the rest of a word stays as it is."""
    words = word_list(collapse(text))
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*stopwords), F.lower(w)).otherwise(_capital(w)))
    return F.array_join(cased, " ")


def display_title(text: Column) -> Column:
    """smart_title for texts without any capital letter; others stay."""
    return F.when(text.rlike("[A-Z]"), text).otherwise(smart_title(text))


def unique_by(values: Column, keys: Column) -> Column:
    """values, trimmed and in order, whose key (same place in keys) is not empty and not seen before."""
    pairs = F.zip_with(values, keys, lambda v, k: F.struct(F.trim(v).alias("v"), k.alias("k")))
    kept = F.filter(pairs, lambda p, i: (p["v"] != "") & (p["k"] != "") & ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: (q["k"] == p["k"]) & (q["v"] != "")))
    return F.transform(kept, lambda p: p["v"])


def title_head(title: Column) -> Column:
    """What stands before the first colon."""
    return F.split(F.coalesce(title, F.lit("")), "[:：]", 2)[0]


def query_variants(title: Column) -> Column:
    """Search strings for a title, four at most, all different: itself with plain dashes, normalised, its head
    if that has three words, its first ten words if there are more than twelve."""
    whole = collapse(F.regexp_replace(nfkc(title), "[‐‑‒–—−]", "-"))
    normal = norm_title(whole)
    head, words = F.trim(title_head(whole)), word_list(normal)
    long_head = F.when(F.size(word_list(norm_title(head))) >= 3, head)
    short = F.when(F.size(words) > 12, F.array_join(F.slice(words, 1, 10), " "))
    made = F.filter(F.array(whole, normal, long_head, short), lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(made), 1, 4)


def paper_context(text: Column, title: Column, radius: int = 2400) -> Column:
    """The text up to radius characters around the title (or its first 42 characters), else the beginning."""
    t, needle = F.coalesce(text, F.lit("")), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    exact = F.when(needle != "", F.instr(F.lower(t), needle)).otherwise(0)
    at = F.when(exact > 0, exact).when(needle != "", F.instr(F.lower(t), F.substring(needle, 1, 42))).otherwise(0)
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at == 0, F.substring(t, 1, 2 * radius)).otherwise(F.substr(t, start, at + F.length(needle) + radius - start))
