"""Identity of two works: title similarity and author overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import has_phrase, jaccard_of, similarity_of, word_list


def verify_identity(title: Column, found: Column, creators: Column, authors: Column) -> Column:
    """A struct (ok, reason, score) for normalised titles, creators array<struct<family, given>> and authors array<string>.

    Names are normalised; creators are the query's authors in order. Equal or nearly equal titles pass
    without authors; else the first creator must be found, or two creators under a closer title.
    """
    jaccard, score = jaccard_of(title, found), similarity_of(title, found)
    a, b = F.size(word_list(title)), F.size(word_list(found))
    ratio = F.least(a, b) / F.greatest(a, b)
    people = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda x: x != "")
    wanted = F.coalesce(creators, F.array().cast("array<struct<family:string,given:string>>"))

    def same(q: Column, f: Column) -> Column:
        given = F.split(F.coalesce(q["given"], F.lit("")), " ")[0]
        family, words = F.coalesce(q["family"], F.lit("")), F.split(f, " ")
        fits = (given == "") | (F.length(given) == 1) | F.array_contains(words, given) | F.array_contains(words, F.substring(given, 1, 1))
        parts = F.filter(F.split(family, " "), lambda t: F.length(t) >= 4)
        partial = (F.length(given) > 1) & F.array_contains(words, given) & F.arrays_overlap(parts, words)
        return F.when((family != "") & has_phrase(f, family), fits).otherwise(partial)

    found_each = F.transform(wanted, lambda q: F.exists(people, lambda f: same(q, f)))
    overlaps = F.size(F.filter(found_each, lambda m: m))
    first = F.coalesce(F.get(found_each, F.lit(0)), F.lit(False))
    alone = (F.size(wanted) == 0) | (F.size(people) == 0)

    def result(ok: Column, reason: Column | str, value: Column) -> Column:
        return F.struct(ok.alias("ok"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), value.cast("double").alias("score"))

    none = F.lit(None).cast("double")
    reason = F.when(first | (overlaps >= 2), "title-and-authors").otherwise("author-mismatch")
    return (
        F.when((title == "") | (found == ""), result(F.lit(False), "missing-title", none))
        .when((jaccard < 0.82) & ~((score >= 0.90) & (ratio >= 0.70)), result(F.lit(False), "title-mismatch", none))
        .when(alone, result((title == found) | ((score >= 0.96) & (ratio >= 0.9)), "title-only", score))
        .otherwise(result(first | ((overlaps >= 2) & (score >= 0.92)), reason, score))
    )
