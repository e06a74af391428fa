"""Hand-derived golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import keys as K
from quirefold.functions import labels as L
from quirefold.functions import markup as M
from quirefold.functions import text as T


def value(spark, column, **inputs):
    types = {k: ("bigint" if isinstance(v, int) else "array<string>" if isinstance(v, list) else "string") for k, v in inputs.items()}
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items())
    frame = spark.createDataFrame([tuple(inputs.values())], schema) if inputs else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


def c(name):
    return F.col(name)


@pytest.mark.parametrize(("text", "want"), [("Attention Is All You Need!", "attention is all you need"), ("Café &amp; ﬁne", "cafe fine"), (None, ""), ("", "")])
def test_norm_title(spark, text, want):
    assert value(spark, T.norm_title(c("a")), a=text) == want


def test_norm_venue_keeps_accents(spark):
    assert value(spark, T.norm_venue(c("a")), a="Café S&P’s") == "café s and ps"
    assert value(spark, T.norm_listing(c("a")), a="S&P’s") == "s and p s"


@pytest.mark.parametrize(("a", "b", "jaccard", "similarity"), [
    ("deep learning", "deep learning for vision", 0.5, 0.5), ("a b c", "a b c d e f", 0.5, 0.91), ("", "x", 0.0, 0.0), ("x y", "X  Y!", 1.0, 1.0)])
def test_similarity(spark, a, b, jaccard, similarity):
    assert value(spark, T.title_jaccard(c("a"), c("b")), a=a, b=b) == pytest.approx(jaccard)
    assert value(spark, T.title_similarity(c("a"), c("b")), a=a, b=b) == pytest.approx(similarity)


def test_years(spark):
    assert value(spark, K.item_year(c("a")), a="120245") == 2024
    assert value(spark, K.year_from_text(c("a")), a="120245") is None
    assert [value(spark, K.full_year(F.lit(n))) for n in (24, 70, 99, 1998)] == [2024, 1970, 1999, 1998]


@pytest.mark.parametrize(("n", "want"), [(None, None), (9, "<10"), (10, "10+"), (9999, "5000+"), (10000, "10000+")])
def test_cite_bucket(spark, n, want):
    assert value(spark, L.cite_bucket(F.lit(n).cast("long"))) == want


@pytest.mark.parametrize(("field", "text", "want"), [
    ("a", "arXiv:1706.03762v5", "1706.03762"), ("d", "10.48550/arXiv.1706.03762", "1706.03762"), ("u", "https://arxiv.org/abs/1706.03762", "1706.03762"),
    ("e", "1706.03762", None), ("a", "1706.03762v1", "1706.03762"), ("u", "https://arxiv.org/abs/hep-th/9901001", None)])
def test_arxiv_id(spark, field, text, want):
    fields = {k: text if k == field else None for k in "adue"}
    assert value(spark, K.arxiv_id(c("a"), c("d"), c("u"), c("e")), **fields) == want


def test_formal_dois(spark):
    got = value(spark, K.formal_dois(c("d"), c("e")), d="10.48550/arXiv.1706.03762", e="see 10.1145/3292500.3330701).")
    assert got == ["10.1145/3292500.3330701"]


def test_smart_title(spark):
    assert value(spark, T.smart_title(c("a")), a="learning for THE web") == "Learning for the Web"
    assert value(spark, T.display_title(c("a")), a="learning Of x") == "learning Of x"


def test_entities(spark):
    assert value(spark, M.decode_html(c("a")), a="&amp;lt;") == "<"
    assert value(spark, M.decode_xml(c("a")), a="&amp;lt;") == "&lt;"
    assert value(spark, M.decode_html(c("a")), a="&#x41;&#66;&#xD800;") == "AB"


def test_unique_and_authors(spark):
    assert value(spark, T.unique_by(c("a"), F.transform(c("a"), lambda v: F.lower(F.trim(v)))), a=["B ", "b", "", "a", "B"]) == ["B", "a"]
    assert value(spark, T.author_matches(F.lit(""), c("a")), a=["x"]) is True
    assert value(spark, T.author_matches(F.lit("le cun"), c("a")), a=["yann le cun"]) is True


def test_query_variants(spark):
    got = value(spark, T.query_variants(c("a")), a="Deep Nets – A Study: of things")
    assert got[0] == "Deep Nets - A Study: of things" and len(got) <= 4


def test_tags(spark):
    made = L.build_tags(F.lit("X"), F.lit(2025), F.lit("A"), F.lit("A*"), F.lit("accepted"), F.lit(120))
    assert value(spark, made) == ["venue:X", "year:2025", "CCF2026:A", "CORE:A*", "acceptance:accepted", "cite:100+"]


def test_track_phrase_is_a_substring(spark):
    assert value(spark, L.has_track_phrase(c("a")), a="on democracy") is True


def test_json_ld(spark):
    page = '<script type="application/ld+json">{"@graph": [{"@type": "ScholarlyArticle", "name": "n"}, {"@type": "Thing"}]}</script><script type="application/ld+json">broken</script>'
    assert len(value(spark, M.json_ld(c("a")), a=page)) == 1


def test_urls(spark):
    assert value(spark, K.http_url(c("a")), a="https://Example.ORG/x#f") == "https://example.org/x"
    assert value(spark, K.http_url(c("a")), a="https://localhost/x") is None
    assert value(spark, K.safe_url(c("a")), a="https://h/?api_key=1&b=2") == "https://h/?api_key=[REDACTED]&b=2"
    assert value(spark, K.absolute_url(c("a"), c("b")), a="https://h/x/y", b="../z") == "https://h/z"
    assert value(spark, K.doi_path(c("a")), a="https://doi.org/10.1/a b") == "10.1/a%20b"
