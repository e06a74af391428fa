"""Queries of venue lookup on the driver's tables, over the invented catalogue, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_venue
from ..operators.lookup import find_in_text, lookup, lookup_core, lookup_slug, rank
from . import fixture
from .queries import _VENUE, _t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Venue strings by p_partkey % 12, with what the catalogue says: (value, kind, canonical, tier, matched_by, ambiguous).
_CASES = (
    ("Zeta Learning Conference", None, "ZLearn", "A", "exact", False),
    ("Proceedings of ZLEARN 2024", None, "ZLearn", "A", "exact", False),
    ("ambi", "conference", None, None, "exact", True),
    ("TWIN", "journal", "TWIN", "B", "exact", False),
    ("Notes of the ZL 2020 gathering", None, "ZL", "B", "acronym-token", False),
    ("notes of the zl 2020 gathering", None, None, None, None, None),
    ("Big MoZaic gathering", None, "MoZaic", "C", "acronym-token", False),
    ("Annual Symposium on Nice Data Xrays", None, "SNDX", "A", "derived-initialism", False),
    ("Proceedings of the Symposium on Networked Data Exchange, vol. 3 series", None, "SNDX", "A", "long-name", False),
    ("Symposium on Networked Data Exchange and Others", None, None, None, None, None),
    ("Workshop at ZLearn", None, None, None, None, None),
    ("S&Q", "conference", "S&Q", "A", "exact", False),
)


def _values(cases) -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(quote(v) for v in c)})" for i, c in enumerate(cases))


def _asked(spark, sf, cases) -> DataFrame:
    dim = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, value string, kind string")
    part = _t(spark, sf, "part", "p_partkey").withColumn("i", (F.col("p_partkey") % len(cases)).cast("int"))
    return part.join(F.broadcast(dim), "i")


@query(f"SELECT p_partkey, value, canonical, tier, matched_by, ambiguous FROM part JOIN (VALUES {_values(_CASES)}) AS c(i, value, kind, canonical, tier, matched_by, ambiguous) ON p_partkey % {len(_CASES)} = i")
def q_lookup_stages(spark, sf):
    asked = _asked(spark, sf, _CASES)
    found = lookup(asked.select("value", "kind"), fixture.index(spark)).select("value", F.col("kind").alias("_k"), "match")
    joined = asked.join(found, (asked.value == found.value) & asked.kind.eqNullSafe(found["_k"]), "left").drop(found.value)
    return joined.select("p_partkey", "value", "match.canonical", "match.tier", "match.matched_by", "match.ambiguous")


_EXACT = ", ".join(f"('{a.lower()}', '{n}')" for a, n in (("standard anodized tin", "SAT"), ("economy polished steel", "EPS"), ("promo burnished copper", "PBC")))


@query(f"SELECT p_partkey, c.n AS canonical FROM part LEFT JOIN (VALUES {_EXACT}) AS c(a, n) ON {_VENUE.format('p_type')} = c.a")
def q_lookup_exact(spark, sf):
    names = [("standard anodized tin", "SAT"), ("economy polished steel", "EPS"), ("promo burnished copper", "PBC")]
    dim = spark.createDataFrame(names, "norm string, canonical string")
    part = _t(spark, sf, "part", "p_partkey", "p_type").withColumn("norm", norm_venue(F.col("p_type")))
    return part.join(F.broadcast(dim), "norm", "left").select("p_partkey", "canonical")


@query(f"SELECT p_partkey, p_partkey % {len(_CASES)} = 2 AS ambiguous FROM part")
def q_lookup_ambiguous(spark, sf):
    asked = _asked(spark, sf, _CASES)
    found = lookup(asked.select("value", "kind"), fixture.index(spark))
    return asked.join(found.select("value", "match.ambiguous"), "value", "left").select("p_partkey", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ZLearn' WHEN 1 THEN 'AMBI' END AS canonical, CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS ambiguous FROM part")
def q_lookup_slug(spark, sf):
    k = F.col("p_partkey")
    urls = _t(spark, sf, "part", "p_partkey").withColumn("url", F.when(k % 3 == 0, "conf/zlearn/Smith24").when(k % 3 == 1, "https://dblp.org/rec/conf/ambi/x").otherwise("journals/x/y"))
    found = lookup_slug(urls, fixture.index(spark))
    out = urls.join(found, "url", "left")
    return out.select("p_partkey", F.when(F.col("match.ambiguous"), F.element_at(F.array(F.lit("AMBI")), 1)).otherwise(F.col("match.canonical")).alias("canonical"), "match.ambiguous")


_CORE_CASES = (
    ("zl conf", None, "ZLearn"),
    ("Proceedings of ZL Conf 2021", None, "ZLearn"),
    ("ZL Conf Workshop", None, None),
    ("economy anodized steel", None, None),
    ("The Economy conference", None, "ECONOMY"),
)


@query(f"SELECT p_partkey, value, core FROM part JOIN (VALUES {_values(_CORE_CASES)}) AS c(i, value, kind, core) ON p_partkey % {len(_CORE_CASES)} = i")
def q_lookup_core(spark, sf):
    asked = _asked(spark, sf, _CORE_CASES)
    found = lookup_core(asked, fixture.index(spark)).select("value", F.col("core.canonical").alias("core"))
    return asked.join(found, "value", "left").select("p_partkey", "value", "core")


#: (value, kind, canonical, kind of the venue, core tier, tier)
_RANK_CASES = (
    ("ZL conf", None, "ZL", "conference", "A*", "B"),
    ("zl conf", None, "ZLearn", "conference", "A*", "A"),
    ("oldsnd", None, "OLD SND", "conference", "A", ""),
    ("SNDX", None, "SNDX", "conference", "A", "A"),
    ("TWIN", "journal", "TWIN", "journal", "", "B"),
    ("unknown things", None, None, None, None, None),
)


@query(f"SELECT p_partkey, canonical, vkind, core, tier FROM part JOIN (VALUES {_values(_RANK_CASES)}) AS c(i, value, kind, canonical, vkind, core, tier) ON p_partkey % {len(_RANK_CASES)} = i")
def q_core_compose(spark, sf):
    asked = _asked(spark, sf, _RANK_CASES)
    found = rank(asked, fixture.index(spark)).select("value", "venue")
    return asked.join(found, "value", "left").select("p_partkey", "venue.canonical", F.col("venue.kind").alias("vkind"), "venue.core", "venue.tier")


#: (text, row_ord, score, quality)
_TEXT_CASES = (
    ("We present it at the International Conference on Zeta Learning this year", 0, 12, "phrase"),
    ("accepted at MoZaic soon", 6, 8, "exact_case"),
    ("accepted at mozaic soon", 6, 3, "case_insensitive"),
    ("accepted at SNDX and MoZaic", None, None, None),
    ("nothing here", None, None, None),
)


def _text_values() -> str:
    return ", ".join(f"({i}, '{t}', {'NULL' if r is None else r}, {'NULL' if s is None else s}, {'NULL' if q is None else repr(q)})" for i, (t, r, s, q) in enumerate(_TEXT_CASES))


@query(f"SELECT p_partkey, row_ord::INTEGER AS row_ord, score::INTEGER AS score, quality FROM part JOIN (VALUES {_text_values()}) AS c(i, value, row_ord, score, quality) ON p_partkey % {len(_TEXT_CASES)} = i")
def q_unique_top(spark, sf):
    asked = _asked(spark, sf, [(t, None) for t, *_ in _TEXT_CASES])
    found = find_in_text(asked.select(F.col("value").alias("text")), fixture.index(spark))
    return asked.join(found, asked.value == found.text, "left").select("p_partkey", "row_ord", "score", "quality")


_PHRASES = ("of the in", "that the of", "with the and", "the of and")


@query("SELECT doc_id, list_aggregate(list_sort(list(phrase)), 'string_agg', '|') AS phrases FROM (SELECT doc_id, phrase FROM (SELECT doc_id, " + _VENUE.format("text") + " AS n FROM documents), (VALUES " + ", ".join(f"('{p}')" for p in _PHRASES) + ") AS v(phrase) WHERE contains(' ' || n || ' ', ' ' || phrase || ' ')) GROUP BY doc_id")
def q_lookup_long(spark, sf):
    from ..operators.lookup import _ngrams

    dim = spark.createDataFrame([(p,) for p in _PHRASES], "gram string")
    docs = _t(spark, sf, "documents", "doc_id", "text").withColumn("tokens", F.split(norm_venue(F.col("text")), " "))
    grams = docs.select("doc_id", F.explode(_ngrams("tokens", [3])).alias("g")).select("doc_id", F.col("g.gram").alias("gram"))
    found = grams.join(F.broadcast(dim), "gram").groupBy("doc_id").agg(F.array_sort(F.collect_set("gram")).alias("p"))
    return found.select("doc_id", F.array_join("p", "|").alias("phrases"))
