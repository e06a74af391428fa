"""A small invented catalogue for tests and queries; the real one is an input with its publisher's rights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalogue import CATALOGUE, Index, build_index

RANKINGS = "ord int, canonical string, kind string, core_tier string, aliases string, write_as string"

#: (canonical, kind, tier, domain, aliases, full_name, publisher, dblp_slug)
_ROWS = (
    ("ZLearn", "conference", "A", "learning", ("Zeta Learning Conference",), "International Conference on Zeta Learning", "ZPress", "zlearn"),
    ("ZL", "conference", "B", "learning", (), "Zeta Letters Meeting on Logic", "ZPress", "zl"),
    ("AMBI", "conference", "A", "systems", ("amb",), "Ambient Systems Conference First", "APress", "ambi"),
    ("AMBI", "conference", "B", "security", ("amb",), "Ambit Security Conference Second", "BPress", "ambi"),
    ("TWIN", "journal", "B", "systems", (), "Transactions on Winning", "TPress", ""),
    ("TWIN", "journal", "B", "theory", (), "Transactions on Winning", "", ""),
    ("MoZaic", "conference", "C", "graphics", (), "Symposium on Mosaic Zones and Icons", "MPress", "mozaic"),
    ("SNDX", "conference", "A", "networks", (), "Symposium on Networked Data Exchange", "SPress", "sndx"),
    ("S&Q", "conference", "A", "security", (), "IEEE Symposium on Safety and Quality", "IEEE", "sq"),
    ("LARGE POLISHED", "journal", "C", "materials", ("JLPB",), "Journal of Large Polished Brass", "JPress", ""),
)
_CORE = (
    ("ZLearn", "conference", "A*", "zl conf|international conference on zeta learning", "Proceedings of Zeta Learning"),
    ("OLD SND", "conference", "A", "oldsnd|sndx", ""),
    ("ECONOMY", "journal", "B", "economy anodized|economy", "Economy Review"),
)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(i, c, k, t, d, list(a), f, p, f"https://dblp.org/db/conf/{s}/" if s else "", s) for i, (c, k, t, d, a, f, p, s) in enumerate(_ROWS)]
    return spark.createDataFrame(rows, CATALOGUE)


def rankings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(_CORE)], RANKINGS)


def index(spark: SparkSession) -> Index:
    return build_index(catalogue(spark), rankings(spark))
