"""Queries that run each operator on the driver's tables, with equivalent DuckDB SQL.

The tables have no bibliographic columns, so inputs are made from keys the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import labels as L
from ..functions import markup as M
from ..functions import text as T
from ..operators import resolve as R
from ..operators.identity import verify_identity
from ..streaming import requests as S
from .tools import chunks, first_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; sql: the same in DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '&(?:amp|lt|gt|quot|apos);', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_VENUE = "trim(regexp_replace(replace(regexp_replace(lower({0}), '[’'']', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SIM = """CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE (
  SELECT CASE WHEN i = 0 THEN 0.0 WHEN least(x, y) < 3 THEN i / (x + y - i) ELSE greatest(i / (x + y - i), (i / least(x, y)) * (0.82::DOUBLE + 0.18::DOUBLE * (least(x, y) / greatest(x, y)))) END
  FROM (SELECT len(list_intersect(string_split({a}, ' '), string_split({b}, ' ')))::DOUBLE AS i, len(list_distinct(string_split({a}, ' ')))::DOUBLE AS x, len(list_distinct(string_split({b}, ' ')))::DOUBLE AS y)) END"""


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def q_norm_title(spark, sf):
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", T.norm_title(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {_VENUE.format('text')} AS norm FROM documents")
def q_norm_catalogue(spark, sf):
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", T.norm_venue(F.col("text")).alias("norm"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS n_tokens FROM documents")
def q_tokens(spark, sf):
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.size(T.ascii_tokens(F.col("text"))).alias("n_tokens"))


def _blocked_pairs(spark, sf) -> DataFrame:
    part = _t(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").withColumn("t", F.concat_ws(" ", "p_name", "p_type"))
    block = ["p_brand", "p_type"]  # titles are compared within a block, never all with all
    near = part.withColumn("other", F.lag("p_partkey").over(Window.partitionBy(*block).orderBy("p_partkey"))).withColumn("u", F.lag("t").over(Window.partitionBy(*block).orderBy("p_partkey")))
    return near.where("other IS NOT NULL")


_PAIRS = """p AS (SELECT p_partkey, p_name || ' ' || p_type AS t, lag(p_partkey) OVER w AS other, lag(p_name || ' ' || p_type) OVER w AS u FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
n AS (SELECT p_partkey, other, {t} AS a, {u} AS b FROM p WHERE other IS NOT NULL)""".format(t=_NORM.format("t"), u=_NORM.format("u"))


@query(f"""WITH {_PAIRS} SELECT p_partkey, other, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE
  len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))) END, 9) AS score FROM n""")
def q_jaccard(spark, sf):
    return _blocked_pairs(spark, sf).select("p_partkey", "other", F.round(T.title_jaccard(F.col("t"), F.col("u")), 9).alias("score"))


@query(f"WITH {_PAIRS} SELECT p_partkey, other, round({_SIM.format(a='a', b='b')}, 9) AS score FROM n")
def q_similarity(spark, sf):
    return _blocked_pairs(spark, sf).select("p_partkey", "other", F.round(T.title_similarity(F.col("t"), F.col("u")), 9).alias("score"))


@query("""WITH i AS (SELECT s_suppkey, 'deep learning for large graph number ' || (s_suppkey % 7) AS q, 'deep learning for large graph number ' || (s_suppkey % 5) AS f,
  'name' || (s_suppkey % 4) AS family, CASE WHEN s_suppkey % 3 = 0 THEN 'ann' WHEN s_suppkey % 3 = 1 THEN 'a' ELSE '' END AS given, 'name' || (s_suppkey % 3) AS found FROM supplier),
s AS (SELECT *, CASE WHEN q = f THEN 1.0 ELSE 6.0 / 8.0 END AS jac, CASE WHEN q = f THEN 1.0 ELSE 6.0 / 7.0 END AS sim FROM i)
SELECT s_suppkey, CASE WHEN jac < 0.82 AND NOT sim >= 0.9 THEN false ELSE family = found END AS ok,
  CASE WHEN jac < 0.82 AND NOT sim >= 0.9 THEN 'title-mismatch' WHEN family = found THEN 'title-and-authors' ELSE 'author-mismatch' END AS reason FROM s""")
def q_identity(spark, sf):
    k = F.col("s_suppkey")
    title = lambda n: F.concat(F.lit("deep learning for large graph number "), (k % n).cast("string"))
    given = F.when(k % 3 == 0, "ann").when(k % 3 == 1, "a").otherwise("")
    creators = F.array(F.struct(F.concat(F.lit("name"), (k % 4).cast("string")).alias("family"), given.alias("given")))
    authors = F.array(F.concat(F.lit("ann name"), (k % 3).cast("string")))
    v = verify_identity(title(7), title(5), creators, authors)
    return _t(spark, sf, "supplier", "s_suppkey").withColumn("v", v).select("s_suppkey", "v.ok", "v.reason")


@query("""WITH i AS (SELECT p_partkey, lower(p_name) || ' of the ' || p_type AS t FROM part), w AS (SELECT p_partkey, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM i)
SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND lower(x) IN ('a','an','the','of','for','and','in','on','to','at','via') THEN lower(x) ELSE upper(x[1]) || x[2:] END), ' ') AS title FROM w""")
def q_smart_title(spark, sf):
    text = F.concat(F.lower("p_name"), F.lit(" of the "), F.col("p_type"))
    return _t(spark, sf, "part").select("p_partkey", T.smart_title(text).alias("title"))


# ---------------------------------------------------------------- keys

_DATED = "CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d')"


def _dated() -> Column:
    return F.concat(F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"SELECT o_orderkey, nullif(regexp_extract({_DATED}, '((?:19|20)[0-9]{{2}})', 1), '')::INTEGER AS year FROM orders")
def q_item_year(spark, sf):
    return _t(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", K.item_year(_dated()).alias("year"))


@query(f"SELECT o_orderkey, nullif(regexp_extract({_DATED}, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '')::INTEGER AS year FROM orders")
def q_text_year(spark, sf):
    return _t(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", K.year_from_text(_dated()).alias("year"))


_AID = "(lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((o_orderkey * 7 % 100000)::VARCHAR, 5, '0'))"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {_AID} WHEN 1 THEN {_AID} WHEN 2 THEN {_AID} WHEN 3 THEN {_AID} END AS arxiv_id FROM orders""")
def q_arxiv_id(spark, sf):
    k = F.col("o_orderkey")
    aid = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k * 7 % 100000).cast("string"), 5, "0"))
    at = lambda n, prefix, suffix="": F.when(k % 5 == n, F.concat(F.lit(prefix), aid, F.lit(suffix)))
    extra = F.coalesce(at(4, "see "), at(3, "note\narXiv: "))
    return _t(spark, sf, "orders", "o_orderkey").select("o_orderkey", K.arxiv_id(at(0, "arXiv:", "v2"), at(1, "10.48550/arXiv."), at(2, "https://arxiv.org/abs/"), extra).alias("arxiv_id"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.' || (1000 + o_orderkey % 9000) || '/x' || o_orderkey WHEN 1 THEN '10.1145/a' || o_orderkey || '|10.1000/b' ELSE '' END AS dois FROM orders""")
def q_formal_dois(spark, sf):
    k = F.col("o_orderkey")
    doi = F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10."), (1000 + k % 9000).cast("string"), F.lit("/x"), k.cast("string"))).when(k % 3 == 2, "10.48550/arXiv.1706.03762")
    extra = F.when(k % 3 == 1, F.concat(F.lit("see 10.1145/A"), k.cast("string"), F.lit("). and 10.1145/a"), k.cast("string"), F.lit(", 10.1000/b]"))).otherwise("")
    return _t(spark, sf, "orders", "o_orderkey").select("o_orderkey", F.lower(F.array_join(K.formal_dois(doi, extra), "|")).alias("dois"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {_HOST} AS host, {_HOST} AS family FROM pages")
def q_host_family(spark, sf):
    host = K.host_of(F.col("url"))
    return _t(spark, sf, "pages", "page_id", "url").select("page_id", host.alias("host"), K.host_family(host).alias("family"))


@query(f"SELECT page_id, len(list_filter(['example.org', 'ththre.example.com'], lambda h: {_HOST} = h OR ends_with({_HOST}, '.' || h))) > 0 AS official FROM pages")
def q_official_host(spark, sf):
    return _t(spark, sf, "pages", "page_id", "url").select("page_id", K.is_official_host(K.host_of(F.col("url")), ("example.org", "ththre.example.com")).alias("official"))


_URLS = ("https://www.usenix.org/conference/usenixsecurity24/presentation/x", "https://www.usenix.org/conference/nsdi98/a", "https://openaccess.thecvf.com/CVPR2021/p", "https://aclanthology.org/2020.conll-1.3/", "https://www.ndss-symposium.org/ndss2019/x", "https://example.org/2020")
_NAMES = (("USENIX Security", 2024), ("nsdi", 1998), ("CVPR", 2021), ("CoNLL", 2020), ("NDSS", 2019), (None, None))


@query("SELECT n_nationkey, [" + ", ".join("NULL" if n is None else f"'{n}'" for n, _ in _NAMES) + "][n_nationkey % 6 + 1] AS venue, [" + ", ".join("NULL" if y is None else str(y) for _, y in _NAMES) + "][n_nationkey % 6 + 1]::INTEGER AS year FROM nation")
def q_official_venue(spark, sf):
    url = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return _t(spark, sf, "nation", "n_nationkey").withColumn("v", K.official_venue(url)).select("n_nationkey", "v.venue", "v.year")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 >= 70 THEN 1900 + o_orderkey % 100 ELSE 2000 + o_orderkey % 100 END::BIGINT AS year FROM orders")
def q_full_year(spark, sf):
    return _t(spark, sf, "orders", "o_orderkey").select("o_orderkey", K.full_year(F.col("o_orderkey") % 100).alias("year"))


# ---------------------------------------------------------------- markup

_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_DECODED = "replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_DECODED.format(_BARE)}, '\\s+', ' ', 'g'))) AS digest FROM pages")
def q_html_text(spark, sf):
    return _t(spark, sf, "pages", "page_id", "html").select("page_id", F.md5(M.html_to_text(F.col("html"))).alias("digest"))


@query("""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>', 1)[1:20] || regexp_extract_all(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)[1:1],
  lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), '|') AS headings FROM pages""")
def q_headings(spark, sf):
    return _t(spark, sf, "pages", "page_id", "html").select("page_id", F.array_join(M.headings(F.col("html")), "|").alias("headings"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s>]+)[^>]*>.*?</a>'))::INTEGER AS n_anchors FROM pages")
def q_anchor_count(spark, sf):
    return _t(spark, sf, "pages", "page_id", "html").select("page_id", F.size(M.anchor_parts(F.col("html"))).alias("n_anchors"))


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base, regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>', 1)[1:3] AS l FROM pages),
e AS (SELECT page_id, base, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM a)
SELECT page_id, (pos - 1)::INTEGER AS pos, base || href AS link FROM e""")
def q_top_links(spark, sf):
    links = M.anchors(_t(spark, sf, "pages", "page_id", "url", "html").where("html IS NOT NULL"))
    return first_rows(links, ["page_id"], F.col("pos"), n=3).select("page_id", "pos", "link")


@query("SELECT page_id, 'T' || page_id || '|A' || page_id AS metas FROM pages")
def q_html_meta(spark, sf):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<meta name="citation_title" content="T'), k, F.lit("\"><meta content='A"), k, F.lit("' property='citation_author'/><meta name=other content=x>"), F.col("html"))
    return _t(spark, sf, "pages", "page_id", "html").select("page_id", F.array_join(M.meta_values(html, "citation_title", "citation_author"), "|").alias("metas"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_props(spark, sf):
    return _t(spark, sf, "events", "event_id", "props").select("event_id", M.wrapped(F.col("props"), "k").alias("k"))


# ---------------------------------------------------------------- labels

_BUCKET = "CASE WHEN {0} IS NULL THEN NULL " + " ".join(f"WHEN {{0}} >= {b} THEN '{b}+'" for b in L.CITE_BUCKETS) + " ELSE '<10' END"


@query(f"SELECT o_orderkey, {_BUCKET.format('floor(o_totalprice / 20)')} AS bucket FROM orders")
def q_cite_bucket(spark, sf):
    return _t(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", L.cite_bucket(F.floor(F.col("o_totalprice") / 20)).alias("bucket"))


_SOURCES = {"view": "dblp", "signup": "crossref_title", "error": "semantic_scholar_title", "click": "duckduckgo_web", "purchase": "openalex_doi"}
_SRC = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SOURCES.items()) + " ELSE event_type END"
_FAM = f"CASE {_SRC} WHEN 'crossref_title' THEN 'crossref_or_doi' WHEN 'semantic_scholar_title' THEN 'semantic_scholar' WHEN 'duckduckgo_web' THEN 'web_evidence' WHEN 'openalex_doi' THEN 'openalex' ELSE {_SRC} END"
_WEIGHT = f"coalesce(CASE {_SRC} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.SOURCE_WEIGHTS) + f" END, {L.DEFAULT_WEIGHT})"


def _source() -> Column:
    table = F.create_map(*[F.lit(x) for kv in _SOURCES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("event_type")), F.col("event_type"))


@query(f"SELECT event_id, {_FAM} AS family FROM events")
def q_source_family(spark, sf):
    return _t(spark, sf, "events", "event_id", "event_type").select("event_id", L.source_family(_source()).alias("family"))


@query(f"SELECT event_id, {_WEIGHT}::INTEGER AS weight FROM events")
def q_source_weight(spark, sf):
    return _t(spark, sf, "events", "event_id", "event_type").select("event_id", L.source_weight(_source()).alias("weight"))


@query(f"""SELECT o_orderkey, 'venue:' || o_orderpriority || ' year:' || year(o_orderdate) || CASE WHEN o_orderstatus = 'F' THEN ' CCF2026:A' ELSE '' END || ' acceptance:accepted cite:' || {_BUCKET.format('floor(o_totalprice / 20)')} AS tags FROM orders""")
def q_tags(spark, sf):
    tags = L.build_tags(F.col("o_orderpriority"), F.year("o_orderdate"), F.when(F.col("o_orderstatus") == "F", "A"), F.lit(None).cast("string"), F.lit("accepted"), F.floor(F.col("o_totalprice") / 20))
    return _t(spark, sf, "orders").select("o_orderkey", F.array_join(tags, " ").alias("tags"))


_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'conference' WHEN 1 THEN 'journal' WHEN 2 THEN 'conference' END"


@query(f"""SELECT o_orderkey, {_KIND} AS kind, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_clerkless WHEN 2 THEN o_orderpriority ELSE o_clerkless END AS label
FROM (SELECT *, 'J' || o_orderstatus AS o_clerkless FROM orders)""")
def q_label(spark, sf):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    kind_of = F.when(k % 4 == 0, "conferencePaper").when(k % 4 == 1, "journalArticle").when(k % 4 == 2, "book").otherwise("thesis")
    conference = F.when(k % 4 == 2, F.col("o_orderpriority"))
    journal = F.concat(F.lit("J"), F.col("o_orderstatus"))
    kind = L.item_kind(kind_of, conference, none, none, none)
    label = L.venue_label(kind_of, kind, F.when(k % 4 == 0, F.col("o_orderpriority")), conference, none, none, journal, none)
    return _t(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), label.alias("label"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || chr(31) || CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END || chr(31) || o_orderpriority || chr(31) || 'D' || chr(31) AS encoded,
  CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END AS tier, o_orderpriority AS canonical FROM orders""")
def q_column_encode(spark, sf):
    tier = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C")
    coded = _t(spark, sf, "orders").select("o_orderkey", L.encode_tier(tier, F.col("o_orderpriority"), F.lit("D"), F.lit(None).cast("string")).alias("encoded"))
    return coded.withColumn("d", L.decode_tier(F.col("encoded"))).select("o_orderkey", "encoded", "d.tier", "d.canonical")


# ---------------------------------------------------------------- scoring


def _scored(spark, sf) -> DataFrame:
    events = _t(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    return events.select(F.col("user_id").alias("item"), F.floor("value").cast("string").alias("group_key"), L.source_family(_source()).alias("family"),
                         (L.source_weight(_source()) + F.floor(F.col("value") * 10) / 10).cast("double").alias("score"), F.col("event_id").alias("ord"))


_SCORED = f"e AS (SELECT user_id AS item, floor(value)::BIGINT::VARCHAR AS group_key, {_FAM} AS family, ({_WEIGHT} + floor(value * 10) / 10)::DOUBLE AS score, event_id AS ord FROM events)"


@query(f"SELECT event_id, ({_WEIGHT} + 7 + 22 + 7 + 1.5 + CASE WHEN value > 50 THEN -30 ELSE 0 END)::DOUBLE AS score FROM events")
def q_hit_score(spark, sf):
    events = _t(spark, sf, "events", "event_id", "event_type", "value")
    none = lambda t="string": F.lit(None).cast(t)
    hits = events.select("event_id", _source().alias("source"), F.lit(0.5).alias("title_score"), none().alias("external_doi"), F.when(F.col("value") > 50, "page_text").alias("venue_evidence"), none().alias("venue_match_quality"),
                         F.struct(F.lit("X").alias("canonical"), F.lit("conference").alias("kind"), F.lit("").alias("core"), F.lit("A").alias("tier")).alias("venue"))
    return hits.select("event_id", R.hit_score().alias("score"))


_GROUPS = f"""{_SCORED}, f AS (SELECT item, group_key, family, max(score) AS s, arg_max(ord, (score, -ord)) AS bo, min(ord) AS fo FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item, group_key ORDER BY s DESC, fo) AS n FROM f),
g AS (SELECT item, group_key, max(s) AS m, arg_max(bo, (s, -bo)) AS bo, min(fo) AS fo, count(*) AS families,
  max(s) + greatest(0, count(*) - 1) * 10.0 + ((coalesce(max(s) FILTER (n = 2), 0) * 0.08::DOUBLE + coalesce(max(s) FILTER (n = 3), 0) * 0.08::DOUBLE) + coalesce(max(s) FILTER (n = 4), 0) * 0.08::DOUBLE) AS total FROM r GROUP BY item, group_key)"""


@query(f"WITH {_GROUPS}, w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY total DESC, m DESC, fo) AS k FROM g) SELECT item, group_key, bo AS best_ord, families, round(total, 6) AS total FROM w WHERE k = 1")
def q_choose_group(spark, sf):
    best = R.best_groups(R.score_groups(_scored(spark, sf), ["item"]), ["item"])
    return best.select("item", "group_key", "best_ord", "families", F.round("total", 6).alias("total"))


@query(f"""WITH {_GROUPS}, w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY total DESC, m DESC, fo) AS k FROM g)
SELECT item, CASE WHEN families >= 3 THEN 0.99 WHEN families >= 2 THEN 0.95 WHEN {_SRC} IN ('dblp') THEN 0.92 ELSE 0.87 END::DOUBLE AS confidence FROM w JOIN events ON event_id = bo WHERE k = 1""")
def q_confidence(spark, sf):
    events = _t(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    none = lambda t="string": F.lit(None).cast(t)
    venue = F.struct(F.floor("value").cast("string").alias("canonical"), F.lit("conference").alias("kind"), F.lit("").alias("core"), F.lit("A").alias("tier"))
    hits = events.select(F.col("user_id").alias("item_key"), F.col("event_id").alias("hit_ord"), _source().alias("source"), none().alias("venue_evidence"), none().alias("venue_match_quality"), venue.alias("venue"))
    best = R.best_groups(R.score_groups(_scored(spark, sf), ["item"]), ["item"])
    chosen = hits.join(best.select(F.col("best_ord").alias("hit_ord")), "hit_ord")
    return R.confidence(chosen, hits).withColumnRenamed("item_key", "item")


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity DESC, l_linenumber) = 1")
def q_best_per_provider(spark, sf):
    lines = _t(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return first_rows(lines, ["l_orderkey", "l_suppkey"], F.desc("l_quantity"), F.col("l_linenumber")).drop("l_quantity")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q_first_seen(spark, sf):
    return first_rows(_t(spark, sf, "events", "user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT md5(text) AS arxiv_id, array_to_string(list_sort(list(doc_id)), ',') AS keys FROM documents GROUP BY text HAVING count(*) > 1")
def q_duplicate_groups(spark, sf):
    docs = _t(spark, sf, "documents", "doc_id", "text").select(F.md5("text").alias("arxiv_id"), F.col("doc_id").alias("item_key"))
    return R.duplicate_groups(docs).select("arxiv_id", F.array_join(F.col("item_keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT user_id AS item_key, max(floor(value)) FILTER (event_type = 'error')::INTEGER AS citation_count, max(floor(value / 2)) FILTER (event_type IN ('error', 'view'))::INTEGER AS influential_citations FROM events GROUP BY user_id")
def q_citation_max(spark, sf):
    n = lambda d: F.floor(F.col("value") / d).cast("int")
    hits = _t(spark, sf, "events").select(F.col("user_id").alias("item_key"), _source().alias("source"), n(1).alias("citation_count"), F.when(F.col("event_type").isin("error", "view"), n(2)).alias("influential_citations"))
    return R.citations(hits)


# ---------------------------------------------------------------- stages, overrides, proposals


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS stage FROM events WHERE event_type IN ('purchase', 'click', 'view')),
m AS (SELECT user_id, min(stage) AS stage FROM s GROUP BY user_id) SELECT user_id, s.stage::INTEGER AS stage, count(*) AS n_hits FROM s JOIN m USING (user_id, stage) GROUP BY ALL""")
def q_stage_fallback(spark, sf):
    events = _t(spark, sf, "events", "user_id", "event_id", "event_type")
    found, done = None, None
    for stage, kind in enumerate(("purchase", "click", "view"), 1):
        now = events.where(F.col("event_type") == kind).select("user_id", F.lit(stage).alias("stage"))
        now = now if done is None else now.join(done, "user_id", "left_anti")
        found = now if found is None else found.union(now)
        done = found.select("user_id").distinct()
    return found.groupBy("user_id", "stage").agg(F.count(F.lit(1)).alias("n_hits"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'user' WHEN o.n IS NOT NULL THEN o.n ELSE c_mktsegment END AS canonical, CASE WHEN c_custkey % 10 = 0 OR o.n IS NOT NULL THEN 1.0 ELSE 0.87 END::DOUBLE AS confidence
FROM customer LEFT JOIN (VALUES (1, 'curated one'), (2, 'curated two')) AS o(k, n) ON c_nationkey = o.k""")
def q_override_precedence(spark, sf):
    items = _t(spark, sf, "customer").select(F.col("c_custkey").alias("item_key"), "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "first\nvenue override: user \nvenue year: 2020").otherwise("x").alias("extra"))
    curated = spark.createDataFrame([(1, "curated one"), (2, "curated two")], "c_nationkey int, c_name string")
    base = items.join(F.broadcast(curated), "c_nationkey", "left").join(R.user_overrides(items), "item_key", "left")
    by_hand = F.col("ov_venue").isNotNull() | F.col("c_name").isNotNull()
    return base.select(F.col("item_key").alias("c_custkey"), F.coalesce("ov_venue", "c_name", "c_mktsegment").alias("canonical"), F.when(by_hand, 1.0).otherwise(0.87).alias("confidence"))


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS ord, min(l_returnflag) AS venue, min(year(l_shipdate)) AS y, CASE WHEN l_linenumber % 2 = 0 THEN '10.1/' || min(l_partkey) END AS doi FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT * FROM h WHERE ord = 1)
SELECT c.k AS item_key, coalesce(c.doi, (SELECT arg_min(h.doi, h.ord) FROM h WHERE h.k = c.k AND h.venue = c.venue AND h.y = c.y AND h.doi IS NOT NULL)) AS external_doi FROM c""")
def q_fill_down(spark, sf):
    none = F.lit(None).cast("string")
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min(F.year("l_shipdate")).alias("year"), F.min("l_partkey").alias("l_partkey"))
    hits = lines.select(F.col("l_orderkey").alias("item_key"), F.col("l_linenumber").alias("hit_ord"), F.col("l_returnflag").alias("venue_raw"), "year",
                        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("10.1/"), F.col("l_partkey").cast("string"))).alias("external_doi"), *[none.alias(c) for c in R.FILLED[1:]],
                        F.struct(F.col("l_returnflag").alias("canonical")).alias("venue"))
    chosen = hits.where("hit_ord = 1").select("item_key", F.col("hit_ord").alias("chosen_ord"))
    return R.fill_down(hits, chosen).select("item_key", "external_doi")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 100)::INTEGER AS chunk, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 100)::INTEGER AS pos FROM orders")
def q_batch_positions(spark, sf):
    return chunks(_t(spark, sf, "orders", "o_orderkey"), "o_orderkey", F.col("o_orderkey"), 100)


@query("""WITH d AS (SELECT doc_id, '10.1000/a' || doc_id AS a, '10.1000/b' || (doc_id % 7) AS b FROM documents)
SELECT doc_id, a || '|' || b AS all_dois, CASE WHEN doc_id % 2 = 0 THEN b ELSE a || '|' || b END AS fresh FROM d""")
def q_dois_union_diff(spark, sf):
    k = F.col("doc_id")
    a, b = F.concat(F.lit("10.1000/a"), k.cast("string")), F.concat(F.lit("10.1000/b"), (k % 7).cast("string"))
    both = F.array_distinct(F.concat(F.array(a), F.array(b, a)))
    before = F.when(k % 2 == 0, F.array(a)).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf, "documents", "doc_id").select("doc_id", F.array_join(both, "|").alias("all_dois"), F.array_join(F.array_except(both, before), "|").alias("fresh"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations")
def q_forward_fill(spark, sf):
    from ..operators.catalogue import forward_fill

    lines = _t(spark, sf, "conversations", "conv_id", "turn", "role").withColumn("line_no", F.col("turn"))
    return forward_fill(lines, F.when(F.col("role") == "user", F.col("turn")), "header", ("conv_id",)).select("conv_id", "turn", "header")


@query("""WITH v(d, k, c, a) AS (VALUES ('1', 'nation', 'FRANCE', 'fr'), ('*', 'nation', 'FRANCE', 'gaul'), ('*', 'nation', 'CHINA', 'cn'), ('9', 'nation', 'CHINA', 'none'), ('*', 'nation', 'NATION_3', 'three'))
SELECT n_nationkey, coalesce((SELECT string_agg(a, '|' ORDER BY d DESC, a) FROM v WHERE c = n_name AND (d = n_regionkey::VARCHAR OR d = '*')), '') AS aliases FROM nation""")
def q_alias_wildcard(spark, sf):
    from ..operators.catalogue import manual_aliases

    rows = [("1", "nation", "FRANCE", "fr"), ("*", "nation", "FRANCE", "gaul"), ("*", "nation", "CHINA", "cn"), ("9", "nation", "CHINA", "none"), ("*", "nation", "NATION_3", "three")]
    aliases = spark.createDataFrame(rows, "domain string, kind string, canonical string, alias string")
    entries = _t(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("domain"), F.lit("nation").alias("kind"), F.col("n_name").alias("canonical"))
    return manual_aliases(entries, aliases).select("n_nationkey", F.array_join("manual", "|").alias("aliases"))


@query("SELECT o_orderkey, 0.55 + (o_orderkey % 5) * 0.1 AS confidence FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND 55 + (o_orderkey % 5) * 10 >= 80)")
def q_autoselect(spark, sf):
    from ..operators.proposal import auto_select

    made = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "conferencePaper").alias("target_item_type"), (F.lit(0.55) + (F.col("o_orderkey") % 5) * F.lit(0.1)).alias("confidence"))
    return auto_select(made).select("o_orderkey", F.round("confidence", 2).cast("decimal(23,2)").alias("confidence"))


@query("SELECT c_custkey AS item_key, c_name AS publisher, 'p' || (c_custkey % 3) AS pages FROM customer")
def q_undo_roundtrip(spark, sf):
    from ..operators.proposal import apply_proposals, preimage, undo

    k = F.col("c_custkey")
    items = _t(spark, sf, "customer").select(k.alias("item_key"), F.lit("preprint").alias("itemType"), F.col("c_name").alias("publisher"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("pages"))
    fields = F.create_map(F.lit("publisher"), F.lit("changed"), F.lit("pages"), F.lit("1-2"))
    proposals = items.select("item_key", F.when(F.col("item_key") % 2 == 0, "conferencePaper").alias("target_item_type"), fields.alias("fields"))
    return undo(apply_proposals(items, proposals), preimage(items, proposals)).select("item_key", "publisher", "pages")


@query("SELECT c_custkey AS item_key, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_name END AS publisher, CASE WHEN c_custkey % 2 = 0 THEN 'conferencePaper' ELSE 'preprint' END AS \"itemType\" FROM customer")
def q_apply(spark, sf):
    from ..operators.proposal import apply_proposals

    items = _t(spark, sf, "customer").select(F.col("c_custkey").alias("item_key"), F.lit("preprint").alias("itemType"), F.col("c_name").alias("publisher"))
    fields = F.create_map(F.lit("publisher"), F.lit("changed"))
    proposals = items.select("item_key", F.when(F.col("item_key") % 2 == 0, "conferencePaper").alias("target_item_type"), fields.alias("fields"))
    return apply_proposals(items, proposals)


@query("""SELECT c_custkey, c_custkey % 4 = 0 OR (c_custkey % 4 = 2) AS same FROM customer""")
def q_noop_filter(spark, sf):
    from ..operators.proposal import FIELDS, fields_match

    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    values = {f: none for f in FIELDS} | {"publisher": F.col("c_name"), "date": F.lit("2020-05-01")}
    fields = F.create_map(F.lit("publisher"), F.when(k % 4 == 1, "other").otherwise(F.col("c_name")), F.lit("date"), F.when(k % 4 == 3, "2020-05-02").when(k % 4 == 2, "2020").otherwise("2020-05-01"))
    items = _t(spark, sf, "customer").select("c_custkey", F.struct(*[v.alias(f) for f, v in values.items()]).alias("item"), fields.alias("fields"))
    return items.select("c_custkey", fields_match("item", F.col("fields"), F.lit(2020)).alias("same"))


# ---------------------------------------------------------------- request policies


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 900000 WHEN page_id % 5 = 1 THEN 900000 WHEN regexp_matches(url, '/v[0-9]+/[^/?]+\\.html') THEN 604800000 ELSE 21600000 END::BIGINT AS ttl FROM pages")
def q_ttl_class(spark, sf):
    k = F.col("page_id")
    return _t(spark, sf, "pages", "page_id", "url").select("page_id", S.lifetime_ms(F.when(k % 5 == 0, 404).otherwise(200), F.when(k % 5 == 1, "[]").otherwise("{}"), F.col("url")).alias("ttl"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS s FROM events QUALIFY s <= 3)
SELECT user_id AS item_key, event_id AS ord FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8""")
def q_budget_rank(spark, sf):
    requests = _t(spark, sf, "events").select(F.col("user_id").alias("item_key"), F.col("event_type").alias("source"), F.col("event_id").alias("ord"))
    return S.within_budgets(requests, item_limit=8, source_limit=3).select("item_key", "ord")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts) = 1) GROUP BY user_id")
def q_single_flight(spark, sf):
    log = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("url"), "event_id")
    return S.single_flight(log).select(F.col("key").alias("user_id"), "event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT *, max(t - n * 300) OVER (PARTITION BY event_type ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 300 AS start_ms FROM e) SELECT event_id, start_ms::BIGINT AS start_ms FROM w""")
def q_pacing(spark, sf):
    log = _t(spark, sf, "events").select("event_id", F.col("event_id").alias("key"), F.col("event_type").alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return S.paced(log).select("event_id", "start_ms")


def _log(spark, sf) -> DataFrame:
    events = _t(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, 429).otherwise(500)).otherwise(200)
    return events.select(F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), status.cast("int").alias("status"), F.lit(30000).cast("long").alias("retry_after_ms"), F.col("event_id").cast("string").alias("key"),
                         F.concat(F.lit("https://h/"), F.col("user_id").cast("string")).alias("url"), F.col("props").alias("body"))


@query()
def q_breaker(spark, sf):
    return S.breaker(_log(spark, sf))


@query()
def q_cache_latest(spark, sf):
    log = _log(spark, sf).withColumn("key", F.col("url"))
    last = log.agg(F.max("ts_ms")).first()[0] or 0
    return S.cache_latest(log, last).select("key", "ts_ms", "expires_ms")
