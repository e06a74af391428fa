"""URL filtering by rules and, where no rule fits, by propagation over the host graph.

Hosts most of whose pages the rules allow are trusted seeds, hosts most of whose pages they block are
blocked seeds. Trust flows along links by personalised PageRank, distrust flows against them, from the
linked host back to the linking one; a host without such a link keeps its mass. Distrust that is shared
out over a host's in-links fades as they grow, so a second measure, leaning, is the distrust that a
walk from the host along its links meets. A host whose distrust or leaning exceeds its trust by THRESHOLD is blocked. The iterations run over a table with one row for each pair of linked hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, read, small

#: (verdict, host and path) in the order given by the contract of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

DAMPING = 0.85
ITERATIONS = 10
STEPS_A_STAGE = 5
THRESHOLD = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"

#: Also links without a scheme, //host/.
_ANY_LINK = _LINK.replace("[a-z][a-z0-9+.-]*://", "(?:[a-z][a-z0-9+.-]*:)?//")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and for no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """A struct (size, rule, verdict) of the longest rule that fits, ties by text; null if none does."""
    fits = []
    for verdict, rule in rules:
        own, _, tail = rule.partition("/")
        ok = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) for each pair of different hosts that absolute links in html join; pages: host, html."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_ANY_LINK), F.lit(1))).alias("to"))
    links = links.withColumn("to", F.regexp_replace("to", "^//", "http://"))
    return links.select("src", url_host(F.col("to")).alias("dst")).where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, stages: Stages, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust, leaning) for every host of seeds (host, trust, distrust) and edges (src, dst, links)."""
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    nodes = stages.keep(linked.join(seeds, "host", "full").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]).withColumn("leaning", F.col("distrust")), "nodes")
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("total"))
    along = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"), F.lit(0.0).alias("wl"))
    back = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("wt"), (F.col("links") / F.col("total")).alias("wd"), F.lit(0.0).alias("wl"))
    lean = edges.join(out, "src").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("wt"), F.lit(0.0).alias("wd"), (F.col("links") / F.col("total")).alias("wl"))
    own = nodes.join(out.select(F.col("src").alias("host")).withColumn("o", F.lit(1)), "host", "left").join(into.select(F.col("dst").alias("host")).withColumn("i", F.lit(1)), "host", "left")
    own = own.where("o IS NULL OR i IS NULL").select(F.col("host").alias("a"), F.col("host").alias("b"), F.when(F.col("o").isNull(), 1.0).otherwise(0.0).alias("wt"), F.when(F.col("i").isNull(), 1.0).otherwise(0.0).alias("wd"), F.when(F.col("o").isNull(), 1.0).otherwise(0.0).alias("wl"))
    flows = stages.keep(along.unionByName(back).unionByName(lean).unionByName(own), "flows")
    vector, last = nodes, ""
    for step in range(1, iterations + 1):
        moved = flows.join(vector.select(F.col("host").alias("a"), "trust", "distrust", "leaning"), "a").groupBy(F.col("b").alias("host")).agg(
            F.sum(F.col("trust") * F.col("wt")).alias("t"), F.sum(F.col("distrust") * F.col("wd")).alias("d"), F.sum(F.col("leaning") * F.col("wl")).alias("l"))
        vector = nodes.join(moved, "host", "left").select("host", *[((1 - DAMPING) * F.col(c) + DAMPING * F.coalesce(F.col(c[0]), F.lit(0.0))).alias(c) for c in ("trust", "distrust", "leaning")])
        if step % STEPS_A_STAGE == 0 or step == iterations:
            vector = stages.keep(vector, f"vector{step}")
            if last:
                stages.drop(last)
            last = f"vector{step}"
    return vector


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages (url, html and any others) with host, path, rule and verdict.

    Null urls and urls without :// have an empty host and are allowed; null html has no links. Repeated
    rows are kept and count as pages of their host. Input columns of those four names are replaced; names with "_q_" are reserved.
    """
    stages = Stages(pages.sparkSession)
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    judged = pages.withColumn("_q_html", html).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))).withColumn("_q_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        *[F.when(2 * F.count_if(F.col("_q_fit.verdict") == v) > F.count(F.lit(1)), 1.0).otherwise(0.0).alias(c) for c, v in (("trust", "allow"), ("distrust", "block"))])
    seeds = stages.keep(seeds, "seeds")
    edges = stages.keep(host_edges(judged.select("host", F.col("_q_html").alias("html"))), "edges")
    scores = seeds.withColumn("leaning", F.col("distrust")) if edges.isEmpty() else propagate(seeds, edges, stages)  # without links every host keeps its seed
    blocked = stages.keep(scores.where(F.greatest("distrust", "leaning") - F.col("trust") >= threshold).select("host"), "blocked").withColumn("_q_bad", F.lit(True))
    out = judged.drop("_q_html").join(small(blocked, 300), "host", "left")
    verdict = F.coalesce("_q_fit.verdict", F.when(F.col("_q_bad"), "block").otherwise("allow"))
    return out.withColumn("rule", F.col("_q_fit.rule")).withColumn("verdict", verdict).drop("_q_fit", "_q_bad")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"
    cases = []
    for verdict, rule in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        own, _, tail = rule.partition("/")
        cases.append((f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{tail}') THEN", rule, verdict))
    pick = lambda k: "CASE " + " ".join(f"{c[0]} '{c[k]}'" for c in cases) + " END"
    link = _LINK.replace("'", "''")
    steps = []
    for k in range(ITERATIONS):
        steps.append(f"""v{k + 1} AS MATERIALIZED (SELECT host, {1 - DAMPING:.2f}::DOUBLE * n.trust + {DAMPING} * coalesce(t, 0) AS trust, {1 - DAMPING:.2f}::DOUBLE * n.distrust + {DAMPING} * coalesce(d, 0) AS distrust
  FROM v0 n LEFT JOIN (SELECT b AS host, sum(trust * wt) AS t, sum(distrust * wd) AS d FROM flows JOIN v{k} ON v{k}.host = a GROUP BY b) USING (host))""")
    return f"""
WITH u AS (SELECT page_id, html, {host.format("url")} AS host, coalesce(regexp_extract({rest.format("url")}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, {pick(1)} AS rule, {pick(2)} AS rv FROM u),
seeds AS (SELECT host, CASE WHEN 2 * count(*) FILTER (rv = 'allow') > count(*) THEN 1.0 ELSE 0.0 END::DOUBLE AS trust, CASE WHEN 2 * count(*) FILTER (rv = 'block') > count(*) THEN 1.0 ELSE 0.0 END::DOUBLE AS distrust FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS url FROM j WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM (SELECT src, {host.format("url")} AS dst FROM l) WHERE dst <> '' AND dst <> src GROUP BY ALL),
v0 AS MATERIALIZED (SELECT host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM (SELECT src AS host FROM e UNION SELECT dst FROM e UNION SELECT host FROM seeds) LEFT JOIN seeds USING (host)),
flows AS MATERIALIZED (
  SELECT src AS a, dst AS b, links / sum(links) OVER (PARTITION BY src) AS wt, 0.0 AS wd FROM e
  UNION ALL SELECT dst, src, 0.0, links / sum(links) OVER (PARTITION BY dst) FROM e
  UNION ALL SELECT host, host, CASE WHEN host IN (SELECT src FROM e) THEN 0.0 ELSE 1.0 END, CASE WHEN host IN (SELECT dst FROM e) THEN 0.0 ELSE 1.0 END
  FROM v0 WHERE host NOT IN (SELECT src FROM e) OR host NOT IN (SELECT dst FROM e)),
{", ".join(steps)}
SELECT page_id, j.host, path, rule, coalesce(rv, CASE WHEN v.distrust - v.trust >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN v{ITERATIONS} v ON v.host = j.host
"""


OP5_SQL = _sql()
