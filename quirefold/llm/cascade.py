"""Quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a document. On a bounded sample the cascade measures what a
rule costs (seconds beyond those of a job without rules, the least of several runs, by powers of two) and how many rows it rejects, then orders the rules by rejections per cost,
so that cheap and selective rules run first; a CASE expression evaluates a rule only for the rows that
every earlier one let pass. The order changes the run time and which rule is named first, never which
documents are kept: a document is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bare, read, words

#: Rows in the sample that orders the rules, and characters of each. It settles no verdict.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000

#: How often the sample's rows are judged in a timed job, so that its work outweighs its start, and how often it is timed.
COPIES, RUNS = 4, 2

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str | Callable[[], Column]  # over the columns text and n_words, or what else the documents have
    note: str = ""

    def condition(self) -> Column:
        return F.expr(self.rejects) if isinstance(self.rejects, str) else self.rejects()


#: Thresholds in the style of published web-text filters, over whole texts.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("symbols", f"10 * (length(text) - length(translate(text, '{SYMBOLS}', ''))) > length(text)", "over a tenth of the characters"),
    Rule("upper_case", "2 * (length(text) - length(regexp_replace(text, '[A-Z]', ''))) > length(text)", "over half of the characters"),
    Rule("word_length", "length(text) > 16 * n_words", "over 16 characters a word"),
    Rule("line_repeats", "5 * size(array_distinct(split(text, '\\n'))) < 2 * size(split(text, '\\n')) - 5", "about three lines in five are repeats"),
    Rule("repeated_words", lambda: 100 * repeat_words(F.col("text")) > 50 * F.col("n_words"), "over half of the words stand in repeated 3-word windows"),
)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it and whatever the optimizer moves."""
    return F.transform(F.array(value), body)[0]


def repeat_words(text: Column) -> Column:
    """How many words of the text stand in a 3-word window that occurs twice or more in it, the first included."""

    def windows(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(each, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda v, k: (v["x"] == F.get(s, k - 1)["x"]) | (v["x"] == F.get(s, k + 1)["x"]))
        places = _let(ranked, lambda s: F.sort_array(F.transform(same(s), lambda v: v["i"])))
        gaps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        total = _let(places, lambda p: F.aggregate(gaps(p), F.lit(0), lambda n, g: n + g))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return _let(words(text), lambda w: _let(windows(w), covered)).cast("long")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, each a long over the whole text.

    Null text counts as no words. n_dup_lines counts the lines with a word that equal an earlier line.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    return docs.withColumns(
        {
            "n_words": F.size(words(F.col(text))).cast("long"),
            "word_chars": F.length(bare(t)).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col(text)),
        }
    )


def with_word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("n_words", F.size(words(F.col(text))).cast("long"))


def _seconds(df: DataFrame) -> float:
    """The least time of RUNS runs after one that compiles."""
    found = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        df.first()
        found.append(time.perf_counter() - began)
    return min(found[1:])


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejections per cost, highest first; ties by name. docs: with text and n_words.

    The sample is the first sample_rows rows that Spark returns, taken partition by partition until they
    are enough, the first SAMPLE_CHARS characters of each; an empty table keeps the given order. Costs
    count by powers of two, so that small differences between runs do not change the order.
    """
    spark = docs.sparkSession
    source = docs.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS))
    source = source.select("text", *[c for c in source.columns if c.startswith("n_")])
    taken = source._jdf.takeAsList(sample_rows)
    if taken.isEmpty():
        return list(rules)
    sample = DataFrame(spark._jsparkSession.createDataFrame(taken, source._jdf.schema()), spark)
    hits = sample.agg(*[F.count_if(r.condition()) for r in rules]).first()
    many = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    judged = lambda c: many.agg(F.count_if(c))
    empty = _seconds(judged(F.col("_copy") > 0))
    found = []
    for r, n in zip(rules, hits):
        cost = max(_seconds(judged(r.condition())) - empty, empty / 8)
        found.append((-n / 2 ** round(math.log2(cost)), r.name, r))
    return [r for _, _, r in sorted(found, key=lambda x: x[:2])]


def verdict(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The first rule that rejects, in the given order; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.condition(), F.lit(r.name)).otherwise(out)
    return out


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with failed_rule (null: kept). docs: any columns, with a string column text.

    Null text counts as empty and fails too_few_words. All other columns pass unchanged; columns called
    n_words, failed_rule or _text of the input are replaced. Equal rows get equal verdicts.
    """
    return _judged(with_word_count(docs), rules, sample_rows)


def _judged(counted: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> DataFrame:
    order = ordered_rules(counted, rules, sample_rows)
    return (
        counted.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("failed_rule", verdict(order)).withColumn("text", F.col("_text")).drop("_text")
    )


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs (text and any others), unchanged, that no rule rejects."""
    return quality_cascade(docs).where("failed_rule IS NULL").select(*docs.columns)


#: For documents whose base columns stand already, so that the costly one is made once.
COUNTED_RULES = tuple(Rule(r.name, "100 * n_repeat_words > 50 * n_words", r.note) if r.name == "repeated_words" else r for r in RULES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = _judged(base_columns(docs), COUNTED_RULES, SAMPLE_ROWS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"),
    )


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM w, unnest(generate_series(1, len(words) - 2)) AS g(i)),
rep AS (SELECT doc_id, tri FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM win JOIN rep USING (doc_id, tri), (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE translate(l, {_WS}, '') <> '' GROUP BY doc_id),
b AS (
  SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words, length(translate(w.text, {_WS}, ''))::BIGINT AS word_chars,
    (length(w.text) - length(translate(w.text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= length(text)
  AND 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) <= length(text) AND length(text) <= 16 * n_words
  AND 5 * len(list_distinct(string_split(text, chr(10)))) >= 2 * len(string_split(text, chr(10))) - 5 AS kept
FROM f
"""
