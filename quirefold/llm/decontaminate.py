"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names (capitalised words inside a sentence, runs as one) become typed
placeholders; the rest is lower-cased and loses punctuation. Windows of WINDOW template tokens of every
document are hash-joined to those of the benchmark and compared token by token. Each benchmark window has
an anchor, its longest two tokens in a row (or its one token); a bit table of the anchors shows where in a
document a window can match at all, so only windows around these places are formed. Before, a gate passes the
documents that hold, for some benchmark window, its longest three (two, one) words in a row, without regard to
templates; no window that matches fails it, and most documents need no template at all. Where matched windows hold placeholders, their
values are compared along the alignment: each benchmark value must stand for one document value of its
type and the reverse, so a re-parameterised question is caught and a chance template is not. A document
is contaminated by an item if, on one alignment, the windows that remain cover min(MIN_TOKENS, the
item's tokens) tokens or more.

What this template misses is sought by two others in the same pass: one where every capitalised run is a name, so names
that open a sentence count, and one without placeholders, which finds an item of which every token stands
as it is, so an item rich in numbers is found where its windows hold too few other tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, read, small

WINDOW = 8
MIN_TOKENS = 13

#: A window needs this many tokens that are no placeholders (all of them in an item shorter than that).
MIN_LITERALS = 4

#: The bit table of anchors has 2 to this power bits at most; beyond, more windows go to the join.
MOST_BITS = 22

#: A hash's second bit is chosen by what follows its first so many bits.
SECOND = 29

NUM, NAME, UNIT = "", "", ""
_MARKS = {"num": NUM, "name": NAME, "unit": UNIT}

#: Units that may follow a number.
UNITS = (
    "km", "cm", "mm", "m", "kg", "mg", "g", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "k",
    "b", "kb", "mb", "gb", "tb", "%", "°c", "°f", "usd", "eur", "gbp", "mph", "kmh", "feet", "foot", "ft", "inches", "inch", "in", "miles", "mile",
    "yards", "yard", "meters", "meter", "metres", "metre", "grams", "gram", "pounds", "pound", "liters", "liter", "litres", "litre", "gallons",
    "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "percent",
    "dollars", "dollar", "cents", "cent", "euros", "euro", "degrees", "degree",
)

#: Repeated groups are possessive in Spark, since a greedy one takes a stack frame for each repetition and a long run
#: of capitalised words or of joined numbers overflows the executor's stack. Nothing is lost: what follows never starts inside the run.
_NUMBER = "[0-9]+(?:[.,:/][0-9]+)*+"
_BY_LENGTH = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
#: The number of a quantity, its unit, and the character after it.
QUANTITY = rf"(?i)({_NUMBER})[ -]?({_BY_LENGTH})([^\p{{L}}\p{{N}}]|$)"
NUMBER = _NUMBER
NAMES = r"([\p{L}\p{N},;] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*+)"
#: Names wherever they stand.
ALL_NAMES = r"((?:^|[^\p{L}\p{N}]))(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*+)"
#: How many words in a row the gate looks for, the most first.
GATE_WORDS = (3, 2, 1)

#: Patterns of names, in the order of the templates; the last has no placeholders and needs every token of an item.
TEMPLATES = (NAMES, ALL_NAMES, None)
OTHER = f"[^\\p{{L}}\\p{{N}}{NUM}{NAME}{UNIT}]+"


def _raw(text: Column) -> Column:
    """The text, empty for null, without the characters that stand for placeholders."""
    out = F.coalesce(text, F.lit(""))
    for mark in _MARKS.values():
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def _marked(text: Column, names: str = NAMES) -> tuple[Column, Column, Column]:
    """text with quantities, then numbers, then names replaced."""
    raw = _raw(text)
    one = F.regexp_replace(raw, QUANTITY, f" {NUM} {UNIT} $3")
    two = F.when(raw.rlike("[0-9]"), F.regexp_replace(one, NUMBER, f" {NUM} ")).otherwise(raw)
    return one, two, F.regexp_replace(two, names, f"$1{NAME}")


def template(text: Column, names: str | None = NAMES) -> Column:
    """The template tokens of a text as an array; empty for null. names: the pattern of names; null for no placeholders at all."""
    raw = _raw(text) if names is None else _marked(text, names)[2]
    flat = F.trim(F.regexp_replace(F.lower(raw), OTHER, " "))  # OTHER takes whole runs, so single spaces are left
    return F.array_remove(F.split(flat, " "), "")


def slots(text: Column, tokens: Column, names: str = NAMES) -> Column:
    """array<struct<kind, at, value>>: the placeholders among tokens, with what they stand for."""
    one, two, _ = _marked(text, names)
    # numbers in order: a quantity's number stays findable beside its marks only in the raw text
    raw = _raw(text)
    kept = F.regexp_replace(raw, QUANTITY, f" {NUM}$1 {UNIT} $3")
    number = F.regexp_extract_all(kept, F.lit(NUMBER), F.lit(0))
    unit = F.transform(F.regexp_extract_all(raw, F.lit(QUANTITY), F.lit(2)), F.lower)
    name = F.regexp_extract_all(two, F.lit(names), F.lit(2))
    parts = []
    for kind, values in (("num", number), ("unit", unit), ("name", name)):
        parts.append(_placed(kind, tokens, values))
    return F.concat(*parts)


def _placed(kind: str, tokens: Column, values: Column) -> Column:
    at = F.filter(F.transform(tokens, lambda x, i: F.when(x == _MARKS[kind], i)), lambda x: x.isNotNull())
    return F.zip_with(at, values, lambda a, v: F.struct(F.lit(kind).alias("kind"), a.alias("at"), v.alias("value")))


def _anchor_hash(*tokens: Column) -> Column:
    return F.xxhash64(*tokens)


def _known(table: Column, size: int, h: Column) -> Column:
    """Whether both bits of a hash are set; a hash of none of the values passes with a chance of about (2 * values / bits) squared."""
    bit = lambda v: F.bit_get(F.get(table, F.shiftright(v, 6).bitwiseAND(size - 1).cast("int")), v.bitwiseAND(63).cast("int")) == 1
    return bit(h) & bit(F.shiftright(h, SECOND))


def _mixed(hashes: list[Column]) -> Column:
    """One hash for those of words in a row."""
    out = hashes[0]
    for n, h in enumerate(hashes[1:], 1):
        out = out.bitwiseXOR(F.shiftleft(h, n))
    return out


def _gate_anchor(part: Column) -> Column:
    """A struct (words, hash) of the longest three, two or one tokens in a row of letters alone; null if part has none.

    Such tokens stand in every text that has the window, and side by side among its runs of letters, whatever the template.
    """
    rows = []
    for n in GATE_WORDS:
        tokens = lambda i, n=n: [F.get(part, i + k) for k in range(n)]
        plain = lambda i, n=n: F.concat(*tokens(i)).rlike(r"^\p{L}+$")  # noqa: E731  null where fewer are left
        each = F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda i, n=n: F.when(plain(i), F.struct(F.length(F.concat(*tokens(i))).alias("l"), _mixed([F.xxhash64(t) for t in tokens(i)]).alias("h"))))
        rows.append(F.when(F.array_max(each).isNotNull(), F.struct(F.lit(n).alias("words"), F.array_max(each)["h"].alias("hash"))))
    return F.coalesce(*rows)


def _gate(text: Column, anchors: DataFrame) -> Column | None:
    """Whether a text holds one of anchors (words, hash), as far as the bit tables tell; null if an anchor is missing, so nothing can be told."""
    if not anchors.where("hash IS NULL").isEmpty():
        return None
    hashes = F.transform(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "), " "), lambda x: F.xxhash64(x))
    tables = [(n, *_bit_table(own.select("hash"))) for n in GATE_WORDS if not (own := anchors.where(F.col("words") == n)).isEmpty()]

    def found(t: Column) -> Column:
        def marked(x: Column, i: Column) -> Column:
            hits = [F.coalesce(_known(table, size, _mixed([x, *[F.get(t, i + k) for k in range(1, n)]])), F.lit(False)) for n, table, size in tables]
            out = hits[0] if hits else F.lit(False)
            for hit in hits[1:]:
                out = out | hit
            return out

        return F.array_contains(F.transform(t, marked), True)

    return F.transform(F.array(hashes), found)[0]


def _bit_table(values: DataFrame) -> tuple[Column, int]:
    """(array<bigint>, its length, a power of two): two bits for each hash in the one column; 2 ** MOST_BITS bits at most."""
    values = values.toDF("h").distinct()
    bits = min(1 << MOST_BITS, max(1 << 16, 1 << (1024 * values.count()).bit_length()))
    size = bits // 64
    both = values.select(F.explode(F.array("h", F.shiftright("h", SECOND))).alias("h"))
    words = both.groupBy(F.shiftright("h", 6).bitwiseAND(size - 1).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("w"))
    table = [0] * size
    for r in words.collect():  # size rows at most
        table[r["k"]] = r["w"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), size


def _near_anchors(rows: DataFrame, anchors: dict[int, DataFrame], sizes: list[int]) -> DataFrame:
    """(key, tpl, size, at, window): the windows of rows (key, tokens0, tokens1, ...) that hold an anchor of their template, as far as the bit tables tell."""
    reach, single = max(sizes), 1 in sizes
    first = lambda p: F.greatest(p - max(reach - 2, 0), F.lit(0))

    def around(tpl: int) -> Column:
        table, size = _bit_table(anchors[tpl])
        tokens = F.col(f"tokens{tpl}")
        known = lambda h: _known(table, size, h)

        def marked(x: Column, i: Column) -> Column:
            pair = known(_anchor_hash(x, F.get(tokens, i + 1)))
            return F.when(pair | known(_anchor_hash(x)) if single else pair, i)

        spots = F.array_compact(F.transform(tokens, marked))
        return F.transform(spots, lambda p: F.struct(F.lit(tpl).alias("tpl"), p.alias("p"), first(p).alias("a"), F.slice(tokens, first(p) + 1, p - first(p) + reach).alias("t")))

    # explode_outer, since for explode the optimizer adds a filter on the array's size that computes everything twice
    spot = rows.select("key", F.explode_outer(F.concat(*map(around, anchors))).alias("s")).where("s IS NOT NULL").select("key", "s.tpl", "s.p", "s.a", "s.t")
    parts = []
    for n in sizes:
        starts = F.sequence(F.greatest("a", F.col("p") - max(n - 2, 0)), F.col("p"))
        parts.append(spot.select("key", "tpl", F.lit(n).alias("size"), F.explode(starts).alias("at"), "a", "t").select("key", "tpl", "size", "at", F.slice("t", F.col("at") - F.col("a") + 1, n).alias("window")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where(F.size("window") == F.col("size"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_tokens: int = MIN_TOKENS, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered) for each document and benchmark item that it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts match
    nothing, and the characters U+E000 to U+E002 count as spaces. An item shorter than window is matched as a whole. Repeated rows give one row; rows that
    share a doc_id but not the text are judged apart and give one row each for an item.
    """
    keyed, best = _leaks(docs, benchmark, window, min_tokens, min_literals)
    ids = keyed.join(small(best.select("key").distinct(), 16), "key", "left_semi").select("key", "doc_id").distinct()
    return ids.join(best, "key").select("doc_id", "item_id", "n_tokens", "n_covered").distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_tokens: int = MIN_TOKENS, min_literals: int = MIN_LITERALS) -> DataFrame:
    """The rows of docs, unchanged, whose text holds no benchmark item; a column called _q_key is reserved."""
    _, best = _leaks(docs, benchmark, window, min_tokens, min_literals)
    bad = best.select(F.col("key").alias("_q_key")).distinct()
    return docs.withColumn("_q_key", F.xxhash64("doc_id", "text")).join(small(bad, 16), "_q_key", "left_anti").drop("_q_key")


def _bench(items: DataFrame, window: int, min_literals: int) -> DataFrame:
    """(tpl, item, size, item_at, hash, part, slotted, anchor) of the windows of items."""
    marks = F.array(*[F.lit(m) for m in _MARKS.values()])
    spread = items.select("tpl", "key", F.col("tokens").alias("t"), F.size("tokens").alias("n")).withColumn("size", F.least(F.lit(window), "n"))
    spread = spread.select("tpl", "key", "n", "size", "t", F.explode(F.expr("sequence(0, n - size)")).alias("at")).withColumn("part", F.slice("t", F.col("at") + 1, F.col("size")))
    spread = spread.withColumn("plain", F.filter("part", lambda x: ~F.array_contains(marks, x))).where(F.size("plain") >= F.least(F.lit(min_literals), F.col("n")))
    two = F.transform(F.sequence(F.lit(0), F.size("part") - 2), lambda i: F.struct(F.length(F.get("part", i)) + F.length(F.get("part", i + 1)), _anchor_hash(F.get("part", i), F.get("part", i + 1)).alias("h")))
    anchor = F.when(F.size("part") < 2, _anchor_hash(F.get("part", F.lit(0)))).otherwise(F.array_max(F.when(F.size("part") >= 2, two))["h"])
    return spread.select("tpl", F.col("key").alias("item"), "size", F.col("at").alias("item_at"), F.xxhash64("part").alias("hash"), "part", (F.size("plain") < F.col("size")).alias("slotted"), anchor.alias("anchor"), _gate_anchor(F.col("part")).alias("gate"))


def _found_anyway(text: Column, min_tokens: int) -> Column:
    """Whether the first template finds every verbatim copy of an item: between its first and last token it has min_tokens in
    a row that are no placeholders, so they read the same wherever the item stands and their windows match as they are."""
    tokens, marks = template(text), F.array(*[F.lit(m) for m in _MARKS.values()])
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    return F.array_join(F.transform(inner, lambda x: F.when(F.array_contains(marks, x), "p").otherwise("t")), "").contains("t" * min_tokens)


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, min_tokens: int, min_literals: int) -> tuple[DataFrame, DataFrame]:
    """(docs with their key, a row for each key and item it holds), by the first template that finds it."""
    stages = Stages(docs.sparkSession)
    items = None
    for tpl, names in enumerate(TEMPLATES):
        own = benchmark.select("item_id", "text").distinct().withColumn("tokens", template(F.col("text"), names))
        own = own.withColumn("slots", slots(F.col("text"), F.col("tokens"), names or NAMES)).withColumns({"key": F.xxhash64("item_id", "text"), "tpl": F.lit(tpl)})
        if names is None:
            own = own.where(~_found_anyway(F.col("text"), min_tokens))
        items = own if items is None else items.unionByName(own)
    items = stages.keep(items.where("size(tokens) > 0"), "items")
    short = [r[0] for r in items.where(F.size("tokens") < window).select(F.size("tokens")).distinct().collect()]  # under window of them
    sizes = sorted({window, *short})
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    bench = stages.keep(_bench(items, window, min_literals), "bench")
    passed = _gate(F.col("text"), bench.select("gate.words", "gate.hash").distinct())
    used = [r[0] for r in bench.select("tpl").distinct().orderBy("tpl").collect()] or [0]  # a row for each template
    tokens = (keyed if passed is None else keyed.where(passed)).select("key", *[template(F.col("text"), TEMPLATES[tpl]).alias(f"tokens{tpl}") for tpl in used])
    near = _near_anchors(tokens, {tpl: bench.where(F.col("tpl") == tpl).select("anchor") for tpl in used}, sizes).withColumn("hash", F.xxhash64("window"))
    found = near.join(small(bench.drop("anchor", "gate"), 64, weight=F.octet_length(F.array_join("part", " "))), ["tpl", "size", "hash"]).where("window = part")
    found = stages.keep(found.select("tpl", "key", "item", "size", "slotted", "item_at", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "found")
    good = found.where("NOT slotted")
    for tpl, names in enumerate(TEMPLATES):
        lines = found.where(F.col("slotted") & (F.col("tpl") == tpl))
        if names and not lines.isEmpty():
            good = good.unionByName(_consistent(keyed, items.where(F.col("tpl") == tpl), lines, stages, names, f"pairs{tpl}"))
    steps = F.expr("zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> least(size, coalesce(b - a, size)))")
    cover = good.groupBy("tpl", "key", "item", "shift", "size").agg(F.array_sort(F.collect_set("item_at")).alias("p"))  # no more than the item's windows
    cover = cover.withColumn("n_covered", F.aggregate(steps, F.lit(0), lambda n, g: n + g))
    best = cover.groupBy("tpl", "key", "item").agg(F.max("n_covered").alias("n_covered"))
    best = best.join(items.select("tpl", F.col("key").alias("item"), "item_id", F.size("tokens").alias("n_tokens")), ["tpl", "item"])
    need = F.when(F.col("tpl") < len(TEMPLATES) - 1, F.least(F.lit(min_tokens), "n_tokens")).otherwise(F.col("n_tokens"))
    best = best.where(F.col("n_covered") >= need).withColumn("first", F.min("tpl").over(Window.partitionBy("key", "item_id"))).where("tpl = first")
    return keyed, stages.keep(best.select("key", "item", "item_id", "n_tokens", "n_covered"), "best")


def _consistent(keyed: DataFrame, items: DataFrame, lines: DataFrame, stages: Stages, names: str, name: str) -> DataFrame:
    """The rows of lines, of one template, on alignments whose placeholder values map one to one."""
    need = lines.select("key").distinct()
    texts = keyed.join(small(need, 16), "key", "left_semi").select("key", "text").distinct().withColumn("tokens", template(F.col("text"), names))
    own = texts.select("key", F.explode(slots(F.col("text"), F.col("tokens"), names)).alias("s")).select("key", "s.kind", F.col("s.at").alias("at"), F.col("s.value").alias("value"))
    theirs = items.select(F.col("key").alias("item"), F.explode("slots").alias("s")).select("item", F.col("s.kind").alias("kind"), F.col("s.at").alias("item_pos"), F.col("s.value").alias("item_value"))
    spots = lines.select("key", "item", "shift", F.explode(F.sequence("item_at", F.col("item_at") + F.col("size") - 1)).alias("item_pos")).distinct()
    pairs = spots.join(theirs, ["item", "item_pos"]).withColumn("at", F.col("item_pos") + F.col("shift")).join(own, ["key", "kind", "at"])
    line = ["key", "item", "shift"]
    pairs = stages.keep(pairs.select(*line, "kind", "item_value", "value").distinct(), name)
    bad = pairs.groupBy(*line, "kind", "item_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*line)
    bad = bad.union(pairs.groupBy(*line, "kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*line)).distinct()
    return lines.join(bad, line, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''").replace(")*+", ")*") + "'"
    two = f"regexp_replace(regexp_replace(coalesce(text, ''), {q(QUANTITY)}, ' {NUM} {UNIT} \\3', 'g'), {q(NUMBER)}, ' {NUM} ', 'g')"
    tokens = f"list_filter(string_split(regexp_replace(lower(regexp_replace({two}, {q(NAMES)}, '\\1{NAME}', 'g')), {q(OTHER)}, ' ', 'g'), ' '), lambda x: x <> '')"
    kept = f"regexp_replace(coalesce(text, ''), {q(QUANTITY)}, ' {NUM}\\1 {UNIT} \\3', 'g')"
    values = {"num": f"regexp_extract_all({kept}, {q(NUMBER)})", "unit": f"list_transform(regexp_extract_all(coalesce(text, ''), {q(QUANTITY)}, 2), lambda x: lower(x))", "name": f"regexp_extract_all({two}, {q(NAMES)}, 2)"}

    def both(name: str, table: str, key: str) -> str:
        union = " UNION ALL ".join(
            f"SELECT {key}, '{k}' AS kind, unnest(list_filter(list_transform(tokens, lambda x, i: CASE WHEN x = '{_MARKS[k]}' THEN i END), lambda x: x IS NOT NULL)) AS at, unnest({v}) AS value FROM {name}" for k, v in values.items())
        return f"""{name} AS MATERIALIZED (SELECT DISTINCT {key}, text, {tokens} AS tokens FROM {table}),
{name}_slot AS ({union}),
{name}_win AS (SELECT {key}, i AS at, tokens[i:i + {WINDOW - 1}] AS w, len(tokens) AS n FROM {name}, unnest(generate_series(1, len(tokens) - {WINDOW - 1})) AS g(i))"""

    literal = f"len(list_filter(b.w, lambda x: x NOT IN ('{NUM}', '{NAME}', '{UNIT}')))"
    line = "doc_id, item_id, shift"
    return f"""
WITH {both("d", "documents", "doc_id")}, {both("b", "benchmark", "item_id")},
hit AS MATERIALIZED (SELECT d.doc_id, b.item_id, b.at AS item_at, d.at - b.at AS shift, b.n, {literal} < {WINDOW} AS slotted
  FROM d_win d JOIN b_win b ON d.w = b.w WHERE {literal} >= {MIN_LITERALS}),
spot AS (SELECT DISTINCT {line}, item_at + o AS pos FROM hit, generate_series(0, {WINDOW - 1}) AS g(o) WHERE slotted),
pair AS (SELECT DISTINCT {line}, s.kind, s.value AS iv, t.value AS dv FROM spot JOIN b_slot s USING (item_id) JOIN d_slot t USING (doc_id) WHERE s.at = pos AND t.at = pos + shift AND s.kind = t.kind),
bad AS (SELECT {line} FROM pair GROUP BY {line}, kind, iv HAVING count(*) > 1 UNION SELECT {line} FROM pair GROUP BY {line}, kind, dv HAVING count(*) > 1),
good AS (SELECT * FROM hit WHERE NOT slotted OR ({line}) NOT IN (SELECT ({line}) FROM bad)),
cover AS (SELECT doc_id, item_id, shift, n, count(DISTINCT item_at + o) AS c FROM good, generate_series(0, {WINDOW - 1}) AS g(o) GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_tokens, max(c)::INTEGER AS n_covered FROM cover GROUP BY doc_id, item_id, n HAVING max(c) >= least({MIN_TOKENS}, n)
"""


OP4_SQL = _sql()
