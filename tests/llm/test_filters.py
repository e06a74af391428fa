import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.llm import cascade, decontaminate, licences, linkgraph
from tests.conftest import canonical
from tests.llm import brute


@pytest.mark.parametrize(("run", "sql"), [(licences.op3_licence_scan, licences.OP3_SQL), (decontaminate.op4_decontaminate, decontaminate.OP4_SQL), (linkgraph.op5_url_filters, linkgraph.OP5_SQL), (cascade.op8_quality_rules, cascade.OP8_SQL)])
def test_against_sql(run, sql, spark, sf, duck):
    assert canonical(run(spark, sf).toPandas()) == canonical(duck.sql(sql).df())


# ------------------------------------------------------------- licences


def test_licence_digests(spark):
    mit = dict(licences.LICENCE_TEXTS[:1])["MIT"]
    british = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper() + "\nAll rights reserved."
    rows = [(1, british), (2, mit + " And more."), (3, None), (4, ""), (5, "x\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0."), (5, "x\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0."), (6, "word " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence_id", F.lit("clash")).withColumn("known_digests", F.lit(1)).withColumn("known_digest", F.lit(1)).withColumn("licence_digest", F.lit("clash"))
    out = [(r["doc_id"], r["licence_id"], r["notice_ids"]) for r in licences.scan_licences(frame).collect()]
    assert sorted(out, key=lambda x: x[0]) == [(1, "MIT", []), (2, None, []), (3, None, []), (4, None, []), (5, None, ["CC-BY-NC-4.0", "MIT"]), (5, None, ["CC-BY-NC-4.0", "MIT"]), (6, None, [])]
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts installed")
def test_whole_licence_documents_match(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    texts = {i: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for f, i in names.items()}
    rows = [(i, t) for i, t in texts.items()] + [(i, "Copyright 2024 Someone Else\n" + " ".join(t.upper().split())) for i, t in texts.items() if i in ("MPL-2.0", "CC0-1.0")]
    rows += [(None, texts["Apache-2.0"] + "\nand one more clause")]
    found = licences.scan_licences(spark.createDataFrame(rows, "want string, text string")).select("want", "licence_id").collect()
    assert len(found) == len(rows) and all(r["want"] == r["licence_id"] for r in found if r["want"]) and [r["licence_id"] for r in found if not r["want"]] == [None]


def test_line_wraps_do_not_change_a_licence(spark):
    mit = dict(licences.LICENCE_TEXTS[:1])["MIT"]
    flat = " ".join(mit.split())
    usual = flat.replace("THE AUTHORS OR COPYRIGHT", "THE\nAUTHORS OR COPYRIGHT")
    head = "MIT License\n\nCopyright (c) 2020 Someone\nCopyright Jane Doe\n(c) 2021 Other\n\n"
    clause = "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    rows = [(1, head + usual), (2, flat), (3, mit), (4, "\n".join(flat.split())), (5, flat.replace(clause + " ", "")), (6, "(c) You must retain all notices")]
    out = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["licence_id"] for i in range(1, 7)] == ["MIT"] * 4 + [None] * 2 and out[6]["licence_digest"] != brute.sha("")


# ------------------------------------------------------------- decontamination

QUESTION = "If Alice Brown buys 12 apples for 3 dollars and gives 12 of them to Bob, how many apples does Alice Brown have left over today?"


def leaks(spark, docs, bench):
    made = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in made.collect()}


def test_reparameterised_questions(spark):
    renamed = QUESTION.replace("Alice Brown", "Carol").replace("Bob", "Dan").replace("12", "40").replace("3 dollars", "7 euros")
    broken = QUESTION.replace("gives 12", "gives 13")
    docs = [(1, "Some words before. " + renamed + " And after."), (2, broken), (3, QUESTION.upper()), (4, None), (5, ""), (6, "plain text of no concern " * 20), (None, QUESTION), (7, renamed), (7, renamed), (8, "w " * 50_000 + ". " + QUESTION)]
    got = leaks(spark, docs, [(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (4, "three words only")])
    assert {(1, 1), (None, 1), (7, 1), (8, 1)} <= got and not {d for d, _ in got} & {4, 5, 6}
    assert (2, 1) not in leaks(spark, [(2, broken)], [(1, QUESTION)])


def test_names_that_open_a_sentence_and_verbatim_numbers(spark):
    bench = [(1, "Anna has 5 pens. Ben has 7 pens. Carl has 9 pens. How many pens do they have altogether?"), (2, "Tom buys 12 apples and eats 5 of them, how many remain?"), (3, "Compute 12 + 7 * 3 - 45 / 9 + 8 now.")]
    docs = [(1, "Dora has 4 pens. Emil has 8 pens. Finn has 6 pens. How many pens do they have altogether?"), (2, "So. Sue buys 30 apples and eats 4 of them, how many remain?"), (3, bench[2][1]), (4, "Compute 13 + 7 * 3 - 45 / 9 + 8 now."), (5, "Dora has 4 pens. Emil has 8 pens. Dora has 6 pens. How many pens do they have altogether?")]
    assert leaks(spark, docs, bench) == {(1, 1), (2, 2), (3, 3)}


def test_short_items_and_empty_tables(spark):
    assert leaks(spark, [(1, "here are three words only for you"), (2, "three words")], [(4, "Three words only")]) == {(1, 4)}
    assert leaks(spark, [], [(4, "Three words only")]) == set() and leaks(spark, [(1, "a")], []) == set()


def test_verbatim_passages(spark, sf, duck):
    want = set(duck.sql("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    assert want == got


def test_drop_leaks(spark):
    docs = spark.createDataFrame([(1, QUESTION, "x"), (1, "other text", "y"), (None, "more", "z")], "doc_id long, text string, lang string")
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, QUESTION)], "item_id long, text string"))
    assert sorted(r["lang"] for r in kept.collect()) == ["y", "z"] and kept.columns == docs.columns


def test_long_runs_do_not_overflow_the_stack(spark):
    rows = [(1, "Hahe " * 60_000), (2, "x 1.2" + ".3" * 100_000), (3, "Some " * 30_000 + ". " + QUESTION)]
    assert {i for i, _ in leaks(spark, rows, [(1, QUESTION)])} == {3}


def test_placeholder_characters_and_column_names(spark):
    marks = decontaminate.NUM + decontaminate.NAME + decontaminate.UNIT
    bench = [(1, "one two three four five six seven eight"), (2, "single")]
    assert leaks(spark, [(1, f"one two{marks}three four five six seven eight"), (2, "one " + marks), (3, "a single word")], bench) == {(1, 1), (3, 2)}
    docs = spark.createDataFrame([(1, "text", "a", 5)], "doc_id long, text string, key string, hash int")
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "text", "a", 5)] and kept.columns == docs.columns


# ------------------------------------------------------------- urls


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?y#z", "https://example.net", "ftp://b.example.com/de/", "https://x.org/fr/1", "no scheme", None, "https://Ünet.net/", "a://b://c.net/x"]
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in linkgraph.filter_urls(frame).collect()}
    assert rows[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[1][:3] == ("example.net", "", None) and rows[2] == ("b.example.com", "/de/", "example.com/de/", "block")
    assert rows[3][2:] == ("org/fr/", "allow") and rows[4] == ("", "", None, "allow") and rows[5] == ("", "", None, "allow")
    assert rows[6][0] == "Ünet.net" and rows[7][:2] == ("b:", "//c.net/x")
    assert linkgraph.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_against_sql(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">t</a>' for h in hosts)
    rows = [(1, "https://bad.net/", link("mid.info")), (2, "https://mid.info/", link("bad.net", "bad.net")), (3, "https://far.info/", link("mid.info")), (4, "https://good.org/fr/x", link("nice.info")),
            (5, "https://nice.info/", None), (6, "https://nice.info/2", link("good.org", "else.where")), (7, "https://else.where/", ""), (7, "https://else.where/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    frame.toPandas().to_parquet(tmp_path / "p.parquet")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p.parquet'")
    got = linkgraph.filter_urls(frame).select("page_id", "host", "path", "rule", "verdict").toPandas()
    assert canonical(got) == canonical(con.sql(linkgraph.OP5_SQL).df())
    verdicts = dict(zip(got.page_id, got.verdict))
    assert verdicts[2] == "block" and verdicts[5] == "allow"


@pytest.mark.parametrize("linked", [False, True])
def test_blocked_seed_with_many_linkers(spark, linked):
    rows = [(0, "https://bad.net/", None)]
    for i in range(1, 41):
        rows.append((i, f"https://farm{i}.info/", '<a href="//bad.net/p">t</a>' + (f'<a href="//farm{i % 40 + 1}.info/">n</a>' if linked else "")))
    rows.append((99, "https://portal.info/", '<a href="//bad.net/">t</a>' + "".join(f'<a href="https://other{i}.info/">t</a>' for i in range(60))))
    verdicts = {r["page_id"]: r["verdict"] for r in linkgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {verdicts[i] for i in range(41)} == {"block"} and verdicts[99] == "allow"


# ------------------------------------------------------------- quality


def test_quality_matches_brute_force(spark):
    good = " ".join(f"word{i} plain" for i in range(60))
    texts = [None, "", " \n\t", "a b", good, good + "\n" + good, "a b c " * 60, "# * " * 100, "ABC DEF " * 100, "x" * 5000, "line\n" * 100, "\u00a0 \u2003 é", "a\x0bb\x0cc\rd", "w" * 300_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("failed_rule", F.lit(1)).withColumn("n_words", F.lit("x"))
    base = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in cascade.base_columns(frame).collect()}
    assert base == {i: brute.quality(t) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in cascade.keep_quality(frame).collect()}
    assert kept == {i for i, t in enumerate(texts) if brute.kept_quality(t)}
    assert cascade.keep_quality(frame.limit(0)).count() == 0


def test_a_costly_rule_that_rejects_little_comes_after_a_cheap_one_that_rejects_much(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{k % 700}" for k in range(20 if i % 2 else 1500))) for i in range(400)], "doc_id long, text string")
    orders = {tuple(r.name for r in cascade.ordered_rules(cascade.with_word_count(frame))) for _ in range(2)}
    assert all(o[0] == "too_few_words" for o in orders)


def test_order_does_not_change_what_is_kept(spark):
    frame = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string")
    counted = cascade.with_word_count(frame)
    one, two = (counted.where(cascade.verdict(r).isNull()).count() for r in (cascade.RULES, cascade.RULES[::-1]))
    assert one == two and {r.name for r in cascade.ordered_rules(counted)} == {r.name for r in cascade.RULES}
