import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import order_minhash, substring
from quirefold.llm.common import Stages
from quirefold.llm.components import components
from tests.conftest import canonical
from tests.llm import brute

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (7, "w" * 70_000), (8, "a b c d e f g h i j k l m n o p")]


def copies(seed=3):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choices(vocabulary, k=80) for _ in range(12)]
    rows, n = [], 0
    for w in base:
        for rate in (0, 0.01, 0.04, 0.08):
            edited = [random.choice(vocabulary) if random.random() < rate else x for x in w]
            rows.append((n, " ".join(edited)))
            n += 1
    passage = " ".join(random.choices(vocabulary, k=20))
    for _ in range(60):
        rows.append((n, " ".join(random.choices(vocabulary, k=40)) + " " + passage + " " + " ".join(random.choices(vocabulary, k=40))))
        n += 1
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1])]


def test_edit_distance_matches_dynamic_programming():
    random.seed(1)
    for _ in range(3000):
        a = [random.randrange(4) for _ in range(random.randrange(25))]
        b = a[:]
        for _ in range(random.randrange(6)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(2)] = [random.randrange(4)] * random.randrange(2)
        band = random.randrange(10)
        want = brute.distance(a, b)
        assert order_minhash.edit_distance(a, b, band) == (want if want <= band else None)


def test_classes_match_brute_force(spark):
    rows = copies()
    got = dict(order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert got == brute.classes(rows)


def edited(words, share, tag):
    """words with that share of them, evenly spread, replaced by new ones."""
    out, n = list(words), round(share * len(words))
    for i in random.sample(range(len(out)), n):
        out[i] = f"{tag}{i}"
    return out


def drifting(seed=5, chains=12, length=7):
    """Chains of versions, each an edit of the last, beside texts that share a passage with all of them."""
    random.seed(seed)
    vocabulary, passage, rows = [f"w{i}" for i in range(3000)], [f"p{i}" for i in range(30)], []
    for c in range(chains):
        now = random.choices(vocabulary, k=90)
        for step in range(length):
            now = edited(now, 0.14, f"c{c}s{step}x")
            rows.append(" ".join(passage + now))
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1000, 7])
def test_drifting_versions_in_shared_buckets(spark, block):
    rows = drifting()
    got = dict(order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).select("doc_id", "class_id").collect())
    assert got == brute.classes(rows)


def test_recall_just_over_the_threshold(spark):
    random.seed(11)
    vocabulary, rows = [f"w{i}" for i in range(5000)], []
    for i in range(150):
        base = random.choices(vocabulary, k=200)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(base, (0.2, 0.18, 0.15)[i % 3], "x")))]
    got = dict(order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect())
    want = brute.classes(rows)
    missed = sum(got[d] != c for d, c in want.items())
    assert len(set(want.values())) == 150 and missed <= 2


def test_pairs_among_texts_with_a_shared_opening(spark):
    random.seed(21)
    opening, rows = " ".join(f"o{i}" for i in range(30)) + " ", []
    for i in range(100):
        rows.append(opening + " ".join(f"s{i}x{k}" for k in range(45)))
    for i in range(10):
        body = [f"p{i}x{k}" for k in range(45)]
        rows += [opening + " ".join(body), opening + " ".join(edited(body, 0.2, f"q{i}"))]
    random.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute.classes(rows)
    assert len(set(want.values())) == 110
    assert dict(order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()) == want


@pytest.mark.parametrize("block", [250, 9])
def test_texts_that_are_mostly_one_passage(spark, block):
    random.seed(31)
    passage, common, rows = " ".join(f"p{i}" for i in range(120)), [f"c{i}" for i in range(40)], []
    for i in range(70):
        rows.append(passage + " " + " ".join(random.choices(common, k=random.randrange(34, 58))))
    rows = list(enumerate(rows))
    want = brute.classes(rows)
    assert len(set(want.values())) > 1
    assert dict(order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).select("doc_id", "class_id").collect()) == want


def test_first_qgrams_of_near_duplicates_meet():
    random.seed(41)
    for q in order_minhash.QGRAMS:
        for _ in range(200):
            size = random.randrange(5, 60)
            a = [random.randrange(30) for _ in range(size)]
            b = edited(a, random.choice([0.05, 0.1, 0.2]), 100) if random.random() < 0.5 else a[random.randrange(size // 5 + 1) :]
            b = [hash(x) for x in b]
            if not b or brute.distance(a, b) > int(0.2 * max(len(a), len(b)) + 1e-9):
                continue
            firsts = []
            for w in (a, b):
                values, bounds = order_minhash._qgrams(np.array(w, np.int64).astype(np.uint64), np.array([len(w)]), q)
                need = max(1, int(np.ceil((1 - q * 0.2) * len(w) - q + 1 - 1e-6)))
                firsts.append(set(np.sort(values)[: len(values) - need + 1].tolist()))
            assert firsts[0] & firsts[1]


def test_edit_distance_of_very_long_texts():
    random.seed(51)
    a = [f"w{i}" for i in range(20_000)] + ["the"] * 200
    b = edited(a, 0.01, "x")
    assert order_minhash.edit_distance(a, b, 4000) == sum(x != y for x, y in zip(a, b))
    assert order_minhash.edit_distance(a[:6000], [f"y{i}" for i in range(6000)], 1200) is None
    for _ in range(50):
        c = [random.randrange(6) for _ in range(40)]
        d = [random.randrange(6) for _ in range(40)]
        narrow = order_minhash.edit_distance(c, d, 30)
        order_minhash.WHOLE_MASKS, kept = 0, order_minhash.WHOLE_MASKS
        try:
            assert order_minhash.edit_distance(c, d, 30) == narrow
        finally:
            order_minhash.WHOLE_MASKS = kept


def test_counters_refute_no_near_duplicate(spark):
    random.seed(8)
    base = random.choices([f"w{i}" for i in range(50)], k=2000)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 0.2, "x"))), (3, " ".join(edited(base, 0.5, "y")))]
    counted = {r["vertex"]: r for r in spark.createDataFrame(rows, "vertex long, text string").mapInArrow(order_minhash._counted, "vertex long, size int, bins binary").collect()}
    pairs = [(u, v, *(counted[x][c] for c in ("size", "bins") for x in (u, v))) for u, v in ((1, 2), (1, 3))]
    frame = spark.createDataFrame(pairs, "u long, v long, size_u int, size_v int, bins_u binary, bins_v binary")
    assert [tuple(r) for r in frame.mapInArrow(order_minhash._possible(0.8), "u long, v long").collect()] == [(1, 2)]


def test_classes_on_table(spark, sf, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert dict(order_minhash.op1_order_minhash(spark, sf).collect()) == brute.classes(rows)


def test_near_duplicates_edges(spark):
    frame = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("class_id", F.lit("x")).withColumn("key", F.lit(1))
    out = order_minhash.near_duplicates(frame)
    rows = [(r["doc_id"], r["class_id"]) for r in out.collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (None, None), (7, 7), (8, 8)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert order_minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(0, i) for i in range(500, 560)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), Stages(spark), "c").collect())
    assert got == {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("rows", [copies(), copies(9)])
def test_repeats_match_brute_force(spark, rows):
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.without_repeats(rows)
    for r in out.collect():
        w, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(w) - len(kept), " ".join(kept))
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeats_against_sql(spark, sf, duck):
    assert canonical(substring.op2_substring_dedup(spark, sf).toPandas()) == canonical(duck.sql(substring.OP2_SQL).df())


def test_repeats_edges(spark):
    rows = [*EDGES, (9, "a b c d e f g h i j k l m x"), (10, " ".join(["z"] * 40)), (11, " ".join(["z"] * 14))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("at", F.lit(1))
    out = {(r["doc_id"], r["text"]): (r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(frame).collect()}
    assert out[9, rows[-3][1]] == (13, "x") and out[10, rows[-2][1]][0] == 0 and out[11, rows[-1][1]] == (14, "")
    assert out[5, "one two"] == (0, "one two") and out[1, None] == (0, "")
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
