import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import bpe, lattice_lm, sharding, warc
from quirefold.llm.common import Stages
from tests.conftest import canonical
from tests.llm import brute


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


# ------------------------------------------------------------- byte pairs


def test_codec_matches_library(tokenizer):
    random.seed(5)
    codec = bpe.Codec.load(bpe.vocabulary_path())
    alphabet = list("abcdefgh the and   \n\n\t'sre0123!é中😀\u00a0\u2028") + ["<|endoftext|>", "<|endof"]
    for k in range(400):
        s = "".join(random.choice(alphabet) for _ in range(random.randrange(500)))
        s = s.replace(" ", "").replace("\n", "") if k % 8 == 0 else s
        ids = codec.encode(s)
        assert ids == tokenizer.encode(s, add_special_tokens=False).ids
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == s


def test_bpe_query(spark, sf, duck, tokenizer):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op9_bpe(spark, sf).collect()}
    for doc, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[doc] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(back))


def test_bpe_edges(spark):
    rows = [(1, None), (2, ""), (3, "ab" * 40_000), (3, "ab" * 40_000), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.round_trip(frame, bpe.vocabulary_path()).collect()
    assert sorted((r["decoded"] for r in out)) == sorted((t or "") for _, t in rows)
    assert bpe.round_trip(frame.limit(0), bpe.vocabulary_path()).count() == 0


# ------------------------------------------------------------- language model


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces([("▁", 0), ("▁a", 1), ("a", 2), ("ab", 3), ("b", 4), ("▁ab", 5)], [6.0] * 256)
    p = pieces.first
    table = dict(zip(pieces.texts, p))
    for c in "abz▁":
        table[c] = table.get(c, 0) + math.prod(p[len(pieces.texts) + b] for b in c.encode())
    words = ["", "a", "ab", "aba", "zb", "abab"]
    lattice = lattice_lm.Lattice(pieces, p)
    counts = {}

    def every(s):
        if not s:
            yield 1.0, Counter()
        for n in range(1, len(s) + 1):
            if s[:n] in table:
                for rest, used in every(s[n:]):
                    yield table[s[:n]] * rest, used + Counter([s[:n]])

    for w, got in zip(words, lattice.score(words)):
        total = sum(x for x, _ in every("▁" + w))
        assert got == pytest.approx(math.log(total))
        for x, used in every("▁" + w):
            for piece, n in used.items():
                counts[piece] = counts.get(piece, 0) + n * x / total
    found = lattice.expected(words, np.ones(len(words)))
    assert found[pieces.texts.index("ab")] == pytest.approx(counts["ab"]) and found[pieces.texts.index("▁ab")] == pytest.approx(counts["▁ab"])


def test_scores_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the CAT", None, "", " \n", "a b c a", "unseen wörds 日本 \U0001f600", "the the the", "x" * 3000] * 3)] + [(None, "the end"), (2, "again")]
    out = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)), lattice_lm.vocabulary_path(), block_bytes=200)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in out.collect())
    lower = lambda t: [w.encode().lower().decode() for w in brute.words(t)]
    counts = Counter()
    for d, t in rows:
        if not lattice_lm.held_out(d):
            counts.update([*lower(t), "\x00end"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        tokens = [*lower(t), "\x00end"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[d, lattice_lm.held_out(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 8)] += 1
    assert got == want
    assert lattice_lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), lattice_lm.vocabulary_path()).count() == 0


def test_score_sums_segmentations_of_every_word(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat on", "a cat", "zzq the", None, "on on on the mat"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lattice_lm.score_documents(docs, lattice_lm.vocabulary_path(), passes=0).collect()}
    pieces = lattice_lm.Pieces.load(lattice_lm.vocabulary_path())
    trained = [1 for d, _ in rows if not lattice_lm.held_out(d)]
    counts = Counter(w for d, t in rows if not lattice_lm.held_out(d) for w in brute.words(t))
    p, end = lattice_lm.train(spark.createDataFrame(list(counts.items()), "word string, c long"), pieces, len(trained), 0)
    table = dict(zip(pieces.texts, p))

    def total(s):
        ways = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                own = table.get(s[i:j], 0.0)
                if j == i + 1:
                    own += math.prod(p[len(pieces.texts) + b] for b in s[i].encode())
                ways[j] += ways[i] * own
        return ways[-1]

    assert counts and sum(p) + end == pytest.approx(1.0)
    for d, t in rows:
        want = sum(math.log10(total("▁" + w)) for w in brute.words(t)) + math.log10(end)
        assert got[d][0] == pytest.approx(want, rel=1e-9)


def test_training_helps_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = lambda passes: lattice_lm.score_documents(docs, lattice_lm.vocabulary_path(), passes=passes).where("held_out").agg(F.sum("score")).first()[0]
    assert score(0) < score(1) < 0 and score(1) <= score(2) + 1e-6


# ------------------------------------------------------------- shards


def test_shards_are_a_reproducible_permutation(spark):
    for n in (0, 1, 2, 3, 39, 40, 41, 1000):
        frame = spark.range(n).withColumnRenamed("id", "doc_id").repartition(3)
        rows = sharding.feistel_shards(frame, shards=7).collect()
        again = sharding.feistel_shards(frame.repartition(5, "doc_id"), shards=7).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == n
        places = {(r["shard"], r["slot"]) for r in rows}
        sizes = Counter(s for s, _ in places)
        assert places == {(s, k) for s, m in sizes.items() for k in range(m)} and len(places) == n
        assert not n or max(sizes.values()) - min([sizes.get(s, 0) for s in range(7)]) <= 1
        for r in rows[:50]:
            assert sharding.locate(r["row_number"], n, 7) == (r["shard"], r["slot"])
            assert sharding.row_number(r["shard"], r["slot"], n, 7) == r["row_number"]


def test_shards_match_a_plain_numbering(spark):
    rows = [(i, f"t{i % 700}") for i in range(900)] + [(5, "t5")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [(r["h"], r["doc_id"], r["text"]) for r in frame.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text").collect()]
    want = Counter((d, t, *sharding.locate(n, len(keyed), 7)) for n, (_, d, t) in enumerate(sorted(keyed)))
    assert Counter(tuple(r) for r in sharding.feistel_shards(frame, 7).select("doc_id", "text", "shard", "slot").collect()) == want
    with pytest.raises(ValueError, match="Shard"):
        sharding.feistel_shards(frame.withColumn("Shard", F.lit(1)))


def test_shards_of_copies_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    frame = spark.createDataFrame([(None, None)] * 95 + [(1, "a")] * 3 + [(2, None)], "doc_id long, text string")
    rows = sharding.feistel_shards(frame, shards=4).collect()
    assert len(rows) == 99 and {r["row_number"] for r in rows} == set(range(99))
    assert Counter(r["shard"] for r in rows) == {0: 25, 1: 25, 2: 25, 3: 24}


def test_shard_query(spark, sf, duck):
    rows = sharding.op6_sharding(spark, sf).collect()
    facts = {d: (n, c) for d, n, c in ((d, len((t or "").encode()) + 16, __import__("zlib").crc32((t or "").encode())) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall())}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == facts
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s in sizes for k in range(sizes[s])}


# ------------------------------------------------------------- archives


def test_warc_query(spark, sf, duck):
    assert canonical(warc.op7_warc(spark, sf).toPandas()) == canonical(duck.sql(warc.OP7_SQL).df())


def test_warc_round_trip_with_revisits(spark):
    long, short = "é" * 900, "s" * 20
    rows = [(1, "http://a/ b\n", long), (2, None, long), (3, "http://c", short), (4, "http://d", short), (5, "http://e", None), (None, "http://f", "n" * 2000), (None, "http://g", long), (6, "u", "z" * 400_000), (6, "u", "z" * 400_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, records = warc.round_trip(frame, Stages(spark))
    out = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"] is None or bytes(r["payload"]).decode()) for r in records.collect())
    sha1 = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = Counter()
    for page, _, t in rows:
        revisit = t == long and page != 2
        want[page, "revisit" if revisit else "response", 2 if revisit else None, size(t), sha1(t), True if revisit else (t or "")] += 1
    assert out == want
    one = index.where("page_id = 3")
    assert [r["payload_digest"] for r in warc.read_warc(one).collect()] == [sha1(short)] and one.first()["url"] == "http://c"
    assert warc.round_trip(frame.limit(0), Stages(spark))[1].count() == 0


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 10 + warc.GAP_BYTES * 2, 5), ("b", 0, 1)]
    assert [len(g) for g in warc._ranges(rows)] == [2, 1, 1]
    assert list(itertools.chain(*warc._ranges(rows))) == rows
