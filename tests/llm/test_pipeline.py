from tokenizers import Tokenizer

import corpus_pipeline
from quirefold.llm import bpe
from tests.llm import brute


def test_pipeline_matches_brute_force(spark, sf, duck):
    rows = [(d, t) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() if brute.kept_quality(t)]
    classes = brute.classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    cut = brute.without_repeats(rows)
    rows = [(d, t if len(cut[d][0]) == len(cut[d][1]) else " ".join(cut[d][1])) for d, t in rows]
    bench = [t for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    flat = lambda t: " ".join(t.split())
    rows = [(d, t) for d, t in rows if not any(flat(b) in flat(t) for b in bench)]
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    want = {}
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t))
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_keep_columns_and_edges(spark, sf):
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (None, "x", "en", "s", 1), (1, "good " * 3, "en", "s", 3), (1, "good " * 3, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.near_dedup(spark, docs, sf).count() == 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]


def test_unlike_texts_under_one_id_stay(spark, sf):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "text A"), (1, "unlike text B"), (1, "text A"), (2, "text A"), (3, long), (4, long + " more"), (4, "quite another"), (None, "text A")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "text A"), (1, "unlike text B"), (3, long), (4, "quite another"), (None, "text A")], key=str)
