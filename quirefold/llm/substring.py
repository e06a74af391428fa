"""Substring deduplication by seed and extend.

Seeds: every document is winnowed into anchors, hashes of SEED words, so dense that a run of LENGTH
words holds one, chosen by the run's words alone. Anchors are joined across documents; where one occurs in
several, it is extended both ways: each run of LENGTH words that chose the anchor gets a 128-bit hash,
and runs are joined on it. A run that also starts in a document with a smaller doc_id is a repeat;
overlapping repeats merge into maximal spans, which are removed.

Equal texts are settled before: a copy of at least LENGTH words is a repeat as a whole, and only the copy
with the smallest doc_id is compared with other texts. No pairs are formed, so a passage in n documents
costs n rows, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, read, small
from .kernels import WordHashes, batched, grams, inside, split_words, winnowed

LENGTH = 13
SEED = 5

#: Text bytes in an output batch, roughly.
BATCH_BYTES = 4 << 20

_SIGNED = np.int64


def _salt(d: np.ndarray) -> np.ndarray:
    """A value for each document of a batch that sets equal hashes of different documents apart."""
    with np.errstate(over="ignore"):
        return (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _runs(h: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, documents, anchors) of the runs of length words: where, in which document, the hash of the chosen anchor."""
    g = grams(h, seed)
    at = winnowed(g, length - seed + 1)
    starts = inside(ends, length, len(at))
    return starts, np.searchsorted(ends, starts, side="right"), g[at[starts]]


def _anchors(length: int, seed: int):
    known = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column("_q_doc").to_numpy(), batch.column("_q_row").to_numpy()
            texts = enumerate(t.as_py() for t in batch.column("text"))
            for keys, h, ends in batched(texts, known):
                _, d, a = _runs(h, ends, length, seed)
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])) if len(a) else np.zeros(0, np.int64)
                d, a = d[new], a[new]
                _, first = np.unique(a ^ _salt(d), return_index=True)  # one row for each anchor of a document
                own = np.array(keys, np.int64)[d[first]]
                yield pa.RecordBatch.from_arrays([pa.array(a[first].astype(_SIGNED)), pa.array(doc[own]), pa.array(row[own])], names=["anchor", "_q_doc", "_q_row"])

    return run


def _extended(length: int, seed: int):
    known = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, shared = batch.column("_q_doc").to_numpy(), batch.column("_q_row").to_numpy(), batch.column("anchors")
            texts = enumerate(t.as_py() for t in batch.column("text"))
            for keys, h, ends in batched(texts, known):
                starts, d, a = _runs(h, ends, length, seed)
                lists = [shared[k].values.to_numpy().astype(np.uint64) for k in keys]
                wanted = np.concatenate(lists) ^ _salt(np.repeat(np.arange(len(keys)), [len(x) for x in lists]))
                hit = np.isin(a ^ _salt(d), wanted)
                starts, d = starts[hit], d[hit]
                own, first = np.array(keys)[d], np.concatenate([[0], ends[:-1]])[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams(h, length)[starts].astype(_SIGNED)), pa.array(grams(h, length, True)[starts].astype(_SIGNED)), pa.array(doc[own]), pa.array(row[own]), pa.array((starts - first).astype(np.int32))],
                    names=["h1", "h2", "_q_doc", "_q_row", "at"],
                )

    return run


def spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal spans [from, to) covered by runs of length words at starts."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + length)
        else:
            out.append([s, s + length])
    return [(a, b) for a, b in out]


def _cut(schema: pa.Schema, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [k for k, n in enumerate(batch.schema.names) if n in schema.names]
            texts, starts, copy = batch.column("text"), batch.column("starts"), batch.column("whole")
            at = 0
            while at < batch.num_rows:
                begun, size, rows = at, 0, []
                while at < batch.num_rows and size < BATCH_BYTES:
                    words = split_words(texts[at].as_py())
                    found = [(0, len(words))] if copy[at].as_py() and len(words) >= length else spans(starts[at].as_py() or [], length)
                    kept, last = [], 0
                    for a, b in found:
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    text = b" ".join(kept).decode("utf-8", "surrogatepass")
                    rows.append((len(words), len(words) - len(kept), text, [{"start": a, "end": b} for a, b in found]))
                    size, at = size + len(text) + 64, at + 1
                part = batch.slice(begun, at - begun)
                made = [pa.array(v, schema.field(n).type) for v, n in zip(zip(*rows), ("n_words", "n_removed", "kept_text", "spans"))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in passed), *made], schema=schema)

    return run


def _repeats(docs: DataFrame, stages: Stages, length: int, seed: int) -> DataFrame:
    """(_q_doc, _q_row, starts, whole): the repeats of each document that has any; docs: _q_doc, _q_row, _q_key, text."""
    least = docs.groupBy("_q_key").agg(F.min("_q_doc").alias("_q_least"), F.max("_q_doc").alias("_q_most")).where("_q_least < _q_most")
    copies = docs.select("_q_key", "_q_doc", "_q_row").join(least, "_q_key").where("_q_doc > _q_least").select("_q_doc", "_q_row").distinct()
    copies = stages.keep(copies, "copies")
    single = docs.select("_q_doc", "_q_row", "text").join(small(copies, 32), ["_q_doc", "_q_row"], "left_anti")
    anchors = stages.keep(single.mapInArrow(_anchors(length, seed), "anchor long, _q_doc long, _q_row long"), "anchors")
    shared = stages.keep(anchors.groupBy("anchor").agg(F.min("_q_doc").alias("a"), F.max("_q_doc").alias("b")).where("a < b").select("anchor"), "shared")  # a table of its own, so the join with it can split a hot anchor
    seeds = anchors.join(shared, "anchor").groupBy("_q_doc", "_q_row").agg(F.collect_list("anchor").alias("anchors"))  # no more than the document's words
    seeds = stages.keep(seeds, "seeds")
    stages.drop("anchors", "shared")
    runs = docs.select("_q_doc", "_q_row", "text").join(seeds, ["_q_doc", "_q_row"])
    runs = stages.keep(runs.mapInArrow(_extended(length, seed), "h1 long, h2 long, _q_doc long, _q_row long, at int"), "runs")
    stages.drop("seeds")
    firsts = stages.keep(runs.groupBy("h1", "h2").agg(F.min("_q_doc").alias("a"), F.max("_q_doc").alias("b")).where("a < b").select("h1", "h2", "a"), "firsts")
    found = runs.join(firsts, ["h1", "h2"]).where("_q_doc > a").groupBy("_q_doc", "_q_row").agg(F.collect_set("at").alias("starts"))
    found = found.withColumn("whole", F.lit(False))
    whole = copies.select("_q_doc", "_q_row", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    out = stages.keep(found.unionByName(whole), "repeats")
    stages.drop("runs", "firsts", "copies")
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text and any others) with n_words, n_removed, kept_text and spans.

    spans: the maximal repeats as word positions [start, end); kept_text: the other words, joined by one
    space. Repeats are judged on the input. Null text has no words; a null doc_id counts as larger than
    all others. Rows that share a doc_id are not smaller than each other: repeats between them stay, and
    rows equal in doc_id and text are treated alike. A document under length words keeps all of them. Input columns of
    those four names are replaced; names that begin with "_q_" are reserved.
    """
    stages = Stages(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text", "spans")
    marked = docs.withColumns({
        "_q_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_q_row": F.xxhash64("doc_id", "text"), "_q_key": F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256),
    })
    repeats = _repeats(marked, stages, length, seed)
    joined = marked.drop("_q_key").join(repeats, ["_q_doc", "_q_row"], "left").drop("_q_doc", "_q_row")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", span)]
    schema = T.StructType([*docs.schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    return joined.select(*docs.columns, "starts", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(_cut(to_arrow_schema(schema), length), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, i, w[i:i + {LENGTH - 1}] AS run FROM d, unnest(generate_series(1, len(w) - {LENGTH - 1})) AS g(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS a FROM r),
c AS (SELECT DISTINCT doc_id, i + o AS pos FROM f, generate_series(0, {LENGTH - 1}) AS g(o) WHERE a < doc_id),
x AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda e, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
