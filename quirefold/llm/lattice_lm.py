"""Language-model scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary are the events of a unigram model. Their scores in the vocabulary
file (ranks) give a first distribution; expectation maximisation over the word counts of all training
documents turns it into piece probabilities. A word's probability is the sum over all its segmentations,
by forward recursion in log space; pieces do not cross words, so a text's log probability is the sum over
its words and the end. A character is also reachable by its byte pieces, so every text has a probability.

Documents are packed into blocks with a local vocabulary. Only distinct words of blocks are shuffled:
to be counted, and to bring each block the counts and probabilities of its own words. Nothing that
grows with the corpus is broadcast; the piece table is as large as the vocabulary.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, read

#: Text bytes in a block.
BLOCK_BYTES = 16 << 20

#: Passes of expectation maximisation.
PASSES = 2

#: Pseudo-counts that the first distribution keeps, and the shift of its ranks.
PRIOR, RANK_SHIFT = 1000.0, 10.0

#: Additive smoothing of the base score.
ADDED = 0.1

#: Words that go through the lattice at once.
CHUNK = 8192

_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LN10 = float(np.log(10.0))


def held_out(doc_id: int | None) -> bool:
    """Whether a document is left out of training; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Pieces:
    """The pieces of a vocabulary, their first distribution and an index of their prefixes; picklable."""

    def __init__(self, ranked: list[tuple[str, float]], byte_ranks: list[float]):
        """ranked: (piece, rank) without duplicates; byte_ranks: the rank of each byte's piece. Bytes come last."""
        self.texts, self.n = [t for t, _ in ranked], len(ranked) + 256
        weights = 1.0 / (np.array([r for _, r in ranked] + byte_ranks) + RANK_SHIFT)
        self.first = weights / weights.sum()
        found: dict[int, int] = {}
        for k, t in enumerate(self.texts):
            h = 0
            for at, c in enumerate(t):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                found.setdefault(h, -1)
                if at == len(t) - 1:
                    found[h] = k
        self.keys = np.array(sorted(found), np.uint64)
        self.at = np.array([found[int(h)] for h in self.keys], np.int64)
        self.longest = max((len(t) for t in self.texts), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked, last = [], float(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranked.append((sp.id_to_piece(i), -float(sp.get_score(i))))
        return cls(ranked, [last] * 256)


class Lattice:
    """The forward and backward recursions under one distribution over pieces."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces = pieces
        with np.errstate(divide="ignore"):
            self.logp = np.log(p)
        b = self.logp[-256:]
        cp = np.arange(0x110000)
        tail = lambda k: b[0x80 | (cp >> (6 * k)) & 0x3F]
        self.by_bytes = np.select(
            [cp < 0x80, cp < 0x800, cp < 0x10000],
            [b[cp & 0x7F], b[(0xC0 | cp >> 6) & 0xFF] + tail(0), b[(0xE0 | cp >> 12) & 0xFF] + tail(1) + tail(0)],
            b[(0xF0 | cp >> 18) & 0xFF] + tail(2) + tail(1) + tail(0),
        )

    def _edges(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray | None, np.ndarray]]:
        """(from, to, rows, pieces, log probability) of the lattices of words x; rows None: all, by bytes."""
        keys, at, size = self.pieces.keys, self.pieces.at, x.shape[1]
        for i in range(size):
            yield i, i + 1, None, None, self.by_bytes[x[:, i]]
            rows, h = np.arange(len(x)), np.zeros(len(x), np.uint64)
            for j in range(i, min(size, i + self.pieces.longest)):
                h = h * _BASE + x[rows, j].astype(np.uint64) + np.uint64(1)
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                live = keys[k] == h
                rows, h, k = rows[live], h[live], at[k[live]]
                if not len(rows):
                    break
                whole = k >= 0
                yield i, j + 1, rows[whole], k[whole], self.logp[k[whole]]

    def _forward(self, x: np.ndarray, edges) -> list[np.ndarray]:
        alpha = [np.full(len(x), 0.0 if i == 0 else -np.inf) for i in range(x.shape[1] + 1)]
        for i, j, rows, _, lp in edges:
            if rows is None:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + lp)
            elif len(rows):
                alpha[j][rows] = np.logaddexp(alpha[j][rows], alpha[i][rows] + lp)
        return alpha

    def _chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in words, code points with the start mark) of words of one length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            size = int(sizes[group[0]])
            step = max(1, min(CHUNK, (CHUNK * 32) // (size + 1)))
            for s in range(0, len(group), step):
                part = group[s : s + step]
                data = "".join(_START + words[k] for k in part).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(data, np.uint32).reshape(len(part), size + 1).astype(np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """The natural log probability of each word, all segmentations summed."""
        out = np.zeros(len(words))
        with np.errstate(over="ignore"):
            for part, x in self._chunks(words):
                out[part] = self._forward(x, self._edges(x))[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur counts times."""
        total, by_char = np.zeros(self.pieces.n), defaultdict(float)
        with np.errstate(over="ignore"):
            for part, x in self._chunks(words):
                edges = list(self._edges(x))
                alpha = self._forward(x, edges)
                z, w = alpha[-1], counts[part]
                beta = [np.full(len(x), -np.inf) for _ in range(x.shape[1])] + [np.zeros(len(x))]
                for i, j, rows, k, lp in reversed(edges):
                    if rows is None:
                        through = lp + beta[j]
                        beta[i] = np.logaddexp(beta[i], through)
                        share = np.exp(alpha[i] + through - z) * w
                        chars, where = np.unique(x[:, i], return_inverse=True)
                        for c, v in zip(chars.tolist(), np.bincount(where, share).tolist()):
                            by_char[c] += v
                    elif len(rows):
                        through = lp + beta[j][rows]
                        beta[i][rows] = np.logaddexp(beta[i][rows], through)
                        total += np.bincount(k, np.exp(alpha[i][rows] + through - z[rows]) * w[rows], len(total))
        for c, v in by_char.items():
            for byte in chr(c).encode("utf-8", "surrogatepass"):
                total[len(self.pieces.texts) + byte] += v
        return total


BLOCK = "block string, words array<string>, counts array<bigint>, doc_ids array<bigint>, ends array<int>, ids binary, n_train bigint"
_LIST, _TEXT = pa.list_(pa.int64()), pa.list_(pa.string())


def _tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as blocks: distinct words with their training counts, and each document as word numbers."""

    def block(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts = [array("i", map(number.__getitem__, t)) for t in texts]
        train = [p for d, p in zip(doc_ids, parts) if not held_out(d)]
        counts = np.bincount(np.frombuffer(b"".join(train), np.int32), minlength=len(number))
        ids = zstandard.compress(b"".join(parts), 1)
        row = [[uuid.uuid4().hex], [[w.decode("utf-8", "surrogatepass") for w in number]], [counts.tolist()], [doc_ids], [np.cumsum([len(p) for p in parts]).tolist()], [ids], [len(train)]]
        kinds = [pa.string(), _TEXT, _LIST, _LIST, pa.list_(pa.int32()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = t.as_py()
                doc_ids.append(d)
                texts.append(_tokens(t))
                size += len(t or "") + 16
                if size >= block_bytes:
                    yield block(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
        if doc_ids:
            yield block(doc_ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


def train(lexicon: DataFrame, pieces: Pieces, n_train: int, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(probability of each piece, of the end) after passes over lexicon (word, c); they sum to 1. Without passes the
    vocabulary's own scores stay the pieces' distribution, and one pass only counts pieces for the end."""
    spark = lexicon.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    p, total = pieces.first, 0.0
    for _ in range(max(passes, 1)):
        now = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, found = Lattice(shared.value, now.value), np.zeros(shared.value.n)
            for batch in batches:
                found += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], names=["piece", "n"])

        rows = lexicon.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
        counts = np.zeros(pieces.n)
        for r in rows:
            counts[r["piece"]] = r["n"]
        total = float(counts.sum())
        if passes:
            p = (counts + PRIOR * pieces.first) / (total + PRIOR)
    end = (n_train + 1.0) / (total + n_train + 2.0)
    return p * (1.0 - end), end


def score_documents(docs: DataFrame, vocabulary: str, passes: int = PASSES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end as their only token. Repeated rows count and are scored each. A
    null doc_id is held out. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    blocks = stages.keep(pack(docs, block_bytes), "blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    lexicon = stages.keep(entries.groupBy("word").agg(F.sum("n").alias("c")), "lexicon")
    n_train = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    tokens, distinct = lexicon.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = tokens + n_train, distinct + (n_train > 0)
    pieces = Pieces.load(vocabulary)
    p, end = train(lexicon, pieces, n_train, passes)
    shared = spark.sparkContext.broadcast((pieces, p))
    scale = tokens + ADDED * (distinct + 1)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(*shared.value)
        for batch in batches:
            found = model.score(batch.column("word").to_pylist()) / _LN10
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found)], names=["word", "c", "lp"])

    scored = stages.keep(lexicon.mapInArrow(lattice, "word string, c long, lp double"), "scored")
    values = entries.select("block", "at", "word").join(scored, "word").select(F.col("block").alias("to"), "at", "c", "lp")

    def finish(own: pa.Table, theirs: pa.Table) -> pa.Table:
        c, lp = np.zeros(theirs.num_rows, np.int64), np.zeros(theirs.num_rows)
        at = theirs.column("at").to_numpy()
        c[at], lp[at] = theirs.column("c").to_numpy(), theirs.column("lp").to_numpy()
        base = np.log10((c + ADDED) / scale)
        out = []
        for row in own.to_pylist():
            ids = np.frombuffer(zstandard.decompress(row["ids"]), np.int32)
            ends = np.array([0, *row["ends"]])
            n = np.diff(ends)
            sums = lambda v, ends=ends, ids=ids: np.array([v[ids[a:b]].sum() for a, b in zip(ends, ends[1:])])
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([held_out(d) for d in row["doc_ids"]]), "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(sums((c > 0).astype(np.int64)) + int(n_train > 0), pa.int64()), "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
                "base_score": pa.array(sums(base) + np.log10((n_train + ADDED) / scale), pa.float64()), "score": pa.array(sums(lp) + np.log10(end), pa.float64()),
            }))
        return pa.concat_tables(out) if out else pa.table({k: [] for k in RESULT_NAMES})

    packed = spark.read.schema(blocks.schema).parquet(stages.path("blocks")).select("block", "doc_ids", "ends", "ids")
    return packed.groupBy("block").cogroup(values.groupBy("to")).applyInArrow(finish, RESULT)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), vocabulary_path())
