"""Byte-level BPE encoding and decoding with a contiguous rank array.

Texts are split at special tokens and by the pretokenizer's pattern. A short piece is a list of parts and,
beside it, the ranks of its adjacent pairs: scan for the smallest rank, join the two parts, refresh the
ranks to the left and right, until no pair has a rank. Long pieces take a heap of pairs instead of the scan,
with the same result. Pieces repeat, so each worker remembers a bounded number of them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read

#: Fixed value: the pretokenizer's pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Parts from which a piece goes through the heap.
LONG = 200

#: Pieces that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 200_000

#: Text bytes in an output batch, roughly.
BATCH_BYTES = 4 << 20

_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Encoder and decoder for one vocabulary; picklable."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: raw(s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        single = {raw(s): i for s, i in vocab.items() if len(s) == 1}
        self.single = [single[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = k
            self.joined.append(vocab[left + right])
        self.ready = False

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def prepare(self) -> Codec:
        if not self.ready:
            self.pieces = regex.compile(PATTERN).findall
            self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
            self.known: dict[str, bytes] = {}
            self.ready = True
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "cut", "known")} | {"ready": False}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.single[b] for b in piece]
        if len(ids) >= LONG:
            return self._merge_long(ids)
        rank, joined = self.rank.get, self.joined
        ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = joined[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the parts has changed
            ids[i], ids[j] = self.joined[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (s := rank((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (s, p, ids[p], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        self.prepare()
        known, out = self.known, []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for piece in self.pieces(part):
                got = known.get(piece)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    got = known[piece] = b"".join(i.to_bytes(4, "little") for i in self.merge(piece.encode()))
                out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> and decoded string, the text decoded from ids; vocabulary: path of a tokenizer file.

    Null text counts as empty and gives no ids and an empty string. Rows are kept one for one, in any
    order; other columns pass unchanged, but for input columns called ids or decoded, which are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Codec.load(vocabulary))  # as large as the vocabulary
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            column, start = batch.column(text), 0
            while start < batch.num_rows:
                ids, ends, decoded, size, at = [], [0], [], 0, start
                while at < batch.num_rows and size < BATCH_BYTES:
                    t = column[at].as_py() or ""
                    got = codec.encode_bytes(t)
                    ids.append(got)
                    ends.append(ends[-1] + len(got) // 4)
                    decoded.append(codec.decode(memoryview(got).cast("i").tolist()))
                    size, at = size + len(t) + 16, at + 1
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*part.schema.names, "ids", "decoded"])
                start = at

    return docs.mapInArrow(run, schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs, vocabulary_path()).drop("text"))
