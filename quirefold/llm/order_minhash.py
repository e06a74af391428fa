"""Near-duplicates by Order MinHash and banded alignment.

A text's k-mers are runs of K words, labelled with their occurrence (first, second, ...). A sketch takes
the PICKED labelled k-mers with the smallest hashes under one of SKETCHES permutations and keeps them in
text order; equal sketches make two texts candidates, with a chance that falls with their edit
similarity. Candidates are verified by a banded alignment of their words: texts are near-duplicates if
their edit distance is at most (1 - SIMILARITY) of the longer one's words. Classes are the connected
components of these links.

Equal texts are one vertex. ROUNDS times each bucket compares one leader with one text of every other
component in it, first the most central text, then others: groups of copies join at once, for as many
pairs as the bucket has members. These rounds only save work. Afterwards every pair of a bucket that is
still in different components is settled:

- Buckets of up to DIRECT texts form their pairs.
- Texts of larger buckets are joined by an exact prefix filter instead, since such a bucket is mostly a
  passage that many unlike texts share. Texts within the distance share so many q-grams of words that the
  first ones of both, in any one order of all q-grams, must meet. The order puts the q-grams that are
  common among these texts last (counted on a fixed share of them, which bears on cost alone), so a text
  whose first q-grams are all rare meets few others, however long its passages' buckets are. Pairs of
  which neither text is so are tried with the next smaller q.
- What is left, texts made up almost wholly of common words, is compared block by block, with no row for a pair.
  These are texts of which about SIMILARITY is one passage; whether two are linked hangs on single words, and no
  bound that is cheaper than looking at the pair settles it. Only their number has a square in the cost.

Every pair so found is refuted by an exact bound (counts of words by hash) or aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, read, small
from .components import components
from .kernels import WordHashes, batched, grams, split_words

K = 5
SKETCHES = 160
PICKED = 2
SIMILARITY = 0.8

#: Sketches whose buckets are found at once.
TOGETHER = 32

#: Rounds that compare a bucket's texts with one leader, as long as this share of a round's pairs was aligned in vain.
ROUNDS, WORTH = 2, 0.1

#: Buckets of up to so many texts form their pairs at once.
DIRECT = 16

#: The sizes of q-grams of the prefix filter, in the order they are tried.
QGRAMS = (2, 1)

#: One text in SHARE is counted for the common q-grams; one counted COMMON times there is common. The most
#: common LISTED are known to every task; more would only save work.
SHARE, COMMON, LISTED = 4, 4, 1 << 18

#: Up to so many words the places of a word are one number as wide as the text; beyond, only what lies in the band is made one.
WHOLE_MASKS = 4096

#: Counters of a text's words by hash, and the members of a bucket's block.
BINS = 128
BLOCK, BLOCK_BYTES = 250, 4 << 20

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_OCCURRENCE = np.uint64(0x94D049BB133111EB)
_S = np.uint64(32)


def _scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit values."""
    y = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1B873593) & 0xFFFFFFFFFFFFFFFF)) * _MIX
    return (y ^ (y >> _S)) * _OCCURRENCE


def _seed(n: int) -> np.uint64:
    """The n-th of a fixed sequence of 64-bit values."""
    with np.errstate(over="ignore"):
        return _scrambled(np.array([n + 1], np.uint64), 5)[0]


def _labelled(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, bounds): occurrence-labelled k-mer hashes of each document; a shorter one is its own k-mer."""
    g, parts, bounds, start = grams(h, k), [], [0], 0
    for e in ends.tolist():
        own = g[start : e - k + 1] if e - start >= k else grams(h[start:e], e - start) if e > start else g[:0]
        if len(own) > 1:
            order = np.argsort(own, kind="stable")
            run = own[order]
            first = np.concatenate([[True], run[1:] != run[:-1]])
            if not first.all():
                at = np.arange(len(run))
                nth = at - np.maximum.accumulate(np.where(first, at, 0))
                own = own.copy()
                own[order] = run + nth.astype(np.uint64) * _OCCURRENCE
        parts.append(own)
        bounds.append(bounds[-1] + len(own))
        start = e
    return np.concatenate(parts) if parts else g[:0], np.array(bounds)


def sketches(h: np.ndarray, ends: np.ndarray, k: int = K, count: int = SKETCHES, picked: int = PICKED) -> tuple[np.ndarray, np.ndarray]:
    """(documents, keys): for each document with a word, count sketches of picked k-mers in text order."""
    with np.errstate(over="ignore"):
        labels, bounds = _labelled(h, ends, k)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts, sizes = bounds[:-1][full], sizes[full]
        out = np.empty((count, len(full)), np.uint64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        places_ = np.arange(len(labels), dtype=np.uint64)
        low = np.uint64((1 << max(len(labels) - 1, 1).bit_length()) - 1)  # the low bits hold the place, the others the hash
        y = np.empty(len(labels), np.uint64)
        for s in range(count):
            np.bitwise_xor(labels, _seed(2 * s), out=y)
            np.multiply(y, _seed(2 * s + 1) | np.uint64(1), out=y)
            np.bitwise_and(y, ~low, out=y)
            np.bitwise_or(y, places_, out=y)
            places = np.empty((picked, len(full)), np.int64)
            for p in range(picked):
                where = (np.minimum.reduceat(y, starts) & low).astype(np.int64)
                y[where[sizes > p]] = top
                places[p] = np.where(sizes > p, where, -1)  # fewer k-mers than picked
            places.sort(axis=0)
            key = np.full(len(full), np.uint64(s + 1))
            for row in places:
                key = _scrambled(key ^ np.where(row >= 0, labels[row], np.uint64(0)), s + 7)
            out[s] = key
    return np.tile(full, count), out.reshape(-1)


def _window(places: list[int], first: int, width: int) -> int:
    """A bit for each of the sorted places in [first, first + width). Never wider than the band, however long the texts."""
    at, end = bisect_left(places, first), bisect_left(places, first + width)
    if end - at < 8:
        out = 0
        for p in places[at:end]:
            out |= 1 << (p - first)
        return out
    bits = np.zeros(width, np.uint8)
    bits[np.array(places[at:end]) - first] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def edit_distance(a: list, b: list, band: int) -> int | None:
    """The edit distance of two sequences if it is at most band, else None; bit-parallel, within the band of diagonals."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[skip:], b[skip:]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > band:
        return None
    if not n:
        return m
    band = min(band, m)
    width = 2 * band + 1
    full = (1 << width) - 1
    narrow = m <= WHOLE_MASKS
    places: dict = {}
    for i, x in enumerate(a):
        if narrow:
            places[x] = places.get(x, 0) | 1 << i
        else:
            places.setdefault(x, []).append(i)
    vp, vn, now = full >> band << band, 0, band
    low, side = 1 << (width - 1), 1 << width >> 2
    most = band + n - (m - band)  # beyond, the last column cannot come back into the band
    for i, x in enumerate(b):
        if narrow:
            eq = places.get(x, 0)
            eq = (eq >> (i - band) if i >= band else eq << (band - i)) & full
        else:
            eq = _window(places.get(x, ()), i - band, width)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if i < m - band:
            now += not d0 & low
        else:
            now += bool(hp & side) - bool(hn & side)
            side >>= 1
        if now > most:
            return None
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return now if now <= band else None


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer sequence; empty ones equal each other only."""
    size = max(len(a), len(b))
    band = int((1 - similarity) * size + 1e-9)
    if size - min(len(a), len(b)) > band:
        return False
    if a == b:
        return True
    if size - sum((Counter(a) & Counter(b)).values()) > band:  # a bound from below
        return False
    return edit_distance(a, b, band) is not None


def _sketched(k: int, count: int, picked: int):
    known = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vertex").to_numpy()
            for keys, h, ends in batched(enumerate(t.as_py() for t in batch.column("text")), known):
                docs, found = sketches(h, ends, k, count, picked)
                n = len(docs) // count
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * count), pa.array(np.ascontiguousarray(found.reshape(count, n).T).astype(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(keys)[docs[:n]]] if n else ids[:0]), rows], names=["vertex", "keys"])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            found = []
            for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("text_u"), batch.column("text_v")):
                if u != last:
                    last, words = u, split_words(a.as_py())
                if similar(words, split_words(b.as_py()), similarity):
                    found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, text) as (vertex, size, bins): the number of words, and of words in each of BINS classes, 255 at most."""
    known = WordHashes()
    for batch in batches:
        sizes, bins = [], []
        for t in batch.column("text"):
            h = np.fromiter(map(known.__getitem__, split_words(t.as_py())), np.uint64)
            sizes.append(len(h))
            bins.append(np.minimum(np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary())], names=["vertex", "size", "bins"])


def _possible(similarity: float):
    """Keeps the pairs that the counters do not refute: an edit adds at most one word to a text and takes at most one away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("bins_u", "bins_v"))
            size = np.maximum(batch.column("size_u").to_numpy(), batch.column("size_v").to_numpy())
            least = np.maximum(np.maximum(a - b, 0).sum(axis=1), np.maximum(b - a, 0).sum(axis=1))
            yield batch.select(["u", "v"]).filter(pa.array(least <= ((1 - similarity) * size + 1e-9).astype(np.int64)))

    return run


def _qgrams(h: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the occurrence-labelled q-grams of each document, apart for each q."""
    values, bounds = _labelled(h, ends, q)
    return values ^ np.uint64(q), bounds


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): in how many texts of a batch each q-gram occurs."""
    known = WordHashes()
    for batch in batches:
        for _, h, ends in batched(enumerate(t.as_py() for t in batch.column("text")), known):
            for q in QGRAMS:
                grams_, n = np.unique(_qgrams(h, ends, q)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams_.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _prefixed(q: int, similarity: float, common: Broadcast):
    """(vertex, root, size, sure, grams): the rare ones of a text's first q-grams; sure: all of them are rare.

    With a the words of the longer text, two near-duplicates share a - q + 1 - q * (1 - similarity) * a q-grams
    at least, no less than the same for the words of either text; so of n q-grams the first n - that + 1 of both share one.
    """
    known = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = common.value
        for batch in batches:
            for keys, h, ends in batched(enumerate(t.as_py() for t in batch.column("text")), known):
                values, bounds = _qgrams(h, ends, q)
                sizes = np.diff(np.concatenate([[0], ends]))
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
                    often = np.where(listed[at] == values, counts[at], 0)
                else:
                    often = np.zeros(len(values), np.int64)
                out, sure = [], []
                for a, b, size in zip(bounds, bounds[1:], sizes):
                    need = max(1, int(np.ceil((1 - q * (1 - similarity)) * size - q + 1 - 1e-6)))
                    first = np.lexsort((values[a:b], often[a:b]))[: max(b - a - need + 1, 0)]
                    rare = often[a:b][first] == 0
                    out.append(values[a:b][first][rare].astype(np.int64))
                    sure.append(bool(rare.all()))
                at = pa.array(keys, pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("vertex").take(at), batch.column("root").take(at), pa.array(sizes, pa.int32()), pa.array(sure), lists], names=["vertex", "root", "size", "sure", "grams"])

    return run


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("vertex"))
    return members.join(small(roots.withColumnRenamed("id", "vertex"), 32), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    return pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")


def _met(left: DataFrame, right: DataFrame, on: list[str], similarity: float, more: str) -> DataFrame:
    """(u, v), u < v, not distinct: the pairs of left and right (vertex, root, size and on) in different components whose sizes allow the distance."""
    named = lambda df, x: df.select(*on, *[F.col(c).alias(c + x) for c in df.columns if c not in on])
    longer, shorter = F.greatest("size_u", "size_v"), F.least("size_u", "size_v")
    fits = (F.col("root_u") != F.col("root_v")) & (longer - shorter <= F.floor(F.lit(1 - similarity) * longer + 1e-9))
    both = named(left, "_u").join(named(right, "_v"), on).where(fits & F.expr(more))
    return both.select(F.least("vertex_u", "vertex_v").alias("u"), F.greatest("vertex_u", "vertex_v").alias("v"))


def _overlaps(texts: list[list[bytes]]):
    """i -> how many words, each as often as it occurs in both, text i has in common with each of the texts."""
    number: dict = {}
    rows, columns = [], []
    for i, words in enumerate(texts):
        for word, n in Counter(words).items():
            for k in range(n):
                rows.append(i)
                columns.append(number.setdefault((word, k), len(number)))
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    held = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])

    def of(i: int) -> np.ndarray:
        own = np.zeros(len(number), bool)
        own[columns[held[i] : held[i + 1]]] = True
        return np.bincount(rows[own[columns]], minlength=len(texts))

    return of


def _compared(similarity: float):
    """The links (u, v) between block a and block b of a group, a spanning forest of those found; blocks are bounded in texts and bytes."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [split_words(r["text"]) for r in rows]
        sizes = np.array([len(w) for w in words])
        shared = _overlaps(words)
        alone = rows[0]["a"] == rows[0]["b"]
        left, right = ([i for i, r in enumerate(rows) if r["own"] == r[side]] for side in ("a", "b"))
        up = {r["root"]: r["root"] for r in rows}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found, theirs = [], np.array(right, np.int64)
        for n, i in enumerate(left):
            others = theirs[n + 1 :] if alone else theirs
            longer = np.maximum(sizes[others], sizes[i])
            most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            others = others[longer - np.minimum(shared(i)[others], sizes[i]) <= most]  # an edit adds at most one word and takes at most one away
            for j in others.tolist():
                x, y = find(rows[i]["root"]), find(rows[j]["root"])
                if x != y and edit_distance(words[i], words[j], int((1 - similarity) * max(sizes[i], sizes[j]) + 1e-9)) is not None:
                    up[x] = y
                    found.append((rows[i]["vertex"], rows[j]["vertex"]))
        return pa.table({"u": pa.array([min(x) for x in found], pa.int64()), "v": pa.array([max(x) for x in found], pa.int64())})

    return run


def _in_blocks(at: DataFrame, own: DataFrame, stages: Stages, similarity: float, block: int) -> DataFrame:
    """Links (u, v) among at (key, vertex, root): texts that a chain of shared buckets joins are a group, split into blocks
    of about so many texts or BLOCK_BYTES; each pair of blocks is compared once."""
    first = at.groupBy("key").agg(F.min("vertex").alias("v"))
    groups = components(at.join(first, "key").where("vertex <> v").select(F.col("vertex").alias("u"), "v").distinct(), stages, "group-")
    texts = at.select("vertex", "root").distinct().join(groups.toDF("vertex", "group"), "vertex", "left").withColumn("group", F.coalesce("group", "vertex")).join(own, "vertex")
    texts = stages.keep(texts, "group-texts")
    wide = texts.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    wide = wide.select("group", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    texts = texts.join(wide, "group").withColumn("own", F.expr("pmod(xxhash64(vertex), blocks)"))
    pairs = F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, own) AS a, greatest(x, own) AS b))")
    dealt = texts.select("group", "vertex", "root", "text", "own", F.explode(pairs).alias("p")).select("group", "p.a", "p.b", "vertex", "root", "text", "own")
    return stages.keep(dealt.groupBy("group", "a", "b").applyInArrow(_compared(similarity), "u long, v long"), "links-blocks")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(q-grams, counts) of the most common q-grams, sorted; LISTED at most."""
    tallied = texts.where(F.expr(f"pmod(xxhash64(vertex), {SHARE}) = 0")).select("text").mapInArrow(_tallied, "gram long, n long")
    found = tallied.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(LISTED).toArrow()
    grams_ = found.column("gram").to_numpy().astype(np.uint64)
    order = np.argsort(grams_)
    return grams_[order], found.column("n").to_numpy()[order]


def _remaining(members: DataFrame, own: DataFrame, counted: DataFrame, roots: DataFrame | None, stages: Stages, similarity: float, block: int, direct: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, links), both (u, v): the pairs of different components that share a bucket and can be near-duplicates, others
    among them, and links that were found already in place of such pairs."""
    vertices = _rooted(counted.select("vertex", "size"), roots)
    at = _rooted(members.select("key", "vertex"), roots)
    mixed = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "n")
    mixed = stages.keep(mixed, "mixed")
    open_ = stages.keep(members.select("key", "vertex").join(mixed.where(F.col("n") > direct), "key").select("vertex").distinct(), "open")
    pairs, rest = None, open_.limit(0)
    if not open_.isEmpty():
        texts = stages.keep(own.join(small(open_, 16), "vertex").join(small(vertices.select("vertex", "root"), 32), "vertex"), "open-texts")
        common = texts.sparkSession.sparkContext.broadcast(_common(texts))
        for q in QGRAMS:
            first = stages.keep(texts.mapInArrow(_prefixed(q, similarity, common), "vertex long, root long, size int, sure boolean, grams array<long>"), f"prefixes{q}")
            grams_ = first.select("vertex", "root", "size", "sure", F.explode("grams").alias("gram"))
            shared = grams_.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
            grams_ = stages.keep(grams_.join(shared, "gram"), f"grams{q}")
            found = stages.keep(_met(grams_, grams_, ["gram"], similarity, "vertex_u < vertex_v AND (sure_u OR sure_v)").distinct(), f"met{q}")
            pairs = found if pairs is None else pairs.union(found)
            rest = first.where("NOT sure").select("vertex")
            if rest.isEmpty():
                break
            texts = texts.join(small(rest, 16), "vertex", "left_semi")
    vertices = vertices.join(small(rest.withColumn("rest", F.lit(True)), 16), "vertex", "left")
    at = stages.keep(members.select("key", "vertex").join(mixed, "key").join(vertices, "vertex"), "at")
    few = at.where(F.col("n") <= direct).select("key", "vertex", "root", "size")
    near = stages.keep(_met(few, few, ["key"], similarity, "vertex_u < vertex_v").distinct(), "met-direct")
    pairs = (near if pairs is None else pairs.union(near)).distinct()
    many = at.where((F.col("n") > direct) & F.col("rest")).select("key", "vertex", "root")
    return pairs, None if many.isEmpty() else _in_blocks(many, own, stages, similarity, block)


def _links(texts: DataFrame, stages: Stages, k: int, count: int, picked: int, similarity: float, block: int, direct: int) -> DataFrame:
    """(id, root) of the classes among texts (vertex, text), without the roots."""
    sketched = stages.keep(texts.mapInArrow(_sketched(k, count, picked), "vertex long, keys array<long>"), "sketches")
    members = None
    for first in range(0, count, TOGETHER):
        every = sketched.select(F.explode(F.slice("keys", first + 1, TOGETHER)).alias("key"), "vertex")
        live = stages.keep(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "live")
        some = stages.keep(every.join(live, "key").distinct(), f"members{first}")
        members = some if members is None else members.union(some)
    central = members.groupBy("vertex").agg(F.sum("n").alias("rank"))
    members = stages.keep(members.join(central, "vertex").select("key", "vertex", "rank"), "ranked")
    stages.drop("sketches", "live", *[f"members{first}" for first in range(0, count, TOGETHER)])
    own = stages.keep(texts.join(small(members.select("vertex").distinct(), 16), "vertex", "left_semi"), "texts")
    counted = stages.keep(own.mapInArrow(_counted, "vertex long, size int, bins binary"), "counted")
    bins = lambda x: counted.toDF(x, f"size_{x}", f"bins_{x}")
    text = lambda x: own.toDF(x, f"text_{x}")

    def verified(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(the pairs that were aligned, the links among them)."""
        possible = stages.keep(pairs.join(bins("u"), "u").join(bins("v"), "v").mapInArrow(_possible(similarity), "u long, v long"), f"possible-{name}")
        return possible, stages.keep(possible.join(text("u"), "u").join(text("v"), "v").mapInArrow(_verified(similarity), "u long, v long"), f"links-{name}")

    roots, edges, tried = None, None, None
    for n in range(ROUNDS):
        at = _rooted(members, roots)
        order = F.struct("rank", (-F.col("vertex")).alias("v")) if n == 0 else F.struct(F.xxhash64("root", F.lit(n)).alias("rank"), (-F.col("vertex")).alias("v"))
        reps = at.groupBy("key", "root").agg(F.max(order).alias("b"))
        leaders = reps.groupBy("key").agg(F.max("b").alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (-F.col("l.v")).alias("leader"))
        reps = stages.keep(reps.select("key", (-F.col("b.v")).alias("vertex")), f"reps{n}") if n == 0 else reps.select("key", (-F.col("b.v")).alias("vertex"))
        pairs = reps.join(stages.keep(leaders, f"leaders{n}"), "key").where("vertex <> leader").select(F.least("leader", "vertex").alias("u"), F.greatest("leader", "vertex").alias("v")).distinct()
        pairs = stages.keep(_untried(pairs, tried), f"pairs{n}")
        tested, links = verified(pairs, f"round{n}")
        tried = pairs if tried is None else tried.union(pairs)
        found = links.count()
        if found:
            edges = links if edges is None else edges.union(links)
            roots = components(edges, stages, f"components{n}-")
        if tested.count() - found < WORTH * pairs.count():
            break
    left, more = _remaining(members, own, counted, roots, stages, similarity, block, direct)
    links = verified(_untried(left, tried), "last")[1]
    links = links if more is None else links.union(more)
    if not links.isEmpty():
        edges = links if edges is None else edges.union(links)
        roots = components(edges, stages, "last-components-")
    if roots is None:
        return members.select(F.col("vertex").alias("id"), F.col("vertex").alias("root")).limit(0)
    return roots


def near_duplicates(docs: DataFrame, k: int = K, count: int = SKETCHES, picked: int = PICKED, similarity: float = SIMILARITY, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """docs (doc_id, text and any others) with class_id: the smallest doc_id of the row's class of near-duplicates.

    Equal texts share a class, null and empty texts among them. Texts that differ are candidates only if
    they share k-mers, so different texts of under k words are apart. Rows with a null doc_id get no
    class_id and are not compared. Repeated rows get the same class. An input column class_id is replaced; names with "_q_" are reserved.
    """
    stages = Stages(docs.sparkSession)
    marked = docs.drop("class_id").withColumn("_q_key", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    equal = marked.where("doc_id IS NOT NULL").groupBy("_q_key").agg(F.min("doc_id").alias("_q_least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = stages.keep(equal, "equal")
    based = marked.join(small(equal, 120), "_q_key", "left").withColumn("_q_vertex", F.when(F.col("doc_id").isNotNull(), F.coalesce("_q_least", "doc_id").cast("long"))).drop("_q_key", "_q_least")
    texts = based.where("_q_vertex = doc_id AND text IS NOT NULL").select(F.col("_q_vertex").alias("vertex"), "text")
    roots = _links(texts, stages, k, count, picked, similarity, block, direct)
    roots = roots.select(F.col("id").alias("_q_vertex"), F.col("root").alias("_q_root"))
    out = based.join(small(roots, 32), "_q_vertex", "left")
    return out.withColumn("class_id", F.coalesce("_q_root", "_q_vertex")).drop("_q_root", "_q_vertex")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id")
