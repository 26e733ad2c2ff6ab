"""Exact set-similarity joins inside regions of a metric space.

Jaccard distance ``d = 1 - J`` is a metric.  A region is a group of texts around a pivot; the
texts' sets are shipped to the region once, and all pairs with ``d <= eps`` inside it are found
exactly:

* a region above ``LEAF`` texts is split by a pivot ``p`` at a radius ``b`` into an inner part
  ``d(x, p) <= b + eps/2`` and an outer part ``d(x, p) >= b - eps/2``.  By the triangle
  inequality both ends of a pair within ``eps`` lie in the inner part or both in the outer
  part, so only the window of width ``eps`` around the boundary is replicated.  Parts are
  split again until they are small or a split no longer shrinks them;
* leaves are joined by counting common pieces: all (piece, text) incidences of many leaves are
  sorted at once, and equal pieces count for every pair of their texts.

How texts reach regions is told in ``routed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.textsets import band_keys, mix64, normalise, piece_hashes
from sievework.session import written

LEAF = 96
#: Pieces of up to this many texts of a leaf are counted pair by pair, others by matrices of WIDTH columns.
RARE, WIDTH = 8, 4096
#: Regions above this many texts are spread over block pairs, so that no task gets more.
BLOCK = 1024
#: Characters of the regions that are joined together: their arrays stay in the cache.
TOGETHER = 80_000
DICTIONARY_TEXTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 1500, 4000, 110_000


# ---------------------------------------------------------------- texts


def _dictionary(texts: DataFrame) -> bytes:
    """A compression dictionary from at most 1500 texts of up to 4000 characters; b'' for few texts.

    It only makes shuffled texts smaller; results don't depend on it.
    """
    rows = texts.where(F.length("text").between(1, DICTIONARY_CHARS)).select("text").limit(DICTIONARY_TEXTS).collect()
    samples = [normalise(r[0]).encode() for r in rows]
    if len(samples) < 200:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def packed_texts(texts: DataFrame, prepare=None) -> tuple[DataFrame, bytes]:
    """``(id, side, text)`` to a written table ``(id, side, k, z)`` and the codec's dictionary.

    ``k`` is the 64-bit content hash of the normalised text, the identity of a distinct text; ``z``
    is the compressed normalised text, once per batch and distinct text, else null.  Rows without a
    set (null text, no letter or digit) are left out.  ``prepare`` cuts the text to be measured
    out of the whole text.
    """
    dictionary = _dictionary(texts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _codec(dictionary)[0].compress
        for batch in batches:
            ids, sides, keys, packed, seen = [], [], [], [], set()
            for i, side, text in zip(*(batch.column(c).to_pylist() for c in ("id", "side", "text"))):
                text = normalise(prepare(text) if prepare and text is not None else text)
                if not text:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                key = xxhash.xxh3_64_intdigest(raw)
                ids.append(i)
                sides.append(side)
                keys.append(key - (1 << 64) if key >= 1 << 63 else key)
                packed.append(None if key in seen else compress(raw))
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sides, pa.int32()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())],
                names=["id", "side", "k", "z"],
            )

    packed = texts.select("id", "side", "text").mapInArrow(pack, "id bigint, side int, k bigint, z binary")
    return written(packed, "packed"), dictionary


# ---------------------------------------------------------------- routing


def routed(packed: DataFrame, dictionary: bytes, bands: int, rows: int, cross: bool) -> DataFrame:
    """Which distinct text goes to which region: ``(region, k)``.

    Texts meet in the buckets of banded minwise signatures.  The pivot of a bucket is its text
    with the smallest key; the region of a pivot takes the texts of all its buckets, so a text is
    replicated to every pivot it shares a bucket with.  A pair of similarity ``s`` is missed with
    probability ``(1 - s**rows)**bands`` and then only.  With ``cross`` a bucket counts only if it
    holds texts of side 1 and of side 2.  A bucket is streamed in key order, never collected.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(dictionary)[1].decompress
        for batch in batches:
            zs = batch.column("z").to_pylist()
            for lo in range(0, len(zs), 2000):
                texts = [unpack(z).decode("utf-8", "surrogatepass") for z in zs[lo : lo + 2000]]
                keys = band_keys(texts, bands, rows).view(np.int64)
                k = np.repeat(batch.column("k").slice(lo, 2000).to_numpy(), bands)
                side = np.repeat(batch.column("side").slice(lo, 2000).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(k), pa.array(side)], names=["bucket", "k", "side"])

    if cross:
        # a text's sides are those of all its rows, also of rows whose copy carries the text
        sides = packed.groupBy("k").agg(F.bit_or("side").alias("side"))
        source = packed.where("z IS NOT NULL").select("k", "z").join(sides, "k").select("k", "side", "z")
    else:
        source = packed.where("z IS NOT NULL").select("k", F.lit(0).alias("side"), "z")
    signed = source.mapInArrow(sign, "bucket bigint, k bigint, side int")
    w = Window.partitionBy("bucket").orderBy("k")
    signed = signed.withColumn("region", F.first("k").over(w))
    if cross:
        whole = Window.partitionBy("bucket")
        signed = signed.withColumn("sides", F.bit_or("side").over(whole)).where("sides = 3")
    members = written(signed.where("region <> k").select("region", "k").distinct(), "members")  # read four times
    return members.union(members.select("region", F.col("region").alias("k")).distinct())


def spread(members: DataFrame) -> DataFrame:
    """``(region, k)`` with the block pairs of large regions: ``(region, a, b, part, k)``.

    A region of at most ``BLOCK`` texts is one block.  A larger one is cut into ``g`` parts by the
    texts' keys and joined as the pairs ``(a, b)`` of parts; each text goes to ``g`` of them.
    """
    sizes = members.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    large = sizes.where("g > 1")
    one = members.join(large, "region", "left")
    part = F.when(F.col("g").isNull(), 0).otherwise(F.pmod(F.xxhash64("k"), F.col("g")).cast("int"))
    return (
        one.withColumn("part", part)
        .withColumn("other", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))))
        .select("region", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "k")
    )


# ---------------------------------------------------------------- the join inside regions


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _leaf_pairs(tokens: np.ndarray, owner: np.ndarray, leaf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of the same leaf with their number of common pieces.

    tokens/owner: pieces and the slot they belong to; leaf: a slot's leaf number; sizes: slots per
    leaf (slots are ordered by leaf).  44 bits of the piece, salted with its leaf, and 20 bits of
    the slot are sorted as one integer; callers recount pairs near the threshold from whole hashes.
    """
    salt = mix64(np.arange(1, len(sizes) + 1, dtype=np.uint64))
    key = (mix64(tokens ^ salt[leaf[owner]]) & np.uint64(~((1 << 20) - 1) & (2**64 - 1))) | owner.astype(np.uint64)
    key = np.sort(key)
    if len(key) > 1:
        key = key[np.r_[True, key[1:] != key[:-1]]]
    piece, slot = key >> np.uint64(20), (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.r_[0, np.cumsum(sizes)]  # the leaf's first slot
    base = np.r_[0, np.cumsum(sizes * sizes)]
    counts = np.zeros(base[-1], np.int32)
    run = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
    times = np.diff(np.r_[run, len(piece)])
    often = np.repeat(times > RARE, times)
    at = np.flatnonzero(np.repeat((times > 1) & (times <= RARE), times))
    for lag in range(1, RARE):  # rare pieces: every pair of their texts
        at = at[at + lag < len(piece)]
        at = at[piece[at] == piece[at + lag]]
        x, y = slot[at], slot[at + lag]
        g = leaf[x]
        counts += np.bincount(base[g] + (x - first[g]) * sizes[g] + (y - first[g]), minlength=len(counts)).astype(np.int32)
    # common pieces: 0/1 matrices of texts by pieces, leaf by leaf
    column, rows_ = np.cumsum(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else piece, slot
    column, rows_ = column[often], rows_[often]
    order = np.argsort(leaf[rows_], kind="stable")
    column, rows_ = column[order], rows_[order]
    bounds = np.searchsorted(leaf[rows_], np.arange(len(sizes) + 1))
    for g in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[g], bounds[g + 1]
        new = np.cumsum(np.r_[0, column[lo + 1 : hi] != column[lo : hi - 1]])
        table = np.zeros((sizes[g], sizes[g]), np.float32)
        for c in range(0, new[-1] + 1, WIDTH):
            p, q = np.searchsorted(new, (c, c + WIDTH))
            m = np.zeros((sizes[g], min(WIDTH, new[-1] + 1 - c)), np.float32)
            m[rows_[lo + p : lo + q] - first[g], new[p:q] - c] = 1
            table += m @ m.T
        counts[base[g] : base[g + 1]] += np.triu(table, 1).astype(np.int32).ravel()
    hit = np.flatnonzero(counts)
    g = np.searchsorted(base, hit, side="right") - 1
    local = hit - base[g]
    return first[g] + local // sizes[g], first[g] + local % sizes[g], counts[hit]


def _split(members: np.ndarray, sets: list[np.ndarray], eps: float, leaves: list[np.ndarray]) -> None:
    """Adds the leaves of one region: slots of members, boundary windows replicated (see the module)."""
    stack = [members]
    while stack:
        part = stack.pop()
        if len(part) <= LEAF:
            leaves.append(part)
            continue
        pivot = sets[part[0]]
        lengths = np.array([len(sets[m]) for m in part])
        inside = np.isin(np.concatenate([sets[m] for m in part]), pivot)
        common = np.add.reduceat(inside, np.r_[0, np.cumsum(lengths)[:-1]])
        d = 1 - common / (lengths + len(pivot) - common)
        best = None
        for b in (0.5, 0.6, 0.7, 0.8):  # any radius is exact; the one that replicates least is taken
            inner, outer = d <= b + eps / 2 + 1e-9, d >= b - eps / 2 - 1e-9
            cost = inner.sum() ** 2 + outer.sum() ** 2
            if best is None or cost < best[0]:
                best = (cost, inner, outer)
        if best[0] > 0.9 * len(part) ** 2:
            leaves.append(part)
        else:
            stack += [p for p in (part[best[1]], part[best[2]]) if len(p) > 1]


def similar_pairs(sets: list[np.ndarray], groups: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of slots in a common group with Jaccard similarity of at least ``threshold``."""
    leaves: list[np.ndarray] = []
    for g in groups:
        if len(g) <= LEAF:
            leaves.append(g)
        else:
            _split(g, sets, 1 - threshold, leaves)
    if not leaves:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    sizes = np.array([len(x) for x in leaves], np.int64)
    member = np.concatenate(leaves)  # slot -> set
    leaf = np.repeat(np.arange(len(leaves)), sizes)
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([sets[m] for m in member])
    owner = np.repeat(np.arange(len(member)), n[member])
    x, y, common = _leaf_pairs(tokens, owner, leaf, sizes)
    x, y = member[x], member[y]
    j = common / (n[x] + n[y] - common)
    near = np.flatnonzero(np.abs(j - threshold) < 0.02)
    for i in near:
        c = len(np.intersect1d(sets[x[i]], sets[y[i]], assume_unique=True))
        j[i] = c / (n[x[i]] + n[y[i]] - c)
    ok = (j >= threshold - 1e-12) & (x != y)
    return x[ok], y[ok], j[ok]


def together(cuts: list[int], chars: list[int], most: int) -> list[tuple[int, int]]:
    """Runs ``(lo, hi)`` of whole regions ``cuts[i]:cuts[i + 1]`` of up to ``most`` characters, or of one larger region."""
    runs, lo, size = [], 0, 0
    for i in range(len(cuts) - 1):
        more = sum(chars[cuts[i] : cuts[i + 1]])
        if i > lo and size + more > most:
            runs.append((lo, i))
            lo, size = i, 0
        size += more
    return [*runs, (lo, len(cuts) - 1)]


def joined(members: DataFrame, packed: DataFrame, dictionary: bytes, threshold: float, cross: bool) -> DataFrame:
    """All pairs of distinct texts that meet in a region and reach the threshold: ``(ka, kb, similarity)``.

    With ``cross`` only pairs with one text of side 1 and one of side 2 are given.
    """
    texts = packed.groupBy("k").agg(F.first("z", ignorenulls=True).alias("z"), F.bit_or("side").alias("side"))
    shipped = spread(members).join(texts, "k").select("region", "a", "b", "part", "k", "side", "z")
    shipped = shipped.repartition("region", "a", "b").sortWithinPartitions("region", "a", "b", "k")

    most = TOGETHER

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(dictionary)[1].decompress
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            texts = [unpack(r[6]).decode("utf-8", "surrogatepass") for r in rows]
            cuts = [0] + [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]] + [len(rows)]
            found = []
            for lo, hi in together(cuts, [len(t) for t in texts], most):
                h, starts = piece_hashes(texts[cuts[lo] : cuts[hi]])
                sets = [_distinct(h[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                groups = [np.arange(a, b) - cuts[lo] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1])]
                x, y, j = similar_pairs(sets, groups, threshold)
                found.append((x + cuts[lo], y + cuts[lo], j))
            x, y, j = map(np.concatenate, zip(*found))
            k = np.array([r[4] for r in rows], np.int64)
            a, b, part = (np.array([r[c] for r in rows], np.int32) for c in (1, 2, 3))
            ok = (a[x] == b[x]) | (part[x] != part[y])
            if cross:
                side = np.array([r[5] for r in rows], np.int32)
                ok &= ((side[x] & 1 > 0) & (side[y] & 2 > 0)) | ((side[x] & 2 > 0) & (side[y] & 1 > 0))
            x, y, j = x[ok], y[ok], j[ok]
            lo, hi = np.minimum(k[x], k[y]), np.maximum(k[x], k[y])
            return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(j)], names=["ka", "kb", "similarity"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if size > 1_500_000 and row[:3] != held[-1][:3]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += 2 * len(row[6])
        if held:
            yield flush(held)

    return shipped.mapInArrow(join, "ka bigint, kb bigint, similarity double").dropDuplicates(["ka", "kb"])
