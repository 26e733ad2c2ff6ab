"""Story clusters: exact collapse, candidates, exact similarity, connected components.

Near-equal stories are found by the parts of their shingle sets: two sets whose similarity reaches the threshold differ in so few
shingles that of somewhat more parts one is equal in both, so stories meet by equal parts.  That is exact, and stories that only share
a stock phrase don't meet.  What is shuffled are numbers; texts are shipped once for each side of a pair.  A story is known by the
first 64 bits of its SHA-256, which its ids show.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import piece_crcs, shingle_hashes, sketch, story_key
from sievework.operators.forest import spanning_forest
from sievework.session import written

#: A sketch of fewer hashes needs to share one, a longer one two.
SHORT = 4
#: From this threshold on stories meet by parts of their shingle sets; below, a part would hold too few shingles to tell stories apart.
BY_PARTS = 0.9
#: Parts beyond those that differences can spoil, so that hardly any story needs to meet by parts without a shingle.
SLACK = 1.25
#: Stories that share a sketch hash are compared in blocks of this size, and so many pairs at a time.
BLOCK, PAIRS = 20_000, 4_000_000


# ---------------------------------------------------------------- candidates by sketches


def _pairs_sharing(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers ``(i, j)`` of stories in a common bucket that share exactly one hash beyond the bucket's own."""
    x, a, b, part, n = (rows.column(c).to_numpy() for c in ("x", "a", "b", "part", "n"))
    bucket = np.cumsum(np.r_[True, (x[1:] != x[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) - 1
    rest = rows.column("rest").combine_chunks()
    row = np.repeat(np.arange(len(x)), rest.value_lengths().to_numpy(zero_copy_only=False))
    key = bucket[row] << 32 | (rest.flatten().to_numpy().astype(np.int64) + 2**31)
    order = np.argsort(key, kind="stable")
    key, sorted_row = key[order], row[order]
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.repeat(np.r_[runs[1:], len(key)], np.diff(np.r_[runs, len(key)])) if len(key) else runs
    partners = (ends - np.arange(len(key)) - 1)[place]
    total = np.cumsum(np.bincount(row, partners, len(x)).astype(np.int64))
    first, at = np.searchsorted(row, np.arange(len(x) + 1)), 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        entries = np.arange(first[at], first[stop])
        count = partners[entries]
        i = np.repeat(row[entries], count)
        j = sorted_row[np.repeat(place[entries] + 1 - (np.cumsum(count) - count), count) + np.arange(len(i))]
        fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
        fits &= (a[i] == b[i]) | (part[i] != part[j])
        pair = np.sort(i[fits] * len(x) + j[fits])
        once = np.diff(np.r_[-1, pair]) != 0
        once &= np.r_[once[1:], True]
        yield pair[once] // len(x), pair[once] % len(x)
        at = stop


def _meeting(base: DataFrame, threshold: float, shingle: int, sketch_size: int, counted: bool) -> DataFrame:
    """The candidates ``(u, v)``, each once, or with ``counted`` rows ``(pairs)`` that add up to their number."""
    small = F.transform(sketch(F.col("s"), sketch_size), lambda x: (x - F.lit(2**31)).cast("int"))
    sketched = written(base.select("h", "n", small.alias("k")), "sketches")
    hot = sketched.select(F.explode("k").alias("x")).groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")).where("g > 1")
    # at most one hash of BLOCK / sketch_size stories is hot
    each = sketched.select("h", "n", "k", F.posexplode("k").alias("at", "x")).select("x", "h", "n", F.slice("k", F.col("at") + 2, F.lit(sketch_size)).alias("rest"))
    each = each.join(F.broadcast(hot), "x", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("h"), F.col("g")), F.lit(0)).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)))
    each = each.select("x", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "h", "n", "rest")
    buckets = each.repartition("x", "a", "b").sortWithinPartitions("x", "a", "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            h = rows.column("h").combine_chunks()
            for i, j in _pairs_sharing(rows, threshold):
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64())], names=["pairs"])
                else:
                    yield pa.RecordBatch.from_arrays([h.take(pa.array(i)), h.take(pa.array(j))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 2 * BLOCK:
                rows = pa.Table.from_batches(held)
                x, a, b = (rows.column(c).to_numpy() for c in ("x", "a", "b"))
                last = np.flatnonzero((x != x[-1]) | (a != a[-1]) | (b != b[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
                yield from flush(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    # two stories that share c > 1 hashes share exactly one beyond the bucket's in one bucket, that of the last hash but one
    kind = base.schema["h"].dataType.simpleString()
    twos = buckets.mapInArrow(meet, "pairs bigint" if counted else f"u {kind}, v {kind}")
    beside = sketched.where(F.col("n") * threshold <= shingle + SHORT - 1)  # no other text is as short as one with a short sketch
    a = beside.select(F.explode("k").alias("x"), F.col("h").alias("u"), F.col("n").alias("nu"), F.col("k").alias("ku"))
    b = beside.where(F.size("k") < SHORT).select(F.explode("k").alias("x"), F.col("h").alias("v"), F.col("n").alias("nv"), F.col("k").alias("kv"))
    fits = F.least("nu", "nv") >= F.lit(threshold) * F.greatest("nu", "nv")
    ones = a.join(b, "x").where("u < v").where(fits).where(F.size(F.array_intersect("ku", "kv")) == 1)
    if counted:
        return twos.union(ones.agg(F.count("*")))
    return twos.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(ones.select("u", "v"))


def fuzzy_candidates(base: DataFrame, threshold: float, shingle: int, sketch_size: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``(h, n, s)``: hashes in order, lengths whose ratio reaches the threshold, shared sketch hashes.

    Two shared hashes are needed, one if the later story's sketch is short.  Stories meet in the bucket of each of their sketch
    hashes, which ships the hashes after it; a pair that shares more than one is given in one bucket only, so pairs are neither
    shuffled nor compared again.
    """
    return _meeting(base, threshold, shingle, sketch_size, False)


def candidate_count(base: DataFrame, threshold: float, shingle: int, sketch_size: int) -> DataFrame:
    """One row with the number of ``fuzzy_candidates``, which are not listed for it."""
    pairs = _meeting(base, threshold, shingle, sketch_size, True)
    return pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("candidate_pairs_compared"))


# ---------------------------------------------------------------- candidates by parts


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_keys(texts: list[str], threshold: float, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``(key, text number)``: texts whose shingle sets reach the threshold have a key in common.

    Sets are sorted into classes by size, each class up to half as large again as the one before.  A pair is of the class of its larger set; a smaller set
    also has the keys of the classes it may meet there.  Sets of a class that are similar differ in at most ``spoilt`` shingles; they are
    cut by hash into more parts than that, each difference spoils one part, and a key is a hash of a part.  Parts without a
    shingle get a key only if a set has no more than ``spoilt`` others: with more, one of the others is equal.
    """
    keys = piece_crcs(texts, shingle)
    owner, crc = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
    size = np.bincount(owner, minlength=len(texts))
    tops = [1]
    while tops[-1] < size.max(initial=1) / threshold + 1:
        tops.append(max(tops[-1] + 1, tops[-1] * 3 // 2))
    top = np.array(tops)
    low, high = np.searchsorted(top, size), np.searchsorted(top, np.floor(size / threshold + 1e-9))
    mixed, out, whose = _mixed(crc), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in range(int((high - low).max(initial=0)) + 1):
        class_ = low + step
        spoilt = np.floor(2 * top[np.minimum(class_, len(top) - 1)] * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)
        parts = np.ceil(SLACK * (spoilt + 1)).astype(np.int64)
        mine = np.flatnonzero((class_ <= high)[owner])
        if not len(mine):
            continue
        o = owner[mine]
        part = (crc[mine] * parts[o].astype(np.uint64)) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (part[1:] != part[:-1])])
        sums, o, part = np.add.reduceat(mixed[mine], begin), o[begin], part[begin]
        salt = class_.astype(np.uint64) << np.uint64(32)
        out.append(_mixed(sums + _mixed(salt[o] | part)))
        whose.append(o)
        filled = np.bincount(o, minlength=len(texts))
        for t in np.flatnonzero((filled > 0) & (filled <= spoilt)):
            empty = np.setdiff1d(np.arange(parts[t], dtype=np.uint64), part[o == t])
            out.append(_mixed(_mixed(salt[t] | empty)))
            whose.append(np.full(len(empty), t))
    return np.concatenate(out), np.concatenate(whose)


def part_candidates(stories: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``(h, norm)`` that may reach the threshold, and all that do."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text = part_keys(batch.column("norm").to_pylist(), threshold, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("h").take(pa.array(text))], names=["x", "h"])

    signed = stories.select("h", "norm").mapInArrow(sign, f"x bigint, h {stories.schema['h'].dataType.simpleString()}")
    signed = signed.repartition("x")  # one exchange for both sides
    a, b = signed.select("x", F.col("h").alias("u")), signed.select("x", F.col("h").alias("v"))
    return a.join(b, "x").where("u < v").select("u", "v").distinct()


# ---------------------------------------------------------------- similarity and components


def fuzzy_edges(stories: DataFrame, candidates: DataFrame, threshold: float, shingle: int, sketch_size: int) -> DataFrame:
    """Pairs of ``(h, norm)`` among the candidates that are candidates by their sketches and nearly equal: ``(u, v, similarity)``."""
    u, v = (stories.select(F.col("h").alias(c), F.col("norm").alias(f"t{c}")) for c in "uv")
    kind = stories.schema["h"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tu, tv = batch.column("tu").to_pylist(), batch.column("tv").to_pylist()
            count, sides, firsts = len(tu), [], []
            for texts in (tu, tv):
                keys = piece_crcs(texts, shingle)
                sides.append(keys)
                begin = np.searchsorted(keys, np.arange(count, dtype=np.uint64) << np.uint64(32))
                firsts.append(keys[np.arange(len(keys)) - begin[(keys >> np.uint64(32)).astype(np.int64)] < sketch_size])

            def per(keys: np.ndarray) -> np.ndarray:
                return np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=count)

            common, shared = (per(np.intersect1d(*both, assume_unique=True)) for both in (sides, firsts))
            j = common / np.maximum(per(sides[0]) + per(sides[1]) - common, 1)
            nu, nv = (np.array([len(t) for t in texts]) for texts in (tu, tv))
            ok = (np.minimum(nu, nv) >= threshold * np.maximum(nu, nv)) & (shared >= np.where(per(firsts[1]) < SHORT, 1, 2)) & (j >= threshold)
            ok = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(ok)), batch.column("v").take(pa.array(ok)), pa.array(j[ok])], names=["u", "v", "similarity"])

    both = candidates.join(u, "u").join(v, "v").select("u", "v", "tu", "tv")
    return both.mapInArrow(measure, f"u {kind}, v {kind}, similarity double")


def _shingled(stories: DataFrame, shingle: int) -> DataFrame:
    return stories.select("h", F.length("norm").alias("n"), shingle_hashes("norm", shingle).alias("s"))


def _number(text: Column) -> Column:
    """The first 64 bits of the SHA-256 as a number, in the order of the digest."""
    digest = F.sha2(text, 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high - F.lit(2**31), 32).bitwiseOR(low)


def _digits(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def _clustered(records: DataFrame, id_: str, story: Column, threshold: float, shingle: int, sketch_size: int) -> tuple[DataFrame, DataFrame | None]:
    """``(id, h, component)`` (null for a story that no other is near to), and the distinct stories ``(h, norm)``."""
    keyed = written(records.select(F.col(id_), story_key(story).alias("norm")), "stories")
    own = F.when(F.col("norm") == "", F.concat(F.lit("__missing_story_"), F.col(id_).cast("string"))).otherwise(F.col("norm"))
    rows = keyed.select(id_, _number(own).alias("h"))
    if threshold >= 1:
        return rows.withColumn("component", F.lit(None).cast("bigint")), None
    stories = written(keyed.where("norm <> ''").select("norm").distinct().select(_number(F.col("norm")).alias("h"), "norm"), "texts")
    if threshold >= BY_PARTS:
        candidates = part_candidates(stories, threshold, shingle)
    else:
        candidates = fuzzy_candidates(_shingled(stories, shingle), threshold, shingle, sketch_size)
    edges = fuzzy_edges(stories, candidates, threshold, shingle, sketch_size).select("u", "v", (1 - F.col("similarity")).alias("w"))
    merged = spanning_forest(edges)[0].select(F.col("vertex").alias("h"), F.col("root").alias("component"))
    return rows.join(merged, "h", "left").select(id_, "h", "component"), stories


def story_clusters(
    records: DataFrame, id_: str, story: Column, threshold: float = 0.92, shingle: int = 5, sketch_size: int = 12, prefix: str = "story"
) -> DataFrame:
    """``(id, story_cluster_id, story_exact_id)``: exact and near-equal stories share a cluster.

    An empty story is a cluster of its own and takes no part in the fuzzy stage (two placeholders are never near
    each other).
    """
    rows = _clustered(records, id_, story, threshold, shingle, sketch_size)[0]
    return rows.select(
        id_,
        F.concat(F.lit(prefix + "_"), _digits(F.coalesce("component", "h"))).alias("story_cluster_id"),
        F.concat(F.lit("exact_"), _digits(F.col("h"))).alias("story_exact_id"),
    )


def cluster_audit(records: DataFrame, id_: str, story: Column, threshold: float = 0.92, shingle: int = 5, sketch_size: int = 12) -> DataFrame:
    """One row: rows, exact stories, clusters, stories merged by similarity, candidate pairs by sketches, rows in shared clusters."""
    rows, stories = _clustered(records, id_, story, threshold, shingle, sketch_size)
    per = rows.groupBy(F.coalesce("component", "h").alias("c")).agg(F.count("*").alias("rows"), F.count_distinct("h").alias("stories"))
    counts = per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("stories"), F.lit(0)).alias("exact_stories"), F.count("*").alias("clusters"),
        F.coalesce(F.sum(F.col("stories") - 1), F.lit(0)).alias("merged_stories"), F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("rows_in_shared_clusters"),
    )
    if stories is None:
        return counts.withColumn("candidate_pairs_compared", F.lit(0).cast("bigint"))
    return counts.crossJoin(candidate_count(_shingled(stories, shingle), threshold, shingle, sketch_size))
