"""Problem 7: filling fixed-capacity containers with items.

Martello-Toth dominance reduction, then best fit.  Items of one size are interchangeable, so the
instance is its size histogram: at most ``capacity`` entries however many items there are.  ``plan``
works on that histogram in batches: it fixes small sets that dominate every other set with the same
largest item (an item nothing fits beside; a pair that fills the container; the best pair where
no three fit; the best triple where no four fit), shrinks the instance, and repeats; the remainder is
packed best-fit decreasing.  Its result are patterns with multiplicities, again bounded by the
capacity.  Items then find their container by their rank among items of their size, which is computed
in hashed blocks, so that a size of a third of all items is ranked by many tasks.

Defined results: a text above the capacity is cut into full pieces and a rest; no other text is cut.
Null and empty texts need no space and are left out.  Repeated texts are items of their own.  Limits that are null or
not positive are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.tokens import VOCABULARY, counted
from sievework.session import written

#: Items are ranked in hashed blocks: these many, and one more per BLOCK_ITEMS items.
BLOCKS, BLOCK_ITEMS = 64, 250_000
Pattern = tuple[int, dict[int, int]]


def _dominating(j: int, room: int, sizes: list[int], left: dict[int, int]) -> tuple[int, ...] | None:
    """The others of a set that dominates all feasible sets with largest item ``j``; None if none is known."""

    def has(s: int, taken: tuple[int, ...] = ()) -> bool:
        return left[s] - (s == j) - taken.count(s) > 0

    def largest(limit: int, taken: tuple[int, ...] = ()) -> int:
        at = bisect_right(sizes, limit) - 1
        while at >= 0 and not has(sizes[at], taken):
            at -= 1
        return sizes[at] if at >= 0 else 0

    small: list[int] = []
    for s in sizes:
        small += [s] * min(3 - len(small), max(0, left[s] - (s == j)))
        if len(small) == 3:
            break
    if not small or small[0] > room:
        return ()
    one = largest(room)
    if one == room or len(small) < 2 or small[0] + small[1] > room:
        return (one,)
    if len(small) < 3 or sum(small) > room:  # at most two more fit
        second = largest(room - one, (one,))
        half = largest(room // 2)  # the largest that can be the smaller of a pair
        if second and second >= half:
            return (one, second)
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers as ``(how many, {size: times})`` for a size histogram (sizes of 1 to capacity)."""
    left = {s: c for s, c in histogram.items() if c > 0}
    sizes = sorted(left)
    done: list[Pattern] = []

    def take(items: tuple[int, ...]) -> None:
        need = {s: items.count(s) for s in items}
        times = min(left[s] // n for s, n in need.items())
        done.append((times, need))
        for s, n in need.items():
            left[s] -= times * n
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))

    changed = True
    while changed:
        changed = False
        for j in sorted(sizes, reverse=True):
            while left[j]:
                others = _dominating(j, capacity - j, sizes, left)
                if others is None:
                    break
                take((j, *others))
                changed = True
    # best-fit decreasing: containers with equal content move together
    node: list[tuple[int, int, int]] = []  # parent, size, times
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> [(node, how many)]
    rooms: list[int] = []

    def put(room: int, at: int, many: int) -> None:
        if many:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((at, many))

    for s in reversed(sizes):
        c = left[s]
        while c:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                at, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, at, many = capacity, -1, -(-c // (capacity // s))
            fill = room // s
            full = min(many, c // fill)
            if full:
                node.append((at, s, fill))
                put(room - fill * s, len(node) - 1, full)
                c -= full * fill
            if full < many and c:  # one more takes what is left
                node.append((at, s, c))
                put(room - c * s, len(node) - 1, 1)
                full, c = full + 1, 0
            if at >= 0:
                put(room, at, many - full)
    for room in rooms:
        for at, many in open_[room]:
            content: dict[int, int] = {}
            while at >= 0:
                parent, s, n = node[at]
                content[s] = content.get(s, 0) + n
                at = parent
            done.append((many, content))
    return done


def _runs(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first container and items per container of each run of equal containers."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    container = 0
    for many, content in patterns:
        for s, n in content.items():
            runs.setdefault(s, []).append((next_rank.get(s, 0), container, n))
            next_rank[s] = next_rank.get(s, 0) + many * n
        container += many
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in runs.items()}


def _limits(limits: DataFrame) -> list[tuple[str, int]]:
    rows = limits.where("capacity_tokens > 0 AND container_kind IS NOT NULL").select("container_kind", "capacity_tokens").distinct()
    return [(r[0], r[1]) for r in rows.orderBy("container_kind").collect()]


def _items(tokens: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """``(kind, doc_id, piece, tokens)``: texts and, above the capacity, their pieces."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in limits))
    each = tokens.where("tokens > 0").select("doc_id", "tokens", F.explode(kinds).alias("l")).select("doc_id", "tokens", "l.*")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity as int)"))))
    return each.select("kind", "doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), "capacity").alias("tokens"))


def packed(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(container_kind, container, doc_id, piece, tokens)``: every item and its container."""
    spark, wanted = documents.sparkSession, _limits(limits)
    schema = "container_kind string, container bigint, doc_id bigint, piece int, tokens bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    items = _items(counted(documents, vocabulary), wanted)
    histogram: dict[str, dict[int, int]] = {k: {} for k, _ in wanted}
    for kind, size, n in items.groupBy("kind", "tokens").count().collect():  # at most one row per capacity unit
        histogram[kind][size] = n
    runs = {k: _runs(plan(histogram[k], c)) for k, c in wanted}
    blocks = BLOCKS + sum(sum(h.values()) for h in histogram.values()) // BLOCK_ITEMS
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = items.groupBy("kind", "tokens", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind", "tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "tokens", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("kind", "tokens", "block").orderBy("doc_id", "piece")
    placed = items.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["kind", "tokens", "block"])
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column("kind").to_pylist(), object)
            size, rank = batch.column("tokens").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(rank), np.int64)
            order = np.lexsort((size, kind))
            k, s = kind[order], size[order]
            cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]), True]) if len(order) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                start, base, times = shared.value[k[a]][int(s[a])]
                r = rank[order[a:b]]
                i = np.searchsorted(start, r, side="right") - 1
                out[order[a:b]] = base[i] + (r - start[i]) // times[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array(out), batch.column("doc_id"), batch.column("piece"), batch.column("tokens")],
                names=["container_kind", "container", "doc_id", "piece", "tokens"],
            )

    ranked = placed.select("kind", (F.col("offset") + F.col("own")).alias("rank"), "doc_id", "piece", "tokens")
    return ranked.mapInArrow(place, schema)


def report(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per kind: items, containers, tokens, unused tokens, and the containers that no packing can go below."""
    rows = written(packed(documents, limits, vocabulary), "containers")
    used = rows.groupBy("container_kind", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    sums = used.groupBy("container_kind").agg(
        F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")
    )
    return sums.join(limits.distinct(), "container_kind").select(
        "container_kind",
        "capacity_tokens",
        "items",
        "containers",
        "tokens",
        (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused_tokens"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        "fullest",
    )


def facts(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per kind what holds for every valid packing: documents packed, containers above the capacity, and documents cut though they fit (none)."""
    rows = written(packed(documents, limits, vocabulary), "containers")
    caps = limits.where("capacity_tokens > 0 AND container_kind IS NOT NULL").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    full = rows.groupBy("container_kind", "container").agg(F.sum("tokens").alias("t")).join(caps, "container_kind")
    docs = rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces")).join(caps, "container_kind")
    over = full.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull_containers"))
    each = docs.groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if((F.col("t") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("needlessly_cut"),
        F.count_if(F.col("pieces") != F.ceil(F.col("t") / F.col("capacity"))).alias("wrongly_cut"),
    )
    return each.join(over, "container_kind")
