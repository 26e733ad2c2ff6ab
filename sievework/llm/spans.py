"""Problem 9: long exact spans shared between records.

De Bruijn compaction over sampled k-mers of tokens; a token is a character, the unit in which spans are measured.

1. Nodes are k-mers.  Of every stretch of ``length`` characters the k-mer with the smallest
   hash is a node, so two records that share such a stretch share a node at the same place in it.
   Nodes that stand in one record only are dropped; a join with the node counts keeps the others.
2. Two nodes of a record that follow each other at most ``k`` characters apart form an edge, named by both
   nodes and their distance; as the k-mers touch, equal edges mean equal text.  Edges are counted.
3. Edges are compacted to nonbranching paths by joins of the distinct edges: two that meet in a node belong to one path when
   both and the node occur equally often, for then all their occurrences run through all of them.  Every edge finds the head of
   its path and its distance from it by pointer jumping (the logarithm of the longest path in rounds; there are no cycles,
   as some occurrence would have to have no beginning).  The edges' occurrences join their heads, and those with one head and one
   start, by source coordinates, are an occurrence of the path.  A path of at least ``length`` characters stands in two records
   and is a shared span as it is.
4. What is left are windows of ``length`` characters around the ends and branches of paths.  They are
   verified by their source coordinates: the hashes of the windows that hold a repeated node are
   aggregated to their first and last record, and those of two records join back.
5. Per record, paths and windows are merged to maximal spans.

Unsampled k-mers would be one row per character; the nodes are one row per (length - k + 2) / 2 of them, and lose no span.
Every step is a hash join or a pre-aggregated count, rows are a few dozen bytes, and texts are
shuffled once, to meet their own nodes and paths (a list that is shorter than the text).  The joins have one row per node, edge or
hash on one side, so a stock passage of a third of all records skews the other side only, which adaptive execution splits.
64-bit hashes stand for text: among 10**9 windows a false match has probability 0.03.

Defined results: null, blank and shorter texts share nothing and appear only in the report, with 0.
Equal texts share all of their characters if long enough.  A stretch repeated only within one record is
not shared.  Rows that repeat a ``doc_id`` are one record: their texts share nothing with each other, and
the spans of all of them are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.textsets import code_points, mix64
from sievework.session import cut, written

LENGTH = 150
_BASE = 0x9E3779B97F4A7C15
_BATCH_CHARS = 1_000_000
_AT = np.uint64(30)  # bits of a position inside a batch
_MASK = np.uint64((1 << 30) - 1)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for rolling hashes of up to n characters."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Rolling:
    """Hashes of any substring of a batch of texts."""

    def __init__(self, texts: list[str]):
        codes, self.starts = code_points(texts)
        size = 1 << max(16, int(len(codes)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(77)) * power[: len(codes)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.sums[at + length] - self.sums[at]) * self.inverse[at])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows that lie inside one text, and the texts' numbers."""
        count = np.maximum(np.diff(self.starts) - (length - 1), 0)
        text = np.repeat(np.arange(len(count)), count)
        first = np.r_[0, np.cumsum(count)[:-1]]
        return np.arange(count.sum()) - first[text] + self.starts[:-1][text], text

    def minimisers(self, windows: np.ndarray, length: int, k: int) -> np.ndarray:
        """For each window the start of its k-mer with the smallest hash, the leftmost of equal ones."""
        if not len(windows):
            return windows
        n, width = len(self.sums) - k, length - k + 1
        key = (self.hashes(np.arange(n), k) & ~_MASK) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key[: len(key) - span] = np.minimum(key[: len(key) - span], key[span:])
            span *= 2
        return (np.minimum(key[windows], key[windows + (width - span)]) & _MASK).astype(np.int64)


def _batches(ids: list, texts: list, length: int) -> Iterator[tuple[list, list]]:
    """Texts long enough, in groups of a bounded number of characters (a longer text goes alone)."""
    held_ids, held, size = [], [], 0
    for i, t in zip(ids, texts):
        if t is None or len(t) < length:
            continue
        if held and size + len(t) > _BATCH_CHARS:
            yield held_ids, held
            held_ids, held, size = [], [], 0
        held_ids.append(i)
        held.append(t)
        size += len(t)
    if held:
        yield held_ids, held


def shared_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, span_start, span_chars)``: the maximal stretches shared with another record."""
    k = (length + 2) // 2  # neighbouring nodes are at most length - k + 1 <= k apart, so they touch
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").where(F.length("text") >= length)

    def find_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _batches(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), length):
                roll = _Rolling(texts)
                at = np.unique(roll.minimisers(roll.windows(length)[0], length, k))
                text = np.searchsorted(roll.starts, at, side="right") - 1
                own = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(roll.hashes(at, k).view(np.int64)),
                        pa.array(np.array(ids, np.int64)[text]),
                        pa.array(own[text]),
                        pa.array((at - roll.starts[text]).astype(np.int32)),
                    ],
                    names=["node", "doc_id", "of", "at"],
                )

    nodes = written(docs.mapInArrow(find_nodes, "node bigint, doc_id bigint, of bigint, at int"), "nodes")  # read twice
    counts = nodes.groupBy("node").agg(F.count("*").cast("int").alias("occurs"), *_records()).where("d1 <> d2").select("node", "occurs")
    repeated = written(nodes.join(counts, "node"), "repeated")  # few rows, read twice
    in_text = Window.partitionBy("doc_id", "of").orderBy("at")  # texts that share a doc_id have their own edges
    steps = repeated.select(
        "doc_id", "at", "node", "occurs", F.lead("node").over(in_text).alias("next"), F.lead("occurs").over(in_text).alias("next_occurs"),
        (F.lead("at").over(in_text) - F.col("at")).alias("gap"),
    ).where(F.col("gap").between(1, k))
    steps = written(steps.withColumn("edge", F.xxhash64("node", "next", "gap")), "steps")
    edges = (
        steps.groupBy("edge")
        .agg(F.count("*").cast("int").alias("times"), *(F.first(c).alias(c) for c in ("node", "next", "gap", "occurs", "next_occurs")), *_records())
        .where("d1 <> d2")
    )
    paths = steps.select("doc_id", "at", "gap", "edge").join(_heads(cut(edges)), "edge")
    paths = paths.groupBy("doc_id", "head", (F.col("at") - F.col("far")).alias("start")).agg((F.max(F.col("at") + F.col("gap")) + k).alias("end"))
    paths = cut(paths.where(F.col("end") - F.col("start") >= length).select("doc_id", F.col("start").alias("at"), (F.col("end") - F.col("start")).alias("chars")))
    marks = repeated.select("doc_id", "at", F.lit(0).alias("chars")).union(paths)
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "chars")).alias("marks"))  # at most one per character

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of windows that hold a repeated node and lie in no path."""
        for batch in batches:
            column = batch.column("marks")
            flat, offsets = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
            at, chars = flat.field("at").to_numpy(), flat.field("chars").to_numpy()
            row = {}
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                row[d] = i  # rows of one doc_id carry the same marks
            for ids, texts in _batches(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), length):
                roll = _Rolling(texts)
                windows, text = roll.windows(length)
                known = np.zeros(len(roll.sums), bool)
                ends = np.zeros(len(roll.sums), np.int64)  # where a path goes on to, by its characters
                for n, d in enumerate(ids):
                    part = slice(offsets[row[d]], offsets[row[d] + 1])
                    base, size = roll.starts[n], len(texts[n])
                    a, c = at[part], chars[part]
                    known[base + a[(c == 0) & (a + k <= size)]] = True
                    for x, m in zip(a[c > 0].tolist(), c[c > 0].tolist()):
                        stop = base + min(x + m, size)
                        np.maximum(ends[base + x : stop], stop, out=ends[base + x : stop])
                open_ = known[roll.minimisers(windows, length, k)] & (ends[windows] < windows + length)
                here, text = windows[open_], text[open_]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(roll.hashes(here, length).view(np.int64)), pa.array(np.array(ids, np.int64)[text]), pa.array((here - roll.starts[text]).astype(np.int32))],
                    names=["h", "doc_id", "at"],
                )

    one = docs.join(marks, "doc_id")  # only records with a repeated node go on
    windows = written(one.select("doc_id", "text", "marks").mapInArrow(open_windows, "h bigint, doc_id bigint, at int"), "windows")
    shared = windows.groupBy("h").agg(*_records()).where("d1 <> d2").select("h")
    spans = windows.join(shared, "h").select("doc_id", "at", F.lit(length).alias("chars")).union(paths)
    in_doc = Window.partitionBy("doc_id").orderBy("at")
    so_far = in_doc.rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        spans.withColumn("end", F.col("at") + F.col("chars"))
        .withColumn("new", F.when(F.col("at") <= F.max("end").over(so_far), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("at").alias("s"), F.max("end").alias("e"))
    )
    return merged.select("doc_id", F.col("s").cast("bigint").alias("span_start"), (F.col("e") - F.col("s")).cast("bigint").alias("span_chars"))


def _records() -> tuple[Column, Column]:
    """The first and the last record, for groups that must stand in two."""
    return F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")


def _heads(edges: DataFrame) -> DataFrame:
    """``(edge, head, far)``: the first edge of each distinct edge's nonbranching path, and the characters from there to it."""
    ins = edges.where("times = next_occurs").select(F.col("next").alias("node"), F.col("edge").alias("head"), F.col("gap").alias("far"))
    outs = edges.where("times = occurs").select("node", "edge")
    link = outs.join(ins, "node").select("edge", "head", "far")
    at = cut(edges.select("edge").join(link, "edge", "left").select("edge", F.coalesce("head", "edge").alias("head"), F.coalesce("far", F.lit(0)).alias("far")))
    while True:
        up = at.where("edge <> head").select(F.col("edge").alias("head"), F.col("head").alias("top"), F.col("far").alias("more"))
        at = cut(at.select("edge", "head", "far").join(up, "head", "left").select("edge", F.coalesce("top", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "top"))
        if at.where("top IS NOT NULL").isEmpty():
            return at.select("edge", "head", "far")


def found(documents: DataFrame) -> DataFrame:
    """p9_found."""
    return shared_spans(documents)


def report(documents: DataFrame) -> DataFrame:
    """Per record: characters, shared characters, their share, number of spans."""
    per_doc = shared_spans(documents).groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"), F.count("*").alias("spans"))
    chars = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))
    return (
        chars.join(per_doc, "doc_id", "left")
        .fillna(0, ["shared_chars", "spans"])
        .withColumn("shared_share", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(F.lit(0.0)))
    )
