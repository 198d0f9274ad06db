"""Sharding by minimax contiguous partition, with DataFrame functions only.

Groups of equal texts are atoms, ordered by a hash of the text. The smallest feasible capacity is found by binary search,
each capacity checked greedily over sums of ordered segments; only the segments in which a cut can still fall are split
further, so that the driver sees a bounded number of sums and never the groups. Groups above an even share get shards of
their own first, so that the others stay even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sums that the driver reads at once at most; hex digits by which the first segments differ.
SUMS, DIGITS = 100_000, 3
#: Rows of one salt, within which slots are numbered.
SALT_ROWS = 100_000


@dataclass(frozen=True)
class Segment:
    key: str  # all group hashes of the segment begin with it
    size: int
    groups: int


def greedy(segments: list[Segment], capacity: int, shards: int) -> list[int] | None:
    """Where each shard begins if every shard takes what fits; None if they don't suffice."""
    starts, filled = [0], 0
    for i, s in enumerate(segments):
        if s.size > capacity:
            return None
        if filled + s.size > capacity:
            starts.append(i)
            filled = 0
            if len(starts) > shards:
                return None
        filled += s.size
    return starts


def smallest(segments: list[Segment], shards: int) -> int:
    """The smallest capacity that is feasible if segments are atoms."""
    total = sum(s.size for s in segments)
    lo, hi = max(-(-total // shards), max((s.size for s in segments), default=0)), total
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(segments, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def open_segments(segments: list[Segment], lo: int, hi: int, shards: int) -> list[Segment]:
    """Segments of several groups in which a cut of a capacity from lo to hi can fall."""
    ends, reached = [], 0
    for s in segments:
        reached += s.size
        ends.append(reached)
    windows, at, begin = [], 0, 0
    for i in range(1, shards):
        while at < len(segments) and ends[at] - begin <= lo:
            at += 1
        begin = ends[at - 1] if at else 0
        windows.append((begin, i * hi))
    out = []
    for s, end in zip(segments, ends):
        if s.groups > 1 and any(end > a and end - s.size <= b for a, b in windows):
            out.append(s)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The hashes at which shards 1, 2, ... begin. groups: (g: hex hash, w: size), one row each."""

    def sums(where, digits: int | None) -> list[Segment]:
        key = F.col("g") if digits is None else F.substring("g", 1, digits)
        rows = where.groupBy(key.alias("key")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
        return sorted((Segment(r["key"], r["w"], r["n"]) for r in rows), key=lambda s: s.key)

    segments = sums(groups, DIGITS)
    if not segments or shards < 2:
        return []
    largest = groups.agg(F.max("w").alias("w")).first()["w"]
    lo = max(-(-sum(s.size for s in segments) // shards), largest)
    while True:
        hi = smallest(segments, shards)
        wanted = [] if hi == lo else open_segments(segments, lo, hi, shards)
        if not wanted:
            break
        # as many of them as one read may return, the narrowest keys last
        digits = len(wanted[0].key)
        wanted = [s for s in wanted if len(s.key) == digits]
        whole = sum(s.groups for s in wanted) <= SUMS
        keys = {s.key for s in wanted}
        inner = sums(groups.where(F.substring("g", 1, digits).isin(sorted(keys))), None if whole else digits + 2)
        segments = sorted([s for s in segments if s.key not in keys] + inner, key=lambda s: s.key)
    starts = greedy(segments, hi, shards)
    return [segments[i].key for i in starts[1:]]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): one row for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. Rows of equal text share a shard; null is a text of its own, unlike
    the empty one. Slots number a shard's rows from 0 without gaps. An empty table gives no rows."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.sha2(text, 256), F.lit("-")).alias("g"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("w")), "groups")
    left, total, own = shards, groups.agg(F.sum("w").alias("w")).first()["w"] or 0, []
    for r in groups.orderBy(F.desc("w"), "g").limit(shards).collect():
        if left > 1 and r["w"] * left > total:
            own.append(r["g"])
            left, total = left - 1, total - r["w"]
        else:
            break
    rest = groups.where(~F.col("g").isin(own)) if own else groups
    cuts = minimax_cuts(rest, left)
    number = sum(((F.col("g") >= c).cast("int") for c in cuts), F.lit(len(own)))
    for i, g in enumerate(own):
        number = F.when(F.col("g") == g, i).otherwise(number)
    salts = max(1, -(-rows.count() // SALT_ROWS))
    put = rows.withColumn("shard", number.cast("int")).withColumn("_salt", F.pmod(F.xxhash64(id_col, "g"), F.lit(salts)))
    counts = put.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy(id_col, "g"))
    numbered = put.withColumn("_in", inside).join(counts, ["shard", "_salt"])
    return numbered.select(id_col, "size", "text_crc32", "shard", (F.col("_before") + F.col("_in") - 1).cast("long").alias("slot"))
