"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_slices, materialize
from .word_bpe import default_path, encoder

#: Ids of a sequence, the id after a document, and documents that a Python worker is given at a time.
CAPACITY, END_ID, TEXTS = 2048, 0, 2048


@dataclass
class Bins:
    """`count` sequences that hold the same lengths: (length, how many) in order."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)


def _take(counts: np.ndarray, sizes: list[int]) -> int:
    """How often the sizes can be taken together."""
    return min(int(counts[s]) // sizes.count(s) for s in set(sizes))


def dominant_set(counts: np.ndarray, size: int, capacity: int) -> list[int] | None:
    """A set with an item of this size, of three items at most, that dominates every other set with it, or None.

    A set dominates another if the other's items can be dealt over its items without exceeding one: then some
    optimal packing has the set as a sequence. counts: of each size; all sets are drawn from those items.
    """
    room = capacity - size
    counts[size] -= 1
    try:
        there = np.flatnonzero(counts)
        smallest = [int(s) for s in there[:3] for _ in range(min(3, int(counts[s])))][:3]
        if not smallest or smallest[0] > room:
            return [size]
        fits = there[there <= room]
        largest = int(fits[-1])
        if largest == room:
            return [size, largest]
        if sum(smallest[:2]) > room or len(smallest) < 2:
            return [size, largest]
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        # Two others fit at most. The best sum of two, and the largest that can be the lesser of two.
        best = lesser = 0
        for s in fits:
            s = int(s)
            partners = fits[fits <= room - s]
            if len(partners) and int(partners[-1]) == s and counts[s] < 2:
                partners = partners[:-1]
            if len(partners):
                best = max(best, s + int(partners[-1]))
                if int(partners[-1]) >= s:
                    lesser = s
        if largest >= best:
            return [size, largest]
        second = fits[fits <= room - largest]
        if len(second) and int(second[-1]) == largest and counts[largest] < 2:
            second = second[:-1]
        if len(second) and int(second[-1]) >= lesser:
            return [size, largest, int(second[-1])]
        return None
    finally:
        counts[size] += 1


def reduce_instance(counts: np.ndarray, capacity: int = CAPACITY) -> list[Bins]:
    """Takes dominating sets out of counts (changed in place) until none is found."""
    fixed, again = [], True
    while again:
        again = False
        for size in range(capacity, 0, -1):
            while counts[size] and (found := dominant_set(counts, size, capacity)):
                # With fewer items left the set still dominates, as long as its own items last.
                times = _take(counts, found)
                for s in found:
                    counts[s] -= times
                fixed.append(Bins(times, [(s, found.count(s)) for s in dict.fromkeys(found)]))
                again = len(found) > 1 or again
    return fixed


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Bins]:
    """Best fit in decreasing order, all items of a size at once: each goes where the least room is left that it fits."""
    open_bins: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(room: int, bins: Bins) -> None:
        if bins.count:
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append(bins)

    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, bins = capacity, Bins(-(-n // (capacity // size)))
            each = min(room // size, n)
            filled = min(bins.count, n // each)
            n -= filled * each
            if bins.items:
                put(room, Bins(bins.count - filled, bins.items))
            put(room - each * size, Bins(filled, [*bins.items, (size, each)]))
    return [b for x in open_bins.values() for b in x]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Which items of each length go where: those ranked low to high - 1, `each` to a sequence, from sequence and offset on.

    Its size depends on the capacity alone: a step of either method adds a few rows for a whole length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for bins in [*reduce_instance(counts, capacity), *best_fit(counts, capacity)]:
        offset = 0
        for size, each in bins.items:
            rows.append((size, used[size], used[size] + bins.count * each, each, sequence, offset))
            used[size] += bins.count * each
            offset += size * each
        sequence += bins.count
    return pd.DataFrame(rows, columns=["length", "low", "high", "each", "sequence", "offset"], dtype="int64").sort_values(["length", "low"])


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encoded pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and task and rank_in_task.

    rank_in_task counts the pieces of each length in the task; both are kept with the rows once they are written.
    """
    path = path or default_path()

    names = ["doc_id", "piece", "start", "length", "ids", "task", "rank_in_task"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path).encode_all, TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = int(end_id).to_bytes(4, "little")
        for batch in arrow_slices(batches, TEXTS):
            rows, of = [], []
            for i, own in enumerate(encode(batch.column("text"))):
                ids = own + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    length = len(part) // 4
                    rows.append((piece, start // 4, length, part, task, seen[length]))
                    of.append(i)
                    seen[length] += 1
            # Ids stay as they are: a null beside them would make them floats elsewhere.
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, rank_in_task long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep: dict[str, Column] | None = None) -> DataFrame:
    """Places every piece: doc_id, piece, start, length, the columns of `keep` (by default the ids), sequence_id and offset.

    A null or empty text is a piece of end_id alone. Repeated rows are packed as often as they stand; rows of
    equal length are interchangeable, so ties are any way round. An empty table gives an empty one.

    The plan is made on the driver from the histogram of lengths, which has at most `capacity` rows whatever the
    input. A piece finds its place by its rank among those of its length: its rank in its task, after the pieces
    of that length in earlier tasks. These sums grow with the tasks; Spark broadcasts them only below its own limit, and
    else shuffles them and the rows, which are of fixed width unless the ids are kept.
    """
    spark, keep = docs.sparkSession, keep or {"ids": F.col("ids")}
    fixed = ["doc_id", "piece", "start", "length", "task", "rank_in_task"]
    pieces = materialize(cut(docs, path, capacity, end_id).select(*fixed, *[c.alias(k) for k, c in keep.items()]), "pieces", batch=TEXTS)
    with Scratch():
        counts = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        places = plan(histogram, capacity)
        earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        before = materialize(counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before", keep=True)
    ranked = pieces.join(before, ["task", "length"])
    by_length = {k: v[["low", "each", "sequence", "offset"]].to_numpy() for k, v in places.groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(lengths), 2), np.int64)
        values, ranks = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(values):
            rows = np.flatnonzero(values == length)
            low, each, sequence, offset = by_length[length][np.searchsorted(by_length[length][:, 0], ranks[rows], side="right") - 1].T
            out[rows, 0] = sequence + (ranks[rows] - low) // each
            out[rows, 1] = offset + (ranks[rows] - low) % each * length
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    out = ranked.withColumn("place", placed("length", F.col("before") + F.col("rank_in_task")))
    return out.select("doc_id", "piece", "start", "length", *keep, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pack() with its ids; a sequence has at most `capacity` ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["ids"])), ""))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", joined.alias("ids"))
