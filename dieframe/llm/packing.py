"""Best-fit packing planned on a histogram of lengths.

1. Each task writes its pieces with their number among the task's pieces of the same length. Counts by task and length,
   summed up over tasks, give every piece its rank within its length without a task that sees a whole length.
2. The histogram, one count for each length up to the capacity, is all that the plan needs: best fit decreasing over
   counts. Sequences with equal room are a range of numbers; a step places as many pieces of a length as there are
   sequences in the tightest range they fit. So the plan's size follows the capacity, never the number of pieces.
3. The plan says for ranges of ranks within a length which sequences they go to and where. It is cut by the tasks'
   shares of the ranks, and pieces take their slots by a join on task and length, and their rank's range.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bpe
from .common import batch_of, cut, released, sized, table

MOST_LENGTHS = 1 << 16  #: capacities up to this, so that the histogram and the plan stay small
RANKS = 46  #: bits of a rank within a length
SLOT = ("slot_task", "slot_length", "slot_low", "slot_high", "slot_shift", "slot_offset")


def plan(many: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: length, first rank, how many, first sequence, offset.

    Ranks of a length and sequences are numbered from 0; pieces of such a range go to sequences in a row, one each,
    all at one offset.
    """
    out = []
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence, how many
    rooms: list[int] = []  # ascending, those that have ranges
    n = 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, count))

    for length in sorted(many, reverse=True):
        rank, left = 0, many[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
                used, layers = min(left, count), 1
                leave(room, first + used, count - used)
            else:  # a new sequence is filled before the next one: all full ones, then what is left
                room, first, layers = capacity, n, min(left, capacity // length)
                used = left // layers
                n += used
            for k in range(layers):
                out.append((length, rank, used, first, capacity - room + k * length))
                rank, left = rank + used, left - used
            leave(room - layers * length, first, used)
    return out


def ordinals(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; `seen` counts those of each length and is brought up to date."""
    order = np.argsort(length, kind="stable")
    kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(seen[kinds], count)
    seen[kinds] += count
    return out


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset (long) to any pieces that have a length from 1 to `capacity`.

    The pieces of a sequence lie gapless from offset 0 and are together at most `capacity` long; there are as many
    sequences as best fit decreasing needs. Sequence ids are numbers from 0. Other columns and repeated rows are kept;
    a column named like an added one (sequence_id, offset, or the inner pack_task, pack_ordinal) is an error, and so
    is a length that is null or out of bounds. An empty table gives no rows. pieces is computed once, and stored.
    """
    if not 0 < capacity <= MOST_LENGTHS:
        raise ValueError(f"capacities go from 1 to {MOST_LENGTHS}")
    clash = {"sequence_id", "offset", "pack_task", "pack_ordinal"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"columns that exist already: {sorted(clash)}")
    names = pieces.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(names.index(length_col)).cast(pa.int64()).fill_null(0).to_numpy()
            if len(length) and not 0 < length.min() <= length.max() <= capacity:
                raise ValueError(f"lengths go from 1 to {capacity}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int64)), pa.array(ordinals(length, seen))], names=[*names, "pack_task", "pack_ordinal"])

    numbered = cut(pieces.mapInArrow(number, StructType([*pieces.schema.fields, StructField("pack_task", LongType()), StructField("pack_ordinal", LongType())])))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(F.col("pack_task").alias("task"), F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n"))
    shares = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))))
    many = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    made = np.array(plan(many, capacity), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(made[np.lexsort((made[:, 1], made[:, 0]))])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the plan by a task's share of the ranks of a length; low and high are ordinals in the task."""
        length, rank, count, first, offset = shared.value.T
        key = length << RANKS | rank
        for batch in batches:
            task, size, n, before = (c.to_numpy() for c in batch.columns)
            a = np.searchsorted(key, size << RANKS | before, "right") - 1
            many = np.searchsorted(key, size << RANKS | (before + n)) - a
            row = np.repeat(np.arange(len(task)), many)
            at = np.repeat(a, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low, high = np.maximum(0, rank[at] - before[row]), np.minimum(n[row], rank[at] + count[at] - before[row])
            made = (task[row], size[row], low, high, first[at] - rank[at] + before[row], offset[at])
            yield batch_of(dict(zip(SLOT, made)), **dict.fromkeys(SLOT, pa.int64()))

    planned = shares.select("task", "length", "n", "before").mapInArrow(slots, ", ".join(f"{c} long" for c in SLOT)).hint("merge")  # it grows with the tasks
    here = (F.col("pack_task") == F.col("slot_task")) & (F.col(f"`{length_col}`") == F.col("slot_length"))
    placed = numbered.join(planned, here & (F.col("pack_ordinal") >= F.col("slot_low")) & (F.col("pack_ordinal") < F.col("slot_high")))
    return placed.select(*(f"`{c}`" for c in names), (F.col("pack_ordinal") + F.col("slot_shift")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids: each document's ids and the id `end`, cut only where it is longer than `capacity`.

    ids are little-endian unsigned 32-bit integers, as `bpe.encode` gives them; null without with_ids. Null and empty
    texts are `end` alone. Repeated rows and ids give pieces of their own; other columns are left out.
    """
    shared = bpe.shared_vocabulary(docs.sparkSession, path)
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(shared)
        for part in sized(batches, 1, 2048, bpe.SLICE):
            ids, edge = words.encode_column(part.column(1))
            ids = np.insert(ids, edge[1:], end)
            size = np.diff(edge) + 1
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), many)
            k = bpe.expand(np.zeros(len(size), np.int64), many)
            length = np.minimum(capacity, size[doc] - k * capacity)
            at = 4 * bpe.upto(length)
            whole = memoryview(ids.tobytes())
            one = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            rows = {"doc_id": part.column(0).take(pa.array(doc)), "piece": k, "start": k * capacity, "length": length, "ids_crc32": [*map(zlib.crc32, one)]}
            yield batch_of(rows | {"ids": [*map(bytes, one)] if with_ids else [None] * len(one)}, **kinds)
        words.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length and ids of each sequence of packed pieces that have their ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "n_pieces", "length", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids")
    )


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document, packed by 2048 tokens.

    Null texts count as empty: one piece of the end id. See `token_pieces` and `pack` for other cases.
    """
    return pack(token_pieces(table(spark, sf_dir, "documents"), bpe.default_path(), with_ids=False).drop("ids"))
