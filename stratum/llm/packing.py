"""Best-fit packing of token sequences with large-item matching.

Documents longer than the capacity are cut into pieces of exactly the
capacity, the remainder first. How a piece is placed depends on its length
alone, so the plan is made from the number of pieces of each length: at most
``capacity`` counts, whatever the input.

* Pieces above a third of the capacity fit at most two to a sequence. The
  larger half take, longest first, the longest partner that still fits;
  partners that are left pair among themselves.
* Smaller pieces follow by falling length, each into the fullest sequence
  with room for it.

The plan is a list of runs: the pieces of one length with ranks
[rank, rank + n) go to consecutive sequences, ``per`` to each. A run empties a
group of sequences or ends a length, and a group that is used again has less
than half the room it had, so there are at most about
3 * capacity * log2(capacity) runs; that table is broadcast.

Ranks are counted per partition and length while the documents are tokenised;
offsets between partitions come from the (partition, length) counts. No group
of equal lengths is ever gathered.

Null text counts as empty (one id: the end mark). Equal rows are packed as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import durable, importable, pieces, small_table, string_column, table, tidied
from .tokens import worker

CAPACITY = 2048
END = 0


class _Bins:
    """Groups of equally full sequences, by the room that they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.groups:
                insort(self.rooms, room)
                self.groups[room] = []
            self.groups[room].append((first, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Up to ``n`` sequences with exactly this room."""
        first, there = self.groups[room].pop()
        if there > n:
            self.groups[room].append((first + n, there - n))
        elif not self.groups[room]:
            del self.groups[room]
            self.rooms.remove(room)
        return first, min(n, there)

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def run(self, length: int, rank: int, n: int, first: int, per: int, offset: int) -> None:
        self.runs.append((length, rank, n, first, per, offset))


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, rank, n, first, per, offset) for so many pieces of each length, and the number of sequences."""
    out = _Bins(capacity)
    left = {k: n for k, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)

    def place(length: int, n: int, first: int, offset: int, per: int = 1) -> None:
        out.run(length, rank[length], n, first, per, offset)
        rank[length] += n
        left[length] -= n

    large = sorted((k for k in left if 2 * k > capacity), reverse=True)
    middle = sorted(k for k in left if 3 * k > capacity and 2 * k <= capacity)
    for length in large:
        while left[length]:
            at = bisect_left(middle, capacity - length + 1) - 1
            if at < 0:
                n = left[length]
                first = out.open(n)
                place(length, n, first, 0)
                out.put(capacity - length, first, n)
                continue
            partner = middle[at]
            n = min(left[length], left[partner])
            first = out.open(n)
            place(length, n, first, 0)
            place(partner, n, first, length)
            out.put(capacity - length - partner, first, n)
            if not left[partner]:
                middle.remove(partner)
    while middle:  # two of any of these fit together
        length = middle[-1]
        n = left[length]
        if n > 1:
            first = out.open(n // 2)
            place(length, n // 2 * 2, first, 0, per=2)
            out.put(capacity - 2 * length, first, n // 2)
        if left[length]:
            first = out.open(1)
            place(length, 1, first, 0)
            room = capacity - length
            if len(middle) > 1:
                partner = middle[-2]
                place(partner, 1, first, length)
                room -= partner
                if not left[partner]:
                    del middle[-2]
            out.put(room, first, 1)
        middle.pop()

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(out.rooms, length)
            if at == len(out.rooms):
                n = -(-left[length] // (capacity // length))
                out.put(capacity, out.open(n), n)
                continue
            room = out.rooms[at]
            per = room // length
            full, rest = divmod(left[length], per)
            if full:
                first, n = out.take(room, full)
                place(length, n * per, first, capacity - room, per)
                out.put(room - per * length, first, n)
            else:
                first, _ = out.take(room, 1)
                place(length, rest, first, capacity - room, rest)
                out.put(room - rest * length, first, 1)
    return out.runs, out.bins


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_dealt", T.IntegerType()),
        T.StructField("_rank", T.LongType()),
    ]
)


def cut_pieces(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of every document, with their rank among those of one length in their partition."""
    schema = T.StructType([docs.schema[key], *PIECES.fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    end = np.asarray([END], "<u4")

    def cut(batches):
        units, dealt, ranks = worker(path, False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches):
            rows = []
            for at, ids in enumerate(units.of_many(string_column(batch, text))):
                ids = np.append(ids, end)
                n, start, piece = len(ids), 0, 0
                while start < n:
                    size = min(n, n % capacity or capacity) if start == 0 else capacity
                    part = ids[start : start + size].tobytes()
                    rows.append((at, piece, start, size, zlib.crc32(part), dealt, int(ranks[size]), part))
                    ranks[size] += 1
                    start, piece = start + size, piece + 1
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [batch.column(key).take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:7], kinds))]
                if keep_ids:
                    arrays.append(pa.array(cols[7], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(key, text).mapInArrow(tidied(cut), schema)


def pack(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    spark = docs.sparkSession
    importable(spark)
    pieces = durable(cut_pieces(docs, path, key=key, text=text, capacity=capacity, keep_ids=keep_ids))
    dealt = durable(pieces.groupBy("length", "_dealt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    before = Window.partitionBy("length").orderBy("_dealt").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.select("length", "_dealt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    names = "length long, _at long, _n long, _first long, _per long, _offset long"
    placed = small_table(spark, runs, names)
    rank = F.col("_base") + F.col("_rank")
    seat = rank - F.col("_at")
    return (
        pieces.join(base.hint("merge"), ["length", "_dealt"])  # as many rows as partitions times lengths: never broadcast
        .withColumn("_r", rank)
        .join(F.broadcast(placed), "length")
        .where((F.col("_r") >= F.col("_at")) & (F.col("_r") < F.col("_at") + F.col("_n")))
        .select(
            key, "piece", "start", "length", "ids_crc32",
            (F.col("_first") + F.floor(seat / F.col("_per"))).alias("sequence_id"),
            (F.col("_offset") + F.pmod(seat, F.col("_per")) * F.col("length")).alias("offset"),
            *(["ids"] if keep_ids else []),
        )
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
