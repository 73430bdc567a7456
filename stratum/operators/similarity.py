"""Relations between two streams, and pairs of similar functions.

A function table has (idx, kind, symbol, content, ...). Candidates share a
64-byte block or kind and symbol; both are equi-joins and meet in a distinct
union, limited before anything is compressed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions as d
from ..functions.expressions import block_fingerprints, gain
from .streams import compressed_size


def by_fingerprint(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, j) of functions that share a block."""
    a = first.select(F.col("idx").alias("i"), F.explode(block_fingerprints(F.col("content"))).alias("fp"))
    b = second.select(F.col("idx").alias("j"), F.explode(block_fingerprints(F.col("content"))).alias("fp"))
    return a.join(b, "fp").select("i", "j").distinct()


def by_symbol(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, j) of functions with one kind and symbol."""
    a = first.select(F.col("idx").alias("i"), "kind", "symbol")
    b = second.select(F.col("idx").alias("j"), "kind", "symbol")
    return a.join(b, ["kind", "symbol"]).select("i", "j")


def candidates(first: DataFrame, second: DataFrame, limit: int = d.CANDIDATES) -> tuple[DataFrame, bool]:
    """The first ``limit`` candidate pairs in order, and whether there are more."""
    every = by_fingerprint(first, second).unionByName(by_symbol(first, second)).distinct()
    found = every.orderBy("i", "j").limit(limit + 1)
    return found.orderBy("i", "j").limit(limit), found.count() > limit


def similarities(first: DataFrame, second: DataFrame, limit: int = d.CANDIDATES) -> tuple[DataFrame, bool]:
    """Sizes and gains of candidate pairs, and whether candidates were cut."""
    pairs, truncated = candidates(first, second, limit)
    both = pairs.join(first.select(F.col("idx").alias("i"), F.col("content").alias("a")), "i").join(
        second.select(F.col("idx").alias("j"), F.col("content").alias("b")), "j"
    )

    def measure(batches):
        for batch in batches:
            rows = [(compressed_size(x), compressed_size(y), compressed_size(x + y), min(len(x), len(y))) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), *(pa.array(c, pa.int64()) for c in columns)], ["i", "j", "first", "second", "combined", "least"])

    kind = lambda c: both.schema[c].dataType.simpleString()
    sized = both.select("i", "j", "a", "b").mapInArrow(measure, f"i {kind('i')}, j {kind('j')}, first long, second long, combined long, least long")
    gains = gain(F.col("first"), F.col("second"), F.col("combined"), F.lit(d.EMPTY_FRAME))
    return sized.select("i", "j", "first", "second", "combined", *gains, (F.col("least") < d.SMALL_SAMPLE).alias("high_variance")), truncated


def relate(files: DataFrame, first: str, second: str) -> DataFrame:
    """Cross-stream gain of two files of one corpus, whichever is named first."""
    from .streams import stream_metric

    lo, hi = sorted([first, second], key=lambda x: x.encode())
    pair = files.where(F.col("path").isin(lo, hi)).select("path", "content")
    side = F.when(F.col("path") == lo, "first").otherwise("second")
    sides = pair.withColumn("side", side).unionByName(pair.withColumn("side", F.lit("combined")))
    found = stream_metric(sides, ["side"]).groupBy().pivot("side", ["first", "second", "combined"]).agg(F.first("compressed_bytes"))
    empty = F.lit(d.EMPTY_FRAME)
    return found.select(
        F.lit(lo).alias("first_path"), F.lit(hi).alias("second_path"), "first", "second", "combined", empty.alias("empty_frame_bytes"),
        *gain(F.col("first"), F.col("second"), F.col("combined"), empty),
    )
