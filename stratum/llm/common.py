"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import durable, purge, shared_folder  # noqa: F401

#: White space that separates words; fixed value: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``; also makes this package importable on the workers."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Python workers take large arrays straight from the system, so that freeing gives them back.
ALLOCATION = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Put the package's parent folder on the Python workers' path, and set how they take memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env.update(ALLOCATION)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: texts are long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a bounded number of rows; made from Arrow, it starts no Python workers of its own on the executors."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(kind)
    made = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kind)], kind)
    return spark.createDataFrame(made, schema)


def crc_mod(column: str, n: int):
    """crc32 of an integer column as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id reachable.

    Large star and small star steps alternate until the edges stop changing.
    Each step aggregates with a minimum before it joins; the joined side then
    has one row for a node, so that a node with very many links is a skewed join
    of short rows, which adaptive execution splits, and never a list.
    Rounds grow with the logarithm of the longest path.
    """
    edges = durable(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0x3FFFFFF)), F.sum(F.xxhash64("v", "u").bitwiseAND(0x3FFFFFF))).first()
        if now == mark:
            break
        mark = now
    lows = edges.groupBy("u").agg(F.min("v").alias("component"))
    return lows.select(F.col("u").alias("id"), "component").union(
        lows.select(F.col("component").alias("id"), "component").distinct()
    )


def grouped(texts: list[str], size: int):
    group, n = [], 0
    for text in texts:
        group.append(text)
        n += len(text)
        if n > size:
            yield group
            group, n = [], 0
    if group:
        yield group


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        base = 0x5851F42D4C957F2D
        size = max(n, 1 << 16)
        _powers.clear()
        for x in (base, pow(base, -1, 1 << 64)):
            each = np.full(size, x, np.uint64)
            each[0] = 1
            _powers.append(np.cumprod(each, dtype=np.uint64))
    return _powers[0], _powers[1]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: differences of prefix sums of byte * base^place, moved to place 0 and mixed."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def pool_adjacent(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Weighted least squares fit of a non-decreasing sequence."""
    out: list[list[float]] = []
    for w, m in zip(weights, means):
        out.append([w, m, 1])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            w2, m2, n2 = out.pop()
            w1, m1, n1 = out.pop()
            out.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.repeat([m for _, m, _ in out], [n for _, _, n in out])


def pieces(batches, rows: int = 1024, size: int = 1 << 23):
    """Record batches cut to at most ``rows`` and, unless one row is larger, ``size`` bytes of text, so that few texts are Python strings at a time."""
    for batch in batches:
        lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        total = np.cumsum(sum(lengths), dtype=np.int64) if lengths else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def tidied(f: Callable) -> Callable:
    """``f`` over a task's batches; freed memory goes back to the system when it ends, so that a waiting worker keeps no more than its caches."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run


_kept: dict[str, tuple[object, object]] = {}


def kept(name: str, key: object, make: Callable):
    """A cache of this Python worker for ``key``; the worker keeps one cache only, whatever operators it serves."""
    if name not in _kept or _kept[name][0] != key:
        _kept.clear()
        _kept[name] = (key, make())
    return _kept[name][1]


def string_column(batch, name: str) -> list[str]:
    """Texts of an Arrow batch as Python strings; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
