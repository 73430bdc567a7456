"""Digests and compressed sizes of ordered byte streams.

A stream is the concatenation of a group's files in path order. Its compressed
size has no partial form, so a stream and an encoder are one task's work: rows
are dealt by group, sorted within partitions by group and path, and fed to
incremental encoders; memory is a row and the encoders' states (brotli alone,
which is asked for by name, needs its whole stream). Encoders that together
take no longer than the slowest share a pass; others get rows of their own, so
that a long stream's encoders run side by side.
"""

from __future__ import annotations

import hashlib
import heapq
import lzma
import threading
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.expressions import ratio
from ..storage import durable

LEVELS = (1, 3, 9, 19, 22)
ALGORITHMS = ("gzip", "zstd", "brotli", "xz")
PROFILE = ["gzip", "brotli", "xz", *(f"zstd-{n}" for n in LEVELS)]
#: CPU seconds a MB of each encoder on prose, on one machine, and of others; only how tasks are dealt depends on them.
COST = {"brotli": 3.7, "zstd-22": 1.9, "zstd-19": 1.5, "xz": 1.3, "gzip": 0.15, "zstd-9": 0.08}
COST_ELSE = 0.02
#: Streams that are placed by their size, the largest; more than these are dealt by hash.
PLACED = 4096


class _Zstd:
    """One streaming frame without its content size; all levels but 19 flush a block before the end.

    Without a content size, level 19 takes tables of some 90 MB, whatever the
    stream; clearing new ones costs more than a small file's compression.
    ``kept`` holds compressors whose tables serve one stream after another
    (never two at a time).
    """

    def __init__(self, level: int, kept: dict):
        import zstandard

        self.flush = level != 19
        self.block = zstandard.COMPRESSOBJ_FLUSH_BLOCK
        if level not in kept:
            kept[level] = zstandard.ZstdCompressor(level=level)
        self.out = kept[level].compressobj()
        self.n = 0

    def update(self, data: bytes) -> None:
        self.n += len(self.out.compress(data))

    def size(self) -> int:
        if self.flush:
            self.n += len(self.out.flush(self.block))
        return self.n + len(self.out.flush())


class _Stream:
    """gzip and xz: incremental encoders of the standard library."""

    def __init__(self, out, flush: bool = False):
        self.out, self.n, self.flush = out, 0, flush

    def update(self, data: bytes) -> None:
        self.n += len(self.out.compress(data))

    def size(self) -> int:
        if self.flush:
            self.n += len(self.out.flush(zlib.Z_SYNC_FLUSH))
        return self.n + len(self.out.flush())


class _Brotli:
    def __init__(self):
        self.whole = bytearray()

    def update(self, data: bytes) -> None:
        self.whole += data

    def size(self) -> int:
        return pa.Codec("brotli", compression_level=11).compress(pa.py_buffer(self.whole)).size


def encoder(name: str, kept: dict | None = None):
    """By name: zstd-LEVEL, gzip, xz, brotli. ``kept`` lends its compressors to one stream at a time."""
    if name.startswith("zstd-"):
        return _Zstd(int(name[5:]), {} if kept is None else kept)
    if name == "gzip":
        return _Stream(zlib.compressobj(9, zlib.DEFLATED, 31), flush=True)
    if name == "xz":
        return _Stream(lzma.LZMACompressor(lzma.FORMAT_XZ, lzma.CHECK_CRC64, preset=9))
    if name == "brotli":
        return _Brotli()
    raise ValueError(f"no encoder {name}")


_thread = threading.local()


def compressed_size(data: bytes, name: str = "zstd-19") -> int:
    if not hasattr(_thread, "kept"):
        _thread.kept = {}
    one = encoder(name, _thread.kept)
    one.update(data)
    return one.size()


def lanes(encoders: list[str]) -> list[list[str]]:
    """Encoders in as few lists as keep each list's cost within the dearest encoder's."""
    cost = lambda some: sum(COST.get(n, COST_ELSE) for n in some)
    out: list[list[str]] = []
    for name in sorted(encoders, key=lambda n: -cost([n])):
        room = next((x for x in out if cost([*x, name]) <= cost(out[0])), None)
        if room is None:
            out.append([name])
        else:
            room.append(name)
    return out


def places(sizes: list[int], costs: list[float], tasks: int) -> tuple[list[list[int]], int]:
    """For each stream the task of each lane, and the number of tasks: the dearest first, each to the task with least to do; tasks in order of what they have to do."""
    units = sorted(((size * c, i, j) for i, size in enumerate(sizes) for j, c in enumerate(costs)), reverse=True)
    load = [(0.0, t) for t in range(max(1, min(tasks, len(units))))]
    held: list[tuple[int, int, int]] = []
    for cost, i, j in units:
        had, t = heapq.heappop(load)
        heapq.heappush(load, (had + cost, t))
        held.append((i, j, t))
    rank = {t: n for n, (_, t) in enumerate(sorted(load, reverse=True))}
    out = [[0] * len(costs) for _ in sizes]
    for i, j, t in held:
        out[i][j] = rank[t]
    return out, len(load)


def _dealt(files: DataFrame, keys: list[str], order: list[str], costs: list[float], spans: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Every row once for each lane, as ``_lane``; a stream and a lane to one task, sorted. ``spans``: the first lane and the end of each value of the first key, if not all are for all."""
    spark = files.sparkSession
    every = files.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("_bytes"))
    top = every.orderBy(F.desc("_bytes")).limit(PLACED).collect()
    some = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [spans[r[keys[0]]] if spans else (0, len(costs)) for r in top]
    flat, tasks = places([r["_bytes"] * c for r, (a, b) in zip(top, own) for c in costs[a:b]], [1.0], some)
    units = iter(flat)
    at = [[next(units)[0] for _ in range(a, b)] for a, b in own]
    kept = {f"_k{i}": files.schema[k].dataType for i, k in enumerate(keys)}
    kind = StructType([*(StructField(n, t) for n, t in kept.items()), StructField("_at", ArrayType(IntegerType()))])
    rows = [[r[k] for r in top] for k in keys] + [at]
    place = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(rows, to_arrow_schema(kind))], schema=to_arrow_schema(kind)), kind)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & files[k].eqNullSafe(place[f"_k{i}"])
    more = some if len(top) == PLACED else 1
    # a stream that isn't placed goes behind those that are
    hashed = F.array(*(F.pmod(F.hash(*keys, F.lit(j)), F.lit(more)) + tasks for j in range(len(costs))))
    base = F.lit(0)
    if spans:
        here = lambda of: F.coalesce(*(F.when(F.col(keys[0]) == v, F.lit(of(a, b))) for v, (a, b) in spans.items()))
        base, hashed = here(lambda a, b: a), F.slice(hashed, here(lambda a, b: a + 1), here(lambda a, b: b - a))
    wanted = [*keys, *(c for c in order if c not in keys), "content"]
    both = files.select(*wanted).join(F.broadcast(place), same, "left")  # at most PLACED rows
    return (
        both.select(*wanted, F.posexplode(F.coalesce("_at", hashed)).alias("_lane", "_task"))
        .withColumn("_lane", F.col("_lane") + base)
        .repartitionById(tasks + more, F.col("_task"))
        .drop("_task")
        .sortWithinPartitions("_lane", *keys, *order)
    )


def stream_sizes(files: DataFrame, keys: list[str], order: list[str], encoders: list[str] | dict[str, list[str]]) -> DataFrame:
    """(keys, file_count, original_bytes, sha256, sizes map<string,bigint>) of each group's stream; ``encoders`` by value of the first key, if not the same for all."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    sides, spans = [], None
    if isinstance(encoders, dict):
        spans = {}
        for value, names in encoders.items():
            had, sides = len(sides), [*sides, *lanes(names)]
            spans[value] = (had, len(sides))
    else:
        sides = lanes(encoders)

    def close(key, state):
        count, size, digest, made = state
        return {**dict(zip(keys, key[1:])), "file_count": count, "original_bytes": size, "sha256": digest.hexdigest(), "sizes": [(n, e.size()) for n, e in made.items()]}

    def feed(batches):
        schema, kept = None, {}
        key, state = None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [*(pa.field(k, batch.schema.field(k).type) for k in keys), ("file_count", pa.int64()), ("original_bytes", pa.int64()),
                     ("sha256", pa.string()), ("sizes", pa.map_(pa.string(), pa.int64()))]
                )
            done = []
            columns = [batch.column(k).to_pylist() for k in ("_lane", *keys)]
            for i, content in enumerate(batch.column("content")):
                own = tuple(c[i] for c in columns)
                if state is None or own != key:
                    if state is not None:
                        done.append(close(key, state))
                        if own[0] != key[0]:
                            kept.clear()  # level 22 holds some 700 MB, which the next lane has no use for
                    key, state = own, [0, 0, hashlib.sha256(), {n: encoder(n, kept) for n in (sides[own[0]] if sides else ())}]
                data = content.as_py() or b""
                state[0] += 1
                state[1] += len(data)
                state[2].update(data)
                for e in state[3].values():
                    e.update(data)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([close(key, state)], schema)

    if sides:
        dealt = _dealt(files, keys, order, [sum(COST.get(n, COST_ELSE) for n in x) for x in sides], spans)
    else:
        plain = files.select(*keys, *[c for c in order if c not in keys], "content")
        dealt = plain.withColumn("_lane", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys, *order)
    made = dealt.mapInArrow(feed, f"{kinds}, file_count bigint, original_bytes bigint, sha256 string, sizes map<string,bigint>")
    if len(sides) < 2:
        return made
    first = [F.first(c).alias(c) for c in ("file_count", "original_bytes", "sha256")]  # each lane has read the same stream
    return made.groupBy(*keys).agg(*first, F.map_from_entries(F.flatten(F.collect_list(F.map_entries("sizes")))).alias("sizes"))


def file_metric(files: DataFrame, keys: list[str]) -> DataFrame:
    """The stream metric of each row by itself, where it is read."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def measure(batches):
        for batch in batches:
            rows = [(len(x), hashlib.sha256(x).hexdigest(), compressed_size(x)) for x in (c.as_py() or b"" for c in batch.column("content"))]
            sizes, digests, made = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array([1] * len(rows), pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(made, pa.int64())],
                [*keys, "file_count", "original_bytes", "sha256", "size"],
            )

    found = files.select(*keys, "content").mapInArrow(measure, f"{kinds}, file_count bigint, original_bytes bigint, sha256 string, size bigint")
    return _metric(found, keys, F.col("size"))


def stream_metric(files: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, file_count, original_bytes, compressed_bytes, ratio, savings, sha256) by zstd at level 19."""
    return _metric(stream_sizes(files, keys, order or ["path"], ["zstd-19"]), keys, F.col("sizes")["zstd-19"])


def _metric(made: DataFrame, keys: list[str], size: Column) -> DataFrame:
    return made.select(*keys, "file_count", "original_bytes", size.alias("compressed_bytes"), *_shares(size, F.col("original_bytes")), "sha256")


def _shares(part: Column, whole: Column) -> list[Column]:
    return [ratio(part, whole).alias("ratio"), (1 - ratio(part, whole)).alias("savings")]


def compression_profile(files: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Algorithms, the zstd curve, consensus ratio and spread of each group's stream."""
    return _profile(stream_sizes(files, keys, order or ["path"], PROFILE), keys)


def whole_and_languages(files: DataFrame, profile: bool) -> tuple[DataFrame, DataFrame]:
    """The profile of each corpus (or its stream metric alone) and the stream metric of each corpus and language.

    All are dealt together and made once, so that the dearest of all begins
    first: of two jobs the one that is ready first would hold the cores.
    """
    part = lambda c: F.when(F.col("kind") == "language", F.col(c)).alias(c)
    kinds = F.explode(F.array(F.lit("corpus"), F.lit("language"))).alias("kind")
    both = files.select("corpus", "lang_ord", "language", "path", "content", kinds).select("kind", "corpus", part("lang_ord"), part("language"), "path", "content")
    names = {"corpus": PROFILE if profile else ["zstd-19"], "language": ["zstd-19"]}
    made = durable(stream_sizes(both, ["kind", "corpus", "lang_ord", "language"], ["path"], names))
    whole, languages = (made.where(F.col("kind") == k) for k in names)
    size = F.col("sizes")["zstd-19"]
    return _profile(whole, ["corpus"]) if profile else _metric(whole, ["corpus"], size), _metric(languages, ["corpus", "lang_ord", "language"], size)


def _profile(made: DataFrame, keys: list[str]) -> DataFrame:
    whole = F.col("original_bytes")
    at = lambda n: F.col("sizes")[n]
    algorithms = F.array(
        *(
            F.struct(F.lit(a).alias("algorithm"), F.lit(c).alias("configuration"), at(n).alias("compressed_bytes"), ratio(at(n), whole).alias("ratio"))
            for a, c, n in (("gzip", "level=9", "gzip"), ("zstd", "level=19", "zstd-19"), ("brotli", "quality=11,lgwin=22", "brotli"), ("xz", "preset=9,check=crc64", "xz"))
        )
    )
    curve = F.array(
        *(F.struct(F.lit(n).alias("level"), at(f"zstd-{n}").alias("compressed_bytes"), ratio(at(f"zstd-{n}"), whole).alias("ratio")) for n in LEVELS)
    )
    profile = made.select(*keys, "file_count", "original_bytes", "sha256", algorithms.alias("algorithms"), curve.alias("zstd_curve"))
    return profile.select("*", *consensus(F.transform("algorithms", lambda a: a["ratio"])))


def profile_metric(profile: DataFrame) -> DataFrame:
    """The stream metric of a compression profile by corpus, which has compressed the same stream."""
    size = F.filter("zstd_curve", lambda x: x["level"] == 19)[0]["compressed_bytes"]
    return _metric(profile, ["corpus"], size)


def consensus(ratios: Column) -> list[Column]:
    """Mean of the middle two of four ratios, and their spread."""
    r = F.array_sort(ratios)
    return [((r[1] + r[2]) / 2).alias("consensus_ratio"), (r[3] - r[0]).alias("ratio_spread")]
