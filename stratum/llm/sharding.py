"""Sharding by extendible hashing, with DataFrame operations only.

A row's bucket is a prefix of the bits of its key's hash. The directory starts
with one empty prefix; a bucket that is over the byte limit splits on the next
bit, and no other bucket does, until every shard fits. All levels are found at
once: bytes are summed for the finest cells first, and the coarser buckets from
those few sums, so rows are aggregated once and their texts never move.

A shard with one row stays whole even if the row alone exceeds the limit
(``oversize``). Rows of one key have one hash and cannot be parted by it: a
bucket of them that is over the limit splits again by a second hash of key, text
and a row number. Null keys hash as empty text, null texts count 0 bytes; equal
rows are kept. An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Bits of a hash.
BITS = 60
#: Finer than one shard by so many bits when cells are first summed.
SPARE = 4
LIMIT = 1 << 20


def hash_bits(column):
    """The first 60 bits of the MD5 of a column as text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _depths(cells: DataFrame, depth: int, limit: int) -> DataFrame:
    """(cell, depth) of the bucket that each cell of ``depth`` bits ends in; -1 where the cell itself is over the limit."""
    ups = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    ups = ups.withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
    over = ups.groupBy("d", "p").agg(F.sum("bytes").alias("_b"), F.sum("rows").alias("_n")).where((F.col("_b") > limit) & (F.col("_n") > 1))
    deepest = ups.join(over, ["d", "p"]).groupBy("cell").agg(F.max("d").alias("_d"))
    found = cells.join(deepest, "cell", "left").select("cell", (F.coalesce("_d", F.lit(-1)) + 1).alias("depth"))
    return found.select("cell", F.when(F.col("depth") > depth, -1).otherwise(F.col("depth")).cast("int").alias("depth"))


def _bucketed(rows: DataFrame, limit: int, total: int) -> tuple[DataFrame, bool]:
    """Rows (h, n_bytes, ...) with their depth, -1 for rows whose bucket is over the limit at ``BITS`` bits; whether there are such."""
    depth = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SPARE)
    done = None
    while True:
        named = rows.withColumn("cell", F.expr(f"shiftright(h, {BITS - depth})"))
        cells = durable(named.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")))
        depths = durable(_depths(cells, depth, limit))
        out = named.join(depths, "cell").drop("cell")
        left = depths.where("depth < 0").limit(1).count() > 0
        if not left or depth == BITS:
            return (out if done is None else done.unionByName(out)), left
        # only the rows of cells that are still over the limit go on, with more bits
        fine = out.where("depth >= 0")
        done = fine if done is None else done.unionByName(fine)
        rows = durable(out.where("depth < 0").drop("depth"))
        depth = min(BITS, depth + 8)


def extendible_shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, keep: list[str] = ()) -> DataFrame:
    """(key, n_bytes, depth, bucket, shard, oversize[, row]) of every row.

    bucket is the prefix as a number, shard its bits as text (with those of the
    second hash after a slash where a key's rows had to part). row holds the
    columns of ``keep``, so that rows of one key in different shards can be told
    apart. The limit is of the texts' bytes.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    row = [F.struct(*keep).alias("row")] if keep else []
    held = ["row"] if keep else []
    rows = durable(docs.select(key, size.alias("n_bytes"), hash_bits(F.col(key)).alias("h"), F.xxhash64(text).alias("_t"), *row))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    found, stuck = _bucketed(rows, limit, total)
    name = lambda h, d: F.expr(f"substring(lpad(conv({h}, 10, 2), {BITS}, '0'), 1, {d})")
    plain = found.where("depth >= 0").select(
        key, "n_bytes", "h", "depth", F.expr(f"shiftright(h, {BITS} - depth)").alias("bucket"), name("h", "depth").alias("shard"), *held
    )
    if stuck:
        numbered = durable(found.where("depth < 0").withColumn("_row", F.monotonically_increasing_id()))
        again = numbered.select(
            key, "n_bytes", F.col("h").alias("_h"), hash_bits(F.concat_ws(":", F.col(key).cast("string"), F.col("_t"), F.col("_row"))).alias("h"), *held
        )
        # the buckets of different keys share the second directory's levels but never a shard
        parted, _ = _bucketed(again, limit, total)
        plain = plain.unionByName(
            parted.select(
                key, "n_bytes", F.col("_h").alias("h"), F.lit(BITS).alias("depth"), F.col("_h").alias("bucket"),
                F.concat_ws("/", name("_h", str(BITS)), name("h", "depth")).alias("shard"), *held,
            )
        )
    return plain.select(key, "n_bytes", "depth", "bucket", "shard", (F.col("n_bytes") > limit).alias("oversize"), *held)


def write_shards(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Every row of ``docs``, all its columns, as Parquet in one folder for each shard."""
    found = extendible_shards(docs, key=key, text=text, limit=limit, keep=docs.columns)
    folder = F.regexp_replace("shard", "/", "-").alias("shard_id")
    # a shard is at most the limit or one row, so one task may write it
    found.select("row.*", folder).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
d AS (SELECT unnest(range(0, {BITS + 1})) AS d),
b AS (SELECT d, h >> ({BITS} - d) AS p, sum(n_bytes) AS bytes, count(*) AS n FROM r, d GROUP BY ALL),
leaf AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(b.d) AS depth FROM r, b
  WHERE b.p = r.h >> ({BITS} - b.d) AND (b.bytes <= {LIMIT} OR b.n = 1) GROUP BY ALL)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, h >> ({BITS} - depth) AS bucket,
  left(right(repeat('0', {BITS}) || bin(h), {BITS}), CAST(depth AS INTEGER)) AS shard, n_bytes > {LIMIT} AS oversize
FROM leaf
"""
