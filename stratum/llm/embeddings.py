"""Near duplicates among embedding vectors by int8 tile products with error bounds.

Equal vectors are one representative with a multiplicity. Each
representative x, scaled to length one, is quantised once: int8 values q and a
scale s with its exact error e = |x - s q|, and int8 values of what that leaves
with an error f. For two of them |x.y - (s q).(t r)| <= e_y + e_x |t r|, so an
int8 product decides every pair whose distance to the threshold exceeds that
bound; pairs that it leaves open are multiplied again with the second values,
and pairs that are open even then are computed in double precision from
the given numbers.

Representatives are dealt by hash into tiles; a task takes two tiles, two bytes
a dimension, counts the links of its rows and labels what they connect. It
returns a row for a vector that has links and never the linked pairs, so a group
of near copies costs no more rows than any other vectors; only open pairs (those
within some 10^-4 of the threshold) are rows, and only their vectors are sent
in full. Work is quadratic in the number of distinct vectors: rows per
tile grow with it up to ``TILE`` rows or ``TILE_BYTES``, so that each vector is sent
to as few tasks as memory allows.

Vectors that are null, of length zero, or hold null or non-finite numbers have
no links and are their own component; so are vectors of unlike dimension to
each other. Equal rows are kept and count as each other's links; rows of one key
with different vectors have the links of their own vector. Numbers are scaled by
powers of two first, so that very large and very small vectors compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, importable, table, tidied

THRESHOLD = 0.9
TILE = 16_384
TILE_BYTES = 32 << 20
BLOCK = 1024
#: Most products that a task holds at once.
PAIRS = 1 << 21
#: Covers rounding of the int8 product in 32-bit floats and of the double product.
SLACK = 2e-6
#: Covers rounding of the second product, in double precision.
FINE = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest number is about one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of any positive length: int8 values, scales, errors, lengths; second int8 values, scales and errors."""
    unit = scaled(x)
    unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    left = unit - back
    fine = np.maximum(np.abs(left).max(1), 1e-300) / 127
    r = np.rint(left / fine[:, None]).astype(np.int8)
    rest = left - r * fine[:, None]
    norm = lambda y: np.sqrt((y * y).sum(1))
    return q, scale, norm(left) + 1e-12, norm(back), r, fine, norm(rest) + 1e-12


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, raw binary, dim): float64 bytes; null for vectors that can't be compared."""

    def keep(batches):
        for batch in batches:
            raw, dim = [], []
            for v in batch.column(vector).to_pylist():
                x = np.asarray(v, np.float64) if v and None not in v else np.zeros(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                raw.append((x + 0.0).tobytes() if good else None)
                dim.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(raw, pa.binary()), pa.array(dim, pa.int32())], [key, "raw", "dim"])

    return vectors.select(key, vector).mapInArrow(tidied(keep), f"`{key}` {vectors.schema[key].dataType.simpleString()}, raw binary, dim int")


NUMBERS = ("scale", "err", "size", "scale2", "err2")


def _quantise(batches):
    for batch in batches:
        raw, dims = batch.column("raw").to_pylist(), batch.column("dim").to_numpy()
        q, r, numbers = [b""] * len(raw), [b""] * len(raw), np.zeros((5, len(raw)))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            a, *some, b, fine, err2 = quantised(np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(-1, dim))
            numbers[:, at] = [*some, fine, err2]
            for i, x, y in zip(at, a, b):
                q[i], r[i] = x.tobytes(), y.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("rep", "many", "dim")), pa.array(q, pa.binary()), pa.array(r, pa.binary()), *map(pa.array, numbers)],
            ["rep", "many", "dim", "q8", "r8", *NUMBERS],
        )


class _Labels:
    """Links counted and folded into labels, block by block, so that memory stays bounded."""

    def __init__(self, rep: np.ndarray, many: np.ndarray):
        self.rep, self.many, self.counts = rep, many.astype(np.float64), np.zeros(len(rep))
        self.order = np.argsort(rep, kind="stable")  # labels compare by representative
        self.label = np.empty(len(rep), np.int64)
        self.label[self.order] = np.arange(len(rep))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.rep)
        self.counts += np.bincount(a, self.many[b], n) + np.bincount(b, self.many[a], n)
        while True:
            label = self.label
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            self.label = np.minimum(label, label[self.order[label]])
            if (before == self.label).all():
                break

    def columns(self) -> dict[str, np.ndarray]:
        some = np.flatnonzero(self.counts > 0)
        return {"rep": self.rep[some], "n": self.counts[some].astype(np.int64), "low": self.rep[self.order[self.label[some]]]}


FOUND = "rep long, n long, low long, p int, q int, other long"
_found = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("other", pa.int64())])


def _table(columns: dict[str, np.ndarray], n: int) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _found}, schema=_found)


def _compare(threshold: float):
    """Rows (rep, n, low) of vectors with links, and (rep, other, p, q) of pairs that stay open."""

    def compare(group: pa.Table) -> pa.Table:
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        dim = group.column("dim")[0].as_py()
        tile, rep = group.column("tile").to_numpy(), group.column("rep").to_numpy()
        labels = _Labels(rep, group.column("many").to_numpy())
        q8, r8 = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int8).reshape(-1, dim) for c in ("q8", "r8"))
        scale, err, size, scale2, err2 = (group.column(c).to_numpy() for c in NUMBERS)
        left_side, right = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        step = max(32, min(BLOCK, PAIRS // max(1, len(right))))
        exact = np.float32 if dim <= 1000 else np.float64  # sums of int8 products stay whole
        turned = q8[right].astype(exact).T
        fine = lambda k: q8[k] * scale[k, None] + r8[k] * scale2[k, None]
        open_a, open_b = [], []
        for at in range(0, len(left_side), step):
            left = left_side[at : at + step]
            near = q8[left].astype(exact) @ turned
            near *= scale[left].astype(exact)[:, None]
            near *= scale[right].astype(exact)[None, :]
            # one bound for the block picks the few pairs that need their own
            i, j = np.nonzero(near >= threshold - SLACK - err[right].max(initial=0) - err[left].max(initial=0) * size[right].max(initial=0))
            if p == q:
                own = left[i] < right[j]
                i, j = i[own], j[own]
            if not len(i):
                continue
            a, b = left[i], right[j]
            value = near[i, j].astype(np.float64)
            bound = err[b] + err[a] * size[b] + SLACK
            keep = value + bound >= threshold
            a, b, value, bound = a[keep], b[keep], value[keep], bound[keep]
            sure = value - bound >= threshold
            for k in np.array_split(np.flatnonzero(~sure), max(1, (~sure).sum() // 50_000)):
                x, y = fine(a[k]), fine(b[k])
                value = (x * y).sum(1)
                bound = err2[b[k]] + err2[a[k]] * np.sqrt((y * y).sum(1)) + FINE
                sure[k] = value - bound >= threshold
                still = k[(value + bound >= threshold) & ~sure[k]]
                open_a.append(a[still])
                open_b.append(b[still])
            labels.link(a[sure], b[sure])
        known = labels.columns()
        out = [_table(known, len(known["rep"]))]
        if open_a:
            a, b = np.concatenate(open_a), np.concatenate(open_b)
            out.append(_table({"rep": rep[a], "other": rep[b], "p": np.full(len(a), p), "q": np.full(len(a), q)}, len(a)))
        return pa.concat_tables(out)

    return compare


def _decide(threshold: float):
    """Links among the open pairs of two tiles, from their vectors in full."""

    def decide(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        rep = vectors.column("rep").to_numpy()
        order = np.argsort(rep)
        raw = vectors.column("raw").to_pylist()
        labels = _Labels(rep, vectors.column("many").to_numpy())
        ends = [order[np.searchsorted(rep[order], pairs.column(c).to_numpy())] for c in ("rep", "other")]
        linked = np.zeros(len(pairs), bool)
        for k in np.array_split(np.arange(len(pairs)), len(pairs) * len(raw[0]) // (1 << 24) + 1):
            x, y = (scaled(np.frombuffer(b"".join([raw[i] for i in e[k]]), np.float64).reshape(len(k), -1)) for e in ends)
            linked[k] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
        labels.link(*(e[linked] for e in ends))
        known = labels.columns()
        return _table(known, len(known["rep"]))

    return decide


def embedding_components(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; see the module's notes. ``key`` is an integer."""
    spark = vectors.sparkSession
    importable(spark)
    rows = durable(_rows(vectors, key, vector).withColumn("digest", F.sha2("raw", 256)))
    some = rows.where("digest is not null")
    # a representative is named by the least key of its rows, or, where that names several, by a number of its own
    reps = some.groupBy("digest").agg(
        F.min(F.col(key).cast("long")).alias("least"), F.count("*").alias("many"), F.first("raw").alias("raw"), F.first("dim").alias("dim")
    )
    reps = durable(reps.withColumn("rep", F.monotonically_increasing_id()))
    n, widest = reps.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = min(tile, max(BLOCK, n // 12), max(32, TILE_BYTES // (2 * widest)))
    tiles = max(1, -(-n // size))
    dealt = durable(reps.select("rep", "many", "raw", "dim").mapInArrow(tidied(_quantise), "rep long, many long, dim int, q8 binary, r8 binary, " + ", ".join(f"{c} double" for c in NUMBERS)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"))
    units = dealt.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    units = units.withColumn("p", F.least("tile", "_s")).withColumn("q", F.greatest("tile", "_s")).drop("_s")
    first = durable(units.groupBy("dim", "p", "q").applyInArrow(_compare(threshold), FOUND))
    found, still = first.where("other is null"), first.where("other is not null").select("rep", "other", "p", "q")
    if still.limit(1).count():
        ends = still.select("p", "q", "rep").union(still.select("p", "q", "other")).distinct()
        whole = durable(ends.join(reps.select("rep", "many", "raw", F.col("dim").alias("_dim")), "rep"))
        pairs = durable(still.join(reps.select("rep", F.col("dim").alias("_dim")), "rep"))
        by = ["_dim", "p", "q"]
        found = found.unionByName(durable(pairs.groupBy(*by).cogroup(whole.groupBy(*by)).applyInArrow(_decide(threshold), FOUND)))
    classes = components(spark, found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of_rep = durable(
        reps.select("digest", "rep", "many", "least")
        .join(counts, "rep", "left")
        .join(classes.withColumnRenamed("id", "rep"), "rep", "left")
        .select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("_c"))
    )
    linked = of_rep.where("n_links > 0")
    lows = linked.groupBy("_c").agg(F.min("least").alias("component_id"))
    # short rows, each join alone in its stage: skewed ones are split
    linked = durable(linked.join(durable(lows), "_c").select("digest", "n_links", "component_id"))
    every = some.select(key, "digest").join(linked, "digest", "left").select(key, "n_links", "component_id")
    every = every.unionByName(rows.where("digest is null").select(key, F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    kind = vectors.schema[key].dataType
    out = every.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component_id"), F.col(key)).cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.col("component_id") == F.col(key).cast(kind))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links, l.c AS component_id, l.c = e.vec_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN many m ON m.a = e.vec_id
"""
