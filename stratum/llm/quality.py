"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every whole text gives ``STATISTICS`` numbers (lengths, character classes,
repetition of words and lines, compressibility, byte entropy). Features
cos(w.x + b) with normal w approximate a Gaussian kernel over the standardised
statistics; ``features`` bounds their number. Normal equations are summed per
partition, then in groups as many as the root of the number of partitions, then
over the groups, so that a task adds few matrices and the driver receives one
for each fold however many rows there are. Labelled rows fall into
``FOLDS`` folds; each fold is scored by the model of the others, and the
isotonic map is fitted to those scores through a histogram of fixed size.

Null and empty texts have statistics of their own (all counts zero) and get a
score like any other. Rows without a label, or with a null label, are scored
but teach nothing; a label held twice counts twice. Without labelled rows of
both classes every score is the share of positives (0.5 without any).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, durable, importable, pieces, pool_adjacent, string_column, table, tidied

FEATURES = 192
FOLDS = 4
BINS = 2048
RIDGE = 1e-4
THRESHOLD = 0.3

_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_sentence = np.zeros(256, bool)
_sentence[[44, 46, 63, 59, 58]] = True
_symbol = ~(_letter | _digit | _space | _sentence)
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """Numbers that describe one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    if not size:
        return [0.0] * STATISTICS
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / size
    letters = max(1, int(hist[_letter].sum()))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    line_set = Counter(lines)
    pairs = set(zip(words, words[1:]))
    triples = max(1, len(words) - 2)
    some = share[share > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(size),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        hist[_upper].sum() / letters,
        float(share[_digit].sum()),
        float(share[_space].sum()),
        float(share[_sentence].sum()),
        float(np.sqrt(share[_symbol].sum())),
        float(np.sqrt(share[33])),
        float(np.sqrt(share[124])),
        float(np.sqrt(hist[10] / size)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(pairs) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples,
        1 - len(line_set) / n_lines,
        np.log1p(size / n_lines),
        len(zlib.compress(raw, 1)) / (size + 20),
        float(-(some * np.log2(some)).sum()),
    ]


def document_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) for every row."""
    importable(docs.sparkSession)

    def describe(batches):
        for batch in pieces(batches):
            rows = [statistics(x) for x in string_column(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.list_(pa.float64()))], [key, "stats"])

    return docs.select(key, text).mapInArrow(tidied(describe), f"`{key}` {docs.schema[key].dataType.simpleString()}, stats array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, STATISTICS))


def _summed(df: DataFrame, sums) -> dict:
    """Blocks that ``sums`` makes of each partition's frames, summed by name in three steps.

    sums(frames) returns {name: array}. Arrays of a name have one shape.
    """
    groups = max(1, round(df.rdd.getNumPartitions() ** 0.5))

    def partial(frames):
        part = TaskContext.get().partitionId() % groups
        for name, block in sums(frames).items():
            yield pd.DataFrame({"part": [part], "name": [name], "block": [np.asarray(block, np.float64).tobytes()]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), np.float64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[-1].as_py()]), pa.array([total.tobytes()])], ["name", "block"])

    kind = "name string, block binary"
    of_groups = df.mapInPandas(partial, f"part int, {kind}").groupBy("part", "name").applyInArrow(merge, kind)
    found = of_groups.groupBy("name").applyInArrow(merge, kind).collect()
    return {r["name"]: np.frombuffer(r["block"], np.float64) for r in found}


class Model:
    """Fitted by ``fit``; small, and the same size for any input."""

    def __init__(self, mean, scale, w, b, coef, edges, values, prior):
        self.mean, self.scale, self.w, self.b, self.coef = mean, scale, w, b, coef
        self.edges, self.values, self.prior = edges, values, prior

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray, fold: int = -1) -> np.ndarray:
        return self.lift(x) @ self.coef[fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.values is None:
            return np.full(len(x), self.prior)
        return np.interp(self.raw(x), self.edges, self.values)


def fit(
    rows: DataFrame, *, features: int = FEATURES, folds: int = FOLDS, bins: int = BINS, ridge: float = RIDGE, seed: int = 7
) -> Model:
    """Fit to rows (stats, label 0/1, fold int)."""

    def moments(frames):
        n, s, q, p = 0, np.zeros(STATISTICS), np.zeros(STATISTICS), 0
        for f in frames:
            x = _matrix(f["stats"])
            n, s, q, p = n + len(x), s + x.sum(0), q + (x * x).sum(0), p + f["label"].sum()
        return {"m": np.concatenate([[n, p], s, q])} if n else {}

    m = _summed(rows, moments).get("m", np.zeros(2 + 2 * STATISTICS))
    n, p = m[:2]
    mean = m[2 : 2 + STATISTICS] / max(n, 1)
    scale = np.sqrt(np.maximum(m[2 + STATISTICS :] / max(n, 1) - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(STATISTICS / 2), (STATISTICS, features))
    model = Model(mean, scale, w, rng.uniform(0, 2 * np.pi, features), None, None, None, p / n if n else 0.5)
    if not 0 < p < n:
        return model
    d = features + STATISTICS + 1

    def equations(frames):
        out: dict[str, np.ndarray] = {}
        for f in frames:
            z, y, k = model.lift(_matrix(f["stats"])), f["label"].to_numpy(float), f["fold"].to_numpy()
            for fold in np.unique(k):
                a = z[k == fold]
                block = np.concatenate([(a.T @ a).ravel(), a.T @ y[k == fold]])
                out[str(fold)] = out.get(str(fold), 0) + block
        return out

    sums = _summed(rows, equations)
    total = sum(sums.values())
    coef = []
    for fold in [*map(str, range(folds)), None]:
        s = total - sums[fold] if fold in sums else total
        a = s[: d * d].reshape(d, d)
        coef.append(np.linalg.solve(a + ridge * n * np.eye(d), s[d * d :]))
    model.coef = np.array(coef)
    edges = np.linspace(-0.5, 1.5, bins + 1)

    def histogram(frames):
        h = np.zeros((2, bins))
        for f in frames:
            x, y, k = _matrix(f["stats"]), f["label"].to_numpy(float), f["fold"].to_numpy()
            for fold in np.unique(k):
                at = np.clip(np.searchsorted(edges, model.raw(x[k == fold], fold)) - 1, 0, bins - 1)
                h[0] += np.bincount(at, minlength=bins)
                h[1] += np.bincount(at, y[k == fold], minlength=bins)
        return {"h": h.ravel()}

    n_bin, p_bin = _summed(rows, histogram)["h"].reshape(2, bins)
    some = n_bin > 0
    # half a positive and half a negative at each end keep the ends off 0 and 1
    weight = np.concatenate([[0.5], n_bin[some], [0.5]])
    share = np.concatenate([[0.0], p_bin[some] / n_bin[some], [1.0]])
    weight[0] = weight[-1] = 1
    fitted = pool_adjacent(weight, np.clip(share, 0.02, 0.98))[1:-1]
    model.edges, model.values = ((edges[:-1] + edges[1:]) / 2)[some], fitted
    return model


def score_statistics(stats: DataFrame, model: Model, *, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of rows (key, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def score(frames):
        for f in frames:
            s = np.clip(shared.value.score(_matrix(f["stats"])), 0, 1)
            yield pd.DataFrame({key: f[key], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return stats.mapInPandas(score, f"`{key}` {stats.schema[key].dataType.simpleString()}, score double, predicted int")


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    hold_out: int = 5, threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, held_out, score, predicted) of every row; rows whose crc32(key) is divisible by ``hold_out`` teach nothing."""
    stats = durable(document_statistics(docs, key=key, text=text))
    # hashed numbers, not the key itself, decide the fold
    fold = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    taught = labels.where(F.col(label).isNotNull() & (crc_mod(key, hold_out) != 0)).select(key, F.col(label).cast("double").alias("label"))
    rows = durable(stats.join(taught, key).select("stats", "label", fold))
    model = fit(rows)
    scored = score_statistics(stats, model, key=key, threshold=threshold)
    return scored.select(key, (crc_mod(key, hold_out) == 0).alias("held_out"), "score", "predicted")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
