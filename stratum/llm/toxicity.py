"""Toxic passages as maximal scoring segments of token log-odds.

Learning. Labelled texts (at most ``TAUGHT`` of each class, those whose hashes
are least; equal texts count once) give counts of features: lower-case
words, and the beginnings of longer words, which stand for inflected stems. A
document adds at most ``BURST`` to a feature. All labelled texts are counted,
and a taught one stands for as many as its class has for each that is taught,
so that a bound on the classes doesn't change their shares. Every feature of
``DOCS`` documents or more has signed log-odds between the classes under an
informative Dirichlet prior, the pooled frequencies with the weight of the
smaller class; they are shrunk by z^4 / (z^4 + ``Z``^4), so that what may be
chance weighs little, and log-odds within ``LEAST`` of 0 are 0. A word scores as
the one of its features with the largest |z|, clean-leaning words below 0, words
without features 0; from every word's score goes the drift that makes clean text
lose ``DRIFT`` a word.

Scoring. One linear scan finds all maximal scoring segments of a whole text.
Segment scores follow an extreme-value law with parameters lambda (root of
E[exp(lambda * s)] = 1 over clean words) and K (from the best segments of
clean documents), so a segment S in n words has E = K n exp(-lambda S). A
document's evidence adds lambda S - log(K n) over its best and its significant
(E < ``EXPECT``) segments; an isotonic map of the evidence gives the score.
Drift, lambda, K and the map come from ``FOLDS`` folds of the taught rows, each
scored by the log-odds of the others. The driver receives features, histograms
and a number or three for each taught row.

Null and empty texts have no words and the score of texts without evidence.
Labels that are null teach nothing. Without taught rows of both classes no
feature exists and every score is the share of positives (0 without rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, durable, importable, pieces, pool_adjacent, string_column, table, tidied

TAUGHT = 6000
BURST = 3
Z = 3.0
DOCS = 3
LEAST = 0.02
DRIFT = 0.04
FOLDS = 5
STEM = range(4, 10)
EXPECT = 0.05
THRESHOLD = 0.3
CACHED = 100_000
#: The histogram of word scores: bins of ``BIN`` on both sides of 0.
BIN, BINS = 0.01, 2000

_word = re.compile(r"\w+")
_EMPTY = -1e3


def lowered(text: str) -> str:
    """Lower case, character by character where lower case would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def features_of(word: str) -> list[str]:
    """The word, and marked beginnings of words that go on."""
    return [word, *(word[:n] + "-" for n in STEM if len(word) > n)]


class Weights:
    """Scores of words: of listed features (z-score, log-odds) the surest, less ``drift``."""

    def __init__(self, listed: dict[str, tuple[float, float]], drift: float):
        self.listed, self.drift = listed, drift
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"listed": self.listed, "drift": self.drift, "known": {}}

    def _learn(self, words: list[str]) -> None:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = set(words)
        for word in new:
            found = [self.listed[x] for x in features_of(word) if x in self.listed]
            self.known[word] = (max(found, key=lambda x: abs(x[0]))[1] if found else 0.0) - self.drift

    def scores(self, text: str) -> np.ndarray:
        """The score of each word."""
        words = _word.findall(lowered(text))
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        except KeyError:
            self._learn(words)
            return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and maximal segments (first word, last word, score)."""
        s = self.scores(text)
        return len(s), maximal_segments(s)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence.

    ``before`` of a candidate is the index of the last earlier one with a
    smaller left sum; following those links keeps the scan linear.
    """
    places = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    first, last, left, right, before = [], [], [], [], []
    for place, l0, total in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        f = place
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l0:
                j = before[j]
            if j < 0 or right[j] >= total:
                break
            f, l0 = first[j], left[j]
            for column in (first, last, left, right, before):
                del column[j:]
            j -= 1
        first.append(f)
        last.append(place)
        left.append(l0)
        right.append(total)
        before.append(j)
    return [(f, e, r - s) for f, e, s, r in zip(first, last, left, right)]


class Model:
    """Weights, extreme-value parameters and the isotonic map; of bounded size."""

    def __init__(self, weights: Weights, rate: float, log_k: float, xs: np.ndarray, ys: np.ndarray):
        self.weights, self.rate, self.log_k, self.xs, self.ys = weights, rate, log_k, xs, ys

    def log_expect(self, n: int, score: float) -> float:
        return self.log_k + math.log(max(n, 1)) - self.rate * score

    def evidence(self, n: int, scores: list[float]) -> float:
        if not scores:
            return _EMPTY
        each = sorted((-self.log_expect(n, s) for s in scores), reverse=True)
        return each[0] + sum(x for x in each[1:] if x > -math.log(EXPECT))

    def score(self, evidence: float) -> float:
        return float(np.interp(evidence, self.xs, self.ys))


def _taught(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, n: int) -> tuple[DataFrame, tuple[float, float]]:
    """(text, y) of at most ``n`` texts of each class, each text and class once; and for how many labelled texts one of each class stands."""
    hashed = F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h")
    named = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y")).distinct()
    every = durable(docs.select(key, hashed).join(named, key).groupBy("_h", "y").agg(F.min(key).alias(key)))
    totals = {r["y"]: r["count"] for r in every.groupBy("y").count().collect()}
    some = [every.where(F.col("y") == y).orderBy("_h").limit(n) for y in (0, 1)]
    # at most 2 n short rows: broadcast
    rows = docs.select(key, text, hashed).join(F.broadcast(some[0].union(some[1])), [key, "_h"])
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    return rows.select(F.coalesce(text, F.lit("")).alias("text"), "y").dropDuplicates(["text", "y"]).select("text", "y", fold), tuple(max(1.0, totals.get(y, 0) / n) for y in (0, 1))


def _feature_counts(taught: DataFrame) -> DataFrame:
    """(feature, n): for each fold the counts in toxic and clean texts and the number of texts; the feature '' counts words."""

    def count(batches):
        found: list[Counter] = [Counter() for _ in range(3 * FOLDS)]
        for batch in pieces(batches):
            for text, y, fold in zip(string_column(batch, "text"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
                own: Counter = Counter()
                mine, docs = found[3 * fold + 1 - y], found[3 * fold + 2]
                for word, n in Counter(_word.findall(lowered(text))).items():
                    mine[""] += min(n, BURST)
                    for x in features_of(word):
                        own[x] += n
                for x, n in own.items():
                    mine[x] += min(n, BURST)
                docs.update(own.keys())
        names = list(set().union(*found))
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in found)], ["feature", *(f"n{k}" for k in range(3 * FOLDS))]
            )

    columns = [f"n{k}" for k in range(3 * FOLDS)]
    found = taught.mapInArrow(tidied(count), "feature string, " + ", ".join(f"{c} long" for c in columns))
    sums = found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))
    docs = sum((F.col(c) for c in columns[2::3]), F.lit(0))
    return sums.where((docs >= DOCS) | (F.col("feature") == ""))


def log_odds(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float, stands: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(z, shrunk log-odds) of features with counts a and b among n_a and n_b words."""
    prior = min(n_a, n_b)
    alpha = prior * np.maximum(stands[1] * a + stands[0] * b, 0.5) / (stands[1] * n_a + stands[0] * n_b)
    odds = lambda c, n: np.log((c + alpha) / np.maximum(n + prior - c - alpha, 0.5))
    w = odds(a, n_a) - odds(b, n_b)
    z = w / np.sqrt(1 / (a + alpha) + 1 / (b + alpha))
    return z, w * z**4 / (z**4 + Z**4)


def _listed(counts: DataFrame, stands) -> list[dict[str, tuple[float, float]]]:
    """Features with their z-score and log-odds, from all folds but each, and from all folds; the driver gets those that weigh something."""
    words = counts.where("feature = ''").first()
    if words is None:
        return [{}] * (FOLDS + 1)
    total = np.array(words[1:], np.float64)

    def weigh(batches):
        for batch in batches:
            n = np.stack([batch.column(k + 1).to_numpy() for k in range(3 * FOLDS)], axis=1).astype(np.float64)
            z, w = np.zeros((2, FOLDS + 1, len(n)))
            for without in range(FOLDS + 1):
                some = [f for f in range(FOLDS) if f != without]
                a, b, docs = (n[:, [3 * f + k for f in some]].sum(1) for k in range(3))
                n_a, n_b = (total[[3 * f + k for f in some]].sum() for k in (0, 1))
                if n_a and n_b:
                    z[without], w[without] = log_odds(a, b, n_a, n_b, stands)
                    w[without, (docs < DOCS) | (np.abs(w[without]) < LEAST)] = 0
            kept = np.flatnonzero((w != 0).any(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), *(pa.array(list(x[:, kept].T), pa.list_(pa.float64())) for x in (z, w))], ["feature", "z", "w"]
            )

    rows = counts.where("feature <> ''").mapInArrow(tidied(weigh), "feature string, z array<double>, w array<double>").orderBy("feature").collect()
    return [{r["feature"]: (r["z"][f], r["w"][f]) for r in rows if r["w"][f]} for f in range(FOLDS + 1)]


def fit(taught: DataFrame, stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit to rows (text string, y 0/1, fold int), a bounded number; one of class y stands for ``stands[y]`` labelled texts."""
    spark = taught.sparkSession
    # one more than there are folds: the last leaves none out
    found = _listed(durable(_feature_counts(taught)), stands)
    lists = spark.sparkContext.broadcast(found[:FOLDS])

    def each(describe, schema: str, drift: float) -> DataFrame:
        def run(batches):
            weights = [Weights(x, drift) for x in lists.value]
            for batch in pieces(batches):
                rows = zip(string_column(batch, "text"), batch.column("y").to_pylist(), batch.column("fold").to_pylist())
                made = describe(weights, rows)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], [x.split()[0] for x in schema.split(", ")])

        return taught.mapInArrow(tidied(run), schema)

    def histogram(weights, rows):
        total = np.zeros(2 * BINS + 1, np.int64)
        for text, y, fold in rows:
            if not y:
                at = np.clip(np.rint(weights[fold].scores(text) / BIN), -BINS, BINS).astype(np.int64) + BINS
                total += np.bincount(at, minlength=len(total))
        some = np.flatnonzero(total)
        return [(int(i) - BINS, int(total[i])) for i in some] or [(0, 0)]

    words = each(histogram, "bin long, words long", 0.0).groupBy("bin").agg(F.sum("words").alias("words")).collect()
    s, c = (np.array([r[k] for r in sorted(words)], np.float64) for k in (0, 1))
    clean = c.sum()
    drift = (max(0.0, float((s * c).sum() / clean * BIN)) if clean else 0.0) + DRIFT
    rate = _decay(s * BIN - drift, c / max(clean, 1))

    def best(weights, rows):
        out = []
        for text, y, fold in rows:
            k, segments = weights[fold].segments(text)
            out.append((y, k, max((x for _, _, x in segments), default=0.0)))
        return out

    # three numbers, then one, of each taught document
    seen = each(best, "y long, n long, best double", drift).collect()
    log_k = _location([(r["n"], r["best"]) for r in seen if r["y"] == 0], rate)
    total = sum(stands[r["y"]] for r in seen)
    share = sum(stands[1] for r in seen if r["y"]) / total if seen else 0.0
    model = Model(Weights(found[FOLDS], drift), rate, log_k, np.array([0.0]), np.array([share]))
    if not seen or not 0 < share < 1:
        return model
    rule = Model(Weights({}, drift), rate, log_k, np.array([0.0]), np.array([share]))

    def evidence(weights, rows):
        out = []
        for text, y, fold in rows:
            k, segments = weights[fold].segments(text)
            out.append((y, rule.evidence(k, [x for _, _, x in segments])))
        return out

    held_out = each(evidence, "y long, evidence double", drift).collect()
    lists.destroy()
    held = np.array([stands[r["y"]] for r in held_out])
    ys = np.array([r["y"] for r in held_out], float)
    # ties form one point
    points, where = np.unique(np.array([r["evidence"] for r in held_out]), return_inverse=True)
    weight = np.bincount(where, held)
    part = np.bincount(where, ys * held) / weight
    fitted = pool_adjacent(np.concatenate([[1.0], weight, [1.0]]), np.concatenate([[0.0], part, [1.0]]))[1:-1]
    model.xs, model.ys = points, np.clip(fitted, 0.001, 0.999)
    return model


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 over clean words, whose mean score is negative."""
    if not len(scores) or scores.max(initial=0) <= 0:
        return 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum() - 1)
    low, high = 1e-3, 20.0
    if excess(low) >= 0:
        return 0.2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _location(clean: list[tuple[int, float]], rate: float) -> float:
    """log K: so many clean documents have a best segment over their median as the law expects."""
    best = sorted(s for _, s in clean if s > 0)
    if not best:
        return math.log(1e-3)
    # P(no segment over s) = exp(-K n e^(-rate s)); the excesses over s0 tell K
    s0 = best[len(best) // 2]
    mass = sum(n * math.exp(-rate * s0) for n, _ in clean)
    return math.log(max(sum(s >= s0 for s in best) / max(mass, 1e-12), 1e-9))


def toxicity(
    docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(key, score, predicted, n_words, passages) of every row.

    passages: the significant segments, as character offsets into the text,
    with score and log E.
    """
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))

    def score(batches):
        m = shared.value
        for batch in pieces(batches):
            out = []
            for value in string_column(batch, text):
                n, segments = m.weights.segments(value)
                found = [(a, b, s, e) for a, b, s in segments if (e := m.log_expect(n, s)) < math.log(EXPECT)]
                if found:
                    spans = [x.span() for x in _word.finditer(lowered(value))]
                    found = [{"begin": spans[a][0], "end": spans[b][1], "score": s, "log_e": e} for a, b, s, e in found]
                out.append((m.score(m.evidence(n, [s for _, _, s in segments])), n, found))
            s = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()),
                    pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kind),
                ],
                [key, "score", "predicted", "n_words", "passages"],
            )

    return docs.select(key, text).mapInArrow(
        tidied(score),
        f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int, n_words long, "
        "passages array<struct<begin:long,end:long,score:double,log_e:double>>",
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", hold_out: int = 4, taught: int = TAUGHT
) -> Model:
    """Learn from labelled rows whose crc32(key) modulo ``hold_out`` is not 2."""
    importable(docs.sparkSession)
    rows, stands = _taught(docs, labels.where(crc_mod(key, hold_out) != 2), key, text, label, taught)
    return fit(durable(rows), stands)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    found = toxicity(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
