"""The library's queries by name, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dimensions as d
from .functions import expressions as x
from .operators import corpus, ledger, manifests, rust_functions, scoring, signals, similarity, streams, structure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _importable(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(y for y in (root, env.get("PYTHONPATH", "")) if y)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(_table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    """Rows as SQL values."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


_PATH = "CASE WHEN doc_id IS NULL THEN 'null' WHEN doc_id < 0 THEN format('-{:019d}', 9223372036854775807 + doc_id + 1) ELSE format('{:020d}', doc_id) END"
_F = f"f AS (SELECT source AS corpus, {_PATH} AS path, lang AS language, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents)"
#: Every byte of every file: (corpus, path, language, pos, b).
_BYTES = f"""{_F}, h AS (SELECT corpus, path, language, size, hex(encode(text)) AS hx FROM f),
p AS (SELECT corpus, path, language, size, unnest(range(0, size)) AS pos, unnest(list_transform(range(0, size), lambda i: substr(hx, 2 * i + 1, 2))) AS b FROM h)"""


def _digests(files: DataFrame, keys: list[str]) -> DataFrame:
    return streams.stream_sizes(files, keys, ["path"], []).select(*keys, "file_count", "original_bytes", "sha256")


# Ledgers ---------------------------------------------------------------------


@query(f"WITH {_F} SELECT corpus, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS original_bytes, sha256(string_agg(text, '' ORDER BY path)) AS sha256 FROM f GROUP BY corpus")
def ledger_overall(spark, sf_dir):
    return _digests(_documents(spark, sf_dir), ["corpus"])


@query(f"WITH {_F} SELECT corpus, language, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS original_bytes, sha256(string_agg(text, '' ORDER BY path)) AS sha256 FROM f GROUP BY corpus, language")
def ledger_by_language(spark, sf_dir):
    return _digests(_documents(spark, sf_dir), ["corpus", "language"])


@query(f"WITH {_F} SELECT corpus, path, language, size AS original_bytes, sha256(text) AS sha256 FROM f")
def ledger_by_file(spark, sf_dir):
    return ledger.by_file(_documents(spark, sf_dir)).select("corpus", "path", "language", "original_bytes", "sha256")


@query(f"""WITH {_F} SELECT corpus, language, count(*) AS file_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS original_bytes,
CAST(grouping(corpus, language) AS INTEGER) AS level FROM f GROUP BY GROUPING SETS ((corpus, language), (corpus), ())""")
def ledger_grouping_sets(spark, sf_dir):
    return ledger.counts(_documents(spark, sf_dir))


_EMPTY = [("p", "empty.py", ""), ("p", "nonempty.rs", "x"), ("q", "a.rs", "first"), ("q", "b.rs", "second"), ("q", "unknown.bin", "zz")]
_LANGUAGE = [(e, n, i) for i, (n, some) in enumerate(d.LANGUAGES) for e in some]


def _with_language(values: str) -> str:
    return f"""SELECT v.*, l.language, l.lang_ord FROM {values} LEFT JOIN (SELECT * FROM {_values(_LANGUAGE)} AS l(extension, language, lang_ord)) l
ON l.extension = regexp_extract(split_part(v.path, '/', -1), '^.+\\.([^.]*)$', 1)"""


@query(f"""SELECT corpus, language, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS original_bytes, sha256(string_agg(text, '' ORDER BY path)) AS sha256,
sum(strlen(text)) = 0 AS no_ratio FROM ({_with_language(_values(_EMPTY) + " AS v(corpus, path, text)")}) WHERE language IS NOT NULL GROUP BY corpus, language""")
def ledger_with_empty_language(spark, sf_dir):
    rows = spark.createDataFrame(_EMPTY, "corpus string, path string, text string")
    files = corpus.with_language(rows).select("corpus", "path", "language", "lang_ord", F.encode("text", "UTF-8").alias("content"), F.octet_length("text").alias("size"))
    found = ledger.by_language(files)
    return found.select("corpus", "language", "file_count", "original_bytes", "sha256", F.col("ratio").isNull().alias("no_ratio"))


_PATHS = [(p,) for p in "a.rs src/a.tar.rs .rs dir/.rs a. x.S x.s ..rs lib.hpp b.CPP c.kts d/e/f.tsx Makefile g.lhs h.mm i.m j.cs k.unknown l.zig m.scala n.py3 o.py q.mjs".split()]


@query(f"SELECT path, language, lang_ord FROM ({_with_language(_values(_PATHS) + ' AS v(path)')})")
def language_for_path(spark, sf_dir):
    return corpus.with_language(spark.createDataFrame(_PATHS, "path string")).select("path", "language", "lang_ord")


_DEEP = [(p,) for p in "a.rs target/a.rs src/target/b.rs src/target.rs node_modules/x/y.js .git/config.py .hidden/a.py distant/a.rs dist/a.rs a/.next/b.ts a/.cache/b.ts build/c.c vendor/d.go".split()]


@query(f"SELECT path FROM {_values(_DEEP)} AS v(path) WHERE NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(repr(y) for y in d.EXCLUDED)}])")
def excluded_directories(spark, sf_dir):
    return spark.createDataFrame(_DEEP, "path string").where(~x.in_excluded_directory(F.col("path")))


@query(f"SELECT count(*) FILTER (WHERE language IS NULL) AS skipped_file_count, count(language) AS file_count FROM ({_with_language(_values(_PATHS) + ' AS v(path)')})")
def skipped_count(spark, sf_dir):
    rows = corpus.with_language(spark.createDataFrame(_PATHS, "path string")).withColumn("corpus", F.lit("c"))
    return ledger.skipped(rows).select("skipped_file_count", "file_count")


@query(f"SELECT p AS path, coalesce(nullif(list_filter(string_split(p, '/'), lambda y: y NOT IN ('', '.'))[-1], ''), '.') AS label FROM {_values([('/a/b',), ('a',), ('.',), ('/x/y/',), ('./p/q.rs',)])} AS v(p)")
def input_labels(spark, sf_dir):
    rows = spark.createDataFrame([("/a/b",), ("a",), (".",), ("/x/y/",), ("./p/q.rs",)], "path string")
    return rows.select("path", x.input_label(F.col("path")).alias("label"))


@query(f"""WITH {_F}, e AS (SELECT corpus, path, lpad(hex(CAST(strlen(path) AS BIGINT)), 16, '0') || hex(encode(path)) || upper(sha256(text)) AS entry FROM f)
SELECT corpus, sha256(unhex(hex(encode('digest-v1')) || '00' || string_agg(entry, '' ORDER BY path))) AS digest FROM e GROUP BY corpus""")
def source_manifest_digest(spark, sf_dir):
    return ledger.source_manifest(_documents(spark, sf_dir), "digest-v1")


# Streams ---------------------------------------------------------------------


@query()
def stream_zstd19(spark, sf_dir):
    return streams.stream_metric(_documents(spark, sf_dir), ["corpus", "language"])


@query()
def compression_profile(spark, sf_dir):
    return streams.compression_profile(_documents(spark, sf_dir), ["corpus", "language"]).drop("algorithms", "zstd_curve")


_RATIOS = [("a", 0.2, 0.1, 0.4, 0.3), ("b", 0.5, 0.5, 0.5, 0.5), ("c", 0.05, 0.35, 0.15, 0.25)]


@query(f"""WITH v AS (SELECT k, list_sort([a, b, c, e]) AS r FROM {_values(_RATIOS)} AS t(k, a, b, c, e))
SELECT k, round(CAST((r[2] + r[3]) / 2 AS DOUBLE), 12) AS consensus_ratio, round(CAST(r[4] - r[1] AS DOUBLE), 12) AS ratio_spread FROM v""")
def consensus_spread(spark, sf_dir):
    rows = spark.createDataFrame(_RATIOS, "k string, a double, b double, c double, e double")
    found = rows.select("k", *streams.consensus(F.array("a", "b", "c", "e")))
    return found.select("k", F.round("consensus_ratio", 12).alias("consensus_ratio"), F.round("ratio_spread", 12).alias("ratio_spread"))


# Signals ---------------------------------------------------------------------


def _entropy_sql(keys: str) -> str:
    return f"""WITH {_BYTES}, c AS (SELECT {keys}, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS t FROM c)
SELECT {keys}, CAST(any_value(t) AS BIGINT) AS original_bytes, round(-sum(n / t * log2(n / t)), 9) AS bits_per_byte FROM t GROUP BY {keys}"""


@query(_entropy_sql("corpus"))
def entropy_stream(spark, sf_dir):
    return signals.entropy(_documents(spark, sf_dir), ["corpus"]).withColumn("bits_per_byte", F.round("bits_per_byte", 9))


@query(_entropy_sql("corpus, language"))
def entropy_by_language(spark, sf_dir):
    return signals.entropy(_documents(spark, sf_dir), ["corpus", "language"]).withColumn("bits_per_byte", F.round("bits_per_byte", 9))


#: A file of digests: 8496 bytes that look random.
_RANDOM = "SELECT 'noise' AS corpus, 'random' AS path, string_agg(upper(md5(CAST(i AS VARCHAR))), '' ORDER BY i) AS hx FROM range(0, 531) t(i)"


def _random_file(spark: SparkSession) -> DataFrame:
    hx = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(530)), lambda i: F.md5(F.encode(i.cast("string"), "UTF-8"))), "")
    row = spark.range(1).select(F.lit("noise").alias("corpus"), F.lit("random").alias("path"), F.lit("none").alias("language"), F.lit(0).alias("lang_ord"), F.unhex(hx).alias("content"))
    return row.withColumn("size", F.octet_length("content").cast("long"))


@query(f"""WITH {_F}, h AS (SELECT corpus, path, hex(encode(text)) AS hx FROM f UNION ALL {_RANDOM}),
p AS (SELECT corpus, path, unnest(range(0, length(hx) // 2)) AS pos, unnest(list_transform(range(0, length(hx) // 2), lambda i: substr(hx, 2 * i + 1, 2))) AS b FROM h),
c AS (SELECT corpus, path, pos // 4096 AS w, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY corpus, path, w) AS t FROM c),
e AS (SELECT corpus, path, w, any_value(t) AS t, -sum(n / t * log2(n / t)) AS bits FROM t GROUP BY ALL)
SELECT corpus, path, w * 4096 AS "begin", CAST(w * 4096 + t AS BIGINT) AS "end" FROM e WHERE t >= 256 AND bits >= 7.5""")
def high_entropy_windows(spark, sf_dir):
    files = _documents(spark, sf_dir).unionByName(_random_file(spark))
    return signals.intervals(files, ["corpus", "path"]).where("kind = 'entropy'").select("corpus", "path", "begin", "end")


_TOKENS = f"""tok AS (SELECT corpus, path, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{24,}}')) AS t FROM f),
tid AS (SELECT *, row_number() OVER () AS id FROM tok WHERE CAST(regexp_matches(t, '[a-z]') AS INT) + CAST(regexp_matches(t, '[A-Z]') AS INT) + CAST(regexp_matches(t, '[0-9]') AS INT) >= 2),
tch AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(t, '')) AS c FROM tid) GROUP BY ALL),
ten AS (SELECT id, -sum(n / s * log2(n / s)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS s FROM tch) GROUP BY id),
tgood AS (SELECT corpus, path, length(t) AS n FROM tid JOIN ten USING (id) WHERE bits >= 3.5)"""


@query(f"WITH {_F}, {_TOKENS} SELECT corpus, path, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS random_token_bytes FROM tgood GROUP BY corpus, path")
def random_token_bytes(spark, sf_dir):
    found = signals.intervals(_documents(spark, sf_dir), ["corpus", "path"]).where("kind = 'token'")
    return found.groupBy("corpus", "path").agg(F.count("*").alias("tokens"), F.sum(F.col("end") - F.col("begin")).alias("random_token_bytes"))


_MINIFIED = "size >= 1024 AND list_max(list_transform(string_split(text, chr(10)), lambda l: strlen(l))) >= 1000 AND size // len(string_split(text, chr(10))) >= 300"


@query(f"WITH {_F} SELECT corpus, path, size FROM f WHERE {_MINIFIED}")
def minified_files(spark, sf_dir):
    return _documents(spark, sf_dir).where(x.minified(F.col("content"))).select("corpus", "path", "size")


_MARKED = [("m", "0", "// Code GENERATED by x"), ("m", "1", "plain"), ("m", "2", "a" * 20 + " DO not EDIT"), ("m", "3", "é" * 10 + "@Generated"), ("m", "4", "auto generated"), ("m", "5", "Auto-Generated")]
_MARK = " OR ".join(f"contains(lower(left(text, 8192)), '{m}')" for m in d.MARKERS)


@query(f"WITH {_F}, g AS (SELECT corpus, path, text FROM f UNION ALL SELECT * FROM {_values(_MARKED)} AS v(corpus, path, text)) SELECT corpus, path, ({_MARK}) AS marked FROM g")
def generated_markers(spark, sf_dir):
    extra = spark.createDataFrame(_MARKED, "corpus string, path string, text string").select("corpus", "path", F.encode("text", "UTF-8").alias("content"))
    files = _documents(spark, sf_dir).select("corpus", "path", "content").unionByName(extra)
    return files.select("corpus", "path", x.generated_marker(F.col("content")).alias("marked"))


@query(f"""WITH {_F}, {_TOKENS}, n AS (SELECT corpus, path, sum(n) AS n FROM tgood GROUP BY ALL),
g AS (SELECT f.corpus, size, CASE WHEN {_MINIFIED} OR {_MARK} THEN size ELSE coalesce(n.n, 0) END AS flagged FROM f LEFT JOIN n USING (corpus, path))
SELECT corpus, CAST(sum(size) AS BIGINT) AS original_bytes, CAST(sum(flagged) AS BIGINT) AS flagged_bytes, round(sum(flagged) / sum(size), 9) AS noise_ratio FROM g GROUP BY corpus""")
def noise_union(spark, sf_dir):
    found = signals.noise(_documents(spark, sf_dir), ["corpus"])
    return found.select("corpus", "original_bytes", "flagged_bytes", F.round("noise_ratio", 9).alias("noise_ratio"))


_WINDOWS = f"""{_F}, h AS (SELECT corpus, path, size, hex(encode(text)) AS hx FROM f WHERE size > 0),
p AS (SELECT corpus, path, size, unnest(range(0, size)) AS pos, unnest(list_transform(range(0, size), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS INTEGER))) AS b FROM h),
s AS (SELECT corpus, path, size, pos, sum(b) OVER (PARTITION BY corpus, path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS t FROM p),
w AS (SELECT s.corpus, s.path, pos AS "begin", pos + 64 AS "end", substr(hx, 2 * pos + 1, 128) AS k FROM s JOIN h USING (corpus, path) WHERE pos + 64 <= s.size AND t % 64 = 0
  UNION ALL SELECT corpus, path, 0, size, hx FROM h WHERE size < 64)"""


def _duplicate_sql(scope: str, by: str) -> str:
    return f"""WITH {_WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY {scope} k ORDER BY path, "begin") AS rn FROM w),
i AS (SELECT *, coalesce(max("end") OVER (PARTITION BY corpus, path ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hi FROM r WHERE rn > 1)
SELECT {by}, CAST(sum(greatest("end" - greatest("begin", hi), 0)) AS BIGINT) AS duplicate_bytes FROM i GROUP BY {by}"""


@query(_duplicate_sql("corpus,", "corpus"))
def duplicate_windows(spark, sf_dir):
    found = signals.duplicates(_documents(spark, sf_dir), ["corpus"], F.col("path"))
    return found.groupBy("corpus").agg(F.sum("bytes").alias("duplicate_bytes"))


@query(_duplicate_sql("", "path"))
def duplicate_by_file(spark, sf_dir):
    files = _documents(spark, sf_dir).withColumn("corpus", F.lit("all"))
    return signals.duplicates(files, ["corpus"], F.col("path")).select("path", F.col("bytes").alias("duplicate_bytes"))


# Structure, baselines, score ---------------------------------------------------


@query(f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY size, path) AS i, row_number() OVER (PARTITION BY corpus ORDER BY size DESC, path) AS j,
  count(*) OVER (PARTITION BY corpus) AS n, sum(size) OVER (PARTITION BY corpus) AS t, sum(size) OVER (PARTITION BY corpus ORDER BY size DESC, path ROWS UNBOUNDED PRECEDING) AS held FROM f)
SELECT corpus, any_value(n) AS file_count, CAST(any_value(t) AS BIGINT) AS original_bytes, max(size) FILTER (WHERE i = (n - 1) // 2 + 1) AS median_file_bytes,
  max(size) FILTER (WHERE i = (n * 95 + 99) // 100) AS p95_file_bytes, round(max(size) / any_value(t), 9) AS largest_file_share,
  round(sum(size) FILTER (WHERE j <= 10) / any_value(t), 9) AS top_10_file_share,
  round(greatest(2 * sum(CAST(i AS DOUBLE) * size) / (any_value(n) * any_value(t)) - (any_value(n) + 1) / any_value(n), 0), 9) AS gini,
  any_value(n) >= 5 AND 2 * min(j) FILTER (WHERE held >= 0.8 * t) >= any_value(n) AS long_tail FROM r GROUP BY corpus""")
def file_structure(spark, sf_dir):
    found = structure.structure(_documents(spark, sf_dir), "corpus")
    shares = ("largest_file_share", "top_10_file_share", "gini")
    return found.select(*(F.round(c, 9).alias(c) if c in shares else c for c in found.columns))


_LANGUAGES = [("p", "Python", 300000, 0.24), ("p", "Rust", 100000, 0.112598321337310 + 2.5e-16), ("p", "Go", 5, 0.5), ("p", "Zig", 70, 0.4), ("q", "C Header", 1000, 0.16), ("q", "Rust", 10, None), ("q", "TSX", 9, 0.2)]
_SAMPLES = [(n, v) for n, some in d.BASELINES.items() for v in some]
_BASE = f"""l AS (SELECT * FROM {_values(_LANGUAGES)} AS l(corpus, language, source_bytes, project_ratio)), s AS (SELECT * FROM {_values(_SAMPLES)} AS s(language, v)),
b AS (SELECT corpus, l.language, CAST(any_value(source_bytes) AS BIGINT) AS source_bytes, CAST(any_value(project_ratio) AS DOUBLE) AS project_ratio, count(*) AS sample_count, CAST(median(CAST(v AS DOUBLE)) AS DOUBLE) AS median_ratio,
CASE WHEN count(*) >= 3 THEN (count(*) FILTER (WHERE v < project_ratio) + 0.5 * count(*) FILTER (WHERE v = project_ratio)) * 100.0 / count(*) END AS percentile
FROM l JOIN s USING (language) WHERE project_ratio IS NOT NULL GROUP BY corpus, l.language)"""


def _languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LANGUAGES, "corpus string, language string, original_bytes long, ratio double")


@query(f"WITH {_BASE} SELECT corpus, language, source_bytes, round(project_ratio, 9) AS project_ratio, sample_count, round(median_ratio, 9) AS median_ratio, round(CAST(percentile AS DOUBLE), 6) AS percentile FROM b")
def language_baseline(spark, sf_dir):
    found = scoring.baselines(_languages(spark))
    return found.select("corpus", "language", "source_bytes", F.round("project_ratio", 9).alias("project_ratio"), "sample_count", F.round("median_ratio", 9).alias("median_ratio"), F.round("percentile", 6).alias("percentile"))


@query(f"""WITH {_BASE} SELECT corpus, round(sum(least(greatest((project_ratio / median_ratio - 0.5) * 100, 0), 100) * source_bytes) / sum(source_bytes), 6) AS norm_baseline,
round(sum(sample_count * source_bytes) / sum(source_bytes), 6) AS weighted_samples FROM b GROUP BY corpus""")
def weighted_baseline(spark, sf_dir):
    found = scoring.weighted_baseline(scoring.baselines(_languages(spark)))
    return found.select("corpus", F.round("norm_baseline", 6).alias("norm_baseline"), F.round("weighted_samples", 6).alias("weighted_samples"))


_PARTS = [
    ("a", 0.1, 55.0, 0.2, 4.5, 0.05, 0.4, 0.1, 0.5, 300000, 3.0), ("b", 0.95, None, 0.9, 7.9, 0.0, 1.0, 1.0, 0.0, 16384, None), ("c", 0.0, None, 0.03, 2.0, 0.4, 1.0, 0.9, 0.1, 70000, 2.5),
    ("d", 0.3, None, 0.1, 6.5, 0.2, 0.5, 0.2, 0.6, 900000, 5.0), ("e", 0.0, 100.0, 0.5, 3.0, 1.0, 0.3, 0.05, 0.3, 65536, 1.0),
]
_PART = "corpus, noise_ratio, norm_baseline, consensus_ratio, entropy_bits, duplicate_ratio, top_10_share, largest_share, gini, original_bytes, weighted_samples"
_SCORES = f"""v AS (SELECT * FROM {_values(_PARTS)} AS v({_PART})),
c AS (SELECT *, least(greatest((1 - noise_ratio) * 100, 0), 100) AS signal, coalesce(norm_baseline, least(greatest((consensus_ratio - 0.05) / 0.30 * 100, 0), 100)) AS nc,
  CASE WHEN entropy_bits <= 3 THEN least(greatest(entropy_bits / 3 * 70, 0), 100) WHEN entropy_bits <= 6.5 THEN 70 + (entropy_bits - 3) / 3.5 * 30 ELSE least(greatest((8 - entropy_bits) / 1.5 * 100, 0), 100) END AS entropy,
  least(greatest((1 - duplicate_ratio) * 100, 0), 100) AS uniqueness,
  CASE WHEN top_10_share >= 0.999 AND original_bytes < 65536 THEN 50 ELSE least(greatest((1 - 0.55 * largest_share - 0.45 * gini) * 100, 0), 100) END AS distribution FROM v),
e AS (SELECT *, nc * signal / 100 AS compression FROM c)"""


def _scores(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_PARTS, ", ".join(f"{n} {'string' if n == 'corpus' else 'long' if n == 'original_bytes' else 'double'}" for n in _PART.split(", ")))
    return scoring.score(rows)


_SCORE = ["signal", "compression", "entropy", "uniqueness", "distribution"]


@query(f"""WITH {_SCORES} SELECT corpus, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _SCORE)},
round(CAST(0.30 * compression + 0.15 * entropy + 0.25 * uniqueness + 0.20 * signal + 0.10 * distribution AS DOUBLE), 6) AS information_density FROM e""")
def score_profile(spark, sf_dir):
    return _scores(spark).select("corpus", *(F.round(c, 6).alias(c) for c in [*_SCORE, "information_density"]))


@query(f"""WITH {_SCORES} SELECT corpus, CASE WHEN original_bytes >= 262144 AND weighted_samples >= 5 THEN 'high' WHEN original_bytes >= 65536 AND weighted_samples >= 2 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN duplicate_ratio >= 0.30 OR consensus_ratio < 0.08 THEN 'high' WHEN duplicate_ratio >= 0.15 OR consensus_ratio < 0.14 THEN 'medium' ELSE 'low' END AS template_repetition_risk FROM e""")
def confidence_risk(spark, sf_dir):
    return _scores(spark).select("corpus", "confidence", "template_repetition_risk")


#: Five public projects: bytes, zstd-19 bytes by language.
_COHORT = [("a", "Rust", 900000, 110000), ("a", "Python", 50000, 9000), ("b", "Rust", 72512, 14848), ("c", "Python", 20000, 4000), ("d", "Java", 5303367, 1209863), ("e", "Rust", 0, 9)]


def _cohort(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COHORT, "corpus string, language string, original_bytes long, compressed_bytes long")


_COHORT_SQL = f"(SELECT * FROM {_values(_COHORT)} AS c(corpus, language, original_bytes, compressed_bytes))"
_COHORT_ROWS = "count(*) FILTER (WHERE original_bytes > 0) AS projects, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, round(sum(compressed_bytes) / sum(original_bytes), 9) AS ratio"


@query(f"SELECT {_COHORT_ROWS} FROM {_COHORT_SQL}")
def cohort_weighted_ratio(spark, sf_dir):
    return ledger.cohort_ratio(_cohort(spark)).withColumn("ratio", F.round("ratio", 9))


@query(f"SELECT language, {_COHORT_ROWS} FROM {_COHORT_SQL} c GROUP BY language HAVING sum(c.original_bytes) >= 65536")
def cohort_language_floor(spark, sf_dir):
    return ledger.cohort_ratio(_cohort(spark), "language").withColumn("ratio", F.round("ratio", 9))


# Relations and functions ---------------------------------------------------------


@query()
def relation_pair(spark, sf_dir):
    files = _documents(spark, sf_dir)
    ends = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    return similarity.relate(files, ends["b"], ends["a"])


_GAINS = [(58, 58, 59, 9), (9, 9, 9, 9), (100, 50, 160, 9), (1000, 2000, 2500, 9)]


@query(f"""SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(a + b - c AS BIGINT) AS raw_gain, CAST(a + b - c - e AS BIGINT) AS adjusted_gain,
round(CASE WHEN a + b - 2 * e > 0 THEN (a + b - c - e) / (a + b - 2 * e) END, 9) AS gain_ratio FROM {_values(_GAINS)} AS v(a, b, c, e)""")
def gain_arithmetic(spark, sf_dir):
    rows = spark.createDataFrame(_GAINS, "a long, b long, c long, e long")
    found = rows.select("a", "b", "c", *x.gain(F.col("a"), F.col("b"), F.col("c"), F.col("e")))
    return found.withColumn("gain_ratio", F.round("gain_ratio", 9))


_BLOCKS = """blk AS (SELECT corpus, path, unnest(range(0, size // 64)) AS i, hx FROM (SELECT corpus, path, size, hex(encode(text)) AS hx FROM f) WHERE size >= 64),
fp AS (SELECT DISTINCT corpus, path, left(sha256(unhex(substr(hx, 128 * i + 1, 128))), 16) AS fp FROM blk)"""


@query(f"WITH {_F}, {_BLOCKS} SELECT path, fp FROM fp")
def function_fingerprints(spark, sf_dir):
    return _documents(spark, sf_dir).select("path", F.explode(x.block_fingerprints(F.col("content"))).alias("fp"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two groups of sources as functions; the language is the kind, the size the symbol."""
    files = _documents(spark, sf_dir).select("corpus", F.col("path").alias("idx"), F.col("language").alias("kind"), F.col("size").cast("string").alias("symbol"), "content")
    return files.where("corpus < 'src3'"), files.where("corpus >= 'src3'")


_FP = "SELECT DISTINCT a.path AS i, b.path AS j FROM fp a JOIN fp b USING (fp) WHERE a.corpus < 'src3' AND b.corpus >= 'src3'"
_SY = "SELECT a.path AS i, b.path AS j FROM f a JOIN f b ON a.language = b.language AND a.size = b.size WHERE a.corpus < 'src3' AND b.corpus >= 'src3'"


@query(f"WITH {_F}, {_BLOCKS} {_FP}")
def candidates_fingerprint(spark, sf_dir):
    return similarity.by_fingerprint(*_sides(spark, sf_dir))


@query(f"WITH {_F} {_SY}")
def candidates_symbol(spark, sf_dir):
    return similarity.by_symbol(*_sides(spark, sf_dir))


@query(f"WITH {_F}, {_BLOCKS}, u AS ({_FP} UNION {_SY}) SELECT i, j, (SELECT count(*) FROM u) > {d.CANDIDATES} AS truncated FROM u ORDER BY i, j LIMIT {d.CANDIDATES}")
def candidates_union_limit(spark, sf_dir):
    found, truncated = similarity.candidates(*_sides(spark, sf_dir))
    return found.withColumn("truncated", F.lit(truncated))


@query()
def function_similarity(spark, sf_dir):
    found, truncated = similarity.similarities(*_sides(spark, sf_dir))
    return found.withColumn("truncated", F.lit(truncated))


_RUST = b"/// d\npub fn outer() { let c = |x: u8| x + 1; }\ntrait T { fn declared(&self); fn defaulted(&self) {} }\nimpl S { fn method(&self) { v.iter().map(|q| q); } }\n"


@query()
def rust_function_spans(spark, sf_dir):
    files = spark.createDataFrame([("c", "src/a.rs", "Rust", _RUST), ("c", "b.py", "Python", b"def f(): pass")], "corpus string, path string, language string, content binary")
    return rust_functions.extract_functions(files).drop("content")


# Manifests, databases, repositories ------------------------------------------------

_A40, _D64 = "0123456789abcdef0123456789ABCDEF01234567", "ab" * 32
_URL = "https://github.com/o/r"
_PROJECTS = [
    (0, "n", "1", None, "u", None, "/here", True, True), (1, " ", "1", None, "u", None, "/here", True, True), (2, "a", "", None, "u", None, "/here", True, True),
    (3, "b", "1", " ", "u", None, "/here", True, True), (4, "c", "1", None, "u", "xyz", "/here", True, True), (5, "e", "1", None, "u", None, "/gone", False, False),
    (6, "f", "1", None, "u", None, "/file", True, False), (7, "g", "1", "main", _URL, _D64, None, False, False), (8, "h", "1", _A40, _URL, None, "/gone", False, False),
    (9, "i", "1", _A40, _URL, _D64, None, False, False), (10, "n", "1", None, "u", None, "/here", True, True), (11, "n", "2", None, " ", "bad", "/here", True, True),
]
_PROJECT_SQL = f"p AS (SELECT * FROM {_values(_PROJECTS)} AS p(idx, name, version, revision, source_url, archive_sha256, path, path_exists, path_is_dir))"
_RULES = """CASE WHEN trim(name) = '' THEN 'empty name' WHEN trim(version) = '' THEN 'empty version' WHEN trim(source_url) = '' THEN 'empty source_url'
WHEN trim(revision) = '' THEN 'empty revision' WHEN archive_sha256 IS NOT NULL AND NOT regexp_full_match(archive_sha256, '[0-9A-Fa-f]{64}') THEN 'invalid archive_sha256'
WHEN path IS NOT NULL AND NOT path_exists AND NOT regexp_full_match(source_url, 'https://github.com/+[^/]+/+[^/]+/*') THEN 'input not found'
WHEN path IS NOT NULL AND path_exists AND NOT path_is_dir THEN 'path not a directory'
WHEN NOT (path IS NOT NULL AND path_exists) AND NOT coalesce(regexp_full_match(revision, '[0-9A-Fa-f]{40}'), false) THEN 'revision required'
WHEN NOT (path IS NOT NULL AND path_exists) AND archive_sha256 IS NULL THEN 'archive digest required'
WHEN row_number() OVER (PARTITION BY name, version ORDER BY idx) > 1 THEN 'duplicate project' END"""


def _projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PROJECTS, manifests.MANIFEST)


@query(f"WITH {_PROJECT_SQL} SELECT idx, {_RULES} AS error FROM p")
def manifest_validation(spark, sf_dir):
    return manifests.manifest_errors(_projects(spark))


@query(f"WITH {_PROJECT_SQL}, e AS (SELECT idx, {_RULES} AS error FROM p) SELECT error, idx FROM e WHERE error IS NOT NULL ORDER BY idx LIMIT 1")
def manifest_first_error(spark, sf_dir):
    return manifests.first_error(manifests.manifest_errors(_projects(spark)))


@query(f"WITH {_PROJECT_SQL} SELECT name, version, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1")
def duplicate_identity(spark, sf_dir):
    return manifests.duplicate_identities(_projects(spark))


@query(f"WITH {_PROJECT_SQL} SELECT row_number() OVER (ORDER BY name, version) AS position, name, version, revision, source_url, archive_sha256 FROM p WHERE idx NOT IN (10)")
def database_sorted(spark, sf_dir):
    return manifests.sorted_projects(_projects(spark).where("idx <> 10"))


@query("""WITH c AS (SELECT conv_id || '/' || turn // 2 AS path, turn % 2 AS side, sha256(text) AS h FROM conversations),
a AS (SELECT * FROM c WHERE side = 0), b AS (SELECT * FROM c WHERE side = 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.path = b.path""")
def snapshot_change_join(spark, sf_dir):
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    rows = _table(spark, sf_dir, "conversations").select(path.alias("path"), "turn", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return ledger.snapshot_changes(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"))


_URLS = [(u,) for u in [_URL, _URL + ".git", _URL + "/", " " + _URL + " ", _URL + "/tree/main", _URL + "/tree/a/b", _URL + "/commit/" + _A40, _URL + "/commit/abc", "http://github.com/o/r", "https://github.com/o", "https://github.com//r", _URL + "/issues/1", "https://github.com/o/r?x"]]


@query(f"""SELECT u AS url, regexp_full_match(u, '\\s*https://github\\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+(/tree/[A-Za-z0-9._-]+|/commit/[0-9A-Fa-f]{{40}})?/*\\s*') AS valid,
nullif(regexp_extract(trim(u), '^https://github\\.com/([A-Za-z0-9._-]+)/[A-Za-z0-9._-]+(/tree/[A-Za-z0-9._-]+|/commit/[0-9A-Fa-f]{{40}})?/*$', 1), '') AS owner,
nullif(regexp_replace(regexp_extract(trim(u), '^https://github\\.com/[A-Za-z0-9._-]+/([A-Za-z0-9._-]+)(/tree/[A-Za-z0-9._-]+|/commit/[0-9A-Fa-f]{{40}})?/*$', 1), '\\.git$', ''), '') AS repository,
nullif(regexp_extract(trim(u), '^https://github\\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+/(tree/([A-Za-z0-9._-]+)|commit/([0-9A-Fa-f]{{40}}))/*$', 2) || regexp_extract(trim(u), '^https://github\\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+/(tree/([A-Za-z0-9._-]+)|commit/([0-9A-Fa-f]{{40}}))/*$', 3), '') AS revision
FROM {_values(_URLS)} AS v(u)""")
def url_grammar(spark, sf_dir):
    from .sources import repository

    def parse(url):
        found = _or_none(repository.parse_address, url)
        return (url, found is not None, *((found.owner, found.repository, found.revision) if found else (None, None, None)))

    return _mapped(spark.createDataFrame(_URLS, "url string"), parse, "url string, valid boolean, owner string, repository string, revision string")


def _or_none(f, *args):
    from .errors import StratumError

    try:
        return f(*args)
    except StratumError:
        return None


def _mapped(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of each row's values, as a row."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([f(*r) for r in frame.itertuples(index=False, name=None)], columns=[c.split()[0] for c in schema.split(", ")])

    _importable(rows.sparkSession)
    return rows.mapInPandas(run, schema)


_REFS = [("HEAD", "1" * 40), ("refs/heads/main", "2" * 40), ("refs/tags/v1", "3" * 40), ("refs/tags/v1^{}", "4" * 40), ("refs/heads/both", "5" * 40), ("refs/tags/both", "6" * 40), ("refs/tags/light", "7" * 40)]
_WANTED = [(w,) for w in ["HEAD", "main", "v1", "both", "light", "none"]]


@query(f"""WITH r AS (SELECT * FROM {_values(_REFS)} AS r(name, c)), w AS (SELECT * FROM {_values(_WANTED)} AS w(revision))
SELECT revision, coalesce(h.c, a.c, b.c, t.c) AS "commit" FROM w LEFT JOIN r h ON w.revision = 'HEAD' AND h.name = 'HEAD' LEFT JOIN r a ON a.name = 'refs/heads/' || revision
LEFT JOIN r b ON b.name = 'refs/tags/' || revision || '^{{}}' LEFT JOIN r t ON t.name = 'refs/tags/' || revision""")
def ref_precedence(spark, sf_dir):
    from .sources import repository

    def find(revision):
        return revision, _or_none(repository.resolve, repository.Address("o", "r", revision), dict(_REFS))

    return _mapped(spark.createDataFrame(_WANTED, "revision string"), find, "revision string, commit string")


_PAGES = [("one", '"currentOid":"' + "a" * 40 + '"'), ("same", ('"currentOid":"' + "b" * 40 + '" x ') * 2), ("two", '"currentOid":"' + "c" * 40 + '""currentOid":"' + "d" * 40 + '"'), ("none", "x"), ("case", '"currentOid":"' + "E" * 40 + '"'), ("malformed", '"currentOid":"' + "f" * 40 + '" "currentOid":"' + "f" * 39 + '"')]


@query(f"""WITH v AS (SELECT k, list_distinct(list_transform(regexp_extract_all(page, '"currentOid":"([0-9A-Fa-f]{{40}})"', 1), lambda y: lower(y))) AS c,
len(string_split(page, '"currentOid":"')) - 1 <> len(regexp_extract_all(page, '"currentOid":"[0-9A-Fa-f]{{40}}"')) AS wrong FROM {_values(_PAGES)} AS v(k, page))
SELECT k, CASE WHEN len(c) = 1 AND NOT wrong THEN c[1] END AS "commit" FROM v""")
def current_oid(spark, sf_dir):
    from .sources import repository

    return _mapped(spark.createDataFrame(_PAGES, "k string, page string"), lambda k, page: (k, _or_none(repository.commit_of_page, page.encode())), "k string, commit string")


_DIGESTS = [("sha256:" + _D64,), ("sha256:" + _D64.upper(),), (_D64,), ("sha256:12",), (None,)]


@query(f"SELECT v AS digest, CASE WHEN regexp_full_match(v, 'sha256:[0-9A-Fa-f]{{64}}') THEN lower(substr(v, 8)) END AS hex FROM {_values(_DIGESTS)} AS t(v)")
def release_digests(spark, sf_dir):
    from .sources import release

    return _mapped(spark.createDataFrame(_DIGESTS, "digest string"), lambda v: (v, _or_none(release.parse_digest, v)), "digest string, hex string")


# Whole analyses ----------------------------------------------------------------------


@query(f"""WITH {_F} SELECT corpus, count(language) AS file_count, CAST(sum(size) FILTER (language IS NOT NULL) AS BIGINT) AS original_bytes,
sha256(string_agg(text, '' ORDER BY path) FILTER (language IS NOT NULL)) AS sha256, count(DISTINCT language) AS languages, count(*) - count(language) AS skipped FROM f GROUP BY corpus""")
def analysis_ledger(spark, sf_dir):
    from .plans import analysis

    found = analysis.analyse(_documents(spark, sf_dir), profile=False)
    rows = [(c, *(a["overall"][k] for k in ("file_count", "original_bytes", "sha256")), len(a["languages"]), a["skipped_file_count"]) for c, a in found.items()]
    return spark.createDataFrame(rows, "corpus string, file_count long, original_bytes long, sha256 string, languages long, skipped long")


@query(f"""WITH {_F}, u AS ({_duplicate_sql("corpus,", "corpus")}) SELECT f.corpus, language, CAST(sum(size) AS BIGINT) AS original_bytes, sha256(string_agg(text, '' ORDER BY path)) AS sha256,
coalesce(any_value(duplicate_bytes), 0) AS duplicate_bytes FROM f LEFT JOIN u USING (corpus) GROUP BY f.corpus, language""")
def analysis_profile(spark, sf_dir):
    from .plans import analysis

    found = analysis.analyse(_documents(spark, sf_dir))
    rows = [
        (c, x["language"], x["original_bytes"], x["sha256"], a["profile"]["duplication"]["duplicate_bytes"]) for c, a in found.items() for x in a["languages"]
    ]
    return spark.createDataFrame(rows, "corpus string, language string, original_bytes long, sha256 string, duplicate_bytes long")


@query(f"WITH {_F} SELECT row_number() OVER (ORDER BY path) AS position, path, language, size AS original_bytes, sha256(text) AS sha256, (SELECT CAST(sum(size) AS BIGINT) FROM f) AS all_bytes FROM f")
def granular_files(spark, sf_dir):
    from .plans import analysis

    files = _documents(spark, sf_dir).withColumn("corpus", F.lit("all"))
    found = analysis.granular_analysis(files, True, True, profile=False)
    rows = [(i + 1, r["path"], r["language"], r["original_bytes"], r["sha256"], found["repository"]["overall"]["original_bytes"]) for i, r in enumerate(found["files"])]
    return spark.createDataFrame(rows, "position long, path string, language string, original_bytes long, sha256 string, all_bytes long")


#: Snapshots by address: (address, path, text).
_SNAPSHOTS = [("https://github.com/o/b", "z.rs", "fn z() { one(); }\n"), ("https://github.com/o/b", "a/m.py", "def m():\n    return 1\n"), ("https://github.com/o/a", "z.rs", "fn z() { two(); }\n"), ("https://github.com/o/a", "notes.txt", "skipped")]
_SNAPSHOT_SQL = f"s AS (SELECT * FROM {_values(_SNAPSHOTS)} AS s(url, path, text) WHERE NOT path LIKE '%.txt')"


def _snapshots():
    from .sources.repository import Snapshot

    urls = list(dict.fromkeys(u for u, _, _ in _SNAPSHOTS))
    return [Snapshot(u, _A40.lower(), _D64, [(p, t.encode()) for v, p, t in _SNAPSHOTS if v == u]) for u in urls]


@query(f"""WITH {_SNAPSHOT_SQL} SELECT min(url) AS "first", max(url) AS "second", CAST(sum(strlen(text)) FILTER (url LIKE '%/a') AS BIGINT) AS first_bytes,
CAST(sum(strlen(text)) FILTER (url LIKE '%/b') AS BIGINT) AS second_bytes, count(*) AS file_count, sha256(string_agg(text, '' ORDER BY url, path)) AS sha256,
(SELECT string_agg('z-z', ',') FROM s a JOIN s b ON a.path = b.path AND a.url < b.url) AS pairs FROM s""")
def comparison_snapshots(spark, sf_dir):
    from .plans import analysis

    _importable(spark)
    r = analysis.compare_snapshots(spark, *_snapshots(), with_functions=True)
    sizes = [r[f"{k}_analysis"]["overall"]["original_bytes"] for k in ("first", "second")]
    pairs = ",".join(f"{p['first']['symbol']}-{p['second']['symbol']}" for p in r["function_similarities"])
    row = (r["first"]["repository_url"], r["second"]["repository_url"], *sizes, r["combined"]["file_count"], r["combined"]["sha256"], pairs)
    return spark.createDataFrame([row], "first string, second string, first_bytes long, second_bytes long, file_count long, sha256 string, pairs string")


@query(f"""WITH {_SNAPSHOT_SQL} SELECT row_number() OVER (ORDER BY url) AS position, right(url, 1) AS name, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS original_bytes,
sha256(string_agg(text, '' ORDER BY path)) AS sha256 FROM s GROUP BY url""")
def database_ledgers(spark, sf_dir):
    from .plans import analysis

    _importable(spark)
    snapshots = _snapshots()
    projects = [{"name": s.url[-1], "version": "1", "path": "/x"} for s in snapshots]
    found = analysis.database(spark, projects, dict(enumerate(snapshots)))["projects"]
    rows = [(i + 1, p["name"], *(p["analysis"]["overall"][k] for k in ("file_count", "original_bytes", "sha256"))) for i, p in enumerate(found)]
    return spark.createDataFrame(rows, "position long, name string, file_count long, original_bytes long, sha256 string")


# Streaming (an addition) -------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS "begin", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streaming_event_windows(spark, sf_dir):
    from .storage import shared_folder
    from .streaming.incremental import all_available, event_windows

    table = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_dir(sf_dir))
    base = f"{shared_folder(spark)}/stratum-stream/{os.urandom(8).hex()}"
    found = all_available(event_windows(stream.withColumn("ts", F.col("ts").cast("timestamp"))), base)
    return found.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream_dir(sf_dir: str) -> str:
    """A glob that holds the events table alone, a file or a folder of files."""
    return f"{sf_dir}/events*.parquet"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
