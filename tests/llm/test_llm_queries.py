"""Queries against their SQL, and the pipeline by brute force."""

import hashlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

import corpus_pipeline
from stratum.llm import quality, queries, toxicity
from test_llm_operators import brute_classes, brute_mixture
from test_queries import SF, TABLES, frame

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in NAMES if n in queries.oracle_sql()])
def test_against_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(frame(got, columns), frame(want, columns))


@pytest.mark.parametrize("name", [n for n in NAMES if n not in queries.oracle_sql()])
def test_rows(spark, name):
    rows = queries.queries()[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.select("doc_id").distinct().count() == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        rows = made.toPandas()
        kept = docs.join(made.select("doc_id"), "doc_id", "left_semi").select(docs.columns).toPandas()
        assert rows.sort_values("doc_id").reset_index(drop=True).equals(kept.sort_values("doc_id").reset_index(drop=True)), name
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 0.7 * sizes[0]
    last = corpus_pipeline.packed(spark, docs, SF).toPandas()
    assert set(last.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, SF).toPandas()
    order = ["doc_id", "piece"]
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert again.sort_values(order)[same].reset_index(drop=True).equals(last.sort_values(order)[same].reset_index(drop=True))


def brute_topic(text):
    t = text or ""
    found = [("terms", "icense" in t or "ights reserved" in t), ("contact", "://" in t or "@" in t), ("tabular", " | " in t), ("shouting", "!! " in t), ("prose", True)]
    return next(name for name, on in found if on)


def test_pipeline_by_brute_force(spark):
    """Thresholds on the scores, then classes, mixture and sequences by brute force in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    quality_of = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    rows = {i: r for i, r in rows.items() if quality_of[i] >= 0.3}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.toxicity(left, toxicity.fit_toxicity(left, labels)).collect()}
    rows = {i: r for i, r in rows.items() if toxic[i] < 0.3}
    ids = sorted(rows)
    _, label = brute_classes([rows[i]["text"] for i in ids])
    rows = {i: rows[i] for k, i in enumerate(ids) if label[k] == k}
    cell = {i: (r["source"], r["lang"], brute_topic(r["text"])) for i, r in rows.items()}
    share = brute_mixture([(cell[i], -(-len((r["text"] or "").encode()) // 4)) for i, r in rows.items()])
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52
    rows = {i: r for i, r in rows.items() if draw(i) < share[cell[i]]}
    assert 20 < len(rows) < len(ids)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows.items():
        assert got[got.doc_id == i].length.sum() == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // 2048) + 1


def test_stages_of_nulls_repeats_and_nothing(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_tokens", F.lit("x"))
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (None, "", "en", None, 0, "x"), (10**7, None, None, "s", None, "x")], docs.schema)
    some = docs.unionByName(odd).unionByName(docs.limit(30))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, some, SF)
        assert made.columns == docs.columns and made.where("doc_id is null").count() == 2, name
        assert stage(spark, docs.where("false"), SF).collect() == [], name
        counts = made.groupBy("doc_id", "text").count().where("doc_id is not null").agg(F.max("count")).first()[0]
        assert counts == (2 if name in ("quality classifier", "toxicity") else 1) or name == "mixing to target weights", name
    assert corpus_pipeline.packed(spark, some, SF).select("doc_id").distinct().count() == some.select("doc_id").distinct().count() and labels.count()
    assert corpus_pipeline.packed(spark, docs.where("false"), SF).collect() == []


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "other words are in this one")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == [1, 3, 4]
