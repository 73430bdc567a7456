"""A training corpus from documents: quality, toxicity, near copies, mixture, packing.

Every stage takes all that its predecessor kept, and all but the last return
the columns of ``documents``. ``run`` writes each stage's rows as a table in the
shared folder and reads it again for the next.

Rows are told apart by doc_id: rows that share one share its decisions, and go
if any of them is rejected; a null doc_id is never rejected. Null and empty texts
are scored like others, link with nothing, and are one piece of one id. Of
rows equal in doc_id and text one stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import jaccard_join, mixing, packing, quality, toxicity
from stratum.llm.common import durable, importable, table

#: Most ids that are broadcast; with more the join is shuffled.
BROADCAST = 1 << 20


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``rejected`` (doc_id); a null id is never rejected."""
    ids = durable(rejected.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_anti").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    importable(spark)
    return _without(docs, quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    importable(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.toxicity(docs, model).where("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more, the one with the least id; of repeated rows one."""
    importable(spark)
    classes = durable(jaccard_join.jaccard_classes(docs))
    kept = _without(docs, classes.where("component_id <> doc_id"))
    again = durable(classes.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.limit(1).count() == 0:
        return kept
    # ids that occur more than once: equal rows go, and only these rows are shuffled
    some = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(some)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come near to their target weights."""
    importable(spark)
    return _without(docs, mixing.mixture(docs).where("not kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    importable(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: Classifiers and tokenizers are beyond SQL; a test holds the ids that each stage keeps, and the sequences, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
