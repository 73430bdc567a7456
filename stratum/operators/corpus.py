"""Tables of files: (corpus, path, language, lang_ord, content, size).

One form serves source trees, archives, and tables of documents. ``language``
is null for files that no language claims; those are counted and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import language_table
from ..functions.expressions import extension

COLUMNS = ["corpus", "path", "language", "lang_ord", "content", "size"]


def with_language(files: DataFrame) -> DataFrame:
    """Files (path, ...) with language and lang_ord by extension."""
    named = files.withColumn("extension", extension(F.col("path")))
    return named.join(F.broadcast(language_table(files.sparkSession)), "extension", "left").drop("extension")  # 40 rows


def from_text(table: DataFrame, *, corpus: Column, path: Column, language: Column, text: Column) -> DataFrame:
    """Rows of any table as files; null text is an empty file."""
    content = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return table.select(
        corpus.alias("corpus"), path.alias("path"), language.alias("language"), F.lit(0).alias("lang_ord"),
        content.alias("content"), F.octet_length(content).cast("long").alias("size"),
    )


def number_path(column: str) -> Column:
    """An integer id as a path whose byte order is the id's order: negative ones first, by their distance from the least; null is last."""
    n = F.col(column).cast("long")
    below = F.concat(F.lit("-"), F.lpad((n - F.lit(-(1 << 63))).cast("string"), 19, "0"))
    return F.when(n.isNull(), "null").when(n < 0, below).otherwise(F.lpad(n.cast("string"), 20, "0"))


def documents(table: DataFrame) -> DataFrame:
    """``documents`` as files: corpus is the source, language the lang."""
    return from_text(table, corpus=F.col("source"), path=number_path("doc_id"), language=F.col("lang"), text=F.col("text"))
