"""Exact dedup by skew-safe combining, in DataFrame functions only.

A class is a set of rows whose texts are identical once each run of ASCII white space is one space.
Three stages compare the full normalised text, not only its digest:

1. local: the partial aggregate of each task folds its own copies into one row;
2. salted: ``(digest, text, salt)`` groups merge, the salt being the input partition's number, so that a
   group holding a third of all rows meets in many tasks;
3. global: ``(digest, text)`` merges the salt winners, at most one per salt and task.

Text moves in these two shuffles only, once per distinct text and task. The way back from a class to
its rows is a narrow join on the digest; digests of large classes (at most 1000 of them, by
arithmetic) are broadcast, so no task gets a hot key. Where two texts share a digest, the rows of
that digest are joined by text too.

Null text counts as empty; an empty text is a class like any other. Rows that repeat the same doc_id and
text are in the same class and are reported alike; ``drop_copies`` leaves one of them. A null doc_id sorts
after all others, and is the keeper only of a class without any id. An empty table gives no rows. Extra columns
are ignored by ``exact_classes`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_lookup, table, text_of, written

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), BLANKS, " ")


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def exact_classes(docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    base = docs.select("doc_id", normalised("text").alias("body")).withColumn("digest", digest(F.col("body")))
    salted = (
        base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "body", "salt").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    )
    winners = salted.groupBy("digest", "body").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    classes = written(spark, winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "exact-classes")

    shared = classes.filter("texts > 1").select("digest")
    narrow = base.select("doc_id", "digest", sha256(F.col("body")).alias("text_sha256"))
    if shared.isEmpty():
        found = _looked_up(narrow, classes)
    else:
        apart = base.join(shared, "digest").join(winners, ["digest", "body"])
        apart = apart.select("doc_id", sha256(F.col("body")).alias("text_sha256"), "keep_id", "group_size")
        found = _looked_up(narrow.join(shared, "digest", "left_anti"), classes).unionByName(apart)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _looked_up(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return hot_lookup(rows, "digest", classes.withColumn("size", F.col("group_size")), ["keep_id", "group_size"], "doc_id").drop("digest")


def drop_copies(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns: the smallest doc_id of each class.

    Winners carry their row through the salted and the global stage, so no join is needed.
    """
    rows = docs.select("*", sha256(normalised("text")).alias("__digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))
    body = normalised("text")
    for by in (["__digest", "__salt"], ["__digest"]):
        first = Window.partitionBy(*by, body).orderBy(F.col("doc_id").asc_nulls_last())
        rows = rows.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")
    return rows.drop("__digest", "__salt")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""
