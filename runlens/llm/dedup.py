"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, chosen, join_sized, numbered, stored, table, text_rows


def normalised(text: Column) -> Column:
    """Each run of space, tab, LF, VT, FF or CR becomes one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose hash occurs once are done after one narrow aggregation. The rest
    are read again and grouped by hash *and* text, so bytes decide, whatever the
    hash does; partial aggregation leaves one row per distinct text and task, so
    a group of any size stays small. Only where one hash has several texts are
    rows matched by text.

    Null text counts as empty, and empty texts form one group. Of rows with the
    same id and text one is kept. A null id sorts after all ids. An empty table
    gives an empty result; other columns are ignored.
    """
    return marked(text_rows(df, id_col, text_col, F.monotonically_increasing_id().alias("row")), hash128).drop("row")


def marked(rows: DataFrame, hash128: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Exact dedup of rows (doc_id, text, row), with the row in the result."""
    base = rows.select("doc_id", normalised(F.col("text")).alias("norm"), "row")
    hashed = base.withColumn("h", F.unhex(hash128(F.col("norm"))))
    keys = stored(hashed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), "row"), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    groups = stored(keys.groupBy("h").agg(first, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    n = groups.count()
    texts = stored(
        join_sized(hashed, groups.select("h"), "h", "left_semi", n).groupBy("h", "norm").agg(F.min("doc_id").alias("id"), F.count("*").alias("group_size")),
        "texts",
    )
    mixed = stored(texts.groupBy("h").count().where("count > 1").select("h"), "mixed")
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    out = join_sized(keys, groups, "h", "left", n)
    same = out.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first") == one)).alias("kept"),
        "text_sha256",
        "row",
        "h",
    )
    m = mixed.count()
    if not m:
        return same.drop("h")
    apart = join_sized(hashed, mixed, "h", "left_semi", m).withColumn("text_sha256", F.sha2("norm", 256))
    apart = stored(apart, "apart")
    best = stored(apart.groupBy("h", "norm").agg(first, F.count("*").alias("group_size")), "best")
    split = apart.join(best.hint("merge"), ["h", "norm"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first") == one).alias("kept"), "text_sha256", "row")
    return join_sized(same, mixed, "h", "left_anti", m).drop("h").unionByName(split)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that exact dedup keeps: one of each text.

    It is the row with the smallest id, a null id after all others; of rows with
    the same id and text one stays. Rows of one id with different texts are
    judged each by its own text.
    """
    rows = numbered(docs)
    return chosen(rows, marked(text_rows(rows, "doc_id", "text", F.col(ROW).alias("row"))).where("kept").withColumnRenamed("row", ROW))
