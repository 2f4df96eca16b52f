"""Run history: filters, upsert, cascade delete, nested reads, ownership, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_eq(df: DataFrame, equal: dict, order: list[Column] | None = None) -> DataFrame:
    """Rows where every named column equals its value."""
    out = df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items()))) if equal else df
    return out.orderBy(*order) if order else out


def upsert(target: DataFrame, changes: DataFrame, key: str, version: str, updated: str = "updated_at", now: Column | None = None) -> DataFrame:
    """Target rows without a change, and the latest change of each key (its largest ``version``), whose ``updated`` is ``now`` (the time of the query) if the target has that column."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    newest = changes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if updated in target.columns:
        newest = newest.withColumn(updated, F.current_timestamp() if now is None else now)
    return target.join(newest.select(key), key, "left_anti").unionByName(newest)


def delete_cascade(tables: list[tuple[DataFrame, str, str | None]], roots: DataFrame) -> list[DataFrame]:
    """Remaining rows of tables from parent to child, each (table, own key, parent key): roots go, and all below them."""
    out, gone = [], roots
    for df, key, parent in tables:
        on = key if parent is None else parent
        dead = gone.withColumnRenamed(gone.columns[0], on)
        out.append(df.join(dead, on, "left_anti"))
        gone = df.join(dead, on, "left_semi").select(key).distinct()
    return out


def nested_history(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs."""
    items = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias(name))
    return parents.join(items, key, "left")


def owned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners.select(key), key, "left_semi")


def new_files(now: DataFrame, known: DataFrame, uploaded: DataFrame, name: str = "name", skip: tuple[str, ...] = ("tmp_code", "supervisord.pid")) -> DataFrame:
    """Files that are neither known nor uploaded, and no scratch files."""
    left = now.join(known.select(name), name, "left_anti").join(uploaded.select(name), name, "left_anti")
    return left.where(reduce(lambda a, b: a & b, (~F.col(name).startswith(s) for s in skip)))


def canonical_hash(*cols: str) -> Column:
    """Hash of a record whatever the order of its fields."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def get_or_create(store: DataFrame, wanted: DataFrame, key: str, defaults: dict) -> DataFrame:
    """The store, and a row of defaults for every wanted key that it lacks."""
    made = wanted.select(key).distinct().join(store.select(key), key, "left_anti").withColumns({k: F.lit(v) for k, v in defaults.items()})
    return store.select(key, *defaults).unionByName(made)


def union_task_sets(sets: list[DataFrame], key: str) -> DataFrame:
    """Union in which a later set's row replaces an earlier one with the same key."""
    tagged = reduce(DataFrame.unionByName, (df.withColumn("_set", F.lit(i)) for i, df in enumerate(sets)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_set")))
    return tagged.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_set")


def set_diff(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """Distinct rows of the named columns that only ``left`` has."""
    return left.select(*names).subtract(right.select(*names))
