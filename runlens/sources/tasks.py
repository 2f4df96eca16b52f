"""Task sources: JSON Lines, one JSON map, CSV; all give (id, question, ground_truth, set, metadata) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = ["id", "question", "ground_truth", "set", "metadata"]
LOADERS: dict[str, Callable[..., DataFrame]] = {}


def as_tasks(df: DataFrame, fields: dict[str, str], set_name: str | None = None) -> DataFrame:
    """The canonical columns, renamed by ``fields`` (task column: source column); absent ones are null.

    ``set_name`` fills a set that is absent or null. A metadata column of any
    other type than a string becomes JSON text.
    """

    def one(name: str) -> Column:
        source = fields.get(name, name)
        if source not in df.columns:
            return F.lit(None).cast("string")
        c = F.col(f"`{source}`")
        return F.to_json(c) if df.schema[source].dataType.typeName() in ("struct", "map", "array") else c.cast("string")

    cols = {name: one(name) for name in TASK}
    cols["set"] = F.coalesce(cols["set"], F.lit(set_name))
    return df.select(*(c.alias(n) for n, c in cols.items()))


def read_tasks_jsonl(spark: SparkSession, path: str, schema: str, fields: dict[str, str], set_name: str | None = None) -> DataFrame:
    """One task a line. Lines that don't parse give tasks with null fields and are left out."""
    return as_tasks(spark.read.schema(schema).json(path), fields, set_name).where("id is not null")


def json_map_rows(df: DataFrame, col: str, value: str = "struct<question:string>", *keep: str) -> DataFrame:
    """A row (key, value), and the columns in ``keep``, for every entry of a JSON object; a text that is no object gives none."""
    return df.select(*keep, F.explode(F.from_json(F.col(col), f"map<string,{value}>")).alias("key", "value"))


def read_tasks_json_map(spark: SparkSession, path: str, set_name: str | None = None) -> DataFrame:
    """Documents ``{id: {question}}``, one a file; files are read whole, so each is as large as a task can hold."""
    rows = json_map_rows(spark.read.text(path, wholetext=True), "value").select(F.col("key").alias("id"), "value.question")
    return as_tasks(rows, {}, set_name)


def read_tasks_csv(spark: SparkSession, path: str, schema: str, fields: dict[str, str], set_name: str | None = None) -> DataFrame:
    """Quoted CSV with a header, cells over several lines and doubled quotes. A null cell and an empty one differ as written."""
    return as_tasks(read_csv(spark, path, schema), fields, set_name)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def metadata_map(metadata: Column) -> Column:
    """A metadata cell as a map: a JSON object's entries, else the raw text under ``raw``; null stays null."""
    parsed = F.when(F.try_parse_json(metadata).isNotNull() & metadata.rlike(r"^\s*\{"), F.from_json(metadata, "map<string,string>"))
    return F.when(metadata.isNotNull(), F.coalesce(parsed, F.create_map(F.lit("raw"), metadata)))


def task_source(name: str) -> Callable:
    """Registers a user's loader ``(spark, path) -> DataFrame`` whose rows become tasks."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        LOADERS[name] = fn
        return fn

    return keep


def load_tasks(spark: SparkSession, name: str, path: str, split: str | None = None) -> DataFrame:
    """Tasks of a registered loader, of one split if named; an unknown loader is an error."""
    if name not in LOADERS:
        raise ValueError(f"no task source named {name!r}")
    tasks = as_tasks(LOADERS[name](spark, path), {})
    return tasks if split is None else tasks.where(F.col("set") == split)
