"""Report, metric and submission sinks; each task writes its own files, and nothing passes through the driver."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, else the context's checkpoint folder; set to a new local one only where master and executors are one machine's process.

    On a cluster without either it is an error: executors would write to disks that others can't read.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.match(r"local(\[[^-]*\])?$", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_folder(spark)}/runlens-{uuid.uuid4().hex}/{name}"


def write_metrics(metrics: DataFrame, path: str, *levels: str) -> None:
    """JSON documents under a folder for each value of the level columns (system, benchmark, split, run_id)."""
    metrics.write.mode("overwrite").partitionBy(*levels).json(path)


def write_results(results: DataFrame, path: str, score: str = "score") -> None:
    """``path/csv`` (arrays, maps and structs as JSON text), ``path/all`` and ``path/failed`` (score 0) as JSON Lines."""
    nested = {f.name for f in results.schema if f.dataType.typeName() in ("array", "map", "struct")}
    flat = results.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in results.columns))
    flat.write.mode("overwrite").csv(f"{path}/csv", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="")
    results.write.mode("overwrite").json(f"{path}/all")
    results.where(F.col(score) == 0).write.mode("overwrite").json(f"{path}/failed")


def write_submission(answers: DataFrame, path: str, task_id: Column, answer: Column, *more: Column) -> None:
    """JSON Lines of task_id and model_answer; a null answer is written as an empty one."""
    answers.select(task_id.alias("task_id"), F.coalesce(answer, F.lit("")).alias("model_answer"), *more).write.mode("overwrite").json(path)
