"""Message streams: ingest, status, monitors, timeouts, duplicates, file arrivals, scoring on arrival.

Every function takes a streaming DataFrame. State and progress live in the
query's checkpoint, so a restarted query goes on where it stopped. Rows later
than the watermark are dropped by Spark, which counts them in the progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.text import score_token_f1
from ..operators.metrics import latest

LATE = "10 minutes"
#: Errors that abort a monitor, longest wait in seconds after an error.
MOST_ERRORS, ERROR_WAIT = 3, 30
#: Buckets of runs whose state is kept together; columns that are flags.
BUCKETS = 4096
FLAGS = {"null_run", "null_at", "null_time", "met", "error", "waits", "over"}

#: The state store of every query: off the heap, with changes alone in a checkpoint; the setting for it.
STORE, STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """The query, started with STORE; one that is started again keeps the store of its checkpoint."""
    was = spark.conf.get(STORE_CLASS)
    spark.conf.set(STORE_CLASS, STORE)
    try:
        return writer.start()
    finally:
        spark.conf.set(STORE_CLASS, was)


def appended(stream: DataFrame, path: str) -> StreamingQuery:
    """Available rows of a stream, each written once, as Parquet under ``path``."""
    return started(stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/_progress").outputMode("append").trigger(availableNow=True), stream.sparkSession)


def updated(stream: DataFrame, path: str) -> StreamingQuery:
    """Changed rows of each batch under ``path/rows/batch=N``; a batch that is run again replaces its own folder."""
    save = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    return started(stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/_progress").outputMode("update").trigger(availableNow=True), stream.sparkSession)


def newest(spark: SparkSession, path: str, schema, *keys: str) -> DataFrame:
    """The last version of each key that ``updated`` has written."""
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn("batch", F.regexp_extract("_metadata.file_path", r"batch=(\d+)", 1).cast("long"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("r")).select("r.*")


def message_ingest(stream: DataFrame, internal: Column, kind: Column) -> DataFrame:
    """Messages for users, with their kind; a null flag counts as visible."""
    return stream.where(~F.coalesce(internal, F.lit(False))).withColumn("kind", kind)


def status_tracker(stream: DataFrame, run: str, status: Column, *order: str) -> DataFrame:
    """Per run the status of the row that is last by event time, whenever it arrives."""
    return stream.groupBy(run).agg(F.max_by(status, F.struct(*order)).alias("status"))


def windowed_condition(stream: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], least: int, late: str = LATE) -> DataFrame:
    """Windows (tumbling, or sliding by ``slide``) with at least ``least`` rows a key."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = stream.withWatermark(ts, late).groupBy(win.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), *keys, "n")


def event_dedupe(stream: DataFrame, ts: str, keys: list[str], late: str = LATE) -> DataFrame:
    """One row for each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def file_arrivals(stream: DataFrame, uploaded: DataFrame) -> DataFrame:
    """path, name, modified of files newly seen that weren't uploaded (by name); the file source remembers what it has seen."""
    files = stream.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    return files.where(~F.col("name").startswith("tmp_code") & ~F.col("name").startswith("supervisord.pid")).join(uploaded.select("name").distinct(), "name", "left_anti").select("path", "name", "modified")


def final_files(files: DataFrame) -> DataFrame:
    """The last file of each name."""
    return latest(files, "name", "modified", "path")


def score_on_arrival(answers: DataFrame, tasks: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Answers joined to the tasks table as they come, with their token score; answers without a task wait for none and go."""
    return answers.join(tasks, key).withColumn("score", score_token_f1(F.col(gold), F.col(pred)))


def bucketed(stream: DataFrame, run: str, order: str, *cols: Column) -> DataFrame:
    """``cols`` beside run and at (0 for null, which null_run and null_at tell), and the run's bucket.

    The state of a bucket's runs is kept together, so that Python is called for
    each bucket of a batch, not for each run. BUCKETS is part of a checkpoint.
    """
    key, at = F.col(run).cast("long"), F.col(order).cast("long")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
    return stream.select(bucket, key.isNull().alias("null_run"), F.coalesce(key, F.lit(0)).alias("run"), at.isNull().alias("null_at"), F.coalesce(at, F.lit(0)).alias("at"), *cols)


def fields(*names: str) -> np.dtype:
    return np.dtype([(n, bool if n in FLAGS else np.int64) for n in names])


def schema_of(kind: np.dtype) -> str:
    return f"runs array<struct<{', '.join(f'{n}: {"boolean" if n in FLAGS else "long"}' for n in kind.names)}>>"


def runs_of(group: GroupState, kind: np.dtype) -> np.ndarray:
    """The state of a bucket, one element a run."""
    return np.array([tuple(r) for r in group.getOption[0]] if group.exists else [], kind)


def ordered(rows: np.ndarray, *names: str) -> np.ndarray:
    return rows[np.lexsort([rows[n] for n in reversed(names)])]


def firsts(rows: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its run, in rows ordered by run."""
    first = np.ones(len(rows), bool)
    first[1:] = (rows["run"][1:] != rows["run"][:-1]) | (rows["null_run"][1:] != rows["null_run"][:-1])
    return first


def folded(held: np.ndarray, chunks: Iterator[pd.DataFrame], fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Chunks folded into what is held, whenever they have as many rows as that, so that rows held are not folded anew with every chunk."""
    parts, more = [held], 0
    for chunk in chunks:
        rows = np.empty(len(chunk), held.dtype)
        for n in held.dtype.names:
            rows[n] = chunk[n].to_numpy()
        parts.append(rows)
        more += len(rows)
        if more >= len(parts[0]):
            parts, more = [fold(np.concatenate(parts))], 0
    return fold(np.concatenate(parts)) if more else parts[0]


def nullable(rows: np.ndarray, name: str) -> pd.api.extensions.ExtensionArray:
    """A column with its nulls; never as floats, which would round long ids."""
    return pd.arrays.IntegerArray(rows[name].copy(), rows[f"null_{name}"].copy())


def monitor(stream: DataFrame, run: str, ts: str, met: Column, error: Column, most_checks: int, sleep: int, order: str) -> DataFrame:
    """A row for each check of a run until it completes or aborts: check_number, errors, status, next_check.

    A check completes the monitor when ``met`` holds or it is number
    ``most_checks``; the third error aborts it; else it sleeps, after an error at
    most 30 seconds, so one that fails as number ``most_checks`` or later leaves
    the end to the next. Rows after the end are ignored. Null flags count as false.
    Within a batch rows run by event time and ``order``; they are read in chunks,
    and no more of a run than the checks it has left are held, errors beyond
    ``most_checks`` among them. The state is kept by buckets of runs.
    """
    time = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = bucketed(stream, run, order, time.isNull().alias("null_time"), F.coalesce(time, F.lit(0)).alias("time"), F.coalesce(met, F.lit(False)).alias("met"), F.coalesce(error, F.lit(False)).alias("error"))
    kept, read = fields("null_run", "run", "checks", "errors", "over"), fields("null_run", "run", "null_at", "at", "null_time", "time", "met", "error")
    most = most_checks + MOST_ERRORS - 1

    def checked(key: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        runs = {(null, run): (checks, errors, over) for null, run, checks, errors, over in runs_of(group, kept).tolist()}

        def left(run: tuple) -> int:
            checks, _, over = runs.get(run, (0, 0, False))
            return 0 if over else most - checks

        def soonest(rows: np.ndarray) -> np.ndarray:
            rows = ordered(rows, "null_run", "run", "null_time", "time", "null_at", "at")
            start = np.flatnonzero(firsts(rows))
            size = np.diff(start, append=len(rows))
            lefts = np.array([left(r) for r in rows[["null_run", "run"]][start].tolist()], np.int64)
            return rows[np.arange(len(rows)) - np.repeat(start, size) < np.repeat(lefts, size)]

        held, out = folded(np.empty(0, read), chunks, soonest), []
        keep = np.zeros(len(held), bool)
        for n, (null, run, _, _, _, _, met, error) in enumerate(held.tolist()):
            checks, errors, over = runs.get((null, run), (0, 0, False))
            if over:
                continue
            checks, errors, keep[n] = checks + 1, errors + error, True
            if error:
                status = "aborted" if errors >= MOST_ERRORS else "error"
            else:
                status = "complete" if met or checks >= most_checks else "sleeping"
            over = status in ("aborted", "complete")
            runs[null, run] = checks, errors, over
            out.append((checks, errors, status, 0 if over else min(sleep, ERROR_WAIT) if error else sleep))
        group.update(([(*k, *v) for k, v in runs.items()],))
        if out:
            number, errors, status, wait = zip(*out)
            yield pd.DataFrame({"run": nullable(held[keep], "run"), "at": nullable(held[keep], "at"), "check_number": number, "errors": errors, "status": status, "next_check": wait})

    return rows.groupBy("bucket").applyInPandasWithState(checked, "run long, at long, check_number long, errors long, status string, next_check long", schema_of(kept), "append", "NoTimeout")


def input_timeout(stream: DataFrame, run: str, ts: str, order: str, waiting: Column, seconds: int = 3600, late: str = LATE) -> DataFrame:
    """run, at, stopped_at: waits for input that lasted over ``seconds``, told by the next row of the run or by a timer on the watermark.

    Whether the very last row of a run has waited too long is known once the
    watermark has passed its limit. Rows without a time are left out. Rows are
    read in chunks, each reduced to its runs' stretches without a gap over
    ``seconds``, so what is held grows with the runs of a bucket and the hours a
    batch covers, not with its rows. The state is the last row of each run, kept
    by buckets of runs until the watermark has passed it.
    """
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).where("_ts is not null").withWatermark("_ts", late)
    rows = bucketed(rows, run, order, F.col("_ts"), F.unix_micros("_ts").alias("start"), F.unix_micros("_ts").alias("end"), F.coalesce(waiting, F.lit(False)).alias("waits"))
    limit, kept = seconds * 1_000_000, fields("null_run", "run", "null_at", "at", "start", "end", "waits")

    def stretches(rows: np.ndarray) -> np.ndarray:
        """Stretches of each run in order of time, each with its first time and its last row."""
        rows = ordered(rows, "null_run", "run", "start", "end")
        new = firsts(rows)
        base, ends = new.cumsum() * len(rows), np.sort(rows["end"])
        latest_end = ends[np.maximum.accumulate(base + np.searchsorted(ends, rows["end"])) - base]  # within the run
        new[1:] |= rows["start"][1:] - latest_end[:-1] > limit
        n = new.cumsum()
        rows["start"] = rows["start"][new][n - 1]
        by_end = np.lexsort([rows["at"], rows["null_at"], rows["end"], n])
        return rows[by_end[np.append(np.flatnonzero(new)[1:], len(rows)) - 1]]

    def waited(key: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = runs_of(group, kept)
        if not group.hasTimedOut:
            held = folded(held, chunks, stretches)
        mark = group.getCurrentWatermarkMs()
        passed = (held["end"] + limit * held["waits"]) // 1000
        stays = np.append(firsts(held)[1:], True) & (passed >= mark)
        if stays.any():
            last = held[stays]
            last["start"] = last["end"]
            group.update((last.tolist(),))
            group.setTimeoutTimestamp(max(int(passed[stays].min()), mark + 1))
        elif group.exists:
            group.remove()
        out = held[~stays & held["waits"]]
        if len(out):
            yield pd.DataFrame({"run": nullable(out, "run"), "at": nullable(out, "at"), "stopped_at": pd.array(out["end"] + limit, "Int64")})

    out = rows.groupBy("bucket").applyInPandasWithState(waited, "run long, at long, stopped_at long", schema_of(kept), "append", "EventTimeTimeout")
    return out.withColumn("stopped_at", F.timestamp_micros("stopped_at"))


def input_timeout_batch(rows: DataFrame, run: str, ts: str, order: str, waiting: Column, seconds: int = 3600) -> DataFrame:
    """The same over a table for waits that a later row of the run ended.

    Rows fall into session windows of a run; such a wait is the last row of a
    session that isn't the run's last. Only sessions, over ``seconds`` apart, are
    put in order, not the rows.
    """
    at = F.struct(F.col(ts), F.col(order))
    last = rows.groupBy(run, F.session_window(ts, f"{seconds} seconds 1 microsecond").alias("_s")).agg(F.max_by(F.struct(*rows.columns, F.coalesce(waiting, F.lit(False)).alias("_waits")), at).alias("_r"))
    later = F.lead("_s").over(Window.partitionBy(run).orderBy("_s.start"))
    return last.withColumn("_later", later).where("_r._waits and _later is not null").select("_r.*").drop("_waits")
