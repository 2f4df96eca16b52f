"""What the corpus operators share: the shared scratch folder, written intermediate tables, size-checked joins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

#: A side is broadcast only when it was counted and holds at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch while tables are written, and the setting for it.
BATCH, ARROW_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Columns that number the rows of a pipeline stage, and name their file.
ROW, FILE = "_runlens_row", "_runlens_file"
#: Places in a bitmap of kept rows (4 KB, the size that bitmap_construct_agg makes), bitmaps that are broadcast at most, and their columns.
BITMAP, BITMAPS, BUCKET, BITS = 32_768, 16_384, "_runlens_bucket", "_runlens_bits"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    importable(spark)
    return f"{shared_folder(spark)}/runlens-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, gives true sizes.

    While it is written, Arrow batches have BATCH rows at most: whole texts of
    10,000 rows, in the executor and its Python workers, take much of a small
    executor's memory.
    """
    path, conf = f"{scratch_dir(df.sparkSession)}/{what}", df.sparkSession.conf
    was = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, BATCH if int(was) <= 0 else min(int(was), BATCH))
    try:
        df.write.parquet(path)
    finally:
        conf.set(ARROW_ROWS, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join with a stored right side of ``rows`` counted rows: broadcast within BROADCAST_ROWS, else sort-merge."""
    hint = "broadcast" if rows <= BROADCAST_ROWS else "merge"
    return left.join(right.hint(hint), on, how)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, in ROW: ids may be null or occur twice.

    Rows read from Parquet files are numbered by file and place in it, the same
    whenever they are read; no copy is made. Other rows, frames that give a
    stored row more than once (a file listed twice, an explode), and those of
    more than BROADCAST_ROWS files are written once with their numbers.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        files = sorted(r[0] for r in placed.select(FILE).distinct().limit(BROADCAST_ROWS + 1).collect())
    except AnalysisException:  # not a scan of files
        files = []
    if 0 < len(files) <= BROADCAST_ROWS:
        number = docs.sparkSession.createDataFrame([(f, i << 36) for i, f in enumerate(files)], f"{FILE} string, _number long")
        rows = placed.join(F.broadcast(number), FILE).withColumn(ROW, F.col("_number") + F.col(ROW)).select(*docs.columns, ROW)
        if rows.groupBy(ROW).count().where("count > 1").isEmpty():  # reads no column of docs
            return rows
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def chosen(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of numbered ``rows`` whose number is in ``kept``, without the number.

    Numbers are dense within a file, so the kept ones become bitmaps of BITMAP
    places, which are broadcast if at most BITMAPS of them were counted: then no
    text is shuffled. Beyond that the join is shuffled.
    """
    columns = [c for c in rows.columns if c != ROW]
    held = stored(kept.select(ROW), "kept")
    places = held.select(F.expr(f"{ROW} div {BITMAP}").alias(BUCKET), F.expr(f"{ROW} % {BITMAP}").alias("place"))
    bits = stored(places.repartition(BUCKET).groupBy(BUCKET).agg(F.bitmap_construct_agg("place").alias(BITS)), "bitmaps")
    if bits.count() > BITMAPS:
        return rows.join(held.hint("merge"), ROW, "left_semi").select(columns)
    byte = f"conv(hex(substring({BITS}, cast({ROW} % {BITMAP} div 8 + 1 as int), 1)), 16, 10)"
    return rows.withColumn(BUCKET, F.expr(f"{ROW} div {BITMAP}")).join(F.broadcast(bits), BUCKET).where(f"bit_get(cast({byte} as int), cast({ROW} % 8 as int)) = 1").select(columns)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster it is installed there or shipped with --py-files."""
    root, held = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = held.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def text_rows(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names; other columns, clashing names too, stay out."""
    importable(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
