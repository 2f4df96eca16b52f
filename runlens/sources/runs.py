"""Run directories, modified files and report files."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .tasks import read_csv

#: The five files of a task directory: glob and schema.
RUN_FILES = {
    "answers": ("*_answer.json", "answer string, screenshots array<string>, target_final_url string, intermediate_url_list array<string>"),
    "scores": ("score.json", "score string, reasoning string, metadata string"),
    "times": ("times.json", "start_time double, end_time double, duration double"),
    "messages": ("*_messages.json", "source string, content string, timestamp string, metadata map<string,string>"),
    "usage": ("model_tokens_usage.json", "value map<string,struct<prompt_tokens:bigint,completion_tokens:bigint>>"),
}
LEVELS = ["system", "benchmark", "split", "run_id", "task_id"]
#: Names and extensions that a listing of modified files leaves out.
IGNORED = r"/(__pycache__|__init__\.py)(/|$)|[^/]\.(pyc|cache)$"
VALUE, SPACE = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n]*").match


def read_run_dirs(spark: SparkSession, root: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables answers, scores, times, messages, usage over ``root/system/benchmark/split/run_id/task_id``.

    The path's last five levels become columns (without a leading ``name=``). A
    score is a map always: a number is ``{"score": x}``. Usage has a row a client.
    Files that don't parse give nulls. ``files`` names the tables to read, and
    their files where those are called otherwise. In a ``file:`` folder the
    driver looks for the runs alone; tasks list their folders and open the files.
    In other stores Spark's reader does it, and the driver holds a list of files.
    """
    out, root = {}, root.rstrip("/")
    tasks = task_folders(spark, root) if local_path(spark, root) else None
    for name, file in (files or {n: f for n, (f, _) in RUN_FILES.items()}).items():
        schema = RUN_FILES[name][1]
        if tasks is None:
            df = listed_files(spark, root, file, None if name == "usage" else schema)
        else:
            pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(file).compiled().pattern()
            df = opened_files(tasks, pattern) if name == "usage" else parsed(opened_files(tasks, pattern, schema), schema)
        if name == "usage":
            df = df.select(F.explode(F.from_json("value", schema.split(" ", 1)[1])).alias("client", "use"), "folder").select("client", "use.*", "folder")
        if name == "scores":
            number = F.col("score").try_cast("double")
            df = df.withColumn("score", F.when(number.isNotNull(), F.create_map(F.lit("score"), number)).otherwise(F.from_json("score", "map<string,double>")))
        parts = F.split("folder", "/")
        out[name] = df.select(*(unescaped(F.element_at(parts, i - len(LEVELS)), c).alias(c) for i, c in enumerate(LEVELS)), *(c for c in df.columns if c != "folder"))
    return out


def local_path(spark: SparkSession, root: str) -> str | None:
    """The path by which tasks can open a folder themselves; None in a store that only Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def folders(at: str, depth: int = 1) -> Iterator[str]:
    """Folders so many levels below ``at``."""
    with os.scandir(at) as found:
        for x in found:
            if x.is_dir():
                yield from folders(x.path, depth - 1) if depth > 1 else (x.path,)


def task_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders of tasks below ``root``, whatever they are called, dealt over the cores."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(root)
    runs = [(at,) for x in found for at in folders(x.getPath().toUri().getPath(), len(LEVELS) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (task for batch in batches for at in batch.column(0).to_pylist() for task in folders(at))
        for some in iter(lambda: [*islice(found, 10_000)], []):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["folder"])

    return spread(spark.createDataFrame(runs, "run string").mapInArrow(run, "folder string"), "folder")


def opened_files(tasks: DataFrame, pattern: str, schema: str | None = None) -> DataFrame:
    """folder and text of the files called by a regular expression; blank files are left out.

    With a schema, text that can't be decoded is null, and what stands in the
    place of a string is quoted, else ``from_json`` would write numbers anew.
    """
    kind = StructType.fromDDL(schema) if schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, out, held = re.compile(pattern, re.DOTALL), [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                task = folder.rpartition("/")[2]
                for name in sorted(filter(wanted.fullmatch, os.listdir(folder))):
                    if name[0] in "._" and not name.startswith(task) or not os.path.isfile(path := f"{folder}/{name}"):
                        continue
                    with open(path, "rb") as f:
                        text = decoded(f.read(), "strict" if kind else "replace")
                    if text is None or text.strip(" \t\r\n"):
                        out.append((folder, quoted(text, kind) if text and kind else text))
                        held += len(text or "")
                if len(out) >= 1_000 or held >= 1 << 22:
                    yield table(out)
                    out, held = [], 0
        yield table(out)

    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["folder", "value"])
    return tasks.mapInArrow(run, "folder string, value string")


def decoded(raw: bytes, errors: str) -> str | None:
    """JSON's text, in the encoding that its first bytes tell."""
    try:
        return raw.decode(json.detect_encoding(raw), errors)
    except UnicodeDecodeError:
        return None


def quoted(text: str, kind: StructType) -> str:
    """A JSON text with its numbers, objects and other values as strings, as they are written, where the type has strings; as it is if it doesn't parse."""
    at = SPACE(text).end()
    try:
        value, end = quoted_value(text, at, ArrayType(kind) if text[at] == "[" else kind)
    except (ValueError, RecursionError):
        return text
    return value + text[end:]


def quoted_value(text: str, at: int, kind: DataType | None) -> tuple[str, int]:
    """The value at a place, and its end."""
    end = VALUE(text, at)[1]
    first, out = text[at], []
    if isinstance(kind, StringType) and first != '"' and text[at:end] != "null":
        return json.dumps(text[at:end]), end
    if not isinstance(kind, {"{": (StructType, MapType), "[": ArrayType}.get(first, ())):
        return text[at:end], end
    at = SPACE(text, at + 1).end()
    while at < end - 1:
        key, inner = "", kind.elementType if first == "[" else None
        if first == "{":
            name, stop = VALUE(text, at)
            key, at = f"{text[at:stop]}:", SPACE(text, SPACE(text, stop).end() + 1).end()  # behind the colon
            inner = kind.valueType if isinstance(kind, MapType) else kind[name].dataType if name in kind.names else None
        value, at = quoted_value(text, at, inner)
        out.append(key + value)
        at = SPACE(text, SPACE(text, at).end() + 1).end()  # behind the comma
    return first + ",".join(out) + text[end - 1], end


def unescaped(name: Column, column: str) -> Column:
    """A folder's name, or what stands behind ``column=`` in one as Spark writes it."""
    value = F.substr(name, F.lit(len(column) + 2))
    return F.when(F.startswith(name, F.lit(f"{column}=")), F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)).otherwise(name)


def parsed(df: DataFrame, schema: str) -> DataFrame:
    """The rows of each JSON text, an object or an array of them; one row of nulls for what doesn't parse."""
    one = F.array(F.from_json("value", f"struct<{schema}>"))
    many = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(one)
    return df.select(F.inline(F.coalesce(many, F.array(F.lit(None).cast(f"struct<{schema}>")))), "folder")


def listed_files(spark: SparkSession, root: str, file: str, schema: str | None) -> DataFrame:
    """The same by Spark's reader, text without a schema. Folders are listed by tasks; the driver looks for those of runs, and for folders of tasks that Spark takes for hidden ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth() + len(LEVELS) + 1
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file)
    paths = f"{root}/*/*/*/{{*,*/[_.]*}}"
    df = read.schema(schema).json(paths, multiLine=True) if schema else read.text(paths, wholetext=True)
    at = F.split(F.regexp_replace("path", "^[^:/]+:(//[^/]*)?", ""), "/")
    rows = df.select("*", F.col("_metadata.file_path").alias("path")).where(F.size(at) == depth + 1)  # files of the tasks' folders alone
    return rows.select(*df.columns, F.try_url_decode(F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("+"), F.lit("%2B"))).alias("folder"))


def write_run_dirs(rows: DataFrame, root: str, dealt: bool = False) -> None:
    """A folder ``root/system=…/benchmark=…/split=…/run_id=…/task_id=…`` of JSON for each task, of the columns besides LEVELS.

    ``root`` is new. Tasks are dealt over all cores, few bytes or many, unless
    they are ``dealt``: spread by a key of theirs. In a ``file:`` folder each
    makes its own folders and files: Hadoop would start processes for the rights
    of each of them. In other stores Spark's writer does it, and each task moves
    its own files in; moving all of them at the end is the driver's work alone,
    and far slower.
    """
    rows = rows if dealt else spread(rows, *LEVELS)
    at = local_path(rows.sparkSession, root)
    if not at:
        rows.write.partitionBy(*LEVELS).option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(root)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (([x.as_py() for x in row[:-1]], row[-1].as_py()) for batch in batches for row in zip(*batch.columns, strict=True))
        for task, lines in groupby(named, itemgetter(0)):
            folder = "/".join([at, *(f"{c}={escaped(x)}" for c, x in zip(LEVELS, task, strict=True))])
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{uuid.uuid4().hex}"  # no reader sees it before it is whole, whichever attempt of the Spark task ends first
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{line}\n" for _, line in lines)
            os.replace(part, f"{folder}/part-00000.json")
        yield from ()

    os.makedirs(at)
    value = F.to_json(F.struct(*(c for c in rows.columns if c not in LEVELS)))
    rows.sortWithinPartitions(*LEVELS).select(*(F.col(c).cast("string") for c in LEVELS), value.alias("value")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def escaped(value: str | None) -> str:
    """A level's value as Spark's writer names its folder, but that an empty text isn't null."""
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value is not None else "__HIVE_DEFAULT_PARTITION__"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a few tasks for each core, or as many as shuffles have: for work that goes by files or rows, not by bytes alone."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def list_modified_files(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """path, name, extension, modified of files changed in [start, end] (ISO instants), by extension and name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kept = files.where(F.col("modified").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))) & ~F.col("path").rlike(IGNORED))
    return kept.withColumn("name", name).withColumn("extension", ext).select("path", "name", "extension", "modified").orderBy("extension", "name", "path")


def read_results_csv(spark: SparkSession, path: str, schema: str, lists: dict[str, str]) -> DataFrame:
    """A report CSV; columns in ``lists`` hold JSON text and get the named type, null if they don't parse."""
    df = read_csv(spark, path, schema)
    return df.select(*(F.from_json(c, lists[c]).alias(c) if c in lists else F.col(c) for c in df.columns))
