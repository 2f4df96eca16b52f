"""Bound-certified best-fit packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_rows
from .tokens import Units, tokenizer_path

#: Pieces in a partition on average, and times that open bins are exchanged at most.
GROUP, EXCHANGES = 16_000, 4

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, part long, sequence_id long, offset long, certified boolean, open boolean"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids of every text with its end id; only longer texts are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, end = Units.of(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            docs, texts, rows = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            at = 0
            for ids, ends in units.encode(texts):
                flat = ids.astype("<u4").tobytes()
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    raw = flat[4 * a : 4 * b] + end
                    for k in range(0, len(raw), 4 * size):
                        out.append((docs[at], rows[at], k // (4 * size), k // 4, len(raw[k : k + 4 * size]) // 4, zlib.crc32(raw[k : k + 4 * size])))
                    at += 1
            yield arrow(out, PIECES)

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [*zip(*rows)] or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Least number of bins that any packing needs, by two families of dual feasible functions.

    For 0 <= t <= size/2: lengths over size - t count whole, lengths under t not
    at all, others as they are. For k = 1..8: x counts as floor((k+1)x/size)/k,
    or as x/size where (k+1)x/size is a whole number.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    upto, many = np.cumsum(n * np.arange(size + 1)), np.cumsum(n)
    t = np.arange(size // 2 + 1)
    best = int(-(-((many[size] - many[size - t]) * size + upto[size - t] - upto[np.maximum(t - 1, 0)]).max() // size))
    x = np.arange(size + 1)
    for k in range(1, 9):  # scaled by k * size
        value = np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size)
        best = max(best, int(-(-(n * value).sum() // (k * size))))
    return best


def best_fit(lengths: list[int], size: int) -> list[int]:
    """Best-fit decreasing: a bin number for each length."""
    bins: list[int] = [0] * len(lengths)
    open_: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room left
    rooms = made = 0  # rooms: bit r set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = size, made, made + 1
        bins[i] = b
        if room > n:
            open_[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def pack(parts: DataFrame, size: int, last: bool, step: int) -> DataFrame:
    """Pack each partition; unless it is the last step, bins that a better packing could save are opened again.

    A partition whose number of bins equals its bound is certified: it opens
    only its bins that are under half full. Others open every bin with over a
    64th of its room left.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = [*zip(*(group.column(c).to_pylist() for c in ("doc_id", "row", "piece", "start", "length", "ids_crc32", "part")))]
        rows.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
        lengths = [r[4] for r in rows]
        bins = best_fit(lengths, size)
        filled = np.bincount(bins, lengths).astype(np.int64)
        sure = len(filled) == lower_bound(np.array(lengths), size)
        spare = size // 2 if sure else size // 64
        at, out = [0] * len(filled), []
        for r, b in zip(rows, bins):
            out.append((*r, step << 56 | r[6] << 24 | b, at[b], bool(sure), not last and bool(size - filled[b] > spare)))
            at[b] += r[4]
        return pa.Table.from_batches([arrow(out, PACKED)])

    return parts.groupBy("part").applyInArrow(run, PACKED)


def best_fit_pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, size: int = 4096, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Pieces are dealt by a hash to partitions of about ``group``; each is packed by
    best-fit decreasing and held against its lower bound. The documents of open
    bins are dealt anew, again to partitions of about ``group``, until one
    partition takes them all or they were exchanged EXCHANGES times; what is left
    then stays as packed, not certified. So no task ever holds much more than
    ``group`` pieces, however few partitions can be certified.

    Null or empty text is one piece with the end id alone. Repeated rows and null
    ids are packed as rows of their own. An empty table gives an empty result.
    """
    docs = text_rows(df, id_col, text_col)
    left = stored(pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, size), "pieces")
    n, done = left.count(), None
    columns = left.columns
    for step in range(EXCHANGES + 1):
        parts = max(1, -(-n // group))
        last = parts == 1 or step == EXCHANGES
        dealt = left.select(*columns, F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(step)), F.lit(parts)).alias("part"))
        packed = stored(pack(dealt, size, last, step), f"packed{step}")
        closed = packed if last else packed.where("not open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = packed.where("open")
        n = left.count()
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
