"""Token ids in files, coded by a static range asymmetric numeral system.

A file set is a folder with three Parquet tables: ``freq`` (the shared
frequency table), ``blocks`` and ``files``. A block holds the ids of whole
documents and can be read alone: symbol i belongs to lane i mod LANES, the lanes
share one stream of 32-bit words, and their states are kept at the start and
again every CHECK_STEPS steps, with the place in the stream. From these
checkpoints the parts of a block are decoded side by side, and single documents
without the parts before them. Each block carries a CRC-32 of its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_sized, scratch_dir, stored, table, text_rows
from .tokens import Units, tokenizer_path

LANES, CHECK_STEPS, SCALE = 1024, 128, 20
#: Ids after which a block is closed (a document stays in one block), ids in a file on average.
BLOCK_IDS, FILE_IDS = 1 << 19, 1 << 22
LOW = np.uint64(1 << 31)
U32 = np.uint64(32)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts as frequencies that sum to 2**scale, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << scale
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    used = counts > 0
    if used.sum() > size:
        raise ValueError("more ids than the scale holds")
    out[used] = np.maximum(1, counts[used].astype(object) * size // total).astype(np.int64)
    left = size - int(out.sum())
    if left > 0:
        out[int(out.argmax())] += left
    while left < 0:  # the largest give way
        order = np.argsort(-out, kind="stable")[:1024]
        give = np.minimum(out[order] // 2, -left)
        upto = np.cumsum(give)
        give = np.where(upto <= -left, give, np.maximum(0, give - (upto + left)))
        out[order] -= give
        left += int(give.sum())
    return out


class Coder:
    """The shared table, with what encoding and decoding look up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(words, checkpoints): the stream, and at every CHECK_STEPS steps the place in it and the lanes' states."""
        steps = -(-len(ids) // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        scale, mask = np.uint64(SCALE), np.uint64(63 - SCALE)
        sent = 0
        for step in range(steps - 1, -1, -1):
            x = ids[step * LANES : (step + 1) * LANES]
            n, f = len(x), self.freq[x]
            s = state[:n]
            full = s >= (f << mask)
            if full.any():
                out = s[full]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                sent += len(out)
                s[full] = out >> U32
            q, r = np.divmod(s, f)
            state[:n] = (q << scale) + r + self.start[x]
            if step % CHECK_STEPS == 0:
                marks.append((sent, state.copy()))
        table = np.array([[sent - at, *s] for at, s in marks[::-1]], "<u8")
        return b"".join(w.tobytes() for w in words[::-1]), table.tobytes()

    def decode(self, words: bytes, checkpoints: bytes, n: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of a block of ``n``: the parts that hold them, from their checkpoints on and side by side."""
        end = n if end is None else end
        if begin >= end:
            return np.zeros(0, np.uint32)
        stream, part = np.frombuffer(words, "<u4"), CHECK_STEPS * LANES
        first = begin // part
        marks = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)[first : -(-end // part)]
        at, state = marks[:, 0].astype(np.int64), marks[:, 1:].copy()
        out = np.zeros((len(marks), CHECK_STEPS, LANES), np.uint32)
        left = n - (first + len(marks) - 1) * part  # of the last part
        scale, mask, steps = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), CHECK_STEPS if len(marks) > 1 else min(CHECK_STEPS, -(-left // LANES))
        for step in range(steps):
            slot = state & mask
            x = self.symbol[slot]
            out[:, step] = x
            state = self.freq[x] * (state >> scale) + slot - self.start[x]
            low = state < LOW
            if left < part:  # lanes of the last part that have no id any more
                low[-1, max(0, left - step * LANES) :] = False
            taken = np.cumsum(low, 1)
            state[low] = (state[low] << U32) | stream[(at[:, None] + taken - 1)[low]].astype(np.uint64)
            at += taken[:, -1]
        return out.reshape(-1)[begin - first * part : end - first * part]


def coder_of(freq: DataFrame) -> Coder:
    """From the table of frequencies, which has at most one row for each id of the vocabulary."""
    rows = freq.orderBy("id").collect()
    out = np.zeros(rows[-1].id + 1 if rows else 1, np.int64)
    for r in rows:
        out[r.id] = r.freq
    return Coder(out)


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (doc_id, n, ids) of every text with the end id, ids packed; and rows (id, count): how often each id occurs in a task's texts."""
    names = ["doc_id", "n", "ids", "id", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = Units.of(tokenizer), np.zeros(1 << 16, np.int64)
        for batch in batches:
            sizes, blobs = [], []
            for ids, ends in units.encode(batch.column(1).to_pylist()):
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                total = added(total, np.bincount(ids))
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    sizes.append(b - a)
                    blobs.append(packed(ids[a:b]))
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), none, none], names)
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), pa.array(total[used])], names)

    return docs.mapInArrow(run, "doc_id long, n long, ids binary, id long, count long")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def packed(ids: np.ndarray) -> bytes:
    """Ids as byte planes, compressed; the first byte says how many planes."""
    import zstandard

    planes = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1, write_checksum=False).compress(raw.tobytes())


def unpacked(blob: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:], max_output_size=n * blob[0]), np.uint8).reshape(blob[0], n)
    out = np.zeros((n, 4), np.uint8)
    out[:, : blob[0]] = raw.T
    return out.reshape(-1).view("<u4")


BLOCKS = "file long, block long, doc_ids array<long>, lengths array<long>, n long, crc32 long, checkpoints binary, words binary"


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the ids of every text, each followed by ``end_id``, to ``path`` in ascending order of ``id_col``.

    Texts are encoded once, into a table in the shared folder; the frequency
    table counts all of it, in the same pass. File numbers follow ranges of ids, so numbering and
    order hold whatever the number of partitions. Null text counts as empty (its
    ids are the end id alone), null ids come first, rows with equal ids stay
    next to each other in order of length and content.
    """
    spark = df.sparkSession
    tokens = stored(token_table(text_rows(df, id_col, text_col), tokenizer or tokenizer_path("word_bpe_49k.json"), end_id), "tokens")
    counts = tokens.where("id is not null").groupBy("id").agg(F.sum("count").alias("count")).collect()  # a row for each id of the vocabulary
    tokens = tokens.where("n is not null").select("doc_id", "n", "ids")
    count = np.zeros(max([0, *(r.id for r in counts)]) + 1, np.int64)
    for r in counts:
        count[r.id] = r["count"]
    freq = scaled(count)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id long, freq long").coalesce(1).write.parquet(f"{path}/freq")
    shared = spark.sparkContext.broadcast(Coder(freq))  # a row for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, names = TaskContext.get().partitionId(), [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        held: list[np.ndarray] = []
        docs: list[int] = []
        size = block = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, marks = shared.value.encode(ids)
            row = [file, block, docs, [*map(len, held)], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), marks, words]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names)

        for batch in batches:
            for doc, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(unpacked(blob, n))
                docs.append(doc)
                size += n
                if size >= BLOCK_IDS:
                    yield close()
                    held, docs, size, block = [], [], 0, block + 1
        if held:
            yield close()

    parts = max(1, -(-int(count.sum()) // FILE_IDS))
    ranged = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    ranged.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))  # one row for each partition
    files.select("file", "n", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start")).coalesce(1).write.parquet(f"{path}/files")


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a file set with ``at``, the number of ids before each."""
    blocks = spark.read.parquet(f"{path}/blocks")
    places = blocks.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("inside"))
    files = spark.read.parquet(f"{path}/files").select("file", F.col("start").alias("first"))
    starts = stored(places.join(files.hint("merge"), "file").select("file", "block", (F.col("first") + F.col("inside")).alias("at")), "starts")
    return join_sized(blocks, starts, ["file", "block"], "inner", starts.count())


def read_ids(spark: SparkSession, path: str, with_ids: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 (and ids).

    Blocks are decoded alone, the parts of a block side by side. A block whose
    checksum fails raises an error. With ``only`` (doc_id) just those documents
    are decoded, from the checkpoint before each on, and no block's checksum is
    held against its ids.
    """
    shared = spark.sparkContext.broadcast(coder_of(spark.read.parquet(f"{path}/freq")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    columns = ["doc_ids", "lengths", "n", "crc32", "checkpoints", "words", "at"]
    blocks = block_table(spark, path)
    if only is not None:
        wanted = stored(only.select("doc_id").distinct(), "wanted")
        places = blocks.select("file", "block", F.posexplode(F.arrays_zip("doc_ids")).alias("place", "d")).select("file", "block", "place", F.col("d.doc_ids").alias("doc_id"))
        hits = join_sized(places, wanted, "doc_id", "left_semi", wanted.count()).groupBy("file", "block").agg(F.array_sort(F.collect_set("place")).alias("places"))
        hits = stored(hits, "hits")
        blocks = join_sized(blocks, hits, ["file", "block"], "inner", hits.count())
        columns = [*columns, "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, lengths, n, crc, marks, words, at, *some = (c[k].as_py() for c in batch.columns)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                if some:
                    begins, ends, docs = begins[some[0]], ends[some[0]], [docs[i] for i in some[0]]
                    each = [shared.value.decode(words, marks, n, a, b) for a, b in zip(begins.tolist(), ends.tolist())]
                    ids = np.concatenate(each)
                else:
                    ids = shared.value.decode(words, marks, n)
                raw = ids.astype("<u4").tobytes()
                if not some and zlib.crc32(raw) != crc:
                    raise ValueError(f"checksum of the block at {at} fails")
                upto = np.append(0, np.cumsum(ends - begins))
                out = [pa.array(docs, pa.int64()), pa.array(begins + at, pa.int64()), pa.array(ends - begins, pa.int64())]
                out.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto.tolist(), upto[1:].tolist())], pa.int64()))
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return blocks.select(*columns).mapInArrow(run, schema)


def op4_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/ids"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, with_ids=False)
