"""Vector code compression: parts of vectors coded by their nearest codebook entry, found by distances to fixed pivots (LAESA)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, join_sized, stored, table

#: Pivots of each part position, vectors coded together in a task, and the slack that rounding of distances is given.
PIVOTS, TOGETHER, SLACK = 4, 4096, 1e-5


def far_apart(entries: np.ndarray, many: int) -> np.ndarray:
    """``many`` rows of ``entries`` (at most all): the first, then each time the one farthest from those taken."""
    taken = [0]
    nearest = squared(entries, entries[0])
    while len(taken) < min(many, len(entries)):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries, entries[taken[-1]]))
    return entries[taken]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integer vectors, exact."""
    d = a - b
    return (d * d).sum(-1)


def nearest(parts: np.ndarray, held: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance, exact evaluations) of each part's nearest entry, ties to the lower index.

    ``held`` has each part's distances to the pivots, worked out once. By the
    triangle inequality, |part to pivot - pivot to entry| bounds the distance
    from below. Each part evaluates entries by rising bound and stops when the
    next bound is above its best distance: bounds that equal it are evaluated,
    as a tie may have a lower index.
    """
    reach = np.sqrt(squared(pivots[:, None], entries[None]).astype(float))
    bound = np.abs(held[:, 0, None].astype(float) - reach[0])
    for p in range(1, len(pivots)):
        np.maximum(bound, np.abs(held[:, p, None] - reach[p]), out=bound)
    bound = np.maximum(0.0, bound - SLACK * (1 + held.max(1, initial=0.0)[:, None] + reach.max())) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(parts))
    index = order[:, 0].copy()
    best = squared(parts, entries[index])
    done = len(parts)
    for k in range(1, len(entries)):
        at = order[rows, k]
        go = bound[rows, at] <= best[rows]
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        d = squared(parts[rows], entries[at])
        done += len(rows)
        better = (d < best[rows]) | (d == best[rows]) & (at < index[rows])
        best[rows[better]], index[rows[better]] = d[better], at[better]
    return index, best, done


def read(blobs: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), *shape)


def coded(vectors: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(doc, code, error, evaluated) of each stored vector; books are (part, entry, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, held in chunks(batches, books, pivots):
            codes, error, done = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64), 0
            for p, book in enumerate(books):
                codes[:, p], d, n = nearest(x[:, p], held[:, p], book, pivots[p])
                error += d
                done += n
            digits = [r.tobytes().hex() for r in codes.astype(np.uint8)]
            each = np.zeros(len(x), np.int64)
            each[:1] = done
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(digits, pa.string()), pa.array(error), pa.array(each)], ["vec_id", "label", "code", "error", "evaluated"])

    return vectors.mapInArrow(run, "vec_id long, label string, code string, error long, evaluated long")


def chunks(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            yield some.column(0), some.column(1), read(some.column(2), np.int64, (parts, width)), read(some.column(3), np.float32, (parts, pivots.shape[1]))


def moved(vectors: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Books after one round: each entry the floor of the mean of the parts nearest to it; unused entries stay.

    Every task sums for itself; a row for each entry comes to the driver, as
    many as the codebooks have, whatever the number of vectors.
    """
    count, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((count, size), np.int64), np.zeros((count, size, width), np.int64)
        for _, _, x, held in chunks(batches, books, pivots):
            for p, book in enumerate(books):
                index, _, _ = nearest(x[:, p], held[:, p], book, pivots[p])
                n[p] += np.bincount(index, minlength=size)
                np.add.at(sums[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    total = vectors.mapInArrow(run, "part long, entry long, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]  # partial sums of 64 bits, their sum of more
    out = books.copy()
    for r in total.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): a row (vec_id, code, error, label_error, evaluated) for each kept vector, and (part, entry, place) integers.

    Vectors that are null or hold null or non-finite components take no part,
    nor do those of another length than the first kept one, or of a length that
    the parts don't divide. Codebooks start as the ``entries`` first vectors by
    id, null last (of rows that share an id the smaller vectors first); fewer
    vectors make smaller codebooks. Distances to the fixed pivots are worked out
    once and stored with the vectors; each round and the last assignment read
    them. ``label_error`` sums the error of the rows with the same label, null
    labels together. ``evaluated`` counts exact distances, in the first row of
    each batch. Repeated rows are coded each. Components so large that an error
    might not fit a long are refused with an error. Empty table: empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    importable(df.sparkSession)
    finite = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    base = base.where(finite & (F.size("v") > 0) & (F.size("v") % parts == 0)).withColumn("v", F.transform("v", lambda x: x.cast("double")))
    order = [F.col("vec_id").isNull(), "vec_id", "v"]
    head = base.orderBy(*order).limit(1).collect()
    if not head:
        return base.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(0).cast("long").alias("evaluated")), np.zeros((parts, 0, 0), np.int64)
    dims = len(head[0].v)
    width, most = dims // parts, isqrt((1 << 62) // dims) // 2
    large = F.exists("v", lambda x: F.abs(x) * scale >= most)
    base = base.where(F.size("v") == dims).withColumn("v", F.when(large, F.raise_error(F.lit(f"a component times {scale} exceeds {most}"))).otherwise(F.col("v")))
    first = base.orderBy(*order).limit(entries).select(whole(F.col("v"), scale).alias("v")).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    fixed = np.stack([far_apart(b, pivots) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = np.floor(flat * scale).astype(np.int64).reshape(-1, parts, width)
            held = np.sqrt(squared(x[:, :, None], fixed[None]).astype(float)).astype(np.float32)
            blobs = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *blobs], ["vec_id", "label", "x", "held"])

    vectors = stored(base.select("vec_id", "v", "label").mapInArrow(run, "vec_id long, label string, x binary, held binary"), "vectors")
    for _ in range(rounds):
        books = moved(vectors, books, fixed)
    out = stored(coded(vectors, books, fixed), "codes")
    labels = stored(out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("blank", F.col("label").isNull()).fillna("", "label"), "labels")
    named = out.withColumn("blank", F.col("label").isNull()).fillna("", "label")
    return join_sized(named, labels, ["label", "blank"], "inner", labels.count()).select("vec_id", "code", "error", "label_error", "evaluated"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Two rounds, written out; parts are four components wide, as the table's vectors have 64.
OP12_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT row, k AS part, x[k * w + 1] AS x1, x[k * w + 2] AS x2, x[k * w + 3] AS x3, x[k * w + 4] AS x4
  FROM (SELECT row, x, len(x) // 16 AS w, unnest(range(16)) AS k FROM v)
), e0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x1, x2, x3, x4 FROM p WHERE row <= 64),
a1 AS MATERIALIZED (
  SELECT p.row, p.part, p.x1, p.x2, p.x3, p.x4, min(struct_pack(d := (p.x1-e.x1)**2 + (p.x2-e.x2)**2 + (p.x3-e.x3)**2 + (p.x4-e.x4)**2, entry := e.entry)) AS best
  FROM p JOIN e0 e USING (part) GROUP BY ALL
), e1 AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.x1, e.x1) AS x1, coalesce(m.x2, e.x2) AS x2, coalesce(m.x3, e.x3) AS x3, coalesce(m.x4, e.x4) AS x4
  FROM e0 e LEFT JOIN (SELECT part, best.entry AS entry, floor(sum(x1) / count(*))::BIGINT AS x1, floor(sum(x2) / count(*))::BIGINT AS x2, floor(sum(x3) / count(*))::BIGINT AS x3, floor(sum(x4) / count(*))::BIGINT AS x4 FROM a1 GROUP BY ALL) m USING (part, entry)
), a2 AS MATERIALIZED (
  SELECT p.row, p.part, p.x1, p.x2, p.x3, p.x4, min(struct_pack(d := (p.x1-e.x1)**2 + (p.x2-e.x2)**2 + (p.x3-e.x3)**2 + (p.x4-e.x4)**2, entry := e.entry)) AS best
  FROM p JOIN e1 e USING (part) GROUP BY ALL
), e2 AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.x1, e.x1) AS x1, coalesce(m.x2, e.x2) AS x2, coalesce(m.x3, e.x3) AS x3, coalesce(m.x4, e.x4) AS x4
  FROM e1 e LEFT JOIN (SELECT part, best.entry AS entry, floor(sum(x1) / count(*))::BIGINT AS x1, floor(sum(x2) / count(*))::BIGINT AS x2, floor(sum(x3) / count(*))::BIGINT AS x3, floor(sum(x4) / count(*))::BIGINT AS x4 FROM a2 GROUP BY ALL) m USING (part, entry)
), a3 AS MATERIALIZED (
  SELECT p.row, p.part, min(struct_pack(d := (p.x1-e.x1)**2 + (p.x2-e.x2)**2 + (p.x3-e.x3)**2 + (p.x4-e.x4)**2, entry := e.entry)) AS best
  FROM p JOIN e2 e USING (part) GROUP BY ALL
), c AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a3 GROUP BY row),
b AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (row), b
"""
