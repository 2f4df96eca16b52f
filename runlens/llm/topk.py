"""Exact top-k search by integer inner product over an impact-ordered index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, stored, table

#: Vectors in an index block, queries in a query block, impact levels for each dimension.
BLOCK, QUERIES, LEVELS = 8192, 512, 32
#: Shares of a block's postings after each round, and the part of its rows that are rescored at once when no other row can be a member.
ROUNDS, RESCORED = [0.1 + 0.05 * i for i in range(19)], 8
#: Query blocks are broadcast together up to so many bytes.
BROADCAST_BYTES = 32 << 20


class ImpactIndex:
    """Postings of one block: for each dimension, segments of rows by level of their component.

    A segment's impact for a query is the most that its rows' components add over
    the least that the dimension adds to any row. Segments are processed by
    descending impact, whatever their dimension, and only once met. A row's
    accumulator holds the impacts met and their number; each of its other
    dimensions adds at most what the next segment does. The search stops when few
    enough rows have bounds that reach the k-th exact score: those are rescored,
    and no other row can be a member. ``read`` counts postings processed.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        low, high = vectors.min(0), vectors.max(0)
        level = (vectors - low) // np.maximum(1, -(-(high - low + 1) // levels))
        order = np.argsort(level, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T).ravel()
        sorted_ = np.take_along_axis(level, order, 0).T
        start = np.ones((dims, n), bool)
        start[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        self.begin = np.flatnonzero(start)
        self.end = np.append(self.begin[1:], n * dims)
        self.dim, self.size = self.begin // n, self.end - self.begin
        self.first = np.searchsorted(self.begin, np.arange(dims) * n)
        values = np.take_along_axis(vectors, order, 0).T.ravel()
        self.least, self.most = np.minimum.reduceat(values, self.begin), np.maximum.reduceat(values, self.begin)
        self.read = self.all = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, reached: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For every query the k best (vec_id, score), ties to the smaller id, never the query's own row.

        ``reached``: a score for each query that k other rows reach; rows below it are left out.
        """
        weight = queries[:, self.dim]
        ends = weight * self.least, weight * self.most
        floor = np.minimum.reduceat(np.minimum(*ends), self.first, axis=1)  # least that the dimension adds to any row
        gain = np.maximum(*ends) - floor[:, self.dim]
        peak = np.maximum.reduceat(gain, self.first, axis=1)
        reached = np.full(len(queries), np.iinfo(np.int64).min) if reached is None else reached
        return [self.one(int(i), q, k, g, p, int(f.sum()), int(r)) for i, q, g, p, f, r in zip(query_ids, queries, gain, peak, floor, reached)]

    def one(self, query_id: int, query: np.ndarray, k: int, gain: np.ndarray, peak: np.ndarray, base: int, reached: int) -> list[tuple[int, int]]:
        n, total = len(self.ids), len(self.postings)
        by = np.argsort(-gain, kind="stable")
        upto = np.cumsum(self.size[by])
        most = int(peak.sum())
        met, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        scored, exact = self.ids == query_id, np.zeros(n, np.int64)
        best, at, room = np.zeros(0, np.int64), 0, max(4 * k, n // RESCORED)

        def rescore(rows: np.ndarray) -> None:
            nonlocal best, reached
            exact[rows], scored[rows] = self.vectors[rows] @ query, True
            pool = np.concatenate([best, rows])
            best = pool[np.lexsort((self.ids[pool], -exact[pool]))][:k]
            if len(best) == k:
                reached = max(reached, int(exact[best[-1]]))

        for share in ROUNDS:
            to = int(np.searchsorted(upto, share * total)) + 1 if share < 1 else len(by)
            if to <= at:
                continue
            some, at = by[at:to], to
            rows = np.concatenate([self.postings[a:b] for a, b in zip(self.begin[some].tolist(), self.end[some].tolist())])
            if most < 1 << 31:  # both sums in one, exact as a double
                both = np.bincount(rows, np.repeat(gain[some] + float(1 << 32), self.size[some]), n).astype(np.int64)
                met += both & 0xFFFFFFFF
                number += both >> 32
            else:
                np.add.at(met, rows, np.repeat(gain[some], self.size[some]))
                number += np.bincount(rows, minlength=n)
            self.read += len(rows)
            rest = int(gain[by[at]]) if at < len(by) else 0
            upper = met - number * rest + (base + int(np.minimum(peak, rest).sum()))
            upper[scored] = np.iinfo(np.int64).min
            if not scored.all():
                top = np.argpartition(-upper, min(4 * k, n) - 1)[: 4 * k]
                rescore(top[~scored[top]])
                upper[top] = np.iinfo(np.int64).min
            members = np.flatnonzero((upper >= reached) & ~scored)
            if len(members) <= room or at == len(by):
                rescore(members)
                break
        self.all += total
        return [(int(self.ids[r]), int(exact[r])) for r in best if exact[r] >= reached]


def components(vector: Column) -> Column:
    """floor(1024 x) of every component; null if the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def blocks_of(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of each partition packed into blocks: (ids, dims, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def close(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            data = np.array([v for _, v in rows], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([np.array([i for i, _ in rows], "<i8").tobytes()], pa.binary()), pa.array([dims]), pa.array([data.tobytes()], pa.binary())], ["ids", "dims", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield close(len(v))
        for dims in [*held]:
            yield close(dims)

    return vectors.mapInArrow(run, "ids binary, dims long, data binary")


SCORED = "query_id long, vec_id long, score long, read long, all long"


def exact_top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row where ``is_query`` holds.

    Vectors that are null, empty, or hold null or non-finite components take no
    part, nor do null ids; vectors of another length than the query's aren't
    compared. Rows with the query's own id are never its results; of other rows
    that share an id each is a row of its own. Components and scores are 64-bit
    integers. Query blocks are broadcast, as many at a time as BROADCAST_BYTES
    holds, and meet every index block; a block and a query give at most k rows,
    none that k rows met before by the same task beat. With ``report`` the result
    is the number of postings read, and of all postings of all searches, instead.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), components(F.col(vector_col)).alias("v"), is_query.alias("asks")).where("vec_id is not null and v is not null")
    index = blocks_of(rows.select("vec_id", "v"), BLOCK)
    asks = rows.where("asks").select("vec_id", "v")
    many = asks.count()
    queries = stored(blocks_of(asks.repartition(max(1, -(-many // QUERIES)), "vec_id"), QUERIES).withColumnsRenamed({"ids": "q_ids", "data": "q_data"}), "queries")
    size = queries.agg(F.sum(F.length("q_data"))).first()[0] or 0
    turns = max(1, -(-2 * size // BROADCAST_BYTES))  # blocks are dealt by hash: half full on average

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, ImpactIndex] | None = None
        best: dict[tuple[int, int], np.ndarray] = {}  # the k best scores of each query so far, in order
        for batch in batches:
            for ids, data, dims, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or last[0] != ids:
                    last = ids, ImpactIndex(np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, dims))
                asked, index = np.frombuffer(q_ids, "<i8"), last[1]
                none = np.full(k, np.iinfo(np.int64).min)
                reached = np.array([best.get((dims, q), none)[0] for q in asked.tolist()], np.int64)
                was = index.read, index.all
                found = index.search(asked, np.frombuffer(q_data, "<i8").reshape(-1, dims), k, reached)
                for q, got in zip(asked.tolist(), found):
                    best[dims, q] = np.sort(np.concatenate([best.get((dims, q), none), [s for _, s in got]]).astype(np.int64))[-k:]
                out = [(q, i, s, None, None) for q, got in zip(asked.tolist(), found) for i, s in got]
                if report:
                    out = [(None, None, None, index.read - was[0], index.all - was[1])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([*zip(*out)] or [()] * 5)], [f.split()[0] for f in SCORED.split(", ")])

    def meet(some: DataFrame, with_index: DataFrame) -> DataFrame:
        return with_index.join(F.broadcast(some), "dims").select("ids", "data", "dims", "q_ids", "q_data").mapInArrow(run, SCORED)

    if turns == 1:
        found = meet(queries, index)
    else:
        index = stored(index, "index")
        turn = F.pmod(F.xxhash64("q_ids"), F.lit(turns))
        found = reduce(DataFrame.unionByName, (stored(meet(queries.where(turn == i), index), "found") for i in range(turns)))
    if report:
        return found.agg(F.sum("read").alias("postings_read"), F.sum("all").alias("postings_all"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
