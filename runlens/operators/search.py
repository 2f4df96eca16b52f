"""Samples, containment, similarity and term searches over tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..sources.sinks import scratch

#: A side is broadcast only if it was counted and holds at most this many rows.
BROADCAST_ROWS = 50_000
#: Characters of gold texts (and 64 for each) in one automaton.
GOLD_CHARS = 4_000_000
#: Products in a matrix of similarities.
CELLS = 1 << 21


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def blocks(df: DataFrame, rows: int, key: str) -> list[DataFrame]:
    """A query set in blocks of about BROADCAST_ROWS, by a hash of its key."""
    n = max(1, -(-rows // BROADCAST_ROWS))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def subsample(df: DataFrame, fraction: float, seed: int, key: str, bits: int = 16) -> DataFrame:
    """Exactly int(n * fraction) rows: those with the least seeded hashes of the key, ties by the key.

    Rows are counted by the hash's first bits; only the bucket that the limit
    falls into is sorted. A fraction outside (0, 1] is an error.
    """
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction in (0, 1], not {fraction}")
    h = F.sha2(F.concat_ws("-", F.lit(seed), F.col(key)), 256)
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, bits // 4), 16, 10).cast("int"))
    counts = sorted((r._b, r["count"]) for r in rows.groupBy("_b").count().collect())  # at most 2**bits
    left, edge = int(sum(n for _, n in counts) * fraction), -1
    for b, n in counts:
        edge = b
        if n >= left:
            break
        left -= n
    last = rows.where(F.col("_b") == edge).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).where(F.col("_r") <= left).drop("_r")
    return rows.where(F.col("_b") < edge).unionByName(last).drop("_h", "_b")


def holds(texts: DataFrame, golds: DataFrame, key: str, text: str, gold_key: str, gold: str, head: int = 32) -> DataFrame:
    """(key, gold_key) for every text that has a gold text as a part; a null text or gold is part of nothing, an empty gold of every text.

    Each task runs an automaton of the golds' first ``head`` characters once over
    each of its whole texts; where a head ends, the golds that begin with it
    are looked up by the text that follows, once for each of their lengths.
    Golds are broadcast in blocks of about GOLD_CHARS characters, whatever their
    number, and the texts are read once for each block; neither side is shuffled
    but to drop repeated pairs.
    """
    texts, golds = texts.select(F.col(key).alias("key"), F.col(text).alias("text")), golds.select(F.col(gold_key).alias("gold_key"), F.col(gold).alias("gold")).where("gold is not null")
    out = StructType([StructField(key, texts.schema["key"].dataType), StructField(gold_key, golds.schema["gold_key"].dataType)])
    g = written(golds, "golds")
    n = max(1, -(-(g.agg(F.sum(F.length("gold") + F.lit(64))).first()[0] or 0) // GOLD_CHARS))

    def over(block: DataFrame) -> DataFrame:
        held = block.toPandas()  # about GOLD_CHARS characters
        shared = block.sparkSession.sparkContext.broadcast((held["gold"].tolist(), held["gold_key"].tolist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_text: dict[str, list] = {}
            lengths: dict[str, set[int]] = {}
            for one, its in zip(*shared.value):
                by_text.setdefault(one, []).append(its)
                lengths.setdefault(one[:head], set()).add(len(one))
            heads = ahocorasick.Automaton()
            for word in lengths:
                if word:
                    heads.add_word(word, word)
            heads.make_automaton()
            for batch in batches:
                keys, found = batch.column(0).to_pylist(), ([], [])
                for i, t in enumerate(batch.column(1)):
                    t = t.as_py()
                    if t is None:
                        continue
                    met = {""} & by_text.keys()
                    for end, word in heads.iter(t) if heads else ():
                        at = end + 1 - len(word)
                        met.update(p for p in (t[at : at + k] for k in lengths[word]) if p in by_text)
                    for p in met:
                        found[0].extend([keys[i]] * len(by_text[p]))
                        found[1].extend(by_text[p])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow)], schema=arrow)

        return texts.mapInArrow(run, out)

    arrow = to_arrow_schema(out)
    parts = [over(g.where(F.pmod(F.xxhash64("gold"), F.lit(n)) == i)) for i in range(n)]
    return reduce(DataFrame.unionByName, parts).distinct()


def relevant(rows: DataFrame, asks: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """query_id, key, similarity: for every asking row the most similar other row by cosine, if it reaches ``least``; ties to the smaller key.

    Asking rows are a stated query set, broadcast in blocks; keys are whole
    numbers. Vectors that are null, hold a null or have no length take no part,
    nor do pairs of different sizes. Each task multiplies matrices of at most
    CELLS products and works out exactly, item by item, what may be a query's
    best by those; it sends one row a query.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    v = F.transform(vector, lambda x: x.cast("double"))
    e = rows.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull()).withColumn("n", norm(F.col("v"))).where("n <> 0")
    q = written(asks.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull()).withColumn("n", norm(F.col("v"))).where("n <> 0"), "asks")
    parts = [e.mapInArrow(most_similar(some.toArrow(), q.sparkSession, least), "query_id long, key long, s double") for some in blocks(q, q.count(), "key")]
    best = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.max_by(F.struct("key", "s"), F.struct("s", -F.col("key"))).alias("b"))
    return best.select(F.col("query_id").cast(asks.schema[key].dataType).alias("query_id"), F.col("b.key").cast(rows.schema[key].dataType).alias(key), F.col("b.s").alias("similarity"))


def most_similar(asks: pa.Table, spark: SparkSession, least: float):
    """A function of batches (key, v, n) that gives the best (query_id, key, s) of its task for each row of ``asks``."""

    def taken(table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, vectors, lengths) of the rows of each size of vectors."""
        size = pc.list_value_length(table.column("v"))
        out = []
        for d in pc.unique(size).to_pylist():
            some = table.filter(pc.equal(size, d))
            flat = pa.concat_arrays([c.flatten() for c in some.column("v").chunks]).to_numpy(zero_copy_only=False)
            out.append((some.column("key").to_numpy(), flat.reshape(-1, d).astype(float), some.column("n").to_numpy()))
        return out

    def once(keys: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without copies but the two with the least keys, as a query may be one of them."""
        order = np.argsort(keys, kind="stable")
        keys, v, n = keys[order], np.ascontiguousarray(v[order]), n[order]
        numbers: dict[bytes, int] = {}
        same = np.array([numbers.setdefault(x.tobytes(), len(numbers)) for x in v])
        by = np.argsort(same, kind="stable")
        kept = np.sort(by[np.concatenate([[True, True], same[by][2:] != same[by][:-2]])[: len(by)]])
        return keys[kept], v[kept], n[kept]

    cells, slack = CELLS, 1e-10  # far over what rounding makes of cosines
    shared = spark.sparkContext.broadcast({v.shape[1]: (k[o], v[o], n[o]) for k, v, n in taken(asks) for o in [np.argsort(k, kind="stable")]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {d: (np.full(len(k), -np.inf), np.zeros(len(k), np.int64)) for d, (k, _, _) in shared.value.items()}
        for batch in batches:
            for keys, v, n in taken(pa.Table.from_batches([batch])):
                d = v.shape[1]
                if d not in found:
                    continue
                asked, w, m = shared.value[d]
                score, its = found[d]
                keys, v, n = once(keys, v, n)
                unit = v / n[:, None]
                step = max(1, cells // len(keys))
                for at in range(0, len(asked), step):
                    own = slice(at, at + step)
                    s = (w[own] / m[own, None]) @ unit.T
                    s[np.isnan(s)] = np.inf
                    place = np.searchsorted(keys, asked[own])
                    held = np.minimum(place, len(keys) - 1)
                    for i in np.flatnonzero(keys[held] == asked[own]):
                        s[i, held[i] : np.searchsorted(keys, asked[at + i], "right")] = -np.inf
                    limit = np.maximum(np.maximum(s.max(1), score[own]) - slack, least - slack)
                    i, j = np.nonzero(s >= limit[:, None])
                    i += at
                    exact = np.zeros(len(i))
                    for x in range(d):
                        exact += v[j, x] * w[i, x]
                    exact /= n[j] * m[i]
                    exact[np.isnan(exact)] = np.inf
                    good = exact >= least
                    i, j, exact = i[good], j[good], exact[good]
                    order = np.lexsort((keys[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.flatnonzero(np.diff(i, prepend=-1))
                    i, k, exact = i[first], keys[j[first]], exact[first]
                    better = (exact > score[i]) | (exact == score[i]) & (k < its[i])
                    score[i[better]], its[i[better]] = exact[better], k[better]
        for d, (score, its) in found.items():
            met = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][met]), pa.array(its[met]), pa.array(np.where(score == np.inf, np.nan, score)[met])], ["query_id", "key", "s"])

    return run


def fuzzy_find(names: DataFrame, asks: DataFrame, name: str, least: float = 0.2, top: int = 20) -> DataFrame:
    """q, name, similarity, exact: for every asked name the ``top`` names over ``least`` by edit distance; equal but for case is 1 and exact.

    Asked names are a stated query set, broadcast in blocks; lengths rule out
    names that can't reach ``least``, and each task ranks before the shuffle.
    """
    n = names.select(name).where(F.col(name).isNotNull()).distinct()
    q = written(asks.select(F.col(name).alias("q")).where("q is not null").distinct(), "asks")
    short, long = F.least(F.length("q"), F.length(name)), F.greatest(F.length("q"), F.length(name))
    s = F.when(F.lower("q") == F.lower(name), 1.0).otherwise(1 - F.levenshtein("q", name) / long)
    scored = reduce(DataFrame.unionByName, (n.join(F.broadcast(some), short > least * long).withColumn("similarity", s).where(F.col("similarity") > least) for some in blocks(q, q.count(), "q")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), name))
    return scored.withColumn("_r", rank).where(F.col("_r") <= top).select("q", name, "similarity", (F.col("similarity") == 1.0).alias("exact"))


def plan_search(plans: DataFrame, query: str, task: Column, steps: Column, newest: list[Column], n: int = 5) -> DataFrame:
    """The newest ``n`` plans with every term of the query in the task, or every term in one step's text; none for a query of under three letters."""
    terms = F.array(*map(F.lit, query.lower().split(" ")))
    has = lambda text: F.forall(terms, lambda x: F.lower(text).contains(x))
    met = F.coalesce(has(task), F.lit(False)) | F.coalesce(F.exists(steps, has), F.lit(False))
    return plans.where(met & F.lit(len(query) >= 3)).orderBy(*newest).limit(n)


def tasks_with_answers(tasks: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every task, with its answers or null columns."""
    return tasks.join(answers, key, "left")


def first_references(refs: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """The first answer of each key."""
    return refs.groupBy(key).agg(F.min_by(answer, order).alias("answer"))


def complete_submission(answers: DataFrame, asked: DataFrame, key: str, answer: str) -> DataFrame:
    """key, answer of every answered and every asked task; blank where there is none, or where it says that it can't be told."""
    out = answers.select(key, answer).join(asked.select(key).distinct(), key, "full_outer")
    return out.select(key, F.when(F.col(answer).isin("Unable to determine", "None"), "").otherwise(F.coalesce(answer, F.lit(""))).alias("answer"))


def unscored(tasks: DataFrame, scores: DataFrame, key: str, redo: bool = False) -> DataFrame:
    """Tasks without a score; all of them to do over."""
    return tasks if redo else tasks.join(scores.select(key), key, "left_anti")


def policy_lists(rules: DataFrame, site: str = "site", status: str = "status") -> DataFrame:
    """(status, site) of the allowed, rejected and blocked sites, each once; a list that is empty has one row with a null site."""
    lists = rules.sparkSession.createDataFrame([("allowed",), ("rejected",), ("blocked",)], "status string")
    rows = rules.select(F.col(status).alias("status"), F.col(site).alias("site")).where("site is not null").distinct()
    none = lists.join(rows.select("status").distinct(), "status", "left_anti").select("status", F.lit(None).cast("string").alias("site"))
    return rows.where(F.col("status").isin("allowed", "rejected", "blocked")).unionByName(none)


def combine_pages(pages: DataFrame, query: str, key: str, text: str, pages_max: int = 3, words: int = 20) -> DataFrame:
    """query, combined: for each query its first pages in order, each with a header and its first ``words`` words; pages without a text are left out."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(key))
    first = pages.withColumn("_r", rank).where(F.col("_r") <= pages_max).where(F.col(text).isNotNull())
    page = F.concat(F.lit("Page: "), F.col(key).cast("string"), F.lit("\n"), F.array_join(F.slice(F.split(text, " "), 1, words), " "), F.lit("\n\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", page.alias("p")))), lambda x: x["p"]), "")
    return first.groupBy(query).agg(body.alias("_b")).select(query, F.concat(F.lit("Search Results for "), F.col(query), F.lit("\n\n"), "_b").alias("combined"))
