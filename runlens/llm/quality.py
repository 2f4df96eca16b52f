"""Quality classifier: document evidence, and site posteriors shrunk toward wider priors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, chosen, join_sized, numbered, sliced, stored, table, text_rows

#: Labelled rows that fit the document classifier on average, chosen by a hash of doc_id.
SAMPLE = 50_000
#: Penalty on standardised weights, and rounds of its fit at most.
PENALTY, ROUNDS = 1e-4, 40
FEATURES = ["log_words", "mean_word", "upper", "digit", "mark", "run", "bang", "bar", "distinct", "top_word", "same_line", "repeat", "letter", "short_line"]
RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower = raw.lower().split()
    seen: dict[bytes, int] = {}
    for w in lower:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[0xC3:].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    return [
        log(n), size / n / 10, kinds[65:91].sum() / max(1, letters), kinds[48:58].sum() / size, marks / n, sum(1 for _ in RUNS.finditer(raw)) / n, min(1.0, kinds[33] / n), min(1.0, kinds[124] / n),
        len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines), sum(map(bytes.__eq__, lower, lower[1:])) / n, letters / size, sum(len(x) < 40 for x in lines) / len(lines),
    ]


def feature_table(df: DataFrame, id_col: str, text_col: str, host: Column, path: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path, an array of FEATURES and the long columns ``more`` for every row, written once."""
    docs = text_rows(df, id_col, text_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], x], ["doc_id", "host", "path", *more, "x"])

    return stored(docs.mapInArrow(run, ", ".join(["doc_id long, host string, path string", *(f"{m} long" for m in more), "x array<double>"])), "features")


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, prior: Column) -> float:
    """Prior strength of a level by moments: how far group means spread around ``prior`` beyond sampling noise (1 to 10,000)."""
    spread = F.sum(F.pow(F.col("s") / F.col("n") - prior, 2) * F.col("n"))
    r = groups.agg(spread.alias("q"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(prior * (1 - prior) * F.col("n")).alias("v")).first()
    if not r.k or r.k < 2 or not r.v:
        return 10_000.0
    v = r.v / r.n
    between = max(0.0, (r.q - r.k * v) / r.n)
    return float(min(10_000.0, max(1.0, v / between - 1 if between > 0 else 10_000.0)))


def summed(train: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (x, y) of ``of``, which gives ``size`` sums of a batch: by tasks, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    out = np.zeros(size)
    for r in train.select("x", "y").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def fit_score(x: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression on labelled rows (x, y).

    Newton's method on standardised features: tasks sum loss, gradient and
    curvature, the driver gets one number for each pair of features.
    """
    n = labels.count()
    rows = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    train = stored(x.join(rows.hint("merge"), "doc_id").select("x", F.col("y").cast("double").alias("y")), "train")
    m = len(FEATURES)
    n, good, *moments = summed(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * m)
    if good in (0, n):  # nothing to tell apart
        return [0.0] * m, (4.0 if good else -4.0) if n else 0.0
    mean = np.array(moments[:m]) / n
    spread = np.sqrt(np.maximum(0, np.array(moments[m:]) / n - mean * mean))
    spread[spread < 1e-9] = 1.0
    bound = np.array([PENALTY] * m + [0.0])

    def sums_at(at: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.hstack([(x - mean) / spread, np.ones((len(y), 1))])
            z = x @ at
            p = np.exp(-np.logaddexp(0, -z))
            return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        return of

    at = held = np.array([0.0] * m + [log(good / (n - good))])
    step, least = np.zeros(m + 1), np.inf
    for _ in range(ROUNDS):
        loss, *rest = summed(train, sums_at(at), 1 + (m + 1) * (m + 2)) / n
        loss += (bound * at * at).sum() / 2
        if loss > least + 1e-12:  # too far
            step = step / 2
        else:
            held, least = at, loss
            slope, curve = np.array(rest[: m + 1]) + bound * at, np.array(rest[m + 1 :]).reshape(m + 1, m + 1)
            step = -np.linalg.solve(curve + np.diag(bound + 1e-9), slope)
        if np.abs(step).max() < 1e-5:
            break
        at = held + step
    weights = held[:m] / spread
    return weights.tolist(), float(held[m] - weights @ mean)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label: str = "quality", threshold: float = 0.3, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, quality, accepted and the long columns ``more`` for every row.

    The document classifier (fit on at most about SAMPLE labelled rows) gives
    each text a probability. Labels where known, else probabilities, are summed by
    host and path over all rows; a host's posterior shrinks toward the global
    mean, a path's toward its host's, with strengths estimated from the spread
    of the groups. The quality of a document adds its own log odds to its path's
    log odds over the global ones. Null text is empty, a null host or path is ''
    and forms one site; without labels every row has even odds and is accepted.
    The threshold is under one half: a doubtful text stays.
    """
    host, path = host if host is not None else F.col("source"), path if path is not None else F.concat_ws("/", "source", "lang")
    x = feature_table(df, id_col, text_col, host, path, more)
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    y = stored(y, "labels")
    weights, bias = fit_score(x, y)
    z = F.lit(bias)
    for i, w in enumerate(weights):
        z = z + F.col("x")[i] * w
    scored = x.select("doc_id", "host", "path", *more, F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z)).alias("z"))
    named = scored.where("doc_id is not null").join(y.hint("merge"), "doc_id", "left")  # rows without an id have no label, and would all meet in one task
    known = named.unionByName(scored.where("doc_id is null").withColumn("y", F.lit(None).cast("double"))).withColumn("p", F.coalesce("y", logistic(F.col("z"))))
    paths = stored(known.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-4, max(1e-4, (whole.s + 1) / (whole.n + 2))) if whole.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    k = strength(hosts, F.lit(mean))
    hosts = stored(hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior")), "hosts")
    nested = stored(paths.join(hosts.hint("merge"), "host"), "nested")
    kp = strength(nested, F.col("host_posterior"))
    sites = stored(nested.select("host", "path", "host_posterior", ((F.col("s") + kp * F.col("host_posterior")) / (F.col("n") + kp)).alias("path_posterior")), "sites")
    out = join_sized(scored, sites, ["host", "path"], "left", sites.count())
    odds = F.col("z") + logit(F.col("path_posterior")) - log(mean / (1 - mean))
    return out.select("doc_id", "host", "path", logistic(F.col("z")).alias("evidence"), "host_posterior", "path_posterior", logistic(odds).alias("quality"), (logistic(odds) >= threshold).alias("accepted"), *more)


def held_out_accuracy(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> tuple[int, int]:
    """(right, all): verdicts on the labelled documents whose crc32 of the id is divisible by 5, by a classifier that saw none of their labels."""
    out = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).withColumn("_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    told = classify(docs, out.where("not _out"), label=label, threshold=threshold).select("doc_id", "accepted")
    r = told.join(out.where("_out").select("doc_id", F.col(label).cast("int").alias("y")), "doc_id").agg(F.count_if((F.col("y") == 1) == F.col("accepted")).alias("right"), F.count("*").alias("n")).first()
    return r.right, r.n


def op10_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier accepts, each by its own text and site.

    A null id has no label; rows of one id share its label, but not a verdict.
    """
    rows = numbered(docs)
    return chosen(rows, classify(rows, labels, more=(ROW,)).where("accepted"))
