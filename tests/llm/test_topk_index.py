"""The impact-ordered index against brute force: ties, few rows, copies of an id, bounds beyond 32 bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import topk
from runlens.llm.topk import ImpactIndex


@pytest.mark.parametrize("n, dims, scale", [(1, 3, 5), (7, 2, 1), (900, 8, 2), (900, 16, 1024), (900, 8, 10**6), (300, 4, 0)])
def test_matches_brute_force(n, dims, scale):
    rng = np.random.default_rng(n + dims)
    v = rng.integers(-scale, scale + 1, (n, dims))
    ids = rng.permutation(n)
    ids[: n // 50] = ids[0]  # rows that share an id
    asked = np.concatenate([ids[: min(n, 20)], [10**9]])
    queries = np.concatenate([v[: min(n, 20)], rng.integers(-scale, scale + 1, (1, dims))])
    for q, vec, got in zip(asked.tolist(), queries, ImpactIndex(ids, v).search(asked, queries, 10)):
        want = sorted(((int(i), int(s)) for i, s in zip(ids, v @ vec) if i != q), key=lambda r: (-r[1], r[0]))[:10]
        assert got == want


def test_reached_scores_cut_only_rows_below():
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 51, (700, 8))
    ids = np.arange(700)
    for reached in (-(10**6), 9000, 10**6):
        got = ImpactIndex(ids, v).search(np.array([-1]), v[:1], 10, np.array([reached]))[0]
        want = sorted(((int(i), int(s)) for i, s in zip(ids, v @ v[0])), key=lambda r: (-r[1], r[0]))[:10]
        assert got == [r for r in want if r[1] >= reached]


def brute(rows, asks, k=10):
    ints = {i: np.floor(np.array(x, np.float32).astype(float) * 1024).astype(int) for i, x in rows if i is not None and x and np.isfinite(x).all()}
    out = []
    for q in sorted(i for i in ints if asks(i)):
        best = sorted((-int(ints[q] @ c), i) for i, c in ints.items() if i != q and len(c) == len(ints[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("bytes_", [1 << 25, 1 << 12])
def test_query_blocks_in_turns(spark, monkeypatch, bytes_):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(400, 8)).round(2))]
    rows += [(1000, [1.0, 2.0]), (1001, [0.5, 0.5]), (1002, []), (1003, None), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 4 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, lambda i: i % 4 == 0)
    if bytes_ == 1 << 25:
        assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_postings_are_skipped(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(3000, 16)))], "vec_id long, embedding array<float>")
    r = topk.exact_top_k(df.coalesce(1), F.col("vec_id") % 100 == 0, report=True).first()
    assert 0 < r.postings_read < 0.8 * r.postings_all
