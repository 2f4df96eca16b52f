"""Vector codes against brute force: ties, repeated rows and ids, odd vectors, few rows."""

import hashlib

import numpy as np
import pytest

from runlens.llm import codes

INF = float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, vector, label) -> sorted (vec_id, code, error, label_error), books."""
    kept = [(d, [float(np.float32(x)) for x in v], k) for d, v, k in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[int(np.floor(256 * x)) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for c in cut:
                got[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(g) for x in zip(*g)) if g else e for g, e in zip(got, books[p])]
    out = []
    for (d, _, k), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((d, "".join(f"{i:02x}" for _, i in best), sum(e for e, _ in best), k))
    sums = {}
    for _, _, e, k in out:
        sums[k] = sums.get(k, 0) + e
    return sorted(((d, c, e, sums[k]) for d, c, e, k in out), key=str), books


def rows_of(n, dims, spread, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims) * spread], int(i) % 5 if i % 7 else None) for i in rng.permutation(n)]
    return rows + [(3, rows[0][1], 9), (None, rows[1][1], 2), (None, rows[1][1], 2), (*rows[2][:2], 4), rows[2]]


@pytest.mark.parametrize("n, dims, spread", [(400, 64, 0.2), (300, 16, 0.01), (300, 32, 900.0), (3, 64, 1.0), (200, 48, 0.0)])
def test_matches_brute_force(spark, n, dims, spread):
    rows = rows_of(n, dims, spread)
    odd = [(-1, None, 1), (-2, [None] * dims, 1), (-3, [INF] + [0.0] * (dims - 1), 1), (-4, [float("nan")] * dims, None), (-5, [], 1), (-6, [1.0] * 5, 1), (10**6, [1.0] * (2 * dims), 1)]
    df = spark.createDataFrame([(d, v, k, "x", 1) for d, v, k in [*rows, *odd]], SCHEMA).repartition(3)
    got, books = codes.vector_codes(df)
    want, held = brute([*rows, *odd])
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got.collect()], key=str) == want
    assert [[tuple(e) for e in b] for b in books.tolist()] == held
    flat = ",".join(str(x) for b in held for e in b for x in e)
    assert codes.digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_pivots_prune_and_keep_ties():
    rng = np.random.default_rng(5)
    parts = rng.integers(-60, 60, (3000, 4))
    entries = np.concatenate([rng.integers(-60, 60, (40, 4)), parts[:12], parts[:12]])  # later copies of an entry never win
    pivots = codes.far_apart(entries, 4)
    held = np.sqrt(codes.squared(parts[:, None], pivots[None]).astype(float)).astype(np.float32)
    index, best, done = codes.nearest(parts, held, entries, pivots)
    d = codes.squared(parts[:, None], entries[None])
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert done < 0.5 * d.size


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)
    got, books = codes.vector_codes(df)
    assert got.count() == 0 and books.shape[1] == 0
    with pytest.raises(Exception, match="exceeds"):
        codes.vector_codes(spark.createDataFrame([(1, [1e12] * 16, 1, "x", 1)], SCHEMA))[0].count()
