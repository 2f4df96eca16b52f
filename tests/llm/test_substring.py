"""Substring dedup against brute force: overlapping, periodic and nested repeats, copies, null ids, a common phrase."""

import random

import numpy as np
import pytest

from runlens.llm import substring
from runlens.llm.substring import Automaton

SCHEMA = "doc_id long, text string, row int, words string"


def brute(rows, width):
    """rows (id, text) in stored order -> for each its kept text and number of removed words."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        w = (rows[i][1] or "").split()
        gone = set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone.update(range(s, s + width))
            seen.add(k)
        out[i] = (rows[i][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return [out[i] for i in range(len(rows))]


def texts(seed=1):
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, line = own(45), own(23), own(9)
    out = [own(60) + a + own(5), a[3:40], a + b, own(30) + b + a[:25] + own(8), b * 4, ["x"] * 90, ["x"] * 30, ["p", "q", "r"] * 20, own(19), [], own(20), a, a]
    out += [own(rng.randrange(3, 30)) + line + own(rng.randrange(3, 30)) for _ in range(40)]
    out += [own(4) + line + a[:12] + line + own(3) for _ in range(3)]
    return [" ".join(x) for x in out] + ["tab\tand\x0bvt " + " ".join(a[:21]) + "\n\n", "two of them " * 2000]


@pytest.mark.parametrize("width, hot, shard", [(20, 1024, 1024), (20, 2, 3), (9, 1, 5), (33, 1024, 2)])
def test_matches_brute_force(spark, monkeypatch, width, hot, shard):
    for name, value in (("HOT", hot), ("SHARD", shard)):
        monkeypatch.setattr(substring, name, value)
    found = texts()
    rows = [(i * 7 % 31 if i % 9 else None, t) for i, t in enumerate(found)] + [(2, found[0]), (2, found[0]), (None, None), (None, found[2])]
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], SCHEMA).coalesce(1)
    got = substring.substring_dedup(df, width=width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=str) == sorted(brute(rows, width), key=str)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) and all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:])) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring.substring_dedup(df).count() == 0
    assert [tuple(r) for r in substring.substring_dedup(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).collect()] == [(1, 0, 0, "", [])]


def test_automaton_gives_matching_statistics():
    rng = random.Random(2)
    for kinds in (2, 3, 8):
        automaton, read = Automaton(), []
        for _ in range(12):
            automaton.restart()
            read.append([])
            for _ in range(rng.randrange(1, 25)):
                read[-1].append(rng.randrange(kinds))
                got = automaton.read(read[-1][-1])
                now = read[-1]
                before = {tuple(s[i:j]) for s in read for i in range(len(s)) for j in range(i + 1, len(s) + (s is not now))}
                want = max((k for k in range(1, len(now) + 1) if tuple(now[-k:]) in before), default=0)
                assert got == want


def test_filter_bits_set_by_chance_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(4))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    monkeypatch.setattr(substring, "met", lambda bits, codes: codes == codes)
    got = substring.substring_dedup(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(brute(rows, 20))


@pytest.mark.parametrize("together", [1, 300, 1 << 21])
def test_stretches_of_texts_together_are_those_of_each(monkeypatch, together):
    monkeypatch.setattr(substring, "TOGETHER", together)
    found = [t.encode() for t in texts(3)]
    got = []
    for _, words, ends in substring.grouped(found):
        anchor, first, n = substring.stretches(words, ends, 20)
        got += [(a, words[f : f + m + 19]) for a, f, m in zip(anchor.tolist(), first.tolist(), n.tolist())]
    want = []
    for t in found:
        words = t.split()
        anchor, first, n = substring.stretches(words, np.array([len(words)]), 20)
        assert sorted(x for f, m in zip(first.tolist(), n.tolist()) for x in range(f, f + m)) == [*range(max(0, len(words) - 19))]
        want += [(a, words[f : f + m + 19]) for a, f, m in zip(anchor.tolist(), first.tolist(), n.tolist())]
    assert got == want


def test_a_text_beyond_the_places_is_cut_at_windows(monkeypatch):
    words = " ".join(texts(5)).encode().split()
    one = substring.stretches(words, np.array([len(words)]), 20)
    monkeypatch.setattr(substring, "PLACES", 8)
    cut = substring.stretches(words, np.array([len(words)]), 20)
    spread = lambda s: [(f + k) for _, f, n in zip(*(x.tolist() for x in s)) for k in range(n)]
    assert spread(one) == spread(cut) and len(words) > 300
    by = {}
    for a, f, n in zip(*(x.tolist() for x in cut)):
        for k in range(f, f + n):
            assert by.setdefault(tuple(words[k : k + 20]), a) == a  # equal windows, equal anchors
