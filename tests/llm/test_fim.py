"""Fill-in-middle against brute force over code points, and the boundary set against plain lists."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import fim
from runlens.llm.fim import ArrayPlaces, BitPlaces, BoundarySet, Rule, RunPlaces, container

TEXTS = [None, "", "a", "é", "日本語 text", "with <P> in it", "<M>", "half <", "S> half", "<P", "\x00 nul \n\n line\r\n", "é" * 70_000, "a" * 200_000, "aé" * 50_000 + "日" * 40_000, "🙂 smile " * 9000]
ROWS = [(i % 40 if i % 11 else None, TEXTS[i % len(TEXTS)]) for i in range(150)]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_matches_brute_force_and_restores(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, n int, form string")
    got = fim.fill_in_middle(df).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted([(d, *brute(d, t), t or "") for d, t in ROWS], key=str)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got], key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_query_has_digests_of_output_and_text(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted([(d, *o[:4], sha(o[4]), sha(t or "")) for d, t in ROWS for o in [brute(d, t)]], key=str)
    assert sorted([tuple(r) for r in fim.op11_fill_in_middle(spark, str(tmp_path)).collect()], key=str) == want


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_are_never_cut(spark, unit):
    df = spark.createDataFrame([(i, f"  one é two\n three\tfour {i}\n\n five\n" * (i % 7)) for i in range(60)], "doc_id long, text string")
    for r in fim.fill_in_middle(df, rule=Rule(rate=100, spm=0, unit=unit)).join(df, "doc_id").collect():
        if r.form == "plain":
            continue
        p, s, m = r.output.removeprefix("<P>").replace("<M>", "<S>").split("<S>")
        assert p + m + s == r.text
        for left, right in ((p, m + s), (p + m, s)):
            if left and right:
                assert left[-1] == "\n" if unit == "line" else left[-1].isspace() and not right[0].isspace()


@pytest.mark.parametrize("share, kind", [(0.01, ArrayPlaces), (0.5, BitPlaces), (1.0, RunPlaces)])
def test_each_container_selects_its_members(share, kind):
    rng = np.random.default_rng(3)
    mask = rng.random(3 * fim.SPAN + 100) < share
    mask[fim.SPAN : 2 * fim.SPAN] = False  # one container without members
    cuts, want = BoundarySet.of(mask), np.flatnonzero(mask)
    assert isinstance(container(mask[: fim.SPAN])[0], kind) and cuts.size == len(want)
    for k in {0, len(want) // 3, len(want) // 2, len(want) - 1, *rng.integers(0, len(want), 200).tolist()}:
        assert cuts.select(k) == want[k]
