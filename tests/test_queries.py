"""Hand-worked cases of scorers, sequences, aggregates and URLs."""

import functools
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import align as A
from runlens.functions import pages as G
from runlens.functions import records as C
from runlens.functions import text as X
from runlens.functions import urls as U
from runlens.operators import metrics as M
from runlens.operators import search as Q
from runlens.operators import sequences as S


def one(spark, rows, names, col):
    return [r[0] for r in spark.createDataFrame(rows, names).select(col).collect()]


@pytest.mark.parametrize(
    "fn, gold, pred, score",
    [
        (X.score_exact, "Paris", " Paris\n", 1.0), (X.score_exact, "Paris", "paris", 0.0), (X.score_token_f1, "the red car", "red red car", 0.8), (X.score_token_f1, "a", "b", 0.0),
        (X.score_normalised, "1,2, 3.", "1, 2,3", 1.0), (X.score_normalised, "", "", 0.0),
    ],
)
def test_scorers(spark, fn, gold, pred, score):
    assert one(spark, [(gold, pred)], "g string, p string", fn(F.col("g"), F.col("p"))) == [pytest.approx(score)]


@pytest.mark.parametrize("gold, pred, score", [(0.0, 0.0, 1.0), (10.0, 10.0, 1.0), (10.0, 20.0, 0.306853), (10.0, 100.0, 0.0), (5.0, -5.0, 0.0)])
def test_number_score(spark, gold, pred, score):
    assert one(spark, [(gold, pred)], "g double, p double", X.score_number(F.col("g"), F.col("p"))) == [pytest.approx(score, abs=1e-5)]


def test_text_functions(spark):
    x = F.col("x")
    rows = lambda *texts: [(t,) for t in texts]
    assert one(spark, rows("$1,234", "12%", "5d", None), "x string", X.clean_number(x)) == [1.234, 12.0, None, None]
    spans = ["The Eiffel-Tower, 330", "330,", "$1,234", "(42)", "a an the", "an\nb", "1_000 INF 1e16 12345678 0.0001", "aé «a»", "", "-5 +5"]
    assert one(spark, rows(*spans), "x string", X.normalised_span(x)) == ["eiffel tower 330.0", "330.0", "1234.0", "42.0", "", "b", "1000.0 inf 1e+16 12345678.0 0.0001", "aé « »", "", "5.0 5.0"]
    assert one(spark, rows("aa bb cc ddd", ""), "x string", X.viewport_chunks(x, 4)) == [["aa bb ", "cc ddd"], [""]]
    assert one(spark, rows("abc"), "x string", X.stable_id(x)) == ["ba7816bf8f01cfea"]
    said = ['ok {"a": 1} end', '{"a": 1} and {"b": 2}', '{"a":1},{"b":2}', '{"a":1}]y}', "none", None]
    assert one(spark, rows(*said), "x string", X.first_json(x)) == ['{"a": 1}', None, None, None, None, None]
    strict = ['{"a":1}', '{"a":1},{"b":2}', '{"a":1}]y', "1]x", "1],7]x", " [1] ", "x", "", None]
    assert one(spark, rows(*strict), "x string", X.strict_json(x)) == [True, False, False, False, False, True, False, False, False]
    assert one(spark, rows("http://a.com/x%20y/?b=2&a=1"), "x string", U.normalise_url(x)) == ["http://a.com/x y?a=1&b=2"]
    assert one(spark, rows("Looks good ", "sounds good", "Run plan", "accpt", "yes", "go ahead", "continue"), "x string", X.reply_accepted(x)) == [True] * 4 + [False] * 3
    replies = ["yes", " N ", "hm", '{"accepted": false}', '{"accepted": "false"}', '{"accepted": 0}', '{"accepted": null}', '{"accepted": [1]}', '{"accepted": {}}', '{"x": 1}', "{bad", None]
    assert one(spark, rows(*replies), "x string", X.action_approved(x, True)) == [True, False, True, False, True, False, False, True, False, True, True, True]
    assert one(spark, rows("**$\\boxed{5}$** and $x_1$ `c` }"), "x string", X.clean_response(x)) == ["5 and x_1 `c` }"]
    assert [tuple(r) if r else r for r in one(spark, rows('{"score": 7, "success": true}', "{}", "no"), "x string", X.judgement(x))] == [(0.7, True, "No reasoning provided."), (0.0, False, "No reasoning provided."), None]
    flat = one(spark, rows('{"a":{"b":[1,{"c":null}]},"d":"t"}', "[[[[4]]]]", "5", "no"), "x string", X.flatten_json(x))
    assert [r and [tuple(i) for i in r] for r in flat] == [[("a.b[0]", "1"), ("a.b[1]", '{"c":null}'), ("d", "t")], [("[0][0][0]", "[4]")], [("", "5")], None]


@pytest.mark.parametrize("query, start, found", [("de*", 0, 1), ("DEEP, sea!", 0, 1), ("x", 0, 0), ("x", 1, 2), ("*", 1, 1), ("", 0, None), ("?!", 0, None), ("deep * x", 0, None), ("se* x", 0, 2)])
def test_find_in_chunks(spark, query, start, found):
    chunks = F.array(F.lit("x"), F.lit("a deep, sea"), F.lit("see the x"))
    assert spark.range(1).select(X.find_in_chunks(chunks, query, F.lit(start)).alias("f")).first().f == found


def test_empty_bags(spark):
    bags = [([], [], 1.0), (["a1"], [], 0.0), ([], ["a1"], 0.0), (["3.0", "cats"], ["4.0", "cats"], 0.0), (["cats"], ["4.0", "cats"], 2 / 3)]
    got = one(spark, [b[:2] for b in bags], "g array<string>, p array<string>", X.pair_f1(F.col("g"), F.col("p")))
    assert got == [pytest.approx(b[2]) for b in bags]


def test_pages(spark):
    html = "<a href=/x>l</a><a>no</a><INPUT type='Checkbox'><button disabled>b</button><select><option>1</select><div role=tab>t</div><div role=note>n</div><p tabindex='0'>p</p><!-- <button> --><script>'<button>'</script>"
    assert one(spark, [(html,), ("",)], "h string", G.page_elements(F.col("h"))) == [["link", "checkbox", "combobox", "option", "tab", ""], []]
    text = "see [A](http://a.com)\n[A](http://a.com) and [B](http://b.com)\n[C](ftp://c.com)\n[D](/d)\nno"
    assert [[tuple(x) for x in r] for r in one(spark, [(text,)], "t string", G.markdown_links(F.col("t")))] == [[("http://a.com", "A")]]
    assert one(spark, [("<meta name=a content=1><meta property='a' content='2'><meta name=b>",)], "h string", G.meta_map(F.col("h"))) == [{"a": "2"}]


def test_records(spark):
    step = '{"title": "a", "details": "b", "agent_name": "c"%s}'
    plan = '{"task": "t", "steps": [%s], "needs_plan": true, "response": "", "plan_summary": ""}'
    rows = [(plan % (step % ""),), (plan % "1",), (plan % (step % ', "step_type": "SentinelPlanStep"'),), (plan % '{"step_type": "other"}',), ("[]",), ("{}",)]
    assert one(spark, rows, "x string", C.record_fault(F.col("x"), "plan")) == [None, "bad step", None, "bad step", "not an object", "missing keys"]
    assert one(spark, rows, "x string", C.record_fault(F.col("x"), "plan", monitors=True)) == [None, "bad step", "bad step", None, "not an object", "missing keys"]
    names = [("a.py",), ("b.XLSX",), ("c.pdf",), (".py",), ("d.x/e",), ("x/y.tar.svg",)]
    assert one(spark, names, "x string", C.file_type(F.col("x"))) == ["code", "unknown", "pdf", "unknown", "unknown", "image"]


def test_searches(spark):
    texts = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone twox"), (3, None), (4, "the two cats")], "k long, t string")
    golds = spark.createDataFrame([(10, "wo three four five six sev"), (11, "one"), (12, "e two c"), (13, "zz"), (14, None), (15, "")], "g long, gold string")
    want = {(1, 10), (1, 11), (2, 11), (4, 12), (1, 15), (2, 15), (4, 15)}
    assert {tuple(r) for r in Q.holds(texts, golds, "k", "t", "g", "gold").collect()} == want
    assert Q.holds(texts, golds.limit(0), "k", "t", "g", "gold").count() == 0
    ids = spark.range(1000)
    for n in (0.001, 0.01, 0.37, 1.0):
        got = [r.id for r in Q.subsample(ids.repartition(5), n, 7, "id", bits=8).collect()]
        key = lambda i: hashlib.sha256(f"7-{i}".encode()).hexdigest()
        assert sorted(got, key=key) == sorted(range(1000), key=key)[: int(1000 * n)]


def test_progress(spark):
    kinds = {1: "P s t", 2: "P s F", 3: "P s F P", 4: "P s F P s", 5: "P x", 6: "P s E", 7: "P x x x"}
    df = spark.createDataFrame([(r, i, k) for r, ks in kinds.items() for i, k in enumerate(ks.split())], "run int, seq int, kind string")
    k, step = F.col("kind"), F.when(F.col("kind").isin("s", "t"), F.col("seq"))
    out = {r[0]: tuple(r)[1:] for r in S.run_progress(df, "run", "seq", k == "F", step, F.when(step.isNotNull(), 9), k == "P", k != "E").collect()}
    assert out == {1: (2, 9, False, False, 2), 2: (-1, 0, True, False, 0), 3: (-1, 0, False, True, 0), 4: (4, 9, False, False, 1), 5: (-1, 0, False, True, 0), 6: (-1, -1, False, False, 1), 7: (-1, 0, False, False, 0)}


def test_url_policy(spark):
    rules = ["example.com", "google.com", "http://www.bing.com", "ftp://filexfer.com", "sample.com/foo/bar", "localhost", "chrome-error://chromewebdata/"]
    good = ["https://www.google.com", "http://google.com", "google.com/abcd", "https://www.bing.com", "ftp://www.filexfer.com/page", "subdomain.example.com", "sample.com/foo/bar/page.html", "http://localhost:8000", "https://localhost/file", "chrome-error://chromewebdata", "chrome-error://chromewebdata/page"]
    bad = ["example.org", "ftp://google.com", "bing.com", "file://bing.com", "notreallygoogle.com", "http://filexfer.com", "sample.com", "sample.com/foo", "sample.com/bar"]
    urls = spark.createDataFrame([(u,) for u in good + bad], "url string")
    out = U.url_policy(urls, spark.createDataFrame([(r, "allowed") for r in rules], "pattern string, status string"))
    assert {r.url: r.allowed for r in out.collect()} == {u: True for u in good} | {u: False for u in bad}
    none = U.url_policy(urls, spark.createDataFrame([("google.com", "blocked")], "pattern string, status string"))
    assert {r.url for r in none.collect() if not r.allowed} == {"https://www.google.com", "http://google.com", "google.com/abcd"}


@pytest.mark.parametrize("kinds, failed", [("P s R P s", [1]), ("P s F R", [1]), ("P s t R", [2])])
def test_failed_steps(spark, kinds, failed):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds.split())], "run int, seq int, kind string")
    signal = F.when(F.col("kind").isin("P", "s", "t", "R"), F.col("kind"))
    out = S.failed_steps(df, "run", ["seq"], signal, "R").where(F.col("failed") & F.col("kind").isin("s", "t")).orderBy("seq")
    assert [r.seq for r in out.collect()] == failed


def test_metrics(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.5,)], "score double")
    assert M.score_summary(df).first() == (0.5, 1.0, 3)
    runs = spark.createDataFrame([(1, 0.5)] * 4 + [(2, 1.0)] * 2, "run int, score double")
    assert M.combine_runs(runs, "run").first()[:3] == (0.75, 1.0, 3.0)
    ci = spark.range(1).select(M.half_width(F.lit(0.302), F.lit(162)))
    assert ci.first()[0] == pytest.approx(0.0707, abs=1e-4)
    times = spark.createDataFrame([(1, -1.0), (1, 10.0), (1, 20.0)], "run int, d double")
    assert M.average_time(times, "run", "d").first()[1] == 15.0


def test_relevant_by_matrices_equals_pairs(spark):
    """Against every pair: copies, ties to the smaller key, own row left out, null and zero vectors, sizes that differ; matrices of at most CELLS products."""
    rng = np.random.default_rng(4)
    plain = [[float(x) for x in np.round(rng.normal(size=6), 1)] for _ in range(120)]
    rows = dict(enumerate([*plain, *plain[:40], *[plain[0]] * 30, None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [0.0] * 6, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]))
    df = spark.createDataFrame([*rows.items()], "id int, v array<float>").repartition(5)

    def cosine(a, b):
        total = lambda p, q: functools.reduce(lambda s, x: s + x[0] * x[1], zip(p, q), 0.0)
        return total(a, b) / (total(a, a) ** 0.5 * total(b, b) ** 0.5)

    able = {i: [float(np.float32(x)) for x in v] for i, v in rows.items() if v and None not in v and any(v)}
    want = {}
    for i, v in able.items():
        others = [(-cosine(v, u), j) for j, u in able.items() if j != i and len(u) == len(v)]
        s, j = min(others)
        if -s >= 0.5:
            want[i] = (j, -s)
    found = Q.relevant(df, df, "id", "v", 0.5)
    assert found.dtypes == [("query_id", "int"), ("id", "int"), ("similarity", "double")]
    assert {r.query_id: (r.id, r.similarity) for r in found.collect()} == {i: (j, pytest.approx(s, abs=1e-12)) for i, (j, s) in want.items()}
    # a plan of pairs would have a join; the work goes to matrices, which few products bound
    assert "Join" not in found._jdf.queryExecution().toString()


def test_texts_are_parsed_once(spark):
    for col in (C.record_fault(F.col("x"), "plan", monitors=True), C.record_fault(F.col("x"), "ledger", ["web"]), C.record_fault(F.col("x"), "check")):
        assert str(col).count("try_parse_json") == 1
    values = str(A.typed_values(F.col("x")))
    assert values.count("try_parse_json") == 1 and values.count("schema_of_variant") == 2  # of the value and of a list's items
    rows = [(x,) for x in ('{"a": 1}', '{"a": 1} x', '[1', "1", '],"x', "null", "", None)]
    assert [r.s for r in spark.createDataFrame(rows, "x string").select(X.strict_json(F.col("x")).alias("s")).collect()] == [True, False, False, True, False, True, False, False]
