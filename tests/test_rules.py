"""Rules of single operators on hand-worked rows: answers, links, microdata, splits, summaries, registered scorers."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from runlens.functions import pages as G
from runlens.functions import text as X
from runlens.functions import urls as U
from runlens.operators import history as H
from runlens.operators import metrics as M
from runlens.operators import scoring as S
from runlens.operators import search as Q
from runlens.operators import sequences as W
from runlens.plans.texts import SPLITS, split_tasks


def each(spark, rows, col):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", col(F.col("x")).alias("y")).orderBy("i").collect()]


def test_final_answer(spark):
    rows = ["Final Answer: FINAL ANSWER: a FINAL ANSWER: b", "I think FINAL ANSWER: z", "Final Answer: no marker", "Final Answer: so FINAL ANSWER:\n x \n", " Final Answer: FINAL ANSWER: a", "Final Answer: FINAL ANSWER:", None]
    assert each(spark, rows, X.final_answer) == ["a", None, None, "x", None, "", None]


def test_page_words(spark):
    page = "<p>one  two</p><p>three</p> four " + "five " * 3000
    assert each(spark, [page, "", "<p> a</p>"], lambda c: X.page_lines(c, words=4)) == ["one two\nthree\nfour", "", "a"]
    assert each(spark, [page], lambda c: F.size(F.split(X.page_lines(c, words=2500), r"\s+"))) == [2500]


def test_html_links(spark):
    page = """<A HREF='https://a.org/x'>one <b>two</b>\n three</A><a class="c" href=http://b.org>b</a><a href="/rel">r</a><a href="mailto:x@y">m</a><a name=q>n</a><abbr href="http://no.org">z</abbr><a title="a > b" href="HTTP://C.org/?q">c</a>"""
    assert each(spark, [page, "", None], G.html_links) == [[("https://a.org/x", "one two three"), ("http://b.org", "b"), ("HTTP://C.org/?q", "c")], [], None]


class Items(HTMLParser):
    """Properties by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        scopes = [e for e in self.open if e["scope"]]
        e = {"tag": tag, "scope": "itemscope" in a, "type": a.get("itemtype") or "", "a": a, "text": "", "owner": scopes[-1]["type"] if scopes else None}
        if "itemprop" in a and not e["scope"] and scopes:
            self.found.append(e)
        if tag not in G.VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        at = max((i for i, e in enumerate(self.open) if e["tag"] == tag), default=len(self.open))
        del self.open[at:]

    def handle_data(self, data):
        for e in self.open:
            e["text"] += data

    def told(self):
        value = lambda e, n: e["a"].get("href") if n == "url" else e["a"].get("content") or e["text"].replace("\n", " ").strip() or e["a"].get("src") or ""
        return [(e["owner"], n, value(e, n)) for e in self.found for n in e["a"]["itemprop"].split()]


MICRODATA = [
    '<div itemscope itemtype="A"><span itemprop=name>Ann <b>Lee</b></span></div>',
    '<div itemscope itemtype="A"><p itemprop="a b">x\ny</p><div itemprop=c itemscope itemtype="B"><i itemprop=d>in <u>side</u></i></div><b itemprop=e>out</b></div><b itemprop=f>lost</b>',
    '<div itemscope itemtype=A><a itemprop=url href="/u">t</a><a itemprop=link href="/v">text</a><img itemprop=pic src="p.png"><meta itemprop=m content="c"><span itemprop=none></span></div>',
    '<ul itemscope itemtype=A><li itemprop=x>one<li itemprop=y>two</ul><p itemprop=z>3',
    '<div itemscope><div itemscope itemtype=C><b itemprop=q>1</b></div><b itemprop=r content="">2</b></div></div></p>',
    "<p>plain</p>", "",
    "<div itemscope itemtype=Z>" + "".join(f"<div><span itemprop=p{i}>v{i} <i>w</i></span></div>" for i in range(60)) + "</div>",
]


def test_microdata_nests(spark):
    want = []
    for page in MICRODATA:
        parser = Items()
        parser.feed(page)
        want.append(parser.told())
    got = each(spark, MICRODATA, G.item_properties)
    assert [[tuple(x) for x in r] for r in got] == want
    assert want[0] == [("A", "name", "Ann Lee")] and ("B", "d", "in side") in want[1] and ("A", "e", "out") in want[1]


def test_splits_fractions_and_summaries_refuse(spark):
    df = spark.createDataFrame([(1, "fr", 1.0), (2, "en", 0.0)], "id int, set string, score double")
    assert split_tasks(df, "romance", groups=SPLITS).count() == split_tasks(df, "fr", groups=SPLITS).count() == 1
    with pytest.raises(ValueError, match="no split 'italic'"):
        split_tasks(df, "italic", groups=SPLITS)
    for bad in (0, -0.1, 1.1):
        with pytest.raises(ValueError):
            Q.subsample(df, bad, 1, "id")
    assert Q.subsample(df, 1, 1, "id").count() == 2
    with pytest.raises(Exception, match="no scores"):
        M.score_summary(df.where("score > 5")).collect()


def test_registered_scorers_and_metrics(spark):
    df = spark.createDataFrame([("a b", "a", 1), ("x", "x", 2)], "g string, p string, k int")

    @S.register_scorer("longer")
    def longer(gold, pred):
        return (F.length(gold) > F.length(pred)).cast("double")

    S.register_metric("range", lambda s: {"low": F.min(s), "high": F.max(s)})
    scored = S.score_by(df, F.col("g"), F.col("p"), "longer", "exact")
    assert sorted((r.longer, r.exact) for r in scored.collect()) == [(0.0, 1.0), (1.0, 0.0)]
    assert S.summarise(scored, "longer", "range", "summary").first() == (0.0, 1.0, 0.5, 1.0, 2)
    with pytest.raises(ValueError, match="no scorer named 'none'"):
        S.score_by(df, F.col("g"), F.col("p"), "none")


def test_upsert_sets_the_time(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, version int").withColumn("updated_at", F.lit("2000-01-01").cast("timestamp"))
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, version int").withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.v, r.updated_at.year) for r in H.upsert(rows, changes, "id", "version").collect()}
    assert got[1] == ("a", 2000) and got[2][0] == "d" and got[2][1] > 2020 and got[3][0] == "e"


def test_monitors_sleep_only_in_active_runs(spark):
    rows = [(1, 1, "status", True), (1, 2, "sleeping", True), (2, 1, "sleeping", True), (2, 2, None, False), (3, 1, "sleeping", True), (3, 2, "complete", True), (4, 1, None, None)]
    df = spark.createDataFrame(rows, "run int, at int, state string, live boolean")
    got = {r.run: (r.state, r.sleeping) for r in W.monitor_state(df, "run", ["at"], F.col("state"), F.col("live")).collect()}
    assert got == {1: ("sleeping", True), 2: ("sleeping", False), 3: ("complete", False), 4: (None, False)}
    totals = W.monitor_totals(df, "run", "at", F.col("state"), F.col("at"), F.col("at") * 10).collect()
    assert sorted(tuple(r) for r in totals) == [(1, "sleeping", 2, 20), (2, "sleeping", 1, 10), (3, "complete", 2, 20)]


def test_public_suffix_rules(spark, tmp_path):
    """Plain, wildcard and exception rules from a file, the longest first; hosts without a rule, of one label, of an address."""
    (tmp_path / "rules.dat").write_text("// a comment\n\ncom\nuk\nCO.uk  // said after\n*.ck\n!www.ck\n*.kawasaki.jp\n!city.kawasaki.jp\njp\n*\n")
    want = {
        "http://a.b.com/x": ("a", "b", "com"), "b.com": ("", "b", "com"), "com": ("", "", "com"), "x.y.co.uk": ("x", "y", "co.uk"), "y.uk": ("", "y", "uk"), "co.uk": ("", "", "co.uk"), "a.b.c.ck": ("a", "b", "c.ck"),
        "www.ck": ("", "www", "ck"), "z.www.ck": ("z", "www", "ck"), "c.ck": ("", "", "c.ck"), "ck": ("", "ck", ""), "a.b.c.kawasaki.jp": ("a", "b", "c.kawasaki.jp"), "city.kawasaki.jp": ("", "city", "kawasaki.jp"),
        "m.city.kawasaki.jp": ("m", "city", "kawasaki.jp"), "kawasaki.jp": ("", "kawasaki", "jp"), "one.two.none": ("one", "two", "none"), "localhost:80": ("", "localhost", ""), "http://10.0.0.7:8/x": ("", "10.0.0.7", ""), "A.B.COM.": ("a", "b", "com"),
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    got = U.host_parts(df, "url", spark.read.text(f"{tmp_path}/rules.dat"))
    assert {r.url: (r.subdomain, r.domain, r.suffix) for r in got.collect()} == want and got.columns == ["url", "suffix", "domain", "subdomain", "scheme", "path"]
    few = U.host_parts(df, "url", ["com", "*.ck", "!www.ck"]).where("url in ('www.ck', 'a.b.c.ck', 'y.uk')")
    assert {(r.url, r.suffix) for r in few.collect()} == {("www.ck", "ck"), ("a.b.c.ck", "c.ck"), ("y.uk", "uk")}
    none = U.host_parts(df, "url", spark.createDataFrame([], "value string"))
    assert {r.suffix for r in none.where("url like '%b.com/x' or url = 'localhost:80'").collect()} == {"com", ""}
    assert U.host_parts(spark.createDataFrame([(None,)], "url string"), "url").first().domain is None
    rules = spark.createDataFrame([("b.co.uk", "blocked"), ("c.co.uk", "allowed")], "pattern string, status string")
    urls = spark.createDataFrame([("http://b.co.uk",), ("http://x.b.co.uk",), ("http://b.uk",), ("http://c.co.uk/1",)], "url string")
    assert {r.url for r in U.url_policy(urls, rules).where("allowed").collect()} == {"http://c.co.uk/1"}


def test_parts_of_texts_by_automaton(spark, monkeypatch):
    """Golds of all lengths, with shared heads, inside each other, repeated, in one automaton or in many, against all pairs."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 40, 300]))) for i in range(60)] + [(60, None), (61, texts_end := "x" * 40 + "tail"), (61, texts_end)]
    golds = [(i, word(rng.choice([1, 2, 3, 5, 7]))) for i in range(40)] + [(40, ""), (41, None), (42, "x" * 36 + "tail"), (43, "x" * 36 + "tale"), (44, "x" * 32), (45, "x" * 33), (46, "tail"), (47, "tail"), (48, "\U0001f600")]
    texts.append((62, "say \U0001f600!"))
    want = {(k, g) for k, t in texts for g, x in golds if t is not None and x is not None and x in t}
    t, g = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(golds, "g int, x string")
    for chars in (4_000_000, 600):
        monkeypatch.setattr(Q, "GOLD_CHARS", chars)
        got = Q.holds(t, g, "k", "t", "g", "x", head=4 if chars == 600 else 32)
        assert got.columns == ["k", "g"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_cut_runs_give_the_rows_of_whole_runs(spark, monkeypatch):
    """One run with most rows, a null run, nulls in values: every window function over runs that are cut, against runs in one window each."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), n, rng.choice(["a", "b", "b", "end", "plan", "wait", None]), rng.choice([None, 1.5, 2.0, 7.0]), rng.choice([None, True, False])) for n in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run long, at long, kind string, x double, flag boolean").repartition(3)
    kind = F.col("kind")
    jobs = {
        "seq": lambda d: W.message_seq(d, "run", "at"),
        "repeated": lambda d: W.repeated_steps(d, "run", ["at"], F.when(kind != "wait", kind), F.coalesce(kind == "end", F.lit(False))),
        "unknown separators": lambda d: W.repeated_steps(d, "run", ["at"], kind, F.col("flag")),
        "failed": lambda d: W.failed_steps(d, "run", ["at"], F.when(kind.isin("plan", "end"), kind), "plan"),
        "changed": lambda d: W.changed(d, "run", ["at"], F.when(F.col("at") % 50 > 20, kind)),
        "timing": lambda d: W.check_timing(d, "run", ["at"], F.col("x")),
        "budget": lambda d: W.token_budget(d, "run", ["at"], F.col("at") % 7, 400),
        "phase": lambda d: W.phase_tag(d, "run", ["at"], kind == "plan"),
        "status": lambda d: W.derived_status(d.withColumnRenamed("kind", "status"), "run", ["at"], F.when(F.col("status") == "wait", "awaiting_input").otherwise(F.col("status")), F.col("flag")),
    }
    whole = {name: job(df) for name, job in jobs.items()}
    want = {name: sorted(map(str, d.collect())) for name, d in whole.items()}
    monkeypatch.setattr(W, "RUN_ROWS", 40)
    parts = W.cut(df, "run", ["at"])[0]
    held = {(r.run, r[W.PART]): r["count"] for r in parts.groupBy("run", W.PART).count().collect()}
    assert len([1 for run, part in held if run == 1 and part]) >= 4 and {part for run, part in held if run == 2} and max(held.values()) < 150
    for name, job in jobs.items():
        got = job(df)
        assert got.columns == whole[name].columns and [f.dataType for f in got.schema] == [f.dataType for f in whole[name].schema], name
        assert sorted(map(str, got.collect())) == want[name], name
    own = sorted(r[1] for r in rows if r[0] == 1)
    assert {r.at: r.seq for r in jobs["seq"](df).where("run = 1").collect()} == {at: n + 1 for n, at in enumerate(own)}
    assert jobs["timing"](df.limit(0)).count() == 0


def walked(gold, steps):
    """Longest common subsequence without immediate repeats, by its table."""
    a, b = ([x for i, x in enumerate(xs) if i == 0 or x != xs[i - 1]] for xs in (gold or [], steps))
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return float(row[-1]) if a else None


@pytest.mark.parametrize("steps, summaries, rows", [(4096, 64, 5_000_000), (7, 3, 5_000_000), (5, 2, 60)])
def test_path_scores_of_cut_runs(spark, monkeypatch, steps, summaries, rows):
    rng = random.Random(steps)
    golds = {0: list("abcab"), 1: list("aabbc"), 2: ["d"], 3: [], 4: None, None: list("cba")}
    runs = {run: [rng.choice(["a", "b", "c", "d", None]) for _ in range(n)] for run, n in zip(golds, (150, 33, 8, 5, 9, 1))}
    data = [(run, at, x, golds[run], 0) for run, xs in runs.items() for at, x in enumerate(xs)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "run long, at int, step string, gold array<string>, _at int")
    for name, value in (("STEPS", steps), ("SUMMARIES", summaries), ("RUN_ROWS", rows)):
        monkeypatch.setattr(W, name, value)
    got = W.path_scores(df, "run", ["at"], F.col("step"), F.col("gold"))
    assert {r.run: (r.score, r.last) for r in got.collect()} == {run: (walked(golds[run], xs), xs[-1]) for run, xs in runs.items()}
    assert W.path_scores(df.limit(0), "run", ["at"], F.col("step"), F.col("gold")).count() == 0
