"""Sources, sinks, plans, alignment and streams on small hand-worked input."""

import itertools
import json
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.functions import align as A
from runlens.functions.assignment import _span_scores, sums_of
from runlens.functions import plans as P
from runlens.sources import runs, sinks, tasks
from runlens.streaming import jobs as R


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def value(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_task_sources(spark, tmp_path):
    put(f"{tmp_path}/a/t.jsonl", '{"task_id": "1", "Question": "q", "Level": "2", "Meta": {"a": "b"}}\nnot json\n')
    got = tasks.read_tasks_jsonl(spark, f"{tmp_path}/a", "task_id string, Question string, Level string, Meta map<string,string>", {"id": "task_id", "question": "Question", "set": "Level", "metadata": "Meta"}, "dev")
    assert [tuple(r) for r in got.collect()] == [("1", "q", None, "2", '{"a":"b"}')]
    put(f"{tmp_path}/b/t.json", json.dumps({"x": {"question": "one"}, "y": {"question": "two"}}, indent=1))
    assert {(r.id, r.question, r.set) for r in tasks.read_tasks_json_map(spark, f"{tmp_path}/b", "all").collect()} == {("x", "one", "all"), ("y", "two", "all")}
    put(f"{tmp_path}/c/t.csv", 'problem,answer,metadata\n"a ""b""\nc",42,"{""k"": 1}"\nd,,plain\n')
    got = tasks.read_tasks_csv(spark, f"{tmp_path}/c", "problem string, answer string, metadata string", {"question": "problem", "ground_truth": "answer"})
    assert [(r.question, r.ground_truth, r.m) for r in got.select("*", tasks.metadata_map(F.col("metadata")).alias("m")).collect()] == [('a "b"\nc', "42", {"k": "1"}), ("d", None, {"raw": "plain"})]
    tasks.task_source("mine")(lambda s, path: s.createDataFrame([("1", "q", "dev"), ("2", "r", "test")], "id string, question string, `set` string"))
    assert [r.id for r in tasks.load_tasks(spark, "mine", "", "test").collect()] == ["2"]
    with pytest.raises(ValueError):
        tasks.load_tasks(spark, "absent", "")


def test_run_dirs(spark, tmp_path):
    at = f"{tmp_path}/runs/sys/bench/dev/0/t1"
    put(f"{at}/t1_answer.json", '{"answer": "42"}')
    put(f"{at}/score.json", '{"score": 0.5}')
    put(f"{tmp_path}/runs/sys/bench/dev/0/t2/score.json", '{"score": {"answer": 1.0}}')
    put(f"{at}/times.json", '{"start_time": 1.0, "end_time": 3.5, "duration": 2.5}')
    put(f"{at}/t1_messages.json", '[{"source": "user", "content": "hi", "timestamp": "1", "metadata": {"type": "x"}}, {"source": "web", "content": "yo"}]')
    put(f"{at}/model_tokens_usage.json", '{"web": {"prompt_tokens": 10, "completion_tokens": 2}}')
    out = runs.read_run_dirs(spark, f"{tmp_path}/runs")
    assert [(r.system, r.task_id, r.answer) for r in out["answers"].collect()] == [("sys", "t1", "42")]
    assert {r.task_id: r.score for r in out["scores"].collect()} == {"t1": {"score": 0.5}, "t2": {"answer": 1.0}}
    assert out["times"].first().duration == 2.5 and [r.source for r in out["messages"].collect()] == ["user", "web"]
    assert out["usage"].select("split", "run_id", "client", "prompt_tokens").first() == ("dev", "0", "web", 10)


def test_run_dirs_of_odd_names_and_depths(spark, tmp_path):
    """Tasks whose names look hidden are read, files above and below a task's folder aren't; few bytes are still dealt over many tasks."""
    for task in ("t1", "_t2", ".t3", "t4/deep", ".."):
        put(f"{tmp_path}/r/sys/bench/dev/0/{task}/times.json", '{"duration": 1.0}')
    out = runs.read_run_dirs(spark, f"{tmp_path}/r/")
    assert sorted(r.task_id for r in out["times"].collect()) == [".t3", "_t2", "t1"]
    assert [out[name].count() for name in ("answers", "scores", "messages", "usage")] == [0, 0, 0, 0]
    rows = spark.range(64).select(*(F.lit("x").alias(c) for c in runs.LEVELS[:-1]), F.col("id").cast("string").alias("task_id"), F.col("id").alias("duration"))
    assert runs.spread(rows, *runs.LEVELS).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    runs.write_run_dirs(rows, f"{tmp_path}/w")
    assert {r.task_id: r.duration for r in runs.read_run_dirs(spark, f"{tmp_path}/w", {"times": "part-*.json"})["times"].collect()} == {str(i): float(i) for i in range(64)}


def test_run_dirs_are_opened_by_tasks(spark, tmp_path):
    """Tasks make their own files, without checksums beside them, and no list of files stands in the plan; names and values come back, and no rows are no error."""
    names = ["a/b", "1+1", "50%", "x=y", "_t", ".t", "é {2}", "%41", "", "t"]
    rows = spark.createDataFrame([("s", "b", "d", "0", n, f"say {n}\n", 0.5) for n in names], "system string, benchmark string, split string, run_id string, task_id string, answer string, score double")
    runs.write_run_dirs(rows, f"{tmp_path}/w")
    assert sorted(f for _, _, found in os.walk(f"{tmp_path}/w") for f in found) == ["part-00000.json"] * len(names)
    out = runs.read_run_dirs(spark, f"{tmp_path}/w", {"answers": "part-*.json", "scores": "{part,x}-*.json"})
    assert out["answers"].inputFiles() == []
    assert {r.task_id: r.answer for r in out["answers"].collect()} == {n: f"say {n}\n" for n in names}
    assert [(r.system, r.score) for r in out["scores"].collect()] == [("s", {"score": 0.5})] * len(names)
    with pytest.raises(FileExistsError):
        runs.write_run_dirs(rows, f"{tmp_path}/w")
    runs.write_run_dirs(rows.limit(0), f"{tmp_path}/none")
    assert [d.count() for d in runs.read_run_dirs(spark, f"{tmp_path}/none").values()] == [0] * 5
    put(f"{tmp_path}/h/s/b/d/0/_t/_t_answer.json", '{"answer": "hidden"}')
    put(f"{tmp_path}/h/s/b/d/0/_t/._t_answer.json", "left by a file manager")
    assert [r.answer for r in runs.read_run_dirs(spark, f"{tmp_path}/h")["answers"].collect()] == ["hidden"]


def test_tasks_of_a_run_are_written_once_each(spark, tmp_path):
    """Rows of a task stand in one file whichever task meets them, and many runs with many tasks come back whole."""
    rows = spark.range(3000).select(F.lit("s").alias("system"), (F.col("id") % 7).cast("string").alias("benchmark"), F.lit("d").alias("split"), (F.col("id") % 3).cast("string").alias("run_id"), F.col("id").cast("string").alias("task_id"), F.col("id").cast("double").alias("duration"))
    runs.write_run_dirs(rows.union(rows), f"{tmp_path}/w")
    runs.write_run_dirs(runs.spread(rows.withColumn("answer", F.lit("x")), "task_id"), f"{tmp_path}/dealt", dealt=True)
    assert runs.read_run_dirs(spark, f"{tmp_path}/dealt", {"answers": "part-*.json"})["answers"].where("answer = 'x'").count() == 3000
    files = [f"{at}/{f}" for at, _, found in os.walk(f"{tmp_path}/w") for f in found]
    with open(files[0]) as f:
        assert len(files) == 3000 and len(set(f.read().splitlines())) == 1
    got = runs.read_run_dirs(spark, f"{tmp_path}/w", {"times": "part-*.json"})["times"].select("benchmark", "run_id", "task_id", "duration").collect()
    assert sorted(map(tuple, got)) == sorted((str(i % 7), str(i % 3), str(i), float(i)) for i in range(3000))


def test_spread_follows_the_number_of_shuffle_partitions(spark):
    """Large tables, for which shuffles have many partitions, aren't dealt over the cores alone."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert runs.spread(spark.range(9), "id").rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_run_dirs_read_alike_by_tasks_and_by_spark(spark, tmp_path, monkeypatch):
    """Odd JSON gives the same rows whether tasks open the files or Spark's reader does, as in stores that only it reaches."""
    odd = {
        "n": '{"X": 2.5}', "empty": "", "blank": " \n\t", "cut": '{"X": 2.5', "type": '{"start_time": "abc", "X": 1.5}', "scalar": "42", "null": "null", "rows": ' \n[{"X": 1}, {"X": 2.50}]', "none": "[]", "bad": '[{"X": 1}, {"X": "x", "end_time": 4}]',
        "two": '{"X": 1}\n{"X": 2}', "dup": '{"X": 1, "X": 2}', "nan": '{"X": NaN}', "big": '{"X": 1e400}', "map": '{"X": {"a": 1, "b" : 0.250}}', "list": '{"X": [1, 2.50, null, "s"]}', "text": '{"X": "\\ud83d\\ude00 \\" é"}', "other": '{"y": [1.50], "X": true, "metadata": {"k": [ 1.0 ], "l": null}}',
        "nbsp": "\u00a0", "more": '{"X": 3} more', "bom": '\ufeff{"X": 7}', "a b+c%20d": '{"X": 11}', "task_id=x%2Fy": '{"X": 12}',
    }
    at = f"{tmp_path}/r/sys/bench/dev/0"
    for task, text in odd.items():
        for name, field in (("score.json", "score"), ("times.json", "duration"), (f"{task}_messages.json", "content"), (f"{task}_answer.json", "answer"), ("model_tokens_usage.json", "web")):
            put(f"{at}/{task}/{name}", text.replace("X", field))
    put(f"{at}/used/model_tokens_usage.json", '{"web": {"prompt_tokens": 10}, "x": null}')
    for task, raw in (("utf16", '{"duration": 8}'.encode("utf-16")), ("invalid", b'{"duration": 5, "y": "\xff"}')):
        os.makedirs(f"{at}/{task}")
        with open(f"{at}/{task}/times.json", "wb") as f:
            f.write(raw)
    read = lambda: {name: (d.dtypes, sorted(map(str, d.collect()))) for name, d in runs.read_run_dirs(spark, f"{tmp_path}/r").items()}
    opened = read()
    monkeypatch.setattr(runs, "local_path", lambda *_: None)
    listed = read()
    for name, rows in opened.items():
        assert rows == listed[name]
    assert len(opened["times"][1]) == len(opened["scores"][1]) + 2 == len(odd) + 1  # two blank files and an empty array have no row, two arrays have two each


def test_modified_files(spark, tmp_path):
    for name, at in (("b.py", 1000), ("a.txt", 2000), ("late.txt", 9000), ("x.pyc", 1500), ("sub/c.py", 1000), ("y.cache", 1500), ("my__init__.py", 1200), ("__init__.py", 1200), ("__pycache__/z.py", 1200), ("a.cached/d.py", 1200)):
        put(f"{tmp_path}/{name}", "x")
        os.utime(f"{tmp_path}/{name}", (at, at))
    got = runs.list_modified_files(spark, str(tmp_path), "1970-01-01T00:16:40Z", "1970-01-01T00:33:20Z")
    assert [r.name for r in got.collect()] == ["b.py", "c.py", "d.py", "my__init__.py", "a.txt"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\nyou', [1, 2], 0.0), ("2", None, [], 1.0)], "task_id string, answer string, steps array<int>, score double")
    sinks.write_results(df, f"{tmp_path}/r")
    back = runs.read_results_csv(spark, f"{tmp_path}/r/csv", "task_id string, answer string, steps string, score double", {"steps": "array<int>"})
    assert sorted(map(tuple, back.collect())) == [("1", 'say "hi"\nyou', [1, 2], 0.0), ("2", None, [], 1.0)]
    assert [r.task_id for r in spark.read.json(f"{tmp_path}/r/failed").collect()] == ["1"]
    sinks.write_submission(df, f"{tmp_path}/s", F.col("task_id"), F.col("answer"))
    assert {r.task_id: r.model_answer for r in spark.read.json(f"{tmp_path}/s").collect()} == {"1": 'say "hi"\nyou', "2": ""}
    sinks.write_metrics(df.select("task_id", "score"), f"{tmp_path}/m", "task_id")
    assert sorted(os.listdir(f"{tmp_path}/m"))[-2:] == ["task_id=1", "task_id=2"]


def test_plans(spark):
    c = F.col("x")
    got = value(spark, "x string", ("a\n```py\nx\n```\nb\n```\ny\nz\n```",), P.code_blocks(c))
    assert [tuple(r) for r in got] == [("py", "x\n"), ("", "y\nz\n")]
    assert value(spark, "x string", ("[]",), P.parse_plan(c)) is None and value(spark, "x string", ("no",), P.parse_plan(c)) is None
    assert [tuple(s)[:3] for s in value(spark, "x string", ("[{}]",), P.parse_plan(c)).steps] == [("Untitled Step", "No details provided.", "agent")]
    plan = value(spark, "x string", ('{"task":"t","steps":[{"title":"a","sleep_duration":5,"condition":3},{"title":"off","enabled":false}]}',), P.parse_plan(c))
    assert plan.task == "t" and len(plan.steps) == 1 and plan.steps[0].monitor and plan.steps[0].condition == "3"
    assert value(spark, "x string", ('[{"title":"a"}]',), P.plan_text(P.parse_plan(c))) == "1. a\n   No details provided.\n   [agent]"
    assert value(spark, "x string", ('[{"name":"a.py","type":"file"},{"name":null}]',), P.attached_files(c)) == ["a.py"]


def test_alignment(spark):
    g, p = F.col("g"), F.col("p")
    rng = random.Random(3)
    f1 = lambda x, y: 2 * len({*x.split()} & {*y.split()}) / (len({*x.split()}) + len({*y.split()}))
    words = ["red", "blue", "dog", "cat", "big"]
    span = lambda: " ".join(rng.sample(words, rng.randrange(1, 4)))
    cases = [(["red", "blue"], ["blue", "red"]), (["red", "blue"], ["red"]), ([], ["x"]), (["x"], ["x"] * 11), (["big red dog", "red dog", "small cat"], ["red", "big dog", "cat red", "small red cat"])]
    cases += [([span() for _ in range(rng.randrange(1, 6))], [span() for _ in range(rng.randrange(1, 6))]) for _ in range(12)]
    want = []
    for a, b in cases:
        few, many = sorted((a, b), key=len)
        want.append(max((sum(map(f1, few, order)) for order in itertools.permutations(many, len(few))), default=0) / len(many) if few and len(many) < 9 else {0: 0.0, 1: 1 / 11}[len(few)])
    # beyond the subsets: 12 spans that each match one other in another order, and one half match
    own = [f"w{i} v{i}" for i in range(12)]
    cases.append((own, [*own[:0:-1], "w0 x", "y"]))
    want.append(11.5 / 13)
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, g array<string>, p array<string>")
    got = [r.score for r in A.align_spans(rows, g, p).orderBy("i").collect()]
    assert got == [pytest.approx(x) for x in want]


MANY = [f"w{i} v{i}" for i in range(12)]


def best_sum(scores):
    """Largest sum of a one-to-one choice, by sets of used columns."""
    held = {0: 0.0}
    for row in scores:
        after = dict(held)
        for used, total in held.items():
            for j, x in enumerate(row):
                if not used >> j & 1:
                    after[used | 1 << j] = max(after.get(used | 1 << j, 0.0), total + x)
        held = after
    return max(held.values())


def test_assignment_of_many_matrices_at_once():
    rng = np.random.default_rng(8)
    shapes = [tuple(rng.integers(1, 12, 2)) for _ in range(60)] + [(0, 0), (1, 40), (40, 1), (3, 30), (11, 11), (12, 25)]
    cells = [np.round(rng.random(s) * (rng.random(s) < 0.6), int(rng.integers(1, 4))) for s in shapes]
    got = sums_of(np.array([s[0] for s in shapes]), np.array([s[1] for s in shapes]), np.concatenate([c.reshape(-1) for c in cells]))
    for total, c in zip(got, cells):
        rows = c if c.shape[0] >= c.shape[1] else c.T  # few columns, so few sets
        assert total == pytest.approx(best_sum(rows.tolist()) if c.size else 0.0)


def test_memory_of_alignment_does_not_grow_with_rows():
    spans = lambda n: [[f"w{(i * j) % 97}" for j in range(12)] for i in range(n)]
    some = pa.array([spans(20), None, [], spans(7), [None], spans(20)], pa.list_(pa.list_(pa.string())))
    peaks = []
    for n in (100, 1000):
        rows = pa.concat_arrays([some] * n)
        tracemalloc.start()
        got = _span_scores(rows, rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got.to_pylist() == [1.0, None, None, 1.0, None, 1.0] * n
    assert peaks[1] < 3 * peaks[0]
    assert _span_scores(some[:0], some[:0]).to_pylist() == []
    one = pa.array([spans(300)], some.type)
    assert _span_scores(one, one).to_pylist() == [1.0]


@pytest.mark.parametrize("n", [11, 60, 200])
def test_assignment_beyond_brute_force_has_its_bound(n):
    rng = np.random.default_rng(n)
    order, scores = rng.permutation(n), rng.random((n, n)) * 0.5
    scores[np.arange(n), order] += 0.5  # each row's best is a column of its own, so the sum of row maxima is reached
    assert sums_of(np.array([n]), np.array([n]), scores.reshape(-1))[0] == pytest.approx(scores[np.arange(n), order].sum()) == pytest.approx(scores.max(1).sum())
    u, v = rng.random(n), rng.random(n)  # u + v in a hidden permutation and less elsewhere: its sum is the largest
    hidden = np.maximum(0, u[:, None] + v - rng.random((n, n)))
    hidden[np.arange(n), order] = u + v[order]
    assert sums_of(np.array([n]), np.array([n]), hidden.reshape(-1))[0] == pytest.approx(u.sum() + v.sum())


def test_scores_of_maps_and_answers(spark):
    g, p = F.col("g"), F.col("p")
    maps = [
        ('{"name": "ann", "n": 10}', '{"name": "ann"}', 2 / 3), ('{"a": "red car"}', '{"a": "red car 7"}', 0.0), ('{"a": null}', '{"a": 1}', 0.0), ('{"a": "1,5 sqft"}', '{"a": 1.5}', 1.0), ('{"a": true}', '{"a": 1}', 1.0),
        ('{"a": "5 square kilometers"}', '{"a": 5}', 0.0), ('{"a": "1$2"}', '{"a": 12}', 0.0), ('{"a": "$ 1_2 %"}', '{"a": 12}', 1.0),
        (json.dumps({"a": MANY, "b": "x"}), json.dumps({"a": [*MANY[:0:-1], "w0 x", "y"]}), 2 * (11.5 / 13) * (11.5 / 26) / (11.5 / 13 + 11.5 / 26)), ('{"a": ["x", "y"]}', '{"a": ["y", "x"]}', 1.0), ('{"a": ["x"]}', '{"a": "x"}', 0.0), ("{}", "{}", 0.0), ('{"a": 1}', "no", 0.0),
    ]
    rows = spark.createDataFrame([(i, *m[:2]) for i, m in enumerate(maps)], "i int, g string, p string")
    got = [r.score for r in A.score_dict(rows, A.typed_values(g), A.typed_values(p)).orderBy("i").collect()]
    assert got == [pytest.approx(m[2]) for m in maps]
    typed = [
        ("10", "10", 1.0), ("10", "1\n2", 0.0), ("10", "20", 0.306853), ("10", "ten", 0.0), ("10", "[10]", 0.0), ("red\nblue", '["Blue", "the red"]', 1.0), ("red\nblue", "Blue\nthe red", 1 / 3), ("red", "", 0.0), ("red", None, 0.0),
        ('{"a": "x"}', '{"a": "x"}', 1.0), ("{'a': 'x'}", '[{"a": "x"}]', 1.0), ('{"a": 1}\n{"a": 2}', '{"a": 2}\n{"a": 1}', 1.0), ('{"a": 1}', "x", 0.0), ("1\n2", "1", 0.0), ("", "x", 0.0), ("$ 1,5", "1.5", 1.0),
        ("\n".join(f"w{i}" for i in range(12)), "[" + ", ".join(f'"w{i}"' for i in range(13)) + "]", 12 / 13),
    ]
    rows = spark.createDataFrame([(i, *t[:2]) for i, t in enumerate(typed)], "i int, g string, p string")
    assert [r.score for r in A.score_typed(rows, g, p).orderBy("i").collect()] == [pytest.approx(t[2], abs=1e-5) for t in typed]


def test_paths_and_maps_of_scores(spark):
    g, p = F.col("g"), F.col("p")
    path = lambda a, b: value(spark, "g array<string>, p array<string>", (a, b), A.path_score(g, p))
    assert path([*"abc"], [*"aacb"]) == 2.0 and path([*"abc"], None) == 0.0 and path([], ["a"]) is None
    assert value(spark, "g double, p double", (None, 1.0), A.score_custom(answer=g, target_final_url=p)) == {"target_final_url": 1.0}


SCHEMA = "run long, ts timestamp, at long, kind string"


def replay(spark, tmp_path, batches, job):
    """The rows that a job gives for files that arrive one by one: (run, seconds, at, kind)."""
    src, made = f"{tmp_path}/in", []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(r, s, a, k) for r, s, a, k in rows], "run long, s long, at long, kind string")
        df.select("run", F.timestamp_seconds("s").alias("ts"), "at", "kind").coalesce(1).write.mode("append").parquet(src)
        made.append(job(spark.readStream.schema(SCHEMA).parquet(src)))
        R.appended(made[-1], f"{tmp_path}/out").awaitTermination()
    return spark.read.schema(made[-1].schema).parquet(f"{tmp_path}/out/rows")


def test_monitor(spark, tmp_path):
    job = lambda s: R.monitor(s, "run", "ts", F.col("kind") == "met", F.col("kind") == "error", 3, 60, "at")
    got = replay(spark, tmp_path, [[(1, 1, 1, "x"), (2, 1, 1, "error"), (3, 1, 1, "met")], [(1, 2, 2, "x"), (2, 2, 2, "error"), (3, 2, 2, "x")], [(1, 3, 3, "x"), (2, 3, 3, "error"), (1, 4, 4, "x")]], job)
    out = {}
    for r in got.orderBy("run", "check_number").collect():
        out.setdefault(r.run, []).append((r.status, r.next_check))
    assert out == {1: [("sleeping", 60), ("sleeping", 60), ("complete", 0)], 2: [("error", 30), ("error", 30), ("aborted", 0)], 3: [("complete", 0)]}


def test_monitor_goes_on_after_an_error_at_its_last_check(spark, tmp_path):
    job = lambda s: R.monitor(s, "run", "ts", F.lit(False), F.col("kind") == "error", 2, 60, "at")
    kinds = {1: "x error x x", 2: "x error error error x", 3: "error error x x", 4: "x x error"}
    rows = [(run, n + 1, n + 1, kind) for run, said in kinds.items() for n, kind in enumerate(said.split())]
    want = {1: ["sleeping", "error", "complete"], 2: ["sleeping", "error", "error", "aborted"], 3: ["error", "error", "complete"], 4: ["sleeping", "complete"]}
    for name, parts in (("once", [rows]), ("twice", [[r for r in rows if r[1] <= 2], [r for r in rows if r[1] > 2]])):
        got = replay(spark, f"{tmp_path}/{name}", parts, job).orderBy("run", "check_number").collect()
        assert {run: [r.status for r in got if r.run == run] for run in kinds} == want


def test_input_timeout(spark, tmp_path):
    job = lambda s: R.input_timeout(s, "run", "ts", "at", F.col("kind") == "wait")
    got = replay(spark, tmp_path, [[(r, 10_000, a, "wait") for r, a in ((1, 1), (2, 2), (3, 5))], [(2, 10_060, 3, "reply"), (1, 13_700, 4, "reply")], [(9, 99_000, 9, "reply")]], job)
    assert sorted((r.run, r.at) for r in got.collect()) == [(1, 1), (3, 5)]


def test_long_runs_in_chunks(spark, tmp_path):
    """A run of many chunks a batch in any order, its state taken up in a second batch, against the rules row by row."""
    draw = random.Random(7)
    whole = [(r, 10_000 * (n + 1) + draw.choice([0, 10, 3600, 3601, 5000]), 2 * n + r, draw.choice(["wait", "error", "x", "x", "x"])) for r in (1, 2) for n in range(150)]
    parts = [[x for x in whole if x[1] < 900_000], [x for x in whole if x[1] >= 900_000]]
    for p in parts:
        draw.shuffle(p)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = replay(spark, f"{tmp_path}/m", parts, lambda s: R.monitor(s, "run", "ts", F.lit(False), F.lit(None).cast("boolean"), 140, 60, "at"))
        assert sorted((r.run, r.check_number, r.at, r.status) for r in got.collect()) == [(r, n + 1, 2 * n + r, "complete" if n == 139 else "sleeping") for r in (1, 2) for n in range(140)]
        got = replay(spark, f"{tmp_path}/t", [*parts, [(9, 9_000_000, 1, "x")]], lambda s: R.input_timeout(s, "run", "ts", "at", F.col("kind") == "wait"))
        assert len(got.collect()) == len(set(got.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    want = set()
    for run in (1, 2):
        own = sorted((s, a, k) for r, s, a, k in whole if r == run)
        want |= {(run, a, s + 3600) for (s, a, k), (later, _, _) in zip(own, [*own[1:], (9_000_000, 0, "")]) if k == "wait" and later - s > 3600}
    assert {(r.run, r.at, int(r.stopped_at.timestamp())) for r in got.collect()} == want
    rows = spark.createDataFrame([(r, s, a, k) for r, s, a, k in whole], "run long, s long, at long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    batch = R.input_timeout_batch(rows, "run", "ts", "at", F.col("kind") == "wait")
    last = {max((s, a) for r, s, a, _ in whole if r == run)[1] for run in (1, 2)}
    assert batch.columns == rows.columns and {(r.run, r.at) for r in batch.collect()} == {(r, a) for r, a, _ in want if a not in last}


def test_many_runs_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    """Runs and ids null or beyond the reach of floats, four batches, runs that end while others of their bucket go on: against the rules row by row."""
    appended, queries = R.appended, []
    monkeypatch.setattr(R, "appended", lambda *a: queries.append(appended(*a)) or queries[-1])
    monkeypatch.setattr(R, "BUCKETS", 3, raising=False)
    draw, big = random.Random(3), 2**60
    names = [None, big, big + 1, *range(30)]
    whole = [(r, draw.randrange(10_000, 190_000, 600), None if n == 5 else big + draw.randrange(10**6), draw.choice(["wait", "error", "x"])) for r in names for n in range(draw.randrange(1, 25))]
    whole = list({x[:2]: x for x in whole}.values()) + [(r, 10_000, a, k) for r in names for a, k in ((None, "wait"), (3, "x"))]
    whole = [x for x in whole if x[1] > 10_000 or x[2] in (None, 3)]
    parts = [[x for x in whole if low <= x[1] < low + 60_000] for low in (0, 60_000, 120_000, 180_000)] + [[(99, 9_000_000, 1, "wait")], [(99, 9_000_001, 2, "wait")]]
    own = {r: sorted((x[1:] for x in whole if x[0] == r), key=lambda x: (x[0], x[1] is None, x[1] or 0)) for r in names}
    want = sorted(f"{r} {a} {s + 3600}" for r in names for (s, a, k), (later, _, _) in zip(own[r], [*own[r][1:], (9_000_000, 0, "")]) if k == "wait" and later - s > 3600)
    for no_data in ("true", "false"):  # without such batches a run times out while its bucket has rows
        keep = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", no_data)
        try:
            got = replay(spark, f"{tmp_path}/{no_data}", parts, lambda s: R.input_timeout(s, "run", "ts", "at", F.col("kind") == "wait")).collect()
        finally:
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", keep)
        assert sorted(f"{r.run} {r.at} {int(r.stopped_at.timestamp())}" for r in got) == want
    want = []
    for r in names:
        errors = 0
        for n, (_, a, k) in enumerate(own[r], 1):
            errors += k == "error"
            status = ("aborted" if errors == 3 else "error") if k == "error" else "complete" if n >= 8 else "sleeping"
            want.append(f"{r} {a} {n} {errors} {status}")
            if status in ("aborted", "complete"):
                break
    got = replay(spark, f"{tmp_path}/m", parts[:-2], lambda s: R.monitor(s, "run", "ts", F.lit(False), F.col("kind") == "error", 8, 60, "at")).collect()
    assert sorted(f"{r.run} {r.at} {r.check_number} {r.errors} {r.status}" for r in got) == sorted(want)
    assert 0 < max(s.numRowsTotal for q in queries for p in q.recentProgress for s in p.stateOperators) <= 3  # a state a bucket, not a run


def test_late_and_repeated_rows(spark, tmp_path):
    got = replay(spark, f"{tmp_path}/d", [[(1, 10_000, 1, "a")], [(1, 10_060, 2, "a"), (1, 10_060, 3, "b")], [(9, 80_000, 9, "z")], [(1, 90_000, 4, "a")]], lambda s: R.event_dedupe(s, "ts", ["run", "kind"]))
    assert sorted((r.at) for r in got.collect()) == [1, 3, 4, 9]
    got = replay(spark, f"{tmp_path}/w", [[(1, 30, 1, "a"), (1, 90_000, 2, "a")], [(1, 40, 3, "a")], [(1, 990_000, 4, "a")]], lambda s: R.windowed_condition(s, "ts", "1 minute", None, ["run"], 1))
    assert sorted(r.n for r in got.collect()) == [1, 1]


def test_file_arrivals(spark, tmp_path):
    for name in ("a.txt", "b.txt", "tmp_code_1.py", "sub/a.txt"):
        put(f"{tmp_path}/files/{name}", "x")
    os.utime(f"{tmp_path}/files/a.txt", (1000, 1000))
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/files")
    R.appended(R.file_arrivals(stream, spark.createDataFrame([("b.txt",)], "name string")), f"{tmp_path}/out").awaitTermination()
    new = spark.read.schema("path string, name string, modified timestamp").parquet(f"{tmp_path}/out/rows")
    assert sorted(r.name for r in new.collect()) == ["a.txt", "a.txt"]
    assert [r.path.rsplit("/", 2)[1] for r in R.final_files(new).collect()] == ["sub"]


def test_no_local_scratch_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        sinks.scratch(Session(), "x")
    assert sinks.scratch(spark, "x").endswith("/x")
