"""Queries: tables written by sinks and read back by sources, plans and attachments, list and map scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import align as A
from ..functions import plans as P
from ..operators import sequences as W
from ..sources import runs, sinks, tasks
from .base import query


@query("S1_read_tasks_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS question, lang AS \"set\" FROM documents WHERE doc_id IS NOT NULL")
def s1(t):
    path = sinks.scratch(t.spark, "tasks")
    t("documents").select(F.col("doc_id").cast("string").alias("task_id"), F.coalesce("text", F.lit("")).alias("Question"), F.col("lang").alias("Level")).write.json(path)
    return tasks.read_tasks_jsonl(t.spark, path, "task_id string, Question string, Level string", {"id": "task_id", "question": "Question", "set": "Level"}).select("id", "question", "set")


@query("S2_json_map_rows", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s2(t):
    return tasks.json_map_rows(t("events"), "props", "bigint", "event_id")


@query("S3_read_tasks_csv", "SELECT concat(conv_id, '-', turn) AS id, text AS question, role AS \"set\" FROM conversations")
def s3(t):
    path = sinks.scratch(t.spark, "csv")
    rows = t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("problem"), "role")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tasks.read_tasks_csv(t.spark, path, "key string, problem string, role string", {"id": "key", "question": "problem", "set": "role"}).select("id", "question", "set")


@query("S7_read_results_csv", "SELECT doc_id, quality AS score, [quality, toxic] AS scores FROM labels")
def s7(t):
    path = sinks.scratch(t.spark, "report")
    sinks.write_results(t("labels").select("doc_id", F.col("quality").alias("score"), F.array("quality", "toxic").alias("scores")), path)
    return runs.read_results_csv(t.spark, f"{path}/csv", "doc_id long, score int, scores string", {"scores": "array<int>"})


@query("K1_write_metrics", "SELECT source, lang, round(avg(quality), 6) AS mean_score, count(quality) AS num_tasks FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def k1(t):
    path = sinks.scratch(t.spark, "metrics")
    per = t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id").groupBy("source", "lang").agg(F.round(F.avg("quality"), 6).alias("mean_score"), F.count("quality").alias("num_tasks"))
    sinks.write_metrics(per, path, "source", "lang")
    return t.spark.read.schema("mean_score double, num_tasks long, source string, lang string").json(path).select("source", "lang", "mean_score", "num_tasks")


@query("K2_write_results", "SELECT doc_id, quality AS score FROM labels WHERE quality = 0")
def k2(t):
    path = sinks.scratch(t.spark, "report")
    sinks.write_results(t("labels").select("doc_id", F.col("quality").alias("score")), path)
    return t.spark.read.schema("doc_id long, score int").json(f"{path}/failed")


@query("K3_write_submission", "SELECT CAST(doc_id AS VARCHAR) AS task_id, coalesce(text, '') AS model_answer FROM documents")
def k3(t):
    path = sinks.scratch(t.spark, "submission")
    sinks.write_submission(t("documents"), path, F.col("doc_id").cast("string"), F.col("text"))
    return t.spark.read.schema("task_id string, model_answer string").json(path)


@query("T3_code_blocks", "SELECT conv_id, turn, role AS language, concat(replace(text, '```', '~~~'), chr(10)) AS code FROM conversations UNION ALL SELECT conv_id, turn, '', concat('b', chr(10)) FROM conversations")
def t3(t):
    body = F.replace("text", F.lit("```"), F.lit("~~~"))
    rows = t("conversations").withColumn("said", F.concat(F.lit("see\n```"), "role", F.lit("\n"), body, F.lit("\n```\nand\n```\nb\n```\n")))
    return rows.select("conv_id", "turn", F.inline(P.code_blocks(F.col("said"))))


@query("T4_parse_plan", "SELECT l_orderkey, count(*) AS steps, count(*) FILTER (WHERE l_linenumber = 1) AS monitors, count(*) FILTER (WHERE l_returnflag = 'R') AS untitled FROM (SELECT * FROM lineitem WHERE l_linenumber <> 7) GROUP BY l_orderkey")
def t4(t):
    one = F.col("l_linenumber") == 1
    step = F.struct(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("title"), (F.col("l_linenumber") != 7).alias("enabled"), F.when(one, 60).alias("sleep_duration"), F.when(one, F.lit("3")).alias("condition"),
    )
    plans = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.lit("ship").alias("task"), F.collect_list(step).alias("steps"))).alias("plan"))
    steps = plans.select("l_orderkey", P.parse_plan(F.col("plan"))["steps"].alias("s")).where("s is not null")
    return steps.select("l_orderkey", F.size("s").cast("long").alias("steps"), F.size(F.filter("s", lambda x: x["monitor"])).cast("long").alias("monitors"), F.size(F.filter("s", lambda x: x["title"] == "Untitled Step")).cast("long").alias("untitled"))


@query("T8_attached_files", "SELECT p_partkey, p_name AS name FROM part WHERE p_name <> ''")
def t8(t):
    meta = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.lit("file").alias("type")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("file").alias("type"))))
    return t("part").select("p_partkey", F.explode(P.attached_files(meta)).alias("name"))


@query("F11_align_spans")
def f11(t):
    """Sentences of a turn against those of the next; tested against permutations."""
    spans = t("conversations").select("conv_id", "turn", A.answer_lines(F.regexp_replace("text", r"\. ", "\n")).alias("gold"))
    nxt = spans.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("gold").alias("pred"))
    return A.align_spans(spans.join(nxt, ["conv_id", "turn"]), F.col("gold"), F.col("pred")).select("conv_id", "turn", F.round("score", 6).alias("score"))


NUMBERS = "SELECT event_id, CASE WHEN g = 0 AND p = 0 THEN 1.0 WHEN p IS NULL THEN 0.0 ELSE round(greatest(0, 1 - ln(greatest(CASE WHEN g = 0 THEN 1e-4 ELSE g END, CASE WHEN p = 0 THEN 1e-4 ELSE p END) / least(CASE WHEN g = 0 THEN 1e-4 ELSE g END, CASE WHEN p = 0 THEN 1e-4 ELSE p END))), 6) END AS score FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS g, lag(CAST(json_extract_string(props, '$.k') AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


def before(t):
    return F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))


DICTS = """
WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, lag(event_type) OVER w AS u, lag(CAST(json_extract_string(props, '$.k') AS DOUBLE)) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
z AS (SELECT *, CASE WHEN k = 0 THEN 1e-4 ELSE k END AS a, CASE WHEN p = 0 THEN 1e-4 ELSE p END AS b FROM e),
s AS (SELECT event_id, p, CASE WHEN k = 0 AND p = 0 THEN 1.0 ELSE greatest(0, 1 - ln(greatest(a, b) / least(a, b))) END AS n, CASE WHEN t = u THEN 2.0 / 3 ELSE 0 END AS w FROM z)
SELECT event_id, CASE WHEN p IS NULL OR n + w + n = 0 THEN 0.0 ELSE round(2 * (n + w) / 2 * n / 2 / ((n + w) / 2 + n / 2), 6) END AS score FROM s
"""


@query("F12_score_dict", DICTS)
def f12(t):
    """A number and a text; the predicted text also has a number, which precision asks the gold one for and recall doesn't."""
    doc = lambda note: F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), note.alias("note")))
    before_ = F.lag(doc(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t("events").select("event_id", A.typed_values(doc(F.col("event_type"))).alias("gold"), A.typed_values(before_).alias("pred"))
    return A.score_dict(rows, F.col("gold"), F.col("pred")).select("event_id", F.round("score", 6).alias("score"))


@query("F13_score_typed", NUMBERS)
def f13(t):
    rows = t("events").select("event_id", "props", F.coalesce(before(t), F.lit("")).alias("was"))
    k = lambda c: F.coalesce(F.get_json_object(c, "$.k"), F.lit(""))
    even = F.col("event_id") % 2 == 0  # half as numbers, half as JSON
    gold, pred = F.when(even, k("props")).otherwise(F.col("props")), F.when(even, k("was")).otherwise(F.col("was"))
    return A.score_typed(rows.select("event_id", gold.alias("g"), pred.alias("p")), F.col("g"), F.col("p")).select("event_id", F.round("score", 6).alias("score"))


FUNNEL = ["signup", "view", "click", "purchase"]


def paths(t):
    return W.path_scores(t("events"), "user_id", ["ts", "event_id"], F.col("event_type"), F.array(*map(F.lit, FUNNEL)))


def path_sql(select: str) -> str:
    """Longest common subsequence by trying each of the funnel's 16 subsequences as a pattern."""
    kept = [[c for i, c in enumerate(FUNNEL) if m >> i & 1] for m in range(16)]
    tries = ", ".join(f"CASE WHEN regexp_matches(path, '{'.*'.join(k)}') THEN {len(k)}.0 ELSE 0.0 END" for k in kept)
    return f"WITH p AS (SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id), s AS (SELECT *, CAST(list_max([{tries}]) AS DOUBLE) AS score FROM p) {select}"


@query("F15_path_score", path_sql("SELECT user_id, score FROM s"))
def f15(t):
    return paths(t).select("user_id", "score")


@query("F16_score_custom", path_sql("SELECT user_id, 'intermediate_url_list' AS key, score FROM s UNION ALL SELECT user_id, 'target_final_url', CAST(path LIKE '%purchase' AS DOUBLE) FROM s WHERE user_id % 2 = 0"))
def f16(t):
    last = F.when(F.col("user_id") % 2 == 0, (F.col("last") == "purchase").cast("double"))
    scores = A.score_custom(intermediate_url_list=F.col("score"), target_final_url=last, answer=F.lit(None))
    return paths(t).select("user_id", F.explode(scores).alias("key", "score"))


@query("S4_read_run_dirs", "SELECT source AS benchmark, coalesce(lang, 'none') AS split, CAST(doc_id AS VARCHAR) AS task_id, coalesce(text, '') AS answer, CAST(quality AS DOUBLE) AS score, CAST(doc_id AS DOUBLE) / 10 AS duration FROM documents JOIN labels USING (doc_id)")
def s4(t):
    """Answers, scores and times of each labelled document, written as one file in a run directory, from which each of the three is read again."""
    root = sinks.scratch(t.spark, "runs")
    d = runs.spread(t("documents").select("doc_id", "text", "source", "lang"), "doc_id").join(runs.spread(t("labels"), "doc_id"), "doc_id")
    level = [F.lit("runlens").alias("system"), F.col("source").alias("benchmark"), F.coalesce("lang", F.lit("none")).alias("split"), F.lit("0").alias("run_id"), F.col("doc_id").cast("string").alias("task_id")]
    values = [F.coalesce("text", F.lit("")).alias("answer"), F.col("quality").cast("double").alias("score"), (F.col("doc_id") / 10).alias("duration")]
    runs.write_run_dirs(d.select(*level, *values), root, dealt=True)
    out = runs.read_run_dirs(t.spark, root, {name: "part-*.json" for name in ("answers", "scores", "times")})
    scores = out["scores"].select(*runs.LEVELS, F.col("score")["score"].alias("score"))
    whole = out["answers"].select(*runs.LEVELS, "answer").join(scores, runs.LEVELS, "left").join(out["times"].select(*runs.LEVELS, "duration"), runs.LEVELS, "left")
    return whole.drop("system", "run_id")


@query("S5_list_modified_files", "SELECT concat('part-', n_nationkey) AS file, 'nation' AS folder FROM nation UNION ALL SELECT concat('part-', r_regionkey), 'region' FROM region")
def s5(t):
    """Files of two tables, written a row a folder; all are younger than the year 2000."""
    root = sinks.scratch(t.spark, "files")
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        t(name).select(F.concat(F.lit("part-"), key).alias("file"), F.col(key).cast("string").alias("value")).write.partitionBy("file").text(f"{root}/{name}")
    found = runs.list_modified_files(t.spark, root, "2000-01-01T00:00:00Z", "2999-01-01T00:00:00Z").where("extension = 'txt'")
    return found.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), F.regexp_extract("path", "/(nation|region)/", 1).alias("folder"))


@query("X3_task_source", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'dev' AS \"set\" FROM benchmark WHERE item_id % 2 = 0")
def x3(t):
    """The benchmark table by a user's own loader, of which one split is taken."""
    split = F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test")
    tasks.task_source("benchmark")(lambda spark, path: spark.read.parquet(path).select(F.col("item_id").alias("id"), F.col("text").alias("question"), split.alias("set")))
    return tasks.load_tasks(t.spark, "benchmark", t.path("benchmark"), "dev").select("id", "question", "set")
