"""Queries: reports, joins, history, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators import search as Q
from ..operators import sequences as S
from .base import query

DL = "documents JOIN labels USING (doc_id)"


def answers(t) -> DataFrame:
    """Documents as answers with their labels as scores."""
    return t("documents").join(t("labels"), "doc_id").withColumn("score", F.col("quality").cast("double"))


@query("A1_score_summary", "SELECT round(avg(quality), 6) AS mean_score, CAST(max(quality) AS DOUBLE) AS max_score, count(quality) AS num_tasks FROM labels")
def a1(t):
    return M.score_summary(t("labels"), "quality")


@query("A2_score_summary_by_key", "SELECT key, round(avg(value), 6) AS mean_score, CAST(max(value) AS DOUBLE) AS max_score, count(*) AS num_tasks FROM (SELECT 'quality' AS key, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) WHERE value IS NOT NULL GROUP BY key")
def a2(t):
    return M.score_summary_by_key(t("labels").select(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("score")))


@query("A3_accuracy_by_group", f"SELECT source, lang, round(avg(quality), 6) AS accuracy, count(quality) AS n FROM {DL} GROUP BY source, lang")
def a3(t):
    return M.accuracy_by_group(answers(t), "source", "lang")


@query("A4_combine_runs", "SELECT round(avg(m), 6) AS mean_score, CAST(max(x) AS DOUBLE) AS max_score, round(avg(n), 6) AS num_tasks, count(*) AS num_runs FROM (SELECT doc_id % 3 AS run, avg(quality) AS m, max(quality) AS x, count(quality) AS n FROM labels GROUP BY 1) HAVING count(*) >= 2")
def a4(t):
    return M.combine_runs(t("labels").withColumn("run", F.col("doc_id") % 3), "run", "quality")


@query("A5_average_time", "SELECT user_id, round(avg(CASE WHEN value <> -1 THEN value END), 6) AS avg_task_time, round(sum(CASE WHEN value <> -1 THEN value END), 4) AS total_time FROM events GROUP BY user_id")
def a5(t):
    return M.average_time(t("events"), "user_id", "value")


@query("A5_average_run_time", "SELECT round(sum(CASE WHEN value <> -1 THEN value END) / count(DISTINCT user_id), 3) AS avg_run_time, count(DISTINCT user_id) AS num_runs FROM events")
def a5b(t):
    return M.average_run_time(t("events"), "user_id", "value")


@query("A6_run_outcome", "SELECT count(*) FILTER (quality = 1) AS succeeded, count(*) FILTER (quality <> 1) AS failed FROM labels")
def a6(t):
    return M.run_outcome(t("labels"), F.col("quality") == 1)


@query("A7_accuracy_variants", f"SELECT source, round(avg(quality), 6) AS success_rate, round(avg(CAST(contains(text, 'and') AS DOUBLE)), 6) AS unable_rate, round(avg(CASE WHEN NOT contains(text, 'and') THEN CAST(quality AS DOUBLE) END), 6) AS accuracy_excluding, round(avg(CASE WHEN contains(text, 'and') THEN 1.0 ELSE CAST(quality AS DOUBLE) END), 6) AS accuracy_counting FROM {DL} GROUP BY source")
def a7(t):
    return M.accuracy_variants(answers(t), F.col("text").contains("and"), "source")


@query("A8_accuracy_ci", f"SELECT source, round(p, 6) AS accuracy, n, round(1.96 * sqrt(p * (1 - p) / n), 6) AS half_width FROM (SELECT source, avg(quality) AS p, count(quality) AS n FROM {DL} GROUP BY source)")
def a8(t):
    return M.accuracy_ci(answers(t), "source")


WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


def words(col: str = "text"):
    return F.size(F.filter(F.split(col, "[ \\t\\n\\r]+"), lambda x: x != ""))


@query("A9_token_totals", f"SELECT CAST(sum(CASE WHEN role <> 'system' THEN {WORDS} END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role <> 'system' THEN length(text) END) AS BIGINT) AS completion_tokens FROM conversations")
def a9(t):
    return M.token_totals(t("conversations").withColumn("w", words()).withColumn("c", F.length("text")), "role", "w", "c", "system")


@query("A9_token_pivot", "SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS assistant, CAST(sum(CASE WHEN role = 'system' THEN length(text) END) AS BIGINT) AS system, CAST(sum(CASE WHEN role = 'user' THEN length(text) END) AS BIGINT) AS user FROM conversations GROUP BY conv_id")
def a9b(t):
    return t("conversations").groupBy("conv_id").pivot("role", ["assistant", "system", "user"]).agg(F.sum(F.length("text")))


@query("A10_reply_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS execution_replies, count(*) FILTER (event_type = 'view') AS planning_replies FROM events GROUP BY user_id")
def a10(t):
    return M.reply_counts(t("events"), "user_id", F.col("event_type") == "click", F.col("event_type") == "view")


@query("A11_reply_stats", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 50) AS n FROM events GROUP BY user_id) SELECT round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max, min(n) AS min, round(avg(CASE WHEN n >= 1 THEN n END), 6) AS mean_some, median(CASE WHEN n >= 1 THEN n END) AS median_some, round(avg(CAST(n >= 1 AS DOUBLE)), 6) AS share_some FROM c")
def a11(t):
    return M.reply_stats(M.reply_counts(t("events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 50), F.lit(False)), "execution_replies")


@query("A12_value_share", "SELECT toxic, n, round(100 * n / sum(n) OVER (), 4) AS percent, n_able, round(100 * n_able / sum(n_able) OVER (), 4) AS percent_able FROM (SELECT toxic, count(*) AS n, count(*) FILTER (quality <> 0) AS n_able FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)")
def a12(t):
    return M.value_share(t("labels"), "toxic", F.col("quality") == 0)


@query("A13_latest_run", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def a13(t):
    return M.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("A14_latest_file", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def a14(t):
    return M.latest(t("documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("A15_sentinel_rollup", "SELECT user_id, CAST(event_id // 100 AS BIGINT) AS check_number, arg_max(props, event_id) FILTER (event_type = 'error') AS reason, round(arg_max(value, event_id) FILTER (event_type = 'view'), 6) AS next_check_in, count(*) FILTER (event_type = 'click') AS messages, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY 1, 2")
def a15(t):
    kind, checks = F.col("event_type"), events(t).withColumn("check_number", F.floor(F.col("event_id") / 100))
    out = S.sentinel_rollup(checks, ["user_id", "check_number"], "event_id", F.when(kind == "error", F.col("props")), F.when(kind == "view", F.col("value")), kind == "click", kind)
    return out.withColumn("next_check_in", F.round("next_check_in", 6)).withColumn("kinds", F.array_join("kinds", ","))


@query("A15_monitor_totals", "SELECT user_id, event_type AS state, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS total_checks, CAST(floor(coalesce(value, 0)) AS BIGINT) AS runtime FROM events WHERE event_type IN ('view', 'click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def a15_totals(t):
    state = F.when(F.col("event_type").isin("view", "click", "error"), F.col("event_type"))
    return S.monitor_totals(events(t), "user_id", "event_id", state, F.get_json_object("props", "$.k").cast("long"), F.floor("value"))


@query("A16_screenshot_index", "SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS part, i = len(p) AND turn = max(turn) OVER (PARTITION BY conv_id) AS current FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)")
def a16(t):
    return S.part_index(t("conversations").select("conv_id", "turn", F.split("text", "\n").alias("p")), "conv_id", "turn", "p").select("conv_id", "turn", "part", "current")


@query("J1_tasks_answers", "SELECT d.doc_id, d.lang, c.turn, c.text AS answer FROM documents d LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') c ON d.doc_id = c.conv_id")
def j1(t):
    """Documents as tasks; answers are the assistant's turns of the conversation with that number, which most tasks lack."""
    found = t("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("answer"))
    return Q.tasks_with_answers(t("documents").select("doc_id", "lang"), found, "doc_id")


@query("J2_enrich_results", "SELECT d.doc_id, d.source, l.quality, c.turns FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c ON d.doc_id = c.conv_id WHERE l.quality IS NOT NULL")
def j2(t):
    turns = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left").join(turns, "doc_id", "left").dropna(subset=["quality"])


@query("J3_reference_answers", "SELECT n.n_nationkey, n.n_name, coalesce(arg_min(s.s_name, s.s_suppkey), '') AS answer FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name")
def j3(t):
    first = Q.first_references(t("supplier"), "s_nationkey", "s_name", "s_suppkey").withColumnRenamed("s_nationkey", "n_nationkey")
    return t("nation").join(first, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("answer", F.lit("")).alias("answer"))


@query("J4_complete_submission", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN text IN ('Unable to determine', 'None') THEN '' ELSE coalesce(text, '') END AS text FROM documents d FULL JOIN (SELECT doc_id + 3 AS doc_id FROM labels) l ON d.doc_id = l.doc_id")
def j4(t):
    asked = t("labels").select((F.col("doc_id") + 3).alias("doc_id"))
    return Q.complete_submission(t("documents"), asked, "doc_id", "text").withColumnRenamed("answer", "text")


@query("J5_unscored_only", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j5(t):
    return Q.unscored(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("J8_session_history", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def j8(t):
    c = t("conversations")
    out = H.nested_history(c.select("conv_id").distinct(), c, "conv_id", ["turn"], ["role"], "messages")
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join("messages.role", ",").alias("roles"))


@query("J8_order_history", "SELECT c_custkey, count(DISTINCT o_orderkey) AS runs, count(l_orderkey) AS messages, round(sum(l_quantity), 2) AS quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def j8b(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("m"), F.sum("l_quantity").alias("q"))
    runs = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("runs"), F.sum("m").alias("m"), F.sum("q").alias("q"))
    return t("customer").select("c_custkey").join(runs, "c_custkey", "left").select("c_custkey", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), F.coalesce("m", F.lit(0)).cast("long").alias("messages"), F.round("q", 2).alias("quantity"))


@query("J9_owned_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def j9(t):
    return H.owned(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_nationkey = 3").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("J10_new_files", "SELECT concat(p_name, '-', p_partkey % 97) AS name FROM part WHERE p_partkey % 2 = 0 AND concat(p_name, '-', p_partkey % 97) NOT IN (SELECT concat(p_name, '-', p_partkey % 97) FROM part WHERE p_partkey % 3 = 0) AND concat(p_name, '-', p_partkey % 97) NOT IN (SELECT concat(p_name, '-', p_partkey % 97) FROM part WHERE p_partkey % 5 = 0) AND NOT starts_with(p_name, 'a') AND NOT starts_with(p_name, 'b')")
def j10(t):
    files = t("part").select("p_partkey", F.concat_ws("-", "p_name", F.col("p_partkey") % 97).alias("name"))
    pick = lambda n: files.where(F.col("p_partkey") % n == 0).select("name")
    return H.new_files(pick(2), pick(3), pick(5), skip=("a", "b"))


@query("J11_existing_config", "SELECT a.p_partkey, min(b.p_partkey) AS same_as FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND b.p_partkey < a.p_partkey GROUP BY a.p_partkey")
def j11(t):
    p = t("part").select("p_partkey", H.canonical_hash("p_type", "p_brand", "p_size").alias("h"))
    first = F.min("p_partkey").over(Window.partitionBy("h"))
    return p.withColumn("same_as", first).where("same_as < p_partkey").select("p_partkey", "same_as")


@query("J12_get_or_create", "SELECT o_custkey AS c_custkey, 'new' AS c_mktsegment FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def j12(t):
    return H.get_or_create(t("customer").where("c_custkey % 2 = 0"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", {"c_mktsegment": "new"})


@query("K4_upsert", "SELECT o_orderkey, o_orderstatus, '2000-01-01' AS updated FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X', '2024-05-06' FROM orders WHERE o_orderkey % 7 = 0")
def k4(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"), F.lit("2000-01-01").cast("timestamp").alias("updated_at"))
    fresh = o.where("o_orderkey % 7 = 0")
    changes = fresh.withColumn("o_orderstatus", F.lit("W")).withColumn("version", F.lit(1)).unionByName(fresh.withColumn("o_orderstatus", F.lit("X")).withColumn("version", F.lit(2)))
    stored = H.upsert(o, changes, "o_orderkey", "version", now=F.lit("2024-05-06").cast("timestamp"))
    return stored.select("o_orderkey", "o_orderstatus", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("K5_delete_cascade", "SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0))")
def k5(t):
    left = H.delete_cascade([(t("customer"), "c_custkey", None), (t("orders"), "o_orderkey", "o_custkey"), (t("lineitem"), "l_linenumber", "l_orderkey")], t("customer").where("c_custkey % 5 = 0").select("c_custkey"))
    named = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for df, n in zip(left, ("customer", "orders", "lineitem"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("U1_union_task_sets", "SELECT item_id AS id, text AS q FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, text FROM documents")
def u1(t):
    return H.union_task_sets([t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("q")), t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("q"))], "id")


@query("U2_file_set_diff", "SELECT p_name, p_brand FROM part WHERE p_size < 30 EXCEPT SELECT p_name, p_brand FROM part WHERE p_size > 20")
def u2(t):
    return H.set_diff(t("part").where("p_size < 30"), t("part").where("p_size > 20"), "p_name", "p_brand")


EV = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
ORD = ["ts", "event_id"]


def events(t) -> DataFrame:
    return t("events").select("user_id", "event_id", "ts", "event_type", "value", "props")


@query("W1_message_seq", f"SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq FROM {EV}")
def w1(t):
    return S.message_seq(events(t), "user_id", *ORD).select("user_id", "event_id", "seq")


@query("W2_repeated_steps", "WITH a AS (SELECT *, sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seps FROM events) SELECT user_id, event_id, coalesce(lag(seps) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = seps, false) AND event_type <> 'purchase' AS repeated FROM a")
def w2(t):
    return S.repeated_steps(events(t), "user_id", ORD, F.col("event_type"), F.col("event_type") == "purchase").select("user_id", "event_id", "repeated")


@query("W3_failed_steps", "SELECT user_id, event_id, coalesce(first_value(CASE WHEN event_type IN ('click', 'error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 'error', false) AS failed FROM events")
def w3(t):
    signal = F.when(F.col("event_type").isin("click", "error", "signup"), F.col("event_type"))
    return S.failed_steps(events(t), "user_id", ORD, signal, "error").select("user_id", "event_id", "failed")


@query("W4_run_progress", f"""WITH e AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id), -1) AS f, max(seq) OVER (PARTITION BY user_id) AS m FROM {EV}),
g AS (SELECT user_id, max(f) AS f, arg_max(CAST(event_id AS BIGINT), seq) FILTER (event_type = 'click' AND seq > f) AS step, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), seq) FILTER (event_type = 'click' AND seq > f AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 0) AS n, count(*) FILTER (event_type = 'click' AND seq > f) AS steps_after, bool_or(event_type = 'signup' AND seq > f) AS plan_after, bool_or(event_type = 'signup' AND seq > m - 3) AS plan_late, arg_max(event_type, seq) <> 'error' AS live FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN live THEN coalesce(step, -1) ELSE -1 END AS step, CASE WHEN live THEN coalesce(n, 0) ELSE -1 END AS plan_length, f >= 0 AND NOT plan_after AS has_final, live AND step IS NULL AND CASE WHEN f >= 0 THEN plan_after ELSE plan_late END AS planning, steps_after FROM g""")
def w4(t):
    """A run whose last event is an error counts as not live."""
    e = S.message_seq(events(t), "user_id", *ORD)
    kind, length = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    return S.run_progress(e, "user_id", "seq", kind == "purchase", F.when(kind == "click", F.col("event_id")), F.when((kind == "click") & (length > 0), length), kind == "signup", kind != "error")


@query("W5_monitor_state", "SELECT user_id, state, state IS NOT NULL AND state = 'sleeping' AND last <> 'error' AS sleeping FROM (SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN 'sleeping' ELSE event_type END, struct_pack(a := ts, b := event_id)) FILTER (event_type IN ('view', 'click', 'signup')) AS state, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY user_id)")
def w5(t):
    """Views are sleeps, clicks checks, signups ends; a run whose last event is an error isn't active."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "sleeping").when(kind.isin("click", "signup"), kind)
    return S.monitor_state(events(t), "user_id", ORD, state, kind != "error")


@query("W6_page_changed", "SELECT user_id, event_id FROM (SELECT *, md5(props) AS h, lag(md5(props)) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR h IS DISTINCT FROM p")
def w6(t):
    return S.changed(events(t), "user_id", ORD, F.col("props")).select("user_id", "event_id")


@query("W7_check_timing", "SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS check_number, round(epoch(ts) - first_value(epoch(ts)) OVER w, 3) AS since_start, round(coalesce(epoch(ts) - lag(epoch(ts)) OVER w, 0), 3) AS since_last FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w7(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    out = S.check_timing(events(t).where("event_type = 'view'"), "user_id", ORD, seconds)
    return out.select("user_id", "event_id", "check_number", F.round("since_start", 3).alias("since_start"), F.round("since_last", 3).alias("since_last"))


@query("W8_derived_status", "WITH a AS (SELECT *, CASE WHEN event_type = 'view' AND (event_type = 'purchase' OR coalesce(lag(event_type = 'purchase') OVER w, false)) THEN 'final_answer_awaiting_input' WHEN event_type = 'view' THEN 'awaiting_input' ELSE event_type END AS status FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM a) SELECT user_id, event_id, status FROM b WHERE status IS DISTINCT FROM p")
def w8(t):
    status = F.when(F.col("event_type") == "view", "awaiting_input").otherwise(F.col("event_type"))
    return S.derived_status(events(t), "user_id", ORD, status, F.col("event_type") == "purchase").select("user_id", "event_id", "status")


@query("W9_phase_tag", "SELECT user_id, event_id, CASE WHEN event_type <> 'signup' AND bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 'execution' ELSE 'planning' END AS phase FROM events")
def w9(t):
    return S.phase_tag(events(t), "user_id", ORD, F.col("event_type") == "signup").select("user_id", "event_id", "phase")


@query("W10_last_n", "SELECT user_id, event_id, CAST(r AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 15")
def w10(t):
    return S.last_n(events(t), "user_id", ORD, 15).select("user_id", "event_id", "back")


@query("W11_token_budget", f"SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM (SELECT conv_id, turn, sum({WORDS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running FROM conversations) WHERE running <= 300")
def w11(t):
    return S.token_budget(t("conversations"), "conv_id", ["turn"], words(), 300).select("conv_id", "turn", "running")
