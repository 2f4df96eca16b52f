"""Queries: predicates, scores, text, pages, links, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align as A
from ..functions import pages as G
from ..functions import records as C
from ..functions import text as X
from ..functions import urls as U
from ..operators import history as H
from ..operators import scoring as S
from ..operators import search as Q
from .base import SQL, query

J = "(SELECT b.item_id, d.doc_id, b.text AS gold, d.text AS pred FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, place):
    """The value at a place of a list of texts, which goes round."""
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def items(t) -> int:
    """Numbers of benchmark items run from 0; how many there are."""
    return (t("benchmark").agg(F.max("item_id")).first()[0] or 0) + 1


def pairs(t) -> DataFrame:
    """Benchmark texts as gold, documents as predictions."""
    d = t("documents").select("doc_id", F.col("text").alias("pred"), (F.col("doc_id") % items(t)).alias("item_id"))
    return d.join(t("benchmark").select("item_id", F.col("text").alias("gold")), "item_id")


@query("S6_read_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def s6(t):
    return H.filter_eq(t("nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_regionkey": 1}, [F.desc("n_nationkey")])


@query("P1_filter_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p1(t):
    return H.filter_eq(t("orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", "o_custkey")


SPLITS = {"romance": ["fr", "es"], "germanic": ["en", "de"]}


def split_tasks(tasks: DataFrame, split: str, col: str = "set", groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Tasks of a split; a group's name stands for its members. With groups, a split that is neither a group nor a member is an error."""
    if groups is not None and split not in groups and not any(split in members for members in groups.values()):
        raise ValueError(f"no split {split!r}; there are {', '.join(sorted({*groups, *(m for ms in groups.values() for m in ms)}))}")
    return tasks.where(F.col(col).isin((groups or {}).get(split, [split])))


@query("P2_split_tasks", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')")
def p2(t):
    return split_tasks(t("documents").select("doc_id", "lang"), "romance", "lang", SPLITS)


@query("P3_subsample", "SELECT doc_id FROM documents ORDER BY sha256(concat('7-', doc_id)), doc_id LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)")
def p3(t):
    return Q.subsample(t("documents").select("doc_id"), 0.1, 7, "doc_id")


@query("P4_head_n", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def p4(t):
    return t("benchmark").orderBy("item_id").limit(10)


@query("P5_visible_messages", "SELECT conv_id, turn FROM conversations WHERE role IS DISTINCT FROM 'system'")
def p5(t):
    meta = F.when(F.col("role") == "system", F.create_map(F.lit("internal"), F.lit("yes"))).otherwise(F.create_map(F.lit("kind"), F.lit("text")))
    return t("conversations").withColumn("metadata", meta).where(C.visible(F.col("metadata"))).select("conv_id", "turn")


SOURCES = [*C.LEARNABLE_SOURCES, "User", "system"]
TYPES = [*C.LEARNABLE_TYPES, "ToolCallEvent"]


@query("P6_learnable_messages", f"SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % {len(SOURCES)} < 8 AND turn % 3 < 2")
def p6(t):
    source, kind = pick(SOURCES, F.col("conv_id") + F.col("turn")), pick(TYPES, F.col("turn"))
    return t("conversations").where(C.learnable(source, kind)).select("conv_id", "turn")


@query("P7_user_history_only", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def p7(t):
    return t("conversations").where(F.col("role").isin("user")).select("conv_id", "turn")


NAMES = [f"dir.x/file{e}" for names in C.FILE_TYPES.values() for e in names] + ["a.PY", ".py", "noext", "dir.py/x", "b.tar.gz", "..a.csv", "c.", "photo.old.png"]
KINDS = [k for k, names in C.FILE_TYPES.items() for _ in names] + ["unknown", "unknown", "unknown", "unknown", "unknown", "csv", "unknown", "image"]


@query("P8_file_type", f"SELECT page_id, {sql_list(KINDS)}[CAST(page_id % {len(NAMES)} + 1 AS INTEGER)] AS type, CASE WHEN regexp_matches(url, '[.]pdf$') THEN 'pdf' WHEN regexp_matches(url, '[.]html$') THEN 'code' ELSE 'unknown' END AS url_type FROM pages")
def p8(t):
    name = F.concat_ws("/", "url", pick(NAMES, F.col("page_id")))
    return t("pages").select("page_id", C.file_type(name).alias("type"), C.file_type(F.col("url")).alias("url_type"))


@query("P9_stable_id", "SELECT doc_id, left(sha256(text), 16) AS id, replace(replace(rtrim(base64(unhex(left(sha256(text), 32))), '='), '+', '-'), '/', '_') AS safe_id FROM documents")
def p9(t):
    return t("documents").select("doc_id", X.stable_id(F.col("text")).alias("id"), X.url_safe_id(F.col("text")).alias("safe_id"))


@query("P10_format_question", "SELECT p_partkey, concat('Read this. Question: ', p_name, chr(10), 'A: ', p_brand, chr(10), 'B: ', p_type, chr(10), 'C: ', p_name, CASE WHEN p_size % 2 = 0 THEN concat(chr(10), 'Attached file: ', p_container) ELSE '' END) AS prompt FROM (SELECT *, p_brand AS p_container FROM part)")
def p10(t):
    file = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return t("part").select("p_partkey", C.format_question(F.col("p_name"), F.array("p_brand", "p_type", "p_name"), file, "Read this. ").alias("prompt"))


@query("P11_recency_bucket", "SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1998-08-01' THEN 'today' WHEN o_orderdate >= DATE '1998-07-31' THEN 'yesterday' WHEN o_orderdate >= DATE '1998-07-25' THEN 'last7Days' WHEN o_orderdate >= DATE '1998-07-02' THEN 'last30Days' ELSE 'older' END AS bucket FROM orders")
def p11(t):
    return t("orders").select("o_orderkey", C.recency_bucket(F.col("o_orderdate"), F.lit("1998-08-01")).alias("bucket"))


POLICIES, GUESSES, VERDICTS = ["always", "never", "auto-permissive", "auto-conservative"], ["always", "maybe", "never"], ["yes", "Y", "no", "N", "hm"]


@query("P12_approval_required", f"SELECT event_id, CASE WHEN p = 'always' THEN true WHEN p = 'never' THEN false WHEN b = 'never' THEN false WHEN b = 'always' THEN true WHEN p = 'auto-permissive' THEN g IS DISTINCT FROM 'never' ELSE lower(v) NOT IN ('no', 'n') END AS required FROM (SELECT event_id, {sql_list(POLICIES)}[CAST(event_id % 4 + 1 AS INTEGER)] AS p, CASE WHEN event_type = 'error' THEN 'always' WHEN event_type = 'view' THEN 'never' ELSE 'maybe' END AS b, {sql_list(GUESSES)}[CAST(event_id % 3 + 1 AS INTEGER)] AS g, {sql_list(VERDICTS)}[CAST(event_id % 5 + 1 AS INTEGER)] AS v FROM events)")
def p12(t):
    at, kind = F.col("event_id"), F.col("event_type")
    baseline = F.when(kind == "error", "always").when(kind == "view", "never").otherwise("maybe")
    return t("events").select("event_id", X.approval_required(pick(POLICIES, at), baseline, pick(GUESSES, at), pick(VERDICTS, at)).alias("required"))


REPLIES = ["Accept", "accepted ", "acept", "RUN", "execute plan", "Execute", "Looks good", "do it", "accept plan", "accpt", "run plan", "sounds good", "I don't know. Use your best judgment.", "i don't know, you figure it out, don't ask me again.", "yes", "Y", "no", "deny", '{"accepted": true}', '{"accepted": false, "content": "x"}', '{"x": 1}', "maybe"]


@query("P13_reply_accepted", f"SELECT conv_id, turn, NOT own AND i < 14 AS accepted, own OR i NOT IN (16, 17, 19) AS approved FROM (SELECT conv_id, turn, turn % 3 = 0 AS own, (conv_id * 7 + turn) % {len(REPLIES)} AS i FROM conversations)")
def p13(t):
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(pick(REPLIES, F.col("conv_id") * 7 + F.col("turn")))
    return t("conversations").select("conv_id", "turn", X.reply_accepted(said).alias("accepted"), X.action_approved(said, True).alias("approved"))


SAID = "CASE turn % 4 WHEN 0 THEN concat('Final Answer: FINAL ANSWER: ', text, ' FINAL ANSWER: ', role) WHEN 1 THEN concat('Final Answer: so FINAL ANSWER:', text) WHEN 2 THEN concat('Final Answer: ', text) ELSE concat('I think FINAL ANSWER: ', text) END"


@query("P14_final_answer", f"SELECT conv_id, turn, CASE WHEN starts_with(x, 'Final Answer:') AND contains(x, 'FINAL ANSWER:') THEN regexp_replace(string_split(x, 'FINAL ANSWER:')[2], '^\\s+|\\s+$', '', 'g') END AS answer FROM (SELECT conv_id, turn, {SAID} AS x FROM conversations)")
def p14(t):
    """Turns with the markers twice, once, half and not at the start."""
    return t("conversations").select("conv_id", "turn", X.final_answer(F.expr(SAID)).alias("answer"))


@query("P15_unable_flag", "SELECT doc_id, contains(text, 'The') AS reported, text = 'The' AS blanked, lower(trim(text)) = 'the' AS simulated FROM documents")
def p15(t):
    return t("documents").select("doc_id", *(c.alias(n) for c, n in zip(C.unable_flags(F.col("text"), "The"), ("reported", "blanked", "simulated"))))


KIND_OF = {"purchase": "final_answer", "signup": "plan_message", "error": "step_execution", "view": "sentinel_check"}


@query("P16_message_kind", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'final-answer' WHEN 'signup' THEN 'plan' WHEN 'error' THEN 'step-execution' WHEN 'view' THEN 'sentinel' ELSE 'default' END AS kind FROM events")
def p16(t):
    types = F.create_map(*(F.lit(x) for kv in KIND_OF.items() for x in kv))
    return t("events").select("event_id", C.message_kind(types[F.col("event_type")]).alias("kind"))


@query("P17_parse_user_content", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain text' END AS content, event_id % 4 = 0 AS accepted, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def p17(t):
    said = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("content"), (F.col("event_id") % 4 == 0).alias("accepted"), F.from_json("props", "k long").alias("plan")))).otherwise("plain text")
    c = C.parse_user_content(said)
    return t("events").select("event_id", c.alias("c")).select("event_id", "c.content", "c.accepted", F.get_json_object("c.plan", "$.k").cast("long").alias("k"))


@query("J7_truth_leak", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j7(t):
    return Q.holds(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("gold")), "doc_id", "text", "item_id", "gold")


@query("J13_relevant_plan", "WITH n AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (q.n * c.n) AS s FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s WHERE s >= 0.2) WHERE r = 1")
def j13(t):
    e = t("embeddings").select("vec_id", "embedding")
    return Q.relevant(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.2).withColumn("similarity", F.round("similarity", 5))


RULES = [("example.com", "allowed"), ("https://m.ththth.example.net", "allowed"), ("example.org/en", "rejected"), ("thther.example.org", "blocked")]


@query("J6_url_policy", "WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS p FROM pages) SELECT page_id, NOT (s IN ('http', 'https') AND (h = 'thther.example.org' OR (h = 'example.org' OR ends_with(h, '.example.org')) AND starts_with(p, '/en'))) AND s IN ('http', 'https') AND (h = 'example.com' OR ends_with(h, '.example.com') OR h = 'm.ththth.example.net') AS allowed FROM u")
def j6(t):
    spark = t("pages").sparkSession
    return U.url_policy(t("pages").select("page_id", "url"), spark.createDataFrame(RULES, "pattern string, status string")).select("page_id", "allowed")


@query("U3_policy_lists", "SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'rejected' ELSE 'other' END AS status, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS site FROM pages WHERE page_id % 3 < 2 UNION ALL SELECT 'blocked', NULL")
def u3(t):
    status = F.when(F.col("page_id") % 3 == 0, "allowed").when(F.col("page_id") % 3 == 1, "rejected").otherwise("other")
    return Q.policy_lists(t("pages").select(U.part(F.col("url"), "HOST").alias("site"), status.alias("status")))


@query("F1_score_exact", f"SELECT doc_id, CAST(regexp_replace(gold, '^\\s+|\\s+$', '', 'g') = regexp_replace(pred, '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS score FROM {J}")
def f1_(t):
    return pairs(t).select("doc_id", X.score_exact(F.col("gold"), F.col("pred")).alias("score"))


TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"


@query("F2_score_token_f1", f"SELECT doc_id, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS score FROM (SELECT doc_id, {TOK.format('gold')} AS a, {TOK.format('pred')} AS b FROM {J})")
def f2(t):
    return pairs(t).select("doc_id", F.round(X.score_token_f1(F.col("gold"), F.col("pred")), 6).alias("score"))


NORM = "regexp_replace(trim(regexp_replace(replace(lower(trim({0})), ',', ', '), '\\s+', ' ', 'g')), '[.!?]+$', '')"


@query("F3_score_normalised", f"SELECT doc_id, CAST({NORM.format('gold')} = {NORM.format('pred')} AND {NORM.format('gold')} <> '' AS DOUBLE) AS score FROM {J}")
def f3(t):
    return pairs(t).select("doc_id", X.score_normalised(F.col("gold"), F.col("pred")).alias("score"))


@query("F4_score_choice", "SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN NULL WHEN p_size % 7 < 3 AND chr(CAST(65 + p_size % 7 AS INTEGER)) = 'B' THEN 1.0 ELSE 0.0 END AS score FROM part")
def f4(t):
    reply = F.concat(F.lit("I think so. answer : "), pick([*"ABCabcD"], F.col("p_size")), F.lit(" Answer: B"))
    gold = F.when(F.col("p_size") % 5 == 4, "none of these").otherwise(F.concat(F.lit("t"), "p_type"))
    options = F.array(F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("t"), "p_type"), F.concat(F.lit("n"), "p_name"))
    return t("part").select("p_partkey", C.score_choice(reply, gold, options).alias("score"))


@query("F5_score_verdict", "SELECT conv_id, turn, CASE WHEN regexp_extract(text, '([ABC])', 1) = '' THEN 'C' ELSE regexp_extract(text, '([ABC])', 1) END AS verdict, CASE WHEN contains(upper(text), 'NOT THE') THEN 0.0 WHEN contains(upper(text), 'THE') THEN 1.0 ELSE 0.0 END AS success, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn AS DOUBLE) / 10 END AS judged, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn % 3 = 1 END AS judged_success FROM conversations")
def f5(t):
    up = F.replace(F.upper("text"), F.lit("THE"), F.lit("SUCCESS"))
    reply = F.when(F.col("turn") % 3 == 0, "no JSON").when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.col("turn").alias("score"), F.lit(True).alias("success")))).otherwise(F.to_json(F.struct(F.col("turn").alias("score"))))
    return t("conversations").select("conv_id", "turn", X.verdict(F.col("text")).alias("verdict"), X.success(up).alias("success"), X.judgement(reply).alias("j")).select("conv_id", "turn", "verdict", "success", F.col("j.score").alias("judged"), F.col("j.success").alias("judged_success"))


@query("F6_answer_type", "SELECT event_id, ['number', 'json', 'string', 'string list', 'number', 'json', 'string'][CAST(event_id % 7 + 1 AS INTEGER)] AS type FROM events")
def f6(t):
    k, at = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    answer = F.when(at == 0, k).when(at == 1, F.col("props")).when(at == 2, F.concat(F.lit("about "), k)).when(at == 3, F.concat_ws("\n", "event_type", k)).when(at == 4, F.concat(F.lit("$ "), k, F.lit(",5 sqft\n\n"))).when(at == 5, F.concat(F.lit("{'a': 'b'}\n"), F.col("props"))).otherwise(F.concat("props", F.lit(" x")))
    return t("events").select("event_id", A.answer_type(answer).alias("type"))


@query("F7_clean_number", "SELECT p_partkey, round(CAST(replace(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR), ',', '.') AS DOUBLE), 4) AS price FROM part")
def f7(t):
    return t("part").select("p_partkey", F.round(X.clean_number(F.concat(F.lit("$"), F.floor("p_retailprice").cast("long").cast("string"))), 4).alias("price"))


@query("F8_score_number", "SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - ln(greatest(g, p) / least(g, p))), 6) AS score FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN 1e-4 ELSE l_extendedprice END AS p, CASE WHEN p_retailprice = 0 THEN 1e-4 ELSE p_retailprice END AS g FROM lineitem JOIN part ON l_partkey = p_partkey)")
def f8(t):
    both = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_linenumber", F.round(X.score_number(F.col("p_retailprice"), F.col("l_extendedprice")), 6).alias("score"))


FLOAT = "(?i)^\\s*[+-]?((\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)(e[+-]?\\d+(_\\d+)*)?|inf|infinity|nan)\\s*$"


def span_sql(c: str) -> str:
    """Words of a span; the letters of an article stand alone where no letter, digit or underscore of any script touches them."""
    bare = f"list_transform(regexp_split_to_array(lower({c}), '[ -]'), lambda x: CASE WHEN regexp_matches(x, '{FLOAT}') THEN x ELSE regexp_replace(x, '[!-/:-@\\[-`{{-~]', '', 'g') END)"
    told = f"list_transform({bare}, lambda x: CASE WHEN regexp_matches(x, '{FLOAT}') THEN CAST(TRY_CAST(replace(trim(x), '_', '') AS DOUBLE) AS VARCHAR) ELSE regexp_replace(regexp_replace(x, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g'), '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g') END)"
    return f"list_filter(regexp_split_to_array(array_to_string({told}, ' '), '\\s+'), lambda x: x <> '')"


def f1_sql(a: str, b: str) -> str:
    number = lambda w: f"list_filter({w}, lambda x: regexp_matches(x, '{FLOAT}'))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({number(a)}) > 0 AND len(list_intersect({number(a)}, {number(b)})) = 0 THEN 0.0 WHEN len(list_intersect({a}, {b})) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0 END"


@query("F9_normalise_spans", f"SELECT conv_id, turn, array_to_string({span_sql('text')}, ' ') AS words FROM conversations")
def f9(t):
    return t("conversations").select("conv_id", "turn", X.normalised_span(F.col("text")).alias("words"))


@query("F10_pair_f1", f"WITH s AS (SELECT conv_id, turn, list_distinct({span_sql('text')}) AS w FROM conversations) SELECT a.conv_id, a.turn, round({f1_sql('a.w', 'b.w')}, 6) AS score FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def f10(t):
    s = t("conversations").select("conv_id", "turn", X.span_words(F.col("text")).alias("w"))
    nxt = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("p"))
    return s.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.pair_f1(F.col("w"), F.col("p")), 6).alias("score"))


def spans_sql(c: str) -> str:
    return f"list_transform({c}, lambda y: array_to_string({span_sql('y')}, ' '))"


@query("A17_exact_set_match", f"SELECT conv_id, turn, list_sort(list_distinct({spans_sql('g')})) = list_sort(list_distinct({spans_sql('p')})) AND len(g) = len(p) AS matches FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS g, CASE turn % 3 WHEN 0 THEN list_reverse(list_transform(string_split(text, chr(10)), lambda x: concat('The ', x, '!'))) WHEN 1 THEN list_append(string_split(text, chr(10)), string_split(text, chr(10))[1]) ELSE list_append(string_split(text, chr(10))[2:], 'other') END AS p FROM conversations)")
def a17(t):
    g = F.split("text", "\n")
    p = F.when(F.col("turn") % 3 == 0, F.reverse(F.transform(g, lambda x: F.concat(F.lit("The "), x, F.lit("!"))))).when(F.col("turn") % 3 == 1, F.array_append(g, F.get(g, F.lit(0)))).otherwise(F.array_append(F.slice(g, 2, 1000000), F.lit("other")))
    return t("conversations").select("conv_id", "turn", X.exact_set_match(g, p).alias("matches"))


@query("F14_url_equal", "SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') = regexp_replace(split_part(url, '#', 1), '/+$', '') AS same FROM pages")
def f14(t):
    u = F.col("url")
    return t("pages").select("page_id", U.normalise_url(u).eqNullSafe(U.normalise_url(F.substring_index(F.substring_index(u, "#", 1), "?", 1))).alias("same"))


def clean_sql(c: str) -> str:
    for m in X.MARKERS:
        c = f"replace({c}, '{m}', '')"
    return c


@query("F17_clean_response", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def f17(t):
    return t("documents").select("doc_id", X.clean_response(F.col("text")).alias("text"))


@query("L1_recent_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def l1(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("L2_plan_search", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') AND contains(lower(text), 'and')) OR len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the') AND contains(lower(x), 'and'))) > 0 ORDER BY doc_id DESC LIMIT 5")
def l2(t):
    return Q.plan_search(t("documents").where("text is not null"), "The and", F.col("text"), F.split("text", "\n"), [F.desc("doc_id")]).select("doc_id")


@query("L3_plan_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('Re'))")
def l3(t):
    return t("part").where(F.lower("p_name").contains("re")).select("p_partkey", "p_name")


@query("L4_fuzzy_find", "WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT DISTINCT p_name AS q FROM part WHERE p_partkey % 20 = 0), s AS (SELECT q, p_name, CASE WHEN lower(q) = lower(p_name) THEN 1.0 ELSE 1.0 - levenshtein(q, p_name) / greatest(length(q), length(p_name)) END AS s FROM q, n) SELECT q, p_name, round(s, 6) AS similarity, s = 1.0 AS exact FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p_name) AS r FROM s WHERE s > 0.2) WHERE r <= 20")
def l4(t):
    return Q.fuzzy_find(t("part"), t("part").where("p_partkey % 20 = 0"), "p_name").withColumn("similarity", F.round("similarity", 6))


#: A page with links of other kinds before its own: upper case, single quotes, markup in the label; relative, other schemes, no href.
BEFORE = ["<A class=x HREF='http://a.org/", """'>one <b>two</b> \n three</A><a href=/rel>no</a><a href="ftp://f.org">f</a><a name=n>no</a>"""]
HREF = """regexp_extract(x[1], '(?i)\\shref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', {})"""
LINK = """(?is)<a(\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)>(.*?)</a\\s*>"""


def links(t) -> DataFrame:
    page = F.concat(F.lit(BEFORE[0]), "page_id", F.lit(BEFORE[1]), "html")
    return t("pages").select("page_id", F.posexplode(G.html_links(page)).alias("pos", "l")).select("page_id", "pos", "l.url", "l.label")


LINKS = f"""(SELECT page_id, unnest(range(len(l))) AS pos, unnest(list_transform(l, lambda y: y.url)) AS url, unnest(list_transform(l, lambda y: y.label)) AS label FROM (
  SELECT page_id, list_filter(list_transform(list_zip(regexp_extract_all(h, '{LINK}', 1), regexp_extract_all(h, '{LINK}', 2)), lambda x: struct_pack(url := concat({HREF.format(1)}, {HREF.format(2)}, {HREF.format(3)}), label := trim(regexp_replace(regexp_replace(x[2], '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))), lambda x: regexp_matches(x.url, '^(?i)https?://[^/?#\\s]')) AS l
  FROM (SELECT page_id, concat({sql_list(BEFORE)}[1], page_id, {sql_list(BEFORE)}[2], html) AS h FROM pages)))"""


@query("L5_top_links", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM {LINKS} WHERE pos < 3")
def l5(t):
    return links(t).where("pos < 3").select("page_id", "pos", "url")


@query("L6_failed_tasks", "SELECT doc_id, source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def l6(t):
    return t("documents").join(t("labels").where("quality = 0"), "doc_id").select("doc_id", "source", "lang")


@query("T1_first_json", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE concat('{\"a\": [', props, ']}') END AS j FROM events")
def t1(t):
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("ok "), "props", F.lit(" end"))).when(F.col("event_id") % 4 == 1, F.concat("props", F.lit(" and "), "props")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{"), "props")).otherwise(F.concat(F.lit('{"a": ['), "props", F.lit("]}, bye")))
    return t("events").select("event_id", X.first_json(said).alias("j"))


@query("T2_flatten_json", "WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, 'type' AS path, event_type AS value FROM e UNION ALL SELECT event_id, 'deep.p.k', k FROM e UNION ALL SELECT event_id, 'deep.l[0]', event_type FROM e UNION ALL SELECT event_id, 'deep.l[1]', 'x' FROM e")
def t2(t):
    k = F.from_json("props", "k long")
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(k.alias("p"), F.array(F.col("event_type"), F.lit("x")).alias("l")).alias("deep")))
    return t("events").select("event_id", F.inline(X.flatten_json(doc)))


@query("T5_normalise_url", "SELECT page_id, concat(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', ''), CASE WHEN contains(url, '?') THEN concat('?', array_to_string(list_sort(string_split(split_part(split_part(url, '#', 1), '?', 2), '&')), '&')) ELSE '' END) AS url FROM pages")
def t5(t):
    return t("pages").select("page_id", U.normalise_url(F.col("url")).alias("url"))


@query("T6_host_parts", "WITH h AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.') AS h FROM pages) SELECT page_id, h[len(h)] AS suffix, h[len(h) - 1] AS domain, array_to_string(h[1:len(h) - 2], '.') AS subdomain FROM h")
def t6(t):
    return U.host_parts(t("pages").select("page_id", "url"), "url").select("page_id", "suffix", "domain", "subdomain")


RECORDS = {
    "plan": [
        ('{"task": "t", "steps": [{"title": "a", "details": "b", "agent_name": "c"}], "needs_plan": true, "response": "", "plan_summary": ""}', "valid"),
        ('{"task": "t", "steps": [{"title": "a"}], "needs_plan": true, "response": "", "plan_summary": ""}', "bad step"), ('{"task": "t", "steps": []}', "missing keys"), ("[1]", "not an object"), ('{"task"} x', "not json"),
    ],
    "ledger": [
        ('{"is_current_step_complete": {"reason": "", "answer": true}, "need_to_replan": {"reason": "", "answer": false}, "instruction_or_question": {"answer": "", "agent_name": "web"}, "progress_summary": "s"}', "valid"),
        ('{"is_current_step_complete": {"reason": "", "answer": true}, "need_to_replan": {"reason": "", "answer": false}, "instruction_or_question": {"answer": "", "agent_name": "cook"}, "progress_summary": "s"}', "unknown agent"),
        ('{"is_current_step_complete": true, "need_to_replan": {"reason": "", "answer": false}, "instruction_or_question": {"answer": "", "agent_name": "web"}, "progress_summary": "s"}', "bad answer"),
        ('{"is_current_step_complete": {"reason": "", "answer": true}, "need_to_replan": {"reason": "", "answer": false}, "instruction_or_question": {"answer": "", "agent_name": "web"}, "progress_summary": 5}', "bad summary"), ("{}", "missing keys"),
    ],
    "check": [('{"condition_met": true, "reason": "r", "sleep_duration": 5, "sleep_duration_reason": "", "error_encountered": false}', "valid"), ('{"condition_met": true, "reason": "r"}', "missing keys"), ('"text"', "not an object"), ("none", "not json"), ("{}", "missing keys")],
}


def reasons_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {sql_list([r for _, r in rows])}[CAST(event_id % {len(rows)} + 1 AS INTEGER)] AS reason FROM events" for kind, rows in RECORDS.items())


@query("T7_validate_records", f"SELECT kind, reason, count(*) AS n FROM ({reasons_sql()}) GROUP BY 1, 2")
def t7(t):
    fault = lambda kind, rows: F.coalesce(C.record_fault(F.col(kind), kind, ["web", "coder"]), F.lit("valid"))
    told = t("events").select(*(pick([r for r, _ in rows], F.col("event_id")).alias(kind) for kind, rows in RECORDS.items()))
    reasons = F.array(*(F.struct(F.lit(kind).alias("kind"), fault(kind, rows).alias("reason")) for kind, rows in RECORDS.items()))
    return told.select(F.inline(reasons)).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("T9_page_text", "SELECT page_id, array_to_string(list_filter(list_transform((string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10)))[1:50], lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages")
def t9(t):
    return t("pages").select("page_id", X.page_lines(F.col("html")).alias("text"))


@query("T9_page_words", f"SELECT page_id, regexp_extract(text, '^(?:\\S+\\s+){{0,29}}\\S*') AS text FROM ({SQL['T9_page_text']})")
def t9_words(t):
    """At most 30 words of the page's lines."""
    return t("pages").select("page_id", X.page_lines(F.col("html"), words=30).alias("text"))


FORM = '<form><input><input type="checkbox" disabled><select name=s><option>a<option disabled>b</select><textarea></textarea><div role="slider"></div><p tabindex="-1">x</p><b tabindex=0 onclick="f()">y</b><!-- <button>z</button> --></form>'


@query("T10_page_elements", "WITH e AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script\\s*>|<style.*?</style\\s*>', ' ', 'g') AS h FROM pages), r AS (SELECT page_id, 'link' AS role, len(regexp_extract_all(h, '<a\\s[^>]*href=')) AS n FROM e UNION ALL SELECT page_id, 'button', len(regexp_extract_all(h, '<button[ >]')) FROM e UNION ALL SELECT page_id, unnest(['textbox', 'combobox', 'option', 'slider', '']), unnest([2, 1, 2, 1, 1]) FROM e) SELECT page_id, role, CAST(sum(n) AS BIGINT) AS n FROM r WHERE n > 0 GROUP BY 1, 2")
def t10(t):
    roles = t("pages").select("page_id", F.explode(G.page_elements(F.concat("html", F.lit(FORM)))).alias("role"))
    return roles.groupBy("page_id", "role").agg(F.count("*").alias("n"))


@query("T11_page_links", f"SELECT page_id, label, url FROM {LINKS}")
def t11(t):
    return links(t).select("page_id", "label", "url")


@query("T11_markdown_links", "SELECT page_id, concat('page ', page_id) AS label, url FROM pages WHERE regexp_matches(url, '^https?://[^/]') AND NOT regexp_matches(url, '[()\\[\\]]')")
def t11_markdown(t):
    text = F.concat(F.lit("see [page "), "page_id", F.lit("]("), "url", F.lit(") now\n[A](http://a.com) and [B](http://b.com)\n[C](ftp://c.com)\n[D](/d)"))
    return t("pages").select("page_id", F.inline(G.markdown_links(text))).select("page_id", "label", "url")


@query("T12_page_title", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def t12(t):
    return t("pages").select("page_id", G.title(F.col("html")).alias("title"))


HEAD = """<META name="a" content="one"><meta property='og:x' content='two > 1'><meta name="a" content="three"><meta name=bare><meta charset="utf-8"><script type="application/ld+json"> {"k": 1} </script>"""
ITEM = """<div itemscope itemtype="T"><span itemprop="name also">Page <b>%s</b>!</span><a itemprop=url href="/u/%s">u</a><meta itemprop="n" content="5"><div itemprop=by itemscope itemtype="P"><i itemprop=name>By %s</i></div><em itemprop=after>end <p>of %s</em></div><b itemprop=lost>x</b>"""


@query("T12_page_metadata", "SELECT page_id, 'meta' AS kind, unnest(['a', 'og:x', 'page']) AS key, unnest(['three', 'two > 1', CAST(page_id AS VARCHAR)]) AS value FROM pages UNION ALL SELECT page_id, 'json-ld', '', '{\"k\": 1}' FROM pages UNION ALL SELECT page_id, unnest(['T', 'T', 'T', 'T', 'P', 'T']), unnest(['name', 'also', 'url', 'n', 'name', 'after']), unnest([concat('Page ', page_id, '!'), concat('Page ', page_id, '!'), concat('/u/', page_id), '5', concat('By ', page_id), concat('end of ', page_id)]) FROM pages")
def t12_metadata(t):
    """The pages hold no metadata of their own: each gets a head and an item with some, of its own number."""
    item = F.format_string(ITEM, *[F.col("page_id").cast("string")] * 4)
    html = F.concat(F.lit(HEAD), item, F.lit('<meta content="'), "page_id", F.lit('" name="page">'), "html")
    p = t("pages").select("page_id", G.meta_map(html).alias("m"), G.json_ld(html).alias("j"), G.item_properties(html).alias("i"))
    triple = lambda kind, key, value: F.struct(kind.alias("kind"), key.alias("key"), value.alias("value"))
    rows = F.concat(
        F.transform(F.map_entries("m"), lambda e: triple(F.lit("meta"), e["key"], e["value"])), F.transform("j", lambda x: triple(F.lit("json-ld"), F.lit(""), x)), F.transform("i", lambda x: triple(x["type"], x["name"], x["value"]))
    )
    return p.select("page_id", F.inline(rows))


@query("T13_pdf_urls", "SELECT page_id, ends_with(lower(url), '.pdf') AS pdf FROM pages")
def t13(t):
    return t("pages").select("page_id", F.lower("url").endswith(".pdf").alias("pdf"))


@query("T14_combine_pages", "SELECT source, concat('Search Results for ', source, chr(10), chr(10), string_agg(concat('Page: ', doc_id, chr(10), array_to_string((string_split(text, ' '))[1:20], ' '), chr(10), chr(10)), '' ORDER BY doc_id)) AS combined FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3 AND text IS NOT NULL GROUP BY source")
def t14(t):
    return Q.combine_pages(t("documents"), "source", "doc_id", "text")


CHUNK = r"(?s)(?:.{499}[^ \t\r\n]*[ \t\r\n]|.+)"


@query("T15_viewport_chunks", f"SELECT doc_id, CAST(unnest(range(greatest(len(regexp_extract_all(text, '{CHUNK}')), 1))) AS INTEGER) AS pos, unnest(CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '{CHUNK}') END) AS chunk FROM documents")
def t15(t):
    return t("documents").select("doc_id", F.posexplode(X.viewport_chunks(F.col("text"), 500)).alias("pos", "chunk"))


@query("T16_find_in_chunks", f"WITH c AS (SELECT doc_id, unnest(range(greatest(len(regexp_extract_all(text, '{CHUNK}')), 1))) AS pos, unnest(CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '{CHUNK}') END) AS chunk FROM documents), n AS (SELECT doc_id, max(pos) + 1 AS n FROM c GROUP BY doc_id) SELECT doc_id, CAST(arg_min(pos, (pos - 1 + n) % n) AS INTEGER) AS found FROM c JOIN n USING (doc_id) WHERE regexp_matches(concat(' ', lower(regexp_replace(chunk, '[^\\pL\\pN_]+', ' ', 'g')), ' '), ' th.* of ') GROUP BY doc_id")
def t16(t):
    c = t("documents").select("doc_id", X.viewport_chunks(F.col("text"), 500).alias("chunks"))
    return c.select("doc_id", X.find_in_chunks(F.col("chunks"), "TH* of!", F.lit(1)).alias("found")).where("found is not null")


@query("X1_register_scorer", f"SELECT doc_id, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS token_f1, CAST(gold = pred AS DOUBLE) AS same FROM (SELECT doc_id, gold, pred, {TOK.format('gold')} AS a, {TOK.format('pred')} AS b FROM {J})")
def x1(t):
    S.register_scorer("same", lambda g, p: (g == p).cast("double"))
    return S.score_by(pairs(t), F.col("gold"), F.col("pred"), "token_f1", "same").select("doc_id", F.round("token_f1", 6).alias("token_f1"), "same")


@query("X2_register_metric", "SELECT doc_id % 4 AS run, round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS spread FROM labels GROUP BY 1")
def x2(t):
    S.register_metric("spread", lambda s: {"mean": F.round(F.avg(s), 6), "spread": F.round(F.stddev_pop(s), 6)})
    return S.summarise(t("labels"), "quality", "spread", by=((F.col("doc_id") % 4).alias("run"),))
