"""Column functions over messages, files, questions and the JSON records that agents write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strict_variant

#: Sources and types of messages that a plan is learned from.
LEARNABLE_SOURCES = ["user", "user_proxy", "web_surfer", "file_surfer", "orchestrator", "Orchestrator", "coder_agent-llm", "coder_agent-executor"]
LEARNABLE_TYPES = ["TextMessage", "MultiModalMessage"]
#: File types by extension, with case.
FILE_TYPES = {
    "code": [".py", ".python", ".js", ".jsx", ".java", ".c", ".cpp", ".cs", ".ts", ".tsx", ".html", ".css", ".scss", ".less", ".json", ".xml", ".yaml", ".yml", ".md", ".rst", ".tex", ".sh", ".bat", ".ps1", ".php", ".rb", ".go", ".swift", ".kt", ".hs", ".scala", ".lua", ".pl", ".sql", ".config"],
    "csv": [".csv", ".xlsx"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg", ".webp"],
    "pdf": [".pdf"],
    "video": [".mp4", ".webm", ".ogg", ".mov", ".avi", ".wmv"],
}
#: Keys that records must have.
PLAN_KEYS, STEP_KEYS, MONITOR_STEP_KEYS = ["task", "steps", "needs_plan", "response", "plan_summary"], ["title", "details", "agent_name"], ["sleep_duration", "condition"]
LEDGER_KEYS = ["is_current_step_complete", "need_to_replan", "instruction_or_question", "progress_summary"]
CHECK_KEYS = ["condition_met", "reason", "sleep_duration", "sleep_duration_reason", "error_encountered"]


def learnable(source: Column, kind: Column) -> Column:
    return F.coalesce(source.isin(LEARNABLE_SOURCES) & kind.isin(LEARNABLE_TYPES), F.lit(False))


def visible(metadata: Column) -> Column:
    """Whether a message with this metadata map is shown: not where ``internal`` is yes."""
    return ~metadata["internal"].eqNullSafe(F.lit("yes"))


def extension(path: Column) -> Column:
    """From the last point of a path's last part on; empty if there is none but at its start."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^\.*[^.].*(\.[^.]*)$|^\.*[^.](\.[^.]*)$", 1)


def file_type(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kind, names in FILE_TYPES.items() for name in names for x in (name, kind)))
    return F.coalesce(kinds[extension(path)], F.lit("unknown"))


def format_question(question: Column, options: Column | None = None, file: Column | None = None, prefix: str = "") -> Column:
    """Prefix, ``Question: …``, a lettered line for each option and a note of the attached file, where there are any."""
    lines = [F.concat(F.lit(f"{prefix}Question: "), question)]
    if options is not None:
        lines.append(F.array_join(F.transform(options, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(": "), x)), "\n"))
    if file is not None:
        lines.append(F.when(file != "", F.concat(F.lit("Attached file: "), file)))
    return F.concat_ws("\n", *lines)


def recency_bucket(day: Column, now: Column) -> Column:
    """today, yesterday, last7Days, last30Days or older, by day starts before ``now``."""
    back = lambda n: F.to_date(day) >= F.date_sub(F.to_date(now), n)
    return F.when(back(0), "today").when(back(1), "yesterday").when(back(7), "last7Days").when(back(30), "last30Days").otherwise("older")


def message_kind(type_: Column) -> Column:
    """final-answer, plan, step-execution, sentinel or default, by a message's metadata type."""
    return F.when(type_ == "final_answer", "final-answer").when(type_ == "plan_message", "plan").when(type_ == "step_execution", "step-execution").when(type_.startswith("sentinel_"), "sentinel").otherwise("default")


def parse_user_content(c: Column) -> Column:
    """struct(content, accepted, plan): of a JSON object, else the plain text as content."""
    v = F.when(c.rlike(r"^\s*\{"), strict_variant(c))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return F.struct(F.coalesce(get("$.content", "string"), c).alias("content"), F.coalesce(get("$.accepted", "boolean"), F.lit(False)).alias("accepted"), F.to_json(get("$.plan", "variant")).alias("plan"))


def unable_flags(answer: Column, words: str = "Unable to determine") -> list[Column]:
    """Three tests: the answer has the words; equals them; equals them in lower case without white space around."""
    return [answer.contains(words), answer == words, F.lower(F.trim(answer)) == words.lower()]


def score_choice(reply: Column, gold: Column, options: Column) -> Column:
    """1 if the first letter that the reply gives as its answer is that of the gold option (with case), else 0; null if gold is no option."""
    place = F.array_position(options, gold)
    said = F.regexp_extract(reply, r"(?i)answer[ \t]*:[ \t\n]*([A-D])", 1)
    return F.when(place > 0, (said == F.char(F.lit(64) + place)).cast("double"))


def keys_of(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<string>"))


def lacks(v: Column, keys: list[str], path: str = "$") -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), keys_of(v, path))) > 0


def record_fault(c: Column, kind: str, agents: list[str] | None = None, monitors: bool = False) -> Column:
    """Why a JSON text is no valid record of a kind (plan, ledger or check): not json, not an object, missing keys, bad step, bad answer, unknown agent, bad summary; null if it is valid.

    Steps need title, details and agent; with ``monitors`` one typed as a monitor
    needs a sleep and a condition too, and one of another type nothing.
    """
    return let(F.struct(strict_variant(c).alias("v")), lambda x: fault(x["v"], kind, agents, monitors))


def fault(v: Column, kind: str, agents: list[str] | None, monitors: bool) -> Column:
    head = F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    if kind == "check":
        return head.when(lacks(v, CHECK_KEYS), "missing keys")
    if kind == "plan":
        steps = F.try_variant_get(v, "$.steps", "array<variant>")
        typed = F.array_contains
        none = lambda s, keys: lacks(s, keys)
        if monitors:
            bad = lambda s: F.when(~typed(keys_of(s), "step_type"), none(s, STEP_KEYS)).when(F.try_variant_get(s, "$.step_type", "string") == "SentinelPlanStep", none(s, STEP_KEYS + MONITOR_STEP_KEYS)).otherwise(False)
        else:
            bad = lambda s: none(s, STEP_KEYS)
        broken = steps.isNull() | F.exists(steps, lambda s: ~F.schema_of_variant(s).startswith("OBJECT") | F.coalesce(bad(s), F.lit(False)))
        return head.when(lacks(v, PLAN_KEYS), "missing keys").when(broken, "bad step")
    out = head.when(lacks(v, LEDGER_KEYS), "missing keys")
    for name in LEDGER_KEYS[:2]:
        out = out.when(lacks(v, ["reason", "answer"], f"$.{name}"), "bad answer")
    out = out.when(lacks(v, ["answer", "agent_name"], "$.instruction_or_question"), "bad answer")
    out = out.when(~F.coalesce(F.try_variant_get(v, "$.instruction_or_question.agent_name", "string").isin(agents or []), F.lit(False)), "unknown agent")
    return out.when(F.schema_of_variant(F.try_variant_get(v, "$.progress_summary", "variant")) != "STRING", "bad summary")
