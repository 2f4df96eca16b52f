"""Plans, code blocks and attached files inside message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<title:string,details:string,agent_name:string,enabled:boolean,sleep_duration:int,condition:string>"


def code_blocks(c: Column) -> Column:
    """Array of (language, code): fenced blocks in text order; a fence without a language has an empty one. Null gives null."""
    fence = r"(?s)```[ \t]*(\w+)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```"
    codes = F.transform(F.regexp_extract_all(c, F.lit(fence), F.lit(2)), lambda x: F.concat(x, F.lit("\n")))
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(fence), F.lit(1)).alias("language"), codes.alias("code"))


def parse_plan(c: Column) -> Column:
    """struct(task, steps) of a plan's JSON text: a list of steps, or an object with steps.

    Missing titles, details and agents get defaults; steps switched off go. A step
    is a monitor when it has both a sleep and a condition. No step, or text that
    doesn't parse, gives null.
    """
    whole = F.from_json(c, f"struct<task:string,steps:array<{STEP}>>")
    steps = F.when(c.rlike(r"^\s*\["), F.from_json(c, f"array<{STEP}>")).otherwise(whole["steps"])
    on = F.filter(steps, lambda s: F.coalesce(s["enabled"], F.lit(True)))
    full = F.transform(
        on,
        lambda s: F.struct(
            F.coalesce(s["title"], F.lit("Untitled Step")).alias("title"), F.coalesce(s["details"], F.lit("No details provided.")).alias("details"), F.coalesce(s["agent_name"], F.lit("agent")).alias("agent_name"),
            s["sleep_duration"].alias("sleep_duration"), s["condition"].alias("condition"), (s["sleep_duration"].isNotNull() & s["condition"].isNotNull()).alias("monitor"),
        ),
    )
    return F.when(F.size(full) > 0, F.struct(F.when(c.rlike(r"^\s*\{"), whole["task"]).alias("task"), full.alias("steps")))


def plan_text(plan: Column) -> Column:
    """A plan as numbered lines: title, then details and agent."""
    lines = F.transform(plan["steps"], lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["title"], F.lit("\n   "), s["details"], F.lit("\n   ["), s["agent_name"], F.lit("]")))
    return F.array_join(lines, "\n")


def attached_files(c: Column) -> Column:
    """Names in a JSON list of uploaded files, nulls and empty names left out; null if it doesn't parse."""
    files = F.from_json(c, "array<struct<name:string,type:string>>")
    return F.filter(F.transform(files, lambda f: f["name"]), lambda n: n.isNotNull() & (n != ""))
