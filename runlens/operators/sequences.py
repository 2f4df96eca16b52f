"""Window functions over message sequences.

A run of more than RUN_ROWS rows is cut by its order into parts, each a window
of its own; what earlier or later parts of the run add is summed up by part and
joined. Results are the same however runs are cut. Rows of a run are told apart
by their order columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import joined_summary, path_summary, without_repeats
from .search import sized, written

#: Rows of a run in one window, and the column that numbers the parts of longer runs (0 in others).
RUN_ROWS, PART = 5_000_000, "_part"
#: Steps of a path in one array, and summaries that are joined at once.
STEPS, SUMMARIES = 4096, 64


def cut(df: DataFrame, run: str, order: list[str]) -> tuple[DataFrame, bool]:
    """``df`` with PART, and whether any run is cut: rows of long runs are put in ranges of the run and its order, and written, so that parts stay as they are."""
    long = df.groupBy(F.col(run).alias("_run")).count().where(F.col("count") > RUN_ROWS)
    runs, rows = long.agg(F.count("*"), F.sum("count")).first()  # one row
    if not runs:
        return df.withColumn(PART, F.lit(0)), False
    side, same = sized(written(long.select("_run"), "long"), runs), F.col(run).eqNullSafe(F.col("_run"))
    ranges = df.join(side, same, "left_semi").repartitionByRange(-(-rows // RUN_ROWS) + 1, run, *order)
    parts = written(ranges.withColumn(PART, F.spark_partition_id() + 1), "parts")
    return df.join(side, same, "left_anti").withColumn(PART, F.lit(0)).unionByName(parts), True


def carry(df: DataFrame, some: bool, keys: list[str], later: bool = False, **of: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``df`` with a column for each aggregate: its value over each part, put together over all earlier (or later) parts of the keys; null where there is none."""
    if not some:
        return df.withColumns({name: F.lit(None) for name in of})
    w = Window.partitionBy(*keys).orderBy(PART)
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    each = df.where(F.col(PART) > 0).groupBy(*keys, PART).agg(*(value.alias(name) for name, (value, _) in of.items()))
    each = written(each.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, PART])), *(join(name).over(w).alias(name) for name, (_, join) in of.items())), "carry")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, PART])]
    return df.join(sized(each, each.count()), same, "left").drop(*(f"_k{i}" for i in range(len(same))))


def plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def lagged(df: DataFrame, some: bool, run: str, order: list[str], **of: Column) -> DataFrame:
    """``df`` with the value of each column in the run's row before, null in the first."""
    last = lambda c: (F.max_by(F.struct(c.alias("v")), F.struct(*order)), lambda n: F.last(n, ignorenulls=True))
    out = carry(df, some, [run], **{f"{name}_was": last(c) for name, c in of.items()})
    before = {name: F.lag(F.struct(c.alias("v"))).over(Window.partitionBy(run, PART).orderBy(*order)) for name, c in of.items()}
    return out.withColumns({name: F.coalesce(b, F.col(f"{name}_was"))["v"] if some else b["v"] for name, b in before.items()}).drop(*(f"{name}_was" for name in of))


def numbered_rows(df: DataFrame, some: bool, run: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the row's number in its run."""
    out = carry(df, some, [run], _before=(F.count("*"), F.sum))
    at = F.row_number().over(Window.partitionBy(run, PART).orderBy(*order)).cast("long")
    return out.withColumn(name, plus(at, F.col("_before").cast("long"))).drop("_before")


def message_seq(df: DataFrame, run: str, *order: str) -> DataFrame:
    return numbered_rows(*cut(df, run, [*order]), run, [*order], "seq").drop(PART)


def repeated_steps(df: DataFrame, run: str, order: list[str], step: Column, separator: Column) -> DataFrame:
    """Adds ``repeated``: the same step came before, with no separator since its latest time."""
    rows, some = cut(df, run, order)
    rows = carry(rows.withColumn("_sep", separator.cast("long")).withColumn("_step", step), some, [run], _earlier=(F.sum("_sep"), F.sum))
    within = F.sum("_sep").over(Window.partitionBy(run, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seps = carry(rows.withColumn("_seps", plus(within, F.col("_earlier").cast("long"))), some, [run, "_step"], _met=(F.max("_seps"), F.max))
    before = F.lag("_seps").over(Window.partitionBy(run, "_step", PART).orderBy(*order))
    same = F.coalesce(F.coalesce(before, F.col("_met").cast("long")) == F.col("_seps"), F.lit(False))
    return seps.withColumn("repeated", same & F.col("_step").isNotNull() & ~separator).drop("_sep", "_seps", "_step", "_earlier", "_met", PART)


def failed_steps(df: DataFrame, run: str, order: list[str], signal: Column, bad: str) -> DataFrame:
    """Adds ``failed``: the next non-null signal after the row is ``bad``."""
    rows, some = cut(df.withColumn("_signal", signal), run, order)
    rows = carry(rows, some, [run], later=True, _later=(F.min_by("_signal", F.when(F.col("_signal").isNotNull(), F.struct(*order))), lambda n: F.first(n, ignorenulls=True)))
    nxt = F.first("_signal", ignorenulls=True).over(Window.partitionBy(run, PART).orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("failed", F.coalesce(F.coalesce(nxt, F.col("_later")) == bad, F.lit(False))).drop("_signal", "_later", PART)


def run_progress(df: DataFrame, run: str, seq: str, final: Column, step: Column, length: Column, plan: Column, live: Column) -> DataFrame:
    """Per run: step, plan_length, has_final, planning, steps_after, of the rows after the last final row.

    The latest step (-1 if none) and the latest plan length (0 if none); both -1
    in a run that isn't live by its last row. has_final: a final row came, and no
    plan after it. planning: no step yet, and a plan after the final row or,
    without one, among the run's last three rows.
    """
    w = Window.partitionBy(run)
    after = df.withColumn("_final", F.coalesce(F.max(F.when(final, F.col(seq))).over(w), F.lit(-1))).withColumn("_most", F.max(seq).over(w))
    on = F.col(seq) > F.col("_final")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(seq)))
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    out = after.groupBy(run).agg(
        last(F.when(on, step)).alias("_step"), last(F.when(on, length)).alias("_length"), (F.max("_final") >= 0).alias("_ended"), some(on & plan).alias("_after"),
        some((F.col(seq) > F.col("_most") - 3) & plan).alias("_late"), F.max_by(live, seq).alias("_live"), F.count(F.when(on, step)).alias("steps_after"),
    )
    planning = F.col("_live") & F.col("_step").isNull() & F.when(F.col("_ended"), F.col("_after")).otherwise(F.col("_late"))
    return out.select(run, F.when(F.col("_live"), F.coalesce("_step", F.lit(-1))).otherwise(-1).alias("step"), F.when(F.col("_live"), F.coalesce("_length", F.lit(0))).otherwise(-1).alias("plan_length"), (F.col("_ended") & ~F.col("_after")).alias("has_final"), planning.alias("planning"), "steps_after")


def monitor_state(df: DataFrame, run: str, order: list[str], state: Column, active: Column | None = None) -> DataFrame:
    """The latest state of each run and whether its monitor sleeps: that state is ``sleeping`` and the run is active by its last row. Rows of other kinds have a null state."""
    last = F.max_by(state, F.when(state.isNotNull(), F.struct(*order)))
    live = F.lit(True) if active is None else F.coalesce(F.max_by(active, F.struct(*order)), F.lit(False))
    return df.groupBy(run).agg(last.alias("state"), (live & F.coalesce(last == "sleeping", F.lit(False))).alias("sleeping"))


def monitor_totals(df: DataFrame, run: str, order: str, state: Column, checks: Column, runtime: Column) -> DataFrame:
    """Per monitor, by its latest row with a state: that state, the number of checks and the seconds it has run, 0 where the row doesn't tell."""
    known = F.when(state.isNotNull(), F.col(order))
    last = lambda c: F.max_by(c, known)
    return df.groupBy(run).agg(last(state).alias("state"), F.coalesce(last(checks), F.lit(0)).cast("long").alias("total_checks"), F.coalesce(last(runtime), F.lit(0)).cast("long").alias("runtime")).where("state is not null")


def sentinel_rollup(df: DataFrame, keys: list[str], order: str, reason: Column, wait: Column, message: Column, kind: Column) -> DataFrame:
    """Per check of a monitor: latest reason, latest wait until the next check, number of messages, kinds in order."""
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), kind.alias("kind")))), lambda x: x["kind"])
    return df.groupBy(*keys).agg(last(reason).alias("reason"), last(wait).alias("next_check_in"), F.count_if(message).alias("messages"), kinds.alias("kinds"))


def part_index(df: DataFrame, run: str, seq: str, parts: str) -> DataFrame:
    """A row for each part of a message; ``current`` is the run's last part."""
    last = F.max(seq).over(Window.partitionBy(run))
    return df.select(run, seq, F.size(parts).alias("_n"), F.posexplode(parts).alias("part", "value")).withColumn("current", (F.col("part") == F.col("_n") - 1) & (F.col(seq) == last)).drop("_n")


def changed(df: DataFrame, run: str, order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the one before in the run; the first row always."""
    rows, some = cut(df.withColumn("_h", F.md5(value)), run, order)
    rows = lagged(rows, some, run, order, _was=F.struct("_h"))
    return rows.where(F.col("_was").isNull() | ~F.col("_h").eqNullSafe(F.col("_was._h"))).drop("_h", "_was", PART)


def check_timing(df: DataFrame, run: str, order: list[str], seconds: Column) -> DataFrame:
    """Check number, seconds since the first check and since the one before (0 for the first)."""
    rows, some = cut(df.withColumn("_s", seconds), run, order)
    rows = lagged(numbered_rows(rows, some, run, order, "check_number"), some, run, order, _was=F.col("_s"))
    rows = carry(rows, some, [run], _start=(F.min_by(F.struct("_s"), F.struct(*order)), F.first))
    first = F.first("_s").over(Window.partitionBy(run, PART).orderBy(*order))
    if some:
        first = F.when(F.col("_start").isNull(), first).otherwise(F.col("_start._s"))
    return rows.withColumns({"since_start": F.col("_s") - first, "since_last": F.coalesce(F.col("_s") - F.col("_was"), F.lit(0.0))}).drop("_s", "_was", "_start", PART)


def last_n(df: DataFrame, run: str, order: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(run).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("back", rank).where(F.col("back") <= n)


def token_budget(df: DataFrame, run: str, order: list[str], tokens: Column, limit: int) -> DataFrame:
    """Newest rows of each run whose tokens together stay within the limit."""
    rows, some = cut(df.withColumn("tokens", tokens), run, order)
    rows = carry(rows, some, [run], later=True, _newer=(F.sum("tokens"), F.sum))
    within = F.sum("tokens").over(Window.partitionBy(run, PART).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", plus(within, F.col("_newer")) if some else within).where(F.col("running") <= limit).drop("_newer", PART)


def path_scores(df: DataFrame, run: str, order: list[str], step: Column, gold: Column) -> DataFrame:
    """run, score, last of every run: steps of the gold path that the run walks in order, both without immediate repeats, and the run's last step.

    The gold path is an array, the same in all rows of a run; the score is null
    where it is null or empty. A run is never one array: stretches of STEPS steps
    are summed up by their common lengths with every part of the gold path, and
    SUMMARIES neighbours become one in each round, until each run has one.
    """
    most = df.groupBy(run).count().agg(F.max("count")).first()[0] or 0
    rows, some = cut(df.select(run, *order, F.struct(step.alias("v")).alias("_step"), gold.alias("_gold")), run, order)
    rows = lagged(rows, some, run, order, _was=F.col("_step")).where(~F.col("_step").eqNullSafe(F.col("_was")))
    at = F.row_number().over(Window.partitionBy(run, PART).orderBy(*order))
    path = F.transform(F.sort_array(F.collect_list(F.struct(*order, "_step"))), lambda x: x["_step"]["v"])
    held = rows.withColumn("_at", F.floor((at - 1) / STEPS)).groupBy(run, PART, "_at").agg(path.alias("_path"), F.first("_gold").alias("_gold"))
    held = held.withColumn("_gold", without_repeats(F.coalesce("_gold", F.array().cast(df.select(gold).schema[0].dataType))))
    out = held.select(run, PART, "_at", "_gold", path_summary(F.col("_gold"), F.col("_path")).alias("_sum"), F.struct(F.element_at("_path", -1).alias("v")).alias("_last"))
    stretches = 1 if most <= STEPS else -(-most // STEPS) + -(-most // RUN_ROWS) + 1  # at most
    while stretches > 1:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(PART, "_at")) - 1).withColumn("_at", F.floor(F.col("_n") / SUMMARIES))
        out = out.groupBy(run, "_at").agg(F.sort_array(F.collect_list(F.struct("_n", "_sum"))).alias("_sums"), F.first("_gold").alias("_gold"), F.max_by("_last", "_n").alias("_last"))
        sums = F.transform("_sums", lambda x: x["_sum"])
        out = out.withColumn("_sum", F.aggregate(F.slice(sums, 2, SUMMARIES), F.get(sums, F.lit(0)), lambda a, b: joined_summary(a, b, F.size("_gold")))).withColumn(PART, F.lit(0))
        stretches = -(-stretches // SUMMARIES)
    return out.select(run, F.when(F.size("_gold") > 0, F.get("_sum", F.size("_gold"))).cast("double").alias("score"), F.col("_last.v").alias("last"))


def phase_tag(df: DataFrame, run: str, order: list[str], plan: Column) -> DataFrame:
    """planning until a plan was seen and the current row is none."""
    rows, some = cut(df.withColumn("_plan", plan.cast("int")), run, order)
    rows = carry(rows, some, [run], _earlier=(F.max("_plan"), F.max))
    within = F.max("_plan").over(Window.partitionBy(run, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = F.greatest(within, F.col("_earlier").cast("int")) == 1
    return rows.withColumn("phase", F.when(seen & ~plan, "execution").otherwise("planning")).drop("_plan", "_earlier", PART)


def derived_status(df: DataFrame, run: str, order: list[str], status: Column, final: Column) -> DataFrame:
    """Status, which is final_answer_awaiting_input where input is awaited and one of the last two rows is a final answer; only changes."""
    rows, some = cut(df.withColumn("_final", final), run, order)
    rows = lagged(rows, some, run, order, _near=F.col("_final"))
    near = F.coalesce("_near", F.lit(False)) | F.col("_final")
    out = rows.withColumn("status", F.when((status == "awaiting_input") & near, "final_answer_awaiting_input").otherwise(status))
    return lagged(out, some, run, order, _was=F.col("status")).where(~F.col("status").eqNullSafe(F.col("_was"))).drop("_was", "_near", "_final", PART)
