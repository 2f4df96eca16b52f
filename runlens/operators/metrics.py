"""Aggregates over scores: summaries, groups, repeated runs, intervals, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """mean_score, max_score, num_tasks; an error where there is no score."""
    n = F.count(score)
    return scores.agg(F.round(F.when(n > 0, F.avg(score)).otherwise(F.raise_error(F.lit("no scores to sum up"))), 6).alias("mean_score"), F.max(score).cast("double").alias("max_score"), n.alias("num_tasks"))


def score_summary_by_key(scores: DataFrame, score: str = "score") -> DataFrame:
    """The same for a map of scores, over the rows that hold each key."""
    return scores.select(F.explode(score).alias("key", "value")).where("value is not null").groupBy("key").agg(F.round(F.avg("value"), 6).alias("mean_score"), F.max("value").alias("max_score"), F.count("*").alias("num_tasks"))


def accuracy_by_group(scores: DataFrame, *groups: str, score: str = "score") -> DataFrame:
    return scores.groupBy(*groups).agg(F.round(F.avg(score), 6).alias("accuracy"), F.count(score).alias("n"))


def half_width(p: Column, n: Column) -> Column:
    """Half of a 95 % interval of a proportion."""
    return F.round(1.96 * F.sqrt(p * (1 - p) / n), 6)


def accuracy_ci(scores: DataFrame, *groups: str, score: str = "score") -> DataFrame:
    return scores.groupBy(*groups).agg(F.avg(score).alias("p"), F.count(score).alias("n")).select(*groups, F.round("p", 6).alias("accuracy"), "n", half_width(F.col("p"), F.col("n")).alias("half_width"))


def combine_runs(scores: DataFrame, run: str, score: str = "score") -> DataFrame:
    """Mean of the runs' means (unweighted) and maximum of their maxima; needs two runs, else no row."""
    per = scores.groupBy(run).agg(F.avg(score).alias("mean"), F.max(score).alias("top"), F.count(score).alias("n"))
    return per.agg(F.round(F.avg("mean"), 6).alias("mean_score"), F.max("top").cast("double").alias("max_score"), F.round(F.avg("n"), 6).alias("num_tasks"), F.count("*").alias("num_runs")).where("num_runs >= 2")


def average_time(times: DataFrame, run: str, duration: str) -> DataFrame:
    """Per run the mean of known durations (-1: unknown) and their total."""
    known = F.when(F.col(duration) != -1, F.col(duration))
    return times.groupBy(run).agg(F.round(F.avg(known), 6).alias("avg_task_time"), F.round(F.sum(known), 4).alias("total_time"))


def average_run_time(times: DataFrame, run: str, duration: str) -> DataFrame:
    """Total known time over the number of runs."""
    known = F.when(F.col(duration) != -1, F.col(duration))
    return times.agg(F.round(F.sum(known) / F.count_distinct(run), 3).alias("avg_run_time"), F.count_distinct(run).alias("num_runs"))


def run_outcome(scores: DataFrame, good: Column) -> DataFrame:
    return scores.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def accuracy_variants(scores: DataFrame, unable: Column, *groups: str, score: str = "score") -> DataFrame:
    """Success rate, rate of unable answers, accuracy without them (null if none is left) and with them as correct."""
    return scores.groupBy(*groups).agg(
        F.round(F.avg(score), 6).alias("success_rate"),
        F.round(F.avg(unable.cast("double")), 6).alias("unable_rate"),
        F.round(F.avg(F.when(~unable, F.col(score))), 6).alias("accuracy_excluding"),
        F.round(F.avg(F.when(unable, 1.0).otherwise(F.col(score))), 6).alias("accuracy_counting"),
    )


def token_totals(usage: DataFrame, client: str, prompt: str, completion: str, left_out: str) -> DataFrame:
    use = F.col(client) != left_out
    return usage.agg(F.sum(F.when(use, F.col(prompt))).alias("prompt_tokens"), F.sum(F.when(use, F.col(completion))).alias("completion_tokens"))


def reply_counts(messages: DataFrame, run: str, execution: Column, planning: Column) -> DataFrame:
    return messages.groupBy(run).agg(F.count_if(execution).alias("execution_replies"), F.count_if(planning).alias("planning_replies"))


def reply_stats(counts: DataFrame, col: str) -> DataFrame:
    """Mean, median, maximum, minimum; mean and median of those with at least one; share with at least one."""
    some = F.when(F.col(col) >= 1, F.col(col))
    return counts.agg(
        F.round(F.avg(col), 6).alias("mean"), F.median(col).alias("median"), F.max(col).alias("max"), F.min(col).alias("min"),
        F.round(F.avg(some), 6).alias("mean_some"), F.median(some).alias("median_some"), F.round(F.avg((F.col(col) >= 1).cast("double")), 6).alias("share_some"),
    )


def value_share(rows: DataFrame, flag: str, unable: Column) -> DataFrame:
    """Count and percent of each value of a flag, nulls left out, over all rows and over those that weren't unable."""
    counted = rows.where(F.col(flag).isNotNull()).groupBy(flag).agg(F.count("*").alias("n"), F.count_if(~unable).alias("n_able"))
    total = counted.agg(F.sum("n").alias("t"), F.sum("n_able").alias("t_able"))  # one row
    return counted.crossJoin(F.broadcast(total)).select(flag, "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("percent"), "n_able", F.round(100 * F.col("n_able") / F.col("t_able"), 4).alias("percent_able"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
