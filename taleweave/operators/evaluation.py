"""Evaluation: the matrix of runs, judged answers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN, FRAME = 4, 200


def matrix(questions: DataFrame, models: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every question with every model and condition; all of them, however many they are."""
    return questions.crossJoin(models).crossJoin(conditions)


def remaining(runs: DataFrame, done: DataFrame) -> DataFrame:
    return runs.join(done.select("question_id", "model", "cond"), ["question_id", "model", "cond"], "left_anti")


def context(chat: Column, tokens: int, block: Column) -> Column:
    """The memory block and as much of the chat's end as the budget leaves."""
    room = F.greatest(F.lit(tokens * CHARS_PER_TOKEN - FRAME) - F.length(block), F.lit(0))
    tail = F.when(room > 0, F.substring(chat, F.greatest(F.length(chat) - room + 1, F.lit(1)), room)).otherwise("")
    return F.concat_ws("\n\n", F.when(block != "", block), tail)


def cost(questions: int, models: int, sizes: list[int]) -> dict:
    return {"calls": questions * models * 2 * len(sizes), "input_tokens": questions * models * sum(2 * s for s in sizes)}


def judged(raw: Column) -> Column:
    """score (0 to 2; errors 0) and reason of a judge's JSON."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "score double, reason string")
    score = F.least(F.lit(2), F.greatest(F.lit(0), F.coalesce(F.floor(found["score"]).cast("int"), F.lit(0))))
    return F.struct(score.alias("score"), F.coalesce(found["reason"], F.lit("unparsed")).alias("reason"))


def report(answers: DataFrame) -> DataFrame:
    n, of = F.count(F.lit(1)), lambda s: F.count_if(F.col("score") == s)
    return answers.groupBy("model", "cond").agg(F.round(F.avg("score"), 6).alias("mean"), F.round((of(2) + 0.5 * of(1)) / n, 6).alias("accuracy"), of(2).alias("full_marks"), of(1).alias("part"), of(0).alias("wrong"))


def win_rates(answers: DataFrame, base: str) -> DataFrame:
    b = answers.where(F.col("cond") == base).select("question_id", "model", F.col("score").alias("base"))
    j = answers.where(F.col("cond") != base).join(b, ["question_id", "model"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return j.groupBy("model", "cond").agg(F.count_if(F.col("score") > F.col("base")).alias("wins"), F.count_if(F.col("score") == F.col("base")).alias("ties"), F.count_if(F.col("score") < F.col("base")).alias("losses"))


def markdown(answers: DataFrame) -> str:
    """A report of a few rows; the aggregates are made on the cluster."""
    rows = report(answers).orderBy("model", "cond").collect()
    lines = ["| model | condition | mean | accuracy | full | part | wrong |", "| --- | --- | --- | --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r.model} | {r.cond} | {r.mean:.3f} | {r.accuracy:.3f} | {r.full_marks} | {r.part} | {r.wrong} |" for r in rows])
