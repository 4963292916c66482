"""The relational parts of conversations, judging and agent evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import shorten

# The judge's weights, the mark to pass, and the limits of a history.
WEIGHTS = {"accuracy": 0.30, "completeness": 0.25, "evidence": 0.25, "clarity": 0.20}
PASS = 6.0
HISTORY, TOOL_CHARS, TOOL_TAIL = 40, 2000, "... [truncated]"


def trim_history(messages: DataFrame, most: int = HISTORY, tool_chars: int = TOOL_CHARS) -> DataFrame:
    """The last `most` messages of each conversation, long tool outputs cut."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    text = F.when(F.col("role") == "tool", shorten(F.col("text"), tool_chars, TOOL_TAIL)).otherwise(F.col("text"))
    return messages.withColumn("_n", newest).where(F.col("_n") <= most).drop("_n").withColumn("text", text)


def last_answer(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """The last message of that role in each conversation."""
    return messages.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.max("turn").alias("turn"))


def judge_json(raw: Column) -> Column:
    """The judge's reply as a map of numbers: fences stripped, else the first braces, else empty."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    pick = F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)
    return F.coalesce(F.from_json(pick, "map<string,string>"), F.create_map().cast("map<string,string>"))


def judged(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Scores (0 where missing), the weighted mark and whether it passes."""
    out = rows.withColumn("_m", judge_json(F.col(raw)))
    for k in WEIGHTS:
        out = out.withColumn(k, F.coalesce(F.try_to_number(F.get(F.array(F.element_at("_m", F.lit(k))), F.lit(0)), F.lit("99")).cast("int"), F.lit(0)))
    mark = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.drop("_m").withColumn("weighted", F.round(mark, 6)).withColumn("passed", F.round(mark, 6) >= PASS)


def judge_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of the marks, the share that passes, tool calls, and what lacks evidence. Rows with an error or without marks are left out."""
    ok = rows.where("error is null and weighted is not null")
    return ok.groupBy(*by).agg(
        *(F.round(F.avg(k), 6).alias(k) for k in (*WEIGHTS, "weighted")), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
        F.round(F.avg("tool_calls"), 6).alias("tool_calls"), F.round(1 - F.avg("evidence") / 10, 6).alias("hallucination"), F.count(F.lit(1)).alias("cases"),
    )


def contexts(messages: DataFrame, most: int = 500) -> DataFrame:
    """Per conversation: the tool messages' texts, cut, and how many there were."""
    tools = messages.where(F.col("role") == "tool")
    rows = tools.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", shorten(F.col("text"), most, "...").alias("t")))).alias("l"))
    return rows.select("conv_id", F.size("l").alias("tool_calls"), F.array_join(F.transform("l", lambda x: x["t"]), "\n---\n").alias("context"))
