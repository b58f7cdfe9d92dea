"""Plan, problem and validator texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain(c: Column) -> Column:
    """Text without comments from ';' to the line's end."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r";[^\n]*", "")


def plan_steps(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step, name, arguments) of a plan's lines "(action argument ...)", with or without "time:" before and "[cost]" behind."""
    actions = F.regexp_extract_all(F.lower(_plain(F.col(text))), F.lit(r"\(([^()]+)\)"), F.lit(1))
    rows = docs.select(key, F.posexplode(actions).alias("step", "a"))
    words = F.split(F.trim("a"), r"\s+")
    return rows.select(key, "step", words[0].alias("name"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("arguments"))


def problem_init(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, predicate): the ground predicates of a problem's (:init ...) block, words joined by '_'."""
    block = F.regexp_extract(F.lower(_plain(F.col(text))), r"\(:init((?:\s*\([^()]*\))*)", 1)
    rows = docs.select(key, F.explode(F.regexp_extract_all(block, F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("p"))
    return rows.select(key, F.regexp_replace(F.trim("p"), r"\s+", "_").alias("predicate"))


def validator_steps(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step, added, deleted): effects by step of a validator's output, "Checking next happening" starting a step."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "s"))
    w = Window.partitionBy(key).orderBy("line")
    rows = lines.withColumn("step", F.sum(F.col("s").startswith("Checking next happening").cast("int")).over(w)).where("step > 0")
    effect = lambda verb: F.when(F.col("s").rlike(rf"^\s*{verb} \("), F.regexp_replace(F.regexp_extract("s", r"\(([^()]+)\)", 1), r"\s+", "_"))
    return rows.groupBy(key, "step").agg(F.sort_array(F.collect_list(effect("Adding"))).alias("added"), F.sort_array(F.collect_list(effect("Deleting"))).alias("deleted"))
