"""Corpus files, states, span sources, claims and step logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRIC = "struct<coherence: double, stability: double, entropy: double, rupture: double, lambda_hazard: double>"
STEP = "id string, action string, timestamp string, metadata struct<file_path: string, patch: string, content: string, failures: array<string>, diagnostics: array<string>, query: string, summary: string>"


def read_corpus(spark: SparkSession, root: str, *, extensions: list[str] | None = None) -> DataFrame:
    """(file_id, path, text, byte_count, char_count) of every file below ``root``, recursively.

    With extensions given, files of others or of none are left out; case is ignored. Bytes that are no
    UTF-8 become U+FFFD. file_id is the path relative to the root, whose order is the corpus order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    if extensions is not None:
        files = files.where(ext.isin([e.lower().lstrip(".") for e in extensions]))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), rf"^{root.rstrip('/')}/", "")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(rel.alias("file_id"), "path", text.alias("text"), F.length("content").alias("byte_count"), F.length(text).alias("char_count"))


def read_bytes(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, data) of raw files, at most ``max_bytes`` of each if given: the loader's own parameter."""
    files = spark.read.format("binaryFile").load(path)
    data = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    return files.select("path", data.alias("data"))


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """signals and string_scores of a state document; a member that is missing is an empty table."""
    schema = f"signals array<struct<id: bigint, window_start: bigint, window_end: bigint, signature: string, metrics: {METRIC}, lambda_hazard: double>>, string_scores map<string, struct<occurrences: bigint, window_ids: array<bigint>, metrics: {METRIC}, patternability: double, connector: double>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return {"signals": doc.select(F.inline("signals")), "string_scores": doc.select(F.explode("string_scores").alias("string", "s")).select("string", "s.*")}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A state as one Parquet table for each member."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(span) of a JSON list of strings or objects, or of {"spans": [...]}; objects give their text or span field."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    body = F.coalesce(F.get_json_object("value", "$.spans"), F.col("value"))
    items = raw.select(F.explode(F.from_json(body, "array<string>")).alias("item"))
    return items.select(F.coalesce(F.get_json_object("item", "$.text"), F.get_json_object("item", "$.span"), F.when(~F.col("item").startswith("{"), F.col("item"))).alias("span")).where("span is not null")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, expected string, gold_uris array<string>, rules struct<forbidden: array<string>, required: array<string>, entities: array<string>>").json(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Agent steps of JSON lines, a JSON list, or {"steps": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    whole = F.trim("value")
    body = F.coalesce(F.get_json_object(whole, "$.steps"), F.when(whole.startswith("["), whole), F.concat(F.lit("["), F.array_join(F.filter(F.split(whole, r"\n"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    return raw.select(F.inline(F.from_json(body, f"array<struct<{_fields(STEP)}>>")))


def _fields(ddl: str) -> str:
    """A DDL column list as struct fields."""
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += ch
    return ", ".join(out)


def parse_records(text: Column) -> Column:
    """Chunks between lines '---' of a record file."""
    return F.filter(F.split(text, r"(?m)^---\s*$"), lambda x: F.trim(x) != "")


def records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ix, record_id, kind, line, content): the lines of delimited records by section.

    Sections start with "ID:", "Claim:", "Final Answer:" or "Evidence:"; a line that starts with
    "(sentence" is a citation. Lines before any section are 'other'. A section is carried to the
    following lines by a running last value over the line number.
    """
    chunks = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(parse_records(F.col(text))).alias("ix", "chunk"))
    lines = chunks.select(key, "ix", F.posexplode(F.split("chunk", r"\r?\n")).alias("line", "raw"))
    raw = F.trim("raw")
    head = F.when(raw.startswith("ID:"), "id").when(raw.startswith("Claim:"), "claim").when(raw.startswith("Final Answer:"), "answer").when(raw.startswith("Evidence:"), "evidence")
    w = Window.partitionBy(key, "ix").orderBy("line")
    rows = lines.withColumn("head", head).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("other")))
    kind = F.when(raw.startswith("(sentence"), "citation").otherwise(F.col("section"))
    content = F.trim(F.regexp_replace("raw", r"^\s*(ID|Claim|Final Answer|Evidence):", ""))
    rows = rows.withColumn("kind", kind).withColumn("content", content)
    rid = F.max(F.when(F.col("head") == "id", F.col("content"))).over(Window.partitionBy(key, "ix"))
    return rows.withColumn("record_id", rid).where("content <> ''").select(key, "ix", "record_id", "kind", "line", "content")


def workflow_steps(runs: DataFrame) -> DataFrame:
    """One row a step of {workflow_runs: [{id, name, html_url, steps: [...]}]} documents."""
    return runs.select(F.inline("workflow_runs")).select("id", "name", "html_url", F.posexplode("steps").alias("step_ix", "s")).select("id", "name", "html_url", "step_ix", F.col("s.name").alias("step"), F.col("s.conclusion").alias("conclusion"), F.col("s.status").alias("status"), F.col("s.duration_ms").alias("duration_ms"))


def content_hash(files: DataFrame) -> DataFrame:
    """(hash, n_files): one digest over the sorted digests of path and content of (file_id, text)."""
    one = F.sha2(F.concat_ws("\0", "file_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).cast("binary"), 256)
    # Digests are summed in ranges of their first byte, so no task holds them all.
    part = files.select(one.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", "h"))), "").cast("binary"), 256).alias("hash"), F.sum("n").alias("n_files"))
