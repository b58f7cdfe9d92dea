"""Plan transitions, agent steps and window histories as columns: tokens and features."""

from __future__ import annotations

import ast
import difflib
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.session import store


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))))


def _predicates(c: Column) -> Column:
    tidy = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_")))
    return F.array_sort(F.array_distinct(tidy))


# The suffixes, names of sizes and bounds of the buckets below are fixed values.
def plan_tokens(df: DataFrame, *, state: str = "state", action: str = "action", arguments: str = "arguments", next_state: str = "next_state") -> DataFrame:
    """``df`` with ``structural`` (tokens joined by blanks) and ``semantic`` (array) of each transition.

    Predicates that appear, vanish or stay, the action and its arguments become tokens; the size of the
    change, its share of what stays and the arguments' part in it become buckets. Null states are empty.
    """
    before, after = _predicates(F.col(state)), _predicates(F.col(next_state))
    args = F.transform(F.coalesce(F.col(arguments), F.array().cast("array<string>")), F.lower)
    rows = df.withColumns({"_b": before, "_a": after, "_g": args, "_n": F.lower(F.coalesce(F.col(action), F.lit("")))})
    rows = rows.withColumns({"_up": F.array_except("_a", "_b"), "_down": F.array_except("_b", "_a"), "_keep": F.array_intersect("_a", "_b")})
    rows = rows.withColumns({"_ch": F.concat("_up", "_down")}).withColumns({"_k": F.size("_ch"), "_unused": F.filter("_g", lambda a: (a != "") & ~F.exists("_ch", lambda p: p.contains(a)))})
    tag = lambda c, t: F.transform(c, lambda x: F.concat(x, F.lit(t)))
    k, none = F.col("_k"), F.array().cast("array<string>")
    only = lambda cond, *t: F.when(cond, F.array(*(F.lit(x) if isinstance(x, str) else x for x in t))).otherwise(none)
    size = F.when(k <= 0, "none").when(k == 1, "single").when(k <= 3, "few").when(k <= 6, "several").otherwise("many")
    ratio = k / F.greatest(F.size("_keep"), F.lit(1))
    change = F.when(ratio == 0, "static").when(ratio < 0.5, "light").when(ratio < 1.25, "balanced").otherwise("heavy")
    hits = F.size(F.filter("_ch", lambda p: F.exists("_g", lambda a: (a != "") & p.contains(a))))
    share = hits / F.nullif(k, F.lit(0))
    fit = F.when(k == 0, "none").when(share < 0.34, "low").when(share > 0.67, "high").otherwise("medium")
    structural = F.concat(
        tag("_up", "__UP"), tag("_down", "__RANGEEXP"), tag("_keep", "__ZPOS"), only(F.col("_n") != "", F.concat(F.lit("action__"), F.col("_n"), F.lit("__ACCEL"))),
        F.transform("_g", lambda a, i: F.concat(F.lit("action_arg"), i.cast("string"), F.lit("__"), a, F.lit("__ACCEL"))), only((F.size("_up") > 0) & (F.size("_down") > 0), "transition__RUPTURE"),
        F.array(F.concat(F.lit("transition__delta_size__"), size), F.concat(F.lit("transition__relative_change__"), change), F.when(F.size("_unused") > 0, "action__argument_dropout__DRIFT").otherwise("action__argument_alignment__ZPOS"), F.concat(F.lit("action__effect_alignment__"), fit)),
    )
    semantic = F.concat(only(F.col("_n") != "", F.col("_n")), F.col("_up"), F.transform("_down", lambda x: F.concat(F.lit("not_"), x)), F.transform("_unused", lambda a: F.concat(F.lit("arg_unused:"), a)))
    helpers = ["_b", "_a", "_g", "_n", "_up", "_down", "_keep", "_ch", "_k", "_unused"]
    return rows.withColumns({"structural": F.array_join(structural, " "), "semantic": semantic}).drop(*helpers)


def transition_valid(valid: Column, is_valid: Column, status: Column, errors: Column) -> Column:
    """Whether a transition holds: its flags if it has any, else its status, else that it has no errors."""
    by_status = F.when(F.lower(status).isin("ok", "valid", "success", "passed"), True).when(F.lower(status).isin("invalid", "error", "failed", "failure"), False)
    return F.coalesce(valid, is_valid, by_status, F.coalesce(F.size(errors), F.lit(0)) <= 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_tokens(code: pd.Series) -> pd.Series:
    """Syntax tokens of Python text: kinds of nodes, buckets of their number and depth; unreadable text gives 'ast_unparsed'."""
    bucket = lambda n: "small" if n < 20 else "medium" if n < 100 else "large"

    def depth(node: ast.AST) -> int:
        level, nodes = 0, [node]
        while nodes:
            nodes = [c for n in nodes for c in ast.iter_child_nodes(n)]
            level += 1
        return level

    kinds = {ast.FunctionDef: "ast_function_def", ast.AsyncFunctionDef: "ast_function_def", ast.ClassDef: "ast_class_def", ast.Import: "ast_import", ast.ImportFrom: "ast_import", ast.For: "ast_loop", ast.While: "ast_loop", ast.If: "ast_branch", ast.Try: "ast_try", ast.Return: "ast_return", ast.Call: "ast_call"}

    def one(text: str | None) -> list[str]:
        if not text:
            return []
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return ["ast_unparsed"]
        nodes = list(ast.walk(tree))
        found = [kinds[type(n)] for n in nodes if type(n) in kinds]
        names = [f"func:{n.name}" for n in nodes if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        return list(dict.fromkeys([*found, *names, f"ast_nodes__{bucket(len(nodes))}", f"ast_depth__{bucket(depth(tree) * 4)}"]))

    return code.map(one)


def diff_tokens(patch: Column) -> Column:
    """Buckets of added and deleted lines of a unified diff, and whether it adds a function's head."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    count = lambda sign, head: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(head)))
    bucket = lambda n: F.when(n == 0, "none").when(n <= 3, "few").when(n <= 20, "some").otherwise("many")
    adds = F.exists(lines, lambda x: x.rlike(r"^\+\s*(async\s+)?def "))
    base = F.array(F.concat(F.lit("diff_add__"), bucket(count("+", "+++"))), F.concat(F.lit("diff_del__"), bucket(count("-", "---"))))
    return F.when(adds, F.concat(base, F.array(F.lit("add_function_signature")))).otherwise(base)


def added_code(patch: Column) -> Column:
    """The added lines of a diff, without their marks."""
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30)), "\n")


def step_tokens(steps: DataFrame, *, most: int = 16) -> DataFrame:
    """Agent steps with ``structural`` and ``semantic`` tokens, each once in order; semantic ones at most ``most``, the parameter."""
    m = "metadata"
    code = F.coalesce(F.col(f"{m}.content"), added_code(F.col(f"{m}.patch")))
    failures = F.coalesce(F.size(f"{m}.failures"), F.lit(0))
    head = F.array(F.concat(F.lit("action__"), F.lower("action")))
    result = F.when(failures > 0, F.array(F.lit("tests__failed"))).otherwise(F.array().cast("array<string>"))
    rows = steps.withColumn("_ast", python_tokens(code))
    structural = F.array_distinct(F.concat(head, diff_tokens(F.col(f"{m}.patch")), F.filter("_ast", lambda x: ~x.startswith("func:")), result))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", f"{m}.query", f"{m}.summary")), F.lit(r"[\p{L}_]{3,}"), F.lit(0))
    semantic = F.slice(F.array_distinct(F.concat(F.filter("_ast", lambda x: x.startswith("func:")), words)), 1, most)
    return rows.withColumns({"structural": structural, "semantic": semantic}).drop("_ast")


def difference_score(a: Column, b: Column) -> Column:
    """Mean absolute difference of two maps of numbers over all their keys, at most 1; 0 without keys."""
    empty = F.create_map().cast("map<string,double>")
    d = F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    v = F.map_values(d)
    return F.when(F.size(v) > 0, F.least(F.lit(1.0), F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))).otherwise(0.0)


def causal_features(df: DataFrame, trace: str, order: list[str], *, state: str = "state", path: str = "path") -> DataFrame:
    """Nine features in [0, 1] of each window from its metrics, state map and history within the trace."""
    w = Window.partitionBy(trace).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_d", difference_score(F.col(state), F.lag(state).over(w)))
    for c in ("coherence", "entropy"):
        rows = rows.withColumn(f"_v_{c}", F.abs(F.col(c) - F.lag(c).over(w)))
    rows = rows.withColumn("_acc", F.abs(F.col("coherence") - 2 * F.lag("coherence").over(w) + F.lag("coherence", 2).over(w)))
    mean = lambda c: F.coalesce(F.avg(c).over(run), F.lit(0.0))
    p = clamp(F.coalesce(F.col(path), F.lit(0.0)))
    features = {
        "irreversible_actions": F.col("_d") + (1 - F.col("stability")) * 0.5, "resource_commitment_ratio": p, "decision_reversibility": 1 - p, "unsatisfied_preconditions": F.col("entropy") * (1 - F.col("coherence")),
        "effect_cascade_depth": F.col("_d") + p * 0.5, "constraint_violation_distance": 1 - F.col("stability"), "action_velocity": mean("_v_coherence"), "state_divergence_rate": mean("_acc"), "pattern_break_score": mean("_v_entropy"),
    }
    return rows.select(*df.columns, *(clamp(v).alias(k) for k, v in features.items()))


# Weights of actions that can't be undone, their clusters, and the prefixes of met and unmet predicates.
ACTION_WEIGHTS = {"deliver": 1.25, "unload": 1.1, "load": 0.65, "drive": 0.4, "fly": 0.45}
ACTION_CLUSTERS = {"load": "loading_ops", "drive": "movement_ops", "unload": "delivery_ops", "deliver": "delivery_ops", "fly": "movement_ops"}
POSITIVE = ("at_", "in_", "vehicle_", "available", "ready")
NEGATIVE = ("not_at_", "not_in_", "not_vehicle_", "missing", "blocked")


def logistics_features(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, irreversibility, momentum, cluster_entropy, predicate_balance, predicate_delta) of each window.

    windows: (id), ids one after another; tokens: (token, window_id). Windows without tokens have neutral values.
    """
    pick = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    starts = lambda ps: F.array_contains(F.array(*(F.col("token").startswith(p) for p in ps)), True)
    t = tokens.select("window_id", "token", F.try_element_at(pick(ACTION_WEIGHTS), F.col("token")).alias("w"), F.try_element_at(pick(ACTION_CLUSTERS), F.col("token")).alias("cluster"), starts(POSITIVE).cast("int").alias("pos"), starts(NEGATIVE).cast("int").alias("neg"))
    per = t.groupBy("window_id").agg(F.sum("w").alias("w"), F.count("w").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cl = t.where("cluster is not null").groupBy("window_id", "cluster").agg(F.count(F.lit(1)).alias("k")).groupBy("window_id").agg(F.count(F.lit(1)).alias("m"), F.sum("k").alias("s"), F.sum(F.col("k") * F.log2("k")).alias("kl"))
    j = windows.select("id").join(per, F.col("id") == per["window_id"], "left").drop("window_id").join(cl, F.col("id") == cl["window_id"], "left")
    total = F.coalesce(F.col("pos") + F.col("neg"), F.lit(0))
    signed = F.when(total > 0, (F.col("pos") - F.col("neg")) / total).otherwise(0.0)
    h = F.coalesce(F.log2("s") - F.col("kl") / F.col("s"), F.lit(0.0))
    rows = j.withColumns({"delta": -signed, "irr": F.when(F.col("n") > 0, F.col("w") / (F.col("n") * max(ACTION_WEIGHTS.values()))).otherwise(0.0), "ce": h / F.greatest(F.lit(1.0), F.log2(F.greatest("m", F.lit(1)))), "bal": 0.5 + 0.5 * signed})
    # Ids follow each other, so the two windows before are met by equi-joins instead of one global order.
    rows = store(rows)
    before = lambda n, c: rows.select((F.col("id") + n).alias("id"), F.col("delta").alias(c))
    one_two = rows.join(before(1, "one"), "id", "left").join(before(2, "two"), "id", "left")
    one, two = F.col("one"), F.col("two")
    momentum = F.when(one.isNull(), 0.5 + 0.6 * F.col("delta")).when(two.isNull(), 0.5 + 0.55 * (F.col("delta") - one)).otherwise(0.5 + 0.4 * (F.col("delta") - 2 * one + two))
    return one_two.withColumn("mom", momentum).select("id", clamp(F.col("irr")).alias("irreversibility"), clamp(F.col("mom")).alias("momentum"), clamp(F.col("ce")).alias("cluster_entropy"), clamp(F.col("bal")).alias("predicate_balance"), clamp(F.abs("delta")).alias("predicate_delta"))


def history_features(df: DataFrame, trace: str, order: list[str], action: str, failure: Column) -> DataFrame:
    """Rows with the share of distinct actions so far, of rows without failure so far, and the mean change of the first."""
    w = Window.partitionBy(trace).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(trace, action).orderBy(*order)) == 1
    rows = df.withColumn("_f", (first & F.col(action).isNotNull()).cast("int")).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("entropy_so_far", F.sum("_f").over(run) / F.col("_i")).withColumn("stability_so_far", 1 - F.sum(failure.cast("int")).over(run) / F.col("_i"))
    rows = rows.withColumn("_c", F.abs(F.col("entropy_so_far") - F.lag("entropy_so_far").over(w)))
    return rows.withColumn("pattern_break", F.least(F.lit(1.0), F.greatest(F.col("entropy_so_far"), F.coalesce(F.avg("_c").over(run), F.lit(0.0))))).drop("_f", "_i", "_c")


def positional_zip(left: DataFrame, right: DataFrame, trace: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides joined by their place within the trace, as far as the shorter side goes."""
    number = lambda d, o: d.withColumn("_pos", F.row_number().over(Window.partitionBy(trace).orderBy(*o)))
    return number(left, left_order).join(number(right, right_order), [trace, "_pos"]).withColumnRenamed("_pos", "position")


def timeline(df: DataFrame, trace: str, order: list[str], start: Column, stop: Column) -> DataFrame:
    """Rows with ``at_ms``: midpoints of equal parts of [start, stop) in milliseconds."""
    i = F.row_number().over(Window.partitionBy(trace).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(trace))
    return df.withColumn("at_ms", (start + (i + 0.5) * (stop - start) / n).cast("long"))


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - similarity of two texts by matching blocks."""
    return pd.Series([None if x is None or y is None else 1 - difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def entities_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b\d+[\w%]*"), F.lit(0)))


def repair(proposals: DataFrame, *, max_ratio: float = 0.5, sigma: float = 0.15) -> DataFrame:
    """(span, repair): the first proposal by rank, of two at most, whose entities the span has, that is near it and has the margin.

    proposals: (span, rank, text, margin).
    """
    ok = (F.size(F.array_except(entities_of(F.col("text")), entities_of(F.col("span")))) == 0) & (F.col("margin") >= sigma)
    tried = proposals.where("rank <= 2").withColumn("ratio", edit_ratio(F.col("span"), F.col("text"))).withColumn("ok", ok & (F.col("ratio") <= max_ratio))
    return tried.groupBy("span").agg(F.min_by("text", F.when(F.col("ok"), F.col("rank"))).alias("repair"))


def rule_violations(text: Column, forbidden: Column, required: Column, entities: Column) -> Column:
    """Whether a text holds a forbidden phrase, lacks a required one, or has none of the entities asked for."""
    t = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    bad = F.exists(F.coalesce(forbidden, none), lambda x: t.contains(F.lower(x)))
    lacks = ~F.forall(F.coalesce(required, none), lambda x: t.contains(F.lower(x)))
    ents = F.coalesce(entities, none)
    return bad | lacks | ((F.size(ents) > 0) & ~F.exists(ents, lambda x: t.contains(F.lower(x))))


def claim_metrics(sentences: DataFrame) -> DataFrame:
    """(n_claims, hallucination_initial, hallucination_final, repair_yield, citation_coverage).

    sentences: (claim, admitted, repaired, cited), a row for each answer sentence. A claim hallucinates
    while no sentence of it is admitted; repair counts what is admitted after it.
    """
    per = sentences.groupBy("claim").agg(F.bool_or("admitted").alias("a"), F.bool_or(F.col("admitted") | F.col("repaired")).alias("r"), F.bool_or("cited").alias("c"), F.count_if(~F.col("admitted")).alias("blocked"), F.count_if(~F.col("admitted") & F.col("repaired")).alias("fixed"))
    rate = lambda c: F.avg((~c).cast("double"))
    return per.agg(F.count(F.lit(1)).alias("n_claims"), rate(F.col("a")).alias("hallucination_initial"), rate(F.col("r")).alias("hallucination_final"), F.when(F.sum("blocked") > 0, F.sum("fixed") / F.sum("blocked")).otherwise(0.0).alias("repair_yield"), F.avg(F.col("c").cast("double")).alias("citation_coverage"))
