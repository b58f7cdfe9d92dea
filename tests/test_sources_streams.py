import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sondera.operators import traces
from sondera.plans import streams
from sondera.sources import binary_log, candles, files
from sondera.streaming import operators as ops


def test_window_log_round_trip_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(binary_log.WindowLog)
    path = str(tmp_path / "log")
    cols = [F.col("id"), (F.col("id") * 32).alias("window_start"), (F.col("id") * 32 + 64).alias("window_end"), F.lit(0).cast("long").alias("byte_start"), F.lit(64).cast("long").alias("byte_end")]
    cols += [F.lit(0.25).cast("float").alias(f) for f in ("coherence", "stability", "entropy", "rupture", "lambda_hazard")]
    cols += [F.lit(i).cast("int").alias(f) for i, f in enumerate(("sig_c", "sig_s", "sig_e", "flags"))] + [F.lit(0).cast("long").alias("reserved")]
    df = spark.range(50).select(*cols)
    df.write.format("windowlog").mode("append").save(path)
    df.limit(5).write.format("windowlog").mode("append").save(path)
    got = spark.read.format("windowlog").load(path)
    assert got.count() == 55 and got.where("window_end = window_start + 64 and coherence = 0.25 and sig_e = 2").count() == 55
    assert binary_log.RECORD.size == 64
    (tmp_path / "log" / "torn.log").write_bytes(binary_log.pack({"id": 7}) + b"half")
    assert spark.read.format("windowlog").load(path).count() == 56
    stream = spark.readStream.format("windowlog").load(path)
    assert ops.run_available(stream).count() == 56


def test_corpus_scan_filters_and_repairs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes(b"ok \xff bad")
    (tmp_path / "sub" / "a.md").write_text("hé")
    (tmp_path / "noext").write_text("x")
    got = {r.file_id: r for r in files.read_corpus(spark, str(tmp_path), extensions=["txt", ".md"]).collect()}
    assert set(got) == {"b.TXT", "sub/a.md"} and "�" in got["b.TXT"].text and got["sub/a.md"].byte_count == 3
    assert files.read_corpus(spark, str(tmp_path)).count() == 3
    h = files.content_hash(files.read_corpus(spark, str(tmp_path))).first()
    assert h.n_files == 3 and h.hash == files.content_hash(files.read_corpus(spark, str(tmp_path)).repartition(5)).first().hash


def test_candle_csv_and_json(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Time,O,High,LOW,Close,Vol\n2020-01-01T00:00:00Z,1,2,0.5,1.5,\n2020-01-01T01:00:00+01:00,1,2,0.5,1.6,7\nbad,1,2,3,4,5\n2020-01-01 02:00:00,x,2,3,4,5\n2020-01-01 03:00:00,1,2,1,2,3\n")
    got = [(r.timestamp_ms, r.close, r.volume) for r in candles.read_candles_csv(spark, str(tmp_path / "c.csv"), tz="Europe/Berlin").orderBy("timestamp_ms", "close").collect()]
    t = 1577836800000
    assert got == [(t, 1.5, 0.0), (t, 1.6, 7.0), (t + 7_200_000, 2.0, 3.0)]
    assert candles.read_candles_csv(spark, str(tmp_path / "c.csv"), end="2020-01-01T00:00:00+00:00").count() == 2
    (tmp_path / "bad.csv").write_text("Time,Open\n1,2\n")
    with pytest.raises(ValueError):
        candles.read_candles_csv(spark, str(tmp_path / "bad.csv"))
    one = {"time": "2020-01-01T00:00:00Z", "mid": {"o": "1", "h": "2", "l": "0.5", "c": "1.5"}, "volume": 3}
    for name, text in (("a", json.dumps([one])), ("b", json.dumps({"candles": [one]})), ("c", json.dumps(one) + "\n" + json.dumps({"t": t + 60000, "o": 1, "h": 1, "l": 1, "c": 1}) + "\n")):
        (tmp_path / name).write_text(text)
        rows = candles.read_candles_json(spark, str(tmp_path / name)).orderBy("timestamp_ms").collect()
        assert (rows[0].timestamp_ms, rows[0].high, rows[0].close) == (t, 2.0, 1.5) and len(rows) == (2 if name == "c" else 1)


def test_records_steps_spans_and_state(spark, tmp_path):
    text = "ID: r1\nClaim: water is wet\nFinal Answer: yes\nEvidence:\nIt flows.\n(sentence 1)\n---\nID: r2\nClaim: second\n---\n"
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    got = [(r.record_id, r.kind, r.content) for r in files.records(df, "k", "t").orderBy("ix", "line").collect()]
    assert got == [("r1", "id", "r1"), ("r1", "claim", "water is wet"), ("r1", "answer", "yes"), ("r1", "evidence", "It flows."), ("r1", "citation", "(sentence 1)"), ("r2", "id", "r2"), ("r2", "claim", "second")]
    step = {"id": "s1", "action": "apply_patch", "metadata": {"patch": "+++ b\n+def helper(x):\n+    return x\n-old", "failures": ["t"]}}
    for name, body in (("l", json.dumps(step) + "\n"), ("a", json.dumps([step])), ("o", json.dumps({"steps": [step]}))):
        (tmp_path / name).write_text(body)
        r = traces.step_tokens(files.read_steps(spark, str(tmp_path / name))).first()
        assert {"add_function_signature", "ast_function_def", "diff_add__few", "tests__failed"} <= set(r.structural) and "func:helper" in r.semantic
    (tmp_path / "s").write_text(json.dumps({"spans": ["one", {"text": "two"}, {"span": "three"}]}))
    assert sorted(r.span for r in files.read_spans(spark, str(tmp_path / "s")).collect()) == ["one", "three", "two"]
    (tmp_path / "state.json").write_text(json.dumps({"signals": [{"id": 1, "signature": "x"}]}))
    state = files.read_state(spark, str(tmp_path / "state.json"))
    assert state["signals"].count() == 1 and state["string_scores"].count() == 0


def test_plan_tokens(spark):
    df = spark.createDataFrame([(["at a"], "Move", ["a", "b"], ["at c"]), (None, None, None, None)], "state array<string>, action string, arguments array<string>, next_state array<string>")
    one, none = traces.plan_tokens(df).orderBy(F.desc("action")).collect()
    for token in ("at_c__UP", "at_a__RANGEEXP", "action__move__ACCEL", "action_arg1__b__ACCEL", "transition__RUPTURE", "transition__delta_size__few", "transition__relative_change__heavy", "action__argument_dropout__DRIFT"):
        assert token in one.structural.split()
    assert one.semantic[:3] == ["move", "at_c", "not_at_a"] and "arg_unused:b" in one.semantic
    assert "transition__delta_size__none" in none.structural


def test_features_lie_in_range(spark):
    w = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    t = spark.createDataFrame([("deliver", 0), ("unload", 1), ("load", 2), ("not_at_pkg1", 0), ("not_at_pkg1", 2), ("at_pkg1", 1)], "token string, window_id long")
    rows = {r.id: r for r in traces.logistics_features(w, t).collect()}
    assert len(rows) == 3 and rows[0].irreversibility > rows[2].irreversibility
    assert all(0 <= v <= 1 for r in rows.values() for v in list(r)[1:])
    assert traces.logistics_features(w.limit(0), t).count() == 0
    h = spark.createDataFrame([("t", i, c, 0.4, 0.6, {"x": float(i)}, 0.3) for i, c in enumerate([0.2, 0.9, 0.5])], "trace string, i int, coherence double, entropy double, stability double, state map<string,double>, path double")
    got = traces.causal_features(h, "trace", ["i"]).collect()
    assert len(got) == 3 and all(0 <= r[c] <= 1 for r in got for c in got[0].asDict() if c not in ("trace", "i", "state"))


def test_claims_and_rules(spark):
    s = spark.createDataFrame([("c1", False, True, True), ("c1", True, False, False), ("c2", False, False, False)], "claim string, admitted boolean, repaired boolean, cited boolean")
    m = traces.claim_metrics(s).first()
    assert (m.n_claims, m.hallucination_initial, m.hallucination_final, m.repair_yield, m.citation_coverage) == (2, 0.5, 0.5, 0.5, 0.5)
    df = spark.createDataFrame([("the risk is low", ["fatal"], ["risk"], ["Low"]), ("fatal", ["fatal"], None, None), (None, None, ["x"], None)], "t string, f array<string>, r array<string>, e array<string>")
    assert [r[0] for r in df.select(traces.rule_violations(*(F.col(c) for c in "tfre"))).collect()] == [False, True, True]
    p = spark.createDataFrame([("value 12 rose", 1, "value 13 rose", 0.9), ("value 12 rose", 2, "value 12 rises", 0.9)], "span string, rank int, text string, margin double")
    assert traces.repair(p).first().repair == "value 12 rises"


def test_streamed_bits_and_json_lines_once(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "1.json").write_text("".join(json.dumps({"e": "a", "o": i, "b": b}) + "\n" for i, b in enumerate([0, 0, 1, 1, 0])))
    s = ops.read_json_stream(spark, str(d), "e string, o long, b int")
    got = [r.state for r in ops.run_available(ops.transitions(s, "e", "o", "b")).orderBy("at").collect()]
    assert got == ["NULL", "FLIP", "RUPTURE", "FLIP"]


def test_stream_repetitions_of_ties_late_rows_and_many_signatures(spark, tmp_path):
    hour = 3_600_000
    rows = [(1, "a", "x", 0), (2, "a", "x", 2 * hour), (3, "a", "x", 2 * hour), (3, "a", "x", 2 * hour), (4, "a", "x", 8 * hour), (5, "a", "x", 8 * hour + 1), (6, None, "x", 0), (7, "a", None, 0), (8, "a", "x", None), (9, "a", "x", None)]
    schema = "id long, instrument string, signature string, window_start long"
    many = spark.range(100_000).select((F.col("id") + 100).alias("id"), F.lit("b").alias("instrument"), F.concat(F.lit("s"), "id").alias("signature"), F.col("id").alias("window_start"))
    spark.createDataFrame(rows, schema).unionByName(many).write.parquet(str(tmp_path / "signals.parquet"))
    began = time.monotonic()
    got = {r.key: (r.repetitions, r.first_seen) for r in streams.stream_repetitions(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 20
    want = {1: (1, 0), 2: (3, 0), 3: (3, 0), 4: (3, 2 * hour), 5: (2, 8 * hour), 6: (1, 0), 8: (2, None), 9: (2, None)}
    assert {k: v for k, v in got.items() if k < 100} == want and len(got) == 100_000 + len(want)
    assert all(got[k + 100] == (1, k) for k in range(100_000))
    # The same rows in batches: what came before counts, a second delivery and rows after it don't.
    d = tmp_path / "in"
    d.mkdir()
    for i, part in enumerate([rows[4:5], rows[:3], rows[3:4] + rows[5:]]):
        (d / f"{i}.json").write_text("".join(json.dumps(dict(zip(("id", "instrument", "signature", "window_start"), r, strict=True))) + "\n" for r in part))
        os.utime(d / f"{i}.json", (1e9 + i, 1e9 + i))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))
    got = sorted((r.key, r.repetitions, r.first_seen) for r in ops.repetitions(s, "instrument", "window_start", "signature", "id", 6 * hour).collect())
    assert got == sorted((k, *v) for k, v in (want | {4: (1, 8 * hour)}).items())
