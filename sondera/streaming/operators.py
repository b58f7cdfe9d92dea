"""Routing, deduplication, event-time windows and keyed state over streams of windows or events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sondera.functions.scores import stream_route
from sondera.operators.prefix import running_total
from sondera.session import checkpoint_folder, small


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON-line files of a directory; each line is emitted once, whatever the file's age."""
    return spark.readStream.schema(schema).json(path)


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a directory, or the one file of a path (read as a pattern, as the source takes directories only)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """Kafka values as JSON rows; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def routed(windows: DataFrame, path: str, signal: str, semantic: str) -> DataFrame:
    """Windows with their route; stateless."""
    return windows.withColumn("route", stream_route(F.col(path), F.col(signal), F.col(semantic)))


def deduplicated(events: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark: a source that re-reads its tail emits nothing twice."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, ts: str, width: str, delay: str, keys: list[str], value: str) -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, delay: str, keys: list[str]) -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, width, step).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def qgrams(windows: DataFrame, entity: str, order: str, signature: str, key: str, q: int = 3) -> DataFrame:
    """(entity, key, qgram) as windows arrive: the state of an entity is its last q - 1 signatures.

    Within a batch rows are taken by ``order``; a row older than the state is appended after it.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["o", "key"])
        out = []
        for key_, sig in zip(rows["key"], rows["sig"], strict=True):
            held.append(sig)
            if len(held) >= q:
                out.append((k[0], int(key_), "|".join(held[-q:])))
            held = held[-(q - 1) :] if q > 1 else []
        state.update((held,))
        yield pd.DataFrame(out, columns=["entity", "key", "qgram"])

    slim = windows.where(F.col(signature).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.col(order).cast("long").alias("o"), F.col(signature).alias("sig"), F.col(key).cast("long").alias("key"))
    return slim.groupBy("entity").applyInPandasWithState(run, "entity string, key long, qgram string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


SEEN = "key long, entity string, sig string, t long, repetitions long, first_seen long"


def repetition_batch(folder: str, lookback_ms: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over rows (key, entity, sig, t): writes SEEN to ``folder``, of each row the occurrences of its signature within the lookback, rows of its own time included.

    A row that was delivered before is left out. The state is what earlier batches wrote, of which a batch reads the stretch of time that
    its rows reach back to; a batch that runs again replaces its own part.
    """
    w = Window.partitionBy("entity", "sig").orderBy("t").rangeBetween(-lookback_ms, 0)
    cols = ["key", "entity", "sig", "t"]

    def run(df: DataFrame, batch: int) -> None:
        # One shuffle serves for duplicates and for the window.
        spread = lambda x: x.repartition("entity", "sig")
        if not batch:
            rows = spread(df).distinct().withColumn("_new", F.lit(True))
        else:
            df = df.persist()
            low, high = df.agg(F.min("t"), F.max("t")).first()
            reach = F.col("t").isNull() if low is None else F.col("t").isNull() | F.col("t").between(low - lookback_ms, high)
            held = df.sparkSession.read.schema(f"{SEEN}, batch long").parquet(folder).where(F.col("batch") < batch).where(reach).select(cols)
            both = spread(df.withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False))))
            rows = both.groupBy(cols).agg(F.min("_new").alias("_new"))
        out = rows.withColumns({"repetitions": F.count(F.lit(1)).over(w), "first_seen": F.min("t").over(w)}).where("_new").drop("_new")
        out.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if batch:
            df.unpersist()

    return run


def repetitions(windows: DataFrame, entity: str, ts_ms: str, signature: str, key: str, lookback_ms: int) -> DataFrame:
    """(entity, key, repetitions, first_seen) of all input that is there now, by :func:`repetition_batch`."""
    slim = windows.where(F.col(signature).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(entity).cast("string").alias("entity"), F.col(signature).alias("sig"), F.col(ts_ms).cast("long").alias("t"))
    spark = windows.sparkSession
    base = f"{checkpoint_folder(spark)}/sondera-stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], SEEN).write.parquet(f"{base}/out/batch=-1")
    writer = slim.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(repetition_batch(f"{base}/out", lookback_ms)).start().awaitTermination()
    return spark.read.schema(f"{SEEN}, batch long").parquet(f"{base}/out").select("entity", "key", "repetitions", "first_seen")


def transitions(bits: DataFrame, entity: str, order: str, bit: str) -> DataFrame:
    """(entity, at, state) of each bit after the first; the state of an entity is its previous bit."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for o, b in pd.concat(list(parts)).sort_values("o")[["o", "b"]].itertuples(index=False):
            if last is not None:
                out.append((k[0], int(o), "FLIP" if b != last else "RUPTURE" if b else "NULL"))
            last = int(b)
        state.update((last,))
        yield pd.DataFrame(out, columns=["entity", "at", "state"])

    slim = bits.where(F.col(bit).isin(0, 1)).select(F.col(entity).cast("string").alias("entity"), F.col(order).cast("long").alias("o"), F.col(bit).cast("int").alias("b"))
    return slim.groupBy("entity").applyInPandasWithState(run, "entity string, at long, state string", "last int", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """All input that is there now, run to its end into a Parquet table of the shared folder.

    In complete mode, where a file sink can't take part, each batch replaces the table.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/sondera-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def seen(sink: DataFrame, signature: str, *, limit: int = 20) -> DataFrame:
    """The newest windows of a signature, at most ``limit``."""
    return sink.where(F.col("signature") == signature).orderBy(F.desc("window_start"), F.desc("id")).limit(limit)


def micro_batches(requests: DataFrame, keys: list[str], order: list[str], size: int = 32) -> DataFrame:
    """Requests of one micro-batch with ``batch``: numbers of at most ``size`` requests of equal keys, in their order.

    For use in foreachBatch: the trigger's interval is the longest wait. Each (keys, batch) is then one call of the engine.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return requests.withColumn("batch", F.floor(n / size).cast("long"))


def replay(spark: SparkSession, rows: DataFrame, order: list[str], per_second: int) -> DataFrame:
    """An endless stream of ``rows`` in their order, again and again, ``per_second`` of them; ``turn`` counts the rounds. rows is a small table."""
    numbered = small(running_total(rows.withColumn("_one", F.lit(1)), order, "_one", "_place").drop("_one"))
    n = max(1, numbered.count())
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select("timestamp", (F.col("value") % n).alias("_place"), F.floor(F.col("value") / n).alias("turn")).join(numbered, "_place").drop("_place")
