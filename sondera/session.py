"""Session helpers: table access and fault-tolerant materialisation points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "sondera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; explicit conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the session has none, a private folder is made on a local master (tests); on a cluster executors
    could not share it, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sondera-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; the files outlive any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a side that is broadcast at most, and rows of a key from which meet() spreads it.
BROADCAST_BYTES, HOT_ROWS = 32 << 20, 500_000
#: Plan nodes whose work is not worth doing twice.
_WORK = re.compile("Aggregate|Join|Window|Map|Generate|Sort|Repartition|Limit|Python")


def fits(df: DataFrame) -> bool:
    """Whether the rows of ``df``, as text, are at most BROADCAST_BYTES. ``df`` should be stored or a plain scan."""
    spark = df.sparkSession
    files = df.inputFiles()
    jvm = spark._jvm
    size = 0
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
        # Packed files beyond the bound hold rows beyond it.
        if size > BROADCAST_BYTES:
            return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 16)).first()[0] or 0) <= BROADCAST_BYTES


def _ready(df: DataFrame) -> DataFrame:
    return store(df) if _WORK.search(df._jdf.queryExecution().optimizedPlan().toString()) else df


def small(df: DataFrame) -> DataFrame:
    """``df``, stored if it takes work, and marked for broadcast if its rows take at most BROADCAST_BYTES; else a shuffled join follows."""
    df = _ready(df)
    return F.broadcast(df) if fits(df) else df


def meet(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left or left_semi) with ``side`` on ``keys``, the same result by one of two ways.

    A side of proven size is broadcast. Otherwise both are shuffled, and a key of more than HOT_ROWS rows is
    spread: its rows by a hash of their content, the side's by repetition, so no task holds all of a key.
    At most one in HOT_ROWS rows can be the first of a hot key, which bounds the list of those that is broadcast.
    """
    side = _ready(side)
    if fits(side):
        return rows.join(F.broadcast(side), keys, how)
    rows = _ready(rows)
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.broadcast(store(parts))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    left = rows.join(parts, keys, "left").withColumn("_salt", salt).drop("_parts")
    right = side.join(parts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Rows of either side that one task of a blocked join pairs.
PAIR_BLOCK = 2048


def meet_in_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which a key of many rows on both sides is cut into blocks of PAIR_BLOCK rows a side.

    Every pair of blocks is a join key of its own, so no task holds all rows of a key. Both sides should be stored.
    """
    sizes = [d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias(c)) for d, c in ((left, "_p"), (right, "_q"))]
    # Keys of one block on each side need no entry.
    plan = store(sizes[0].join(sizes[1], keys).where("_p > 1 or _q > 1"))
    one = F.lit(1)

    def cut_up(d: DataFrame, own: str, other: str) -> DataFrame:
        cols = d.columns
        d = meet(d, plan, keys, "left").withColumns({"_p": F.coalesce("_p", one), "_q": F.coalesce("_q", one)})
        d = d.withColumn("_own", F.pmod(F.xxhash64(*cols), F.col(own).cast("long")).cast("int"))
        d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return d.select(*cols, *((F.col("_own").alias("_i"), F.col("_other").alias("_j")) if own == "_p" else (F.col("_other").alias("_i"), F.col("_own").alias("_j"))))

    return cut_up(left, "_p", "_q").join(cut_up(right, "_q", "_p"), [*keys, "_i", "_j"]).drop("_i", "_j")


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``time`` (nulls last); rows of equal time by the greatest content hash."""
    plain = [c for c, t in df.dtypes if "map<" not in t]
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), F.desc(F.xxhash64(*plain)))
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Unlike :func:`cut` it keeps columns apart, so later passes read only what they need. The folder
    belongs to the session's owner, who clears it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/sondera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
