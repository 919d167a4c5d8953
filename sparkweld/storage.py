"""Tables between steps, and joins whose hot keys are dealt over several tasks.

Only ``spark.checkpoint.dir`` (or the session's checkpoint folder) is used for tables, so that every executor sees them
and a lost executor costs a re-read, never a recomputation of lost blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, as the session has it.

    Only where neither that setting nor a checkpoint folder is set and all runs on one machine (tests) a folder is
    made; a cluster without the setting is an error, as its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return named.rstrip("/") if named else now.get()


#: With this setting Spark removes an execution's shuffle files when it ends, and not when the collector finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back: lineage ends there, and the shuffle files of
    the write are removed at its end.

    ``by``: a column of few values that becomes folders, so that a filter on it reads nothing else.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    back = spark.read.schema(schema).parquet(path)
    back._saved_at = path
    return back


def drop(*saved: DataFrame) -> None:
    """Delete tables of ``save`` that nothing will read again."""
    for x in saved:
        path = x.sparkSession._jvm.org.apache.hadoop.fs.Path(x._saved_at)
        path.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Inner equi-join whose hot keys, and only these, are dealt over several tasks.

    ``small`` has a bounded number of rows a key; ``by`` are columns of ``big`` that tell the rows of a key apart. A key is
    hot when ``big`` has over a quarter of an even share of a partition of it, so there are at most four hot keys a
    partition to be sent out, and no other row is repeated.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = big.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("n")).withColumn("_share", F.greatest(F.lit(1000), F.floor(F.coalesce("n", F.lit(0)) / (4 * parts)))).select("_share")
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_rows") > F.col("_share")).select(*on, F.ceil(F.col("_rows") / F.col("_share")).cast("int").alias("_salts"))
    hot = save(hot, "hot-keys")
    if hot.isEmpty():
        return big.join(small, on)
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    right = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """``df``, read from one file, with each row's number in the file, from 1 on: rows are counted by task first."""
    x = df.withColumn("_at", F.monotonically_increasing_id())
    part, seat = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # one row a task
    counts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return x.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + seat + 1).drop("_part", "_at", "_before")
