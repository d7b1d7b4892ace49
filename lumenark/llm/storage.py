"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where it is unset (tests, one machine) a temporary one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lumenark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors cost nothing."""
    path = new_path(spark, name)
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished plans now: it goes by the driver's garbage collections, which come late on a small heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, root = spark.sparkContext._jvm, shared_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") == root.split(":", 1)[-1].lstrip("/"):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 8 << 20


def is_small(df: DataFrame) -> bool:
    """Whether its values take few enough bytes for a broadcast. df: saved, or cheap to read twice."""
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) if t == "string" else F.octet_length(f"`{c}`") if t == "binary" else F.lit(24) if t.startswith(("array", "struct")) else F.lit(8) for c, t in df.dtypes]
    size = df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16)))).first()[0] or 0
    return size <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small; else Spark joins it by shuffle."""
    return F.broadcast(df) if is_small(df) else df


#: A key that holds more than this share of the rows is met by a broadcast; there are fewer than so many of them.
HOT_SHARE = 4096


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with what facts (saved, one row a key) has for their key; weight: how many rows the key meets. Rows of a hot key stay where they are."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(weight) * HOT_SHARE > total).drop(weight))  # fewer than HOT_SHARE rows
    cold = facts.where(F.col(weight) * HOT_SHARE <= total).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
