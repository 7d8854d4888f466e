"""Helpers that the training-data operators share: table access, the shared
scratch folder, size-checked broadcasts and the native tokenisers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a join side is not broadcast (each such side has rows of
#: bounded width, so this bounds its bytes as well).
BROADCAST_ROWS = 1_000_000

#: Bytes above which a join side whose rows have no bounded width is not
#: broadcast, and bytes up to which a table of few files is dealt out anew.
BROADCAST_BYTES = 64 << 20
SPREAD_BYTES = 256 << 20

#: The word classes of the contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """``df``, of at most ``most`` bytes in files, over all cores if its files
    give fewer tasks than there are (one small file is one task, however much
    work its rows are). Larger tables stay as they are and aren't shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= most and df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``,
    or where that is unset, and driver and tasks are one process, a folder of
    our own. On a cluster a folder of one machine won't do: that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenql-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut by
    files that outlive any executor, and the work is done once."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete what this process wrote to the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is already stopped: nothing to delete with
            return


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None):
    """``df`` with a broadcast hint if it has at most ``limit`` rows (or, with
    ``weight``, if the weights of its rows sum to ``limit`` at most). Beyond
    that the join is left to shuffle, and to adaptive skew splitting.

    ``df`` should be materialised: it is counted here."""
    size = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def python_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The alphanumeric words of a text, in order."""
    return F.array_remove(F.split(fold_ascii(text), ALNUM_GAP), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
