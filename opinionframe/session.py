"""Session helpers: a default local session and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "opinionframe", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that exists."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``. Only where all executors are this very process
    (tests, benches) it may be unset; then it is one of our own. A cluster without it is an error."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opinionframe-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, in_loop: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    A checkpoint keeps what its plan knew of order, partitioning and constraints. In a loop each round would add to
    that of the last, and analysis would take ever longer; with ``in_loop`` it is a written table, which keeps nothing.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if not in_loop:
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of ``cut_lineage(..., in_loop=True)`` that nothing reads any more, so disk doesn't grow with rounds."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(t.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` over all cores before work in Python, if it comes in fewer partitions than there are; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
