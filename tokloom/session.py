"""Session construction and small session-level helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tokloom",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the library is written for.

    On a cluster the master, memory and checkpoint folder come from the
    submitter; only settings the library relies on are pinned here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("TOKLOOM_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is
    always used. Where nothing is configured a scratch folder serves a local
    master; on any other master executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tokloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder and cut lineage.

    Used where a plan branch must see exactly the same rows twice (values tied to
    a partitioning) and inside iterative loops. Survives executor loss because
    the files live in the shared checkpoint folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # Persisted first so that writing the checkpoint does not recompute it.
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a side that is usually small, on columns of the same name; null meets null.

    It is planned as a shuffle join; adaptive execution turns it into a broadcast
    when the bytes measured at run time are under its threshold, and splits
    skewed keys otherwise. Nothing depends on the side being small.
    """
    keys = {c: f"_on_{c}" for c in ([on] if isinstance(on, str) else on)}
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    return big.join(small.withColumnsRenamed(keys), same, how).drop(*keys.values())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder, which is removed when the application ends."""
    own = os.path.join(ensure_checkpoint_dir(spark), "scratch", spark.sparkContext.applicationId)
    if own not in _SWEPT:
        _SWEPT.add(own)
        atexit.register(_remove, spark, own)
    return os.path.join(own, f"{name}-{uuid.uuid4().hex}")


_SWEPT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the application still runs (handlers run before Spark's own, which stops it)."""
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back; lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
