"""Session plumbing shared by every operator: package shipping, staged tables, knobs.

Nothing here keeps state on a worker's local disk.  Intermediate tables go to the
folder named by ``spark.checkpoint.dir`` (shared by all executors on a cluster); a
temporary one is chosen only in local mode where that setting is absent, as in unit tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PKG = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(_PKG)
    fd, path = tempfile.mkstemp(prefix="ledgerloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, files in os.walk(_PKG):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if not f.endswith(".pyc"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    atexit.register(lambda p: os.path.exists(p) and os.remove(p), path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only in local mode."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_ledgerloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
        spark._ledgerloom_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage the way ``checkpoint()`` does, but columnar and compressed, so a
    later reader pays only for the columns it uses and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the application has ended already; the cluster's own cleanup applies


#: scans of at most this many bytes and splits are spread; larger ones are read as they are split
SPREAD_BYTES, SPREAD_SPLITS = 64 << 20, 7


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, for steps whose cost is Python and not reading.

    Only a plain scan of a small table in few splits is repartitioned, by ``keys``, so what is
    shuffled is bounded whatever the cluster's size; any plan with exchanges is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    plan = run.executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or int(str(run.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    if plan.execute().getNumPartitions() > min(SPREAD_SPLITS, cores - 1):
        return df
    return df.repartition(cores, *keys)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
