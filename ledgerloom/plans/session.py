"""Lineage cuts in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named a local session gets a temporary one; on a cluster that
    is an error, as its machines don't see each other's folders."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows written as a table in the shared folder and read back: computed once, without what led to them, and lost
    executors lose nothing of them."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by columns over as many tasks as the session's shuffles have: for dear work on rows of a small file,
    which would be one task. Adaptive execution merges no partitions of a number that is asked for; the hash keeps Spark from
    taking an earlier shuffle by the same columns, which it merges, for this one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


#: Seconds between two sweeps at least.
SWEEP_EVERY = 5.0
_swept = [0.0]


def trim(spark: SparkSession) -> str:
    """Give back to the system what the driver's JVM has freed outside its heap, through its diagnostic command, and return
    what that says; empty where the JVM has none. The C library keeps such memory for the JVM's threads, and it grows with
    each plan that is compiled."""
    jvm = spark._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the interface's method, as the server's own class is not open to callers
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # of a command without arguments: its bean and name
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return str(invoke.invoke(server, given))
    except Py4JJavaError:
        return ""


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark deletes the shuffle files and broadcasts of finished steps only when the driver has
    collected what refers to them, and a long chain of written tables leaves many plans behind."""
    if time.monotonic() - _swept[0] > SWEEP_EVERY:
        gc.collect()  # what Python holds of the JVM's objects goes first
        spark._jvm.System.gc()
        trim(spark)
        _swept[0] = time.monotonic()


def release(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more, and what else is left of their making."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)
