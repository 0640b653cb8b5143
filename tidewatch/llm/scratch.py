"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The JVM's diagnostic command that trims the C library's arenas.
TRIM = "systemTrimNativeHeap"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only on a local master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return _OWN[app]


def _array(spark: SparkSession, kind, *values):
    out = spark.sparkContext._gateway.new_array(kind, len(values))
    for k, x in enumerate(values):
        out[k] = x
    return out


def trim() -> None:
    """Gives memory that this Python process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """work over batches, after whose last batch the worker, which Spark keeps for later tasks, trims its memory."""

    @wraps(work)
    def run(*args, **named):
        yield from work(*args, **named)
        trim()

    return run


def release(spark: SparkSession) -> bool:
    """Asks the driver's JVM and Python to give memory that they have freed back to the system; whether the JVM could.

    Spark drops shuffle files, broadcasts and compiled classes only when the JVM's collector finds them unused. What its
    hundreds of threads, compilers and network buffers have freed outside the heap stays with the C library until that
    is told to trim its arenas, which some JVMs can't.
    """
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    trim()
    kind = jvm.java.lang.Class.forName
    try:
        # the server's own class is not open to Py4J, its interface is
        types = [kind(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", _array(spark, jvm.java.lang.Class, *types))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, _array(spark, jvm.java.lang.Object, commands, TRIM, None, None))
    except Py4JError:
        return False
    return True


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    Executors that are lost later cost nothing but a re-read, and the files carry real sizes, so that Catalyst's
    broadcast decisions rest on measured bytes. The folder goes when the driver's JVM ends. After each write the driver
    releases what it no longer uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)
