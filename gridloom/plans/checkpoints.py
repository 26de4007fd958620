"""Tables that are written once, in the shared folder that the session names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder named in spark.checkpoint.dir. Only a local session (tests) does without: it gets a
    temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    use_shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def released(spark: SparkSession) -> str | None:
    """The driver gives back memory that was freed but is held by its allocators: Python's, and the JVM's native memory,
    where plans and compiled code of each table leave some. What the JVM says, or None if it has no such command."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # By reflection: the server's own class isn't open to callers, its interface is.
        named, kinds, values = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder."""
    use_shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    released(df.sparkSession)
    return done


def rewritten(df: DataFrame) -> DataFrame:
    """written() for tables that are made from themselves in rounds. A checkpoint keeps its plan's estimate of its size, and
    joins multiply estimates: over rounds, their digits double until they fill the driver. Here the estimate goes, too."""
    done = written(df)
    return DataFrame(done.sparkSession._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), done.sparkSession)


#: Rows go to Python in batches of so many bytes at most, besides Spark's bound on their number.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows with long lists would make batches of 10,000 rows too large; a smaller bound that is already set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def collected(df: DataFrame) -> pa.Table:
    """All rows in the driver, on their way compressed: else the bytes of large tables make its heap grow, and it stays so."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.compression.codec"
    before = conf.get(name, "none")
    conf.set(name, "zstd")
    try:
        return df.toArrow()
    finally:
        conf.set(name, before)
