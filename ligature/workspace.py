"""Where the engine keeps tables that cut a plan's lineage.

A cluster names a folder that all its executors reach in ``spark.checkpoint.dir``; everything that is
written goes below it. Only where that setting is absent (tests, a laptop) a folder of our own is made.
Tables are ordinary Parquet, so the loss of an executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Per cent of the heap that a collection leaves free at most.
_FREE = "MaxHeapFreeRatio"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="ligature-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Used where a result feeds several consumers or where rows depend on which task made them. The name
    only helps people who look into the folder; a random part keeps runs apart.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ligature/{name}-{uuid.uuid4().hex}"
    # what was shuffled for this table isn't read again once the table is there
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._ligature_path = path
    return out


def release(spark: SparkSession) -> None:
    """Free what ended queries left behind, in the driver's heap and in the executors' shuffle files.

    Plans, broadcast tables and states of shuffles are held until the driver collects its garbage. Left alone
    it first grows its heap to the limit, and lets the files stay, in jobs of many queries. Python collects
    first: models and plans in reference cycles of its own hold theirs in the JVM. The heap then shrinks to
    what is used and two thirds of that beside; by default it would keep more than twice as much beside. What
    the compiler and compressors have freed outside the heap stays with the C library, a few hundred MB, until
    it is told to give it back.
    """
    gc.collect()
    diagnostics = "com.sun.management:type=HotSpotDiagnostic"
    try:
        before = _manage(spark, diagnostics, "getVMOption", _FREE).get("value")
        _manage(spark, diagnostics, "setVMOption", _FREE, "40")
    except Py4JJavaError:  # a JVM without that setting, or with a larger least share
        before = None
    try:
        spark.sparkContext._jvm.System.gc()
    finally:
        if before is not None:
            _manage(spark, diagnostics, "setVMOption", _FREE, before)
    try:
        _manage(spark, "com.sun.management:type=DiagnosticCommand", "systemTrimNativeHeap")
    except Py4JJavaError:  # JVMs without that command are left as they are
        pass


def _manage(spark: SparkSession, bean: str, operation: str, *texts: str):
    """Call an operation of the driver's JVM; its parameters are texts."""
    sc = spark.sparkContext
    jvm = sc._jvm
    # by reflection, as the server's class is hidden in its module
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = sc._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName(bean), operation
    if texts:
        args[2], args[3] = sc._gateway.new_array(jvm.java.lang.Object, len(texts)), sc._gateway.new_array(jvm.java.lang.String, len(texts))
        for i, text in enumerate(texts):
            args[2][i], args[3][i] = text, "java.lang.String"
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def cached(spark: SparkSession, make: Callable[[], DataFrame], folder: str, tag: str) -> DataFrame:
    """The table ``folder/tag``; made and published there if nobody has done so yet."""
    from ligature.sources.sinks import publish

    path = f"{folder.rstrip('/')}/{tag}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        publish(make(), path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._ligature_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession) -> int:
    """Number of partitions for CPU-heavy narrow work: the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needless where the package is installed on all machines, harmless there.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_ligature_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ligature-package-"), "ligature.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("ligature", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._ligature_shipped = True


def scatter(df: DataFrame, *columns: str) -> DataFrame:
    """Rows spread by a hash of the columns over all cores, for steps whose work isn't told by their bytes.

    The hash is an expression of its own, so that neither an earlier shuffle on the same columns nor the
    joining of small partitions takes the place of this one.
    """
    from pyspark.sql import functions as F

    return df.repartition(spread(df.sparkSession), F.xxhash64(*columns))
