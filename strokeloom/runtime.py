"""Session plumbing shared by every operator: shared tables, shipped code, bounded broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
#: Bytes a side may have to be hinted as a broadcast; beyond it the planner picks a shuffled join.
BROADCAST_BYTES = 8 << 20
#: Bytes of a batch of rows on its way to Python; rows with whole texts are long.
ARROW_BATCH_BYTES = 4 << 20
#: Spark's setting by which the shuffle files of an execution are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_written: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever the driver was started, and bound what they get at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BATCH_BYTES}b")
    root = os.path.dirname(PACKAGE_DIR)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, root))
    target = os.path.join(tempfile.mkdtemp(), "strokeloom_code.zip")
    with open(target, "wb") as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing (tests on one machine) is a local folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "strokeloom-shared")
    return f"{base.rstrip('/')}/strokeloom-{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and an executor's loss costs nothing.

    Spark is told to delete shuffle files when the execution that wrote them ends; they would else stay
    on the executors' disks until the driver happens to collect its garbage. Tables that are not dropped
    before are deleted when the driver's Python ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    df.write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    written._strokeloom_path = path
    _written[path] = spark
    return written


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(written: DataFrame) -> None:
    """Delete a table of :func:`table` that no later plan reads."""
    _delete(_written.pop(written._strokeloom_path), written._strokeloom_path)


@atexit.register
def _delete_all() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before
            return


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting: rows of at most ``limit`` bytes. A larger side keeps the planner's own join.

    A row is taken as 16 bytes, 8 for each number and 48 for each other column, so columns that may
    be longer are not for this. ``df`` should come from :func:`table`, so the count is cheap.
    """
    width = 16 + sum(8 if isinstance(f.dataType, NumericType) else 48 for f in df.schema.fields)
    most = limit // width
    return F.broadcast(df) if df.count() <= most else df
