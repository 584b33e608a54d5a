"""Session helpers shared by every part of the library.

Nothing here assumes a shared local disk between the driver and the executors:
durable intermediate results go to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of an Arrow batch between the JVM and Python, where the session doesn't set them: rows may be long texts.
ARROW_BYTES = "8000000"
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: dict[str, str] = {}


def local_session(app: str = "tidebook", cores: int = 8, **conf: str) -> SparkSession:
    """A small local session in UTC, as the tests and the benchmark use it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in tests,
    a folder of this machine takes its place, which is right for local mode alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.realpath(os.path.join(tempfile.gettempdir(), "tidebook-checkpoints"))
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, whatever their path is, and bound their batches."""
    context = spark.sparkContext
    if spark.conf.get(_ARROW_SETTING, None) is None:
        spark.conf.set(_ARROW_SETTING, ARROW_BYTES)
    if _SHIPPED.get("app") == context.applicationId:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tidebook-"))
    target = os.path.join(folder, "tidebook_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    context.addPyFile(target)
    _SHIPPED["app"] = context.applicationId
