"""Sessions, and this package's code on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def get_session(name: str = "tastegrid", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; what `conf` gives wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application, so that their Python can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tastegrid-code-")) / "tastegrid_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def stored_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="tastegrid-"))
    return f"{found.rstrip('/')}/tastegrid-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The result has a method `release` that deletes the table, for when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{stored_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)

    def release() -> None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    out.release = release
    return out
