"""What every query needs from its session: the package on the workers and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


#: Bytes of rows that go to a Python worker at once, about: rows may be whole books.
BATCH_BYTES = 16 << 20


def ship_package(spark: SparkSession) -> None:
    """Lets the Python workers import this package, where PYTHONPATH hasn't it, and bounds the bytes of their batches."""
    sc = spark.sparkContext
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if limit.isdigit() and int(limit) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_folio_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="folio-")) / "folio_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((ROOT / "folio").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._folio_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset and a single process does all work."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="folio-shared-")).as_uri()
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/folio/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and an executor's loss costs nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, tag)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folio_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a table made by written() that nothing reads any more."""
    folder = getattr(df, "_folio_folder", None)
    if folder:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
