"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; Spark's other settings are the cluster's."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def _on_path() -> bool:
    roots = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return os.path.realpath(_ROOT) in roots


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers the package, once per session, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    if _on_path() or getattr(context, "_lexmill_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((_ROOT / "lexmill").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._lexmill_shipped = True
    return spark


_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one if all is one machine."""
    global _fallback
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    return _fallback


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operation in the shared folder; ``close`` deletes them, and so does leaving a ``with`` block."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, fresh_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Written and read back."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
