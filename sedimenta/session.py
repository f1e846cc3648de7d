"""Session helpers: settings for local runs, the shared checkpoint folder, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "sedimenta") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so Python workers can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sedimenta-")) / "sedimenta.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("sedimenta") / p.relative_to(root)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    `spark.checkpoint.dir` decides. Only a local session without that setting gets a temporary folder: on a cluster a
    folder of one machine would be lost with it, so there its absence is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sedimenta-checkpoint-")
    sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written below the checkpoint folder, for loops: a checkpointed DataFrame carries the constraints of its
    plan on, and in a loop of joins these multiply with each round; a table read again starts afresh.

    Each table can be discarded when the next round no longer reads it; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self._fs().deleteOnExit(self._path(self.folder))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, folders: list[str] | None = None) -> DataFrame:
        """`df` read again from where it was written; folders: columns whose values are folders of the table."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path, partitionBy=folders)
        again = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((again, path))
        return again

    def discard(self, df: DataFrame | None) -> None:
        """Delete the table behind `df`, which must have come from `write`; None is allowed."""
        for known, path in self.tables:
            if known is df:
                self._fs().delete(self._path(path), True)
        self.tables = [x for x in self.tables if x[0] is not df]


_SCRATCH: dict[str, Scratch] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written once, as a compressed table in the shared folder, and read from there: lineage ends, and a lost executor costs nothing that was written."""
    return scratch(df.sparkSession).write(df)


def scratch(spark: SparkSession) -> Scratch:
    """The scratch folder of an application."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = Scratch(spark)
    return _SCRATCH[app]


def discard(*tables: DataFrame) -> None:
    """Delete what `checkpoint` wrote for these tables; nothing may read them any more. Others go when the application ends."""
    for df in tables:
        scratch = _SCRATCH.get(df.sparkSession.sparkContext.applicationId)
        if scratch:
            scratch.discard(df)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
